"""Readers, writers, plans and streaming."""

from __future__ import annotations

import json
import re
import urllib.error

import pytest
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import urls as U
from tidemark.plans import outputs, pipelines
from tidemark.sources import files, maps, offers, web
from tidemark.streaming import poll

KML = """<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>d</name>
<Placemark><name>solto</name></Placemark>
<Folder><name>Eventos</name><Folder><name>Dentro</name><Placemark><name>A - SP</name><description><![CDATA[veja http://x.org/a.<br>fim]]></description>
<ExtendedData><Data name="DATA"><value>1/1/2020</value></Data><Data name="DATA"><value>15/7/2026</value></Data><Data name="MARCADOR"><value>10:00</value></Data></ExtendedData>
<Point><coordinates> -46.1,-23.5,0 </coordinates></Point></Placemark></Folder>
<Placemark><name>B</name><address>Rua, RJ</address></Placemark></Folder></Document></kml>"""


def rows(spark, fields, *values):
    return spark.createDataFrame([tuple(v.get(f, "") for f in fields) for v in values], S.strings(fields))


def test_map_to_events(spark, tmp_path):
    (tmp_path / "m.kml").write_text(KML)
    markers = maps.read_map(spark, str(tmp_path / "m.kml"))
    assert maps.count_markers(spark, str(tmp_path / "m.kml")) == 3 and maps.count_markers(spark, str(tmp_path / "none")) == 0
    got = [r.asDict() for r in files.events_from_markers(markers, "2026-07-14").orderBy("seq").collect()]
    assert [(r["nome"], r["camada"]) for r in got] == [("solto", ""), ("A - SP", "Dentro"), ("B", "Eventos")]
    a = got[1]
    assert (a["data"], a["hora_marcador"], a["status_data"], a["uf"], a["latitude"], a["longitude"], a["link"], a["descricao"]) == (
        "2026-07-15", "10:00", "futuro_ou_hoje", "SP", "-23.5", "-46.1", "http://x.org/a.", "veja http://x.org/a. | fim",
    ) or a["link"] == "http://x.org/a"
    assert got[2]["uf"] == "RJ" and got[2]["status_data"] == "sem_data"


def test_csv_round_trip(spark, tmp_path):
    hard = {"nome": 'diz "oi", sim', "descricao": "duas\nlinhas\\", "uf": ""}
    files.write_csv(rows(spark, S.EVENT_FIELDS, hard), str(tmp_path / "e"), S.EVENT_FIELDS)
    back = files.read_csv(spark, str(tmp_path / "e"), S.EVENT_FIELDS).collect()
    assert [(r["nome"], r["descricao"], r["uf"]) for r in back] == [(hard["nome"], hard["descricao"], "")]
    assert files.count_csv(spark, str(tmp_path / "e")) == 1 and files.count_csv(spark, str(tmp_path / "no")) == 0
    assert files.read_csv(spark, str(tmp_path / "no"), S.EVENT_FIELDS).count() == 0


@pytest.mark.parametrize(("text", "want"), [('{"lotes": [{"titulo": "Trator"}, {"titulo": "Login"}, {"titulo": "x", "lote": "9.19"}, 3]}', ["Trator"]), ('[{"titulo": "T"}]', ["T"]), ("{kaputt", []), ('{"lotes": 3}', [])])
def test_snapshot_reader(spark, tmp_path, text, want):
    (tmp_path / "l.json").write_text(text)
    assert [r["titulo"] for r in files.read_snapshot(spark, str(tmp_path / "l.json")).orderBy("seq").collect()] == want
    assert files.read_snapshot(spark, str(tmp_path / "none.json")).count() == 0


def test_snapshot_by_lines(spark, tmp_path, monkeypatch):
    """no row holds the whole snapshot; its lines in many files are one document, read back in order."""
    lots = spark.range(0, 3000, numPartitions=5).select((F.col("id") * 2).alias("seq"), *[(F.concat(F.lit('a "\n'), F.col("id").cast("string")) if c == "titulo" else F.lit("")).alias(c) for c in S.LOT_FIELDS])
    monkeypatch.setattr(files, "snapshot_payload", None)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for one_file in (True, False):
        path = str(tmp_path / f"s{one_file}")
        files.write_snapshot(lots, spark.createDataFrame([(3000,)], "total_lotes int"), path, one_file=one_file)
        assert (len(list((tmp_path / f"s{one_file}").glob("part-*"))) == 1) == one_file and files.read_totals(spark, path) == {"total_lotes": 3000}
        want = [f'a "\n{i}' for i in range(3000)]
        assert [x["titulo"] for x in files.read_object(spark, path)["lotes"]] == want
        got = files.read_snapshot(spark, path, only_valid=False).orderBy("seq").collect()
        assert [r["titulo"] for r in got] == want and [r["seq"] for r in got] == list(range(3000))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files.write_snapshot(lots.limit(0), spark.createDataFrame([(0,)], "total_lotes int"), str(tmp_path / "no"))
    assert files.read_object(spark, str(tmp_path / "no")) == {"total_lotes": 0, "lotes": []} and files.read_snapshot(spark, str(tmp_path / "no")).isEmpty()


@pytest.mark.parametrize("text", ['{"lotes": [%s]}'])
def test_snapshot_beyond_a_variant(spark, tmp_path, text):
    (tmp_path / "l.json").write_text(text % ", ".join('{"titulo": "%s%d"}' % ("x" * 10_000_000, i) for i in range(14)))
    got = files.read_snapshot(spark, str(tmp_path / "l.json")).select("seq", F.length("titulo").alias("n")).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [(i, 10_000_001 + (i > 9)) for i in range(14)]


def test_payload_and_page(spark):
    lots = rows(spark, S.LOT_FIELDS, {"titulo": "b"}, {"titulo": "a"}).withColumn("seq", F.when(F.col("titulo") == "a", 1).otherwise(0))
    value = json.loads(files.snapshot_payload(lots, spark.createDataFrame([(2,)], "total_lotes int")).first()["value"])
    assert value["total_lotes"] == 2 and [x["titulo"] for x in value["lotes"]] == ["b", "a"]
    assert files.site_page("<x>MARK</x>", '{"a":"</script>"}', "MARK") == '<x>{"a":"<\\/script>"}</x>'
    with pytest.raises(ValueError):
        files.site_page("x", "{}", "MARK")


def test_fetch_contract():
    def gone(request, timeout):
        raise urllib.error.HTTPError("u", 404, "x", {"content-type": "text/html"}, None)

    def broken(request, timeout):
        raise OSError("down")

    seen = []

    class Answer:
        status, headers = 200, {"content-type": "text/plain"}

        def __init__(self, request):
            seen.append(request.full_url)
            if len(seen) == 1:
                raise OSError("first")

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

        def read(self, n):
            return b"x" * n

        def geturl(self):
            return "http://final"

    policy = web.Policy(1, 10, 1, 0)
    assert web.fetch("http://u", policy, gone).row() == ("http://u", 404, b"", "text/html", "http://u")
    assert web.fetch("http://u", policy, broken).row()[1:3] == (0, b"down")
    drive = "https://drive.google.com/file/d/abc/view"
    got = web.fetch(drive, web.Policy(1, 4, 3, 0), lambda request, timeout: Answer(request))
    assert got.row() == (drive, 200, b"xxxx", "text/plain", "http://final") and seen == ["https://drive.google.com/uc?export=download&id=abc"] * 2
    parts = web.WebReader({"urls": "http://a/1\nhttp://b/1\nhttp://a/2"}).partitions()
    assert [p.urls for p in parts] == [["http://a/1", "http://a/2"], ["http://b/1"]]
    split = web.WebReader({"urls": "\n".join(f"http://a/{k}" for k in range(40)), "slots": "4"}).partitions()
    assert len(split) == 4 and sorted(u for p in split for u in p.urls) == sorted(f"http://a/{k}" for k in range(40))


def test_offline_fetch_and_kind(spark):
    pages = spark.createDataFrame([("http://a", "x")], "url string, html string")
    got = {r["url"]: r["status"] for r in web.offline(pages, spark.createDataFrame([("http://a",), ("http://b",)], "url string")).collect()}
    assert got == {"http://a": 200, "http://b": 404}
    kinds = spark.createDataFrame([("http://a/x.PDF?y", "", b""), ("u", "application/pdf", b""), ("u", "", b"%PDF-1"), ("u", "text/html", b"<")], "u string, t string, b binary")
    assert [r[0] for r in kinds.select(web.is_pdf("u", "t", "b")).collect()] == [True, True, True, False]
    assert spark.createDataFrame([("ç".encode("latin-1"), "text/html; charset=ISO-8859-1")], "b binary, t string").select(web.decoded(F.col("b"), F.col("t"))).first()[0] == "ç"


def test_paged_offers():
    page = lambda n, total: web.Fetched("u", 200, json.dumps({"total": total, "offers": [{"id": k + 1} for k in range(n)]}).encode())

    def read(*answers):
        given, asked = iter(answers), []
        return [r[1:3] for r in web.offer_pages("http://sold.com.br/x-12345", "12345", lambda a: (asked.append(a), next(given))[1])], asked

    got, asked = read(page(60, 130), page(60, 130), page(10, 130))
    assert got == [(0, 200), (1, 200), (2, 200)] and "auction.id%3A12345" in asked[0] and "pageNumber=2" in asked[2]
    assert len(read(page(60, 60))[0]) == len(read(page(60, None))[0]) == len(read(page(59, 200))[0]) == len(read(page(0, 9))[0]) == 1
    # offers without title and id are no lots, so a page of them does not fill the total
    bare = web.Fetched("u", 200, json.dumps({"total": 60, "offers": [{"id": 1}] * 59 + [{"id": " ", "title": "<b></b>", "product": 5}]}).encode())
    assert len(read(bare, page(1, 60))[0]) == 2 and web.accepted({"offerDetail": {"description": "x"}}) and not web.accepted([1])
    # a fault on a later page ends the reading; five pages are the most
    assert read(page(60, 999), web.Fetched("u", 500))[0] == [(0, 200), (1, 500)] and read(web.Fetched("u", 200, b"{"))[0] == [(0, 200)]
    assert len(read(*[page(60, 9999)] * 9)[0]) == 5 and not list(web.offer_pages("u", "", None))
    assert U.plain_event_id("https://s/leilao-12345?x") == "12345" and U.plain_event_id("https://s/a/99999/b") == "99999" and U.plain_event_id("https://s/1") == ""


def test_offers_to_lots(spark):
    offer = {"id": 77, "endDate": "2026-08-01 9:30", "priceFormatted": "R$ 5", "lotNumber": 4, "product": {"shortDesc": "<b>Pá</b> carregadeira", "location": {"city": "Santos", "state": "SP"}}}
    base = {"nome": "Ev", "data": "2026-07-30", "hora_marcador": "08:00", "endereco_ou_localizacao": "aqui"}
    df = rows(spark, S.EVENT_FIELDS, base, base).withColumns({"source_url": F.lit("https://www.sold.com.br/leilao-12345"), "event_url": F.lit("https://www.sold.com.br/leilao-12345")})
    df = df.withColumn("offer", F.parse_json(F.lit(json.dumps(offer)))).limit(1).unionByName(df.withColumn("offer", F.parse_json(F.lit("{}"))).limit(1))
    (lot,) = offers.lots_from_offers(df, "2026-07-14T16:00:00-03:00").collect()
    assert (lot["titulo"], lot["data"], lot["hora"], lot["local"], lot["lote"], lot["link_lote"]) == (
        "Pá carregadeira", "2026-08-01", "9:30", "Santos, SP", "4", "https://www.sold.com.br/oferta/pa-carregadeira-77",
    )


def test_offer_fields_are_read_once(spark):
    texts = [{"id": 7, "title": "A &amp;amp; B", "lotNumber": 3}, {"id": " ", "title": "<b></b>"}, {"id": 8, "offerDescription": {"description": "<i>x</i>"}, "auction": {"desc": "L &lt; 2"}}]
    df = rows(spark, S.EVENT_FIELDS, *[{"descricao": json.dumps(t)} for t in texts]).withColumns({"source_url": F.lit("https://a.br/x-12345"), "event_url": F.lit("e"), "offer": F.parse_json("descricao")})
    made = offers.lots_from_offers(df, "c")
    got = sorted((r["titulo"], r["lote"], r["descricao"], r["evento"], r["link_lote"]) for r in made.collect())
    assert got == [("A &amp; B", "3", "", "", "https://a.br/oferta/a-b-7"), ("Lote 8", "", "x", "L < 2", "https://a.br/oferta/lote-8-8")]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get(") <= 40  # was in the hundreds: each use of a title read its fields again


def test_map_query_reads_files_in_blocks(spark, tmp_path):
    """No row holds a nation's map: the files are cut, and numbered and named across the cuts."""
    from tidemark.plans import listing_queries

    n = 3000
    spark.range(n).selectExpr("id + 1 as c_custkey", "concat('C', id) as c_name", "cast(id % 2 as int) as c_nationkey", "'M' as c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    asked = []
    whole, files.markers_of = files.markers_of, lambda *a, **b: asked.append(a) or whole(*a, **b)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        got = listing_queries.map_events(spark, str(tmp_path)).select("c_nationkey", "seq", "nome", "camada").collect()
    finally:
        files.markers_of = whole
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {(k, 0, "solto", "") for k in (0, 1)} | {(i % 2, i // 2 + 1, f"C{i} - SP", f"Nação {i % 2}") for i in range(n)}
    assert not asked and len(got) == len(want) and {tuple(r) for r in got} == want


def test_refresh_events(spark):
    e = rows(
        spark, S.EVENT_FIELDS, {"nome": "a", "link": "l", "camada": "Eventos", "data_original": "x"}, {"nome": "b", "camada": "Eventos", "data_original": "y", "data": "2020-01-01"},
        {"nome": "c", "camada": "Patios"}, {"nome": "d", "camada": "Eventos"},
    ).withColumn("seq", F.ascii("nome"))
    new = e.filter("nome = 'a'").withColumn("data", F.lit("2026-07-20"))
    out = pipelines.refresh_events(e, new, "2026-07-14 16:00:00", "Patios")
    names = {k: sorted(r["nome"] for r in v.collect()) for k, v in out.items()}
    assert names == {"full": ["a", "b", "c", "d"], "events": ["a", "b"], "future": ["a"], "yards": ["c"]}


def test_index_lots_carries_and_drops(spark):
    events = rows(spark, S.EVENT_FIELDS, {"nome": "Ok", "data": "2026-08-01"}, {"nome": "Fora", "data": "2026-08-01"})
    lot = lambda **v: {"data": "2026-08-01", "status_captura": "html_ok", **v}
    fresh = rows(spark, S.LOT_FIELDS, lot(titulo="Trator", evento="Ok", link_lote="u1"), lot(titulo="trator", evento="Ok", link_lote="U1"), lot(titulo="velho", evento="Ok", link_lote="u2", data="2020-01-01"))
    fresh = fresh.withColumns({"n": F.lit(1).cast("long"), "seq": F.when(F.col("titulo") == "Trator", 0).when(F.col("titulo") == "trator", 1).otherwise(2).cast("long")})
    previous = rows(spark, S.LOT_FIELDS, lot(titulo="Guardado", evento="Fora", link_lote="u9"), lot(titulo="Sumiu", evento="Ok", link_lote="u8"), lot(titulo="guardado", evento="Fora", link_lote="U9"), lot(titulo="Login", evento="Fora", link_lote="u7")).withColumn("seq", F.monotonically_increasing_id())
    logs = spark.createDataFrame([(1, "Ok", "2026-08-01"), (2, "Fora", "2026-08-01")], "n long, evento string, data string")
    out = pipelines.index_lots(events, fresh, logs, previous, "2026-07-14 16:00:00")
    assert {(r["titulo"], r["status_captura"]) for r in out["lots"].collect()} == {("Trator", "html_ok"), ("Guardado", S.CARRIED + "html_ok")}
    assert {r["n"]: r["lotes"] for r in out["logs"].collect()} == {1: 2, 2: 0}
    attempt = "array(named_struct('url', 'https://f.br/x', 'status', 'bloqueado_http_403', 'http', 403, 'lotes', 0))"
    logs = out["logs"].selectExpr("*", "if(n = 1, 'html_ok', 'bloqueado_http_403') as status", "if(n = 1, 'https://www.o.br/a', 'https://f.br/x') as link", "'' as final_url", f"if(n = 1, null, {attempt}) as fontes_tentadas")
    got = pipelines.update_report(previous, out["lots"], out["fresh"], logs, out["carried"]).first()
    assert (got["analysed"], got["with_lots"], got["rows_before"], got["rows_after"], got["new_keys"], got["removed_keys"]) == (2, 1, 4, 2, 1, 2)
    # a repeated row is carried too; what only names a label of navigation is not
    assert (got["captured"], got["carried"], got["fresh_new_keys"], got["blocked"]) == (2, 2, 2, 1)
    assert got["lots_by_host"] == {"o.br": 2} and got["errors_by_host"] == {"f.br": 1}
    assert [tuple(a) for a in got["failed_attempts"]] == [("https://f.br/x", "bloqueado_http_403", 403)]
    kept = pipelines.failed_report(previous, out["lots"], out["fresh"], logs)
    said = json.loads(outputs.report_json(kept, "2026-07-14T16:00:00", kept=True))
    assert (said["status"], said["base_anterior_preservada"], said["lotes_candidatos_apos_limpeza"]) == ("falha_sem_portal_com_lotes", True, 2)
    assert (said["lotes_antes"], said["lotes_depois"], said["lotes_preservados"], said["lotes_realmente_novos"], said["lotes_capturados_agora"]) == (4, 4, 4, 0, 2)


def test_past_lots_count_as_carried(spark):
    events = rows(spark, S.EVENT_FIELDS, {"nome": "Fora", "data": "2026-07-10"})
    fresh = rows(spark, S.LOT_FIELDS).withColumns({"n": F.lit(1).cast("long"), "seq": F.lit(0).cast("long")})
    previous = rows(spark, S.LOT_FIELDS, {"titulo": "Trator", "evento": "Fora", "data": "2026-07-10", "status_captura": "html_ok"}).withColumn("seq", F.lit(0).cast("long"))
    logs = spark.createDataFrame([(1, "Fora", "2026-07-10")], "n long, evento string, data string")
    out = pipelines.index_lots(events, fresh, logs, previous, "2026-07-14 16:00:00")
    assert out["lots"].count() == 0 and out["carried"].count() == 1


def test_events_of_the_site(spark):
    made = [("a", "2026-07-14", "15h", "SP"), ("b", "2026-07-14", "17:00", "sp"), ("c", "2026-07-14", "a definir", "XX"), ("d", "2026-07-15", "1h", "RJ"), ("e", "14/07/2026", "", "SP"), ("f", "", "", "")]
    df = spark.createDataFrame(made, "nome string, data string, hora_marcador string, uf string")
    assert [tuple(r) for r in pipelines.site_events(df, "2026-07-14 16:00:00").orderBy("nome").select("nome", "uf").collect()] == [("b", ""), ("c", ""), ("d", "RJ")]


def test_publish_only_without_fault(spark, tmp_path):
    t = {"t": spark.range(3)}
    assert pipelines.publish(spark, t, str(tmp_path), "v1", "few_lots") is None and not (tmp_path / "v1").exists()
    assert spark.read.parquet(pipelines.publish(spark, t, str(tmp_path), "v1", "") + "/t").count() == 3


def test_poll_sees_each_file_once(spark, tmp_path):
    seen = []
    schema = spark.range(1).schema
    for k in (2, 3):
        spark.range(k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        poll.poll(spark, str(tmp_path / "in"), schema, str(tmp_path / "ck"), lambda df, _: seen.append(df.count()))
    assert seen == [2, 3]


def big_map(kind):
    """Nested folders, names behind their markers, names of other elements, empty markers,
    comments and sections; ``kind`` puts an end tag into a section or uses a prefix."""
    import random

    rng = random.Random(7)
    out = ['<?xml version="1.0"?><!-- a > b --><kml xmlns="http://www.opengis.net/kml/2.2" xmlns:gx="http://x"><Document><name>d</name><Style id="a>b"><name>s</name></Style>']
    depth, n = 0, 0
    for _ in range(120):
        what = rng.random()
        if what < 0.2 and depth < 5:
            depth += 1
            out.append("<Folder>" + (f"<name>F{n} &amp; <![CDATA[<x>]]></name>" if rng.random() < 0.7 else "<name/>" if rng.random() < 0.3 else "") + "<Region><name>r</name></Region>")
        elif what < 0.35 and depth:
            depth -= 1
            out.append((f"<name>late{n}</name>" if rng.random() < 0.5 else "") + "</Folder>\n")
        elif what < 0.4:
            out.append("<Placemark/><!-- <Folder> -->")
        else:
            inside = "</Placemark>" if kind == "section" and n % 9 == 4 else ""
            out.append(f'<Placemark id="{n}"><name>M{n}</name><description><![CDATA[a<br><!-- b{inside}]]></description><gx:x gx:y="1"/><ExtendedData><Data name="A"><value>{n}</value></Data></ExtendedData><MultiGeometry><Point><coordinates>{n},2</coordinates></Point><Point><coordinates>9,9</coordinates></Point></MultiGeometry></Placemark>')
        n += 1
    text = "".join(out) + "</Folder>" * depth + "</Document></kml>\n"
    if kind == "prefix":
        return re.sub(r"<(/?)(\w)", r"<\1k:\2", text.replace("<gx:x", "<gxx").replace(' gx:y="1"', "").replace("<x>", "")).replace("k:br>", "br>").replace('xmlns="http', 'xmlns:k="http')
    return text


@pytest.mark.parametrize(("kind", "cuts"), [("plain", (97, 1000, 1 << 20)), ("section", (211, 1 << 20)), ("prefix", (500,))])
def test_maps_are_the_same_at_any_cut(spark, tmp_path, kind, cuts):
    text = big_map(kind)
    want = [(i, m["name"], m["folder"], m["description"], m["coordinates"], m["data"]) for i, m in enumerate(files.markers(text))]
    assert len(want) > 60 and len({w[2] for w in want}) > 10 and {"", "0,2"} & {w[4] for w in want}
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.kml").write_text(text)
    (tmp_path / "m/b.kml").write_text("<kml><Placemark><name>x</name></Placemark></kml>")
    sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in sizes}
    try:
        for cut in cuts:
            for k, v in zip(sizes, (cut, 0, 1), strict=True):
                spark.conf.set(k, v)
            got = sorted((r["seq"], r["name"], r["folder"], r["description"], r["coordinates"], r["data"]) for r in maps.read_map(spark, str(tmp_path / "m")).collect())
            assert [g for g in got if g[1] != "x"] == want and [g for g in got if g[1] == "x"] == [(0, "x", "", "", "", {})], cut
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_broken_maps_raise_and_empty_ones_are_empty(spark, tmp_path):
    (tmp_path / "a.kml").write_text("<kml><Folder><Placemark><name>x</Placemark></Folder></kml>")
    with pytest.raises(Exception, match="mismatched tag"):
        maps.read_map(spark, str(tmp_path / "a.kml")).collect()
    (tmp_path / "b.kml").write_text("<kml><Folder><name>f</name></Folder></kml>")
    assert maps.count_markers(spark, str(tmp_path / "b.kml")) == 0


def test_poll_keeps_the_last_hash_of_each_path(spark, tmp_path):
    """Over polls: unchanged, changed, returning and vanishing files, versions out of order,
    and a batch that is written again."""
    import hashlib

    land, check, out = (str(tmp_path / n) for n in ("land", "check", "out"))
    seen = {}

    def poll_now(*versions):
        made = [(p, f"2026-07-14 {h:02d}:00:00", c) for p, h, c in versions]
        df = spark.createDataFrame(made, "path string, moment string, content binary").withColumn("moment", F.col("moment").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(land)
        rows = poll.poll_changes(spark, land, check, out).collect()
        new = sorted((r["path"], r["moment"].hour, r["hash"] or None, r["before"]) for r in rows if r["batch"] not in seen)
        seen.update({r["batch"]: 1 for r in rows})
        return new

    h = lambda c: hashlib.sha256(c).hexdigest()
    assert poll_now(("a", 1, b"1"), ("b", 1, b"1"), ("c", 1, b"1")) == [(p, 1, h(b"1"), None) for p in "abc"]
    assert poll_now(("a", 2, b"1"), ("b", 2, b"2"), ("c", 2, None)) == [("b", 2, h(b"2"), h(b"1")), ("c", 2, None, h(b"1"))]
    # back to what it was; an old version that comes late; two versions in one poll
    assert poll_now(("b", 3, b"1"), ("a", 1, b"9"), ("c", 4, b"5"), ("c", 3, b"4"), ("c", 3, b"4")) == [("b", 3, h(b"1"), h(b"2")), ("c", 3, h(b"4"), ""), ("c", 4, h(b"5"), h(b"4"))]
    # nothing new; and the same batch after a crash between writing and noting it
    everything = sorted(map(str, poll.poll_changes(spark, land, check, out).collect()))
    last = max(int(p.name) for p in (tmp_path / "check/commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "check/commits" / name).unlink(missing_ok=True)
    assert sorted(map(str, poll.poll_changes(spark, land, check, out).collect())) == everything


def test_changed(spark):
    f = spark.createDataFrame([("a", b"1"), ("b", b"2")], "path string, content binary")
    known = f.limit(1).select("path", F.sha2("content", 256).alias("hash"))
    assert {r["path"]: r["changed"] for r in poll.changed(f, known).collect()} == {"a": False, "b": True}


def test_counters_of_notices_and_limit(spark):
    from tidemark.operators import dedupe, report

    e = spark.createDataFrame([(1, "x"), (2, ""), (3, None)], "n long, link_edital string")
    assert tuple(report.notice_counters(e, e.filter("n > 1")).first()) == (1, 0)
    assert dedupe.first_events(e, 2).count() == 2 and dedupe.first_events(e, 0).count() == 3


def test_places_in_two_levels(spark, monkeypatch):
    """Ranks and running maxima over parts of an order equal those over all of it."""
    import random

    from tidemark.operators import dedupe

    monkeypatch.setattr(dedupe, "SPAN", 7)
    rng = random.Random(3)
    rows = [(k, rng.choice("ab"), rng.choice(["x", "y", None]), rng.randrange(30)) for k in rng.sample(range(500), 300)]
    df = spark.createDataFrame(rows, "seq long, a string, b string, score int")
    want = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or "", r[0])), 1)}
    assert {r["seq"]: r["rank"] for r in dedupe.ordered_rank(df, [F.col("a"), F.col("b")], "seq").collect()} == want
    got = {r["seq"]: r["best"] for r in dedupe.best_before(df, ["b"], "score", "seq", "best").collect()}
    for seq, _, b, _ in rows:
        before = [s for q, _, c, s in rows if c == b and q < seq]
        assert got[seq] == (max(before) if before else None)


def test_published_files(spark, tmp_path):
    from tidemark.operators import report
    from tidemark.plans import outputs

    e = rows(spark, S.EVENT_FIELDS, {"nome": "a", "uf": "SP", "data": "2026-08-01", "link": "l"}, {"nome": "b", "uf": "", "data": "2026-08-01"}, {"nome": "c", "uf": "SP", "data": ""}).withColumn("seq", F.ascii("nome"))
    outputs.write_events(dict.fromkeys(outputs.EVENT_FILES, e), str(tmp_path))
    assert all(files.count_csv(spark, f"{tmp_path}/{n}") == 3 for n in outputs.EVENT_FILES.values())
    flags = e.withColumns({"is_future": F.lit(True), "is_event": F.lit(True), "is_yard": F.lit(False)})
    got = json.loads(outputs.summary_json(report.summary(flags), "2026-07-14T16:00:00", "2026-07-14", '{"bytes": 5}'))
    assert list(got)[:3] == ["atualizado_em", "data_base", "total_registros"] and got["download_kml"] == {"bytes": 5}
    assert got["eventos_por_uf"] == [["SP", 2], ["Sem UF", 1]] and got["datas"] == [["2026-08-01", 2], ["sem_data", 1]] and got["eventos_com_link"] == 1
    lots = rows(spark, S.LOT_FIELDS, {"titulo": "b", "status_captura": S.CARRIED + "x", "link_edital": "u"}, {"titulo": "a"}, {"titulo": "Login"}).withColumn("seq", F.when(F.col("titulo") == "b", 0).otherwise(1).cast("long"))
    logs = spark.createDataFrame([("html_ok", 2), ("erro", 0)], "status string, lotes int")
    outputs.write_snapshot(lots, lots.limit(1), logs, lots.filter(F.col("status_captura").startswith(S.CARRIED)), "2026-07-14T16:00:00", str(tmp_path / "s"))
    said = files.read_object(spark, str(tmp_path / "s/lotes.json"))
    assert [said[k] for k in ("total_eventos_lidos", "total_lotes", "total_lotes_capturados_agora", "total_lotes_preservados", "eventos_com_lotes", "eventos_sem_lotes", "eventos_com_erro_ou_bloqueio")] == [2, 3, 1, 1, 1, 1, 1]
    assert outputs.clean_snapshot(spark, str(tmp_path / "s/lotes.json"), str(tmp_path / "clean")) == 2
    again = files.read_object(spark, str(tmp_path / "clean/lotes.json"))
    assert (again["total_lotes"], again["total_eventos_lidos"], [x["titulo"] for x in again["lotes"]]) == (2, 2, ["b", "a"]) and files.count_csv(spark, str(tmp_path / "clean/lotes.csv")) == 2
    with pytest.raises(ValueError, match="no snapshot"):
        outputs.clean_snapshot(spark, str(tmp_path / "none"), str(tmp_path / "x"))
    pages = outputs.site_pages("<x>__DATA__</x>", lots.withColumn("rank", F.col("seq")), e, e.limit(0), "agora", "v1", "A & B", "old.html", "https://m.br/")
    data = json.loads(pages["index.html"][3:-4].replace("<\\/", "</"))
    assert list(data) == list(outputs.PAYLOAD) and (data["proxima_atualizacao"], data["mapa"]) == ("Atualização diária", "https://m.br/")
    assert (len(data["eventos"]), data["patios"], len(data["lotes"]), data["editais_eventos"], data["lotes_com_edital"], data["versao"]) == (3, [], 3, 0, 1, "v1") and "url=./" in pages["old.html"] and "A &amp; B" in pages["old.html"]


def test_report_file(spark):
    from tidemark.plans import outputs

    names = {c: F.lit(1).cast("long").alias(c) for c in outputs.REPORT.values()} | {"lots_by_host": F.create_map(F.lit("a.br"), F.lit(2)).alias("lots_by_host")}
    got = json.loads(outputs.report_json(spark.range(1).select(*names.values()), "2026-07-14T16:00:00"))
    assert list(got) == ["executado_em", *outputs.REPORT, "status", "base_anterior_preservada"] and got["quantidade_coletada_por_leiloeiro"] == {"a.br": 2} and got["status"] == "ok"
