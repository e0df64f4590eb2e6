"""Order-aware deduplication, snapshots, reports and extraction."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import text as X
from tidemark.operators import dedupe, extract, report, snapshot


def fold(rows, fill):
    """The merge as a loop over rows in order: what the declarative form must equal."""
    kept = {}
    for r in rows:
        now = kept.get(r["k"])
        if now is None:
            kept[r["k"]] = dict(r)
            continue
        best, other = (r, now) if r["score"] > now["score"] else (now, r)
        merged = dict(best)
        for f in fill:
            merged[f] = best[f] or other[f]
        kept[r["k"]] = merged
    return kept


def test_quality_merge_equals_a_fold(spark):
    rng = random.Random(5)
    rows = [{"k": f"k{rng.randrange(60)}", "seq": i, "score": rng.randrange(6), "title": f"t{i}", "a": rng.choice(["", "", f"a{i}"]), "b": rng.choice(["", f"b{i}"])} for i in range(900)]
    want = fold(rows, ("a", "b"))
    got = dedupe.quality_merge(spark.createDataFrame(rows), ["k"], "score", ("a", "b")).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r["k"]]
        assert (r["title"], r["score"], r["a"], r["b"]) == (w["title"], w["score"], w["a"], w["b"])


def test_quality_counts_in_twentieths(one):
    score = dedupe.quality("t", "d", dedupe.generic_title("t"))
    assert one(score, t="Lote 12-A", d="x" * 7) == 7 and one(score, t="Trator", d="") == 120
    assert one(dedupe.generic_title("t"), t=" VER LOTE ") and not one(dedupe.generic_title("t"), t="Lote 1 trator")


def test_first_last_top(spark):
    df = spark.createDataFrame([("a", 1, 9), ("a", 2, 8), ("b", 3, 7)], "k string, seq int, v int")
    assert sorted(tuple(r) for r in dedupe.first_per_key(df, ["k"]).collect()) == [("a", 1, 9), ("b", 3, 7)]
    assert sorted(tuple(r) for r in dedupe.last_per_key(df, ["k"]).collect()) == [("a", 2, 8), ("b", 3, 7)]
    assert [r["place"] for r in dedupe.top_per_key(df, ["k"], ["v"], 1).collect()] == [1, 1]
    assert dedupe.first_per_key(df.limit(0), ["k"]).count() == 0


def test_fallback_keeps_attempts_up_to_the_first_success(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 4), (1, 2, 9), (2, 0, 0), (2, 1, 0)], "e int, pos int, lots int")
    got = sorted((r["e"], r["pos"]) for r in dedupe.source_fallback(df, ["e"]).collect())
    assert got == [(1, 0), (1, 1), (2, 0), (2, 1)]


def test_an_event_of_repeated_lots_counts_as_failed(spark):
    lots = spark.createDataFrame([(1, 0, "x"), (2, 0, "x"), (3, 0, "y")], "n long, seq int, key string")
    logs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "n long")
    kept, fresh = dedupe.global_dedupe(lots, logs)
    assert sorted(r["n"] for r in kept.collect()) == [1, 3]
    assert {r["n"]: r["lotes"] for r in fresh.collect()} == {1: 1, 2: 0, 3: 1, 4: 0}


def test_carry_forward(spark):
    key = lambda *v: spark.createDataFrame([(x,) for x in v], "key string")
    rows = lambda *v: spark.createDataFrame(list(v), "key string, status string, t string")
    previous = rows(("a", "ok", "1"), ("b", "ok", "2"), ("c", S.CARRIED + "ok", "3"), ("d", "x" * 200, "4"))
    out = snapshot.carry_forward(previous, key("a", "c", "d"), key("a", "b", "c", "d"), rows(("a", "ok", "9")))
    got = {r["t"]: (r["status"], r["source"]) for r in out.collect()}
    assert got == {"9": ("ok", 0), "3": (S.CARRIED + "ok", 1), "4": ((S.CARRIED + "x" * 200)[:120], 1)}


def test_write_back_replaces_every_row_of_a_key(spark):
    rows = spark.createDataFrame([("n", "l", 1, "yard"), ("n", "l", 2, "event"), ("m", "l", 3, "event")], "nome string, link string, seq int, v string")
    changed = spark.createDataFrame([("n", "l", 2, "first"), ("n", "l", 5, "last")], "nome string, link string, seq int, v string")
    got = {r["seq"]: r["v"] for r in snapshot.write_back(rows, changed, ["nome", "link"]).collect()}
    assert got == {1: "last", 2: "last", 3: "event"}


def test_diff(spark):
    key = lambda *v: spark.createDataFrame([(x,) for x in v], "key string")
    assert tuple(snapshot.diff_counts(key("a", "b", "b", ""), key("b", "c")).first()) == (4, 2, 1, 1)
    assert tuple(snapshot.diff_counts(key(), key()).first()) == (0, 0, 0, 0)
    assert {tuple(r) for r in snapshot.new_and_removed(key("a", "b"), key("b", "c")).collect()} == {("c", "new"), ("a", "removed")}


def test_most_common_breaks_ties_by_first_appearance(spark):
    df = spark.createDataFrame([("z", 1), ("a", 2), ("a", 3), ("z", 4), ("", 5), (None, 6)], "v string, seq int")
    got = [(r["value"], r["n"]) for r in report.most_common(df, "v", missing="none").orderBy("rank").collect()]
    assert got == [("z", 2), ("a", 2), ("none", 2)]


def test_counters_and_failed_attempts(spark):
    logs = spark.createDataFrame(
        [(1, "https://www.a.br/x", "bloqueado_http_403", 0, [("u1", "bloqueado_http_403", 403, 0)]), (2, None, "sem_link", 0, []), (3, "https://b.br", "html_ok", 5, [("u3", "http_404", 404, 0), ("u4", "http_200", 200, 5)])],
        "n long, link string, status string, lotes int, fontes_tentadas array<struct<url:string,status:string,http:int,lotes:int>>",
    )
    assert tuple(report.outcome_counters(logs).first()) == (3, 1, 2, 1, 1, 1)
    assert {tuple(r) for r in report.host_counts(logs).collect()} == {("a.br", 0, 1), ("b.br", 5, 0)}
    assert [r["url"] for r in report.failed_attempts(logs).orderBy("rank").collect()] == ["u1", "u3"]


def test_gates(one):
    yes, n = F.lit(True), F.lit
    assert one(report.event_gate(n(9), yes)) == "few_events" and one(report.event_gate(n(10), yes)) == ""
    assert one(report.lot_gate(yes, n(24), n(24), n(24), n(0), n(1), n(0))) == "few_lots"
    assert one(report.lot_gate(yes, n(49), n(49), n(49), n(1000), n(1), n(0))) == "few_lots"
    assert one(report.lot_gate(yes, n(50), n(50), n(50), n(1000), n(0), n(0))) == "nothing_read"
    assert one(report.lot_gate(F.lit(False), n(50), n(1), n(50), n(1000), n(0), n(0))) == "stale"
    ok, failed = report.checks_status({"a": yes, "b": F.lit(None).cast("boolean"), "c": F.lit(False)})
    assert one(ok) is False and one(failed) == ["b", "c"]
    assert one(report.may_write(n(5), n(0))) is False and one(report.may_write(n(0), n(0))) is True


def test_report_of_a_kept_base_reads_it_once(spark):
    base, fresh = spark.range(5).selectExpr("cast(id as string) key"), spark.range(3, 7).selectExpr("cast(id as string) key")
    kept = snapshot.run_counts(base, base, fresh)
    assert kept._jdf.queryExecution().executedPlan().toString().count("Range (0, 5") == 1
    assert kept.first().asDict() == {"rows_before": 5, "rows_after": 5, "captured": 4, "new_keys": 0, "removed_keys": 0, "fresh_new_keys": 2}
    assert snapshot.run_counts(base, fresh, fresh).first().asDict() == {"rows_before": 5, "rows_after": 4, "captured": 4, "new_keys": 2, "removed_keys": 3, "fresh_new_keys": 2}


def test_first_per_key_is_no_aggregate_of_whole_rows(spark):
    plan = dedupe.first_per_key(spark.range(9).selectExpr("id seq", "id % 2 k"), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "min_by" not in plan  # before the shuffle and after it


def test_text_segments_of_a_long_notice(spark):
    text = "".join(f"\nLOTE {k} - Peça {k}" for k in range(1, 4001))
    rows = extract.text_segments(spark.createDataFrame([(1, text, "http://h/e.pdf")], "id int, t string, src string"), "t", ["id", "src"])
    assert [r["lote"] for r in extract.segment_lots(rows, "src").orderBy("pos").collect()] == [str(k) for k in range(1, 4001)]


def test_text_segments_and_lots(spark):
    text = "EDITAL\nLOTE 001 - Trator azul, avaliação R$ 10,00\nLote 9.19 cláusula\nITEM nº 2: Caminhão LANCE MÍNIMO R$ 5\nLote 001 de novo\nLote 3\n"
    rows = extract.text_segments(spark.createDataFrame([(1, text, "http://h/e.pdf")], "id int, t string, src string"), "t", ["id", "src"])
    lots = extract.segment_lots(rows, "src").orderBy("pos").collect()
    assert [(r["lote"], r["titulo"], r["lance_atual"], r["link_lote"]) for r in lots] == [
        ("001", "Lote 001 - Trator azul,", "R$ 10,00", "http://h/e.pdf#lote-001"),
        ("2", "Lote 2 - Caminhão", "R$ 5", "http://h/e.pdf#lote-2"),
    ]


def test_page_reader(spark):
    page = """<title>A &amp; B</title><script>no</script><a href='/lote/1'><img data-src="/f/1.jpg" alt="Trator"> azul</a>
    <a href="/lote/2"><div style="background-image:url('x/2.png')">Lote 2</div></a><a href="/empty"></a><p>texto <b>visível</b></p>"""
    rows = extract.html_pages(spark.createDataFrame([(1, page, "https://h.br/"), (2, None, "")], "page_id int, html string, url string"), keep=("page_id", "url"))
    got = {r["page_id"]: r for r in rows.collect()}
    assert got[1]["title"] == "A & B" and "no" not in got[1]["visible"] and "visível" in got[1]["visible"]
    assert [(x["href"], x["text"], x["image"]) for x in got[1]["links"]] == [("/lote/1", "Trator azul", "/f/1.jpg"), ("/lote/2", "Lote 2", "x/2.png")]
    assert got[2]["links"] == []
    links = extract.page_links(rows, "url").orderBy("pos").collect()
    assert [(r["link"], r["image"], r["is_lot"]) for r in links] == [("https://h.br/lote/1", "https://h.br/f/1.jpg", True), ("https://h.br/lote/2", "https://h.br/x/2.png", True)]


def test_json_objects_of_pages(spark):
    page = """<script type="application/ld+json">{"name": "Lote 1", "offers": [{"price": "10,00"}, {"images": [{"url": "/a.jpg"}]}]}</script>
    <script type="application/ld+json">{broken</script><script id="__NEXT_DATA__">{"title": "T", "link": "/x", "valor": 7}</script>"""
    got = extract.json_objects(spark.createDataFrame([(1, page)], "id int, html string"), "html", ("id",), embedded=True).orderBy("pos").collect()
    assert [bool(r["error"]) for r in got] == [True, *[False] * 5] and "JSONDecodeError" in got[0]["error"]
    assert [(r["path"], r["text"], r["price"], r["link"], r["images"]) for r in got[1:]] == [
        ("$", "Lote 1", "", "", []), ("$.offers[0]", "", "R$ 10,00", "", []), ("$.offers[1]", "", "", "", ["/a.jpg"]), ("$.offers[1].images[0]", "", "", "/a.jpg", []), ("$", "T", "R$ 7", "/x", []),
    ]


def test_document_moment(one):
    text = "Publicado. " + "x " * 300 + "Data do leilão: 32/01/2026, depois 5 de março de 2026 às 14h30, ou 06/03/2026"
    got = one(extract.document_moment("v"), v=text)
    assert (got["data"], got["hora"]) == ("2026-03-05", "14:30")
    assert one(extract.document_moment("v"), v="nada")["data"] == ""


def test_capture_status(one):
    assert one(extract.capture_status(F.lit(403), F.lit(""))) == "bloqueado_http_403"
    assert one(extract.capture_status(F.lit(200), F.lit("<b>Access</b> DENIED"))) == "bloqueado_http_200"
    assert one(extract.capture_status(F.lit(0), F.lit(None).cast("string"))) == "erro"


def test_distinct_join(one):
    assert one(X.distinct_join(F.array(F.lit("b"), F.lit(""), F.lit("a"), F.lit("b"), F.lit(None)), " | ")) == "b | a"


def test_snippets_are_made_as_asked_for(monkeypatch):
    """F16: behind the first snippet with a date no keyword is looked for."""
    asked = []
    monkeypatch.setattr(extract, "KEYWORDS", type("K", (), {"finditer": lambda self, t, k=extract.KEYWORDS: (asked.append(m) or m for m in k.finditer(t))})())
    assert extract.moment("Abertura 1/2/2020, leilão, visitação, pagamento")[0] == "2020-02-01" and len(asked) == 1
    assert list(extract.snippets("nada")) == ["nada"] and not list(extract.snippets(" "))


def test_prices_only_of_texts_with_the_sign(monkeypatch):
    """texts without the sign of an amount are not written as JSON."""
    asked = []
    monkeypatch.setattr(extract.json, "dumps", lambda t, f=extract.json.dumps: asked.append(t) or f(t))
    assert extract.object_price({"a": "x", "b": ["por R$ 5", "y"]}) == "R$ 5" and asked == ["por R$ 5"]
