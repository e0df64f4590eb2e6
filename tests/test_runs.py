"""Steps, intake, status, and the reading of events' sources."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import urls as U
from tidemark.operators import extract, lots, waves
from tidemark.plans import runs
from tidemark.sources import fetching, web


def test_map_intake(tmp_path):
    good = b"<?xml?><kml>" + b"<Placemark/>" * 2000
    target = str(tmp_path / "m.kml")
    answers = iter([web.Fetched("u", 500), web.Fetched("u", 200, b"<kml>"), web.Fetched("u", 200, good)])
    got = runs.take_in_map("u", target, pause=0, get=lambda *a: next(answers))
    assert (got["attempts"], got["changed"], got["markers"]) == (3, True, 2000)
    assert runs.take_in_map("u", target, pause=0, get=lambda *a: web.Fetched("u", 200, good))["changed"] is False
    assert runs.fetch_map("u", get=lambda *a: web.Fetched("u", 200, good)) == (good, 1)
    with pytest.raises(RuntimeError, match="2 attempts"):
        runs.take_in_map("u", target, attempts=2, pause=0, get=lambda *a: web.Fetched("u", 200, b"x"))
    assert (tmp_path / "m.kml").read_bytes() == good


def test_orchestration_undoes_at_the_first_fault():
    tries, undone = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 2:
            raise OSError("down")
        return 5

    steps = [("a", flaky, 3, None), ("b", lambda: 1, 1, lambda r: "few_lots" if r < 2 else ""), ("c", lambda: undone.append("no"), 1, None)]
    got = runs.orchestrate(steps, lambda: undone.append("yes"), pause=0)
    assert (got["ok"], got["failed_at"], got["message"], undone) == (False, "b", "few_lots", ["yes"])
    assert got["steps"][0]["attempts"] == 2 and runs.orchestrate(steps[:1], lambda: None, 0)["ok"]


def test_status(spark, tmp_path, monkeypatch):
    row = runs.status_row(spark.range(1), {"a": F.lit(True), "b": F.lit(False)}).first().asDict()
    assert runs.status_text(row).startswith("ATENCAO: b\nid: 0")
    assert runs.keep_earlier({"x": "", "y": 1}, {"x": 3, "y": 4, "z": 5}, ("x", "y")) == {"x": 3, "y": 1}
    monkeypatch.setenv("GITHUB_OUTPUT", str(tmp_path / "o"))
    runs.write_output("changed", "true")
    assert (tmp_path / "o").read_text() == "changed=true\n"
    got = runs.recount(spark.createDataFrame([(S.CARRIED + "x",), ("ok",)], "status_captura string")).first()
    assert tuple(got) == (2, 1)


def test_enrich_takes_the_first_sane_date(spark):
    events = spark.createDataFrame([tuple(["e1", *[""] * 3, "9h", *[""] * 11]), tuple(["e2", *[""] * 3, "sem", *[""] * 11])], S.EVENT).withColumn("seq", F.substring("nome", 2, 1).cast("long"))
    found = spark.createDataFrame([(1, 0, "2020-01-01", "", "", "site", "", ""), (1, 1, "2026-08-01", "01/08/2026", "10:30", "edital_pdf", "u", "r")], "seq long, pos int, data string, data_original string, hora string, fonte string, link_edital string, resumo string")
    got = {r["nome"]: (r["data"], r["hora_marcador"], r["fonte_data_hora"]) for r in runs.enrich(events, found, "2026-07-14 16:00:00").collect()}
    assert got == {"e1": ("2026-08-01", "10:30", "edital_pdf"), "e2": ("", "sem", "")}


CAPTURED = "2026-07-14T16:00:00-03:00"
FETCHED = "url string, status int, body binary, content_type string, final_url string"


def test_documents_date_events(spark, monkeypatch):
    """A page gives its own date unless a notice it links to has one."""
    monkeypatch.setattr(web, "pdf_text", lambda raw, pages=120: bytes(raw)[4:].decode() if raw else "")
    monkeypatch.setattr(runs, "_first_pages", lambda c: F.expr("substring(decode(body, 'UTF-8'), 5)"))
    event = lambda n, **v: (n, *[v.get(f, "") for f in S.EVENT_FIELDS])
    events = spark.createDataFrame(
        [event(1, nome="a", link="https://a.br/p | https://a.br/q"), event(2, nome="b", link="https://b.br/n.pdf"), event(3, nome="c", link="https://c.br/gone|https://c.br/old| https://c.br/never"), event(4, nome="d", hora_marcador="9h")],
        "seq long, " + ", ".join(f"{f} string" for f in S.EVENT_FIELDS),
    )
    rows = [
        ("https://a.br/p", 200, b'<p>Abertura: 01/09/2026 as 9h</p><a href="/x.pdf">x</a> https://a.br/y.pdf). <a href="/z.pdf">z</a>', "text/html", ""),
        ("https://a.br/x.pdf", 200, b"%PDFsem data", "", "https://a.br/x.pdf"), ("https://a.br/z.pdf", 200, "%PDFLeilão: 5 de agosto de 2026, 14:30".encode(), "", "https://cdn/z.pdf"), ("https://a.br/y.pdf", 200, b"%PDFdata 07/08/2026", "", ""),
        ("https://b.br/n.pdf", 200, b"%PDFinicio em 2/8/26 10 horas", "application/pdf", ""), ("https://c.br/gone", 404, b"data 03/08/2026", "", ""), ("https://c.br/old", 200, b"data 03/08/2020", "", ""),
    ]
    found = {(r["seq"], r["pos"]): r for r in runs.inspect(events, spark.createDataFrame(rows, FETCHED)).collect()}
    assert set(found) == {(1, 0), (2, 0), (3, 1)}
    assert tuple(found[1, 0])[2:7] == ("2026-08-05", "05/08/2026", "14:30", "edital_pdf", "https://cdn/z.pdf")
    assert tuple(found[2, 0])[2:7] == ("2026-08-02", "02/08/2026", "10:00", "edital_pdf", "https://b.br/n.pdf")
    got = {r["seq"]: (r["data"], r["hora_marcador"], r["link_edital"]) for r in runs.enrich(events, runs.inspect(events, spark.createDataFrame(rows, FETCHED)), "2026-07-14 16:00:00").collect()}
    assert got == {1: ("2026-08-05", "14:30", "https://cdn/z.pdf"), 2: ("2026-08-02", "10:00", "https://b.br/n.pdf"), 3: ("", "", ""), 4: ("", "09:00", "")}


def test_diagnostic(spark, tmp_path):
    site = runs.Site("lots.example.org", required=("index.html", "lotes.csv", "nada.txt"))
    (tmp_path / site.schedule).write_text(f"{runs.BY_HAND}\n - cron: '{runs.EVERY_SIX_HOURS}'\n{runs.MAY_SAVE}\nrun: {site.runner}")
    (tmp_path / site.lots).write_text(json.dumps({"lotes": [{"titulo": "a"}, {"titulo": "b"}], "atualizado_em": "2026-07-14T15:00:00-03:00", "eventos_com_lotes": 1}))
    (tmp_path / site.lots_csv).write_text("titulo\na\nb\n")
    (tmp_path / site.events_csv).write_text("nome\nx\n")
    (tmp_path / site.summary).write_text(json.dumps({"atualizado_em": "2026-07-13T15:00:00-03:00"}))
    (tmp_path / site.page).write_text("x" * 100_001 + site.page_data)
    facts = runs.gather(spark, str(tmp_path), site, "2026-07-14 16:30:00-03:00")
    status, code = runs.diagnose(facts, site, {"mensagem": "antes", "lotes": 9}, fail_on_attention=True)
    assert len(runs.fourteen_checks(site)) == 14 and status["failed_checks"] == ["arquivos_obrigatorios", "dominio_configurado", "base_eventos_recente"]
    assert (status["status"], code, status["missing"], status["mensagem"], status["lots"], status["future"], status["lots_age"], status["events_age"]) == ("atencao", 1, ["nada.txt"], "antes", 2, 1, 1.5, 25.5)
    published = runs.published_status(facts, site, "2026-07-14T16:30:00-03:00", {"mensagem": "antes", "lotes_antes": 3})
    assert list(published)[:3] == ["status", "verificado_em", "atualizado_em_base_eventos"] and (published["status"], published["lotes"], published["arquivos_faltando"]) == ("atencao", 2, ["nada.txt"])
    assert [k for k, v in published["checks"].items() if not v] == status["failed_checks"] and list(published["checks"]) == list(runs.fourteen_checks(site))
    runs.write_status(published, str(tmp_path))
    assert json.loads((tmp_path / "status_atualizacao.json").read_text()) == published
    lines = (tmp_path / "status_atualizacao.txt").read_text().splitlines()
    assert lines[0] == "Status: atencao" and lines[4] == "Idade da base de eventos: 25.5 horas" and lines[10:12] == ["Lotes antes: 3", "Lotes depois: -"]
    assert lines[-2:] == ["Verificações com problema: arquivos_obrigatorios, dominio_configurado, base_eventos_recente", "Mensagem: antes"]
    (tmp_path / site.host).write_text(site.domain + "\n")
    site = runs.Site("lots.example.org", required=("index.html",))
    facts = runs.gather(spark, str(tmp_path), site, "2026-07-14 02:00:00-03:00")
    assert runs.diagnose(facts, site, {})[0]["status"] == "ok" and runs.diagnose(facts, site, {}, True)[1] == 0


# --- reading events: the operator against a reader that goes step by step ---------------


def fold(event, fetched, api):
    """(lots, log) of one event as a reader would get them that asks one source after
    another; lots as (title, number, link, notice, source, status, event link)."""
    sources = event["_sources"]
    if not sources:
        return [], ("sem_link", None, None, 0, [])
    tried, found, status, final = [], [], "sem_lotes", sources[0]

    def segments(text, place):
        out, seen = [], set()
        for m in re.finditer(r"(?im)^\s*LOTE (\d+) - (.*)$", text):
            if m[1] not in seen:
                seen.add(m[1])
                out.append((f"Lote {m[1]} - {m[2]}", m[1], f"{place}#lote-{m[1]}", event["link_edital"] or (place if re.search(r"(?i)\.pdf(?:$|[?#])", place) else ""), place, "pdf_ok", source))
        return out

    for source in sources:
        if "sold.com.br" in source:
            ident = U.plain_event_id(source)
            said, lots_here = "api_superbid_sem_id_evento", []
            if ident:
                said, n = "api_superbid_erro", 0
                for page, (code, body) in enumerate(api.get(source, [])):
                    said = f"api_superbid_http_{code}" if code else "api_superbid_erro"
                    if code != 200:
                        break
                    try:
                        data = json.loads(body)
                    except ValueError:
                        said = "api_superbid_json_invalido"
                        break
                    own = data.get("offers") or []
                    if not own:
                        break
                    lots_here += [(o["title"], "", f"https://www.sold.com.br/oferta/{o['title'].lower().replace(' ', '-')}-{o['id']}", event["link_edital"], source, "api_superbid_ok", source) for o in own]
                    if len(lots_here) >= int(data.get("total") or 0) or len(own) < 60:
                        break
            if lots_here:
                tried.append((source, "api_superbid_ok", None, len(lots_here)))
                return lots_here, ("api_superbid_ok", sources[0], source, len(lots_here), tried)
            tried.append((source, said, None, 0))
        code, body, kind, final = fetched.get(source, (0, b"", "", source))
        final = final or source
        if code == 200 and (".pdf" in final or "pdf" in kind or body[:4] == b"%PDF"):
            found = segments(body.decode()[4:], final)
            status = "pdf_ok" if found else "pdf_sem_lotes"
            tried.append((source, status, code, len(found)))
            if found:
                break
            continue
        if "charset=nope" in kind:
            return [], ("erro_execucao_evento", None, None, 0, None)
        page = body.decode("utf-8", "replace")
        state = f"http_{code}" if code else "erro"
        status = f"bloqueado_{state}" if code in (401, 403, 429) or "just a moment" in page.lower() else state
        own = []
        if code == 200:
            read = extract.read_page(page)
            for link in read["links"]:
                to = U.resolved(final, link["href"])
                row = (link["text"][:240], (re.findall(r"(?i)lote (\d+)", link["text"]) or [""])[0], to, "", final, status, source)
                if "/lote/" in to and len(link["text"]) >= 5 and (link["text"] + "|" + to).casefold() not in {x[0] for x in own}:
                    own.append(((link["text"] + "|" + to).casefold(), row))
            own = [r for _, r in own] or [(*r[:5], "html_texto_ok", source) for r in segments("\n".join(read["visible"]), final)]
        tried.append((source, status, code, len(own)))
        notices = [event["link_edital"]] if event["link_edital"] else []
        linked = [u for u in dict.fromkeys(U.resolved(final, h) for h in re.findall(r"""(?:href|src)=["']([^"']+)["']""", page)) if re.search(r"(?i)\.pdf(?:$|[?#])", u)][:2]
        notices += [u for u in linked if u not in notices]
        found += [(*r[:3], event["link_edital"] or (notices[0] if notices else ""), *r[4:]) for r in own]
        more = False
        for u in notices[:2]:
            pcode, pbody, pkind, pfinal = fetched.get(u, (0, b"", "", u))
            if pcode != 200 or not (pbody[:4] == b"%PDF" or "pdf" in pkind):
                continue
            lots_of = segments(pbody.decode()[4:], pfinal or u)
            tried.append((u, "pdf_link_ok" if lots_of else "pdf_link_sem_lotes", 200, len(lots_of)))
            if lots_of:
                found, more, final = found + lots_of, True, pfinal or u
        if found:
            status = ("html_pdf_ok" if own else "pdf_link_ok") if more else "html_ok"
            break
    return found, (status, sources[0], final, len(found), tried)


def event_fixtures():
    """Events over answers of all kinds."""
    offers = lambda a, n, total: (200, json.dumps({"total": total, "offers": [{"id": k, "title": f"Oferta {k}"} for k in range(a, a + n)]}))
    lote = lambda k, more="": f'<li><a href="/lote/{k}">Lote {k} - Trator {more}</a></li>'
    pdf = lambda *ks: ("%PDF" + "".join(f"\nLOTE {k} - Pá {k}" for k in ks)).encode()
    answers = {
        "https://a.br/p": (200, (lote(1) + lote(1) + lote(2) + '<a href="e.pdf">edital</a><a href="f.pdf">f</a><a href="g.pdf">g</a>').encode(), "text/html", "https://a.br/p/"),
        "https://a.br/p/e.pdf": (200, pdf(7, 8, 7), "", "https://cdn.br/e.pdf"), "https://a.br/p/f.pdf": (404, pdf(9), "", ""), "https://a.br/p/g.pdf": (200, pdf(99), "", ""),
        "https://b.br/texto": (200, b"<p>LOTE 1 - Bomba</p><p>LOTE 2 - Motor</p><script>LOTE 3 - x</script>", "text/html", ""),
        "https://c.br/recusa": (403, b'<a href="https://c.br/n.pdf">n</a>', "text/html", ""), "https://c.br/n.pdf": (200, pdf(4), "application/pdf", ""),
        "https://d.br/vazio": (200, b"<p>nada</p>", "text/html", ""), "https://d.br/x.pdf": (500, b"%PDF", "", ""), "https://d.br/y.pdf": (200, b"%PDF nada", "", ""),
        "https://e.br/z": (200, b"\xff", "text/html; charset=nope", ""), "https://f.br/just": (200, b"<title>Just a moment</title>", "text/html", ""),
        "https://g.br/d.pdf": (200, pdf(1, 2), "", "https://g.br/d.pdf?v=2"), "https://www.sold.com.br/leilao-12345": (200, lote(5).encode(), "text/html", ""),
        "https://h.br/ed.pdf": (200, pdf(3), "", ""), "https://www.sold.com.br/leilao-22222": (200, b"", "text/html", ""),
    }
    api = {
        "https://www.sold.com.br/leilao-12345": [offers(0, 60, 100), offers(60, 60, 100), offers(120, 5, 100)], "https://www.sold.com.br/leilao-22222": [offers(0, 60, 130), (500, "")],
        "https://www.sold.com.br/leilao-33333": [(200, "{")], "https://www.sold.com.br/leilao-44444": [offers(0, 0, 0)], "https://www.sold.com.br/leilao-55555": [(0, "x")],
    }
    events = [
        {"nome": "a", "site_leiloeiro": "https://a.br/p", "link": "https://b.br/texto"}, {"nome": "b", "site_leiloeiro": "https://b.br/texto"}, {"nome": "c", "site_leiloeiro": "https://c.br/recusa"},
        {"nome": "d", "site_leiloeiro": "https://d.br/vazio", "link": "https://d.br/x.pdf https://d.br/y.pdf"}, {"nome": "e", "site_leiloeiro": "https://e.br/z", "link": "https://b.br/texto"},
        {"nome": "f", "site_leiloeiro": "https://f.br/just"}, {"nome": "g", "link": "https://g.br/d.pdf"}, {"nome": "h", "link": "https://www.sold.com.br/leilao-12345"}, {"nome": "i"},
        {"nome": "j", "site_leiloeiro": "https://d.br/vazio", "link_edital": "https://h.br/ed.pdf"}, {"nome": "k", "site_leiloeiro": "https://nao.br/"}, {"nome": "l", "link": "https://www.sold.com.br/leilao-22222"},
        {"nome": "m", "link": "https://www.sold.com.br/leilao-33333"}, {"nome": "n", "link": "https://www.sold.com.br/leilao-44444 https://b.br/texto"}, {"nome": "o", "link": "https://www.sold.com.br/leilao-55555"},
        {"nome": "p", "link": "https://www.sold.com.br/sem-numero"}, {"nome": "q", "site_leiloeiro": "https://b.br/texto", "link": "https://longer.e.br/z"},
    ]
    return [dict.fromkeys(S.EVENT_FIELDS, "") | e | {"data": "2026-08-01"} for e in events], answers, api


def test_sources_are_read_as_one_after_another(spark, monkeypatch):
    monkeypatch.setattr(lots, "_pdf", lambda c: F.substring(F.decode(c, "UTF-8"), 5, 1 << 30))
    events, answers, api = event_fixtures()
    table = spark.createDataFrame([(n, *[e[f] for f in S.EVENT_FIELDS]) for n, e in enumerate(events)], "n long, " + ", ".join(f"{f} string" for f in S.EVENT_FIELDS))
    fetched = spark.createDataFrame([(u, *v) for u, v in answers.items()], FETCHED)
    paged = spark.createDataFrame([(u, p, *v) for u, pages in api.items() for p, v in enumerate(pages)], web.OFFERS)
    sources = {r["n"]: [] for r in table.select("n").collect()}
    for r in lots.sources_of(table).orderBy("n", "pos").collect():
        sources[r["n"]].append(r["url"])
    rows, logs = lots.read_events(table, fetched, CAPTURED, paged)
    got = {n: [] for n in sources}
    for r in rows.orderBy("n", "seq").collect():
        got[r["n"]].append((r["titulo"], r["lote"], r["link_lote"], r["link_edital"], r["fonte"], r["status_captura"], r["link_evento"]))
        assert r["evento"] == events[r["n"]]["nome"] and r["capturado_em"] == CAPTURED
    log = {r["n"]: (r["status"], r["link"], r["final_url"], r["lotes"], None if r["fontes_tentadas"] is None else [tuple(a) for a in r["fontes_tentadas"]]) for r in logs.collect()}
    errors = {r["n"]: r["erro"] for r in logs.collect() if r["erro"]}
    assert list(errors) == [4] and "nope" in errors[4]
    for n, e in enumerate(events):
        want, (status, link, final, count, tried) = fold(e | {"_sources": sources[n]}, answers, api)
        assert got[n] == want, e
        have = log[n]
        assert (have[0], have[3]) == (status, count), (e, have)
        if status not in ("sem_link", "erro_execucao_evento"):
            assert (have[1], have[2], have[4]) == (link, final, tried), (e, have)
    assert log[4][1] == "https://b.br/texto" and {log[n][0] for n in log} >= {"html_pdf_ok", "pdf_link_ok", "html_ok", "pdf_ok", "pdf_sem_lotes", "sem_link", "erro", "api_superbid_ok", "bloqueado_http_200"}


class Asked(dict):
    """Answers that remember what was asked for."""

    def __init__(self, answers, seen):
        super().__init__(answers)
        self.seen = seen

    def get(self, key, default=None):
        self.seen.add(key)
        return super().get(key, default)


class Paged(dict):
    def __init__(self, pages, seen):
        super().__init__(pages)
        self.seen = seen

    def get(self, key, default=None):
        for number, page in enumerate(super().get(key, default)):
            self.seen.add(web.offers_address(U.plain_event_id(key), number))
            yield page


def test_waves_ask_what_a_sequential_reader_asks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(lots, "_pdf", lambda c: F.substring(F.decode(c, "UTF-8"), 5, 1 << 30))
    events, answers, api = event_fixtures()
    table = spark.createDataFrame([(n, *[e[f] for f in S.EVENT_FIELDS]) for n, e in enumerate(events)], "n long, " + ", ".join(f"{f} string" for f in S.EVENT_FIELDS))
    offered = {web.offers_address(U.plain_event_id(u), p): v for u, pages in api.items() for p, v in enumerate(pages)}
    log = tmp_path / "asked"
    log.mkdir()

    def get(url, policy):
        import hashlib

        with open(log / hashlib.md5(url.encode()).hexdigest(), "a") as f:
            f.write(url + "\n")
        if url in offered:
            status, body = offered[url]
            return web.Fetched(url, status, body.encode())
        status, body, kind, final = answers.get(url, (0, b"", "", ""))
        return web.Fetched(url, status, body, kind, final)

    state = str(tmp_path / "state")
    rows, logs, requests = waves.read_live(table, CAPTURED, state, fetching.Live(get=get))
    fetched = spark.createDataFrame([(u, *v) for u, v in answers.items()], FETCHED)
    paged = spark.createDataFrame([(u, p, *v) for u, pages in api.items() for p, v in enumerate(pages)], web.OFFERS)
    want_rows, want_logs = lots.read_events(table, fetched, CAPTURED, paged)
    listed = lambda df: sorted(map(str, df.collect()))
    assert listed(rows) == listed(want_rows) and listed(logs) == listed(want_logs)

    sequential = set()
    sources = {r["n"]: [] for r in table.select("n").collect()}
    for r in lots.sources_of(table).orderBy("n", "pos").collect():
        sources[r["n"]].append(r["url"])
    for n, e in enumerate(events):
        fold(e | {"_sources": sources[n]}, Asked(answers, sequential), Paged(api, sequential))
    asked = [line for f in log.iterdir() for line in f.read_text().splitlines()]
    assert set(asked) == sequential and len(asked) == len(set(asked))
    assert max(r["wave"] for r in requests.collect()) >= 2


def test_what_a_crash_left_whole_is_not_asked_again(spark, tmp_path):
    place = str(tmp_path / "answers")
    assert fetching.once(spark.range(3), place).count() == 3
    assert fetching.once(spark.range(9), place).count() == 3
    (tmp_path / "answers/_SUCCESS").unlink()  # a table that was not finished is made anew
    assert fetching.once(spark.range(5), place).count() == 5


def test_no_events_no_requests(spark, tmp_path):
    empty = spark.createDataFrame([], "n long, " + ", ".join(f"{f} string" for f in S.EVENT_FIELDS))
    assert [df.count() for df in waves.read_live(empty, CAPTURED, str(tmp_path), fetching.Live(get=lambda url, policy: 1 / 0))] == [0, 0, 0]


def test_a_hot_host_is_many_tasks_that_keep_its_rate(spark, tmp_path):
    from pyspark import TaskContext

    wanted = spark.createDataFrame([(f"https://hot.br/{k}",) for k in range(300)] + [(f"https://h{k}.br/",) for k in range(20)] + [("https://hot.br/0",), ("",), (None,)], "url string")

    def get(url, policy):
        return web.Fetched(url, 200, str(TaskContext.get().partitionId()).encode(), "text/html", "")

    got = fetching.fetch_table(wanted, fetching.FOR_DATES, fetching.Budget(slots=8), get).collect()
    assert sorted(r["url"] for r in got) == sorted({u for (u,) in [tuple(r) for r in wanted.collect()] if u})
    assert {r["final_url"] for r in got} == {r["url"] for r in got}
    slots = {r["slot"] for r in fetching.slotted(wanted, 8).filter("host = 'hot.br'").collect()}
    assert len(slots) == 8 and len({bytes(r["body"]) for r in got if "hot.br" in r["url"]}) > 1
    # two requests a second and four slots: each slot one in two seconds, one after another
    clock, waits = [0.0], []

    def sleep(seconds):
        waits.append(seconds)
        clock[0] += seconds

    rows = [("a0", "a", 0), ("a1", "a", 1), ("a2", "a", 0), ("b0", "b", 0)]
    times = [(u, clock[0]) for (u,) in fetching.paced(rows, fetching.Budget(2.0, 4), lambda u: [(u,)], lambda: clock[0], sleep)]
    assert times == [("a0", 0.0), ("b0", 0.0), ("a1", 0.5), ("a2", 2.0)]
    assert [u for (u,) in fetching.paced(rows, fetching.Budget(), lambda u: [(u,)], lambda: 0.0, None)] == ["a0", "a2", "a1", "b0"]


def test_objects_of_pages(spark):
    long = "Lote 5 - " + "x" * 300
    page = f"""<script type="application/ld+json">[{{"name": "Lote 5 - Trator", "url": "/l/5", "price": "10,00", "image": ["/logo.png", "/f/5.jpg"]}}, {{"title": "{long} a", "url": "/l/9", "descricao": "<b>d</b>"}}, {{"title": "{long} b", "url": "/l/9"}}]</script>
      <script type="application/ld+json">{{kaputt</script><a href="/l/5">Lote 5 - Trator</a><a href="/l/6">Lote 6 R$ 7</a>"""
    rows = spark.createDataFrame([(1, 0, "https://a.br/x", page)], "n long, pos int, final_url string, html string")
    got = [(r["titulo"], r["descricao"], r["lance_atual"], r["lote"], r["link_lote"], r["foto_lote"]) for r in lots.page_lots(rows).orderBy("branch", "at").collect()]
    assert got == [
        ("Lote 5 - Trator", "", "R$ 10,00", "5", "https://a.br/l/5", "https://a.br/f/5.jpg"), (long[:240], "d", "", "5", "https://a.br/l/9", ""), (long[:240], "", "", "5", "https://a.br/l/9", ""),
        ("Lote 6 R$ 7", "", "R$ 7", "6", "https://a.br/l/6", ""),
    ]


def test_deep_and_broken_json(spark):
    deep = '{"images": ' * 3000 + '"/a.jpg"' + "}" * 3000
    texts = ["[" * 200_000, deep, "{", None, '{"a": 1}']
    got = extract.json_objects(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", ("id",)).collect()
    errors = {r["id"]: r["error"] for r in got if r["error"]}
    assert set(errors) >= {0, 2} and all(r["path"] is None for r in got if r["error"]) and [r["path"] for r in got if r["id"] == 4] == ["$"]
    nested = x = {}
    for _ in range(3000):
        x["url"] = {"photo": 1}
        x = x["url"]
    x["url"] = "/f.jpg"
    assert list(extract.image_candidates(nested))[0] == "/f.jpg" and extract.object_price({"a": [{"b": "por R$ 5"}]}) == "R$ 5"


def test_page_reader():
    page = '<title>um</title><svg><p>fora</p></svg></svg><a href="/1"><img data-src="/a.jpg" alt="Lote 1"><b>x</b></a><a href="/1">de novo</a><a href="/2"><div style="color:red;url(/no.jpg)">dois</div></a><a href="/3"><i style="BACKGROUND: url(\'/s.jpg\')">três</i><img></a><a>sem</a><a href="">vazio</a><a href="/4">aberto<a href="/5">cinco</a><title>fim &amp; mais</title>'
    got = extract.read_page(page)
    assert got["title"] == "fim & mais" and got["visible"][:2] == ["um", "x"] and "fora" not in got["visible"]
    assert [(x["href"], x["text"], x["image"]) for x in got["links"]] == [("/1", "Lote 1 x", "/a.jpg"), ("/1", "de novo", "/a.jpg"), ("/2", "dois", ""), ("/3", "três", ""), ("/5", "cinco", "")]
