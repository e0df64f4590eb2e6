"""Text, addresses, dates: the cases in which engines differ, and the rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import temporal as D
from tidemark.functions import text as X
from tidemark.functions import urls as U

def now():
    return F.lit("2026-07-14 16:00:00").cast("timestamp_ntz")



@pytest.mark.parametrize(
    ("value", "want"),
    [(None, ""), ("", ""), (" a \tb\n", "a b"), ("<b>x</b>&amp;<i>y", "x & y"), ("&lt;b&gt;z&lt;/b&gt;", "z"), ("a &amp;amp; b", "a &amp; b"), ("\x1c x", "x")],
)
def test_clean_text(spark, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(X.clean_text("v")).first()[0] == want


def test_clean_html_decodes_twice_and_shows_breaks(one):
    assert one(X.clean_html("v"), v="um<br/>dois &amp;amp; três<BR >") == "um | dois & três |"


def test_slug_and_fold(one):
    assert one(X.slugify("v"), v=" Leilão Nº 3 — São Paulo!") == "leilao-no-3-sao-paulo"
    assert one(X.slugify("v"), v="—") == "lote"
    assert one(X.fold("v"), v="  STRASSE   Straße Ç") == "strasse strasse c"
    assert one(X.casefold("v"), v="ßﬁ") == "ssfi"


def test_lot_number_and_price(one):
    assert one(X.lot_number("v"), v="Vende-se LOTE não, lote: 007b e lote 8") == "007b"
    assert one(X.lot_number("v"), v="lotes") == ""
    assert one(X.price("v"), v="de r$ 1.234,50 por R$9") == "r$ 1.234,50"
    assert one(X.is_clause(F.col("v")), v="9.19") and not one(X.is_clause(F.col("v")), v="9.1")


def test_quote_fragment(one):
    assert one(X.quote_fragment(F.col("v")), v="2/3 A~") == "2/3%20A~"


def test_segments(one):
    got = one(X.segments(F.col("v"), r"(?:^|\n)(\d+)"), v="vor\n1 a\nb\n2\n3 c")
    assert [(r["number"], r["body"]) for r in got] == [("1", " a\nb"), ("2", ""), ("3", " c")]
    assert one(X.segments(F.col("v"), r"(?:^|\n)(\d+)"), v="") == []


def test_url_parts(one):
    u = "HTTPS://WWW.a.www.example.com:81/p/-12345?lot=1#f"
    assert one(U.scheme("v"), v=u) == "https"
    assert one(U.domain("v"), v="https://www.a.www.example.com:81/x") == "a.example.com:81"
    assert one(U.query("v"), v=u) == "lot=1"
    assert one(U.event_id("v"), v=u) == "12345" and one(U.event_id("v"), v="http://h/123456/x") == "123456" and one(U.event_id("v"), v="http://h/1234") == ""
    assert one(U.normalized("v"), v="HTTP://Ex.ORG/Path/?q#f") == "http://ex.org/Path"
    assert one(U.normalized("v"), v="http://ex.org") == "http://ex.org/"
    assert one(U.canonical("v", F.lit("e")), v="http://h/X#lote-1") == "http://h/X" and one(U.canonical("v", F.lit("e#1")), v="") == "e"


def test_wrapped_and_shared_addresses(one):
    assert one(U.unwrap_redirect("v"), v="https://www.google.com/url?sa=D&q=https%3A%2F%2Fx.org%2Fa%3Fb%3D1") == "https://x.org/a?b=1"
    assert one(U.unwrap_redirect("v"), v="https://x.org/url?q=1") == "https://x.org/url?q=1"
    assert one(U.drive_download("v"), v="https://drive.google.com/file/d/AbC/view") == "https://drive.google.com/uc?export=download&id=AbC"
    assert one(U.drive_download("v"), v="https://drive.google.com/open?id=Q") == "https://drive.google.com/uc?export=download&id=Q"


def test_candidates_prefer_sites_to_notices(one):
    got = one(
        U.candidates(["a", "b", "c"]), a="www.site.com.br ", b="veja https://drive.google.com/file/d/1 e https://www.sold.com.br/leilao-12345.", c="https://www.google.com/maps https://x.org/a.pdf?x"
    )
    assert got == ["https://www.sold.com.br/leilao-12345", "https://www.site.com.br", "https://x.org/a.pdf?x", "https://drive.google.com/file/d/1"]


def test_links_from(one):
    assert one(U.links_from("a", "b"), a="http://x/a). http://y/?a=1&amp;b=2", b="http://x/a") == "http://x/a | http://y/?a=1&b=2"
    assert one(U.links_from("a"), a="nichts") == ""


def test_absolute_and_image(one):
    assert one(U.absolute(F.lit("https://h.br/a/b"), "v"), v="../c?x=1&amp;y=2") == "https://h.br/c?x=1&y=2"
    assert one(U.image_url("v", F.lit("https://h.br/a/")), v="fotos\\/1.jpg") == "https://h.br/a/fotos/1.jpg"
    for bad in ("data:image/png;base64,x", "/img/Logo.png", "x.svg", "", "ftp://h/x.jpg"):
        assert one(U.image_url("v", F.lit("https://h.br/")), v=bad) == ""


def test_looks_like_lot(one):
    yes = [("Lote 12", "https://h/x"), ("Caminhao R$ 10,00", ""), ("Trator azul", "https://h/lote/9"), ("Trator azul", "https://h/p?lot=1")]
    no = [("abc", "https://h/lote/1"), ("Facebook", "https://h/lote/1"), ("Lote 12", "https://www.facebook.com/x"), ("Trator azul", "https://h/evento/?lot=1"), ("Trator azul", "https://h/")]
    for want, cases in ((True, yes), (False, no)):
        for label, link in cases:
            assert one(U.looks_like_lot("a", "b"), a=label, b=link) is want, (label, link)


def test_keys_are_not_exchangeable(one):
    u = "https://H.org/Path/?Q=1#f"
    e = F.lit("")
    assert one(U.stable_key("v", e, e, e, e, e), v=u) == "url:https://h.org/path/?q=1"
    assert one(U.run_key("v", "v"), v=u) == "url:https://h.org/Path"
    assert one(U.merge_key("v", e, e, e, e), v=u) == "https://H.org/Path/?Q=1"
    assert one(U.merge_key(e, e, "v", F.lit("1"), F.lit("T")), v="Ev") == "ev|1|t"
    assert one(U.event_date_key("v", F.lit("2026-01-01")), v="Leilão  A") == "leilao-a|2026-01-01"
    assert one(U.site_event_key("v", F.lit("2026-01-01")), v=" Leilão  A ") == "leilão a|2026-01-01"


@pytest.mark.parametrize(
    ("value", "want"),
    [("12/3/2026", "2026-03-12"), ("em 30-02-2026 e 1/1/2026", ""), ("1/2/26", "2026-02-01"), ("", ""), ("x 7/8/202", "0202-08-07")],
)
def test_parse_date(one, value, want):
    assert one(D.parse_date("v"), v=value) == want


def test_long_date_and_clock(one):
    assert one(D.parse_long_date("v"), v="dia 5 de MARÇO de 2026") == "2026-03-05"
    assert one(D.parse_long_date("v"), v="31 de fevereiro de 2026") == ""
    for text, want in (("às 9h", "09:00"), ("14:30 hs", "14:30"), ("2ª vara", "02:00"), ("99:10 ou 10:00", ""), ("sem", "")):
        assert one(D.clock("v"), v=text) == want, text


@pytest.mark.parametrize(
    ("day", "hour", "mode", "want"),
    [
        ("2026-07-15", "", "event", True), ("2026-07-13", "23:00", "event", False), ("2026-07-14", "15:00", "event", False), ("2026-07-14", "16:00", "event", False),
        ("2026-07-14", "16:01", "event", True), ("2026-07-14", "17", "event", True), ("2026-07-14", "17", "lot", True), ("2026-07-14", "99:10", "event", True),
        ("2026-07-14", "99:10", "lot", True), ("2026-07-14", "10h", "lot", False), ("2026-7-15", "", "lot", True), ("2026-7-15", "", "event", False), ("2026-7-15", "", "site", False),
        ("2026-02-30", "", "lot", False), ("", "", "site", False), (" 2026-07-15 ", "", "site", True), (" 2026-07-15 ", "", "event", False),
    ],
)
def test_upcoming(one, day, hour, mode, want):
    assert one(D.upcoming("d", "h", now(), mode), d=day, h=hour) is want


def test_status_and_window(one):
    today = F.lit("2026-07-14").cast("date")
    assert [one(D.status_at_scan("v", today), v=d) for d in ("", "2026-07-14", "2026-07-13", "2026-02-30")] == ["sem_data", "futuro_ou_hoje", "passado", "sem_data"]
    assert [one(D.sane_date("v", today), v=d) for d in ("2026-07-12", "2026-07-11", "2027-07-19", "2027-07-20", "x")] == [True, False, True, False, False]


def test_ages(one):
    moment = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(D.age_hours(moment("2026-07-14 13:30:00"), now())) == 2.5
    assert [one(D.is_recent(moment(m), now())) for m in ("2026-07-14 08:00:00", "2026-07-14 07:59:59", "2026-07-14 17:00:00", "2026-07-14 17:00:01")] == [True, False, True, False]


@pytest.mark.parametrize(
    ("value", "want"),
    [("2026-07-24T10:00:00Z", "2026-07-24 10:00"), ("2026-07-24T10:00:00-0300", "2026-07-24 13:00"), ("2026-07-24T10:00", "2026-07-24 13:00"), ("2026-07-24", None), ("2026-02-30T10:00", None), ("x", None)],
)
def test_parse_moment(one, value, want):
    assert one(F.date_format(D.parse_moment("v"), "yyyy-MM-dd HH:mm"), v=value) == want


def test_version(one):
    assert one(D.version(now())) == "v2026.07.14.1600"


def test_infer_unit(one):
    for text, want in (("Patio - SP", "SP"), ("Rua A, XX, RJ", "RJ"), ("em MG hoje", "MG"), ("sp", ""), ("ES/SC", "SC"), ("", "")):
        assert one(D.infer_unit("v"), v=text) == want, text


def test_folding_equals_the_rules_over_all_characters(spark):
    """Every code point, alone and among others; nothing of it runs in Python."""
    import unicodedata

    codes = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x110000))]
    texts = ["".join(codes[k : k + 997]) for k in range(0, len(codes), 997)] + ["Straße ﬁn…½", "각힣가a", "İstanbul ŉ", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, v string").select("id", X.casefold("v").alias("c"), X.strip_accents("v").alias("s"))
    assert "EvalPython" not in df._jdf.queryExecution().executedPlan().toString()
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    got = {r["id"]: r for r in df.collect()}
    for k, t in enumerate(texts):
        assert got[k]["c"] == (t or "").casefold() and got[k]["s"] == plain(t or ""), k


def test_several_letters_by_a_short_way(spark):
    """texts of Latin letters are told from those that need a lookup without the whole class."""
    every = spark.range(1, 0x30000).filter("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "utf-32").alias("c"))
    for rule in (X._without_accents, str.casefold):
        t = X._table(rule)
        assert every.filter(F.col("c").rlike(t.any) != F.col("c").rlike(f"[{t.several}]")).isEmpty() and every.filter(F.col("c").rlike(t.any)).count() > 50


def test_functions_and_parsers_take_pieces():
    """what Python has in hand does not grow with an Arrow batch."""
    import pyarrow as pa

    from tidemark.functions import lazy
    from tidemark.operators import extract

    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2, 3, 4]), pa.array(["a" * 6, None, "b" * 6, "c" * 30, "d"])], names=["kept", "html"])
    got = list(extract.pieces(iter([batch, batch.slice(0, 0)]), 10))
    assert [b.column(0).to_pylist() for b in got] == [[0, 1], [2], [3], [4]] and pa.Table.from_batches(got).equals(pa.Table.from_batches([batch]))
    assert lazy.arrow_type("data string, hora string") == pa.struct([("data", pa.string()), ("hora", pa.string())])
