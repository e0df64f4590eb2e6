"""Lots of pages, notices and offers, and the reading of an event's sources in order.

Content has been fetched and written before (see ``sources.web``); what a sequential
reader would do with it, stopping at the first source that gives lots, is a minimum
over positions here.  A source is tried in up to four ways: the offer interface, its
own answer (page or notice), and the first two notices that belong to its page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import text as X
from tidemark.functions import urls as U
from tidemark.functions.lazy import arrow_function
from tidemark.operators import dedupe, extract
from tidemark.sources import offers, scratch, web
from tidemark.sources.scratch import written

#: What identifies a source of an event.
KEYS = ("n", "pos")
#: What all kinds of lots have in common here; ``branch`` and ``at`` give their order.
FOUND = ("branch", "at", "titulo", "descricao", "lance_atual", "lote", "link_lote", "foto_lote")
#: Signs of a title and of a description.
TITLE, DESCRIPTION = 240, 600


@arrow_function("string")
def _pdf(raw: list[bytes | None]) -> list[str | None]:
    return [None if b is None else web.pdf_text(b) for b in raw]


def _object_lots(pages: DataFrame) -> DataFrame:
    rows = extract.json_objects(pages.select(F.struct(*KEYS).alias("page"), "final_url", "html"), "html", ("page", "final_url"), embedded=True).filter("error is null")
    link = S.filled(F.when(F.col("link") != "", U.absolute("final_url", "link")), "final_url")
    rows = rows.withColumn("link_lote", link).filter((F.col("text") != "") & U.looks_like_lot("text", F.when(F.col("link") != "", F.col("link_lote")).otherwise("")))
    images = rows.select("page", "pos", "final_url", F.posexplode("images").alias("i", "image")).withColumn("image", U.image_url("image", "final_url")).filter("image <> ''")
    first = images.groupBy(F.col("page").alias("p"), F.col("pos").alias("o")).agg(F.min_by("image", "i").alias("foto_lote"))
    rows = rows.join(first, (F.col("page") == F.col("p")) & (F.col("pos") == F.col("o")), "left")
    return rows.select(
        "page.*", F.lit(0).alias("branch"), rows["pos"].alias("at"), F.col("text").alias("titulo"), F.substring("description", 1, DESCRIPTION).alias("descricao"), F.col("price").alias("lance_atual"),
        X.lot_number("text").alias("lote"), "link_lote", F.coalesce("foto_lote", F.lit("")).alias("foto_lote"),
    )


def _link_lots(read: DataFrame) -> DataFrame:
    links = extract.page_links(read.select(F.struct(*KEYS).alias("page"), "final_url", "links"), "final_url", ("page",)).filter("is_lot")
    return links.select(
        "page.*", F.lit(1).alias("branch"), F.col("pos").alias("at"), F.col("label").alias("titulo"), F.lit("").alias("descricao"), X.price("label").alias("lance_atual"),
        X.lot_number("label").alias("lote"), F.col("link").alias("link_lote"), F.col("image").alias("foto_lote"),
    )


def text_lots(rows: DataFrame, text: str, branch: int = 2, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Numbered segments of a text as lots, of rows with ``keys`` and final_url."""
    parts = extract.text_segments(rows.select(F.struct(*keys).alias("page"), "final_url", text), text, ["page", "final_url"])
    return extract.segment_lots(parts, "final_url").select(
        "page.*", F.lit(branch).alias("branch"), F.col("pos").alias("at"), "titulo", "descricao", "lance_atual", "lote", "link_lote", F.lit("").alias("foto_lote")
    )


def page_lots(pages: DataFrame) -> DataFrame:
    """Lots of pages (n, pos, final_url, html): from data scripts, then from links, each
    whole title and link once; the visible text only of pages that have neither."""
    read = extract.html_pages(pages, keep=(*KEYS, "final_url"))
    found = _object_lots(pages).unionByName(_link_lots(read))
    found = written(dedupe.first_per_key(found.withColumn("_key", U.title_link_key("titulo", "link_lote")), [*KEYS, "_key"], F.struct("branch", "at")).drop("_key"), "page-lots")
    bare = read.join(found.select(*KEYS).distinct(), list(KEYS), "left_anti").withColumn("shown", F.array_join("visible", "\n"))
    return found.withColumn("titulo", F.substring("titulo", 1, TITLE)).unionByName(text_lots(bare, "shown"))


def offer_lots(wanted: DataFrame, api: DataFrame, captured: str) -> tuple[DataFrame, DataFrame]:
    """Lots and attempts of events (their columns, n, pos, url) from pages of the offer
    interface (:data:`web.OFFERS`): pages count in turn up to the first that is faulty,
    short, or with which as many lots came as were announced."""
    value = F.try_parse_json("body")
    pages = api.select(F.col("url").alias("of"), "page", F.col("status").alias("code"), F.when(F.col("status") == 200, value).alias("v"))
    pages = pages.withColumns(
        {
            "is_object": F.coalesce(F.expr("schema_of_variant(v)").startswith("OBJECT"), F.lit(False)), "offers": F.expr("try_variant_get(v, '$.offers', 'array<variant>')"),
            "total": F.coalesce(F.expr("try_variant_get(v, '$.total', 'bigint')"), F.lit(0)),
        }
    ).drop("v")
    listed = pages.select("of", "page", F.posexplode("offers").alias("i", "offer")).filter(F.expr("schema_of_variant(offer)").startswith("OBJECT"))
    titled = offers.titled(listed).groupBy(F.col("of").alias("o"), F.col("page").alias("p")).agg(F.count("*").alias("lots"))
    pages = pages.withColumn("size", F.coalesce(F.size("offers"), F.lit(0))).drop("offers").join(titled, (F.col("of") == F.col("o")) & (F.col("page") == F.col("p")), "left").drop("o", "p")
    upto = W.partitionBy("of").orderBy("page")
    so_far = F.sum(F.coalesce("lots", F.lit(0))).over(upto.rowsBetween(W.unboundedPreceding, 0))
    pages = pages.withColumn("on", (F.col("code") == 200) & F.col("is_object") & (F.col("size") >= web.PAGE_SIZE) & (so_far < F.col("total")))
    read = pages.withColumn("read", F.coalesce(F.min(F.col("on").cast("int")).over(upto.rowsBetween(W.unboundedPreceding, -1)), F.lit(1)) == 1).filter("read")
    said = F.when(F.col("code") == 0, "api_superbid_erro").when(F.col("code") != 200, F.concat(F.lit("api_superbid_http_"), F.col("code").cast("string"))).when(~F.col("is_object"), "api_superbid_json_invalido").otherwise("api_superbid_http_200")
    state = read.groupBy("of").agg(F.max_by(said, "page").alias("said"), F.coalesce(F.sum("lots"), F.lit(0)).cast("int").alias("lots"))
    known = F.when(U.event_id("url") == "", "api_superbid_sem_id_evento").when(F.col("lots") > 0, "api_superbid_ok").otherwise(F.coalesce("said", F.lit("api_superbid_erro")))
    counted = F.when(U.event_id("url") == "", 0).otherwise(F.coalesce("lots", F.lit(0)))
    attempts = wanted.select(*KEYS, "url").join(state, F.col("url") == F.col("of"), "left").select(*KEYS, "url", known.alias("status"), counted.alias("lots"))
    chosen = listed.join(read.select(F.col("of").alias("o"), F.col("page").alias("p")), (F.col("of") == F.col("o")) & (F.col("page") == F.col("p")), "left_semi")
    rows = wanted.filter(U.event_id("url") != "").join(chosen, F.col("url") == F.col("of")).withColumns({"source_url": F.col("url"), "event_url": F.col("url")})
    place = (F.col("page") * 10_000 + F.col("i")).alias("at")
    return offers.lots_from_offers(rows, captured, keep=(*[F.col(k) for k in KEYS], place)), attempts


def sources_of(events: DataFrame, most: int = 4) -> DataFrame:
    """(n, pos, url): the candidates of each event (n and the event columns)."""
    found = U.candidates(["site_leiloeiro", "link", "link_edital", "descricao"], most)
    return events.select("n", F.posexplode(found).alias("pos", "url"))


def _content(fetched: DataFrame) -> DataFrame:
    return fetched.dropDuplicates(["url"]).select(F.col("url").alias("_url"), F.col("status").alias("http"), "body", "content_type", F.coalesce(F.nullif("final_url", F.lit("")), "url").alias("final_url"))


def _nothing(rows: DataFrame, columns: str) -> DataFrame:
    return rows.sparkSession.createDataFrame([], columns)


def read_events(events: DataFrame, fetched: DataFrame, captured: str, api: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Lots and logs of events from fetched content (url, status, body, content_type,
    final_url) and pages of the offer interface (:data:`web.OFFERS`).

    Each event's sources count in order up to the first with lots.  A source of the
    interface is asked there first, and read as a page if that gives nothing.  A notice
    that answers 200 gives its segments.  Any other answer is a page: its lots count if
    it answers 200, and together with them those of the first two of the event's own
    notice and the notices that the page links to, whatever the page answers.  An
    event that meets a page that cannot be decoded gives no lots but a log with the
    error.  What is read of the sources is written once and used from there; only the
    results stay."""
    kept: list[DataFrame] = []
    with scratch.scope(kept):
        kept += concluded(events, read_sources(events, sources_of(events), fetched, captured, api), captured)
    return kept[0], kept[1]


def concluded(events: DataFrame, read: dict[str, DataFrame], captured: str) -> list[DataFrame]:
    """:func:`conclude`, written."""
    return [written(df, name) for df, name in zip(conclude(events, read, captured), ("event-lots", "event-logs"), strict=True)]


def answers_of(wanted: DataFrame, fetched: DataFrame) -> DataFrame:
    """The answer of each of ``wanted`` (n, pos, url): http, body, content_type,
    final_url, and whether it is a notice."""
    got = wanted.join(_content(fetched), F.col("url") == F.col("_url"), "left").drop("_url").withColumns({"final_url": F.coalesce("final_url", "url"), "http": F.coalesce("http", F.lit(0))})
    return got.withColumn("pdf", F.coalesce(web.is_pdf("final_url", "content_type", "body") & (F.col("http") == 200), F.lit(False)))


def pages_of(answers: DataFrame) -> DataFrame:
    """Answers that are no notices, decoded; ``fault`` where that cannot be."""
    pages = answers.filter("not pdf").withColumns({"html": web.decoded(F.col("body"), F.col("content_type")), "fault": web.undecodable(F.col("content_type"))})
    return pages.withColumn("state", extract.capture_status(F.col("http"), F.col("html"))).drop("body")


def with_notices(pages: DataFrame, events: DataFrame) -> DataFrame:
    """Sound pages with the ``notices`` that are read beside them: the first two of the
    event's own one and those that the page links to."""
    sound = pages.filter("fault is null").join(events.select(F.col("n").alias("_n"), X.clean_text("link_edital").alias("own")), F.col("n") == F.col("_n")).drop("_n")
    none = F.expr("cast(array() as array<string>)")
    notices = F.array_distinct(F.concat(F.when(F.col("own") != "", F.array("own")).otherwise(none), extract.notice_links("html", "final_url")))
    return sound.withColumn("notices", F.slice(notices, 1, 2))


def read_sources(events: DataFrame, wanted: DataFrame, fetched: DataFrame, captured: str, api: DataFrame | None = None) -> dict[str, DataFrame]:
    """What each of ``wanted`` (n, pos, url) gives: ``sources`` (how its reading ended),
    ``tries``, ``lots`` and ``offered``."""
    have = _content(fetched)
    got = answers_of(wanted, fetched)
    # the offer interface
    event_columns = events.select(F.col("n").alias("_n"), *S.EVENT_FIELDS)
    asked = wanted.filter(U.served_by_api("url")).join(event_columns, F.col("n") == F.col("_n")).drop("_n")
    offered, api_attempts = offer_lots(asked, api if api is not None else _nothing(events, web.OFFERS), captured)
    api_attempts = written(api_attempts, "asked")
    # notices and pages
    direct = got.filter("pdf").withColumn("content", _pdf(F.col("body")))
    pages = pages_of(got)
    read_pages = written(with_notices(pages, events), "pages")
    sound = read_pages.drop("html", "content_type")
    linked = sound.select(*KEYS, F.posexplode("notices").alias("k", "notice")).join(have, F.col("notice") == F.col("_url"))
    linked = written(linked.filter((F.col("http") == 200) & web.is_pdf(F.lit(""), "content_type", "body")).select(*KEYS, "k", "notice", "final_url", _pdf(F.col("body")).alias("content")), "notices")
    direct = written(direct.select(*KEYS, "url", "http", "final_url", "content"), "direct")
    faults = written(pages.filter("fault is not null").select(*KEYS, "fault"), "faults")
    # lots of each source
    of_pages = page_lots(read_pages.filter("http = 200")).join(sound.select(*KEYS, F.col("final_url").alias("source"), "state", F.get("notices", 0).alias("notice")), list(KEYS))
    of_pages = of_pages.withColumns({"k": F.lit(0), "state": F.when(F.col("branch") == 2, "html_texto_ok").otherwise(F.col("state"))})
    of_direct = text_lots(direct, "content", 3).join(direct.select(*KEYS, F.col("final_url").alias("source")), list(KEYS)).withColumns({"k": F.lit(0), "state": F.lit("pdf_ok"), "notice": F.lit(None).cast("string")})
    of_linked = text_lots(linked, "content", 4, (*KEYS, "k")).join(linked.select(*KEYS, "k", F.col("final_url").alias("source")), [*KEYS, "k"]).withColumns({"state": F.lit("pdf_ok"), "notice": F.lit(None).cast("string")})
    lots = written(of_pages.unionByName(of_direct).unionByName(of_linked), "lots")
    # attempts: the interface, the answer itself, the notices
    counts = lots.groupBy(*KEYS, "k", (F.col("branch") == 4).alias("is_notice")).agg(F.count("*").cast("int").alias("lots"))
    of_own = counts.filter("not is_notice").select(*KEYS, "lots")
    own = direct.select(*KEYS, "url", "http", "final_url", F.lit(True).alias("pdf"), F.lit(None).cast("string").alias("state")).unionByName(sound.select(*KEYS, "url", "http", "final_url", F.lit(False).alias("pdf"), "state"))
    own = own.join(of_own, list(KEYS), "left").withColumn("lots", F.coalesce("lots", F.lit(0)))
    own = own.withColumn("status", F.when(~F.col("pdf"), F.col("state")).when(F.col("lots") > 0, "pdf_ok").otherwise("pdf_sem_lotes"))
    read = linked.select(*KEYS, "k", "notice", "final_url").join(counts.filter("is_notice").select(*KEYS, "k", "lots"), [*KEYS, "k"], "left").withColumn("lots", F.coalesce("lots", F.lit(0)))
    attempt = lambda sub, url, status, http: (*KEYS, sub.alias("sub"), F.struct(url.alias("url"), status.alias("status"), http.cast("int").alias("http"), F.col("lots").alias("lotes")).alias("a"))
    tries = api_attempts.select(*attempt(F.lit(0), F.col("url"), F.col("status"), F.lit(None)))
    tries = tries.unionByName(own.select(*attempt(F.lit(1), F.col("url"), F.col("status"), F.col("http"))))
    tries = tries.unionByName(read.select(*attempt(F.col("k") + 2, F.col("notice"), F.when(F.col("lots") > 0, "pdf_link_ok").otherwise("pdf_link_sem_lotes"), F.lit(200))))
    # what each source comes to
    by_notice = read.groupBy(*KEYS).agg(F.sum("lots").cast("int").alias("more"), F.max_by(F.when(F.col("lots") > 0, F.col("final_url")), F.when(F.col("lots") > 0, F.col("k"))).alias("notice_url"))
    each = wanted.join(api_attempts.select(*KEYS, F.col("status").alias("api_status"), F.col("lots").alias("api_lots")), list(KEYS), "left")
    each = each.join(own.select(*KEYS, "pdf", "status", "final_url", "lots"), list(KEYS), "left").join(by_notice, list(KEYS), "left").join(faults, list(KEYS), "left")
    each = each.na.fill(0, ["api_lots", "lots", "more"]).withColumn("by_api", F.col("api_lots") > 0)
    result = F.when(F.col("by_api"), F.col("api_status")).when(F.col("pdf"), F.col("status")).when(F.col("more") > 0, F.when(F.col("lots") > 0, "html_pdf_ok").otherwise("pdf_link_ok")).when(F.col("lots") > 0, "html_ok").otherwise(F.col("status"))
    final = F.when(F.col("by_api"), F.col("url")).when(F.col("more") > 0, F.col("notice_url")).otherwise(F.col("final_url"))
    each = each.select(*KEYS, "url", "by_api", F.when(F.col("by_api"), F.lit(None)).otherwise(F.col("fault")).alias("fault"), result.alias("result"), final.alias("final"), F.when(F.col("by_api"), F.col("api_lots")).otherwise(F.col("lots") + F.col("more")).alias("lots"))
    each = written(each.withColumn("ends", ((F.col("lots") > 0) | F.col("fault").isNotNull()).cast("int")), "sources")
    return {"sources": each, "tries": tries, "lots": lots, "offered": offered}


def conclude(events: DataFrame, read: dict[str, DataFrame], captured: str) -> tuple[DataFrame, DataFrame]:
    """Lots and logs of events from what :func:`read_sources` gives: of each event the
    sources up to the first with lots."""
    each, tries, lots, offered = (read[k] for k in ("sources", "tries", "lots", "offered"))
    event_columns = events.select(F.col("n").alias("_n"), *S.EVENT_FIELDS)
    tried = dedupe.source_fallback(each, ["n"], found="ends")
    logged = tried.groupBy("n").agg(
        F.max("fault").alias("erro"), F.max_by("result", "pos").alias("status"), F.max_by("final", "pos").alias("final_url"), F.min_by("url", "pos").alias("link"), F.sum("lots").cast("int").alias("lotes")
    )
    counted = tries.join(tried.select(*KEYS, "by_api"), list(KEYS)).filter("not by_api or sub = 0")
    attempts = counted.groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sub", "a"))), lambda r: r["a"]).alias("fontes_tentadas"))
    logged = logged.join(attempts, "n", "left")
    logs = events.select("n", F.col("nome").alias("evento"), "data", F.col("link").alias("_link")).join(logged, "n", "left")
    failed = F.col("erro").isNotNull()
    unless = lambda c: F.when(~failed, F.col(c))
    logs = logs.select(
        "n", "evento", unless("data").alias("data"), F.when(failed, U.first_url("_link")).otherwise(F.col("link")).alias("link"), unless("final_url").alias("final_url"),
        F.when(failed, "erro_execucao_evento").otherwise(F.coalesce("status", F.lit("sem_link"))).alias("status"), F.when(failed, 0).otherwise(F.coalesce("lotes", F.lit(0))).alias("lotes"),
        unless("fontes_tentadas").alias("fontes_tentadas"), "erro",
    )
    # the lots of the source at which each event's reading ended
    ended = tried.filter("lots > 0").select(*KEYS, F.col("url").alias("event_url"), "by_api")
    inherited = event_columns.drop(*FOUND, *KEYS)
    kept = lots.join(ended.filter("not by_api").drop("by_api"), list(KEYS)).join(inherited, F.col("n") == F.col("_n")).drop("_n")
    base = event_base_of(captured)
    order = lambda branch, k, at: F.struct(branch.cast("int").alias("branch"), k.cast("int").alias("k"), at.cast("int").alias("at")).alias("seq")
    rows = kept.select("n", order(F.col("branch"), F.col("k"), F.col("at")), *[(F.col(c) if c in FOUND else base[c]).alias(c) for c in S.LOT_FIELDS])
    by_api = offered.join(ended.filter("by_api").select(*KEYS), list(KEYS), "left_semi")
    return rows.unionByName(by_api.select("n", order(F.lit(-1), F.lit(0), F.col("at")), *S.LOT_FIELDS)), logs


def event_base_of(captured: str) -> dict[str, Column]:
    """:func:`offers.event_base` of found lots; a page's lots take over its first notice."""
    base = offers.event_base("source", "event_url", F.col("state"), F.lit(captured))
    return base | {"link_edital": S.filled(base["link_edital"], F.col("notice"))}
