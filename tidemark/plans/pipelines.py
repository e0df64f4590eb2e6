"""The three plans: refreshing events, indexing lots, and the site.

Each is a function from tables to tables; the caller gives ``now`` and writes the
results to a staging path, which is published once the gates hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import temporal as D
from tidemark.functions import text as X
from tidemark.functions import urls as U
from tidemark.operators import dedupe, report, snapshot
from tidemark.sources.scratch import written


def refresh_events(scanned: DataFrame, enriched: DataFrame, now: str, yard_layer: str) -> dict[str, DataFrame]:
    """``scanned`` and ``enriched`` are event rows with ``seq``.  Enriched rows are
    written back by name and link; dated rows outside the yard layer are events, those
    still to come the future ones."""
    moment = F.lit(now).cast("timestamp_ntz")
    full = snapshot.write_back(scanned, enriched, ["nome", "link"])
    dated = (F.col("camada") != yard_layer) & (F.coalesce("data_original", F.lit("")) != "")
    events = full.filter(dated).withColumn("status_data", D.updated_status("data", "hora_marcador", moment))
    future = events.filter(D.upcoming("data", "hora_marcador", moment, "event"))
    return {"full": full, "events": events, "future": future, "yards": full.filter(F.col("camada") == yard_layer)}


def index_lots(events: DataFrame, lots: DataFrame, logs: DataFrame, previous: DataFrame, now: str) -> dict[str, DataFrame]:
    """``lots`` (of an event ``n``, in order of ``seq``) deduplicated over events, those
    of failed events carried over from ``previous``, invalid, repeated and past ones
    left out; and the logs with their lots counted anew.  ``carried`` are the rows taken
    over, before anything is left out."""
    moment = F.lit(now).cast("timestamp_ntz")
    keyed = lots.withColumn("key", U.title_link_key("titulo", "link_lote"))
    fresh = written(dedupe.first_per_key(keyed, ["key"], F.struct("n", "seq")), "fresh")
    logs = written(dedupe.recounted(fresh, logs), "logs")
    with_key = lambda df, name: df.withColumn("event_key", U.event_date_key(name, "data"))
    old = with_key(previous, "evento").withColumn("n", F.lit(None).cast("long"))
    failed = with_key(logs, "evento").filter("lotes = 0")
    new = with_key(fresh.drop("key"), "evento")
    proper = dedupe.valid_lot(X.clean_text("titulo"), X.clean_text("lote"))
    carried = written(snapshot.carried_rows(old, with_key(events, "nome"), failed, new, "event_key", "status_captura", proper), "carried")
    valid = snapshot.with_carried(new.filter(proper), carried)  # the others are proper
    final = valid.withColumn("final_key", U.final_key("evento", "lote", "titulo", "link_lote"))
    unique = dedupe.first_per_key(final, ["final_key"], F.struct("source", "n", "seq"))
    current = unique.filter(D.upcoming("data", "hora", moment, "lot")).drop("final_key", "event_key")
    return {"lots": written(current, "lots"), "logs": logs, "fresh": fresh.drop("key"), "carried": carried}


def site_events(events: DataFrame, now: str) -> DataFrame:
    """Events still to come, units that are none empty."""
    rows = events.filter(D.upcoming("data", "hora_marcador", F.lit(now).cast("timestamp_ntz"), "site"))
    return rows.withColumn("uf", F.when(F.col("uf").isin(*S.UNIT_CODES), F.col("uf")).otherwise(""))


def site(lots: DataFrame, events: DataFrame, now: str) -> DataFrame:
    """Upcoming lots with gaps filled from their events (:func:`site_events`), duplicates
    merged by quality, in order of date, hour and unit; ``rank`` is the place.  What is
    used twice is written once."""
    moment = F.lit(now).cast("timestamp_ntz")
    rows = lots.filter(D.upcoming("data", "hora", moment, "site"))
    rows = rows.withColumn("uf", F.when(F.col("uf").isin(*S.UNIT_CODES), F.col("uf")).otherwise(""))
    fill = {"link_edital": "link_edital", "resumo_edital": "resumo_edital", "link_evento": "link"}
    rows = snapshot.lookup_left_join(rows, site_events(events, now), U.site_event_key("evento", "data"), U.site_event_key("nome", "data"), fill)
    rows = rows.withColumns({"merge_key": U.merge_key("link_lote", "link_evento", "evento", "lote", "titulo"), "score": dedupe.quality("titulo", "descricao", dedupe.generic_title("titulo"))})
    merged = dedupe.quality_merge(written(rows, "rows"), ["merge_key"], "score", ("lote", "foto_lote", "link_edital", "resumo_edital", "link_evento", "lance_atual"))
    order = [S.filled("data", F.lit("9999-99-99")), S.filled("hora", F.lit("23:59")), F.col("uf")]
    return dedupe.ordered_rank(written(merged, "merged"), order, "first_seq").drop("merge_key", "score")


def update_report(previous: DataFrame, final: DataFrame, fresh: DataFrame, logs: DataFrame, carried: DataFrame) -> DataFrame:
    """One row about a run: outcome counters, the difference of snapshots by stable
    key, what was read and carried over (all that was, see :func:`index_lots`), counts by
    host and the attempts that failed."""
    keyed = lambda df: df.select(U.stable_key("link_lote", "link_evento", "fonte", "evento", "lote", "titulo").alias("key"))
    before = keyed(previous)
    counts = snapshot.run_counts(before, before if final is previous else keyed(final), keyed(fresh))
    kept = carried.agg(F.count("*").alias("carried"))
    hosts = report.host_maps(report.host_counts(logs, S.filled("link", "final_url")))
    failed = report.failed_attempts(logs).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct("url", "status", "http").alias("a")))), lambda r: r["a"]).alias("failed_attempts"))
    out = report.outcome_counters(logs)
    for one in (counts, kept, hosts, failed):  # each is one row
        out = out.crossJoin(one)
    return out


def failed_report(previous: DataFrame, final: DataFrame, fresh: DataFrame, logs: DataFrame) -> DataFrame:
    """:func:`update_report` of a run in which no source gave lots: the old base stays
    whole, and ``candidates`` is how many lots would have stood in its place."""
    return update_report(previous, previous, fresh, logs, previous).crossJoin(final.agg(F.count("*").alias("candidates")))


def publish(spark: SparkSession, tables: dict[str, DataFrame], base: str, version: str, fault: str) -> str | None:
    """Writes tables under a staging path and renames it to the version when ``fault``
    is empty; otherwise nothing changes and the staging path is removed."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    staging, final = f"{base}/_staging-{version}", f"{base}/{version}"
    fs = fs_path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{staging}/{name}")
    if fault or not fs.rename(fs_path(staging), fs_path(final)):
        fs.delete(fs_path(staging), True)
        return None
    return final
