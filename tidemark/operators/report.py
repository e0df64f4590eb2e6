"""Counters, rankings and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.operators.dedupe import ordered_rank

#: Fewest events, freshest and oldest ages in hours, and sizes that gates ask for.
LEAST_EVENTS, RECENT_HOURS, STATUS_HOURS, LEAST_PAGE = 10, 8.0, 12.0, 100_000
LEAST_LOTS, LOT_SHARE = 25, 20


def most_common(df: DataFrame, value: str, seq: str = "seq", missing: str | None = None) -> DataFrame:
    """(value, n, rank): most frequent first, ties by first appearance."""
    v = F.col(value).cast("string")
    v = v if missing is None else F.coalesce(F.nullif(v, F.lit("")), F.lit(missing))
    counted = df.groupBy(v.alias("value")).agg(F.count("*").alias("n"), F.min(seq).alias("_first"))
    return ordered_rank(counted, [-F.col("n")], "_first").drop("_first")


def summary(events: DataFrame, unit: str = "uf", day: str = "data", seq: str = "seq") -> DataFrame:
    """One row of totals with the two rankings as arrays."""
    upcoming = events.filter("is_future")
    rank = lambda c, missing: most_common(upcoming, c, seq, missing).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))), lambda r: F.struct(r["value"], r["n"])).alias(c))
    totals = events.agg(
        F.count("*").alias("total_rows"), F.count_if("is_event").alias("events"), F.count_if("is_future").alias("future"), F.count_if("is_yard").alias("yards"),
        F.count_if(F.col("is_future") & (F.coalesce("link", F.lit("")) != "")).alias("with_link"),
        F.count_if(F.col("is_future") & (F.col("fonte_data_hora") == "edital_pdf")).alias("date_from_notice"),
        F.count_if(F.col("is_future") & (F.col("fonte_data_hora") == "site")).alias("date_from_site"),
    )
    return totals.crossJoin(rank(unit, "Sem UF").withColumnRenamed(unit, "by_unit")).crossJoin(rank(day, "sem_data").withColumnRenamed(day, "by_date"))


def _has(status: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | status.contains(w)
    return out


def outcome_counters(logs: DataFrame, status: str = "status", lots: str = "lotes") -> DataFrame:
    """One row of overlapping counts of event outcomes: blocked ones are errors."""
    s = F.coalesce(F.col(status), F.lit(""))
    return logs.agg(
        F.count("*").alias("analysed"),
        F.count_if(F.col(lots) > 0).alias("with_lots"),
        F.count_if(F.coalesce(F.col(lots), F.lit(0)) == 0).alias("without_lots"),
        F.count_if(_has(s, "erro", "http_0", "bloqueado")).alias("errors"),
        F.count_if(s.contains("bloqueado")).alias("blocked"),
        F.count_if((s == "sem_link") | s.contains("http_404")).alias("invalid"),
    )


def host_counts(logs: DataFrame, link: str | Column = "link", status: str = "status", lots: str = "lotes") -> DataFrame:
    """(host, lots, errors) of hosts with either."""
    s = F.coalesce(F.col(status), F.lit(""))
    grouped = logs.groupBy(U.host_counts_key(link).alias("host")).agg(
        F.coalesce(F.sum(F.when(F.col(lots) > 0, F.col(lots))), F.lit(0)).alias("lots"), F.count_if(_has(s, "erro", "http_0", "bloqueado")).alias("errors")
    )
    return grouped.filter("lots > 0 or errors > 0")


def host_maps(counts: DataFrame) -> DataFrame:
    """One row with the counts of :func:`host_counts` as two maps, in order of host; an
    export."""
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c) > 0, F.struct("host", c)))))
    return counts.agg(entries("lots").alias("lots_by_host"), entries("errors").alias("errors_by_host"))


def notice_counters(events: DataFrame, lots: DataFrame) -> DataFrame:
    """One row: events and lots that have a notice."""
    have = lambda df, name: df.agg(F.count_if(F.coalesce("link_edital", F.lit("")) != "").alias(name))
    return have(events, "events_with_notice").crossJoin(have(lots, "lots_with_notice"))


def failed_attempts(logs: DataFrame, attempts: str = "fontes_tentadas", seq: str = "n", most: int = 500) -> DataFrame:
    """The first attempts, in order of event and attempt, that found nothing with an
    error: (rank, seq, pos, url, status, http)."""
    rows = logs.select(F.col(seq).alias("seq"), F.posexplode(attempts).alias("pos", "a")).select("seq", "pos", "a.*")
    s = F.coalesce("status", F.lit(""))
    failed = rows.filter((F.coalesce("lotes", F.lit(0)) == 0) & _has(s, "erro", "bloqueado", "http_0", "http_4", "http_5"))
    # a limit after a sort keeps a few rows a task; the rank is made over those alone
    top = failed.select("seq", "pos", "url", "status", "http").orderBy("seq", "pos").limit(most)
    return top.withColumn("rank", F.row_number().over(W.orderBy("seq", "pos")))


def event_gate(future: Column, recent: Column) -> Column:
    """Empty when events may be published, else what is wrong with them."""
    return F.when(future < LEAST_EVENTS, "few_events").when(~recent, "stale").otherwise("")


def lot_gate(recent: Column, in_json: Column, informed: Column, in_csv: Column, previous: Column, captured: Column, carried: Column) -> Column:
    """Empty when lots may be published, else the first fault in the order of checks."""
    least = F.greatest(F.lit(LEAST_LOTS), F.floor(previous / LOT_SHARE))
    return (
        F.when(~recent, "stale")
        .when(in_json != informed, "count_differs")
        .when(in_csv != in_json, "files_differ")
        .when(in_json < least, "few_lots")
        .when(captured + carried <= 0, "nothing_read")
        .otherwise("")
    )


def checks_status(checks: dict[str, Column]) -> tuple[Column, Column]:
    """Whether all checks hold, and the names of those that don't, in order."""
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in checks.items()])
    return F.forall(pairs, lambda p: p["ok"]), F.transform(F.filter(pairs, lambda p: ~p["ok"]), lambda p: p["name"])


def may_write(analysed: Column, with_lots: Column, allow_empty: bool = False) -> Column:
    """False when events were read and none gave lots: the old base stays."""
    return F.lit(allow_empty) | ~((analysed > 0) & (with_lots == 0))
