"""Order-aware deduplication.  Tables have no order of their own: every operator
takes the column that gives it (``seq``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import schema as S


def _keys(keys: list[str | Column]) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def first_per_key(df: DataFrame, keys: list[str | Column], seq: str | Column = "seq") -> DataFrame:
    """The first row of each key, rows without ``seq`` after those with one.

    Each task keeps its first row of a key before the shuffle (Spark's group limit), so a
    hot key is no large group."""
    return _one_per_key(df, keys, (F.col(seq) if isinstance(seq, str) else seq).asc_nulls_last())


def last_per_key(df: DataFrame, keys: list[str | Column], seq: str | Column = "seq") -> DataFrame:
    """The last row of each key: what a map filled in order holds at the end.  Found as
    the first one is."""
    return _one_per_key(df, keys, (F.col(seq) if isinstance(seq, str) else seq).desc_nulls_last())


def _one_per_key(df: DataFrame, keys: list[str | Column], order: Column) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*_keys(keys)).orderBy(order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def top_per_key(df: DataFrame, keys: list[str], order: list[str | Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key, with their place."""
    place = F.row_number().over(W.partitionBy(*_keys(keys)).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= most)


def quality(title: str | Column, description: str | Column, generic: Column) -> Column:
    """Quality of a row in twentieths of a point, so ties are exact: twenty for each
    sign of a title that says something, one for each sign of the description."""
    t, d = (F.col(c) if isinstance(c, str) else c for c in (title, description))
    return F.when(generic, 0).otherwise(F.length(t)) * 20 + F.length(d)


def generic_title(title: str | Column) -> Column:
    t = F.trim(F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit("")))
    return t.rlike(r"(?iu)^(?:lote(?U:\s)*[\d.\-/a-z]*|efetuar lance|ver lote|detalhes)$")


#: Places of an order that one task of a window sees at most.
SPAN = 1 << 16


def _same(keys: list[str]) -> Column:
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return match


def best_before(df: DataFrame, keys: list[str], score: str, seq: str, name: str) -> DataFrame:
    """Adds the largest ``score`` of the rows of equal keys with a smaller ``seq``, null
    for the first, in two levels, so that no window holds more than ``SPAN`` places."""
    part = df.withColumn("_part", F.floor(F.col(seq) / SPAN))
    tops = part.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_of")).agg(F.max(score).alias("_top"))
    over = W.partitionBy(*[f"_{k}" for k in keys]).orderBy("_of").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.withColumn("_before", F.max("_top").over(over)).drop("_top")
    inner = W.partitionBy(*keys, "_part").orderBy(seq).rowsBetween(W.unboundedPreceding, -1)
    joined = part.join(tops, _same(keys) & (F.col("_part") == F.col("_of")))
    return joined.withColumn(name, F.greatest("_before", F.max(score).over(inner))).drop("_part", "_of", "_before", *[f"_{k}" for k in keys])


def ordered_rank(df: DataFrame, by: list[Column], seq: str, name: str = "rank") -> DataFrame:
    """Adds the place of each row in the order of ``by`` and then ``seq`` (no two are
    equal): the rows before its group, counted in two levels, and its place in it.  No
    window holds more than one value of ``by[0]``'s groups, or ``SPAN`` places."""
    names = [f"_by{i}" for i in range(len(by))] + ["_part"]
    keyed = df.withColumns({**{n: c for n, c in zip(names, by, strict=False)}, "_part": F.floor(F.col(seq) / SPAN)})
    sizes = keyed.groupBy(*names).agg(F.count("*").alias("_n"))
    firsts = sizes.groupBy("_by0").agg(F.sum("_n").alias("_all"))
    ahead = firsts.withColumn("_ahead", F.coalesce(F.sum("_all").over(W.orderBy("_by0").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(F.col("_by0").alias("_first"), "_ahead")
    inside = W.partitionBy("_by0").orderBy(*names[1:]).rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_within", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(ahead, F.col("_by0").eqNullSafe(F.col("_first")))
    sizes = sizes.select(*[F.col(n).alias(f"_{n}") for n in names], (F.col("_ahead") + F.col("_within")).alias("_start"))
    joined = keyed.join(sizes, _same(names))
    place = F.row_number().over(W.partitionBy(*names).orderBy(seq))
    return joined.withColumn(name, (F.col("_start") + place).cast("long")).drop(*names, *[f"_{n}" for n in names], "_start")


def quality_merge(df: DataFrame, keys: list[str], score: str, fill: tuple[str, ...], seq: str = "seq") -> DataFrame:
    """One row per key, as a fold in order would leave it in which a row replaces the
    one before only when strictly better, and a loser fills empty ``fill`` columns.

    Rows better than all before them are records.  The last record wins; the order of
    preference for filling is records, latest first, then the others as they came.
    ``first_seq`` is where the key first appeared."""
    judged = best_before(df, keys, score, seq, "_best")
    record = F.col("_best").isNull() | (F.col(score) > F.col("_best"))
    ranked = judged.withColumn("_order", F.struct(F.when(record, 0).otherwise(1), F.when(record, -F.col(seq)).otherwise(F.col(seq))))
    others = [c for c in df.columns if c not in {*keys, *fill}]
    top = [F.min_by(F.struct(*others), "_order").alias("_top")] if others else []
    filled = [F.coalesce(F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col("_order"))), F.min_by(c, "_order")).alias(c) for c in fill]
    out = ranked.groupBy(*keys).agg(*top, *filled, F.min(seq).alias("first_seq"))
    return out.select(*keys, *[F.col(f"_top.{c}").alias(c) for c in others], *fill, "first_seq")


def source_fallback(attempts: DataFrame, keys: list[str], pos: str = "pos", found: str | Column = "lots") -> DataFrame:
    """Attempts of each key that a reader going through its sources in order makes:
    all up to the first that finds something; the rest is never tried.

    The first finds are a partial aggregate, joined back (a broadcast while small), so a
    key with very many attempts is no window of its own."""
    hit = F.col(found) if isinstance(found, str) else found
    stops = attempts.filter(hit > 0).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(pos).alias("stop_pos"))
    joined = attempts.join(stops, _same(keys), "left").drop(*[f"_{k}" for k in keys])
    return joined.filter(F.col("stop_pos").isNull() | (F.col(pos) <= F.col("stop_pos")))


def first_events(events: DataFrame, limit: int, seq: str = "n") -> DataFrame:
    """The events up to number ``limit``; all for 0."""
    return events.filter(F.col(seq) <= limit) if limit else events


def global_dedupe(lots: DataFrame, logs: DataFrame, key: str = "key", seq: str = "seq", event: str = "n") -> tuple[DataFrame, DataFrame]:
    """Lots that are first of their key over all events, and the logs with their
    count of lots taken anew from them."""
    kept = first_per_key(lots, [key], F.struct(event, seq))
    return kept, recounted(kept, logs, event)


def recounted(kept: DataFrame, logs: DataFrame, event: str = "n") -> DataFrame:
    """The logs with their count of lots taken anew from those kept."""
    counts = kept.groupBy(F.col(event).alias("_n")).agg(F.count("*").cast("int").alias("_lots"))
    return logs.join(counts, F.col(event) == F.col("_n"), "left").withColumn("lotes", F.coalesce("_lots", F.lit(0))).drop("_n", "_lots")


def valid_lot(title: Column, number: Column) -> Column:
    """A cleaned title that is not a label of navigation, and no clause's number."""
    return ~F.lower(title).isin("", *S.NAVIGATION_LABELS) & ~number.rlike(r"^\d+\.\d{2,}$")
