"""Comparing a snapshot with the one before, and carrying records forward."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.operators.dedupe import last_per_key


def lookup_left_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, fill: dict[str, str], seq: str = "seq") -> DataFrame:
    """Left join to the last right row of each key; ``fill`` maps left columns to the
    right ones that stand in where they are empty."""
    wanted = right.select(right_key.alias("_right"), F.col(seq).alias("_seq"), *[F.col(v).alias(f"_{k}") for k, v in fill.items()])
    last = last_per_key(wanted, ["_right"], "_seq").drop("_seq")
    joined = left.withColumn("_left", left_key).join(last, F.col("_left").eqNullSafe(F.col("_right")), "left")
    return joined.withColumns({k: S.filled(F.col(k).cast("string"), F.col(f"_{k}").cast("string")) for k in fill}).drop("_left", "_right", *[f"_{k}" for k in fill])


def write_back(rows: DataFrame, changed: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Rows replaced, whole, by the last changed row of the same key, wherever there
    is one; the number of rows and their ``seq`` stay."""
    columns = [c for c in rows.columns if c not in {*keys, seq}]
    last = last_per_key(changed, keys, seq)
    new = last.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*columns).alias("_new"))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = rows.join(new, match, "left")
    return joined.select(*keys, seq, *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def allowed_keys(current: DataFrame, failed: DataFrame, fresh: DataFrame, key: str = "key") -> DataFrame:
    """Keys of current events whose reading failed and that got nothing new."""
    return current.select(key).intersect(failed.select(key)).join(fresh.select(key).distinct(), key, "left_anti")


def carried_status(status: str | Column) -> Column:
    """Marks a status as carried, once; at most 120 signs."""
    s = F.coalesce(F.col(status) if isinstance(status, str) else status, F.lit(""))
    return F.when(s.startswith(S.CARRIED), s).otherwise(F.substring(F.concat(F.lit(S.CARRIED), s), 1, 120))


def carried_rows(previous: DataFrame, current: DataFrame, failed: DataFrame, fresh: DataFrame, key: str = "key", status: str = "status", valid: Column | None = None) -> DataFrame:
    """The previous rows of events that failed this time, their status marked.  How many
    they are is what a run says it carried, whatever becomes of them later."""
    old = previous.join(allowed_keys(current, failed, fresh, key), key, "left_semi")
    return (old if valid is None else old.filter(valid)).withColumn(status, carried_status(status))


def with_carried(fresh: DataFrame, old: DataFrame) -> DataFrame:
    """Fresh rows, then carried ones; ``source`` is 0 and 1, to order by."""
    return fresh.withColumn("source", F.lit(0)).unionByName(old.withColumn("source", F.lit(1)), allowMissingColumns=True)


def carry_forward(previous: DataFrame, current: DataFrame, failed: DataFrame, fresh: DataFrame, key: str = "key", status: str = "status", valid: Column | None = None) -> DataFrame:
    """Fresh rows, then the previous ones of events that failed this time."""
    return with_carried(fresh, carried_rows(previous, current, failed, fresh, key, status, valid))


def new_and_removed(before: DataFrame, after: DataFrame, key: str = "key") -> DataFrame:
    """Keys in one snapshot only, as (key, change)."""
    a, b = before.select(key).filter(F.col(key) != "").distinct(), after.select(key).filter(F.col(key) != "").distinct()
    return b.join(a, key, "left_anti").withColumn("change", F.lit("new")).unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("removed")))


def run_counts(before: DataFrame, after: DataFrame, fresh: DataFrame, key: str = "key") -> DataFrame:
    """One row about a run: rows before, after and captured, and distinct keys that are
    new, gone, and captured though not there before; a single shuffle by key.  A table given
    twice is read once."""
    tables = {"b": before, "a": after, "f": fresh}
    once = {id(df): df for df in tables.values()}.values()
    flagged = [df.select(key, *[F.lit(int(tables[k] is df)).cast("long").alias(k) for k in tables]) for df in once]
    by_key = reduce(DataFrame.unionByName, flagged).groupBy(key).agg(*[F.sum(k).alias(k) for k in tables])
    known = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    total = lambda k, name: F.coalesce(F.sum(k), F.lit(0)).alias(name)
    only = lambda k, without, name: F.count_if(known & (F.col(k) > 0) & (F.col(without) == 0)).alias(name)
    return by_key.agg(
        total("b", "rows_before"), total("a", "rows_after"), total("f", "captured"),
        only("a", "b", "new_keys"), only("b", "a", "removed_keys"), only("f", "b", "fresh_new_keys"),
    )


def diff_counts(before: DataFrame, after: DataFrame, key: str = "key") -> DataFrame:
    """One row: numbers of rows before and after, and of distinct keys new and gone,
    from a single shuffle by key."""
    both = before.select(key, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(key, F.lit(0).alias("b"), F.lit(1).alias("a")))
    by_key = both.groupBy(key).agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    known = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    return by_key.agg(
        F.coalesce(F.sum("b"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("rows_after"),
        F.count_if(known & (F.col("b") == 0)).alias("new_keys"),
        F.count_if(known & (F.col("a") == 0)).alias("removed_keys"),
    )
