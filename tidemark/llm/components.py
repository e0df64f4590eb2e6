"""Connected components of a link table, by alternating large and small stars.

Every round is two aggregates and two joins; nothing is collected.  A vertex with
very many links is a hot join key: both sides of each join are read from written
tables, so adaptive execution may split it, and the minima are partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, release


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star round over links (u, v): each vertex points its larger neighbours
    (large star), or itself and its smaller ones (small star), at its least one."""
    if small:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        both = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
        sides = edges.select(both.alias("e")).select("e.u", "e.v")
    sides = materialise(sides, "star")
    least = materialise(sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    moved = sides.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
    if small:
        out = moved.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), F.col("m")))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
    else:
        out = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = materialise(out.filter("u <> v").distinct(), "links")
    release(sides, least)
    return out


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(vertex, component) for every vertex of the links (u, v) of any ordered type; the
    component is its least vertex.  Links of a vertex to itself don't count."""
    current = materialise(edges.filter("u <> v").select("u", "v").distinct(), "links")
    before = _state(current)
    for _ in range(rounds):
        if not before[0]:
            break
        large = _star(current, small=False)
        new = _star(large, small=True)
        release(current, large)
        current, after = new, _state(new)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    roots = current.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots)
