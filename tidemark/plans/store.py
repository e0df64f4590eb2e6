"""Versions of snapshots, committed by one small file.

A version's tables are written bucketed by their key, so two versions are compared without
a shuffle.  What was written is described by a manifest (files with their sizes, rows,
layout), and ``CURRENT`` names the manifest and its hash.  Replacing ``CURRENT`` is the
commit: before it, readers see the old version whole, after it the new one, and nothing is
ever renamed but that file, so it holds on object stores too, where a folder's renaming is
no single step.

Rows and other figures are observed while the tables are written; the gates look at these,
so nothing is read again to decide whether a version may be published."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CURRENT, BUCKETS = "CURRENT", 64
#: What is observed of each table beside the number of its rows.
Metrics = dict[str, dict[str, Column]]


def _fs(spark: SparkSession, path: str):  # noqa: ANN202 - a Java object
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _read(spark: SparkSession, path: str) -> str | None:
    fs, place = _fs(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file in one step: beside it first, then in its place."""
    jvm = spark._jvm
    fs, place = _fs(spark, path)
    staged = jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    stream = fs.create(staged, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    over = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = over
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()).rename(staged, place, options)


def _files(spark: SparkSession, path: str) -> dict[str, int]:
    fs, place = _fs(spark, path)
    return {f.getPath().getName(): f.getLen() for f in fs.listStatus(place) if f.getPath().getName().startswith("part-")}


def _name(path: str) -> str:
    return "tidemark_" + hashlib.md5(path.encode()).hexdigest()  # noqa: S324 - a name, no secret


def _write(df: DataFrame, path: str, key: str, buckets: int, observed: Observation, figures: dict[str, Column]) -> None:
    """One bucketed table; each bucket is one task's file, and what is observed comes from
    the tasks that write."""
    spark = df.sparkSession
    spark.sql(f"drop table if exists {_name(path)}")
    rows = df.repartition(buckets, key).observe(observed, F.count("*").alias("rows"), *[c.alias(k) for k, c in figures.items()])
    rows.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(_name(path))
    spark.sql(f"drop table {_name(path)}")  # the files stay; the manifest says how they lie


def commit(
    spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, str], base: str, version: str, *, gate: Callable[[dict], str] | None = None, metrics: Metrics | None = None, buckets: int = BUCKETS,
) -> tuple[bool, str, dict]:
    """Writes ``tables`` as a version, each bucketed by its column in ``keys``, and makes it
    the current one unless ``gate`` names a fault in what was observed (by table: ``rows``
    and the table's ``metrics``).  Whether it did, the fault, and what was observed.

    A version that is not committed stays out of sight; writing it again replaces it."""
    seen: dict[str, dict] = {}
    entries: dict[str, dict] = {}
    for name, df in tables.items():
        path, observed = f"{base}/{version}/{name}", Observation()
        _write(df, path, keys[name], buckets, observed, (metrics or {}).get(name, {}))
        seen[name] = dict(observed.get)
        entries[name] = {"key": keys[name], "buckets": buckets, "schema": df.schema.jsonValue(), "rows": seen[name]["rows"], "files": _files(spark, path)}
    if fault := gate(seen) if gate else "":
        return False, fault, seen
    manifest = json.dumps({"version": version, "tables": entries}, sort_keys=True)
    _put(spark, f"{base}/{version}/manifest.json", manifest)
    _put(spark, f"{base}/{CURRENT}", json.dumps({"version": version, "sha256": hashlib.sha256(manifest.encode()).hexdigest()}))
    return True, "", seen


def _manifest(spark: SparkSession, base: str) -> dict | None:
    if (pointer := _read(spark, f"{base}/{CURRENT}")) is None:
        return None
    said = json.loads(pointer)
    text = _read(spark, f"{base}/{said['version']}/manifest.json") or ""
    if hashlib.sha256(text.encode()).hexdigest() != said["sha256"]:
        raise ValueError(f"the manifest of version {said['version']} is not the one that was committed")
    return json.loads(text)


def current(spark: SparkSession, base: str) -> tuple[str, dict[str, DataFrame]]:
    """The committed version and its tables; an empty name and none before the first.

    A table whose files differ from the manifest's raises a ValueError."""
    if (manifest := _manifest(spark, base)) is None:
        return "", {}
    out = {}
    for name, entry in manifest["tables"].items():
        path = f"{base}/{manifest['version']}/{name}"
        if _files(spark, path) != entry["files"]:
            raise ValueError(f"the files of {name} differ from version {manifest['version']}'s manifest")
        fields = StructType.fromJson(entry["schema"]).fields
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        key, n = entry["key"], entry["buckets"]
        spark.sql(f"drop table if exists {_name(path)}")
        spark.sql(f"create table {_name(path)} ({columns}) using parquet clustered by (`{key}`) sorted by (`{key}`) into {n} buckets location '{path}'")
        out[name] = spark.table(_name(path))
    return manifest["version"], out


def compare(before: DataFrame, after: DataFrame, key: str = "key") -> DataFrame:
    """As ``snapshot.diff_counts``: rows before and after, distinct keys new and gone.  Of
    two tables bucketed alike by the key nothing is shuffled but each task's one row."""
    each = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    both = each(before, "b").withColumnRenamed(key, "_b").join(each(after, "a").withColumnRenamed(key, "_a"), F.col("_b") == F.col("_a"), "full_outer")
    known = F.coalesce(F.col("_b").cast("string"), F.col("_a").cast("string"), F.lit("")) != ""
    return both.agg(
        F.coalesce(F.sum("b"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("rows_after"),
        F.count_if(known & F.col("b").isNull()).alias("new_keys"),
        F.count_if(known & F.col("a").isNull()).alias("removed_keys"),
    )


def prune(spark: SparkSession, base: str, keep: int = 2) -> list[str]:
    """Removes all but the latest ``keep`` versions by name, never the current one; their
    names."""
    fs, place = _fs(spark, base)
    manifest = _manifest(spark, base)
    versions = sorted(f.getPath().getName() for f in fs.listStatus(place) if f.isDirectory())
    gone = [v for v in versions[: max(0, len(versions) - keep)] if manifest is None or v != manifest["version"]]
    for v in gone:
        fs.delete(_fs(spark, f"{base}/{v}")[1], True)
    return gone
