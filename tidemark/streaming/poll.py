"""Polling as a stream: new files of a landing folder, once, then stop; and what they say
that differs from what was there before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def poll(spark: SparkSession, folder: str, schema: StructType, checkpoint: str, handle: Callable[[DataFrame, int], None], files_per_batch: int = 1000) -> None:
    """Hands each batch of files not seen before to ``handle``; the checkpoint
    remembers them across runs, so a run after a crash goes on where it stopped."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """(path, hash, changed) of binary files: changed when the content's SHA-256 is
    not the known one, or none is known.  ``known``: path, hash."""
    now = files.select("path", F.sha2("content", 256).alias("hash"))
    old = known.select(F.col("path").alias("old_path"), F.col("hash").alias("old_hash"))
    return now.join(old, F.col("path") == F.col("old_path"), "left").select("path", "hash", F.coalesce(F.col("hash") != F.col("old_hash"), F.lit(True)).alias("changed"))


#: What a landing folder holds, and what is handed over of it: the versions that changed something.
LANDED = "path string, moment timestamp, content binary"
CHANGES = "path string, moment timestamp, hash string, before string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _LastHash(StatefulProcessor):
    """Keeps the hash of a path's last version; passes on the versions that differ from the
    one before them.  Versions not later than the last one known are old news."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string, moment timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, since = self.last.get() if self.last.exists() else (None, None)
        out: list[tuple] = []
        for moment, digest in sorted({(m, h) for part in rows for m, h in zip(part["moment"], part["hash"], strict=True)}):
            if since is not None and moment <= pd.Timestamp(since, tz=moment.tz):
                continue
            if digest != known:
                out.append((key[0], moment, digest, known))
            known, since = digest, moment
        if since is not None:
            self.last.update((known, since.to_pydatetime() if isinstance(since, pd.Timestamp) else since))
        yield pd.DataFrame(out, columns=["path", "moment", "hash", "before"])

    def close(self) -> None:
        return


def poll_changes(spark: SparkSession, folder: str, checkpoint: str, out: str, files_per_batch: int = 1000) -> DataFrame:
    """Takes in what has landed under ``folder`` since the last call (:data:`LANDED`, as
    Parquet) and gives all changes so far (:data:`CHANGES` and ``batch``).

    The last hash of each path is the stream's state, under ``checkpoint``.  A batch is
    handed over as a folder named by its number, written anew whole if a crash comes
    between, so each change is there once.  A null content is a version too: of a path
    that is gone.  Rows without path or moment are left out."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, _STORE)
    try:
        stream = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
        versions = stream.filter("path is not null and moment is not null").select("path", "moment", F.coalesce(F.sha2("content", 256), F.lit("")).alias("hash"))
        changes = versions.groupBy("path").transformWithStateInPandas(_LastHash(), CHANGES, "Append", "None")
        hand_over = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        changes.writeStream.foreachBatch(hand_over).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)
    return spark.read.schema(f"{CHANGES}, batch int").option("basePath", out).parquet(out)
