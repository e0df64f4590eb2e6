"""Written intermediates: they cut a plan's lineage, are made once however often they are
used, and survive the loss of any executor.  Those that no plan reads again are released,
one by one or all that a piece of work has made (:func:`scope`); the rest goes when the
driver ends."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and runs on one machine.
LOCAL = "/tmp/checkpoints/tidemark"

#: Paths made and not released, with their sessions.
made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).  A cluster
    must name one; a local session may do without."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return LOCAL


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder; what is there goes when the driver ends."""
    path = f"{folder(spark)}/tidemark-{uuid.uuid4().hex}-{name}"
    made.append((spark, path))
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Removes written tables that no plan will read again."""
    for t in tables:
        if path := getattr(t, "_tidemark_path", None):
            delete(t.sparkSession, path)


@contextmanager
def scope(keep: Iterable[DataFrame]) -> Iterator[None]:
    """Removes, at its end, the tables written inside but for those that were put in
    ``keep``.  What is kept must itself be written: a plan over the others is lost."""
    before = {path for _, path in made}
    yield
    kept = {getattr(t, "_tidemark_path", None) for t in keep}
    for spark, path in list(made):
        if path not in before and path not in kept:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    made[:] = [x for x in made if x[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in list(made):
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return
