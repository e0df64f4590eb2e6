"""Reading addresses that a table holds: a table in, a table out, nothing on the driver.

Addresses are dealt by a key of two levels, host and slot, so a host with most of the
addresses is as many tasks as it has slots, and its slots share its budget of requests.
A fetch never fails a task.  Tasks may be repeated, so what is fetched is written once
and read from there (:func:`once`)."""

from __future__ import annotations

import heapq
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.sources import web
from tidemark.sources.files import path_exists

#: How pages and notices are read for their lots, and for their dates.
FOR_LOTS = web.Policy(timeout=12, most=20_000_000, attempts=1, most_error=500_000)
FOR_DATES = web.Policy(timeout=8, most=5_000_000, attempts=3, most_error=200_000)
#: Bytes of answers that a task holds before it passes them on.
HELD = 1 << 24


@dataclass(frozen=True)
class Budget:
    """Requests a second that a host gets (0: as fast as it answers), and its slots."""

    rate: float = 0.0
    slots: int = 16

    def first(self, slot: int) -> float:
        """Seconds until a slot's first request: slots begin one after another."""
        return slot / self.rate if self.rate else 0.0

    def pause(self) -> float:
        """Seconds between a slot's requests; all slots together keep to the rate."""
        return self.slots / self.rate if self.rate else 0.0


def slotted(wanted: DataFrame, slots: int, url: str = "url") -> DataFrame:
    """(url, host, slot) of the distinct addresses of a table; empty ones are left out."""
    once = wanted.select(F.col(url).alias("url")).filter("url <> ''").distinct()
    return once.select("url", U.authority("url").alias("host"), F.pmod(F.xxhash64("url"), F.lit(slots)).cast("int").alias("slot"))


def paced(rows: Iterable[tuple[str, str, int]], budget: Budget, read: Callable[[str], Iterable[tuple]], clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple]:
    """What ``read`` gives for each address (url, host, slot), the slot that is due first
    going first; each request of a slot is followed by its pause."""
    waiting: dict[tuple[str, int], deque[str]] = {}
    for url, host, slot in rows:
        waiting.setdefault((host, slot), deque()).append(url)
    began = clock()
    due = [(began + budget.first(slot), host, slot) for host, slot in waiting]
    heapq.heapify(due)
    while due:
        at, host, slot = heapq.heappop(due)
        if (left := at - clock()) > 0:
            sleep(left)
        requests = 0
        for row in read(waiting[host, slot].popleft()):
            requests += 1
            yield row
        if waiting[host, slot]:
            heapq.heappush(due, (max(at, clock()) + budget.pause() * max(1, requests), host, slot))


def _read_table(wanted: DataFrame, budget: Budget, read: Callable[[str], Iterable[tuple]], schema: str, kinds: pa.Schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for row in paced(rows, budget, read):
                held.append(row)
                size += sum(len(v) for v in row if isinstance(v, (bytes, str)))
                if size >= HELD:
                    yield _batch(held, kinds)
                    held, size = [], 0
        if held:
            yield _batch(held, kinds)

    # a fixed number of tasks: by their bytes, addresses would be merged into a few
    spark = wanted.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return slotted(wanted, budget.slots).repartition(tasks, "host", "slot").sortWithinPartitions(F.xxhash64("url", F.lit(3))).mapInArrow(run, schema)


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)


_ANSWERS = pa.schema([("url", pa.string()), ("status", pa.int32()), ("body", pa.binary()), ("content_type", pa.string()), ("final_url", pa.string())])
_OFFERS = pa.schema([("url", pa.string()), ("page", pa.int32()), ("status", pa.int32()), ("body", pa.string())])


def fetch_table(wanted: DataFrame, policy: web.Policy = FOR_LOTS, budget: Budget = Budget(), get: Callable[[str, web.Policy], web.Fetched] = web.fetch) -> DataFrame:
    """Answers (:data:`web.SCHEMA`) of the distinct addresses of ``wanted`` (url)."""
    return _read_table(wanted, budget, lambda url: [get(url, policy).row()], web.SCHEMA, _ANSWERS)


def fetch_offers(wanted: DataFrame, policy: web.Policy = FOR_LOTS, budget: Budget = Budget(), get: Callable[[str, web.Policy], web.Fetched] = web.fetch) -> DataFrame:
    """Pages of the offer interface (:data:`web.OFFERS`) for the events behind the
    addresses of ``wanted`` (url), each event's up to the last that is needed."""
    read = lambda url: web.offer_pages(url, U.plain_event_id(url), lambda address: get(address, policy))
    return _read_table(wanted, budget, read, web.OFFERS, _OFFERS)


@dataclass(frozen=True)
class Live:
    """Where answers come from: the network, by ``get``."""

    policy: web.Policy = FOR_LOTS
    budget: Budget = Budget()
    get: Callable[[str, web.Policy], web.Fetched] = web.fetch

    def answers(self, wanted: DataFrame) -> DataFrame:
        return fetch_table(wanted, self.policy, self.budget, self.get)

    def offers(self, wanted: DataFrame) -> DataFrame:
        return fetch_offers(wanted, self.policy, self.budget, self.get)


@dataclass(frozen=True)
class Stored:
    """The same from tables of answers and of offer pages; what they lack is a fault."""

    fetched: DataFrame
    paged: DataFrame | None = None

    def answers(self, wanted: DataFrame) -> DataFrame:
        have = self.fetched.dropDuplicates(["url"]).withColumnRenamed("url", "_url")
        got = wanted.select("url").filter("url <> ''").distinct().join(have, F.col("url") == F.col("_url"), "left")
        return got.select("url", F.coalesce("status", F.lit(0)).alias("status"), "body", "content_type", "final_url")

    def offers(self, wanted: DataFrame) -> DataFrame:
        if self.paged is None:
            return wanted.sparkSession.createDataFrame([], web.OFFERS)
        return self.paged.join(wanted.select("url").distinct(), "url", "left_semi").select("url", "page", "status", "body")


def once(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path``, or what an earlier run has written there whole."""
    spark = df.sparkSession
    if not path_exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
