"""Packing token ids into fixed rows by best-fit decreasing.

Texts are tokenised whole, closed by an end token and packed into rows of
``context`` ids: longest segments first, each into the fullest row that still
takes it, found in a segment tree over remaining capacities.  Documents longer
than a row are split into full rows and a rest, losslessly.  A packed row carries
its ids (padded with the end token), the positions, which start anew with each
segment, the cumulative segment lengths, and the document and token offset of each
segment.

Documents are dealt to shards by a hash of id and text, and packed in order of
these, so the rows are the same however the input is split.

Defined results: null and empty texts are a lone end token; repeated rows are
packed as often as they occur; an empty table gives no rows; extra columns are
ignored.

Scale: shards hold about ``shard_chars`` characters, and sets of ``set_tokens``
tokens at most are packed together, which bounds memory; a set wastes less than a
row or two.  Texts are shuffled once, by shard.  Rows that repeat an id and a text
are found by their digests before: up to ``FEW`` of these are broadcast, beyond that
they are joined by a shuffle of the rows that a bitmap lets through.  They collapse by a partial aggregate and are
dealt to many shards again, so one row repeated a billion times is no hot key.  The
vocabulary file, of fixed size, is broadcast.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mark_possible, materialise

CONTEXT, SET_TOKENS, SHARD_CHARS = 2048, 1 << 22, 1 << 22
#: Shards up to which each has about a task of its own, and shards of a task beyond.
MOST_SINGLE, SHARDS_A_TASK = 1000, 64
#: Repeated rows (an id and a digest each) that are broadcast; more are joined by a shuffle.
FEW = 200_000
SCHEMA = (
    "shard long, bin int, n_tokens int, n_segments int, ids binary, positions binary, cu_seqlens array<int>, "
    "doc_ids array<bigint>, doc_offsets array<int>"
)


def load_vocabulary(path: str | None = None, pattern: str | None = None) -> dict:
    """A byte-level BPE vocabulary as ranks; the end token is the first free id."""
    if path is None or pattern is None:
        import public_tokenizers as public

        path, pattern = path or public.path("byte_bpe_50k.tiktoken"), pattern or public.PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return {"ranks": ranks, "pattern": pattern, "end": max(ranks.values()) + 1}


_encoders: dict[int, object] = {}


class Tokenizer:
    def __init__(self, vocabulary: dict) -> None:
        import tiktoken

        key = hash((len(vocabulary["ranks"]), vocabulary["pattern"], vocabulary["end"]))
        if key not in _encoders:
            _encoders[key] = tiktoken.Encoding("own", pat_str=vocabulary["pattern"], mergeable_ranks=vocabulary["ranks"], special_tokens={})
        self.encoding, self.end = _encoders[key], vocabulary["end"]
        self.kind = np.dtype("<u2" if self.end < 1 << 16 else "<u4")

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text and the end token."""
        parts = [np.asarray(self.encoding.encode_to_numpy(p, disallowed_special=()), self.kind) for p in cut(text or "")]
        return np.concatenate([*parts, np.array([self.end], self.kind)])

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode([int(i) for i in ids if i != self.end])


def cut(text: str, most: int = 1 << 20) -> Iterator[str]:
    """Pieces of a long text that tokenise as the whole does: each begins at a space
    between a letter and a letter, where a pre-token begins in any case."""
    lo = 0
    while len(text) - lo > most:
        hi = text.find(" ", lo + most)
        while hi >= 0 and not (text[hi - 1].isalpha() and text[hi + 1 : hi + 2].isalpha()):
            hi = text.find(" ", hi + 1)
        if hi < 0:
            break
        yield text[lo:hi]
        lo = hi
    if lo < len(text):
        yield text[lo:]


class Capacities:
    """Open rows by remaining capacity; a segment tree finds the least capacity
    that is large enough."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << max(1, most.bit_length())
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, capacity: int, step: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += step
            i >>= 1

    def put(self, row: int, capacity: int) -> None:
        if capacity:
            self.rows[capacity].append(row)
            self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least capacity of at least ``need``, and that capacity."""
        i = need + self.leaves
        if not self.count[i]:
            # up to the first right sibling that holds rows, then down its left side
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._add(capacity, -1)
        return self.rows[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], context: int) -> list[list[int]]:
    """Rows of segment numbers, none longer than ``context`` in sum."""
    rows: list[list[int]] = []
    open_rows = Capacities(context)
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = open_rows.take(lengths[k])
        row, capacity = found if found else (len(rows), context)
        if not found:
            rows.append([])
        rows[row].append(k)
        open_rows.put(row, capacity - lengths[k])
    return rows


def shards(docs: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(shard, doc_id, tag, copies, text) of ``docs``, sorted by the first three within
    partitions that hold whole shards."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), F.md5(F.coalesce("text", F.lit(""))).alias("tag"))
    heads = rows.groupBy("doc_id", "tag").agg(F.count("*").alias("copies"), F.max(F.length("text")).alias("chars"))
    heads = materialise(heads, "heads")
    total = heads.agg(F.sum(F.col("copies") * (F.coalesce("chars", F.lit(0)) + 1))).first()[0] or 0
    count = max(1, -(-total // shard_chars))
    # repeated rows become one with its number of copies, dealt in chunks of a shard's size
    again = heads.filter("copies > 1").select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.col("copies").alias("_copies"))
    alone = None
    if again.count() <= FEW:
        again = F.broadcast(again)
    else:  # rows that surely do not repeat are no part of the join
        rows = mark_possible(rows, F.xxhash64("doc_id", "tag"), again.select(F.xxhash64("_id", "_tag").alias("_key")), "_key")
        alone, rows = rows.filter("not _may").drop("_may"), rows.filter("_may").drop("_may")
    joined = rows.join(again, rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["tag"] == F.col("_tag")), "left").drop("_id", "_tag")
    unlike = joined.filter("_copies is null").drop("_copies")
    unlike = unlike if alone is None else unlike.unionByName(alone)
    single = unlike.select("doc_id", "tag", F.lit(0).cast("long").alias("chunk"), F.lit(1).cast("long").alias("copies"), "text")
    most = F.greatest(F.lit(1), F.floor(F.lit(shard_chars) / (F.coalesce(F.length("text"), F.lit(0)) + 1))).cast("long")
    once = joined.filter("_copies is not null").groupBy("doc_id", "tag", "_copies").agg(F.first("text").alias("text")).withColumn("most", most)
    chunks = once.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / F.col("most")))))
    chunks = chunks.select("doc_id", "tag", "chunk", F.least("most", F.col("_copies") - F.col("chunk") * F.col("most")).alias("copies"), "text")
    shard = F.pmod(F.xxhash64("doc_id", "tag", "chunk", F.lit(31)), F.lit(count)).alias("shard")
    dealt = single.unionByName(chunks).select(shard, "doc_id", "tag", "chunk", "copies", "text")
    # tasks in proportion to the shards, so that what one of them reads does not grow with the table
    tasks = min(count, max(MOST_SINGLE, count // SHARDS_A_TASK))
    return dealt.repartition(tasks, "shard").sortWithinPartitions("shard", "doc_id", "tag", "chunk")


def pack(docs: DataFrame, vocabulary: dict, *, context: int = CONTEXT, set_tokens: int = SET_TOKENS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Packed rows (:data:`SCHEMA`) of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    place = np.dtype("<u2" if context <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(shared.value)
        shard, bins = -1, 0
        segments: list[tuple[int | None, int, np.ndarray]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal bins, held
            rows = best_fit_decreasing([len(s[2]) for s in segments], context)
            for lo in range(0, len(rows), 256):
                out: dict[str, list] = {k: [] for k in _ARROW.names}
                for row in rows[lo : lo + 256]:
                    own = [segments[k] for k in row]
                    sizes = [len(s[2]) for s in own]
                    ids, positions = np.full(context, tokenizer.end, tokenizer.kind), np.zeros(context, place)
                    ids[: sum(sizes)] = np.concatenate([s[2] for s in own])
                    positions[: sum(sizes)] = np.concatenate([np.arange(n, dtype=place) for n in sizes])
                    values = (shard, bins, sum(sizes), len(own), ids.tobytes(), positions.tobytes(), np.concatenate(([0], np.cumsum(sizes))).tolist(), [s[0] for s in own], [s[1] for s in own])
                    for k, v in zip(out, values, strict=True):
                        out[k].append(v)
                    bins += 1
                yield pa.RecordBatch.from_pydict(out, schema=_ARROW)
            segments.clear()
            held = 0

        for batch in batches:
            for of, doc_id, copies, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if of != shard:
                    if segments:
                        yield from flush()
                    shard, bins = of, 0
                ids = tokenizer.encode(text.as_py())
                for _ in range(copies):
                    for at in range(0, len(ids), context):
                        segments.append((doc_id, at, ids[at : at + context]))
                    held += len(ids)
                    if held >= set_tokens:
                        yield from flush()
        if segments:
            yield from flush()

    return shards(docs, shard_chars).select("shard", "doc_id", "copies", "text").mapInArrow(run, SCHEMA)


_ARROW = pa.schema(
    [("shard", pa.int64()), ("bin", pa.int32()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("ids", pa.binary()), ("positions", pa.binary())]
    + [("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int32()))]
)


def segments(packed: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, doc_offset, ids) of every segment of packed rows: what
    :func:`pack` put together, taken apart again.  ``width``: bytes of an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[tuple] = []
            for ids, lengths, docs, offsets in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                for a, b, d, o in zip(lengths[:-1], lengths[1:], docs, offsets, strict=True):
                    got.append((d, o, ids[a * width : b * width]))
            columns = list(zip(*got, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["doc_id", "doc_offset", "ids"])

    return packed.select("ids", "cu_seqlens", "doc_ids", "doc_offsets").mapInArrow(run, "doc_id long, doc_offset int, ids binary")
