"""Pieces shared by the training-data operators.

Scratch tables, text batches for Arrow functions, and vectorised hashing of
words.  Everything here is deterministic: the same text gives the same hash on
every worker and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources import scratch

#: A word of the corpus contracts: a run without the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Used only where the session names no shared folder and runs on one machine (tests).
LOCAL_SCRATCH = scratch.LOCAL
scratch_dir, scratch_path, scratch_scope = scratch.folder, scratch.new_path, scratch.scope
materialise, release, _written = scratch.written, scratch.release, scratch.made


def word_count(text: Column) -> Column:
    """Number of corpus words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id written as text: the folds of the contracts."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def sample_by_hash(df: DataFrame, key: str, bound: int, seed: int = 7) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of ``key`` (all rows when
    there are fewer).  The bound limits what a model is fitted on, never what it
    is applied to."""
    n = df.count()
    if n <= bound:
        return df
    span = 1 << 40
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(span)) < F.lit(int(span * bound / n)))


def text_tag(text: Column) -> Column:
    """16 bytes that name a text: the first half of its SHA-256."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def mark_possible(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: str, most_bits: int = 1 << 28) -> DataFrame:
    """Adds ``_may``: false for rows whose key is surely not among those of ``wanted``.

    A bitmap of hashed keys, sixteen bits a key but ``most_bits`` at most, is broadcast
    as a table of words.  What is let through by chance costs, but does no harm."""
    bits = min(most_bits, max(1 << 12, 1 << (16 * wanted.count()).bit_length()))
    slot = lambda k: F.pmod(F.xxhash64(k, F.lit(29)), F.lit(bits))
    mask = F.expr("bit_or(shiftleft(1L, cast(_slot % 63 as int)))")
    words = wanted.select(slot(F.col(wanted_key)).alias("_slot")).groupBy(F.expr("_slot div 63").alias("_word")).agg(mask.alias("_mask"))
    marked = rows.withColumn("_at", slot(key)).join(F.broadcast(words), F.expr("_at div 63") == F.col("_word"), "left")
    return marked.withColumn("_may", F.coalesce(F.expr("shiftright(_mask, cast(_at % 63 as int)) & 1L = 1L"), F.lit(False))).drop("_at", "_word", "_mask")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, settle=F.max, seed: int = 7) -> tuple[DataFrame, dict[int, int]]:
    """(label, text, doc_id) of about ``rows`` rows a class at most, and the number of
    labelled ids by class.

    Labels of an id that contradict one another are settled by ``settle``.  Ids are chosen
    by hash, then texts by hash where an id has many; equal rows count once, so the bound
    holds however often ids repeat."""
    known = labels.filter(F.col(label).isin(0, 1)).groupBy("doc_id").agg(settle(label).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    span = 1 << 40
    chance = lambda n: F.lit(int(span * min(1.0, rows / max(n, 1))))
    at = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(span))
    chosen = known.filter(at < F.when(F.col("label") == 1, chance(counts.get(1, 0))).otherwise(chance(counts.get(0, 0))))
    # the ids are bounded by about twice ``rows``, so the join may broadcast them
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("tag", F.md5(F.coalesce("text", F.lit(""))))
    once = materialise(found.groupBy("label", "doc_id", "tag").agg(F.first("text").alias("text")), "labelled")
    have = {r["label"]: r["n"] for r in once.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # ids of one row each give no more rows than ids; 1.5 leaves room for chance
    rate = lambda n: F.lit(int(span * min(1.0, 1.5 * rows / max(n, 1))))
    by_text = F.pmod(F.xxhash64("tag", F.lit(seed)), F.lit(span))
    bounded = once.filter(by_text < F.when(F.col("label") == 1, rate(have.get(1, 0))).otherwise(rate(have.get(0, 0))))
    return bounded.select("label", "text", "doc_id"), counts


#: Characters of texts that vectorised work takes at a time; arrays of words are many times as large.
AT_ONCE = 1 << 18


def slices(lengths: list[int], most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths add up to ``most`` or that hold one row."""
    lo = total = 0
    for i, n in enumerate(lengths):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)


# --- vectorised word hashing -------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 19)
        base = int(_MULT)
        inverse = pow(base, -1, 1 << 64)
        for k, b in enumerate((base, inverse)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            p = np.multiply.accumulate(p)
            if len(_powers) > k:
                _powers[k] = p
            else:
                _powers.append(p)
    return _powers[0], _powers[1]


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, in_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in a byte array."""
    inside = ~_BLANK[data] if in_word is None else in_word
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    if len(inside) and inside[-1]:
        edge = np.concatenate((edge, [len(inside)]))
    return edge[0::2], edge[1::2]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, independent of its place."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def join_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of texts, each followed by a line feed, and where each starts
    (one more entry than texts)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=offsets[1:])
    return np.frombuffer(b"\n".join(raw) + b"\n", np.uint8), offsets


def hash_text(text: str) -> int:
    """The hash that :func:`span_hash` gives for a whole text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return int(span_hash(data, np.array([0]), np.array([len(data)]))[0])
