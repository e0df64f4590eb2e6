"""Benchmark decontamination by latent semantic retrieval.

Benchmark items, cut into query passages of at most ``QUERY_WORDS`` words, are
searched in the passages (windows of ``WINDOW`` words, half overlapping) of every
document.  Passages are TF-IDF vectors over the words of the queries.  A randomised
SVD of the matrix whose rows are passages, those of all documents and the query passages
themselves, each side with half of the weight, is made from the products of its columns,
summed over partitions; its strongest directions, as many as hold ``ENERGY`` of the queries but
``RANK`` at most, are the latent space.  Cosines in it pick candidates, which are
checked on the words themselves: the longest common subsequence must cover most of the
query, or half of it with its answer (for paraphrases); the query's rare words must be
among what is found.

Words are lower-cased runs of letters and digits.  Document frequencies count all
passages of all documents.  Words outside the queries weigh as the mean of theirs, so
a cosine does not fall as the table grows.  Common words weigh only in queries that
have few others; a window that holds most of a query's weight, by its latent vector,
is a candidate whatever else is in it.

Defined results: null and empty texts match nothing; an item of fewer than
``LEAST_WORDS`` words, which any text may hold by chance, is found where a line of a
text says exactly that, an item without words nowhere; without items, or without
documents, the result is empty; repeated rows each give their matches, a row one match
an item, its best; repeated items count once an id, items that differ in their answers
count each; extra columns are ignored; an ``answer`` column of the benchmark, if there
is one, names the answers, else the last words of an item stand for it; an answer of
any length must be found whole, in its order.

Scale: the words of the queries are counted in one pass over the documents for every
``MOST_WORDS`` of them; then the queries are handled in indexes of ``QUERIES`` passages,
``INDEXES`` of them at most a round of two passes over the documents: one sums the products
of words that share a passage, shuffled as partial sums by pair, one searches.  A
passage is bounded in words, so vocabulary, basis and vectors are bounded however long
items are, a benchmark of any size is a number of scans, and what is broadcast is
bounded.  No text is shuffled; a scan is a map whose output is the matches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, mix64, release, slices, word_spans

WINDOW, QUERY_WORDS, LEAST_WORDS = 32, 64, 4
QUERIES, INDEXES = 256, 8
#: Passages of an item that are searched in one scan.
STRETCH = 512
#: Latent directions at most, the share of the queries that they need not exceed, and
#: further directions that the iteration carries along.
RANK, ENERGY, OVERSAMPLE = 192, 0.95, 16
#: Words of queries that are counted in one pass.
MOST_WORDS = 1 << 22
#: Pairs of words that a task holds of an index, tasks for their products with a basis,
#: and rounds of power iteration.
PAIRS, PARTS, POWER = 1 << 20, 16, 2
#: Ranges of first terms by which the sums of an index's pairs are shuffled.
BANDS = 64
#: Cosine that makes a candidate; shares of a query that the subsequence and the
#: rare words must reach; the same with an answer found.
COSINE, COVER, RARE, COVER_ANSWER, RARE_ANSWER = 0.3, 0.7, 0.6, 0.5, 0.5
#: Words of more than this share of passages are no evidence, unless they leave less
#: than this share of a query's words.
COMMON, EVIDENCE = 0.05, 0.5
#: Share of a query in a window that makes a candidate whatever else is there.
CONTAINED = 0.5
FOUND = "item_id long, coverage double, rare double, cosine double, answer boolean, start_word int"
MATCHES = f"doc_id long, {FOUND}"

_tables: dict[str, np.ndarray] = {}


def _table() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        import unicodedata

        inside = np.zeros(0x110000, bool)
        for cp in range(0x110000):
            if unicodedata.category(chr(cp))[0] in "LNM":
                inside[cp] = True
        _tables.update(inside=inside, value=mix64(np.arange(0x110000, dtype=np.uint64) + np.uint64(77)))
    return _tables["inside"], _tables["value"]


_base = int(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        for name, b in (("up", _base), ("down", pow(_base, -1, 1 << 64))):
            p = np.full(max(n, 1 << 19), b, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts one after another, and where each text's begin
    (one more entry than texts)."""
    inside, value = _table()
    low = [(t or "").lower() for t in texts]
    cp = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts, ends = word_spans(cp, inside[cp])
    up, down = _power(len(cp) + 1)
    total = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(value[cp] * up[: len(cp)], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    offsets = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in low], out=offsets[1:])
    return hashes, np.searchsorted(starts, offsets)


def query_passages(items: list[tuple], stretch: int = STRETCH) -> list[dict]:
    """Query passages of (item_id, text, answer or None); ``stretch`` of an item's go to
    one scan."""
    out = []
    for item, text, answer in items:
        words = word_hashes([text])[0]
        if not len(words):
            continue
        parts = -(-len(words) // QUERY_WORDS)
        edges = [len(words) * k // parts for k in range(parts + 1)]
        own = word_hashes([answer])[0] if answer else words[:0]
        if not len(own):
            own = words[-min(QUERY_WORDS, max(3, len(words) // parts // 5)) :]
        out += [{"item": item, "stretch": k // stretch, "words": words[a:b], "answer": own} for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    return out


def passages_of(benchmark: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(item_id, stretch, words, answer), the latter two as binary hashes, of each query
    passage."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = query_passages([item], stretch)
                numbers = [pa.array([q[k] for q in got], pa.int64()) for k in ("item", "stretch")]
                yield pa.RecordBatch.from_arrays([*numbers, *[pa.array([q[k].tobytes() for q in got], pa.binary()) for k in ("words", "answer")]], names=["item_id", "stretch", "words", "answer"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer")).filter("text is not null")
    cut_up = items.mapInArrow(cut, "item_id long, stretch long, words binary, answer binary")
    return materialise(cut_up.groupBy("item_id", "words", "answer").agg(F.min("stretch").alias("stretch")), "queries")


def lcs(query: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel columns."""
    masks: dict[int, int] = {}
    for i, w in enumerate(query.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(query)) - 1
    row = full
    for w in region.tolist():
        if m := masks.get(w):
            both = row & m
            row = ((row + both) | (row - both)) & full
    return len(query) - row.bit_count()


def filled(vocabulary: np.ndarray) -> np.ndarray:
    """Whether a word of a vocabulary begins with each pattern of some bits; few others do."""
    bits = min(24, max(12, 4 + len(vocabulary).bit_length()))
    out = np.zeros(1 << bits, bool)
    out[vocabulary >> np.uint64(64 - bits)] = True
    return out


def held_words(vocabulary: np.ndarray, begun: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that a sorted vocabulary (and what :func:`filled` gives) holds, and their numbers in it."""
    some = np.flatnonzero(begun[hashes >> np.uint64(65 - len(begun).bit_length())])
    at = np.minimum(np.searchsorted(vocabulary, hashes[some]), len(vocabulary) - 1)
    hit = vocabulary[at] == hashes[some]
    return some[hit], at[hit]


class Index:
    """A part of the queries: vocabulary with weights, basis, latent queries."""

    def __init__(self, queries: list[dict]) -> None:
        self.queries = queries
        self.words = [q["words"].tolist() for q in queries]
        self.vocabulary = np.unique(np.concatenate([q["words"] for q in queries]))
        self.begun = filled(self.vocabulary)
        self.idf = np.zeros(len(self.vocabulary), np.float32)
        #: Weight of words outside the vocabulary.
        self.rarest = 1.0
        self.basis = self.latent = None

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words in the vocabulary, -1 for others."""
        out = np.full(len(hashes), -1)
        place, term = held_words(self.vocabulary, self.begun, hashes)
        out[place] = term
        return out

    def weigh(self, df: np.ndarray, passages: int) -> None:
        n = max(passages, 2)
        full = np.log((n + 1) / (df + 1)).astype(np.float32)
        self.idf = np.where(df > max(COMMON * n, 1), np.float32(0), full)
        evidence = self.idf > 0
        for q in self.queries:
            term = self.terms(q["words"])
            if evidence[term].mean() < EVIDENCE:  # (nearly) nothing but common words: weigh them all
                self.idf[term] = full[term] + np.float32(0.01)
        self.common = self.idf == 0
        self.rarest = float(self.idf[~self.common].mean())

    def query_matrix(self) -> np.ndarray:
        a = np.zeros((len(self.queries), len(self.vocabulary)), np.float32)
        for k, q in enumerate(self.queries):
            np.add.at(a[k], self.terms(q["words"]), 1)
        a *= self.idf
        self.norms = np.maximum(np.linalg.norm(a, axis=1), 1e-9)
        return a / self.norms[:, None]

    def project(self, directions: np.ndarray) -> None:
        """Puts queries and words into the space of orthonormal directions."""
        queries = self.query_matrix()
        self.basis = np.asfortranarray(directions, np.float32)
        latent = queries @ self.basis
        self.energy = np.maximum(np.linalg.norm(latent, axis=1), 1e-3)
        self.latent = (latent / self.energy[:, None]).astype(np.float32)
        #: Product with a query's direction at which a window holds as much of it.
        self.whole = (CONTAINED * self.norms * self.energy).astype(np.float32)
        self.weighted = (self.idf[:, None] * self.basis).astype(np.float32)
        # what one word of a window adds to its product with a query at most, as such and as a share of the query
        self.peak, self.share = (np.empty(len(self.vocabulary)) for _ in range(2))
        for lo in range(0, len(self.vocabulary), 8192):
            each = self.weighted[lo : lo + 8192] @ self.latent.T
            self.peak[lo : lo + 8192], self.share[lo : lo + 8192] = each.max(axis=1), (each / self.whole).max(axis=1)


def blocks_of(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For words of texts that begin at ``first``: the block of each word (blocks of
    ``size`` words within a text) and the first block of each text."""
    counts = np.diff(first)
    of_text = -(-counts // size)
    start = np.concatenate(([0], np.cumsum(of_text)))
    inner = np.arange(first[-1]) - np.repeat(first[:-1], counts)
    return np.repeat(start[:-1], counts) + inner // size, start


def _count(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Passages that hold each word of a sorted vocabulary (word, n); the null word has
    the number of passages."""
    counts = np.zeros(len(vocabulary), np.int64)
    passages, begun = 0, filled(vocabulary)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for lo, hi in slices([len(t or "") for t in texts]):
            hashes, first = word_hashes(texts[lo:hi])
            block, start = blocks_of(first, WINDOW)
            passages += int(start[-1])
            place, term = held_words(vocabulary, begun, hashes)
            seen = np.unique(block[place] * len(vocabulary) + term)
            np.add.at(counts, seen % len(vocabulary), 1)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array([*vocabulary[some].view(np.int64).tolist(), None], pa.int64()), pa.array(np.append(counts[some], passages))], names=["word", "n"])


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in order and the sums of their values."""
    pairs, values = (np.concatenate(x) for x in zip(*runs, strict=True))
    known, at = np.unique(pairs, return_inverse=True)
    return known, np.bincount(at, values)


RUNS = "part int, band int, pairs binary, sums binary"


def _runs(part: int, runs: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [(part, band, pairs.tobytes(), values.tobytes()) for band, pairs, values in runs]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*columns, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "band", "pairs", "sums"])


def _add_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, pair, value) of runs, those of a band merged; a band has a bounded number of pairs."""
    held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for part, band, pairs, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs = held.setdefault((part, band), [])
            runs.append((np.frombuffer(pairs, np.int64), np.frombuffer(values)))
            if len(runs) > 1 and sum(len(p) for p, _ in runs[1:]) > max(PAIRS // BANDS, len(runs[0][0])):
                runs[:] = [_merged(runs)]
    for (part, _), runs in held.items():
        pairs, values = _merged(runs)
        for lo in range(0, len(pairs), 1 << 16):
            own = pairs[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part), pa.int32()), pa.array(own), pa.array(values[lo : lo + (1 << 16)])], names=["part", "pair", "value"])


def _pairs(batches: Iterator[pa.RecordBatch], indexes: list[Index]) -> Iterator[pa.RecordBatch]:
    """Sums of A^T A over passages, for each index (part) by pair of terms, the lesser first;
    pair -1 counts the passages with terms.  Rows are sorted runs of pairs whose first terms
    share a band.  What is in hand is bounded by ``PAIRS``."""
    held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in indexes]

    def out(k: int) -> Iterator[pa.RecordBatch]:
        pairs, values = _merged(held[k])
        held[k].clear()
        size = len(indexes[k].vocabulary)
        edges = np.searchsorted(pairs, [-1, *(size * (size * b // BANDS) for b in range(1, BANDS)), size * size])
        yield _runs(k, [(b, pairs[lo:hi], values[lo:hi]) for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if lo < hi])

    for batch in batches:
        texts = batch.column(0).to_pylist()
        for lo, hi in slices([len(t or "") for t in texts]):
            hashes, first = word_hashes(texts[lo:hi])
            block, _ = blocks_of(first, WINDOW)
            for k, index in enumerate(indexes):
                use, term = held_words(index.vocabulary, index.begun, hashes)
                rare = ~index.common[term]
                use, term = use[rare], term[rare]
                if not len(use):
                    continue
                own, size = block[use], len(index.vocabulary)
                row = np.cumsum(np.diff(own, prepend=own[0]) > 0)  # blocks ascend
                norm = np.bincount(row, index.idf[term].astype(np.float64) ** 2)
                cell, often = np.unique(row * size + term, return_counts=True)
                row, term = cell // size, cell % size
                weight = often * index.idf[term] / np.sqrt(np.maximum(norm[row], 1e-9))
                # each cell of a passage with itself and those behind it
                reach = np.searchsorted(row, row, side="right") - np.arange(len(row))
                left = np.repeat(np.arange(len(row)), reach)
                right = left + np.arange(len(left)) - np.repeat(np.cumsum(reach) - reach, reach)
                held[k].append((np.append(term[left] * size + term[right], -1), np.append(weight[left] * weight[right], len(norm))))
                if sum(len(p) for p, _ in held[k]) > PAIRS:
                    held[k][:] = [_merged(held[k])]
                    if len(held[k][0][0]) > PAIRS // 2:
                        yield from out(k)
    for k in range(len(indexes)):
        if held[k]:
            yield from out(k)


def _add_rows(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds rows to those of ``total`` at the places ``at``."""
    if len(at):
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        total[at[order][first]] += np.add.reduceat(rows[order], first, axis=0)


def _times(batches: Iterator[pa.RecordBatch], bases: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(A^T A) Q of a part of the pairs and the number of passages, for each index as one binary."""
    sums, rows = [np.zeros(b.shape) for b in bases], np.zeros(len(bases))
    for batch in batches:
        part, pair, value = (batch.column(k).to_numpy() for k in range(3))
        for k, (basis, total) in enumerate(zip(bases, sums, strict=True)):
            rows[k] += value[(part == k) & (pair < 0)].sum()
            own = np.flatnonzero((part == k) & (pair >= 0))
            for lo in range(0, len(own), 4096):  # products of pairs are as wide as the basis
                some = own[lo : lo + 4096]
                i, j, v = pair[some] // len(basis), pair[some] % len(basis), value[some, None]
                _add_rows(total, i, v * basis[j])
                _add_rows(total, j[i != j], (v * basis[i])[i != j])
    yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([np.append(s, n).tobytes() for s, n in zip(sums, rows, strict=True)], pa.binary())], names=["part", "sum"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            one = np.frombuffer(raw.as_py())
            totals[part] = totals[part] + one if part in totals else one.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["part", "sum"])


def count_words(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(word, n) of passages of ``docs`` that hold each of a sorted vocabulary's words;
    the null word counts all passages."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return docs.select("text").mapInArrow(lambda it: _count(it, shared.value), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def weigh(indexes: list[Index], counted: list[tuple[int | None, int]]) -> None:
    """Weights of the indexes' words from what :func:`count_words` gives."""
    passages = next((n for w, n in counted if w is None), 0)
    known = sorted((w, n) for w, n in counted if w is not None)
    words, n = np.array([w for w, _ in known], np.int64).view(np.uint64), np.array([n for _, n in known], np.int64)
    order = np.argsort(words)
    words, n = np.append(words[order], 0), np.append(n[order], 0)
    for index in indexes:
        at = np.searchsorted(words[:-1], index.vocabulary)
        index.weigh(np.where(words[at] == index.vocabulary, n[at], 0), passages)


def fit(docs: DataFrame, indexes: list[Index]) -> None:
    """Weights and bases from all passages of ``docs``."""
    weigh(indexes, [tuple(r) for r in count_words(docs, np.unique(np.concatenate([i.vocabulary for i in indexes]))).collect()])
    fit_bases(docs, indexes)


def products(docs: DataFrame, indexes: list[Index]) -> DataFrame:
    """(part, pair, value): what :func:`_pairs` sums, over all passages of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(indexes)
    pairs = docs.select("text").mapInArrow(lambda it: _pairs(it, shared.value), RUNS)
    return materialise(pairs.repartition(BANDS, "part", "band").mapInArrow(_add_runs, "part int, pair long, value double"), "products")


def fit_bases(docs: DataFrame, indexes: list[Index], seed: int = 17) -> None:
    """The latent space of each index, by power iteration over the products of words in
    all passages, summed once, and the index's queries."""
    spark = docs.sparkSession
    summed = products(docs, indexes)
    bases = []
    for index in indexes:
        rank = min(RANK + OVERSAMPLE, len(index.vocabulary))
        bases.append(np.linalg.qr(np.random.default_rng(seed).standard_normal((len(index.vocabulary), rank)))[0])
    for _ in range(POWER):
        state = spark.sparkContext.broadcast(bases)
        parts = summed.coalesce(PARTS).mapInArrow(lambda it, s=state: _times(it, s.value), "part int, sum binary")
        # two steps, so that no task and not the driver meets a matrix of every partition
        for width in (int(PARTS**0.5), 1):
            parts = parts.repartition(width).mapInArrow(_add_up, "part int, sum binary")
        got = {r["part"]: np.frombuffer(r["sum"]) for r in parts.collect()}
        for k, (index, basis) in enumerate(zip(indexes, bases, strict=True)):
            queries = index.query_matrix().astype(np.float64)
            corpus = got[k][:-1].reshape(basis.shape) if k in got else np.zeros(basis.shape)
            rows = got[k][-1] if k in got else 0.0
            # rows have length 1, so their number is the weight of a side
            image = corpus + (rows / len(queries) if rows else 1.0) * (queries.T @ (queries @ basis))
            bases[k] = np.linalg.svd(image, full_matrices=False)[0]
        state.unpersist()
    release(summed)
    for index, basis in zip(indexes, bases, strict=True):
        held = np.cumsum(((index.query_matrix() @ basis) ** 2).sum(axis=0))
        index.project(basis[:, : min(RANK, 1 + int(np.searchsorted(held, ENERGY * len(index.queries))))])


def candidates(index: Index, hashes: np.ndarray, first: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word in the text, query, cosine) of windows near a query."""
    half = WINDOW // 2
    block, start = blocks_of(first, half)
    place, term = held_words(index.vocabulary, index.begun, hashes)
    known, weight = block[place], index.idf[term]
    n = int(start[-1])
    others = np.bincount(block, minlength=n + 1) - np.bincount(known, minlength=n + 1)
    every = others * float(np.float32(index.rarest) ** 2) + np.bincount(known, weight * weight, minlength=n + 1)
    most = [np.bincount(known, x[term], minlength=n + 1) for x in (index.peak, index.share)]
    ends = np.zeros(n, bool)
    ends[start[1:][np.diff(start) > 0] - 1] = True  # a text's last block is a window of its own
    follows = np.where(ends, 0, 1)
    norm = every[:n] + follows * every[1 : n + 1]
    product, share = (x[:n] + follows * x[1 : n + 1] for x in most)
    # windows that can pass by the sums of the most their words can add
    window = np.flatnonzero((norm > 0) & ((product >= cosine * np.sqrt(norm) - 1e-4) | (share >= 1 - 1e-4)))
    if not len(window):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.float32)
    need = np.zeros(n + 1, bool)
    need[window] = True
    need[window + follows[window]] = True
    number = np.cumsum(need) - 1
    use = need[known] & (weight > 0)
    order = number[known[use]]
    latent = np.zeros((int(number[-1]) + 1, index.basis.shape[1]), np.float32)
    if use.any():
        rows = index.weighted[term[use]]
        edge = np.concatenate(([0], np.flatnonzero(np.diff(order)) + 1))
        latent[order[edge]] = np.add.reduceat(rows, edge, axis=0)
    found = []
    for lo in range(0, len(window), 4096):
        w = window[lo : lo + 4096]
        vector = latent[number[w]] + follows[w, None] * latent[number[w + follows[w]]]
        dot = vector @ index.latent.T
        near = dot / np.sqrt(norm[w])[:, None]
        x, q = np.nonzero((near >= cosine) | (dot >= index.whole))
        found.append((w[x], q, near[x, q]))
    w, q, c = (np.concatenate(x) for x in zip(*found, strict=True))
    text = np.searchsorted(start, w, side="right") - 1
    return text, (w - start[text]) * half, q, c


def matches(index: Index, texts: list[str | None]) -> list[tuple]:
    """(text, item, coverage, rare share, cosine, answer found, first word) of the
    items found in each text, the best place of each."""
    best: dict[tuple, tuple] = {}
    for lo, hi in slices([len(t or "") for t in texts]):
        hashes, first = word_hashes(texts[lo:hi])
        for text, at, k, cosine in zip(*(x.tolist() for x in candidates(index, hashes, first)), strict=True):
            q = index.queries[k]
            words = q["words"]
            m = len(words)
            a = first[text] + max(0, at - m // 2)
            b = min(first[text + 1], first[text] + at + WINDOW + m // 2)
            region = hashes[a:b]
            have = set(region.tolist())
            hits = [w in have for w in index.words[k]]
            if sum(hits) < COVER_ANSWER * m:
                continue
            inside = np.array(hits)
            idf = index.idf[index.terms(words)] + np.float32(1e-3)
            rare = float(idf[inside].sum() / idf.sum())
            if rare < RARE_ANSWER:
                continue
            cover = lcs(words, region[np.isin(region, words)]) / m
            # behind the query there is room for a short answer; a long one needs as much more
            more = len(q["answer"]) + m // 2 if len(q["answer"]) > WINDOW // 2 else 0
            around = hashes[max(first[text], a - more) : min(first[text + 1], b + more)] if more else region
            answer = lcs(q["answer"], around[np.isin(around, q["answer"])]) == len(q["answer"])
            good = cover >= (COVER if m >= 8 else 1.0) and rare >= RARE
            if good or (m >= 8 and answer and cover >= COVER_ANSWER and rare >= RARE_ANSWER):
                key, value = (lo + text, q["item"]), (cover, rare, cosine, answer, at)
                if key not in best or value[:3] > best[key][:3]:
                    best[key] = value
    return [(*key, *value) for key, value in best.items()]


def line_matches(short: dict[bytes, list[int]], texts: list[str | None]) -> list[tuple]:
    """As :func:`matches`, of items of a few words: lines that say exactly them."""
    lines, owner = [], []
    for i, t in enumerate(texts):
        own = (t or "").split("\n")
        lines += own
        owner += [i] * len(own)
    out: dict[tuple, tuple] = {}
    for lo, hi in slices([len(t) for t in lines]):
        hashes, first = word_hashes(lines[lo:hi])
        size = np.diff(first)
        for k in np.flatnonzero((size > 0) & (size < LEAST_WORDS)).tolist():
            for item in short.get(hashes[first[k] : first[k + 1]].tobytes(), ()):
                out.setdefault((owner[lo + k], item), (1.0, 1.0, 1.0, False, 0))
    return [(*key, *value) for key, value in out.items()]


def words_of(queries: DataFrame) -> DataFrame:
    """The distinct words of query passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64))], names=["word"])

    return queries.select("words").mapInArrow(run, "word long").distinct()


def frequencies(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """What :func:`count_words` gives for all words of the queries."""
    words = materialise(words_of(queries), "words")
    passes = max(1, -(-words.count() // MOST_WORDS))
    found = None
    for k in range(passes):
        own = words.filter(F.pmod(F.xxhash64("word"), F.lit(passes)) == k).toPandas()["word"].to_numpy(np.int64)
        counted = count_words(docs, np.sort(own.view(np.uint64)))
        found = counted if found is None else found.unionByName(counted.filter("word is not null"))
    return materialise(found, "frequencies")


def _scans(docs: DataFrame, benchmark: DataFrame, size: int, number: int, stretch: int) -> Iterator[Callable[[DataFrame, tuple[str, ...]], DataFrame]]:
    """For each scan a function of rows (with ``text``) and their columns to keep, that
    gives the rows as struct ``kept``, ``text`` and ``found``, the items found in the
    row's text.  ``size``: passages of an index, ``number``: indexes of a scan."""
    spark = docs.sparkSession
    queries = passages_of(benchmark, stretch)
    # scans take a bounded number of passages each
    scans = max(1, -(-queries.count() // max(1, size * number // 2)))
    found_sql = "found array<struct<" + ",".join(":".join(f.split()) for f in FOUND.split(", ")) + ">>"
    kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.int32())
    names = [f.split()[0] for f in FOUND.split(", ")]
    found_type = pa.list_(pa.struct(list(zip(names, kinds, strict=True))))
    if queries.isEmpty():
        return
    counted = frequencies(docs, queries)
    for k in range(scans):
        chosen = queries.filter(F.pmod(F.xxhash64("item_id", "stretch"), F.lit(scans)) == k)
        every = [{"item": r["item_id"], "words": np.frombuffer(r["words"], np.uint64), "answer": np.frombuffer(r["answer"], np.uint64)} for r in chosen.orderBy("item_id", "words", "answer").collect()]
        passages = [q for q in every if len(q["words"]) >= LEAST_WORDS]
        short: dict[bytes, list[int]] = {}
        for q in every:
            if len(q["words"]) < LEAST_WORDS:
                short.setdefault(q["words"].tobytes(), []).append(q["item"])
        if not every:
            continue
        indexes = [Index(passages[i : i + size]) for i in range(0, len(passages), size)]
        if indexes:
            own = counted.join(words_of(chosen), "word").unionByName(counted.filter("word is null"))
            weigh(indexes, [tuple(r) for r in own.select("word", "n").collect()])
            fit_bases(docs, indexes)
        shared = spark.sparkContext.broadcast((indexes, short))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                best: list[dict[int, tuple]] = [{} for _ in texts]
                indexes, short = shared.value
                for got in (*(matches(index, texts) for index in indexes), *([line_matches(short, texts)] if short else [])):
                    for text, item, *rest in got:
                        if item not in best[text] or tuple(rest) > best[text][item]:
                            best[text][item] = tuple(rest)
                found = [[dict(zip(names, (item, *rest), strict=True)) for item, rest in sorted(b.items(), key=lambda x: (x[0] is None, x[0]))] for b in best]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, found_type)], names=["kept", "text", "found"])

        def scan(rows: DataFrame, keep: tuple[str, ...], search=search) -> DataFrame:
            chosen = rows.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), F.col("text").cast("string").alias("text"))
            return chosen.mapInArrow(search, f"kept {chosen.schema['kept'].dataType.simpleString()}, text string, {found_sql}")

        yield scan


def find(docs: DataFrame, benchmark: DataFrame, *, size: int = QUERIES, number: int = INDEXES, stretch: int = STRETCH) -> DataFrame:
    """(doc_id, item_id, coverage, rare, cosine, answer, start_word): the items found
    in each of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # stretches of one item may be found in several scans; equal rows are told apart by their number
    keys, best = ("doc_id", "tag", "item_id"), [f.split()[0] for f in FOUND.split(", ")][1:]
    out = None
    for scan in _scans(docs, benchmark, size, number, stretch):
        found = scan(docs, ("doc_id",)).filter("size(found) > 0").select("kept.doc_id", F.md5("text").alias("tag"), F.explode("found").alias("f")).select("doc_id", "tag", "f.*")
        once = found.groupBy(*keys).agg(F.count("*").alias("copies"), F.max(F.struct(*best)).alias("best"))
        out = once if out is None else out.unionByName(once)
    if out is None:
        return docs.sparkSession.createDataFrame([], MATCHES)
    whole = out.groupBy(*keys).agg(F.max("copies").alias("copies"), F.max("best").alias("best"))
    return whole.select("doc_id", "item_id", "best.*", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")


def clean(docs: DataFrame, benchmark: DataFrame, *, size: int = QUERIES, number: int = INDEXES, stretch: int = STRETCH) -> DataFrame:
    """``docs`` without the rows in which an item was found.  Each row is judged by its
    own text, whatever its id; with several scans, each takes what the one before left."""
    rest = tuple(c for c in docs.columns if c != "text")
    out = docs
    for k, scan in enumerate(_scans(docs, benchmark, size, number, stretch)):
        rows = materialise(out, "left") if k else out
        left = scan(rows, rest or ("text",)).filter("size(found) = 0")
        out = left.select(*[F.col("text") if c == "text" else F.col(f"kept.{c}") for c in docs.columns])
    return out
