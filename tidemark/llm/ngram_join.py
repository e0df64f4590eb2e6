"""N-gram Jaccard self-join by a MinHash LSH forest.

A text is the set of its runs of five words (of all its words when it has fewer).
Each of ``TREES`` trees is a trie of the texts by a prefix of their own minimum
hashes, held as a sorted run: texts are dealt by the shortest prefix that may be
used and sorted by the whole one, so texts that share a longer prefix lie together.
In each tree a text starts with the texts that share its longest prefix and
shortens it, one value at a time, until its estimated recall reaches the target; the
estimate counts the neighbours met so far (one of similarity ``s`` met at depth ``d``
stands for ``1 / (trees * s ** d)``) and one more at the threshold itself.  So texts
in dense places stop at long prefixes, and a text with few or no neighbours goes on to
the depth at which a pair just at the threshold is missed with less than the
target's chance.  Texts that meet and whose signatures agree enough are connected;
inside each connected candidate group links are settled exactly, on full sets of
shingles.

Results are one row a document: its class (the least id of its connected group of
documents with similarity of at least ``threshold``) and the number of documents
it is linked to directly.  Copies are never expanded: equal texts form one
representative with a weight.  Texts are named by 16 bytes of their SHA-256, never by
an id.

Defined results: null texts have a class of their own and no links; texts without
words link to their exact copies only; repeated rows are copies of each other;
unlike texts of one id are compared like any others; ids that are null name no class
(the class is null when all ids of it are), yet such rows are linked and counted like
any others; extra columns are ignored.

Scale: texts are read twice; those outside candidate groups are never shuffled.  What
is shuffled: one (key, name) pair a tree and text, signatures of texts that share a
prefix, and texts and shingle sets of candidate groups.  Copies collapse before
anything else, by a partial aggregate.  Dense buckets are first thinned: in blocks of
``BUCKET_BLOCK`` texts, those close to a leader are connected to it and only leaders
go on, so a bucket of near copies takes linear work; what then remains in a bucket
(unlike texts) is dealt in pairs of blocks.  Large candidate groups are reduced to
what differs from one member, and compared in pairs of blocks of ``GROUP_BLOCK`` texts
whose comparison is left open by the numbers of differences.  Nothing is capped or
sampled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_texts, mark_possible, materialise, mix64, release, slices, span_hash, text_tag, word_spans
from tidemark.llm.components import components

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH = 20, 6
#: Share of links to find.
RECALL = 0.9999
#: Signatures must agree in the threshold less this, four deviations of the estimate.
SLACK = 0.15
#: Signatures that differ in less than this share join a leader of a dense bucket.
CLOSE = 0.08
#: Texts in a block of a bucket, and texts and shingles in a block of a candidate group.
BUCKET_BLOCK, GROUP_BLOCK, GROUP_SHINGLES = 512, 256, 1 << 18
#: A bucket is thinned as long as this share of its texts, at most, are leaders.
THINS = 0.5

_HASHES = TREES * DEPTH
_A = mix64(np.arange(1, _HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix64(np.arange(1001, 1001 + _HASHES, dtype=np.uint64))
_PLACE = [np.uint64(int(x) | 1) for x in mix64(np.arange(2001, 2001 + 64, dtype=np.uint64))]


def shingle_arrays(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """The shingle hashes of each text (with repeats), in order."""
    for lo, hi in slices([len(t or "") for t in texts]):
        data, offsets = join_texts(texts[lo:hi])
        starts, ends = word_spans(data)
        hashes = span_hash(data, starts, ends)
        first = np.searchsorted(starts, offsets)
        windows = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
        for k in range(words if len(windows) else 0):
            windows += hashes[k : k + len(windows)] * _PLACE[k]
        windows = mix64(windows)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= words:
                yield windows[a : b - words + 1]
            elif b > a:
                short = np.zeros(1, np.uint64)
                for k in range(a, b):
                    short += hashes[k : k + 1] * _PLACE[k - a]
                yield mix64(short + np.uint64(b - a))
            else:
                yield windows[:0]


def signature(shingles: np.ndarray) -> bytes:
    """16 bits of each minimum hash, by trees."""
    low = np.full(_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        part = shingles[i : i + 4096]
        np.minimum(low, (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1), out=low)
    return (mix64(low) >> np.uint64(48)).astype("<u2").tobytes()


def digest(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:16]


def shortest_prefix(threshold: float, recall: float) -> int:
    """The longest prefix at which a pair at the threshold is missed by all trees with
    a chance of ``1 - recall`` at most."""
    for depth in range(DEPTH, 0, -1):
        if (1 - threshold**depth) ** TREES <= 1 - recall:
            return depth
    raise ValueError(f"{TREES} trees cannot find pairs of similarity {threshold} with a recall of {recall}")


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        sigs, sizes = [], []
        for s in shingle_arrays(texts):
            sigs.append(signature(s) if len(s) else None)
            sizes.append(len(s))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())], names=["doc_id", "tag", "sig", "shingles"])


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that hold whole groups of equal keys of a sorted stream, with the
    borders of their groups."""
    left: pa.RecordBatch | None = None
    for batch in batches:
        if left is not None:
            batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            v = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        borders = np.concatenate(([0], np.flatnonzero(change) + 1))
        if len(borders) > 1:
            yield batch.slice(0, borders[-1]), borders
        left = batch.slice(borders[-1])
    if left is not None:
        yield left, np.array([0, left.num_rows])


def forest(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a symmetric link matrix that has links, the least row of its
    component."""
    m = len(mask)
    label = np.arange(m, dtype=np.int32)
    while True:
        low = np.where(mask, label[None, :], np.int32(m)).min(axis=1)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(m))
    return at, label[at]


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal minimum hashes of each row of ``a`` with each of ``b``."""
    out = np.empty((len(a), len(b)), np.float32)
    for i in range(0, len(a), 16):
        out[i : i + 16] = (a[i : i + 16, None, :] == b[None, :, :]).mean(axis=2)
    return out


def unmet_share(found: np.ndarray, depth: int, threshold: float) -> np.ndarray:
    """For each row of a matrix of similarities of neighbours met at ``depth`` in one
    tree (0: none), the estimated share of its links that no tree has met, counting one
    link at the threshold beside them."""
    s = np.where(found > 0, found, np.float32(1))
    weight = np.where(found > 0, 1 / (TREES * s**depth), 0)
    missed = (weight * (1 - s**depth) ** TREES).sum(axis=1) + (1 - threshold**depth) ** TREES
    return missed / (weight.sum(axis=1) + 1)


def meet(key: np.ndarray, sig: np.ndarray, side: np.ndarray | None, slack: np.ndarray, threshold: float, recall: float, shortest: int) -> np.ndarray:
    """Which texts of a trie's node meet and agree: a symmetric matrix.

    ``key`` holds the whole prefixes in sorted order.  Each text starts with those that
    share all of its prefix; those whose recall is not yet reached go on with a shorter
    one.  ``side`` (block numbers) leaves out pairs of one block; ``slack`` is what a
    text's agreement may lack."""
    n = len(key)
    mask = np.zeros((n, n), bool)
    found = np.zeros((n, n), np.float32)
    going = np.ones(n, bool)
    for depth in range(key.shape[1], shortest - 1, -1):
        edge = np.concatenate(([0], np.flatnonzero((key[1:, :depth] != key[:-1, :depth]).any(axis=1)) + 1, [n]))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            own = np.flatnonzero(going[a:b]) + a
            if b - a < 2 or not len(own):
                continue
            same = agreement(sig[own], sig[a:b])
            good = same >= threshold - SLACK - slack[own, None] - slack[None, a:b]
            good[np.arange(len(own)), own - a] = False
            if side is not None:
                good &= side[own, None] != side[None, a:b]
            mask[own[:, None], np.arange(a, b)[None, :]] |= good
            found[own, a:b] = np.where(good & (same >= threshold), same, 0)
        if depth > shortest:
            going &= unmet_share(found, depth, threshold) > 1 - recall
    return mask | mask.T


def _prefixes(sigs: np.ndarray, trees: np.ndarray) -> np.ndarray:
    return sigs.reshape(len(sigs), TREES, DEPTH)[np.arange(len(sigs)), trees]


def _in_order(key: np.ndarray) -> np.ndarray:
    return np.lexsort(key.T[::-1])


LINKS = "u binary, v binary"


def _meet(batches: Iterator[pa.RecordBatch], threshold: float, recall: float, shortest: int) -> Iterator[pa.RecordBatch]:
    """Links between the texts of buckets, or of two blocks of one."""
    for batch, borders in groups(batches, ("bucket", "p", "q")):
        p, q, part, tree = (batch.column(k).to_numpy() for k in (1, 2, 3, 4))
        slack, names = batch.column(5).to_numpy(), batch.column(6)
        sigs = np.frombuffer(b"".join(batch.column(7).to_pylist()), "<u2").reshape(-1, _HASHES)
        at, to = [], []
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            if b - a < 2:
                continue
            key = _prefixes(sigs[a:b], tree[a:b])
            order = _in_order(key) + a
            side = part[order] if p[a] != q[a] else None
            x, root = forest(meet(key[order - a], sigs[order], side, slack[order], threshold, recall, shortest))
            at.append(order[x])
            to.append(order[root])
        if at:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(at))), names.take(pa.array(np.concatenate(to)))], names=["u", "v"])


def leaders(sig: np.ndarray, slack: np.ndarray, close: float) -> tuple[np.ndarray, np.ndarray]:
    """For each text its leader: the first in order that it is close to; and how far
    the texts of a leader are from it at most."""
    n = len(sig)
    of, reach = np.full(n, -1), np.zeros(n, np.float32)
    for i in range(n):
        if of[i] < 0:
            open_ = np.flatnonzero(of < 0)
            far = 1 - agreement(sig[i : i + 1], sig[open_])[0]
            near = (far < close) & (slack[open_] + far < 2 * close)
            mine = open_[near | (open_ == i)]
            of[mine] = i
            reach[i] = max(slack[i], float((slack[mine] + (1 - agreement(sig[i : i + 1], sig[mine])[0])).max())) if len(mine) > 1 else slack[i]
    return of, reach


def _thin(batches: Iterator[pa.RecordBatch], close: float) -> Iterator[pa.RecordBatch]:
    """Leaders of blocks of dense buckets (leads true, with their slack), and links of
    the others to them (u, name of the leader)."""
    for batch, borders in groups(batches, ("bucket", "part")):
        bucket, tree, slack, names = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4)
        sigs = np.frombuffer(b"".join(batch.column(5).to_pylist()), "<u2").reshape(-1, _HASHES)
        of, reach = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.float32)
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            own, far = leaders(sigs[a:b], slack[a:b], close)
            of[a:b], reach[a:b] = own + a, far
        leads = of == np.arange(batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket), pa.array(tree), pa.array(reach.astype(np.float32)), names, pa.array([s if own else None for s, own in zip(batch.column(5).to_pylist(), leads, strict=True)], pa.binary()), names.take(pa.array(of)), pa.array(leads)],
            names=["bucket", "tree", "slack", "tag", "sig", "leader", "leads"],
        )


def _blocks(rows: DataFrame, count: str, salt: int) -> DataFrame:
    """Deals rows into ``count`` blocks of their key and repeats each row for every
    pair of blocks that it takes part in: adds part, p, q."""
    rows = rows.withColumn("part", _part(count, salt)).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(count) - 1).cast("int"))))
    return rows.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")}).drop("other", count)


def _part(count: str, salt: int) -> Column:
    return F.pmod(F.xxhash64("tag", F.lit(salt)), F.col(count)).cast("int")


def _counted(rows: DataFrame) -> DataFrame:
    """``rows`` (with a bucket) with the number of blocks that their bucket needs."""
    sizes = rows.groupBy(F.col("bucket").alias("of")).agg(F.ceil(F.count("*") / BUCKET_BLOCK).alias("blocks"))
    return rows.join(sizes, F.col("bucket") == F.col("of")).drop("of")


def candidate_links(reps: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Links (u, v) between names of texts (tag, sig) that are likely similar."""
    shortest = shortest_prefix(threshold, recall)
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    prefix = F.substring(F.col("sig"), F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * shortest))
    keyed = reps.select("tag", "sig", tree).select("tag", "tree", F.xxhash64("tree", prefix).alias("bucket"))
    shared = materialise(keyed.groupBy(F.col("bucket").alias("of")).agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    # most buckets hold one text: a bitmap of the others keeps those out of the join
    met = mark_possible(keyed, F.col("bucket"), shared, "of").filter("_may")
    inside = met.join(shared, F.col("bucket") == F.col("of")).select("bucket", "tree", F.ceil(F.col("n") / BUCKET_BLOCK).alias("blocks"), "tag")
    rows = inside.join(reps.select("tag", "sig"), "tag").select("bucket", "blocks", "tree", F.lit(0.0).cast("float").alias("slack"), "tag", "sig")
    small, dense, found = rows.filter("blocks = 1"), None, []
    if not shared.filter(F.col("n") > BUCKET_BLOCK).isEmpty():
        dense = materialise(rows.filter("blocks > 1"), "dense")
        before = dense.count()
        while before:
            parts = dense.select("bucket", _part("blocks", 3 + len(found)).alias("part"), "tree", "slack", "tag", "sig")
            step = materialise(parts.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "tag").mapInArrow(lambda it: _thin(it, CLOSE), "bucket long, tree int, slack float, tag binary, sig binary, leader binary, leads boolean"), "thin")
            found.append(step.filter("not leads").select(F.col("tag").alias("u"), F.col("leader").alias("v")))
            dense = materialise(_counted(step.filter("leads").select("bucket", "tree", "slack", "tag", "sig")).select("bucket", "blocks", "tree", "slack", "tag", "sig"), "leaders")
            after = dense.filter("blocks > 1").count()
            if after > THINS * before or not after:
                break
            before = after
    every = small if dense is None else small.unionByName(dense)
    dealt = _blocks(every, "blocks", 1).select("bucket", "p", "q", "part", "tree", "slack", "tag", "sig")
    dealt = dealt.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "tag")
    links = dealt.mapInArrow(lambda it: _meet(it, threshold, recall, shortest), LINKS)
    for one in found:
        links = links.unionByName(one)
    out = materialise(links, "meet")
    release(shared, dense)
    return out


def differences(own: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Members of one sorted set only, and how many the centre and the set have alone."""
    lost, more = np.setdiff1d(centre, own, assume_unique=True), np.setdiff1d(own, centre, assume_unique=True)
    return np.sort(np.concatenate([lost, more])), len(lost), len(more)


def _reduce(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Sets as differences from the centre of their group, with their weight: what the
    centre has alone and ``threshold`` times what the set has alone."""
    for batch in batches:
        sets, centres = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        got = [differences(np.frombuffer(a, np.uint64), np.frombuffer(c, np.uint64)) for a, c in zip(sets, centres, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([d.tobytes() for d, _, _ in got], pa.binary()), pa.array([a + threshold * b for _, a, b in got], pa.float64()), pa.array([(1 - threshold) * (len(c) // 8) for c in centres], pa.float64())],
            names=["kept", "members", "far", "room"],
        )


def linked(members: list[np.ndarray], far: np.ndarray, room: float, threshold: float) -> np.ndarray:
    """Which pairs of texts have a Jaccard similarity of at least ``threshold``.

    With sets written as differences from a centre of ``n`` members, of which one lacks
    ``a`` and has ``b`` of its own, two sets share ``n - a1 - a2 + m`` members and have
    ``n + b1 + b2 - m`` in all where ``m`` differences are common to both.  So they are
    similar if and only if ``far1 + far2 <= room + (1 + threshold) * m`` for
    ``far = a + threshold * b`` and ``room = (1 - threshold) * n``: only pairs whose
    ``far`` add up to more than ``room`` need a look at ``m``."""
    open_ = far[:, None] + far[None, :] - room
    mask = open_ <= 1e-9
    left = np.flatnonzero((~mask).any(axis=1))
    if len(left) > 1:
        both = common_members([members[i] for i in left])
        mask[left[:, None], left[None, :]] |= open_[left[:, None], left[None, :]] <= (1 + threshold) * both + 1e-9
    np.fill_diagonal(mask, False)
    return mask


def common_members(sets: list[np.ndarray], width: int = 1024) -> np.ndarray:
    """Sizes of the intersections of sorted, distinct sets: shared members become
    columns of a matrix, whose products with itself add up to them."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    both = np.zeros((m, m))
    if not len(flat):
        return both
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    use = shared[column]
    owner, column = owner[use], (np.cumsum(shared) - 1)[column[use]]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (lo, lo + width))
        block = np.zeros((m, width), np.float32)
        block[owner[a:b], column[a:b] - lo] = 1
        both += block @ block.T
    return both


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Exact links between the texts of two blocks: (u, null, n) adds n linked
    documents to u, (u, v, null) connects them."""
    for batch, borders in groups(batches, ("comp", "p", "q")):
        p, q, part, far, room, weight = (batch.column(k).to_numpy() for k in (1, 2, 3, 4, 5, 6))
        names, sets = batch.column(7), batch.column(8)
        u, v, n = [], [], []
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            if b - a < 2:
                continue
            mask = linked([np.frombuffer(sets[i].as_py(), np.uint64) for i in range(a, b)], far[a:b], float(room[a]), threshold)
            if p[a] != q[a]:
                mask &= part[a:b, None] != part[None, a:b]
            at, root = forest(mask)
            more = np.array([weight[a:b][row].sum() for row in mask])
            some = np.flatnonzero(more)
            u += [at + a, some + a]
            v += [root + a, np.full(len(some), -1)]
            n += [np.full(len(at), -1, np.int64), more[some]]
        if u:
            u, v, n = (np.concatenate(x) for x in (u, v, n))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(u)), names.take(pa.array(np.where(v < 0, 0, v), mask=v < 0)), pa.array(n, mask=n < 0)], names=["u", "v", "n"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(s).tobytes() for s in shingle_arrays(batch.column(1).to_pylist())], pa.binary())], names=["own", "members"])


def exact_links(docs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(u, v, n) as :func:`_compare` gives them, for ``members`` (tag, copies, shingles,
    comp) of candidate groups and the texts of ``docs`` (tag, text)."""
    sizes = members.groupBy(F.col("comp").alias("of")).agg(
        F.ceil(F.greatest(F.count("*") / GROUP_BLOCK, F.sum("shingles") / GROUP_SHINGLES)).alias("blocks"), F.min("tag").alias("centre")
    )
    placed = materialise(members.join(sizes, F.col("comp") == F.col("of")).drop("of", "shingles"), "placed")
    # one text a name: copies combine before the shuffle
    wanted = mark_possible(docs, F.col("tag"), placed, "tag").filter("_may").drop("_may")
    once = wanted.groupBy(F.col("tag").alias("name")).agg(F.first("text").alias("text"))
    texts = once.join(placed.select("tag"), F.col("name") == F.col("tag"), "left_semi")
    sets = materialise(placed.join(texts.mapInArrow(_sets, "own binary, members binary"), F.col("tag") == F.col("own")).drop("own"), "sets")
    none = F.lit(0.0)
    whole = sets.filter("blocks = 1").select("comp", "tag", "copies", "blocks", "members", (F.octet_length("members") / 8 * threshold).alias("far"), none.alias("room"))
    large = sets.filter("blocks > 1")
    if not large.isEmpty():
        # the centre is repeated for each block of its group, so that no task meets all of a group
        part = lambda: F.pmod(F.xxhash64("tag", F.lit(5)), F.col("blocks")).cast("int")
        centres = large.filter("tag = centre").select(F.col("comp").alias("of"), F.col("members").alias("middle"), F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("at"))
        beside = large.withColumn("part", part()).join(centres, (F.col("comp") == F.col("of")) & (F.col("part") == F.col("at")))
        kept = F.struct("comp", "tag", "copies", "blocks")
        beside = beside.select(kept.alias("kept"), "members", "middle")
        kind = beside.schema["kept"].dataType.simpleString()
        reduced = beside.mapInArrow(lambda it: _reduce(it, threshold), f"kept {kind}, members binary, far double, room double").select("kept.*", "members", "far", "room")
        whole = whole.unionByName(materialise(reduced, "reduced"))
    dealt = _blocks(whole, "blocks", 2).select("comp", "p", "q", "part", "far", "room", "copies", "tag", "members")
    dealt = dealt.repartition("comp", "p", "q").sortWithinPartitions("comp", "p", "q", "tag")
    out = materialise(dealt.mapInArrow(lambda it: _compare(it, threshold), "u binary, v binary, n long"), "exact")
    release(placed, sets)
    return out


def join(docs: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, text_id) of every row of ``docs`` (doc_id, text);
    text_id is the least id with the same text."""
    return _join(docs, threshold=threshold, recall=recall).select("doc_id", F.when(F.col("tag").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "n_links", "text_id")


def _join(docs: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, tag, class_id, class_tag, n_links, text_id) of every row: its text's name
    and the name of its class beside the ids."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_tag(F.col("text")).alias("tag"), "text")
    sketch = materialise(docs.mapInArrow(_sketch, "doc_id long, tag binary, sig binary, shingles long"), "sketch")
    classes = sketch.filter("tag is not null").groupBy("tag").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min("sig").alias("sig"), F.min("shingles").alias("shingles"))
    classes = materialise(classes, "classes")
    reps = classes.filter("sig is not null")
    links = candidate_links(reps.select("tag", "sig"), threshold, recall)
    comps = components(links).select(F.col("vertex").alias("of"), F.col("component").alias("comp"))
    members = materialise(reps.select("tag", "copies", "shingles").join(comps, F.col("tag") == F.col("of")).drop("of"), "members")
    exact = exact_links(docs.select("tag", "text"), members, threshold)
    counts = exact.filter("n is not null").groupBy(F.col("u").alias("linked")).agg(F.sum("n").alias("more"))
    joined = materialise(components(exact.filter("v is not null").select("u", "v")).withColumnRenamed("component", "root"), "joined")
    info = classes.select("tag", "least", "copies").join(counts, F.col("tag") == F.col("linked"), "left").join(joined, F.col("tag") == F.col("vertex"), "left")
    info = info.select(F.col("tag").alias("of"), F.col("least").alias("text_id"), F.coalesce("root", "tag").alias("class_tag"), (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.col("root").isNotNull().alias("grouped"))
    info = materialise(info, "info")
    # only classes of several texts need the least of their ids
    least = info.filter("grouped").groupBy(F.col("class_tag").alias("class")).agg(F.min("text_id").alias("least"))
    named = info.join(least, F.col("class_tag") == F.col("class"), "left").select("of", "text_id", "class_tag", "links", F.when(F.col("grouped"), F.col("least")).otherwise(F.col("text_id")).alias("class_id"))
    named = materialise(named, "named")
    release(links, members, exact, joined, info)
    out = sketch.select("doc_id", "tag").join(named, F.col("tag") == F.col("of"), "left")
    return out.select("doc_id", "tag", "class_id", "class_tag", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("text_id", "doc_id").alias("text_id"))


def keep_one(docs: DataFrame, **options: object) -> DataFrame:
    """``docs`` with one document of each class: that of the least id (of the least name
    of texts where ids are equal, one of them where rows repeat); all null texts, which
    are in no class together, are kept."""
    own = _join(docs, **options)
    first = own.filter("tag is not null").groupBy("class_tag").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("first"))
    first = materialise(first.select(F.col("first.doc_id").alias("_tidemark_id"), F.col("first.tag").alias("_tidemark_tag")), "first")
    again = own.groupBy("doc_id", "tag").agg(F.count("*").alias("n")).filter("n > 1 and tag is not null").select(F.col("doc_id").alias("_tidemark_of"), F.col("tag").alias("_tidemark_same"))
    kept = materialise(first.join(again, F.col("_tidemark_id").eqNullSafe(F.col("_tidemark_of")) & (F.col("_tidemark_tag") == F.col("_tidemark_same")), "left").select("_tidemark_id", "_tidemark_tag", F.col("_tidemark_same").isNotNull().alias("_tidemark_again")), "kept")
    named = docs.withColumn("_tidemark_name", text_tag(F.col("text")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_tidemark_id")) & (F.col("_tidemark_name") == F.col("_tidemark_tag"))
    single = named.join(kept.filter("not _tidemark_again"), same, "left_semi").drop("_tidemark_name").unionByName(docs.filter("text is null"))
    repeated = kept.filter("_tidemark_again")
    if repeated.isEmpty():
        return single
    return single.unionByName(named.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "_tidemark_name"]).drop("_tidemark_name"))
