"""A Merkle manifest of a table: a leaf a row, a tree a source, a root over all, and an
authentication path a leaf.

Leaves ascend by id in their source (equal ids by leaf, nulls first).  Every sixteen
consecutive nodes, of the last run as many as there are, hash to their parent while more
than one remains; the subroots, by source (null first), make the tree above in the same
way.  A digest is lowercase hex SHA-256; what is hashed is text.

Paths are emitted by fractal traversal.  Sources are cut into aligned blocks of
``ARITY ** LEVELS`` leaves.  Within a block, in order of leaves, one subtree a level is
kept stacked: the existing one, whose siblings are being emitted, and the desired one,
which grows as nodes complete below and takes the place of the existing one when the
traversal crosses into it.  A block's own path, from the block to the root, comes with it
from levels that are hashed and joined as distributed tables.

Defined results: a null column is ``-`` in a leaf; an empty text is ``0:``; texts of any
length are hashed whole; rows that repeat an id in a source are leaves of their own, in
order of their digests; an empty table gives no rows; extra columns are ignored.

Scale: a text is read once, for its leaf (and for a tampered one where that is asked for).
Rows are numbered within sources by ranges of (source, id), so a source of any size is many
tasks; equal rows are dealt by their place in the input.  A task holds one block.  Levels
shrink sixteenfold each; the driver gets the number of leaves of the largest source.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import id_crc, materialise

ARITY, LEVELS = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id {}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
UPPERS, LOWERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: Column) -> Column:
    """H of a list of texts."""
    return F.sha2(F.array_join(parts, "").cast("binary"), 256)


def leaf_of(**columns: Column) -> Column:
    """H of the fields of a row; ``columns`` replace the table's own."""

    def field(name: str) -> Column:
        value = columns.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[field(f) for f in FIELDS]).cast("binary"), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(grp, key, leaf, forged) of the rows of ``docs``: ``forged`` is the leaf with the
    text's A-Z in lower case where ``tampered`` holds, else null."""
    rows = docs.select(*FIELDS)
    forged = F.when(F.lit(False) if tampered is None else tampered, leaf_of(text=F.translate("text", UPPERS, LOWERS)))
    # a text that keeps the order of sources and puts null first
    group = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    return rows.select(group.alias("grp"), F.col("doc_id").alias("key"), leaf_of().alias("leaf"), forged.alias("forged"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (grp, key, leaf, ...) with ``pos``, the place by key and leaf within the
    group, and ``n``, the group's size."""
    names = rows.columns
    spread = rows.withColumn("turn", F.xxhash64(F.monotonically_increasing_id()))
    dealt = spread.repartitionByRange("grp", "key", "leaf", "turn").sortWithinPartitions("grp", "key", "leaf", "turn").drop("turn")
    schema = StructType([*rows.schema, StructField("nth", LongType(), False), StructField("part", LongType(), False)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(0).dictionary_encode()
            code = groups.indices.to_numpy()
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            nth = np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code))))
            first, final = groups.dictionary[int(code[0])].as_py(), groups.dictionary[int(code[-1])].as_py()
            if first == last:
                nth[: starts[1] if len(starts) > 1 else len(code)] += seen
            last, seen = final, int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(nth, pa.int64()), batch.column(len(names))], names=[*names, "nth", "part"])

    counted = materialise(dealt.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(count, schema), "numbered")
    sizes = materialise(counted.groupBy("grp", "part").agg((F.max("nth") + 1).alias("here")), "sizes")
    total = sizes.groupBy("grp").agg(F.sum("here").alias("n"))
    # a group has at most a row for each range here
    since = F.expr("coalesce(sum(here) over (partition by grp order by part rows between unbounded preceding and 1 preceding), 0L)")
    places = sizes.select("grp", "part", since.alias("since")).join(total, "grp")
    return counted.join(places, ["grp", "part"]).select(*names, (F.col("nth") + F.col("since")).alias("pos"), "n")


def _runs(level: DataFrame) -> DataFrame:
    """(grp, idx, n, run) of a level's nodes (grp, idx, n, h): the runs by their place, in
    groups of more than one node.  ``n`` becomes the size of the level above."""
    run = F.transform(F.array_sort(F.collect_list(F.struct("idx", "h"))), lambda m: m["h"])
    own = level.filter("n > 1").groupBy("grp", F.expr(f"idx div {ARITY}").alias("up")).agg(F.max("n").alias("n"), run.alias("run"))
    return own.select("grp", F.col("up").alias("idx"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), "run")


def _parents(runs: DataFrame) -> DataFrame:
    return runs.select("grp", "idx", "n", digest(F.col("run")).alias("h"))


def climb(nodes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Roots (grp, root) of the groups of ``nodes`` (grp, idx, n, h), and the path (grp, idx,
    path) of each node: siblings before and after it, level by level.  ``most``: nodes of
    the largest group."""
    level = materialise(nodes, "nodes")
    side = "struct<before: string, after: string>"
    paths = level.select("grp", "idx", F.array().cast(f"array<{side}>").alias("path"), F.col("idx").alias("at"))
    roots = level.filter("n = 1")
    while most > 1:
        runs = materialise(_runs(level), "runs")
        own = runs.select(F.col("grp").alias("_grp"), F.col("idx").alias("_idx"), F.col("run").alias("_run"))
        place = F.expr(f"cast(at % {ARITY} as int)")
        before, after = F.slice("_run", F.lit(1), place), F.slice("_run", place + 2, F.lit(ARITY))
        step = F.array(F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after")))
        paths = paths.join(own, (F.col("grp") == F.col("_grp")) & (F.expr(f"at div {ARITY}") == F.col("_idx")), "left")
        paths = paths.select("grp", "idx", F.when(F.col("_run").isNotNull(), F.concat("path", step)).otherwise(F.col("path")).alias("path"), F.expr(f"at div {ARITY}").alias("at"))
        level = _parents(runs)
        roots, most = roots.unionByName(level.filter("n = 1")), -(-most // ARITY)
    return roots.select("grp", F.col("h").alias("root")), materialise(paths.select("grp", "idx", "path"), "paths")


class Stack:
    """The subtrees of one block, a run a level: desired ones grow from below, the existing
    one is what siblings are read from."""

    def __init__(self, height: int) -> None:
        self.height = height
        self.growing: list[list[str]] = [[] for _ in range(height)]
        self.desired: list[list[list[str]]] = [[] for _ in range(height)]
        self.existing: list[list[str]] = [[] for _ in range(height)]

    def grow(self, node: str, level: int = 0) -> None:
        if level < self.height:
            self.growing[level].append(node)
            if len(self.growing[level]) == ARITY:
                self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.growing[level] = self.growing[level], []
        self.desired[level].append(run)
        self.grow(_h("".join(run)), level + 1)

    def close(self) -> None:
        """The block has no more leaves: runs end short."""
        for level in range(self.height):
            if self.growing[level]:
                self._complete(level)
            self.desired[level].reverse()

    def cross(self, at: int) -> None:
        """The traversal comes to leaf ``at``: where that begins a run, the desired one takes over."""
        for level in range(self.height):
            if at % ARITY ** (level + 1):
                return
            self.existing[level] = self.desired[level].pop()

    def sides(self, at: int, level: int) -> tuple[str, str]:
        run, k = self.existing[level], at // ARITY**level % ARITY
        return "".join(run[:k]), "".join(run[k + 1 :])


def _h(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def _height(n: int, most: int) -> int:
    """Levels of a block of a source of ``n`` leaves, ``most`` at most."""
    height = 0
    while n > 1 and height < most:
        n, height = -(-n // ARITY), height + 1
    return height


def _emit(ids: list, digests: list[str], forged: list[str | None], above: dict, levels: int) -> Iterator[tuple]:
    """Rows of the leaves of one block; ``above``: its path to the root."""
    stack = Stack(_height(above["n"], levels))
    for h in digests:
        stack.grow(h)
    stack.close()
    tail = [(s["before"], s["after"]) for s in above["path"]]
    end = "".join(b + a for b, a in tail).encode("ascii")
    upper: list[tuple[str, str]] = []
    middle = b""
    for at, (doc_id, leaf, other) in enumerate(zip(ids, digests, forged, strict=True)):
        if at % ARITY == 0:  # above the leaves' own run, siblings are the same for all of it
            stack.cross(at)
            upper = [stack.sides(at, level) for level in range(1, stack.height)]
            middle = "".join(b + a for b, a in upper).encode("ascii") + end
        lowest = [stack.sides(at, 0)] if stack.height else []
        proof = sha256("".join(b + a for b, a in lowest).encode("ascii") + middle).hexdigest()
        node = leaf if other is None else other
        for before, after in (*lowest, *upper, *tail):
            node = _h(before + node + after)
        yield doc_id, leaf, above["subroot"], above["root"], proof, node, node == above["root"]


def manifest(docs: DataFrame, tampered: Column | None = None, *, levels: int = LEVELS) -> DataFrame:
    """Leaf, subroot, root and path digest of each row of ``docs``, and the root that its
    path folds to from the leaf (from the tampered one where ``tampered`` holds).
    ``levels``: of a block, which one task holds at a time."""
    out_schema = SCHEMA.format(docs.schema["doc_id"].dataType.simpleString())
    placed = numbered(materialise(leaves(docs, tampered), "leaves"))
    level = placed.select("grp", F.col("pos").alias("idx"), "n", F.col("leaf").alias("h"))
    counts = materialise(placed.filter("pos = 0").select("grp", "n"), "counts")
    largest = counts.agg(F.max("n")).first()[0]
    if largest is None:
        return docs.sparkSession.createDataFrame([], out_schema)

    # up to the blocks, then from the blocks to the subroots, then from these to the root
    roots = level.filter("n = 1").select("grp", F.col("h").alias("root"))
    for _ in range(levels):
        level = materialise(_parents(_runs(level)), "level")
        roots = roots.unionByName(level.filter("n = 1").select("grp", F.col("h").alias("root")))
    block_roots, block_paths = climb(level.filter("n > 1"), -(-largest // ARITY**levels))
    subroots = materialise(roots.unionByName(block_roots), "subroots")
    order = numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("root").alias("leaf")))
    tops = materialise(order, "tops")
    top_root, top_paths = climb(tops.select("grp", F.col("pos").alias("idx"), "n", F.col("leaf").alias("h")), subroots.count())
    to_root = tops.join(top_paths.withColumnRenamed("idx", "pos"), ["grp", "pos"]).join(top_root, "grp")
    to_root = to_root.select(F.col("key").alias("grp"), F.col("leaf").alias("subroot"), "root", F.col("path").alias("top"))

    whole = ARITY**levels
    small = counts.filter(F.col("n") <= whole).select("grp", F.lit(0).cast("long").alias("idx"), F.array().cast(block_paths.schema["path"].dataType).alias("path"))
    above = block_paths.unionByName(small).join(counts, "grp").join(to_root, "grp")
    above = above.select("grp", F.col("idx").alias("block"), F.struct("n", "subroot", "root", F.concat("path", "top").alias("path")).alias("above"))

    rows = placed.select("grp", F.expr(f"pos div {whole}").alias("block"), "pos", F.col("key").alias("doc_id"), "leaf", "forged")
    both = rows.unionByName(above.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
    dealt = both.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
    kind = pa.schema([("doc_id", _arrow(docs, "doc_id")), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        above: dict = {}

        def flush() -> Iterator[pa.RecordBatch]:
            if held[0]:
                columns = zip(*_emit(*held, above, levels), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kind.types, strict=True)], schema=kind)
                for h in held:
                    h.clear()

        for batch in batches:
            pos, ids, own, other = (batch.column(k).to_pylist() for k in range(4))
            heads = [k for k, p in enumerate(pos) if p < 0]
            edges = [*heads, len(pos)] if heads and heads[0] == 0 else [0, *heads, len(pos)]
            for lo, hi in zip(edges, edges[1:]):  # noqa: B905
                if lo < hi and pos[lo] < 0:
                    yield from flush()
                    above = batch.column(4)[lo].as_py()
                    lo += 1
                for mine, column in zip(held, (ids, own, other), strict=True):
                    mine.extend(column[lo:hi])
        yield from flush()

    return dealt.select("pos", "doc_id", "leaf", "forged", "above").mapInArrow(run, out_schema)


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def fifth(doc_id: Column) -> Column:
    """Whether 5 divides the unsigned crc32 of an id written as text; not for null."""
    return F.coalesce(id_crc(doc_id) % 5 == 0, F.lit(False))
