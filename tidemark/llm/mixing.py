"""Mixing sources to target weights by Sainte-Laguë apportionment.

Equal-token blocks go to sources by highest quotients (Webster's divisors 1, 3,
5, ...); a source's blocks go to its shards by cumulative rounding, so that the
shards' integer quotas add up to the source's; of a shard's blocks, seeded ones are
taken once more than the rest.  The main path is DataFrame functions only.

Defined results:

* null or empty text: size 0, nothing taken, no part in any shard;
* null source: a source of its own, ranked last;
* null, equal or repeated ids: each row counts; rows equal in id and text are
  interchangeable, so the multiset of results is the same in every run;
* empty table: empty result; a corpus without words: targets and takes of 0;
* tiny sources: blocks have ``block_tokens`` words, or fewer where the smallest
  target would have less than ``LEAST_BLOCKS`` of them, down to single words;
* extra columns, whatever their names, are ignored.

Scale: one scan of the texts and one shuffle of (id, source, size, digest) rows, in
which equal rows collapse; shards hold about ``shard_tokens`` words and are dealt by
a hash of id and text, so a source, an id or a text with a third of all rows lies in
many of them.  A shard's blocks are never listed: how many chosen ones lie before a
word is a closed formula, so a document's length does not matter.  Rows by shard are
summed in two levels; only rows by source meet in one task.  Whole documents are
settled on such rows, a shard's as one array, and joined with their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, word_count

SEED = "mix-1"
#: Blocks that the smallest target has at least, unless blocks are single words already.
LEAST_BLOCKS = 64
#: Shards whose blocks are added up in one task.
SHARDS_AT_ONCE = 4096
#: Documents whose copies are appended at a time, so that arrays are not copied for each.
CHUNK = 256


def water_levels(totals: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """Adds ``weight`` and ``target`` to (source, source_size): shares of the sum
    of all sizes by weight, none above ``cap`` times its source's size, the
    excess reshared by weight.

    Sorted by cap over weight, the capped sources are a prefix, so running sums
    replace the rounds of resharing."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    t = totals.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_ratio = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    upto = by_ratio.rowsBetween(W.unboundedPreceding, 0)
    all_rows = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0.0)
    t = t.withColumn("total", F.sum(F.col("source_size").cast("double")).over(all_rows)).withColumn("weights", F.sum("weight").over(all_rows))
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), zero)) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), zero))
    t = t.withColumn("above", (F.col("most") < F.col("weight") * level).cast("int"))
    t = t.withColumn("capped", F.min("above").over(upto) == 1)
    open_total = F.col("total") - F.sum(F.when(F.col("capped"), F.col("most")).otherwise(zero)).over(all_rows)
    open_weight = F.sum(F.when(F.col("capped"), zero).otherwise(F.col("weight"))).over(all_rows)
    shared = F.col("weight") * open_total / F.when(open_weight > 0, open_weight)
    target = F.when(F.col("capped"), F.col("most")).otherwise(F.coalesce(shared, zero))
    return t.withColumn("target", F.least(target, F.col("most"))).drop("above", "capped", "total", "weights")


def apportion(sources: DataFrame, block_tokens: int) -> DataFrame:
    """Adds ``block``, the words of a block, and ``blocks``: all blocks (the sum of
    targets over ``block``) given to sources by the highest quotients
    target / (2 j + 1).

    Rounding target / block is the allocation of the divisor ``block``; the few
    blocks by which it misses the house size are then added at the highest open
    quotients or taken back at the lowest won ones."""
    all_rows = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(all_rows)
    block = F.greatest(F.lit(1), F.least(F.lit(block_tokens), F.floor(least / LEAST_BLOCKS))).cast("long")
    sources = sources.withColumn("block", block)
    first = F.floor(F.col("target") / F.col("block") + 0.5).cast("long")
    s = sources.withColumns({"first": first, "rank": F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))})
    house = F.floor(F.sum("target").over(all_rows) / F.col("block") + 0.5).cast("long")
    s = s.withColumn("lack", house - F.sum("first").over(all_rows))
    # |lack| candidates a source are enough for any outcome; |lack| is at most half the number of sources
    steps = F.sequence(F.lit(1), F.greatest(F.abs("lack"), F.lit(1)).cast("int"))
    c = s.select("source", "target", "rank", "first", "lack", F.explode(steps).alias("step")).filter((F.col("lack") > 0) | ((F.col("lack") < 0) & (F.col("first") >= F.col("step"))))
    quotient = F.col("target") / F.when(F.col("lack") > 0, 2 * (F.col("first") + F.col("step")) - 1).otherwise(2 * (F.col("first") - F.col("step")) + 1)
    c = c.withColumn("quotient", quotient)
    best = F.when(F.col("lack") > 0, -F.col("quotient")).otherwise(F.col("quotient"))
    # on ties the earlier source wins
    place = F.row_number().over(W.orderBy(best, F.when(F.col("lack") > 0, F.col("rank")).otherwise(-F.col("rank")), F.col("step")))
    moved = c.withColumn("place", place).filter(F.col("place") <= F.abs("lack")).groupBy("source").agg(F.sum(F.signum("lack").cast("long")).alias("moved"))
    moved = moved.withColumnRenamed("source", "moved_source")
    joined = s.join(moved, s["source"].eqNullSafe(moved["moved_source"]), "left")
    return joined.withColumn("blocks", F.col("first") + F.coalesce("moved", F.lit(0))).drop("first", "rank", "lack", "moved", "moved_source")


def _sum_before(rows: DataFrame, value: str, keys: list[str], at: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of equal ``keys`` with a smaller ``at``
    (no two are equal), in two levels of at most ``SHARDS_AT_ONCE`` rows a task."""
    part = rows.withColumn("_part", F.floor(F.col(at) / SHARDS_AT_ONCE))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = part.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    parts = parts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_of"), "_before")
    match = F.col("_part") == F.col("_of")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inner = W.partitionBy(*keys, "_part").orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    return part.join(parts, match).withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_part", "_of", "_before", *[f"_{k}" for k in keys])


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for every row of
    ``docs`` (doc_id, text, source)."""
    parts, sized, sources = _mix(docs, **options)
    # equal rows share what their group takes: the first ones have a word more
    every = F.col("words_taken") - F.pmod(F.col("words_taken"), F.col("copies"))
    each = F.when(F.col("nth") <= F.pmod(F.col("words_taken"), F.col("copies")), 1).otherwise(0) + F.floor(every / F.col("copies"))
    rows = parts.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).withColumn("taken", each.cast("long"))
    blank = sized.filter("size = 0").select("doc_id", "size", "source").join(_renamed(sources), F.col("source").eqNullSafe(F.col("plan_source")))
    names = ("doc_id", "size", "source_size", "target", "taken", "source")
    return rows.select(*names).unionByName(blank.withColumn("taken", F.lit(0).cast("long")).select(*names))


def _renamed(sources: DataFrame) -> DataFrame:
    return sources.select(F.col("source").alias("plan_source"), "source_size", "target", "block", "blocks")


def _mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    block_tokens: int = 16,
    shard_tokens: int = 65536,
    seed: str = SEED,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, sizes, sources).  A group is ``copies`` equal rows of one shard, with
    the words taken of them together (``words_taken``), how often all of the shard is
    taken (``whole``) and a seeded ``dither`` of 0 to 1.

    A shard's stream of words, in seeded order, is cut into equal blocks; the
    shard's integer quota takes every block ``quota // n`` times and ``quota % n``
    blocks, evenly spread from a seeded start, once more.  A document takes the words
    of it that lie in taken blocks."""
    tag = F.when(F.col("text").isNotNull(), F.md5("text"))
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), tag.alias("tag")), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = materialise(apportion(water_levels(totals, weights, cap), block_tokens), "sources")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens)).cast("long").alias("shards")
    equal = sized.filter("size > 0").groupBy("source", "doc_id", "tag").agg(F.first("size").alias("size"), F.count("*").alias("together"))
    rows = equal.join(_renamed(sources).select("*", shards), F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    # so many equal rows that they are more than a shard are several groups
    most = F.greatest(F.lit(1), F.floor(F.lit(shard_tokens) / F.col("size"))).cast("long")
    rows = rows.withColumn("most", most).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("together") - 1) / F.col("most")))))
    rows = rows.withColumn("copies", F.least(F.col("most"), F.col("together") - F.col("chunk") * F.col("most"))).drop("most", "together")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "tag", F.lit(":"), F.col("chunk").cast("string")))
    rows = rows.withColumn("digest", digest)
    number = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    rows = rows.withColumns({"shard": number("digest", 1) % F.col("shards"), "words": F.col("size") * F.col("copies")})
    # blocks of shards, and the shares of the source's blocks that end in each
    length = rows.groupBy("source", "shard").agg(F.sum("words").alias("length"), F.first("block").alias("block"), F.first("blocks").alias("blocks"))
    length = materialise(length.withColumn("n", F.ceil(F.col("length") / F.col("block")).cast("long")), "shards")
    every = length.groupBy(F.col("source").alias("of")).agg(F.sum("n").alias("n_all"))
    quotas = _sum_before(length, "n", ["source"], "shard", "before").join(every, F.col("source").eqNullSafe(F.col("of")))
    upto = lambda c: f"(cast(least(blocks, {int(cap)} * n_all) as decimal(19,0)) * cast({c} as decimal(19,0))) div cast(n_all as decimal(19,0))"
    quota = F.least(F.expr(upto("before + n")) - F.expr(upto("before")), cap * F.col("n"))
    start = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("\x00")), F.lit("/"), F.col("shard").cast("string")))
    quotas = quotas.select(F.col("source").alias("of"), F.col("shard").alias("at"), "n", quota.cast("long").alias("quota"), (number(start, 1) % F.col("n")).alias("turn"))
    rows = rows.join(quotas, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("at"))).drop("of", "at")
    order = W.partitionBy("source", "shard").orderBy("digest", "doc_id", "tag").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("words").over(order)).withColumns({"since": F.col("upto") - F.col("words"), "more": F.col("quota") % F.col("n")})
    # chosen blocks before block i are chosen(i) - chosen(0); block i is one when chosen(i + 1) differs
    chosen = lambda i: f"((cast({i} + turn as decimal(19,0)) * cast(more as decimal(19,0))) div cast(n as decimal(19,0)))"
    at = lambda x: f"({x} div block)"
    before = lambda x: F.expr(f"block * {chosen(at(x))} + ({chosen(at(x) + ' + 1')} - {chosen(at(x))}) * ({x} % block)")
    whole = F.floor(F.col("quota") / F.col("n")).cast("long")
    taken = whole * F.col("words") + before("upto") - before("since")
    dither = (number("digest", 17) + 0.5) / float(1 << 32)
    names = ("doc_id", "tag", "size", "copies", "source_size", "target", "source", "shard")
    return rows.select(*names, taken.cast("long").alias("words_taken"), whole.alias("whole"), dither.alias("dither")), sized, sources


def round_with_carry(rows: Column) -> Column:
    """How often each of a shard's ``rows`` (size, whole, taken, dither) is taken, in
    their order: ``whole`` times, and once more where its other words taken and those
    carried from the rows before reach its dither's share of its size.  What is over or
    lacking is carried on."""
    start = lambda carry: F.struct(carry.alias("carry"), F.array().cast("array<bigint>").alias("times"))

    def one(x: Column, row: Column) -> Column:
        due = x["carry"] + row["taken"] - row["whole"] * row["size"]
        more = F.when(due >= row["dither"] * row["size"], F.lit(1)).otherwise(F.lit(0)).cast("long")
        return F.struct((due - more * row["size"]).alias("carry"), F.concat(x["times"], F.array(row["whole"] + more)).alias("times"))

    def chunk(x: Column, at: Column) -> Column:
        join = lambda y: F.struct(y["carry"].alias("carry"), F.concat(x["times"], y["times"]).alias("times"))
        return F.aggregate(F.slice(rows, at, F.lit(CHUNK)), start(x["carry"]), one, join)

    return F.aggregate(F.sequence(F.lit(1), F.size(rows), F.lit(CHUNK)), start(F.lit(0).cast("long")), chunk, lambda x: x["times"])


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The mix as whole documents with the columns of ``docs``: each as often as
    all of its shard is taken, or once more.

    Which ones is settled by rounding with carry, from a shard's longest document to
    its shortest, so the words of a shard come to the words taken of it but for about
    a short document.  Rows that share source, id and text are taken equally often."""
    names = {k: f"_tidemark_{k}" for k in ("id", "source", "tag", "times", "copy")}
    groups, *_ = _mix(docs, **options)
    own = groups.groupBy("source", "doc_id", "tag").agg(F.min("shard").alias("shard"), F.sum(F.col("size") * F.col("copies")).alias("size"), F.sum("words_taken").alias("taken"), F.max("whole").alias("whole"), F.max("dither").alias("dither"))
    row = F.struct((-F.col("size")).alias("order"), "dither", "doc_id", "tag", "size", "taken", "whole")
    shards = own.groupBy("source", "shard").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    settled = shards.select("source", F.explode(F.arrays_zip("rows", round_with_carry(F.col("rows")).alias("times"))).alias("one"))
    counts = settled.select(F.col("one.rows.doc_id").alias(names["id"]), F.col("one.rows.tag").alias(names["tag"]), F.col("source").alias(names["source"]), F.col("one.times").alias(names["times"]))
    counts = counts.filter(F.col(names["times"]) > 0)
    same = docs["doc_id"].eqNullSafe(F.col(names["id"])) & docs["source"].eqNullSafe(F.col(names["source"])) & (F.md5(docs["text"]) == F.col(names["tag"]))
    out = docs.join(counts, same)
    return out.withColumn(names["copy"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(names["times"])))).select(*docs.columns)
