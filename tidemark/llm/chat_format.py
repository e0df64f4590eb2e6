"""Chat formatting of typed content parts.

A visitor over a turn's parts flattens text, image, audio and document parts into
ordered placeholders; attachments keep their reference, place and token count.
Turns are marked by control strings, and control strings inside texts are escaped
reversibly, so the formatted string alone gives back every turn.  DataFrame
functions only.

Escapes: ``~`` becomes ``~0`` and ``<|`` becomes ``~1``; undone in the opposite
order.  So ``<|`` in the output is always one of the template's own marks.

Defined results: null text or role counts as empty; a conversation without rows
does not exist; a null conversation is one of its own; a null turn comes first;
rows of equal turn are ordered by role and text (as they are, not as escaped),
repeated rows are kept; a part of unknown type becomes a ``document`` placeholder;
extra columns are ignored.

Scale: one shuffle by conversation, for the places of turns and for the string
alike; a conversation is one output string, so its turns meet in one task by
definition.  Places are running sums, so the work grows in proportion to the turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: The element type of a turn's ``parts``.
PART = "struct<type:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"
#: Tokens of attachments: an image tile of 28 x 28 pixels, audio frames a second, a document's page.
TILE, FRAMES, PAGE_TOKENS = 28, 25, 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("~"), F.lit("~0")), F.lit("<|"), F.lit("~1"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~1"), F.lit("<|")), F.lit("~0"), F.lit("~"))


def escape_role(role: Column) -> Column:
    """As texts, and a line feed, which ends the role, becomes ``~2``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("~2"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("~2"), F.lit("\n")))


def part_tokens(part: Column) -> Column:
    """Tokens that an attachment's placeholder expands to; 0 for text."""
    tiles = F.ceil(F.coalesce(part["width"], F.lit(0)) / TILE) * F.ceil(F.coalesce(part["height"], F.lit(0)) / TILE)
    return (
        F.when(part["type"] == "text", F.lit(0))
        .when(part["type"] == "image", F.greatest(F.lit(1), tiles))
        .when(part["type"] == "audio", F.greatest(F.lit(1), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * FRAMES)))
        .otherwise(F.greatest(F.lit(1), F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS))
        .cast("long")
    )


def placeholder(part: Column, index: Column) -> Column:
    """How the visitor writes one part: text escaped, else a numbered mark."""
    kind = F.when(part["type"].isin("image", "audio"), part["type"]).otherwise(F.lit("document"))
    return F.when(part["type"] == "text", escape(part["text"])).otherwise(F.concat(F.lit("<|"), kind, F.lit(":"), index.cast("string"), F.lit("|>")))


def text_parts(text: Column) -> Column:
    """A single text part."""
    values = {"type": F.lit("text"), "text": text}
    fields = [f.split(":") for f in PART[7:-1].split(",")]
    return F.array(F.struct(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields]))


def format_chats(turns: DataFrame) -> DataFrame:
    """``turns``: conv_id, turn, role, parts (array of :data:`PART`).

    Returns conv_id, formatted, loss_spans (in code points, one for each assistant
    text: [start, end) in the string, and the place ``turn`` of its turn and where
    that begins), attachments (array of turn, part, type, ref, tokens in output
    order) and expanded_tokens (their sum)."""
    parts = F.coalesce(F.col("parts"), F.expr(f"cast(array() as array<{PART}>)"))
    known = F.transform(parts, lambda p, i: F.struct(F.col("turn").alias("turn"), i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "").alias("plain"), F.array_join(F.transform(parts, placeholder), "").alias("body"),
        F.filter(known, lambda a: ~a["type"].eqNullSafe("text")).alias("known"),
    )
    rows = rows.withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))).withColumn("whole", F.concat("head", "body", F.lit(END + "\n")))
    by_turn = W.partitionBy("conv_id").orderBy("turn", "role", "plain", "body", "known")
    rows = rows.select(
        "conv_id", F.row_number().over(by_turn).alias("place"), (F.sum(F.length("whole")).over(by_turn.rowsBetween(W.unboundedPreceding, 0)) - F.length("whole")).alias("at"),
        F.length("head").alias("skip"), F.length("body").alias("size"), (F.col("role") == "assistant").alias("loss"), "whole", "known",
    )
    row = F.struct("place", "at", "skip", "size", "loss", "whole", "known")
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    begin = lambda r: (r["at"] + r["skip"]).cast("long")
    span = lambda r: F.struct(begin(r).alias("start"), (begin(r) + r["size"]).alias("end"), (r["place"] - 1).alias("turn"), r["at"].alias("turn_start"))
    spans = F.transform(F.filter("rows", lambda r: r["loss"]), span)
    attachments = F.flatten(F.transform("rows", lambda r: r["known"]))
    out = chats.select("conv_id", F.array_join(F.transform("rows", lambda r: r["whole"]), "").alias("formatted"), spans.alias("loss_spans"), attachments.alias("attachments"))
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"])
    return out.withColumn("expanded_tokens", tokens)


def read_back(chats: DataFrame) -> DataFrame:
    """Turns and loss text taken from ``formatted`` and ``loss_spans`` alone:
    adds turns (array of role, text) and loss_texts (array of string).

    The string is cut into its turns once; a span is then taken from its own turn,
    so the work is in proportion to the string."""
    pieces = F.split(F.col("formatted"), r"<\|im_end\|>\n")
    cut = chats.withColumn("_pieces", F.slice(pieces, 1, F.size(pieces) - 1))  # nothing stands behind the last mark
    inner = F.transform("_pieces", lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)))
    turns = F.transform(
        inner,
        lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substring(p, F.locate("\n", p) + 1, F.length(p))).alias("text")),
    )
    part = lambda s: F.substring(F.get(F.col("_pieces"), s["turn"]), (s["start"] - s["turn_start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    loss = F.transform("loss_spans", lambda s: unescape(part(s)))
    return cut.withColumns({"turns": turns, "loss_texts": loss}).drop("_pieces")
