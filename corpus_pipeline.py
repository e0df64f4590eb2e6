"""The training-data pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes
each result as Parquet to the shared folder, reads it back for the next stage, and
removes what the stage before left.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_id, mixing, ngram_join, packing
from tidemark.llm.common import materialise, release, scratch_scope


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without letters.
    Where the label is missing, the predicted language becomes it.

    Without any labelled document the model is empty and only texts without letters
    go.  Each row is judged by itself: ids may be null or equal, repeated rows stay
    repeated, ties between languages fall to the one first by name."""
    model = language_id.fit(docs)
    if not model["langs"]:
        return docs.filter(F.col("text").rlike(r"[\p{L}\p{M}]"))
    rest = F.struct(*[F.col(c) for c in docs.columns if c != "text"])
    found = language_id.identify(docs.select(rest.alias("rest"), "text"), model, keep=("rest",), spans=False, with_text=True)
    kept = found.filter(F.col("lang_pred") != language_id.UNKNOWN)
    whole = {"text": F.col("text"), "lang": F.coalesce(F.col("rest.lang"), F.col("lang_pred"))}
    return kept.select(*[whole.get(c, F.col(f"rest.{c}")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least id, null ids
    last; of equal ids that of the least text name; one of rows that repeat.  Texts
    are what is compared, so unlike texts of one id are documents of their own.  Null
    texts, if any came so far, stay; texts without words go with their exact copies."""
    return ngram_join.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found.  Each row is judged by its own
    text, whatever its id; null and empty texts stay, repeated rows stay or go
    together."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.  A null source is one of
    its own; texts without words are not taken; rows of equal source, id and text are
    taken equally often; ids may be null."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids.  Rows that repeat are packed as often as they occur,
    null and empty texts are a lone end token."""
    return packing.pack(docs, packing.load_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", languages),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_leaks),
    ("mix_sources", mix),
    ("token_packing", tokens),
]

#: The models of stages 1 to 3 and the tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        written: list[DataFrame] = []
        with scratch_scope(written):  # what a stage wrote on its way goes when its result is written
            written.append(materialise(stage(spark, docs, sf_dir), name))
        release(docs)
        docs = written[0]
    return STAGES[-1][1](spark, docs, sf_dir)
