"""Quality rules with risk-controlled thresholds.

Each rule is a statistic of a text that speaks against it when large (or when
small).  For every stratum (a language) and rule, cutoffs from a fixed grid are
tried on labelled holdouts: the exact (Clopper-Pearson) upper bound on the share
of good documents rejected must stay under the rule's risk.  Cutoffs are tested in
a fixed order, from loose to strict, up to the first that fails, which needs no
correction within a rule; the error level is divided by rules and strata
(Bonferroni).  So with probability ``1 - delta`` no chosen cutoff rejects more good
documents of its stratum than its risk; the rules' risks add up to ``risk``.  Of the
cutoffs that pass, a stricter one is taken only where what it rejects beyond the
looser one is bad documents, at least ``GAIN`` for each good one; where none passes,
the rule stays silent.

Statistics are made in one map over whole texts, exactly: words are interned to
integers, windows of three are packed without hashing.

Defined results: null text counts as empty: all statistics 0, base failed; strata
without labels, and null languages unless labelled, have no active rules; rows
repeated give equal results; of labels that contradict one another the bad one counts;
a row is kept or not by its own stratum, null and empty languages being two; extra
columns are ignored.

Scale: no shuffle of texts.  The holdout counts are grouped per (stratum, rule,
cutoff), a few thousand rows; thresholds come back as a table with one row per
stratum, joined by Spark (broadcast where it is small).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of good documents of a stratum that all rules together may reject, and
#: the probability that this fails.
RISK, DELTA = 0.05, 0.05
#: Bad documents that a stricter cutoff must reject for each good one.
GAIN = 20
SYMBOLS = "#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_distinct long, n_letters long"

#: Rules: name, SQL of the statistic, grid of cutoffs from strict to loose; a text
#: is rejected when the statistic is at least the cutoff.
GRID = tuple(round(x, 4) for x in (0.02, 0.03, 0.05, 0.075, 0.1, 0.125, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95))
RULES = (
    ("symbols", "n_symbols / greatest(n_words, 1)", GRID),
    ("repeats", "n_repeat_words / greatest(n_words, 1)", GRID),
    ("upper", "n_upper / greatest(n_letters, 1)", GRID),
    ("dup_lines", "n_dup_lines / greatest(n_words, 1)", GRID),
    ("poor_words", "1 - n_distinct / greatest(n_words, 1)", GRID),
)


def text_stats(text: str | None) -> tuple[int, ...]:
    """The statistics of :data:`STATS` for one whole text."""
    if not text:
        return (0,) * 8
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    dup = 0
    if "\n" in text:
        seen: set[str] = set()
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif line.strip(" \t\x0b\x0c\r"):
                seen.add(line)
    ids: dict[bytes, int] = {}
    number = [ids.setdefault(w, len(ids)) for w in words]
    repeat = 0
    if n >= 4 and len(ids) < n:
        repeat = repeated_words(np.array(number, np.int64), len(ids))
    data = np.frombuffer(raw, np.uint8)
    upper = int(((data >= 65) & (data <= 90)).sum())
    low = int(((data >= 97) & (data <= 122)).sum())
    return n, len(text) - blanks, symbols, dup, repeat, upper, len(ids), upper + low


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a window of three found twice or more."""
    if distinct < 1 << 21:
        key = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:  # packed in two steps, still exact
        pair = np.unique(ids[:-2] * distinct + ids[1:-1], return_inverse=True)[1]
        key = pair.astype(np.int64) * distinct + ids[2:]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(ids), bool)
    for k in range(3):
        cover[k : k + len(key)] |= twice
    return int(cover.sum())


def with_stats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The ``keep`` columns and the statistics of every whole ``text``."""
    kept = docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), F.col("text"))
    names = [s.split()[0] for s in STATS.split(", ")]
    schema = f"kept {kept.schema['kept'].dataType.simpleString()}, {STATS}"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = np.array([text_stats(t.as_py()) for t in batch.column(1)], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(got[:, k]) for k in range(got.shape[1])]], names=["kept", *names])

    return kept.mapInArrow(measure, schema).select("kept.*", *names)


def binomial_below(rejected: int, total: int, share: float) -> float:
    """Probability that at most ``rejected`` of ``total`` are rejected where each is
    with the chance ``share``: terms from the last one on until they no longer count."""
    if rejected >= total:
        return 1.0
    if rejected > total * share:  # the other tail is the short one
        return 1.0 - binomial_below(total - rejected - 1, total, 1.0 - share)
    i = rejected
    term = math.exp(math.lgamma(total + 1) - math.lgamma(i + 1) - math.lgamma(total - i + 1) + i * math.log(share) + (total - i) * math.log1p(-share))
    out = 0.0
    while i >= 0 and term > out * 1e-17:
        out += term
        term *= i * (1 - share) / ((total - i + 1) * share)
        i -= 1
    return min(out, 1.0)


def binomial_upper(rejected: int, total: int, level: float) -> float:
    """Exact one-sided upper bound on a share: the largest p under which at most
    ``rejected`` of ``total`` has a probability of ``level`` or more."""
    if total == 0 or rejected >= total:
        return 1.0
    lo, hi = rejected / total or 1e-12, 1.0 - 1e-12
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_below(rejected, total, mid) > level else (lo, mid)
    return hi


def holds(rejected: int, total: int, share: float, level: float) -> bool:
    """Whether the exact upper bound at ``level`` is ``share`` at most; the same as
    ``binomial_upper(rejected, total, level) <= share``, without looking for the bound."""
    return 0 < total and rejected < total and binomial_below(rejected, total, share) <= level


def choose_cutoff(good: list[int], bad: list[int], allowed: float, level: float, grid: tuple[float, ...] = GRID, gain: int = GAIN) -> float | None:
    """The cutoff for one rule and stratum from counts of values by how many cutoffs
    of the ``grid`` (strict to loose) they reach; null where the rule stays silent."""
    total, rejected = sum(good), 0
    cutoff, new_bad, new_good = None, 0, 0
    for k in range(len(grid) - 1, -1, -1):  # from loose to strict; a cutoff at index k rejects values that reach more than k
        rejected += good[k + 1]
        if not holds(rejected, total, allowed, level):
            break
        new_bad, new_good = new_bad + bad[k + 1], new_good + good[k + 1]
        if new_bad and new_bad >= gain * new_good:
            cutoff, new_bad, new_good = grid[k], 0, 0
    return cutoff


def stratum() -> Column:
    """The stratum of a row: its language; null and empty ones are strata of their own."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null"))


def thresholds(measured: DataFrame, labels: DataFrame, *, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per stratum: stratum and a cutoff column for each rule (null:
    silent), from ``measured`` (doc_id, lang, statistics) and ``labels`` (doc_id,
    quality)."""
    marks = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = measured.join(marks, "doc_id").withColumn("stratum", stratum())
    parts = F.array(*[F.struct(F.lit(name).alias("rule"), F.expr(sql).cast("double").alias("value")) for name, sql, _ in RULES])
    rows = held.select("stratum", "quality", F.explode(parts).alias("part"))
    # how many grid cutoffs a value reaches; counts per step make cumulative counts
    reached = F.size(F.filter(F.array(*[F.lit(float(g)) for g in GRID]), lambda g: F.col("part.value") >= g))
    steps = rows.groupBy("stratum", F.col("part.rule").alias("rule"), reached.alias("reached")).agg(
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")
    )
    strata = max(1, held.select("stratum").distinct().count())
    level = delta / (strata * len(RULES))
    allowed = risk / len(RULES)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        good, bad = [0] * (len(GRID) + 1), [0] * (len(GRID) + 1)
        for r in pdf.itertuples():
            good[r.reached] += int(r.good)
            bad[r.reached] += int(r.bad)
        cutoff = choose_cutoff(good, bad, allowed, level)
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]], "rule": [pdf["rule"].iloc[0]], "cutoff": pd.array([cutoff], dtype="Float64")})

    chosen = steps.groupBy("stratum", "rule").applyInPandas(choose, "stratum string, rule string, cutoff double")
    return chosen.groupBy("stratum").pivot("rule", [r[0] for r in RULES]).agg(F.first("cutoff"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds base_failed and kept to measured rows."""
    rows = measured.withColumn("rule_stratum", stratum())
    joined = rows.join(cutoffs.withColumnRenamed("stratum", "rule_stratum"), "rule_stratum", "left")
    hit = F.lit(False)
    for name, sql, _ in RULES:
        hit = hit | F.coalesce(F.expr(sql).cast("double") >= F.col(name), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~hit).drop("rule_stratum", *[r[0] for r in RULES])
