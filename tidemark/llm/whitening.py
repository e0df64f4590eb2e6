"""Whitening of embeddings by a distributed singular value decomposition.

Entries become whole numbers, ``floor(256 * c)``.  The model is fitted on every distinct
vector of these once: its exact sums give the centre, the centred rows go as a distributed
matrix to MLlib's ``computeSVD``, whose singular values, squared and divided by the number
of vectors, are the variances along its right singular vectors.  The total variance comes
apart from it, from exact squared deviations in whole numbers.

Defined results: vectors that are null or hold null or non-finite entries are dropped;
entries beyond the range of a long are its ends; a vector shorter than the longest (an
empty one too) has zeros for the entries it lacks; repeated rows count once in the fit and
each get their results; components of equal variance come as the decomposition gives them,
each turned so that its largest entry is positive; components without variance (fewer
distinct vectors or dimensions than asked for; below 1e-14 of the largest, double precision
can't tell it from none) have no rows, so one distinct vector, vectors
without dimensions and empty tables give none; a deviation beyond a long is null; extra
columns are ignored.

Scale: whole vectors are shuffled once, to be told apart, after partial aggregation, so a
vector that a third of the rows share is no hot key.  Sums combine before the shuffle.
The Gram matrix of dimension by dimension is summed in a tree and decomposed on the driver,
which bounds the dimension (15,000 is MLlib's own bound), never the rows.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from tidemark.llm.common import materialise

COMPONENTS, SCALE = 4, 256.0
#: Singular values below this share of the largest are none: their squares are rounding errors of the Gram matrix.
LEAST = 1e-7
#: Up to this, entries, products and sums of a batch stay whole in 64 bits; beyond, Python's integers take over.
_PLAIN = 1 << 20
_LONG = (1 << 63) - 1


def integers(vectors: DataFrame, dimension: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, x) of the vectors without null and non-finite entries; x: bytes of longs."""
    schema = StructType([vectors.schema[key], StructField("x", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lengths = np.array([len(v) if v.is_valid else -1 for v in lists], np.int64)
            flat = lists.flatten()
            flat = np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan, flat.to_numpy(zero_copy_only=False)) if flat.null_count else flat.to_numpy(zero_copy_only=False)
            flat = flat.astype(np.float64)
            there = np.flatnonzero(lengths >= 0)
            size = lengths[there]
            row = np.repeat(np.arange(len(there)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            fine = np.bincount(row, weights=~np.isfinite(flat), minlength=len(there)) == 0
            scaled = np.floor(SCALE * np.where(np.isfinite(flat), flat, 0.0))
            high, low = scaled >= 2.0**63, scaled < -(2.0**63)
            whole = np.where(high | low, 0.0, scaled).astype(np.int64)
            whole[high], whole[low] = _LONG, -_LONG - 1
            x = np.zeros((len(there), dimension), "<i8")
            x[row, place] = whole
            keys = batch.column(0).take(pa.array(there[fine]))
            yield pa.RecordBatch.from_arrays([keys, pa.array([r.tobytes() for r in x[fine]], pa.binary())], names=[key, "x"])

    return vectors.select(key, column).mapInArrow(run, schema)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dimension)


def _exact(x: np.ndarray) -> np.ndarray:
    """``x`` as numbers of which products and sums stay exact."""
    return x if not x.size or (x.max() <= _PLAIN and x.min() >= -_PLAIN) else x.astype(object)


def _sums(fit: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """Number of the fit's vectors, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dimension, 0
        for batch in batches:
            x = _exact(_matrix(batch.column(0), dimension))
            total, n = [a + int(b) for a, b in zip(total, x.sum(axis=0), strict=True)], n + len(x)
        with decimal.localcontext() as context:
            context.prec = 38
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(dimension)], pa.int32()), pa.array([Decimal(v) for v in (n, *total)], pa.decimal128(38, 0))], names=["dim", "s"])

    got = dict(fit.select("x").mapInArrow(run, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s")).collect())
    return int(got.get(-1, 0)), [int(got.get(k, 0)) for k in range(dimension)]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Of each row, the sum over dimensions of (n * x - S)**2, as Python's integers."""
    x = _exact(x)
    most = max((abs(s) for s in sums), default=0)
    squares = (x * x).sum(axis=1)
    inner = x @ np.array(sums, np.int64) if x.dtype != object and most * _PLAIN * max(len(sums), 1) < _LONG else (x.astype(object) * np.array(sums, object)).sum(axis=1)
    return n * n * squares.astype(object) - 2 * n * np.asarray(inner, object) + sum(s * s for s in sums)


def fit(distinct: DataFrame, dimension: int, components: int = COMPONENTS) -> dict | None:
    """Centre, directions (dimension by component), variances and total variance of the
    distinct vectors (x); none where these have no variance."""
    n, sums = _sums(distinct, dimension)
    if n < 2 or not dimension:
        return None
    centre = np.array([float(s) / n for s in sums])

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _matrix(batch.column(0), dimension) - centre
            at = np.arange(0, c.size + 1, dimension, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at), pa.array(c.ravel()))], names=["row"])

    rows = distinct.select("x").mapInArrow(centred, "row array<double>").select(array_to_vector("row").alias("row"))
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "row"), n, dimension)
    found = matrix.computeSVD(dimension, computeU=False, rCond=LEAST)  # all of them: decomposed whole, not iterated
    variances = np.asarray(found.s.toArray()) ** 2 / n
    directions = np.asarray(found.V.toArray())[:, : len(variances)]
    variances, directions = variances[:components], directions[:, :components]
    directions = directions * np.where(directions[np.abs(directions).argmax(axis=0), np.arange(directions.shape[1])] < 0, -1.0, 1.0)

    def deviate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float(sum(_deviations(_matrix(batch.column(0), dimension), n, sums)))])], names=["d"])

    total = distinct.select("x").mapInArrow(deviate, "d double").agg(F.sum("d")).first()[0]
    return {"n": n, "sums": sums, "centre": centre, "directions": directions, "variances": variances, "total": total / float(n) ** 3} if len(variances) else None


def _whiten(x: np.ndarray, model: dict) -> np.ndarray:
    return (x - model["centre"]) @ model["directions"] / np.sqrt(model["variances"])


def identity_error(distinct: DataFrame, model: dict) -> float:
    """The largest entry, by size, of the covariance of the whitened fit less the identity."""
    dimension, k = len(model["centre"]), len(model["variances"])

    def gathered(of, schema: str, names: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                total = total + of(_whiten(_matrix(batch.column(0), dimension), model))
            if np.ndim(total):
                at = np.indices(np.shape(total)).reshape(np.ndim(total), -1)
                yield pa.RecordBatch.from_arrays([*(pa.array(a, pa.int32()) for a in at), pa.array(total.ravel())], names=[*names, "v"])

        return distinct.select("x").mapInArrow(run, schema).groupBy(*names).agg(F.sum("v").alias("v"))

    mean = np.zeros(k)
    for r in gathered(lambda w: w.sum(axis=0), "i int, v double", ["i"]).collect():
        mean[r["i"]] = r["v"] / model["n"]
    covariance = np.zeros((k, k))
    for r in gathered(lambda w: (w - mean).T @ (w - mean), "i int, j int, v double", ["i", "j"]).collect():
        covariance[r["i"], r["j"]] = r["v"] / model["n"]
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, *, components: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each
    remaining vector and component."""
    out = StructType([vectors.schema[key], StructField("component", IntegerType())])
    out = StructType([*out, *(StructField(c, LongType()) for c in ("n", "deviation")), *(StructField(c, DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    dimension = vectors.agg(F.max(F.size(column))).first()[0] or 0
    rows = integers(vectors, max(dimension, 0), key, column)
    distinct = materialise(rows.select("x").distinct(), "fit")
    model = fit(distinct, dimension, components) if dimension > 0 else None
    if model is None:
        return vectors.sparkSession.createDataFrame([], out)
    error, k = identity_error(distinct, model), len(model["variances"])
    explained = model["variances"] / model["total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dimension)
            of = np.repeat(np.arange(len(x)), k)
            deviation = [int(d) if d <= _LONG else None for d in _deviations(x, model["n"], model["sums"])]
            columns = [
                batch.column(0).take(pa.array(of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(of), model["n"], np.int64)),
                pa.array(deviation, pa.int64()).take(pa.array(of)), pa.array(_whiten(x, model).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(of), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out])

    return rows.mapInArrow(run, out)
