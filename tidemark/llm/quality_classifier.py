"""Quality classification by compression.

Two Zstandard dictionaries are built, from good and from bad labelled text.  A
text, in pieces of ``PIECE_BYTES``, is compressed with each of them; the difference
of the compressed sizes, divided by the text's size, is all that its score is made
from: an isotonic curve calibrates it to the probability that the label is 1.

Defined results: null and empty texts get the calibrated score of no difference;
with no labels the score is 0.5, with one class a constant near it; repeated rows
get equal scores; labels that name no document or are null do not count, of those
that contradict one another the bad one does; extra columns are ignored.

Scale: dictionaries and calibration are fitted on a bounded, hash-chosen sample of
labelled rows (``rows`` a class, ``PIECES`` pieces of each text for the
dictionaries); scoring maps over whole texts without a shuffle.  The broadcast
model is two dictionaries of ``DICT_BYTES`` and a curve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.calibration import apply_isotonic, fit_isotonic
from tidemark.llm.common import labelled_sample

#: Labelled rows a class that the model is fitted on, pieces a row that go into
#: the dictionaries, size of a dictionary and of a piece.
ROWS, PIECES, DICT_BYTES, PIECE_BYTES = 3000, 4, 1 << 15, 512
LEVEL = 3


def pieces(text: str | None, size: int = PIECE_BYTES) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + size] for i in range(0, len(raw), size)]


class Scorer:
    """Compressors of a model, made once a task."""

    def __init__(self, model: dict) -> None:
        self.model = model
        options = {"level": LEVEL, "write_checksum": False, "write_content_size": False}
        self.by = []
        for raw in model["dicts"]:
            if raw:
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=LEVEL)
                self.by.append(zstandard.ZstdCompressor(dict_data=d, write_dict_id=False, **options))
            else:
                self.by.append(zstandard.ZstdCompressor(**options))

    def difference(self, text: str | None) -> float:
        """Bytes that the bad dictionary needs beyond the good one, a byte of text."""
        parts = pieces(text)
        if not parts:
            return 0.0
        good, bad = (sum(len(c.compress(p)) for p in parts) for c in self.by)
        return (bad - good) / sum(map(len, parts))

    def score(self, texts: list[str | None]) -> np.ndarray:
        return apply_isotonic(self.model["calibration"], np.array([self.difference(t) for t in texts], float))


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A Zstandard dictionary; samples too few to train on become its content."""
    samples = [s for s in samples if s]
    total = sum(map(len, samples))
    if not total:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 8)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> dict:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality).

    Half of the sample (by hash) builds the dictionaries, the other half, which
    they have not seen, calibrates."""
    sample, counts = labelled_sample(docs, labels, "quality", rows, F.min)
    sample = sample.select("label", "text", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 0).alias("builds"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"label": [], "piece": []}
            for q, text, builds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if builds:
                    parts = pieces(text)
                    step = max(1, len(parts) // PIECES)
                    own = parts[::step][:PIECES]
                    out["label"] += [q] * len(own)
                    out["piece"] += own
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("label", pa.int32()), ("piece", pa.binary())]))

    samples = sample.mapInArrow(cut, "label int, piece binary").orderBy("label", "piece").toPandas()
    dicts = [train_dictionary([bytes(p) for p in samples["piece"][samples["label"] == q]]) for q in (1, 0)]
    shared = docs.sparkSession.sparkContext.broadcast({"dicts": dicts})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            got = [(q, scorer.difference(t)) for q, t, builds in zip(*(c.to_pylist() for c in batch.columns), strict=True) if not builds]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.float64())], names=["label", "difference"])

    seen = sample.mapInArrow(measure, "label int, difference double").orderBy("label", "difference").toPandas()
    shared.unpersist()
    y = seen["label"].to_numpy(float)
    # the classes were sampled at different rates: weights give the labels' own odds
    weight = np.ones(len(y))
    for q in (0, 1):
        weight[y == q] = counts.get(q, 0) / max((y == q).sum(), 1)
    return {"dicts": dicts, "calibration": fit_isotonic(seen["difference"].to_numpy(float), y, weight)}


def score(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with the score of every whole ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.score(batch.column(1).to_pylist()), pa.float64())], names=["kept", "score"])

    return kept.mapInArrow(run, f"kept {kept.schema['kept'].dataType.simpleString()}, score double").select("kept.*", "score")
