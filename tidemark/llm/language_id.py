"""Language identification of mixed-language text.

The script of a word narrows its candidate languages to those seen in that script;
each candidate gets a per-word score from character 1- to 3-grams; a Viterbi pass
with a penalty for switching language labels every word, and runs of equal labels
are the spans.  A text's language is the one with most letters.

Words are runs of letters (Unicode category L and marks).  Scores are vectorised
over the code points of many texts at once.  The exact decoder runs in numpy: a
text whose best single language no excursion can beat (a maximum-subarray bound)
is labelled at once, the others go through the dynamic programme.

Defined results: null, empty and letterless texts are ``und`` with score 0 and no
spans; texts in scripts never seen in training get equal scores, so the language
most frequent in training; a model without rows predicts ``und`` throughout; more
than ``languages`` languages raise a ValueError, none is left out in silence;
a run of letters longer than twice ``AT_ONCE`` is cut in words of about that length;
repeated rows get equal results; extra columns are ignored by :func:`identify`
except those named as kept.

Scale: fitting takes a bounded, hash-chosen sample (``rows`` a language); scoring
is a single map over the texts, in slices of about ``AT_ONCE`` characters, with no
shuffle.  The model (about a megabyte a language) is broadcast; its size is fixed
by the n-gram table and the number of languages, which ``LANGUAGES`` bounds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import AT_ONCE, materialise, release, slices

#: Rows a language that a model is fitted on.
ROWS = 1500
#: Languages that a model may tell apart, for its size grows with them, and those whose
#: counts the driver takes at a time.
LANGUAGES, AT_A_TIME = 256, 16
#: Slots of the hashed n-gram table.
SLOTS = 1 << 16
#: Penalty, in nats, for changing language between two words.
SWITCH = 6.0
#: Least share of a language's letters for a script to count as one of its own.
SCRIPT_SHARE = 0.02
UNKNOWN = "und"

# First and last code point of the scripts that are told apart.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}

_tables: dict[str, np.ndarray] = {}


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter or mark, and its script (0: other)."""
    if not _tables:
        import unicodedata

        letter = np.zeros(0x110000, bool)
        for cp in range(0x110000):
            if unicodedata.category(chr(cp))[0] in "LM":
                letter[cp] = True
        script = np.zeros(0x110000, np.uint8)
        for k, ranges in enumerate(SCRIPTS.values(), 1):
            for lo, hi in ranges:
                script[lo : hi + 1] = k
        _tables.update(letter=letter, script=script)
    return _tables["letter"], _tables["script"]


class Words:
    """The words of some texts and the n-gram slots of their letters."""

    def __init__(self, texts: list[str | None]) -> None:
        letter, script = _letters()
        lowered = [(t or "").lower() for t in texts]
        self.cp = cp = np.frombuffer(("\n" + "\n".join(lowered) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = letter[cp]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in lowered], out=bounds[1:])
        self.first = np.searchsorted(self.start, bounds + 1)  # of the words of each text
        self.at = np.flatnonzero(inside)
        self.word_of = np.repeat(np.arange(len(self.start)), self.end - self.start)
        self.script = script[cp[self.start]] if len(self.start) else np.zeros(0, np.uint8)
        self.letter_script = script[cp[self.at]]

    def slots(self) -> Iterator[np.ndarray]:
        """For n = 1, 2, 3, the slot of the n-gram that ends at each letter; what
        stands before a word counts as one boundary sign."""
        letter, _ = _letters()
        c = np.where(letter[self.cp], self.cp, np.uint32(32)).astype(np.uint64)
        a, b, d = c[self.at], c[self.at - 1], c[np.maximum(self.at - 2, 0)]
        d = np.where(b == 32, np.uint64(32), d)
        after = c[self.at + 1] == 32
        m1, m2, m3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
        top = np.uint64(64 - SLOTS.bit_length() + 1)
        yield (a * m1) >> top
        yield (a * m1 + b * m2 + np.uint64(1)) * m1 >> top
        yield (a * m1 + b * m2 + d * m3 + after * np.uint64(0x27D4EB2F165667C5)) * m1 >> top


def fit(labelled: DataFrame, rows: int = ROWS, seed: int = 11, languages: int = LANGUAGES) -> dict:
    """A model from (text, lang); rows of null lang or text don't count.

    About ``rows`` rows a language are chosen by a hash of the text; n-gram and
    script counts are made in the executors and added up by slot."""
    good = labelled.select("text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    by_lang = good.groupBy("lang").agg(F.count("*").alias("n")).limit(languages + 1).collect()
    if len(by_lang) > languages:
        raise ValueError(f"more than {languages} languages: the model would outgrow its bound")
    sizes = {r["lang"]: r["n"] for r in by_lang}
    langs = sorted(sizes)
    if not langs:
        return {"langs": []}
    span = 1 << 40
    rates = F.create_map(*[F.lit(x) for lang in langs for x in (lang, int(span * min(1.0, rows / sizes[lang])))])
    chosen = good.filter(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(span)) < rates[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The counts of a slice of one language at a time, as its slots that occur."""
        for batch in batches:
            texts, tags = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for lang in sorted(set(tags)):
                own = [texts[i] for i in np.flatnonzero(tags == lang)]
                for lo, hi in slices([len(t) for t in own]):
                    w = Words(own[lo:hi])
                    found = np.concatenate([s.astype(np.int64) + n * SLOTS for n, s in enumerate(w.slots())] + [w.letter_script.astype(np.int64) + 3 * SLOTS])
                    at, n = np.unique(found, return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "slot": at.astype(np.int32), "n": n.astype(np.int64)})

    counted = materialise(chosen.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")), "grams")
    # the driver holds the counts of a few languages beside the model
    few = (langs[lo : lo + AT_A_TIME] for lo in range(0, len(langs), AT_A_TIME))
    model = build(langs, sizes, ((some, counted.filter(F.col("lang").isin(some)).toPandas()) for some in few))
    release(counted)
    return model


def build(langs: list[str], sizes: dict[str, int], counts: Iterable[tuple[list[str], pd.DataFrame]]) -> dict:
    """Log-probabilities from counts (frames of lang, slot, n, of some languages each)."""
    logp = np.zeros((len(langs), 3, SLOTS), np.float32)
    kinds = np.zeros((len(langs), 256))
    for some, got in counts:
        for lang in some:
            own, k = got[got["lang"] == lang], langs.index(lang)
            flat = np.zeros(3 * SLOTS + 256)
            flat[own["slot"].to_numpy(np.int64)] = own["n"]
            shape, kinds[k] = flat[: 3 * SLOTS].reshape(3, SLOTS), flat[3 * SLOTS :]
            logp[k] = (np.log(shape + 0.1) - np.log(shape.sum(axis=1, keepdims=True) + 0.1 * SLOTS)) * np.array([[0.2], [0.3], [0.5]])
    logp -= logp.mean(axis=0, keepdims=True)
    own = kinds >= SCRIPT_SHARE * np.maximum(kinds.sum(axis=1, keepdims=True), 1)
    own[:, ~own.any(axis=0)] = True  # a script that nobody uses rules nobody out
    return {"langs": langs, "prior": max(langs, key=lambda x: (sizes.get(x, 0), x)), "logp": np.ascontiguousarray(logp.transpose(1, 2, 0)), "scripts": own}


def word_scores(w: Words, model: dict) -> np.ndarray:
    """Words x languages: summed n-gram scores, far below zero where the script
    rules the language out."""
    scores = np.zeros((len(w.start), len(model["langs"])), np.float32)
    if len(w.start):
        total = None
        for n, s in enumerate(w.slots()):
            part = model["logp"][n][s.astype(np.int64)]
            total = part if total is None else total + part
        firsts = np.concatenate(([0], np.cumsum(w.end - w.start)[:-1]))
        scores = np.add.reduceat(total, firsts, axis=0)
        scores[~model["scripts"][:, w.script].T] -= 1e4
    return scores


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word: the sum of scores less ``switch`` a change."""
    n, k = scores.shape
    best = scores[0].astype(np.float64).tolist()
    tops, stays = [0] * n, [()] * n
    for t, row in enumerate(scores[1:].astype(np.float64).tolist(), 1):
        top = max(best)
        least = top - switch
        tops[t] = best.index(top)
        stays[t] = [x >= least for x in best]
        best = [(x if x >= least else least) + y for x, y in zip(best, row, strict=True)]
    labels = [0] * n
    now = labels[-1] = best.index(max(best))
    for t in range(n - 1, 0, -1):
        if not stays[t][now]:
            now = tops[t]
        labels[t - 1] = now
    return np.array(labels, np.int32)


def label_words(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Labels of the words of several texts; ``first`` bounds the texts' words."""
    labels = np.zeros(len(scores), np.int32)
    count = np.diff(first)
    full = np.flatnonzero(count)
    if not len(full):
        return labels
    starts, count = first[:-1][full], count[full]
    ends = starts + count
    best = np.add.reduceat(scores.astype(np.float64), starts, axis=0).argmax(axis=1)
    of_text = np.repeat(np.arange(len(full)), count)
    labels[:] = best[of_text]
    if scores.shape[1] < 2:
        return labels
    # what leaving the best single language could gain at each word
    word = np.arange(len(scores))
    base = scores[word, labels].astype(np.float64)
    others = scores.copy()
    others[word, labels] = -np.inf
    run = np.concatenate(([0.0], np.cumsum(np.clip(others.max(axis=1) - base, -1e3, 1e3))))
    fall = of_text * 4e3 * len(scores)  # lets running minima start anew in each text
    low = np.minimum.accumulate(run[:-1] - fall) + fall
    inner = np.maximum.reduceat(run[1:] - low, starts)
    front = np.maximum.reduceat(run[1:], starts) - run[starts]
    back = run[ends] - np.minimum.reduceat(run[:-1], starts)
    # an excursion costs a switch at each end that lies inside the text, so texts
    # where none pays keep their one language; the others are decoded
    for i in np.flatnonzero((inner > 2 * switch) | (front > switch) | (back > switch)):
        labels[starts[i] : ends[i]] = viterbi(scores[starts[i] : ends[i]], switch)
    return labels


def _pieces(text: str, most: int = AT_ONCE) -> list[str]:
    """A text cut between words into pieces of about ``most`` characters."""
    out, lo = [], 0
    letter, _ = _letters()
    while len(text) - lo > most:
        hi = lo + most
        while hi < len(text) and letter[ord(text[hi])] and hi - lo < 2 * most:
            hi += 1
        out.append(text[lo:hi])
        lo = hi
    return [*out, text[lo:]]


def predict(texts: list[str | None], model: dict, spans: bool = True) -> list[tuple[str, float, list[dict]]]:
    """(lang, score, spans) of each text; a span is a range of words and its lang."""
    if not model["langs"]:
        return [(UNKNOWN, 0.0, [])] * len(texts)
    out: list[tuple[str, float, list[dict]]] = []
    cut = [_pieces(t or "") for t in texts]
    for lo, hi in slices([len(t or "") for t in texts]):
        flat = [p for c in cut[lo:hi] for p in c]
        parts = [Words(flat[a:b]) for a, b in slices([len(p) for p in flat])]
        scores = np.concatenate([word_scores(w, model) for w in parts])
        letters = np.concatenate([w.end - w.start for w in parts])
        counts = np.concatenate([np.diff(w.first) for w in parts])
        ends = np.cumsum([len(c) for c in cut[lo:hi]])
        first = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], ends))]
        labels = label_words(scores, first)
        k = len(model["langs"])
        shares = np.bincount(np.repeat(np.arange(hi - lo), np.diff(first)) * k + labels, letters, minlength=(hi - lo) * k).reshape(hi - lo, k)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if a == b:
                out.append((UNKNOWN, 0.0, []))
                continue
            if not scores[a:b].any():
                top = model["langs"].index(model["prior"])
            else:
                top = int(shares[i].argmax())
            found: list[dict] = []
            if spans:
                edge = np.concatenate(([0], np.flatnonzero(np.diff(labels[a:b])) + 1, [b - a]))
                found = [{"start": int(x), "end": int(y), "lang": model["langs"][labels[a + x]]} for x, y in zip(edge[:-1], edge[1:], strict=True)]
            own = scores[a:b].sum(axis=0, dtype=np.float64) / np.sqrt(letters[a:b].sum())
            certain = 1 / np.exp(np.clip(own - own[top], -50, 50)).sum()
            out.append((model["langs"][top], float(certain * shares[i, top] / shares[i].sum()), found))
    return out


def identify(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",), spans: bool = True, with_text: bool = False) -> DataFrame:
    """The ``keep`` columns of ``docs`` with lang_pred, score and spans (empty
    unless asked for), and ``text`` if asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), F.col("text"))
    text = ", text string" if with_text else ""
    schema = f"kept {kept.schema['kept'].dataType.simpleString()}{text}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            got = predict(batch.column(1).to_pylist(), shared.value, spans)
            columns = [*batch.columns[: 1 + with_text], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], span)]
            yield pa.RecordBatch.from_arrays(columns, names=["kept", "text", "lang_pred", "score", "spans"] if with_text else ["kept", "lang_pred", "score", "spans"])

    return kept.mapInArrow(label, schema).select("kept.*", *["text"] * with_text, "lang_pred", "score", "spans")
