"""Toxicity scoring of text restored by a noisy-channel decoder.

Disguised words (leetspeak, letters spaced out, letters repeated) become lattices
of characters: each sign may stand for itself or for letters that it is used for,
a run of one letter for one, two or all of it, a spaced-out run for one word or, with
boundaries put in, for several.  Texts are brought to compatibility form first, so wide
and other styled letters are plain ones.  Viterbi decoding under a character trigram model
of the whole corpus, with a cost for each change, restores runs and tokens of any length
whole, as one word and as several; what all surviving readings share is settled on the
way, so memory stays bounded.  The restored text is scored by words and word beginnings
whose presence tells toxic from other labelled texts, calibrated to a probability.

Defined results: null and empty texts get the calibrated score of no evidence;
without labels the score is 0.5; a label that names no document, or is null, does
not count, of those that contradict one another the toxic one does; repeated rows
get equal scores; extra columns are ignored.

Scale: the character counts cover every text of the corpus (one map, partial
sums per task, added by slot); the lexicon is fitted on a bounded, hash-chosen
sample of labelled rows (``rows`` a class); scoring is a map without a shuffle.
The broadcast model is a table of ``36 ** 3`` numbers and the ``features`` strongest
entries of the lexicon, parameters that bound the model, not what it is applied to.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.calibration import apply_logistic, fit_logistic
from tidemark.llm.common import join_texts, labelled_sample, materialise, release, slices, span_hash, word_spans

#: Labelled rows a class that the model is fitted on, entries of its lexicon, folds of its calibration.
ROWS, FEATURES, FOLDS = 8000, 60000, 4
#: Characters of the model: 0 is the boundary, 1-26 letters, 27-35 others.
SIZE = 36
#: Cost in nats of reading a sign as a letter, of dropping a repeat, of joining a spaced run.
COST_LEET, COST_REPEAT = 1.0, 0.5
# Signs and the letters they are used for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "h", "%": "x", "&": "a", "€": "e", "£": "l",
}
PREFIXES = (4, 5, 6)
#: Signs beyond ASCII, as control characters of one byte while tokens are looked for.
_MARKS = {ord(sign): chr(1 + k) for k, sign in enumerate(s for s in LEET if not s.isascii())}
_MARKED = {**{ord(m): chr(31) for m in _MARKS.values()}, **_MARKS}
#: Positions after which settled readings are put aside, and signs of tokens whose forms are remembered.
SETTLE, REMEMBERED = 512, 40


def _alphabet() -> np.ndarray:
    """Class of each code point under 0x250 (others 35)."""
    table = np.full(0x250, 35, np.uint8)
    for cp in range(0x250):
        ch = unicodedata.normalize("NFKD", chr(cp).lower())[:1]
        if "a" <= ch <= "z":
            table[cp] = ord(ch) - 96
        elif not chr(cp).isalpha():
            table[cp] = 0
    return table


_CLASS = _alphabet()


def classes(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(cp < 0x250, _CLASS[np.minimum(cp, 0x24F)], 35).astype(np.int64)


@lru_cache(maxsize=4096)
def _class(ch: str) -> int:
    return int(classes(ch)[0])


def character_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts of the characters of every text of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for lo, hi in slices([len(t) for t in texts]):
                c = classes("\n\n" + "\n\n".join(texts[lo:hi]) + "\n")
                keep = np.ones(len(c), bool)  # runs of boundaries count once
                keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
                c = np.concatenate(([0, 0], c[keep], [0]))
                total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])

    got = docs.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIZE**3, np.int64)
    out[got["slot"].to_numpy(np.int64)] = got["n"]
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), interpolated with lower orders."""
    three = counts.reshape(SIZE, SIZE, SIZE).astype(float)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5)
    return np.log(p3)


def lattice(token: str, breaks: bool = False) -> list[list[tuple[str, float]]]:
    """For each position of a token its readings, with costs.  A run of a
    letter is one position that reads as one, two or all of it.  With ``breaks``, a
    word may end in or after each position."""
    out: list[list[tuple[str, float]]] = []
    for ch, run in groupby(token):
        n = sum(1 for _ in run)
        if ch.isalpha():
            readings = [(ch * n, 0.0)] if n < 3 else [(ch, COST_REPEAT), (ch * 2, COST_REPEAT), (ch * n, 0.0)]
            if breaks and n > 1:
                readings.append((f"{ch} {ch}", 0.0 if n < 3 else COST_REPEAT))
        elif ch in LEET:
            readings = [(r * k, COST_LEET * n) for r in LEET[ch] for k in {1, n}]
        else:
            readings = [("", COST_LEET * n)]
        out.append(readings + [(f"{letters} ", cost) for letters, cost in readings] if breaks else readings)
    return out


def decode(token: str, logp: np.ndarray, breaks: bool = False) -> str:
    """The most likely word, or with ``breaks`` words, behind a token.

    A state is the last two characters; each keeps the best way to it as the reading it
    ends in and the state before.  Where all ways have one part in common, it is settled."""
    states: dict[tuple[int, int], float] = {(0, 0): 0.0}
    settled: list[str] = []
    steps: list[dict[tuple[int, int], tuple]] = []
    for readings in lattice(token, breaks):
        coded = [(letters, cost, [_class(c) for c in letters]) for letters, cost in readings]
        new: dict[tuple[int, int], tuple] = {}
        for (a, b), score in states.items():
            for letters, cost, code in coded:
                x, y, s = a, b, score - cost
                for c in code:
                    s += logp[x][y][c]
                    x, y = y, c
                found = (s, letters, (a, b))
                if (x, y) not in new or found > new[x, y]:
                    new[x, y] = found
        states = {k: v[0] for k, v in new.items()}
        steps.append(new)
        if len(steps) >= SETTLE:
            _settle(steps, settled)
    if not steps:
        return "".join(settled)
    _, end = max((s + logp[a][b][0], (a, b)) for (a, b), s in states.items())
    ending: list[str] = []
    for step in reversed(steps):
        _, letters, end = step[end]
        ending.append(letters)
    return "".join(settled) + "".join(reversed(ending))


def _settle(steps: list[dict[tuple[int, int], tuple]], settled: list[str]) -> None:
    """Moves the steps up to which all ways are one from ``steps`` to ``settled``."""
    alive, known = set(steps[-1]), len(steps)
    while known and len(alive) > 1:
        known -= 1
        alive = {steps[known][s][2] for s in alive}
    if not known:
        return
    state = next(iter(alive))
    one: list[str] = []
    for step in reversed(steps[:known]):
        _, letters, state = step[state]
        one.append(letters)
    settled.extend(reversed(one))
    del steps[:known]


def restored(token: str, logp: np.ndarray) -> str:
    """The restored forms of a token: as one word, and as words."""
    return " ".join(dict.fromkeys(decode(token, logp, breaks).strip() for breaks in (False, True)))


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_PLAIN = {ord(m): chr(sign) for sign, m in _MARKS.items()}
_SIGN = np.zeros(256, bool)
_SIGN[[*b"0123456789@$!|+(<*#%&._-", *map(ord, _MARKS.values())]] = True
_TAIL = np.zeros(256, bool)
_TAIL[[*b"0123456789@$+#*|", *map(ord, _MARKS.values())]] = True
#: Bytes of a character by its first one.
_BYTES = np.repeat([1, 0, 2, 3, 4, 0], [128, 64, 32, 16, 8, 8])
#: Letters that a spaced-out word has at least.
SPACED = 4


def disguised(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words (spans between blanks of lower-cased bytes) hold a sign before a
    letter, a digit or another sign that ends no clause after one, or a letter three times in a row; and the (first,
    last + 1) words of runs of single characters."""
    letter, nxt = _LETTER[data], np.append(_LETTER[data[1:]], False)
    odd = _SIGN[data] & nxt
    odd[1:] |= letter[:-1] & _TAIL[data[1:]]
    odd[2:] |= letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    found = np.zeros(len(starts), bool)
    at = np.flatnonzero(odd)
    found[np.searchsorted(starts, at, side="right") - 1] = len(at) > 0
    single = np.concatenate(([False], ends - starts == _BYTES[data[starts]], [False]))
    edge = np.flatnonzero(single[1:] != single[:-1])
    runs = np.stack([edge[0::2], edge[1::2]], axis=1)
    return found, runs[runs[:, 1] - runs[:, 0] >= SPACED]


def restore(texts: list[str | None], logp: np.ndarray, memory: dict[str, str] | None = None) -> list[str]:
    """Lower-cased texts in compatibility form, each followed by the restored forms of its
    disguised words.  What a word says as it stands is kept, so nothing gets lost."""
    memory, logp = {} if memory is None else memory, logp.tolist()  # single numbers are read faster from lists
    low = [t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).lower() for t in (t or "" for t in texts)]
    out: list[str] = []
    for lo, hi in slices([len(t) for t in low]):
        data, offsets = join_texts([t.translate(_MARKED) for t in low[lo:hi]])
        starts, ends = word_spans(data)
        if not len(starts):
            out += low[lo:hi]
            continue
        found, runs = disguised(data, starts, ends)
        raw = data.tobytes()
        tokens = [(starts[k], raw[starts[k] : ends[k]]) for k in np.flatnonzero(found)]
        owner = np.searchsorted(offsets, starts, side="right") - 1
        for a, b in runs:
            edges = [a, *(np.flatnonzero(np.diff(owner[a:b])) + a + 1), b]  # a run ends with its text
            for first, end in zip(edges[:-1], edges[1:], strict=True):
                if end - first >= SPACED:
                    tokens.append((starts[first], b"".join(raw[starts[k] : ends[k]] for k in range(first, end))))
        more: dict[int, list[str]] = {}
        for at, token in tokens:
            word = token.decode("utf-8", "replace").rstrip(".,;:!?").translate(_PLAIN)
            if (form := memory.get(word)) is None:
                form = restored(word, logp)
                if len(word) <= REMEMBERED:  # forms are the same either way
                    if len(memory) > 50000:
                        memory.clear()
                    memory[word] = form
            more.setdefault(int(np.searchsorted(offsets, at, side="right") - 1), []).append(form)
        out += [t if i not in more else f"{t} {' '.join(more[i])}" for i, t in enumerate(low[lo:hi])]
    return out


def all_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash) of restored texts: words, and the beginnings of
    longer words."""
    data, offsets = join_texts(texts)
    starts, ends = word_spans(data, _LETTER[data])
    owner = np.searchsorted(offsets, starts, side="right") - 1
    found, owners = [span_hash(data, starts, ends)], [owner]
    for n in PREFIXES:
        long = ends - starts > n
        found.append(span_hash(data, starts[long], starts[long] + n) ^ np.uint64(0x5BD1E995 * n))
        owners.append(owner[long])
    return np.concatenate(owners), np.concatenate(found)


def distinct(owner: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature once a text."""
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    if len(owner):
        new = np.concatenate(([True], (np.diff(owner) != 0) | (found[1:] != found[:-1])))
        owner, found = owner[new], found[new]
    return owner, found


class Lexicon:
    """Weights of features by hash; a bitmap of low bits turns most others away."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray) -> None:
        self.keys, self.weights = keys, weights
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Per text: the largest weight, the sum of the three largest, and the log
        count of strong features."""
        out = np.zeros((len(texts), 3))
        owner, found = all_features(texts)
        if not len(self.keys) or not len(found):
            return out
        may = self.seen[(found & np.uint64((1 << 20) - 1)).astype(np.int64)]
        owner, found = distinct(owner[may], found[may])
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        hit = self.keys[at] == found
        owner, weight = owner[hit], self.weights[at[hit]]
        order = np.lexsort((-weight, owner))
        owner, weight = owner[order], weight[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner, side="left")
        np.maximum.at(out[:, 0], owner, weight)
        np.add.at(out[:, 1], owner[place < 3], weight[place < 3])
        out[:, 2] = np.log1p(np.bincount(owner[weight > 1.5], minlength=len(texts)))
        return out


def fit(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, rows: int = ROWS, features: int = FEATURES) -> dict:
    """A model from ``docs`` (doc_id, text), ``labels`` (doc_id, toxic) and the
    texts of ``corpus`` (``docs`` unless given).

    The lexicon comes from the whole sample.  It is calibrated by cross-fitting: each
    text of the sample is measured by a lexicon made without its fold."""
    logp = language_model(character_counts(docs if corpus is None else corpus))
    sample, known = labelled_sample(docs, labels, "toxic", rows)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)).cast("int")
    sample = sample.select("label", "text", fold.alias("fold"))
    groups = range(2 * FOLDS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, str] = {}
        for batch in batches:
            label, texts, folds = (c.to_pylist() for c in batch.columns)
            group = np.array(label) * FOLDS + np.array(folds)
            for g in groups:
                own = restore([texts[i] for i in np.flatnonzero(group == g)], logp, memory)
                if own:
                    parts = [distinct(*all_features(own[lo:hi]))[1] for lo, hi in slices([len(t) for t in own])]
                    keys, n = np.unique(np.concatenate(parts), return_counts=True)
                    keys, n = np.append(keys[keys != 0], np.uint64(0)), np.append(n[keys != 0], len(own))  # 0 stands for the texts
                    yield pa.RecordBatch.from_pydict({"grp": pa.array([g] * len(keys), pa.int32()), "feature": keys.view(np.int64), "n": n})

    counted = sample.mapInArrow(count, "grp int, feature long, n long").groupBy("feature").pivot("grp", list(groups)).agg(F.sum("n")).na.fill(0)
    counted = materialise(counted, "features")
    sums = counted.filter("feature = 0").first()
    total = np.array([sums[str(g)] if sums else 0 for g in groups], float).reshape(2, FOLDS)

    def lexicon(without: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The strongest features: the log ratio of document frequencies in the two
        classes, at one deviation to the safe side."""
        use = [f for f in range(FOLDS) if f != without]
        c0, c1 = (sum(F.col(str(q * FOLDS + f)) for f in use) for q in (0, 1))
        n0, n1 = (float(total[q, use].sum()) for q in (0, 1))
        safe = F.log((c1 + 0.25) / (n1 + 1)) - F.log((c0 + 0.25) / (n0 + 1)) - F.sqrt(1 / (c1 + 0.25))
        top = counted.filter("feature <> 0").filter(c1 >= 2).select("feature", safe.alias("weight")).filter("weight > 0").orderBy(F.desc("weight"), "feature").limit(features).toPandas()
        keys = top["feature"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        return keys[order], top["weight"].to_numpy(float)[order]

    shared = docs.sparkSession.sparkContext.broadcast([lexicon(f) for f in range(FOLDS)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, str] = {}
        lexica = [Lexicon(*one) for one in shared.value]
        for batch in batches:
            label, texts, folds = (c.to_pylist() for c in batch.columns)
            for f, own_lexicon in enumerate(lexica):
                own = [i for i, x in enumerate(folds) if x == f]
                got = measured(restore([texts[i] for i in own], logp, memory), own_lexicon)
                yield pa.RecordBatch.from_arrays([pa.array([label[i] for i in own], pa.int32()), *[pa.array(got[:, k]) for k in range(3)]], names=["label", "a", "b", "c"])

    seen = sample.mapInArrow(measure, "label int, a double, b double, c double").orderBy("label", "a", "b", "c").toPandas()
    shared.unpersist()
    y = seen["label"].to_numpy(float)
    calibration = fit_logistic(seen[["a", "b", "c"]].to_numpy(float), y, products=False)
    if len(y) and y.min() < y.max():
        calibration["beta"][0] += np.log(known[1] / known[0]) - np.log(y.sum() / (len(y) - y.sum()))
    keys, weights = lexicon(None)
    release(counted)
    return {"logp": logp, "keys": keys, "weights": weights, "calibration": calibration}


def measured(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    found = [lexicon.evidence(texts[lo:hi]) for lo, hi in slices([len(t) for t in texts])]
    return np.concatenate(found) if found else np.zeros((0, 3))


def score(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with the score of every whole ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, str] = {}
        m = shared.value
        lexicon = Lexicon(m["keys"], m["weights"])
        for batch in batches:
            found = measured(restore(batch.column(1).to_pylist(), m["logp"], memory), lexicon)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(apply_logistic(m["calibration"], found), pa.float64())], names=["kept", "score"])

    return kept.mapInArrow(run, f"kept {kept.schema['kept'].dataType.simpleString()}, score double").select("kept.*", "score")
