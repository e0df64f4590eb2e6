"""SentencePiece encoding and decoding by vectorised merge rounds.

A model file of the BPE kind with byte fallback is read into tables.  Texts become flat
arrays of symbols, cut into words wherever no piece of the vocabulary holds the two
neighbouring characters side by side, for no merge can cross there.  Equal words of a
slice are merged once.  A round takes the least pair rank of every word, merges all its
leftmost places at once, and packs the arrays; it ends when no word has a pair left.

The rounds give what one merge after another gives.  Merging the places of a rank
together is right only if no merge makes a pair of the same or a better rank: pieces of
which that cannot be said merge at their leftmost place alone, once a round.  Words of
more than ``LONG`` symbols are merged from a queue of pairs by rank and place, as their
rounds could be as many as their symbols.

Defined results: null and empty texts have no ids and decode to an empty text; characters
outside the vocabulary become the pieces of their UTF-8 bytes; texts of any length are
encoded whole, in pieces cut between words; repeated rows are encoded as often as they
occur; an empty table gives no rows; columns that are not kept are ignored.  Decoding takes
any ids: bytes that are no UTF-8 become U+FFFD one by one, control pieces vanish, the
unknown piece becomes its surface, null ids an empty text; ids outside the vocabulary
raise an error.

Scale: two maps without a shuffle; a task holds a slice of ``AT_ONCE`` characters, or one
word where that is longer.  The model, of fixed size, is broadcast.
"""

from __future__ import annotations

import codecs
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tidemark.llm.common import mix64, slices

#: Symbols up to which a word is merged in rounds, and characters of a slice.
LONG, AT_ONCE = 1024, 1 << 20
SPACE = "▁"
#: Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2
NO_RANK = np.int32(2**31 - 1)


# --- model --------------------------------------------------------------------------


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if (kind := tag & 7) == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield tag >> 3, data[at : at + size]
        at += size


def load_model(path: str | None = None) -> dict:
    """Pieces, scores, kinds and settings of a model file."""
    if path is None:
        import public_tokenizers as public

        path = public.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        message = list(_fields(f.read()))
    entries = [dict(_fields(v)) for k, v in message if k == 1]
    trainer = dict(_fields(next((v for k, v in message if k == 2), b"")))
    normalizer = dict(_fields(next((v for k, v in message if k == 3), b"")))
    model = {
        "pieces": [e[1].decode() for e in entries],
        "scores": [struct.unpack("<f", e[2])[0] if 2 in e else 0.0 for e in entries],
        "kinds": [e.get(3, NORMAL) for e in entries],
        "unknown": trainer.get(44, " ⁇ ".encode()).decode(),
        "prefix": bool(normalizer.get(3, 1)),
    }
    odd = [what for what, there in {
        "no BPE model": trainer.get(3, 1) != BPE,
        "no byte fallback": not trainer.get(35, 0) or model["kinds"].count(BYTE) != 256,
        "a character map": bool(normalizer.get(2)),
        "white space that is removed": bool(normalizer.get(4, 1)),
        "white space that is not escaped": not normalizer.get(5, 1),
        "white space as a suffix": bool(trainer.get(24, 0)),
        "pieces of other kinds": not set(model["kinds"]) <= {NORMAL, UNKNOWN, CONTROL, BYTE},
    }.items() if there]
    if odd:
        raise ValueError(f"{path} has what is not supported: {', '.join(odd)}")
    return model


class Tables:
    """A model as arrays for look-ups."""

    def __init__(self, model: dict) -> None:
        pieces, kinds = model["pieces"], model["kinds"]
        self.prefix, self.size = model["prefix"], len(pieces)
        ids = {p: i for i, p in enumerate(pieces) if kinds[i] == NORMAL}
        whole = [i for p, i in ids.items() if len(p) > 1]
        letters = sorted({c for i in whole for c in pieces[i]})
        #: Symbols of characters: ids, or numbers from ``size`` on for those that are no pieces.
        self.symbol = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[0x20] = self.symbol[ord(SPACE)]
        code = {c: int(self.symbol[ord(c)]) for c in letters}
        of = lambda s: ids[s] if s in ids else code[s] if len(s) == 1 else None
        better = {s: k for k, s in enumerate(sorted({model["scores"][i] for i in whole}, reverse=True))}
        found = {}
        for i in whole:
            p, rank = pieces[i], better[model["scores"][i]]
            for k in range(1, len(p)):
                if (a := of(p[:k])) is not None and (b := of(p[k:])) is not None:
                    found[a, b] = (rank, i)
        self.span = self.size + 0x110000
        pairs = sorted(found)
        self.keys = np.array([a * self.span + b for a, b in pairs] or [-1], np.int64)
        self.ranks = np.array([found[p][0] for p in pairs] or [NO_RANK], np.int32)
        self.made = np.array([found[p][1] for p in pairs] or [0], np.int32)
        #: Pieces that may at once be part of a pair as good as their own.
        self.risky = np.zeros(self.size, bool)
        best: dict[int, int] = {}
        for (a, b), (rank, _) in found.items():
            for s in (a, b):
                best[s] = min(best.get(s, NO_RANK), rank)
        for _, (rank, i) in found.items():
            self.risky[i] |= best.get(i, NO_RANK) <= rank
        #: Characters in longer pieces by number, 0 for all others, and which stand side by side in one.
        self.letter = np.zeros(0x110000, np.uint16)
        for k, c in enumerate(letters):
            self.letter[ord(c)] = k + 1
        self.letter[0x20] = self.letter[ord(SPACE)]
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for i in whole:
            for a, b in zip(pieces[i], pieces[i][1:]):  # noqa: B905
                self.beside[self.letter[ord(a)], self.letter[ord(b)]] = True
        byte = [i for i, k in enumerate(kinds) if k == BYTE]
        self.byte_ids = np.array(sorted(byte, key=lambda i: int(pieces[i][1:-1], 16)), np.int32)
        # for decoding: the bytes of each piece
        surface = [
            p.replace(SPACE, " ").encode() if k == NORMAL else bytes([int(p[1:-1], 16)]) if k == BYTE else model["unknown"].encode() if k == UNKNOWN else b""
            for p, k in zip(pieces, kinds, strict=True)
        ]
        self.control = np.array([k == CONTROL for k in kinds])
        self.spaced = np.array([k == NORMAL and p.startswith(SPACE) for p, k in zip(pieces, kinds, strict=True)])
        self.text_at = np.cumsum([0] + [len(s) for s in surface])
        self.text = np.frombuffer(b"".join(surface), np.uint8)

    # --- encoding -------------------------------------------------------------------

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs (``NO_RANK``: none) and the pieces that they make."""
        keys = left.astype(np.int64) * self.span + right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        there = self.keys[at] == keys
        return np.where(there, self.ranks[at], NO_RANK), self.made[at]

    def codes(self, text: str, first: bool) -> np.ndarray:
        """Code points of a text, with the leading space that the model wants."""
        if first and self.prefix and text:
            text = " " + text
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def breaks(self, codes: np.ndarray) -> np.ndarray:
        """Whether a word begins at each character."""
        letter = self.letter[codes]
        out = np.ones(len(codes), bool)
        out[1:] = ~self.beside[letter[:-1], letter[1:]]
        return out

    def parts(self, text: str, most: int = AT_ONCE) -> Iterator[np.ndarray]:
        """The code points of a text, cut between words into parts of about ``most``."""
        lo, first = 0, True
        while len(text) - lo > most:
            size, cut = most, 0
            while not cut:
                begins = np.flatnonzero(self.breaks(self.codes(text[lo : lo + size], False)))
                cut = int(begins[-1])
                if lo + size >= len(text):
                    cut = cut or len(text) - lo
                size *= 2
            yield self.codes(text[lo : lo + cut], first)
            lo, first = lo + cut, False
        if lo < len(text):
            yield self.codes(text[lo:], first)

    def encode(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """The ids of each part of a text."""
        sizes = np.array([len(p) for p in parts], np.int64)
        if not sizes.sum():
            return [np.zeros(0, np.int32) for _ in parts]
        codes = np.concatenate(parts)
        begin = self.breaks(codes)
        edges = np.cumsum(sizes)
        begin[(edges - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(begin)
        lengths = np.diff(np.append(starts, len(codes)))
        word, offset = _ragged(lengths)
        same, picked = self._alike(codes, starts, lengths, word, offset)
        flat, at = self._words(codes, starts[picked], lengths[picked])
        # each word's ids, in the order of the words
        count = np.diff(at)[same]
        which, nth = _ragged(count)
        ids = flat[at[same][which] + nth]
        ends = np.append(0, np.cumsum(count))[np.searchsorted(starts, edges)]
        return np.split(ids, ends[:-1])

    def _alike(self, codes, starts, lengths, word, offset) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word among the distinct ones, and a place of each of these."""
        mixed = mix64(codes.astype(np.uint64) + (offset.astype(np.uint64) << np.uint64(32)))
        tags = np.add.reduceat(mixed, starts)
        _, picked, same = np.unique(tags, return_index=True, return_inverse=True)
        like = picked[same]
        if (lengths == lengths[like]).all() and (codes == codes[starts[like][word] + offset]).all():
            return same, picked
        return np.arange(len(starts)), np.arange(len(starts))  # two words share a tag: merge each by itself

    def _words(self, codes, starts, lengths) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of words, and where each word's begin (one more entry than words)."""
        word, offset = _ragged(lengths)
        symbols, place = self.symbol[codes[starts[word] + offset]], np.arange(len(word))
        short = lengths[word] <= LONG
        got = [self.merge(symbols[short], lengths[lengths <= LONG], place[short])]
        for k in np.flatnonzero(lengths > LONG):
            own = word == k
            got.append(self.merge_long(symbols[own], place[own]))
        symbols, place = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(place, kind="stable")
        symbols, word = symbols[order], word[place[order]]
        # symbols that are no pieces become those of their bytes
        odd = np.flatnonzero(symbols >= self.size)
        count = np.ones(len(symbols), np.int64)
        point = symbols[odd] - self.size
        count[odd] = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
        which, nth = _ragged(count)
        ids = symbols[which]
        hit = np.flatnonzero(ids >= self.size)
        if len(hit):
            raw = np.frombuffer(point.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            ids[hit] = self.byte_ids[raw]
        total = np.bincount(word, weights=count, minlength=len(lengths)).astype(np.int64)
        return ids, np.append(0, np.cumsum(total))

    def merge(self, symbols, lengths, place) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words after all merges, and the places of their first characters."""
        done: list[tuple[np.ndarray, np.ndarray]] = [(symbols[:0], place[:0])]
        word = np.repeat(np.arange(len(lengths)), lengths)
        rank, made = self._ranks(symbols, word, np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lengths = np.diff(np.append(starts, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            if (ended := least == NO_RANK).any():
                done.append((symbols[ended], place[ended]))
                symbols, place, word, rank, made, least = (x[~ended] for x in (symbols, place, word, rank, made, least))
                continue
            at = np.flatnonzero(rank == least)
            # of places that overlap, every other one from the left
            nth = np.arange(len(at))
            run = np.maximum.accumulate(np.where(np.append(True, at[1:] != at[:-1] + 1), nth, 0))
            at = at[(nth - run) % 2 == 0]
            own = word[at]
            alone = np.zeros(int(own[-1]) + 1, bool)
            alone[own[self.risky[made[at]]]] = True
            at = at[np.append(True, own[1:] != own[:-1]) | ~alone[own]]
            symbols[at] = made[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, place, word, rank, made = (x[stay] for x in (symbols, place, word, rank, made))
            at = (np.cumsum(stay) - 1)[at]
            touched = np.concatenate([at, at[at > 0] - 1])
            rank[touched], made[touched] = self._ranks(symbols, word, touched)
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def _ranks(self, symbols, word, at) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the pairs that begin at places, and what they make."""
        after = np.minimum(at + 1, max(len(symbols) - 1, 0))
        rank, made = self.look(symbols[at], symbols[after])
        rank[(word[at] != word[after]) | (after == at)] = NO_RANK
        return rank, made

    def merge_long(self, symbols, place) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long word, from a queue of its pairs."""
        own, n = symbols.tolist(), len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        table: dict[tuple[int, int], tuple[int, int] | None] = {}

        def pair(a: int, b: int) -> tuple[int, int] | None:
            if (a, b) not in table:
                rank, made = self.look(np.array([a]), np.array([b]))
                table[a, b] = (int(rank[0]), int(made[0])) if rank[0] != NO_RANK else None
            return table[a, b]

        rank, made = self.look(symbols[:-1], symbols[1:])
        queue = [(int(rank[i]), i, own[i], own[i + 1], int(made[i])) for i in np.flatnonzero(rank != NO_RANK).tolist()]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, whole = heapq.heappop(queue)
            if own[i] != a or (j := after[i]) >= n or own[j] != b:
                continue
            own[i], own[j], after[i] = whole, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (p := pair(own[left], own[right])):
                    heapq.heappush(queue, (p[0], left, own[left], own[right], p[1]))
        out = np.array(own, np.int32)
        return out[out >= 0], place[out >= 0]

    # --- decoding -------------------------------------------------------------------

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of flat ids; ``ends``: where each text's end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id outside the vocabulary")
        size = np.diff(self.text_at)[ids]
        which, nth = _ragged(size)
        raw = self.text[self.text_at[ids][which] + nth].tobytes()
        at = np.append(0, np.cumsum(size))
        shown = np.flatnonzero(~self.control[ids])
        first = shown[np.minimum(np.searchsorted(shown, np.append(0, ends[:-1])), max(len(shown) - 1, 0))] if len(shown) else ends * 0
        stops = np.flatnonzero(self.control[ids])  # bytes on both sides of a control piece are no one character
        since = np.append(0, ends[:-1])
        low, high = at[since] + (self.prefix & (first >= since) & (first < ends) & self.spaced[ids[first]] if len(ids) else 0), at[ends]
        cuts = zip(np.searchsorted(stops, since), np.searchsorted(stops, ends), strict=True)
        out = []
        for lo, hi, (a, b) in zip(low.tolist(), high.tolist(), cuts, strict=True):
            edges = [lo, *(max(lo, int(x)) for x in at[stops[a:b]]), hi]
            out.append("".join(raw[x:y].decode("utf-8", "tidemark-bytes") for x, y in zip(edges, edges[1:])))  # noqa: B905
        return out


codecs.register_error("tidemark-bytes", lambda e: ("�" * (e.end - e.start), e.end))


def _ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these lengths laid end to end: the group of each entry, and its place in it."""
    group = np.repeat(np.arange(len(lengths)), lengths)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


_tables: dict[int, Tables] = {}


def tables(model: dict) -> Tables:
    """The tables of a model, made once in a process."""
    key = hash((tuple(model["pieces"]), tuple(model["scores"]), model["prefix"]))
    if key not in _tables:
        _tables[key] = Tables(model)
    return _tables[key]


# --- tables of Spark ----------------------------------------------------------------


def _extended(df: DataFrame, keep: list[str], field: StructField) -> StructType:
    return StructType([df.schema[k] for k in keep] + [field])


def encode(docs: DataFrame, model: dict, *, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The kept columns (``doc_id``) of ``docs`` and ``ids`` (array of int) of each whole text."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tables(shared.value)
        for batch in batches:
            lengths = [len(t.as_py() or "") for t in batch.column(len(keep))]
            for lo, hi in slices(lengths, AT_ONCE):
                texts = [t or "" for t in batch.column(len(keep)).slice(lo, hi - lo).to_pylist()]
                if hi - lo == 1:
                    ids = [np.concatenate([np.zeros(0, np.int32), *(own.encode([p])[0] for p in own.parts(texts[0]))])]
                else:
                    ids = own.encode([own.codes(t, True) for t in texts])
                ends = np.append(0, np.cumsum([len(i) for i in ids])).astype(np.int32)
                got = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(len(keep))), got], names=[*keep, "ids"])

    schema = _extended(docs, keep, StructField("ids", ArrayType(IntegerType(), False)))
    return docs.select(*keep, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: dict, *, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (``doc_id``) of ``encoded`` and the ``text`` of each row's ids."""
    keep = keep or ["doc_id"]
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tables(shared.value)
        for batch in batches:
            lists = batch.column(len(keep))
            lengths = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
            for lo, hi in slices(lengths.tolist(), AT_ONCE):
                ids = lists.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False)
                texts = own.decode(ids, np.cumsum(lengths[lo:hi]))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, "text"])

    return encoded.select(*keep, "ids").mapInArrow(run, _extended(encoded, keep, StructField("text", StringType())))
