"""Map files of any size, read in parallel.

Spark's text source cuts a file at the end tags of markers, wherever its blocks fall.  A
block is scanned once: it gives its markers, and says of the elements around them how many
it closes that it did not open, and which it leaves open.  Of these the elements that are
open where a block begins follow by a fold over the blocks of a file, which are as many as
the file has partitions; a marker whose folder began before its block takes its name from
there.  Markers are numbered by the counts of the blocks before theirs.

A file whose blocks cannot be read one by one (an end tag inside a comment or a character
section on a cut, entities of its own, a broken file) is read as a whole instead, so the
result is that of :func:`files.markers` in any case."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import AT_ONCE, MARKER, markers_in, markers_of, path_exists
from tidemark.sources.scratch import written

#: What is no element, or one tag: whether it ends, its name, its attributes, whether it is empty.
_TOKEN = re.compile(r"""<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^>\[]*>|<(/?)([\w.:-]+)((?:[^<>"']|"[^"]*"|'[^']*')*?)(/?)>""", re.DOTALL)
_OPENINGS = re.compile(r"<!--|<!\[CDATA\[")
_PREFIX = re.compile(r"[<\s/]([\w.-]+):[\w.-]+")
NAMES = tuple(f.split()[0] for f in MARKER.split(", "))
#: What a block says: markers in it, elements closed that it did not open, and as (folder
#: number or -1, name or null) those left open; names (elements up, name) given to folders
#: opened before, and (number, name) to its own after markers in them; what is wrong.
_BLOCK = "n long, closes int, opens array<struct<number:int,name:string>>, above array<struct<up:int,name:string>>, named array<struct<number:int,name:string>>, fault string"
_ROW = f"file string, block long, nth long, ref string, {MARKER}, {_BLOCK}"


def _local(tag: str) -> str:
    return tag.rpartition(":")[2]


def _parsed(fragment: str) -> ET.Element:
    """An element cut out of its document, its prefixes declared anew."""
    known = "".join(f' xmlns:{p}="{p}"' for p in sorted(set(_PREFIX.findall(fragment)) - {"xml", "xmlns"}))
    (found,) = ET.fromstring(f"<r{known}>{fragment}</r>")
    return found


def _unclosed(text: str, at: int) -> int:
    """Where a comment or character section begins that does not end, -1 if none does."""
    while (opened := _OPENINGS.search(text, at)) is not None:
        close = text.find("-->" if opened[0] == "<!--" else "]]>", opened.end())
        if close < 0:
            return opened.start()
        at = close + 3
    return -1


class _Block:
    """One block's elements, marker by marker."""

    def __init__(self) -> None:
        self.open: list[list] = []  # [folder number or -1, name or None]
        self.closes = self.folders = self.count = 0
        self.above: list[tuple[int, str]] = []
        self.named: list[tuple[int, str]] = []
        self.rest = self.fault = ""

    def take(self, record: str, end: str) -> Iterator[tuple]:
        """The markers of a record (text up to an end tag; ``end`` is that, or empty for the
        last): nth, reference to the folder or None, marker.  What is not whole waits for
        the next record."""
        text, self.rest = self.rest + record, ""
        at = 0
        while (token := _TOKEN.search(text, at)) is not None:
            if _OPENINGS.search(text, at, token.start()):  # begins before this and does not end
                break
            ends, tag, _, empty = token.groups()
            if tag is None:
                at = token.end()
            elif _local(tag) != "Placemark" or ends:
                at = self._element(text, token, ends, _local(tag), empty)
            elif empty:
                yield self._marker(token[0])
                at = token.end()
            elif _unclosed(text, token.start()) >= 0:
                self.rest = text[token.start() :] + end
                return
            else:
                yield self._marker(text[token.start() :] + end)
                return
        if (odd := _unclosed(text, at)) >= 0:
            self.rest = text[odd:] + end

    def _element(self, text: str, token: re.Match, ends: str, tag: str, empty: str) -> int:
        if ends:
            if self.open:
                self.open.pop()
            else:
                self.closes += 1
        elif tag == "name" and empty:
            self._name("")
        elif tag == "name" and (close := text.find(f"</{token[2]}>", token.end())) >= 0:
            after = close + len(token[2]) + 3
            self._name((_parsed(text[token.start() : after]).text or "").strip())
            return after
        elif not empty:
            self.open.append([self.folders if tag == "Folder" else -1, None])
            self.folders += tag == "Folder"
        return token.end()

    def _name(self, name: str) -> None:
        """The name of the innermost element; only a folder's first one counts."""
        if not self.open:
            self.above.append((self.closes, name))
        elif self.open[-1][0] >= 0 and self.open[-1][1] is None:
            self.open[-1][1] = name
            self.named.append((self.open[-1][0], name))

    def _marker(self, fragment: str) -> tuple:
        (found,) = markers_in(_parsed(fragment))
        folder = next((x for x in reversed(self.open) if x[0] >= 0), None)
        ref = f"u{self.closes}" if folder is None else f"f{folder[0]}" if folder[1] is None else None
        if folder is not None and folder[1] is not None:
            found["folder"] = folder[1]
        self.count += 1
        return self.count - 1, ref, found

    def summary(self) -> tuple:
        listed = lambda rows, a, b: [{a: x, b: y} for x, y in rows]
        return self.count, self.closes, listed(self.open, "number", "name"), listed(self.above, "up", "name"), listed(self.named, "number", "name"), self.fault or ("a section over a cut" if self.rest.strip() else "")


def _scan(batches: Iterator[pa.RecordBatch], end: str, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of markers, and behind the last of a block its summary (``nth`` null)."""
    current: tuple | None = None
    block = _Block()
    out: list[tuple] = []

    def close() -> None:
        if current is not None:
            out.append((*current, None, None, *[None] * len(NAMES), *block.summary()))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.types, strict=True)], schema=kinds)

    for batch in batches:
        for file, start, record, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, start) != current:
                close()
                current, block = (file, start), _Block()
            if block.fault:
                continue
            try:
                for nth, ref, m in block.take(record, "" if last else end):
                    out.append((*current, nth, ref, *[m[n] for n in NAMES[:-1]], list(m["data"].items()), *[None] * 6))
            except (ET.ParseError, ValueError) as e:
                block.fault = repr(e)
            if len(out) >= AT_ONCE:
                yield flush()
                out.clear()
    close()
    yield flush()


def folded(blocks: list[dict]) -> list[tuple[int, str, str, int]]:
    """(block, reference, folder's name, markers before) of the blocks of a file, in order."""
    stack: list[list] = []  # [whether a folder, name or None]
    seen: list[tuple[int, list[list], dict[int, list], list, int]] = []
    before = 0
    for b in blocks:
        inside = list(stack)
        for x in b["above"]:
            if x["up"] < len(stack) and (entry := stack[-1 - x["up"]])[0] and entry[1] is None:
                entry[1] = x["name"]
        del stack[len(stack) - min(b["closes"], len(stack)) :]
        own = {x["number"]: [True, x["name"]] for x in b["opens"] if x["number"] >= 0}
        stack += [own.get(x["number"], [False, None]) for x in b["opens"]]
        seen.append((b["block"], inside, own, b["named"], before))
        before += b["n"]
    out = []
    for number, inside, own, named, since in seen:
        out.append((number, "", "", since))
        for up in range(len(inside) + 1):
            folder = next((x for x in reversed(inside[: len(inside) - up]) if x[0]), None)
            out.append((number, f"u{up}", (folder[1] or "") if folder else "", since))
        names = {x["number"]: x["name"] for x in named} | {k: x[1] or "" for k, x in own.items()}
        out += [(number, f"f{k}", name, since) for k, name in names.items()]
    return out


def _prefix(spark: SparkSession, path: str) -> str:
    """What stands before tag names in a file, such as ``kml:``."""
    first = [r["value"] for r in spark.read.option("lineSep", ">").text(path).limit(8).collect()]
    return next((m[1] or "" for t in first if (m := re.search(r"<([\w.-]+:)?kml\b", t))), "")


def read_map(spark: SparkSession, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The markers of the map files under ``path`` (seq, its number in the file, and
    :data:`files.MARKER`); ``keep`` may ask for their ``file``."""
    end = f"</{_prefix(spark, path)}Placemark>"
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # a file's last record ends without the tag; that the tag is missing shows in its length
    ends = F.col("_metadata.file_block_start") + F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")
    records = spark.read.option("lineSep", end).text(path).select(*place, "value", (ends & ~F.col("value").rlike(r"<(?:[\w.-]+:)?Placemark\b")).alias("last"))
    kinds = _arrow(_ROW)
    rows = written(records.mapInArrow(lambda it: _scan(it, end, kinds), _ROW), "map")
    summaries = rows.filter("nth is null")
    odd = summaries.filter("fault <> ''").select("file").distinct()

    names = ["_file", "_block", "_ref", "_name", "since"]

    def fold(file: pa.Table) -> pa.Table:
        blocks = sorted(file.to_pylist(), key=lambda b: b["block"])
        made = zip(*((blocks[0]["file"], *r) for r in folded(blocks)), strict=True)
        return pa.table([pa.array(c, pa.int64() if k in ("_block", "since") else pa.string()) for k, c in zip(names, made, strict=True)], names=names)

    refs = written(summaries.select("file", "block", "n", "closes", "opens", "above", "named").groupBy("file").applyInArrow(fold, "_file string, _block long, _ref string, _name string, since long"), "map-folders")
    found = rows.filter("nth is not null").join(odd, "file", "left_anti")
    joined = found.join(refs, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")) & (F.coalesce("ref", F.lit("")) == F.col("_ref")), "left")
    columns = [F.when(F.col("ref").isNull(), F.col("folder")).otherwise(F.coalesce("_name", F.lit(""))).alias("folder") if n == "folder" else F.col(n) for n in NAMES]
    split = joined.select(*keep, (F.col("nth") + F.coalesce("since", F.lit(0))).alias("seq"), *columns)
    if odd.isEmpty():
        return split
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").join(odd, "file", "left_semi")
    return split.unionByName(markers_of(texts, keep))


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def count_markers(spark: SparkSession, path: str) -> int:
    return read_map(spark, path).count() if path_exists(spark, path) else 0
