"""WARC archives with revisit resolution.

Headers (id, payload digest, length) are shuffled by digest to find the original
of each group of equal payloads; records of the same payload become revisits that
refer to it, and the archives are written deduplicated, with fresh headers.

Records are laid out by SQL expressions and written by Spark's text sink, whose
line separator closes each record: the commit protocol of the sink makes lost or
repeated tasks harmless on any file system.  A file is one gzip member of some
records, read back with a streaming parser that goes by Content-Length alone, so
payloads may hold anything.  Payloads of ``LARGE`` bytes and more are kept in files
of their own, with as few records a file as keep it under ``FILE_BYTES``.

Defined results: null html is an empty payload; payloads under ``least`` bytes
are always responses; among equal payloads the smallest id is the response (rows
that repeat that id are responses as well, and as the same page share its record
id); null ids come last, each with a record id of its own; an empty table gives no
archive records; extra columns are ignored.

Scale: partial aggregate of headers by digest.  Up to ``FEW`` originals are broadcast
to the records.  Beyond that, records whose digest does not occur twice (a bitmap of
bounded size turns them away) are responses and never shuffled; the others join the
originals in one shuffle, whose hot digests adaptive execution splits (both sides
are plain exchanges).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import mark_possible, materialise, scratch_path

CRLF = "\r\n"
#: Payloads under this many bytes are never revisits.
LEAST = 100
#: Bytes from which a payload is kept apart, and bytes of payloads in a file.
LARGE, FILE_BYTES = 1 << 18, 1 << 30
#: Originals (a digest and an id each) that are broadcast; more are joined by a shuffle.
FEW = 200_000
RECORD_FIELDS = (
    "record_id string, record_type string, target_uri string, warc_date string, page_id long, payload_digest string, "
    "payload_bytes long, refers_to long, content_length long, block_digest string"
)


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary), payload_digest, payload_bytes."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    return rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})


def originals(heads: DataFrame, least: int = LEAST) -> DataFrame:
    """(digest, original) of payloads that occur more than once among headers
    (page_id, payload_digest, payload_bytes)."""
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id").alias("id")))
    grouped = heads.filter(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("digest")).agg(first["id"].alias("original"), F.count("*").alias("copies"))
    return grouped.filter("copies > 1").drop("copies")


def resolve(records: DataFrame, known: DataFrame) -> DataFrame:
    """Records with record_type and refers_to added, ``known`` being their
    :func:`originals`."""
    joined = records.join(known, records["payload_digest"] == known["digest"], "left")
    again = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("original"))}).drop("digest", "original")


def record_id(page_id: Column, digest: Column) -> Column:
    """A stable urn:uuid made from the page's id and payload; a fresh one without an id."""
    h = F.md5(F.concat(F.lit("page:"), page_id.cast("string"), F.lit(":"), digest))
    at = lambda a, n: F.substring(h, a, n)
    named = F.concat_ws("-", at(1, 8), at(9, 4), at(13, 4), at(17, 4), at(21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.when(page_id.isNull(), F.uuid()).otherwise(named), F.lit(">"))


def write_archives(records: DataFrame, path: str, *, date: str | None = None, records_per_file: int = 4000) -> None:
    """Adds records (page_id, url, payload, payload_digest, payload_bytes,
    record_type, refers_to) as gzip-compressed WARC/1.1 files to ``path``.  ``date``, of
    the fresh headers, is the moment of writing unless given."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    block = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("payload_digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        F.when(F.col("page_id").isNotNull(), line("X-Page-ID", F.col("page_id").cast("string"))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", record_id(F.col("refers_to"), F.col("payload_digest"))),
                line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
    )
    value = F.concat(head, block.cast("string"), F.lit(CRLF))
    records.select(value.alias("value")).write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).mode("append").text(path)


def parse_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record of a stream."""
    data, at, more = bytearray(), 0, True

    def need(until) -> bool:
        nonlocal more, at
        while not until():
            piece = next(chunks, None)
            if piece is None:
                return False
            del data[:at]
            at = 0
            data.extend(piece)
        return True

    while True:
        if not need(lambda: data.find(b"\r\n\r\n", at) >= 0):
            if bytes(data[at:]).strip():
                raise ValueError("a WARC record without an end of its header")
            return
        stop = data.find(b"\r\n\r\n", at)
        first, *lines = bytes(data[at:stop]).decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        at = stop + 4
        if not need(lambda: len(data) - at >= size + 4):
            raise ValueError("a WARC record is cut off")
        yield fields, bytes(data[at : at + size])
        at += size + 4


def _unzip(content: bytes, piece: int = 1 << 18) -> Iterator[bytes]:
    """Plain bytes, or the members of a gzip file one after another."""
    if content[:2] != b"\x1f\x8b":
        for i in range(0, len(content), piece):
            yield content[i : i + piece]
        return
    while content:
        z = zlib.decompressobj(31)
        view, at = memoryview(content), 0
        while at < len(view) and not z.eof:
            if out := z.decompress(view[at : at + piece]):
                yield out
            at += piece
        if out := z.flush():
            yield out
        content = bytes(z.unused_data) + bytes(view[at:]) if z.eof else b""


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row a record of the WARC files under ``path``."""
    schema = RECORD_FIELDS + (", payload binary" if with_payload else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        number = lambda v: None if v is None else int(v)
        kinds = [pa.int64() if f.endswith(" long") else pa.binary() if f.endswith(" binary") else pa.string() for f in schema.split(", ")]
        target = pa.schema(list(zip(names, kinds, strict=True)))
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for f, block in parse_records(_unzip(content.as_py())):
                    row = (
                        f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-date"), number(f.get("x-page-id")),
                        f.get("warc-payload-digest", "").removeprefix("sha256:"), number(f.get("x-payload-length")), number(f.get("x-refers-to-page-id")),
                        len(block), hashlib.sha256(block).hexdigest(),
                    )
                    rows.append(row + ((block,) if with_payload else ()))
                    held += len(block) * with_payload + 400
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=target)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=target)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, schema)


def archive_pages(pages: DataFrame, least: int = LEAST, *, large: int = LARGE, file_bytes: int = FILE_BYTES, **options: object) -> DataFrame:
    """Writes the deduplicated archives of ``pages`` (page_id, url, html) to the
    shared folder and returns what reading them back gives.  A response's block is
    hashed again on reading; a mismatch with its header raises."""
    spark = pages.sparkSession
    rows = headers(pages)
    heads = materialise(rows.select("page_id", "payload_digest", "payload_bytes"), "headers")
    known = materialise(originals(heads, least), "originals")
    longest = heads.agg(F.max("payload_bytes")).first()[0] or 0
    path = scratch_path(spark, "warc")
    if known.count() <= FEW:
        every = resolve(rows, F.broadcast(known))
    else:  # what may be a revisit joins the originals; the rest is all responses and stays where it is
        marked = mark_possible(rows, F.col("payload_digest"), known, "digest")
        alone = marked.filter("not _may").withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")})
        every = resolve(marked.filter("_may"), known).unionByName(alone).drop("_may")
    write_archives(every.filter(F.col("payload_bytes") < large), path, **options)
    if longest >= large:
        write_archives(every.filter(F.col("payload_bytes") >= large), path, **(options | {"records_per_file": max(1, file_bytes // longest)}))
    back = read_archives(spark, path)
    bad = (F.col("record_type") == "response") & ((F.col("block_digest") != F.col("payload_digest")) | (F.col("content_length") != F.col("payload_bytes")))
    checked = F.when(bad, F.raise_error(F.lit("a payload differs from its header")).cast("string")).otherwise(F.col("record_type"))
    return back.select("page_id", "payload_bytes", "payload_digest", checked.alias("record_type"), "refers_to", "record_id", "target_uri")
