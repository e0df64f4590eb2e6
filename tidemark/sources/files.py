"""Readers and writers of listings: CSV, JSON snapshots and map files."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schema as S
from tidemark.functions import temporal as D
from tidemark.functions import text as X
from tidemark.functions import urls as U
from tidemark.operators.dedupe import valid_lot
from tidemark.sources.scratch import release, written

CSV_OPTIONS = {"header": True, "multiLine": True, "escape": '"', "quote": '"', "encoding": "UTF-8", "enforceSchema": False}


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def read_csv(spark: SparkSession, path: str, fields: tuple[str, ...]) -> DataFrame:
    """Rows of a CSV file with header, nulls as empty, in the given layout; a missing
    file has no rows.  A byte order mark before the first name is dropped."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], S.strings(fields))
    df = spark.read.options(**CSV_OPTIONS).csv(path)
    return S.conform(df.toDF(*[c.lstrip("﻿") for c in df.columns]), fields)


def count_csv(spark: SparkSession, path: str) -> int:
    """Data rows of a CSV file; 0 for a missing one."""
    return spark.read.options(**CSV_OPTIONS).csv(path).count() if path_exists(spark, path) else 0


def write_csv(df: DataFrame, path: str, fields: tuple[str, ...], seq: str | None = None) -> None:
    """One CSV file of exactly the given columns, in order of ``seq``: an export for
    readers of a single file, not a store for large tables."""
    out = df.orderBy(seq) if seq else df
    S.conform(out, fields).coalesce(1).write.mode("overwrite").options(header=True, escape='"', quote='"', emptyValue="", lineSep="\n").csv(path)


#: How the lines before and behind a snapshot's lots end, when each lot has its own line.
HEAD, TAIL = '"lotes":[', "]}"
#: Characters of a text up to which a variant surely holds it.
VARIANT_SIGNS = 1 << 24


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the text under ``path`` with the JSON value in each (``row``), null in heads and tails."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    own = F.when(F.regexp_like("value", F.lit(r"^,?\{.*\}$")), F.regexp_replace("value", "^,", ""))
    return lines.withColumns({"head": F.col("value").startswith("{") & F.col("value").endswith(HEAD), "tail": F.col("value") == TAIL, "row": F.try_parse_json(own)})


def _by_lines(spark: SparkSession, path: str) -> str | None:
    """The head of a snapshot in which each lot has its own line (:func:`write_snapshot`), null of others."""
    odd = ~F.col("head") & ~F.col("tail") & F.col("row").isNull()
    first = F.col("row").isNotNull() & ~F.col("value").startswith(",")
    said = _lines(spark, path).agg(F.count_if("head").alias("heads"), F.count_if("tail").alias("tails"), F.count_if(odd).alias("odd"), F.count_if(first).alias("firsts"), F.max(F.when(F.col("head"), F.col("value"))).alias("head")).first()
    return said["head"] if (said["heads"], said["tails"], said["odd"]) == (1, 1, 0) and said["firsts"] <= 1 else None


def snapshot_rows(spark: SparkSession, path: str) -> DataFrame:
    """(seq, row): what is listed in a JSON snapshot, an object with ``lotes`` or a bare
    list, as variants; nothing when the file is missing or no JSON.

    Lines of lots are read in parallel and numbered by the counts of the blocks before
    theirs; any other document is one text."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "seq long, row variant")
    if _by_lines(spark, path) is None:
        text = F.col("value")
        parsed = F.try_parse_json(text)
        raw = spark.read.text(path, wholetext=True).select("value", parsed.alias("v"))
        inside = F.coalesce(F.expr("try_variant_get(v, '$.lotes', 'array<variant>')"), F.expr("try_variant_get(v, '$', 'array<variant>')"))
        # a variant has a greatest size; of longer documents each element is one
        large = F.when(F.col("v").isNull() & (F.length(text) > VARIANT_SIGNS), F.coalesce(F.from_json(text, "lotes array<variant>")["lotes"], F.from_json(text, "array<variant>")))
        return raw.select(F.posexplode(F.coalesce(inside, large)).alias("seq", "row")).select(F.col("seq").cast("long").alias("seq"), "row")
    lines = written(_lines(spark, path).select("file", "block", F.monotonically_increasing_id().alias("id"), "head", "tail", "row"), "snapshot-lines")
    blocks = lines.groupBy(F.col("file").alias("_file"), F.col("block").alias("_block")).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1))  # a row a block
    blocks = blocks.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    # said outright, as by their estimated sizes Spark would broadcast the lines
    placed = lines.join(F.broadcast(blocks), (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    return placed.filter("not head and not tail").select((F.col("before") + F.col("id") - F.col("first") - 1).alias("seq"), "row")  # the head is line 0


def read_snapshot(spark: SparkSession, path: str, only_valid: bool = True) -> DataFrame:
    """Lots of a JSON snapshot, an object with ``lotes`` or a bare list, with ``seq``;
    none when the file is missing or no JSON.  ``only_valid`` drops rows without a
    proper title."""
    rows = snapshot_rows(spark, path).filter(F.expr("schema_of_variant(row)").startswith("OBJECT"))
    fields = [F.coalesce(F.expr(f"try_variant_get(row, '$.{c}', 'string')"), F.lit("")).alias(c) for c in S.LOT_FIELDS]
    out = rows.select("seq", *fields)
    return out.filter(valid_lot(X.clean_text("titulo"), X.clean_text("lote"))) if only_valid else out


def read_object(spark: SparkSession, path: str) -> dict:
    """A small JSON object (a status, a summary) on the driver; {} when there is none.
    Several files are one text, in order of their names."""
    if not path_exists(spark, path):
        return {}
    parts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    try:
        value = json.loads("".join(r["value"] for r in parts.orderBy("file").collect()))
    except (ValueError, TypeError):
        return {}
    return value if isinstance(value, dict) else {}


def read_totals(spark: SparkSession, path: str) -> dict:
    """What a snapshot's object says beside its lots; {} when there is none."""
    if not path_exists(spark, path):
        return {}
    head = _by_lines(spark, path)
    value = json.loads(head + TAIL) if head else read_object(spark, path)
    return {k: v for k, v in value.items() if k != "lotes"}


def snapshot_payload(lots: DataFrame, totals: DataFrame, seq: str = "seq") -> DataFrame:
    """One row with the JSON text of a small snapshot: the single row of ``totals`` and
    all lots in order.  Those of any size are written by :func:`write_snapshot`."""
    listed = lots.agg(F.transform(F.array_sort(F.collect_list(F.struct(seq, F.struct(*S.LOT_FIELDS).alias("lot")))), lambda r: r["lot"]).alias("lotes"))
    return totals.crossJoin(listed).select(F.to_json(F.struct("*")).alias("value"))


def write_snapshot(lots: DataFrame, totals: DataFrame, path: str, seq: str = "seq", one_file: bool = True) -> None:
    """The JSON text of a snapshot, each lot a line: the single row of ``totals`` and all
    lots in order.  No row, and no task but the one that writes a single file line by
    line, holds it whole; otherwise it is the files under ``path`` in order of their names."""
    rows = written(lots.select(F.col(seq).alias("seq"), F.to_json(F.struct(*S.LOT_FIELDS)).alias("lot"), F.monotonically_increasing_id().alias("id")), "snapshot")
    first = rows.agg(F.min_by("id", F.struct("seq", "lot", "id")).alias("id")).first()["id"]  # the only one without a comma
    said = totals.select(F.to_json(F.struct("*")).alias("v")).select(F.concat(F.expr("substring(v, 1, length(v) - 1)"), F.when(F.col("v") == "{}", "").otherwise(","), F.lit(HEAD)).alias("line"))
    order = ("place", "seq", "lot", "id")
    around = lambda df, place: df.select(F.lit(place).alias("place"), *[F.lit(None).alias(c) for c in order[1:]], "line")
    listed = rows.select(F.lit(1).alias("place"), *order[1:], F.concat(F.when(F.col("id") == F.lit(first), "").otherwise(","), "lot").alias("line"))
    tail = lots.sparkSession.range(1).select(F.lit(TAIL).alias("line"))
    lines = listed.unionByName(around(said, 0)).unionByName(around(tail, 2)).orderBy(*order).select("line")
    (lines.coalesce(1) if one_file else lines).write.mode("overwrite").option("lineSep", "\n").text(path)
    release(rows)


def site_page(template: str, rows_json: str, marker: str) -> str:
    """A page with data put in place of the marker, closing tags in it escaped."""
    if marker not in template:
        raise ValueError("the template lacks its marker")
    return template.replace(marker, rows_json.replace("</", "<\\/"))


# --- map files -----------------------------------------------------------------

#: Markers that a task has in hand at a time.
AT_ONCE = 1000
MARKER = "name string, folder string, description string, address string, coordinates string, data map<string,string>"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def markers(document: str) -> Iterator[dict]:
    """Placemarks of a map document at any depth, with the name of the nearest folder
    around them.  A repeated data name keeps its last value."""
    return markers_in(ET.fromstring(document))


def markers_in(root: ET.Element) -> Iterator[dict]:
    """:func:`markers` of an element."""

    def text(e: ET.Element | None) -> str:
        return (e.text or "").strip() if e is not None else ""

    def child(e: ET.Element, name: str) -> ET.Element | None:
        return next((c for c in e if _local(c.tag) == name), None)

    stack = [(root, "")]
    while stack:
        element, folder = stack.pop()
        if _local(element.tag) == "Placemark":
            point = next((e for e in element.iter() if _local(e.tag) == "coordinates"), None)
            data = {(e.get("name") or "").strip(): text(child(e, "value")) for e in element.iter() if _local(e.tag) == "Data"}
            yield {**{k: text(child(element, k)) for k in ("name", "description", "address")}, "folder": folder, "coordinates": text(point), "data": data}
            continue
        inside = text(child(element, "name")) if _local(element.tag) == "Folder" else folder
        stack += [(c, inside) for c in reversed(element)]


def markers_of(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per marker of map documents (the ``keep`` columns and ``value``, the text),
    with ``seq``, its order in the document."""
    names = [f.split()[0] for f in MARKER.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * (len(names) - 1), pa.map_(pa.string(), pa.string())]
    kept = documents.select(F.struct(F.lit(0).alias("_"), *keep).alias("kept"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in enumerate(batch.column(1)):
                found = ((i, *[m[n] for n in names[:-1]], list(m["data"].items())) for i, m in enumerate(markers(raw.as_py())))
                while rows := list(islice(found, AT_ONCE)):
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(rows), pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["kept", "seq", *names])

    found = kept.mapInArrow(run, f"kept {kept.schema['kept'].dataType.simpleString()}, seq long, {MARKER}")
    return found.select(*[f"kept.{c}" for c in keep], "seq", *names)


def events_from_markers(rows: DataFrame, today: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Event rows from markers, with ``seq`` and the ``keep`` columns; ``today`` is an ISO
    date."""
    # Names of the map's data fields.
    value = lambda k: F.coalesce(F.try_element_at("data", F.lit(k)), F.lit(""))
    address = S.filled("address", value("LOCALIZAÇÃO"), value("ENDEREÇO DO PATIO"), value("LOCALIZAÇÃO ALTERNATIVA"))
    point = F.split(F.get(F.split(F.trim(F.regexp_replace("coordinates", r"\s+", " ")), " "), 0), ",")
    known = F.size(point) >= 2
    out = rows.withColumns(
        {
            "nome": F.col("name"), "camada": F.col("folder"), "data_original": value("DATA"), "hora_marcador": value("MARCADOR"),
            "endereco_ou_localizacao": address, "descricao": X.clean_html(S.filled(value("DESCRIÇÃO"), "description")),
            "site_leiloeiro": value("SITE DO LEILOEIRO"), "link": U.links_from(value("DESCRIÇÃO"), "description", value("SITE DO LEILOEIRO")),
            "longitude": F.when(known, F.get(point, 0)).otherwise(""), "latitude": F.when(known, F.get(point, 1)).otherwise(""),
            "fonte_data_hora": F.lit("mapa"), "link_edital": F.lit(""), "resumo_edital": F.lit(""), "iso": D.parse_date(value("DATA")),
        }
    ).drop("data")
    out = out.withColumnRenamed("iso", "data").withColumn("status_data", D.status_at_scan("data", F.lit(today).cast("date")))
    return out.withColumn("uf", D.infer_unit("nome", "endereco_ou_localizacao", "descricao")).select(*keep, "seq", *S.EVENT_FIELDS)
