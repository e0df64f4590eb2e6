"""The published files: exports of the plans' tables for readers of single files.

Tables are written as Parquet by :func:`pipelines.publish`; what is written here are
small JSON, CSV and page files beside them, under a staging path like everything else."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import text as X
from tidemark.operators import dedupe, report
from tidemark.sources import files

#: The files of events.
EVENT_FILES = {"future": "eventos_futuros.csv", "events": "eventos_todos.csv", "yards": "patios.csv", "full": "base_completa.csv"}
# Published names of totals, in order.
SUMMARY = {
    "total_registros": "total_rows", "eventos_atualizacao": "events", "eventos_futuros_ou_hoje": "future", "patios": "yards", "eventos_com_link": "with_link",
    "eventos_com_data_hora_de_edital": "date_from_notice", "eventos_com_data_hora_de_site": "date_from_site", "eventos_por_uf": "by_unit", "datas": "by_date",
}
REPORT = {
    "lotes_antes": "rows_before", "lotes_depois": "rows_after", "lotes_realmente_novos": "new_keys", "lotes_removidos_ou_encerrados": "removed_keys", "lotes_preservados": "carried",
    "lotes_capturados_agora": "captured", "lotes_capturados_com_chave_nova": "fresh_new_keys", "eventos_analisados": "analysed", "eventos_com_lotes": "with_lots", "eventos_com_erro": "errors",
    "eventos_bloqueados": "blocked", "links_invalidos": "invalid", "quantidade_coletada_por_leiloeiro": "lots_by_host", "erros_por_leiloeiro": "errors_by_host", "urls_que_falharam": "failed_attempts",
}
# Status of a run without lots, and its further field.
FAILED_RUN, CANDIDATES = "falha_sem_portal_com_lotes", "lotes_candidatos_apos_limpeza"
TOTALS = {"eventos_com_lotes": "with_lots", "eventos_sem_lotes": "without_lots", "eventos_com_erro_ou_bloqueio": "errors"}
# What the page's data says of the next run, and its keys in order.
NEXT_UPDATE = "Atualização diária"
PAYLOAD = ("eventos", "patios", "lotes", "gerado_em", "proxima_atualizacao", "mapa", "versao", "editais_eventos", "lotes_com_edital")
#: The marker of the page's data, and the page that leads there.
MARKER = "__DATA__"
REDIRECT = '<!doctype html><html lang="pt-BR"><meta charset="utf-8"><meta http-equiv="refresh" content="0;url=./"><title>{0}</title><p><a href="./">{0}</a></p></html>\n'


def _named(names: dict[str, str]) -> list[Column]:
    return [F.col(c).alias(name) for name, c in names.items()]


def write_events(tables: dict[str, DataFrame], folder: str) -> None:
    """The four event files from what ``pipelines.refresh_events`` gives."""
    for key, name in EVENT_FILES.items():
        files.write_csv(tables[key], f"{folder}/{name}", S.EVENT_FIELDS, "seq")


def summary_json(totals: DataFrame, updated: str, day: str, download: str = "{}") -> str:
    """The summary of a refresh, from :func:`report.summary`, as JSON text."""
    value = totals.select(*_named(SUMMARY)).select(F.lit(updated).alias("atualizado_em"), F.lit(day).alias("data_base"), "*", F.parse_json(F.lit(download)).alias("download_kml"))
    text = value.select(F.to_json(F.struct("*")).alias("v")).first()["v"]
    return _as_lists(text, ("eventos_por_uf", "datas"))


def _as_lists(text: str, names: tuple[str, ...]) -> str:
    """JSON text in which the objects of the named lists are lists of their values."""
    value = json.loads(text)
    for n in names:
        value[n] = [list(x.values()) for x in value[n]]
    return json.dumps(value, ensure_ascii=False)


def report_json(run: DataFrame, moment: str, kept: bool = False) -> str:
    """The report of a run, from ``pipelines.update_report``; ``kept`` says that no source
    gave lots and the old base stays (``pipelines.failed_report``)."""
    ending = [F.lit(FAILED_RUN if kept else "ok").alias("status"), F.lit(kept).alias("base_anterior_preservada"), *([F.col("candidates").alias(CANDIDATES)] if kept else [])]
    values = run.select(F.lit(moment).alias("executado_em"), *_named(REPORT), *ending)
    return values.select(F.to_json(F.struct("*")).alias("v")).first()["v"]


def snapshot_totals(lots: DataFrame, fresh: DataFrame, logs: DataFrame, carried: DataFrame, moment: str) -> DataFrame:
    """The totals that stand before a snapshot's lots, as one row; ``carried`` are all
    rows taken over, those left out later too."""
    own = lots.agg(F.count("*").alias("total_lotes")).crossJoin(carried.agg(F.count("*").alias("total_lotes_preservados")))
    outcome = report.outcome_counters(logs).select(F.col("analysed").alias("total_eventos_lidos"), *_named(TOTALS))
    read = fresh.agg(F.count("*").alias("total_lotes_capturados_agora"))
    names = ("total_eventos_lidos", "total_lotes", "total_lotes_capturados_agora", "total_lotes_preservados", *TOTALS)
    return own.crossJoin(outcome).crossJoin(read).select(F.lit(moment).alias("atualizado_em"), *names)  # one row each


def write_snapshot(lots: DataFrame, fresh: DataFrame, logs: DataFrame, carried: DataFrame, moment: str, folder: str) -> None:
    """The lots as JSON with totals, and as CSV."""
    files.write_snapshot(lots, snapshot_totals(lots, fresh, logs, carried, moment), f"{folder}/lotes.json")
    files.write_csv(lots, f"{folder}/lotes.csv", S.LOT_FIELDS, "seq")


def clean_snapshot(spark: SparkSession, source: str, folder: str) -> int:
    """Checks stored lots anew without a network: invalid ones go, totals are counted
    again, both files are written under ``folder``.  How many are left.

    A file that holds no object raises a ValueError."""
    if not (payload := files.read_totals(spark, source)):
        raise ValueError(f"no snapshot in {source}")
    every = files.read_snapshot(spark, source, only_valid=False)
    lots = every.filter(dedupe.valid_lot(X.clean_text("titulo"), X.clean_text("lote")))
    counted = lots.agg(F.count("*").alias("total_lotes"), F.count_if(F.col("status_captura").startswith(S.CARRIED)).alias("total_lotes_preservados"))
    said = {k: v for k, v in payload.items() if not isinstance(v, (list, dict)) and k not in ("total_lotes", "total_lotes_preservados")}
    totals = counted.select(*[F.lit(v).alias(k) for k, v in said.items()], "*")
    files.write_snapshot(lots, totals, f"{folder}/lotes.json")
    files.write_csv(lots, f"{folder}/lotes.csv", S.LOT_FIELDS, "seq")
    return int(counted.first()["total_lotes"])


def site_pages(template: str, lots: DataFrame, events: DataFrame, yards: DataFrame, moment: str, version: str, title: str, old_name: str, embedded_map: str = "") -> dict[str, str]:
    """The page with the data in it, and the page that leads there from an old name, by
    file name.  ``events`` are those of ``pipelines.site_events``."""
    listed = lambda df, names, order, name: df.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*names).alias("_r")))), lambda r: r["_r"]).alias(name))
    value = listed(events, S.EVENT_FIELDS, "seq", "eventos").crossJoin(listed(yards, S.EVENT_FIELDS, "seq", "patios")).crossJoin(listed(lots, [c for c in S.LOT_FIELDS if c in lots.columns], "rank", "lotes"))
    counted = report.notice_counters(events, lots).select(F.col("events_with_notice").alias("editais_eventos"), F.col("lots_with_notice").alias("lotes_com_edital"))
    said = {"gerado_em": moment, "proxima_atualizacao": NEXT_UPDATE, "mapa": embedded_map, "versao": version}
    data = value.withColumns({k: F.lit(v) for k, v in said.items()}).crossJoin(counted).select(F.to_json(F.struct(*PAYLOAD)).alias("v")).first()["v"]
    return {"index.html": files.site_page(template, data, MARKER), old_name: REDIRECT.format(html.escape(title))}
