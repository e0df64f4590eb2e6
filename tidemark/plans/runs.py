"""Running the plans: taking in the map, steps with retries, status and checks.

These are the driver's small pieces of work around the tables; nothing here touches
rows."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import temporal as D
from tidemark.functions import text as X
from tidemark.functions.lazy import arrow_function
from tidemark.operators import extract, report
from tidemark.schema import CARRIED, filled
from tidemark.sources import files, web

#: Least bytes of a map document, and the tag it must hold.
LEAST_MAP, MAP_TAG = 10_000, b"<kml"


def valid_map(content: bytes) -> bool:
    return len(content) >= LEAST_MAP and MAP_TAG in content[:5000].lower()


def fetch_map(url: str, attempts: int = 4, pause: float = 3.0, get: Callable[[str, web.Policy], web.Fetched] = web.fetch) -> tuple[bytes, int]:
    """The map at an address, tested, and the attempt that gave it; nothing is written."""
    policy = web.Policy(timeout=45, most=1 << 28)
    got, number = web.persistent([lambda: get(url, policy)] * attempts, lambda x: x.status == 200 and valid_map(x.body), pause)
    if got.status != 200 or not valid_map(got.body):
        raise RuntimeError(f"no valid map after {attempts} attempts: status {got.status}, {len(got.body)} bytes")
    return got.body, number


def take_in_map(url: str, target: str, **options: object) -> dict:
    """Puts the map in place in one step, with its SHA-256 beside it; says whether it
    changed.  A failed download leaves the old file."""
    content, attempt = fetch_map(url, **options)
    digest, place = hashlib.sha256(content).hexdigest(), Path(target)
    mark = place.with_name(place.name + ".sha256")
    old = mark.read_text().split()[0] if mark.exists() else ""
    for path, data in ((place, content), (mark, f"{digest}\n".encode())):
        staged = path.with_name(path.name + ".tmp")
        staged.write_bytes(data)
        os.replace(staged, path)
    return {"bytes": len(content), "sha256": digest, "markers": content.count(b"<Placemark"), "attempts": attempt, "changed": digest != old}


def run_step(name: str, step: Callable[[], object], attempts: int = 1, pause: float = 15.0) -> dict:
    """Runs a step with retries; what happened, as a row for the status."""
    began, fault, result = time.time(), "", None
    for attempt in range(1, attempts + 1):
        try:
            result, fault = step(), ""
            break
        except Exception as e:  # noqa: BLE001 - a step's fault is its result
            fault = f"{type(e).__name__}: {e}"[:500]
            if attempt < attempts:
                time.sleep(pause * attempt)
    return {"name": name, "ok": not fault, "attempts": attempt, "seconds": round(time.time() - began, 2), "fault": fault, "result": result}


def orchestrate(steps: list[tuple[str, Callable[[], object], int, Callable[[object], str] | None]], undo: Callable[[], None], pause: float = 15.0) -> dict:
    """Steps in turn, each with its attempts and a gate that names a fault; at the
    first failure everything is undone."""
    done: list[dict] = []
    for name, step, attempts, gate in steps:
        row = run_step(name, step, attempts, pause)
        if row["ok"] and gate and (fault := gate(row["result"])):
            row |= {"ok": False, "fault": fault}
        done.append({k: v for k, v in row.items() if k != "result"})
        if not row["ok"]:
            undo()
            return {"ok": False, "failed_at": name, "message": row["fault"], "steps": done}
    return {"ok": True, "failed_at": "", "message": "", "steps": done}


def status_row(facts: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """The one row of ``facts`` with ``ok`` and the names of failed checks."""
    ok, failed = report.checks_status(checks)
    return facts.withColumns({"ok": ok, "failed_checks": failed})


def status_text(status: dict) -> str:
    """A status as lines to read."""
    head = "OK" if status.get("ok") else "ATENCAO: " + ", ".join(status.get("failed_checks") or ["?"])
    return "\n".join([head, *(f"{k}: {json.dumps(v, ensure_ascii=False, default=str)}" for k, v in status.items() if k not in ("ok", "failed_checks"))]) + "\n"


# --- the diagnostic ------------------------------------------------------------------

@dataclass(frozen=True)
class Site:
    """Where a run's files are under their root, and what they must say."""

    domain: str
    summary: str = "summary.json"
    lots: str = "lotes.json"
    events_csv: str = "eventos_futuros.csv"
    yards_csv: str = "patios.csv"
    lots_csv: str = "lotes.csv"
    schedule: str = "schedule.yml"
    page: str = "index.html"
    host: str = "CNAME"
    runner: str = "run.py"
    page_data: str = 'id="data"'
    required: tuple[str, ...] = ()


# What a schedule says that can be started by hand, runs every six hours and may save.
BY_HAND, EVERY_SIX_HOURS, MAY_SAVE = "workflow_dispatch:", "17 */6 * * *", "contents: write"
# What a diagnostic keeps of the status before.
KEPT = (
    "ultima_execucao", "erro_em", "mensagem", "base_anterior_restaurada", "lotes_antes", "lotes_depois", "lotes_novos_detectados", "lotes_removidos_ou_encerrados", "etapas",
)


def gather(spark: SparkSession, root: str, site: Site, now: str) -> DataFrame:
    """One row of facts about the published files under ``root``."""

    def text(name: str) -> str:
        path = f"{root}/{name}"
        return spark.read.text(path, wholetext=True).first()["value"] if files.path_exists(spark, path) else ""

    summary, lots = files.read_object(spark, f"{root}/{site.summary}"), files.read_totals(spark, f"{root}/{site.lots}")
    listed = files.snapshot_rows(spark, f"{root}/{site.lots}").count()
    csv = {k: files.count_csv(spark, f"{root}/{getattr(site, k)}") for k in ("events_csv", "yards_csv", "lots_csv")}
    row = {
        "missing": [n for n in site.required if not files.path_exists(spark, f"{root}/{n}")], "schedule": text(site.schedule), "page": text(site.page), "host": text(site.host).strip(),
        **csv, "lots_json": listed, "events_moment": str(summary.get("atualizado_em", "")), "lots_moment": str(lots.get("atualizado_em", "")),
        "future": int(summary.get("eventos_futuros_ou_hoje") or csv["events_csv"]), "yards": int(summary.get("patios") or csv["yards_csv"]),
        "lots": int(lots.get("total_lotes") or listed), "captured": int(lots.get("total_lotes_capturados_agora") or 0),
        "carried": int(lots.get("total_lotes_preservados") or 0), "events_with_lots": int(lots.get("eventos_com_lotes") or 0),
    }
    kinds = ", ".join(f"{k} {'array<string>' if k == 'missing' else 'long' if isinstance(v, int) else 'string'}" for k, v in row.items())
    facts = spark.createDataFrame([tuple(row.values())], kinds)
    moment = F.to_timestamp(F.lit(now))
    return facts.withColumns({f"{k}_age": D.age_hours(D.parse_moment(f"{k}_moment"), moment) for k in ("events", "lots")})


def fourteen_checks(site: Site) -> dict[str, Column]:
    """The checks of the diagnostic over :func:`gather`'s facts, by their published names."""
    says = lambda c, what: F.col(c).contains(what)
    fresh = lambda c: F.coalesce(F.col(c) <= report.STATUS_HOURS, F.lit(False))
    # Names of the checks, in order.
    return {
        "arquivos_obrigatorios": F.size("missing") == 0, "workflow_existe": F.col("schedule") != "", "workflow_execucao_manual": says("schedule", BY_HAND),
        "workflow_agendado_6h": says("schedule", EVERY_SIX_HOURS), "workflow_pode_salvar": says("schedule", MAY_SAVE), "workflow_executa_indexador": says("schedule", site.runner),
        "eventos_csv_ok": F.col("events_csv") > 0, "lotes_json_ok": F.col("lots_json") > 0, "lotes_csv_consistente": F.col("lots_csv") == F.col("lots_json"),
        "site_gerado": F.octet_length("page") > report.LEAST_PAGE, "base_embutida_no_site": says("page", site.page_data), "dominio_configurado": F.col("host") == site.domain,
        "base_eventos_recente": fresh("events_age"), "base_lotes_recente": fresh("lots_age"),
    }


def diagnose(facts: DataFrame, site: Site, earlier: dict, fail_on_attention: bool = False) -> tuple[dict, int]:
    """The status of a run and the exit code: 1 for a status that asks for attention,
    if that is to fail.  Values of the ``earlier`` status are kept."""
    row = status_row(facts, fourteen_checks(site)).drop("schedule", "page").first().asDict()
    status = {"status": "ok" if row["ok"] else "atencao", **row, **{k: earlier[k] for k in KEPT if k in earlier}}
    return status, int(fail_on_attention and not row["ok"])


# Published names of a status's facts, in order.
STATUS = {
    "atualizado_em_base_eventos": "events_moment", "atualizado_em_base_lotes": "lots_moment", "idade_base_eventos_horas": "events_age", "idade_base_lotes_horas": "lots_age",
    "eventos_futuros": "future", "patios": "yards", "lotes": "lots", "lotes_capturados_agora": "captured", "lotes_preservados": "carried", "eventos_indexados_com_lotes": "events_with_lots",
}
# Lines of the readable status, in order, with the field of each and what stands for a missing one.
LINES = (
    ("Status", "status", None), ("Verificado em", "verificado_em", None), ("Base de eventos", "atualizado_em_base_eventos", None), ("Base de lotes", "atualizado_em_base_lotes", None),
    ("Idade da base de eventos", "idade_base_eventos_horas", None), ("Idade da base de lotes", "idade_base_lotes_horas", None), ("Eventos futuros", "eventos_futuros", None),
    ("Lotes disponíveis", "lotes", None), ("Lotes capturados nesta execução", "lotes_capturados_agora", None), ("Lotes preservados", "lotes_preservados", None), ("Lotes antes", "lotes_antes", "-"),
    ("Lotes depois", "lotes_depois", "-"), ("Lotes novos detectados", "lotes_novos_detectados", "-"), ("Lotes removidos ou encerrados", "lotes_removidos_ou_encerrados", "-"), ("Pátios", "patios", None),
)
HOURS, FAULTY, NONE_FAULTY, MESSAGE = " horas", "Verificações com problema", "nenhuma", "Mensagem"


def published_status(facts: DataFrame, site: Site, moment: str, extra: dict) -> dict:
    """The published status of :func:`gather`'s facts: fixed fields, all checks by name,
    what is missing, and then ``extra``, which goes before them."""
    checks = fourteen_checks(site)
    said = [F.coalesce(c, F.lit(False)).alias(f"check {k}") for k, c in checks.items()]
    row = facts.select(*[F.col(c).alias(k) for k, c in STATUS.items()], F.col("missing").alias("arquivos_faltando"), *said).first().asDict()
    held = {k: row.pop(f"check {k}") for k in checks}
    missing = row.pop("arquivos_faltando")
    return {"status": "ok" if all(held.values()) else "atencao", "verificado_em": moment, **row, "checks": held, "arquivos_faltando": missing} | extra


def status_lines(status: dict) -> str:
    """A published status to read."""
    ending = lambda field: HOURS if field.endswith("_horas") else ""
    lines = [f"{label}: {status.get(field, missing)}{ending(field)}" for label, field, missing in LINES]
    failed = [name for name, held in status.get("checks", {}).items() if not held]
    lines.append(f"{FAULTY}: {', '.join(failed) or NONE_FAULTY}")
    if status.get("mensagem"):
        lines.append(f"{MESSAGE}: {status['mensagem']}")
    return "\n".join(lines) + "\n"


def write_status(status: dict, folder: str) -> None:
    """A published status as JSON and as lines, each put in place in one step."""
    for name, text in (("status_atualizacao.json", json.dumps(status, ensure_ascii=False, indent=2) + "\n"), ("status_atualizacao.txt", status_lines(status))):
        place = Path(folder) / name
        staged = place.with_name(name + ".tmp")
        staged.write_text(text, encoding="utf-8")
        os.replace(staged, place)


def keep_earlier(status: dict, earlier: dict, names: tuple[str, ...]) -> dict:
    """A status with the named values of an earlier one where it lacks them."""
    return status | {k: earlier[k] for k in names if k in earlier and not status.get(k)}


def write_output(name: str, value: str, variable: str = "GITHUB_OUTPUT") -> None:
    """A result for the build system, where it names a file for it."""
    if path := os.environ.get(variable):
        with open(path, "a", encoding="utf-8") as f:
            f.write(f"{name}={value}\n")


def recount(lots: DataFrame, status: str = "status_captura") -> DataFrame:
    """Totals of a cleaned snapshot: rows, and rows carried over."""
    return lots.agg(F.count("*").alias("total_lotes"), F.count_if(F.col(status).startswith(CARRIED)).alias("total_lotes_preservados"))


# --- dates from documents ----------------------------------------------------------

#: Answers that hold a document, links of an event and of a page that are looked at, and
#: pages of a notice.
ANSWERED, MOST_LINKS, NOTICE_PAGES = (200, 201, 202), 2, 6


@arrow_function("string")
def _first_pages(raw: list[bytes | None]) -> list[str | None]:
    return [None if b is None else web.pdf_text(b, NOTICE_PAGES) for b in raw]


def _documents(wanted: DataFrame, fetched: DataFrame, keys: list[str]) -> DataFrame:
    """The documents behind ``wanted`` (keys, url): keys, pdf, final_url, html, and what
    is found in them (data, data_original, hora, resumo)."""
    have = fetched.dropDuplicates(["url"]).select(F.col("url").alias("_url"), "status", "body", "content_type", F.coalesce(F.nullif("final_url", F.lit("")), "url").alias("final_url"))
    got = wanted.join(have, F.col("url") == F.col("_url")).filter(F.col("status").isin(*ANSWERED) & (F.length("body") > 0))
    got = got.withColumn("pdf", F.coalesce(web.is_pdf("final_url", "content_type", "body"), F.lit(False)))
    html = F.when(~F.col("pdf"), web.decoded(F.when(~F.col("pdf"), F.col("body")), F.col("content_type")))
    text = F.when(F.col("pdf"), X.clean_text(_first_pages(F.when(F.col("pdf"), F.col("body")))))
    got = got.withColumns({"html": html, "moment": extract.document_moment(F.coalesce(text, html))})
    return got.select(*keys, "pdf", "final_url", "html", "moment.*")


def inspect(events: DataFrame, fetched: DataFrame) -> DataFrame:
    """Dates found behind the first links of events (seq, link): seq, pos, data,
    data_original, hora, fonte, link_edital, resumo.

    A notice gives its own date.  A page gives that of the first of the notices it links
    to that has one, else its own; notices are looked at one level deep, and what a page
    links to is read from ``fetched`` as well (url, status, body, content_type,
    final_url)."""
    links = F.filter(F.transform(F.split(F.coalesce("link", F.lit("")), "[|]"), lambda u: F.trim(u)), lambda u: u != "")
    wanted = events.select("seq", F.posexplode(F.slice(links, 1, MOST_LINKS)).alias("pos", "url"))
    first = _documents(wanted, fetched, ["seq", "pos"])
    below = first.filter("not pdf").select("seq", "pos", F.posexplode(extract.notice_links("html", "final_url", MOST_LINKS, bare=True)).alias("k", "url"))
    second = _documents(below, fetched, ["seq", "pos", "k"]).filter("data <> ''")
    fields = lambda pdf: F.struct("data", "data_original", "hora", F.when(pdf, "edital_pdf").otherwise("site").alias("fonte"), F.when(pdf, F.col("final_url")).otherwise("").alias("link_edital"), "resumo")
    better = second.groupBy(F.col("seq").alias("_seq"), F.col("pos").alias("_pos")).agg(F.min_by(fields(F.col("pdf")), "k").alias("below"))
    joined = first.join(better, (F.col("seq") == F.col("_seq")) & (F.col("pos") == F.col("_pos")), "left")
    return joined.select("seq", "pos", F.coalesce("below", fields(F.col("pdf"))).alias("d")).select("seq", "pos", "d.*").filter("data <> ''")


def enrich(events: DataFrame, found: DataFrame, now: str) -> DataFrame:
    """Events with date, hour and notice taken from their documents: the first sane
    date in order of link.  ``found`` is what :func:`inspect` gives."""
    today = F.lit(now).cast("timestamp_ntz").cast("date")
    good = found.filter(D.sane_date("data", today))
    first = good.groupBy(F.col("seq").alias("_seq")).agg(F.min_by(F.struct("data", "data_original", "hora", "fonte", "link_edital", "resumo"), "pos").alias("d"))
    have = F.col("d").isNotNull()
    pick = lambda new, old: F.when(have, new).otherwise(old)
    new = {
        "data": pick(F.col("d.data"), F.col("data")), "data_original": pick(filled("d.data_original", "data_original"), F.col("data_original")),
        "hora_marcador": pick(filled("d.hora", "hora_marcador"), filled(D.clock("hora_marcador"), "hora_marcador")),
        "fonte_data_hora": pick(F.col("d.fonte"), F.col("fonte_data_hora")), "link_edital": pick(F.col("d.link_edital"), F.col("link_edital")), "resumo_edital": pick(F.col("d.resumo"), F.col("resumo_edital")),
    }
    return events.join(first, F.col("seq") == F.col("_seq"), "left").withColumns(new).drop("_seq", "d")

