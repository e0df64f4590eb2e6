"""Offer objects of the interface as lots, from a variant column ``offer``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import temporal as D
from tidemark.functions import text as X
from tidemark.functions import urls as U


#: Fields of an offer that a lot is made from.
_PATHS = {
    "short": "product.shortDesc", "product": "product.description", "own_title": "title", "detail_title": "offerDetail.title", "detail": "offerDetail.description", "id": "id",
    "about": "offerDescription", "about_offer": "offerDescription.offerDescription", "about_text": "offerDescription.description", "kind": "product.productTypeDescription", "category": "product.categoryDescription",
    "address": "product.location.address", "city": "product.location.city", "state_code": "product.location.stateCode", "state": "product.location.state",
    "price": "priceFormatted", "bid": "currentBidFormatted", "lot": "lotNumberDesc", "lot_number": "lotNumber", "auction": "auction.desc", "end": "endDate",
}
_TITLES = ("short", "product", "own_title", "detail_title", "detail")


def _once(rows: DataFrame, name: str, **made: Column) -> DataFrame:
    """``rows`` with a struct ``name`` of columns that are computed once a row, however
    often they are used: nothing is merged with an explode or pushed below it."""
    return rows.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))).alias(name))


def titled(rows: DataFrame, keep: dict[str, Column] | None = None) -> DataFrame:
    """Rows with an ``offer`` that has a title, with structs ``raw`` (texts of its fields)
    and ``named`` (``title`` and the ``keep`` columns, made from ``raw``) instead of it."""
    fields = _once(rows, "raw", **{k: F.expr(f"try_variant_get(offer, '$.{p}', 'string')") for k, p in _PATHS.items()}).drop("offer")
    clean = _once(fields, "tidy", **{k: X.clean_text(F.col(f"raw.{k}")) for k in _TITLES}, **(keep or {}))
    ident = offer_ident()
    title = S.filled(*[F.col(f"tidy.{k}") for k in _TITLES], F.when(ident != "", F.concat(F.lit("Lote "), ident)))
    return _once(clean, "named", title=title, **{k: F.col(f"tidy.{k}") for k in keep or ()}).drop("tidy").filter(F.col("named.title") != "")


def offer_ident() -> Column:
    return F.trim(F.coalesce(F.col("raw.id"), F.lit("")))


def offer_description() -> Column:
    raw = lambda k: F.col(f"raw.{k}")
    own = S.filled(raw("about_offer"), raw("about_text"), F.when(~F.coalesce(raw("about"), F.lit("")).startswith("{"), raw("about")))
    return F.concat_ws(" | ", *[F.nullif(c, F.lit("")) for c in (own, raw("product"), raw("kind"), raw("category"))])


def offer_place() -> Column:
    return F.concat_ws(", ", *[F.nullif(F.col(f"raw.{k}"), F.lit("")) for k in ("address", "city", "state_code", "state")])


def offer_link(source: str | Column, slug: Column) -> Column:
    s = F.col(source) if isinstance(source, str) else source
    ident = offer_ident()
    made = F.concat(S.filled(U.scheme(s), F.lit("https")), F.lit("://"), S.filled(U.authority(s), F.lit("www.sold.com.br")), F.lit("/oferta/"), slug, F.lit("-"), ident)
    return F.when(ident == "", s).otherwise(made)


def event_base(source: str, link: str, status: Column, captured: Column) -> dict[str, Column]:
    """What a lot takes over from its event's columns and its source."""
    notice = F.when(U.is_notice(source), F.col(source)).otherwise("")
    return {
        "leiloeiro": U.domain(S.filled(source, link)), "evento": S.filled("nome"), "data": S.filled("data"), "data_original": S.filled("data_original"),
        "hora": S.filled("hora_marcador"), "uf": S.filled("uf"), "local": S.filled("endereco_ou_localizacao"), "link_evento": F.col(link),
        "link_edital": S.filled("link_edital", notice), "resumo_edital": S.filled("resumo_edital"), "fonte": S.filled(source, link),
        "capturado_em": captured, "status_captura": status,
    }


def lots_from_offers(rows: DataFrame, captured: str, source: str = "source_url", link: str = "event_url", keep: tuple[Column, ...] = ()) -> DataFrame:
    """Lots from event rows with an ``offer``; offers without a title are left out.
    The offer's own date, hour and place go before the event's; ``keep`` names further
    columns to pass on."""
    about = {"about": offer_description(), "place": offer_place(), "price": S.filled("raw.price", "raw.bid"), "lot": S.filled("raw.lot", "raw.lot_number")}
    made = titled(rows, {k: X.clean_text(c) for k, c in (about | {"auction": F.col("raw.auction")}).items()})
    made = _once(made, "linked", title=X.clean_text("named.title"))
    title, (day, hour) = F.col("named.title"), D.api_moment("raw.end")
    base = event_base(source, link, F.lit("api_superbid_ok"), F.lit(captured))
    base |= {
        "titulo": F.substring(title, 1, 240), "descricao": F.substring("named.about", 1, 600), "lance_atual": F.col("named.price"), "lote": F.col("named.lot"),
        "evento": S.filled("nome", "named.auction"), "data": S.filled(day, "data"), "hora": S.filled(hour, "hora_marcador"),
        "local": S.filled("named.place", "endereco_ou_localizacao"), "link_lote": offer_link(source, X.slug("linked.title")), "foto_lote": F.lit(""),
    }
    return made.select(*keep, *[base[c].alias(c) for c in S.LOT_FIELDS])
