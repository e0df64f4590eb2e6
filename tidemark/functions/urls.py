"""Addresses: parts, normal forms, candidates and the keys made from them.

There are several keys on purpose; they differ in case, query and fragment and are
not exchangeable."""

from __future__ import annotations

import html
import re
import urllib.parse

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import text as X
from tidemark.functions.lazy import arrow_function

# Patterns of addresses and of notices.
URL = r"(?i)https?://[^\s<>'\"]+"
PDF = r"(?i)\.pdf(?:$|[?#])"
DRIVE = "drive.google.com"


def _column(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def scheme(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(_column(c), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(c: Column | str) -> Column:
    """User, host and port, as written."""
    return F.regexp_extract(_column(c), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path(c: Column | str) -> Column:
    return F.regexp_extract(_column(c), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(c: Column | str) -> Column:
    return F.regexp_extract(_column(c), r"^[^?#]*\?([^#]*)", 1)


def domain(c: Column | str) -> Column:
    """The authority without any ``www.``; port and case stay."""
    return F.replace(authority(c), F.lit("www."), F.lit(""))


def host_counts_key(c: Column | str) -> Column:
    return F.coalesce(F.nullif(domain(c), F.lit("")), F.lit("sem_link"))


def all_urls(c: Column | str) -> Column:
    """Addresses in a text, without punctuation at their ends."""
    return F.transform(F.regexp_extract_all(_column(c), F.lit(URL), 0), lambda u: F.regexp_replace(u, r"[).,;\]]+$", ""))


def first_url(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(_column(c), URL, 0), r"[).,;]+$", "")


def links_from(*columns: Column | str) -> Column:
    """Distinct addresses of several texts, decoded and trimmed, joined by bars."""
    found = F.flatten(F.array(*[F.regexp_extract_all(_column(c), F.lit(URL), 0) for c in columns]))
    joined = X.unescape(F.array_join(found, "\x01"))  # decoded in one go; the separator occurs in no address
    return F.when(F.size(found) == 0, F.lit("")).otherwise(F.array_join(F.array_distinct(F.transform(F.split(joined, "\x01"), lambda u: F.regexp_replace(u, r"[).,;]+$", ""))), " | "))


def _parameter(q: Column, name: str) -> Column:
    raw = F.regexp_extract(q, rf"(?:^|&){name}=([^&]+)", 1)
    return F.coalesce(F.try_url_decode(raw), raw)


def unwrap_redirect(c: Column | str) -> Column:
    """The target of a search engine's redirect link, else the link."""
    u = _column(c)
    inner = _parameter(query(u), "q")
    wrapped = authority(u).endswith("google.com") & (path(u) == "/url") & (inner != "")
    return F.when(wrapped, inner).otherwise(u)


def drive_download(c: Column | str) -> Column:
    """The download address of a shared file, else the address."""
    u = _column(c)
    ident = S.filled(F.regexp_extract(path(u), "/file/d/([^/]+)", 1), _parameter(query(u), "id"))
    return F.when(authority(u).contains(DRIVE) & (ident != ""), F.concat(F.lit("https://drive.google.com/uc?export=download&id="), ident)).otherwise(u)


def resolved(base: str | None, url: str | None) -> str:
    """An address decoded once and resolved against its page; as it is when broken."""
    try:
        return urllib.parse.urljoin(base or "", html.unescape(url or ""))
    except ValueError:
        return url or ""


@arrow_function("string")
def _join(base: list[str | None], url: list[str | None]) -> list[str | None]:
    return [resolved(b, u) for b, u in zip(base, url, strict=True)]


def download_address(url: str) -> str:
    """:func:`drive_download` of one address, for those who read it."""
    parts = urllib.parse.urlsplit(url)
    if DRIVE not in parts.netloc:
        return url
    named = re.search("/file/d/([^/]+)", parts.path)
    ident = named[1] if named else urllib.parse.parse_qs(parts.query).get("id", [""])[0]
    return f"https://drive.google.com/uc?export=download&id={ident}" if ident else url


def plain_event_id(url: str) -> str:
    """:func:`event_id` of one address, for those who read it."""
    place = urllib.parse.urlsplit(url).path
    dashed = re.search(r"-(\d{5,})(?:[/?#]|$)", place)
    return dashed[1] if dashed else next((p for p in reversed(place.split("/")) if re.fullmatch(r"\d{5,}", p)), "")


@arrow_function("array<string>")
def _join_all(base: list[str | None], urls: list[list[str] | None]) -> list[list[str] | None]:
    return [[resolved(b, u) for u in us] if us is not None else None for b, us in zip(base, urls, strict=True)]


def absolute_all(base: Column | str, urls: Column) -> Column:
    """The addresses of an array, each resolved against their page."""
    none = F.expr("cast(array() as array<string>)")
    return F.when(F.size(urls) > 0, _join_all(_column(base), F.when(F.size(urls) > 0, urls))).otherwise(none)


def absolute(base: Column | str, c: Column | str) -> Column:
    """An address resolved against its page."""
    b, u = _column(base), _column(c)
    whole = u.rlike("(?i)^https?://[^/?#]+(/[^.&]*)?$")  # absolute already, nothing to resolve in it
    return F.when(whole, u).otherwise(_join(b, F.when(~whole, u)))


def served_by_api(c: Column | str) -> Column:
    host = domain(c)
    known = host.isin(*S.API_DOMAINS)
    for d in S.API_DOMAINS:
        known = known | host.endswith("." + d)
    return known


def is_notice(c: Column | str) -> Column:
    u = _column(c)
    return u.rlike(PDF) | domain(u).contains(DRIVE)


def candidate_class(c: Column | str) -> Column:
    """Order of candidates: offer interface, pages, notices, the search engine."""
    return F.when(served_by_api(c), 0).when(is_notice(c), 2).when(domain(c).endswith("google.com"), 3).otherwise(1)


def candidates(values: list[Column | str], most: int = 4) -> Column:
    """The addresses to try for an event, from its columns in order: distinct, by
    class, then by length, then by place; ``most`` of them."""

    def of(c: Column | str) -> Column:
        v = _column(c)
        found = all_urls(v)
        bare = F.trim(v)
        return F.when((F.size(found) == 0) & F.lower(bare).startswith("www."), F.array(F.concat(F.lit("https://"), bare))).otherwise(found)

    joined = F.flatten(F.array(*[of(c) for c in values]))
    decoded = F.split(X.unescape(F.array_join(joined, "\x01")), "\x01")
    distinct = F.array_distinct(F.transform(F.when(F.size(joined) > 0, decoded).otherwise(joined), unwrap_redirect))
    ranked = F.array_sort(F.transform(distinct, lambda u, i: F.struct(candidate_class(u).alias("c"), F.length(u).alias("n"), i.alias("i"), u.alias("url"))))
    return F.slice(F.transform(ranked, lambda r: r["url"]), 1, most)


def event_id(c: Column | str) -> Column:
    """Digits (five or more) that end a dashed path, else the last all-digit part."""
    p = path(c)
    dashed = F.regexp_extract(p, r"-(\d{5,})(?:[/?#]|$)", 1)
    parts = F.filter(F.split(p, "/"), lambda x: x.rlike(r"^\d{5,}$"))
    return S.filled(dashed, F.try_element_at(parts, F.lit(-1)))


def canonical(lot: Column | str, event: Column | str) -> Column:
    """The lot's link, else the event's, without fragment; case kept."""
    return F.trim(F.regexp_replace(S.filled(lot, event), "#.*$", ""))


def normalized(c: Column | str) -> Column:
    """Scheme and host folded, path as written, no query, no fragment, no slash at
    the end.  An address without scheme or host keeps its path likewise; one that
    cannot be taken apart (an open bracket in its host) is folded as a whole."""
    u = F.regexp_replace(_column(c), r"^(?U:\s)+|(?U:\s)+$", "")
    s, host = scheme(u), X.casefold(authority(u))
    rooted = F.regexp_replace(path(u), "/+$", "")
    p = F.when(rooted == "", "/").otherwise(rooted)
    slashed = F.when((host != "") & ~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p)
    full = F.concat(F.when(s != "", F.concat(s, F.lit(":"))).otherwise(""), F.when((host != "") | p.startswith("//"), F.concat(F.lit("//"), host)).otherwise(""), slashed)
    broken = authority(u).contains("[") != authority(u).contains("]")
    return F.when(u == "", "").when(broken, F.regexp_replace(X.casefold(u), "/+$", "")).otherwise(full)


def looks_like_lot(label: Column | str, link: Column | str) -> Column:
    """Whether a labelled link is a lot's: rules in order."""
    low = X.casefold(X.clean_text(label))
    host, p, q = domain(link), X.casefold(path(link)), X.casefold(query(link))
    any_of = lambda c, words: F.coalesce(F.greatest(*[c.contains(w).cast("int") for w in words]), F.lit(0)) == 1
    return (
        F.when((F.length(low) < 5) | low.isin(*S.NAVIGATION_LABELS), False)
        .when(any_of(host, S.SOCIAL_HOSTS), False)
        .when(low.rlike(X.LOT) | _column(label).rlike(X.PRICE) | any_of(p, S.LOT_PATHS), True)
        .otherwise(q.contains("lot") & ~p.contains("evento"))
    )


def image_url(value: Column | str, base: Column | str) -> Column:
    """An absolute address of a picture, or empty: no data, logo or icon."""
    raw = F.trim(F.replace(X.unescape(value), F.lit("\\/"), F.lit("/")))
    url = absolute(base, raw)
    low = F.lower(url)
    bad = F.greatest(*[low.contains(w).cast("int") for w in S.IMAGE_WORDS]) == 1
    good = (raw != "") & ~raw.rlike("^(data|blob|javascript):") & scheme(url).isin("http", "https") & (authority(url) != "") & ~bad & ~F.lower(path(url)).endswith(".svg")
    return F.when(good, url).otherwise("")


# --- keys --------------------------------------------------------------------


def title_link_key(title: Column | str, link: Column | str) -> Column:
    """Key of lots within a page, and of lots across events."""
    return X.casefold(F.concat(_column(title), F.lit("|"), _column(link)))


def final_key(event: Column | str, lot: Column | str, title: Column | str, link: Column | str) -> Column:
    return F.concat_ws("|", X.slugify(event), X.casefold(X.clean_text(lot)), X.casefold(X.clean_text(title)), X.casefold(link))


def stable_key(link: Column | str, event_link: Column | str, source: Column | str, event: Column | str, lot: Column | str, title: Column | str) -> Column:
    """Key across snapshots: the link folded, without fragment, query kept; else the
    host and three fields."""
    u = X.casefold(F.regexp_replace(F.regexp_replace(X.clean_text(link), "#.*$", ""), "/+$", ""))
    parts = F.concat_ws("|", domain(S.filled(event_link, source)), X.slugify(event), X.casefold(X.clean_text(lot)), X.casefold(X.clean_text(title)))
    return F.when(u != "", F.concat(F.lit("url:"), u)).otherwise(F.concat(F.lit("dados:"), parts))


def run_key(link: Column | str, *fields: Column | str) -> Column:
    """Key of an orchestrated run: the normalised link, else folded fields."""
    return F.when(F.trim(_column(link)) != "", F.concat(F.lit("url:"), normalized(link))).otherwise(F.concat(F.lit("dados:"), F.concat_ws("|", *[X.fold(c) for c in fields])))


def merge_key(lot_link: Column | str, event_link: Column | str, event: Column | str, lot: Column | str, title: Column | str) -> Column:
    """Key of the site's merge: the canonical link, case kept, else three fields."""
    link = canonical(lot_link, event_link)
    return F.when(link != "", link).otherwise(X.casefold(F.concat_ws("|", _column(event), _column(lot), _column(title))))


def event_date_key(name: Column | str, day: Column | str) -> Column:
    """Event and date for carrying forward: the name as a slug."""
    return F.concat(X.slugify(name), F.lit("|"), X.clean_text(day))


def site_event_key(name: Column | str, day: Column | str) -> Column:
    """Event and date for the site's lookup: the name folded, accents kept."""
    return F.concat(X.casefold(X.collapse(_column(name))), F.lit("|"), _column(day))
