"""Dates, hours and the filters on them.  ``now`` is always given (a literal
timestamp without zone, local time), never read from a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import text as X

# Patterns of dates and hours.
NUMERIC = r"(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})"
LONG = r"(?iu)(\d{1,2})(?U:\s)+de(?U:\s)+(janeiro|fevereiro|mar[cç]o|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)(?:(?U:\s)+de)?(?U:\s)+(\d{4})"
HOUR = r"(?i)(?<!\d)(\d{1,2})(?:[:h](\d{2}))?\s*(?:horas?|hrs?)?(?!\d)"
LISTED_HOUR = r"(?i)(\d{1,2})[:h](\d{2})?"
ISO = r"^\d{4}-\d{2}-\d{2}$"
LOOSE_ISO = r"^\d{4}-\d{1,2}-\d{1,2}$"


def _column(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def date_of(day: Column, month: Column, year: Column) -> Column:
    """A date from parts as text, null when there is none; years under 100 are of
    this century."""
    y = F.when(year.try_cast("int") < 100, year.try_cast("int") + 2000).otherwise(year.try_cast("int"))
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.try_to_date(F.when(y > 0, text), "yyyy-MM-dd")


def parse_date(c: Column | str) -> Column:
    """ISO text of the first d/m/y in a text, empty when there is none or it is no
    date."""
    part = lambda k: F.regexp_extract(_column(c), NUMERIC, k)
    return F.coalesce(date_of(part(1), part(2), part(3)).cast("string"), F.lit(""))


def parse_long_date(c: Column | str) -> Column:
    """The same for dates with a month's name."""
    part = lambda k: F.regexp_extract(_column(c), LONG, k)
    name = F.replace(F.lower(part(2)), F.lit("ç"), F.lit("c"))
    month = F.array_position(F.array(*[F.lit(m.replace("ç", "c")) for m in S.MONTHS]), name)
    return F.coalesce(date_of(part(1), month.cast("string"), part(3)).cast("string"), F.lit(""))


def clock(c: Column | str) -> Column:
    """HH:mm of the first hour in a text, empty when it is out of range."""
    h, m = F.regexp_extract(_column(c), HOUR, 1).try_cast("int"), F.coalesce(F.regexp_extract(_column(c), HOUR, 2).try_cast("int"), F.lit(0))
    return F.when((h <= 23) & (m <= 59), F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"))).otherwise("")


def listed_minutes(c: Column | str) -> Column:
    """Minutes of a listed hour, which needs a separator and is clamped to the day;
    null when there is none."""
    h = F.regexp_extract(_column(c), LISTED_HOUR, 1).try_cast("int")
    m = F.coalesce(F.regexp_extract(_column(c), LISTED_HOUR, 2).try_cast("int"), F.lit(0))
    return F.when(h.isNotNull(), F.least(h, F.lit(23)) * 60 + F.least(m, F.lit(59)))  # least() would skip a null


def api_moment(c: Column | str) -> tuple[Column, Column]:
    """Date and hour texts of an interface's time stamp."""
    p = r"(\d{4}-\d{2}-\d{2})[ T](\d{1,2}:\d{2})"
    return F.regexp_extract(_column(c), p, 1), F.regexp_extract(_column(c), p, 2)


def status_at_scan(day: Column | str, today: Column) -> Column:
    d = F.try_to_date(F.when(_column(day).rlike(ISO), _column(day)), "yyyy-MM-dd")
    return F.when(d.isNull(), S.UNDATED).when(d >= today, S.FUTURE).otherwise(S.PAST)


def upcoming(day: Column | str, hour: Column | str, now: Column, mode: str) -> Column:
    """Whether a record is still to come: a later day, or today without a known hour
    or with one after ``now``.  Modes: ``event`` (bare hours count, those out of range
    are unknown, dates are ISO), ``lot`` (hours need a separator and are clamped,
    dates may lack zeros), ``site`` (as lots, dates are ISO)."""
    raw = X.clean_text(day) if mode == "lot" else F.trim(_column(day)) if mode == "site" else _column(day)
    d = F.try_to_date(F.when(raw.rlike(LOOSE_ISO if mode == "lot" else ISO), raw), "y-M-d")
    if mode == "event":
        text = clock(hour)
        minutes = F.when(text != "", F.substring(text, 1, 2).try_cast("int") * 60 + F.substring(text, 4, 2).try_cast("int"))
    else:
        minutes = listed_minutes(X.clean_text(hour) if mode == "lot" else hour)
    today = now.cast("date")
    passed = F.hour(now) * 60 + F.minute(now)
    return d.isNotNull() & F.coalesce(F.when(d > today, True).when(d < today, False).when(minutes.isNull(), True).otherwise(minutes > passed), F.lit(False))


def updated_status(day: Column | str, hour: Column | str, now: Column) -> Column:
    return F.when(upcoming(day, hour, now, "event"), S.FUTURE).otherwise(S.PAST)


def sane_date(day: Column | str, today: Column) -> Column:
    """A captured date is taken from two days ago to 370 days ahead."""
    d = F.try_to_date(F.when(_column(day).rlike(ISO), _column(day)), "yyyy-MM-dd")
    return F.coalesce(d.between(F.date_sub(today, 2), F.date_add(today, 370)), F.lit(False))


def parse_moment(c: Column | str) -> Column:
    """A timestamp from ISO text, null for other text; without a zone it is local time
    of the listings."""
    v = F.trim(_column(c))
    iso = v.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?$")
    zoned = v.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    whole = F.when(zoned, F.regexp_replace(v, r"([+-]\d{2})(\d{2})$", "$1:$2")).otherwise(F.concat(v, F.when(v.rlike(r":\d{2}:\d{2}"), "").otherwise(":00"), F.lit(" " + S.TIMEZONE)))
    return F.when(iso, whole).try_cast("timestamp")


def version(now: Column) -> Column:
    """The version that a run at ``now`` publishes."""
    return F.date_format(now, "'v'yyyy.MM.dd.HHmm")


def age_seconds(moment: Column, now: Column) -> Column:
    return F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(moment.cast("timestamp"))


def age_hours(moment: Column, now: Column) -> Column:
    """Hours since, to two digits; negative for the future."""
    return F.round(age_seconds(moment, now) / 3600, 2)


def is_recent(moment: Column, now: Column, most_hours: float = 8.0) -> Column:
    """At most ``most_hours`` old, and at most one hour ahead."""
    age = age_seconds(moment, now)
    return F.coalesce(age.between(-3600, int(most_hours * 3600)), F.lit(False))


def infer_unit(*columns: Column | str) -> Column:
    """The first valid unit code after a dash, comma or slash, else after any
    separator; upper case only."""
    merged = F.concat_ws(" ", *[_column(c) for c in columns])
    tight = F.regexp_extract_all(merged, F.lit(r"[-,/](?U:\s)*([A-Z]{2})(?:(?U:\s)|,|$)"), 1)
    loose = F.regexp_extract_all(merged, F.lit(r"(?:^|(?U:\s)|[,\-/])([A-Z]{2})(?:(?U:\s)|,|$)"), 1)
    first = lambda codes: F.get(F.filter(codes, lambda u: u.isin(*S.UNIT_CODES)), 0)
    return F.coalesce(first(tight), first(loose), F.lit(""))
