"""Text cleaning, folding and extraction as columns.

Expressions stay in the JVM.  Unicode decomposition and full case folding, which it lacks,
are tables made once from Python's Unicode data: characters that become one or none by
``translate``, those that become several by a lookup in the texts that hold such.
Character references are an Arrow function that only gets the rows which need it.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.lazy import arrow_function

# Patterns of blanks, prices and lot numbers.
# All blanks of Unicode, and the four separators that count as blanks beside them.
BLANK = r"(?U)[\s\x1c-\x1f]"
PRICE = r"(?i)R\$[\s\u00a0\u2000-\u200a\u202f\u3000]?[\d.,]+"
LOT = r"(?iu)\b(?:lote|lt\.?)(?U:\s)*[:#º°-]?(?U:\s)*(\d+[A-Za-z]?)"
#: A number with a clause's dot, such as 9.19, is a paragraph of a notice.
CLAUSE = r"^\d+\.\d{2,}$"


@arrow_function("string", nulls=True)
def _unescape(texts: list[str | None]) -> list[str | None]:
    return [None if t is None else html.unescape(t) for t in texts]


def _without_accents(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


#: Hangul syllables decompose by a rule: first, last, and the numbers of their parts.
_HANGUL, _JAMO = (0xAC00, 0xD7A3), ((0x1100, 19), (0x1161, 21), (0x11A7, 28))
_ENDS, _MEANS = "\x01", "\x02"
#: Where the blocks of Latin letters end.
_LATIN = 0x250


class _Table:
    """What a rule makes of each character, as arguments of ``translate`` and a lookup."""

    def __init__(self, rule: Callable[[str], str]) -> None:
        changed = {c: made for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if (made := rule(c)) != c}
        self.hangul = chr(_HANGUL[0]) in changed
        many = {c: made for c, made in changed.items() if len(made) > 1 and not (self.hangul and _HANGUL[0] <= ord(c) <= _HANGUL[1])}
        one = {c: made for c, made in changed.items() if len(made) == 1}
        self.source = "".join(one) + "".join(c for c, made in changed.items() if not made)
        self.target = "".join(one.values())
        self.pairs = _ENDS.join(c + _MEANS + made for c, made in many.items())
        listed = {*map(ord, many), *(range(_HANGUL[0], _HANGUL[1] + 1) if self.hangul else ())}
        self.several = _class(listed)
        # a class of many ranges is asked range by range, so characters that texts are full of are told apart before
        self.any = f"(?=[^\\x00-\\x7F])(?=[^{_class(set(range(0x80, _LATIN)) - listed)}])[{self.several}]"

    def __call__(self, v: Column) -> Column:
        named = F.str_to_map(F.lit(self.pairs), F.lit(_ENDS), F.lit(_MEANS))
        one = lambda p: F.coalesce(F.try_element_at(named, p), p)
        if self.hangul:
            plain = one
            one = lambda p: F.when(F.ascii(p).between(*_HANGUL), _syllable(F.ascii(p) - _HANGUL[0])).otherwise(plain(p))
        parts = F.regexp_extract_all(v, F.lit(f"[{self.several}]|[^{self.several}]+"), 0)
        looked_up = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^[{self.several}]"), one(p)).otherwise(p)), "")
        return F.translate(F.when(v.rlike(self.any), looked_up).otherwise(v), self.source, self.target)


def _syllable(number: Column) -> Column:
    """The letters of a Hangul syllable; the third may be none."""
    (lead, _), (vowel, vowels), (tail, tails) = _JAMO
    letter = lambda first, n, k: F.substring(F.lit("".join(chr(first + i) for i in range(n))), (k + 1).cast("int"), F.lit(1))
    last = F.pmod(number, F.lit(tails))
    whole = letter(lead, _JAMO[0][1], F.floor(number / (vowels * tails))), letter(vowel, vowels, F.pmod(F.floor(number / tails), F.lit(vowels)))
    return F.concat(*whole, F.when(last == 0, "").otherwise(letter(tail, tails, last)))


def _class(codes: set[int]) -> str:
    """What stands in the brackets of a character class."""
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _ranges([*codes]))


def _ranges(codes: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for c in sorted(codes):
        if out and c == out[-1][1] + 1:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out


@cache
def _table(rule: Callable[[str], str]) -> _Table:
    return _Table(rule)


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _where_needed(value: Column, needs: Column, slow, fast: Column) -> Column:
    return F.coalesce(slow(F.when(needs, value)), fast)


def unescape(c: Column | str) -> Column:
    """Character references decoded once; null is empty."""
    v = F.coalesce(_column(c), F.lit(""))
    return _where_needed(v, v.contains("&"), _unescape, v)


def collapse(c: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, BLANK + "+", " "))


def clean_text(c: Column | str) -> Column:
    return collapse(F.regexp_replace(unescape(c), "<[^>]+>", " "))


_TAGS = re.compile(r"<[^>]+>")


def plain_text(value: str | None) -> str:
    """:func:`clean_text` of one text, for parsers and readers."""
    text = html.unescape(value or "")
    return " ".join((_TAGS.sub(" ", text) if "<" in text else text).split())


def clean_html(c: Column | str) -> Column:
    """As :func:`clean_text`, with line breaks shown as bars and references decoded a
    second time at the end."""
    lines = F.regexp_replace(unescape(c), r"(?i)<br\s*/?>", " | ")
    return collapse(unescape(F.regexp_replace(lines, "<[^>]+>", " ")))


def strip_accents(c: Column | str) -> Column:
    v = F.coalesce(_column(c), F.lit(""))
    return F.when(v.rlike(r"[^\x00-\x7F]"), _table(_without_accents)(v)).otherwise(v)


def casefold(c: Column | str) -> Column:
    v = F.coalesce(_column(c), F.lit(""))
    return F.when(v.rlike(r"[^\x00-\x7F]"), _table(str.casefold)(v)).otherwise(F.lower(v))


def slugify(c: Column | str) -> Column:
    return slug(clean_text(c))


def slug(c: Column | str) -> Column:
    """:func:`slugify` of a text that is clean."""
    dashed = F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("lote"))


def fold(c: Column | str) -> Column:
    """Accents and case folded, blanks collapsed."""
    return collapse(casefold(strip_accents(c)))


def lot_number(c: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(_column(c), F.lit("")), LOT, 1)


def price(c: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(_column(c), F.lit("")), PRICE, 0)


def is_clause(c: Column) -> Column:
    return c.rlike(CLAUSE)


def distinct_join(values: Column, separator: str) -> Column:
    """Distinct non-empty values in order of first appearance, joined."""
    return F.array_join(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))), separator)


def quote_fragment(c: Column) -> Column:
    """Percent-encoding that leaves slashes, and writes blanks as %20."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))


def segments(text: Column, pattern: str) -> Column:
    """Array of (number, body): a text cut at each match of ``pattern``, whose first
    group is the number; what stands before the first match is left out.

    Marks that cannot occur in the text (two private-use signs, removed from it first)
    stand in for the matches, so one replacement and one split do the work; lambdas only
    see a piece, never the text."""
    clean = F.translate(text, "\ue000\ue001", "")
    pieces = F.split(F.regexp_replace(clean, pattern, "\ue000$1\ue001"), "\ue000")
    part = lambda p: F.struct(F.substring_index(p, "\ue001", 1).alias("number"), F.substring(p, F.locate("\ue001", p) + 1, F.length(p)).alias("body"))
    return F.transform(F.slice(pieces, 2, 1 << 30), part)
