"""Text, number and date parsing as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = " \t\r\n\f\v"
# A plain decimal number. The guard keeps out what a bare cast would accept ("1d", "inf").
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_MISSING_WORDS = ("", "nan", "none")
# The date texts that are read: day first, or ISO (always year-month-day), with optional time.
_DATE_SHAPE = (
    r"^([0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})( [0-9]{2}:[0-9]{2}:[0-9]{2})?$"
)
_DAY_FIRST = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})"


def _latin_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters; combining marks map to nothing."""
    accented, plain = [], []
    for code in range(0x00C0, 0x0250):
        base = "".join(ch for ch in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(ch))
        if len(base) == 1 and base != chr(code):
            accented.append(chr(code))
            plain.append(base)
    marks = "".join(chr(code) for code in range(0x0300, 0x0370))
    return "".join(accented) + marks, "".join(plain)


ACCENTED, PLAIN = _latin_table()


def strip(c: Column) -> Column:
    """Trim every kind of blank at both ends."""
    return F.btrim(c.cast("string"), F.lit(_BLANKS))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def fold_text(c: Column) -> Column:
    """lower-case, trimmed, accent-free text."""
    return F.translate(F.lower(strip(c)), ACCENTED, PLAIN)


def address_key(c: Column) -> Column:
    """the lookup key of an address; null becomes the empty key."""
    return F.lower(strip(F.coalesce(c.cast("string"), F.lit(""))))


def column_name(name: str) -> str:
    """A header cell as a column name (lower case, underscores, no dots or accents)."""
    text = name.strip().lower().replace(" ", "_").replace(".", "")
    return text.translate(str.maketrans(ACCENTED[: len(PLAIN)], PLAIN, ACCENTED[len(PLAIN):]))


def parse_money(c: Column) -> Column:
    """Brazilian money text as double, null when it is not a number.

    With a comma present the comma is the decimal mark and dots group thousands;
    without one the text is already a plain decimal.
    """
    raw = F.translate(strip(c), " ", "")
    comma = F.contains(raw, F.lit(","))
    text = F.when(comma, F.translate(raw, ",.", ".")).otherwise(raw)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def parse_money_or_zero(c: Column) -> Column:
    return F.coalesce(parse_money(c), F.lit(0.0))


def parse_day_first(c: Column) -> Column:
    """timestamp without zone from text; null when no format fits or there is no such day.

    Day-first text is turned into ISO order and cast. A cast answers null for a wrong date
    without raising inside, which makes it several times faster than parsing by pattern,
    and it does not involve the session time zone.
    """
    text = strip(c)
    iso = F.regexp_replace(text, _DAY_FIRST, "$3-$2-$1")
    return F.when(text.rlike(_DATE_SHAPE), iso.try_cast("timestamp_ntz"))


def parse_count(c: Column) -> Column:
    """whole number from text, cut toward zero; anything else becomes 0."""
    text = strip(c)
    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.coalesce(number.try_cast("long"), F.lit(0).cast("long"))


def known_text(c: Column) -> Column:
    """True for text that is neither null, blank nor a spelled-out missing value."""
    return F.coalesce(~F.lower(strip(c)).isin(*_MISSING_WORDS), F.lit(False))
