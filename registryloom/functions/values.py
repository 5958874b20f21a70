"""Type coercion that yields NULL where a value does not fit, also in ANSI mode."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tried in this order after the ISO forms (year, year-month, date, date and time).
DATE_FORMATS = (
    "M/d/yyyy",
    "d-MMM-yyyy",
    "MMMM d, yyyy",
    "MMM d, yyyy",
    "MMMM yyyy",
    "MMM yyyy",
    "yyyy/M/d",
    "yyyyMMdd",
)


def _utc(c: Column) -> Column:
    """Clock time in UTC of texts that name a zone or offset; NULL for all others."""
    zoned = (F.length(c) > 16) & c.rlike(r":\d{2}.*(Z|[+-]\d{2}:?\d{2})$")
    micros = F.unix_micros(F.when(zoned, c).try_cast("timestamp_ltz"))
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01").cast("timestamp_ntz"))


# What the letters of a date format stand for in a text; other letters are not told by their shape.
_LETTERS = {
    "yyyy": r"\d{4}",
    "MMMM": "(?:[A-Za-z]{4,}|[Mm][Aa][Yy])",
    "MMM": "[A-Za-z]{3}",
    "MM": r"\d{2}",
    "M": r"\d{1,2}",
    "dd": r"\d{2}",
    "d": r"\d{1,2}",
}


def shape(date_format: str) -> str | None:
    """A pattern for the texts that a date format reads; None if the format has other letters."""
    parts = re.findall(r"([A-Za-z])(\1*)|([^A-Za-z]+)", date_format)
    runs = [letter + more for letter, more, _ in parts if letter]
    if not set(runs) <= set(_LETTERS):
        return None
    return "^" + "".join(_LETTERS[a + b] if a else re.escape(other) for a, b, other in parts) + "$"


def _by_shape(c: Column, formats: Sequence[str]) -> list[Column]:
    """Parsers that take turns: a text goes to the one whose shape it has, and to no other.

    A parser that fails costs a hundred times as much as a test of the shape. Formats whose shape
    cannot be told are tried where the others have found nothing.
    """
    parsed = [(shape(f), F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz")) for f in formats]
    shaped = [(s, p) for s, p in parsed if s is not None]
    cases = F.when(c.rlike(shaped[0][0]), shaped[0][1]) if shaped else None
    for pattern, one in shaped[1:]:
        cases = cases.when(c.rlike(pattern), one)
    return [cases] * bool(shaped) + [p for s, p in parsed if s is None]


def to_timestamp(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Clock times, in UTC where the text names a zone.

    Each value is parsed on its own, so the result does not hang on row order. More than four
    digits in a row are no year, nor more than two a day or month.
    """
    iso = F.when(~c.rlike(r"^\s*\d{5,}\s*$"), c)
    return F.coalesce(_utc(c), iso.try_cast("timestamp_ntz"), *_by_shape(c, formats))


def to_bigint(c: Column) -> Column:
    """Whole numbers, ``12.0`` included; fractions and junk give NULL."""
    text = c.cast("string")
    # The pattern spares junk the far slower failing cast.
    number = F.when(text.rlike(r"^\s*[-+]?[0-9]*\.?[0-9]*([eE][-+]?[0-9]+)?\s*$"), text)
    number = number.try_cast("double")
    whole = F.when(number == F.floor(number), number.try_cast("bigint"))
    return F.coalesce(text.try_cast("bigint"), whole)
