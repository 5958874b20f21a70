"""Text cleaning with Unicode rules.

Spark's own trim, initcap and regex classes follow narrower rules (space only, whitespace word
breaks, ASCII word characters), so the builders here spell the wider rules out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every Unicode whitespace character, as a trim set and as the inside of a regex class.
SPACE_CHARS = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E),
        *range(0x1C, 0x21),
        0x85,
        0xA0,
        0x1680,
        *range(0x2000, 0x200B),
        0x2028,
        0x2029,
        0x202F,
        0x205F,
        0x3000,
    )
)
SPACE = r"\s\p{Z}\x0B\x1c-\x1f\x85"
# The same class for scanning long text: printable ASCII is ruled out by its first half at once.
_GAP = rf"[[^\x21-\x7e]&&[{SPACE}]]"
_CASED = r"\p{IsUppercase}\p{IsLowercase}\p{Lt}"
# A mark before the space that opens a word, and how the mark's own sign is written meanwhile.
_SIGN = "\ufdd0"
_MARK, _OWN_SIGN = _SIGN + " ", _SIGN + "\ufdd1"

CASE_MODES = ("none", "upper", "lower", "title")


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE_CHARS))


def collapse(c: Column) -> Column:
    """Tab and line-break runs, and runs of two or more whitespace characters, become one space."""
    return F.regexp_replace(c, rf"{_GAP}(?:{_GAP}+|(?<=[\t\r\n]))", " ")


def title(c: Column) -> Column:
    """Capitalise after every character that has no case: ``i/ii`` gives ``I/Ii``.

    ``initcap`` breaks words at spaces only, so a marked space goes in before the other word
    starts and comes out again afterwards. The mark's sign in the text itself is written as a
    pair meanwhile, so every text comes back whole. Most cells have no such start and are spared
    all of that.
    """
    inner = c.rlike(f"[^{_CASED} ][{_CASED}]")
    safe = F.replace(c, F.lit(_SIGN), F.lit(_OWN_SIGN))
    marked = F.regexp_replace(safe, f"([^{_CASED} ])(?=[{_CASED}])", f"$1{_MARK}")
    plain = F.replace(F.initcap(marked), F.lit(_MARK), F.lit(""))
    return F.when(inner, F.replace(plain, F.lit(_OWN_SIGN), F.lit(_SIGN))).otherwise(F.initcap(c))


def with_case(c: Column, mode: str) -> Column:
    if mode not in CASE_MODES:
        raise ValueError(f"case mode {mode!r} is none of {CASE_MODES}")
    return {"upper": F.upper, "lower": F.lower, "title": title}.get(mode, lambda x: x)(c)


def clean_text(
    c: Column, strip_ws: bool = True, collapse_ws: bool = True, case_mode: str = "none"
) -> Column:
    c = strip(c) if strip_ws else c
    c = collapse(c) if collapse_ws else c
    return with_case(c, case_mode)


def remove_punct(c: Column) -> Column:
    """Keep letters and digits of any script, underscores and whitespace."""
    return F.regexp_replace(c, f"[^\\p{{L}}\\p{{N}}_{SPACE}]", "")


def norm_key(c: Column, punct: bool = True, mode: str = "compat") -> Column:
    """Lookup key: clean, lower case, no punctuation.

    Dropping punctuation can leave two spaces in a row (``a & b``). ``compat`` keeps them, as
    the expected results do; ``idempotent`` cleans once more, so both sides meet.
    """
    if mode not in ("compat", "idempotent"):
        raise ValueError(f"key mode {mode!r} is neither 'compat' nor 'idempotent'")
    key = clean_text(c, case_mode="lower")
    if punct:
        key = remove_punct(key)
    return clean_text(key) if mode == "idempotent" else key


def first_token(c: Column) -> Column:
    """First line, up to its first comma, stripped and in title case."""
    head = reduce(lambda x, sep: F.substring_index(x, sep, 1), ("\r", "\n", ","), c)
    return title(strip(head))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def matches(c: Column, pattern: str) -> Column:
    """Regex search where NULL counts as no match."""
    return F.coalesce(c.rlike(pattern), F.lit(False))


def contains_any(c: Column, terms: Iterable[str], ignore_case: bool = False) -> Column:
    """Literal search for any of the terms; NULL counts as no match."""
    pattern = "|".join(re.escape(t) for t in terms)
    return matches(c, ("(?iu)" if ignore_case else "") + pattern)


def sanitize_cell(c: Column, max_chars: int) -> Column:
    """No NULL, no control characters but tab and line breaks, at most ``max_chars`` long."""
    kept = F.regexp_replace(or_empty(c), r"[\x00-\x08\x0B-\x0C\x0E-\x1F]", "")
    return F.substring(kept, 1, max_chars)
