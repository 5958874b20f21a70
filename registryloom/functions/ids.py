"""Registry ids and age groups read out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from registryloom.functions.text import matches, strip

# The id pattern and the marker of rows that have no id.
ID_PREFIX = "NCT"
ID_PATTERN = r"(?i)(NCT\p{Nd}{8})"
NO_CODE = "NO NCT CODE"


def id_position(c: Column) -> Column:
    """Zero-based place of the id prefix, -1 if absent, NULL for NULL."""
    return (F.locate(ID_PREFIX, F.upper(c)) - 1).cast("bigint")


def registry_id(c: Column) -> Column:
    """First registry id in the text, upper case, or the no-code marker."""
    found = F.try_element_at(F.regexp_extract_all(c, F.lit(ID_PATTERN), F.lit(1)), F.lit(1))
    return F.coalesce(F.upper(found), F.lit(NO_CODE))


def has_no_code(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)) == NO_CODE.lower(), F.lit(False))


def mentions_group(c: Column, group: str) -> Column:
    """Whole-word search, ignoring case; letters of any script count as word characters."""
    edge = r"[^\p{L}\p{N}_]"
    return matches(c, f"(?iu)(?:^|{edge}){group}(?:{edge}|$)")
