"""Whole-table cleaning."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registryloom.functions import text
from registryloom.names import col
from registryloom.operators.schema import is_number, is_text, present, replace_columns

# Fixed value: longest cell an export keeps.
MAX_CELL_CHARS = 32760


def _fill_number(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(t, (T.FloatType, T.DoubleType)):
        c = F.nanvl(c, F.lit(None).cast(t))
    return F.coalesce(c, F.lit(0).cast(t))


def _has_value(c: Column, t: T.DataType, strip_ws: bool) -> Column:
    """Before cleaning, tells whether the cleaned cell will hold something."""
    if is_text(t):
        return F.coalesce(F.length(text.strip(c) if strip_ws else c) > 0, F.lit(False))
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def drop_empty_rows(
    df: DataFrame, columns: Iterable[str] | None = None, strip_ws: bool = False
) -> DataFrame:
    """Keep rows with a value in at least one scoped column; zero is a value, '' is none."""
    scope = present(df, columns)
    if not scope:
        return df
    tests = [_has_value(col(n), df.schema[n].dataType, strip_ws) for n in scope]
    return df.filter(reduce(lambda a, b: a | b, tests))


def clean_table(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    *,
    fill_text: bool = True,
    fill_numbers: bool = True,
    strip_ws: bool = True,
    collapse_ws: bool = True,
    case_mode: str = "none",
    drop_rows: bool = True,
    drop_null_columns: bool | Observation = False,
) -> DataFrame:
    """Fill, clean and prune the scoped columns (all if none are named).

    Rows are tested on the raw cells, before the costly text rules: cleaning never empties a
    cell that strip leaves non-empty. With ``fill_numbers`` a number in scope always holds a
    value, so no row can be empty and the test is left out. ``drop_null_columns`` looks at the
    data at once and is therefore off unless asked for. Given an observation, nothing is dropped
    here: the first job over the result counts along the way, and ``null_columns`` then names what
    to drop; there, filled columns stay even if there is no row at all.
    """
    scope = present(df, columns)
    types = {n: df.schema[n].dataType for n in scope}
    numbers = [n for n in scope if is_number(types[n])]
    texts = [n for n in scope if is_text(types[n])]
    filled = {*(numbers if fill_numbers else ()), *(texts if fill_text else ())}
    raw = df
    if isinstance(drop_null_columns, Observation):
        df = df.observe(drop_null_columns, *_null_counts([n for n in scope if n not in filled], set()))

    if scope and drop_rows and not (fill_numbers and numbers):
        df = drop_empty_rows(df, scope, strip_ws)

    new = {}
    for n in texts:
        cell = text.or_empty(col(n)) if fill_text else col(n)
        new[n] = text.clean_text(cell, strip_ws, collapse_ws)
    if fill_numbers:
        new |= {n: _fill_number(col(n), types[n]) for n in numbers}
    cleaned = replace_columns(df, new)
    # In a projection of its own, as the rules for case mention a cell more than once.
    if case_mode != "none":
        cleaned = replace_columns(cleaned, {n: text.with_case(col(n), case_mode) for n in texts})

    if drop_null_columns is True and scope:
        return cleaned.drop(*null_columns(raw.agg(*_null_counts(scope, filled)).first().asDict()))
    return cleaned


def _null_counts(scope: list[str], filled: set[str]) -> list[Column]:
    """Rows, and cells that hold something; filled columns hold something in every row."""
    return [F.count(F.lit(1) if n in filled else col(n)).alias(n) for n in scope] or [F.count(F.lit(1)).alias("")]


def null_columns(counts: Mapping[str, int]) -> list[str]:
    """Counted columns without any value."""
    return [n for n, k in counts.items() if n and not k]


def remove_punctuation(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """All text columns unless some are named."""
    scope = [n for n in present(df, columns) if is_text(df.schema[n].dataType)]
    return replace_columns(df, {n: text.remove_punct(col(n)) for n in scope})


def sanitize_cells(df: DataFrame, max_chars: int = MAX_CELL_CHARS) -> DataFrame:
    """Make every text column safe for cell-based exports."""
    scope = [f.name for f in df.schema if is_text(f.dataType)]
    return replace_columns(df, {n: text.sanitize_cell(col(n), max_chars) for n in scope})

