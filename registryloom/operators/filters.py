"""Row filters on trial columns, written so that they can reach the file reader."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registryloom.functions.text import contains_any
from registryloom.names import Names, col
from registryloom.operators.schema import replace_columns

# Column of tables that are laid out by start month: year * 100 + month.
MONTH = "start_yyyymm"
# The interventions that source B keeps.
KEYWORDS = ["DRUG", "BIOLOGICAL"]
# Entries that mean no filter.
ALL_TOKENS = ("ALL", "ALL SPONSORS INCLUDED", "ANY")
TYPE_ALL_TOKENS = ("ALL", "ANY")
# Region codes of the request form and the tag each stands for.
REGION_CODES = {
    "na": "NA only",
    "eu": "EU only",
    "apac": "APAC only",
    "euapac": "EU and APAC",
    "naapac": "NA and APAC",
}


def keyword_filter(df: DataFrame, name: str, terms: Iterable[str] = tuple(KEYWORDS)) -> DataFrame:
    """Keep rows whose text holds any of the terms, ignoring case, also inside words."""
    return df.filter(contains_any(col(name), terms, ignore_case=True))


def replace_value(df: DataFrame, name: str, old: str, new: str) -> DataFrame:
    return replace_columns(df, {name: F.when(col(name) == old, new).otherwise(col(name))})


def drop_planned(df: DataFrame, names: Names = Names()) -> DataFrame:
    """A missing status is kept."""
    status = col(names.status)
    return df.filter(status.isNull() | (status != "Planned"))


def month_window(
    df: DataFrame, start: tuple[int, int], end: tuple[int, int], names: Names = Names()
) -> DataFrame:
    """Start date in ``[start, end)``, both given as (year, month); missing dates drop out.

    A table laid out by month (see ``sources.months``) is read in the months of the window alone.
    """
    begin, stop = (F.lit(dt.date(year, month, 1)) for year, month in (start, end))
    day = col(names.start)
    if MONTH in df.columns:
        (y1, m1), (y2, m2) = start, end
        df = df.filter(col(MONTH).between(y1 * 100 + m1, y2 * 100 + m2)).drop(MONTH)
    return df.filter((day >= begin) & (day < stop))


def add_start_parts(df: DataFrame, names: Names = Names()) -> DataFrame:
    day = col(names.start)
    return replace_columns(
        df,
        {
            names.start_year: F.year(day).cast("bigint"),
            names.start_month: F.month(day).cast("bigint"),
        },
    )


def started_before_update(
    df: DataFrame, inclusive: bool = False, names: Names = Names()
) -> DataFrame:
    start, modified = col(names.start), col(names.modified)
    return df.filter(start <= modified if inclusive else start < modified)


def prefix_filter(df: DataFrame, name: str, prefix: str) -> DataFrame:
    return df.filter(col(name).startswith(prefix))


def as_list(values: object) -> list:
    if values is None:
        return []
    return list(values) if isinstance(values, (list, tuple, set, frozenset)) else [values]


def selects(values: object, all_tokens: Iterable[str] = ALL_TOKENS) -> bool:
    """Whether the choice narrows anything: not empty, and no entry that means 'all'."""
    given = [str(v).strip().upper() for v in as_list(values)]
    return bool(given) and not set(given) & set(all_tokens)


def multi_select(
    df: DataFrame, name: str, values: object, all_tokens: Iterable[str] = ALL_TOKENS
) -> DataFrame:
    if name not in df.columns or not selects(values, all_tokens):
        return df
    return df.filter(col(name).isin(as_list(values)))


def region_filter(df: DataFrame, region: str, names: Names = Names()) -> DataFrame:
    """Equality on the region tag; accepts tags and form codes, and 'Global' passes all rows."""
    if region.strip().upper() == "GLOBAL":
        return df
    return df.filter(col(names.region_tag) == REGION_CODES.get(region, region))
