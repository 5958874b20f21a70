"""Column selection, renaming and type coercion. Columns that are absent are passed over."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registryloom.functions.values import DATE_FORMATS, to_bigint, to_timestamp
from registryloom.names import col

TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_number(t: T.DataType) -> bool:
    """Booleans count as numbers here."""
    return isinstance(t, (T.NumericType, T.BooleanType))


def is_text(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


def present(df: DataFrame, names: Iterable[str] | None) -> list[str]:
    """The named columns that ``df`` has, in the order given; all columns for none."""
    names = list(names or [])
    return [n for n in names if n in df.columns] if names else list(df.columns)


def col_or(df: DataFrame, name: str, default: Column | str = "") -> Column:
    if name in df.columns:
        return col(name)
    return default if isinstance(default, Column) else F.lit(default)


def replace_columns(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    """All replacements in one projection; names not yet there are added at the end."""
    return df.withColumns(dict(new)) if new else df


def keep_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.select(*[col(n) for n in names if n in df.columns])


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in mapping.items() if old != new})


def coerce_dates(
    df: DataFrame, names: Iterable[str], formats: Sequence[str] = DATE_FORMATS
) -> DataFrame:
    """Text to timestamps without zone; columns already of a time type stay, and can push down."""
    text = [n for n in names if n in df.columns and is_text(df.schema[n].dataType)]
    return replace_columns(df, {n: to_timestamp(col(n), formats) for n in text})


def coerce_numbers(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Text to doubles, NULL where it is no number; columns of other types stay."""
    text = [n for n in names if n in df.columns and is_text(df.schema[n].dataType)]
    return replace_columns(df, {n: col(n).try_cast("double") for n in text})


def coerce_integer(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns or df.schema[name].dataType == T.LongType():
        return df
    return replace_columns(df, {name: to_bigint(col(name))})
