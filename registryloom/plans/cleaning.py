"""Cleaning of the two registry files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation

from registryloom.names import DISPLAY, Names
from registryloom.operators import clean, filters, refine, schema
from registryloom.sources.headers import PUBLIC_DATES, SNAKE_SHEET, Sheet


def select_sheet(df: DataFrame, sheet: Sheet = SNAKE_SHEET) -> DataFrame:
    """Kept columns in order, renamed, with number columns typed."""
    kept = schema.rename_columns(schema.keep_columns(df, sheet.keep), sheet.renames)
    return schema.coerce_numbers(kept, sheet.numbers)


def rename_public(df: DataFrame, names: Names = Names()) -> DataFrame:
    """Source B's own headers to the names in use; frames that have those stay as they are."""
    used = ("public_id", "public_title", "public_status")
    return schema.rename_columns(df, {getattr(DISPLAY, f): getattr(names, f) for f in used})


def clean_sheet(
    df: DataFrame, sheet: Sheet = SNAKE_SHEET, drop_null_columns: bool | Observation = False
) -> DataFrame:
    """Source A after ``select_sheet``: typed, cleaned in title case, with id and age flags.

    The id is read from the raw protocol text. Cleaning changes only case and whitespace there,
    so the id is the same, and a filter on it does not repeat the cleaning.
    """
    names = sheet.names
    typed = schema.coerce_integer(schema.coerce_dates(df, sheet.dates), names.trial_id)
    with_id = refine.add_registry_id(typed, names)
    cleaned = clean.clean_table(
        with_id,
        sheet.cleaned,
        case_mode="title",
        drop_null_columns=drop_null_columns,
    )
    return refine.add_age_flags(cleaned, names)


def clean_public(
    df: DataFrame,
    names: Names = Names(),
    dates: Sequence[str] = tuple(PUBLIC_DATES),
    drop_null_columns: bool | Observation = False,
    numbers: Sequence[str] = (),
) -> DataFrame:
    """Source B: typed, cleaned in upper case, no punctuation, drug and biological rows only.

    Text columns named in ``numbers`` become numbers first, so that the text rules spare them.
    """
    cleaned = clean.clean_table(
        schema.coerce_numbers(schema.coerce_dates(df, dates), numbers),
        collapse_ws=False,
        case_mode="upper",
        drop_null_columns=drop_null_columns,
    )
    plain = clean.remove_punctuation(cleaned)
    both = filters.replace_value(plain, names.sex, "ALL", "BOTH")
    renamed = schema.rename_columns(
        both, {names.public_id: names.registry_id, names.sex: names.gender}
    )
    return filters.keyword_filter(renamed, names.interventions)
