"""Tag columns for trials. An absent input column counts as empty text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registryloom.functions import tags
from registryloom.names import Names, col
from registryloom.operators.schema import col_or, replace_columns


def add_area_tag(df: DataFrame, names: Names = Names()) -> DataFrame:
    return replace_columns(df, {names.area_tag: tags.area_tag(col_or(df, names.area))})


def add_covid_tag(df: DataFrame, names: Names = Names()) -> DataFrame:
    texts = col_or(df, names.title), col_or(df, names.disease)
    return replace_columns(df, {names.covid_tag: tags.covid_tag(*texts)})


def add_phase_tag(df: DataFrame, names: Names = Names()) -> DataFrame:
    return replace_columns(df, {names.phase_tag: tags.phase_tag(col_or(df, names.phase))})


def add_region_tag(df: DataFrame, names: Names = Names()) -> DataFrame:
    return replace_columns(df, {names.region_tag: tags.region_tag(col_or(df, names.region))})


def add_healthy_tag(
    df: DataFrame, names: Names = Names(), phase_one_only: bool = False
) -> DataFrame:
    """``phase_one_only`` needs the phase tag."""
    texts = [col_or(df, n) for n in (names.title, names.keywords, names.design)]
    tag = tags.healthy_tag(
        col_or(df, names.registry_id, F.lit("")),
        texts,
        col(names.phase_tag) if phase_one_only else None,
    )
    return replace_columns(df, {names.healthy_tag: tag})
