"""Derivations and refinements of the branch that has no partner in the public registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registryloom.functions import tags
from registryloom.functions.ids import has_no_code, id_position, mentions_group, registry_id
from registryloom.functions.text import first_token, matches, or_empty
from registryloom.names import Names, col
from registryloom.operators.schema import col_or, replace_columns


def add_registry_id(df: DataFrame, names: Names = Names()) -> DataFrame:
    """First registry id of the protocol text, upper case, or the no-code marker."""
    return replace_columns(df, {names.registry_id: registry_id(col(names.protocol_id))})


def add_id_position(df: DataFrame, name: str, names: Names = Names()) -> DataFrame:
    return replace_columns(df, {name: id_position(col(names.protocol_id))})


def add_age_flags(df: DataFrame, names: Names = Names()) -> DataFrame:
    """``Older Adults`` sets the adult flag as well."""
    group = col(names.age_group)
    return replace_columns(
        df,
        {
            names.child: mentions_group(group, "Children"),
            names.adult: mentions_group(group, "Adults"),
            names.older_adults: mentions_group(group, "Older Adults"),
        },
    )


def filter_no_code(df: DataFrame, names: Names = Names()) -> DataFrame:
    return df.filter(has_no_code(col(names.registry_id)))


def add_sponsor_tag(df: DataFrame, names: Names = Names()) -> DataFrame:
    """First listed sponsor type, and its tag; a missing type stays NULL and is tagged Others."""
    kind = first_token(col(names.sponsor_type))
    out = replace_columns(df, {names.clean_sponsor_type: kind})
    return replace_columns(
        out, {names.sponsor_tag: tags.sponsor_tag(col(names.clean_sponsor_type))}
    )


def refine_sponsor(
    df: DataFrame,
    industry: bool | None = None,
    academic: bool | None = None,
    others: bool | None = None,
    names: Names = Names(),
) -> DataFrame:
    flags = {"Industry": industry, "Academic": academic, "Others": others}
    chosen = [tag for tag, on in flags.items() if on]
    return df.filter(col(names.sponsor_tag).isin(chosen)) if chosen else df


def _blob(df: DataFrame, names: Names) -> Column:
    return tags.text_blob(*[col_or(df, n) for n in (names.design, names.plan, names.keywords)])


def base_text_filter(df: DataFrame, names: Names = Names()) -> DataFrame:
    """Keep rows whose design, plan or keywords speak of an interventional study."""
    return df.filter(matches(_blob(df, names), tags.INTERVENTIONAL))


def add_study_type(df: DataFrame, names: Names = Names()) -> DataFrame:
    return replace_columns(df, {names.study_type: tags.study_type(_blob(df, names))})


def refine_study_type(
    df: DataFrame,
    interventional: bool | None = None,
    observational: bool | None = None,
    names: Names = Names(),
) -> DataFrame:
    """Keep the chosen study types; both flags together also admit ambiguous rows.

    With no flag set the rows pass as they are and no study type is added.
    """
    flags = {
        "Interventional": interventional,
        "Observational": observational,
        "Ambiguous": interventional and observational,
    }
    chosen = [kind for kind, on in flags.items() if on]
    if not chosen:
        return df
    if names.study_type not in df.columns:
        df = add_study_type(df, names)
    return df.filter(col(names.study_type).isin(chosen))


def add_lead_sponsor(df: DataFrame, names: Names = Names()) -> DataFrame:
    """First sponsor of the first line; '' when there is none."""
    source = col_or(df, names.sponsor, col_or(df, names.sponsor_fallback, F.lit("")))
    return replace_columns(df, {names.lead_sponsor: first_token(or_empty(source))})
