"""Join of the two cleaned files, refinement of the unmatched branch, and their union."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame

from registryloom.functions.ids import NO_CODE
from registryloom.names import Names, col
from registryloom.operators import joins, refine


@dataclass(frozen=True)
class Refinement:
    """Choices for the unmatched branch; None and False both mean not chosen."""

    interventional: bool | None = None
    observational: bool | None = None
    industry: bool | None = None
    academic: bool | None = None
    others: bool | None = None


class Branches(NamedTuple):
    left: DataFrame
    both: DataFrame
    union: DataFrame


def matched_branch(
    sheet: DataFrame,
    public: DataFrame,
    names: Names = Names(),
    right_columns: Iterable[str] | None = None,
    suffix: str = "_CT",
) -> DataFrame:
    right = names.right_columns if right_columns is None else right_columns
    split = joins.split_join(
        sheet, public, names.registry_id, right_columns=right, suffix=suffix
    )
    return split.both


def no_code_rows(sheet: DataFrame, public: DataFrame, names: Names = Names()) -> DataFrame:
    """Left-only rows without a registry id.

    Cleaned files spell the marker one way, so both sides are cut down to it before they meet:
    what is left of the public file is at most one key, and no row of the sheet shuffles.
    """
    key = names.registry_id
    marked = [df.filter(col(key) == NO_CODE) for df in (sheet, public)]
    return joins.unmatched_hot(*marked, key)


def refine_branch(
    rows: DataFrame, refinement: Refinement = Refinement(), names: Names = Names()
) -> DataFrame:
    """Sponsor tag and choice, base text filter, study type choice."""
    tagged = refine.add_sponsor_tag(rows, names)
    by_sponsor = refine.refine_sponsor(
        tagged, refinement.industry, refinement.academic, refinement.others, names
    )
    based = refine.base_text_filter(by_sponsor, names)
    return refine.refine_study_type(
        based, refinement.interventional, refinement.observational, names
    )


def join_and_stack(
    sheet: DataFrame,
    public: DataFrame,
    refinement: Refinement = Refinement(),
    names: Names = Names(),
    right_columns: Iterable[str] | None = None,
    suffix: str = "_CT",
) -> Branches:
    """Both branches of two cleaned files, and the union of them, left branch first."""
    both = matched_branch(sheet, public, names, right_columns, suffix)
    left = refine_branch(no_code_rows(sheet, public, names), refinement, names)
    return Branches(left, both, joins.stack(left, both))
