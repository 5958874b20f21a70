"""Date window, tags and multi-select filters over the trial table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registryloom.names import Names
from registryloom.operators import filters, schema, tagging


@dataclass(frozen=True)
class FilterSpec:
    """One request. Months are (year, month); the window is half open, so equal ends are empty.

    Empty selections, and selections that hold an 'all' entry, do not filter.
    """

    start: tuple[int, int] = (2015, 1)
    end: tuple[int, int] = (2015, 1)
    statuses: list = field(default_factory=list)
    phases: list = field(default_factory=list)
    areas: list = field(default_factory=list)
    sponsor_types: list = field(default_factory=list)
    sponsors: list = field(default_factory=list)
    region: str = "Global"
    region_enabled: bool = False
    same_day_update: bool = True
    healthy_phase_one: bool = False
    sponsor_prefix: str | None = None

    @classmethod
    def fixed(cls, start: tuple[int, int], end: tuple[int, int]) -> FilterSpec:
        """The preset without selections: industry sponsors, strictly later updates, and phase I
        for healthy volunteers."""
        return cls(
            start,
            end,
            same_day_update=False,
            healthy_phase_one=True,
            sponsor_prefix="Industry",
        )

    @classmethod
    def from_request(cls, request: Mapping[str, object]) -> FilterSpec:
        """From the keys of a filter form."""

        def month(edge: str) -> tuple[int, int]:
            return (
                int(request.get(f"start_date_{edge}_year", 2015)),
                int(request.get(f"start_date_{edge}_month", 1)),
            )

        selections = {
            "statuses": "selected_trial_statuses",
            "phases": "selected_phases",
            "areas": "selected_therapeutic_areas",
            "sponsor_types": "selected_lead_sponsor_types",
            "sponsors": "selected_sponsors",
        }
        return replace(
            cls(month("from"), month("until")),
            region=str(request.get("region", "Global")),
            region_enabled=bool(request.get("region_enabled", False)),
            **{k: filters.as_list(request.get(v)) for k, v in selections.items()},
        )


def with_dates(df: DataFrame, names: Names = Names()) -> DataFrame:
    """Start and modified date as time types, NULL where the column is absent."""
    absent = [n for n in (names.start, names.modified) if n not in df.columns]
    typed = schema.coerce_dates(df, [names.start, names.modified])
    return schema.replace_columns(
        typed, {n: F.lit(None).cast("timestamp_ntz") for n in absent}
    )


def add_tags(df: DataFrame, names: Names = Names(), healthy_phase_one: bool = False) -> DataFrame:
    """Area, covid, phase, region and healthy-volunteer tag."""
    out = tagging.add_area_tag(df, names)
    out = tagging.add_covid_tag(out, names)
    out = tagging.add_phase_tag(out, names)
    out = tagging.add_region_tag(out, names)
    return tagging.add_healthy_tag(out, names, healthy_phase_one)


def apply_filters(df: DataFrame, spec: FilterSpec, names: Names = Names()) -> DataFrame:
    """Filter on the given columns first, then tag, then filter on the tags."""
    out = filters.drop_planned(df, names) if names.status in df.columns else df
    out = with_dates(out, names)
    out = filters.add_start_parts(out, names)
    out = filters.month_window(out, spec.start, spec.end, names)
    out = filters.started_before_update(out, spec.same_day_update, names)
    if spec.sponsor_prefix is not None:
        out = filters.prefix_filter(out, names.sponsor_type, spec.sponsor_prefix)
    out = filters.multi_select(out, names.status, spec.statuses)

    out = add_tags(out, names, spec.healthy_phase_one)
    out = filters.multi_select(out, names.phase_tag, spec.phases)
    out = filters.multi_select(out, names.area_tag, spec.areas)
    out = filters.multi_select(
        out, names.clean_sponsor_type, spec.sponsor_types, filters.TYPE_ALL_TOKENS
    )
    out = filters.multi_select(out, names.lead_sponsor, spec.sponsors)
    return filters.region_filter(out, spec.region, names) if spec.region_enabled else out
