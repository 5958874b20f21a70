"""Labels derived from trial columns.

A filter on a tag moves below the projection that cleans its input and then repeats that input's
expression for every mention. So each tag mentions its input as rarely as it can: values are
looked up in a map, and word lists are searched in one pattern.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from registryloom.functions.ids import has_no_code
from registryloom.functions.text import SPACE, contains_any, matches, or_empty, strip

# Phase codes and the phase they count as.
PHASES = {
    "I": "I",
    "II": "II",
    "III": "III",
    "IV": "IV",
    "I/II": "II",
    "II/III": "III",
    "III/IV": "III",
}
OTHER_PHASE = "Recommend Exclude"

# Therapeutic areas that stand for themselves, and those that count as vaccines.
AREAS = [
    "Oncology",
    "Cns",
    "Unassigned",
    "Metabolic/Endocrinology",
    "Autoimmune/Inflammation",
    "Infectious Disease",
    "Cardiovascular",
    "Infectious Disease; Vaccines (Infectious Disease)",
    "Genitourinary",
    "Ophthalmology",
    "Vaccines (Infectious Disease)",
]
VACCINE_AREAS = [
    "Infectious Disease; Vaccines (Infectious Disease)",
    "Vaccines (Infectious Disease)",
]

# Words that mark a covid trial, in upper case.
COVID_TOKENS = [
    "COVID-19",
    "COVID",
    "2019-NCOV",
    "SARS-COV-2",
    "WUHAN CORONAVIRUS",
    "NCOV-19",
    "NCOV-2019",
    "2019 NOVEL CORONAVIRUS",
    "SEVERE ACUTE RESPIRATORY SYNDROME CORONAVIRUS 2",
]
COVID_LABEL = "Covid - Recommend Exclude"

# Words that mark healthy-volunteer trials, in upper case.
HEALTHY_TOKENS = ["HEALTHY", "BIOEQUIVALENCE", "BIOAVAILABILITY"]

# Design patterns, searched in upper-case text.
INTERVENTIONAL = f"RANDOM|CONTROL|DOUBLE[{SPACE}-]?BLIND|PLACEBO|INTERVENTION"
OBSERVATIONAL = f"OBSERVATION|NON[{SPACE}-]?INTERVENTIONAL"

# Region names as the sheet spells them.
NORTH_AMERICA = ["North America"]
EUROPE = ["Western Europe"]
ASIA_PACIFIC = ["Asia", "Australia/Oceania"]
# Label by presence in (North America, Europe, Asia-Pacific).
REGION_LABELS = {
    (False, False, False): "Other",
    (True, False, False): "NA only",
    (False, True, False): "EU only",
    (False, False, True): "APAC only",
    (True, True, False): "NA and EU",
    (True, False, True): "NA and APAC",
    (False, True, True): "EU and APAC",
    (True, True, True): "Global",
}

# Label by signs of an (interventional, observational) study.
STUDY_TYPES = {
    (False, False): "Unknown",
    (True, False): "Interventional",
    (False, True): "Observational",
    (True, True): "Ambiguous",
}

# Tag by sponsor type in lower case.
SPONSOR_TAGS = {"industry": "Industry", "academic": "Academic"}
OTHER_SPONSOR = "Others"


def text_blob(*columns: Column) -> Column:
    """Columns in upper case, joined by one space each, NULL as empty text."""
    return F.upper(F.concat_ws(" ", *[or_empty(c) for c in columns]))


def _look_up(value: Column, labels: Mapping[str, str], default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, value), F.lit(default))


def _by_flags(flags: list[Column], labels: Mapping[tuple[bool, ...], str]) -> Column:
    """The label of one combination of flags, each flag mentioned once."""
    ordered = [F.lit(labels[key]) for key in product((False, True), repeat=len(flags))]
    place = F.lit(1)
    for i, flag in enumerate(reversed(flags)):
        place = place + flag.cast("int") * 2**i
    return F.element_at(F.array(*ordered), place)


def study_type(blob: Column) -> Column:
    return _by_flags([matches(blob, INTERVENTIONAL), matches(blob, OBSERVATIONAL)], STUDY_TYPES)


def sponsor_tag(cleaned: Column) -> Column:
    return _look_up(F.lower(strip(cleaned)), SPONSOR_TAGS, OTHER_SPONSOR)


def area_tag(area: Column) -> Column:
    labels = {a: "Vaccines" if a in VACCINE_AREAS else a for a in AREAS}
    return _look_up(area, labels, "Multiple")


def covid_tag(title: Column, disease: Column) -> Column:
    hit = contains_any(text_blob(title, disease), COVID_TOKENS)
    return F.when(hit, COVID_LABEL).otherwise("")


def phase_tag(phase: Column) -> Column:
    return _look_up(strip(F.upper(phase)), PHASES, OTHER_PHASE)


def region_tag(region: Column) -> Column:
    seen = [contains_any(region, names) for names in (NORTH_AMERICA, EUROPE, ASIA_PACIFIC)]
    return _by_flags(seen, REGION_LABELS)


def healthy_tag(registry_id: Column, texts: list[Column], phase: Column | None = None) -> Column:
    """``Yes`` for trials without a registry id whose texts name healthy volunteers.

    With ``phase`` given, only phase I trials qualify.
    """
    hit = has_no_code(registry_id) & contains_any(text_blob(*texts), HEALTHY_TOKENS)
    if phase is not None:
        hit = hit & F.coalesce(phase == "I", F.lit(False))
    return F.when(hit, "Yes").otherwise("No")
