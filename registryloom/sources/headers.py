"""Headers of the two registry files.

The lists are fixed values: they spell the files' own headers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

from registryloom.names import DISPLAY, Names

# The sheet columns that are kept, in output order.
SHEET_COLUMNS = [
    "Trial ID",
    "Protocol/Trial ID",
    "Trial Title",
    "Trial Phase",
    "Trial Status",
    "Therapeutic Area",
    "Disease",
    "MeSH Term",
    "Sponsor/Collaborator",
    "Sponsor/Collaborator Type",
    "Sponsor/Collaborator: Parent HQ Country",
    "Primary Tested Drug",
    "Primary Tested Drug: Mechanism Of Action",
    "Primary Tested Drug: Target",
    "Primary Tested Drug: Therapeutic Class",
    "Primary Tested Drug: Drug Type",
    "Other Tested Drug",
    "Other Tested Drug: Mechanism Of Action",
    "Other Tested Drug: Target",
    "Other Tested Drug: Therapeutic Class",
    "Other Tested Drug: Drug Type",
    "Oncology Biomarker",
    "Oncology Biomarker Common Use(s)",
    "Primary Endpoint",
    "Primary Endpoint Group",
    "Primary Endpoint Details",
    "Secondary/Other Endpoint",
    "Secondary/Other Endpoint Group",
    "Secondary/Other Endpoint Details",
    "Start Date",
    "Treatment Duration (Mos.)",
    "Primary Completion Date",
    "Primary Completion Date Type",
    "Full Completion Date",
    "Primary Endpoints Reported Date",
    "Primary Endpoints Reported Date Type",
    "Pts/Site/Mo",
    "Patient Gender",
    "Patient Age Group",
    "Min Patient Age",
    "Min Patient Age Unit",
    "Max Patient Age",
    "Max Patient Age Unit",
    "Target Accrual",
    "Actual Accrual (No. of patients)",
    "Actual Accrual (% of Target)",
    "Reported Sites",
    "Identified Sites",
    "Trial Region",
    "Countries",
    "Countries Count",
    "ClinicalTrials.gov Location Country",
    "ClinicalTrials.gov Sites Count",
    "Prior/Concurrent Therapy",
    "Treatment Plan",
    "Study Keywords",
    "Study Design",
    "Decentralized (DCT) Attributes",
    "Associated CRO",
    "Last Modified Date",
]

# Sheet columns that get another name.
SHEET_RENAMES = {
    "Trial Status": "TT_Trial Status",
    "Protocol/Trial ID": "Protocol_Trial_ID",
    "Sponsor/Collaborator": "TT_Sponsor/Collaborator",
    "Primary Tested Drug: Target": "Primary Tested Drug: Target_truncated",
    "Other Tested Drug: Mechanism Of Action": "Other Tested Drug: Mechanism Of Action_truncated",
    "Other Tested Drug: Target": "Other Tested Drug: Target_truncated",
    "Other Tested Drug: Therapeutic Class": "Other Tested Drug: Therapeutic Class_truncated",
    "Primary Endpoint Group": "Primary Endpoint Group_truncated",
    "Primary Endpoint Details": "Primary Endpoint Details_truncated",
    "Secondary/Other Endpoint Group": "Secondary/Other Endpoint Group_truncated",
    "Secondary/Other Endpoint Details": "Secondary/Other Endpoint Details_truncated",
    "Prior/Concurrent Therapy": "Prior/Concurrent Therapy_truncated",
    "Study Design": "TT_Study Design",
}

# Sheet columns left as they come; all other kept columns are cleaned.
SHEET_NOT_CLEANED = [
    "Trial Status",
    "MeSH Term",
    "Sponsor/Collaborator",
    "Sponsor/Collaborator Type",
    "Sponsor/Collaborator: Parent HQ Country",
    "Primary Tested Drug: Drug Type",
    "Other Tested Drug: Drug Type",
    "Treatment Duration (Mos.)",
    "Full Completion Date",
    "Pts/Site/Mo",
    "Countries Count",
    "Treatment Plan",
    "Study Design",
    "Decentralized (DCT) Attributes",
]

# Sheet columns that hold dates.
SHEET_DATES = [
    "Start Date",
    "Primary Completion Date",
    "Full Completion Date",
    "Primary Endpoints Reported Date",
    "Last Modified Date",
]

# Sheet columns that hold numbers.
SHEET_NUMBERS = [
    "Treatment Duration (Mos.)",
    "Pts/Site/Mo",
    "Min Patient Age",
    "Max Patient Age",
    "Target Accrual",
    "Actual Accrual (No. of patients)",
    "Actual Accrual (% of Target)",
    "Reported Sites",
    "Identified Sites",
    "Countries Count",
    "ClinicalTrials.gov Sites Count",
]

# Public registry columns that hold dates.
PUBLIC_DATES = ["start_date", "primary_completion_date", "completion_date"]


def snake_case(header: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", header.lower()).strip("_")


def _canonical() -> dict[str, str]:
    known = {getattr(DISPLAY, f.name): getattr(Names(), f.name) for f in fields(Names)}
    renamed = {h: SHEET_RENAMES.get(h, h) for h in SHEET_COLUMNS}
    return {h: known.get(r, snake_case(r)) for h, r in renamed.items()}


# File header to snake_case column.
SNAKE_HEADERS = _canonical()


@dataclass(frozen=True)
class Sheet:
    """How source A's columns are called and treated; lists name columns after renaming."""

    names: Names
    keep: list[str]
    renames: dict[str, str] = field(default_factory=dict)
    numbers: list[str] = field(default_factory=list)
    dates: list[str] = field(default_factory=list)
    cleaned: list[str] = field(default_factory=list)


def _sheet(names: Names, new_name: dict[str, str]) -> Sheet:
    def called(headers: list[str]) -> list[str]:
        return [new_name.get(h, h) for h in headers]

    return Sheet(
        names=names,
        keep=SHEET_COLUMNS,
        renames=new_name,
        numbers=called(SHEET_NUMBERS),
        dates=called(SHEET_DATES),
        cleaned=called([h for h in SHEET_COLUMNS if h not in SHEET_NOT_CLEANED]),
    )


# The sheet with its own headers, and the same sheet renamed to snake_case on the way in.
DISPLAY_SHEET = _sheet(DISPLAY, SHEET_RENAMES)
SNAKE_SHEET = _sheet(Names(), SNAKE_HEADERS)
