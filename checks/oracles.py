"""SQL for each query in ``checks.queries``, written for the engine that checks the results.

The SQL follows the rules themselves, not the Spark code: regexes where Spark trims, word lists
where Spark marks word starts, a real full outer join where Spark joins part by part.
"""

from __future__ import annotations

from checks.fixtures import FULL_CELLS, fixture_sql
from registryloom.sources.headers import (
    SHEET_COLUMNS,
    SHEET_DATES,
    SHEET_NOT_CLEANED,
    SHEET_NUMBERS,
    SHEET_RENAMES,
)

WS = r"\s\p{Z}\x0B\x1c-\x1f\x85"
CASED = r"\p{Lu}\p{Ll}\p{Lt}"
TEXT = [
    "protocol_trial_id",
    "trial_title",
    "trial_phase",
    "therapeutic_area",
    "disease",
    "study_keywords",
    "patient_age_group",
    "trial_region",
]
UNTOUCHED = ["trial_status", "sponsor", "sponsor_type", "study_design", "treatment_plan"]


# --- scalar rules -----------------------------------------------------------------------------


def filled(c: str) -> str:
    return f"coalesce({c}, '')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def collapse(c: str) -> str:
    lines = f"regexp_replace({c}, '[\\t\\r\\n]+', ' ', 'g')"
    return f"regexp_replace({lines}, '[{WS}]{{2,}}', ' ', 'g')"


def upper(c: str) -> str:
    """The sharp s has no single capital in the rules to match."""
    return f"upper(replace({c}, 'ß', 'ss'))"


def title(c: str) -> str:
    """Runs of letters with case get one capital; a sharp s in front opens up to Ss."""
    words = f"regexp_extract_all({c}, '([{CASED}]+|[^{CASED}]+)')"
    first = "CASE w[1] WHEN 'ß' THEN 'Ss' ELSE upper(w[1]) END"
    return f"array_to_string(list_transform({words}, lambda w: {first} || lower(w[2:])), '')"


def cleaned(c: str) -> str:
    return title(collapse(strip(filled(c))))


def no_punct(c: str) -> str:
    return f"regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_{WS}]', '', 'g')"


def norm(c: str, punct: bool = True, again: bool = False) -> str:
    key = f"lower({collapse(strip(c))})"
    key = no_punct(key) if punct else key
    return collapse(strip(key)) if again else key


def first_token(c: str) -> str:
    line = f"split_part(replace({c}, chr(13), chr(10)), chr(10), 1)"
    return title(strip(f"split_part({line}, ',', 1)"))


def code(c: str) -> str:
    return f"coalesce(upper(nullif(regexp_extract({c}, '(?i)NCT[0-9]{{8}}'), '')), 'NO NCT CODE')"


def group(name: str) -> str:
    edge = r"[^\p{L}\p{N}_]"
    pattern = f"(?i)(^|{edge}){name}({edge}|$)"
    return f"coalesce(regexp_matches(patient_age_group, '{pattern}'), false)"


AGE = (
    f"{group('Children')} AS child, {group('Adults')} AS adult, "
    f"{group('Older Adults')} AS older_adults"
)
BLOB = (
    "upper(coalesce(study_design, '') || ' ' || coalesce(treatment_plan, '') || ' ' || "
    "coalesce(study_keywords, ''))"
)
INTER = f"regexp_matches({BLOB}, 'RANDOM|CONTROL|DOUBLE[\\s-]?BLIND|PLACEBO|INTERVENTION')"
OBS = f"regexp_matches({BLOB}, 'OBSERVATION|NON[\\s-]?INTERVENTIONAL')"
STUDY_TYPE = (
    f"CASE WHEN {INTER} AND {OBS} THEN 'Ambiguous' WHEN {INTER} THEN 'Interventional' "
    f"WHEN {OBS} THEN 'Observational' ELSE 'Unknown' END"
)
SPONSOR_TAG = (
    "CASE lower(clean_sponsor_type) WHEN 'industry' THEN 'Industry' "
    "WHEN 'academic' THEN 'Academic' ELSE 'Others' END"
)
AREA_TAG = (
    "CASE WHEN therapeutic_area IN ('Infectious Disease; Vaccines (Infectious Disease)', "
    "'Vaccines (Infectious Disease)') THEN 'Vaccines' WHEN therapeutic_area IN ('Oncology', "
    "'Cns', 'Unassigned', 'Metabolic/Endocrinology', 'Autoimmune/Inflammation', "
    "'Infectious Disease', 'Cardiovascular', 'Genitourinary', 'Ophthalmology') "
    "THEN therapeutic_area ELSE 'Multiple' END"
)


def covid_tag(text: str) -> str:
    words = (
        "COVID|2019-NCOV|SARS-COV-2|WUHAN CORONAVIRUS|NCOV-19|NCOV-2019|2019 NOVEL CORONAVIRUS|"
        "SEVERE ACUTE RESPIRATORY SYNDROME CORONAVIRUS 2"
    )
    return (
        f"CASE WHEN regexp_matches(upper({text}), '{words}') "
        "THEN 'Covid - Recommend Exclude' ELSE '' END"
    )


COVID_TAG = covid_tag("coalesce(trial_title, '') || ' ' || coalesce(disease, '')")
PHASE_TAG = (
    "CASE upper(trim(coalesce(trial_phase, ''))) WHEN 'I' THEN 'I' WHEN 'II' THEN 'II' "
    "WHEN 'III' THEN 'III' WHEN 'IV' THEN 'IV' WHEN 'I/II' THEN 'II' WHEN 'II/III' THEN 'III' "
    "WHEN 'III/IV' THEN 'III' ELSE 'Recommend Exclude' END"
)
_NA = "contains(coalesce(trial_region, ''), 'North America')"
_EU = "contains(coalesce(trial_region, ''), 'Western Europe')"
_AP = "regexp_matches(coalesce(trial_region, ''), 'Asia|Australia/Oceania')"
REGION_TAG = (
    f"CASE WHEN {_NA} AND {_EU} AND {_AP} THEN 'Global' WHEN {_NA} AND {_EU} THEN 'NA and EU' "
    f"WHEN {_NA} AND {_AP} THEN 'NA and APAC' WHEN {_EU} AND {_AP} THEN 'EU and APAC' "
    f"WHEN {_NA} THEN 'NA only' WHEN {_EU} THEN 'EU only' WHEN {_AP} THEN 'APAC only' "
    "ELSE 'Other' END"
)
_HEALTHY = " OR ".join(
    f"regexp_matches(upper(coalesce({c}, '')), 'HEALTHY|BIOEQUIVALENCE|BIOAVAILABILITY')"
    for c in ("trial_title", "study_keywords", "study_design")
)


def healthy_tag(extra: str = "true") -> str:
    return (
        f"CASE WHEN nct_id = 'NO NCT CODE' AND {extra} AND ({_HEALTHY}) THEN 'Yes' ELSE 'No' END"
    )


STRICT_HEALTHY = healthy_tag(f"({PHASE_TAG}) = 'I'")
TAGS = (
    f"{AREA_TAG} AS area_tag, {COVID_TAG} AS covid_tag, {PHASE_TAG} AS phase_tag, "
    f"{REGION_TAG} AS region_tag"
)


# --- tables -----------------------------------------------------------------------------------

SHEET = f"""
SELECT s.*, {AGE} FROM (
  SELECT coalesce(trial_id, 0) AS trial_id, {", ".join(f"{cleaned(c)} AS {c}" for c in TEXT)},
    {", ".join(UNTOUCHED)}, try_cast(start_date AS DATE) AS start_date,
    try_cast(last_modified_date AS DATE) AS last_modified_date, full_completion_date,
    coalesce(target_accrual, 0) AS target_accrual, {code("protocol_trial_id")} AS nct_id
  FROM tt_raw) s
"""


def _public(c: str) -> str:
    return no_punct(upper(strip(filled(c))))


PUBLIC = f"""
SELECT {_public("nct_id")} AS nct_id, {_public("study_title")} AS study_title,
  {_public("study_status")} AS study_status, {_public("interventions")} AS interventions,
  {_public("condition")} AS condition,
  CASE {_public("sex")} WHEN 'ALL' THEN 'BOTH' ELSE {_public("sex")} END AS patient_gender,
  try_cast(start_date AS DATE) AS start_date
FROM ct_raw WHERE regexp_matches({_public("interventions")}, 'DRUG|BIOLOGICAL')
"""
CT_COLUMNS = ["study_title", "study_status", "interventions", "condition"]
CT_LIST = ", ".join(f"p.{c} AS {c}_CT" for c in CT_COLUMNS)
BOTH = f"""
SELECT s.*, {CT_LIST} FROM sheet s JOIN public p ON s.nct_id IS NOT DISTINCT FROM p.nct_id
"""
NO_CODE = """
SELECT s.* FROM sheet s
WHERE NOT EXISTS (SELECT 1 FROM public p WHERE p.nct_id IS NOT DISTINCT FROM s.nct_id)
  AND lower(trim(s.nct_id)) = 'no nct code'
"""
TAGGED = f"""
SELECT n.*, {SPONSOR_TAG} AS sponsor_tag
FROM (SELECT *, {first_token("sponsor_type")} AS clean_sponsor_type FROM no_code) n
"""


def left_sql(tags: str | None = None, types: str | None = None) -> str:
    kind = f", {STUDY_TYPE} AS study_type" if types else ""
    by_type = f" AND {STUDY_TYPE} IN ({types})" if types else ""
    by_tag = f" AND sponsor_tag IN ({tags})" if tags else ""
    return f"SELECT *{kind} FROM tagged WHERE {INTER}{by_type}{by_tag}"


UNION = "SELECT * FROM left_part UNION ALL BY NAME SELECT * FROM both_part"
LEAD = f"SELECT *, {first_token(filled('sponsor'))} AS lead_sponsor FROM union_part"
RAW_LEAD = f"""
SELECT trial_id, sponsor, {first_token(filled("sponsor"))} AS lead_sponsor FROM tt_raw
"""


def lookup_sql(name: str, key: str, value: str, punct: bool = True) -> str:
    def cell(c: str) -> str:
        return no_punct(cleaned(c)) if punct else cleaned(c)

    return f"SELECT {cell(key)} AS {key}, {cell(value)} AS {value} FROM {name}"


MAP = lookup_sql("map_sponsor", "lead_sponsor", "standard_name")
US = lookup_sql("seg_us", "standard_name", "us_segment")
WW = lookup_sql("seg_ww", "standard_name", "ww_segment")


def chain_sql(source: str, again: bool = False) -> str:
    def key(c: str) -> str:
        return norm(c, again=again)

    return f"""
SELECT l.*, m.standard_name, coalesce(nullif(u.us_segment, ''), 'Others') AS us_segment,
  coalesce(nullif(w.ww_segment, ''), 'Others') AS ww_segment
FROM {source} l
LEFT JOIN map_clean m ON {key("l.lead_sponsor")} IS NOT DISTINCT FROM {key("m.lead_sponsor")}
LEFT JOIN us_clean u ON {key("m.standard_name")} IS NOT DISTINCT FROM {key("u.standard_name")}
LEFT JOIN ww_clean w ON {key("m.standard_name")} IS NOT DISTINCT FROM {key("w.standard_name")}
"""


PARTS = {
    "tt_raw": fixture_sql("tt_raw"),
    "ct_raw": fixture_sql("ct_raw"),
    "map_sponsor": fixture_sql("map_sponsor"),
    "seg_us": fixture_sql("seg_us"),
    "seg_ww": fixture_sql("seg_ww"),
    "sheet": SHEET,
    "public": PUBLIC,
    "both_part": BOTH,
    "no_code": NO_CODE,
    "tagged": TAGGED,
    "raw_lead": RAW_LEAD,
    "map_clean": MAP,
    "us_clean": US,
    "ww_clean": WW,
}
PUNCTUATED = {
    "map_clean": lookup_sql("map_sponsor", "lead_sponsor", "standard_name", punct=False),
    "us_clean": lookup_sql("seg_us", "standard_name", "us_segment", punct=False),
    "ww_clean": lookup_sql("seg_ww", "standard_name", "ww_segment", punct=False),
}
RAW = ["tt_raw"]
JOINED = ["tt_raw", "ct_raw", "sheet", "public"]
LEFT = [*JOINED, "no_code", "tagged"]
LOOKUPS = ["map_sponsor", "seg_us", "seg_ww", "map_clean", "us_clean", "ww_clean"]


def query(select: str, parts: list[str], **more: str) -> str:
    named = {p: PARTS[p] for p in parts} | more
    ctes = ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in named.items())
    return f"WITH {ctes}\n{select.strip()}"


def pipeline(select: str, left: str) -> str:
    return query(
        select,
        [*LEFT, "both_part", *LOOKUPS],
        left_part=left,
        union_part=UNION,
        lead_part=LEAD,
        segments=chain_sql("lead_part"),
    )


# --- queries ----------------------------------------------------------------------------------

_DIRTY = """
SELECT doc_id, chr(1) || chr(9) || text || chr(11) || chr(31) || chr(10) || '.' AS text,
  CASE WHEN doc_id % 5 <> 0 THEN lang END AS lang, n_chars FROM documents
"""


def _safe(c: str) -> str:
    bad = r"[\x00-\x08\x0B-\x0C\x0E-\x1F]"
    return f"substring(regexp_replace({filled(c)}, '{bad}', '', 'g'), 1, 32760)"


_ID_TEXT = """
SELECT trial_id, start_date,
  CASE trial_id % 7 WHEN 0 THEN trial_id || '.5' WHEN 1 THEN trial_id || '.0'
    WHEN 2 THEN 'x' || trial_id ELSE trial_id || '' END AS id_number,
  trial_id % 11 AS spelling, last_modified_date
FROM tt_raw
"""
_WINDOW = "start_date >= DATE '1994-03-01' AND start_date < DATE '1997-09-01'"
_PARTS = "year(start_date) AS start_year, month(start_date) AS start_month"
_STATUS = "trial_status IS DISTINCT FROM 'Planned'"
_CHOSEN = """
phase_tag IN ('I', 'II', 'Recommend Exclude') AND trial_status IN ('Open', 'Closed', 'Completed')
  AND area_tag IN ('Oncology', 'Cns', 'Vaccines', 'Multiple') AND region_tag = 'NA only'
"""
_DAY = "date_diff('day', DATE '1970-01-01', CAST(start_date AS DATE))"
_TYPED = f"""
SELECT {_public("nct_id")} AS nct_id, {_public("study_title")} AS study_title,
  {_public("study_status")} AS study_status, {_public("interventions")} AS interventions,
  {_public("condition")} AS condition, try_cast(start_date AS DATE) AS start_date,
  CASE coalesce(sex, '') WHEN 'All' THEN 'BOTH' ELSE upper(coalesce(sex, '')) END AS patient_gender,
  CASE WHEN {_DAY} % 5 <> 0 THEN ({_DAY} - 9000) / 8.0::DOUBLE ELSE 0 END AS score,
  CAST({_DAY} % 97 AS INTEGER) AS size, scan
FROM ct_raw, (VALUES ('schema'), ('numbers')) scans(scan)
WHERE regexp_matches({_public("interventions")}, 'DRUG|BIOLOGICAL')
"""


def _full_cell(header: str) -> str:
    raw = FULL_CELLS[header]
    if header == "Trial ID":
        return "coalesce(o_orderkey, 0)"
    if header in SHEET_DATES:
        return f"try_cast({raw} AS DATE)"
    if header in SHEET_NUMBERS:
        number = f"try_cast({raw} AS DOUBLE)"
        return number if header in SHEET_NOT_CLEANED else f"coalesce({number}, 0)"
    return raw if header in SHEET_NOT_CLEANED else cleaned(raw)


_FULL = ", ".join(f'{_full_cell(h)} AS "{SHEET_RENAMES.get(h, h)}"' for h in SHEET_COLUMNS)
_FULL_AGE = AGE.replace("patient_age_group", '"Patient Age Group"')
_FULL_CODE = code(FULL_CELLS["Protocol/Trial ID"])
_TYPE_PICK = "clean_sponsor_type IN ('Industry', 'Government')"
_NAME_PICK = "lead_sponsor IN ('Building Co 1', 'Machinery & Co 2')"
_OPEN = (
    f"{_STATUS} AND start_date >= DATE '1992-01-01' AND start_date < DATE '1998-12-01' "
    "AND start_date <= last_modified_date"
)
_PICKS = {"types": _TYPE_PICK, "sponsors": _NAME_PICK, "both": f"{_TYPE_PICK} AND {_NAME_PICK}"}
_SPONSORS = f"""
SELECT *, {first_token("sponsor_type")} AS clean_sponsor_type,
  {first_token(filled("sponsor"))} AS lead_sponsor FROM sheet WHERE {_OPEN}
"""
_REGIONS = {
    "na": "NA only",
    "eu": "EU only",
    "apac": "APAC only",
    "euapac": "EU and APAC",
    "naapac": "NA and APAC",
    "NA and EU": "NA and EU",
}
_LONG_PLAN = "CASE WHEN trial_id % 40 = 0 THEN repeat('plan ', 8000) ELSE treatment_plan END"


def _written(stage: str, part: str) -> str:
    title_ct = "study_title_CT" if stage != "left" else "NULL"
    return (
        f"SELECT '{stage}' AS stage, trial_id, length(treatment_plan) AS plan_chars, trial_status, "
        f"{title_ct} AS study_title_CT FROM {part}"
    )


_STAGE_PARTS = {
    "sheet": 22,
    "public": 7,
    "left_part": 24,
    "both_part": 26,
    "union_part": 28,
    "lead_part": 29,
    "segments": 32,
}

ORACLES = {
    "clean_text": f"""
SELECT doc_id, plain, {upper("plain")} AS upper, lower(plain) AS lower, {title("plain")} AS title
FROM (SELECT doc_id, {collapse(strip("text"))} AS plain FROM documents)
""",
    "clean_table": query(
        f"""
SELECT coalesce(trial_id, 0) AS trial_id, full_completion_date,
  {", ".join(f"{cleaned(c)} AS {c}" for c in [*TEXT, *UNTOUCHED])},
  {cleaned("start_date")} AS start_date, {cleaned("last_modified_date")} AS last_modified_date,
  coalesce(target_accrual, 0) AS target_accrual
FROM tt_raw""",
        RAW,
    ),
    "clean_table_drop_rows": query(
        f"""
SELECT trial_id, {collapse(strip(filled("trial_phase")))} AS trial_phase,
  {collapse(strip(filled("sponsor_type")))} AS sponsor_type,
  {collapse(strip(filled("study_keywords")))} AS study_keywords
FROM tt_raw
WHERE NOT ({strip(filled("trial_phase"))} = '' AND {strip(filled("sponsor_type"))} = ''
  AND {strip(filled("study_keywords"))} = '')""",
        RAW,
    ),
    "drop_null_columns": query(
        f"""
SELECT coalesce(trial_id, 0) AS trial_id, protocol_trial_id, trial_title,
  upper({collapse(strip(filled("trial_phase")))}) AS trial_phase, trial_status,
  therapeutic_area, disease, sponsor, sponsor_type, study_design, treatment_plan, study_keywords,
  patient_age_group, trial_region, try_cast(start_date AS DATE) AS start_date,
  last_modified_date, target_accrual
FROM tt_raw""",
        RAW,
    ),
    "remove_punct": f"""
SELECT doc_id, {no_punct("text")} AS text, {no_punct("lang")} AS lang,
  {no_punct("source")} AS source, n_chars FROM documents
""",
    "sanitize_cells": f"""
SELECT doc_id, {_safe("text")} AS text, {_safe("lang")} AS lang, n_chars FROM ({_DIRTY})
""",
    "project_rename": query(
        "SELECT trial_status AS sheet_status, trial_id, sponsor, study_design AS sheet_design, "
        "trial_title FROM tt_raw",
        RAW,
    ),
    "coerce_types": query(
        """
SELECT trial_id,
  CASE WHEN regexp_full_match(id_number, '[0-9]+(\\.0)?')
    THEN CAST(split_part(id_number, '.', 1) AS BIGINT) END AS id_number,
  try_cast(start_date AS DATE) AS start_date,
  CASE WHEN spelling IN (7, 8) THEN CAST(date_trunc('month', CAST(last_modified_date AS DATE)) AS DATE)
    ELSE CAST(last_modified_date AS DATE) END AS last_modified_date
FROM id_text""",
        RAW,
        id_text=_ID_TEXT,
    ),
    "extract_registry_id": query(
        f"""
SELECT trial_id, protocol_trial_id, strpos(upper(protocol_trial_id), 'NCT') - 1 AS id_position,
  {code("protocol_trial_id")} AS nct_id FROM tt_raw""",
        RAW,
    ),
    "age_flags": query(f"SELECT trial_id, patient_age_group, {AGE} FROM tt_raw", RAW),
    "keyword_filter": query("SELECT * FROM public", ["ct_raw", "public"]),
    "join_three_way": query(
        """
SELECT CASE WHEN l IS NULL THEN 'right_only' WHEN r IS NULL THEN 'left_only' ELSE 'both' END
    AS bucket, count(*) AS n_rows
FROM (SELECT nct_id, 1 AS l FROM sheet) a FULL OUTER JOIN (SELECT nct_id, 1 AS r FROM public) b
  ON a.nct_id IS NOT DISTINCT FROM b.nct_id
GROUP BY 1""",
        JOINED,
    ),
    "join_enrich_both": query("SELECT * FROM both_part", [*JOINED, "both_part"]),
    "left_only_no_code": query("SELECT * FROM no_code", [*JOINED, "no_code"]),
    "left_only": query(
        """
SELECT s.* FROM sheet s
WHERE NOT EXISTS (SELECT 1 FROM public p WHERE p.nct_id IS NOT DISTINCT FROM s.nct_id)""",
        JOINED,
    ),
    "join_right_only": query(
        f"""
SELECT p.nct_id, {CT_LIST} FROM public p ANTI JOIN sheet s ON p.nct_id = s.nct_id""",
        JOINED,
    ),
    "first_token_title": query(
        f"""
SELECT trial_id, sponsor_type, {first_token("sponsor_type")} AS clean_sponsor_type
FROM tt_raw""",
        RAW,
    ),
    "lead_sponsor": query("SELECT * FROM raw_lead", [*RAW, "raw_lead"]),
    "sponsor_tag_refine": query(
        """
SELECT trial_id, nct_id, clean_sponsor_type, sponsor_tag FROM tagged
WHERE sponsor_tag IN ('Industry', 'Others')""",
        LEFT,
    ),
    "base_text_filter": query(f"SELECT * FROM no_code WHERE {INTER}", [*JOINED, "no_code"]),
    "study_type": query(f"SELECT trial_id, {STUDY_TYPE} AS study_type FROM tt_raw", RAW),
    "study_type_refine": query(
        f"""
SELECT trial_id, study_design, {STUDY_TYPE} AS study_type FROM tt_raw
WHERE {STUDY_TYPE} <> 'Unknown'""",
        RAW,
    ),
    "union_by_name": query(
        "SELECT * FROM union_part",
        [*LEFT, "both_part"],
        left_part=left_sql("'Industry', 'Others'", "'Interventional'"),
        union_part=UNION,
    ),
    "norm_key": query(
        f"""
SELECT trial_id, {norm("lead_sponsor")} AS compat,
  {norm("lead_sponsor", again=True)} AS idempotent, {norm("sponsor", punct=False)} AS with_punct
FROM raw_lead""",
        [*RAW, "raw_lead"],
    ),
    "lookup_append": query(
        f"""
SELECT l.*, m.standard_name FROM raw_lead l
LEFT JOIN map_clean m ON {norm("l.lead_sponsor")} = {norm("m.lead_sponsor")}""",
        [*RAW, "raw_lead", "map_sponsor", "map_clean"],
    ),
    "lookup_append_idempotent": query(
        f"""
SELECT l.*, m.standard_name FROM raw_lead l
LEFT JOIN map_clean m
  ON {norm("l.lead_sponsor", again=True)} = {norm("m.lead_sponsor", again=True)}""",
        [*RAW, "raw_lead", "map_sponsor", "map_clean"],
    ),
    "lookup_chain": query(chain_sql("raw_lead", again=True), [*RAW, "raw_lead", *LOOKUPS]),
    "lookup_chain_keep_punct": query(
        chain_sql("raw_lead", again=True),
        [*RAW, "raw_lead", "map_sponsor", "seg_us", "seg_ww"],
        **PUNCTUATED,
    ),
    "lookup_keys_renamed": query(
        f"SELECT * RENAME (lead_sponsor AS company) FROM ({chain_sql('raw_lead', again=True)})",
        [*RAW, "raw_lead", *LOOKUPS],
    ),
    "tag_area": query(
        f"SELECT trial_id, therapeutic_area, {AREA_TAG} AS area_tag FROM sheet", [*RAW, "sheet"]
    ),
    "tag_covid": query(
        f"SELECT trial_id, trial_title, {COVID_TAG} AS covid_tag FROM sheet", [*RAW, "sheet"]
    ),
    "tag_phase": query(
        f"SELECT trial_id, trial_phase, {PHASE_TAG} AS phase_tag FROM sheet", [*RAW, "sheet"]
    ),
    "tag_region": query(
        f"SELECT trial_id, trial_region, {REGION_TAG} AS region_tag FROM sheet", [*RAW, "sheet"]
    ),
    "tag_healthy": query(
        f"""
SELECT trial_id, {STRICT_HEALTHY} AS healthy_phase_one, {healthy_tag()} AS healthy_tag
FROM sheet""",
        [*RAW, "sheet"],
    ),
    "date_window": query(
        f"""
SELECT trial_id, trial_status, start_date, {_PARTS} FROM sheet WHERE {_STATUS} AND {_WINDOW}""",
        [*RAW, "sheet"],
    ),
    "date_order_check": query(
        """
SELECT trial_id, start_date, last_modified_date, 'before' AS rule FROM sheet
WHERE start_date < last_modified_date
UNION ALL
SELECT trial_id, start_date, last_modified_date, 'upto' AS rule FROM sheet
WHERE start_date <= last_modified_date""",
        [*RAW, "sheet"],
    ),
    "prefix_filter": query(
        "SELECT trial_id, sponsor_type FROM tt_raw WHERE sponsor_type LIKE 'Industry%'", RAW
    ),
    "filter_spec": query(
        f"""
SELECT * FROM (SELECT trial_id, trial_status, {PHASE_TAG} AS phase_tag, {AREA_TAG} AS area_tag,
  {REGION_TAG} AS region_tag, {covid_tag("trial_title")} AS covid_tag FROM sheet)
WHERE {_CHOSEN}""",
        [*RAW, "sheet"],
    ),
    "apply_filters_fixed": query(
        f"""
SELECT *, {_PARTS}, {TAGS}, {STRICT_HEALTHY} AS healthy_tag FROM sheet
WHERE {_STATUS} AND {_WINDOW} AND start_date < last_modified_date
  AND sponsor_type LIKE 'Industry%'""",
        [*RAW, "sheet"],
    ),
    "apply_filters_spec": query(
        f"""
SELECT * FROM (SELECT *, {_PARTS}, {TAGS}, {healthy_tag()} AS healthy_tag FROM sheet)
WHERE {_CHOSEN} AND start_date >= DATE '1993-06-01' AND start_date < DATE '1998-02-01'
  AND start_date <= last_modified_date""",
        [*RAW, "sheet"],
    ),
    "scan_csv_roundtrip": query("SELECT * EXCLUDE (full_completion_date) FROM tt_raw", RAW),
    "scan_csv_typed": query(_TYPED, ["ct_raw"]),
    "write_fallback": query(
        "SELECT *, 'csv' AS fmt, '/map.csv' AS ending FROM map_sponsor", ["map_sponsor"]
    ),
    "sheet_full": f"""
SELECT {_FULL}, {_FULL_CODE} AS "NCT ID", {_FULL_AGE}
FROM (SELECT *, {cleaned(FULL_CELLS["Patient Age Group"])} AS "Patient Age Group" FROM orders)
""",
    "filter_sponsors": query(
        " UNION ALL ".join(
            f"SELECT trial_id, clean_sponsor_type, lead_sponsor, '{pick}' AS pick "
            f"FROM sponsored WHERE {rule}"
            for pick, rule in _PICKS.items()
        ),
        [*RAW, "sheet"],
        sponsored=_SPONSORS,
    ),
    "region_codes": query(
        " UNION ALL ".join(
            [
                f"SELECT *, '{asked}' AS asked FROM tagged_region WHERE region_tag = '{tag}'"
                for asked, tag in _REGIONS.items()
            ]
            + ["SELECT *, 'Global' AS asked FROM tagged_region"]
        ),
        [*RAW, "sheet"],
        tagged_region=f"SELECT trial_id, trial_region, {REGION_TAG} AS region_tag FROM sheet",
    ),
    "batch_staged": pipeline("SELECT * FROM segments", left_sql()),
    "batch_outputs": pipeline(
        " UNION ALL ".join(_written(s, f"{s}_part") for s in ("left", "both", "union")),
        left_sql(),
    ).replace(
        f"tt_raw AS ({PARTS['tt_raw']})",
        f"tt_raw AS (SELECT * REPLACE ({_LONG_PLAN} AS treatment_plan) FROM ({PARTS['tt_raw']}))",
    ),
    "stage_summary": pipeline(
        " UNION ALL ".join(
            f"SELECT '{name.removesuffix('_part')}' AS stage, count(*) AS n_rows, "
            f"CAST({width} AS BIGINT) AS n_cols FROM {name}"
            for name, width in _STAGE_PARTS.items()
        ),
        left_sql(),
    ),
    "batch_full": pipeline("SELECT * FROM segments", left_sql()),
    "scan_csv_split": query("SELECT * EXCLUDE (full_completion_date) FROM tt_raw", RAW),
    "date_window_by_month": query(
        f"""
SELECT trial_id, trial_status, start_date, {_PARTS} FROM sheet WHERE {_STATUS} AND {_WINDOW}""",
        [*RAW, "sheet"],
    ),
    "lookup_chain_uncleaned": query(
        chain_sql("raw_lead", again=True),
        [*RAW, "raw_lead", "map_sponsor", "seg_us", "seg_ww"],
        map_clean="""
SELECT lead_sponsor, CASE WHEN lead_sponsor NOT LIKE '% 4' THEN standard_name END AS standard_name FROM map_sponsor""",
        us_clean="SELECT standard_name, us_segment FROM seg_us UNION ALL SELECT NULL, 'No Name Us'",
        ww_clean="SELECT standard_name, ww_segment FROM seg_ww UNION ALL SELECT NULL, 'No Name Ww'",
    ),
    "cached_pair": pipeline(
        f"""
SELECT 'batch' AS request, trial_id, NULL AS region_tag, NULL AS healthy_tag, lead_sponsor, us_segment, study_title_CT FROM segments
UNION ALL
SELECT 'fixed', trial_id, {REGION_TAG}, {STRICT_HEALTHY}, NULL, NULL, NULL FROM sheet
WHERE {_STATUS} AND {_WINDOW} AND start_date < last_modified_date AND sponsor_type LIKE 'Industry%'
UNION ALL
SELECT 'spec', trial_id, region_tag, healthy_tag, NULL, NULL, NULL
FROM (SELECT *, {_PARTS}, {TAGS}, {healthy_tag()} AS healthy_tag FROM sheet)
WHERE {_CHOSEN} AND start_date >= DATE '1993-06-01' AND start_date < DATE '1998-02-01'
  AND start_date <= last_modified_date""",
        left_sql(),
    ),
    "keyed_both": query("SELECT * FROM both_part", [*JOINED, "both_part"]),
    "keyed_left_only": query(
        """
SELECT s.* FROM sheet s
WHERE NOT EXISTS (SELECT 1 FROM public p WHERE p.nct_id IS NOT DISTINCT FROM s.nct_id)""",
        JOINED,
    ),
    "keyed_right_only": query(
        f"SELECT p.nct_id, {CT_LIST} FROM public p ANTI JOIN sheet s ON p.nct_id = s.nct_id", JOINED
    ),
    "join_hot_keys": query(
        """
SELECT trial_id, count(*) AS n_rows, max(study_title) AS last_title
FROM (SELECT trial_id, CASE WHEN trial_id % 3 = 0 THEN 'NCT00000002' ELSE nct_id END AS id FROM sheet)
JOIN (SELECT CASE WHEN substr(md5(nct_id), 1, 2) = '00' THEN 'NCT00000002' ELSE nct_id END AS id, study_title FROM public)
  USING (id) GROUP BY trial_id""",
        JOINED,
    ),
    "batch_flags": pipeline(
        "SELECT * FROM segments",
        left_sql("'Industry', 'Others'", "'Interventional', 'Observational', 'Ambiguous'"),
    ),
}
