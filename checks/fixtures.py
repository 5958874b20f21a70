"""Registry-like inputs derived from the given tables by SQL that both engines run alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from registryloom.sources.headers import SHEET_COLUMNS, SHEET_DATES, SHEET_NUMBERS
from registryloom.sources.tables import spread

TT_RAW = """
SELECT o_orderkey AS trial_id,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL
       WHEN o_orderkey % 4 = 3 THEN ' EudraCT-' || CAST(o_orderkey AS STRING)
       ELSE 'eu ' || CAST(o_orderkey AS STRING) || ';  nct' || lpad(CAST(o_orderkey AS STRING), 8, '0') END AS protocol_trial_id,
  'Study of' || chr(9) || c_mktsegment || CASE WHEN o_orderkey % 17 = 0 THEN ' in COVID-19' WHEN o_orderkey % 19 = 0 THEN ' in sars-cov-2' WHEN o_orderkey % 5 = 0 THEN ' in healthy  volunteers' ELSE '' END AS trial_title,
  CASE o_orderkey % 8 WHEN 0 THEN 'I' WHEN 1 THEN 'I/II' WHEN 2 THEN ' ii ' WHEN 3 THEN 'II/III' WHEN 4 THEN 'III' WHEN 5 THEN 'III/IV' WHEN 6 THEN 'IV' ELSE NULL END AS trial_phase,
  CASE o_orderkey % 6 WHEN 0 THEN 'Open' WHEN 1 THEN 'Closed' WHEN 2 THEN 'Planned' WHEN 3 THEN 'Completed' WHEN 4 THEN 'Temporarily Closed' ELSE NULL END AS trial_status,
  CASE o_orderkey % 7 WHEN 0 THEN 'Oncology' WHEN 1 THEN 'CNS' WHEN 2 THEN 'Vaccines (Infectious Disease)' WHEN 3 THEN 'Infectious Disease; Vaccines (Infectious Disease)' WHEN 4 THEN 'Oncology; CNS' WHEN 5 THEN 'Cardiovascular' ELSE NULL END AS therapeutic_area,
  CASE WHEN o_orderkey % 23 = 0 THEN 'Wuhan Coronavirus' ELSE o_orderpriority END AS disease,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE ' ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ' & co ' ELSE ' co ' END || CAST(c_nationkey AS STRING) || ', inc' || chr(13) || chr(10) || 'Partner, llc' END AS sponsor,
  CASE o_orderkey % 5 WHEN 0 THEN 'Industry' WHEN 1 THEN 'Academic, Industry' WHEN 2 THEN 'INDUSTRY' || chr(10) || 'Academic' WHEN 3 THEN 'Government' ELSE NULL END AS sponsor_type,
  CASE o_orderstatus WHEN 'O' THEN 'Double-Blind, Randomized' WHEN 'F' THEN 'non interventional observation' ELSE NULL END AS study_design,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Placebo arm' ELSE 'dose' END AS treatment_plan,
  CASE WHEN o_orderkey % 10 = 0 THEN 'bioequivalence; observational' ELSE NULL END AS study_keywords,
  CASE o_orderkey % 4 WHEN 0 THEN 'Children, Adults' WHEN 1 THEN 'Older Adults' WHEN 2 THEN 'adults' ELSE NULL END AS patient_age_group,
  CASE o_orderkey % 8 WHEN 0 THEN 'North America' WHEN 1 THEN 'Western Europe' WHEN 2 THEN 'Asia' WHEN 3 THEN 'Australia/Oceania; North America' WHEN 4 THEN 'North America; Western Europe' WHEN 5 THEN 'Western Europe; Asia' WHEN 6 THEN 'North America; Western Europe; Asia' ELSE 'Africa' END AS trial_region,
  CASE WHEN o_orderkey % 29 = 0 THEN 'n/a' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS start_date,
  CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 - 20 AS INT) AS STRING) AS last_modified_date,
  CAST(NULL AS DATE) AS full_completion_date,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 500 AS DOUBLE) END AS target_accrual
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

CT_RAW = """
SELECT ' nct' || lpad(CAST(CASE WHEN o_orderkey % 10 = 9 THEN o_orderkey + 50000000 ELSE o_orderkey END AS STRING), 8, '0') AS nct_id,
  'Trial (' || o_orderpriority || ')' AS study_title, lower(o_orderstatus) AS study_status,
  CASE o_orderkey % 4 WHEN 0 THEN 'Drug: A|Device: B' WHEN 1 THEN 'biological: C' WHEN 2 THEN 'DRUGS' ELSE 'Behavioral: D' END AS interventions,
  'cond_' || CAST(o_custkey % 50 AS STRING) AS condition,
  CASE o_orderkey % 3 WHEN 0 THEN 'All' WHEN 1 THEN 'Female' ELSE NULL END AS sex,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS start_date
FROM {orders} WHERE o_orderkey % 2 = 0 OR o_orderkey % 5 = 4
"""

MAP_SPONSOR = """
SELECT DISTINCT lower(c_mktsegment) || ' &  CO ' || CAST(c_nationkey AS STRING) AS lead_sponsor, 'Std ' || c_mktsegment || '-' || CAST(c_nationkey % 5 AS STRING) AS standard_name FROM {customer} WHERE c_nationkey % 3 <> 0
UNION ALL SELECT 'Building Co 1' AS lead_sponsor, 'Std Dup' AS standard_name
"""

SEG_US = """
SELECT DISTINCT 'std ' || c_mktsegment || CAST(c_nationkey % 5 AS STRING) AS standard_name, CASE c_nationkey % 5 WHEN 0 THEN 'global pharma' WHEN 1 THEN 'SMID' ELSE NULL END AS us_segment FROM {customer} WHERE c_nationkey % 5 < 4
"""

SEG_WW = """
SELECT DISTINCT 'std ' || c_mktsegment || CAST(c_nationkey % 5 AS STRING) AS standard_name, CASE c_nationkey % 5 WHEN 0 THEN 'global pharma' WHEN 1 THEN 'SMID' ELSE NULL END AS ww_segment FROM {customer} WHERE c_nationkey % 5 < 3
"""



def _full_cell(i: int, header: str) -> str:
    """Dates in three spellings, numbers with junk, the id text, and blanks around words."""
    key = "o_orderkey"
    if header == "Trial ID":
        return f"CASE WHEN {key} % 9 = 0 THEN CAST({key} AS STRING) || '.0' ELSE CAST({key} AS STRING) END"
    if header == "Protocol/Trial ID":
        return f"CASE WHEN {key} % 4 = 0 THEN 'eu; nct' || lpad(CAST({key} AS STRING), 8, '0') ELSE 'none' END"
    if header in SHEET_DATES:
        return f"CASE {key} % 3 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN 'n/a' END"
    if header in SHEET_NUMBERS:
        return f"CASE {key} % 3 WHEN 0 THEN CAST({key} % 50 AS STRING) || '.5' WHEN 1 THEN 'x' END"
    word = f"' ab' || chr(9) || 'c{i}  D ' || CAST({key} % {i + 2} AS STRING)"
    return f"CASE WHEN {key} % {i + 3} <> 0 THEN {word} END"


FULL_CELLS = {h: _full_cell(i, h) for i, h in enumerate(SHEET_COLUMNS)}
FULL_SHEET = (
    "SELECT 'drop me' AS not_wanted, "
    + ", ".join(f"{cell} AS `{h}`" for h, cell in reversed(FULL_CELLS.items()))
    + " FROM {orders}"
)

FIXTURES = {
    "tt_raw": TT_RAW,
    "ct_raw": CT_RAW,
    "map_sponsor": MAP_SPONSOR,
    "seg_us": SEG_US,
    "seg_ww": SEG_WW,
}
TABLES = ("customer", "orders")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = FIXTURES[name]
    read = {"orders": table(spark, sf_dir, "orders")} if "{orders}" in text else {}
    if "{customer}" in text:
        read["customer"] = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return spark.sql(text, **read)


def fixture_sql(name: str) -> str:
    """The same text over tables called by their own names."""
    return FIXTURES[name].format(**{t: t for t in TABLES}).strip()
