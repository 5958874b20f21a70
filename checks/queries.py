"""One query per operator over the given tables; ``checks.oracles`` holds the SQL for each."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.fixtures import FULL_SHEET, fixture, table
from registryloom.functions import text
from registryloom.functions.ids import NO_CODE
from registryloom.functions.text import norm_key
from registryloom.names import Names, col
from registryloom.operators import clean, filters, joins, lookups, refine, schema, tagging
from registryloom.plans import branches, pipeline, trial_filters
from registryloom.plans.branches import Refinement
from registryloom.plans.cleaning import clean_public, clean_sheet, select_sheet
from registryloom.plans.cached import CachedPair, save_requests
from registryloom.plans.keyed import Layout, split_keyed
from registryloom.plans.pipeline import PipelineConfig
from registryloom.plans.trial_filters import FilterSpec
from registryloom.sources.headers import DISPLAY_SHEET, SNAKE_SHEET
from registryloom.sources.months import load_by_month, save_by_month
from registryloom.sources.tables import load_table, save_or_csv, save_table, shared_dir

N = Names()
KEEP = ["trial_status", "trial_id", "not_there", "sponsor", "study_design", "trial_title"]
RENAMES = {"trial_status": "sheet_status", "study_design": "sheet_design", "absent": "x"}
DATE_SPELLINGS = (
    "M/d/yyyy",
    "d-MMM-yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "yyyy/MM/dd",
    "yyyyMMdd",
    "MMM yyyy",
    "MMMM yyyy",
)
WINDOW = ((1994, 3), (1997, 9))
REQUEST = {
    "start_date_from_month": 6,
    "start_date_from_year": 1993,
    "start_date_until_month": 2,
    "start_date_until_year": 1998,
    "selected_phases": ["I", "II", "Recommend Exclude"],
    "selected_trial_statuses": ["Open", "Closed", "Completed"],
    "selected_therapeutic_areas": ["Oncology", "Cns", "Vaccines", "Multiple"],
    "selected_sponsors": ["All Sponsors included"],
    "region_enabled": True,
    "region": "na",
}

# A request that narrows nothing by itself.
OPEN_REQUEST = {
    "start_date_from_month": 1,
    "start_date_from_year": 1992,
    "start_date_until_month": 12,
    "start_date_until_year": 1998,
}
# The fixture's sheet has its final headers, fewer of them, and dates as text.
SHEET_AS_IS = replace(
    SNAKE_SHEET,
    keep=[
        "trial_id",
        "protocol_trial_id",
        "trial_title",
        "trial_phase",
        "trial_status",
        "therapeutic_area",
        "disease",
        "sponsor",
        "sponsor_type",
        "study_design",
        "treatment_plan",
        "study_keywords",
        "patient_age_group",
        "trial_region",
        "start_date",
        "last_modified_date",
        "full_completion_date",
        "target_accrual",
    ],
    renames={},
)


def _days(df: DataFrame) -> DataFrame:
    """Timestamps as days, so that session time zones cannot matter in the comparison."""
    days = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return schema.replace_columns(df, {n: col(n).cast("date") for n in days})


def _sheet(spark: SparkSession, sf: str) -> DataFrame:
    return clean_sheet(fixture(spark, sf, "tt_raw"))


def _public(spark: SparkSession, sf: str) -> DataFrame:
    return clean_public(fixture(spark, sf, "ct_raw"))


def _split(spark: SparkSession, sf: str) -> joins.JoinSplit:
    return joins.split_join(
        _sheet(spark, sf), _public(spark, sf), N.registry_id, right_columns=N.right_columns
    )


def _no_code(spark: SparkSession, sf: str) -> DataFrame:
    return branches.no_code_rows(_sheet(spark, sf), _public(spark, sf))


def clean_text(spark, sf):
    docs = table(spark, sf, "documents")
    plain = docs.select("doc_id", text.clean_text(F.col("text")).alias("plain"))
    cased = {m: text.with_case(F.col("plain"), m).alias(m) for m in ("upper", "lower", "title")}
    return plain.select("doc_id", "plain", *cased.values())


def clean_table(spark, sf):
    return clean.clean_table(fixture(spark, sf, "tt_raw"), case_mode="title")


def clean_table_drop_rows(spark, sf):
    raw = fixture(spark, sf, "tt_raw").select(
        "trial_id",
        "trial_phase",
        "sponsor_type",
        F.coalesce("study_keywords", F.lit(" \t ")).alias("study_keywords"),
    )
    return clean.clean_table(raw, ["trial_phase", "sponsor_type", "study_keywords"])


def drop_null_columns(spark, sf):
    typed = schema.coerce_dates(fixture(spark, sf, "tt_raw"), ["start_date"])
    scope = ["trial_id", "trial_phase", "start_date", "full_completion_date"]
    return _days(clean.clean_table(typed, scope, case_mode="upper", drop_null_columns=True))


def remove_punct(spark, sf):
    return clean.remove_punctuation(table(spark, sf, "documents"))


def sanitize_cells(spark, sf):
    dirty = table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("\x01\t"), "text", F.lit("\x0b\x1f\n.")).alias("text"),
        F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang"),
        "n_chars",
    )
    return clean.sanitize_cells(dirty)


def project_rename(spark, sf):
    kept = schema.keep_columns(fixture(spark, sf, "tt_raw"), KEEP)
    return schema.rename_columns(kept, RENAMES)


def coerce_types(spark, sf):
    n = F.col("trial_id")
    id_text = (
        F.when(n % 7 == 0, F.concat(n.cast("string"), F.lit(".5")))
        .when(n % 7 == 1, F.concat(n.cast("string"), F.lit(".0")))
        .when(n % 7 == 2, F.concat(F.lit("x"), n.cast("string")))
        .otherwise(n.cast("string"))
    )
    # One spelling after the other; the month names and the compact form among them.
    day = F.to_date("last_modified_date")
    written = [F.date_format(day, f) for f in ("MM/dd/yyyy", *DATE_SPELLINGS)]
    spelled = reduce(lambda c, i: c.when(n % 11 == i, written[i]), range(len(written)), F)
    raw = fixture(spark, sf, "tt_raw").select(
        "trial_id",
        id_text.alias("id_number"),
        "start_date",
        spelled.otherwise(F.col("last_modified_date")).alias("last_modified_date"),
    )
    typed = schema.coerce_dates(raw, ["start_date", "last_modified_date", "absent"])
    return _days(schema.coerce_integer(typed, "id_number"))


def extract_registry_id(spark, sf):
    raw = fixture(spark, sf, "tt_raw").select("trial_id", "protocol_trial_id")
    return refine.add_registry_id(refine.add_id_position(raw, "id_position"))


def age_flags(spark, sf):
    raw = fixture(spark, sf, "tt_raw").select("trial_id", "patient_age_group")
    return refine.add_age_flags(raw)


def keyword_filter(spark, sf):
    return _days(_public(spark, sf))


def join_three_way(spark, sf):
    return joins.bucket_counts(_sheet(spark, sf), _public(spark, sf), N.registry_id)


def join_enrich_both(spark, sf):
    return _days(_split(spark, sf).both)


def left_only_no_code(spark, sf):
    return _days(_no_code(spark, sf))


def left_only(spark, sf):
    """All rows of the sheet without a partner, with or without an id."""
    return _days(_split(spark, sf).left_only)


def join_right_only(spark, sf):
    return _split(spark, sf).right_only


def first_token_title(spark, sf):
    return refine.add_sponsor_tag(
        fixture(spark, sf, "tt_raw").select("trial_id", "sponsor_type")
    ).drop(N.sponsor_tag)


def lead_sponsor(spark, sf):
    return refine.add_lead_sponsor(fixture(spark, sf, "tt_raw").select("trial_id", "sponsor"))


def sponsor_tag_refine(spark, sf):
    tagged = refine.add_sponsor_tag(_no_code(spark, sf))
    chosen = refine.refine_sponsor(tagged, industry=True, others=True)
    return chosen.select("trial_id", "nct_id", "clean_sponsor_type", "sponsor_tag")


def base_text_filter(spark, sf):
    return _days(refine.base_text_filter(_no_code(spark, sf)))


def study_type(spark, sf):
    return refine.add_study_type(fixture(spark, sf, "tt_raw")).select("trial_id", "study_type")


def study_type_refine(spark, sf):
    raw = fixture(spark, sf, "tt_raw")
    chosen = refine.refine_study_type(raw, interventional=True, observational=True)
    return chosen.select("trial_id", "study_design", "study_type")


def union_by_name(spark, sf):
    refinement = Refinement(interventional=True, industry=True, others=True)
    layout = Layout(spark, shared_dir(spark))
    staged = pipeline.staged_branches(layout, _sheet(spark, sf), _public(spark, sf), refinement=refinement)
    return _days(staged.branches.union)


def norm_keys(spark, sf):
    sponsors = refine.add_lead_sponsor(fixture(spark, sf, "tt_raw"))
    return sponsors.select(
        "trial_id",
        norm_key(F.col("lead_sponsor")).alias("compat"),
        norm_key(F.col("lead_sponsor"), mode="idempotent").alias("idempotent"),
        norm_key(F.col("sponsor"), punct=False).alias("with_punct"),
    )


def _lookups(spark, sf) -> list[DataFrame]:
    return [fixture(spark, sf, n) for n in ("map_sponsor", "seg_us", "seg_ww")]


def lookup_append(spark, sf):
    sponsors = refine.add_lead_sponsor(
        fixture(spark, sf, "tt_raw").select("trial_id", "sponsor")
    )
    sponsor_map = lookups.clean_lookup(
        *lookups.broadcast_small(fixture(spark, sf, "map_sponsor"))
    )
    return lookups.lookup_append(
        sponsors, sponsor_map, left_key="lead_sponsor", add_columns=["standard_name"]
    )


def lookup_append_idempotent(spark, sf):
    sponsors = refine.add_lead_sponsor(
        fixture(spark, sf, "tt_raw").select("trial_id", "sponsor")
    )
    sponsor_map = lookups.clean_lookup(
        *lookups.broadcast_small(fixture(spark, sf, "map_sponsor"))
    )
    return lookups.lookup_append(
        sponsors, sponsor_map, left_key="lead_sponsor", mode="idempotent"
    )


def lookup_chain(spark, sf):
    sponsors = refine.add_lead_sponsor(
        fixture(spark, sf, "tt_raw").select("trial_id", "sponsor")
    )
    return pipeline.add_segments(sponsors, *_lookups(spark, sf), mode="idempotent")


def lookup_chain_keep_punct(spark, sf):
    """Tables keep their punctuation; keys never do."""
    sponsors = refine.add_lead_sponsor(
        fixture(spark, sf, "tt_raw").select("trial_id", "sponsor")
    )
    return pipeline.add_segments(sponsors, *_lookups(spark, sf), mode="idempotent", punct=False)


def lookup_keys_renamed(spark, sf):
    """Every key column has a name of its own."""
    sponsors = refine.add_lead_sponsor(
        fixture(spark, sf, "tt_raw").select("trial_id", "sponsor")
    ).withColumnRenamed("lead_sponsor", "company")
    sponsor_map, us, ww = _lookups(spark, sf)
    return pipeline.add_segments(
        sponsors,
        sponsor_map.withColumnRenamed("lead_sponsor", "map_name"),
        us.withColumnRenamed("standard_name", "us_name"),
        ww.withColumnRenamed("standard_name", "ww_name"),
        mode="idempotent",
        map_left_key="company",
        map_right_key="map_name",
        us_key="us_name",
        ww_key="ww_name",
    )


def tag_area(spark, sf):
    return tagging.add_area_tag(_sheet(spark, sf)).select(
        "trial_id", "therapeutic_area", "area_tag"
    )


def tag_covid(spark, sf):
    return tagging.add_covid_tag(_sheet(spark, sf)).select("trial_id", "trial_title", "covid_tag")


def tag_phase(spark, sf):
    return tagging.add_phase_tag(_sheet(spark, sf)).select("trial_id", "trial_phase", "phase_tag")


def tag_region(spark, sf):
    return tagging.add_region_tag(_sheet(spark, sf)).select(
        "trial_id", "trial_region", "region_tag"
    )


def tag_healthy(spark, sf):
    sheet = tagging.add_phase_tag(_sheet(spark, sf))
    strict = tagging.add_healthy_tag(sheet, phase_one_only=True)
    strict = strict.withColumnRenamed("healthy_tag", "healthy_phase_one")
    return tagging.add_healthy_tag(strict).select("trial_id", "healthy_phase_one", "healthy_tag")


def date_window(spark, sf):
    sheet = filters.drop_planned(_sheet(spark, sf))
    windowed = filters.month_window(filters.add_start_parts(sheet), *WINDOW)
    return _days(
        windowed.select("trial_id", "trial_status", "start_date", "start_year", "start_month")
    )


def date_order_check(spark, sf):
    sheet = _sheet(spark, sf).select("trial_id", "start_date", "last_modified_date")
    later = filters.started_before_update(sheet).withColumn("rule", F.lit("before"))
    same = filters.started_before_update(sheet, inclusive=True).withColumn("rule", F.lit("upto"))
    return _days(later.unionByName(same))


def prefix_filter(spark, sf):
    raw = fixture(spark, sf, "tt_raw").select("trial_id", "sponsor_type")
    return filters.prefix_filter(raw, "sponsor_type", "Industry")


def filter_spec(spark, sf):
    """Selections and the region filter alone, with one input column missing."""
    tagged = trial_filters.add_tags(_sheet(spark, sf).drop("disease"))
    spec = FilterSpec.from_request(REQUEST)
    out = filters.multi_select(tagged, N.status, spec.statuses)
    out = filters.multi_select(out, N.phase_tag, spec.phases)
    out = filters.multi_select(out, N.area_tag, spec.areas)
    out = filters.multi_select(out, N.lead_sponsor, spec.sponsors)
    return filters.region_filter(out, spec.region).select(
        "trial_id", "trial_status", "phase_tag", "area_tag", "region_tag", "covid_tag"
    )


def apply_filters_fixed(spark, sf):
    return _days(trial_filters.apply_filters(_sheet(spark, sf), FilterSpec.fixed(*WINDOW)))


def apply_filters_spec(spark, sf):
    spec = FilterSpec.from_request(REQUEST)
    return _days(trial_filters.apply_filters(_sheet(spark, sf), spec))


def scan_csv_roundtrip(spark, sf):
    """The raw sheet through a CSV sink and back: blanks, line breaks and NULLs survive."""
    raw = fixture(spark, sf, "tt_raw").drop("full_completion_date")
    path = f"{shared_dir(spark)}/tt_raw.csv"
    save_table(raw, path, rows_per_file=100_000)
    back = load_table(spark, path, null_markers=())
    typed = schema.coerce_integer(back, "trial_id")
    return typed.withColumn("target_accrual", F.col("target_accrual").try_cast("double"))


def scan_csv_typed(spark, sf):
    """Numbers of delimited files, cleaned as numbers: decimals, negatives and missing ones."""
    raw = fixture(spark, sf, "ct_raw").withColumn("sex", F.coalesce("sex", F.lit("n/a")))
    day = F.unix_date(F.to_date("start_date"))
    score = F.when(day % 5 != 0, (day - 9000) / 8.0)
    path = f"{shared_dir(spark)}/ct_raw"
    save_table(raw.withColumn("score", score).withColumn("size", (day % 97).cast("int")), path, "csv")
    kinds = "start_date date, score double, size int, not_there int"
    typed = load_table(spark, path, "csv", schema=kinds)
    text = load_table(spark, path, "csv", multi_line=False)
    one = clean_public(typed).withColumn("scan", F.lit("schema"))
    two = clean_public(text, numbers=["score", "size"]).withColumn("scan", F.lit("numbers"))
    two = two.withColumn("size", F.col("size").cast("int"))
    return _days(two).unionByName(one)


def write_fallback(spark, sf):
    """A table asked for as a workbook becomes a delimited one beside it."""
    raw = fixture(spark, sf, "map_sponsor")
    path, fmt = save_or_csv(raw, f"{shared_dir(spark)}/map.xlsx")
    back = load_table(spark, path)
    return back.withColumn("fmt", F.lit(fmt)).withColumn("ending", F.substring(F.lit(path), -8, 8))


def sheet_full(spark, sf):
    """A sheet with all its headers and one more, kept, renamed, typed and cleaned."""
    raw = spark.sql(FULL_SHEET, orders=table(spark, sf, "orders"))
    return _days(clean_sheet(select_sheet(raw, DISPLAY_SHEET), DISPLAY_SHEET))


def filter_sponsors(spark, sf):
    """Selections of sponsor types and of lead sponsors, alone and together."""
    sheet = refine.add_lead_sponsor(refine.add_sponsor_tag(_sheet(spark, sf)))
    types, names = ["Industry", "Government"], ["Building Co 1", "Machinery & Co 2"]
    picks = {"types": (types, "all"), "sponsors": ([], names), "both": (types, names)}
    parts = []
    for pick, (by_type, by_name) in picks.items():
        request = {**OPEN_REQUEST, "selected_lead_sponsor_types": by_type, "selected_sponsors": by_name}
        out = trial_filters.apply_filters(sheet, FilterSpec.from_request(request))
        parts.append(out.select("trial_id", "clean_sponsor_type", "lead_sponsor", F.lit(pick).alias("pick")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def region_codes(spark, sf):
    """Each code of the request form, a tag in full, and no choice."""
    tagged = tagging.add_region_tag(_sheet(spark, sf).select("trial_id", "trial_region"))
    asked = [*filters.REGION_CODES, "NA and EU", "Global"]
    parts = [filters.region_filter(tagged, r).withColumn("asked", F.lit(r)) for r in asked]
    return reduce(DataFrame.unionByName, parts)


def batch_outputs(spark, sf):
    """Outputs come back as the stages are: long cells whole, missing ones missing."""
    root = shared_dir(spark)
    sheet = fixture(spark, sf, "tt_raw").withColumn(
        "treatment_plan", F.when(F.col("trial_id") % 40 == 0, F.repeat(F.lit("plan "), 8000)).otherwise(F.col("treatment_plan"))
    )
    files = _saved(spark, sf, root, tt_raw=sheet)
    outputs = {s: f"{root}/out/{s}" for s in ("left", "both", "union")}
    pipeline.run_pipeline(spark, PipelineConfig(**files, outputs=outputs, sheet=SHEET_AS_IS))
    read = [spark.read.parquet(p).withColumn("stage", F.lit(s)) for s, p in outputs.items()]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read)
    return whole.select(
        "stage", "trial_id", F.length("treatment_plan").cast("bigint").alias("plan_chars"), "trial_status", "study_title_CT"
    )


def batch_staged(spark, sf):
    """The whole batch from files, by way of the stage folder."""
    files = _saved(spark, sf, shared_dir(spark))
    stages = pipeline.run_pipeline(spark, PipelineConfig(**files, sheet=SHEET_AS_IS))
    return _days(stages["segments"])


def _saved(spark, sf, root: str, **frames: DataFrame) -> dict[str, str]:
    """The input files of a batch, as folders without an ending."""
    names = ("tt_raw", "ct_raw", "map_sponsor", "seg_us", "seg_ww")
    for name in names:
        save_table(frames.get(name, fixture(spark, sf, name)), f"{root}/{name}")
    return dict(zip(pipeline._PATHS, (f"{root}/{n}" for n in names)))


def _stages(spark, sf, **flags) -> pipeline.Stages:
    return pipeline.staged_stages(
        spark,
        fixture(spark, sf, "tt_raw"),
        fixture(spark, sf, "ct_raw"),
        *_lookups(spark, sf),
        refinement=Refinement(**flags),
    )


def stage_summary(spark, sf):
    return pipeline.stage_summary(_stages(spark, sf))


def batch_full(spark, sf):
    return _days(_stages(spark, sf)["segments"])


def batch_flags(spark, sf):
    flags = {"interventional": True, "observational": True, "industry": True, "others": True}
    return _days(_stages(spark, sf, **flags)["segments"])


def cached_pair(spark, sf):
    """A batch and two filter requests over one cleaning, which is released before this returns."""
    root, asked = shared_dir(spark), {"fixed": FilterSpec.fixed(*WINDOW), "spec": REQUEST}
    with CachedPair(_sheet(spark, sf), _public(spark, sf)) as pair:
        frames = {n: pair.filtered(r).select("trial_id", "region_tag", "healthy_tag") for n, r in asked.items()}
        batch = pair.stages(*_lookups(spark, sf))["segments"]
        frames["batch"] = batch.select("trial_id", "lead_sponsor", "us_segment", "study_title_CT")
        save_requests(frames, root)
    read = [spark.read.parquet(f"{root}/{n}").withColumn("request", F.lit(n)) for n in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read)


def _keyed_split(spark, sf) -> joins.JoinSplit:
    """The two files laid out by registry id, and their three parts over what was laid out."""
    pair = pipeline.staged_pair(Layout(spark, shared_dir(spark)), _sheet(spark, sf), _public(spark, sf))
    return split_keyed(*pair, right_columns=N.right_columns)


def keyed_both(spark, sf):
    return _days(_keyed_split(spark, sf).both)


def keyed_left_only(spark, sf):
    return _days(_keyed_split(spark, sf).left_only)


def keyed_right_only(spark, sf):
    return _keyed_split(spark, sf).right_only


def join_hot_keys(spark, sf):
    """Both files with a third of their rows under ids that nobody named, found by a sketch."""
    hot = F.when(F.col("trial_id") % 3 == 0, F.lit("NCT00000002"))
    sheet = _sheet(spark, sf).select("trial_id", F.coalesce(hot, N.registry_id).alias(N.registry_id))
    few = F.substring(F.md5(F.col(N.registry_id).cast("binary")), 1, 2) == "00"
    public = _public(spark, sf).select(F.when(few, F.lit("NCT00000002")).otherwise(F.col(N.registry_id)).alias(N.registry_id), "study_title")
    found = joins.frequent_keys(sheet, N.registry_id, 0.1)
    split = joins.split_join(
        sheet,
        joins.per_key(public, N.registry_id, n_rows=F.count(F.lit(1)), study_title=F.max("study_title")),
        N.registry_id,
        right_columns=["n_rows", "study_title"],
        hot_keys=[*found, NO_CODE],
    )
    counts = split.both.groupBy("trial_id").agg(F.sum("n_rows_CT").alias("n_rows"), F.max("study_title_CT").alias("last_title"))
    return counts


def scan_csv_split(spark, sf):
    """One delimited file with line breaks in cells, read by byte range."""
    # The rows are made in many tasks and moved to the one that writes them.
    raw = fixture(spark, sf, "tt_raw").drop("full_completion_date").repartition(1)
    path = f"{shared_dir(spark)}/tt_raw.csv"
    save_table(raw, path)
    typed = schema.coerce_integer(load_table(spark, path, null_markers=(), split=True), "trial_id")
    return typed.withColumn("target_accrual", F.col("target_accrual").try_cast("double"))


def date_window_by_month(spark, sf):
    """The date window over a sheet laid out by start month."""
    path = save_by_month(_sheet(spark, sf), f"{shared_dir(spark)}/months")
    sheet = filters.drop_planned(load_by_month(spark, path))
    windowed = filters.month_window(filters.add_start_parts(sheet), *WINDOW)
    return _days(windowed.select("trial_id", "trial_status", "start_date", "start_year", "start_month"))


def lookup_chain_uncleaned(spark, sf):
    """Tables as they are: NULL names and NULL keys meet, and trials without a name get NULL's segments."""
    sponsors = refine.add_lead_sponsor(fixture(spark, sf, "tt_raw").select("trial_id", "sponsor"))
    nulls = {"standard_name": None, "us_segment": "No Name Us", "ww_segment": "No Name Ww"}
    sponsor_map, us, ww = _lookups(spark, sf)
    us, ww = (
        t.unionByName(spark.range(1).select(*[F.lit(nulls[c]).cast("string").alias(c) for c in t.columns])) for t in (us, ww)
    )
    sponsor_map = sponsor_map.withColumn(
        "standard_name", F.when(F.col("lead_sponsor").endswith(" 4"), None).otherwise(F.col("standard_name"))
    )
    return pipeline.add_segments(sponsors, sponsor_map, us, ww, mode="idempotent", cleanse=False)


QUERIES = {
    "clean_text": clean_text,
    "clean_table": clean_table,
    "clean_table_drop_rows": clean_table_drop_rows,
    "drop_null_columns": drop_null_columns,
    "remove_punct": remove_punct,
    "sanitize_cells": sanitize_cells,
    "project_rename": project_rename,
    "coerce_types": coerce_types,
    "extract_registry_id": extract_registry_id,
    "age_flags": age_flags,
    "keyword_filter": keyword_filter,
    "join_three_way": join_three_way,
    "join_enrich_both": join_enrich_both,
    "left_only_no_code": left_only_no_code,
    "left_only": left_only,
    "join_right_only": join_right_only,
    "first_token_title": first_token_title,
    "lead_sponsor": lead_sponsor,
    "sponsor_tag_refine": sponsor_tag_refine,
    "base_text_filter": base_text_filter,
    "study_type": study_type,
    "study_type_refine": study_type_refine,
    "union_by_name": union_by_name,
    "norm_key": norm_keys,
    "lookup_append": lookup_append,
    "lookup_append_idempotent": lookup_append_idempotent,
    "lookup_chain": lookup_chain,
    "lookup_chain_keep_punct": lookup_chain_keep_punct,
    "lookup_keys_renamed": lookup_keys_renamed,
    "tag_area": tag_area,
    "tag_covid": tag_covid,
    "tag_phase": tag_phase,
    "tag_region": tag_region,
    "tag_healthy": tag_healthy,
    "date_window": date_window,
    "date_order_check": date_order_check,
    "prefix_filter": prefix_filter,
    "filter_spec": filter_spec,
    "apply_filters_fixed": apply_filters_fixed,
    "apply_filters_spec": apply_filters_spec,
    "scan_csv_roundtrip": scan_csv_roundtrip,
    "scan_csv_typed": scan_csv_typed,
    "write_fallback": write_fallback,
    "sheet_full": sheet_full,
    "filter_sponsors": filter_sponsors,
    "region_codes": region_codes,
    "stage_summary": stage_summary,
    "batch_full": batch_full,
    "batch_flags": batch_flags,
    "batch_staged": batch_staged,
    "batch_outputs": batch_outputs,
    "cached_pair": cached_pair,
    "scan_csv_split": scan_csv_split,
    "date_window_by_month": date_window_by_month,
    "lookup_chain_uncleaned": lookup_chain_uncleaned,
    "keyed_both": keyed_both,
    "keyed_left_only": keyed_left_only,
    "keyed_right_only": keyed_right_only,
    "join_hot_keys": join_hot_keys,
}
