import datetime as dt

import pytest

from pyspark.sql import functions as F

from registryloom.names import DISPLAY, col
from registryloom.operators import clean, filters, refine, schema, tagging
from registryloom.plans import trial_filters
from registryloom.plans.trial_filters import FilterSpec


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(
        [
            (None, None, float("nan"), " a\t b ", None, dt.date(2020, 1, 1)),
            (1, True, 2.5, None, "Keep  me", None),
        ],
        "n int, b boolean, d double, t string, other string, day date",
    )


def test_fills_and_scope(mixed):
    out = clean.clean_table(mixed, ["n", "b", "d", "t", "day", "absent"], case_mode="title")
    assert out.columns == mixed.columns
    assert rows(out) == [
        (0, False, 0.0, "A B", None, dt.date(2020, 1, 1)),
        (1, True, 2.5, "", "Keep  me", None),
    ]
    kept = clean.clean_table(mixed, fill_text=False, fill_numbers=False)
    assert rows(kept)[0][:2] == (None, None) and rows(kept)[1][3] is None


def test_empty_list_means_all_columns(mixed):
    assert rows(clean.clean_table(mixed, [])) == rows(clean.clean_table(mixed))


def test_row_drop(spark):
    df = spark.createDataFrame(
        [(1, " ", None), (2, "x", None), (None, " ", ""), (0, None, None)],
        "n int, a string, b string",
    )
    assert clean.clean_table(df, ["a", "b"]).count() == 1
    assert clean.clean_table(df).count() == 4, "a filled number is a value"
    assert clean.clean_table(df, fill_numbers=False).count() == 3, "zero is a value"
    assert clean.clean_table(df, ["a", "b"], strip_ws=False).count() == 3
    assert clean.clean_table(df, ["a", "b"], drop_rows=False).count() == 4
    assert clean.clean_table(df, ["absent"]).count() == 4


def test_null_column_drop(spark):
    df = spark.createDataFrame(
        [("a", None, None, 1)], "t string, empty date, out date, n int"
    )
    dropped = clean.clean_table(df, ["t", "empty", "n"], drop_null_columns=True)
    assert dropped.columns == ["t", "out", "n"]
    none = clean.clean_table(df.filter("n > 1"), ["t", "empty", "n"], drop_null_columns=True)
    assert none.columns == ["out"]


def test_columns_with_odd_headers(spark):
    df = spark.createDataFrame(
        [("a b", 1, None)], "`Sites (No. of x)` string, `a.b/c` int, `x:y` date"
    )
    out = clean.clean_table(df, case_mode="upper", drop_null_columns=True)
    assert out.columns == ["Sites (No. of x)", "a.b/c"] and rows(out) == [("A B", 1)]
    kept = schema.keep_columns(df, ["a.b/c", "absent", "Sites (No. of x)"])
    renamed = schema.rename_columns(kept, {"a.b/c": "k.1", "absent": "z"})
    assert renamed.columns == ["k.1", "Sites (No. of x)"]
    assert rows(clean.sanitize_cells(df)) == [("a b", 1, None)]


def test_coercions_leave_typed_columns_alone(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), "2020")], "d date, t string")
    out = schema.coerce_dates(df, ["d", "t", "absent"])
    assert dict(out.dtypes) == {"d": "date", "t": "timestamp_ntz"}
    assert schema.coerce_integer(df, "absent") is df


def test_remove_punctuation_scope(spark):
    df = spark.createDataFrame([("a-b_c!", "x.y", None, 1)], "a string, b string, c string, n int")
    assert rows(clean.remove_punctuation(df)) == [("ab_c", "xy", None, 1)]
    assert rows(clean.remove_punctuation(df, ["b"])) == [("a-b_c!", "xy", None, 1)]


def test_keyword_filter_and_replace(spark):
    df = spark.createDataFrame(
        [("drugs", "ALL"), ("xbiologicalx", "all"), ("dr ug", "ALL"), (None, None)], "i string, s string"
    )
    out = filters.replace_value(filters.keyword_filter(df, "i"), "s", "ALL", "BOTH")
    assert rows(out) == [("drugs", "BOTH"), ("xbiologicalx", "all")]


def test_refinements(spark):
    df = spark.createDataFrame(
        [
            (1, "industry, x", "Double-Blind", None, None),
            (2, "\nIndustry", "dose", "placebo", None),
            (3, None, "observation", None, "control"),
            (4, "Academic\rz", "non-interventional", None, None),
        ],
        "id int, sponsor_type string, study_design string, treatment_plan string, study_keywords string",
    )
    tagged = refine.add_sponsor_tag(df)
    got = {r.id: (r.clean_sponsor_type, r.sponsor_tag) for r in tagged.collect()}
    assert got == {1: ("Industry", "Industry"), 2: ("", "Others"), 3: (None, "Others"),
                   4: ("Academic", "Academic")}
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(refine.refine_sponsor(tagged)) == [1, 2, 3, 4]
    assert ids(refine.refine_sponsor(tagged, academic=True, others=True)) == [2, 3, 4]
    assert ids(refine.base_text_filter(df)) == [1, 2, 3, 4]
    assert refine.refine_study_type(df, False, None) is df
    assert ids(refine.refine_study_type(df, True, False)) == [1, 2]
    assert ids(refine.refine_study_type(df, True, True)) == [1, 2, 3, 4]
    assert ids(refine.refine_study_type(df, observational=True)) == []
    assert ids(refine.base_text_filter(df.drop("study_design"))) == [2, 3]


def test_lead_sponsor_sources(spark):
    df = spark.createDataFrame([("acme co, x", None)], "sponsor_collaborator string, z string")
    assert refine.add_lead_sponsor(df).first().lead_sponsor == "Acme Co"
    assert refine.add_lead_sponsor(df.drop("sponsor_collaborator")).first().lead_sponsor == ""
    shown = df.withColumnRenamed("sponsor_collaborator", "TT_Sponsor/Collaborator")
    assert refine.add_lead_sponsor(shown, DISPLAY).first()["Lead Sponsor"] == "Acme Co"


@pytest.fixture(scope="module")
def trials(spark):
    base = ("Oncology", "I", "healthy people", "North America", "NO NCT CODE")
    return spark.createDataFrame(
        [
            (1, "Open", "Industry", "2015-01-01", "2015-01-01", *base),
            (2, "Planned", "Industry", "2015-06-01", "2016-01-01", *base),
            (3, None, "Academic", "2015-06-01", "2016-01-01", *base),
            (4, "Closed", "Industry, x", "2015-12-31", "2016-01-01", *base[:1], "II", *base[2:]),
            (5, "Closed", "Industry", "2016-01-01", "2016-01-01", *base),
            (6, "Closed", "Industry", None, "2016-01-01", *base),
            (7, "Closed", "industry", "2015-02-01", "2014-01-01", *base),
        ],
        "trial_id int, trial_status string, sponsor_type string, start_date string, "
        "last_modified_date string, therapeutic_area string, trial_phase string, "
        "trial_title string, trial_region string, nct_id string",
    )


def picked(df):
    return sorted(r.trial_id for r in df.collect())


def test_filter_presets(trials):
    window = (2015, 1), (2016, 1)
    fixed = trial_filters.apply_filters(trials, FilterSpec.fixed(*window))
    assert picked(fixed) == [4], "strictly later update, industry prefix, half-open window"
    assert fixed.first().healthy_tag == "No" and fixed.first().start_month == 12
    free = trial_filters.apply_filters(trials, FilterSpec(*window))
    assert picked(free) == [1, 3, 4]
    assert {r.healthy_tag for r in free.collect()} == {"Yes"}
    assert picked(trial_filters.apply_filters(trials, FilterSpec())) == [], "equal ends are empty"


def test_filter_request(trials):
    request = {
        "start_date_until_year": 2017,
        "selected_phases": "II",
        "selected_trial_statuses": ("Closed",),
        "selected_sponsors": [" any "],
        "selected_lead_sponsor_types": ["Industry"],
        "region_enabled": "yes",
        "region": " global",
    }
    spec = FilterSpec.from_request(request)
    assert (spec.start, spec.end, spec.phases) == ((2015, 1), (2017, 1), ["II"])
    assert picked(trial_filters.apply_filters(trials, spec)) == [4], "absent columns do not filter"
    for region, want in (("NA only", [4]), ("na", [4]), ("eu", [])):
        spec = FilterSpec.from_request({**request, "region": region})
        assert picked(trial_filters.apply_filters(trials, spec)) == want


def test_selection_rules(trials):
    assert not filters.selects(None) and not filters.selects([]) and not filters.selects("All")
    assert filters.selects(["All sponsors"]) and not filters.selects(["x", " all sponsors included"])
    assert filters.selects("All Sponsors included", filters.TYPE_ALL_TOKENS)
    assert filters.multi_select(trials, "absent", ["x"]) is trials


def test_filters_with_columns_missing(trials):
    bare = trials.select("trial_id")
    spec = FilterSpec((2000, 1), (2030, 1))
    out = trial_filters.apply_filters(bare, spec)
    assert out.count() == 0 and "start_year" in out.columns
    tagged = trial_filters.add_tags(bare).first()
    assert (tagged.area_tag, tagged.phase_tag, tagged.region_tag, tagged.covid_tag) == (
        "Multiple", "Recommend Exclude", "Other", "")
    assert tagged.healthy_tag == "No"
    odd = trials.select(F.lit("x").alias("id"), col("nct_id").alias(DISPLAY.registry_id))
    assert DISPLAY.healthy_tag in tagging.add_healthy_tag(odd, DISPLAY).columns
