import pytest

from conftest import SF, plan_of
from checks.fixtures import fixture
from checks.queries import QUERIES
from pyspark.sql import functions as F

from registryloom.functions.ids import NO_CODE
from registryloom.operators import filters, refine
from registryloom.plans import branches
from registryloom.plans.cleaning import clean_sheet
from registryloom.plans.trial_filters import FilterSpec, apply_filters
from registryloom.streaming.incremental import process_new_files

ONE_SIDED = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInPandas", "CartesianProduct",
             "BroadcastNestedLoopJoin")


def formatted(df) -> str:
    utils = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils
    return utils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", ["batch_full", "union_by_name", "join_right_only"])
def test_no_python_and_no_cross_join_in_plans(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert not [word for word in ONE_SIDED if word in plan]


def test_lookups_broadcast_and_trials_do_not_shuffle_for_them(spark):
    plan = plan_of(QUERIES["lookup_chain"](spark, SF))
    top = plan.split("Scan parquet")[0]
    assert plan.count("BroadcastHashJoin") >= 3 and "SortMergeJoin" not in top


def test_filters_on_typed_columns_reach_the_reader(spark, tmp_path):
    path = str(tmp_path / "trials")
    sheet = clean_sheet(fixture(spark, SF, "tt_raw"))
    sheet.write.parquet(path)
    trials = spark.read.parquet(path)
    spec = FilterSpec((1994, 1), (1995, 1), statuses=["Open"], sponsor_prefix="Industry")
    pushed = formatted(apply_filters(trials, spec).select("trial_id"))
    for part in ("GreaterThanOrEqual(start_date", "LessThan(start_date", "In(trial_status",
                 "StringStartsWith(sponsor_type,Industry)"):
        assert part in pushed or part.replace("In(", "EqualTo(") in pushed, part
    schema = pushed[pushed.index("ReadSchema") :].split("\n")[0]
    assert "trial_title" not in schema, "columns nobody asks for are not read"
    assert f"EqualTo(nct_id,{NO_CODE})" in formatted(branches.no_code_rows(trials, trials))


def test_pushed_tag_filter_mentions_its_input_once_per_rule(spark):
    sheet = clean_sheet(fixture(spark, SF, "tt_raw"))
    tagged = QUERIES["tag_phase"](spark, SF).filter(F.col("phase_tag") == "II")
    assert plan_of(tagged).split("Filter")[1].split("\n")[0].count("initcap") <= 1
    assert plan_of(filters.add_start_parts(sheet)).count("PythonUDF") == 0


def test_new_files_go_through_the_same_flow_once(spark, tmp_path):
    raw = fixture(spark, SF, "tt_raw")
    source, sink, memory = (str(tmp_path / n) for n in ("in", "out", "seen"))
    raw.filter("trial_id % 2 = 0").coalesce(1).write.parquet(source)

    def flow(df):
        return apply_filters(refine.add_lead_sponsor(clean_sheet(df)), FilterSpec((1994, 1), (1996, 1)))

    def run():
        process_new_files(spark, source, raw.schema, flow, sink, memory).awaitTermination(120)
        return spark.read.parquet(sink)

    first = run().count()
    assert run().count() == first, "files seen before are not taken again"
    raw.filter("trial_id % 2 = 1").coalesce(1).write.mode("append").parquet(source)
    out, want = run(), flow(raw)
    assert out.columns == want.columns
    assert out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty()
