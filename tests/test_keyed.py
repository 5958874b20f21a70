"""Tables laid out by key, the cached pair, and counts that come with the writes."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks.fixtures import fixture
from checks.queries import REQUEST, SHEET_AS_IS, WINDOW
from conftest import SF, plan_of
from registryloom.functions.ids import NO_CODE
from registryloom.names import Names
from registryloom.operators import joins
from registryloom.plans import keyed, pipeline
from registryloom.plans.branches import Refinement
from registryloom.plans.cached import CachedPair, save_requests
from registryloom.plans.cleaning import clean_public, clean_sheet
from registryloom.plans.keyed import Layout, hot_keys, split_keyed
from registryloom.plans.pipeline import PipelineConfig, run_pipeline, stage_summary
from registryloom.plans.trial_filters import FilterSpec, apply_filters

N = Names()


@pytest.fixture(scope="module")
def sheet(spark):
    return clean_sheet(fixture(spark, SF, "tt_raw"))


@pytest.fixture(scope="module")
def public(spark):
    return clean_public(fixture(spark, SF, "ct_raw"))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def bag(df):
    return Counter(map(tuple, df.collect()))


def rows(spark, side, keys):
    return spark.createDataFrame([(k, f"{side}{i}") for i, k in enumerate(keys)], f"k string, {side} string")


LEFT = ["a", "b", "b", None, NO_CODE, NO_CODE, "c", "hot", "hot", "hot", ""]
RIGHT = ["b", "b", "d", None, None, "hot", "hot", "", NO_CODE]


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("right", [RIGHT, ["b", "x"], [None], []])
def test_keyed_parts_equal_the_lazy_ones(spark, tmp_path, monkeypatch, right, small):
    if not small:
        monkeypatch.setattr(keyed, "BROADCAST_BYTES", -1)
    layout, hot = Layout(spark, str(tmp_path), 3), ("hot", NO_CODE)
    a, b = rows(spark, "l", LEFT), rows(spark, "r", right)
    left, other = layout.keyed(a, "a", "k", hot, firsts=F.count_if(F.col("l") == "l0")), layout.keyed(b, "b", "k", hot)
    assert (left.rows, left.apart_rows, left.metrics) == (11, 6, {"firsts": 1})
    assert bag(left.frame) == bag(a)
    want = joins.split_join(a, b, "k", right_columns=["r"], hot_keys=hot)
    got = split_keyed(left, other, right_columns=["r"])
    for part in ("both", "left_only", "right_only"):
        assert getattr(got, part).columns == getattr(want, part).columns
        assert bag(getattr(got, part)) == bag(getattr(want, part)), part
    layout.remove()
    assert not tmp_path.exists() and not [t for t in spark.catalog.listTables() if t.name in layout._tables]


def test_tables_laid_out_differently_are_refused(spark, tmp_path):
    layout = Layout(spark, str(tmp_path), 2)
    a = layout.keyed(rows(spark, "l", LEFT), "a", "k", ("hot",))
    b = layout.keyed(rows(spark, "r", RIGHT), "b", "k", ())
    with pytest.raises(ValueError):
        split_keyed(a, b)
    layout.remove()


def test_no_exchange_above_the_scans(spark, sheet, public, tmp_path, no_broadcast):
    layout = Layout(spark, str(tmp_path))
    left, right = pipeline.staged_pair(layout, sheet, public)
    assert left.apart_rows and not right.apart_rows
    for part in split_keyed(left, right, right_columns=N.right_columns):
        part.collect()
        plan = plan_of(part)
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
    files = [p for p in (tmp_path / "sheet" / "regular").iterdir() if p.suffix == ".parquet"]
    assert len(files) <= layout.buckets, "rows move by key once, so a bucket is one file"
    layout.remove()


def test_hot_keys_are_found_and_lie_apart(spark, tmp_path):
    ids = spark.range(6000)
    a = ids.select(F.when(F.col("id") % 3 == 0, "unforeseen").otherwise(F.col("id").cast("string")).alias("k"), "id")
    b = ids.select(F.when(F.col("id") % 100 == 0, "unforeseen").otherwise((F.col("id") * 2).cast("string")).alias("k"))
    assert hot_keys([a, b], "k", 16) == ("unforeseen",)
    assert hot_keys([b.filter("k <> 'unforeseen'")], "k", 16) == ()
    assert joins.frequent_keys(a, "k", 0.3) == ["unforeseen"] and joins.frequent_keys(a, "k", 0.4) == []
    layout = Layout(spark, str(tmp_path), 16)
    left = layout.keyed(a, "a", "k", ("unforeseen",))
    right = layout.keyed(b.withColumn("r", F.lit(1)), "b", "k", ("unforeseen",))
    sizes = [r["count"] for r in left.regular.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2] and sum(sizes) == 4000
    both = split_keyed(left, right, right_columns=["r"]).both
    assert both.filter("k = 'unforeseen'").count() == 2000 * 60
    layout.remove()


def test_hot_keys_of_null_and_empty_frames(spark):
    empty = spark.createDataFrame([], "k string")
    assert hot_keys([empty, spark.createDataFrame([(None,)] * 9, "k string")], "k", 4) == ()
    assert joins.frequent_keys(empty, "k", 0.1) == []


def test_pair_is_cleaned_once_and_released(spark, sheet, public, tmp_path):
    lookups = [fixture(spark, SF, n) for n in ("map_sponsor", "seg_us", "seg_ww")]
    spec = FilterSpec.fixed(*WINDOW)
    with CachedPair(sheet, public) as pair:
        counts = pair.fill()
        assert counts == {"sheet": sheet.count(), "public": public.count()}
        stages = pair.stages(*lookups, Refinement(industry=True))
        frames = {"batch": stages["segments"], "fixed": pair.filtered(spec), "form": pair.filtered(REQUEST)}
        for name, df in frames.items():
            plan = plan_of(df)
            assert "InMemoryTableScan" in plan, name
            cleaned_here = [line for line in plan.split("InMemoryRelation")[0].splitlines() if "FileScan" in line]
            assert not cleaned_here, "no file is read above the stored frames"
        saved = save_requests(frames, str(tmp_path))
        assert spark.sparkContext._jsc.getPersistentRDDs().size() >= 2
    want = {"fixed": apply_filters(sheet, spec), "form": apply_filters(sheet, FilterSpec.from_request(REQUEST))}
    for name, df in want.items():
        held = spark.read.parquet(str(tmp_path / name))
        assert saved[name] == df.count() and bag(held) == bag(df)
    assert not sheet.storageLevel.useMemory and not public.storageLevel.useMemory
    for use in (lambda: pair.sheet, lambda: pair.filtered(spec), lambda: pair.branches()):
        with pytest.raises(RuntimeError, match="released"):
            use()
    pair.release()


def test_pair_of_files(spark, tmp_path):
    paths = {}
    for key, name in zip(pipeline._PATHS, ("tt_raw", "ct_raw", "map_sponsor", "seg_us", "seg_ww")):
        paths[key] = str(tmp_path / name)
        fixture(spark, SF, name).write.parquet(paths[key])
    cfg = PipelineConfig(**paths, sheet=SHEET_AS_IS)
    with CachedPair.load(spark, cfg) as pair, run_pipeline(spark, cfg) as stages:
        assert bag(pair.branches().both) == bag(stages["both"])
        assert pair.sheet.count() == stages.count("sheet")


def staged(spark, sheet=None, **options):
    names = ("tt_raw", "ct_raw", "map_sponsor", "seg_us", "seg_ww")
    raw, *others = [fixture(spark, SF, n) for n in names]
    return pipeline.staged_stages(spark, raw if sheet is None else sheet, *others, **options)


def test_counts_come_with_the_writes(spark):
    with staged(spark) as stages:
        assert set(stages.counts) == set(pipeline.STAGES) - {"segments"}
        summary = stage_summary(stages)
        assert "FileScan" not in plan_of(summary)
        held = {r.stage: (r.n_rows, r.n_cols) for r in summary.collect()}
        assert held == {n: (df.count(), len(df.columns)) for n, df in stages.items()}


def test_outputs_are_counted_as_they_are_written(spark, tmp_path):
    paths = {}
    for key, name in zip(pipeline._PATHS, ("tt_raw", "ct_raw", "map_sponsor", "seg_us", "seg_ww")):
        paths[key] = str(tmp_path / name)
        fixture(spark, SF, name).write.parquet(paths[key])
    out = {"segments": str(tmp_path / "out.parquet"), "left": str(tmp_path / "left.csv")}
    with run_pipeline(spark, PipelineConfig(**paths, sheet=SHEET_AS_IS, outputs=out)) as stages:
        assert stages.counts["segments"] == spark.read.parquet(out["segments"]).count()
        tables = stages.layout._tables[:]
        assert tables
    assert not Path(stages.root).exists()
    assert not {t.name for t in spark.catalog.listTables()} & set(tables)


def test_all_null_columns_go_without_a_job_of_their_own(spark):
    raw = fixture(spark, SF, "tt_raw").withColumn("last_modified_date", F.lit("junk"))
    kept = clean_sheet(raw, drop_null_columns=True).columns
    public = clean_public(fixture(spark, SF, "ct_raw"), drop_null_columns=True).columns
    with staged(spark, raw, drop_null_columns=True) as stages:
        assert stages["sheet"].columns == kept and "last_modified_date" not in kept
        assert stages["public"].columns == public
    with staged(spark, raw) as stages:
        assert "last_modified_date" in stages["sheet"].columns


def test_empty_files(spark):
    empty = [fixture(spark, SF, n).limit(0) for n in ("tt_raw", "ct_raw", "map_sponsor", "seg_us", "seg_ww")]
    with pipeline.staged_stages(spark, *empty) as stages:
        assert {r.n_rows for r in stage_summary(stages).collect()} == {0}
        assert stages["segments"].count() == 0
