"""Files split by byte range, tables by start month, and lookups prepared for arriving rows."""

import csv
import io
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks import queries
from checks.fixtures import fixture
from conftest import SF, plan_of
from registryloom.operators import filters, lookups, refine
from registryloom.operators.joins import stack
from registryloom.plans.cleaning import clean_sheet
from registryloom.plans.trial_filters import FilterSpec, apply_filters
from registryloom.sources import quoted
from registryloom.sources import tables as files
from registryloom.sources.months import load_by_month, save_by_month
from registryloom.sources.tables import load_table
from registryloom.streaming.incremental import process_new_files


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", 61)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def bag(df):
    return Counter(map(tuple, df.collect()))


def table(rng, n, breaks=("\n", "\r\n", "\r", '"', ",", "a", "é", " ", "")):
    def cell():
        return "".join(rng.choices([*breaks, "x", "yz"], k=rng.choice([0, 1, 3, 9, 80])))

    return [[str(i), cell(), cell(), f"end{i}"] for i in range(n)]


def write(path, rows, header, end="\n", mark=""):
    text = io.StringIO()
    csv.writer(text, lineterminator=end).writerows([header, *rows])
    path.write_bytes((mark + text.getvalue()).encode())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_split_read_equals_the_read_of_one_task(spark, small_ranges, tmp_path, end):
    rng = random.Random(5)
    folder = tmp_path / "t.csv"
    folder.mkdir()
    header = ["id", 'odd "name"\nwith a break' if end == "\n" else "b", "c", "last"]
    rows = [table(rng, n) for n in (0, 1, 40, 90)]
    for i, own in enumerate(rows):
        write(folder / f"{i}.csv", own, header, end)
    cut = load_table(spark, str(folder), null_markers=(), split=True)
    assert cut.columns == header
    assert bag(cut) == Counter(tuple(c or None for c in r) for own in rows for r in own)
    if end == "\r\n":
        return
    assert bag(cut) == bag(load_table(spark, str(folder), null_markers=()))
    lines = quoted._lines(spark, str(folder))
    assert lines.select("file", "start").distinct().count() > 100, "many ranges, most inside rows"
    markers = load_table(spark, str(folder), split=True)
    assert bag(markers) == bag(load_table(spark, str(folder)))


def test_ranges_beyond_the_broadcast(spark, small_ranges, tmp_path, monkeypatch):
    monkeypatch.setattr(quoted, "MAX_BROADCAST_RANGES", 0)
    path = tmp_path / "t.csv"
    write(path, table(random.Random(6), 60), ["id", "b", "c", "last"])
    assert bag(load_table(spark, str(path), null_markers=(), split=True)) == bag(load_table(spark, str(path), null_markers=()))


def test_a_cell_longer_than_many_ranges(spark, small_ranges, tmp_path):
    path = tmp_path / "t.csv"
    rows = [["1", "line\n" * 400, "", "z"], ["2", "a", "b\n\nc", "z"], ["3", "\n" * 300, '""', "z"]]
    write(path, rows, ["id", "b", "c", "last"], mark="\ufeff")
    got = {r["id"]: r for r in quoted.read_quoted(spark, str(path), ["id", "b", "c", "last"]).collect()}
    assert [list(map(lambda v: v or "", got[r[0]])) for r in rows] == rows


def test_other_headers_are_an_error(spark, tmp_path):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    write(folder / "a.csv", [["1", "x"]], ["id", "b"])
    write(folder / "b.csv", [["x", "1"]], ["b", "id"])
    with pytest.raises(Exception, match="header"):
        load_table(spark, str(folder), split=True).collect()


def test_windows_skip_the_files_of_other_months(spark, tmp_path):
    sheet = clean_sheet(fixture(spark, SF, "tt_raw"))
    path = save_by_month(sheet, str(tmp_path / "months"))
    held = load_by_month(spark, path)
    assert bag(held.drop(filters.MONTH).select(sheet.columns)) == bag(sheet)
    window = (1994, 3), (1994, 6)
    cut = filters.month_window(held, *window)
    assert filters.MONTH not in cut.columns
    plan = plan_of(cut)
    part = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "199403" in part and "199406" in part
    months = {f.split(f"{filters.MONTH}=")[1][:6] for f in cut.inputFiles()} if len(cut.inputFiles()) < len(held.inputFiles()) else None
    assert months is None or months <= {"199403", "199404", "199405", "199406"}
    assert bag(cut.select(sheet.columns)) == bag(filters.month_window(sheet, *window))
    spec = FilterSpec((1994, 3), (1997, 1), statuses=["Open", "Closed"])
    a, b = apply_filters(held, spec), apply_filters(sheet, spec)
    assert sorted(a.columns) == sorted(b.columns) and bag(a.select(b.columns)) == bag(b) and a.count()


MAP = [("Acme", "A"), ("acme", "A2"), ("Nul", None), (None, "N"), ("Gap", "Gone")]
US = [("A", "us a"), (None, "us none"), ("N", ""), (None, "us none 2")]
WW = [("a", "ww a"), ("N", "ww n")]


@pytest.fixture(scope="module")
def tables(spark):
    rows = ((MAP, "standard_name", "lead_sponsor"), (US, "us_segment", "standard_name"), (WW, "ww_segment", "standard_name"))
    return [spark.createDataFrame(r, f"{key} string, {value} string") for r, value, key in rows]


def chained(leads, map_rows, us, ww):
    def key(v):
        return None if v is None else v.lower()

    out = Counter()
    for lead in leads:
        for name in [s for k, s in map_rows if key(k) == key(lead)] or [None]:
            for u in [v for k, v in us if key(k) == key(name)] or [None]:
                for w in [v for k, v in ww if key(k) == key(name)] or [None]:
                    out[lead, name, u or "Others", w or "Others"] += 1
    return out


LEADS = ["Acme", "Nul", None, "Gap", "unknown", "ACME"]


@pytest.mark.parametrize("broadcast_bytes", [None, 1 << 20, 0])
def test_uncleaned_tables_meet_as_one(spark, tables, broadcast_bytes):
    trials = spark.createDataFrame([(x,) for x in LEADS], "lead_sponsor string").repartition(3)
    out = lookups.lookup_chain(trials, *tables, cleanse=False, broadcast_bytes=broadcast_bytes)
    assert out.columns == ["lead_sponsor", "standard_name", "us_segment", "ww_segment"]
    assert bag(out) == chained(LEADS, MAP, US, WW)


def test_trials_move_at_most_once_for_uncleaned_tables(spark, tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        trials = spark.range(100).select(F.concat(F.lit("Acme"), "id").alias("lead_sponsor"), "id")
        chain = lookups.prepare_chain(*tables, cleanse=False, broadcast_bytes=1 << 20)
        plan = plan_of(chain.append(trials))
        above = plan.split("Range (0, 100")[0].split("BroadcastExchange")[0]
        assert "Exchange" not in above.replace("BroadcastExchange", "")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_map_must_name_the_standard_name(tables):
    with pytest.raises(ValueError, match="standard_name"):
        lookups.prepare_chain(*tables, map_add=["other"])


@pytest.mark.parametrize("cleanse", [True, False])
def test_lookups_over_arriving_files(spark, tmp_path, cleanse):
    raw = fixture(spark, SF, "tt_raw").select("trial_id", "sponsor")
    small = [fixture(spark, SF, n) for n in ("map_sponsor", "seg_us", "seg_ww")]
    options = {"mode": "idempotent", "cleanse": cleanse, "broadcast_bytes": 1 << 24}
    chain = lookups.prepare_chain(*small, root=str(tmp_path / "lookups"), **options)
    source, sink, memory = (str(tmp_path / n) for n in ("in", "out", "seen"))
    raw.filter("trial_id % 3 = 0").coalesce(1).write.parquet(source)

    def flow(df):
        return chain.append(refine.add_lead_sponsor(df))

    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "plans alone")
    flow(spark.readStream.schema(raw.schema).parquet(source))
    flow(raw)
    assert not jobs.getJobIdsForGroup("building"), "no job while a plan is built"
    spark.sparkContext.setJobGroup("running", "")

    def run():
        process_new_files(spark, source, raw.schema, flow, sink, memory).awaitTermination(120)
        return spark.read.parquet(sink)

    first = run().count()
    assert first and run().count() == first
    raw.filter("trial_id % 3 <> 0").coalesce(1).write.mode("append").parquet(source)
    out = run()
    want = lookups.lookup_chain(refine.add_lead_sponsor(raw), *small, **options)
    assert out.columns == want.columns and bag(out) == bag(want)
    assert stack(out, want).count() == 2 * out.count()


def test_parts_grow_with_the_files_that_are_dealt_out(spark, tmp_path, monkeypatch):
    spark.range(20_000).coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert files.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(files, "PART_BYTES", 4_000)
    dealt = files.spread(df)
    assert dealt.rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    assert dealt.distinct().count() == 20_000


def test_rows_of_a_delimited_file_are_bounded(spark, tmp_path):
    path = f"{tmp_path}/t.csv"
    text = F.concat(F.lit("a\n"), F.col("id").cast("string"))
    files.save_table(spark.range(50).select("id", text.alias("t")).coalesce(1), path, rows_per_file=20)
    assert len(list(Path(path).glob("part-*"))) == 3
    back = files.load_table(spark, path)
    assert sorted(int(r.id) for r in back.collect()) == list(range(50))
    assert back.filter(~F.col("t").startswith("a\n")).count() == 0


def test_the_task_that_writes_one_file_makes_no_rows(spark, monkeypatch):
    saved = []
    monkeypatch.setattr(queries, "save_table", lambda df, path: saved.append(df) or files.save_table(df, path))
    assert queries.scan_csv_split(spark, SF).count() == fixture(spark, SF, "tt_raw").count()
    assert saved[0].rdd.getNumPartitions() == 1
    assert "Coalesce" not in plan_of(saved[0])
