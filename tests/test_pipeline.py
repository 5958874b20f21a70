import csv
import json
from collections import Counter
from pathlib import Path

import pytest

from conftest import SF, plan_of
from checks.fixtures import fixture
from checks.queries import SHEET_AS_IS
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from registryloom import __main__ as command
from registryloom.names import DISPLAY
from registryloom.operators.clean import sanitize_cells
from registryloom.plans import pipeline
from registryloom.plans.branches import Refinement
from registryloom.plans.pipeline import STAGES, PipelineConfig, run_pipeline, stage_summary
from registryloom.sources import tables
from registryloom.sources.headers import (
    DISPLAY_SHEET,
    SHEET_COLUMNS,
    SHEET_NOT_CLEANED,
    SHEET_RENAMES,
    SNAKE_SHEET,
)

SHEET = [
    # id, protocol text, phase, status, sponsor, sponsor type, design, plan, age group, start
    ["1", "eu; nct00000001", "ii", "Open", "acme, inc\nbeta", "Industry", "x", "y", "Adults",
     "2015-02-01"],
    ["2.0", "none", "I/II", "Open", '"quoted" & co', "Industry\nAcademic", "Randomized", "",
     "Children", "n/a"],
    ["x", "NCT99", "III", "NA", "gamma llc", "Academic", "observation", "placebo", "", "2015-03"],
    ["4", "eudract", "IV", "Closed", "", "", "cohort", "dose", "Older\tAdults", "03/05/2015"],
    ["5", "NCT00000005", "I", "Closed", "acme", "", "", "", "", "2016"],
]
SHEET_HEADERS = [
    "Trial ID", "Protocol/Trial ID", "Trial Phase", "Trial Status", "Sponsor/Collaborator",
    "Sponsor/Collaborator Type", "Study Design", "Treatment Plan", "Patient Age Group",
    "Start Date", "Not Wanted", "Treatment Duration (Mos.)",
]
PUBLIC_HEADERS = [
    "NCT id", "study title", "study status", "interventions", "condition", "sex", "start_date",
]
PUBLIC = [
    [" nct00000001 ", "A (b)", "done", "Drug: A|Device: B", "c1", "All", "2014-01-01"],
    ["NCT00000001", "second", "done", "biological", "c2", "Female", ""],
    ["NCT00000005", "third", "done", "Device: C", "c3", "All", ""],
    ["NCT00000077", "fourth", "done", "drugs", "c4", "", ""],
]


def write_csv(path, headers, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([headers, *rows])
    return str(path)


@pytest.fixture
def files(tmp_path):
    return {
        "sheet_path": write_csv(
            tmp_path / "sheet.csv", SHEET_HEADERS, [[*r, "drop me", "1.5"] for r in SHEET]
        ),
        "public_path": write_csv(tmp_path / "public.csv", PUBLIC_HEADERS, PUBLIC),
        "sponsor_map_path": write_csv(
            tmp_path / "map.csv", ["Lead Sponsor", "EP Standard Name"], [["ACME", "acme group"]]
        ),
        "us_path": write_csv(
            tmp_path / "us.csv",
            ["EP Standard Name", "US company segmentation"],
            [["Acme Group", "global pharma"]],
        ),
        "ww_path": write_csv(
            tmp_path / "ww.csv", ["EP Standard Name", "WW company segmentation"], [["z", "SMID"]]
        ),
    }


def test_batch_over_files_with_their_own_headers(spark, files, tmp_path):
    out = {s: str(tmp_path / "out" / f"{s}.parquet") for s in STAGES}
    out["union"] = str(tmp_path / "out" / "union.xlsx")
    cfg = PipelineConfig(**files, outputs=out, sheet=DISPLAY_SHEET)
    stages = run_pipeline(spark, cfg)
    assert list(stages) == list(STAGES)

    sheet = {r["Trial ID"]: r for r in stages["sheet"].collect()}
    assert set(sheet) == {0, 1, 2, 4, 5}, "junk ids become missing and are filled"
    assert sheet[2]["NCT ID"] == "NO NCT CODE" and sheet[1]["NCT ID"] == "NCT00000001"
    assert sheet[4]["older_adults"] and sheet[4]["adult"] and not sheet[4]["child"]
    assert str(sheet[4]["Start Date"])[:10] == "2015-03-05" and sheet[2]["Start Date"] is None
    assert sheet[0]["TT_Trial Status"] is None, "NA marks a missing value"
    assert sheet[0]["Protocol_Trial_ID"] == "Nct99" and sheet[1]["Treatment Duration (Mos.)"] == 1.5
    assert "Not Wanted" not in stages["sheet"].columns

    public = {r["NCT ID"] for r in stages["public"].collect()}
    assert public == {"NCT00000001", "NCT00000077"}, "devices drop out"
    assert {r["Patient Gender"] for r in stages["public"].collect()} == {"BOTH", "FEMALE", ""}

    left = {r["Trial ID"]: r for r in stages["left"].collect()}
    assert set(left) == {0, 2}, "no interventional word in trial 4"
    assert left[2][DISPLAY.sponsor_tag] == "Industry" and left[0][DISPLAY.sponsor_tag] == "Academic"
    both = stages["both"].collect()
    assert Counter(r["Trial ID"] for r in both) == {1: 2}
    assert {r["study title_CT"] for r in both} == {"A B", "SECOND"}

    segments = {(r["Trial ID"], r["Lead Sponsor"]): r for r in stages["segments"].collect()}
    assert set(segments) == {(1, "Acme"), (2, '"Quoted" & Co'), (0, "Gamma Llc")}
    assert segments[1, "Acme"]["US company segmentation"] == "Global Pharma"
    assert segments[1, "Acme"]["WW company segmentation"] == "Others"
    assert segments[0, "Gamma Llc"]["EP Standard Name"] is None

    counts = {r.stage: r.n_rows for r in stage_summary(stages).collect()}
    assert counts == {"sheet": 5, "public": 3, "left": 2, "both": 2, "union": 4, "lead": 4,
                      "segments": 4}
    assert Path(out["union"]).with_suffix(".csv").is_dir(), "no workbook writer: CSV instead"
    written = spark.read.parquet(out["segments"])
    assert written.columns == stages["segments"].columns and written.count() == 4
    same = spark.read.parquet(out["left"])
    assert {r["TT_Trial Status"] for r in same.collect()} == {"Open", None}, "as the stage is"
    stages.remove()
    assert not Path(stages.root).exists()


def test_cells_are_cut_only_when_asked_for(spark, files, tmp_path):
    out = {"left": str(tmp_path / "left.parquet")}
    cfg = PipelineConfig(**files, outputs=out, sheet=DISPLAY_SHEET, max_cell_chars=4)
    with run_pipeline(spark, cfg) as stages:
        whole = {r["TT_Study Design"] for r in stages["left"].collect()}
    assert whole == {"Randomized", "observation"}
    cut = spark.read.parquet(out["left"]).collect()
    assert {r["TT_Trial Status"] for r in cut} == {"Open", ""}
    assert max(len(r["TT_Study Design"]) for r in cut) == 4


def test_the_raw_sheet_is_read_once_and_cleaned_apart_from_its_scan(spark, files):
    with run_pipeline(spark, PipelineConfig(**files, sheet=DISPLAY_SHEET)) as stages:
        plan = plan_of(stages["segments"])
        assert "sheet.csv" not in plan and "public.csv" not in plan
        raw = spark.read.parquet(f"{stages.root}/sheet_path")
        assert raw.columns == SHEET_HEADERS and raw.count() == len(SHEET), "as it was read"


def test_marker_in_the_public_file_still_matches(spark, files, tmp_path):
    rows = [*PUBLIC, ["no nct code", "odd", "x", "drug", "c", "", ""]]
    files["public_path"] = write_csv(tmp_path / "odd.csv", PUBLIC_HEADERS, rows)
    cfg = PipelineConfig(**files, sheet=DISPLAY_SHEET, stage_dir=str(tmp_path / "stage"))
    stages = run_pipeline(spark, cfg)
    assert stages["left"].count() == 0
    assert Counter(r["Trial ID"] for r in stages["both"].collect()) == {1: 2, 0: 1, 2: 1, 4: 1}


def test_staged_run_equals_the_lazy_plan(spark, tmp_path):
    paths = {}
    for key, name in zip(
        ("sheet_path", "public_path", "sponsor_map_path", "us_path", "ww_path"),
        ("tt_raw", "ct_raw", "map_sponsor", "seg_us", "seg_ww"),
    ):
        paths[key] = str(tmp_path / f"{name}.parquet")
        fixture(spark, SF, name).write.parquet(paths[key])
    keep_all = SNAKE_SHEET.__class__(
        names=SNAKE_SHEET.names,
        keep=spark.read.parquet(paths["sheet_path"]).columns,
        dates=["start_date", "last_modified_date"],
        cleaned=SNAKE_SHEET.cleaned,
    )
    flags = Refinement(interventional=True, industry=True, others=True)
    staged = run_pipeline(spark, PipelineConfig(**paths, sheet=keep_all, refinement=flags))
    lazy = pipeline.trial_stages(
        *[spark.read.parquet(p) for p in paths.values()], refinement=flags
    )
    for stage in ("left", "both", "segments"):
        a, b = staged[stage], lazy[stage]
        assert a.columns == b.columns
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_command_reads_its_settings(files, tmp_path):
    path = tmp_path / "batch.json"
    path.write_text(json.dumps({**files, "headers": "display", "refinement": {"industry": True}}))
    cfg = command.config(json.loads(path.read_text()))
    assert cfg.sheet is DISPLAY_SHEET and cfg.refinement.industry
    with pytest.raises(ValueError):
        PipelineConfig(**files, outputs={"other": "x.csv"})


def test_header_lists_agree():
    assert len(SHEET_COLUMNS) == 60 and len(SHEET_RENAMES) == 13
    assert len(DISPLAY_SHEET.cleaned) == 46 and set(SHEET_NOT_CLEANED) < set(SHEET_COLUMNS)
    assert set(SHEET_RENAMES) < set(SHEET_COLUMNS)
    assert len(set(SNAKE_SHEET.renames.values())) == 60
    assert SNAKE_SHEET.renames["Sponsor/Collaborator"] == "sponsor"
    assert SNAKE_SHEET.renames["Trial Region"] == "trial_region"


def test_csv_keeps_cells_whole(spark, tmp_path):
    cells = ["a\r\nb", "c\rd", 'q"uo"te', " pad ", "", None, "x,y", "back\\slash", "tab\t"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    path = str(tmp_path / "cells.csv")
    tables.save_table(df, path)
    back = {int(r.i): r.c for r in tables.load_table(spark, path, null_markers=()).collect()}
    want = dict(enumerate(cells)) | {4: None}
    assert back == want, "a delimited file does not tell '' from a missing value"


def test_formats_and_fallback(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"])], "i int, list array<string>")
    with pytest.raises(ValueError):
        tables.save_table(df, str(tmp_path / "x.txt"))
    with pytest.raises(ValueError):
        tables.load_table(spark, "x.xlsx")
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        tables.load_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(AnalysisException):
        tables.save_or_csv(df, str(tmp_path / "lists.csv"))
    broken = df.select(F.raise_error(F.lit("boom")).cast("string").alias("x"))
    with pytest.raises(Exception, match="boom"):
        tables.save_or_csv(broken, str(tmp_path / "broken.parquet"))
    path, fmt = tables.save_or_csv(df.select("i"), str(tmp_path / "x.xls"))
    assert fmt == "csv" and path.endswith("x.csv")
    assert tables.load_table(spark, path).first().i == "1"


def test_spread_only_where_a_scan_has_too_few_parts(spark, tmp_path):
    df = spark.range(100)
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    few = tables.spread(spark.read.parquet(str(tmp_path / "one")))
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert few.count() == 100
    many = df.repartition(16)
    assert tables.spread(many) is many


def test_paths_keep_scheme_and_host():
    assert tables.csv_path("s3a://bucket/out.xlsx") == "s3a://bucket/out.csv"
    assert tables.csv_path("hdfs://nn/out/u.xlsx") == "hdfs://nn/out/u.csv"
    assert tables.csv_path("hdfs://nn.host/out/u/") == "hdfs://nn.host/out/u.csv"
    assert tables.format_of("s3a://b.c/x.CSV/") == "csv"
    assert tables.format_of("hdfs://nn.host/dir/table") == "parquet"
    assert tables.format_of("/data/table.v2", "csv") == "csv"


def test_batch_over_plain_folders(spark, tmp_path):
    paths = {}
    for key, name in zip(pipeline._PATHS, ("tt_raw", "ct_raw", "map_sponsor", "seg_us", "seg_ww")):
        paths[key] = str(tmp_path / "v1.0" / name)
        fmt = "csv" if name.startswith("seg") else "parquet"
        tables.save_table(fixture(spark, SF, name), paths[key], fmt)
    cfg = PipelineConfig(**paths, sheet=SHEET_AS_IS, formats={"us_path": "csv", "ww_path": "csv"})
    with run_pipeline(spark, cfg) as stages:
        assert stages["segments"].count() > 0
        assert stages["segments"].filter("us_segment <> 'Others'").count() > 0
    with pytest.raises(ValueError, match="formats"):
        PipelineConfig(**paths, formats={"other": "csv"})


def test_files_with_other_headers_are_an_error(spark, tmp_path):
    folder = tmp_path / "two.csv"
    folder.mkdir()
    write_csv(folder / "a.csv", ["a", "b"], [["1", "x"]])
    write_csv(folder / "b.csv", ["b", "a"], [["y", "2"]])
    with pytest.raises(Exception, match="(?i)header"):
        tables.load_table(spark, str(folder)).collect()


def test_types_by_name(spark, tmp_path):
    path = write_csv(tmp_path / "t.csv", ["n", "d", "x"], [["-0.75", "2020-01-02", "7"], ["z", "", "NA"]])
    rows = tables.load_table(spark, path, schema="x int, n double, absent int").collect()
    assert [tuple(r) for r in rows] == [(-0.75, "2020-01-02", 7), (None, None, None)]


def test_shared_folders_are_released(spark):
    paths = [tables.shared_dir(spark) for _ in range(2)]
    for path in paths:
        spark.range(3).write.parquet(path)
    tables.release_shared(spark)
    assert not any(Path(p).exists() for p in paths) and not tables._named


def test_sanitised_union_has_no_nulls_in_text(spark):
    df = spark.createDataFrame([(None, 1)], "t string, n int")
    assert [tuple(r) for r in sanitize_cells(df).collect()] == [("", 1)]
