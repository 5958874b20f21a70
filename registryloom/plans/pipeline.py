"""The whole batch: two registry files and three lookup tables to one tagged trial table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from registryloom.functions.ids import NO_CODE
from registryloom.names import Names, col
from registryloom.operators import joins, lookups, refine
from registryloom.operators.clean import null_columns, sanitize_cells
from registryloom.plans.branches import (
    Branches,
    Refinement,
    join_and_stack,
    no_code_rows,
    refine_branch,
)
from registryloom.plans.cleaning import (
    clean_public,
    clean_sheet,
    rename_public,
    select_sheet,
)
from registryloom.plans.keyed import KeyedTable, Layout, hot_keys, observed, side_by_side, split_keyed, written
from registryloom.sources.headers import SNAKE_SHEET, Sheet
from registryloom.sources.tables import (
    format_of,
    load_table,
    save_or_csv,
    save_table,
    shared_dir,
    spread,
)

STAGES = ("sheet", "public", "left", "both", "union", "lead", "segments")
# Outputs that can be made safe for cell-based tools.
_CELL_SAFE = ("left", "both", "union")
_PATHS = ("sheet_path", "public_path", "sponsor_map_path", "us_path", "ww_path")


class Stages(dict):
    """Frames by stage name, read from the stage folder of ``layout``.

    ``counts`` holds the rows of stages that were counted while they were written. As a context
    manager it removes the folder at the end; ``remove`` does so at once.
    """

    def __init__(self, frames: Mapping[str, DataFrame], layout: Layout, counts: Mapping[str, int]):
        super().__init__(frames)
        self.layout, self.counts = layout, dict(counts)

    @property
    def root(self) -> str:
        return self.layout.root

    def count(self, name: str) -> int:
        """Rows of a stage; one that was not written is counted once, over the columns it hangs on."""
        if name not in self.counts:
            self.counts[name] = self[name].count()
        return self.counts[name]

    def remove(self) -> None:
        self.layout.remove()

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *error: object) -> None:
        self.remove()


@dataclass(frozen=True)
class PipelineConfig:
    sheet_path: str
    public_path: str
    sponsor_map_path: str
    us_path: str
    ww_path: str
    outputs: Mapping[str, str] = field(default_factory=dict)
    sheet: Sheet = SNAKE_SHEET
    refinement: Refinement = Refinement()
    right_columns: list[str] | None = None
    suffix: str = "_CT"
    drop_null_columns: bool = False
    cleanse_lookups: bool = True
    title_case: bool = True
    punct: bool = True
    key_mode: str = "compat"
    # Formats by path field or output stage, for paths whose ending does not name theirs.
    formats: Mapping[str, str] = field(default_factory=dict)
    # Number columns of delimited files, which have text only.
    public_numbers: tuple[str, ...] = ()
    lookup_numbers: tuple[str, ...] = ()
    # Whether cells of delimited files may hold line breaks; files without any can be split.
    multi_line: bool = True
    # Split files with such breaks too; their quotes must be balanced.
    split_files: bool = False
    # Longest text cell of the left, both and union outputs, with NULL written as ''; for targets
    # that are opened with cell-based tools. By default outputs are written as they are.
    max_cell_chars: int | None = None
    # Parts that an unsplittable file is dealt out to; by default all cores at the start.
    parts: int | None = None
    # Shared folder for the cleaned files; by default one is taken under spark.checkpoint.dir.
    stage_dir: str | None = None
    # Buckets that the cleaned files lie in by registry id; by default as many as shuffles have parts.
    buckets: int | None = None

    def __post_init__(self):
        odd = set(self.formats) - {*_PATHS, *STAGES}
        if odd:
            raise ValueError(f"formats for unknown paths {sorted(odd)}")
        unknown = set(self.outputs) - set(STAGES)
        if unknown:
            raise ValueError(f"outputs for unknown stages {sorted(unknown)}; stages are {STAGES}")


def stage_summary(stages: Mapping[str, DataFrame]) -> DataFrame:
    """One row ``(stage, n_rows, n_cols)`` per frame.

    For ``Stages`` the counts are those taken while the stages were written, and the result is
    rows without a plan; other frames are counted where the summary runs.
    """
    if isinstance(stages, Stages):
        rows = [(name, stages.count(name), len(df.columns)) for name, df in stages.items()]
        schema = "stage string, n_rows bigint, n_cols bigint"
        return stages.layout.spark.createDataFrame(rows, schema).coalesce(1)
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("stage"),
            "n_rows",
            F.lit(len(df.columns)).cast("bigint").alias("n_cols"),
        )
        for name, df in stages.items()
    ]
    return reduce(DataFrame.unionAll, counts)


def add_segments(
    trials: DataFrame,
    sponsor_map: DataFrame,
    us_segments: DataFrame,
    ww_segments: DataFrame,
    **options: object,
) -> DataFrame:
    """``lookup_chain`` with the size of the lookup tables checked before they are broadcast."""
    options = {"broadcast_bytes": lookups.BROADCAST_BYTES, **options}
    return lookups.lookup_chain(trials, sponsor_map, us_segments, ww_segments, **options)


def trial_stages(
    sheet: DataFrame,
    public: DataFrame,
    sponsor_map: DataFrame,
    us_segments: DataFrame,
    ww_segments: DataFrame,
    refinement: Refinement = Refinement(),
    spec: Sheet = SNAKE_SHEET,
) -> dict[str, DataFrame]:
    """All stages as plans over raw frames; nothing is written."""
    names = spec.names
    clean_a, clean_b = clean_sheet(sheet, spec), clean_public(public, names)
    branches = join_and_stack(clean_a, clean_b, refinement, names)
    lead = refine.add_lead_sponsor(branches.union, names)
    segments = add_segments(lead, sponsor_map, us_segments, ww_segments, names=names)
    frames = (clean_a, clean_b, *branches, lead, segments)
    return dict(zip(STAGES, frames))


class Staged(NamedTuple):
    """The two cleaned files and the branches of them, written; ``counts`` by stage name."""

    sheet: KeyedTable
    public: KeyedTable
    branches: Branches
    counts: dict[str, int]


def staged_pair(
    layout: Layout,
    sheet: DataFrame,
    public: DataFrame,
    names: Names = SNAKE_SHEET.names,
    null_counts: Sequence[Observation] = (),
) -> tuple[KeyedTable, KeyedTable]:
    """Both cleaned files, written once by registry id.

    The ids that stand out in either file are found first, by one job over the id columns; it
    also fills the observations of ``null_counts``, whose columns without values then go.
    """
    key = names.registry_id
    found = hot_keys([sheet, public], key, layout.buckets)
    hot = tuple(dict.fromkeys([NO_CODE, *found]))
    if null_counts:
        gone = [null_columns(observed(o) or {}) for o in null_counts]
        sheet, public = (df.drop(*c) for df, c in zip((sheet, public), gone))
    laid_out = side_by_side(
        layout.spark,
        lambda: layout.keyed(sheet, "sheet", key, hot),
        lambda: layout.keyed(public, "public", key, hot),
    )
    return laid_out[0], laid_out[1]


def staged_branches(
    layout: Layout,
    sheet: DataFrame,
    public: DataFrame,
    names: Names = SNAKE_SHEET.names,
    refinement: Refinement = Refinement(),
    right_columns: list[str] | None = None,
    suffix: str = "_CT",
    null_counts: Sequence[Observation] = (),
) -> Staged:
    """Write the cleaned files and the two branches once, each built on what was written before.

    The files meet bucket by bucket; trials without an id lie apart, so the branch of those reads
    its own rows only. All later stages work row by row on the branches, so nothing is cleaned or
    joined twice, and every count comes from a write.
    """
    left_table, right_table = staged_pair(layout, sheet, public, names, null_counts)
    right = names.right_columns if right_columns is None else right_columns
    both = split_keyed(left_table, right_table, right_columns=right, suffix=suffix).both
    marked = left_table.apart.filter(col(names.registry_id) == NO_CODE)
    if right_table.apart_rows:
        marked = no_code_rows(marked, right_table.apart, names)
    left = refine_branch(marked, refinement, names)
    (both, b), (left, a) = side_by_side(
        layout.spark,
        lambda: layout.plain(both, "both", n=F.count(F.lit(1))),
        lambda: layout.plain(left, "left", n=F.count(F.lit(1))),
    )
    counts = {"sheet": left_table.rows, "public": right_table.rows, "left": a["n"], "both": b["n"]}
    counts["union"] = counts["lead"] = a["n"] + b["n"]
    return Staged(left_table, right_table, Branches(left, both, joins.stack(left, both)), counts)


def staged_stages(
    spark: SparkSession,
    sheet: DataFrame,
    public: DataFrame,
    sponsor_map: DataFrame,
    us_segments: DataFrame,
    ww_segments: DataFrame,
    refinement: Refinement = Refinement(),
    spec: Sheet = SNAKE_SHEET,
    *,
    root: str | None = None,
    buckets: int | None = None,
    drop_null_columns: bool = False,
    public_numbers: Sequence[str] = (),
    right_columns: list[str] | None = None,
    suffix: str = "_CT",
    **lookup_options: object,
) -> Stages:
    """All stages over raw frames, each raw file cleaned once into the stage folder."""
    layout, names = Layout(spark, root or shared_dir(spark), buckets), spec.names
    seen = (Observation(), Observation()) if drop_null_columns else (False, False)
    staged = staged_branches(
        layout,
        clean_sheet(sheet, spec, seen[0]),
        clean_public(public, names, drop_null_columns=seen[1], numbers=public_numbers),
        names,
        refinement,
        right_columns,
        suffix,
        seen if drop_null_columns else (),
    )
    lead = refine.add_lead_sponsor(staged.branches.union, names)
    tables = (sponsor_map, us_segments, ww_segments)
    segments = add_segments(lead, *tables, names=names, **lookup_options)
    frames = (staged.sheet.frame, staged.public.frame, *staged.branches, lead, segments)
    return Stages(dict(zip(STAGES, frames)), layout, staged.counts)


def _raw(spark: SparkSession, cfg: PipelineConfig, name: str, root: str) -> DataFrame:
    """A raw file; a delimited one is parsed once into the stage folder, where its columns lie apart.

    If it cannot be split it is dealt out on the way. Filters on dealt rows would move below the
    shuffle and into the few tasks that read the file, so the cleaning starts from what is written.
    """
    path, fmt = getattr(cfg, name), cfg.formats.get(name)
    df = load_table(spark, path, fmt, multi_line=cfg.multi_line, split=cfg.split_files)
    if format_of(path, fmt) != "csv":
        return df
    dealt = spread(df, cfg.parts)
    save_table(dealt, f"{root}/{name}", "parquet")
    return spark.read.schema(df.schema).parquet(f"{root}/{name}")


def run_pipeline(spark: SparkSession, cfg: PipelineConfig) -> Stages:
    """Run the batch, write the wanted outputs, and return all stages by name.

    Lost executors never send the job back to the source files: the costly stages are tables in
    the stage folder. The returned frames read that folder; close or ``remove`` the stages after
    their use.
    """
    root = cfg.stage_dir or shared_dir(spark)
    raw_sheet, raw_public = side_by_side(spark, *[partial(_raw, spark, cfg, n, root) for n in _PATHS[:2]])
    lookup_tables = [load_table(spark, getattr(cfg, n), cfg.formats.get(n)) for n in _PATHS[2:]]
    stages = staged_stages(
        spark,
        select_sheet(raw_sheet, cfg.sheet),
        rename_public(raw_public, cfg.sheet.names),
        *lookup_tables,
        cfg.refinement,
        cfg.sheet,
        root=root,
        buckets=cfg.buckets,
        drop_null_columns=cfg.drop_null_columns,
        public_numbers=cfg.public_numbers,
        right_columns=cfg.right_columns,
        suffix=cfg.suffix,
        cleanse=cfg.cleanse_lookups,
        title_case=cfg.title_case,
        punct=cfg.punct,
        numbers=cfg.lookup_numbers,
        mode=cfg.key_mode,
    )
    for stage, path in cfg.outputs.items():
        df = stages[stage]
        if cfg.max_cell_chars is not None and stage in _CELL_SAFE:
            df = sanitize_cells(df, cfg.max_cell_chars)
        if stage in stages.counts:
            save_or_csv(df, path, cfg.formats.get(stage))
        else:
            seen = written(df, lambda d: save_or_csv(d, path, cfg.formats.get(stage)), n=F.count(F.lit(1)))
            stages.counts[stage] = seen["n"]
    return stages
