"""The two cleaned files held in storage, for a caller who asks of them again and again."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registryloom.names import Names
from registryloom.operators import refine
from registryloom.plans.branches import Branches, Refinement, join_and_stack
from registryloom.plans.cleaning import clean_public, clean_sheet, rename_public, select_sheet
from registryloom.plans.keyed import side_by_side, written
from registryloom.plans.pipeline import STAGES, PipelineConfig, add_segments
from registryloom.plans.trial_filters import FilterSpec, apply_filters
from registryloom.sources.headers import SNAKE_SHEET
from registryloom.sources.tables import load_table


class CachedPair:
    """``sheet`` and ``public``, cleaned once and kept until ``release`` or the end of a ``with``.

    Storage is memory first, then the executors' disks. Parts on a lost executor are cleaned again
    from the source files, so nothing is lost. Requests are plans over the stored frames.
    """

    def __init__(
        self,
        sheet: DataFrame,
        public: DataFrame,
        names: Names = SNAKE_SHEET.names,
        level: StorageLevel = StorageLevel.MEMORY_AND_DISK,
    ):
        self.names, self._released = names, False
        self._sheet, self._public = sheet.persist(level), public.persist(level)

    @classmethod
    def load(cls, spark: SparkSession, cfg: PipelineConfig, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> CachedPair:
        """The files of a batch, with its options for them."""
        raw = (load_table(spark, getattr(cfg, f), cfg.formats.get(f), multi_line=cfg.multi_line, split=cfg.split_files) for f in ("sheet_path", "public_path"))
        sheet, public = raw
        names, drop = cfg.sheet.names, cfg.drop_null_columns
        return cls(
            clean_sheet(select_sheet(sheet, cfg.sheet), cfg.sheet, drop),
            clean_public(rename_public(public, names), names, drop_null_columns=drop, numbers=cfg.public_numbers),
            names,
            level,
        )

    def _held(self, df: DataFrame) -> DataFrame:
        if self._released:
            raise RuntimeError("the cached pair has been released")
        return df

    @property
    def sheet(self) -> DataFrame:
        return self._held(self._sheet)

    @property
    def public(self) -> DataFrame:
        return self._held(self._public)

    def fill(self) -> dict[str, int]:
        """Clean and store both files now, side by side; their row counts."""
        frames = {"sheet": self.sheet, "public": self.public}
        jobs = [lambda df=df: df.agg(F.count(F.lit(1))).first()[0] for df in frames.values()]
        return dict(zip(frames, side_by_side(self.sheet.sparkSession, *jobs)))

    def branches(self, refinement: Refinement = Refinement()) -> Branches:
        return join_and_stack(self.sheet, self.public, refinement, self.names)

    def stages(
        self,
        sponsor_map: DataFrame,
        us_segments: DataFrame,
        ww_segments: DataFrame,
        refinement: Refinement = Refinement(),
        **lookup_options: object,
    ) -> dict[str, DataFrame]:
        """All stages of one batch request, as plans."""
        branches = self.branches(refinement)
        lead = refine.add_lead_sponsor(branches.union, self.names)
        tables = (sponsor_map, us_segments, ww_segments)
        segments = add_segments(lead, *tables, names=self.names, **lookup_options)
        return dict(zip(STAGES, (self.sheet, self.public, *branches, lead, segments)))

    def filtered(self, request: FilterSpec | Mapping[str, object]) -> DataFrame:
        """One filter request, as a ``FilterSpec`` or with the keys of a filter form."""
        spec = request if isinstance(request, FilterSpec) else FilterSpec.from_request(request)
        return apply_filters(self.sheet, spec, self.names)

    def release(self) -> None:
        """Give the storage back; further requests are errors."""
        if not self._released:
            self._released = True
            for df in (self._sheet, self._public):
                df.unpersist(blocking=True)

    def __enter__(self) -> CachedPair:
        return self

    def __exit__(self, *error: object) -> None:
        self.release()


def save_requests(frames: Mapping[str, DataFrame], root: str) -> dict[str, int]:
    """Write each request's result below ``root`` and tell its rows, counted on the way."""
    return {
        name: written(df, lambda d, n=name: d.write.mode("overwrite").parquet(f"{root}/{n}"), n=F.count(F.lit(1)))["n"]
        for name, df in frames.items()
    }
