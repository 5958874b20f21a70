"""Run the batch from a JSON file: ``python -m registryloom batch.json``.

The keys are those of ``PipelineConfig``; ``headers`` is ``snake`` or ``display``, and
``refinement`` is an object of flags. Prints one line per stage.
"""

from __future__ import annotations

import json
import sys

from registryloom.plans.branches import Refinement
from registryloom.plans.pipeline import PipelineConfig, run_pipeline, stage_summary
from registryloom.session import session
from registryloom.sources.headers import DISPLAY_SHEET, SNAKE_SHEET


def config(settings: dict) -> PipelineConfig:
    settings = dict(settings)
    for name in ("public_numbers", "lookup_numbers"):
        settings[name] = tuple(settings.get(name, ()))
    sheet = {"snake": SNAKE_SHEET, "display": DISPLAY_SHEET}[settings.pop("headers", "snake")]
    refinement = Refinement(**settings.pop("refinement", {}))
    return PipelineConfig(sheet=sheet, refinement=refinement, **settings)


def main(path: str) -> None:
    with open(path, encoding="utf-8") as file:
        cfg = config(json.load(file))
    spark = session()
    with run_pipeline(spark, cfg) as stages:
        for row in stage_summary(stages).collect():
            print(f"{row.stage}: {row.n_rows:,} rows, {row.n_cols} columns")


if __name__ == "__main__":
    main(sys.argv[1])
