"""Session settings the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "registryloom", **conf: object) -> SparkSession:
    """Adaptive execution with skew handling, UTC, and no web page; ``conf`` adds or overrides."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        # Methods above this many bytes are never compiled by the JVM; Spark then splits them.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        # Spares several driver round trips for each column expression that is built.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    builder = SparkSession.builder.appName(app)
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()
