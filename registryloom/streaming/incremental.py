"""Feed newly arrived files through a stateless flow.

Cleaning, tagging, filtering and lookups against fixed tables work row by row, so the same
functions that build the batch serve here; the joins of the two registry files do not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def process_new_files(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    flow: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    max_files: int = 1000,
) -> StreamingQuery:
    """Take the Parquet files not seen before, run ``flow`` on them, append the result to ``sink``.

    Stops when all present files are done; the checkpoint folder remembers them for next time.
    """
    arriving = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    )
    return (
        flow(arriving)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
