"""Trial tables in one folder a start month, so that date windows skip the files of other months."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registryloom.names import Names, col
from registryloom.operators.filters import MONTH


def save_by_month(df: DataFrame, path: str, names: Names = Names()) -> str:
    """Write ``df`` by the month of its start date; rows without one have a folder of their own.

    A month's rows are gathered into files of even size first, a large month into several.
    """
    day = col(names.start)
    month = (F.year(day) * 100 + F.month(day)).cast("int")
    laid = df.withColumn(MONTH, month).hint("rebalance", MONTH)
    laid.write.mode("overwrite").partitionBy(MONTH).parquet(path)
    return path


def load_by_month(spark: SparkSession, path: str) -> DataFrame:
    """All rows and ``MONTH``, which ``month_window`` uses and drops."""
    return spark.read.parquet(path)
