"""Table reading and writing by format, for paths on storage that all executors share."""

from __future__ import annotations

import atexit
import logging
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from registryloom.names import col
from registryloom.operators.schema import is_text, replace_columns
from registryloom.sources.quoted import read_quoted

log = logging.getLogger(__name__)

#: Bytes of files that a part of dealt rows comes from, about.
PART_BYTES = 4 * 1024 * 1024

FORMATS = ("csv", "parquet")

# Cell texts that mean a missing value in a delimited file.
NULL_MARKERS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Cells may hold line breaks, quotes and outer blanks, and must come back as they went out.
_CSV = {"header": True, "quote": '"', "escape": '"'}
# Without a forced schema, every file's header is held against the columns read.
_CSV_READ = {**_CSV, "enforceSchema": False}
_CSV_WRITE = {**_CSV, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _suffix(path: str) -> str:
    """The ending of the last part of a path or URI, in lower case, without its dot."""
    found = re.search(r"\.([^./]+)/*$", path)
    return found[1].lower() if found else ""


def format_of(path: str, fmt: str | None = None) -> str:
    """The format asked for, else the one that the path's ending names; Parquet without one."""
    fmt = fmt or _suffix(path) or "parquet"
    if fmt not in FORMATS:
        raise ValueError(f"unsupported table format {fmt!r} for {path}; use one of {FORMATS}")
    return fmt


def load_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    *,
    null_markers: Sequence[str] = NULL_MARKERS,
    schema: StructType | str | None = None,
    multi_line: bool = True,
    split: bool = False,
) -> DataFrame:
    """Read a table; delimited files come as text by header, with the null markers as NULL.

    ``schema`` gives columns of a delimited file their types, by name and whatever their order;
    what does not fit is NULL, and columns it does not name stay text. Files whose headers differ
    are an error. A file with line breaks in cells is read by one task (see ``spread``), unless
    ``split`` is on: then its quotes, which must be balanced, are counted first (see ``quoted``).
    Without such breaks, ``multi_line`` may be off, and files are split right away.
    """
    fmt = format_of(path, fmt)
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        df = spark.read.options(**_CSV_READ, multiLine=multi_line).csv(path)
        if split and multi_line:
            df = read_quoted(spark, path, df.columns, _CSV["quote"])
        if null_markers:
            texts = [f.name for f in df.schema if is_text(f.dataType)]
            markers = list(null_markers)
            df = replace_columns(df, {n: F.when(~col(n).isin(markers), col(n)) for n in texts})
        if schema is not None:
            kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema
            new = {f.name: col(f.name).try_cast(f.dataType) for f in kinds if f.name in df.columns}
            df = replace_columns(df, new)
    return df


def _file_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads; the plan's leaves know them."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Deal the rows of a scan out to ``parts`` where the scan has fewer.

    Text cleaning costs far more than moving the rows once, and a few unsplittable files would
    leave most of the cluster idle. The default is all cores, or more where files are large: then
    a task's work does not grow with them. A scan of many parts stays as it is, without a shuffle. The
    optimizer moves filters below the shuffle; write the dealt rows first where those are costly.
    """
    parts = parts or max(df.sparkSession.sparkContext.defaultParallelism, -(-_file_bytes(df) // PART_BYTES))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage with all it holds."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def save_table(
    df: DataFrame, path: str, fmt: str | None = None, partition_by: Sequence[str] = (), rows_per_file: int = 0
) -> str:
    """Write a directory of part files, replacing what is there; returns the format used.

    A delimited file with line breaks in cells is read by one task, so ``rows_per_file`` bounds
    what such a task reads; 0 sets no bound.
    """
    fmt = format_of(path, fmt)
    writer = df.write.mode("overwrite").format(fmt).partitionBy(*partition_by)
    writer = writer.option("maxRecordsPerFile", rows_per_file)
    (writer.options(**_CSV_WRITE) if fmt == "csv" else writer).save(path)
    return fmt


def csv_path(path: str) -> str:
    """The same place with the ending ``.csv``; URIs keep their scheme and host."""
    return re.sub(r"(\.[^./]+)?/*$", "", path, count=1) + ".csv"


def save_or_csv(df: DataFrame, path: str, fmt: str | None = None) -> tuple[str, str]:
    """Write in the wanted format, or as CSV where that format cannot take the table.

    Only the choice of format is retried: errors of the query itself come through. Returns the
    path and format written.
    """
    try:
        return path, save_table(df, path, fmt)
    except (ValueError, AnalysisException) as error:
        unfit = isinstance(error, ValueError) or "UNSUPPORTED_DATA_TYPE" in str(error)
        alternative = csv_path(path)
        if not unfit or alternative == path:
            raise
        log.warning("cannot write %s (%s); writing %s instead", path, error, alternative)
        return alternative, save_table(df, alternative)


_named: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh path under the cluster's shared folder; a local temporary one only in local mode.

    ``release_shared`` removes what was written there; local folders go when the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="registryloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    _named.append(f"{base.rstrip('/')}/registryloom-{uuid.uuid4().hex}")
    return _named[-1]


def release_shared(spark: SparkSession) -> None:
    """Remove all folders that ``shared_dir`` has named so far; frames that read them are void."""
    while _named:
        remove_dir(spark, _named.pop())
