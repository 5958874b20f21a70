"""What the operators share: words, letter case, staged frames."""

from __future__ import annotations

import gc
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registryloom.sources.tables import shared_dir

#: Words are runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Hashes by which rows with equal counts are told apart.
TIES = 1 << 16
#: Bytes of rows that a task hands to Python at once, about.
BATCH_BYTES = 4_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session hands rows to Python by a few MB, not by tens of thousands.

    Whole texts are long, and each task holds a batch on both sides of the pipe.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name).rstrip("b")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def lower_ascii(c: Column) -> Column:
    """A-Z alone in lower case, whatever the locale."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def word_count(text: Column) -> Column:
    """Number of words as bigint; a null text has none."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return F.size(words).cast("bigint")


def fold(doc_id: Column, n: int) -> Column:
    """``crc32`` of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def saved(df: DataFrame) -> DataFrame:
    """Compute now, keep the rows in the cluster's shared checkpoint folder, cut the lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, root: str | None = None) -> DataFrame:
    """As ``saved``, but in Parquet, which packs numbers far better than a checkpoint; below ``root``
    if given, which the caller may remove once the rows have served."""
    spark = df.sparkSession
    path = f"{root or shared_dir(spark)}/rows"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_unused(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that are gone; else they stay on disk until
    the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def most_frequent(counts: DataFrame, limit: int, root: str | None = None) -> DataFrame:
    """The ``limit`` rows of ``counts`` with the largest ``n``; all of them if there are fewer. What is
    returned reads the counts as ``stored`` has put them, below ``root`` if given.

    How many rows are about how frequent is a few hundred numbers, which tell the frequency where
    the limit falls; rows about as frequent are counted by ``n``, and those with one ``n`` by a hash
    of the row, of which fewer than one hash's share are left out. So no task sends a top list.
    """
    counts = stored(counts, root)
    others = [c for c in counts.columns if c != "n"]
    kept, within, room = F.lit(False), F.lit(True), limit
    for part in (F.floor(F.log2("n") * 16), F.col("n"), F.pmod(F.xxhash64(*others), F.lit(TIES))):
        sizes = {r["part"]: r["count"] for r in counts.filter(within).groupBy(part.alias("part")).count().collect()}
        least = max(sizes, default=0) + 1
        for at in sorted(sizes, reverse=True):
            if sizes[at] > room:
                break
            room, least = room - sizes[at], at
        else:
            return counts.filter(kept | within)
        kept, within = kept | (within & (part >= least)), within & (part == at)
    return counts.filter(kept)
