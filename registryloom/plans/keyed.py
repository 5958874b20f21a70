"""Tables laid out once by their join key, so that every later join reads them without a shuffle.

Rows of ordinary keys lie in buckets, sorted by key. Keys that hold so many rows that their bucket
would stand out, found by a sketch of the key column, lie apart with the missing ones and meet by
a broadcast of checked size or by salted parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from registryloom.functions.ids import NO_CODE
from registryloom.names import col
from registryloom.operators import joins
from registryloom.operators.joins import JoinSplit, right_subset
from registryloom.operators.lookups import BROADCAST_BYTES, row_bytes
from registryloom.sources.tables import remove_dir

#: A key is hot if it holds more than so many times the mean rows of a bucket.
HOT_FACTOR = 2.0
_RKEY, _ROWS, _BYTES = "__right_key", "__rows", "__bytes"


def side_by_side(spark: SparkSession, *jobs: Callable[[], object]) -> list:
    """Results of jobs that do not need each other; their stages share the cluster."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(j)) for j in jobs]]


def observed(seen: Observation) -> dict[str, object] | None:
    """What was observed; None where the optimizer saw that there are no rows and left it out."""
    try:
        return seen.get
    except Py4JJavaError:
        return None


def written(df: DataFrame, write: Callable[[DataFrame], None], **metrics: Column) -> dict[str, object]:
    """Metrics of the rows of ``df``, taken while ``write`` writes them."""
    seen, columns = Observation(), [c.alias(n) for n, c in metrics.items()]
    write(df.observe(seen, *columns))
    found = observed(seen)
    return df.agg(*columns).first().asDict() if found is None else found


def hot_keys(frames: Sequence[DataFrame], key: str, buckets: int) -> tuple[str, ...]:
    """Keys that hold too many rows of any frame for one of its ``buckets``; one job."""
    seen = [df.select(F.lit(i).alias("side"), col(key).alias("key")) for i, df in enumerate(frames)]
    sides = reduce(DataFrame.unionAll, seen).groupBy("side")
    found = sides.agg(F.count(F.lit(1)).alias("n"), joins.top_keys(F.col("key")).alias("top")).collect()
    return tuple(sorted({k for r in found for k in joins.standing_out(r["top"], HOT_FACTOR * r["n"] / buckets)}))


@dataclass(frozen=True)
class KeyedTable:
    """``regular`` is bucketed and sorted by ``key``; ``apart`` has the rows of hot and NULL keys.

    ``rows`` and ``apart_bytes`` were counted while the rows were written, so whoever plans a join
    knows them without a job.
    """

    key: str
    regular: DataFrame
    apart: DataFrame
    hot: tuple[str, ...]
    rows: int
    apart_rows: int
    apart_bytes: int
    metrics: Mapping[str, object] = field(default_factory=dict)

    @property
    def frame(self) -> DataFrame:
        """All rows."""
        return self.regular.unionByName(self.apart)

    def without(self, columns: Iterable[str]) -> KeyedTable:
        gone = list(columns)
        frames = (df.drop(*gone) for df in (self.regular, self.apart))
        sizes = (self.rows, self.apart_rows, self.apart_bytes, self.metrics)
        return KeyedTable(self.key, *frames, self.hot, *sizes)


class Layout:
    """Writes tables under ``root``; bucketed ones also have a name in the catalog until ``remove``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.root = spark, root
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._tables: list[str] = []

    def plain(self, df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict[str, object]]:
        path = f"{self.root}/{name}"
        seen = written(df, lambda d: d.write.mode("overwrite").parquet(path), **metrics)
        return self.spark.read.schema(df.schema).parquet(path), seen

    def bucketed(self, df: DataFrame, name: str, key: str, **metrics: Column) -> tuple[DataFrame, dict[str, object]]:
        """One file a bucket: rows move by key once, here."""
        table = f"registryloom_{uuid.uuid4().hex}"
        self._tables.append(table)

        def write(d: DataFrame) -> None:
            dealt = d.repartition(self.buckets, col(key))
            writer = dealt.write.format("parquet").bucketBy(self.buckets, key).sortBy(key)
            writer.option("path", f"{self.root}/{name}").saveAsTable(table)

        seen = written(df, write, **metrics)
        return self.spark.table(table), seen

    def keyed(self, df: DataFrame, name: str, key: str, hot: Sequence[str] = (NO_CODE,), **metrics: Column) -> KeyedTable:
        """Write ``df`` once by ``key``; sums of ``metrics`` over all rows come with the table."""
        special = joins.is_hot(key, hot)
        counted = {**metrics, _ROWS: F.count(F.lit(1)), _BYTES: F.coalesce(F.sum(row_bytes(df)), F.lit(0))}
        (regular, a), (apart, b) = side_by_side(
            self.spark,
            lambda: self.bucketed(df.filter(~special), f"{name}/regular", key, **counted),
            lambda: self.plain(df.filter(special), f"{name}/apart", **counted),
        )
        total = {n: (a[n] or 0) + (b[n] or 0) for n in metrics}
        return KeyedTable(key, regular, apart, tuple(hot), a[_ROWS] + b[_ROWS], b[_ROWS], b[_BYTES], total)

    def remove(self) -> None:
        for table in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables.clear()
        remove_dir(self.spark, self.root)


def _apart_matched(left: KeyedTable, right: KeyedTable, narrow: DataFrame, salts: int) -> DataFrame:
    """Rows under hot keys: the right side is broadcast if what was counted of it is small."""
    if right.apart_bytes <= BROADCAST_BYTES:
        small = F.broadcast(narrow.withColumnRenamed(right.key, _RKEY))
        return left.apart.join(small, col(left.key).eqNullSafe(col(_RKEY))).drop(_RKEY)
    return joins.matched(left.apart, narrow, left.key, left.hot, salts)


def _unmatched(a: KeyedTable, b: KeyedTable, rows: DataFrame, apart: DataFrame) -> DataFrame:
    """Rows of ``a``, given with any columns, whose key ``b`` lacks."""
    keys = b.regular.select(col(b.key).alias(_RKEY))
    out = rows.join(keys, col(a.key) == col(_RKEY), "left_anti")
    if a.apart_rows:
        out = out.unionByName(joins.unmatched_hot(apart, b.apart, a.key, a.hot) if b.apart_rows else apart)
    return out


def split_keyed(
    left: KeyedTable,
    right: KeyedTable,
    *,
    right_columns: Iterable[str] | None = None,
    suffix: str = "_CT",
    salts: int = joins.SALTS,
    drop_right_key: bool = False,
) -> JoinSplit:
    """``joins.split_join`` of two laid out tables; ordinary keys meet bucket by bucket.

    Both tables must have been laid out with the same buckets and hot keys. NULL matches NULL.
    """
    if left.key != right.key or set(left.hot) != set(right.hot):
        raise ValueError("tables laid out by different keys or with different hot keys")
    regular, apart = (right_subset(df, right.key, right_columns, suffix) for df in (right.regular, right.apart))
    met = left.regular.join(regular.withColumnRenamed(right.key, _RKEY), col(left.key) == col(_RKEY)).drop(_RKEY)
    if left.apart_rows and right.apart_rows:
        met = met.unionByName(_apart_matched(left, right, apart, salts))
    right_only = _unmatched(right, left, regular, apart)
    return JoinSplit(
        both=met,
        left_only=_unmatched(left, right, left.regular, left.apart),
        right_only=right_only.drop(right.key) if drop_right_key else right_only,
    )
