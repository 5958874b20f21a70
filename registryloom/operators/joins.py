"""Two-table matching on a key that may be missing or badly skewed."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registryloom.functions.ids import NO_CODE
from registryloom.names import col

_HIT, _SALT, _RKEY = "__hit", "__salt", "__right_key"

#: Parts that the rows of a hot key are spread over.
SALTS = 16
#: Most hot keys that are told apart, and keys that their sketch tracks; counts are off by at most
#: about the rows of all keys divided by the tracked ones.
MOST_HOT, TRACKED = 64, 8_192


class JoinSplit(NamedTuple):
    """The three parts of a full outer join; each is its own lazy plan."""

    both: DataFrame
    left_only: DataFrame
    right_only: DataFrame


def right_subset(
    right: DataFrame, key: str, columns: Iterable[str] | None, suffix: str
) -> DataFrame:
    """Key plus the named columns that exist, all but the key with the suffix."""
    wanted = dict.fromkeys([key, *(columns or [])])
    kept = [n for n in wanted if n in right.columns]
    return right.select(*[col(n).alias(n if n == key else n + suffix) for n in kept])


def top_keys(key: Column, most: int = MOST_HOT, tracked: int = TRACKED) -> Column:
    """Aggregate: the most frequent keys and about how many rows each has, as ``item, count``."""
    return F.call_function("approx_top_k", key, F.lit(most), F.lit(tracked))


def standing_out(top: Iterable, least: float) -> list:
    """Keys of a ``top_keys`` result with more than ``least`` rows, NULL left out."""
    return [r["item"] for r in top or () if r["item"] is not None and r["count"] > least]


def frequent_keys(df: DataFrame, key: str, least_share: float) -> list:
    """Keys with more than ``least_share`` of the rows; one job over the key column alone."""
    n, top = df.agg(F.count(F.lit(1)), top_keys(col(key))).first()
    return sorted(standing_out(top, least_share * n))


def is_hot(key: str, hot_keys: Sequence[str]) -> Column:
    return col(key).isNull() | col(key).isin(list(hot_keys))


def _hot_seen(df: DataFrame, key: str, hot_keys: Sequence[str]) -> DataFrame:
    """Hot keys that ``df`` holds: at most one row per hot key and one for NULL."""
    seen = df.filter(is_hot(key, hot_keys)).select(col(key).alias(_RKEY)).distinct()
    return F.broadcast(seen.withColumn(_HIT, F.lit(True)))


def unmatched_hot(
    df: DataFrame, other: DataFrame, key: str, hot_keys: Sequence[str] = (NO_CODE,)
) -> DataFrame:
    """Rows of ``df`` under a hot key that ``other`` does not hold; nothing of ``df`` shuffles."""
    on = col(key).eqNullSafe(col(_RKEY))
    rows = df.filter(is_hot(key, hot_keys))
    return rows.join(_hot_seen(other, key, hot_keys), on, "left_anti")


def unmatched(
    df: DataFrame, other: DataFrame, key: str, hot_keys: Sequence[str] = (NO_CODE,)
) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``other``; NULL matches NULL.

    Rows under a hot key never shuffle: the few hot keys of ``other`` are broadcast. The keys of
    ``other`` are made distinct before they meet the rest, so its own hot keys collapse early.
    The null-safe comparison moves the distinct keys once more, which costs little and leaves
    both inputs as plain shuffles, so that adaptive execution can split any other hot key.
    """
    on = col(key).eqNullSafe(col(_RKEY))
    other_keys = (
        other.filter(~is_hot(key, hot_keys)).select(col(key).alias(_RKEY)).distinct()
    )
    rest = df.filter(~is_hot(key, hot_keys)).join(other_keys, on, "left_anti")
    return unmatched_hot(df, other, key, hot_keys).unionByName(rest)


def matched(
    left: DataFrame,
    right: DataFrame,
    key: str,
    hot_keys: Sequence[str] = (NO_CODE,),
    salts: int = SALTS,
    salt_by: str | None = None,
) -> DataFrame:
    """Inner join where NULL matches NULL: left columns, then the right ones without the key.

    Left rows under a hot key go into the shuffle only if the right side holds that key too, and
    then spread over ``salts`` parts by the hash of one column (the first that is not the key),
    while the right rows of that key are repeated for each part. Adaptive execution splits parts
    that are still too large.
    """
    hot = is_hot(key, hot_keys)
    # One column only: a hash over all of them makes the optimizer's constraint rules explode.
    salt_by = salt_by or next((n for n in left.columns if n != key), key)
    row_salt = F.pmod(F.xxhash64(col(salt_by)), F.lit(salts)).cast("int")
    candidates = (
        left.join(_hot_seen(right, key, hot_keys), col(key).eqNullSafe(col(_RKEY)), "left")
        .filter(~hot | col(_HIT))
        .drop(_RKEY, _HIT)
        .withColumn(_SALT, F.when(hot, row_salt).otherwise(0))
    )
    parts = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = right.select(
        col(key).alias(_RKEY),
        *[col(n) for n in right.columns if n != key],
        F.explode(parts).alias(_SALT + "_r"),
    )
    on = col(key).eqNullSafe(col(_RKEY)) & (col(_SALT) == col(_SALT + "_r"))
    return candidates.join(spread, on, "inner").drop(_SALT, _SALT + "_r", _RKEY)


def split_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    *,
    right_columns: Iterable[str] | None = None,
    suffix: str = "_CT",
    hot_keys: Sequence[str] = (NO_CODE,),
    salts: int = SALTS,
    salt_by: str | None = None,
    drop_right_key: bool = False,
) -> JoinSplit:
    """Split a full outer join into matched, left-only and right-only rows.

    The outer join itself is never built: each part is a join of its own, so a part nobody reads
    costs nothing. Many-to-many keys multiply. ``hot_keys`` may come from ``frequent_keys``. ``drop_right_key`` leaves the key out of the
    right-only part.
    """
    narrow = right_subset(right, key, right_columns, suffix)
    right_only = unmatched(narrow, left, key, hot_keys)
    if drop_right_key:
        right_only = right_only.drop(key)
    return JoinSplit(
        both=matched(left, narrow, key, hot_keys, salts, salt_by),
        left_only=unmatched(left, narrow, key, hot_keys),
        right_only=right_only,
    )


def per_key(df: DataFrame, key: str, **totals: Column) -> DataFrame:
    """One row per key, NULL among them, with aggregates of its rows.

    Whoever asks only for totals over the matches joins this instead of ``df``: what a hot key of
    both sides would multiply is summed before they meet, and no row pair is ever formed.
    """
    return df.groupBy(col(key).alias(key)).agg(*[c.alias(n) for n, c in totals.items()])


def bucket_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Row counts of the three parts of the full outer join, as ``(bucket, n_rows)``.

    Both sides are counted per key before they meet, so no row pair is ever formed.
    """
    lc = left.groupBy(col(key).alias("__l")).agg(F.count(F.lit(1)).alias("nl"))
    rc = right.groupBy(col(key).alias("__r")).agg(F.count(F.lit(1)).alias("nr"))
    nl, nr = F.col("nl"), F.col("nr")
    sums = lc.join(rc, F.col("__l").eqNullSafe(F.col("__r")), "full_outer").agg(
        F.sum(nl * nr).alias("both"),
        F.sum(F.when(nr.isNull(), nl)).alias("left_only"),
        F.sum(F.when(nl.isNull(), nr)).alias("right_only"),
    )
    rows = [
        F.struct(F.lit(b).alias("bucket"), F.coalesce(F.col(b), F.lit(0)).alias("n_rows"))
        for b in JoinSplit._fields
    ]
    return sums.select(F.inline(F.array(*rows)))


def stack(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both, columns aligned by name, NULL where one side lacks a column."""
    return first.unionByName(second, allowMissingColumns=True)

