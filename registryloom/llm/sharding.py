"""Shards of near equal bytes by sampled splitters.

Records are laid out in the order of a hash of their text, so equal texts are neighbours. A
size-weighted sample of that order gives the boundaries of many small ranges; a range that turns
out overfull, because many records share one text, is divided again, between texts where it can
be and by the record's own key inside a text that is too large to stay whole. Exact
sums over the ranges then tell where each record lies on the whole line of bytes, and the line is
cut into equal shards.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registryloom.llm.common import saved

#: Ranges hold ids and sizes alone, about this many rows each, and never number more than the cap,
#: which bounds what the driver gathers: one boundary, one sum and some sampled keys a range.
ROWS_PER_RANGE, MIN_RANGES, MAX_RANGES = 2_000, 128, 16_384
SAMPLES_PER_RANGE = 8
#: A range is overfull beyond so many times the mean bytes or rows.
OVERFULL = 3
#: Equal texts stay in one shard while together they hold at most this part of a shard.
KEEP_TOGETHER = 0.01
_BITS = 2.0**64
_LEAST = -(2**63)


def _uniform(key: Column) -> Column:
    """A number in [0, 1) from a hash of the key, the same in every run."""
    return F.xxhash64(key, F.lit("sample")) / F.lit(_BITS) + F.lit(0.5)


def _sampled(units: DataFrame, rate: Column) -> DataFrame:
    """Draw units by their bytes times ``rate``, the expected draws; beyond one they count so often."""
    drawn = units.withColumn("draws", F.col("copies") * F.col("size") * rate)
    drawn = drawn.filter(_uniform(F.col("unit")) < F.col("draws"))
    return drawn.withColumn("draws", F.greatest("draws", F.lit(1.0)))


def _splitters(keys: np.ndarray, draws: np.ndarray, n: int) -> np.ndarray:
    """At most ``n - 1`` boundaries at equal shares of the weight; a range begins at its boundary."""
    order = np.argsort(keys, kind="stable")
    share = np.cumsum(draws[order])
    if not len(share):
        return np.empty(0, np.int64)
    at = np.searchsorted(share, share[-1] * np.arange(1, n) / n)
    return np.unique(keys[order][np.minimum(at, len(keys) - 1)])


def _place(key: Column, splitters: np.ndarray) -> Column:
    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, keys.to_numpy(), side="right").astype("int32"))

    return place(key)


@dataclass(frozen=True)
class Cuts:
    """Boundaries within one range, in order: a text's hash, and a record's from which on to cut.

    Most cut before all records of a text; texts too large to stay together are cut inside too.
    """

    spots: np.ndarray
    units: np.ndarray

    def place(self, spots: np.ndarray, units: np.ndarray) -> np.ndarray:
        """How many boundaries lie at or before each record."""
        out = np.searchsorted(self.spots, spots, side="right")
        for spot in np.unique(self.spots):
            at = np.flatnonzero(spots == spot)
            low, high = np.searchsorted(self.spots, spot, side="left"), np.searchsorted(self.spots, spot, side="right")
            out[at] = low + np.searchsorted(self.units[low:high], units[at], side="right")
        return out


def _cuts(spots: np.ndarray, units: np.ndarray, draws: np.ndarray, n: int) -> Cuts:
    """At most ``n - 1`` boundaries at equal shares of the weight."""
    order = np.lexsort((units, spots))
    share = np.cumsum(draws[order])
    at = np.searchsorted(share, share[-1] * np.arange(1, n) / n) if len(share) else np.empty(0, np.int64)
    chosen = order[np.unique(np.minimum(at, len(order) - 1))] if len(order) else at
    return Cuts(spots[chosen], units[chosen])


def _whole(cuts: Cuts, divided: np.ndarray) -> Cuts:
    """The boundaries moved before the whole text, but for further ones inside ``divided`` texts."""
    first = np.concatenate([[True], cuts.spots[1:] != cuts.spots[:-1]])[: len(cuts.spots)]
    kept = first | np.isin(cuts.spots, divided)
    return Cuts(cuts.spots[kept], np.where(first, _LEAST, cuts.units)[kept])


def _place_within(part: Column, spot: Column, unit: Column, cuts: dict[int, Cuts]) -> Column:
    @F.pandas_udf("int")
    def place(parts: pd.Series, spots: pd.Series, units: pd.Series) -> pd.Series:
        out = np.zeros(len(parts), "int32")
        held, own = parts.to_numpy(), (spots.to_numpy(), units.to_numpy())
        for p in np.intersect1d(held, np.fromiter(cuts, "int32", len(cuts))):
            rows = held == p
            out[rows] = cuts[int(p)].place(own[0][rows], own[1][rows])
        return pd.Series(out)

    return place(part, spot, unit)


def _sums(units: DataFrame, *by: str) -> list:
    count, size = F.sum("copies").alias("rows"), F.sum(F.col("copies") * F.col("size")).alias("bytes")
    held = units.groupBy(*by).agg(count, size)
    return sorted(held.collect(), key=lambda r: [r[n] for n in by])


def _units(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct records by id, size and hashes, with how often each occurs."""
    body = F.col(text).cast("string")
    size = F.coalesce(F.octet_length(body), F.lit(0)).cast("bigint") + 1
    crc = F.crc32(F.coalesce(body, F.lit("")).cast("binary"))
    rows = docs.select(
        F.col(key).alias("key_value"),
        size.alias("size"),
        crc.alias("text_crc32"),
        F.xxhash64(body).alias("spot"),
        F.xxhash64(F.col(key), body).alias("unit"),
    )
    held = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    return held


def range_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, size, text_crc32, shard, slot`` per row of ``docs``.

    Size is the text's UTF-8 bytes plus one; a null text counts none. Shards are numbered from 0
    along the line and differ by little more than one record, or by ``KEEP_TOGETHER`` of a shard
    where equal texts are kept together; slots count from 0 in each shard without gaps. Null keys
    are records like others, repeated rows each get a slot of their own, other columns are
    ignored, and an empty table gives no rows. The same rows give the same shards in every run.
    """
    units = saved(_units(docs, key, text))
    total = _sums(units)[0]
    n_rows, n_bytes = total["rows"] or 0, total["bytes"] or 0
    n_ranges = int(min(MAX_RANGES, max(MIN_RANGES, n_rows // ROWS_PER_RANGE)))
    rate = F.lit(n_ranges * SAMPLES_PER_RANGE / max(n_bytes, 1))
    sample = _sampled(units, rate).select("spot", "draws").toPandas()
    first = _splitters(sample["spot"].to_numpy(np.int64), sample["draws"].to_numpy(float), n_ranges)
    parts = units.withColumn("part", _place(F.col("spot"), first))

    sums = _sums(parts, "part")
    most = {"rows": OVERFULL * n_rows / n_ranges, "bytes": OVERFULL * n_bytes / n_ranges}
    over = {r["part"]: max(r[k] / v for k, v in most.items()) for r in sums}
    over = {p: x for p, x in over.items() if x > 1}
    placed = _subdivided(parts, sums, over, int(n_bytes / shards * KEEP_TOGETHER))
    return _laid_out(saved(placed), n_bytes, shards).withColumnRenamed("key_value", key)


def _subdivided(parts: DataFrame, sums: list, over: dict[int, float], limit: int) -> DataFrame:
    """Split the overfull ranges again, between texts, and inside texts of over ``limit`` bytes."""
    if not over:
        return parts.withColumn("sub", F.lit(0))
    held = {r["part"]: r["bytes"] for r in sums}
    pieces = {p: int(np.ceil(x * OVERFULL)) for p, x in over.items()}
    rates = [(p, float(n * SAMPLES_PER_RANGE / held[p])) for p, n in pieces.items()]
    rated = parts.join(
        F.broadcast(parts.sparkSession.createDataFrame(rates, "part int, rate double")), "part"
    )
    drawn = _sampled(rated, F.col("rate")).select("part", "spot", "unit", "draws").toPandas()
    within = {
        int(p): _cuts(*(rows[c].to_numpy() for c in ("spot", "unit", "draws")), pieces[int(p)])
        for p, rows in drawn.groupby("part")
    }
    # Texts that several boundaries hit may be too large to stay together; their bytes tell.
    met = [np.unique(c.spots, return_counts=True) for c in within.values()]
    often = [int(x) for spots, n in met for x in spots[n > 1]]
    large = parts.filter(F.col("spot").isin(often)).groupBy("spot")
    large = large.agg(F.sum(F.col("copies") * F.col("size")).alias("bytes")).filter(F.col("bytes") > limit)
    divided = np.array([r["spot"] for r in large.collect()], np.int64)  # fewer than boundaries
    within = {p: _whole(c, divided) for p, c in within.items()}
    return parts.withColumn("sub", _place_within(F.col("part"), F.col("spot"), F.col("unit"), within))


def _laid_out(placed: DataFrame, n_bytes: int, shards: int) -> DataFrame:
    """Exact place of each record on the line, and from it shard and slot."""
    spark = placed.sparkSession
    sums = _sums(placed, "part", "sub")
    rows_before = [0, *accumulate(r["rows"] for r in sums)]
    bytes_before = [0, *accumulate(r["bytes"] for r in sums)]
    offsets = [
        (r["part"], r["sub"], i, rows_before[i], bytes_before[i]) for i, r in enumerate(sums)
    ]
    schema = "part int, sub int, cell int, rows_before bigint, bytes_before bigint"
    joined = placed.join(F.broadcast(spark.createDataFrame(offsets, schema)), ["part", "sub"])

    held = F.col("copies") * F.col("size")
    line = Window.partitionBy("cell").orderBy("spot", "unit", "key_value")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("cell", "spot")
    limit = int(n_bytes / shards * KEEP_TOGETHER)
    lines = (
        joined.withColumn("rank", F.col("rows_before") + F.coalesce(F.sum("copies").over(before), F.lit(0)))
        .withColumn("start", F.col("bytes_before") + F.coalesce(F.sum(held).over(before), F.lit(0)))
        .withColumn("together", F.sum(held).over(same) <= limit)
        .withColumn("group_start", F.min("start").over(same))
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    )
    own = F.col("start") + F.col("i") * F.col("size")
    begin = F.when(F.col("together"), F.col("group_start")).otherwise(own)
    shard = F.floor(begin.cast("double") * shards / max(n_bytes, 1))
    ranked = saved(
        lines.select(
            "key_value",
            "size",
            "text_crc32",
            F.least(shard, F.lit(shards - 1)).cast("int").alias("shard"),
            (F.col("rank") + F.col("i")).alias("rank"),
        )
    )
    first = ranked.groupBy("shard").agg(F.min("rank").alias("first"))  # one row a shard
    slots = ranked.join(F.broadcast(first), "shard")
    slot = (F.col("rank") - F.col("first")).alias("slot")
    return slots.select("key_value", "size", "text_crc32", "shard", slot)
