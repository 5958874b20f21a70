"""Hard negatives by integer inner products, found through rotated one-bit codes.

A vector x is rotated into a few times as many dimensions, and the signs there are its code. The
code stands for a unit vector c; with x come its alignment a = <x, c> and what is left of its
length beside c. For an anchor q, bit counts give an estimate of <q, c>, and by Cauchy and Schwarz
    <q, x> = a <q, c> +- |q beside c| * |x beside c|.
That interval is certain. Only vectors whose interval reaches what is wanted are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registryloom.llm.common import saved
from registryloom.llm.words import flat_lists, list_array

#: Bits of a code for each component, and bits of each number of an anchor in the estimates.
BITS_PER_COMPONENT, ANCHOR_BITS = 8, 6
#: Anchors that meet the rows of one strip together, about, and of them in one step.
ANCHORS, STEP = 8_192, 64
#: Rows of a strip: a part of all rows between these bounds.
STRIP_SHARE, LEAST_STRIP, MOST_STRIP = 64, 4_096, 262_144
#: Rows that are estimated at once.
ROWS = 4_096
#: Integer vectors must be shorter, so that every score fits a long.
MOST_NORM = 2.0**31
SEED = 12
_EXACT = 2.0**53


@dataclass(frozen=True)
class Coder:
    """Codes of integer vectors; ``frame`` has orthonormal columns, so it keeps inner products."""

    frame: np.ndarray

    @classmethod
    def of(cls, size: int) -> Coder:
        bits = -(-size * BITS_PER_COMPONENT // 64) * 64
        drawn = np.random.default_rng(SEED).standard_normal((bits, max(size, 1)))
        return cls(np.linalg.qr(drawn)[0][:, :size])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code words, alignment, length beside the code's direction, and the direction's scale."""
        positive = x @ self.frame.T >= 0
        words = np.packbits(positive, axis=1, bitorder="little").view(np.uint64)
        direction = np.where(positive, 1.0, -1.0) @ self.frame
        length = np.sqrt((direction**2).sum(1))
        scale = 1 / np.maximum(length, 1e-300)
        align = (x * direction).sum(1) * scale
        return words, align, np.sqrt(np.maximum((x**2).sum(1) - align**2, 0)), scale


@dataclass(frozen=True)
class Coded:
    """Vectors with their codes."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    words: np.ndarray
    align: np.ndarray
    beside: np.ndarray
    scale: np.ndarray

    def at(self, rows: np.ndarray | slice) -> Coded:
        return Coded(*(getattr(self, f)[rows] for f in self.__dataclass_fields__))


class Estimates:
    """Intervals of the inner products of some anchors with coded vectors."""

    def __init__(self, coder: Coder, anchors: np.ndarray):
        turned = anchors @ coder.frame.T
        low, high = turned.min(1, initial=np.inf), turned.max(1, initial=-np.inf)
        self.low, self.step = low, np.maximum((high - low) / (2**ANCHOR_BITS - 1), 1e-300)
        whole = np.rint((turned - low[:, None]) / self.step[:, None]).astype(np.uint8)
        rounded = low[:, None] + self.step[:, None] * whole
        self.total = rounded.sum(1)
        self.error = np.abs(turned - rounded).sum(1)  # the most by which a sum over signs is off
        self.norm = np.sqrt((anchors**2).sum(1))
        planes = [np.packbits((whole >> j) & 1, axis=1, bitorder="little") for j in range(ANCHOR_BITS)]
        self.planes = [np.ascontiguousarray(p).view(np.uint64) for p in planes]

    def intervals(self, held: Coded) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds, a row an anchor."""
        shape = len(self.norm), len(held.ids)
        weighted, ones = np.zeros(shape, np.int32), np.zeros(len(held.ids), np.int32)
        for w in range(held.words.shape[1]):
            column = held.words[:, w]
            ones += np.bitwise_count(column)
            for j, plane in enumerate(self.planes):
                weighted += np.bitwise_count(plane[:, w, None] & column).astype(np.int32) << j
        sums = 2 * (self.low[:, None] * ones + self.step[:, None] * weighted) - self.total[:, None]
        along = sums * held.scale
        off = self.error[:, None] * held.scale
        surely = np.maximum(np.abs(along) - off, 0)
        across = np.sqrt(np.maximum(self.norm[:, None] ** 2 - surely**2, 0)) * held.beside
        middle = along * held.align
        length = np.sqrt(held.align**2 + held.beside**2)
        half = off * np.abs(held.align) + across + 1e-9 * (self.norm[:, None] * length + 1)
        return middle - half, middle + half


def scores(vectors: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point where no sum can leave its whole numbers."""
    most = np.sqrt((vectors**2).sum(1).max(initial=0) * (anchor**2).sum())
    if most < _EXACT:
        return (vectors @ anchor).astype(np.int64)
    return vectors.astype(np.int64) @ anchor.astype(np.int64)


def _best(ids: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -points))[:k]
    return ids[order], points[order]


class Positives:
    """The best vectors of the anchors' own labels."""

    def __init__(self, coder: Coder, anchors: Coded, k: int):
        self.coder, self.anchors, self.k = coder, anchors, k
        none = np.empty(0, np.int64)
        self.best = [(none, none)] * len(anchors.ids)

    def meet(self, rows: Coded) -> int:
        """Take in rows; how many pairs were scored."""
        scored = 0
        for label in np.intersect1d(self.anchors.labels, rows.labels):
            mine, held = np.flatnonzero(self.anchors.labels == label), rows.at(rows.labels == label)
            for i in range(0, len(mine), STEP):
                scored += self._meet(mine[i : i + STEP], held)
        return scored

    def _meet(self, mine: np.ndarray, held: Coded) -> int:
        scored = 0
        _, high = Estimates(self.coder, self.anchors.vectors[mine]).intervals(held)
        for a, upper in zip(mine, high):
            ids, points = self.best[a]
            needed = points[-1] if len(points) == self.k else -np.inf
            near = np.flatnonzero((upper >= needed) & (held.ids != self.anchors.ids[a]))
            new = scores(held.vectors[near], self.anchors.vectors[a])
            scored += len(near)
            self.best[a] = _best(np.concatenate([ids, held.ids[near]]), np.concatenate([points, new]), self.k)
        return scored

    def found(self) -> list[tuple[int, int, int, int, int]]:
        """``anchor_id, own place, positive_id, positive_score``, with nothing behind them."""
        return [
            (int(a), 0, 0, int(i), int(s))
            for a, (ids, points) in zip(self.anchors.ids, self.best)
            for i, s in zip(ids, points)
        ]


class Negatives:
    """The best vectors of other labels within the window of each positive's score."""

    def __init__(self, coder: Coder, anchors: Coded, positives: list[list[tuple[int, int]]], k: int, low: int, high: int):
        self.coder, self.anchors, self.k = coder, anchors, k
        none = np.empty(0, np.int64)
        # Whole numbers n with low * p <= 100 n <= high * p.
        self.windows = [
            [(i, p, -(-low * p // 100), high * p // 100) for i, p in own if -(-low * p // 100) <= high * p // 100]
            for own in positives
        ]
        self.best = [[(none, none)] * len(w) for w in self.windows]

    def meet(self, rows: Coded) -> int:
        """Take in rows; how many pairs were scored."""
        scored = 0
        mine = np.array([a for a, w in enumerate(self.windows) if w], np.int64)
        for i in range(0, len(mine), STEP):
            part = mine[i : i + STEP]
            low, high = Estimates(self.coder, self.anchors.vectors[part]).intervals(rows)
            for a, lower, upper in zip(part, low, high):
                scored += self._meet(a, lower, upper, rows)
        return scored

    def _meet(self, a: int, lower: np.ndarray, upper: np.ndarray, rows: Coded) -> int:
        windows, best = self.windows[a], self.best[a]
        least = [max(w[2], b[1][-1]) if len(b[1]) == self.k else w[2] for w, b in zip(windows, best)]
        reach = (upper >= min(least)) & (lower <= max(w[3] for w in windows))
        near = np.flatnonzero(reach & (rows.labels != self.anchors.labels[a]))
        new, ids = scores(rows.vectors[near], self.anchors.vectors[a]), rows.ids[near]
        for n, (_, _, low, high) in enumerate(windows):
            fits = (new >= max(low, least[n])) & (new <= high)
            if fits.any():
                held = best[n]
                best[n] = _best(np.concatenate([held[0], ids[fits]]), np.concatenate([held[1], new[fits]]), self.k)
        return len(near)

    def found(self) -> list[tuple[int, int, int, int, int]]:
        """``anchor_id, positive_id, positive_score, negative_id, negative_score``."""
        return [
            (int(a), w[0], w[1], int(i), int(s))
            for a, windows, best in zip(self.anchors.ids, self.windows, self.best)
            for w, (ids, points) in zip(windows, best)
            for i, s in zip(ids, points)
        ]


_CODED = "id bigint, label bigint, vector array<bigint>, words array<bigint>, align double, beside double, scale double"


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", unit: int = 256) -> DataFrame:
    """``id, label, vector`` with components ``floor(unit * x)``, one row an id.

    Left out: null ids, labels and vectors, null or non-finite components, vectors of another
    length than the most frequent one, and those too long for scores to fit a long. Of several
    rows of one id the one with the smallest label and then vector stays.
    """
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (F.abs(x) * unit + 1) ** 2))
    rows = vectors.select(
        F.col(key).cast("bigint").alias("id"),
        F.col(label).cast("bigint").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    )
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & fine & (norm < MOST_NORM))
    whole = F.transform(v, lambda x: F.floor(x * unit).cast("bigint"))
    one = rows.groupBy("id").agg(F.min(F.struct("label", whole.alias("vector"))).alias("row"))
    kept = saved(one.select("id", "row.label", "row.vector"))
    lengths = kept.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return kept.filter(F.size("vector") == (lengths["n"] if lengths else 0))


def with_codes(rows: DataFrame, coder: Coder) -> DataFrame:
    """The rows of ``usable`` with code words, alignment and the rest of ``_CODED``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, _ = flat_lists(batch.column("vector"), np.float64)
            words, align, beside, scale = coder.encode(flat.reshape(len(batch), -1))
            ends = np.arange(len(batch) + 1) * words.shape[1]
            columns = [batch.column(c) for c in ("id", "label", "vector")]
            columns += [list_array(words.view(np.int64).ravel(), ends), *map(pa.array, (align, beside, scale))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "vector", "words", "align", "beside", "scale"])

    return rows.mapInArrow(run, _CODED)


def _coded(batch: pa.RecordBatch) -> Coded:
    n = len(batch)
    numbers = [batch.column(c).to_numpy() for c in ("id", "label", "align", "beside", "scale")]
    vectors = flat_lists(batch.column("vector"), np.float64)[0].reshape(n, -1)
    words = flat_lists(batch.column("words"), np.int64)[0].view(np.uint64).reshape(n, -1)
    return Coded(numbers[0], numbers[1], vectors, words, *numbers[2:])


def _strips(n_rows: int) -> int:
    strip = min(max(n_rows // STRIP_SHARE, LEAST_STRIP), MOST_STRIP)
    return max(1, -(-n_rows // strip))


def _meet(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, search) -> DataFrame:
    """Every group of anchors meets every strip of rows in one task; ``search`` says what it keeps.

    A task holds one group of anchors and reads the strip in pieces, so its memory is bounded
    whatever the strip holds. Groups and strips are dealt by a hash of the id.
    """
    groups, strips = max(1, -(-n_anchors // ANCHORS)), _strips(n_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    columns = [*rows.columns, "positives", "points", "group", "strip", "asks"]
    none = F.array().cast("array<bigint>")
    held = rows.withColumns({"positives": none, "points": none, "strip": dealt(strips, "strip"), "asks": F.lit(1)})
    asked = anchors.withColumns({"group": dealt(groups, "group"), "asks": F.lit(0)}).withColumn("strip", every(strips))
    both = asked.select(columns).unionByName(held.withColumn("group", every(groups)).select(columns))
    cells = both.repartition(min(2 * groups * strips, 8_192), "group", "strip")
    cells = cells.sortWithinPartitions("group", "strip", "asks", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor_id", "positive_id", "positive_score", "other_id", "other_score"]

        def ended(searcher) -> pa.RecordBatch:
            found = np.array(searcher.found(), np.int64).reshape(-1, len(names))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in found.T], names)

        cell, asking, searcher = None, [], None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in ("group", "strip", "asks")], 1)
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(batch)]):
                *here, kind = place[a].tolist()
                if here != cell:
                    if searcher:
                        yield ended(searcher)
                    cell, asking, searcher = here, [], None
                if kind == 0:
                    asking.append(batch.slice(a, b - a))
                elif asking or searcher:
                    if searcher is None:
                        searcher, asking = search(pa.Table.from_batches(asking).combine_chunks().to_batches()[0]), []
                    for i in range(a, b, ROWS):
                        searcher.meet(_coded(batch.slice(i, min(ROWS, b - i))))
        if searcher:
            yield ended(searcher)

    return cells.mapInArrow(run, "anchor_id bigint, positive_id bigint, positive_score bigint, other_id bigint, other_score bigint")


def _ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    best = Window.partitionBy(*by).orderBy(F.desc("other_score"), "other_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` tells on ``id`` which rows ask. An anchor's positives are the best other rows of
    its label; for each, the negatives are the best rows of other labels whose score is from
    ``low`` to ``high`` percent of the positive's. Scores are integer inner products of the vectors
    that ``usable`` describes, which also tells the rows that take no part; equal scores rank by
    id. Anchors without positives, and positives without negatives, have no rows; other columns
    are ignored, an empty table gives no rows.
    """
    rows = usable(vectors, key, vector, label)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    n_rows, n_anchors, size = rows.agg(F.count(F.lit(1)), F.count_if(is_anchor), F.max(F.size("vector"))).first()
    if not n_anchors or not size:
        return vectors.sparkSession.createDataFrame([], empty)
    coder = Coder.of(size)
    coded = saved(with_codes(rows, coder))
    asked = coded.filter(is_anchor)
    none = F.array().cast("array<bigint>")

    def best_of_label(batch: pa.RecordBatch) -> Positives:
        return Positives(coder, _coded(batch), positives)

    def best_of_others(batch: pa.RecordBatch) -> Negatives:
        ids, points = (batch.column(c).to_pylist() for c in ("positives", "points"))
        pairs = [list(zip(i, p)) for i, p in zip(ids, points)]
        return Negatives(coder, _coded(batch), pairs, negatives, low, high)

    blank = asked.withColumns({"positives": none, "points": none})
    found = _ranked(_meet(coded, blank, n_rows, n_anchors, best_of_label), positives, "anchor_id")
    held = found.groupBy("anchor_id").agg(F.collect_list(F.struct("other_id", "other_score")).alias("held"))
    held = held.select(
        F.col("anchor_id").alias("id"), F.col("held.other_id").alias("positives"), F.col("held.other_score").alias("points")
    )
    ready = saved(asked.join(held, "id"))
    met = _meet(coded, ready, n_rows, n_anchors, best_of_others)
    ranked = _ranked(met, negatives, "anchor_id", "positive_id")
    return ranked.select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("other_id").alias("negative_id"),
        "positive_score",
        F.col("other_score").alias("negative_score"),
    )
