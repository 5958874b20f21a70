"""Approximate nearest neighbours by inner product, scanning few dimensions of most candidates.

Vectors get one more component that makes all of them equally long, so the largest inner product
is the smallest distance. A random rotation spreads each distance evenly over the dimensions, and
the part of it in the first dimensions then tells about the whole: candidates of a probed list are
scanned column block by column block, and a test drops those whose partial distance is too large
for them to be among the nearest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registryloom.llm.common import saved

#: Vectors that the lists are fitted to, about, and of them those that measure the probes needed.
SAMPLE, TRIALS = 20_000, 300
#: One list below this many vectors; beyond, a list for each root(n) / 4, up to the cap.
LEAST_FOR_LISTS, MAX_LISTS = 2_000, 1_024
#: Wanted share of the true neighbours inside the probed lists, on the sample.
LIST_RECALL = 0.975
#: Candidates and queries that meet in one task at most, about; larger lists come in blocks.
BLOCK, QUERIES = 2_048, 1_024
#: Columns scanned before each test, and the test's tolerance in standard deviations.
COLUMNS, TOLERANCE = 16, 2.5
#: Queries whose products with a block of columns are held at once.
TOGETHER = 128
SEED = 8


@dataclass(frozen=True)
class Index:
    """Where the lists lie, in rotated space, and how many of them a query needs."""

    norm: float
    rotation: np.ndarray
    centres: np.ndarray
    probes: int

    def rotated(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """With the component that evens out the lengths; queries need none."""
        rest = np.zeros(len(vectors)) if query else self.norm**2 - (vectors**2).sum(1)
        return np.column_stack([vectors, np.sqrt(np.maximum(rest, 0))]) @ self.rotation

    def order(self, rotated: np.ndarray) -> np.ndarray:
        """All lists from the nearest centre on, for each vector."""
        return np.argsort(_distances(rotated, self.centres), axis=1, kind="stable")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, vector`` of doubles: one row an id, without those that can take no part.

    Left out: null ids, null or zero vectors, null or non-finite components, and vectors of
    another length than the most frequent one. Of several vectors of one id the smallest stays.
    """
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector")
    )
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))
    kept = saved(rows.groupBy("id").agg(F.min("vector").alias("vector")))
    lengths = kept.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return kept.filter(F.size("vector") == (lengths["n"] if lengths else 0))


def fit(rows: DataFrame, k: int) -> tuple[Index, int] | None:
    """Lists and probes from a sample by hash of the id, and the number of rows; None without rows."""
    norm2 = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    n, most = rows.agg(F.count(F.lit(1)), F.max(norm2)).first()
    if not n:
        return None
    drawn = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) < int(SAMPLE / n * (1 << 30))
    sample = rows.filter(drawn).orderBy(F.xxhash64("id", F.lit("trial")), "id").select("vector").toPandas()["vector"]
    vectors = np.stack(sample) if len(sample) else np.stack([rows.first()["vector"]])
    rng = np.random.default_rng(SEED)
    size = vectors.shape[1] + 1
    rotation = np.linalg.qr(rng.standard_normal((size, size)))[0]
    index = Index(float(np.sqrt(most)), rotation, np.zeros((1, size)), 1)
    points = index.rotated(vectors)
    n_lists = 1 if n < LEAST_FOR_LISTS else int(min(MAX_LISTS, np.sqrt(n) / 4, len(points)))
    centres = points[rng.choice(len(points), n_lists, replace=False)]
    for _ in range(10):
        own = np.argmin(_distances(points, centres), axis=1)
        for i in np.unique(own):
            centres[i] = points[own == i].mean(0)
    index = Index(index.norm, rotation, centres, n_lists)
    return Index(index.norm, rotation, centres, _probes(index, vectors, points, k)), n


def _probes(index: Index, vectors: np.ndarray, points: np.ndarray, k: int) -> int:
    """Lists to probe so that ``LIST_RECALL`` of the true neighbours of the sample's first vectors lie
    in them; the sample comes in the order of a hash, so these are drawn from all."""
    trial = index.rotated(vectors[:TRIALS], query=True)
    far = _distances(trial, points)
    far[np.arange(len(trial)), np.arange(len(trial))] = np.inf
    nearest = np.argsort(far, axis=1)[:, : min(k, len(points) - 1)]
    place = np.argsort(index.order(trial), axis=1)
    held = np.argmin(_distances(points, index.centres), axis=1)[nearest]
    needed = np.sort(np.take_along_axis(place, held, axis=1).ravel()) + 1
    return int(needed[int(np.ceil(LIST_RECALL * len(needed))) - 1]) if len(needed) else 1


def _with_list(rows: DataFrame, index: Index) -> DataFrame:
    def assign(frames):
        for frame in frames:
            if len(frame):
                points = index.rotated(np.stack(frame["vector"]))
                frame["list"] = np.argmin(_distances(points, index.centres), axis=1)
                yield frame

    return rows.mapInPandas(assign, "id bigint, vector array<double>, list int")


def _with_probes(queries: DataFrame, index: Index, sizes: np.ndarray, least: int) -> DataFrame:
    """A row for each list that a query probes: enough lists to hold ``least`` vectors."""

    def probe(frames):
        for frame in frames:
            if len(frame):
                order = index.order(index.rotated(np.stack(frame["vector"]), query=True))
                enough = (np.cumsum(sizes[order], axis=1) < least).sum(1) + 1
                lists = [o[: max(index.probes, e)] for o, e in zip(order, enough)]
                yield frame.assign(list=lists).explode("list").astype({"list": "int32"})

    return queries.mapInPandas(probe, "id bigint, vector array<double>, list int")


def scan(index: Index, queries: np.ndarray, candidates: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the candidates that may be among its ``k`` nearest, by column blocks.

    After each block, a candidate goes whose partial distance, scaled to all dimensions, exceeds
    the k-th best distance known by more than chance allows. Of those that all blocks leave, the
    ``k`` nearest stay and what rounding cannot tell from the last of them.
    """
    q, c = index.rotated(queries, query=True), index.rotated(candidates)
    size = c.shape[1]
    cuts = [*range(0, max(size - COLUMNS, 0) + 1, COLUMNS)]
    blocks = list(zip(cuts, [*cuts[1:], size]))
    columns = [np.ascontiguousarray(c[:, a:b]) for a, b in blocks]
    lengths = [(held**2).sum(1) for held in columns]
    slack = 1e-9 * index.norm**2 + 1e-12  # far above what rounding does to distances
    out = []
    for begin in range(0, len(q), TOGETHER):
        some = q[begin : begin + TOGETHER]
        # While most candidates are left, one product for many queries is cheaper than their rows.
        whole = [some[:, a:b] @ held.T for (a, b), held in zip(blocks, columns)]
        own_lengths = np.column_stack([(some[:, a:b] ** 2).sum(1) for a, b in blocks])
        for i, own in enumerate(some):
            if len(c) <= 2 * k:
                out.append(np.arange(len(c)))
                continue
            alive, partial = None, np.zeros(len(c))
            for (a, b), held, length, at_own, products in zip(blocks, columns, lengths, own_lengths[i], whole):
                if alive is None:
                    near = products[i]
                elif 4 * len(alive) > len(c):
                    length, near = length.take(alive), products[i].take(alive)
                else:
                    length, near = length.take(alive), held.take(alive, axis=0) @ own[a:b]
                partial = partial + (length + at_own - 2 * near)
                if not a:
                    seeds = np.argpartition(partial, 2 * k)[: 2 * k]
                    best = np.partition(((c[seeds] - own) ** 2).sum(1), k - 1)[k - 1]
                bound = best * (1 + TOLERANCE / np.sqrt(b)) ** 2 if b < size else best
                keep = np.flatnonzero(partial * (size / b) <= bound + slack)
                if len(keep) < len(partial):
                    alive, partial = keep if alive is None else alive.take(keep), partial.take(keep)
            alive = np.arange(len(c)) if alive is None else alive
            if len(alive) > k:
                alive = alive[partial <= np.partition(partial, k - 1)[k - 1] + 2 * slack]
            out.append(alive)
    return out


def search(
    vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products found for each query.

    ``is_query`` tells on ``id`` which rows ask; every row but the query's own is a candidate.
    Scores are inner products of the given components in double precision; equal scores rank by
    id. With at most ``k`` candidates all are returned. Ids are whole numbers; rows that take no
    part are those that ``usable`` leaves out. Other columns are ignored; empty tables give no rows.
    """
    rows = usable(vectors, key, vector)
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = fit(rows, k)
    if fitted is None:
        return empty
    index, _ = fitted
    held = saved(_with_list(rows.select(F.col("id").cast("bigint").alias("id"), "vector"), index))
    sizes = np.zeros(len(index.centres), np.int64)
    for r in held.groupBy("list").count().collect():  # at most MAX_LISTS rows
        sizes[r["list"]] = r["count"]
    queries = saved(_with_probes(held.filter(is_query).select("id", "vector"), index, sizes, 10 * k))
    asked = np.zeros(len(sizes), np.int64)
    for r in queries.groupBy("list").count().collect():
        asked[r["list"]] = r["count"]

    spark = vectors.sparkSession
    plan = [(i, int(-(-a // BLOCK)), int(-(-b // QUERIES))) for i, (a, b) in enumerate(zip(sizes, asked)) if a and b]
    cuts = F.broadcast(spark.createDataFrame(plan, "list int, blocks int, asks int")) if plan else None
    if cuts is None:
        return empty
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    salted = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = held.join(cuts, "list").withColumn("block", salted("blocks")).withColumn("ask", every("asks"))
    right = queries.join(cuts, "list").withColumn("ask", salted("asks")).withColumn("block", every("blocks"))

    def meet(candidates: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found = {"query_id": [], "vec_id": [], "score": []}
        if len(candidates) and len(asking):
            c, q = np.stack(candidates["vector"]), np.stack(asking["vector"])
            ids, own = candidates["id"].to_numpy(), asking["id"].to_numpy()
            for me, mine, near in zip(own, q, scan(index, q, c, k + 1)):
                near = near[ids[near] != me]
                score = (c[near] * mine).sum(1)
                best = np.lexsort((ids[near], -score))[:k]
                found["query_id"].append(np.full(len(best), me))
                found["vec_id"].append(ids[near][best])
                found["score"].append(score[best])
        kinds = {"query_id": np.int64, "vec_id": np.int64, "score": float}
        return pd.DataFrame({n: np.concatenate([np.empty(0, t), *found[n]]).astype(t) for n, t in kinds.items()})

    keys = ["list", "block", "ask"]
    columns = [*keys, "id", "vector"]
    met = left.select(columns).groupBy(keys).cogroup(right.select(columns).groupBy(keys))
    pairs = met.applyInPandas(meet, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
