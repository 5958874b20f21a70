"""Toxic text by non-negative positive-unlabelled learning.

Confirmed toxic texts are positives; all other training text counts as unlabelled, a blend of both
classes whose share of positives, the class prior, is known. The risk estimator takes the
positives' part out of the unlabelled loss, and a step that would push the rest below zero is
turned back, so that a flexible model cannot overfit by calling every unlabelled text negative.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registryloom.llm.common import saved, small_batches
from registryloom.llm.words import Words, mixed, word_chunks

#: Texts that the weights are fitted to, about: samples by hash of the id. They bound what the driver
#: gathers. What tells features apart, how many texts have each, is counted over all texts.
MAX_POSITIVE, MAX_UNLABELLED = 3_000, 12_000
#: Features that are counted over all texts: those that lean most to the positives on the samples.
CANDIDATES = 65_536
#: Kept features: those that most surely lean to the positives.
FEATURES = 4_096
#: A feature must lean this far, in the log likelihood ratio, and be in so many positive texts.
MIN_EVIDENCE, MIN_TEXTS = 5.0, 3
#: Words count whole and by their first bytes, so inflected forms share a base; a base makes one
#: feature for each of these numbers of times that a text has it at least.
PREFIXES = (4, 5, 6)
TIMES = (1, 2, 3, 5)
EPOCHS, RATE, DECAY, BETA = 400, 0.1, 1e-4, 0.0


def _bases(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words and the 64-bit hashes of their bases, one kind of base after the other."""
    yield np.arange(len(words.hashes)), words.hashes
    for n in PREFIXES:
        at, prefix = words.prefixes(n)
        yield at, mixed(prefix + np.uint64(n))


def text_features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(text, base)`` pairs and how often each occurs."""
    owner = words.owners()
    found = [(owner[at], hashes) for at, hashes in _bases(words)]
    owners, hashes = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((hashes, owners))
    owners, hashes = owners[order], hashes[order]
    new = np.ones(len(owners), bool)
    new[1:] = (owners[1:] != owners[:-1]) | (hashes[1:] != hashes[:-1])
    begin = np.flatnonzero(new)
    return owners[begin], hashes[begin], np.diff(np.append(begin, len(owners)))


@dataclass(frozen=True)
class Features:
    """Chosen features: sorted bases, and for each base and number of times the feature's place."""

    bases: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, base: np.ndarray, level: np.ndarray) -> Features:
        bases, row = np.unique(base, return_inverse=True)
        places = np.full((len(bases), len(TIMES)), -1, np.int64)
        places[row, level] = np.arange(len(base))
        return cls(bases, places)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """``(text, feature)`` pairs, by text; a first, small table spares most words the search."""
        if not len(self.bases):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        table = np.zeros(1 << 16, bool)
        table[self.bases & np.uint64(0xFFFF)] = True
        owner, pairs = words.owners(), []
        for at, hashes in _bases(words):
            likely = np.flatnonzero(table[hashes & np.uint64(0xFFFF)])
            row = np.minimum(np.searchsorted(self.bases, hashes[likely]), len(self.bases) - 1)
            hit = self.bases[row] == hashes[likely]
            pairs.append(owner[at[likely[hit]]] * len(self.bases) + row[hit])
        pair, times = np.unique(np.concatenate(pairs), return_counts=True)
        owners, rows = pair // len(self.bases), pair % len(self.bases)
        found = [(owners[times >= t], self.places[rows[times >= t], i]) for i, t in enumerate(TIMES)]
        owners, places = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(owners, kind="stable")
        order = order[places[order] >= 0]
        return owners[order], places[order]


@dataclass(frozen=True)
class Model:
    """A linear model over the presence of features."""

    features: Features
    weights: np.ndarray
    bias: float

    def scores(self, words: Words) -> np.ndarray:
        n = len(words.first) - 1
        owners, places = self.features.find(words)
        margin = np.full(n, self.bias)
        if len(owners):
            margin += np.bincount(owners, self.weights[places], n)
        return 1 / (1 + np.exp(-margin))


def train(
    owners: np.ndarray, places: np.ndarray, positive: np.ndarray, prior: float, scale: np.ndarray
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss.

    ``owners, places`` are the features that each text has; ``positive`` tells the confirmed
    positives from the unlabelled texts. A feature's ``scale`` is its size where a text has it:
    larger ones are learnt first, smaller ones bear more of the weight decay.
    """
    n, n_features, held = len(positive), len(scale), scale[places]
    w, b = np.zeros(n_features), 0.0
    share = np.where(positive, 1 / max(positive.sum(), 1), 1 / max((~positive).sum(), 1))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, EPOCHS + 1):
        g = b + np.bincount(owners, w[places] * held, n)
        p = 1 / (1 + np.exp(-g))
        as_negative = np.logaddexp(0, g)
        rest = (as_negative * share)[~positive].sum() - prior * (as_negative * share)[positive].sum()
        if rest >= -BETA:
            slope = np.where(positive, prior * (p - 1) - prior * p, p) * share
        else:  # turn back the part that has fallen below zero
            slope = np.where(positive, prior * p, -p) * share
        grad = np.append(np.bincount(places, slope[owners] * held, n_features) + DECAY * w, slope.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w * scale, float(b)


def _evidence(n_pos: int, n_all: int):
    """Log likelihood ratio of a feature's share of the positives against its share of all texts."""
    p = F.col("pos") / n_pos
    q = (F.col("rest") + 0.5) / (n_all + 1)
    blend = (F.col("pos") + F.col("rest") + 0.5) / (n_pos + n_all + 1)
    term = lambda k, n, x, y: k * F.log(x / y) + F.when(n > k, (n - k) * F.log((1 - x) / (1 - y))).otherwise(0.0)
    both = term(F.col("pos"), F.lit(n_pos), p, blend) + term(F.col("rest") + 0.5, F.lit(n_all + 1), q, blend)
    return F.when(p > q, both).otherwise(0.0)


def fit(texts: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """A model from ``texts`` and their ``labels(doc_id, toxic)``.

    Texts whose label is 1 are positives, all texts are unlabelled; labels of 0 serve for the class
    prior alone, the share of 1 among the labelled texts. Features are chosen by how many of all
    texts have them; the weights are fitted to samples, in which equal texts count once.
    Without positives the model gives every text a score near 0.
    """
    said = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    said = said.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = small_batches(texts).select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    spread = F.pmod(F.xxhash64(F.col("key"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    counts = said.join(rows.select("key"), F.col("doc_id") == F.col("key"), "left_semi")
    prior = counts.agg(F.avg("toxic"), F.sum("toxic")).first()
    n_pos, n = prior[1] or 0, rows.count()
    if not n_pos:
        return Model(Features.of(np.empty(0, np.uint64), np.empty(0, int)), np.empty(0), -5.0)

    ids = counts.filter(F.col("toxic") == 1).withColumnRenamed("doc_id", "key")
    ids = ids.filter(spread < MAX_POSITIVE / n_pos).select("key")  # about MAX_POSITIVE rows at most
    positive = rows.join(F.broadcast(ids), "key").select("text", F.lit(True).alias("positive"))
    unlabelled = rows.filter(spread < MAX_UNLABELLED / n).select("text", F.lit(False).alias("positive"))
    sample = saved(positive.unionByName(unlabelled).dropDuplicates(["text", "positive"]))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in word_chunks(batches):
            owners, hashes, times = text_features(words)
            of_positive = batch.column("positive").to_numpy(zero_copy_only=False)
            for level, least in enumerate(TIMES):
                held = times >= least
                bases, at = np.unique(hashes[held], return_inverse=True)
                pos = np.bincount(at, of_positive[owners[held]], len(bases)).astype(np.int64)
                rest = np.bincount(at, minlength=len(bases)) - pos
                columns = [bases.view(np.int64), np.full(len(bases), level, np.int32), pos, rest]
                names = ["base", "level", "pos", "rest"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    sizes = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    held = sample.mapInArrow(counted, "base bigint, level int, pos bigint, rest bigint")
    held = held.groupBy("base", "level").agg(F.sum("pos").alias("pos"), F.sum("rest").alias("rest"))
    held = held.filter(F.col("pos") >= MIN_TEXTS)
    held = held.withColumn("evidence", _evidence(sizes.get(True, 1), sizes.get(False, 0)))
    likely = held.orderBy(F.desc("evidence"), "base", "level").limit(CANDIDATES).filter(F.col("evidence") > 0)
    best = _counted_in_all(rows, likely.select("base", "level", "pos").toArrow())
    best = best.withColumn("evidence", _evidence(sizes.get(True, 1), n)).filter(F.col("evidence") >= MIN_EVIDENCE)
    best = best.orderBy(F.desc("evidence"), "base", "level").limit(FEATURES).toPandas()
    features = Features.of(best["base"].to_numpy(np.int64).view(np.uint64), best["level"].to_numpy(int))
    scale = np.sqrt(best["evidence"].to_numpy(float) / max(best["evidence"].max(), 1e-9))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in word_chunks(batches):
            owners, places = features.find(words)
            own = np.split(places, np.searchsorted(owners, np.arange(1, len(batch))))
            lists = pa.array([p.tolist() for p in own], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("positive"), lists], ["positive", "places"])

    drawn = sample.mapInArrow(placed, "positive boolean, places array<int>").toPandas()
    drawn = drawn.sort_values("positive", key=lambda c: ~c, kind="stable")
    lengths = drawn["places"].map(len).to_numpy()
    owners = np.repeat(np.arange(len(drawn)), lengths)
    places = np.concatenate([np.empty(0, np.int64), *drawn["places"]]).astype(np.int64)
    weights, bias = train(owners, places, drawn["positive"].to_numpy(bool), float(prior[0]), scale)
    return Model(features, weights, bias)


def _counted_in_all(rows: DataFrame, likely: pa.Table) -> DataFrame:
    """``base, level, pos, rest``: the candidates, and how many of all ``rows`` have each."""
    base, level, pos = (likely.column(c).to_numpy() for c in ("base", "level", "pos"))
    features = Features.of(base.view(np.uint64), level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(base), np.int64)
        for _, words in word_chunks(batches):
            total += np.bincount(features.find(words)[1], minlength=len(base))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "rest"])

    counted = rows.select("text").mapInArrow(run, "at int, rest bigint").groupBy("at").agg(F.sum("rest").alias("rest"))
    found = np.zeros(len(base), np.int64)
    for r in counted.collect():  # at most CANDIDATES rows
        found[r["at"]] = r["rest"]
    columns = [pa.array(x) for x in (base, level, pos, found)]
    return rows.sparkSession.createDataFrame(pa.table(columns, names=["base", "level", "pos", "rest"]))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score`` per row of ``docs``, from the whole text alone; a null text counts as empty.

    Null keys and repeated rows get scores like others, other columns are ignored, an empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in word_chunks(batches):
            columns = [batch.column("key"), pa.array(model.scores(words))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "score"])

    rows = small_batches(docs).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def clean_rows(docs: DataFrame, model: Model, limit: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in word_chunks(batches, text):
            yield batch.filter(pa.array(model.scores(words) < limit))

    return small_batches(docs).mapInArrow(run, docs.schema)
