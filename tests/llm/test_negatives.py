import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registryloom.llm import negatives
from registryloom.llm.negatives import Coded, Coder, Estimates

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("rank", T.StringType()),
        T.StructField("words", T.StringType()),
    ]
)


def brute(rows, step, positives=5, count=10, low=30, high=90):
    held = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in v]
        if sum(x * x for x in whole) >= 2**62:
            continue
        held[i] = min(held.get(i, (label, whole)), (label, whole))
    sizes = [len(v) for _, v in held.values()]
    size = min(set(sizes), key=lambda n: (-sizes.count(n), n)) if sizes else 0
    held = {i: x for i, x in held.items() if len(x[1]) == size}
    out = []
    for a, (label, v) in held.items():
        if a % step:
            continue
        points = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in held.items()}
        order = sorted(points, key=lambda i: (-points[i], i))
        for p in [i for i in order if i != a and held[i][0] == label][:positives]:
            fits = [
                i for i in order if held[i][0] != label and low * points[p] <= 100 * points[i] <= high * points[p]
            ]
            out += [(a, p, r, n, points[p], points[n]) for r, n in enumerate(fits[:count], 1)]
    return sorted(out)


def mined(spark, rows, step, **options):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)
    out = negatives.mine(df, F.col("id") % step == 0, **options)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert out.columns == columns
    return sorted(map(tuple, out.collect()))


def drawn(n, size, labels, seed, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((labels, size))
    rows = []
    for i in range(n):
        label = int(rng.integers(labels))
        rows.append((i, (0.3 * centres[label] + spread * rng.standard_normal(size)).tolist(), label))
    return rows


@pytest.mark.parametrize("size", [3, 20, 64])
def test_equals_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(negatives, "LEAST_STRIP", 200)
    monkeypatch.setattr(negatives, "ANCHORS", 30)
    rows = drawn(900, size, 4, size)
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_odd_rows(spark):
    rows = drawn(120, 5, 3, 1)
    nan, inf = float("nan"), float("inf")
    rows += [
        (None, [1.0] * 5, 1),
        (200, None, 1),
        (210, [1.0, None, 0.0, 0.0, 0.0], 1),
        (220, [1.0, nan, 0.0, 0.0, 0.0], 1),
        (230, [inf, 0.0, 0.0, 0.0, 0.0], 1),
        (240, [1.0] * 5, None),
        (250, [1.0] * 3, 1),
        (260, [], 1),
        (270, [3e30, 0.0, 0.0, 0.0, 0.0], 1),
        (280, [0.0] * 5, 1),
        (290, [1e5, -1e5, 0.0, 3.0, 1.0], 2),
        (291, [1e5, -1e5, 0.0, 3.0, 1.0], 2),
        (292, [5e4, -5e4, 0.0, 3.0, 1.0], 1),
        (300, [0.5] * 5, 99),
    ]
    rows += [(i, [0.25, 0.5, 0.125, -0.25, 1.0], i % 3) for i in range(400, 460)]  # ties
    rows += rows[:7] + [(3, [0.5] * 5, 0), (10, [0.25] * 5, 7)]
    assert mined(spark, rows, 10) == brute(rows, 10)
    assert mined(spark, rows, 10, positives=2, negatives=3, low=50, high=100) == brute(rows, 10, 2, 3, 50, 100)


def test_empty_and_alone(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(0, [1.0, 2.0], 1)], 10) == []
    assert mined(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)], 10) == []
    assert mined(spark, [(0, [], 1), (10, [], 1)], 10) == []
    assert mined(spark, [(1, [1.0, 2.0], 1)], 10) == []


def test_intervals_are_certain_and_help():
    rng = np.random.default_rng(0)
    x = np.floor(40 * rng.standard_normal((3000, 64)))
    x[0], x[1] = 0, x[2]
    coder = Coder.of(64)
    words, align, beside, scale = coder.encode(x)
    held = Coded(np.arange(len(x)), np.zeros(len(x)), x, words, align, beside, scale)
    low, high = Estimates(coder, x[:50]).intervals(held)
    exact = x[:50] @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    norms = np.sqrt((x**2).sum(1))
    assert np.median((high - low)[1:, 3:] / (norms[1:50, None] * norms[None, 3:])) < 1


def test_few_vectors_are_scored():
    """Once the best are known, many rows go by their codes alone."""
    rows = drawn(6000, 64, 10, 3)
    x = np.floor(256 * np.array([r[1] for r in rows]))
    labels = np.array([r[2] for r in rows])
    coder = Coder.of(64)
    held = Coded(np.arange(len(x)), labels, x, *coder.encode(x))
    searcher = negatives.Positives(coder, held.at(slice(0, 20)), 5)
    searcher.meet(held.at(slice(0, 1000)))
    pairs = sum(int((labels[1000:] == k).sum()) for k in labels[:20])
    assert searcher.meet(held.at(slice(1000, 6000))) < 0.8 * pairs


def test_hot_vector_and_label(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAST_STRIP", 100)
    rng = random.Random(5)
    same = [rng.uniform(-1, 1) for _ in range(8)]
    rows = [(i, same if i % 3 else [rng.uniform(-1, 1) for _ in range(8)], 0 if i % 2 else i % 5) for i in range(500)]
    assert mined(spark, rows, 20) == brute(rows, 20)
