import numpy as np
import pytest
from pyspark.sql import functions as F

from registryloom.llm import nearest

KIND = "vec_id long, embedding array<float>, score string"


def brute(vectors, queries, k):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], float)
    out = {}
    for q in queries:
        s = (x * np.array(vectors[q], float)).sum(1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), s[i]) for i in order]
    return out


def run(spark, rows, k=20, every=20):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], KIND)
    got = {}
    for r in nearest.search(df, F.col("id") % every == 0, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def floats(rng, n, size):
    return [[float(np.float32(x)) for x in v] for v in rng.standard_normal((n, size))]


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    vectors = dict(enumerate(floats(rng, 300, 12)))
    vectors[41] = vectors[42] = vectors[40]
    want = brute(vectors, [i for i in vectors if i % 20 == 0], 20)
    got = run(spark, list(vectors.items()))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in got for a, b in zip(got[q], want[q]))


def test_lists_reach_the_recall(spark):
    rng = np.random.default_rng(2)
    vectors = dict(enumerate(floats(rng, 6000, 24)))
    hot = vectors[0]
    vectors |= {i: [x + 0.01 * rng.random() for x in hot] for i in range(3000, 5000)}
    vectors = {i: [float(np.float32(x)) for x in v] for i, v in vectors.items()}
    want = brute(vectors, [i for i in vectors if i % 60 == 0], 20)
    got = run(spark, list(vectors.items()), every=60)
    found = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert set(got) == set(want) and found >= 0.9


def test_low_ids_alike_do_not_set_the_probes(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((6000, 24))
    vectors[:600] = vectors[0] + 0.01 * rng.standard_normal((600, 24))
    vectors = {i: [float(np.float32(x)) for x in v] for i, v in enumerate(vectors)}
    want = brute(vectors, [i for i in vectors if i % 60 == 0 and i >= 600], 20)
    got = run(spark, list(vectors.items()), every=60)
    found = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert found >= 0.9


def test_scan_drops_far_candidates_without_losing_near_ones():
    rng = np.random.default_rng(3)
    c, q = rng.standard_normal((2000, 64)), rng.standard_normal((40, 64))
    rotation = np.linalg.qr(rng.standard_normal((65, 65)))[0]
    index = nearest.Index(float(np.linalg.norm(c, axis=1).max()), rotation, np.zeros((1, 65)), 1)
    alive = nearest.scan(index, q, c, 10)
    top = np.argsort(-(q @ c.T), axis=1)[:, :10]
    assert np.mean([np.isin(t, a).mean() for t, a in zip(top, alive)]) > 0.97
    assert np.mean([len(a) for a in alive]) < 700


def test_scan_leaves_the_nearest_alone_and_all_that_are_alike():
    rng = np.random.default_rng(6)
    c, q = rng.standard_normal((2000, 64)), rng.standard_normal((150, 64))
    longest = 3 * c[7]
    c[100:140] = longest
    q[3] = longest
    rotation = np.linalg.qr(rng.standard_normal((65, 65)))[0]
    index = nearest.Index(float(np.linalg.norm(c, axis=1).max()), rotation, np.zeros((1, 65)), 1)
    alive = nearest.scan(index, q, c, 10)
    assert set(range(100, 140)) <= set(alive[3])
    others = [a for i, a in enumerate(alive) if not np.isin(a, range(100, 140)).any()]
    assert others and all(len(a) == 10 for a in others)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_and_odd_vectors(spark, n):
    rows = [(20 * i, [1.0 + i, 2.0]) for i in range(n)]
    odd = [
        (None, [1.0, 1.0]), (100, None), (120, [0.0, 0.0]), (140, [1.0, None]),
        (160, [float("nan"), 1.0]), (180, [float("inf"), 1.0]), (200, []),
    ]
    got = run(spark, rows + odd + rows)
    want = brute(dict(rows), [i for i, _ in rows], 20)
    assert got == {q: v for q, v in want.items() if v}
