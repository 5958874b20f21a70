import random
from collections import defaultdict

from conftest import plan_of
from pyspark.sql import functions as F

from registryloom.llm import mixing

from .conftest import sentence, words_of

WEIGHTS = (5, 2, 1)


def targets(sizes, share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return {**fixed, **{s: level * weight[s] for s in free}}
        fixed |= {s: most * sizes[s] for s in over}


def check(docs, make_docs):
    rows = mixing.mix(make_docs(docs), WEIGHTS).collect()
    assert len(rows) == len(docs)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for d in docs:
        sizes[d[3]] += len(words_of(d[1]))
    want = targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.taken == r.copies * r.size
        assert abs(r.target - want[r.source]) <= 1e-9 * max(1, want[r.source])
        assert r.copies <= 2
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6, s
    return rows


def test_words_come_near_their_targets(make_docs):
    rng = random.Random(3)
    sources = ["b", "a", "ä", "z", None, "hot"]
    docs = [(i, sentence(rng, rng.randrange(1, 60)), "en", rng.choice(sources + ["hot"] * 4)) for i in range(900)]
    first = check(docs, make_docs)
    again = mixing.mix(make_docs(docs[::-1]), WEIGHTS).collect()
    assert sorted(map(str, first)) == sorted(map(str, again)), "reruns agree"


def test_chances_keep_their_expectation(make_docs):
    """Over many sources alike, a record is taken as often as its source asks for."""
    docs = [(i, "w " * (1 + i % 7), "en", f"s{i % 80:02d}") for i in range(2400)]
    rows = check(docs, make_docs)
    one = [r for r in rows if 0 < r.target / r.source_size < 1]
    for size in range(1, 8):
        held = [r for r in one if r.size == size]
        got = sum(r.copies for r in held) / len(held)
        assert abs(got - sum(r.target / r.source_size for r in held) / len(held)) < 0.12


def test_odd_rows(make_docs, odd_texts):
    docs = [(i, t, "en", s) for (i, t), s in zip(odd_texts, [None, "a", "a", "b", "b", "", "c", "d", "d", None, "b"])]
    check(docs, make_docs)
    check([(1, "a b", "en", "s")] * 50 + [(2, None, "en", "t")], make_docs)
    assert mixing.mix(make_docs([]), WEIGHTS).count() == 0


def test_rows_are_repeated_whole(make_docs):
    docs = [(i, f"w{i} " * (i % 5), "en", "ab"[i % 2]) for i in range(60)] + [(7, "x y", "en", None)] * 3
    df = make_docs(docs)
    want = defaultdict(int)
    for r in mixing.mix(df, WEIGHTS).collect():
        want[r.doc_id, r.source] += r.copies
    out = mixing.repeat_rows(df, WEIGHTS)
    assert out.columns == df.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id, r.source] += 1
    assert got == {k: v for k, v in want.items() if v}


def test_running_sums_without_one_task_for_all(spark):
    rng = random.Random(9)
    rows = [(f"s{rng.randrange(10**6):06d}" if i else None, rng.randrange(50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "source string, size int").repartition(7)
    order = [F.col("source").asc_nulls_last(), F.col("size")]
    held = mixing._running(df, order, {"at": F.lit(1), "words": F.col("size")})
    total = n = 0
    for r in sorted(held.collect(), key=lambda r: (r.source is None, r.source or "", r.size, r.at)):
        assert (r.at, r.words) == (n, total)
        n, total = n + 1, total + r.size
    assert mixing._running(df.limit(0), order, {"at": F.lit(1)}).count() == 0


def test_many_sources_and_no_single_task(spark, make_docs):
    rng = random.Random(10)
    docs = [(i, "w " * rng.randrange(1, 30), "en", f"s{i % 400:03d}") for i in range(1200)]
    check(docs, make_docs)
    sizes = make_docs(docs).select("source", F.length("text").alias("size"))
    assert "SinglePartition" not in plan_of(mixing.source_targets(sizes, WEIGHTS, 1.5, 2.0))
