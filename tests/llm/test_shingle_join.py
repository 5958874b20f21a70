import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from registryloom.llm import shingle_join as sj
from registryloom.llm.words import word_chunks

from .conftest import sentence, words_of


def shingles(text):
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    label = {i: i for i, _ in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                i_, j_ = find(i), find(j)
                label[max(i_, j_)] = min(i_, j_)
    return sorted((i, len(s), find(i)) for i, s in sets)


def run(make_docs, docs):
    return sorted(tuple(r) for r in sj.near_duplicates(make_docs(docs)).collect())


def edited(rng, text, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def family(rng, size, words, share):
    base = sentence(rng, words)
    return [base] + [edited(rng, rng.choice([base]), share) for _ in range(size - 1)]


def test_families_passages_and_singles(make_docs):
    rng = random.Random(1)
    passage = sentence(rng, 60)
    texts = [sentence(rng, rng.randrange(1, 200)) for _ in range(60)]
    for size, words, share in ((2, 300, 0.01), (3, 60, 0.02), (4, 40, 0.03), (30, 120, 0.015), (12, 25, 0.03)):
        texts += family(rng, size, words, share)
    texts += [passage + " " + sentence(rng, rng.choice([3, 10, 100])) for _ in range(40)]
    texts += rng.choices(texts, k=20)
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    got = run(make_docs, docs)
    assert got == brute(docs)
    assert 20 < len({c for _, _, c in got}) < len(docs) - 40


def test_a_large_family_with_chains(make_docs, monkeypatch):
    """Copies of copies, so that most members are not similar to the first one."""
    rng = random.Random(2)
    monkeypatch.setattr(sj, "LOCAL_HOT", 8)
    monkeypatch.setattr(sj, "PARTNERS", 16)
    monkeypatch.setattr(sj, "LARGE", 10)
    monkeypatch.setattr(sj, "BLOCK", 9)
    texts = [sentence(rng, 80)]
    for _ in range(70):
        texts.append(edited(rng, rng.choice(texts[-12:]), 0.02))
    base = sentence(rng, 90)
    texts += [edited(rng, base, rng.choice([0.01, 0.04, 0.08])) for _ in range(60)]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    got = run(make_docs, docs)
    assert got == brute(docs)
    assert 5 < len({c for _, _, c in got}) < 120


def test_texts_joined_by_shuffle(make_docs, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(sj, "BROADCAST_IDS", 0)
    docs = list(enumerate(family(rng, 6, 90, 0.01) + family(rng, 2, 90, 0.01) + family(rng, 1, 9, 0)))
    assert run(make_docs, docs) == brute(docs)


def test_sizes_at_the_limit(make_docs):
    w = [f"w{i}" for i in range(40)]
    docs = [(n, " ".join(w[:n])) for n in range(1, 30)] + [(99, "W0  w1\tw2 w3\nw4")]
    assert run(make_docs, docs) == brute(docs)


def test_odd_texts(make_docs, odd_texts):
    known = [r for r in odd_texts if r[0] is not None]
    want = [*brute(known), (None, 1, None)]
    got = sj.near_duplicates(make_docs(odd_texts)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sj.near_duplicates(make_docs([])).count() == 0


def test_one_of_each_stays(make_docs, odd_texts):
    rng = random.Random(4)
    docs = list(enumerate(family(rng, 5, 90, 0.01) + [sentence(rng, 40)] * 3, 20)) + odd_texts
    df = make_docs(docs)
    kept = sj.first_of_each(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 2, 3, 4, 5, 6, 8, 20, 25, None], key=str)


def test_first_rows_of_repeated_and_missing_ids(make_docs):
    rng = random.Random(12)
    a, b, c = (sentence(rng, 40) for _ in range(3))
    rows = [(1, a), (1, b), (2, c), (None, c), (None, "all alone here"), (None, "all alone here"), (None, ""), (None, None)]
    kept = [sorted(map(str, sj.first_of_each(make_docs(some)).collect())) for some in (rows, rows[::-1], rows[3:] + rows[:3])]
    assert kept[0] == kept[1] == kept[2], "reruns agree"
    out = sj.first_of_each(make_docs(rows)).collect()
    assert sorted((r.doc_id for r in out), key=str) == sorted([1, 2, None, None, None], key=str)
    assert sorted(str(r.text) for r in out if r.doc_id is None) == ["", "None", "all alone here"]


@pytest.mark.parametrize("n", [5, 11, 12, 40, 200])
def test_frequent_pairs_are_certain_to_meet(n):
    """However a similar partner's shingles lie, it shares a pair."""
    rng = np.random.default_rng(n)
    least = (n * 80 + 99) // 100
    for _ in range(200):
        x = np.sort(rng.integers(0, 2**63, n, np.uint64))
        lost = rng.choice(n, n - least, replace=False)
        y = np.sort(np.concatenate([np.delete(x, lost), rng.integers(0, 2**63, rng.integers(0, n // 20 + 1), np.uint64)]))
        shared = n - len(lost)
        if 100 * shared < 80 * (n + len(y) - shared):
            continue
        need = lambda s: len(s) - (len(s) * 80 + 99) // 100 + 1
        a, b = (sj.pair_signatures(s, len(s), need(s)) for s in (x, y))
        assert np.isin(a, b).any()


def test_equal_groups_do_not_hide_members_in_whole_rows(spark, monkeypatch):
    """A signature that many texts of one flush share also meets texts of others through itself."""
    large, small = np.uint64(9 << 30), np.uint64(5 << 30)

    def by_size(sets, table):
        """All have one signature; text 1 of 10 shingles and text 100 of 20 also have a smaller one."""
        both = np.flatnonzero(np.isin(sets.n, (10, 20)))
        texts = np.concatenate([np.arange(len(sets.n)), both])
        return texts, np.repeat(np.array([large, small]), [len(sets.n), len(both)])

    monkeypatch.setattr(sj, "signatures", by_size)
    monkeypatch.setattr(sj, "LOCAL_HOT", 4)
    text = lambda i, n: " ".join(f"t{i}w{j}" for j in range(n + 4))
    one = [(i, text(i, 10 if i == 1 else 30 + i)) for i in range(1, 7)]
    row = lambda i, t: F.struct(F.lit(i).cast("bigint").alias("doc"), F.lit(t).alias("text"))
    first, second = F.array(*[row(*r) for r in one]), F.array(row(100, text(100, 20)))
    texts = spark.range(0, 2, 1, 2).select(F.inline(F.when(F.col("id") == 0, first).otherwise(second)))
    groups = sj.meeting_groups(texts, spark.sparkContext.broadcast(np.zeros(1, np.uint8)), 1).collect()
    assert {r.doc for r in groups if r.gid == int(large)} == {1, 2, 3, 4, 5, 6, 100}


def test_signatures_are_made_for_some_texts_at_once(monkeypatch):
    rng = np.random.default_rng(8)
    sizes = rng.integers(0, 60, 90)
    hashes = [np.sort(rng.integers(0, 2**63, n, np.uint64)) for n in sizes]
    sets = sj.Sets(np.concatenate(hashes), np.cumsum([0, *sizes]))
    table = rng.integers(0, 256, 1 << (sj.TABLE_BITS - 3), np.uint8)
    pairs = lambda found: sorted(zip(*(x.tolist() for x in found)))
    want, whole, seen = pairs(sj._signatures(sets, table)), sj._signatures, []
    monkeypatch.setattr(sj, "SIGN_SHINGLES", 200)
    monkeypatch.setattr(sj, "_signatures", lambda s, t: seen.append(len(s.hashes)) or whole(s, t))
    assert pairs(sj.signatures(sets, table)) == want
    assert sum(seen) == sizes.sum() and max(seen) < 200 + 60
    assert [len(x) for x in sj.signatures(sets.take(np.empty(0, int)), table)] == [0, 0]


def test_words_are_hashed_a_few_texts_at_once():
    texts = pa.RecordBatch.from_pydict({"text": ["one two " * 5_000] * 30})
    sizes = [int(words.end[-1]) for _, words in word_chunks(iter([texts]))]
    assert max(sizes) <= 300_000 and len(sizes) > 3
