import random
import zlib

import numpy as np
import pytest

from registryloom.llm import sharding


def check(rows, docs, shards, together=()):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in rows) == sorted(
        (d is None, d or 0, len((t or "").encode()) + 1) for d, t in docs
    )
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for held in by.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    crc = {zlib.crc32((t or "").encode()) for _, t in docs}
    assert {r.text_crc32 for r in rows} == crc
    return {s: sum(r.size for r in held) for s, held in by.items()}


def test_near_equal_bytes_and_whole_groups(make_docs):
    rng = random.Random(1)
    docs = [(i, "x" * rng.randrange(200) + str(i // 3)) for i in range(3000)]
    rows = sharding.range_shards(make_docs(docs), 8).collect()
    sizes = check(rows, docs, 8)
    assert len(sizes) == 8 and max(sizes.values()) <= 1.03 * min(sizes.values())
    again = sharding.range_shards(make_docs(docs[::-1]), 8).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)), "order does not matter"


def test_a_hot_text_is_divided(make_docs):
    docs = [(i, "the same text for all") for i in range(1500)] + [(i, f"t{i}" * 4) for i in range(1500, 2000)]
    sizes = check(sharding.range_shards(make_docs(docs), 8).collect(), docs, 8)
    assert len(sizes) == 8 and max(sizes.values()) <= 1.1 * min(sizes.values())


def test_rows_that_repeat_in_full_are_divided_too(make_docs):
    docs = [(7, "same")] * 4000 + [(i, f"text {i}") for i in range(100)]
    sizes = check(sharding.range_shards(make_docs(docs), 8).collect(), docs, 8)
    assert max(sizes.values()) <= 1.1 * min(sizes.values())


def test_odd_texts(make_docs, odd_texts):
    check(sharding.range_shards(make_docs(odd_texts), 8).collect(), odd_texts, 8)


@pytest.mark.parametrize("docs", [[], [(1, None)]])
def test_few_rows(make_docs, docs):
    check(sharding.range_shards(make_docs(docs), 8).collect(), docs, 8)


def test_small_groups_beside_a_hot_text_stay_whole(make_docs):
    docs = [(i, "the same text for all") for i in range(3000)]
    docs += [(3000 + i, f"pair number {i // 2} with words of its own") for i in range(6000)]
    rows = sharding.range_shards(make_docs(docs), 8).collect()
    sizes = check(rows, docs, 8)
    assert max(sizes.values()) <= 1.1 * min(sizes.values())
    held = {}
    for r in rows:
        if r.doc_id >= 3000:
            held.setdefault((r.doc_id - 3000) // 2, set()).add(r.shard)
    assert len(held) == 3000 and all(len(s) == 1 for s in held.values())


def test_cuts_place_records_in_order():
    rng = np.random.default_rng(3)
    spots, units = rng.integers(0, 9, 400), rng.integers(-50, 50, 400)
    cuts = sharding._whole(sharding._cuts(spots, units, np.ones(400), 40), np.array([4, 5]))
    pairs = list(zip(cuts.spots.tolist(), cuts.units.tolist()))
    assert pairs == sorted(pairs)
    want = [sum(p <= (a, b) for p in pairs) for a, b in zip(spots.tolist(), units.tolist())]
    assert cuts.place(spots, units).tolist() == want
    for spot in set(range(9)) - {4, 5}:
        assert len(set(cuts.place(np.full(100, spot), np.arange(-50, 50)).tolist())) == 1
    assert sharding._cuts(*[np.empty(0, np.int64)] * 3, 5).place(spots, units).tolist() == [0] * 400
