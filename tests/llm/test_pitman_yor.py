import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from registryloom.llm import pitman_yor as py
from registryloom.llm import tables
from registryloom.llm.common import most_frequent, saved
from registryloom.llm.tables import expected_tables
from registryloom.llm.tables import random_pair as _random
from registryloom.llm.words import mixed
from registryloom.sources import tables as sources

from .conftest import sentence, words_of

END = "<end>"


class Dishes:
    """Customers of many dishes at tables, re-seated side by side and one by one.

    What ``drawn_tables`` draws at once is where many moves lead to.

    Customer i of dish p sits at table ``labels[start[p] + i]`` of the dish; ``sizes`` has the
    tables' customers at the same offsets. All begin at expected numbers of tables.
    """

    def __init__(self, keys: np.ndarray, customers: np.ndarray, weight: np.ndarray, discount: float):
        self.keys, self.c, self.discount = keys, customers, discount
        self.t = expected_tables(customers, weight, discount).astype(np.int64)
        self.start = np.cumsum(customers) - customers
        own = np.repeat(np.arange(len(customers)), customers)
        at = np.arange(len(own)) - self.start[own]
        # The first customers open the tables, the others choose among them evenly.
        chosen = (_random(mixed(keys)[own] + at.astype(np.uint64), 1)[0] * self.t[own]).astype(np.int32)
        self.labels = np.where(at < self.t[own], at, chosen).astype(np.int32)
        self.sizes = np.bincount(self.start[own] + self.labels, minlength=len(own)).astype(np.int32)

    def move(self, step: int, weight: np.ndarray) -> None:
        """Take one customer of each dish from its table and seat it again."""
        keys, c, start, d = self.keys, self.c, self.start, self.discount
        pick, chance = _random(keys, step)
        who = (pick * c).astype(np.int64)
        left = self.labels[start + who]
        self.sizes[start + left] -= 1
        self.t -= self.sizes[start + left] == 0
        fresh = chance * (weight + c - 1 - d * self.t) < weight
        seat = np.empty(len(c), np.int32)
        opened = np.flatnonzero(fresh)
        seat[opened] = self._free(opened, left[opened], who[opened])
        todo = np.flatnonzero(~fresh)
        for i in range(64):  # a customer met by chance leads to its table, which takes size - d of size
            if not len(todo):
                break
            pick, chance = _random(keys[todo], step + 1 + i)
            other = (pick * (c[todo] - 1)).astype(np.int64)
            other += other >= who[todo]
            table = self.labels[start[todo] + other]
            size = self.sizes[start[todo] + table]
            seat[todo] = table
            todo = todo[chance * size >= size - d]
        self.labels[start + who] = seat
        self.sizes[start + seat] += 1
        self.t += fresh

    def _free(self, dishes: np.ndarray, left: np.ndarray, who: np.ndarray) -> np.ndarray:
        """An empty table of each dish: the one just left, the customer's own, or the next one."""
        start, c = self.start[dishes], self.c[dishes]
        seat = np.where(self.sizes[start + left] == 0, left, who)
        taken = np.flatnonzero(self.sizes[start + seat] > 0)
        while len(taken):
            seat[taken] = (seat[taken] + 1) % c[taken]
            taken = taken[self.sizes[start[taken] + seat[taken]] > 0]
        return seat


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    train = [(i, sentence(rng, rng.randrange(1, 50), 60)) for i in range(300)]
    test = [(1000 + i, sentence(rng, 30, 80)) for i in range(40)]
    return train, test


def test_counts_and_base_equal_brute_force(make_docs, rows, odd_texts):
    train, test = rows
    docs = train + test + odd_texts
    counts = Counter(w for _, t in train for w in [*words_of(t), END])
    n, v = sum(counts.values()), len(counts)
    got = py.score(make_docs(docs), make_docs(train)).collect()
    assert len(got) == len(docs)
    want = []
    for i, t in docs:
        tokens = [*words_of(t), END]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        want.append((i is None, i or 0, len(tokens), sum(counts[w] > 0 for w in tokens), round(base, 6)))
    have = [(r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got]
    assert sorted(have) == sorted(want)
    assert {r.train_tokens for r in got} == {n}
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_scores_follow_the_seatings(make_docs, rows):
    """Word by word, from the same samples, in plain Python."""
    train, test = rows
    learnt = py._texts(make_docs(train), "doc_id", "text")
    contexts = py.frequent_words(learnt)
    blank = py.Seats(contexts, 0, 0, *[np.zeros(0)] * 4, 0.5, 0.5)
    table = py.word_rows(learnt, blank, 8).orderBy("w").toPandas()
    before, seats = py.learn(py.word_rows(learnt, blank, 8), contexts)
    words = table["w"].to_numpy().view(np.uint64)
    owner = np.repeat(np.arange(len(words)), table["ctx"].map(len))
    ctx, n = (np.concatenate(table[c].to_list()).astype(np.int64) for c in ("ctx", "n"))
    samples = list(py.sample_seatings(words, ctx, n, owner, before, py.ROUNDS - 1))
    assert seats.customers.sum() == n.sum() == seats.tokens
    for s, (t, customers, root) in enumerate(samples):
        assert (t >= 1).all() and (t <= n).all() and (root >= 1).all() and (root <= customers).all()
        assert np.allclose(np.bincount(ctx, t, len(seats.tables[s])), seats.tables[s])
        assert seats.root_customers[s] == t.sum() and seats.root_tables[s] == root.sum()
    # For every context, the chances of all words and of one unknown word make one.
    for c in np.unique(ctx):
        total = 0.0
        for s, (t, customers, root) in enumerate(samples):
            open_ = py.STRENGTH + seats.discount * seats.tables[s][c]
            own = np.bincount(owner[ctx == c], (n - seats.discount * t)[ctx == c], len(words))
            p = (own + open_ * seats.root(customers, root, s)) / (py.STRENGTH + seats.customers[c])
            unknown = open_ * seats.root(0, 0, s) / (py.STRENGTH + seats.customers[c])
            total += (p.sum() + unknown) / len(samples)
        assert total == pytest.approx(1, abs=1e-9)


def test_the_model_beats_the_base_where_order_matters(make_docs):
    rng = random.Random(8)
    chain = {i: rng.sample(range(200), 3) for i in range(200)}

    def walk(n):
        at, out = rng.randrange(200), []
        for _ in range(n):
            out.append(f"w{at}")
            at = rng.choice(chain[at])
        return " ".join(out)

    train, test = [(i, walk(60)) for i in range(400)], [(1000 + i, walk(60)) for i in range(50)]
    got = py.score(make_docs(test), make_docs(train)).collect()
    base, model = sum(r.base_score for r in got), sum(r.score for r in got)
    assert model > 0.45 * base, "about log10(3) a word against log10(200)"


def test_gibbs_keeps_the_distribution():
    """Many copies of one dish reach the known distribution of its number of tables."""
    d, a, c, n = 0.6, 2.0, 6, 20_000
    dishes = Dishes(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(7919), np.full(n, c), np.full(n, a), d)
    for step in range(60):
        dishes.move(step * 128 + 1000, np.full(n, a))
    assert (dishes.sizes.reshape(n, c).sum(1) == c).all()
    assert ((dishes.sizes.reshape(n, c) > 0).sum(1) == dishes.t).all()
    # P(t) is in proportion to a^t times the generalised Stirling number S(c, t).
    stirling = np.zeros((c + 1, c + 1))
    stirling[0, 0] = 1
    for i in range(1, c + 1):
        for t in range(1, i + 1):
            stirling[i, t] = stirling[i - 1, t - 1] + (i - 1 - t * d) * stirling[i - 1, t]
    want = stirling[c] * a ** np.arange(c + 1)
    have = np.bincount(dishes.t, minlength=c + 1) / n
    assert np.abs(have - want / want.sum()).max() < 0.015


def test_draws_follow_the_exact_distribution_whatever_the_size():
    """In a word's contexts and in the parent, below and beyond what is looked up; none is its mean."""
    d, n, strength = 0.6, 4_000, 1.0
    keys = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(7919)
    for c, base, others in ((6, 0.01, 300), (300, 0.3, 0), (700, 1e-3, 5_000), (5_000, 1e-4, 400_000), (5_000, 1e-3, 500), (5_000, 0.9, 3)):
        want = np.full(c + 1, -np.inf)  # the recurrence of the Stirling numbers, in logarithms
        want[1] = 0
        for i in range(1, c):
            joins = want[1 : i + 2] + np.log(np.maximum(i - np.arange(1, i + 2) * d, 1e-300))
            want[1 : i + 2] = np.logaddexp(joins, want[: i + 1])
        want[1:] += np.cumsum(np.log(base * (strength + d * (others + np.arange(c)))))
        want = np.exp(want - want.max())
        mean = (want * np.arange(c + 1)).sum() / want.sum()
        sd = math.sqrt((want * (np.arange(c + 1) - mean) ** 2).sum() / want.sum())
        full = lambda v: np.full(n, v)
        t = full(round(mean))
        for step in range(12):
            t = tables.drawn_tables(keys, full(c), full(base), full(others), strength, d, step * 128, t)
        assert abs(t.mean() - mean) < 0.1 * sd and abs(t.std() - sd) < 0.1 * sd, (c, base, others)


def test_all_customers_of_a_word_are_seated_anew():
    """A frequent word's tables differ by sample, in a context and in the parent."""
    words, ctx, n = np.array([77], np.uint64), np.array([2]), np.array([200_000])
    one = np.ones(1)
    start = py.Seats(words, 1e6, 2_000, 1e6 * np.ones(3), 1e5 * np.ones((1, 3)), 1e5 * one, 2_000 * one, 0.6, 0.5)
    seats = py.Seats(words, 1e6, 2_000, 1e6 * np.ones(3), 2e5 * np.ones((1, 3)), 2e5 * one, 4_000 * one, 0.6, 0.5, start)
    found = [(t[0], r[0]) for t, _, r in py.sample_seatings(words, ctx, n, np.array([0]), seats, 0)]
    assert len(set(found)) == py.SAMPLES and all(1 < t < 200_000 for t, _ in found)
    assert len({t for t, _ in found}) > 1 and len({r for _, r in found}) > 1


def test_words_about_equally_frequent_are_contexts_up_to_the_limit(spark):
    """One step of frequency, or one count alone, that is larger than the limit is not left out."""
    for n in ("1000", "1000 + id % 7", "if(id < 300, 5000, 1000)"):
        counts = spark.range(4_000).selectExpr("id AS w", f"{n} AS n")
        top = most_frequent(counts, 3_000).collect()
        assert 2_990 <= len(top) <= 3_000
        rest = {r.w for r in counts.collect()} - {r.w for r in top}
        assert min(r.n for r in top) >= max(r.n for r in counts.collect() if r.w in rest)
    assert most_frequent(counts, 4_000).count() == 4_000 and most_frequent(counts.limit(0), 5).count() == 0


def test_no_texts(make_docs, rows):
    train, _ = rows
    assert py.score(make_docs([]), make_docs(train)).count() == 0
    got = py.score(make_docs(train[:3]), make_docs([])).collect()
    assert len(got) == 3 and all(r.n_known == 0 and r.score == 0 for r in got), "one unknown word is all"


def test_a_text_has_sums_where_it_has_tokens_alone(make_docs):
    """However many buckets: no row without a token, so at most one a distinct token."""
    rng = random.Random(11)
    docs = [(i, sentence(rng, rng.randrange(0, 30), 500)) for i in range(200)] + [(None, None), (7, "")]
    texts, buckets = py._texts(make_docs(docs), "doc_id", "text"), 512
    contexts = py.frequent_words(texts)
    blank = py.Seats(contexts, 0, 0, *[np.zeros(0)] * 4, 0.5, 0.5)
    rows = saved(py.word_rows(texts, blank, buckets))
    parts = py.sums_by_text(texts, rows, *py.learn(rows, contexts), buckets).collect()
    assert min(r.tokens for r in parts) > 0
    held = Counter((r.key, r.body) for r in parts)
    assert len(held) == 202
    assert sum(held.values()) <= sum(len({*words_of(t), END}) for _, t in docs)


def test_perplexity(make_docs, rows):
    train, test = rows
    scores = py.score(make_docs(train + test), make_docs(train))
    got = scores.collect()
    for r in got:
        assert math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9)
    (whole,) = py.perplexity(scores).collect()
    n, total = sum(r.n_tokens for r in got), sum(r.score for r in got)
    assert whole.n_tokens == n and math.isclose(whole.perplexity, 10 ** (-total / n), rel_tol=1e-9)
    known, unknown = (py.perplexity(scores.filter(f)).first().perplexity for f in ("doc_id < 1000", "doc_id >= 1000"))
    assert known < unknown < 500
    assert py.perplexity(py.score(make_docs([]), make_docs(train))).count() == 0


@pytest.fixture(scope="module")
def rare_rows():
    rng = random.Random(12)
    train = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 90}" for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    return train, [(1000, "w3 w88 w1 w88 never w1 w1"), (1001, "new w1 w89"), (1002, "w77"), (1003, None), *train[:20]]


def test_every_word_is_a_context_of_its_own(make_docs, rare_rows, monkeypatch):
    """With few contexts sent everywhere: counts of each, and chances that make one in each."""
    monkeypatch.setattr(py, "CONTEXTS", 6)
    train, test = rare_rows
    learnt = py._texts(make_docs(train), "doc_id", "text")
    contexts, buckets = py.frequent_words(learnt), 8
    assert len(contexts) == 6
    blank = py.Seats(contexts, 0, 0, *[np.zeros(0)] * 4, 0.5, 0.5)
    rows = saved(py.word_rows(learnt, blank, buckets))
    before, seats = py.learn(rows, contexts)

    follow, words, start = Counter(), Counter(), Counter()
    for _, t in train:
        last = None
        for w in [*words_of(t), END]:
            follow[last, w] += 1
            words[w] += 1
            last = w
    assert seats.tokens == words.total() and seats.types == len(words) and seats.customers.sum() == words.total()
    known = py._predictions(rows, before, seats, buckets)
    near, far = (known.filter(f).toPandas() for f in ("w IS NOT NULL", "w IS NULL"))
    assert sorted(near["c"]) == sorted(words.values()) and near["w"].is_unique
    roots = np.stack([np.frombuffer(v) for v in near["root"]])
    unknown = np.array([seats.root(0, 0, s) for s in range(py.SAMPLES)])
    assert np.allclose(roots.sum(0) + unknown, 1)

    h, keys = (np.frombuffer(b"".join(far[c]), np.uint64) for c in ("far", "key"))
    n, chance = np.frombuffer(b"".join(far["n"]), np.int32), np.frombuffer(b"".join(far["chance"]), np.float32)
    assert len(np.unique(keys)) == len(keys)
    number = Counter(c for c, _ in follow)  # distinct words after each context
    pairs = sum(number.values()) - sum(len(v) // 2 for v in near["ctx"])
    assert pairs == len(keys) and n.sum() == words.total() - sum(seats.customers[py.START :])
    found, customers, opens, own = py.seat_rare(h, keys, n.astype(np.int64), chance.astype(float), seats.discount)
    top = {int(c) for c in contexts}
    assert len(found) == len(words) - 1 - len(top), "all words but those sent everywhere"
    held = np.array([(own[h == c].sum() + o * (roots.sum(0) + unknown).mean()) / (py.STRENGTH + m) for c, m, o in zip(found, customers, opens)])
    assert np.allclose(held, 1, atol=1e-5)
    assert len(set(np.round(opens / (py.STRENGTH + customers), 6))) > 10, "each context has tables of its own"


def test_scores_after_rare_words_follow_their_own_contexts(make_docs, rare_rows, monkeypatch):
    """Token by token from the seatings, in plain Python; buckets and hot words change nothing."""
    monkeypatch.setattr(py, "CONTEXTS", 6)
    train, test = rare_rows
    texts = py._texts(make_docs(test), "doc_id", "text")
    learnt = py._texts(make_docs(train), "doc_id", "text")
    contexts = py.frequent_words(learnt)
    blank = py.Seats(contexts, 0, 0, *[np.zeros(0)] * 4, 0.5, 0.5)
    rows = saved(py.word_rows(learnt, blank, 16))
    before, seats = py.learn(rows, contexts)
    sums = Counter()
    for r in py.sums_by_text(texts, rows, before, seats, 16).collect():
        sums[r.key] += r.score

    known = py._predictions(rows, before, seats, 16)
    near, far = (known.filter(f).toPandas() for f in ("w IS NOT NULL", "w IS NULL"))
    root = {int(w) % 2**64: np.frombuffer(v) for w, v in zip(near["w"], near["root"])}
    own = {(int(w) % 2**64, c): v for w, cs, vs in zip(near["w"], near["ctx"], near["own"]) for c, v in zip(np.frombuffer(cs, np.int16), np.frombuffer(vs, np.float32))}
    h, keys = (np.frombuffer(b"".join(far[c]), np.uint64) for c in ("far", "key"))
    n, chance = np.frombuffer(b"".join(far["n"]), np.int32).astype(np.int64), np.frombuffer(b"".join(far["chance"]), np.float32)
    found, customers, opens, left = py.seat_rare(h, keys, n, chance.astype(float), seats.discount)
    rare = {int(c): (m, o) for c, m, o in zip(found, customers, opens)}
    of_pair = dict(zip(keys.tolist(), left))
    unknown = np.array([seats.root(0, 0, s) for s in range(py.SAMPLES)])

    hashed = {}
    for _, tokens in py._flushes(iter([_arrow([(0, b" ".join(w for _, t in test for w in words_of(t)).decode())])])):
        hashed = dict(zip([*[w for _, t in test for w in words_of(t)], END], tokens.words.tolist()))
    for i, t in test:
        want, last = 0.0, None
        for w in [*words_of(t), END]:
            w = hashed[w]
            p = root.get(w, unknown)
            c = py.START if last is None else int(seats.ids(np.array([last], np.uint64))[0])
            if c == py.RARE:
                m, o = rare.get(last, (0, py.STRENGTH))
                key = int(py._pair_keys(np.array([w], np.uint64), np.array([last], np.uint64))[0])
                q = (of_pair.get(key, 0.0) + o * p.mean()) / (py.STRENGTH + m)
            else:
                o = py.STRENGTH + seats.discount * seats.tables[:, c]
                q = (own.get((w, c), 0.0) + (o * p).mean()) / (py.STRENGTH + seats.customers[c])
            want, last = want + math.log10(q), w
        assert sums[i] == pytest.approx(want, rel=1e-5)


def _arrow(rows):
    return pa.RecordBatch.from_pylist([{"key": k, "text": t} for k, t in rows])


def test_counts_of_all_words_are_removed_once_they_have_served(spark):
    before = len(sources._named)
    words = py.frequent_words(py._texts(spark.createDataFrame([(1, "a b a"), (2, "c")], "doc_id long, text string"), "doc_id", "text"))
    assert len(words) == 3
    places = sources._named[before:]
    assert places and not any(Path(p.removeprefix("file:")).exists() for p in places)


def test_a_bucket_is_summed_by_ranges_of_whole_words(monkeypatch):
    """What tasks have sent of a bucket is never worked on at once."""
    monkeypatch.setattr(py, "RANGE_VALUES", 500)
    rng = np.random.default_rng(11)
    vocabulary = np.unique(rng.integers(0, 2**64, 900, np.uint64))
    rows, want = [], Counter()
    for _ in range(7):
        words = np.sort(rng.choice(vocabulary, 300, replace=False))
        runs = rng.integers(1, 9, 300).astype(np.int32)
        ctx = rng.integers(0, 5, runs.sum()).astype(np.int16)
        n, far = rng.integers(1, 9, len(ctx)).astype(np.int32), rng.integers(0, 2**62, (ctx == py.RARE).sum())
        hashes = np.zeros(len(ctx), np.int64)
        hashes[ctx == py.RARE] = far
        for key in zip(np.repeat(words, runs).tolist(), ctx.tolist(), n.tolist(), hashes.tolist()):
            want[key] += 1
        rows.append({c: v.tobytes() for c, v in (("w", words), ("runs", runs), ("ctx", ctx), ("n", n), ("far", far))})
    empty = dict.fromkeys(rows[0], b"")
    batches = [pa.RecordBatch.from_pylist(some) for some in (rows[:4], [empty], rows[4:])]
    got, last, ranges = Counter(), -1, 0
    for v in py._word_ranges(iter(batches)):
        hashes = np.zeros(len(v["ctx"]), np.int64)
        hashes[v["ctx"] == py.RARE] = v["far"]
        got.update(zip(np.repeat(v["w"], v["runs"]).tolist(), v["ctx"].tolist(), v["n"].tolist(), hashes.tolist()))
        assert int(v["w"].min()) > last and len(v["ctx"]) < 2 * 500
        last, ranges = int(v["w"].max()), ranges + 1
    assert got == want and ranges > 10


def test_rare_contexts_are_seated_by_ranges_alike(monkeypatch):
    rng = np.random.default_rng(12)
    far = rng.choice(rng.integers(0, 2**64, 400, np.uint64), 5_000)
    keys, n = rng.integers(0, 2**64, 5_000, np.uint64), rng.integers(1, 6, 5_000)
    chance = rng.random(5_000).astype(np.float32)
    values = {"far": far, "key": keys, "n": n.astype(np.int32), "chance": chance}
    sent = pa.table({c: pa.array([v[:2_000].tobytes(), v[2_000:].tobytes()]) for c, v in values.items()})
    found, customers, opens, own = py.seat_rare(far, keys, n, chance.astype(float), 0.6)
    by = np.argsort(keys)
    want = found, customers, opens, keys[by], (own / chance)[by]
    monkeypatch.setattr(py, "RANGE_VALUES", 300)
    for a, b in zip(py._rare_ranges(sent, 0.6), want, strict=True):
        assert np.allclose(a, b, rtol=1e-12, atol=0) if a.dtype == float else (a == b).all()
    none = py._rare_ranges(sent.slice(0, 0), 0.6)
    assert [len(v) for v in none] == [0] * 5
