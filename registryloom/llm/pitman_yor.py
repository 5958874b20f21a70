"""A hierarchical Pitman-Yor language model over pairs of words, learnt and applied at corpus size.

Every context has a restaurant whose customers are the words that follow it; the tables of all of
them are the customers of one parent restaurant, whose own base is uniform over the known words
and one unknown. Every word is a context, and so is the start of a text. What is kept of the most
frequent contexts has a fixed size and is sent everywhere. Seatings are kept by word: given the
tables of each context in the last round, the seatings of different words do not depend on each
other, and one row holds all of a word's.

Rarer contexts are too many to be sent. While the parent is learnt, a word's tables in them are
drawn given the mean number of tables that they have. Then each moves, with its words and their
probabilities in the parent, to the bucket of the context's own word, where its whole restaurant is
seated. A token's probability has a factor known where its word is, the word's in the parent, and
one known where its context is, so no token has to move twice. Rows of the most frequent words would
grow with the corpus: their pairs with rarer contexts lie apart, in the buckets of the contexts.

Each step of Gibbs sampling seats all customers of a word in a restaurant anew, the parent's
included, given the other words' tables; only how many tables they take is drawn, see ``tables``. Random
numbers are hashes of word, context and step, so a draw comes out alike wherever it is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registryloom.llm.common import most_frequent, release_unused, small_batches, stored
from registryloom.llm.tables import drawn_tables, expected_tables
from registryloom.llm.words import Words, bucket_order, flat_lists, list_array, mixed, release, word_chunks
from registryloom.sources.tables import remove_dir, shared_dir

#: Words whose contexts are known everywhere; ids fit two bytes with the two contexts below them. Of
#: all other contexts, ``RARE``, each has a restaurant of its own where its word is.
CONTEXTS = 30_000
RARE, START = 0, 1
#: Concentrations of context and parent restaurants. Discounts come from counts of counts.
STRENGTH, ROOT_STRENGTH = 1.0, 1.0
#: Rounds that exchange tables between words, sweeps before the first sample of a round, and samples
#: that predictions average.
ROUNDS, BURN_IN, SAMPLES = 2, 2, 3
#: Pairs of word and context whose seatings a task holds at once, about, and values of a bucket's
#: words that it sums up, or pairs of its rare contexts that it seats, at once.
SLICE_PAIRS, RANGE_VALUES = 150_000, 400_000
#: Tokens that a task counts before it passes sums on, and that share a bucket of words, about.
FLUSH_TOKENS, FLUSH_TEXTS, BUCKET_TOKENS = 1_000_000, 30_000, 4_000_000
LEAST_BUCKETS = 16
#: Words with this share of all tokens are spread over several buckets when texts are scored.
HOT_SHARE, HOT_SPREAD = 1 / 256, 16
END = np.uint64(0x5851F42D4C957F2D)
_SALT = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Seats:
    """What is known of the restaurants as a whole."""

    contexts: np.ndarray  # sorted hashes of the context words; ids count from 2
    tokens: float
    types: float
    customers: np.ndarray  # by context id
    tables: np.ndarray  # by sample and context id
    root_customers: np.ndarray  # by sample
    root_tables: np.ndarray
    discount: float
    root_discount: float
    earlier: Seats | None = None  # of the round before
    # Of words with such ids, and of ends as words under START, the last three by sample.
    counts: np.ndarray | None = None
    away: np.ndarray | None = None  # tables in rare contexts that lie apart
    in_root: np.ndarray | None = None  # customers of the parent
    root_own: np.ndarray | None = None  # and their tables

    def ids(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.contexts, words), max(len(self.contexts) - 1, 0))
        known = self.contexts[at] == words if len(self.contexts) else np.zeros(len(words), bool)
        return np.where(known, at + 2, RARE)

    def word_ids(self, words: np.ndarray) -> np.ndarray:
        """Ids of words whose pairs with rare contexts lie apart; other words have ``RARE``."""
        return np.where(words == END, START, self.ids(words))

    def around(self, ctx: np.ndarray) -> np.ndarray:
        """Tables in each context, in the last sample; in a rare one as many as in the mean of them."""
        tables = self.tables[-1].copy()
        tables[RARE] /= max(self.types - 1 - len(self.contexts), 1)
        return tables[ctx]

    def chances(self, ids: np.ndarray, s: int) -> np.ndarray:
        """Probability in the parent of words with an id, in sample ``s``."""
        return self.root(self.in_root[s][ids], self.root_own[s][ids], s)

    def root(self, customers, tables, s: int):
        """Probability of a word in the parent restaurant, in sample ``s``."""
        own = np.maximum(customers - self.root_discount * tables, 0)
        rest = (ROOT_STRENGTH + self.root_discount * self.root_tables[s]) / (self.types + 1)
        return (own + rest) / (ROOT_STRENGTH + self.root_customers[s])


@dataclass
class Tokens:
    """Tokens of some texts: words, each text's end, and the place of the token before."""

    words: np.ndarray
    texts: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, words: Words) -> Tokens:
        counts = np.diff(words.first)
        owners, n = words.owners(), len(counts)
        out = np.empty(len(owners) + n, np.uint64)
        out[np.arange(len(owners)) + owners] = words.hashes
        ends = words.first[1:] + np.arange(n)
        out[ends] = END
        first = np.zeros(len(out), bool)
        first[ends[:-1] + 1] = True
        first[:1] = True
        return cls(out, np.repeat(np.arange(n), counts + 1), first)


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, Tokens]]:
    """Tokens of as many texts as fit the limits, with the rows they come from."""
    held: list[tuple[pa.RecordBatch, Tokens]] = []

    def joined() -> tuple[pa.Table, Tokens]:
        rows = pa.Table.from_batches([b for b, _ in held])
        begin = np.cumsum([0, *[len(b) for b, _ in held]])
        parts = [t for _, t in held]
        texts = np.concatenate([t.texts + i for t, i in zip(parts, begin)])
        return rows, Tokens(np.concatenate([t.words for t in parts]), texts, np.concatenate([t.first for t in parts]))

    for batch, words in word_chunks(batches):
        tokens = Tokens.of(words)
        size = sum(len(t.words) for _, t in held) + len(tokens.words)
        if held and (size > FLUSH_TOKENS or sum(len(b) for b, _ in held) + len(batch) > FLUSH_TEXTS):
            yield joined()
            held = []
        held.append((batch.drop_columns(["text"]), tokens))
    if held:
        yield joined()


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and for each value which one it is."""
    held = pa.array(values).dictionary_encode()
    distinct = held.dictionary.to_numpy()
    order = np.argsort(distinct)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return distinct[order], rank[held.indices.to_numpy()]


def _bucket(words: np.ndarray, n: int) -> np.ndarray:
    return ((words >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.col(text).cast("string")
    return small_batches(docs).select(F.col(key).alias("key"), F.xxhash64(body).alias("body"), body.alias("text"))


def frequent_words(texts: DataFrame) -> np.ndarray:
    """Hashes of the most frequent words, sorted; counted over all texts."""

    def count(batches):
        for _, tokens in _flushes(batches):
            words, n = np.unique(tokens.words[tokens.words != END], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["w", "n"])

    counts = texts.select("text").mapInArrow(count, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    spark, place = texts.sparkSession, shared_dir(texts.sparkSession)
    top = most_frequent(counts, CONTEXTS, place).select("w").toPandas()["w"]
    remove_dir(spark, place)  # a row a word of the corpus, which would lie there to the end
    return np.sort(top.to_numpy(np.int64).view(np.uint64))


def word_rows(texts: DataFrame, seats: Seats, buckets: int) -> DataFrame:
    """``w, c, ctx, n, far, apart``: a word's customers in all, its contexts, its customers in each.

    ``far`` has the words that are contexts where ``ctx`` is ``RARE``, in the same order. Words with
    an id have those in rows ``apart``, at most one a bucket, and all else in one row.
    """
    k = len(seats.contexts) + 2

    def pairs(batches):
        for _, tokens in _flushes(batches):
            words, at = _coded(tokens.words)
            ids, home = seats.ids(words), _bucket(words, buckets)
            before = np.empty(len(at), np.int64)
            before[1:] = np.where(ids == RARE, k + np.arange(len(words)), ids)[at[:-1]]
            before[tokens.first] = START
            key, n = np.unique(at << 32 | before, return_counts=True)
            place, ctx = key >> 32, key & 0xFFFFFFFF
            far = np.flatnonzero(ctx >= k)
            context = ctx[far] - k
            ctx[far] = RARE
            hashes = np.zeros(len(ctx), np.int64)
            hashes[far] = words[context].view(np.int64)
            of_value = home[place]
            has_id = (seats.word_ids(words) != RARE)[place[far]]
            of_value[far[has_id]] = home[context[has_id]]
            # A word with an id has a row of its own, with no customers if need be.
            near = np.ones(len(ctx), bool)
            near[far[has_id]] = False
            bare = np.setdiff1d(place, place[near])
            order = np.argsort(np.concatenate([place, bare]), kind="stable")
            place, of_value = np.concatenate([place, bare])[order], np.concatenate([of_value, home[bare]])[order]
            ctx = np.concatenate([ctx, np.full(len(bare), START)])[order]
            n, hashes = (np.concatenate([v, np.zeros(len(bare), v.dtype)])[order] for v in (n, hashes))
            values = {"ctx": ctx.astype(np.int16), "n": n.astype(np.int32), "far": hashes}
            yield from _packed(words, place, of_value, values)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for values in _word_ranges(batches):
            yield summed(**values)

    def summed(w: np.ndarray, runs: np.ndarray, ctx: np.ndarray, n: np.ndarray, far: np.ndarray) -> pa.RecordBatch:
        words, at = _coded(w)
        ctx = ctx.astype(np.int64)
        far, which = _coded(far)
        at = np.repeat(at, runs)
        apart = (ctx == RARE) & (seats.word_ids(words) != RARE)[at]
        ctx[ctx == RARE] = k + which
        key = (at << 1 | apart) << 32 | ctx
        order = np.argsort(key)
        key, n = key[order], n[order].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, total = key[new], np.add.reduceat(n, new)
        rows = np.unique(key >> 32)
        key, total = key[total > 0], total[total > 0]
        begin = np.searchsorted(key >> 32, np.append(rows, rows[-1] + 1))
        ctx = key & 0xFFFFFFFF
        rare = ctx >= k
        return pa.RecordBatch.from_pydict({
            "w": words.view(np.int64)[rows >> 1],
            "c": np.diff(np.concatenate([[0], np.cumsum(total)])[begin]),
            "ctx": list_array(np.where(rare, RARE, ctx).astype(np.int16), begin),
            "n": list_array(total, begin),
            "far": list_array(far[ctx[rare] - k], np.concatenate([[0], np.cumsum(rare)])[begin]),
            "apart": pa.array((rows & 1).astype(bool)),
        })

    packed = "bucket int, w binary, runs binary, ctx binary, n binary, far binary"
    rows = texts.select("text").mapInArrow(pairs, packed).groupBy("bucket")
    return rows.applyInArrow(gather, "w bigint, c bigint, ctx array<smallint>, n array<bigint>, far array<bigint>, apart boolean")


def _word_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The values of a bucket of words as tasks have sent them, by ranges of words with about
    ``RANGE_VALUES`` each. A word's values come together, and words in order."""
    kinds = {"w": np.uint64, "runs": np.int32, "ctx": np.int16, "n": np.int32, "far": np.int64}
    rows = [{c: _numbers(batch.column(c)[i], kind) for c, kind in kinds.items()} for batch in batches for i in range(len(batch))]
    ranges = max(-(-sum(len(r["ctx"]) for r in rows) // RANGE_VALUES), 1)
    places = [(0, 0, 0)] * len(rows)
    for part in range(1, ranges + 1):
        found: dict[str, list[np.ndarray]] = {c: [] for c in kinds}
        for i, (r, (word, value, far)) in enumerate(zip(rows, places)):
            to = len(r["w"]) if part == ranges else int(np.searchsorted(r["w"], np.uint64((part << 64) // ranges)))
            end = value + int(r["runs"][word:to].sum())
            last = far + int((r["ctx"][value:end] == RARE).sum())
            own = {"w": slice(word, to), "runs": slice(word, to), "ctx": slice(value, end), "n": slice(value, end), "far": slice(far, last)}
            for c, where in own.items():
                found[c].append(r[c][where])
            places[i] = to, end, last
        values = {c: np.concatenate(v) for c, v in found.items()}
        if len(values["w"]):
            yield values


def _packed(
    words: np.ndarray, place: np.ndarray, of_value: np.ndarray, values: dict[str, np.ndarray],
    more: tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]] | None = None, **whole
) -> Iterator[pa.RecordBatch]:
    """A row for each bucket of values: their words, how many values each has, and the values.

    ``place`` names each value's word, in ascending order. ``whole`` is about the texts that the
    values' ``doc`` names; a bucket gets what is about its own texts, and their new places. ``more``
    are other values, with places and buckets of their own, about words and texts of the bucket.
    Hashes of contexts, ``far``, are there for values of rare contexts alone. Values are the bytes of
    numbers, which Spark moves as they are and not one by one.
    """
    others = dict(_by_bucket(more[1])) if more else {}
    for b, v in _by_bucket(of_value):
        new = np.flatnonzero(np.concatenate([[True], place[v][1:] != place[v][:-1]]))
        w = place[v][new]
        fields = {"bucket": np.array([b], np.int32)}
        own = {n: x[v] for n, x in values.items()}
        if "far" in own:
            own["far"] = own["far"][(own["ctx"] == RARE)]
        if more:
            m = others.get(b, np.empty(0, np.int64))
            own |= {n: x[m] for n, x in more[2].items()}
            own["far_runs"] = np.bincount(np.searchsorted(w, more[0][m]), minlength=len(w)).astype(np.int32)
        if whole:
            present, place_in = np.unique(own["doc"], return_inverse=True)
            own["doc"] = place_in.astype(np.int16)
            if more:
                own["far_doc"] = np.searchsorted(present, own["far_doc"]).astype(np.int16)
            taken = {n: x.take(pa.array(present)) for n, x in whole.items()}
            fields |= {n: pa.array([x], pa.list_(x.type)) for n, x in taken.items()}
        fields |= {"w": _one(words[w]), "runs": _one(np.diff(np.append(new, len(v))).astype(np.int32))}
        fields |= {n: _one(x) for n, x in own.items()}
        yield pa.RecordBatch.from_pydict(fields)


def _pair_keys(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Hashes of pairs of words and rare contexts."""
    return mixed(mixed(words) + contexts * _SALT)


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs, and where it does."""
    few = not len(buckets) or buckets.max() < 1 << 16  # sorted by counting
    order = np.argsort(buckets.astype(np.uint16) if few else buckets, kind="stable")
    found, begin = np.unique(buckets[order], return_index=True)
    return zip(found.tolist(), np.split(order, begin[1:]))


def _one(values: np.ndarray) -> pa.Array:
    return pa.array([values.tobytes()], pa.binary())


def _bytes(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of the bytes of some of the values each."""
    places = pa.py_buffer((offsets * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, places, pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(held: pa.BinaryScalar, kind: np.dtype | type) -> np.ndarray:
    """The numbers that one row has the bytes of, where they lie."""
    buffer = held.as_buffer()
    return np.frombuffer(buffer, kind) if buffer.size else np.empty(0, kind)


def _values(column: pa.Array | pa.ChunkedArray, kind: np.dtype | type) -> np.ndarray:
    """The numbers in a column of their bytes, one row after the other."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    found = [np.empty(0, np.uint8)]
    for chunk in chunks:
        if len(chunk) and chunk.buffers()[2] is not None:
            ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            found.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0] : ends[-1]])
    return np.concatenate(found).view(kind)


def _counts(column: pa.Array | pa.ChunkedArray, kind: np.dtype | type) -> np.ndarray:
    """How many numbers each row has."""
    return pc.binary_length(column).to_numpy() // np.dtype(kind).itemsize


def _elsewhere(words: np.ndarray, seats: Seats) -> tuple[np.ndarray, ...]:
    """As last known, of words with an id: tables that lie apart, customers and tables in the parent."""
    if seats.away is None:
        return (np.zeros(len(words), np.int64),) * 3
    ids = seats.word_ids(words)
    return tuple(v[-1][ids].astype(np.int64) for v in (seats.away, seats.in_root, seats.root_own))


def first_seatings(
    words: np.ndarray, ctx: np.ndarray, n: np.ndarray, owner: np.ndarray, seats: Seats, apart: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """What sampling begins with: tables expected where every (word, context) has had one."""
    apart = np.zeros(len(words), bool) if apart is None else apart
    away, in_root, root_own = _elsewhere(words, seats)
    own, some = np.bincount(owner, minlength=len(words)), np.flatnonzero(n > 1)
    customers = np.where(apart, in_root, own + away)
    opens = STRENGTH + seats.discount * seats.around(ctx[some])
    weight = opens * seats.root(customers, np.minimum(customers, 1), -1)[owner[some]]
    tables = np.ones(len(n), np.int64)
    tables[some] = expected_tables(n[some], weight, seats.discount)
    own += np.bincount(owner[some], tables[some] - 1, len(words)).astype(np.int64)
    customers = np.where(apart, in_root, own + away)
    weight = (ROOT_STRENGTH + seats.root_discount * seats.root_tables[-1]) / (seats.types + 1)
    root = expected_tables(customers, np.full(len(words), weight), seats.root_discount).astype(np.int64)
    return tables, customers, np.where(apart, root_own, root)


def sample_seatings(
    words: np.ndarray, ctx: np.ndarray, n: np.ndarray, owner: np.ndarray, seats: Seats, chain: int,
    far: np.ndarray | None = None, apart: np.ndarray | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tables of each (word, context), and each word's customers and tables in the parent.

    One item a sample, after the burn-in. Words that occur once in a context have one table. A
    round goes on from the last seatings of the round before, which are drawn once more. ``far`` are
    the hashes of rare contexts, 0 of others; tables there are drawn once a round. Rows ``apart``
    find their word in the parent as it was in the round before.
    """
    apart = np.zeros(len(words), bool) if apart is None else apart
    if chain:
        for tables, customers, root in sample_seatings(words, ctx, n, owner, seats.earlier, chain - 1, far, apart):
            pass
    else:
        tables, customers, root = first_seatings(words, ctx, n, owner, seats.earlier, apart)
    some, held = np.flatnonzero(n > 1), np.flatnonzero(~apart)
    keys = mixed(words)
    pair_keys = mixed(keys[owner[some]] + (ctx[some].astype(np.uint64) + (0 if far is None else far[some])) * _SALT)
    last = len(seats.tables) - 1
    others = seats.around(ctx[some]) - tables[some]  # of other words, in the round before
    root_others = (seats.root_tables[last] - root)[held]
    away, in_root, root_own = _elsewhere(words, seats)
    single = np.bincount(owner, minlength=len(words))
    count = lambda: np.bincount(owner[some], tables[some] - 1, len(words)).astype(np.int64)
    customers, root = np.where(apart, in_root, single + away + count()), np.where(apart, root_own, root)
    uniform = np.full(len(held), 1 / (seats.types + 1))
    every, near = np.arange(len(some)), np.flatnonzero(ctx[some] != RARE)
    for sweep in range(BURN_IN + SAMPLES):
        step, drawn = (chain * 64 + sweep) * 128, near if sweep else every
        at = some[drawn]
        base = seats.root(customers, root, last)[owner[at]]
        tables[at] = drawn_tables(
            pair_keys[drawn], n[at], base, others[drawn], STRENGTH, seats.discount, step, tables[at]
        )
        customers = np.where(apart, in_root, single + away + count())
        root = root.copy()
        root[held] = drawn_tables(
            keys[held], customers[held], uniform, root_others, ROOT_STRENGTH, seats.root_discount, step + 64, root[held]
        )
        if sweep >= BURN_IN:
            yield tables.copy(), customers, root


def seat_rare(
    contexts: np.ndarray, keys: np.ndarray, n: np.ndarray, chance: np.ndarray, discount: float
) -> tuple[np.ndarray, ...]:
    """All tables of whole rare contexts, given each word's probability in the parent.

    Returns the contexts, each one's customers and what opens a table there, and for each pair its
    customers less the discount of its tables. Tables are means over samples.
    """
    found, at = np.unique(contexts, return_inverse=True)
    tables, mean, some = np.ones(len(n), np.int64), np.zeros(len(n)), np.flatnonzero(n > 1)
    draws = mixed(keys[some])
    for sweep in range(BURN_IN + SAMPLES):
        others = np.bincount(at, tables, len(found))[at[some]] - tables[some]
        step = (ROUNDS * 64 + sweep) * 128
        tables[some] = drawn_tables(draws, n[some], chance[some], others, STRENGTH, discount, step, tables[some])
        if sweep >= BURN_IN:
            mean += tables / SAMPLES
    opens = STRENGTH + discount * np.bincount(at, mean, len(found))
    return found, np.bincount(at, n, len(found)), opens, np.maximum(n - discount * mean, 0)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, ...]]]:
    """Slices of word rows with few pairs, or one row, and their words, contexts, counts and owners,
    the hashes of rare contexts and whether rows lie apart."""
    for batch in batches:
        ends = np.cumsum(np.diff(batch.column("ctx").offsets.to_numpy()))
        begin = 0
        while begin < len(batch):
            before = ends[begin - 1] if begin else 0
            end = max(int(np.searchsorted(ends, before + SLICE_PAIRS, side="right")), begin + 1)
            part = batch.slice(begin, end - begin)
            ctx, runs = flat_lists(part.column("ctx"), np.int64)
            n, _ = flat_lists(part.column("n"), np.int64)
            words = part.column("w").to_numpy().view(np.uint64)
            far = np.zeros(len(ctx), np.uint64)
            far[ctx == RARE] = flat_lists(part.column("far"), np.int64)[0].view(np.uint64)
            apart = part.column("apart").to_numpy(zero_copy_only=False)
            yield part, (words, ctx, n, np.repeat(np.arange(len(words)), runs), far, apart)
            begin = end


def _summed(rows: DataFrame, sums, length: int) -> np.ndarray:
    """The sum over all batches of a vector of fixed length, by way of one row an entry and task."""

    def run(batches):
        total = np.zeros(length)
        for _, arrays in _slices(batches):
            total += sums(*arrays)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "v"])

    held = rows.select("w", "ctx", "n", "far", "apart").mapInArrow(run, "at int, v double")
    out = np.zeros(length)
    got = held.groupBy("at").agg(F.sum("v").alias("v")).toPandas()  # at most `length` rows
    out[got["at"].to_numpy()] = got["v"].to_numpy()
    return out


def learn(rows: DataFrame, contexts: np.ndarray) -> Seats:
    """Counts, discounts and the samples of the last round, from the rows of all words."""
    k = len(contexts) + 2
    blank = Seats(contexts, 0, 0, *[np.zeros(0)] * 4, 0.5, 0.5)

    def by_id(ids, values):
        out = np.bincount(ids, values, k)
        out[RARE] = 0
        return out

    def counts(words, ctx, n, owner, far, apart):
        kinds, c = np.bincount(owner, minlength=len(words)), np.bincount(owner, n, len(words))
        ids = blank.word_ids(words)
        alone = kinds[ids == RARE]
        few = [(n == 1).sum(), (n == 2).sum(), (alone == 1).sum(), (alone == 2).sum()]
        whole = [n.sum(), (~apart).sum(), len(ctx)]
        vectors = [np.bincount(ctx, n, k), np.bincount(ctx, minlength=k), *[by_id(ids, v) for v in (c, kinds * apart, kinds)]]
        return np.concatenate([*vectors, few, whole])

    got = _summed(rows, counts, 5 * k + 7)
    customers, kinds, c, away, in_root = got[: 5 * k].reshape(5, k)
    n1, n2, r1, r2, tokens, types, pairs = got[5 * k :]
    r1, r2 = r1 + (in_root == 1).sum(), r2 + (in_root == 2).sum()
    discount = lambda one, two: float(np.clip(one / max(one + 2 * two, 1), 0.1, 0.95))
    seats = Seats(
        contexts, tokens, types, customers, kinds[None], np.array([pairs]), np.array([types]), discount(n1, n2), discount(r1, r2),
        None, c, away[None], in_root[None], np.minimum(in_root, 1)[None],
    )

    def sums(ids, ctx, owner, apart, t, customers, root):
        own = np.bincount(owner, t, len(ids))
        vectors = [by_id(ids, v) for v in (own * apart, customers * ~apart, root * ~apart)]
        return [np.bincount(ctx, t, k), *vectors, [customers[~apart].sum(), root[~apart].sum()]]

    def after(before, got):
        tables, away, in_root, root_own = (got[:, i * k : (i + 1) * k] for i in range(4))
        known = {"tables": tables, "root_customers": got[:, 4 * k], "root_tables": got[:, 4 * k + 1]}
        return replace(before, **known, earlier=before, away=away, in_root=in_root, root_own=root_own)

    def first(words, ctx, n, owner, far, apart, seats=seats):
        return np.concatenate(sums(blank.word_ids(words), ctx, owner, apart, *first_seatings(words, ctx, n, owner, seats, apart)))

    seats = after(seats, _summed(rows, first, 4 * k + 2)[None])
    for chain in range(ROUNDS):

        def tables(words, ctx, n, owner, far, apart, seats=seats, chain=chain):
            samples = sample_seatings(words, ctx, n, owner, seats, chain, far, apart)
            ids = blank.word_ids(words)
            return np.concatenate([v for s in samples for v in sums(ids, ctx, owner, apart, *s)])

        before, got = seats, _summed(rows, tables, SAMPLES * (4 * k + 2)).reshape(SAMPLES, 4 * k + 2)
        seats = after(before, got)
    return before, seats


def _predictions(rows: DataFrame, before: Seats, seats: Seats, buckets: int) -> DataFrame:
    """``w, c, root, ctx, own``: a word's parent probability by sample, and its customers in each
    context less the discount of its mean number of tables: the last round, drawn once more.

    In other rows ``bucket, far, key, n, chance``: rare contexts of the bucket, each with a word's
    customers there and its parent probability. Lists are the bytes of numbers.
    """
    near_kind = {"w": pa.int64(), "c": pa.int64(), "root": pa.binary(), "ctx": pa.binary(), "own": pa.binary()}
    far_kind = ("far", "key", "n", "chance")
    schema = pa.schema({**near_kind, "bucket": pa.int32(), **dict.fromkeys(far_kind, pa.binary())})

    def row_batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def run(batches):
        for batch, (words, ctx, n, owner, far, apart) in _slices(batches):
            tables, roots, ids = np.zeros(len(ctx)), [], seats.word_ids(words)
            samples = sample_seatings(words, ctx, n, owner, before, ROUNDS - 1, far, apart)
            for s, (t, customers, root) in enumerate(samples):
                tables += t / SAMPLES
                roots.append(np.where(apart, seats.chances(ids, s), seats.root(customers, root, s)))
            roots = np.column_stack(roots)
            held, near = np.flatnonzero(~apart), ctx != RARE
            own = np.maximum(n - seats.discount * tables, 0).astype(np.float32)
            offsets = np.searchsorted(owner[near], np.append(held, len(words)))
            c = np.where(ids == RARE, batch.column("c").to_numpy(), seats.counts[ids]).astype(np.int64)
            each = np.arange(len(held) + 1) * SAMPLES
            yield row_batch({
                "w": pa.array(words[held].view(np.int64)),
                "c": pa.array(c[held]),
                "root": _bytes(roots[held].ravel(), each),
                "ctx": _bytes(ctx[near].astype(np.int16), offsets),
                "own": _bytes(own[near], offsets),
            })
            order, begin = bucket_order(_bucket(far[~near], buckets), buckets)
            some = np.flatnonzero(np.diff(begin))
            rare = np.flatnonzero(~near)[order]
            begin = np.append(begin[some], len(rare))
            values = far[rare], _pair_keys(words[owner[rare]], far[rare])
            values += n[rare].astype(np.int32), roots.mean(1)[owner[rare]].astype(np.float32)
            yield row_batch({"bucket": pa.array(some.astype(np.int32)), **{c: _bytes(v, begin) for c, v in zip(far_kind, values)}})

    kind = "w bigint, c bigint, root binary, ctx binary, own binary, bucket int"
    return rows.mapInArrow(run, f"{kind}, far binary, key binary, n binary, chance binary")


def _rare_ranges(rare: pa.Table, discount: float) -> tuple[np.ndarray, ...]:
    """``seat_rare`` of a bucket's rare contexts, some contexts at once: contexts in order, their
    customers and what opens a table there; keys of pairs in order, and how many times the word's
    probability in the parent the customers less the discount of their tables make."""
    far, keys = (_values(rare[c], np.uint64) for c in ("far", "key"))
    n, chance = _values(rare["n"], np.int32), _values(rare["chance"], np.float32)
    ranges = max(-(-len(far) // RANGE_VALUES), 1)
    contexts, own = [], np.empty(len(far))
    bounds = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
    part = np.searchsorted(bounds, far, side="right").astype(np.int16)
    for i in range(ranges):
        at = np.flatnonzero(part == i)
        likely = chance[at].astype(float)
        *of_contexts, left = seat_rare(far[at], keys[at], n[at].astype(np.int64), likely, discount)
        contexts.append(of_contexts)
        own[at] = left / np.maximum(likely, 1e-300)
    by = np.argsort(keys)
    return *(np.concatenate(v) for v in zip(*contexts)), keys[by], own[by]


def _score_bucket(asked: pa.Table, known: pa.Table, seats: Seats) -> pa.Table:
    """Sums by text over the tokens of one bucket of words, and the tokens after its rare contexts.

    The probability of a token after a rare context is a product: that of its word in the parent,
    and how many times that the context makes of it.
    """
    release()
    apart = known["w"].is_null()
    rare = known.select(["far", "key", "n", "chance"]).filter(apart)
    known = known.select(["w", "c", "root", "ctx", "own"]).filter(known["w"].is_valid())
    far_words, far_customers, far_opens, keys, far_own = _rare_ranges(rare, seats.discount)
    del rare

    order = np.argsort(known["w"].to_numpy().view(np.uint64))
    words = known["w"].to_numpy().view(np.uint64)[order]
    count = known["c"].to_numpy()[order]
    roots = _values(known["root"], float).reshape(-1, SAMPLES)[order]
    ctx, runs = _values(known["ctx"], np.int16).astype(np.int64), _counts(known["ctx"], np.int16)
    own = _values(known["own"], np.float32)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    pairs = np.repeat(place, runs) << 16 | ctx
    by = np.argsort(pairs)
    pairs, own = pairs[by], own[by]
    del known, ctx, runs, by
    unknown = np.array([seats.root(0, 0, s) for s in range(SAMPLES)])
    opens = (STRENGTH + seats.discount * seats.tables) / SAMPLES
    opens[:, RARE] = 1 / SAMPLES
    held = STRENGTH + seats.customers
    held[RARE] = 1
    smooth = seats.tokens + 0.5 * (seats.types + 1)

    out = []
    for i in range(len(asked)):
        row = asked.slice(i, 1)
        w, key = (_values(row[c], np.uint64) for c in ("w", "far_key"))
        runs, n, far_runs, far_n = (_values(row[c], np.int32).astype(np.int64) for c in ("runs", "n", "far_runs", "far_n"))
        ctx, text, far_text = (_values(row[c], np.int16).astype(np.int64) for c in ("ctx", "doc", "far_doc"))
        at = np.minimum(np.searchsorted(words, w), max(len(words) - 1, 0))
        hit = words[at] == w if len(words) else np.zeros(len(w), bool)
        c = np.where(hit, count[at], 0) if len(words) else np.zeros(len(w))
        root = np.where(hit[:, None], roots[at], unknown) if len(words) else np.tile(unknown, (len(w), 1))
        each = np.repeat(np.arange(len(w)), runs)
        wanted = np.where(hit, at, -1)[each] << 16 | ctx
        near = np.minimum(np.searchsorted(pairs, wanted), max(len(pairs) - 1, 0))
        seen = np.where(pairs[near] == wanted, own[near], 0.0) if len(pairs) else np.zeros(len(ctx))
        rest = sum(opens[s][ctx] * root[each, s] for s in range(SAMPLES))
        chance = (seen + rest) / held[ctx]
        texts = len(row["key"][0])
        v = np.repeat(w, far_runs)
        at = np.minimum(np.searchsorted(far_words, v), max(len(far_words) - 1, 0))
        hit = far_words[at] == v if len(far_words) else np.zeros(len(v), bool)
        customers, fresh = np.zeros(len(v)), np.full(len(v), STRENGTH)
        customers[hit], fresh[hit] = far_customers[at[hit]], far_opens[at[hit]]
        by, near = np.argsort(key), np.empty(len(key), np.int64)  # far faster in order
        near[by] = np.minimum(np.searchsorted(keys, key[by]), max(len(keys) - 1, 0))
        seen = np.where(keys[near] == key, far_own[near], 0.0) if len(keys) else np.zeros(len(v))
        after = np.bincount(far_text, np.log10((seen + fresh) / (STRENGTH + customers)) * far_n, texts)
        total = lambda v: np.bincount(text, v * n, texts)  # noqa: B023, E731
        out.append(pa.table({
            "key": row["key"].combine_chunks().flatten(),
            "body": row["body"].combine_chunks().flatten(),
            "tokens": total(np.ones(len(n))).astype(np.int64),
            "known": total((c > 0)[each]).astype(np.int64),
            "ends": total((w == END)[each]).astype(np.int64),
            "base": total(np.log10((c + 0.5) / smooth)[each]),
            "score": total(np.log10(chance)) + after,
        }))
    if not out:
        none = np.empty(0)
        kind = asked.schema.field("key").type.value_type
        numbers = {n: pa.array(none, pa.int64()) for n in ("body", "tokens", "known", "ends")}
        return pa.table({"key": pa.array([], kind), **numbers, "base": none, "score": none})
    return pa.concat_tables(out)


def score(
    docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, n_tokens, n_known, train_tokens, base_score, score, perplexity`` per row of ``docs``.

    The model learns from ``training``. Tokens are the words of the whole text, lower-cased in
    A-Z, and one end. ``score`` is the log10 probability of the tokens, each given the one before,
    with probabilities averaged over the sampled seatings, ``perplexity`` the same a token;
    ``base_score`` is that of a smoothed unigram model of the same counts. Null texts are empty and have an end alone. Rows with equal
    key and text are scored once and returned as often as they occur; null keys are fine, other
    columns are ignored, an empty table gives no rows. Without training texts all words are unknown.
    """
    learnt = _texts(training, key, text)
    size = learnt.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    contexts = frequent_words(learnt)
    blank = Seats(contexts, 0, 0, *[np.zeros(0)] * 4, 0.5, 0.5)
    buckets = max(LEAST_BUCKETS, -(-size // (6 * BUCKET_TOKENS)))  # words of about five letters
    rows = stored(word_rows(learnt, blank, buckets))
    release_unused(docs.sparkSession)
    before, seats = learn(rows, contexts)
    parts = sums_by_text(_texts(docs, key, text), rows, before, seats, buckets)
    sums = parts.groupBy("key", "body").agg(*[F.sum(c).alias(c) for c in ("tokens", "known", "ends", "base", "score")])
    each = sums.withColumn("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("ends"))))
    return each.select(
        F.col("key").alias(key),
        (F.col("tokens") / F.col("ends")).cast("bigint").alias("n_tokens"),
        (F.col("known") / F.col("ends")).cast("bigint").alias("n_known"),
        F.lit(int(seats.tokens)).cast("bigint").alias("train_tokens"),
        (F.col("base") / F.col("ends")).alias("base_score"),
        (F.col("score") / F.col("ends")).alias("score"),
        F.pow(F.lit(10.0), -F.col("score") / F.col("tokens")).alias("perplexity"),
    )


def perplexity(scores: DataFrame) -> DataFrame:
    """``n_tokens, perplexity`` of all rows of ``score`` together; no row without tokens."""
    sums = scores.agg(F.sum("n_tokens").alias("n_tokens"), F.sum("score").alias("score")).filter("n_tokens > 0")
    return sums.select("n_tokens", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def sums_by_text(texts: DataFrame, rows: DataFrame, before: Seats, seats: Seats, buckets: int) -> DataFrame:
    """``key, body, tokens, known, ends, base, score``: what the tokens of each text in each bucket of
    words add up to. A text has no row for a bucket without a token of its own."""
    most = np.flatnonzero(seats.counts > seats.tokens * HOT_SHARE)  # fewer than 1 / HOT_SHARE words
    hot = np.sort(np.append(seats.contexts, END)[np.where(most == START, -1, most - 2)])

    def asks(batches):
        for table, tokens in _flushes(batches):
            words, at = _coded(tokens.words)
            ids = seats.ids(words)
            ctx = np.empty(len(at), np.int64)
            ctx[1:] = ids[at[:-1]]
            ctx[tokens.first] = START
            keys = at << 32 | ctx << 16 | tokens.texts
            keys, n = np.unique(keys, return_counts=True)
            home = _bucket(words, buckets)
            salt = int(mixed(table["body"].to_numpy()[:1].view(np.uint64))[0] % np.uint64(HOT_SPREAD))
            own, spread = home.copy(), np.isin(words, hot)
            own[spread] = (own[spread] + salt) % buckets
            values = {"ctx": (keys >> 16 & 0xFFFF).astype(np.int16), "doc": (keys & 0xFFFF).astype(np.int16), "n": n.astype(np.int32)}
            # What follows rare contexts, in the context's bucket; its word is a token of the text.
            late = np.flatnonzero(ctx == RARE)
            after = at[late - 1].astype(np.uint64) << np.uint64(40) | at[late].astype(np.uint64) << np.uint64(16) | tokens.texts[late].astype(np.uint64)
            after, times = np.unique(after, return_counts=True)
            context, word = (after >> np.uint64(40)).astype(np.int64), (after >> np.uint64(16) & np.uint64(0xFFFFFF)).astype(np.int64)
            more = {"far_key": _pair_keys(words[word], words[context]), "far_doc": (after & np.uint64(0xFFFF)).astype(np.int64)}
            more["far_n"] = times.astype(np.int32)
            whole = {c: table[c].combine_chunks() for c in ("key", "body")}
            yield from _packed(words, keys >> 32, own[keys >> 32], values, (context, home[context], more), **whole)

    kind = texts.schema["key"].dataType.simpleString()
    packed = f"bucket int, key array<{kind}>, body array<bigint>, w binary, runs binary, ctx binary, doc binary, n binary"
    packed += ", far_key binary, far_doc binary, far_n binary, far_runs binary"
    asked = texts.mapInArrow(asks, packed)
    copies = F.when(F.col("w").isin(hot.view(np.int64).tolist()), F.lit(min(HOT_SPREAD, buckets))).otherwise(F.lit(1))
    at = F.pmod(F.shiftrightunsigned("w", 20), F.lit(int(buckets)))
    known = _predictions(rows, before, seats, buckets).withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    known = known.withColumn("bucket", F.coalesce("bucket", ((at + F.col("salt")) % buckets).cast("int"))).drop("salt")
    met = asked.groupBy("bucket").cogroup(known.groupBy("bucket"))
    result = f"key {kind}, body bigint, tokens bigint, known bigint, ends bigint, base double, score double"
    return met.applyInArrow(lambda a, b: _score_bucket(a, b, seats), result)
