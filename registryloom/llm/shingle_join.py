"""Similarity join of texts on word shingles, by prefixes of single shingles and shingle pairs.

Shingles have one global order: rare ones first, then by hash. Two sets that are similar enough
differ in few shingles, so a short prefix of one must meet the prefix of the other: in one rare
shingle, or in two frequent ones of the same small class. Prefixes grow until that is certain.
Frequent shingles alone thus never bring texts together, only pairs of them do, and rare ones are
indexed one by one. What meets is verified on the whole sets.

Nothing lists all pairs of a group that meets: its members are first compared with one of them,
and only members that this leaves in different components are compared with each other. Large
groups that share members act as one, and what is left of them is compared block by block inside
tasks, which return no more links than join components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registryloom.llm.common import WORD, saved, small_batches
from registryloom.llm.words import Words, flat_lists, list_array, mixed, word_chunks

#: Words of a shingle, and the similarity from which on two sets are linked, in percent.
SHINGLE, PERCENT = 5, 80
#: Shingles in so many texts are frequent.
FREQUENT = 5
#: Frequency classes are kept in a table of 2^27 bits, whatever the corpus. A rare shingle that
#: shares its bit with a frequent one is treated as frequent, which changes no result.
TABLE_BITS = 27
#: Shingles that a task counts at once, that a bucket of signatures stands for, and shingles and
#: texts that a task holds before it passes on.
COUNT_SHINGLES, BUCKET_SHINGLES, FLUSH_SHINGLES, FLUSH_TEXTS = 1_000_000, 3_000_000, 1_200_000, 30_000
#: Shingles whose signatures a task makes at once, about.
SIGN_SHINGLES = 150_000
#: A signature that so many texts of one flush share is not sent text by text to one place.
LOCAL_HOT = 256
#: Rounds that compare a group's members with one of them.
STAR_ROUNDS = 2
#: Members that are compared with one text in the same task, and shingles that a task compares.
PARTNERS, COMPARE_SHINGLES = 512, 1_500_000
#: From so many members on, a group is large; its members are compared in blocks of this many.
LARGE, BLOCK = 64, 256
#: Up to so many wanted texts, their ids are broadcast; beyond, texts are joined by shuffle.
BROADCAST_IDS = 4_000_000

_FACTORS = np.random.Generator(np.random.PCG64(5)).integers(0, 2**62, 8, np.uint64) * np.uint64(2) + np.uint64(1)


class Sets:
    """The distinct shingles of some texts: text i has ``hashes[first[i]:first[i + 1]]``, sorted.

    Hashes have 64 bits. A text with fewer words than a shingle has all its words as the only one.
    """

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        self.hashes, self.first = hashes, first
        self.n = np.diff(first)

    @cached_property
    def owner(self) -> np.ndarray:
        """The text that each shingle belongs to."""
        return np.repeat(np.arange(len(self.n)), self.n)

    @classmethod
    def of(cls, words: Words) -> Sets:
        w, owner, counts = words.hashes, words.owners(), np.diff(words.first)
        texts = len(counts)
        long = max(len(w) - SHINGLE + 1, 0)
        rolled = np.zeros(long, np.uint64)
        for j in range(SHINGLE):
            rolled += w[j : j + long] * _FACTORS[j]
        whole = owner[:long] == owner[SHINGLE - 1 :][:long]
        short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        folded = counts[short].astype(np.uint64) * _FACTORS[-1]
        for j in range(SHINGLE - 1):
            has = counts[short] > j
            folded[has] += w[words.first[short[has]] + j] * _FACTORS[j]
        hashes = mixed(np.concatenate([rolled[whole], folded]))
        owners = np.concatenate([owner[:long][whole], short])
        small = owners.astype(np.uint16) if texts < 1 << 16 else owners
        order = np.argsort(hashes)
        order = order[np.argsort(small[order], kind="stable")]
        hashes, owners = hashes[order], owners[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
        return cls(hashes[new], np.searchsorted(owners[new], np.arange(texts + 1)))

    def sums(self, salt: int) -> np.ndarray:
        """One number a set that equal sets share."""
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(self.hashes ^ np.uint64(salt)), dtype=np.uint64)])
        return mixed(total[self.first[1:]] - total[self.first[:-1]])

    def take(self, texts: np.ndarray) -> Sets:
        parts = [self.hashes[self.first[i] : self.first[i + 1]] for i in texts]
        return Sets(np.concatenate([np.empty(0, np.uint64), *parts]), np.cumsum([0, *map(len, parts)]))


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, Sets]]:
    """Sets of as many texts as fit the limits, with the other columns of their rows."""
    held: list[tuple[pa.RecordBatch, Sets]] = []

    def joined() -> tuple[pa.Table, Sets]:
        n = np.concatenate([[0], *[s.n for _, s in held]])
        hashes = np.concatenate([s.hashes for _, s in held])
        return pa.Table.from_batches([b for b, _ in held]), Sets(hashes, np.cumsum(n))

    for batch, words in word_chunks(batches):
        sets = Sets.of(words)
        size = sum(len(s.hashes) for _, s in held) + len(sets.hashes)
        if held and (size > FLUSH_SHINGLES or sum(len(b) for b, _ in held) + len(batch) > FLUSH_TEXTS):
            yield joined()
            held = []
        held.append((batch.drop_columns(["text"]), sets))
    if held:
        yield joined()


def set_ids(texts: DataFrame) -> DataFrame:
    """``doc, n, s1, s2`` per row of ``texts(doc, text)``: the set's size and two hashes of it."""

    def run(batches):
        for batch, words in word_chunks(batches):
            sets = Sets.of(words)
            numbers = [sets.n, sets.sums(1).view(np.int64), sets.sums(2).view(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *map(pa.array, numbers)], ["doc", "n", "s1", "s2"])

    return texts.mapInArrow(run, "doc bigint, n bigint, s1 bigint, s2 bigint")


def frequent_table(texts: DataFrame, shingles: int) -> Broadcast:
    """The bits of all frequent shingles, counted over all texts.

    A shingle's leading bits name its bucket; the next 40 are sent to it in five bytes, once for
    all texts of a flush. Each bucket answers with its own stretch of the table.
    """
    k = int(np.clip(np.ceil(np.log2(max(shingles, 1) / COUNT_SHINGLES)), 3, 14))

    def count(batches):
        for _, sets in _flushes(batches):
            hashes = sets.hashes
            hashes.sort()
            begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)])
            n = np.diff(np.append(begin, len(hashes))).astype(np.int32)
            hashes = hashes[begin]
            cut = [*np.searchsorted(hashes, np.arange(1 << k, dtype=np.uint64) << np.uint64(64 - k)).tolist(), len(hashes)]
            for b in np.flatnonzero(np.diff(cut)):
                own = slice(cut[b], cut[b + 1])
                tails = (hashes[own] >> np.uint64(24 - k)) & np.uint64((1 << 40) - 1)
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([b], pa.int32()),
                    "tails": [tails.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()],
                    "n": list_array(n[own], np.array([0, cut[b + 1] - cut[b]])),
                })

    def gather(table: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(table["tails"].to_pylist()), np.uint8).reshape(-1, 5)
        tails = np.zeros((len(raw), 8), np.uint8)
        tails[:, :5] = raw
        tails, n = tails.view(np.uint64).ravel(), flat_lists(table["n"], np.int64)[0]
        order = np.argsort(tails)
        tails, n = tails[order], n[order]
        begin = np.flatnonzero(np.concatenate([[True], tails[1:] != tails[:-1]]))
        frequent = tails[begin[np.add.reduceat(n, begin) >= FREQUENT]]
        bits = np.zeros(1 << (TABLE_BITS - k), bool)
        bits[frequent >> np.uint64(40 + k - TABLE_BITS)] = True
        return pa.table({"bucket": table["bucket"][:1], "bits": [np.packbits(bits).tobytes()]})

    packed = texts.mapInArrow(count, "bucket int, tails binary, n array<int>")
    parts = packed.groupBy("bucket").applyInArrow(gather, "bucket int, bits binary").collect()
    table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)  # 2^24 bytes, with all buckets together
    for part in parts:
        bits = np.frombuffer(part["bits"], np.uint8)
        table[part["bucket"] * len(bits) : (part["bucket"] + 1) * len(bits)] = bits
    return texts.sparkSession.sparkContext.broadcast(table)


def _level(n: int) -> int:
    """Frequent shingles of a set this large fall into 2^level classes, two or so of a prefix in each."""
    return max(int(n * 0.176).bit_length() - 1, 0)


def pair_signatures(frequent: np.ndarray, n: int, need: int) -> np.ndarray:
    """Pairs of one class in the shortest prefix of frequent shingles that is certain to suffice.

    A prefix with s shingles in a class can lose s - 1 of them before no pair is left; over all
    classes that must exceed what may differ. Partners up to a quarter larger may have one class
    level more, so signatures are made for both levels.
    """
    out = [np.empty(0, np.uint64)]
    for level in {_level(n), _level(n * 100 // PERCENT)}:
        classes = (frequent >> np.uint64(7)) & np.uint64((1 << level) - 1)
        repeated = np.ones(len(frequent), bool)
        repeated[np.unique(classes, return_index=True)[1]] = False
        enough = int(np.searchsorted(np.cumsum(repeated), need)) + 1
        order = np.argsort(classes[:enough], kind="stable")
        held, own = frequent[:enough][order], classes[:enough][order]
        for step in range(1, len(own)):
            same = np.flatnonzero(own[step:] == own[:-step])
            if not len(same):
                break
            both = held[same] * _FACTORS[0] + held[same + step] * _FACTORS[1]
            out.append(mixed(both ^ _FACTORS[4 + level % 4] + np.uint64(level)))
    return np.concatenate(out)


def signatures(sets: Sets, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(text, signature)`` pairs: similar texts, if not equal, share at least one."""
    cut = [0, *(np.flatnonzero(np.diff(sets.first[1:] // SIGN_SHINGLES)) + 1).tolist(), len(sets.n)]
    parts = []
    for a, b in zip(cut[:-1], cut[1:]):
        first = sets.first[a : b + 1]
        text, sig = _signatures(Sets(sets.hashes[first[0] : first[-1]], first - first[0]), table)
        parts.append((text + a, sig))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _signatures(sets: Sets, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cell = sets.hashes >> np.uint64(64 - TABLE_BITS)
    bit = np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8)
    frequent = (table[cell >> np.uint64(3)] >> bit & 1).astype(bool)
    least = (sets.n * PERCENT + 99) // 100  # what a partner must share
    need = sets.n - least + 1
    rare_before = np.concatenate([[0], np.cumsum(~frequent)])
    rank = rare_before[:-1] - rare_before[sets.first[:-1]][sets.owner]
    single = ~frequent & (rank < need[sets.owner])
    texts, found = [sets.owner[single]], [mixed(sets.hashes[single] ^ _FACTORS[3])]
    rare = rare_before[sets.first[1:]] - rare_before[sets.first[:-1]]
    for i in np.flatnonzero(rare < need):
        own = slice(sets.first[i], sets.first[i + 1])
        pairs = pair_signatures(sets.hashes[own][frequent[own]], int(sets.n[i]), int(need[i] - rare[i]))
        texts.append(np.full(len(pairs), i))
        found.append(pairs)
    return np.concatenate(texts), np.concatenate(found)


def meeting_groups(texts: DataFrame, table: Broadcast, buckets: int) -> DataFrame:
    """``gid, doc``: texts that share a signature; of equal groups in one bucket one stays.

    Groups with members elsewhere, in whole rows, are told apart and stay all.
    """

    def ask(batches):
        for rows, sets in _flushes(batches):
            docs = rows["doc"].to_numpy()
            # Equal sets of one flush act as one, and sets of up to three shingles link to none but equals.
            same = np.lexsort((docs, sets.sums(2), sets.sums(1), sets.n))
            ids = np.stack([sets.n.astype(np.uint64), sets.sums(1), sets.sums(2)])[:, same]
            first = np.ones(len(same), bool)
            first[1:] = (ids[:, 1:] != ids[:, :-1]).any(0)
            chosen = np.sort(same[first & (sets.n[same] > 3)])
            own, docs = sets.take(chosen), docs[chosen]
            text, sig = signatures(own, table.value)
            by = np.argsort(sig, kind="stable")
            text, sig = text[by], sig[by]
            begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, int)
            runs = np.diff(np.append(begin, len(sig)))
            keep = np.ones(len(sig), bool)
            hot = sig[begin[runs >= LOCAL_HOT]]
            for a, n in zip(begin[runs >= LOCAL_HOT], runs[runs >= LOCAL_HOT]):
                members = docs[text[a : a + n]]
                keep[a : a + n] = False
                keep[a + int(np.argmin(members))] = True
                place = int(mixed(sig[a : a + 1] + np.uint64(docs[0] & 0xFFFF))[0] % np.uint64(buckets))
                yield _asked(place, sig[a : a + 1], members, np.zeros(n, np.uint16), hot[:0], whole=True)
            text, sig = text[keep], sig[keep]
            place, hot_place = ((s >> np.uint64(20)) % np.uint64(buckets) for s in (sig, hot))
            for b in range(buckets):
                at = place == b
                if at.any():
                    yield _asked(b, sig[at], docs, text[at].astype(np.uint16), hot[hot_place == b], whole=False)

    def meet(rows: pa.Table) -> pa.Table:
        gids, docs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        sigs, asked = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        hot = flat_lists(rows["hot"], np.int64)[0].view(np.uint64)
        for i in range(len(rows)):
            row = rows.slice(i, 1)
            sig = flat_lists(row["sig"], np.int64)[0].view(np.uint64)
            own = flat_lists(row["docs"], np.int64)[0]
            if row["whole"][0].as_py():
                gids.append(np.full(len(own), sig[0]))
                docs.append(own)
            else:
                sigs.append(sig)
                asked.append(own[flat_lists(row["text"], np.int16)[0].view(np.uint16)])
        sig, doc = np.concatenate(sigs), np.concatenate(asked)
        order = np.lexsort((doc, sig))
        sig, doc = sig[order], doc[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])
        sig, doc = sig[new], doc[new]
        begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, int)
        runs = np.diff(np.append(begin, len(sig)))
        total = np.add.reduceat(mixed(doc.view(np.uint64)), begin) if len(sig) else np.empty(0, np.uint64)
        group = mixed(total + runs.astype(np.uint64))
        whole = np.isin(sig[begin], hot)
        group[whole] = mixed(group[whole] ^ mixed(sig[begin][whole]))
        chosen = np.zeros(len(begin), bool)
        chosen[np.unique(group, return_index=True)[1]] = True
        chosen &= runs > 1
        member = np.repeat(chosen, runs)
        gids.append(sig[member])
        docs.append(doc[member])
        return pa.table({"gid": np.concatenate(gids).view(np.int64), "doc": np.concatenate(docs)})

    kind = "bucket int, whole boolean, sig array<bigint>, docs array<bigint>, text array<smallint>, hot array<bigint>"
    return texts.mapInArrow(ask, kind).groupBy("bucket").applyInArrow(meet, "gid bigint, doc bigint")


def _asked(bucket: int, sig: np.ndarray, docs: np.ndarray, text: np.ndarray, hot: np.ndarray, whole: bool) -> pa.RecordBatch:
    one = lambda v: list_array(v, np.array([0, len(v)]))
    return pa.RecordBatch.from_pydict({
        "bucket": pa.array([bucket], pa.int32()),
        "whole": [whole],
        "sig": one(sig.view(np.int64)),
        "docs": one(docs),
        "text": one(text.view(np.int16)),
        "hot": one(hot.view(np.int64)),
    })


def similar_pairs(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b``: those of ``pairs(a, b, na, nb)`` whose sets are similar, by their whole sets.

    Each text sends its set to the tasks of the texts ``a`` that it is compared with. A text with
    many partners is sent to several tasks, which share them.
    """
    salt = F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")
    partners = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k"), F.sum("nb").alias("load"), F.max("na").alias("na"))
    partners = partners.withColumn("salts", F.ceil(F.col("k") / PARTNERS))
    partners = saved(partners)
    load = partners.agg(F.sum(F.col("load") + F.col("na") * F.col("salts"))).first()[0] or 0
    tasks = int(max(load // COMPARE_SHINGLES + 1, 8))
    task = lambda c: F.pmod(F.xxhash64("a", c), F.lit(tasks)).cast("int")
    to_b = pairs.join(partners.select("a", "salts"), "a").withColumn("salt", salt)
    to_b = to_b.select(F.col("b").alias("doc"), "a", task(F.col("salt")).alias("task"))
    to_a = partners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts").cast("int") - 1)))
    to_a = to_a.select(F.col("a").alias("doc"), "a", task(F.col("salt")).alias("task"))
    goal = F.struct("task", "a")
    wanted = to_b.unionByName(to_a).groupBy("doc").agg(F.collect_set(goal).alias("goals"))
    wanted = _if_small(wanted)

    def send(batches):
        for batch, words in word_chunks(batches):
            sets = Sets.of(words)
            goals, counts = _goals(batch.column("goals"))
            at = np.repeat(np.arange(len(batch)), counts)
            sent = sets.take(at)
            arrays = [goals[0], goals[1], batch.column("doc").take(pa.array(at)), list_array(sent.hashes.view(np.int64), sent.first)]
            yield pa.RecordBatch.from_arrays(arrays, ["task", "a", "doc", "hashes"])

    def compare(rows: pa.Table) -> pa.Table:
        hashes, counts = flat_lists(rows["hashes"], np.int64)
        first = np.concatenate([[0], np.cumsum(counts)])
        a, doc = rows["a"].to_numpy(), rows["doc"].to_numpy()
        own: dict[int, list[int]] = {}
        for i in np.flatnonzero(a == doc):
            own.setdefault(int(a[i]), []).append(i)
        hit = np.zeros(len(a), bool)
        for i in np.flatnonzero(a != doc):
            mine = hashes[first[i] : first[i + 1]]
            hit[i] = any(_similar(mine, hashes[first[j] : first[j + 1]]) for j in own.get(int(a[i]), ()))
        return pa.table({"a": a[hit], "b": doc[hit]})

    held = texts.join(wanted, "doc").select("doc", "text", "goals")
    sent = held.mapInArrow(send, "task int, a bigint, doc bigint, hashes array<bigint>")
    return sent.groupBy("task").applyInArrow(compare, "a bigint, b bigint").distinct()


def _if_small(wanted: DataFrame) -> DataFrame:
    """Goals by text, broadcast where they are few; a goal counts a few numbers."""
    wanted = saved(wanted)
    goals = wanted.agg(F.sum(F.size("goals") + 1)).first()[0] or 0
    return F.broadcast(wanted) if goals <= BROADCAST_IDS else wanted


def _goals(column: pa.Array) -> tuple[list[pa.Array], np.ndarray]:
    counts = np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    return [flat.field("task"), flat.field("a")], counts


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Both sorted without repeats."""
    if min(len(x), len(y)) * 100 < PERCENT * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= PERCENT * (len(both) - shared)


def blocked_links(texts: DataFrame, members: DataFrame) -> DataFrame:
    """``a, b``: links that join components of the same group, ``members(gid, doc, label)``.

    Every member outside its group's first component meets every member, block against block; a
    block pair is one task's work, and a text is sent to the pairs of its block alone.
    """
    sizes = members.groupBy("gid").agg(F.min("label").alias("first"), F.count(F.lit(1)).alias("all"))
    held = members.join(sizes, "gid").withColumn("major", F.col("label") == F.col("first"))
    parts = held.groupBy("gid").agg(
        F.ceil(F.sum((~F.col("major")).cast("int")) / BLOCK).cast("int").alias("minors"),
        F.ceil(F.sum(F.col("major").cast("int")) / BLOCK).cast("int").alias("majors"),
    )
    held = held.join(parts.filter("minors > 0"), "gid")
    spot = lambda n: F.pmod(F.xxhash64("doc"), F.greatest(n, F.lit(1))).cast("int")
    major = F.col("major")
    own = F.when(major, F.col("minors") + spot(F.col("majors"))).otherwise(spot(F.col("minors")))
    others = F.sequence(F.lit(0), F.col("minors") - 1 + F.when(major, 0).otherwise(F.col("majors")))
    goals = held.withColumn("own", own).withColumn("other", F.explode(others))
    goal = F.struct(
        "gid", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "label"
    )
    wanted = _if_small(goals.groupBy("doc").agg(F.collect_list(goal).alias("goals")))

    def send(batches):
        for batch, words in word_chunks(batches):
            sets, column = Sets.of(words), batch.column("goals")
            counts = np.diff(column.offsets.to_numpy())
            at, flat = np.repeat(np.arange(len(batch)), counts), column.flatten()
            cut = np.flatnonzero(np.diff(np.cumsum(sets.n[at]) // FLUSH_SHINGLES)) + 1
            for a, b in zip([0, *cut], [*cut, len(at)]):
                sent = sets.take(at[a:b])
                fields = [flat.field(f).slice(a, b - a) for f in ("gid", "i", "j", "label")]
                fields += [batch.column("doc").take(pa.array(at[a:b]))]
                fields += [list_array(sent.hashes.view(np.int64), sent.first)]
                yield pa.RecordBatch.from_arrays(fields, ["gid", "i", "j", "label", "doc", "hashes"])

    kind = "gid bigint, i int, j int, label bigint, doc bigint, hashes array<bigint>"
    sent = texts.join(wanted, "doc").select("doc", "text", "goals").mapInArrow(send, kind)
    return sent.groupBy("gid", "i", "j").applyInArrow(_join_block, "a bigint, b bigint").distinct()


def _join_block(rows: pa.Table) -> pa.Table:
    """A link for each pair of components that one pair of blocks shows to be one."""
    hashes, n = flat_lists(rows["hashes"], np.int64)
    label, doc = rows["label"].to_numpy(), rows["doc"].to_numpy()
    owner = np.repeat(np.arange(len(n)), n)
    order = np.argsort(hashes, kind="stable")
    owner, hashes = owner[order], hashes[order]
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1  # a shingle of one text alone is in no intersection
    place = np.cumsum(often) - 1
    keep = often[column]
    owner, column = owner[keep], place[column[keep]]
    shared = np.zeros((len(n), len(n)), np.float32)
    for begin in range(0, int(often.sum()), 8_192):
        part = slice(*np.searchsorted(column, [begin, begin + 8_192]))
        has = np.zeros((len(n), 8_192), np.float32)
        has[owner[part], column[part] - begin] = 1
        shared += has @ has.T
    union = n[:, None] + n[None] - shared
    close = (100 * shared >= PERCENT * union) & (label[:, None] != label[None])
    root = {int(x): int(x) for x in label}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    links = []
    for x, y in zip(*np.nonzero(np.triu(close))):
        p, q = find(int(label[x])), find(int(label[y]))
        if p != q:
            root[max(p, q)] = min(p, q)
            links.append((int(doc[x]), int(doc[y])))
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _as_few(members: DataFrame) -> DataFrame:
    """``members`` with large groups that share a member turned into one, and which ones are large."""
    sizes = members.groupBy("gid").agg(F.count(F.lit(1)).alias("k"), F.min("doc").alias("low"))
    sized = members.join(sizes.filter("k > 1"), "gid")
    small = sized.filter(F.col("k") < LARGE).select("gid", "doc", "n", F.lit(False).alias("large"))
    large = saved(sized.filter(F.col("k") >= LARGE).select("doc", "n", "low"))
    if large.isEmpty():
        return small
    whole = components(large.select(F.col("doc").alias("a"), F.col("low").alias("b")))
    named = large.select("doc", "n").distinct().join(whole, "doc", "left")
    gid = F.coalesce("label", "doc").alias("gid")
    return small.unionByName(named.select(gid, "doc", "n", F.lit(True).alias("large")))


def components(links: DataFrame) -> DataFrame:
    """``doc, label``: the smallest document that each linked one can reach, ``links(a, b)``.

    Each round hangs a document's larger neighbours, and then itself, on its smallest one; edges
    only move to smaller ends, and when none moves any more every tree is a star. Sums are taken
    before a shuffle and joins split hot documents, so one with many links needs no large task.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(small.unionByName(lower.withColumnRenamed("m", "v")).distinct())
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state:
            return edges.select(F.col("u").alias("doc"), F.col("v").alias("label"))
        state = mark


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with the label of each document; those without a link are their own."""
    held = members.join(components(links), "doc", "left")
    return held.withColumn("label", F.coalesce("label", "doc"))


def _fitting(pairs: DataFrame) -> DataFrame:
    """``a < b`` once each, without pairs whose sizes alone rule them out."""
    near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT
    order = F.col("a") < F.col("b")
    flip = lambda x, y: F.when(order, F.col(x)).otherwise(F.col(y))
    pairs = pairs.filter(near & (F.col("a") != F.col("b")))
    pairs = pairs.select(flip("a", "b").alias("a"), flip("b", "a").alias("b"), flip("na", "nb").alias("na"), flip("nb", "na").alias("nb"))
    return pairs.distinct()


def linked(texts: DataFrame, members: DataFrame) -> DataFrame:
    """``a, b``: links that connect whatever the groups ``members(gid, doc, n)`` hold together.

    In each star round, the first member of each group that is not yet in its first component is
    compared with all members of other components. What is left, pairs of members in different
    components of one group, is then compared in full, so no link between components is lost.
    """
    members = saved(_as_few(members))
    links, done, labels = None, None, members.withColumn("label", F.col("doc"))
    for turn in range(STAR_ROUNDS + 1):
        if turn == STAR_ROUNDS:
            large = labels.filter("large").select("gid", "doc", "label")
            if not large.isEmpty():
                found = saved(blocked_links(texts, large))
                links = found if links is None else links.unionByName(found)
                labels = saved(_labelled(members, links))
            labels = labels.filter("not large")
        spans = labels.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        open_ = labels.join(spans.filter("low <> high"), "gid")
        first = open_ if turn == 0 else open_.filter(F.col("label") != F.col("low"))
        if turn < STAR_ROUNDS:
            first = first.groupBy("gid").agg(F.min(F.struct("doc", "n", "label")).alias("p")).select("gid", "p.*")
        first = first.select("gid", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
        other = open_.select("gid", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
        pairs = _fitting(first.join(other, "gid").filter("la <> lb"))
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = saved(pairs)
        if pairs.isEmpty():
            continue
        found = saved(similar_pairs(texts, pairs))
        links = found if links is None else links.unionByName(found)
        asked = pairs.select("a", "b")
        done = asked if done is None else done.unionByName(asked)
        if turn < STAR_ROUNDS:
            labels = saved(_labelled(members, links))
    return links


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id`` per row of ``docs``.

    A document's set holds the distinct shingles of its whole text, lower-cased in A-Z; two link
    from ``PERCENT`` percent of shared shingles on, and equal sets always do. ``component_id`` is
    the smallest key that links reach. Null and empty texts have no shingles and link to nothing.
    Keys are whole numbers. Rows with one key count as one document with all their sets; rows
    without a key get the component of the texts equal to theirs, if any, and connect nothing.
    Repeated rows are fine, other columns are ignored, an empty table gives no rows.
    """
    rows = small_batches(docs).select(F.col(key).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text"))
    ids = saved(set_ids(rows))
    full = ids.filter(F.col("n") > 0)
    classes = full.groupBy("n", "s1", "s2").agg(F.min("doc").alias("rep"))
    classes = saved(classes)
    of_doc = full.filter(F.col("doc").isNotNull()).join(classes, ["n", "s1", "s2"]).select("doc", "rep", "n").distinct()
    copies = of_doc.filter(F.col("doc") != F.col("rep")).select(F.col("doc").alias("a"), F.col("rep").alias("b"))

    shingles = ids.agg(F.sum("n")).first()[0] or 0
    named = rows.filter(F.col("doc").isNotNull())
    table = frequent_table(named, shingles)
    groups = meeting_groups(named, table, int(max(shingles // (2 * BUCKET_SHINGLES), 8)))
    members = groups.join(of_doc, "doc").select("gid", F.col("rep").alias("doc"), "n").distinct()
    links = linked(named, saved(members))
    links = copies if links is None else links.unionByName(copies)
    labels = components(links)
    out = ids.join(classes, ["n", "s1", "s2"], "left")
    node = F.coalesce("doc", "rep")
    out = out.withColumn("node", node).join(labels.withColumnRenamed("doc", "node"), "node", "left")
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("label", "node").alias("component_id"))


_DIGEST, _ROW = "__digest", "__row"


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of its component, with all their columns.

    Of rows that repeat a key, the first by a hash of all columns stays, so reruns agree. A row
    without a key goes if a row with one holds the same text; of those left, one of each text stays.
    Rows without a key nor any words stay all.
    """
    found = saved(near_duplicates(docs, key, text))
    others = found.filter(F.col(key) != F.col("component_id")).select(key).distinct()
    twice = saved(found.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").select(key))
    kept = docs.join(_small(others), key, "left_anti")
    if not twice.isEmpty():
        again = _first_rows(kept.join(_small(twice), key, "left_semi"), key)
        kept = kept.join(_small(twice), key, "left_anti").unionByName(again)
    if found.filter(F.col(key).isNull()).isEmpty():
        return kept
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    blank, lost = ~body.rlike(WORD), kept.filter(F.col(key).isNull())
    digest = F.sha2(body.cast("binary"), 256)
    named = kept.filter(F.col(key).isNotNull())
    unnamed = _first_rows(lost.filter(~blank).withColumn(_DIGEST, digest), _DIGEST)
    unnamed = unnamed.join(docs.filter(F.col(key).isNotNull()).select(digest.alias(_DIGEST)), _DIGEST, "left_anti")
    return reduce(DataFrame.unionByName, [named, lost.filter(blank), unnamed.drop(_DIGEST)])


def _first_rows(rows: DataFrame, by: str) -> DataFrame:
    """One row a value of ``by``: the first by a hash of all columns; no value's rows meet in one task whole."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    first = rows.groupBy(by).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(_ROW))
    return first.select(f"{_ROW}.*")


def _small(ids: DataFrame) -> DataFrame:
    ids = saved(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
