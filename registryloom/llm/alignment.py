"""Alignment of the tokens of two tokenizers by the bytes they cover.

Each text's tokens and bytes make two token-byte incidence matrices A and B; the rows of A·Bᵀ are
the overlaps of A's tokens with B's, in bytes. Byte offsets where tokens of both end cut the text
into groups; tokens and groups make two more matrices, whose product links all tokens that share a
group.

Where no token of either can reach across the start of a blank between words, texts are cut there
into parts. The distinct parts of many texts are aligned side by side, their matrices the blocks of
one diagonal, and a text has what its parts have: the product of the matrices text by part and
part by id pair.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registryloom.llm.common import most_frequent, saved, small_batches
from registryloom.llm.sparse import Rows, incidence, product, row_products, turned, work
from registryloom.llm.token_counts import TokenizerFile
from registryloom.llm.word_bpe import byte_letters
from registryloom.llm.words import flat_lists, held, list_array, string_chunks
from registryloom.sources.tables import shared_dir

#: Bytes and texts that are aligned at once, unless one text is longer: each distinct part of them is
#: encoded once, so more texts cost less a byte.
ALIGN_BYTES, ALIGN_ROWS = 3_500_000, 2_000
#: Id pairs whose counts every task holds, by count over the whole corpus; texts meet the counts
#: of all rarer pairs by a join, in which no pair can be hot.
HELD_PAIRS = 400_000

# Fixed value: how byte-level vocabularies part a text before they merge bytes.
_PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed value: the letter that stands for a space in pieces.
_PIECE_SPACE = "▁"
#: Texts that a normalising tokenizer would change.
_PROBE = "ﬁ Ⅷ  ｱ é \t x"
_BLANK_BEFORE_SPACE = re.compile(r"\s ")


class ByteTokenizer:
    """Ids of plain texts and the bytes that each id stands for; a space goes before each text.

    ``lead`` is that space, or empty if the tokenizer adds it itself. ``parted`` tells that no
    token reaches across a space that follows on a character other than blank.
    """

    def __init__(self, file: TokenizerFile):
        if file.kind == "model":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=file.content)
            self.lead = ""  # pieces begin with a space of their own
            self.encode = lambda texts: model.encode(texts, num_threads=1, add_bos=False, add_eos=False)
            self.bytes = [_piece_bytes(model, i) for i in range(model.get_piece_size())]
            pieces = (model.id_to_piece(i).lstrip(_PIECE_SPACE) for i in range(model.get_piece_size()))
            as_is = model.normalize(_PROBE) == _PIECE_SPACE + _PROBE.replace(" ", _PIECE_SPACE)
            self.parted = as_is and not any(_PIECE_SPACE in p for p in pieces)
        else:
            spec = json.loads(file.content)
            byte_of = {letter: b for b, letter in enumerate(byte_letters())}
            held = {i: bytes(map(byte_of.__getitem__, t)) for t, i in spec["model"]["vocab"].items()}
            self.lead = " "
            ranked = _ranked(spec, held)
            self.encode, self.parted = ranked or _by_library(file), ranked is not None
            added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
            self.bytes = [held.get(i, added.get(i, b"")) for i in range(max([*held, *added]) + 1)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def fits(self, ids: list[list[int]], raw: list[bytes]) -> np.ndarray:
        """Whether the bytes of each list of ids are the ones given."""
        joined = b"".join(map(self.bytes.__getitem__, chain.from_iterable(ids)))
        flat = np.fromiter(chain.from_iterable(ids), np.int64)
        token_ends = np.concatenate([[0], np.cumsum(self.lengths[flat])])
        ends = token_ends[np.cumsum([0, *map(len, ids)])]
        wanted = np.cumsum([0, *map(len, raw)])
        if joined == b"".join(raw) and np.array_equal(ends, wanted):
            return np.ones(len(raw), bool)
        cuts = ends.tolist()
        return np.array([joined[x:y] == r for x, y, r in zip(cuts[:-1], cuts[1:], raw)], bool)


def _piece_bytes(model, i: int) -> bytes:
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(_PIECE_SPACE, " ").encode()


def _ranked(spec: dict, held: dict[int, bytes]):
    """An encoder by ranks, several times as fast; None unless ids follow the order of the merges."""
    vocab, step = spec["model"]["vocab"], spec["pre_tokenizer"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    plain = step == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if made != list(range(256, 256 + len(made))) or not plain or spec["normalizer"]:
        return None
    import tiktoken

    ranks = {b: i for i, b in held.items() if i < 256 + len(made)}
    coder = tiktoken.Encoding("ranks", pat_str=_PARTS, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [coder.encode_ordinary(t) for t in texts]


def _by_library(file: TokenizerFile):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(file.content.decode())
    model.encode_special_tokens = True
    model.no_truncation()
    model.no_padding()
    return lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]


@dataclass(frozen=True)
class Aligned:
    """Texts side by side: their tokens' ids and ends on one line of bytes, and their groups.

    ``first_a[i]`` to ``first_a[i + 1]`` are A's tokens of text i, likewise ``first_b`` and
    ``first_group``; ``group_a`` and ``group_b`` tell the group of each token.
    """

    ids_a: np.ndarray
    ids_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    first_group: np.ndarray

    def bytes_a(self) -> Rows:
        return _on_bytes(self.ends_a)

    def bytes_b(self) -> Rows:
        return _on_bytes(self.ends_b)

    def groups_a(self) -> Rows:
        return incidence(np.arange(len(self.group_a) + 1), self.group_a, int(self.first_group[-1]))

    def groups_b(self) -> Rows:
        return incidence(np.arange(len(self.group_b) + 1), self.group_b, int(self.first_group[-1]))

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of A token, B token and the bytes they share, for all pairs that share any."""
        return row_products(self.bytes_a(), turned(self.bytes_b()))

    def shared_groups(self) -> Rows:
        """One row a token of A, with all of B's tokens of its group."""
        return product(self.groups_a(), turned(self.groups_b()))

    def n_shared(self) -> np.ndarray:
        """How many of B's tokens share the group of each token of A, without listing them."""
        return work(self.groups_a(), turned(self.groups_b()))


def _on_bytes(ends: np.ndarray) -> Rows:
    starts = np.concatenate([[0], ends])
    return incidence(starts, np.arange(starts[-1]), int(starts[-1]))


def aligned(a: ByteTokenizer, b: ByteTokenizer, ids_a: list[list[int]], ids_b: list[list[int]]) -> Aligned:
    """Texts of which both lists of ids cover the same bytes."""

    def line(coder: ByteTokenizer, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = np.concatenate([[0], np.cumsum([len(i) for i in ids], dtype=np.int64)])
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(first[-1]))
        return flat, np.cumsum(coder.lengths[flat]), first

    flat_a, ends_a, first_a = line(a, ids_a)
    flat_b, ends_b, first_b = line(b, ids_b)
    cuts = np.intersect1d(ends_a, ends_b)
    text_ends = np.concatenate([[0], ends_a])[first_a]
    group_a, group_b = (np.searchsorted(cuts, ends) for ends in (ends_a, ends_b))
    first_group = np.searchsorted(cuts, text_ends, side="right")
    return Aligned(flat_a, flat_b, ends_a, ends_b, first_a, first_b, group_a, group_b, first_group)


def group_texts(m: Aligned) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` for each text: the ids of both in each of its groups, in order."""
    ids = np.concatenate([m.ids_a, m.ids_b])
    # A token stands behind those of its own kind and those of the other in the groups before it.
    before_a = np.searchsorted(m.group_b, m.group_a, side="left")
    before_b = np.searchsorted(m.group_a, m.group_b, side="right")
    place = np.concatenate([np.arange(len(m.ids_a)) + before_a, np.arange(len(m.ids_b)) + before_b])
    last_a = np.concatenate([m.group_a[1:] != m.group_a[:-1], [True]])[: len(m.group_a)]
    last_b = np.concatenate([m.group_b[1:] != m.group_b[:-1], [True]])[: len(m.group_b)]
    marks = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
    value, mark = np.empty_like(ids), np.empty(len(ids), np.uint8)
    value[place], mark[place] = ids, np.concatenate(marks)
    powers = 10 ** np.arange(1, 10)
    digits = np.searchsorted(powers, value, side="right") + 1
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - 1] = mark
    for i in range(int(digits.max(initial=0))):
        long = digits > i
        out[ends[long] - 2 - i] = ord("0") + value[long] // 10**i % 10
    first = np.concatenate([[0], ends])[m.first_a + m.first_b].tolist()
    whole = out.tobytes()
    return [whole[x : max(x, y - 1)].decode() for x, y in zip(first[:-1], first[1:])]


def parts(text: str) -> list[str]:
    """The text, a space before it, cut before each space that follows on a character other than blank."""
    pieces = text.split(" ")
    if text[-1:] == " " or text[:1] == " " or _BLANK_BEFORE_SPACE.search(text):
        glued: list[str] = []
        for piece in pieces:
            if glued and (not piece or glued[-1][-1:].isspace() or not glued[-1]):
                glued[-1] += " " + piece
            else:
                glued.append(piece)
        pieces = glued
    return [" " + p for p in pieces]


def _pairs(m: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """``text, pair`` of each two tokens that overlap, a row each."""
    found = [np.empty((2, 0), np.int64)]
    for a, b, _ in m.overlaps():
        found.append(np.stack([np.searchsorted(m.first_a, a, side="right") - 1, (m.ids_a[a] << 32) | m.ids_b[b]]))
    return tuple(np.concatenate(found, axis=1))


_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")


def aligned_texts(a: ByteTokenizer, b: ByteTokenizer, texts: list[str]) -> tuple[np.ndarray, list[str], Rows, np.ndarray]:
    """For each text its ``_COUNTS``, its groups as text, and how often each id pair overlaps in it.

    The pairs are the columns of the matrix; the last array tells the pair of each column.
    """
    cut = parts if a.parted and b.parted else lambda t: [" " + t]
    split = [cut(t) if t else [] for t in texts]
    place = {p: i for i, p in enumerate(set().union(*split))}
    ids_a = a.encode([p if a.lead else p[1:] for p in place])
    ids_b = b.encode([p if b.lead else p[1:] for p in place])
    raw = [p.encode() for p in place]
    fits = a.fits(ids_a, raw) & b.fits(ids_b, raw)
    for i in np.flatnonzero(~fits):
        ids_a[i], ids_b[i] = [], []
    m = aligned(a, b, ids_a, ids_b)

    # Texts by parts, without those of which any part does not fit.
    first = np.concatenate([[0], np.cumsum([len(s) for s in split], dtype=np.int64)])
    flat = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64, int(first[-1]))
    bad = np.diff(np.concatenate([[0], np.cumsum(~fits[flat])])[first]) > 0
    split = [[] if x else s for s, x in zip(split, bad.tolist())]
    cell = np.repeat(np.arange(len(texts)), np.diff(first)) * max(len(place), 1) + flat
    cell, times = np.unique(cell[~np.repeat(bad, np.diff(first))], return_counts=True)
    row, part = np.divmod(cell, max(len(place), 1))
    by_part = Rows(np.searchsorted(row, np.arange(len(texts) + 1)), part, times, len(place))

    # Parts by id pairs, and texts by id pairs.
    of, pair = _pairs(m)
    names, column = np.unique(pair, return_inverse=True)
    cell, links = np.unique(of * max(len(names), 1) + column, return_counts=True)
    row, column = np.divmod(cell, max(len(names), 1))
    by_pair = Rows(np.searchsorted(row, np.arange(len(place) + 1)), column, links, len(names))

    shared = np.concatenate([[0], np.cumsum(m.n_shared())])[m.first_a]
    n_links = np.concatenate([[0], np.cumsum(links)])[by_pair.starts]
    each = np.stack([np.diff(x) for x in (m.first_a, m.first_b, m.first_group, n_links, shared)])
    sums = np.cumsum(np.concatenate([np.zeros((len(each), 1), np.int64), each[:, by_part.columns] * by_part.values], 1), 1)
    counts = np.diff(sums[:, by_part.starts])
    said = dict(zip(place, group_texts(m)))
    groups = [";".join(map(said.__getitem__, s)) for s in split]
    return counts, groups, product(by_part, by_pair), names


def align(docs: DataFrame, first: TokenizerFile, second: TokenizerFile, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of ``docs``: ``key``, ``n_a, n_b, n_groups, n_links, n_shared, groups, pairs, times``.

    ``groups`` lists the ids of each group as ``a1,a2|b1;a3|b2,b3``. ``pairs`` are the distinct id
    pairs that overlap, as ``a << 32 | b``, and ``times`` at how many places each does; ``n_links``
    counts the places. ``n_shared`` counts token pairs within one group. Special strings are plain
    text. A space goes before each text; texts that are null or empty, or of which the tokens' bytes
    are not the text's, have no tokens: zeros, an empty text, empty lists. Null keys and repeated
    rows pass through, other columns are ignored, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = held((first, second), lambda: (ByteTokenizer(first), ByteTokenizer(second)))
        for batch, texts in string_chunks(batches, "text", ALIGN_BYTES, ALIGN_ROWS):
            counts, groups, by_pair, names = aligned_texts(a, b, texts)
            columns = [batch.column("key"), *map(pa.array, counts), pa.array(groups, pa.string())]
            columns += [list_array(names[by_pair.columns], by_pair.starts), list_array(by_pair.values.astype(np.int32), by_pair.starts)]
            yield pa.RecordBatch.from_arrays(columns, ["key", *_COUNTS, "groups", "pairs", "times"])

    rows = small_batches(docs).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in _COUNTS)
    out = rows.mapInArrow(run, f"key {kind}, {counts}, groups string, pairs array<bigint>, times array<int>")
    return out.withColumnRenamed("key", key)


def pair_counts(texts: DataFrame) -> DataFrame:
    """``pair, n, best``: in how many texts each pair overlaps, and if that is the most of its A id."""
    counts = saved(texts.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # at most one row an id of the vocabulary
    return counts.join(F.broadcast(most), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_pair_counts(aligned_texts: DataFrame, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """The rows of ``align``, without its lists, and ``n_best, count_sum``.

    A pair's count is the number of rows that hold it. ``count_sum`` adds up the counts of all
    links, ``n_best`` counts the links whose count is the highest of their A id, ties included.
    """
    spark = aligned_texts.sparkSession
    place = shared_dir(spark)
    numbered = aligned_texts.withColumn("row", F.monotonically_increasing_id())
    numbered.write.option("compression", "zstd").parquet(place)  # texts are encoded once, numbers stay
    texts = spark.read.schema(numbered.schema).parquet(place)
    counts = saved(pair_counts(texts))
    frequent = most_frequent(counts, held_pairs).toArrow().sort_by("pair")
    pairs, n, best = (frequent.column(c).to_numpy() for c in ("pair", "n", "best"))
    known = spark.sparkContext.broadcast((pairs, n, best.astype(np.int64)))
    rest = [c for c in numbered.columns if c not in ("pairs", "times")]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = known.value
        n, best = np.append(n, 0), np.append(best, 0)
        for batch in batches:
            pair, lengths = flat_lists(batch.column("pairs"), np.int64)
            times, _ = flat_lists(batch.column("times"), np.int64)
            row = np.repeat(np.arange(len(batch)), lengths)
            at = np.searchsorted(keys, pair)
            hit = np.append(keys, -1)[at] == pair
            at[~hit] = len(keys)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            sums = [np.diff(np.concatenate([[0], np.cumsum(times * x[at])])[ends]) for x in (best, n)]
            rare = np.searchsorted(row[~hit], np.arange(len(batch) + 1))
            columns = [batch.column(c) for c in rest] + [pa.array(s) for s in sums]
            columns += [list_array(pair[~hit], rare), list_array(times[~hit].astype(np.int32), rare)]
            yield pa.RecordBatch.from_arrays(columns, [*rest, "n_best", "count_sum", "pairs", "times"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name in rest]
    schema = ", ".join([*kinds, "n_best bigint", "count_sum bigint", "pairs array<bigint>", "times array<int>"])
    found = saved(texts.mapInArrow(look_up, schema))
    rare = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    rare = rare.select("row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("bigint").alias("times"))
    sums = rare.join(counts, "pair").groupBy("row")
    sums = sums.agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_best"),
        F.sum(F.col("n") * F.col("times")).alias("rare_sum"),
    )
    out = found.drop("pairs", "times").join(sums, "row", "left")
    for column, more in (("n_best", "rare_best"), ("count_sum", "rare_sum")):
        out = out.withColumn(column, F.col(column) + F.coalesce(more, F.lit(0)))
    return out.drop("row", "rare_best", "rare_sum")
