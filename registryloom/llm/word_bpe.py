"""Word-end BPE over whole corpora, with frequent words looked up in a shared transducer.

The most frequent words of the corpus are merged once and compiled into a lexicon file, which
executors map into memory; words that it lacks are merged exactly where they occur.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registryloom.llm.common import most_frequent, small_batches
from registryloom.llm.lexicon import Lexicon, build
from registryloom.llm.words import held, string_chunks
from registryloom.sources.tables import shared_dir

#: Words in the lexicon, by frequency over the whole corpus; bounds what the driver gathers.
LEXICON_WORDS = 200_000
#: Longer words are merged where they occur, so that a lookup's table of letters stays small.
LEXICON_CHARS = 32
#: Bytes of words and stretches between blanks whose ids, or counts, a worker keeps at hand; as
#: many again that it has kept before.
MEMO_BYTES = 32_000_000
#: Bytes that an entry takes besides its letters and ids.
ENTRY_BYTES = 200
#: Tokens whose letters are gathered at once.
DECODE_TOKENS = 20_000
#: Longer stretches are encoded where they occur and not kept.
KEPT_CHARS = 64
#: Words of up to so many bytes are merged side by side, in rows of these widths.
SIDE_BY_SIDE, MERGE_ROWS = (6, 9, 12, 18, 32), 20_000
#: Of words by themselves, shorter ones are merged by plain scans, longer ones with a queue.
SHORT_WORD = 24

# The Unicode blanks, and the word pattern of the vocabulary's pre-tokenizer.
_SPACES = regex.compile("[\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_MARKS = tuple(".,;:!?")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^ \p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Merger:
    """Exact BPE of one word from a vocabulary's pairs, the earliest pair first, left to right."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.letters = byte_letters()
        self.rank = {(self.vocab[a], self.vocab[b]): i for i, (a, b) in enumerate(model["merges"])}
        self.made = [self.vocab[a + b] for a, b in model["merges"]]
        # The same as arrays: pairs in order of both ids, the rank of each, and the ids of bytes.
        pairs = np.array([a << 32 | b for a, b in self.rank] or [-1], np.int64)
        order = np.argsort(pairs)
        self._pairs, self._ranks = pairs[order], np.array([*self.rank.values()] or [0], np.int32)[order]
        self._made = np.array([*self.made, -1], np.int32)
        self._inner, self._last = (
            np.array([self.vocab.get(c + end, -1) for c in self.letters], np.int32) for end in ("", self.end)
        )
        self._whole = bool((self._inner >= 0).all() and (self._last >= 0).all())

    def merge(self, word: str) -> list[int]:
        letters = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        if not letters:
            return []
        letters[-1] += self.end
        ids = [self.vocab[c] for c in letters if c in self.vocab]
        return self._merge_short(ids) if len(ids) <= SHORT_WORD else self._merge_long(ids)

    def merge_many(self, words: list[str]) -> list[list[int]]:
        """``merge`` of each word."""
        return [np.frombuffer(ids, "<u4").tolist() for ids in self.merge_packed(words)]

    def merge_packed(self, words: list[str]) -> list[bytes]:
        """``merge`` of each word, as little-endian unsigned 32-bit numbers; words of about one length
        are merged side by side."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        out = [b""] * len(raw)
        low = 0
        for high in SIDE_BY_SIDE if self._whole else ():
            at = np.flatnonzero((sizes > low) & (sizes <= high))
            for begin in range(0, len(at), MERGE_ROWS):
                some = at[begin : begin + MERGE_ROWS]
                for i, ids in zip(some.tolist(), self._side_by_side([raw[i] for i in some], sizes[some], high)):
                    out[i] = ids
            low = high
        for i in np.flatnonzero(sizes > low).tolist():
            ids = self.merge(words[i])
            out[i] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; the number of ranks where there is none, as beside an end."""
        pair = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
        held = (self._pairs[at] == pair) & (left >= 0) & (right >= 0)
        return np.where(held, self._ranks[at], len(self.made)).astype(np.int32)

    def _side_by_side(self, raw: list[bytes], sizes: np.ndarray, width: int) -> list[bytes]:
        """All words take their first best pair at once, until none has any; -1 fills up the rows."""
        place, rows, none = np.arange(width), np.arange(len(raw)), len(self.made)
        grid = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in raw), np.uint8).reshape(len(raw), width)
        ids = np.where(place < sizes[:, None], self._inner[grid], -1)
        ids[rows, sizes - 1] = self._last[grid[rows, sizes - 1]]
        ids = np.column_stack([ids, np.full(len(raw), -1, np.int32)])
        ranks = self._rank_of(ids[:, :-1], ids[:, 1:])
        left = rows
        out = ids.copy()
        while len(left):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(at)), at]
            done = best == none
            if done.any():
                out[left[done]] = ids[done]
                go = ~done
                left, ids, ranks, at, best = left[go], ids[go], ranks[go], at[go], best[go]
                if not len(left):
                    break
            own = np.arange(len(left))
            # The pair becomes one id, and all behind it moves up.
            ids[own, at] = self._made[best]
            behind = place[None, :] > at[:, None]
            ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(behind[:, 1:], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = none
            ranks[own, at] = self._rank_of(ids[own, at], ids[own, at + 1])
            before = np.flatnonzero(at > 0)
            p = at[before] - 1
            ranks[before, p] = self._rank_of(ids[before, p], ids[before, p + 1])
        begins = np.arange(len(out)) * out.shape[1] * 4
        ends, whole = begins + (out >= 0).sum(1) * 4, out.astype("<i4").tobytes()
        return [whole[a:b] for a, b in zip(begins.tolist(), ends.tolist())]

    def _merge_short(self, ids: list[int]) -> list[int]:
        rank, made, none = self.rank.get, self.made, len(self.made)
        ranks = [rank(p, none) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i : i + 2] = [made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int | None]) -> list[int]:
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple[int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n and (rank := self.rank.get((ids[i], ids[j]))) is not None:
                heapq.heappush(queue, (rank, i, j))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            rank, i, j = heapq.heappop(queue)
            if after[i] != j or self.rank.get((ids[i], ids[j])) != rank:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = self.made[rank], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [i for i in ids if i is not None]


def split_words(text: str, special: regex.Pattern) -> list[str]:
    """The pre-tokens of a text; special strings stay whole and as they are."""
    if special.search(text):
        pieces = special.split(text)
        return [w for p in pieces for w in ([p] if special.fullmatch(p) else _plain_words(p))]
    return _plain_words(text)


def _plain_words(text: str) -> list[str]:
    if not text.isascii():  # letters change case one by one: a sigma at a word's end is none of its own
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    text = text.lower()
    # Most stretches are one word, or one with a mark behind it.
    if text.isalpha():
        return [text]
    if text[-1:] in _MARKS and text[:-1].isalpha():
        return [text[:-1], text[-1]]
    return _WORDS.findall(_SPACES.sub(" ", text))


def split_many(texts: Sequence[str], special: regex.Pattern) -> list[list[str]]:
    """``split_words`` of each text, none of which has a blank; case and normal form are changed at once."""
    whole = "\n".join(texts)
    if special.search(whole):
        return [split_words(t, special) for t in texts]
    if not whole.isascii():
        whole = unicodedata.normalize("NFC", whole).replace("Σ", "σ")
    return [
        [t] if t.isalpha() else [t[:-1], t[-1]] if t[-1:] in _MARKS and t[:-1].isalpha() else _WORDS.findall(t)
        for t in whole.lower().split("\n")
    ]


def special_pattern(special: Sequence[str]) -> regex.Pattern:
    return regex.compile(f"({'|'.join(map(regex.escape, special))})")


def stretches(text: str) -> list[str]:
    """What stands between Unicode blanks; normal forms and words never reach across one."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # blanks for str.split alone
        return [p for p in _SPACES.split(text) if p]
    return text.split()


def _loaded(spec: str) -> tuple[Merger, regex.Pattern]:
    merger = Merger(json.loads(spec))
    return merger, special_pattern([*merger.special])


def word_counts(docs: DataFrame, spec: str, text: str = "text") -> DataFrame:
    """``word, n``: how often each pre-token occurs in all texts; special strings are left out."""

    def flushed(seen: Counter, special: regex.Pattern, names: set[str]) -> pa.RecordBatch:
        words: defaultdict[str, int] = defaultdict(int)
        for own, n in zip(split_many(list(seen), special), seen.values()):
            for w in own:
                words[w] += n
        for name in names & words.keys():
            del words[name]
        columns = [pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["word", "n"])

    def count(batches):
        names = held(("special", spec), lambda: {a["content"] for a in json.loads(spec)["added_tokens"]})
        special = special_pattern([*names])
        seen: Counter = Counter()
        for _, texts in string_chunks(batches):
            for t in texts:
                seen.update(stretches(t))
            if len(seen) * ENTRY_BYTES > MEMO_BYTES or len(texts) == 1:
                yield flushed(seen, special, names)
                seen.clear()
        yield flushed(seen, special, names)

    column = small_batches(docs).select(F.col(text).cast("string").alias("text"))
    counted = column.mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def write_lexicon(docs: DataFrame, spec: str, words: int = LEXICON_WORDS, text: str = "text") -> str:
    """Compile the most frequent words; the name under which executors find the file."""
    spark = docs.sparkSession
    counts = word_counts(docs, spec, text).filter(F.length("word") <= LEXICON_CHARS)
    top = most_frequent(counts, words).select("word").toPandas()["word"]
    merger, _ = _loaded(spec)
    content = build(dict(zip(map(str.encode, top), merger.merge_many(list(top)))))
    name = f"lexicon-{uuid.uuid4().hex}.npy"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(content)
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


class Encoder:
    """Ids of stretches, from memory, the lexicon or exact merging; texts of ids.

    ``known`` holds words and stretches alike, as a word's only word is itself. Once it is full
    it becomes ``older``, from which what is met again comes back.
    """

    def __init__(self, merger: Merger, special: regex.Pattern, lexicon: Lexicon):
        self.merger, self.special, self.lexicon = merger, special, lexicon
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0
        tokens = [merger.tokens.get(i, "").encode() + b" " for i in range(max(merger.tokens) + 1)]
        self._ends = np.cumsum([0, *map(len, tokens)])
        self._letters = np.frombuffer(b"".join(tokens), np.uint8)

    def _missing(self, wanted: set[str]) -> list[str]:
        """Those of ``wanted`` that memory lacks; what an earlier memory holds comes back."""
        missing = wanted.difference(self.known)  # looks up what is wanted, not all that is known
        again = missing.intersection(self.older)
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        self.size += ENTRY_BYTES * len(again)
        return list(missing - again)

    def _keep(self, new: list[str], ids: list[bytes]) -> None:
        self.known.update(zip(new, ids))
        self.size += ENTRY_BYTES * len(new) + sum(map(len, new)) + sum(map(len, ids))

    def learn(self, wanted: set[str]) -> None:
        """Have the ids of all ``wanted`` stretches in memory."""
        if self.size > MEMO_BYTES:
            self.older, self.known, self.size = self.known, {}, 0
        new = self._missing(wanted)
        split = split_many(new, self.special) if new else []
        words = sorted(self._missing(set(chain.from_iterable(split))))  # in order, lookups are faster
        self._keep(words, self._word_ids(words))
        known = self.known.__getitem__
        parted = [i for i, own in enumerate(split) if len(own) != 1 or own[0] is not new[i] and own[0] != new[i]]
        joined = [known(o[0]) + known(o[1]) if len(o) == 2 else b"".join(map(known, o)) for o in map(split.__getitem__, parted)]
        self._keep(list(map(new.__getitem__, parted)), joined)

    def _word_ids(self, words: list[str]) -> list[bytes]:
        found = self.lexicon.packed([w.encode("utf-8", "surrogatepass") for w in words])
        if not self.merger.special.keys().isdisjoint(words):
            for i, w in enumerate(words):
                if w in self.merger.special:
                    found[i] = struct.pack("<I", self.merger.special[w])
        unseen = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(unseen, self.merger.merge_packed([words[i] for i in unseen])):
            found[i] = ids
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        split = [stretches(t) for t in texts]
        self.learn(set().union(*split))
        known = self.known.__getitem__
        ids = [b"".join(map(known, own)) for own in split]
        if len(texts) == 1:  # a long text may be all there is room for
            self._forget_long(split[0])
        return ids

    def _forget_long(self, stretches: list[str]) -> None:
        for s in {s for s in stretches if len(s) > KEPT_CHARS} & self.known.keys():
            self.size -= ENTRY_BYTES + len(s) + len(self.known.pop(s))

    def decode(self, ids: list[bytes]) -> list[str]:
        """The tokens of each text, joined by single spaces."""
        flat = np.frombuffer(b"".join(ids), np.uint32)
        ends = np.concatenate([[0], np.cumsum((self._ends[1:] - self._ends[:-1])[flat])])
        letters = np.empty(ends[-1], np.uint8)
        for i in range(0, len(flat), DECODE_TOKENS):
            some, at = flat[i : i + DECODE_TOKENS], ends[i : i + DECODE_TOKENS + 1]
            letters[at[0] : at[-1]] = self._letters[np.arange(at[0], at[-1]) + np.repeat(self._ends[some] - at[:-1], np.diff(at))]
        whole = letters.tobytes()
        first = ends[np.cumsum([0, *(len(i) // 4 for i in ids)])].tolist()
        return [whole[a : max(a, b - 1)].decode() for a, b in zip(first[:-1], first[1:])]


def _encoder(spec: str, lexicon: str) -> Encoder:
    """One a worker process, so what one task has learnt serves the next."""
    return held((spec, lexicon), lambda: Encoder(*_loaded(spec), Lexicon(SparkFiles.get(lexicon))))


def encode(docs: DataFrame, spec: str, lexicon: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids, decoded`` per row of ``docs``; ``ids`` are little-endian unsigned 32-bit.

    A null text is empty, and an empty text has no ids and decodes to the empty text. Decoding
    joins the tokens with single spaces, as a tokenizer without a decoder does. Keys pass through
    as they are, repeated rows and nulls included; other columns are ignored.
    """

    def run(batches):
        encoder = _encoder(spec, lexicon)
        for batch, texts in string_chunks(batches):
            ids = encoder.encode(texts)
            columns = [batch.column("key"), pa.array(ids, pa.binary()), pa.array(encoder.decode(ids), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "ids", "decoded"])

    rows = small_batches(docs).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, ids binary, decoded string")
    return out.withColumnRenamed("key", key)
