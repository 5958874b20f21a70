"""Whole batches of texts as 64-bit word hashes, without a loop over words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes and texts that are strings at once; a longer text is a chunk of its own.
CHUNK_BYTES, CHUNK_ROWS = 1_000_000, 1_000
#: Bytes whose words are hashed at once, which takes some forty times as many.
WORD_BYTES = 300_000

_rng = np.random.Generator(np.random.PCG64(20))
_BYTE = _rng.integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(_rng.integers(0, 2**64, dtype=np.uint64) | np.uint64(1))
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}
_held: list[tuple[object, object]] = []


def held(key: object, make: Callable[[], object]) -> object:
    """What ``make`` makes, kept by the worker process until it is asked for another key.

    Workers outlive tasks and jobs, and serve operators in turn; only the last one's state stays.
    """
    if not _held or _held[0][0] != key:
        release()
        _held.append((key, make()))
    return _held[0][1]


def release() -> None:
    """Give back what an earlier operator or task has left in this worker, to the machine too."""
    if _held:
        _held.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits, one to one."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        held = np.multiply.accumulate(steps)
        if n <= 2 * WORD_BYTES:
            _powers[name] = held
    return held[:n]


class Words:
    """The words of some texts, lower-cased in A-Z.

    ``first[i]`` to ``first[i + 1]`` are the words of text i; ``hashes`` has one number a word.
    Equal words have equal hashes; different ones differ but for a chance of about 2^-64 a pair.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = _LOWER[data]
        word = ~_BLANK[low]
        edge = np.zeros(len(low) + 1, bool)
        edge[offsets] = True
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | edge[1:-1]
        ends[:-1] &= ~word[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        values = _BYTE[low]
        values *= _power("up", _BASE, len(low))
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        self._back = _power("down", _INVERSE, len(low) + 1)
        self.first = np.searchsorted(self.start, offsets)
        self.length = self.end - self.start
        self.hashes = self._hash(self.start, self.end)

    def _hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        rolled = (self._sums[end] - self._sums[start]) * self._back[start]
        return mixed(rolled + (end - start).astype(np.uint64))

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words have ``n`` bytes or more, and the hash of their first ``n``."""
        at = np.flatnonzero(self.length >= n)
        return at, self._hash(self.start[at], self.start[at] + n)

    def owners(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = CHUNK_BYTES, most_rows: int = CHUNK_ROWS
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with few rows and few bytes of text, or one long text.

    With each come the UTF-8 bytes of its texts and where each begins, the end added; a null text
    is empty. Nothing of a batch is copied but what a slice holds.
    """
    few = (b.slice(i, most_rows) for b in batches for i in range(0, len(b), most_rows))
    for batch in few:
        column = batch.column(text).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
        held = column.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
        begin = 0
        while begin < len(column):
            end = int(np.searchsorted(offsets, offsets[begin] + most_bytes, side="right")) - 1
            end = min(max(end, begin + 1), len(column))
            cut = offsets[begin : end + 1]
            yield batch.slice(begin, end - begin), data[cut[0] : cut[-1]], cut - cut[0]
            begin = end


def word_chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of the batches with the words of their texts; a null text has none."""
    release()
    for batch, data, offsets in text_slices(batches, text, WORD_BYTES):
        yield batch, Words(data, offsets)


def string_chunks(
    batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = CHUNK_BYTES, most_rows: int = CHUNK_ROWS
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts as strings; a null text is empty."""
    for batch, data, offsets in text_slices(batches, text, most_bytes, most_rows):
        whole = data.tobytes()
        yield batch, [whole[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def bucket_order(buckets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by bucket, and where each of ``n`` buckets begins and ends in it."""
    order = np.argsort(buckets, kind="stable")
    return order, np.searchsorted(buckets[order], np.arange(n + 1))


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def flat_lists(column: pa.Array, kind: np.dtype | type) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column one after the other, and how many each row has."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False), lengths
