"""A minimal acyclic transducer from words to token ids.

Words share their prefixes and suffixes; each arc carries the number of words that sort before
those beyond it, so the numbers along a path add up to the word's place, which names its ids. All
of it is one flat array of integers in one file that readers map into memory.
"""

from __future__ import annotations

import io
from collections.abc import Mapping, Sequence

import numpy as np


def _minimal_states(words: Sequence[bytes]) -> tuple[list[dict[int, int]], list[bool], int]:
    """Arcs and final marks of the states of the smallest automaton, and the root.

    Words come sorted; what the next word can no longer change is merged with an equal state that
    is there already.
    """
    arcs: list[dict[int, int]] = []
    final: list[bool] = []
    known: dict[tuple, int] = {}
    path: list[tuple[dict[int, int], list[bool], int]] = [({}, [False], -1)]

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            out, is_final, label = path.pop()
            key = (is_final[0], *sorted(out.items()))
            state = known.get(key)
            if state is None:
                state = known[key] = len(arcs)
                arcs.append(out)
                final.append(is_final[0])
            path[-1][0][label] = state

    before = b""
    for word in words:
        shared = next((i for i, (a, b) in enumerate(zip(before, word)) if a != b), min(len(before), len(word)))
        close(shared)
        for label in word[shared:]:
            path.append(({}, [False], label))
        path[-1][1][0] = True
        before = word
    close(0)
    out, is_final, _ = path[0]
    arcs.append(out)
    final.append(is_final[0])
    return arcs, final, len(arcs) - 1


def build(entries: Mapping[bytes, Sequence[int]]) -> bytes:
    """The file's content for words and their ids."""
    words = sorted(entries)
    arcs, final, root = _minimal_states(words)
    reach = np.zeros(len(arcs), np.int64)  # words from each state on; targets come before sources
    keys, targets, skips = [], [], []
    for state, out in enumerate(arcs):
        n = int(final[state])
        for label, target in sorted(out.items()):
            keys.append(state * 256 + label)
            targets.append(target)
            skips.append(n)
            n += int(reach[target])
        reach[state] = n
    lengths = [len(entries[w]) for w in words]
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    ids = [i for w in words for i in entries[w]]
    parts = [keys, targets, skips, final, offsets, ids]
    flat = [np.asarray(p, np.int64) for p in parts]
    head = np.array([root, max(map(len, words), default=0), *map(len, flat)], np.int64)
    file = io.BytesIO()
    np.save(file, np.concatenate([head, *flat]))
    return file.getvalue()


class Lexicon:
    """Reads a built file, which stays mapped and is shared by all processes of a machine."""

    def __init__(self, path: str):
        flat = np.load(path, mmap_mode="r").view(np.ndarray)
        self.root, self.longest, *sizes = flat[:8].tolist()
        ends = (8 + np.cumsum(sizes)).tolist()
        parts = [flat[a:b] for a, b in zip([8, *ends], ends)]
        self.keys, self.targets, self.skips, self.final, self.offsets, self.ids = parts

    def find(self, words: Sequence[bytes]) -> list[list[int] | None]:
        """The ids of each word, or None."""
        return [None if ids is None else np.frombuffer(ids, "<u4").tolist() for ids in self.packed(words)]

    def packed(self, words: Sequence[bytes]) -> list[bytes | None]:
        """The ids of each word as little-endian unsigned 32-bit numbers, or None; all words walk the
        automaton side by side."""
        found: list[bytes | None] = [None] * len(words)
        at = np.array([i for i, w in enumerate(words) if len(w) <= self.longest], np.int64)
        if not len(at) or not len(self.keys):
            return found
        width = self.longest
        flat = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in at), np.uint8)
        grid = flat.reshape(len(at), width)
        length = np.array([len(words[i]) for i in at])
        state = np.full(len(at), self.root, np.int64)
        number = np.zeros(len(at), np.int64)
        alive = np.arange(len(at))
        for step in range(width):
            alive = alive[length[alive] > step]
            if not len(alive):
                break
            want = state[alive] * 256 + grid[alive, step]
            arc = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[arc] == want
            state[alive[~hit]] = -1
            alive, arc = alive[hit], arc[hit]
            state[alive] = self.targets[arc]
            number[alive] += self.skips[arc]
        rows = np.flatnonzero((state >= 0) & (length > 0))
        rows = rows[self.final[state[rows]] != 0]
        begin, end = self.offsets[number[rows]], self.offsets[number[rows] + 1]
        ends = np.cumsum(end - begin)
        starts = ends - (end - begin)
        whole = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - starts, end - begin)].astype("<u4").tobytes()
        for row, a, b in zip(at[rows].tolist(), (starts * 4).tolist(), (ends * 4).tolist()):
            found[row] = whole[a:b]
        return found
