"""Sparse matrices by compressed rows, and their product row by row (Gustavson)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Single products that are held at once; a row with more is a block of its own.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Rows:
    """Row i holds ``values[starts[i]:starts[i + 1]]`` in the columns of the same places."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)

    def row_of(self) -> np.ndarray:
        """The row of each stored value."""
        return np.repeat(np.arange(self.height), self.lengths())


def incidence(starts: np.ndarray, columns: np.ndarray, width: int) -> Rows:
    """Ones in the given columns of each row."""
    return Rows(starts, columns, np.ones(len(columns), np.int64), width)


def turned(m: Rows) -> Rows:
    """Rows and columns exchanged; each new row keeps its columns in order."""
    order = np.argsort(m.columns, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(m.columns, minlength=m.width))])
    return Rows(starts, m.row_of()[order], m.values[order], m.height)


def work(a: Rows, b: Rows) -> np.ndarray:
    """Single products in each row of ``a @ b``; the row's stored values if none of them meet."""
    each = np.concatenate([[0], np.cumsum(b.lengths()[a.columns])])
    return np.diff(each[a.starts])


def row_products(a: Rows, b: Rows, most: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``row, column, value`` of ``a @ b`` by blocks of whole rows, in order of row and column.

    Each row of ``a`` adds up the rows of ``b`` that its columns name.
    """
    before = np.concatenate([[0], np.cumsum(work(a, b))])
    low = 0
    while low < a.height:
        high = int(np.searchsorted(before, before[low] + most, side="right")) - 1
        high = min(max(high, low + 1), a.height)
        inner = a.columns[a.starts[low] : a.starts[high]]
        n = b.lengths()[inner]
        first = np.cumsum(n) - n
        at = np.arange(before[high] - before[low]) + np.repeat(b.starts[inner] - first, n)
        rows = np.repeat(np.repeat(np.arange(low, high), a.lengths()[low:high]), n)
        cell = rows * b.width + b.columns[at]
        value = np.repeat(a.values[a.starts[low] : a.starts[high]], n) * b.values[at]
        if np.any(cell[1:] < cell[:-1]):
            order = np.argsort(cell, kind="stable")
            cell, value = cell[order], value[order]
        new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])[: len(cell)])
        if len(new):
            yield cell[new] // b.width, cell[new] % b.width, np.add.reduceat(value, new)
        low = high


def product(a: Rows, b: Rows) -> Rows:
    """``a @ b`` whole."""
    blocks = list(row_products(a, b))
    rows, columns, values = (np.concatenate([x[i] for x in blocks] or [np.empty(0, np.int64)]) for i in range(3))
    starts = np.concatenate([[0], np.cumsum(np.bincount(rows.astype(np.int64), minlength=a.height))])
    return Rows(starts, columns, values, b.width)
