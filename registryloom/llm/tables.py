"""Draws of how many tables the customers of a dish sit at, all of them seated anew at once.

The j-th table of a dish opens with weight ``base * (strength + discount * (others + j))``, where
``others`` are tables of other dishes in the restaurant. A seating of ``c`` customers at ``t`` tables
has a probability in proportion to these weights times the tables' own factors, whose sum over all
seatings is the generalised Stirling number S(c, t). What seating one customer after the other
again and again leads to is therefore drawn directly, for any number of customers.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from registryloom.llm.words import mixed

#: Up to so many customers, a draw looks up the chances of all numbers of tables.
LOOKED_UP = 512
#: Chances that are held at once.
ENTRIES = 1 << 17
#: Beyond, numbers of tables that are proposed in a draw, and points of each contour.
PROPOSALS, POINTS = 4, 48
_SALT = np.uint64(0x9E3779B97F4A7C15)


def random_pair(keys: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in [0, 1) that depend on key and step alone."""
    bits = mixed(keys + np.uint64(step * int(_SALT) % 2**64))
    return (bits >> np.uint64(32)) * 2.0**-32, (bits & np.uint64(0xFFFFFFFF)) * 2.0**-32


def expected_tables(customers: np.ndarray, weight: np.ndarray, discount: float) -> np.ndarray:
    """Mean number of tables of a dish whose new tables have this weight."""
    weight = np.maximum(weight, 1e-12)
    grown = weight / discount * np.expm1(discount * np.log1p(customers / weight))
    return np.clip(np.round(grown), 1, customers)


@lru_cache(maxsize=4)
def log_stirling(discount: float) -> np.ndarray:
    """Logarithms of S(c, t), row c and column t, up to ``LOOKED_UP``."""
    out = np.full((LOOKED_UP + 1, LOOKED_UP + 1), -np.inf)
    out[1, 1] = 0
    for c in range(2, LOOKED_UP + 1):
        t = np.arange(1, c + 1)
        joins = out[c - 1, 1 : c + 1] + np.log(np.maximum(c - 1 - discount * t, 1e-300))
        out[c, 1 : c + 1] = np.logaddexp(joins, out[c - 1, :c])
    return out


def log_stirling_at(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """Logarithms of S(c, t) / c! for many customers, by an integral in the complex plane.

    S(c, t) t! d^t / c! is the coefficient of x^c in (1 - (1 - x)^d)^t. The integral runs through
    the point where its terms are smallest on the real line: on a circle if that is near zero, else
    on a parabola around the branch cut from 1 on.
    """
    c, t, d = c.astype(float), t.astype(float), discount
    # The mean exponent of (1 - (1 - x)^d) / x at 1 - x = exp(-v) grows with v; it is to be c / t.
    low, high = np.full(len(c), 1e-9), np.full(len(c), 200 / (1 - d))
    for _ in range(50):
        v = np.sqrt(low * high)
        mean = d * -np.expm1(-v) * np.exp((1 - d) * v) / -np.expm1(-d * v)
        low, high = np.where(mean < c / t, v, low), np.where(mean < c / t, high, v)
    z = np.maximum(np.exp(-high), 2 / c)
    out = np.empty(len(c))
    for circle in (True, False):
        at = np.flatnonzero((z > 0.5) == circle)
        if not len(at):
            continue
        n, k, z0 = c[at, None], t[at, None], z[at, None]
        half = (np.arange(POINTS) + 0.5) / POINTS
        if circle:
            x0 = -np.expm1(-high[at, None])
            mean = d * x0 * z0 ** (d - 1) / (1 - z0**d)
            spread = np.sqrt(np.maximum(k * mean * (1 + (1 - d) * x0 / z0 - mean), 1e-9))
            reach = np.minimum(np.pi, 9 / spread)
            x = x0 * np.exp(1j * reach * half)
            # Near zero, 1 - (1 - x)^d loses digits unless by way of log1p and expm1.
            terms = k * np.log(-np.expm1(d * np.log1p(-x))) - n * np.log(x)
            factor = reach / np.pi
        else:
            reach = np.sqrt(40 / (min(1, 2 * (1 - d)) * n * z0))
            u = 1j * reach * half + 1
            terms = k * np.log1p(-((z0**d) * u ** (2 * d))) - (n + 1) * np.log1p(-z0 * u**2) + np.log(u)
            factor = 2 * z0 * reach / np.pi
        top = terms.real.max(1)
        out[at] = top + np.log(np.maximum((np.exp(terms - top[:, None]).real.mean(1)), 1e-300) * factor[:, 0])
    return out - _log_gamma(t + 1) - t * math.log(d)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in x])


def drawn_tables(
    keys: np.ndarray, customers: np.ndarray, base: np.ndarray, others: np.ndarray, strength: float, discount: float, step: int, tables: np.ndarray
) -> np.ndarray:
    """Tables of each dish, given its customers, its base probability and the tables of other dishes.

    Drawn afresh up to ``LOOKED_UP`` customers. Beyond, numbers nearer and farther from ``tables``,
    those so far, are proposed and taken or not by their exact chances (Metropolis); so the
    distribution is kept. ``PROPOSALS + 1`` steps are used.
    """
    out = np.minimum(customers, 1)
    chances = log_stirling(discount)
    base, before = np.maximum(base, 1e-300), strength / discount + np.maximum(others, 0)
    width = 2
    while width <= LOOKED_UP:
        some = np.flatnonzero((customers > width // 2) & (customers <= width))
        for begin in range(0, len(some), ENTRIES // width):
            part = some[begin : begin + ENTRIES // width]
            each = np.log((base[part] * discount)[:, None] * (before[part, None] + np.arange(width)))
            each = np.cumsum(each, axis=1, out=each)
            each += chances[customers[part], 1 : width + 1]
            each -= each.max(1)[:, None]
            each = np.cumsum(np.exp(each, out=each), axis=1)
            pick = random_pair(keys[part], step)[0] * each[:, -1]
            out[part] = (each <= pick[:, None]).sum(1) + 1
        width *= 2
    many = np.flatnonzero(customers > LOOKED_UP)
    for begin in range(0, len(many), ENTRIES // (4 * POINTS)):
        part = many[begin : begin + ENTRIES // (4 * POINTS)]
        out[part] = _proposed(keys[part], customers[part], base[part], before[part], discount, step + 1, tables[part])
    return out


def _proposed(keys, customers, base, before, discount, step, tables) -> np.ndarray:
    def chance_of(t):
        return t * np.log(base * discount) + _log_gamma(before + t) + log_stirling_at(customers, t, discount)

    # How far proposals reach must not depend on where they start.
    farthest = expected_tables(customers, base * discount * before, discount) / 2
    tables = np.clip(tables, 1, customers)
    now = chance_of(tables)
    for i in range(PROPOSALS):
        reach = np.ceil(farthest / 4**i).astype(np.int64)
        pick, chance = random_pair(keys, step + i)
        other = tables + (pick * (2 * reach + 1)).astype(np.int64) - reach
        fits = (other >= 1) & (other <= customers)
        other = np.where(fits, other, tables)
        then = chance_of(other)
        goes = fits & (np.log(chance + 2.0**-33) < then - now)
        tables, now = np.where(goes, other, tables), np.where(goes, then, now)
    return tables
