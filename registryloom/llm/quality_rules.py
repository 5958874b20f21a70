"""Quality rules whose cutoffs keep the false rejection rate of good texts under a proven bound.

All rules share a ladder of strictness. For each stratum, labelled texts say how many good ones a
level rejects; an exact binomial test tells whether that proves a rate of at most ``RISK``. Levels
are tested from the loosest on, and a stratum stops at its first failure, so only the number of
strata needs a correction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from registryloom.llm.common import saved, small_batches
from registryloom.llm.words import release, string_chunks

#: Largest wanted rate of rejected good texts in a stratum, and the chance that any stratum exceeds it.
RISK, DELTA = 0.01, 0.05
#: Each rule's measure and its cutoff at the loosest and the strictest level; a text is rejected
#: where a measure is above the cutoff. Levels between are even steps of the logarithm.
RULES = {
    "symbols_per_word": (2.0, 0.05),
    "shouts_per_word": (2.0, 0.05),
    "upper_share": (0.8, 0.15),
    "dup_line_share": (0.8, 0.1),
    "repeat_share": (0.5, 0.1),
    "word_length": (30.0, 12.0),
}
LEVELS = 24
#: Up to so many strata, their levels are broadcast; beyond, they are joined by shuffle.
MAX_BROADCAST_STRATA = 100_000

SYMBOLS = "#*$%&|<>"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LETTERS = _UPPER + _UPPER.lower()
_BLANKS = " \t\n\x0b\x0c\r"
_MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_shouts bigint, n_upper bigint, n_letters bigint"


_NAMES = [c.split()[0] for c in _MEASURES.split(", ")]


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text holds at least twice."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(known) + ids[1:]
    if len(known) > 2_000_000:  # else the third factor would not fit
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(known) + ids[2:]
    order = np.argsort(windows, kind="stable")
    equal = windows[order][1:] == windows[order][:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][equal]] = again[order[:-1][equal]] = True
    inside = np.zeros(n, bool)
    for i in range(3):
        inside[i : n - 2 + i] |= again
    return int(inside.sum())


def measure(text: str) -> tuple[int, ...]:
    """The counts of ``_MEASURES`` of one whole text."""
    raw = text.encode()
    words = raw.split()  # at the six ASCII blanks
    lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, _BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        text.count("!"),
        len(raw) - len(raw.translate(None, _UPPER)),
        len(raw) - len(raw.translate(None, _LETTERS)),
    )


def _columns(texts: list[str]) -> list[pa.Array]:
    counts = np.array([measure(t) for t in texts], np.int64).reshape(len(texts), len(_NAMES))
    return [pa.array(c) for c in counts.T]


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """``key, stratum`` and the counts of every whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch, texts in string_chunks(batches):
            held = [batch.column("key"), batch.column("stratum")]
            yield pa.RecordBatch.from_arrays([*held, *_columns(texts)], ["key", "stratum", *_NAMES])

    rows = small_batches(docs).select(
        F.col(key).alias("key"),
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
        F.col(text).cast("string").alias("text"),
    )
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, stratum string, {_MEASURES}")


def _values() -> dict[str, Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbols_per_word": share("n_symbols", "n_words"),
        "shouts_per_word": share("n_shouts", "n_words"),
        "upper_share": share("n_upper", "n_letters"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "word_length": share("word_chars", "n_words"),
    }


def strictness() -> Column:
    """The loosest level, from 1 to ``LEVELS``, at which a rule rejects; null if none does."""
    levels = []
    for rule, value in _values().items():
        loose, strict = RULES[rule]
        # The first level whose cutoff, loose * (strict / loose) ** ((level - 1) / (LEVELS - 1)), is below.
        steps = F.log(value / loose) / math.log(strict / loose) * (LEVELS - 1)
        level = F.least(F.greatest(F.floor(steps) + 2, F.lit(1)), F.lit(LEVELS)).cast("int")
        levels.append(F.when(value > strict, level))
    return F.least(*levels)


@F.pandas_udf(T.DoubleType())
def tail_chance(k: pd.Series, n: pd.Series, risk: pd.Series) -> pd.Series:
    """Exact chance of at most ``k`` rejections of ``n`` texts if the true rate is ``risk``."""
    return pd.Series([_binomial_cdf(int(a), int(b), float(c)) for a, b, c in zip(k, n, risk)])


def _binomial_cdf(k: int, n: int, p: float) -> float:
    if k >= n * p:  # at or above the mean: never a proof
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    term = total = math.exp(log + k * math.log(p) + (n - k) * math.log1p(-p))
    while k > 0 and term > total * 1e-17:
        term *= k * (1 - p) / ((n - k + 1) * p)
        k -= 1
        total += term
    return total


def choose_levels(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``stratum, level, n_good, n_rejected, chance``: the level that each stratum may use.

    ``labels`` holds ``doc_id`` and ``quality``, 1 for good; a text with several labels is good if
    all say so, and null labels say nothing. Of the levels that pass, the loosest one that
    rejects as many bad texts as any goes. A stratum with too few labelled texts has no row.
    """
    said = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    said = said.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = measured.select("key", "stratum", F.coalesce(strictness(), F.lit(LEVELS + 1)).alias("at"))
    held = held.join(said, F.col("key") == F.col("doc_id"))
    good = F.col("quality") == 1
    counts = held.groupBy("stratum", "at").agg(
        F.sum(good.cast("bigint")).alias("good"), F.sum((~good).cast("bigint")).alias("bad")
    )
    # Every level of every stratum, so that the tests go on over levels that reject nobody.
    steps = F.explode(F.sequence(F.lit(1), F.lit(LEVELS + 1))).alias("at")
    grid = counts.select("stratum").distinct().select("stratum", steps)
    full = grid.join(counts, ["stratum", "at"], "left").na.fill(0, ["good", "bad"])
    upto = Window.partitionBy("stratum").orderBy("at")  # at most LEVELS + 1 rows a stratum
    whole = Window.partitionBy("stratum")
    rates = full.select(
        "stratum",
        F.col("at").alias("level"),
        F.sum("good").over(whole).alias("n_good"),
        F.sum("good").over(upto).alias("n_rejected"),
        F.sum("bad").over(upto).alias("n_bad"),
    ).filter(F.col("level") <= LEVELS)
    strata = rates.agg(F.greatest(F.count_distinct("stratum"), F.lit(1))).first()[0]
    tested = rates.withColumn("chance", tail_chance("n_rejected", "n_good", F.lit(risk)))
    path = Window.partitionBy("stratum").orderBy("level")
    worst = tested.withColumn("worst", F.max("chance").over(path))
    passed = worst.filter(F.col("worst") <= delta / strata)
    best = Window.partitionBy("stratum").orderBy(F.desc("n_bad"), "level")
    chosen = passed.withColumn("place", F.row_number().over(best)).filter(F.col("place") == 1)
    return chosen.select("stratum", "level", "n_good", "n_rejected", "chance")


def _with_level(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """``rows`` with their stratum's level; few strata are broadcast, so that nothing moves."""
    levels = saved(levels.select("stratum", "level"))
    few = levels.count() <= MAX_BROADCAST_STRATA
    return rows.join(F.broadcast(levels) if few else levels, "stratum", "left")


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    risk: float = RISK,
    delta: float = DELTA,
) -> DataFrame:
    """``key, stratum``, the counts, ``base_failed``, ``level`` and ``kept`` per row of ``docs``.

    Base: fewer than 50 words, or over half of the words in repeated windows. Other texts go if a
    rule rejects them at the level that their stratum may use; strata without a proven level
    reject nobody more. Null texts are empty, a null stratum is one of its own, null keys meet no
    label, repeated rows are judged alike, other columns are ignored, an empty table gives no rows.
    """
    measured = saved(measures(docs, key, text, stratum))
    judged = _with_level(measured, choose_levels(measured, labels, risk, delta))
    rejected = F.coalesce(strictness() <= F.col("level"), F.lit(False))
    judged = judged.withColumn("base_failed", _base_failed())
    judged = judged.withColumn("kept", ~F.col("base_failed") & ~rejected)
    return judged.withColumnRenamed("key", key)


def kept_rows(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Texts are measured once for the labelled rows' levels and once to filter, which costs less
    than sending all texts to their verdicts. Rows pass through the task that measures them: a
    function of the text alone would be called anew for each filter and column that needs its counts.
    """
    levels = choose_levels(measures(docs, "doc_id", text, stratum), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch, texts in string_chunks(batches):
            held = [batch.column("row"), batch.column("stratum")]
            yield pa.RecordBatch.from_arrays([*held, *_columns(texts)], ["row", "stratum", *_NAMES])

    rows = small_batches(docs).select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
        F.col(text).cast("string").alias("text"),
    )
    kinds = [*rows.schema.fields[:2], *(T.StructField(n, T.LongType()) for n in _NAMES)]
    rows = rows.mapInArrow(run, T.StructType(kinds))
    found = _with_level(rows, levels)
    rejected = _base_failed() | F.coalesce(strictness() <= F.col("level"), F.lit(False))
    return found.filter(~rejected).select("row.*")
