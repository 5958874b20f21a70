import random
import string

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # A column of the reader's own, called like one that operators make.
        T.StructField("score", T.StringType()),
    ]
)
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words_of(text):
    return (text or "").translate(LOWER).encode().split()


@pytest.fixture
def make_docs(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, lang, source)`` rows."""

    def make(rows):
        full = [(*r, *("en", "s0")[len(r) - 2 :])[:4] if len(r) < 4 else r for r in rows]
        return spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in full], DOCS)

    return make


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture
def odd_texts():
    """Nulls, blanks, repeats, ties and a very long text."""
    rng = random.Random(4)
    long = sentence(rng, 30_000, 5_000)
    return [
        (1, None),
        (2, ""),
        (3, " \t\n\x0b\x0c\r"),
        (4, "one"),
        (4, "one"),
        (None, "null id"),
        (5, "Äpfel ÜBER straße x 日本語 🙂 é"),
        (6, long),
        (7, long),
        (8, "a b c d e f g"),
        (9, "A B\tC\nD e F g "),
    ]
