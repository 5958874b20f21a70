import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from registryloom.llm import toxicity
from registryloom.llm.common import fold

from .conftest import sentence

STEMS = ["grr", "blurgh", "snorx", "vlaat"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    docs, toxic = [], []
    for i in range(1500):
        words = sentence(rng, rng.randrange(30, 90), 3000).split()
        bad = rng.random() < 0.12
        if bad:
            for _ in range(rng.randrange(2, 5)):
                words[rng.randrange(len(words))] = rng.choice(STEMS) + rng.choice(["", "a", "ig", "en,"])
        docs.append((i, " ".join(words)))
        toxic.append(bad)
    return docs, toxic


def test_held_out_accuracy(spark, make_docs, rows):
    docs, toxic = rows
    rng = random.Random(6)
    said = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic) if rng.random() < 0.6], "doc_id long, toxic int")
    df = make_docs(docs)
    learn = fold(F.col("doc_id"), 3) != 1
    model = toxicity.fit(df.filter(learn), said.filter(learn))
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    held = {r.doc_id for r in df.filter(~learn).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    wrong = [i for i in held if (got[i] >= 0.7) != toxic[i]]
    assert len(wrong) <= 0.03 * len(held)
    clean = toxicity.clean_rows(df, model, 0.7)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, s in got.items() if s < 0.7}


def test_unlabelled_positives_are_not_pushed_down():
    """Half of the unlabelled share of positives carries the feature; its weight stays positive."""
    n, prior = 4000, 0.1
    rng = np.random.default_rng(1)
    positive = np.arange(n) < 400
    has = np.where(positive, True, rng.random(n) < prior)
    owners = np.flatnonzero(has)
    w, b = toxicity.train(owners, np.zeros(len(owners), int), positive, prior, np.ones(1))
    assert b < 0 and w[0] + b > 1


def test_odd_texts_and_no_labels(spark, make_docs, odd_texts):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(make_docs(odd_texts), empty)
    got = toxicity.score(make_docs(odd_texts), model).collect()
    assert len(got) == len(odd_texts) and all(r.score < 0.1 for r in got)
    some = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    model = toxicity.fit(make_docs(odd_texts), some)
    assert toxicity.score(make_docs(odd_texts), model).count() == len(odd_texts)
    assert toxicity.score(make_docs([]), model).count() == 0
