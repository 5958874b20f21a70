import math
import random
from collections import Counter

import pytest

from checks.compare import connect, differences
from registryloom.llm import quality_rules as q
from registryloom.llm.common import read
from registryloom.llm.queries import op5_quality_rules
from registryloom.llm.sql import QUALITY_RULES

from .conftest import sentence


def brute(text):
    text = text or ""
    words = text.encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines, dup = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")], 0
    for i, line in enumerate(lines):
        dup += line in lines[:i]
    chars = sum(len(w.decode()) for w in words)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_counts_equal_brute_force(odd_texts):
    rng = random.Random(1)
    texts = [t for _, t in odd_texts]
    for _ in range(150):
        texts.append("".join(rng.choices(["a", "b ", "c\n", " ", "　", "#", "|", "é", "a b c ", "\t"], k=rng.randrange(40))))
    for t in texts:
        assert q.measure(t or "")[:5] == brute(t)


@pytest.mark.parametrize("n, p", [(1, 0.5), (30, 0.1), (400, 0.01), (5000, 0.02)])
def test_tail_is_exact(n, p):
    total = 0.0
    for k in range(min(n, 60)):
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        want = total if k < n * p else 1.0
        assert q._binomial_cdf(k, n, p) == pytest.approx(want, rel=1e-9)


def corpus(rng, n, lang, bad_share):
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < bad_share
        text = sentence(rng, 80)
        if bad:
            text = text.replace(" ", "*** ")
        rows.append((len(rows) if lang == "en" else 10_000 + i, text, lang, "s"))
        labels.append((rows[-1][0], 0 if bad else 1))
    return rows, labels


def test_cutoffs_are_proven_by_stratum(spark, make_docs):
    rng = random.Random(2)
    rows, labels = corpus(rng, 1500, "en", 0.2)
    few, few_labels = corpus(rng, 60, "de", 0.5)
    labels = spark.createDataFrame(labels + few_labels, "doc_id long, quality int")
    docs = make_docs(rows + few)
    levels = q.choose_levels(q.measures(docs), labels).collect()
    assert [r.stratum for r in levels] == ["en"], "too few labels prove nothing"
    assert levels[0].chance <= q.DELTA / 2 and levels[0].n_rejected == 0
    bad = {r.doc_id for r in labels.collect() if r.quality == 0}
    for r in q.judge(docs, labels).collect():
        assert r.kept == (r.doc_id not in bad or r.stratum == "de") and not r.base_failed
    kept = q.kept_rows(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows + few if r[0] not in bad or r[2] == "de"}
    # Texts are measured once, by one Python worker a task, whatever the filter needs.
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan


def test_good_texts_like_bad_ones_loosen_the_cutoff(spark, make_docs):
    rng = random.Random(3)
    rows, labels = corpus(rng, 1500, "en", 0.3)
    odd = [(i, 1 if rng.random() < 0.3 else y) for i, y in labels]  # good ones that look bad
    labels = spark.createDataFrame(odd, "doc_id long, quality int")
    kept = q.judge(make_docs(rows), labels)
    assert kept.filter("not kept").count() == 0


def test_query_equals_its_sql_where_levels_are_proven(spark):
    """The smaller tables have too few labels for any level; here two languages use one."""
    sf = "/root/testdata/sf0.1"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    levels = q.choose_levels(q.measures(docs), labels).collect()
    assert len({r.stratum for r in levels}) >= 2
    judged = op5_quality_rules(spark, sf)
    assert judged.filter("kept = base_failed").count() > 0
    assert differences(judged, connect(sf), QUALITY_RULES) == ""


def test_odd_rows(spark, make_docs, odd_texts):
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    rows = [(i, t, None, None) for i, t in odd_texts]
    got = q.judge(make_docs(rows), none).collect()
    assert len(got) == len(rows) and all(r.base_failed != r.kept for r in got)
    assert q.judge(make_docs([]), none).count() == 0
    assert q.kept_rows(make_docs(rows), none).count() == sum(r.kept for r in got)
