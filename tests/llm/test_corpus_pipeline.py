from collections import Counter

import corpus_pipeline
from conftest import SF
from registryloom.llm.common import read
from registryloom.llm.queries import encoded

from .test_shingle_join import brute


def test_stages_in_order(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity",
        "quality_rules",
        "jaccard_join",
        "mixing",
        "bpe",
    ]
    docs = read(spark, SF, "documents")
    labels = {r.doc_id: r for r in read(spark, SF, "labels").collect()}
    toxic, quality, single, mixed, bpe = (f for _, f in corpus_pipeline.STAGES)

    clean = toxic(spark, docs, SF).persist()
    ids = {r.doc_id for r in clean.collect()}
    harmless = {i for i, r in labels.items() if not r.toxic}
    assert clean.columns == docs.columns and len(harmless & ids) >= 0.99 * len(harmless)

    good = quality(spark, clean, SF).persist()
    rows = {r.doc_id: r.text for r in good.collect()}
    assert good.columns == docs.columns and all(len(t.split()) >= 50 for t in rows.values())

    kept = single(spark, good, SF).persist()
    assert {r.doc_id for r in kept.collect()} == {c for _, n, c in brute(list(rows.items()))}

    copies = mixed(spark, kept, SF).persist()
    often = Counter(r.doc_id for r in copies.collect())
    assert copies.columns == docs.columns and set(often.values()) <= {1, 2}

    last = bpe(spark, copies, SF).collect()
    want = {r.doc_id: tuple(r) for r in encoded(kept).collect()}
    assert Counter(r.doc_id for r in last) == often
    assert all(tuple(r) == want[r.doc_id] for r in last)


def test_run_equals_its_stages(spark):
    docs = read(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, docs.collect()))
