import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from registryloom.llm import token_counts
from registryloom.llm.token_counts import DigestCache, TokenizerFile, count_tokens
from tests.llm.conftest import sentence

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]
TEXTS = [
    "a <|endoftext|>b  <|ENDOFTEXT|> <|startoftext|>",
    "  two\t\tblanks \n\n and\x0bmore\x0c ",
    "two blanks and more",
    " two blanks and more",
    "é ́x   nbsp　wide   \x85 \x1c\x1d sep ​",
    "ΣΑΣ ΟΔΟΣ İstanbul ﬁ ǅ",
    "it's we'll 1234 5.6 <s></s> ▁x <0x0A>",
    "\0 nul ﻿ bom \U0001f642\U0001f3fd",
]


def file(name):
    return TokenizerFile.load(public_tokenizers.path(name))


def by_library(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        return [len(i) for i in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_equals_the_library(spark, make_docs, odd_texts, tmp_path, name):
    rng = random.Random(2)
    rows = odd_texts + [(100 + i, t) for i, t in enumerate(TEXTS + TEXTS[:3])]
    rows += [(200 + i, sentence(rng, 40)) for i in range(20)]
    out = count_tokens(make_docs(rows), file(name), DigestCache(spark, str(tmp_path)))
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "cached"]
    counts = by_library(name, [t or "" for _, t in rows])
    want = [(i, len((t or "").encode()), n, False) for (i, t), n in zip(rows, counts)]
    assert rows_of(out) == sorted(want, key=repr)


def test_blanks_are_dropped_where_the_tokenizer_drops_them():
    assert [file(n).drops_blanks for n in NAMES] == [True, False, False]


def test_only_new_contents_are_encoded(spark, make_docs, tmp_path, monkeypatch):
    encoded = []
    plain = token_counts.encode_texts

    def seen(texts, tokenizer):
        encoded.append(sorted(r.content for r in texts.collect()))
        return plain(texts, tokenizer)

    monkeypatch.setattr(token_counts, "encode_texts", seen)
    stored, tokenizer = DigestCache(spark, str(tmp_path)), file(NAMES[0])
    first = make_docs([(1, "a b"), (2, "a  b "), (3, "c"), (4, None), (5, ""), (6, "c")])
    assert {r.cached for r in count_tokens(first, tokenizer, stored).collect()} == {False}
    second = make_docs([(1, "c"), (2, "\td e"), (3, "a\nb"), (4, "d e")])
    found = rows_of(count_tokens(second, tokenizer, stored))
    assert found == [(1, 1, 1, True), (2, 4, 2, False), (3, 3, 2, True), (4, 3, 2, False)]
    assert encoded == [["", "a b", "c"], ["d e"]]
    assert stored.read(tokenizer).count() == 4
    assert {r.cached for r in count_tokens(second, tokenizer, stored).collect()} == {True}
    assert len(encoded) == 2


def test_versions_do_not_meet(spark, make_docs, tmp_path):
    stored, docs = DigestCache(spark, str(tmp_path)), make_docs([(1, "Hello  there, world")])
    for name in NAMES:
        (row,) = count_tokens(docs, file(name), stored).collect()
        assert (row.n_tokens, row.cached) == (by_library(name, ["Hello  there, world"])[0], False)
    changed = TokenizerFile("json", file(NAMES[0]).content + b"\n")
    assert not count_tokens(docs, changed, stored).first().cached


def test_digests_stored_twice_count_once(spark, make_docs, tmp_path):
    stored, docs = DigestCache(spark, str(tmp_path)), make_docs([(1, "a b"), (2, "c")])
    count_tokens(docs, file(NAMES[0]), stored)
    held = spark.createDataFrame(stored.read(file(NAMES[0])).collect(), DigestCache.schema)
    stored.append(file(NAMES[0]), held)
    assert rows_of(count_tokens(docs, file(NAMES[0]), stored)) == [(1, 3, 2, True), (2, 1, 1, True)]


def test_many_misses_meet_by_shuffle(spark, make_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_BROADCAST_DIGESTS", 1)
    rows, stored = [(i, f"word{i % 7} x") for i in range(60)], DigestCache(spark, str(tmp_path))
    count_tokens(make_docs(rows[:3]), file(NAMES[1]), stored)
    out = count_tokens(make_docs(rows), file(NAMES[1]), stored)
    want = by_library(NAMES[1], [t for _, t in rows])
    assert rows_of(out) == sorted(((i, len(t), n, i % 7 < 3) for (i, t), n in zip(rows, want)), key=repr)


def test_memory_turns_over(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_BYTES", 2_000)
    counter = token_counts.TextCounter(file(NAMES[0]))
    rng = random.Random(3)
    texts = [sentence(rng, 12, 60) for _ in range(80)]
    assert [counter.count([t])[0] for t in texts] == by_library(NAMES[0], texts)


def test_empty_table(spark, make_docs, tmp_path):
    assert count_tokens(make_docs([]), file(NAMES[0]), DigestCache(spark, str(tmp_path))).collect() == []


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        TokenizerFile.load("x.tiktoken")
