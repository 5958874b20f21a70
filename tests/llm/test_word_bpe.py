import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from registryloom.llm import word_bpe, words
from registryloom.llm.lexicon import Lexicon, build
from registryloom.llm.queries import tokenizer_spec

ODD = [
    "ΟΔΟΣ Σ ς", "İstanbul ǅ ŉ ß ẞ ﬁ", "a\x1cb\x85c　d​e", "don't I'LL 12½ x² 've'd",
    "<|endoftext|>Hi<|startoftext|> <|endoftext|>", "é Å q̣̇", "日本語テキスト🙂👩‍👩‍👧 ﷺ",
    "___---  \n\t ok", "﻿ zero­", "ⅷ ① ٣ 5", "x" * 500 + " " + "ab" * 300, "ok, no! yes? a.b",
]


@pytest.fixture(scope="module")
def spec():
    return tokenizer_spec()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(df, texts, spec, library, lexicon):
    rows = word_bpe.encode(df, spec, lexicon).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids), r.decoded) for r in rows)
    want = []
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i is None, i or 0, np.array(ids, "<u4").tobytes(), text))
    assert got == sorted(want)


def test_equals_the_library(make_docs, odd_texts, spec, library):
    rng = random.Random(1)
    pieces = [*"abcdefgh", "é", "ö", " ", " ", "'", "s", "1", ".", "\n", "日", "#", "Σ", "́"]
    made = ["".join(rng.choices(pieces, k=rng.randrange(60))) for _ in range(200)]
    texts = [*odd_texts, *enumerate([*ODD, *made], 100)]
    df = make_docs(texts)
    # With few words in the lexicon most are merged where they occur; with many, looked up.
    check(df, texts, spec, library, word_bpe.write_lexicon(df, spec, words=5))
    check(df, texts, spec, library, word_bpe.write_lexicon(df, spec))


def test_no_texts(make_docs, spec):
    df = make_docs([])
    assert word_bpe.encode(df, spec, word_bpe.write_lexicon(df, spec)).count() == 0


def test_lexicon_finds_its_words_alone(tmp_path):
    rng = random.Random(2)
    words = {"".join(rng.choices("abc", k=rng.randrange(1, 9))) for _ in range(900)}
    entries = {w.encode(): [len(w), *w.encode()] for w in words}
    path = tmp_path / "x.npy"
    path.write_bytes(build(entries))
    asked = [*entries, *(("".join(rng.choices("abcd", k=5))).encode() for _ in range(500)), b"", b"z" * 99]
    assert Lexicon(str(path)).find(asked) == [entries.get(w) for w in asked]


def test_suffixes_are_shared(tmp_path):
    words = [a + b + b"ingly" for a in (b"a", b"b", b"c") for b in (b"x", b"yy", b"zzz")]
    path = tmp_path / "x.npy"
    path.write_bytes(build({w: [i] for i, w in enumerate(words)}))
    assert len(Lexicon(str(path)).keys) == 3 + 3 + 1 + 2 + 5


def test_short_and_long_merging_agree(spec):
    merger = word_bpe.Merger(json.loads(spec))
    rng = random.Random(3)
    for _ in range(500):
        word = "".join(rng.choices("abcdeintrhslo", k=rng.randrange(1, 50)))
        ids = [merger.vocab[c] for c in word[:-1]] + [merger.vocab[word[-1] + "</w>"]]
        assert merger._merge_short(list(ids)) == merger._merge_long(list(ids))


def test_words_merged_side_by_side_are_those_merged_alone(spec):
    merger = word_bpe.Merger(json.loads(spec))
    rng = random.Random(4)
    made = ["".join(rng.choices("abcdeintrhsloéß日_", k=rng.randrange(0, 40))) for _ in range(800)]
    words = [*made, "", "a", "the", "🙂", "aaaaaaaaaa", "x" * 300]
    assert merger.merge_many(words) == [merger.merge(w) for w in words]
    assert merger.merge_many([]) == []


def test_stretches_split_at_once_are_those_split_alone(spec):
    _, special = word_bpe._loaded(spec)
    rng = random.Random(6)
    made = ["".join(rng.choices([*"aBcΣσ\u0301'.,1_é日İ", "A\u030a"], k=rng.randrange(1, 8))) for _ in range(900)]
    plain = [*made, *(s for t in ODD for s in word_bpe.stretches(t) if not special.search(s))]
    for texts in (plain, [t for t in plain if t.isascii()], [*plain, "a<|endoftext|>B"], ["Σ"]):
        assert word_bpe.split_many(texts, special) == [word_bpe.split_words(t, special) for t in texts]


def test_a_look_into_memory_goes_through_what_is_wanted_alone(spec, tmp_path):
    class Held(dict):
        def keys(self):
            raise AssertionError("goes through all that is known")

    path = tmp_path / "x.npy"
    path.write_bytes(build({b"the": [1, 2]}))
    encoder = word_bpe.Encoder(*word_bpe._loaded(spec), Lexicon(str(path)))
    encoder.known, encoder.older = Held(a=b""), Held(b=b"")
    assert encoder._missing({"a", "b", "c"}) == ["c"] and set(encoder.known) == {"a", "b"}


def test_memory_turns_over_and_drops_long_stretches(spec, library, tmp_path, monkeypatch):
    monkeypatch.setattr(word_bpe, "MEMO_BYTES", 20_000)
    path = tmp_path / "x.npy"
    path.write_bytes(build({b"the": [518 - 256]}))
    merger, special = word_bpe._loaded(spec)
    encoder = word_bpe.Encoder(merger, special, Lexicon(str(path)))
    rng = random.Random(5)
    for _ in range(60):
        texts = [" ".join(f"w{rng.randrange(90)}, x{rng.randrange(900)}" for _ in range(9)) for _ in range(4)]
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        ids = encoder.encode(texts)
        assert [np.frombuffer(i, "<u4").tolist() for i in ids] == want
        assert encoder.decode(ids) == [library.decode(i, skip_special_tokens=False) for i in want]
        assert encoder.size < 40_000
    long = "y" * 5_000 + " z"
    assert len(encoder.encode([long])) == 1 and not any(len(s) > 64 for s in encoder.known)


def test_workers_keep_the_last_operators_state_alone():
    made = []
    one = words.held("a", lambda: made.append(1) or object())
    assert words.held("a", lambda: made.append(2) or object()) is one
    assert words.held("b", lambda: made.append(3) or object()) is not one
    words.held("a", lambda: made.append(4) or object())
    assert made == [1, 3, 4] and len(words._held) == 1
    words.release()
    assert not words._held
