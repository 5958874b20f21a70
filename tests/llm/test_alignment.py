import random
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from registryloom.llm import alignment, sparse
from registryloom.llm.alignment import ByteTokenizer, align, aligned, with_pair_counts
from registryloom.llm.sparse import Rows, product, row_products, turned, work
from registryloom.llm.token_counts import TokenizerFile
from registryloom.llm.words import string_chunks
from tests.llm.conftest import sentence

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
TEXTS = [
    "Hello world, naïve café 日本語 🙂🏽!",
    " leading  spaces\tand\n\nlines   ",
    "<|endoftext|> </s> <s> <unk> <0x0A>",
    "a piece letter ▁ inside",
    "ﬁ ligature Ⅷ é \x00 \x1c  　",
    "e" * 300,
    " ",
    "   ",
    "end ",
    "end.\n  Next \t two\u3000 three\xa0\n",
    "a  b   c    d",
    "\n lead",
    " ▁ x",
    "one ▁",
    "\n",
    "x",
]


def file(name):
    return TokenizerFile.load(public_tokenizers.path(name))


@cache
def tokenizer(held):
    return ByteTokenizer(held)


@cache
def libraries():
    coder = Tokenizer.from_file(public_tokenizers.path(A))
    coder.encode_special_tokens = True
    return coder, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B))


def brute(texts):
    """Spans, overlaps and groups of single tokens, pair by pair."""
    coder, pieces = libraries()
    letters = {c: b for b, c in enumerate(alignment.byte_letters())}

    def piece(i):
        p = pieces.id_to_piece(i)
        if len(p) == 6 and p.startswith("<0x") and p.endswith(">"):
            return bytes([int(p[3:5], 16)])
        return p.replace("▁", " ").encode()

    out = []
    for text in texts:
        a = coder.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in coder.id_to_token(i)) for i in a]
        bytes_b = [piece(i) for i in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
            out.append(([], [], [], []))
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            ends = np.cumsum([len(p) for p in parts]).tolist()
            spans.append(list(zip([0, *ends], ends)))
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        links = [
            (i, j) for i, (p, q) in enumerate(spans[0]) for j, (x, y) in enumerate(spans[1]) if max(p, x) < min(q, y)
        ]
        groups = [
            ([i for i, s in zip(a, spans[0]) if low < s[1] <= high], [i for i, s in zip(b, spans[1]) if low < s[1] <= high])
            for low, high in zip([0, *cuts], cuts)
        ]
        out.append((a, b, [(a[i], b[j]) for i, j in links], groups))
    return out


def expected(rows):
    found = brute([t for _, t in rows])
    count = Counter(p for _, _, links, _ in found for p in set(links))
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (key, _), (a, b, links, groups) in zip(rows, found):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(count[p] == most[p[0]] for p in links)
        shared = sum(len(x) * len(y) for x, y in groups)
        out.append((key, len(a), len(b), len(groups), len(links), shared, text, best, sum(count[p] for p in links)))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups", "n_best", "count_sum"]


def counted(df, **options):
    out = with_pair_counts(align(df, file(A), file(B)), **options)
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    words = ["the", "Über", "naïve", "tokenization", "1234", "don't", "日本語", "–", "foo_bar", "x=1;", "  ", "\n"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(30)]
    return [*enumerate(TEXTS + texts + texts[:4]), (None, "null key here"), (50, "repeated"), (50, "repeated")]


@pytest.mark.parametrize("held", [0, 7, 100_000])
def test_equals_brute_force(make_docs, rows, held):
    assert counted(make_docs(rows), held_pairs=held) == expected(rows)


def test_odd_texts(make_docs, odd_texts):
    short = [(i, t) for i, t in odd_texts if len(t or "") < 1000]
    assert counted(make_docs(short)) == expected(short)
    assert counted(make_docs([])) == []


def test_long_text_in_blocks(make_docs, monkeypatch):
    rng = random.Random(8)
    rows = [(i, sentence(rng, 300, 90)) for i in range(6)]
    monkeypatch.setattr(sparse.row_products, "__defaults__", (64,))
    assert counted(make_docs(rows)) == expected(rows)


def test_texts_whose_bytes_differ_have_no_tokens(make_docs):
    (row,) = counted(make_docs([(1, "a piece letter ▁ inside")]))
    assert row == (1, 0, 0, 0, 0, 0, "", 0, 0)


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 6), st.integers(0, 6), st.integers(0, 6), st.randoms(use_true_random=False), st.integers(1, 9))
def test_products_are_those_of_dense_matrices(n, k, m, rng, most):
    def matrix(height, width):
        dense = np.array([[rng.choice([0, 0, 1, 2]) for _ in range(width)] for _ in range(height)], np.int64)
        dense = dense.reshape(height, width)
        rows, columns = np.nonzero(dense)
        starts = np.concatenate([[0], np.cumsum((dense != 0).sum(1))]).astype(np.int64)
        return dense, Rows(starts, columns, dense[rows, columns], width)

    (x, a), (y, b) = matrix(n, k), matrix(k, m)
    held = product(a, b)
    dense = np.zeros((n, m), np.int64)
    dense[held.row_of(), held.columns] = held.values
    assert (dense == x @ y).all()
    assert work(a, b).tolist() == ((x != 0).astype(int) @ (y != 0).sum(1)).tolist()
    flipped = turned(a)
    assert (flipped.height, flipped.width) == (k, n)
    in_blocks = [*row_products(a, b, most)]
    assert sum(len(r) for r, _, _ in in_blocks) == len(held.columns)


def test_overlaps_and_shared_groups_of_one_text():
    a, b = tokenizer(file(A)), tokenizer(file(B))
    text = "Tokenizers disagree about naïveté"
    m = aligned(a, b, a.encode([" " + text]), b.encode([text]))
    links = [(i, j, v) for x in m.overlaps() for i, j, v in zip(*map(np.ndarray.tolist, x))]
    assert sum(v for _, _, v in links) == len((" " + text).encode())
    shared = m.shared_groups()
    assert shared.lengths().tolist() == m.n_shared().tolist()
    pairs = set(zip(shared.row_of().tolist(), shared.columns.tolist()))
    assert {(i, j) for i, j, _ in links} <= pairs


@pytest.mark.parametrize("parted", [True, False])
def test_parts_change_nothing(make_docs, rows, parted):
    a, b = tokenizer(file(A)), tokenizer(file(B))
    assert a.parted and b.parted
    whole = [(t, " " + t) for _, t in rows if t]
    assert all("".join(alignment.parts(t)) == led for t, led in whole)
    texts = [t for t, _ in whole]
    held = alignment.aligned_texts(a, b, texts)
    a.parted = parted
    try:
        again = alignment.aligned_texts(a, b, texts)
    finally:
        a.parted = True
    assert (held[0] == again[0]).all() and held[1] == again[1]
    for i in range(len(texts)):
        one, two = ({m[3][c]: v for c, v in zip(m[2].columns[x:y], m[2].values[x:y])} for m in (held, again) for x, y in [m[2].starts[i : i + 2]])
        assert one == two


@settings(deadline=None, max_examples=300)
@given(st.text(st.sampled_from("ab. \n\t\xa0▁1é'"), max_size=14))
def test_texts_cut_anywhere(text):
    a, b = tokenizer(file(A)), tokenizer(file(B))
    ((n_a, n_b, n_groups, n_links, _),) = alignment.aligned_texts(a, b, [text])[0].T
    (ids_a, ids_b, links, groups) = brute([text])[0]
    assert (n_a, n_b, n_groups, n_links) == (len(ids_a), len(ids_b), len(groups), len(links))
    assert alignment.aligned_texts(a, b, [text])[1] == [";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)]


def test_many_texts_are_aligned_at_once():
    batch = pa.RecordBatch.from_pydict({"text": ["few words"] * 1_900})
    chunks = list(string_chunks(iter([batch]), "text", alignment.ALIGN_BYTES, alignment.ALIGN_ROWS))
    assert [len(texts) for _, texts in chunks] == [1_900]


@pytest.mark.parametrize("name", [A, B])
def test_bytes_of_many_texts_are_told_apart(name):
    coder = ByteTokenizer(TokenizerFile.load(public_tokenizers.path(name)))
    ids = coder.encode([" one two", " three"] if coder.lead else ["one two", "three"])
    whole = [b" one two", b" three"]
    assert coder.fits(ids, whole).tolist() == [True, True]
    assert coder.fits(ids[::-1], whole).tolist() == [False, False]
    assert coder.fits([[], ids[1]], [b"", b" three"]).tolist() == [True, True]
    assert coder.fits([ids[0], ids[1]], [b" one two t", b"hree"]).tolist() == [False, False]
    assert coder.fits([], []).tolist() == []
