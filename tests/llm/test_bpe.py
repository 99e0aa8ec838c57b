"""Token counts against the tokenizers library."""

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from auditloom.llm.bpe import ByteBpe, _hash_table, token_counts, unlike_classes

from .conftest import EDGE

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY = Tokenizer.from_file(PATH)
OURS = ByteBpe(PATH, unlike_classes())


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcthe '’sT0189.,!\n\t  éñß日本😀́", max_size=60))
def test_one_text(text):
    tokens = OURS.split(text)
    assert "".join(tokens) == text
    assert int(OURS.counts([t.encode() for t in tokens]).sum()) == library(text)


def test_table(spark, docs_of):
    texts = [*EDGE, "a<|endoftext|>b <|endoftext|><|endoftext|>", "<|endoftext", "aaaa" * 9000, "don't I'LL we've  \n\n x"]
    texts = [(i, t[1] if isinstance(t, tuple) else t) for i, t in enumerate(texts)]
    rows = token_counts(docs_of(texts), PATH, limit=3).collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows}
    want = {}
    for i, t in texts:
        n = library(t or "")
        want[i] = (len((t or "").encode()), n, n > 3)
    assert got == want
    assert token_counts(docs_of([]), PATH).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, PATH).collect()}
    assert got == {r.doc_id: library(r.text) for r in docs.collect()}


def test_every_code_point():
    """Alone and next to a letter, digit, mark and space, cut as the library cuts."""
    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    # what is unlike, what is next to it, and every tenth of the rest
    near = {d for c in unlike_classes() for d in (c - 1, c, c + 1)}
    points = [c for c in points if c in near or c < 0x3000 or c % 10 == 0]
    for around in ("{0}\n", "x{0}y\n", "1{0}2\n", "!{0}?\n", " {0} a\n", "'{0}s\n"):
        for at in range(0, len(points), 20_000):
            text = "".join(around.format(chr(c)) for c in points[at : at + 20_000])
            want = [text[a:b] for _, (a, b) in cut.pre_tokenize_str(text)]
            assert OURS.split(text) == want, around


def test_texts_of_any_code_points():
    rng = np.random.default_rng(5)
    odd = list(unlike_classes())
    for _ in range(1500):
        codes = [*rng.integers(0, 0xD800, 6), *rng.integers(0xE000, 0x110000, 3), *rng.choice(odd, 2), 0x20, 0x27, 0x73, 0x39]
        rng.shuffle(codes)
        text = "".join(chr(int(c)) for c in codes)
        tokens = OURS.split(text)
        assert int(OURS.counts([t.encode() for t in tokens]).sum()) == library(text), ascii(text)


def test_large_vocabularies_fit():
    keys = np.arange(300_000, dtype=np.int64) << 32 | 7
    slots, ranks, bits = _hash_table(keys)
    assert (slots >= 0).sum() == len(keys) and len(slots) == 1 << bits
    assert sorted(ranks[slots >= 0].tolist()) == list(range(len(keys)))
