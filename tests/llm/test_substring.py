"""Removal of repeated passages against brute force."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.llm.fmindex import FMIndex
from auditloom.llm.substring import _pack, _segments, _shrink, substring_dedup
from auditloom.llm.text import hashes, offsets

from .conftest import EDGE


def brute(rows, width):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            key = tuple(words[i : i + width])
            if key in seen:
                gone[i : i + width] = [True] * width
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def found(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def made_texts(seed, n=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [" ".join(rng.choice(vocabulary, size=rng.integers(8, 40))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [" ".join(rng.choice(vocabulary, size=rng.integers(0, 20)))]
        parts += [passages[i] for i in rng.integers(0, 6, size=rng.integers(0, 4))]
        texts.append("  ".join(parts) + "\n")
    return texts + ["z " * 300, "z " * 310, "ab ab ab ba " * 50]


@pytest.mark.parametrize("hot,block", [(64, 1 << 20), (2, 50)])
def test_against_brute_force(spark, docs_of, hot, block):
    texts = made_texts(hot)
    got = found(substring_dedup(docs_of(texts), width=8, gram=4, hot=hot, block_words=block))
    assert got == brute(list(enumerate(texts)), 8)


def test_edges(spark, docs_of):
    rows = substring_dedup(docs_of(EDGE), width=20).collect()
    assert len(rows) == len(EDGE)
    by_text = sorted((r.n_words, r.n_removed) for r in rows)
    assert by_text[:3] == [(0, 0)] * 3  # null, null, empty and blank texts have no words
    # a text of two words that alternate: every window but the first two is a repetition
    assert (60, 58) in by_text
    assert substring_dedup(docs_of([])).count() == 0


def test_whole_copies_keep_the_first(spark, docs_of):
    text = " ".join(f"t{i}" for i in range(50))
    got = found(substring_dedup(docs_of([text] * 90), hot=8))
    assert got[0][:2] == (50, 0)
    assert all(got[i][:2] == (50, 50) for i in range(1, 90))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=3, max_size=20), min_size=1, max_size=6))
def test_index_finds_the_first_window(sequences):
    width = 3
    text = np.array([s for seq in sequences for s in (*seq, 0)])
    ends = np.cumsum([len(s) + 1 for s in sequences]) - 1
    begins = ends - [len(s) for s in sequences]
    index, got = FMIndex(text, width), {}
    for at, low in index.statistics(text, begins, ends):
        got |= dict(zip(at.tolist(), index.earliest[low].tolist(), strict=True))
    first, want = {}, {}
    for b, e in zip(begins, ends, strict=True):
        for i in range(b, e - width + 1):
            want[i] = first.setdefault(tuple(text[i : i + width]), i)
    assert got == want


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="aB é\n\t 😀", max_size=30), max_size=6))
def test_words_are_split_at_ascii_space(texts):
    raw = [t.encode() for t in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    starts, ends = offsets(buf, bounds)
    words = [buf[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert words == [w for r in raw for w in r.split()]
    h = hashes(buf, starts, ends)
    assert len(set(h.tolist())) == len(set(words))


def test_equal_segments_of_a_task_are_folded_into_their_first_owner():
    """Also across batches, whatever the order; no doc_id comes first."""
    text = " ".join(f"w{i}" for i in range(40))
    run = _pack(8, 4)(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})]))
    known = [{"anchor": a, "hot": False} for b in run for a in b.column("anchor").to_pylist()]
    kind = pa.list_(pa.struct([("anchor", pa.int64()), ("hot", pa.bool_())]))

    def batch(ids):
        docs = pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "text": [text] * len(ids)})
        packed = next(_shrink(iter([docs])))
        return packed.append_column("known", pa.array([known] * len(ids), kind))

    rows = [r for b in _segments(8, 4)(iter([batch([9, 4]), batch([7, 5])])) for r in b.to_pylist()]
    assert len({(r["route"], r["words"]) for r in rows}) == len(rows) > 1 and {r["doc_id"] for r in rows} == {4}
    rows = [r for b in _segments(8, 4)(iter([batch([9, 4]), batch([7, None])])) for r in b.to_pylist()]
    assert len({(r["route"], r["words"]) for r in rows}) == len(rows) > 1 and {r["doc_id"] for r in rows} == {None}
