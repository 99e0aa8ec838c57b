"""Names of texts against plain grouping."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from auditloom.llm import naming
from auditloom.llm.naming import exact_dedup, name_documents, normal
from auditloom.session import materialize

from .conftest import EDGE


def brute(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[normal(text)].append((-len(text or ""), doc_id is None, doc_id or 0, i))
    out = []
    for data, members in groups.items():
        keep = rows[min(members)[3]][0]
        digest = hashlib.sha256(data).hexdigest()
        best = min(members)[:3]
        out += [(rows[m[3]][0], keep, len(members), m[:3] == best, digest) for m in members]
    return out


def found(docs, **options):
    return [tuple(r) for r in exact_dedup(docs, **options).collect()]


@pytest.mark.parametrize("size", [3, 4096])
def test_groups_are_those_of_the_texts(spark, docs_of, size):
    rng = np.random.default_rng(size)
    alphabet = list("ab \té")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(150)]
    # prefixes of one another: the same blocks, one more, or a short last one
    texts += ["ab" * n for n in range(40)] + [" a b" * n for n in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "b" * 50), (3, "b" * 50), (None, " b" * 50)]
    want = brute(rows)
    got = found(docs_of(rows).repartition(5), block_bytes=size)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_rounds_follow_the_length(spark, docs_of):
    texts = ["x" * n for n in (0, 1, 3, 4, 6, 7, 12, 13, 3000)]
    rows = {r.n_chars: r.rounds for r in name_documents(docs_of(texts), block_bytes=3).collect()}
    assert rows == {0: 0, 1: 0, 3: 0, 4: 1, 6: 1, 7: 2, 12: 2, 13: 3, 3000: 10}


def test_edges(spark, docs_of):
    rows = found(docs_of(EDGE))
    assert len(rows) == len(EDGE)
    empty = hashlib.sha256().hexdigest()
    # null, empty and blank texts are one group; the blank one is longest, and its doc_id is 2
    assert sorted(r[:4] for r in rows if r[4] == empty and r[0] is not None) == [(0, 2, 4, False), (1, 2, 4, False), (2, 2, 4, True)]
    assert [r[3] for r in rows if r[4] == hashlib.sha256(b"abcdef").hexdigest()].count(True) == 1
    # rows repeated as a whole: exactly one of them stays
    twice = docs_of(["same"]).union(docs_of(["same"]))
    assert sorted(r[:4] for r in found(twice)) == [(0, 0, 2, False), (0, 0, 2, True)]
    assert found(docs_of([])) == []
    only = docs_of([(None, "no id"), (None, "no id")])
    assert sorted(r[:4] for r in found(only)) == [(None, None, 2, False), (None, None, 2, True)]


def test_a_block_is_sent_on_once_for_a_task(spark, docs_of, monkeypatch):
    """Copies in one task share the code of their first block."""
    written = {}

    def keep(df, label):
        written[label] = materialize(df, label)
        return written[label]

    monkeypatch.setattr(naming, "materialize", keep)
    docs = docs_of(["copy " * 100] * 500, clash=False).coalesce(1)
    assert len({r.name for r in name_documents(docs).select("name").collect()}) == 1
    assert written["blocks"].where("block is not null").count() == 1
