"""Every order and step of the filters against a plain replay of them."""

from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.llm.audit import audit_tensor, filter_audit, judged

from .conftest import EDGE


def replay(flags, filters):
    """Rows of the audit by running each order over the documents."""
    out = {}
    total = dict.fromkeys(filters, 0)
    for order in permutations(filters):
        left = list(flags)
        for step, f in enumerate(order, 1):
            gone = [d for d in left if d[f]]
            left = [d for d in left if not d[f]]
            failing = sum(d[f] for d in flags)
            alone = sum(d[f] and not any(d[g] for g in filters if g != f) for d in flags)
            lost = (sum(d["good"] for d in gone), sum(d["toxic"] for d in gone))
            out["".join(order), step] = [len(left), len(gone), failing - len(gone), alone, *lost]
            total[f] += len(gone)
    return {k: (*v, total[k[0][k[1] - 1]]) for k, v in out.items()}


FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 63), max_size=20))
def test_tensor_is_the_replay(masks):
    filters = "XYZ"
    docs = [{f: bool(m >> i & 1) for i, f in enumerate(filters)} | {"good": m >> 3 & 1, "toxic": m >> 4 & 1} for m in masks]
    cells = np.zeros((1, 3, 2, 2, 2), np.int64)
    for d in docs:
        cells[(0, slice(None), *[int(d[f]) for f in filters])] += [1, d["good"], d["toxic"]]
    found = audit_tensor(cells)
    want = replay(docs, filters)
    for i, (key, row) in enumerate(sorted(want.items(), key=lambda x: ([filters.index(c) for c in x[0][0]], x[0][1]))):
        got = [found[c][0, i] for c in FIGURES[:4]] + found["lost"][0, i].tolist() + [found["shapley"][0, i]]
        assert tuple(got) == row, key


def test_audit_of_documents(spark, docs_of):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 400))) + rng.choice(["", "#", " A B C" * 20]) for _ in range(60)]
    texts = [*EDGE, *texts, *texts[:9], (500, "w1"), (3, "w1"), (None, "w1"), (500, "w1")]
    docs = docs_of(texts).selectExpr("*", "'x' as A", "'y' as good", "'z' as mask", "1 as part")
    docs = docs.drop("lang").selectExpr("*", "case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then 'en' else 'fr' end as lang")
    labels = spark.createDataFrame(
        [(i, i % 2, i % 5) for i in range(60)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (7, None, None)],
        "doc_id long, quality int, toxic int",
    )
    marks = {}
    for r in labels.collect():
        good, bad = marks.get(r.doc_id, (False, False))
        marks[r.doc_id] = (good or r.quality == 1, bad or r.toxic == 1)
    first, rows = {}, docs.select("doc_id", "text", "lang").collect()
    for r in rows:
        if r.doc_id is not None:
            first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    parts = {}
    for r in rows:
        text = r.text or ""
        w = text.encode().split()
        good, bad = marks.get(r.doc_id, (False, False)) if r.doc_id is not None else (False, False)
        parts.setdefault(r.lang or "", []).append(
            {
                "A": len(w) < 200,
                "B": 100 * len(set(w)) < 50 * len(w),
                "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
                "D": any(c in "#$%&*|" for c in text),
                "E": r.doc_id is not None and r.doc_id > first[text],
                "good": good,
                "toxic": bad,
            }
        )
    got = filter_audit(judged(docs, labels), "ABCDE", {"good": "good_lost", "toxic": "toxic_lost"}).collect()
    assert len(got) == 600 * len(parts)
    want = {(p, *k): v for p, flags in parts.items() for k, v in replay(flags, "ABCDE").items()}
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in FIGURES) for r in got} == want
    assert judged(docs_of([]).selectExpr("*"), labels).count() == 0
    assert filter_audit(judged(docs_of([]), labels), "ABCDE", {}).count() == 0


def test_null_parts_and_verdicts(spark):
    flags = spark.createDataFrame([(None, True), (None, None), ("p", False)], "part string, F boolean")
    got = {r.part: (r.kept, r.removed, r.shapley) for r in filter_audit(flags, "F", {}).collect()}
    assert got == {None: (1, 1, 1), "p": (1, 0, 0)}
    with pytest.raises(ValueError):
        filter_audit(flags, "ABCDEFGH", {})
