"""Fingerprints and groups against brute force."""

import numpy as np
import pytest

from auditloom.llm.components import components
from auditloom.llm.simhash import block_masks, fingerprint, forest, near_dedup, near_links, simhash_groups

from .conftest import EDGE


def groups_of(values, radius):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    ordered = sorted(set(values))
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in ordered}


def made_prints(seed, n):
    rng = np.random.default_rng(seed)
    out = [int(x) for x in rng.integers(0, 1 << 63, size=n, dtype=np.uint64)]
    base = out[0]
    for _ in range(n):
        bits = rng.integers(0, 64, size=rng.integers(1, 5))
        value = base
        for b in bits:
            value ^= 1 << int(b)
        out.append(value)
    return out


def test_any_near_pair_shares_a_bucket():
    masks = block_masks(3)
    rng = np.random.default_rng(5)
    for _ in range(2000):
        flips = sum(1 << int(b) for b in rng.choice(64, size=3, replace=False))
        assert any(flips & m == 0 for m in masks)


@pytest.mark.parametrize("cell", [2048, 16])
def test_links_connect_what_is_near(spark, cell):
    values = made_prints(cell, 150)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in set(signed)], "fp long").repartition(3)
    roots = {r.node: r.root for r in components(near_links(nodes, 3, cell)).collect()}
    want = groups_of(values, 3)
    classes = {}
    for v, s in zip(values, signed, strict=True):
        classes.setdefault(want[v], set()).add(roots.get(s, s))
    assert all(len(c) == 1 for c in classes.values())
    assert len({next(iter(c)) for c in classes.values()}) == len(classes)


def test_forest_is_small_and_spans():
    values = np.array(made_prints(9, 700), np.uint64)
    a, b = forest(values, None, 3)
    assert len(a) < len(values)
    assert len(set(groups_of(values.tolist(), 3).values())) == len(set(values.tolist())) - len(
        {(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if x != y}
    )


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)]
    df = spark.createDataFrame(edges, "a long, b long")
    roots = {r.node: r.root for r in components(df).collect()}
    assert set(roots.values()) == {0, 1000} and len(roots) == 201 + 301
    assert components(df.where("false")).count() == 0


def test_fingerprint_is_the_hash_of_a_single_shingle():
    import xxhash

    assert fingerprint(b"") == 0 and fingerprint(b" \n ") == 0
    assert fingerprint("Ab É  c".encode()) == xxhash.xxh64_intdigest("ab É c".encode(), 42)
    assert fingerprint(b"one two") == xxhash.xxh64_intdigest(b"one two", 42)


def test_groups_on_edges(spark, docs_of):
    rows = simhash_groups(docs_of(EDGE)).collect()
    assert len(rows) == len(EDGE)
    zero = {r.component_id for r in rows if r.fingerprint == "0" * 16}
    assert zero == {1 - 1}  # null, empty and blank texts are linked; doc 0 is the smallest
    assert simhash_groups(docs_of([])).count() == 0


def test_one_of_each_group_stays(spark, docs_of):
    docs = docs_of(["p q r s t", "p q r s t", "other words are here", None, ""])
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
    twice = docs.union(docs)
    assert sorted(r.doc_id for r in near_dedup(twice).collect()) == [0, 2, 3]
    assert {r.kept for r in kept.collect()} == {"own"}
    clash = docs.selectExpr("*", "1 as __lead", "2 as __MARK", "3 as ___rows")
    assert near_dedup(clash).columns == clash.columns


def test_the_pipeline_stage_is_the_operator(spark, docs_of):
    import corpus_pipeline

    docs = docs_of(EDGE)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    key = lambda rows: sorted(str((r.doc_id, r.text)) for r in rows)
    assert key(got.collect()) == key(near_dedup(docs).collect())
    assert corpus_pipeline.drop_near_copies(spark, docs_of([]), "").count() == 0
