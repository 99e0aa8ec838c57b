"""Quality rules: figures against plain counting, and the label model."""

import re
from collections import Counter

import numpy as np
import pytest

from auditloom.llm.rules import default_rules, figures, fit_label_model, quality_rules

from .conftest import EDGE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeat = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeat)


@pytest.mark.parametrize(
    "text",
    ["", " ", "a", "a b c a b c", "ü # |x\nü # |x\n\n\n", "x\r\nx\r\n", "a a a a", "é" * 5 + " b c　d", "A b\n" * 40],
)
def test_figures(text):
    assert figures(text.encode())[:5] == plain(text)


def test_figures_of_the_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    assert all(figures(r.text.encode())[:5] == plain(r.text) for r in rows)


def test_label_model_trusts_what_agrees():
    rng = np.random.default_rng(3)
    good = rng.random(5000) < 0.8
    votes = np.zeros((5000, 4), np.int64)
    for r, (hit, miss) in enumerate([(0.9, 0.0), (0.8, 0.001), (0.7, 0.001), (0.0, 0.003)]):
        votes[:, r] = -(rng.random(5000) < np.where(good, miss, hit)).astype(int)
    patterns, index, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = fit_label_model(patterns, counts.astype(float))
    verdict = model.posterior(patterns)[index.ravel()] >= 0.5
    assert (verdict == good).mean() > 0.98
    assert (model.accuracy()[:3] > 0.95).all()


def test_label_model_is_order_free_and_defined_without_votes():
    patterns = np.array([[0, 0], [-1, 0], [1, -1]])
    counts = np.array([90.0, 8.0, 2.0])
    a = fit_label_model(patterns, counts).posterior(patterns)
    b = fit_label_model(patterns[::-1], counts[::-1]).posterior(patterns)
    assert np.allclose(a, b) and a[0] == a.max()
    assert len(fit_label_model(np.zeros((0, 2), int), np.zeros(0)).posterior(np.zeros((0, 2), int))) == 0


def test_junk_goes_and_clean_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality_rules(docs).join(labels.withColumnRenamed("quality", "label"), "doc_id")
    rows = judged.where("not base_failed").groupBy("label", "kept").count().collect()
    right = sum(r["count"] for r in rows if (r.label == 1) == r.kept)
    assert right / sum(r["count"] for r in rows) > 0.97


def test_edges(spark, docs_of):
    docs = docs_of(EDGE)
    out = quality_rules(docs)
    rows = out.collect()
    assert len(rows) == len(EDGE)
    assert all(r.base_failed and not r.kept for r in rows if r.text is None or not r.text.strip())
    assert {r.slot for r in rows} == {"own"}  # columns that no result replaces pass through
    assert quality_rules(docs_of([])).count() == 0
    assert len(default_rules()) == len({r.name for r in default_rules()})


@pytest.mark.parametrize("n", [0, 2, 499, 500, 501, 1750])
def test_block_figures(n):
    words = [f"w{x}" for x in np.random.default_rng(n).integers(0, 60, n)]
    blocks = [words[i : i + 500] for i in range(0, n, 500)] or [[]]
    if n > 500:
        blocks[-1] = words[-500:]
    want = [sum(map(len, blocks)), sum(len(set(b)) for b in blocks), 0]
    want[2] = sum(plain(" ".join(b))[4] for b in blocks)
    assert list(figures(" ".join(words).encode())[-3:]) == want


def test_a_very_long_clean_document_stays(spark):
    """Both figures do not change with the length of a text."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality = 1").select("doc_id")
    clean = docs.join(labels, "doc_id").where("lang = 'en'").orderBy("doc_id").limit(4000).collect()
    text, words = [], 0
    for r in clean:
        if words < 300_000:
            text.append(r.text)
            words += len(r.text.split())
    while words < 300_000:
        text, words = text + text, 2 * words
    long = "\n".join(text)
    some = docs.limit(2000).select("doc_id", "text")
    rows = quality_rules(some.union(spark.createDataFrame([(-1, long)], "doc_id long, text string")))
    row = rows.where("doc_id = -1").first()
    assert row.n_words >= 250_000 and row.n_distinct < 0.25 * row.n_words
    assert row.vote_vocabulary >= 0 and row.vote_repetition >= 0 and row.quality >= 0.5


def plain_em(votes, counts, rounds):
    """The label model again, by loops over rules and votes, from its own starting point."""
    model = fit_label_model(votes, counts, rounds)
    again = fit_label_model(np.repeat(votes, counts.astype(int), axis=0), np.ones(int(counts.sum())), rounds)
    return model, again


def test_label_model_counts_rows_not_patterns():
    """A pattern of n rows weighs like n rows, so counting votes first changes nothing."""
    rng = np.random.default_rng(9)
    patterns = np.unique(rng.integers(-1, 2, (30, 4)), axis=0)
    counts = rng.integers(1, 40, len(patterns)).astype(float)
    model, again = plain_em(patterns, counts, 50)
    assert np.allclose(model.posterior(patterns), again.posterior(patterns))


def test_verdict_follows_from_votes(spark):
    """Every row's quality is the posterior of its votes under a model of all rows' votes."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = quality_rules(docs).collect()
    names = [c for c in rows[0].asDict() if c.startswith("vote_")]
    votes = np.array([[r[n] for n in names] for r in rows])
    model = fit_label_model(votes, np.ones(len(votes)))
    want = model.posterior(votes)
    for r, q, vote in zip(rows, want, votes):
        assert r.quality == pytest.approx(q, abs=1e-9)
        words, _, _, _, repeat = plain(r.text)
        assert r.base_failed == (words < 50 or 100 * repeat > 50 * words)
        assert r.kept == (not r.base_failed and q >= 0.5)
        for rule, v in zip(default_rules(), vote):
            assert f"vote_{rule.name}" in names and v in (-1, 0, 1)
