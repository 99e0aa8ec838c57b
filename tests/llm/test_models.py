"""Toxicity and quality models: scans, defined results and held-out accuracy."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom.llm import cotraining
from auditloom.llm.cotraining import fit_quality, quality_scores
from auditloom.llm.toxicity import (
    FEW_TOXIC, LEAST_SCORE, STEP, TOKEN, _logistic, features, fit_toxicity, held_out, segments, toxicity,
)

from .conftest import EDGE

SF = "/root/testdata/sf0.1"


def all_maximal(scores):
    """Ruzzo and Tompa's definition: best contiguous segment, then left and right of it."""
    best, where = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            shorter = where is not None and total > best - 1e-12 and j + 1 - i < where[1] - where[0]
            if total > best + 1e-12 or shorter:
                best, where = total, (i, j + 1)
    if where is None:
        return []
    a, b = where
    right = [(x + b, y + b, s) for x, y, s in all_maximal(scores[b:])]
    return all_maximal(scores[:a]) + [(a, b, best)] + right


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-1, -1, -1, 2, 3.5, 0.7]), max_size=14))
def test_segments(scores):
    values = np.array(scores, float)
    at = np.flatnonzero(values > 0)
    got = segments(at, values[at], len(values), step=1.0)
    assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in all_maximal(scores)))
    assert max((s for *_, s in got), default=0) == pytest.approx(max((s for *_, s in all_maximal(scores)), default=0))
    assert all(values[a:b].sum() == pytest.approx(s) for a, b, s in got)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=14))
def test_segment_places(scores):
    """Distinct totals, so that the segments are unique: their places must agree too."""
    values = np.array([s + 1 / 2 ** (i + 2) if s > 0 else -1.0 for i, s in enumerate(scores)], float)
    at = np.flatnonzero(values > 0)
    got = segments(at, values[at], len(values), step=1.0)
    assert [(a, b) for a, b, _ in sorted(got)] == [(a, b) for a, b, _ in all_maximal(values.tolist())]


@pytest.mark.parametrize("gap", [1, 3, 60])
def test_segments_take_linear_time(gap):
    """Hits far apart, close together and just in balance with their gaps."""
    at = np.arange(200_000) * (gap + 1)
    score = np.full(len(at), 1.0) + np.arange(len(at)) * 1e-9
    for step in (0.05, 0.4, 1 / gap):
        start = time.perf_counter()
        found = segments(at, score, int(at[-1]) + 1, step=step)
        assert time.perf_counter() - start < 1.5 and found


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity(docs, fit_toxicity(docs, labels)).join(labels, "doc_id").where(held_out(F.col("doc_id")))
    rows = scored.select("score", "toxic").collect()
    caught = sum(r.score >= 0.7 for r in rows if r.toxic == 1) / sum(r.toxic == 1 for r in rows)
    false = sum(r.score >= 0.7 for r in rows if r.toxic == 0) / sum(r.toxic == 0 for r in rows)
    assert caught > 0.7 and false < 0.01


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality_scores(docs, fit_quality(docs, labels)).join(labels, "doc_id").where(held_out(F.col("doc_id")))
    rows = scored.select("content", "metadata", "score", "quality").collect()
    for view, least in (("content", 0.93), ("metadata", 0.93), ("score", 0.95)):
        assert sum((r[view] >= 0.5) == (r.quality == 1) for r in rows) / len(rows) > least


def test_edges(spark, docs_of):
    docs, empty = docs_of(EDGE), docs_of([])
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int"
    )
    for given in (labels, labels.where("false")):
        toxic, good = fit_toxicity(docs, given), fit_quality(docs, given)
        rows = toxicity(docs, toxic).collect()
        assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
        assert all(r.passages == [] for r in rows if r.doc_id == 0)
        rows = quality_scores(docs, good).collect()
        assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
        assert toxicity(empty, toxic).count() == 0 and quality_scores(empty, good).count() == 0
    assert fit_toxicity(empty, labels.where("false")).scores == {}


def test_toxicity_prior_is_the_share_in_all_documents(spark):
    """Documents without a label change the prior, and so the scores of the features."""
    rows = [(i, "bad worda wordb" if i % 2 else "good wordc wordd", i % 2) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    more = spark.createDataFrame([(1000 + i, "nothing of this kind") for i in range(3000)], docs.schema)
    few, many = (fit_toxicity(d, labels).scores for d in (docs, docs.union(more)))
    assert set(few) <= set(many) and many["bad"] > few["bad"] + 0.5


def sampled(labels, column):
    """Labelled rows that are learned from, and whether they begin the model or calibrate it."""
    spread = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(10)) < 7
    rows = labels.where(~held_out(F.col("doc_id"))).select("doc_id", column, spread.alias("learn")).collect()
    return {r.doc_id: (r[column], r.learn) for r in rows}


def corpus(spark, n=420):
    rng = np.random.default_rng(21)
    plain = [f"{a}{b}{c}" for a in ("ker", "lom", "tan", "vis") for b in ("a", "eli", "ont") for c in ("", "so", "mir")]
    bad = ["grusk", "zolpar", "vexind"]
    rows = []
    for i in range(n):
        words = rng.choice(plain, rng.integers(4, 60)).tolist()
        if i % 3 == 0:
            for w in rng.choice(bad, rng.integers(1, 5)):
                words.insert(int(rng.integers(len(words))), str(w) + ("!" if rng.random() < 0.3 else ""))
        elif i % 17 == 0:
            words.append("zolpar")
        rows.append((i, " ".join(words).capitalize() + ".", ["en", "fr", None][i % 3 == 0], f"s{i % 5 if i % 3 else 9}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    labels = spark.createDataFrame([(i, i % 3 == 0, int(i % 3 != 0), int(i % 3 == 0)) for i in range(n - 60)], "doc_id long, x boolean, quality int, toxic int")
    return docs, labels, {r[0]: r[1] for r in rows}


def test_toxicity_model_against_brute_force(spark):
    """Prior, scores, rate and scale by plain counting, segments by their definition."""
    docs, labels, texts = corpus(spark)
    model = fit_toxicity(docs, labels, prior=100.0)
    marked = sampled(labels, "toxic")
    of = {i: {f for t in TOKEN.findall(x.lower()) for f in features(t)} for i, x in texts.items()}
    learn = {i: t for i, (t, first) in marked.items() if first}
    n1, n0 = sum(learn.values()), len(learn) - sum(learn.values())
    scores = {}
    for f in set().union(*of.values()):
        y1, y0 = (sum(f in of[i] for i, t in learn.items() if t == k) for k in (1, 0))
        if y1 < 3:
            continue
        a = 100.0 * sum(f in x for x in of.values()) / len(texts)
        low = np.log((y1 + a) / (n1 + 100)) - np.log((y0 + a) / (n0 + 100)) - np.sqrt(1 / (y1 + a) + 1 / (y0 + a))
        if low > LEAST_SCORE:
            scores[f] = low
    assert model.scores == pytest.approx(scores) and 3 <= len(scores) < 40

    def found(text):
        tokens, times, values = TOKEN.findall(text.lower()), {}, []
        for t in tokens:
            s = max([scores.get(f, 0.0) for f in features(t)])
            if s > 0:
                times[t] = times.get(t, 0) + 1
                s /= times[t]
            values.append(s if s > 0 else -STEP)
        return [s for *_, s in all_maximal(values)], len(tokens)

    rest = [(t, *found(texts[i])) for i, (t, first) in marked.items() if not first]
    best = [max(s, default=0.0) for t, s, _ in rest if t == 0]
    over = np.array([b for b in best if b > 0])
    if len(over) >= 5:
        cut = np.median(over)
        tail = over[over >= cut]
        rate = 1 / max((tail - cut).mean(), 0.05)
        scale = len(tail) / sum(n for t, _, n in rest if t == 0) * np.exp(rate * cut)
    else:
        rate, scale = 1.0, 0.01
    assert (model.rate, model.scale) == pytest.approx((rate, scale))
    x = np.array([model.inputs([(0, 0, v) for v in s], n) for _, s, n in rest])
    y = np.array([t for t, _, _ in rest], float)
    p = np.array([model.probability(*row) for row in x])
    # where the likelihood with a little ridge is at its maximum, its slope is zero
    assert abs((y - p).sum() - 1e-6 * model.weights[0]) < 1e-4
    assert np.abs(x.T @ (y - p) - 1e-2 * np.array(model.weights[1:])).max() < 1e-4
    for r in toxicity(docs, model).collect():
        segs, n = found(texts[r.doc_id])
        assert r.score == pytest.approx(model.probability(*model.inputs([(0, 0, v) for v in segs], n)))


def test_cotraining_against_brute_force(spark):
    """One round by plain counting: labelled counts, pseudo-labels across the views, curves."""
    docs, labels, _ = corpus(spark)
    confident, share = 0.9, 0.5
    model = fit_quality(docs, labels, rounds=1, confident=confident, pseudo_share=share)
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    make = cotraining._Features()
    at = {i: [set(x.tolist()) for x in make.of(r)] for i, r in rows.items()}
    marked = sampled(labels, "quality")

    def counts(labelled):
        """``labelled``: document, then the class (or None) each view is told."""
        seen, total = [[{}, {}], [{}, {}]], [[0, 0], [0, 0]]
        for i, told in labelled:
            for v, c in enumerate(told):
                if c is not None:
                    total[v][c] += 1
                    for f in at[i][v]:
                        seen[v][c][f] = seen[v][c].get(f, 0) + 1
        return seen, total

    def odds(seen, total, f):
        every = sum(total)
        a, b = (seen[c].get(f, 0) + cotraining.PRIOR * total[c] / every for c in (0, 1))
        o = np.log(b / total[1]) - np.log(a / total[0])
        return np.sign(o) * max(abs(o) - 2 * np.sqrt(1 / a + 1 / b), 0)

    def raw(seen, total, i, v):
        each = sorted((odds(seen[v], total[v], f) for f in at[i][v]), key=abs, reverse=True)
        return sum(each[: cotraining.STRONGEST])

    def curves(seen, total):
        aside = [(i, q) for i, (q, first) in marked.items() if not first]
        y = np.array([q for _, q in aside], float)
        x = np.array([[raw(seen, total, i, v) for v in range(2)] for i, _ in aside])
        fits = [_logistic(x[:, [v]], y) for v in range(2)]
        return [(a, max(b, 0.0)) for a, b in fits]

    begin = [(i, (q, q)) for i, (q, first) in marked.items() if first]
    seen, total = counts(begin)
    curve = curves(seen, total)
    bound, told = np.log(confident / (1 - confident)), []
    for i in rows:
        logit = [curve[v][0] + curve[v][1] * raw(seen, total, i, v) for v in range(2)]
        sure = [None if abs(x) < bound else int(x > 0) for x in logit]
        told.append((i, (sure[1], sure[0])))
    more, heads = counts(told)
    for v in range(2):
        for c in range(2):
            scale = min(share * total[v][c] / heads[v][c], 1.0) if heads[v][c] else 0.0
            for f, n in more[v][c].items():
                seen[v][c][f] = seen[v][c].get(f, 0) + n * scale
            total[v][c] += heads[v][c] * scale
    for v, view in enumerate((model.content, model.metadata)):
        known = {f for c in range(2) for f in seen[v][c]}
        want = np.zeros(cotraining.WIDTH)
        want[list(known)] = [odds(seen[v], total[v], f) for f in known]
        assert np.allclose(view.odds[list(known)], want[list(known)])
        assert sum(heads[v]) > 100  # the views did talk to each other
    final = curves(seen, total)
    assert np.allclose([model.content.curve, model.metadata.curve], final, rtol=1e-4, atol=1e-4)
    for r in quality_scores(docs, model).collect():
        logit = [final[v][0] + final[v][1] * raw(seen, total, r.doc_id, v) for v in range(2)]
        a, b, c = model.weights
        assert r.score == pytest.approx(1 / (1 + np.exp(-(a + b * logit[0] + c * logit[1]))), abs=1e-3)


@pytest.mark.parametrize("n", [84, 120])
def test_toxicity_of_few_labels_ranks_held_out_rows(spark, n):
    """Some toxic rows to learn from, too few for the usual prior, still tell the words they share."""
    docs, labels, _ = corpus(spark, n)
    labels = labels.where(F.col("doc_id") < n - 60)
    train = labels.where(~held_out(F.col("doc_id")))
    assert 3 <= train.where("toxic = 1").count() < FEW_TOXIC
    rows = toxicity(docs, fit_toxicity(docs, labels)).where(held_out(F.col("doc_id"))).collect()
    high, low = ([r.score for r in rows if (r.doc_id % 3 == 0) == t] for t in (True, False))
    assert sum((a > b) + (a == b) / 2 for a in high for b in low) / (len(high) * len(low)) > 0.75
    assert all(0 <= r.score <= 1 for r in rows)
