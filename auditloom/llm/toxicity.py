"""Toxic passages by maximum-scoring segments of token log-odds.

A token is a run of letters, lower-cased; it is described by itself and by its prefixes.
The log-odds of a feature between toxic and other documents use document counts with an
informative Dirichlet prior (the feature's share in all documents), less one standard
deviation, so only features with enough evidence score above zero. All other tokens cost a
little. One linear scan finds every maximal-scoring segment of a text. Under the extreme-
value law of such scores, a text of n tokens has about ``K n exp(-lambda S)`` chance
segments of score S; this makes scores of short and long texts comparable, and a logistic
curve over it and the number of significant segments gives the final score.

Few toxic labels are too little evidence for this prior and for a part of their own that
calibrates. Then all labelled rows give the scores, against a prior that weighs no more than
the toxic rows, and each row is scanned for calibration by a model that has not seen its fold.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.text import pieces
from auditloom.session import materialize

TOKEN = regex.compile(r"\p{L}+")
PREFIXES = (5, 7)
#: What a token without evidence costs.
STEP = 0.05
#: Labelled rows that the model is fitted on, at most; the hash of doc_id picks them.
TRAIN_ROWS = 20_000
#: Tasks that the sample is dealt out to.
SAMPLE_TASKS = 24
#: Below this number of toxic rows outside the held-out third they are few.
FEW_TOXIC = 20
#: Parts of the labelled rows that are scanned by a model of the others, where toxic rows are few.
FOLDS = 5
#: Features below this score say too little to be kept.
LEAST_SCORE = 0.7
_CACHE_ENTRIES = 300_000


def features(token: str) -> list[str]:
    """The token, and its prefixes (marked) where it is longer."""
    return [token, *(f"{token[:n]}*" for n in PREFIXES if len(token) > n)]


def segments(at: np.ndarray, score: np.ndarray, n: int, step: float = STEP) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(start, end, score)`` of a sequence of ``n`` tokens.

    Tokens at the increasing places ``at`` have the positive scores ``score``, all others
    cost ``step``. A linear-time scan after Ruzzo and Tompa over a stack of candidates: each
    links to the nearest one before it that begins lower, so a candidate that was passed
    over is never looked at again, and where none begins lower the stack is final.
    """
    done: list[tuple[int, int, float]] = []
    # candidates: places, cumulative scores at both ends, nearest earlier one that begins lower
    starts: list[int] = []
    ends: list[int] = []
    lefts: list[float] = []
    rights: list[float] = []
    links: list[int] = []
    total, here = 0.0, 0
    for place, s in zip(at.tolist(), score.tolist(), strict=True):
        total -= step * (place - here)
        start, left = place, total
        total += s
        here = place + 1
        while True:
            j = len(lefts) - 1
            while j >= 0 and lefts[j] >= left:
                j = links[j]
            if j < 0:  # no candidate begins lower, so none can grow any more
                done += [(a, b, r - q) for a, b, q, r in zip(starts, ends, lefts, rights, strict=True)]
                for column in (starts, ends, lefts, rights, links):
                    column.clear()
                break
            if rights[j] >= total:
                break
            start, left = starts[j], lefts[j]
            for column in (starts, ends, lefts, rights, links):
                del column[j:]
        starts.append(start)
        ends.append(here)
        lefts.append(left)
        rights.append(total)
        links.append(j)
    return done + [(a, b, r - q) for a, b, q, r in zip(starts, ends, lefts, rights, strict=True)]


@dataclass(frozen=True)
class ToxicityModel:
    """Feature scores, extreme-value parameters and the logistic curve."""

    scores: dict[str, float]
    rate: float  # lambda
    scale: float  # K
    weights: tuple[float, float, float]
    significant: float = 0.1

    def token_score(self, token: str) -> float:
        return max((self.scores.get(f, 0.0) for f in features(token)), default=0.0)

    def chance(self, score, n):
        """Expected number of chance segments of at least this score in ``n`` tokens."""
        return self.scale * np.maximum(n, 1) * np.exp(-self.rate * np.asarray(score, float))

    def inputs(self, found: list[tuple[int, int, float]], n: int) -> tuple[float, float]:
        """Negative log of the best segment's chance (0 at least), and significant segments."""
        if not found:
            return 0.0, 0.0
        chance = self.chance([s for _, _, s in found], n)
        best = -math.log(max(float(chance.min()), 1e-30))
        return min(max(best, 0.0), 30.0), math.log1p(float((chance <= self.significant).sum()))

    def probability(self, x: float, y: float) -> float:
        a, b, c = self.weights
        return 1 / (1 + math.exp(-max(min(a + b * x + c * y, 60), -60)))


class _Scanner:
    """Segments of texts under given feature scores; remembers the tokens it has met."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.model = ToxicityModel(scores, 1.0, 1.0, (0.0, 0.0, 0.0))
        self.known: dict[str, float] = {}

    def scan(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        tokens = TOKEN.findall(text.lower())
        if len(self.known) > _CACHE_ENTRIES:
            self.known = {}
        for t in [t for t in set(tokens) if t not in self.known]:
            self.known[t] = self.model.token_score(t)
        values = np.fromiter(map(self.known.__getitem__, tokens), float, len(tokens))
        at = np.flatnonzero(values > 0)
        score = values[at]
        times: dict[str, int] = {}
        for i, place in enumerate(at.tolist()):  # a token said k times counts 1 + 1/2 + ... + 1/k
            times[tokens[place]] = k = times.get(tokens[place], 0) + 1
            if k > 1:
                score[i] /= k
        return segments(at, score, len(tokens)), len(tokens)


def _document_features(wanted: set[str] | None):
    """Rows ``fold, feature, n``: in how many documents of a batch a (wanted) feature is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[tuple[int, str]] = Counter()
            for fold, text in zip(batch.column("fold").to_pylist(), batch.column("text"), strict=True):
                tokens = set(TOKEN.findall((text.as_py() or "").lower()))
                found = {f for t in tokens for f in features(t)}
                counts.update((fold, f) for f in (found if wanted is None else found & wanted))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in counts], pa.int32()),
                    pa.array([f for _, f in counts], pa.string()),
                    pa.array(counts.values(), pa.int64()),
                ],
                names=["fold", "feature", "n"],
            )

    return run


def _shares(docs: DataFrame, wanted: set[str]) -> tuple[dict[str, int], int]:
    """In how many documents of the whole table each wanted feature is, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            counts: Counter[str] = Counter()
            for text in batch.column("text"):
                tokens = set(TOKEN.findall((text.as_py() or "").lower()))
                if len(known) > _CACHE_ENTRIES:
                    known = {}
                for t in [t for t in tokens if t not in known]:
                    known[t] = tuple(f for f in features(t) if f in wanted)
                counts.update({f for t in tokens for f in known[t]})
            counts[""] = batch.num_rows  # no feature is empty
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())],
                names=["feature", "n"],
            )

    found = docs.select("text").mapInArrow(run, "feature string, n long")
    out = {r["feature"]: r["n"] for r in found.groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    return out, out.pop("", 0)


def _scan_sample(scores: list[dict[str, float]]):
    """Rows ``toxic, n, found``: the segment scores of labelled documents, by their fold's feature scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = [_Scanner(s) for s in scores]
        for batch in batches:
            folds = batch.column("fold").to_pylist()
            texts = batch.column("text")
            rows = [scanners[k % len(scanners)].scan(t.as_py() or "") for k, t in zip(folds, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("toxic"),
                    pa.array([n for _, n in rows], pa.int64()),
                    pa.array([[s for _, _, s in found] for found, _ in rows], pa.list_(pa.float64())),
                ],
                names=["toxic", "n", "found"],
            )

    return run


def _extreme_values(rows: list) -> tuple[float, float]:
    """Rate and scale of chance segments, from the best segments of clean documents.

    The tail of best scores above their median is exponential in the score; its mean excess
    gives the rate, and the number of tokens that had to be read for one such segment the
    scale.
    """
    clean = [(max(r["found"], default=0.0), r["n"]) for r in rows if r["toxic"] != 1]
    tokens = sum(n for _, n in clean)
    best = np.array([s for s, _ in clean if s > 0])
    if len(best) < 5:
        return 1.0, 0.01
    cut = float(np.median(best))
    over = best[best >= cut]
    rate = 1 / max(float((over - cut).mean()), 0.05)
    return rate, len(over) / max(tokens, 1) * math.exp(min(rate * cut, 500))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, ...]:
    """Logistic regression with a little ridge, by Newton steps."""
    design = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(design.shape[1]), np.diag([1e-6, *[1e-2] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (y - p) - ridge @ w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge + 1e-9 * np.eye(len(w)), grad)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 3 == 1


def _log_odds(
    toxic: dict[str, int], other: dict[str, int], n1: int, n0: int,
    everywhere: dict[str, int], n_docs: int, prior: float,
) -> dict[str, float]:
    """Features that score, from their document counts among toxic and other rows."""
    scores = {}
    for f, y1 in toxic.items():
        y0 = other.get(f, 0)
        a = prior * everywhere[f] / n_docs
        odds = math.log((y1 + a) / (n1 + prior)) - math.log((y0 + a) / (n0 + prior))
        low = odds - math.sqrt(1 / (y1 + a) + 1 / (y0 + a))
        if low > LEAST_SCORE:
            scores[f] = low
    return scores


def _scanned(sample: DataFrame, scores: list[dict[str, float]]) -> list:
    found = sample.select("text", "toxic", "fold").mapInArrow(
        _scan_sample(scores), "toxic int, n long, found array<double>"
    )
    return found.collect()


def _fit_few(sample: DataFrame, docs: DataFrame, groups: list, prior: float) -> ToxicityModel:
    """The model of few toxic rows: all rows give the feature scores and all calibrate.

    Features of one toxic row in twenty count, and of every row below that. What a fold's
    rows are scanned with is learned from the other folds. The curve rises with the
    evidence alone, as there are too few rows for a second weight.
    """
    sizes = {k: Counter() for k in range(FOLDS)}
    for r in groups:
        sizes[r["fold"]][r["toxic"] == 1] += r["count"]
    n1, n0 = (sum(c[t] for c in sizes.values()) for t in (True, False))

    def counted(side, wanted: set[str] | None) -> DataFrame:
        part = sample.where(side).select("text", "fold")
        found = part.mapInArrow(_document_features(wanted), "fold int, feature string, n long")
        return found.groupBy("fold", "feature").agg(F.sum("n").alias("n"))

    toxic = materialize(counted("toxic = 1", None), "toxic")
    enough = toxic.groupBy("feature").agg(F.sum("n").alias("all")).where(F.col("all") >= n1 / 20).select("feature")
    counts = {True: {k: {} for k in range(FOLDS)}, False: {k: {} for k in range(FOLDS)}}
    for r in toxic.join(enough, "feature").collect():
        counts[True][r["fold"]][r["feature"]] = r["n"]
    wanted = {f for c in counts[True].values() for f in c}
    for r in counted("toxic <> 1", wanted).collect():
        counts[False][r["fold"]][r["feature"]] = r["n"]
    everywhere, n_docs = _shares(docs, wanted)

    def scores(without: int | None) -> dict[str, float]:
        total = {t: Counter() for t in counts}
        for t, c in counts.items():
            for k in c:
                if k != without:
                    total[t].update(c[k])
        m1, m0 = (sum(c[t] for k, c in sizes.items() if k != without) for t in (True, False))
        if not m1 or not m0:
            return {}
        return _log_odds(total[True], total[False], m1, m0, everywhere, n_docs, min(prior, m1))

    rows = _scanned(sample, [scores(k) for k in range(FOLDS)])
    rate, scale = _extreme_values(rows)
    model = ToxicityModel(scores(None), rate, scale, (0.0, 0.0, 0.0))
    x = np.array([model.inputs([(0, 0, s) for s in r["found"]], r["n"])[:1] for r in rows]).reshape(-1, 1)
    base, slope = _logistic(x, np.array([float(r["toxic"] == 1) for r in rows]))
    if slope <= 0:  # by chance: evidence never speaks against itself
        base, slope = math.log(n1 / n0), 0.1
    return ToxicityModel(model.scores, rate, scale, (base, slope, 0.0))


def fit_toxicity(
    documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, prior: float = 100.0
) -> ToxicityModel:
    """Fit on at most ``train_rows`` labelled rows outside the held-out third.

    Seven tenths of them give the feature scores, the rest calibrate; both are chosen by
    hash. With fewer than ``FEW_TOXIC`` toxic rows, or where no feature scores, all of them do
    both (see :func:`_fit_few`). The prior is each feature's share in all documents, labelled or not, which takes
    one more pass over them. Rows without label, doc_id or document do not count. Without labels of both
    kinds the model scores the share of toxic labels everywhere.
    """
    spread = F.xxhash64("doc_id", F.lit("train"))
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .orderBy(spread, "doc_id", "toxic")
        .limit(train_rows)
        .select(
            F.col("doc_id").alias("d"), "toxic", (F.pmod(spread, F.lit(10)) < 7).alias("learn"),
            (F.dense_rank().over(Window.partitionBy("toxic").orderBy(spread, "doc_id")) % FOLDS).alias("fold"),
        )
    )
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = materialize(
        docs.join(chosen, F.col("doc_id") == F.col("d"))
        .select("doc_id", "text", "toxic", "learn", "fold")
        .repartition(SAMPLE_TASKS, "doc_id"),
        "sample",
    )
    groups = sample.groupBy("learn", "toxic", "fold").count().collect()
    sizes: Counter[tuple[bool, bool]] = Counter()
    for r in groups:
        sizes[r["learn"], r["toxic"] == 1] += r["count"]
    n1, n0 = sizes[True, True], sizes[True, False]
    all1, all0 = n1 + sizes[False, True], n0 + sizes[False, False]
    if not all1 or not all0:
        share = min(max(all1 / max(all1 + all0, 1), 1e-9), 1 - 1e-9)
        return ToxicityModel({}, 1.0, 0.01, (math.log(share / (1 - share)), 0.0, 0.0))
    if all1 < FEW_TOXIC or not n1 or not n0:
        return _fit_few(sample, docs, groups, prior)

    def counted(side, wanted: set[str] | None) -> DataFrame:
        part = sample.where("learn").where(side).select("text", "fold")
        found = part.mapInArrow(_document_features(wanted), "fold int, feature string, n long")
        return found.groupBy("feature").agg(F.sum("n").alias("n"))

    # features of fewer than three toxic documents never score; the others are bounded by the sample
    toxic = {r["feature"]: r["n"] for r in counted("toxic = 1", None).where("n >= 3").collect()}
    other = {r["feature"]: r["n"] for r in counted("toxic <> 1", set(toxic)).collect()}
    everywhere, n_docs = _shares(docs, set(toxic))
    scores = _log_odds(toxic, other, n1, n0, everywhere, n_docs, prior)
    if not scores:
        return _fit_few(sample, docs, groups, prior)
    rows = _scanned(sample.where("not learn"), [scores])
    rate, scale = _extreme_values(rows)
    model = ToxicityModel(scores, rate, scale, (0.0, 0.0, 0.0))
    x = np.array([model.inputs([(0, 0, s) for s in r["found"]], r["n"]) for r in rows]).reshape(-1, 2)
    y = np.array([float(r["toxic"] == 1) for r in rows])
    weights = _logistic(x, y) if len(rows) else (math.log(n1 / n0), 0.0, 0.0)
    return ToxicityModel(scores, rate, scale, weights)


def _score(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _Scanner(model.scores)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            column = batch.column("text")
            for low, high in pieces(column):
                score, passages = [], []
                for value in column[low:high]:
                    found, n = scanner.scan(value.as_py() or "")
                    score.append(model.probability(*model.inputs(found, n)))
                    passages.append(
                        [
                            {"start": a, "end": b, "score": s}
                            for a, b, s in found
                            if model.chance(s, n) <= model.significant
                        ]
                    )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[low:high], pa.array(score, pa.float64()), pa.array(passages, kind)],
                    names=["doc_id", "score", "passages"],
                )

    return run


def toxicity(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """Score of every document and its significant passages (token ranges).

    Returns ``doc_id, score, passages`` for every input row. Null and empty texts have no
    passage and the base score; equal texts get equal scores; a very long text is scanned
    in time that grows with its length; an empty table gives no rows; other columns are not
    read.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(
        _score(model), "doc_id long, score double, passages array<struct<start: int, end: int, score: double>>"
    )
