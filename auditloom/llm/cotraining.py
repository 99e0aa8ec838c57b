"""Quality of documents by co-training a content view and a metadata view.

The content view sees hashed words and punctuation; the metadata view sees source,
language, length and layout figures in bins, and no words. Both are naive Bayes models over
presence of features, so all they need are counts, which add up over tasks. In each round
every document is scored by both views; where a view is confident, its pseudo-label counts
for the *other* view. At the end each view is calibrated on labelled rows set aside, and a
logistic curve over both calibrated views scores every document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.text import hashes, pieces
from auditloom.llm.toxicity import SAMPLE_TASKS, _logistic, held_out
from auditloom.session import materialize

VIEWS = ("content", "metadata")
#: Hashed features of a view.
WIDTH = 1 << 15
#: Labelled rows that the views begin with, at most; the hash of doc_id picks them.
TRAIN_ROWS = 20_000
PRIOR = 2.0
#: A view decides by so many features of a document, those with the most evidence: words go
#: together, so a sum over all of them would count the same evidence many times.
STRONGEST = 12
_CACHE_ENTRIES = 300_000
_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


_KIND = np.ones(256, np.int8)  # letters, with every byte beyond ASCII among them
_KIND[:128] = 2
_KIND[[*range(33), *range(48, 58), 127]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def token_hashes(raw: bytes) -> np.ndarray:
    """Hashes of the tokens of a text: runs of letters, lower-cased, and runs of marks."""
    buf = np.frombuffer(raw, np.uint8)
    kind = np.concatenate([[0], _KIND[buf], [0]])
    change = np.flatnonzero(kind[1:] != kind[:-1])
    starts, ends = change[:-1], change[1:]
    token = kind[starts + 1] > 0
    return hashes(_FOLD[buf], starts[token], ends[token])


class _Features:
    """Feature numbers of documents in both views; remembers the tokens it has met."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _number(self, name: str) -> int:
        at = self.known.get(name)
        if at is None:
            if len(self.known) > _CACHE_ENTRIES:
                self.known = {}
            at = self.known[name] = zlib.crc32(name.encode()) % WIDTH
        return at

    def content(self, raw: bytes) -> np.ndarray:
        tokens = token_hashes(raw)
        distinct = np.unique(tokens)
        variety = self._number(f"variety\t{int(10 * len(distinct) / max(len(tokens), 1))}")
        return np.unique(np.append((distinct % np.uint64(WIDTH)).astype(np.int64), variety))

    def metadata(self, raw: bytes, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
        size = max(len(raw), 1)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        letters = raw.translate(None, _NOT_LETTERS)
        upper = len(letters) - len(letters.translate(None, _UPPER))
        marks = len(raw) - len(raw.translate(None, _MARKS))
        spaces = raw.count(b" ") + len(lines)
        figures = {
            "source": source,
            "lang": lang,
            "chars": None if n_chars is None else int(math.log2(max(n_chars, 1)) * 2),
            "lines": int(math.log2(len(lines) + 1) * 2),
            "line length": int(math.log2(size / max(len(lines), 1) + 1) * 2),
            "upper": int(20 * upper / max(len(letters), 1)),
            "marks": int(40 * marks / size),
            "word length": int(2 * size / max(spaces, 1)),
            "packed": int(20 * len(zlib.compress(raw, 1)) / size),
            "same lines": int(8 * len(set(lines)) / max(len(lines), 1)),
        }
        return np.unique(np.array([self._number(f"{k}\t{v}") for k, v in figures.items()], np.int64))

    def of(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        text = (row["text"] or "").encode()
        return self.content(text), self.metadata(text, row["lang"], row["source"], row["n_chars"])


_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LETTERS = _UPPER + _UPPER.lower()
_NOT_LETTERS = bytes(b for b in range(256) if b not in _LETTERS)
_MARKS = b"".join(bytes([b]) for b in range(33, 127) if b not in _LETTERS and not 48 <= b <= 57)


@dataclass(frozen=True)
class View:
    """Log-odds of each feature, prior log-odds, and the calibration of their sum."""

    odds: np.ndarray
    curve: tuple[float, float] = (0.0, 1.0)

    def raw(self, at: np.ndarray) -> float:
        odds = self.odds[at]
        if len(odds) > STRONGEST:
            odds = odds[np.argpartition(np.abs(odds), -STRONGEST)[-STRONGEST:]]
        return float(odds.sum())

    def logit(self, at: np.ndarray) -> float:
        return self.curve[0] + self.curve[1] * self.raw(at)


def _view(counts: np.ndarray, totals: np.ndarray) -> View:
    """``counts[class, feature]`` of documents, ``totals[class]`` documents.

    The prior adds ``PRIOR`` documents with the feature, dealt to the classes by size, so a
    feature that was never met says nothing. Log-odds are drawn towards zero by two of
    their standard deviations, so features with little evidence say nothing either.
    """
    seen = counts + PRIOR * totals[:, None] / totals.sum()
    odds = np.log(seen[1] / totals[1]) - np.log(seen[0] / totals[0])
    spread = np.sqrt(1 / seen[0] + 1 / seen[1])
    return View(np.sign(odds) * np.maximum(np.abs(odds) - 2 * spread, 0))


@dataclass(frozen=True)
class QualityModel:
    """Both views and the curve over their calibrated log-odds."""

    content: View
    metadata: View
    weights: tuple[float, float, float] = (0.0, 1.0, 0.0)

    def logits(self, at: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
        return self.content.logit(at[0]), self.metadata.logit(at[1])

    def score(self, content: float, metadata: float) -> float:
        a, b, c = self.weights
        return _sigmoid(a + b * content + c * metadata)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(min(x, 60.0), -60.0)))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for low, high in pieces(batch.column("text")):
        yield from batch.slice(low, high - low).to_pylist()


def _count(label):
    """Sums of a partition, rows ``view, class, feature, n``; feature -1 counts documents.

    ``label(row, features)`` gives the class that each view should learn a row as, or None.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = _Features()
        sums = np.zeros((2, 2, WIDTH + 1), np.int64)  # the last place counts documents
        for batch in batches:
            for row in _rows(batch):
                at = make.of(row)
                for view, wanted in enumerate(label(row, at)):
                    if wanted is not None:
                        sums[view, wanted, at[view]] += 1
                        sums[view, wanted, WIDTH] += 1
        view, kind, feature = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x.astype(np.int32)) for x in (view, kind, feature)] + [pa.array(sums[view, kind, feature])],
            names=["view", "class", "feature", "n"],
        )

    return run


def _counted(docs: DataFrame, label) -> np.ndarray:
    """Counts over all rows: an array [view, class, feature]; its size is fixed by WIDTH."""
    found = (
        docs.mapInArrow(_count(label), "view int, class int, feature int, n long")
        .groupBy("view", "class", "feature")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    out = np.zeros((2, 2, WIDTH + 1))
    out[found["view"], found["class"], found["feature"]] = found["n"]
    return out


def _confident(model: QualityModel, least: float):
    """Pseudo-labels: what one view is sure of is for the other to learn."""
    bound = math.log(least / (1 - least))

    def label(row: dict, at: tuple[np.ndarray, np.ndarray]):
        sure = [None if abs(x) < bound else int(x > 0) for x in model.logits(at)]
        return sure[1], sure[0]

    return label


def _raw_scores(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = _Features()
        for batch in batches:
            rows = [(model.content.raw(c), model.metadata.raw(m)) for c, m in map(make.of, _rows(batch))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.float64()),
                    pa.array([r[1] for r in rows], pa.float64()),
                    batch.column("quality"),
                ],
                names=["content", "metadata", "quality"],
            )

    return run


def _calibrated(model: QualityModel, aside: DataFrame) -> QualityModel:
    rows = aside.mapInArrow(_raw_scores(model), "content double, metadata double, quality int").toPandas()
    y = (rows["quality"] == 1).to_numpy(float)
    if not len(y) or y.min() == y.max():
        return model
    views = []
    for name in VIEWS:
        a, b = _logistic(rows[[name]].to_numpy(float), y)
        views.append(replace(getattr(model, name), curve=(a, max(b, 0.0))))
    logits = np.column_stack([v.curve[0] + v.curve[1] * rows[n] for v, n in zip(views, VIEWS, strict=True)])
    return QualityModel(*views, weights=_logistic(np.clip(logits, -20, 20), y))


def _inputs(documents: DataFrame) -> DataFrame:
    kinds = ("long", "string", "string", "string", "long")
    return documents.select(*[F.col(c).cast(k).alias(c) for c, k in zip(_COLUMNS, kinds, strict=True)])


def fit_quality(
    documents: DataFrame,
    labels: DataFrame,
    rounds: int = 2,
    train_rows: int = TRAIN_ROWS,
    confident: float = 0.98,
    pseudo_share: float = 0.5,
) -> QualityModel:
    """Co-train both views from at most ``train_rows`` labelled rows and all documents.

    Labels of the held-out third are not used. Seven tenths of the labelled rows start the
    views, the rest calibrate them. In each round, documents on which one view gives
    ``confident`` probability or more add to the other view's counts, scaled to
    ``pseudo_share`` of the labelled documents' weight. Without labels of both kinds every
    document scores one half.
    """
    spread = F.xxhash64("doc_id", F.lit("train"))
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .orderBy(spread, "doc_id", "quality")
        .limit(train_rows)
        .select(F.col("doc_id").alias("d"), "quality", (F.pmod(spread, F.lit(10)) < 7).alias("learn"))
    )
    docs = _inputs(documents)
    sample = materialize(
        docs.join(chosen, F.col("doc_id") == F.col("d")).drop("d").repartition(SAMPLE_TASKS, "doc_id"), "sample"
    )
    aside = sample.where("not learn").select(*_COLUMNS, "quality")
    labelled = _counted(
        sample.where("learn").select(*_COLUMNS, "quality"),
        lambda row, at: (int(row["quality"] == 1),) * 2,
    )
    totals = labelled[:, :, WIDTH]
    if not totals.all():
        flat = View(np.zeros(WIDTH))
        return QualityModel(flat, flat, (0.0, 0.0, 0.0))
    counts = labelled
    for turn in range(rounds + 1):
        views = [_view(counts[v, :, :WIDTH], counts[v, :, WIDTH]) for v in range(2)]
        model = _calibrated(QualityModel(*views), aside)
        if turn == rounds:
            break
        pseudo = _counted(docs, _confident(model, confident))
        scale = np.zeros((2, 2, 1))
        np.divide(
            pseudo_share * totals, pseudo[:, :, WIDTH], out=scale[:, :, 0], where=pseudo[:, :, WIDTH] > 0
        )
        counts = labelled + pseudo * np.minimum(scale, 1.0)
    return model


def _score(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = _Features()
        for batch in batches:
            ids, rows = [], []
            for row in _rows(batch):
                c, m = model.logits(make.of(row))
                ids.append(row["doc_id"])
                rows.append((_sigmoid(c), _sigmoid(m), model.score(c, m)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *[pa.array([r[i] for r in rows], pa.float64()) for i in range(3)]],
                names=["doc_id", "content", "metadata", "score"],
            )

    return run


def quality_scores(documents: DataFrame, model: QualityModel) -> DataFrame:
    """Calibrated probability of good quality of every document, by view and combined.

    Returns ``doc_id, content, metadata, score`` for every input row. Nulls in any column
    are values of their own (a null text is empty); equal rows get equal scores; a very long
    text is read alone, its whole length counts; an empty table gives no rows; other columns
    are not read.
    """
    return _inputs(documents).mapInArrow(
        _score(model), "doc_id long, content double, metadata double, score double"
    )
