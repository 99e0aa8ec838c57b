"""How filters interact: what each one removes, in every order they can be applied in.

Every document is judged once by all filters. The verdicts of a part of the corpus form a
contingency tensor with one axis of length two (pass, fail) for each filter; it holds counts
of documents, and there are only so many cells however large the corpus is. What a filter
removes as the third of an order is that tensor contracted with (1, 0) along the filters
before it, (0, 1) along its own axis and (1, 1) along the others. One ``einsum`` takes all
steps of all orders at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.session import materialize

_WORD_GAPS = r"[\x20\x09-\x0D]+"
#: Parts whose tensors are contracted together.
_PARTS = 64
#: Filters that an audit may have; there are 5040 orders of seven.
MAX_FILTERS = 7
_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)


def content_filters(text: Column) -> dict[str, Column]:
    """When the filters A to D of a text fail: short, repetitive, upper case, symbols."""
    words = F.array_remove(F.split(text, _WORD_GAPS), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Verdicts of the five filters: ``part, A, B, C, D, E, good, toxic`` for every document.

    ``E`` fails where a smaller doc_id has the same text (told by its SHA-256). A null text
    is empty, a null language the part ``""``; a row without doc_id is no copy and makes
    none, and has no label. A document is good or toxic if any of its labels says so.
    Copies are found by one aggregation and one join on the digest, so the texts
    themselves are read once and never shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = materialize(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
            *[fails.alias(name) for name, fails in content_filters(text).items()],
        ),
        "judged",
    )
    copies = (
        seen.groupBy("digest")
        .agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("copied"), "first")
    )
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("marked"), "quality", "toxic")
        .groupBy("marked")
        .agg(
            F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
            F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
        )
    )
    return (
        seen.join(copies, F.col("digest") == F.col("copied"), "left")
        .join(marks, F.col("doc_id") == F.col("marked"), "left")
        .select(
            "part", "A", "B", "C", "D",
            F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"),
            *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")],
        )
    )


def _selectors(n: int) -> tuple[list[tuple[int, ...]], dict[str, np.ndarray]]:
    """All orders of ``n`` filters, and for every (order, step) one vector along each axis."""
    orders = list(permutations(range(n)))
    shape = (len(orders) * n, n, 2)
    kept, removed, failing, alone = (np.empty(shape, np.int64) for _ in range(4))
    for i, order in enumerate(orders):
        for step, own in enumerate(order):
            row = i * n + step
            for axis in range(n):
                earlier = axis in order[:step]
                kept[row, axis] = _PASS if earlier or axis == own else _ALL
                removed[row, axis] = _FAIL if axis == own else _PASS if earlier else _ALL
                failing[row, axis] = _FAIL if axis == own else _ALL
                alone[row, axis] = _FAIL if axis == own else _PASS
    return orders, {"kept": kept, "removed": removed, "failing": failing, "alone": alone}


def contract(cells: np.ndarray, select: np.ndarray) -> np.ndarray:
    """Contract tensors ``(part, measure, 2, ..., 2)`` with one vector an axis, for every row
    of ``select`` (row, axis, 2): an array (part, row, measure)."""
    axes = "abcdefg"[: select.shape[1]]
    vectors = [select[:, i] for i in range(select.shape[1])]
    return np.einsum(f"pm{axes},{','.join('x' + a for a in axes)}->pxm", cells, *vectors, optimize=True)


def audit_tensor(cells: np.ndarray) -> dict[str, np.ndarray]:
    """Figures of every part, order and step from tensors of (count, then tallies)."""
    n = cells.ndim - 2
    orders, select = _selectors(n)
    removed = contract(cells, select["removed"])
    failing = contract(cells[:, :1], select["failing"])[..., 0]
    own = np.array([f for order in orders for f in order])
    total = np.stack([removed[:, own == f, 0].sum(axis=1) for f in range(n)], axis=1)
    return {
        "kept": contract(cells[:, :1], select["kept"])[..., 0],
        "removed": removed[..., 0],
        "redundant": failing - removed[..., 0],
        "unique_fails": contract(cells[:, :1], select["alone"])[..., 0],
        "lost": removed[..., 1:],
        "shapley": total[:, own],
    }


def filter_audit(flags: DataFrame, filters: Sequence[str], tallies: Mapping[str, str], part: str = "part") -> DataFrame:
    """What every filter does at every step of every order, per part.

    ``flags`` has one row for each document: boolean columns ``filters`` (true: fails; null:
    passes), named by one character each, and boolean columns ``tallies`` (column: name of
    the result that counts the removed documents for which it is true). Returns ``part,
    filter_order, step, kept, removed, redundant, unique_fails``, the tallies and
    ``shapley``, zeros included: all orders and steps of every part that has a document. A
    null part is one of its own; repeated rows are documents of their own; an empty table
    gives no rows; other columns are not read.

    Documents are counted into cells inside the tasks; what is shuffled is one row for each
    task, part and cell, so neither a hot part nor its size matters.
    """
    filters = list(filters)
    if not 0 < len(filters) <= MAX_FILTERS:
        raise ValueError(f"an audit takes 1 to {MAX_FILTERS} filters")
    bit = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    mask = F.lit(0)
    for f in filters:  # the first filter is the first axis
        mask = mask * 2 + bit(f)
    sums = [F.sum(bit(c)).alias(f"t{i}") for i, c in enumerate(tallies)]
    cells = flags.groupBy(F.col(part).alias("part"), mask.alias("mask")).agg(F.count("*").alias("n"), *sums)
    measures = ["n", *(f"t{i}" for i in range(len(tallies)))]
    tensors = cells.groupBy("part").agg(  # a row for each cell, 2 ** len(filters) at most
        F.collect_list(F.struct("mask", *measures)).alias("cells")
    )
    names = ["".join(filters[i] for i in order) for order in permutations(range(len(filters)))]
    steps = list(range(1, len(filters) + 1))
    figures = ["kept", "removed", "redundant", "unique_fails", *tallies.values(), "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _PARTS):
                some = batch.slice(at, _PARTS)
                full = np.zeros((some.num_rows, len(measures), 1 << len(filters)), np.int64)
                for p, row in enumerate(some.column("cells").to_pylist()):
                    for cell in row:
                        full[p, :, cell["mask"]] = [cell[m] for m in measures]
                found = audit_tensor(full.reshape(some.num_rows, len(measures), *[2] * len(filters)))
                lost = found.pop("lost")
                rows = len(names) * len(steps)
                found |= {name: lost[..., i] for i, name in enumerate(tallies.values())}
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("part").take(pa.array(np.repeat(np.arange(some.num_rows), rows))),
                        pa.array(np.repeat(names, len(steps)).tolist() * some.num_rows, pa.string()),
                        pa.array(np.tile(steps, some.num_rows * len(names)), pa.int32()),
                        *[pa.array(found[c].reshape(-1), pa.int64()) for c in figures],
                    ],
                    names=["part", "filter_order", "step", *figures],
                )

    kind = dict(flags.dtypes)[part]
    schema = f"part {kind}, filter_order string, step int, " + ", ".join(f"`{c}` long" for c in figures)
    return tensors.mapInArrow(run, schema)
