"""Mergeable aggregates: state from rows, state from states, answer from a state.

An :class:`ExprAgg` is three lists of built-in expressions, so every roll-up of it is
an ordinary Spark aggregation with partial and final steps. :class:`PythonAgg` is the
way out for a merge that no built-in expresses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

Exprs = tuple[tuple[str, str], ...]


def _columns(exprs: Exprs) -> list[Column]:
    return [F.expr(text).alias(name) for name, text in exprs]


@dataclass(frozen=True)
class ExprAgg:
    """A mergeable aggregate as SQL expressions: ``(column name, expression)`` pairs.

    ``partial`` reads raw rows, ``merge`` reads columns named like the state and
    ``present`` reads one state.
    """

    partial_exprs: Exprs
    merge_exprs: Exprs
    present_exprs: Exprs

    def partial(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        return df.groupBy(*keys).agg(*_columns(self.partial_exprs))

    def merge(self, states: DataFrame, keys: Sequence[str]) -> DataFrame:
        return states.groupBy(*keys).agg(*_columns(self.merge_exprs))

    def present(self, states: DataFrame, keys: Sequence[str]) -> DataFrame:
        return states.select(*keys, *_columns(self.present_exprs))

    def cube(self, states: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
        """Merge for several groupings at once: one scan and one shuffle.

        ``level`` is the grouping id: bit set means the column is totalled over.
        """
        keys = list(dict.fromkeys(k for s in sets for k in s))
        grouped = states.groupingSets([[F.col(k) for k in s] for s in sets], *keys)
        return grouped.agg(F.grouping_id().alias("level"), *_columns(self.merge_exprs))


@dataclass(frozen=True)
class PythonAgg:
    """A mergeable aggregate with a Python ``plus`` over rows of state columns.

    Rows are sorted by key inside a task (on disk if need be) and stream through Arrow, so
    a task holds one state at a time. States are first merged inside each source task, then
    over groups of tasks, then per key; a key that is in every task meets in ``fan`` tasks
    first, and the last one sees no more than ``fan`` states of it. Values keep their
    types: whole numbers stay whole.
    """

    plus: Callable[[dict[str, Any], dict[str, Any]], dict[str, Any]]
    fan: int = 64

    def merge(self, states: DataFrame, keys: Sequence[str]) -> DataFrame:
        keys, plus = list(keys), self.plus
        schema = to_arrow_schema(states.schema)

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, Any] | None = None
            out: list[dict[str, Any]] = []
            for batch in batches:
                for row in batch.to_pylist():
                    if held is not None and all(held[k] == row[k] for k in keys):
                        held = {**plus(held, row), **{k: row[k] for k in keys}}
                        continue
                    if held is not None:
                        out.append(held)
                    held = row
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            if held is not None:
                yield pa.RecordBatch.from_pylist([*out, held], schema=schema)

        def folded(rows: DataFrame) -> DataFrame:
            ordered = rows.sortWithinPartitions(*keys) if keys else rows
            return ordered.mapInArrow(fold, states.schema)

        once = folded(states).withColumn("__task", F.pmod(F.spark_partition_id(), F.lit(self.fan)))
        some = folded(once.repartition(*keys, "__task").drop("__task"))
        return folded(some.repartition(*keys) if keys else some.coalesce(1))


def hll(value: str = "value", lg_k: int = 14) -> ExprAgg:
    """Distinct count; sketches of unlike size refuse to merge."""
    return ExprAgg(
        (
            ("sketch", f"hll_sketch_agg({value}, {lg_k})"),
            ("n", f"count({value})"),
            ("last_ts", "max(ts)"),
        ),
        (
            ("sketch", "hll_union_agg(sketch, false)"),
            ("n", "sum(n)"),
            ("last_ts", "max(last_ts)"),
        ),
        (("estimate", "coalesce(hll_sketch_estimate(sketch), 0)"), ("n", "n"), ("last_ts", "last_ts")),
    )


def theta(value: str = "value", lg_k: int = 14) -> ExprAgg:
    """Distinct count whose sketches also intersect."""
    return ExprAgg(
        (("sketch", f"theta_sketch_agg({value}, {lg_k})"),),
        (("sketch", f"theta_union_agg(sketch, {lg_k})"),),
        (("estimate", "theta_sketch_estimate(sketch)"),),
    )


def theta_rows(value: str = "value", lg_k: int = 14) -> ExprAgg:
    """:func:`theta` with the number of values and the newest event, as stored."""
    plain = theta(value, lg_k)
    return ExprAgg(
        (*plain.partial_exprs, ("n", f"count({value})"), ("last_ts", "max(ts)")),
        (*plain.merge_exprs, ("n", "sum(n)"), ("last_ts", "max(last_ts)")),
        plain.present_exprs,
    )


# Size of a quantile digest. There is one for all: a merge takes the size it is told, and a
# smaller one would throw away what the digests hold.
KLL_K = 8192


def kll(value: str = "latency_ms", k: int = KLL_K) -> ExprAgg:
    """Quantile digest of a measure; digests must be merged with the ``k`` they were built with."""
    return ExprAgg(
        (
            ("sketch", f"kll_sketch_agg_double({value}, {k})"),
            ("n", f"count({value})"),
            ("last_ts", "max(ts)"),
        ),
        (
            ("sketch", f"kll_merge_agg_double(sketch, {k})"),
            ("n", "sum(n)"),
            ("last_ts", "max(last_ts)"),
        ),
        (("n", "n"),),
    )


def relative_error(lg_k: int) -> float:
    """Standard error of a distinct count sketch with ``2 ** lg_k`` registers."""
    return 1.04 / (2**lg_k) ** 0.5
