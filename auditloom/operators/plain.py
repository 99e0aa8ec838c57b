"""Plain monoids: what an empty group gives, and merges of texts, lists, sets, maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.operators.ordered import running_sums


def total(value: Column) -> Column:
    """Sum; 0 for no rows."""
    return F.coalesce(F.sum(value), F.lit(0))


def product(value: Column) -> Column:
    """Product; 1 for no rows."""
    return F.coalesce(F.product(value), F.lit(1.0))


def largest(value: Column) -> Column:
    """Maximum; minus infinity for no rows."""
    return F.coalesce(F.max(value.cast("double")), F.lit(float("-inf")))


def smallest(value: Column) -> Column:
    """Minimum; infinity for no rows."""
    return F.coalesce(F.min(value.cast("double")), F.lit(float("inf")))


def list_chunks(
    df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], size: int = 10_000
) -> DataFrame:
    """A group's values in order as lists of ``size``: ``keys, chunk, items``.

    The lists of a key, put together by chunk, are its whole list; none is longer than
    ``size``, however large the group. ``order`` should tell rows apart. Null values stay.
    """
    keys, order = list(keys), list(order)
    rows = df.select(*keys, *[c for c in dict.fromkeys([*order, value]) if c not in keys])
    placed = running_sums(rows, keys, order, {"__at": "1L"})
    chunk = F.expr(f"(__at - 1) div {size}").alias("chunk")
    cell = F.struct("__at", F.col(value).alias("v"))
    return placed.groupBy(*keys, chunk).agg(
        F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["v"]).alias("items")
    )


def set_chunks(df: DataFrame, keys: Sequence[str], value: str, size: int = 10_000) -> DataFrame:
    """A group's distinct values, sorted, as lists of ``size`` (see :func:`list_chunks`)."""
    distinct = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    return list_chunks(distinct, keys, value, [value], size)


def joined_text(value: Column, order: Column, separator: str = "") -> Column:
    """Texts put together in order. The result is as long as the group: keep groups
    small, for example already merged per bucket; :func:`list_chunks` takes any."""
    ordered = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.array_join(F.transform(ordered, lambda x: x["v"]), separator)


def joined_lists(value: Column, order: Column) -> Column:
    """Lists put together in order; the same caution holds."""
    ordered = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.flatten(F.transform(ordered, lambda x: x["v"]))


def merged_set(values: Column) -> Column:
    """Sorted union of set columns."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(values))))


def merge_maps(df: DataFrame, keys: Sequence[str], column: str, combine: str = "sum") -> DataFrame:
    """Merge map columns key by key, combining values with a built-in aggregate.

    The work is a grouping on the map's own keys, so it spreads; only the finished
    map of each group, one entry per distinct map key, is put together at the end.
    """
    entries = df.select(*keys, F.explode(column).alias("k", "v"))
    merged = entries.groupBy(*keys, "k").agg(F.expr(f"{combine}(v)").alias("v"))
    return merged.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(column)
    )
