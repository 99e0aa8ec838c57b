"""Small numeric and text expressions used by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(value: Column, places: int) -> Column:
    """Round half away from zero, after clearing binary noise beyond nine places."""
    return F.round(F.round(value, 9), places)


def percentile_label(p: float) -> str:
    """``p50`` for 50, ``p999`` for 99.9: unlike numbers get unlike labels."""
    return "p" + f"{p:g}".replace(".", "")


def percentile_label_col(p: Column) -> Column:
    """:func:`percentile_label` for a column."""
    text = F.regexp_replace(p.cast("double").cast("string"), r"\.0$", "")
    return F.concat(F.lit("p"), F.replace(text, F.lit("."), F.lit("")))


def present_text(value: Column) -> Column:
    """True if a text is there and not empty."""
    return value.isNotNull() & (value != "")


def ranked_text(items: Column) -> Column:
    """``a=3;b=2`` from an array of ``(item, count)`` structs."""
    return F.array_join(F.transform(items, lambda i: F.concat_ws("=", i["item"], i["count"])), ";")
