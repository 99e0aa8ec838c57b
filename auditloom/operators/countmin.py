"""Count-min sketches as tables: one row per cell that is not zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.hashing import seeded_bucket
from auditloom.functions.joins import join_groups
from auditloom.operators.heavy import top_k
from auditloom.session import measured

DEPTH = 5
WIDTH = 1000


def _with_cells(df: DataFrame, item: str, depth: int, width: int, hash: str) -> DataFrame:
    rows = df.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    return rows.withColumn("c", seeded_bucket(F.col(item), F.col("r"), width, hash))


def build(
    counts: DataFrame,
    keys: Sequence[str],
    item: str = "item",
    weight: str = "cnt",
    depth: int = DEPTH,
    width: int = WIDTH,
    hash: str = "xxhash64",
) -> DataFrame:
    """Sketch of weighted items. Feed it counts per item: only those are multiplied."""
    return (
        _with_cells(counts.select(*keys, item, weight), item, depth, width, hash)
        .groupBy(*keys, "r", "c")
        .agg(F.sum(weight).alias("cnt"))
        .withColumn("depth", F.lit(depth))
        .withColumn("width", F.lit(width))
    )


def _same_shape() -> list[Column]:
    text = "if(min({0}) = max({0}), min({0}), raise_error('sketches of unlike {0} do not merge'))"
    return [F.expr(text.format(c)).alias(c) for c in ("depth", "width")]


def merge(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add sketches over everything that is not in ``keys``."""
    return cells.groupBy(*keys, "r", "c").agg(F.sum("cnt").alias("cnt"), *_same_shape())


def query(
    questions: DataFrame,
    cells: DataFrame,
    keys: Sequence[str],
    item: str = "item",
    depth: int = DEPTH,
    width: int = WIDTH,
    hash: str = "xxhash64",
) -> DataFrame:
    """Estimated count ``est`` of asked items: never below the true count."""
    on = [*keys, item]
    probes = _with_cells(questions.select(*on).distinct(), item, depth, width, hash)
    return (
        join_groups(probes, cells.select(*keys, "r", "c", "cnt"), [*keys, "r", "c"], "left")
        .groupBy(*on)
        .agg(F.min(F.coalesce("cnt", F.lit(0))).alias("est"))
    )


def totals(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total weight per sketch: every row of cells sums to it."""
    return cells.where("r = 0").groupBy(*keys).agg(F.sum("cnt").alias("total"))


def heavy_cells(
    cells: DataFrame, keys: Sequence[str], ratio: float = 0.01, limit: int = 100
) -> DataFrame:
    """Cells holding at least ``ratio`` of the weight, the ``limit`` largest per sketch."""
    order = [F.desc("cnt"), F.asc("r"), F.asc("c")]
    shared = join_groups(cells, totals(cells, keys), keys).where(F.col("cnt") >= ratio * F.col("total"))
    ranked = shared.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= limit).withColumn("ratio", F.col("cnt") / F.col("total"))


def heavy_items(
    items: DataFrame,
    cells: DataFrame,
    keys: Sequence[str],
    ratio: float = 0.01,
    hash: str = "xxhash64",
) -> DataFrame:
    """Items whose estimated share is at least ``ratio``; misses no true heavy hitter."""
    estimates = query(items, cells, keys, hash=hash)
    shared = join_groups(estimates, measured(totals(cells, keys), "totals"), keys)
    return shared.where(F.col("est") >= ratio * F.col("total"))


def hybrid(
    questions: DataFrame,
    counts: DataFrame,
    cells: DataFrame,
    keys: Sequence[str],
    k: int,
    hash: str = "xxhash64",
) -> DataFrame:
    """Exact count for the ``k`` tracked items of a key, estimate for all others."""
    on = [*keys, "item"]
    tracked = top_k(counts, keys, k).select(*on, "cnt")
    estimates = query(questions, cells, keys, hash=hash)
    return join_groups(estimates, tracked, on, "left").select(
        *on,
        F.coalesce("cnt", "est").alias("cnt"),
        F.when(F.col("cnt").isNotNull(), "exact").otherwise("estimate").alias("source"),
    )
