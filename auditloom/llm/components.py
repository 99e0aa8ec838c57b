"""Connected components of an undirected graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node it sees."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    least = materialize(least, "star").select(F.col("u").alias("w"), "m")
    linked = both.join(least, F.col("u") == F.col("w")).where("v > u")
    return linked.select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    least = materialize(edges.groupBy("b").agg(F.min("a").alias("m")), "star")
    least = least.select(F.col("b").alias("w"), "m")
    moved = edges.join(least, F.col("b") == F.col("w")).where("a <> m")
    moved = moved.select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), F.col("w").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """Rows ``node, root`` for every node with an edge; ``root`` is the least node reachable.

    ``edges`` has long columns ``a < b``. Alternates large-star and small-star rounds, which
    settle in a number of rounds that grows with the logarithm of the nodes. Each round is
    a table in the shared folder; a hub's edges are spread over tasks by skewed-join splits.
    """
    edges = materialize(edges.select("a", "b").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        edges = materialize(_small_star(_large_star(edges)), "edges")
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
