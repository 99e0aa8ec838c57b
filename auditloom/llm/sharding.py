"""Rendezvous hashing of stable record keys over weighted shards, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditloom.session import materialize

#: Parts into which a shard is cut to number its rows; a part is one window group.
_PART_DIGITS = 3
#: Equal rows that one generated array holds at most.
_RUN = 4096


def record_key(column: str = "doc_id") -> Column:
    """The key of a record as text; a null key is a key of its own."""
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def _cost(key: Column, shard: Column, weight: Column) -> Column:
    """Exponential variate with the shard's weight as its rate; the least cost wins."""
    digits = F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string"))), 1, 13)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(share) / weight


def _best(key: Column, weights: Sequence[float]) -> Column:
    table = F.array(*[F.lit(float(w)) for w in weights])
    costs = F.transform(
        table, lambda w, i: F.struct(_cost(key, i, w).alias("cost"), i.cast("int").alias("shard"))
    )
    return F.array_min(costs)


def assign_shards(
    records: DataFrame, weights: Sequence[float], key: Column | None = None, grown: float | None = None
) -> DataFrame:
    """Add ``shard`` to every record, and with ``grown`` also ``grown_shard``.

    A record goes to the shard with the least cost, a hash of its key and the shard number
    scaled by the shard's weight; so shards get records in proportion to their weights and
    another shard (of weight ``grown``) takes records from all others only into itself.
    No shuffle; one pass; a null key counts as a key; an input column of the same name as
    a result is replaced.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    key = record_key() if key is None else key
    kept = [f"`{c}`" for c in records.columns if c.lower() not in ("shard", "grown_shard")]
    best = records.select(*kept, key.alias("__key")).withColumn("__best", _best(F.col("__key"), weights))
    out = best.withColumn("shard", F.col("__best.shard"))
    if grown is not None:
        n = len(weights)
        added = _cost(F.col("__key"), F.lit(n), F.lit(float(grown)))
        out = out.withColumn(
            "grown_shard", F.when(added < F.col("__best.cost"), F.lit(n)).otherwise(F.col("shard"))
        )
    return out.drop("__key", "__best")


def shard_slots(placed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number the rows of every shard from 0 without gaps: adds ``slot``.

    ``placed`` has ``shard`` and ``columns``; equal rows are counted before the shuffle and
    spread out again after it. A shard is cut into parts by a hash of its rows, rows are
    numbered within parts, and the parts' totals (a fixed number a shard) give the offsets.
    """
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    counted = placed.groupBy("shard", *columns).agg(F.count("*").alias("__n"))
    parted = materialize(
        counted.withColumn("__part", F.substring(F.md5(text), 1, _PART_DIGITS)), "placed"
    )
    totals = parted.groupBy("shard", "__part").agg(F.sum("__n").alias("__total"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("shard").alias("__s"), F.col("__part").alias("__p"),
        F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"),
    )
    inside = (
        Window.partitionBy("shard", "__part").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = parted.withColumn("__from", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    first = F.col("__from") + F.col("__offset")
    last = first + F.col("__n") - 1
    return (
        numbered.join(offsets, (F.col("shard") == F.col("__s")) & (F.col("__part") == F.col("__p")))
        .select("shard", *columns, first.alias("__first"), last.alias("__last"))
        .withColumn("__run", F.explode(F.sequence("__first", "__last", F.lit(_RUN).cast("long"))))
        .withColumn(
            "slot",
            F.explode(F.sequence("__run", F.least("__last", F.col("__run") + (_RUN - 1)))),
        )
        .select("shard", *columns, "slot")
    )


def ordered_slots(placed: DataFrame, major: str, minor: str) -> DataFrame:
    """Number the rows of every shard from 0 without gaps in the order of ``major, minor``.

    Rows are numbered within ``major`` (a part of bounded size, such as a file); the totals
    of the parts of a shard, one row each, give the offsets. The two columns are dropped.
    """
    totals = placed.groupBy("shard", major).agg(F.count("*").alias("__total"))
    before = Window.partitionBy("shard").orderBy(major).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("shard").alias("__s"), F.col(major).alias("__p"),
        F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"),
    )
    inside = Window.partitionBy("shard", major).orderBy(minor)
    numbered = placed.withColumn("__at", F.row_number().over(inside) - 1)
    return (
        numbered.join(offsets, (F.col("shard") == F.col("__s")) & (F.col(major) == F.col("__p")))
        .withColumn("slot", F.col("__at") + F.col("__offset"))
        .drop(major, minor, "__at", "__s", "__p", "__offset")
    )


def sharded_digest(
    documents: DataFrame,
    weights: Sequence[float],
    grown: float = 1.0,
    order: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Shard, slot, size and checksum of every document under the ``key`` law.

    Slots follow a hash of the row, or with ``order`` (major and minor) that order.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row for each
    input row. A null text is empty; a null doc_id is one key; rows equal in all these
    columns are interchangeable; a text is only measured and summed up, whatever its length;
    an empty table gives no rows; other columns are not read.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.length(data) + 16).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        *([] if order is None else [order[0].alias("__major"), order[1].alias("__minor")]),
    )
    placed = assign_shards(docs, weights, grown=grown)
    if order is None:
        numbered = shard_slots(placed, ["doc_id", "text_crc32", "size", "grown_shard"])
    else:
        numbered = ordered_slots(materialize(placed, "placed"), "__major", "__minor")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
