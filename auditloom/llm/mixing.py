"""Interleaving of sources at target weights by proportionate-fair (Pfair) scheduling.

Rows of a source form blocks of fixed length, one block a slot. With whole-number weights w
of total W, block j of a source (from 0) is released at slot ``floor(j * W / w)`` and due
before slot ``ceil((j + 1) * W / w)``. Earliest deadline first among the released blocks
meets every deadline, so after any number of slots each source has been sent less than one
block more or less than its exact share. After W slots every source has been sent exactly
its weight in blocks and the order repeats; so these W slots are worked out once, on the
driver, and a block's slot follows from its number.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence
from math import gcd, isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditloom.llm.text import unused
from auditloom.session import measured

#: The total of the weights in lowest terms, at most: rows of the timetable that is sent to
#: every executor (some 30 MB). It bounds how finely weights can be stated, and the sources.
MAX_TOTAL = 1 << 20
#: The total that weights made from row counts are given, about.
TEMPERED_TOTAL = 1 << 16
#: Rows of a part of a source, about; a part is one window group.
_PART_ROWS = 1 << 18


def tempered(counts: Mapping[str | None, int], total: int = TEMPERED_TOTAL) -> dict[str | None, int]:
    """Targets between the natural and the even mix: the square root of each source's rows,
    as whole numbers that add up to ``total`` at most, but for sources below one."""
    roots = {s: isqrt(n * 1_000_000) for s, n in counts.items()}
    every = sum(roots.values())
    return {s: max(1, r * total // every if every > total else r) for s, r in roots.items()}


def whole_weights(weights: Mapping[str | None, int]) -> dict[str | None, int]:
    """Weights in lowest terms, by source (null first)."""
    if any(w < 1 for w in weights.values()):
        raise ValueError("every source needs a positive whole weight")
    order = sorted(weights, key=lambda s: (s is not None, s))
    least = gcd(*weights.values()) if weights else 1
    out = {s: weights[s] // least for s in order}
    if sum(out.values()) > MAX_TOTAL:
        raise ValueError(f"the weights add up to more than {MAX_TOTAL} in lowest terms: state them more coarsely")
    return out


def timetable(weights: Sequence[int]) -> list[tuple[int, int, int]]:
    """``(source, block, slot)`` of the slots after which the order repeats.

    A queue holds the blocks to come by release, another the released ones by deadline
    (then by source), one block of each source in one of them.
    """
    total = sum(weights)
    coming = [(0, i, 0) for i in range(len(weights))]
    heapq.heapify(coming)
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(total):
        while coming and coming[0][0] <= slot:
            _, i, block = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(block + 1) * total // weights[i]), i, block))
        _, i, block = heapq.heappop(ready)
        out.append((i, block, slot))
        if block + 1 < weights[i]:
            heapq.heappush(coming, ((block + 1) * total // weights[i], i, block + 1))
    return out


def mix(
    records: DataFrame,
    targets: Mapping[str | None, int] | None = None,
    source: str = "source",
    key: Column | None = None,
    block_rows: int = 8,
) -> DataFrame:
    """Place every record in the interleaved order: adds ``block``, ``release``, ``deadline``,
    ``slot`` and ``position``.

    ``targets`` are whole-number weights by source (default: :func:`tempered` row counts);
    every source of the data needs one. ``key`` (default: doc_id and the text's CRC-32)
    identifies a record and fixes the order inside its source, a hash order. No row is
    dropped or repeated: when a source has ended, its slots stay empty and the order closes
    up, so weights hold until the first source ends. Null is a source of its own; rows
    equal in key are interchangeable; an empty table gives no rows; an input column of the
    same name as a result is replaced, others may have any name; texts are only hashed, so
    their length does not matter. Weights count as they are stated; only their total in
    lowest terms is bounded (:data:`MAX_TOTAL`), and with it the number of sources.

    A source is cut into hash parts whose totals give the offsets of their rows, so a
    source with a third of all rows is ranked by many tasks.
    """
    spark = records.sparkSession
    added = ("block", "release", "deadline", "slot", "position")
    kept = [c for c in records.columns if c.lower() not in added]
    counts = {
        r["s"]: r["count"] for r in records.groupBy(F.col(source).cast("string").alias("s")).count().collect()
    }
    weights = whole_weights(tempered(counts) if targets is None else targets)
    if missing := [s for s in counts if s not in weights]:
        raise ValueError(f"sources without a target: {missing[:5]}")
    total = sum(weights.values())
    if key is None:
        text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
        number = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
        key = F.concat(number, F.lit(":"), F.crc32(text).cast("string"))
    digits = 1
    while max(counts.values(), default=0) >> (4 * digits) > _PART_ROWS:
        digits += 1
    hashed, own, part, at, place, s_, p_, offset, source_, w_, block_, slot_ = unused(
        kept, "hash", "own", "part", "at", "place", "s", "p", "offset", "source", "w", "block", "slot"
    )
    keyed = records.select(
        *[f"`{c}`" for c in kept], F.md5(key).alias(hashed), F.col(source).cast("string").alias(own)
    ).withColumn(part, F.substring(hashed, 1, digits))
    totals = keyed.groupBy(own, part).agg(F.count("*").alias("n"))
    before = Window.partitionBy(own).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # written out, so that the rows are not shuffled to meet a table that turns out small
    offsets = measured(
        totals.select(
            F.col(own).alias(s_), F.col(part).alias(p_), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(offset)
        ),
        "offsets",
    )
    inside = Window.partitionBy(own, part).orderBy(hashed)
    ranked = (
        keyed.withColumn(at, F.row_number().over(inside) - 1)
        .join(offsets, F.col(own).eqNullSafe(F.col(s_)) & (F.col(part) == F.col(p_)))
        .select(*[f"`{c}`" for c in kept], own, (F.col(at) + F.col(offset)).alias(at))
        .withColumn(place, F.expr(f"{at} div {block_rows}"))
    )
    names = {i: source for i, source in enumerate(weights)}
    rows = [(names[i], weights[names[i]], k, slot) for i, k, slot in timetable(list(weights.values()))]
    kind = f"`{source_}` string, `{w_}` long, `{block_}` long, `{slot_}` long"
    table = spark.createDataFrame(rows, kind)
    sizes = F.broadcast(table.where(F.col(block_) == 0).select(F.col(source_).alias(s_), w_))
    again = F.expr(f"{place} div {w_}")
    placed = (
        ranked.join(sizes, F.col(own).eqNullSafe(F.col(s_)))
        .withColumn(part, F.col(place) % F.col(w_))
        # MAX_TOTAL rows at most
        .join(F.broadcast(table.drop(w_)), F.col(own).eqNullSafe(F.col(source_)) & (F.col(part) == F.col(block_)))
        .withColumn(slot_, again * F.lit(total).cast("long") + F.col(slot_))
        .withColumn(block_, F.col(place))
    )
    return placed.select(
        *[f"`{c}`" for c in kept],
        F.col(block_).alias("block"),
        F.expr(f"{block_} * {total} div {w_}").alias("release"),
        F.expr(f"(({block_} + 1) * {total} + {w_} - 1) div {w_}").alias("deadline"),
        F.col(slot_).alias("slot"),
        (F.col(slot_) * block_rows + F.col(at) % block_rows).alias("position"),
    )
