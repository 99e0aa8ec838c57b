"""Bloom filters as tables: one row per block of a filter that has a bit set.

A filter of ``k`` hashes is cut into blocks of ``k`` 64-bit words. A value picks one
block and one bit in each of its words. So a value is one row when building (``bit_or``
per word, in generated code, combined inside each task) and one row when probing (an
equi-join on the block), not one per hash; and a big filter is spread over all tasks.
Blocks are filled unevenly, which costs some accuracy, so a filter is made as much
larger as it takes to hold its error rate. A block without a row is all zeros.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.hashing import block_and_bits
from auditloom.functions.joins import join_groups
from auditloom.schema import BLOOM_WORDS
from auditloom.session import measured

WORD = 64


@dataclass(frozen=True)
class Shape:
    """Size of a filter. ``bits`` is what an unblocked filter would need."""

    capacity: int
    error_rate: float
    bits: int
    hashes: int
    blocks: int


def _expected_error(per_block: float, hashes: int) -> float:
    """False positive rate when a block holds ``per_block`` values on average."""
    total, chance, j = 0.0, math.exp(-per_block), 0
    last = per_block + 12 * math.sqrt(per_block) + 20
    while j <= last:
        total += chance * (1 - (1 - 1 / WORD) ** j) ** hashes
        j += 1
        chance *= per_block / j
    return total


def values_per_block(error_rate: float, hashes: int) -> float:
    """Most values per block that keep the error rate."""
    low, high = 0.0, 64.0
    for _ in range(60):
        middle = (low + high) / 2
        if _expected_error(middle, hashes) <= error_rate:
            low = middle
        else:
            high = middle
    return low


def shape(capacity: int, error_rate: float) -> Shape:
    """Filter that holds ``capacity`` values at ``error_rate``."""
    bits = int(-capacity * math.log(error_rate) / math.log(2) ** 2)
    hashes = max(1, int(bits / capacity * math.log(2)))
    blocks = math.ceil(capacity / values_per_block(error_rate, hashes))
    return Shape(capacity, error_rate, bits, hashes, blocks)


def shape_for(
    members: DataFrame, keys: Sequence[str], value: str, error_rate: float, initial: int = 2_000, growth: int = 4
) -> Shape:
    """Filter size for the largest key: the first of ``initial * growth^i`` that holds it."""
    counts = members.select(*keys, value).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    need, capacity = counts.agg(F.max("n")).first()[0] or 0, initial
    while capacity < need:
        capacity *= growth
    fixed = shape(initial, error_rate)
    return Shape(capacity, error_rate, fixed.bits * (capacity // initial), fixed.hashes, math.ceil(
        capacity / values_per_block(error_rate, fixed.hashes)
    ))


def bits_col(capacity: Column, error_rate: Column) -> Column:
    """:func:`shape` bits for columns."""
    return F.floor(-capacity * F.ln(error_rate) / F.pow(F.ln(F.lit(2.0)), F.lit(2.0))).cast("long")


def hashes_col(capacity: Column, bits: Column) -> Column:
    """:func:`shape` hashes for columns."""
    return F.greatest(F.lit(1), F.floor(bits / capacity * F.ln(F.lit(2.0))).cast("int"))


def words(filters: DataFrame) -> list[str]:
    """Names of the word columns."""
    return [c for c in filters.columns if c[0] == "w" and c[1:].isdigit()]


def _marked(
    rows: DataFrame, columns: Sequence[str], value: str, blocks: Column, hashes: int, hash: str, prefix: str
) -> DataFrame:
    """Add the block of a value and one single-bit mask per word."""
    block, bits = block_and_bits(F.col(value), blocks, hashes, hash)
    one = F.lit(1).cast("long")
    masks = [
        F.call_function("shiftleft", one, bit).alias(f"{prefix}{i}") for i, bit in enumerate(bits)
    ]
    return rows.select(*columns, block.alias("block"), *masks)


def _build(
    rows: DataFrame, keys: Sequence[str], value: str, blocks: Column, hashes: int, hash: str
) -> DataFrame:
    marked = _marked(rows, [*keys, blocks.alias("blocks")], value, blocks, hashes, hash, "w")
    merged = [F.expr(f"bit_or(w{i})").alias(f"w{i}") for i in range(hashes)]
    return marked.groupBy(*keys, "blocks", "block").agg(*merged)


def build(
    members: DataFrame, keys: Sequence[str], value: str, size: Shape, hash: str = "xxhash64"
) -> DataFrame:
    """Filter of the values of each key. Repeated values are harmless."""
    blocks = F.lit(size.blocks).cast("long")
    return _build(members, keys, value, blocks, size.hashes, hash)


def _merge(filters: DataFrame, keys: Sequence[str], combine: str, *more: Column) -> DataFrame:
    same = (
        "if(min(blocks) = max(blocks), min(blocks), raise_error('filters of unlike size do not merge'))"
    )
    merged = [F.expr(f"{combine}({w})").alias(w) for w in words(filters)]
    return filters.groupBy(*keys, "block").agg(F.expr(same).alias("blocks"), *merged, *more)


def union(filters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Filter of the union over everything that is not in ``keys``."""
    return _merge(filters, keys, "bit_or")


def intersection(filters: DataFrame, keys: Sequence[str], inputs: int) -> DataFrame:
    """Bits set in all ``inputs`` filters; a block missing from one of them drops out.

    Holds every value present in all inputs, at a higher false positive rate.
    """
    merged = _merge(filters, keys, "bit_and", F.count(F.lit(1)).alias("inputs"))
    return merged.where(F.col("inputs") == inputs).drop("inputs")


def _answered(
    questions: DataFrame, filters: DataFrame, keys: Sequence[str], value: str, blocks: Column, hash: str
) -> DataFrame:
    names = words(filters)
    asked = _marked(questions, questions.columns, value, blocks, len(names), hash, "_m")
    found = join_groups(asked, filters.select(*keys, "block", *names), [*keys, "block"], "left")
    hits = [
        F.col(w).bitwiseAND(F.col(f"_m{i}")) == F.col(f"_m{i}") for i, w in enumerate(names)
    ]
    accessed = F.coalesce(reduce(lambda a, b: a & b, hits), F.lit(False))
    return found.select(*questions.columns, accessed.alias("accessed"))


def contains(
    questions: DataFrame,
    filters: DataFrame,
    keys: Sequence[str],
    value: str,
    size: Shape,
    hash: str = "xxhash64",
) -> DataFrame:
    """Add ``accessed`` to questions: false is certain, true may be a false positive.

    Filters have one row per key and block, so questions are not multiplied, and the
    questions about one hot filter spread over its blocks.
    """
    blocks = F.lit(size.blocks).cast("long")
    return _answered(questions, filters, keys, value, blocks, hash)


def with_probability(answers: DataFrame, filters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add how likely each answer is right: certain for no, by the filter's rate for yes."""
    rates = measured(stats(filters, keys).select(*keys, "error_rate"), "rates")
    right = F.when(F.col("accessed"), 1.0 - F.coalesce("error_rate", F.lit(0.0))).otherwise(1.0)
    return join_groups(answers, rates, keys, "left").withColumn("probability", right).drop("error_rate")


def stats(filters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fill ratio, estimated number of values and current error rate per filter.

    ``formula_rate`` follows from the number of values as in an unblocked filter,
    ``error_rate`` from the bits that are really set in every block.
    """
    names = words(filters)
    hashes = F.lit(len(names))
    ones = [F.bit_count(w) for w in names]
    hit = reduce(lambda a, b: a * b, [o / WORD for o in ones])
    out = filters.groupBy(*keys, "blocks").agg(
        F.sum(reduce(lambda a, b: a + b, ones)).alias("set_bits"), F.sum(hit).alias("_hit")
    )
    bits = F.col("blocks") * hashes * WORD
    fill = F.col("set_bits") / bits
    free = F.greatest(F.lit(1.0) - fill, F.lit(1e-300))
    items = (
        F.when(F.col("set_bits") == 0, F.lit(0).cast("long"))
        # a full filter no longer tells; it holds at least what fills half of it
        .when(F.col("set_bits") >= bits, F.floor(bits / hashes * F.ln(F.lit(2.0))).cast("long"))
        .otherwise(F.floor(-bits / hashes * F.ln(free)).cast("long"))
    )
    out = out.withColumn("bits", bits).withColumn("fill_ratio", fill).withColumn("items", items)
    miss = F.exp(-hashes * F.col("items") / F.col("bits"))
    formula = F.when(F.col("items") == 0, 0.0).otherwise(F.pow(1 - miss, hashes))
    return out.withColumn("formula_rate", formula).withColumn(
        "error_rate", F.col("_hit") / F.col("blocks")
    ).drop("_hit")


def auto_capacity(
    members: DataFrame, keys: Sequence[str], value: str, initial: int, growth: int
) -> DataFrame:
    """Capacity per key: the first of ``initial * growth^i`` that holds its values."""
    seen = members.groupBy(*keys).agg(F.approx_count_distinct(value, 0.02).alias("seen"))
    # a margin of five standard errors, so that the estimate does not undersize
    need = F.col("seen") * 1.1
    steps = F.greatest(F.lit(0.0), F.ceil(F.log(float(growth), need / initial)).cast("double"))
    return seen.withColumn(
        "capacity", (F.lit(initial) * F.pow(F.lit(float(growth)), steps)).cast("long")
    )


def build_sized(
    members: DataFrame, sizes: DataFrame, keys: Sequence[str], value: str, error_rate: float
) -> DataFrame:
    """Filter per key, each as large as its ``capacity`` in ``sizes``.

    The number of hashes follows from the error rate alone, so filters of any size
    share a table; those of unlike size are probed one by one and never merged.
    """
    hashes = shape(1_000_000, error_rate).hashes
    room = values_per_block(error_rate, hashes)
    blocks = F.ceil(F.col("capacity") / F.lit(room)).cast("long")
    sized = measured(sizes.select(*keys, blocks.alias("_blocks")), "sizes")
    return _build(join_groups(members, sized, keys), keys, value, F.col("_blocks"), hashes, "xxhash64")


def contains_sized(
    questions: DataFrame, filters: DataFrame, keys: Sequence[str], value: str
) -> DataFrame:
    """Add ``accessed`` for filters that differ in size between keys."""
    shapes = filters.select(*keys, F.col("blocks").alias("_blocks")).distinct()
    asked = join_groups(questions, measured(shapes, "shapes"), keys, "left")
    # a key without a filter has no block either, and so no row to meet
    found = _answered(asked, filters, keys, value, F.coalesce("_blocks", F.lit(1).cast("long")), "xxhash64")
    return found.drop("_blocks")


# ---- filters as a store keeps them -------------------------------------------------------
# A key may have filters of several sizes: as more values come, they go to a larger one, and
# none is filled beyond what it was made for. Filters of one size merge, and a value is in
# the key if any of its filters holds it.
STORED_ERROR = 0.01
_FIRST, _GROWTH = 1024, 4


def _room() -> float:
    return values_per_block(STORED_ERROR, BLOOM_WORDS)


def merge_shapes(filters: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """Merge filters of one size per key; those of unlike size stay side by side."""
    merged = [F.expr(f"bit_or({w})").alias(w) for w in words(filters)]
    return filters.groupBy(*keys, "blocks", "block").agg(*merged, *more)


def held(filters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many values every stored filter holds, by its bits: ``keys, blocks, items, error_rate``."""
    merged = merge_shapes(filters, keys)
    return stats(merged, keys).select(*keys, "blocks", "items", "error_rate")


def next_shapes(values: DataFrame, stored: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """The filter new values of a key go to: the smallest size that has room for them.

    ``values`` has one row per key and value; ``stored`` are the key's filters so far. Sizes
    grow by a factor of four, so a key has few of them however long it is written to.
    """
    keys = list(keys)
    # a margin of five standard errors, so that the estimate does not undersize
    need = values.groupBy(*keys).agg((F.approx_count_distinct("value", 0.02) * 1.1).alias("__need"))
    if stored is None:
        used = need.select(*keys, "__need", F.lit(None).cast("map<long,double>").alias("__used"))
    else:
        by_size = held(stored, keys).groupBy(*keys).agg(
            F.map_from_entries(F.collect_list(F.struct("blocks", F.col("items").cast("double")))).alias("__used")
        )
        used = join_groups(need, measured(by_size, "filters"), keys, "left")
    room = F.lit(_room())
    sizes = F.transform(
        F.sequence(F.lit(0), F.lit(24)),
        lambda i: F.ceil(F.lit(_FIRST) * F.pow(F.lit(float(_GROWTH)), i) / room).cast("long"),
    )
    taken = lambda b: F.coalesce(F.try_element_at(F.col("__used"), b), F.lit(0.0))
    fits = F.filter(sizes, lambda b: taken(b) + F.col("__need") <= b * room)
    return used.select(*keys, F.element_at(fits, 1).alias("__blocks"))


def filter_rows(values: DataFrame, keys: Sequence[str], stored: DataFrame | None = None) -> DataFrame:
    """Filter rows of new values, to be added to what is ``stored`` of the same keys.

    ``values`` has ``keys, value, last_ts``. Result: ``keys, blocks, block``, the words and
    the newest event of a block; the values themselves are in none of it.
    """
    keys = list(keys)
    sized = measured(next_shapes(values, stored, keys), "shapes")
    rows = join_groups(values, sized, keys)
    marked = _marked(
        rows, [*keys, F.col("__blocks").alias("blocks"), "last_ts"], "value", F.col("__blocks"), BLOOM_WORDS, "xxhash64", "w"
    )
    return merge_shapes(marked, keys, F.max("last_ts").alias("last_ts"))


def contains_any(questions: DataFrame, filters: DataFrame, keys: Sequence[str], parts: Sequence[str] = ()) -> DataFrame:
    """Add ``accessed`` and ``probability`` to questions, asked of all filters of their key.

    ``parts`` are columns that tell apart filters of one key besides their size, such as
    the days of a week: the answer is yes if any filter holds the value. A no is certain;
    a yes is right with the probability that no filter would say so by chance, from the
    bits that are set in each. Questions are spread over the blocks they ask.
    """
    keys, parts = list(keys), list(parts)
    merged = merge_shapes(filters, [*keys, *parts])
    rates = measured(
        stats(merged, [*keys, *parts]).select(*keys, *parts, "blocks", F.col("error_rate").alias("__rate")), "shapes"
    )
    quiet = F.exp(F.sum(F.ln(F.greatest(F.lit(1.0) - F.col("__rate"), F.lit(1e-12)))))
    chance = rates.groupBy(*keys).agg(quiet.alias("__quiet"))
    names = [f"w{i}" for i in range(BLOOM_WORDS)]
    shapes = rates.select(*keys, *[F.col(p).alias(f"__{p}") for p in parts], F.col("blocks").alias("__blocks"))
    asked = join_groups(questions.select(*keys, "value").distinct(), shapes, keys)
    marked = _marked(
        asked, [*keys, "value", *[f"__{p}" for p in parts], "__blocks"], "value", F.col("__blocks"), BLOOM_WORDS, "xxhash64", "m"
    )
    on = marked.withColumnsRenamed({**{f"__{p}": p for p in parts}, "__blocks": "blocks"})
    found = join_groups(on, merged, [*keys, *parts, "blocks", "block"])
    hit = reduce(lambda a, b: a & b, [F.col(w).bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}") for i, w in enumerate(names)])
    yes = found.where(hit).select(*keys, "value").distinct().withColumn("__yes", F.lit(True))
    out = join_groups(questions, yes, [*keys, "value"], "left")
    out = join_groups(out, chance, keys, "left")
    accessed = F.coalesce("__yes", F.lit(False))
    return out.select(
        *questions.columns, accessed.alias("accessed"),
        F.when(accessed, F.col("__quiet")).otherwise(1.0).alias("probability"),
    )
