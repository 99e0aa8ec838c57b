"""Quantiles: a mergeable digest for the roll-ups and an exact distributed form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.buckets import bucket_start, expires_at
from auditloom.functions.joins import join_groups
from auditloom.operators.mergeable import KLL_K, kll
from auditloom.session import materialize, measured

# Rank error of a digest of this size (99 % sure, the published fit for KLL), and a third
# more for checks; still below the share above p99.9.
RANK_ERROR = round(4 / 3 * 2.296 / KLL_K**0.9021, 6)


def kll_rollup(events: DataFrame, window: str = "1h", metric: str = "api_latency") -> DataFrame:
    """Latency digest per system and bucket."""
    timed = events.where("latency_ms is not null").select(
        "system", "ts", "latency_ms", bucket_start(F.col("ts"), window).alias("bucket_start")
    )
    return (
        kll("latency_ms", KLL_K)
        .partial(timed, ["system", "bucket_start"])
        .select(
            F.lit(metric).alias("metric"), "system", F.lit(window).alias("window"), "bucket_start",
            "sketch", "n", "last_ts", expires_at(F.col("last_ts"), window).alias("expires_at"),
        )
    )


def merge_kll(rollup: DataFrame, keys: Sequence[str]) -> DataFrame:
    return kll(k=KLL_K).merge(rollup, keys)


def percentiles(rollup: DataFrame, keys: Sequence[str], ps: Sequence[float]) -> DataFrame:
    """One row per key and percentile (0..100) from digests: ``p, value``."""
    ranks = F.array(*[F.lit(p / 100.0) for p in ps])
    values = F.kll_sketch_get_quantile_double("sketch", ranks)
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in ps]).alias("p"), values.alias("value"))
    return rollup.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.p", "x.value")


#: Values of a key, or of what is left of it, that one task puts in order.
RANKED_ROWS = 1 << 20
#: Ranks that a digest is asked for at once.
_GRID = 1024


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ps: Sequence[float],
    kind: str = "cont",
    ranked_rows: int = RANKED_ROWS,
) -> DataFrame:
    """Exact percentiles (0..100) per key: ``p, value``.

    ``cont`` interpolates between neighbours, ``disc`` takes a value that occurs. Values
    are compared as doubles. Keys of up to ``ranked_rows`` values are counted by value and
    ranked as they are. For larger ones the ranks are selected: a digest tells between
    which values a rank must lie, a second scan counts what is below and between, and only
    the brackets go on, until they are small. No copy of the input is made, and what a
    digest guesses decides nothing but the number of rounds.
    """
    if kind not in ("cont", "disc"):
        raise ValueError(f"unknown kind {kind}; valid: cont, disc")
    keys = list(keys)
    if not keys:
        whole = df.select(F.lit(0).alias("__all"), value)
        return exact_percentiles(whole, ["__all"], value, ps, kind, ranked_rows).drop("__all")
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("value"))
    sizes = measured(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "sizes")
    targets = []
    for p in ps:
        if kind == "cont":
            at = F.lit(p / 100.0) * (F.col("n") - 1)
            low, high = F.floor(at), F.ceil(at)
        else:
            # smallest value whose share of rows reaches p
            low = high = F.greatest(F.ceil(F.lit(p / 100.0) * F.col("n")) - 1, F.lit(0))
        for side, index in (("low", low), ("high", high)):
            targets.append(F.struct(F.lit(float(p)).alias("p"), F.lit(side).alias("side"), index.cast("long").alias("at")))
    ranks = sizes.select(*keys, "n", F.explode(F.array(*targets)).alias("t")).select(*keys, "n", "t.p", "t.side", "t.at")
    whole = ranks.groupBy(*keys, "n").agg(F.array_sort(F.collect_set("at")).alias("ats")).select(
        *keys, F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
        F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), "ats",
    )
    found = _selected(rows, keys, materialize(whole, "brackets"), ranked_rows)
    picked = join_groups(ranks, found, [*keys, "at"]).groupBy(*keys, "n", "p").agg(
        F.max(F.when(F.col("side") == "low", F.col("value"))).alias("low"),
        F.max(F.when(F.col("side") == "high", F.col("value"))).alias("high"),
    )
    at = F.col("p") / 100.0 * (F.col("n") - 1)
    inner = F.col("low") + (F.col("high") - F.col("low")) * (at - F.floor(at))
    between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(inner)
    return picked.select(*keys, "p", (between if kind == "cont" else F.col("low")).alias("value"))


def _within(rows: DataFrame, keys: Sequence[str], brackets: DataFrame, *columns: str) -> DataFrame:
    """Rows that lie inside a bracket of their key, with the bracket's ``id``.

    Brackets exclude their ends; null means no bound. They have one row per key and wanted
    rank at most, and do not overlap, so rows are not multiplied.
    """
    some = join_groups(rows, brackets.select(*keys, "id", "lo", "hi", *columns), keys)
    above = F.col("lo").isNull() | (F.col("value") > F.col("lo"))
    return some.where(above & (F.col("hi").isNull() | (F.col("value") < F.col("hi"))))


def _selected(rows: DataFrame, keys: Sequence[str], brackets: DataFrame, ranked_rows: int) -> DataFrame:
    """The value at every wanted rank: ``keys, at, value``.

    ``brackets`` are open intervals ``lo, hi`` with the number of rows ``below`` and
    ``inside``, and the ranks ``ats`` that lie in them.
    """
    keys, done = list(keys), []
    brackets = brackets.withColumn("id", F.lit(0))
    while not (wide := brackets.where(F.col("inside") > ranked_rows)).isEmpty():
        digests = _within(rows, keys, wide).groupBy(*keys, "id").agg(
            F.expr(f"kll_sketch_agg_double(value, {KLL_K})").alias("sketch")
        )
        # the digest is asked at evenly spaced ranks; a wanted one lies between two of them,
        # and twice the digest's error is left on either side
        grid = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / _GRID) for i in range(_GRID + 1)]))
        share = lambda r, d: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (r - F.col("below")) / F.col("inside") + d)) * _GRID
        edges = F.flatten(
            F.transform(
                "ats",
                lambda r: F.array(
                    F.get("grid", F.floor(share(r, -2 * RANK_ERROR)).cast("int")),
                    F.get("grid", F.ceil(share(r, 2 * RANK_ERROR)).cast("int")),
                ),
            )
        )
        digests = digests.select(*keys, "id", grid.alias("grid"))
        cuts = F.array_sort(F.array_distinct(edges))
        cut = materialize(join_groups(wide, digests, [*keys, "id"]).withColumn("cuts", cuts).drop("grid"), "cuts")
        # 0: below the first cut, 1: equal to it, 2: between it and the second, and so on
        place = 2 * F.size(F.filter("cuts", lambda c: c < F.col("value"))) + F.array_contains(
            F.col("cuts"), F.col("value")
        ).cast("int")
        counts = (
            _within(rows, keys, cut, "cuts").groupBy(*keys, "id", place.alias("place")).agg(F.count(F.lit(1)).alias("c"))
            .groupBy(*keys, "id").agg(F.map_from_entries(F.collect_list(F.struct("place", "c"))).alias("counts"))
        )
        zero = F.lit(0).cast("long")
        each = F.transform(
            F.sequence(F.lit(0), 2 * F.size("cuts")), lambda i: F.coalesce(F.try_element_at(F.col("counts"), i), zero)
        )
        counted = join_groups(cut, counts, [*keys, "id"]).withColumn("each", each)
        before = F.transform(
            F.sequence(F.lit(0), 2 * F.size("cuts")),
            lambda i: F.aggregate(F.slice("each", F.lit(1), i), zero, lambda a, x: a + x),
        )
        hit = counted.withColumn("before", before).select("*", F.explode("ats").alias("at")).withColumn(
            "j", F.size(F.filter("before", lambda b: b <= F.col("at") - F.col("below"))) - 1
        )
        half = F.expr("j div 2").cast("int")
        hit = materialize(
            hit.select(
                *keys, "at",
                F.when(F.col("j") % 2 == 1, F.get("cuts", half)).alias("value"),
                F.when(F.col("j") >= 2, F.get("cuts", half - 1)).otherwise(F.col("lo")).alias("lo"),
                F.when(half < F.size("cuts"), F.get("cuts", half)).otherwise(F.col("hi")).alias("hi"),
                (F.col("below") + F.get("before", F.col("j"))).alias("below"),
                F.get("each", F.col("j")).alias("inside"),
            ),
            "narrowed",
        )
        done.append(hit.where("value is not null").select(*keys, "at", "value"))
        narrowed = hit.where("value is null").groupBy(*keys, "lo", "hi", "below", "inside").agg(
            F.array_sort(F.collect_set("at")).alias("ats")
        )
        rest = brackets.where(F.col("inside") <= ranked_rows).drop("id").unionByName(narrowed)
        brackets = materialize(rest.withColumn("id", F.monotonically_increasing_id().cast("long")), "brackets")
    many = F.count(F.lit(1)).alias("c")
    if done:
        counted = _within(rows, keys, brackets, "below", "ats").groupBy(*keys, "id", "below", "ats", "value").agg(many)
    else:  # no key was large: values are counted before they meet anything
        whole = brackets.select(*keys, "id", "below", "ats")
        counted = join_groups(rows.groupBy(*keys, "value").agg(many), whole, keys)
    # a bracket holds ``ranked_rows`` rows at most
    upto = F.sum("c").over(Window.partitionBy(*keys, "id").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("upto", F.col("below") + upto)
    here = F.filter("ats", lambda r: (r >= F.col("upto") - F.col("c")) & (r < F.col("upto")))
    out = ranked.select(*keys, F.explode(here).alias("at"), "value")
    for part in done:
        out = out.unionByName(part)
    return out


def within_rank_error(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ps: Sequence[float],
    sketch: DataFrame,
    error: float = RANK_ERROR,
) -> DataFrame:
    """Exact percentile, and whether the digest's answer lies within the rank error."""
    keys = list(keys)
    around = sorted({q for p in ps for q in (p, max(p - 100 * error, 0.0), min(p + 100 * error, 100.0))})
    exact = exact_percentiles(df, keys, value, around, "disc")
    spread = exact.select(*keys, F.col("p").alias("q"), F.col("value").alias("v"))
    bands = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(float(p)).alias("p"),
                    F.lit(float(max(p - 100 * error, 0.0))).alias("q_low"),
                    F.lit(float(min(p + 100 * error, 100.0))).alias("q_high"),
                )
                for p in ps
            ]
        )
    )
    banded = (
        spread.select("*", bands.alias("b"))
        .where(F.col("q").isin(around) & ((F.col("q") == F.col("b.p")) | (F.col("q") == F.col("b.q_low")) | (F.col("q") == F.col("b.q_high"))))
        .groupBy(*keys, F.col("b.p").alias("p"))
        .agg(
            F.max(F.when(F.col("q") == F.col("b.p"), F.col("v"))).alias("exact"),
            F.min("v").alias("v_low"),
            F.max("v").alias("v_high"),
        )
    )
    joined = banded.join(sketch.select(*keys, "p", F.col("value").alias("est")), [*keys, "p"], "full_outer")
    within = F.col("est").between(F.col("v_low"), F.col("v_high"))
    return joined.select(*keys, "p", "exact", F.coalesce(within, F.lit(False)).alias("within_bound"))
