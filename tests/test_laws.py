"""Algebra of the mergeable aggregates: any split merges to the whole, in any order."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.operators import bloom, countmin, heavy, moments, rollup
from auditloom.operators.distinct import checked, estimate, merge_hll
from auditloom.operators.mergeable import ExprAgg, PythonAgg, hll, kll, relative_error, theta
from auditloom.operators.quantiles import percentiles

N = 5000


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(7)
    rows = [
        (i, f"k{i % 3}", f"v{rng.randrange(900)}", rng.expovariate(0.02), rng.randrange(1, 9)) for i in range(N)
    ]
    df = spark.createDataFrame(rows, "id long, key string, value string, latency_ms double, w int")
    return df.withColumn("ts", F.timestamp_seconds("id")).cache()


def split(df, parts, seed):
    return df.withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts)))


@pytest.mark.parametrize("parts, seed", [(1, 1), (2, 2), (7, 3), (40, 4)])
def test_any_split_merges_to_the_whole(spark, values, parts, seed):
    shared = split(values, parts, seed)
    true = {r.key: r.n for r in values.groupBy("key").agg(F.count_distinct("value").alias("n")).collect()}
    merged = merge_hll(hll().partial(shared, ["key", "part"]), ["key"])
    for r in estimate(merged, ["key"]).collect():
        assert abs(r.estimate - true[r.key]) <= 0.02 * true[r.key]

    states = theta().merge(theta().partial(shared, ["key", "part"]), ["key"])
    for r in theta().present(states, ["key"]).collect():
        assert abs(r.estimate - true[r.key]) <= 0.02 * true[r.key]

    whole = {r.key: r for r in moments.present(moments.partial(values, ["key"], "latency_ms"), ["key"]).collect()}
    parts_ = moments.merge(moments.partial(shared, ["key", "part"], "latency_ms"), ["key"])
    for r in moments.present(parts_, ["key"]).collect():
        for c in ("n", "mean", "var_pop", "var_samp", "skewness", "kurtosis", "lo", "hi"):
            assert r[c] == pytest.approx(whole[r.key][c], rel=1e-9)

    items = values.select("key", F.col("value").alias("item"), F.col("w").alias("cnt"), "id")
    full = heavy.merge_counts(items, ["key"])
    part_counts = heavy.merge_counts(split(items, parts, seed), ["key", "part"])
    again = heavy.merge_counts(part_counts, ["key"])
    assert full.exceptAll(again).count() == 0 and again.exceptAll(full).count() == 0

    cells = countmin.build(full, ["key"])
    cells_again = countmin.merge(countmin.build(part_counts, ["key", "part"]), ["key"]).select(*cells.columns)
    assert cells.exceptAll(cells_again).count() == 0

    size = bloom.shape(2000, 0.01)
    direct = bloom.build(values, ["key"], "value", size)
    union = bloom.union(bloom.build(shared, ["key", "part"], "value", size), ["key"]).select(*direct.columns)
    assert direct.exceptAll(union).count() == 0 and union.exceptAll(direct).count() == 0


def test_quantile_digests_merge_within_their_error(spark, values):
    shared = split(values, 9, 5)
    merged = kll().merge(kll().partial(shared, ["key", "part"]), ["key"])
    data = values.toPandas()
    for r in percentiles(merged, ["key"], [50, 95, 99]).collect():
        x = np.sort(data[data.key == r.key].latency_ms.to_numpy())
        rank = np.searchsorted(x, r.value, side="right") / len(x)
        assert abs(rank - r.p / 100) < 0.02


def test_zero_is_neutral(spark, values):
    none = values.where("id < 0")
    zero = none.agg(F.expr("hll_sketch_agg(value, 14)").alias("sketch"), F.lit(0).cast("long").alias("n"), F.max("ts").alias("last_ts"))
    assert estimate(zero, []).first().estimate == 0
    whole = hll().partial(values, [])
    both = merge_hll(whole.unionByName(zero), [])
    assert estimate(both, []).first().estimate == estimate(whole, []).first().estimate
    nothing = moments.partial(values, [], "latency_ms").withColumn("n", F.lit(0).cast("long"))
    state = moments.partial(values, [], "latency_ms")
    merged = moments.merge(state.unionByName(nothing), []).first()
    assert merged.n == N and merged.m1 == pytest.approx(state.first().m1)


def test_unlike_sketches_do_not_merge(spark, values):
    small, big = hll(lg_k=10).partial(values, []), hll(lg_k=14).partial(values, [])
    with pytest.raises(Exception, match="HLL_UNION_DIFFERENT_LG_K"):
        merge_hll(small.unionByName(big), []).collect()
    a = bloom.build(values, ["key"], "value", bloom.shape(1000, 0.01))
    b = bloom.build(values, ["key"], "value", bloom.shape(2000, 0.01))
    with pytest.raises(Exception, match="do not merge"):
        bloom.union(a.unionByName(b), ["key"]).collect()
    c = countmin.build(values.select("key", F.col("value").alias("item"), F.lit(1).alias("cnt")), ["key"], width=500)
    d = countmin.build(values.select("key", F.col("value").alias("item"), F.lit(1).alias("cnt")), ["key"])
    with pytest.raises(Exception, match="do not merge"):
        countmin.merge(c.unionByName(d), ["key"]).collect()


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    size = bloom.shape(3000, 0.01)
    members = spark.range(3000).select(F.lit("k").alias("key"), F.concat(F.lit("in"), "id").alias("value"))
    others = spark.range(20000).select(F.lit("k").alias("key"), F.concat(F.lit("out"), "id").alias("value"))
    for hash in ("xxhash64", "md5"):
        filters = bloom.build(members, ["key"], "value", size, hash)
        assert bloom.contains(members, filters, ["key"], "value", size, hash).where("not accessed").count() == 0
        wrong = bloom.contains(others, filters, ["key"], "value", size, hash).where("accessed").count()
        assert wrong / 20000 < 0.02
        stats = bloom.stats(filters, ["key"]).first()
        assert abs(stats["items"] - 3000) < 150 and 0.003 < stats["error_rate"] < 0.02
        assert stats["error_rate"] == pytest.approx(wrong / 20000, abs=0.004)
    nobody = others.withColumn("key", F.lit("absent"))
    filters = bloom.build(members, ["key"], "value", size)
    assert bloom.contains(nobody, filters, ["key"], "value", size).where("accessed").count() == 0


def test_bloom_size_of_the_default_filter():
    size = bloom.shape(1_000_000, 0.001)
    assert (size.bits, size.hashes) == (14_377_587, 9)
    # what the blocks cost: some more bits
    assert 1.0 < size.blocks * size.hashes * 64 / size.bits < 1.25


@pytest.mark.parametrize("rate", [0.1, 0.01, 0.001, 1e-5])
def test_blocks_hold_the_error_rate(rate):
    size = bloom.shape(100_000, rate)
    assert bloom._expected_error(size.capacity / size.blocks, size.hashes) <= rate
    assert bloom._expected_error(size.capacity / size.blocks * 1.02, size.hashes) > rate * 0.99


def test_bloom_intersection_drops_missing_blocks(spark):
    size = bloom.shape(500, 0.001)
    rows = [(s, f"u{i}") for s, lo, hi in (("a", 0, 60), ("b", 40, 90), ("c", 50, 120)) for i in range(lo, hi)]
    filters = bloom.build(spark.createDataFrame(rows, "system string, value string"), ["system"], "value", size)
    both = bloom.intersection(filters, [], 3)
    asked = spark.createDataFrame([(f"u{i}",) for i in range(120)], "value string")
    found = {r.value for r in bloom.contains(asked, both, [], "value", size).where("accessed").collect()}
    assert {f"u{i}" for i in range(50, 60)} <= found and len(found) <= 12


def test_count_min_never_below(spark, values):
    counts = heavy.merge_counts(values.select("key", F.col("value").alias("item"), F.col("w").alias("cnt")), ["key"])
    cells = countmin.build(counts, ["key"], width=200)
    got = countmin.query(counts, cells, ["key"], width=200).join(counts, ["key", "item"])
    assert got.where("est < cnt").count() == 0
    assert got.count() == counts.count()
    absent = spark.createDataFrame([("nokey", "x")], "key string, item string")
    assert countmin.query(absent, cells, ["key"]).first().est == 0


def test_top_k_breaks_ties_by_item(spark):
    rows = [("k", "b", 5), ("k", "a", 5), ("k", "c", 7), ("k", "d", 1)]
    top = heavy.top_k(spark.createDataFrame(rows, "key string, item string, cnt long"), ["key"], 3)
    assert [(r["item"], r["rank"]) for r in top.orderBy("rank").collect()] == [("c", 1), ("a", 2), ("b", 3)]


@pytest.mark.parametrize("k", [10, 5000])
def test_top_k_is_cut_before_the_shuffle(spark, k):
    counts = spark.range(100_000).select(
        (F.col("id") % 2).alias("key"), F.col("id").cast("string").alias("item"), F.col("id").alias("cnt")
    )
    plan = heavy.top_k(counts, ["key"], k)._jdf.queryExecution().executedPlan().toString()
    before, _, after = plan.partition("Exchange")
    assert "WindowGroupLimit" in after and "Partial" in after


def test_own_aggregate_rolls_up(spark, values):
    agg = ExprAgg((("m", "max(w)"), ("s", "sum(w)")), (("m", "max(m)"), ("s", "sum(s)")), (("x", "m * s"),))
    parts = agg.partial(split(values, 5, 9), ["key", "part"])
    cube = agg.cube(parts, [[], ["key"]])
    rows = {r["key"]: r["s"] for r in cube.collect()}
    assert rows[None] == sum(v for k, v in rows.items() if k)


def test_python_merge_sees_one_state_per_task(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("key"), F.col("id").alias("low"), F.col("id").alias("high"))
    agg = PythonAgg(lambda a, b: {**a, "low": min(a["low"], b["low"]), "high": max(a["high"], b["high"])})
    rows = {r.key: (r.low, r.high) for r in agg.merge(df.repartition(6), ["key"]).collect()}
    assert rows == {0: (0, 998), 1: (1, 999)}


def test_last_n_and_empty_lists(spark):
    rows = [("m", s, f"2024-01-0{d} 00:00:00") for s, ds in (("a", (1, 2, 5)), ("b", (1, 4))) for d in ds]
    df = spark.createDataFrame(rows, "metric string, system string, t string").select(
        "metric", "system", F.to_timestamp("t").alias("bucket_start")
    )
    keys = ["metric", "system"]
    assert rollup.last_existing(df, keys, 2).count() == 4
    assert rollup.last_existing(df, keys, 0).count() == 0
    end = F.to_timestamp(F.lit("2024-01-05 10:00:00"))
    assert rollup.last_calendar(df, "1d", end, 2).count() == 2
    assert rollup.of_buckets(df, df.where("false")).count() == 0
    assert rollup.of_systems(df, ["a", "nobody"]).count() == 3


def test_error_constant():
    assert relative_error(14) == pytest.approx(0.008125)
    assert math.isclose(relative_error(12), 0.01625)


def test_checked_tells_a_wrong_estimate(spark):
    a = spark.createDataFrame([("x", 100), ("y", 200)], "k string, estimate long")
    b = spark.createDataFrame([("x", 101), ("y", 300), ("z", 1)], "k string, exact long")
    got = {r.k: r.within_bound for r in checked(a, b, ["k"], 0.04).collect()}
    assert got == {"x": True, "y": False, "z": False}


def test_null_is_a_group_and_names_do_not_clash(spark):
    from auditloom.operators import countmin
    from auditloom.operators.heavy import count_of
    from auditloom.operators.quantiles import exact_percentiles
    from auditloom.operators.rollup import last_existing

    rows = spark.range(40).select(
        F.when(F.col("id") % 2 == 0, F.lit("a")).alias("k"), F.col("id").cast("double").alias("x"), "id"
    )
    states = moments.partial(rows, ["k"], "x")
    merged = {r.k: (r.n, r.m1) for r in moments.merge(states, ["k"]).collect()}
    assert merged == {"a": (20, 19.0), None: (20, 20.0)}
    assert moments.running(rows, ["k"], ["id"], "x").count() == 40
    got = {r.k: r.value for r in exact_percentiles(rows, ["k"], "x", [50]).collect()}
    assert got == {"a": 19.0, None: 20.0}
    items = rows.select("k", F.lit("i").alias("item"), F.lit(1).cast("long").alias("cnt"))
    counts = items.groupBy("k", "item").agg(F.sum("cnt").alias("cnt"))
    asked = items.select("k", "item").distinct()
    assert {(r.k, r.cnt) for r in count_of(counts, asked, ["k"]).collect()} == {("a", 20), (None, 20)}
    cells = countmin.build(items, ["k"], "item")
    assert {(r.k, r.est) for r in countmin.query(asked, cells, ["k"]).collect()} == {("a", 20), (None, 20)}
    buckets = rows.select("k", F.timestamp_seconds("id").alias("bucket_start"))
    assert last_existing(buckets, ["k"], 3).groupBy("k").count().count() == 2


def test_digest_tails_with_many_more_values_than_slots(spark):
    from auditloom.operators.mergeable import kll
    from auditloom.operators.quantiles import KLL_K, RANK_ERROR

    rows = spark.range(0, 400_000, 1, 8).select(
        F.lit("a").alias("k"), F.exp(F.randn(7) * 2).alias("x"), F.spark_partition_id().alias("part"),
        F.lit(0).cast("timestamp").alias("ts"),
    ).cache()
    parts = kll("x", KLL_K).partial(rows, ["k", "part"])
    merged = kll(k=KLL_K).merge(parts, ["k"])
    assert RANK_ERROR < 0.001
    for row in percentiles(merged, ["k"], [50, 90, 95, 99, 99.9]).collect():
        rank = rows.where(F.col("x") <= row.value).count() / 400_000
        assert abs(rank - row.p / 100) < RANK_ERROR


def test_python_aggregates_keep_whole_numbers_and_spread_a_hot_key(spark):
    """Longs beyond 2^53 stay exact; one key that is in a hundred tasks meets in several first."""
    big = 2**60 + 1
    rows = spark.range(5000, numPartitions=100).select(
        F.when(F.col("id") % 50 == 0, F.concat(F.lit("k"), F.col("id") % 7)).when(F.col("id") % 50 > 1, "hot").alias("k"),
        (F.lit(big) + F.col("id")).alias("most"), F.lit(1).cast("long").alias("n"),
        F.timestamp_seconds("id").alias("at"), F.array(F.col("id")).alias("some"),
    )
    plus = lambda a, b: {
        "most": max(a["most"], b["most"]), "n": a["n"] + b["n"], "at": min(a["at"], b["at"]),
        "some": sorted({*a["some"], *b["some"]})[:3],
    }
    agg = PythonAgg(plus, fan=8)
    got = {r.k: r for r in agg.merge(rows, ["k"]).collect()}
    want = rows.groupBy("k").agg(F.max("most").alias("most"), F.sum("n").alias("n"), F.min("at").alias("at")).collect()
    assert {r.k: (r.most, r.n, r["at"]) for r in got.values()} == {r.k: (r.most, r.n, r["at"]) for r in want}
    assert got["hot"].some == [2, 3, 4] and got["hot"].most == big + 4999 and None in got
    assert agg.merge(rows.where("false"), ["k"]).count() == 0
    assert [r.n for r in agg.merge(rows, []).collect()] == [5000]
