"""Known scenarios with known answers."""

import pytest
from pyspark.sql import functions as F

from auditloom.operators import bloom, heavy, members, moments, plain
from auditloom.operators.distinct import estimate, merge_hll
from auditloom.operators.mergeable import hll
from auditloom.session import materialize


def ids(spark, low, high, prefix="user_"):
    df = spark.range(low, high).select(F.concat(F.lit(prefix), F.col("id")).alias("value"))
    return df.withColumn("ts", F.timestamp_seconds(F.lit(0)))


def hours(spark, step, count, mod):
    return (
        spark.range(24).select(F.col("id").alias("hour"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i"))
        .select("hour", ((F.col("hour") * step + F.col("i")) % mod).alias("id"), "i")
        .select("hour", "i", F.concat(F.lit("user_"), F.col("id")).alias("value"), F.timestamp_seconds("hour").alias("ts"))
    )


def counted(df, keys=()):
    return estimate(hll().partial(df, list(keys)), list(keys)).first().estimate


def merged(*parts):
    states = [hll().partial(p, []) for p in parts]
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return estimate(merge_hll(out, []), []).first().estimate


def test_distinct_counts(spark):
    assert 980 <= counted(ids(spark, 0, 1000)) <= 1020
    assert counted(ids(spark, 0, 100).withColumn("value", F.lit("same"))) == 1
    assert 980 <= merged(ids(spark, 0, 500), ids(spark, 500, 1000)) <= 1020
    assert 1470 <= merged(ids(spark, 0, 1000), ids(spark, 500, 1500)) <= 1530
    assert 98_000 <= counted(ids(spark, 0, 100_000)) <= 102_000
    assert counted(ids(spark, 0, 10)) == 10
    assert counted(ids(spark, 0, 0)) == 0
    assert 196 <= merged(ids(spark, 0, 100), ids(spark, 100, 200)) <= 204
    assert 196 <= merged(ids(spark, 0, 150), ids(spark, 50, 200)) <= 204


def test_sketches_survive_storage(spark):
    state = hll().partial(ids(spark, 0, 1000), [])
    again = materialize(state, "state")
    assert estimate(again, []).first() == estimate(state, []).first()


def test_hours_make_a_day(spark):
    day = merge_hll(hll().partial(hours(spark, 50, 100, 500), ["hour"]), [])
    assert 490 <= estimate(day, []).first().estimate <= 510
    exact = hours(spark, 40, 100, 500)
    assert {r.n for r in exact.groupBy("hour").agg(F.count_distinct("value").alias("n")).collect()} == {100}
    assert exact.select("value").distinct().count() == 500


def test_systems(spark):
    ranges = {"prod": (0, 1000), "staging": (400, 900), "api": (200, 1000)}
    rows = None
    for system, (low, high) in ranges.items():
        part = ids(spark, low, high).withColumn("system", F.lit(system))
        rows = part if rows is None else rows.unionByName(part)
    assert members.in_any(rows, []).count() == 1000
    assert members.in_all(rows, "system").count() == 500
    size = bloom.shape(2000, 0.001)
    both = bloom.intersection(bloom.build(rows, ["system"], "value", size), [], 3)
    assert bloom.contains(members.in_all(rows, "system"), both, [], "value", size).where("not accessed").count() == 0


def test_activity_over_a_day(spark):
    size = bloom.shape(1000, 0.001)
    filters = bloom.union(bloom.build(hours(spark, 20, 50, 10_000), ["hour"], "value", size), [])
    asked = spark.createDataFrame([("user_50",), ("user_500",), ("user_1000",)], "value string")
    got = {r.value: r.accessed for r in bloom.contains(asked, filters, [], "value", size).collect()}
    assert got == {"user_50": True, "user_500": True, "user_1000": False}


def test_filter_unions(spark):
    size = bloom.shape(1000, 0.001)
    for left, right in ((("1", "2"), ("3", "4")), (("1", "2"), ("2", "3"))):
        rows = spark.createDataFrame([("a", v) for v in left] + [("b", v) for v in right], "part string, value string")
        union = bloom.union(bloom.build(rows, ["part"], "value", size), [])
        found = bloom.contains(rows.select("value").distinct(), union, [], "value", size)
        assert found.where("not accessed").count() == 0


def test_weighted_top_k(spark):
    def lists(*rows):
        return spark.createDataFrame(list(rows), "part int, item string, cnt long")

    merged_ = heavy.merge_counts(lists((0, "u1", 100), (0, "u2", 50), (1, "u3", 75), (1, "u4", 25)), [])
    assert [(r["item"], r["cnt"]) for r in heavy.top_k(merged_, [], 10).orderBy("rank").collect()] == [
        ("u1", 100), ("u3", 75), ("u2", 50), ("u4", 25),
    ]
    again = heavy.merge_counts(lists((0, "u1", 100), (0, "u2", 50), (1, "u1", 50), (1, "u3", 75)), [])
    assert again.where("item = 'u1'").first()["cnt"] == 150

    hourly = hours(spark, 5, 20, 10_000).select("hour", (F.regexp_extract("value", "[0-9]+", 0).cast("int")).alias("id"))
    weighted = hourly.select("hour", F.concat(F.lit("e"), F.col("id") % 100).alias("item"), (F.col("id") % 50).cast("long").alias("cnt"))
    want = {}
    for h in range(24):
        for i in range(h * 5, h * 5 + 20):
            want[f"e{i % 100}"] = want.get(f"e{i % 100}", 0) + i % 50
    best = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:10]
    got = heavy.top_k(heavy.merge_counts(heavy.merge_counts(weighted, ["hour"]), []), [], 10)
    assert [(r["item"], r["cnt"]) for r in got.orderBy("rank").collect()] == best


def stats(df, value="x"):
    return moments.present(moments.partial(df, [], value), []).first()


def test_moments(spark):
    one = spark.createDataFrame([(float(i),) for i in range(1, 6)], "x double")
    s = stats(one)
    assert (s.n, s.mean, s.var_pop, s.var_samp) == (5, 3.0, 2.0, 2.5)
    assert s.stddev_samp == pytest.approx(1.58, abs=0.01) and s.stddev_pop == pytest.approx(1.414, abs=0.001)
    two = spark.createDataFrame([(float(i),) for i in range(6, 11)], "x double")
    both = moments.merge(moments.partial(one, [], "x").unionByName(moments.partial(two, [], "x")), []).first()
    assert (both.n, both.m1) == (10, 5.5)
    rows = [(h, float(100 + 5 * h + i)) for h in range(24) for i in range(100)]
    day = moments.merge(moments.partial(spark.createDataFrame(rows, "h int, x double"), ["h"], "x"), []).first()
    assert day.n == 2400 and day.m1 == pytest.approx(207.0)


@pytest.mark.parametrize("data", [[], [4.0], [4.0, 4.0, 4.0, 4.0], [1.0, 2.0]])
def test_moments_guards(spark, data):
    df = spark.createDataFrame([(x,) for x in data], "x double")
    s = stats(df)
    assert s.n == len(data)
    assert s.skewness == 0.0 and s.kurtosis == 0.0
    assert s.var_pop == (0.25 if data == [1.0, 2.0] else 0.0)


def test_plain_monoids(spark):
    x = F.col("x")
    df = spark.createDataFrame([(1, "a"), (5, "b"), (3, "c"), (9, "d"), (2, "e")], "x int, t string")
    row = df.agg(plain.total(x), plain.product(x), plain.largest(x), plain.smallest(x), plain.joined_text(F.col("t"), x)).first()
    assert tuple(row) == (20, 270.0, 9.0, 1.0, "aecbd")
    none = df.where("false").agg(plain.total(x), plain.product(x), plain.largest(x), plain.smallest(x), F.sum("x")).first()
    assert tuple(none) == (0, 1.0, float("-inf"), float("inf"), None)
    maps = spark.createDataFrame([("k", {"a": 1, "b": 2}), ("k", {"b": 3}), ("l", {"c": 1})], "key string, m map<string,int>")
    merged_ = {r.key: r.m for r in plain.merge_maps(maps, ["key"], "m").collect()}
    assert merged_ == {"k": {"a": 1, "b": 5}, "l": {"c": 1}}


def test_time_and_systems(spark):
    bases = {"prod": 0, "staging": 500, "api": 800}
    rows = None
    for system, base in bases.items():
        part = spark.range(24).select(
            F.lit(system).alias("system"), F.col("id").alias("hour"),
            F.explode(F.sequence(F.lit(0), F.lit(199))).alias("i"),
        ).withColumn("value", F.concat(F.lit("u"), (F.col("i") + base) % 1000)).withColumn("ts", F.timestamp_seconds("hour"))
        rows = part if rows is None else rows.unionByName(part)
    states = hll().partial(rows, ["system", "hour"])
    cube = hll().cube(states, [[], ["system"], ["hour"]]).select("system", "hour", F.hll_sketch_estimate("sketch").alias("n"))
    got = {(r.system, r.hour): r.n for r in cube.collect()}
    assert got[(None, None)] == pytest.approx(600, rel=0.01)
    assert all(got[(s, None)] == 200 for s in bases)
    assert all(got[(None, h)] == pytest.approx(600, rel=0.01) for h in range(24))
