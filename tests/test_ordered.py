"""Distributed running sums and percentiles, also when one key holds most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.operators import moments
from auditloom.operators.ordered import running_sums
from auditloom.operators.quantiles import exact_percentiles
from auditloom.operators.rollup import exact_rolling_distinct, rolling_distinct
from auditloom.session import input_bytes, partitions_for


@pytest.fixture(scope="module")
def skewed(spark):
    # nine rows in ten belong to one key; many equal values
    df = spark.range(20_000).select(
        "id",
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("small"), F.col("id") % 70)).otherwise("hot").alias("key"),
        F.round(F.pmod(F.xxhash64("id"), F.lit(3000)) / 7, 2).alias("x"),
        F.timestamp_seconds(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5000))).alias("ts"),
    )
    return df.cache()


def test_running_sums_equal_pandas(spark, skewed):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = running_sums(skewed, ["key"], ["ts", "id"], {"n": "1L", "s": "id"}).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = skewed.toPandas().sort_values(["key", "ts", "id"])
    want["n"] = want.groupby("key").cumcount() + 1
    want["s"] = want.groupby("key").id.cumsum()
    both = out.merge(want, on="id", suffixes=("", "_w"))
    assert len(both) == 20_000
    assert (both.n == both.n_w).all() and (both.s == both.s_w).all()
    totals = want.groupby("key").id.sum()
    assert (both.s_total == both.key.map(totals)).all()


def test_a_hot_key_is_cut_into_chunks(spark, skewed):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = skewed.repartitionByRange("key", "ts", "id").withColumn("chunk", F.spark_partition_id())
        chunks = parts.where("key = 'hot'").groupBy("chunk").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(chunks) >= 7 and max(r["count"] for r in chunks) < 20_000 / 4


@pytest.mark.parametrize("kind, method", [("cont", "linear"), ("disc", "inverted_cdf")])
def test_percentiles_equal_numpy(spark, skewed, kind, method):
    ps = [0, 1, 50, 95, 99, 99.9, 100]
    got = exact_percentiles(skewed, ["key"], "x", ps, kind).collect()
    data = skewed.toPandas()
    assert len(got) == data.key.nunique() * len(ps)
    for r in got:
        want = np.percentile(data[data.key == r.key].x, r.p, method=method)
        assert r.value == pytest.approx(want, rel=1e-12), r


def test_percentiles_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("b", None)], "key string, x double")
    got = {(r.key, r.p): r.value for r in exact_percentiles(df, ["key"], "x", [50, 99]).collect()}
    assert got == {("b", 50.0): 1.0, ("b", 99.0): 1.0}
    with pytest.raises(ValueError, match="cont, disc"):
        exact_percentiles(df, ["key"], "x", [50], "middle")


def test_percentile_without_keys(spark, skewed):
    got = exact_percentiles(skewed, [], "x", [25], "cont").first().value
    assert got == pytest.approx(np.percentile(skewed.toPandas().x, 25))


def test_running_moments_equal_prefixes(spark, skewed):
    run = moments.running(skewed.select("key", "ts", "id", "x"), ["key"], ["ts", "id"], "x").toPandas()
    data = skewed.toPandas().sort_values(["ts", "id"])
    hot = data[data.key == "hot"].x.to_numpy()
    mine = run[run.key == "hot"].sort_values("n")
    for n in (1, 2, 3, 10, 1000, len(hot)):
        row, x = mine.iloc[n - 1], hot[:n]
        assert row["n"] == n
        assert row["mean"] == pytest.approx(x.mean())
        assert row["var_pop"] == pytest.approx(x.var() if n > 1 else 0.0)
        if n >= 4:
            z = (x - x.mean()) / x.std()
            assert row["skewness"] == pytest.approx((z**3).mean(), abs=1e-9)
            assert row["kurtosis"] == pytest.approx((z**4).mean() - 3, abs=1e-9)


def test_rolling_distinct_equals_brute_force(spark):
    rows = [("m", "s", h, f"v{(h * h + i) % 17}") for h in (0, 1, 2, 5, 9, 10, 30, 31, 60) for i in range(h % 5 + 1)]
    df = spark.createDataFrame(rows, "metric string, system string, h int, value string").select(
        "metric", "system", F.timestamp_seconds(F.col("h") * 3600).alias("bucket_start"), "value"
    )
    got = {int(r.bucket_start.timestamp()) // 3600: r.exact for r in exact_rolling_distinct(df, "1h", 6).collect()}
    hours = {h for _, _, h, _ in rows}
    assert got == {h: len({v for _, _, g, v in rows if h - 5 <= g <= h}) for h in hours}


def test_partitions_follow_the_input(spark, tmp_path):
    spark.range(100_000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    size = input_bytes(df)
    assert size > 100_000
    assert partitions_for(df, size // 20) >= 20
    assert partitions_for(df) == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("kind, method", [("cont", "linear"), ("disc", "inverted_cdf")])
def test_selection_gives_the_same_percentiles(spark, skewed, kind, method):
    """Brackets instead of whole keys: values that repeat, infinities and a key of one value."""
    more = spark.createDataFrame(
        [("flat", 5.0)] * 300 + [("edge", float("inf"))] * 40 + [("edge", float("-inf"))] * 60 + [("edge", float(i)) for i in range(100)],
        "key string, x double",
    )
    rows = skewed.select("key", "x").unionByName(more).unionByName(spark.range(500).selectExpr("null as key", "id / 3.0D as x"))
    ps = [0, 0.1, 30, 50, 95, 99.9, 100]
    few = exact_percentiles(rows, ["key"], "x", ps, kind, ranked_rows=20).collect()
    data = rows.toPandas()
    assert len(few) == data.key.nunique(dropna=False) * len(ps)
    for r in few:
        own = data[data.key.isna()] if r.key is None else data[data.key == r.key]
        with np.errstate(invalid="ignore"):
            want = np.percentile(np.sort(own.x), r.p, method=method)
        if np.isfinite(want):
            assert r.value == pytest.approx(want, rel=1e-12), r
        elif kind == "disc":
            assert r.value == want, r


def test_percentiles_copy_nothing(spark, skewed):
    plan = exact_percentiles(skewed, ["key"], "x", [50, 99])._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" not in plan and "rangepartitioning" not in plan
    assert "ordered-" not in plan


def test_running_sums_over_null_keys_and_many_batches(spark):
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), "id", (F.col("id") % 7 / 10).alias("x"),
        F.when(F.col("id") % 5 > 0, F.col("id")).alias("some"),
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = {r.id: r for r in running_sums(df, ["k"], ["id"], {"n": "1", "s": "x", "t": "some"}).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for r in sorted(df.collect(), key=lambda r: r.id):
        n, s, t = want.get(r.k, (0, 0.0, 0))
        want[r.k] = n, s, t = n + 1, s + r.x, t + (r.some or 0)
        assert (got[r.id].n, got[r.id].t) == (n, t) and got[r.id].s == pytest.approx(s)
    assert all(got[i].n_total == 2000 and got[i].t_total == want[got[i].k][2] for i in got)
    none = running_sums(df.where("false"), ["k"], ["id"], {"n": "1"})
    assert none.count() == 0
    alone = running_sums(df, [], ["id"], {"n": "1"}).agg(F.max("n"), F.min("n_total")).first()
    assert tuple(alone) == (6000, 6000)


@pytest.mark.parametrize("n", [1, 2, 6, 24])
def test_rolling_sketches_equal_exact_counts(spark, n):
    """Small sketches count exactly; buckets are missing, and several chunks wide."""
    rows = [("m", f"s{g % 2}", h, f"v{(h * h + i + g) % 23}") for g in range(2) for h in (0, 1, 2, 5, 6, 9, 10, 23, 24, 30, 31, 60, 61, 62) for i in range(h % 5 + 1)]
    df = spark.createDataFrame(rows, "metric string, system string, h int, value string").select(
        "metric", "system", F.timestamp_seconds(F.col("h") * 3600).alias("bucket_start"), "value"
    )
    sketches = df.groupBy("metric", "system", "bucket_start").agg(F.hll_sketch_agg("value", 14).alias("sketch"))
    key = ["metric", "system", "bucket_start"]
    got = {tuple(r[k] for k in key): r.estimate for r in rolling_distinct(sketches, "1h", n).collect()}
    want = {tuple(r[k] for k in key): r.exact for r in exact_rolling_distinct(df, "1h", n).collect()}
    assert got == want


def test_rolling_sketches_over_months_and_weeks(spark):
    df = spark.range(40).select(
        F.lit("m").alias("metric"), F.lit("s").alias("system"), F.col("id").cast("string").alias("value"),
        F.expr("add_months(date'2023-11-01', cast(id as int))").cast("timestamp").alias("month"),
        F.expr("timestamp'2023-12-04 00:00:00' + make_dt_interval(cast(7 * id as int))").alias("week"),
    )
    for column, window in (("month", "1M"), ("week", "1w")):
        sketches = df.groupBy("metric", "system", F.col(column).alias("bucket_start")).agg(F.hll_sketch_agg("value", 14).alias("sketch"))
        got = [r.estimate for r in rolling_distinct(sketches, window, 5).orderBy("bucket_start").collect()]
        assert got == [min(i + 1, 5) for i in range(40)]


def test_a_long_history_is_many_tasks(spark):
    """A month of minutes of one key: as many window groups as there are chunks."""
    minutes = spark.range(30 * 1440).select(
        F.lit("m").alias("metric"), F.lit("s").alias("system"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 60).alias("bucket_start"),
        F.concat(F.lit("u"), F.col("id") % 90).alias("value"),
    )
    sketches = minutes.groupBy("metric", "system", "bucket_start").agg(F.hll_sketch_agg("value", 14).alias("sketch")).cache()
    got = rolling_distinct(sketches, "1m", 60).groupBy("estimate").count().collect()
    assert {r.estimate: r["count"] for r in got} == {**{i: 1 for i in range(1, 60)}, 60: 30 * 1440 - 59}
