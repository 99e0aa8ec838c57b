import datetime as dt

import pytest
from pyspark.sql import functions as F

from auditloom.functions.buckets import (
    bucket_end, bucket_label, bucket_series, bucket_start, bucket_start_by, expires_at, last_buckets,
)
from auditloom.functions.numbers import percentile_label, percentile_label_col, tidy
from auditloom.operators.requests import check_windows
from auditloom.schema import WINDOW_CODES, window_spec


def label(spark, text, window):
    df = spark.sql(f"select timestamp '{text}' as ts")
    return df.select(bucket_label(bucket_start(F.col("ts"), window), window)).first()[0]


@pytest.mark.parametrize(
    "text, window, expected",
    [
        ("2025-10-16 10:37:45", "1m", "2025-10-16T10:37:00"),
        ("2025-10-16 10:37:45", "5m", "2025-10-16T10:35:00"),
        ("2025-10-16 10:37:45", "15m", "2025-10-16T10:30:00"),
        ("2025-10-16 10:37:45", "1h", "2025-10-16T10:00:00"),
        ("2025-10-16 10:37:45", "1d", "2025-10-16"),
        ("2025-10-16 10:37:45", "1w", "2025-W42"),
        ("2025-10-16 10:37:45", "1M", "2025-10"),
        ("2024-12-30 00:00:00", "1w", "2025-W01"),
        ("2021-01-03 23:59:59", "1w", "2020-W53"),
        ("1969-12-31 23:57:01", "5m", "1969-12-31T23:55:00"),
    ],
)
def test_labels(spark, text, window, expected):
    assert label(spark, text, window) == expected


def test_per_row_window_equals_fixed_window(spark):
    df = spark.sql("select timestamp '2024-02-29 23:59:59.5' as ts").select(
        "ts", F.explode(F.array(*[F.lit(c) for c in (*WINDOW_CODES, "2h")])).alias("w")
    )
    got = {r.w: r.b for r in df.select("w", bucket_start_by(F.col("ts"), F.col("w")).alias("b")).collect()}
    assert got.pop("2h") is None
    for code, start in got.items():
        assert start == df.select(bucket_start(F.col("ts"), code)).first()[0]


def test_months_follow_the_calendar(spark):
    df = spark.sql("select timestamp '2024-03-31 12:00:00' as ts")
    back = df.select(last_buckets(F.col("ts"), "1M", 4)).first()[0]
    assert [b.strftime("%Y-%m") for b in back] == ["2024-03", "2024-02", "2024-01", "2023-12"]
    end = df.select(bucket_end(bucket_start(F.col("ts"), "1M"), "1M")).first()[0]
    assert end == dt.datetime(2024, 4, 1)


def test_series_is_inclusive(spark):
    df = spark.sql("select timestamp '2024-01-01 22:30:00' as a, timestamp '2024-01-02 01:10:00' as b")
    hours = df.select(bucket_series(F.col("a"), F.col("b"), "1h")).first()[0]
    assert [h.hour for h in hours] == [22, 23, 0, 1]


def test_retention(spark):
    assert {c: window_spec(c).retention_s for c in WINDOW_CODES} == {
        "1m": 3600, "5m": 43200, "15m": 86400, "1h": 604800, "1d": 7776000, "1w": 31449600, "1M": 62208000,
    }
    df = spark.sql("select timestamp '2024-01-01 00:00:00' as ts")
    assert df.select(expires_at(F.col("ts"), "1h")).first()[0] == dt.datetime(2024, 1, 8)


def test_unknown_window_lists_the_valid_ones(spark):
    with pytest.raises(ValueError, match="2h.*1m, 5m, 15m, 1h, 1d, 1w, 1M"):
        window_spec("2h")
    rows = check_windows(spark.createDataFrame([("1h",), ("2h",), (None,)], "window string")).collect()
    by = {r.window: r.reject_reason for r in rows}
    assert by["1h"] is None and "Valid options" in by["2h"] and "none" in by[None]


def test_percentile_labels_differ(spark):
    assert [percentile_label(p) for p in (50, 99, 99.9)] == ["p50", "p99", "p999"]
    df = spark.createDataFrame([(50.0,), (99.0,), (99.9,)], "p double")
    assert [r[0] for r in df.select(percentile_label_col(F.col("p"))).collect()] == ["p50", "p99", "p999"]


def test_tidy_rounds_half_away_from_zero(spark):
    df = spark.createDataFrame([(0.125,), (-0.125,), (1.005,), (2.675,)], "v double")
    assert [r[0] for r in df.select(tidy(F.col("v"), 2)).collect()] == [0.13, -0.13, 1.01, 2.68]
