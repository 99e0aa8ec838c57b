"""Calendar buckets: start, end, label, series. All are plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.schema import WINDOWS, window_spec

_TRUNC = {"1m": "minute", "1h": "hour", "1d": "day", "1w": "week", "1M": "month"}


def bucket_start(ts: Column, window: str) -> Column:
    """First instant of the window of length ``window`` that holds ``ts``."""
    spec = window_spec(window)
    if window in _TRUNC:
        return F.date_trunc(_TRUNC[window], ts)
    seconds = F.unix_seconds(ts)
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(spec.duration_s)))


def bucket_start_by(ts: Column, window: Column) -> Column:
    """Like :func:`bucket_start` with the window code in a column; null if unknown."""
    out = F.lit(None).cast("timestamp")
    for spec in WINDOWS:
        out = F.when(window == spec.code, bucket_start(ts, spec.code)).otherwise(out)
    return out


def bucket_end(start: Column, window: str) -> Column:
    """First instant after the bucket. Months follow the calendar, not 30 days."""
    spec = window_spec(window)
    if window == "1M":
        return F.date_trunc("month", F.add_months(start, 1))
    return F.timestamp_seconds(F.unix_seconds(start) + F.lit(spec.duration_s))


def iso_week_label(day: Column) -> Column:
    """ISO year and week, such as ``2020-W53``."""
    year = F.extract(F.lit("YEAROFWEEK"), day).cast("string")
    return F.concat(year, F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def bucket_label(start: Column, window: str) -> Column:
    """Text name of a bucket."""
    window_spec(window)
    if window == "1w":
        return iso_week_label(start)
    if window == "1M":
        return F.date_format(start, "yyyy-MM")
    if window == "1d":
        return F.date_format(start, "yyyy-MM-dd")
    return F.date_format(start, "yyyy-MM-dd'T'HH:mm:00")


def bucket_label_by(start: Column, window: Column) -> Column:
    """Like :func:`bucket_label` with the window code in a column."""
    out = F.lit(None).cast("string")
    for spec in WINDOWS:
        out = F.when(window == spec.code, bucket_label(start, spec.code)).otherwise(out)
    return out


def shift_back(start: Column, window: str, steps: Column) -> Column:
    """The bucket ``steps`` windows before ``start``."""
    spec = window_spec(window)
    if window == "1M":
        return F.date_trunc("month", F.add_months(start, (-steps).cast("int")))
    return F.timestamp_seconds(F.unix_seconds(start) - F.lit(spec.duration_s) * steps)


def last_buckets(end: Column, window: str, count: int) -> Column:
    """Array of the ``count`` bucket starts ending with the one that holds ``end``."""
    start = bucket_start(end, window)
    return F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)), lambda i: shift_back(start, window, i)
    )


def bucket_series(first: Column, last: Column, window: str) -> Column:
    """Array of all bucket starts from the one holding ``first`` to the one holding ``last``."""
    spec = window_spec(window)
    step = F.expr("interval 1 month" if window == "1M" else f"interval {spec.duration_s} seconds")
    return F.sequence(bucket_start(first, window), bucket_start(last, window), step)


def expires_at(last_ts: Column, window: str) -> Column:
    """When a summary last touched at ``last_ts`` runs out."""
    return F.timestamp_seconds(F.unix_seconds(last_ts) + F.lit(window_spec(window).retention_s))
