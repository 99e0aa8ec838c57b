"""State per key with a lifetime: moments that are merged, kept and forgotten.

Every key is spread over some salts, as its moments can be merged, so a key with most of
the events is kept by several tasks. A batch's rows of a key are summed up first and then
merged into the state, which is seven numbers whatever has gone before. A timer of event
time forgets a key from which nothing has come for a while.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from auditloom.operators import moments
from auditloom.sources.log import Files

SALTS = 8
_STATE = "n long, m1 double, m2 double, m3 double, m4 double, lo double, hi double, last_ms long"
#: Batches after which the newest states are written out as a whole.
_EVERY = 10


def merged(a: Sequence[Any], b: Sequence[Any]) -> tuple:
    """One state from two: count, mean, central sums, range and newest event."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return tuple(b if not a[0] else a)
    d = b[1] - a[1]
    m2 = a[2] + b[2] + d * d * a[0] * b[0] / n
    m3 = a[3] + b[3] + d**3 * a[0] * b[0] * (a[0] - b[0]) / n**2 + 3 * d * (a[0] * b[2] - b[0] * a[2]) / n
    m4 = (
        a[4] + b[4] + d**4 * a[0] * b[0] * (a[0] ** 2 - a[0] * b[0] + b[0] ** 2) / n**3
        + 6 * d * d * (a[0] ** 2 * b[2] + b[0] ** 2 * a[2]) / n**2 + 4 * d * (a[0] * b[3] - b[0] * a[3]) / n
    )
    return n, a[1] + d * b[0] / n, m2, m3, m4, min(a[5], b[5]), max(a[6], b[6]), max(a[7], b[7])


def summed(x: np.ndarray, last_ms: int) -> tuple:
    """State of some values."""
    mean = float(x.mean())
    d = x - mean
    return (
        len(x), mean, float((d**2).sum()), float((d**3).sum()), float((d**4).sum()),
        float(x.min()), float(x.max()), last_ms,
    )


class _Moments(StatefulProcessor):
    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("moments", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else (0,)
        before = state
        for some in rows:
            if len(some):
                last = some["ts"].max().value // 1_000_000  # nanoseconds, in UTC
                state = merged(state, summed(some["value"].to_numpy(float), last))
        if state is before:
            return
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(state[7] + self.keep_ms)
        self.state.update(state)
        yield self._row(key, state, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else None
        if state is not None:
            self.state.clear()
            yield self._row(key, state, True)

    def _row(self, key: Any, state: tuple, gone: bool) -> pd.DataFrame:
        names = [f.split(" ")[0] for f in _STATE.split(", ")]
        return pd.DataFrame([dict(zip(("key", "salt"), key, strict=True)) | dict(zip(names, state, strict=True)) | {"gone": gone}])

    def close(self) -> None:
        pass


def moments_states(events: DataFrame, key: str, value: str, keep: str, salts: int = SALTS) -> DataFrame:
    """Stream of the newest moments per key and salt; ``gone`` tells that they were forgotten.

    ``events`` needs a watermark on ``ts``. Null is a key; null values do not count.
    """
    spark = events.sparkSession
    keep_ms = spark.sql(f"select cast(interval {keep} as interval day to second) as i").first()[0]
    salt = F.pmod(F.xxhash64("ts", value), F.lit(salts)).cast("int")
    rows = events.where(F.col(value).isNotNull()).select(
        F.col(key).alias("key"), salt.alias("salt"), "ts", F.col(value).cast("double").alias("value")
    )
    kind = dict(events.dtypes)[key]
    return (
        rows.groupBy("key", "salt")
        .transformWithStateInPandas(
            statefulProcessor=_Moments(int(keep_ms.total_seconds() * 1000)),
            outputStructType=f"key {kind}, salt int, {_STATE}, gone boolean",
            outputMode="Update",
            timeMode="EventTime",
        )
        .withColumnRenamed("key", key)
    )


def presented(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Readable statistics per key from the states of its salts."""
    return moments.present(moments.merge(states, keys), keys)


class NewestStates:
    """The newest row per key of a stream in update mode, as a table that stays small.

    A batch is a folder; every now and then the newest rows of all batches are written as
    one folder, and what it holds is deleted. A batch that is run again writes its folder
    again, so a failure at any point changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> None:
        self.spark, self.path, self.keys = spark, path, list(keys)
        self.schema = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])

    def _folders(self, kind: str) -> dict[int, str]:
        """Folders that were written to the end, by batch."""
        done = Files(self.spark, self.path).glob(f"{self.path}/{kind}-*/_SUCCESS")
        return {int(n.split("/")[-2].split("-")[1]): n.rpartition("/")[0] for n in done}

    def add(self, rows: DataFrame, batch: int) -> None:
        """One batch of a stream."""
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.path}/batch-{batch}")
        if batch % _EVERY == _EVERY - 1:
            self.read().write.mode("overwrite").parquet(f"{self.path}/whole-{batch}")
            wholes = sorted(self._folders("whole"))
            files = Files(self.spark, self.path)
            # a reader may still be at the state before this one
            for number, name in [*self._folders("batch").items(), *self._folders("whole").items()]:
                if len(wholes) > 1 and number < wholes[-2]:
                    files.delete(name)

    def read(self) -> DataFrame:
        """The newest row per key, without the keys that were forgotten."""
        wholes, batches = self._folders("whole"), self._folders("batch")
        base = max(wholes, default=-1)
        paths = [wholes[base]] if wholes else []
        paths += [name for number, name in sorted(batches.items()) if number > base]
        if not paths:
            return self.spark.createDataFrame([], self.schema).drop("gone")
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        columns = [c for c in self.schema.names if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*columns), "batch").alias("s"))
        return newest.select(*self.keys, "s.*").where("not gone")
