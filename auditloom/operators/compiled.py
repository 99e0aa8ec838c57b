"""All rollup tables of a set of rules from one pass over the events.

A rule names a structure, a metric, a value and a condition. Sketches, digests and moments of
all rules are columns of one aggregation by system and bucket; counts and members of all
rules come from one aggregation by value. So a new metric or measure is one more rule, and
costs a column or a row, not another pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.buckets import bucket_start
from auditloom.operators import bloom, heavy
from auditloom.operators.distinct import LG_K
from auditloom.operators.mergeable import KLL_K
from auditloom.operators.moments import STATE
from auditloom.operators.routing import RULES, MetricRule, value_counts
from auditloom.schema import WINDOW_CODES, window_spec
from auditloom.session import materialize

KEY = ["metric", "system", "window", "bucket_start"]
MEASURED = ("hll", "theta", "kll", "moments")
COUNTED = ("topk", "heavy", "member", "bloom")

_TIMED = "latency_ms is not null"
#: What a maintained store holds unless it is told otherwise. Membership is exact here; a rule
#: with the structure ``bloom`` keeps a filter instead and no raw value.
MAINTAINED = (
    *(r if r.structure != "bloom" else MetricRule("member", r.metric, r.value, r.condition, r.windows) for r in RULES),
    MetricRule("kll", "api_latency", "latency_ms", _TIMED, ("1h", "1d")),
    MetricRule("moments", "api_latency", "latency_ms", _TIMED, ("1h", "1d")),
)


def base_window(rule: MetricRule) -> str:
    """The window a rule is stored in; longer ones are answered from it.

    An hour, or the rule's shortest window if that is shorter. Filters are stored by the
    rule's shortest window, as merging short ones would fill them up.
    """
    shortest = min(rule.windows, key=lambda w: window_spec(w).duration_s)
    if rule.structure == "bloom" or window_spec(shortest).duration_s < 3600:
        return shortest
    return "1h"


def _moments(value: str) -> dict[str, str]:
    """Count, mean, central sums and range of a measure, from built-in aggregates."""
    n, m2 = f"count({value})", f"var_pop({value}) * count({value})"
    m3 = f"coalesce(skewness({value}) * pow({m2}, 1.5D) / sqrt({n}), 0D)"
    m4 = f"coalesce((kurtosis({value}) + 3) * ({m2}) * ({m2}) / {n}, 0D)"
    cells = (n, f"avg({value})", m2, m3, m4, f"min({value})", f"max({value})")
    return dict(zip(STATE, cells, strict=True))


def _cells(rule: MetricRule) -> dict[str, str]:
    """Aggregates of a rule, by column of its table."""
    value = f"case when {rule.condition} then {rule.value} end"
    number = f"case when {rule.condition} then cast({rule.value} as double) end"
    out = {"last_ts": f"max(case when ({rule.condition}) and ({rule.value}) is not null then ts end)"}
    if rule.structure == "hll":
        return out | {"sketch": f"hll_sketch_agg({value}, {LG_K})", "n": f"count({value})"}
    if rule.structure == "theta":
        return out | {"sketch": f"theta_sketch_agg({value}, {LG_K})", "n": f"count({value})"}
    if rule.structure == "kll":
        return out | {"sketch": f"kll_sketch_agg_double({number}, {KLL_K})", "n": f"count({value})"}
    return out | _moments(number)


def _measured(events: DataFrame, rules: list[MetricRule], window: str) -> dict[str, DataFrame]:
    """Tables of the measured structures: one aggregation, whose columns become rows."""
    columns = {(i, name): f"c{i}_{name}" for i, rule in enumerate(rules) for name in _cells(rule)}
    aggs = [F.expr(text).alias(columns[i, name]) for i, rule in enumerate(rules) for name, text in _cells(rule).items()]
    keyed = events.groupBy("system", bucket_start(F.col("ts"), window).alias("bucket_start"))
    wide = materialize(keyed.agg(*aggs), "measured")
    out = {}
    for structure in MEASURED:
        own = [(i, rule) for i, rule in enumerate(rules) if rule.structure == structure]
        if own:
            names = list(_cells(own[0][1]))
            cells = ", ".join(f"'{rule.metric}', " + ", ".join(columns[i, n] for n in names) for i, rule in own)
            stacked = F.expr(f"stack({len(own)}, {cells}) as (metric, {', '.join(names)})")
            rows = wide.select("system", F.lit(window).alias("window"), "bucket_start", stacked)
            out[structure] = rows.where("n > 0")
    return out


def _counted(
    events: DataFrame, rules: list[MetricRule], window: str, stored: Mapping[str, DataFrame]
) -> dict[str, DataFrame]:
    """Tables of the counted structures: one aggregation by value."""
    tagged = [MetricRule(r.structure, f"{r.structure}:{r.metric}", r.value, r.condition, r.windows) for r in rules]
    counts = materialize(value_counts(events, tagged, window), "counted")
    out = {}
    for structure in COUNTED:
        if not any(r.structure == structure for r in rules):
            continue
        tag = f"{structure}:"
        rows = counts.where(F.col("metric").startswith(tag)).withColumn(
            "metric", F.expr(f"substring(metric, {len(tag) + 1})")
        )
        if structure == "topk":
            out[structure] = rows.select(*KEY, F.col("value").alias("item"), "cnt", "last_ts")
        elif structure == "heavy":
            out[structure] = heavy.counter_cut(rows.select(*KEY, F.col("value").alias("item"), "cnt", "last_ts"), KEY)
        elif structure == "member":
            out[structure] = rows.select(*KEY, "value", "last_ts")
        else:
            distinct = rows.groupBy(*KEY, "value").agg(F.max("last_ts").alias("last_ts"))
            out[structure] = bloom.filter_rows(distinct, KEY, stored.get(structure))
    return out


def rollups(
    events: DataFrame, rules: Iterable[MetricRule] = MAINTAINED, stored: Mapping[str, DataFrame] | None = None
) -> dict[str, DataFrame]:
    """Rows for every structure the rules name, each rule in its :func:`base_window`.

    Events are read once for the measured and once for the counted rules of a base window
    (all hourly rules share one). ``stored`` has, for ``bloom``, the filters the new ones
    will be added to, so that values go to a filter with room.
    """
    rules, stored = list(rules), stored or {}
    for rule in rules:
        if rule.structure not in (*MEASURED, *COUNTED):
            raise ValueError(f"unknown structure {rule.structure}; valid: {', '.join((*MEASURED, *COUNTED))}")
    passes = [
        (make, own, window)
        for window in WINDOW_CODES
        for kinds, make in ((MEASURED, _measured), (COUNTED, partial(_counted, stored=stored)))
        if (own := [r for r in rules if base_window(r) == window and r.structure in kinds])
    ]
    out: dict[str, DataFrame] = {}
    if passes:
        # independent passes: their jobs share the cluster instead of queueing
        with ThreadPoolExecutor(len(passes)) as pool:
            made = [pool.submit(make, events, own, window) for make, own, window in passes]
        for tables in made:
            for structure, rows in tables.result().items():
                out[structure] = rows if structure not in out else out[structure].unionByName(rows)
    return out
