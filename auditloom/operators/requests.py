"""Tables of report requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.schema import WINDOW_CODES, window_table


def check_windows(requests: DataFrame) -> DataFrame:
    """Add the window's duration and retention, or ``reject_reason`` for an unknown code."""
    # seven rows, always
    table = F.broadcast(window_table(requests.sparkSession))
    reason = F.concat(
        F.lit("Invalid window: "),
        F.coalesce("window", F.lit("none")),
        F.lit(f". Valid options: {', '.join(WINDOW_CODES)}"),
    )
    return requests.join(table, "window", "left").withColumn(
        "reject_reason", F.when(F.col("duration_s").isNull(), reason)
    )
