"""Broadcast only what was counted and found small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 500_000


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df` with a broadcast hint when it has at most `rows` rows, else unchanged.

    The count stops at the bound. Without the hint Spark shuffles both sides and AQE splits
    skewed partitions.
    """
    limit = rows or int(df.sparkSession.conf.get("chronotag.maxBroadcastRows", str(MAX_BROADCAST_ROWS)))
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
