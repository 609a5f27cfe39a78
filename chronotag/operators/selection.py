"""Selected events and named current values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotag.plans.ordered import Ordered

SELECTIONS = "event_id bigint, selected_at double"
VALUES = "value_group string, value_name string, time double, value array<float>"


def select(selections: DataFrame, ids: DataFrame, now: float) -> DataFrame:
    """Add events (event_id); those already selected keep their place."""
    new = ids.select("event_id").distinct().join(selections, "event_id", "left_anti")
    return selections.unionByName(new.withColumn("selected_at", F.lit(float(now))))


def unselect(selections: DataFrame, ids: DataFrame) -> DataFrame:
    return selections.join(ids.select("event_id"), "event_id", "left_anti")


def deselect_all(selections: DataFrame) -> DataFrame:
    return selections.limit(0)


def is_selected(events: DataFrame, selections: DataFrame) -> DataFrame:
    """Events with a column telling whether they are selected."""
    mark = selections.select(F.col("event_id").alias("_sel")).distinct()
    return events.join(mark, F.col("id") == F.col("_sel"), "left").withColumn("selected", F.col("_sel").isNotNull()).drop("_sel")


def selected_ids(selections: DataFrame) -> DataFrame:
    return selections.orderBy("selected_at", "event_id").select("event_id")


def latest_values(reports: DataFrame, keys: list[str] = ("value_group", "value_name")) -> DataFrame:
    """The newest value per group and name (and when it was set)."""
    return reports.groupBy(*keys).agg(F.max_by("value", "time").alias("value"), F.max("time").alias("time"))


def value_or(latest: DataFrame, group: str, name: str, default: list[float]) -> DataFrame:
    """One named value, or the default when it was never set."""
    hit = latest.where((F.col("value_group") == group) & (F.col("value_name") == name))
    return hit.agg(F.coalesce(F.first("value"), F.array(*[F.lit(float(v)).cast("float") for v in default])).alias("value"))


def value_changes(reports: DataFrame, keys: list[str] = ("value_group", "value_name")) -> DataFrame:
    """Reports that changed the value; repeats of the current one are left out."""
    o = Ordered(reports, list(keys), "time").lag(_was=F.struct("value"))
    return o.where(F.col("_was").isNull() | ~F.col("value").eqNullSafe(F.col("_was.value"))).drop("_was").done()
