"""Change feeds: events entering, staying in and leaving a filter, and samples being added.

A change row has `op` (insert, update, delete) and the event `before` and `after` it as structs
of id, start_time, end_time and tags. The functions work on streams and on tables alike.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotag.functions import tags as T
from chronotag.operators import timecoord
from chronotag.operators.filters import Filter, matches, untestable

EVENT = "struct<id:bigint,start_time:double,end_time:double,tags:array<struct<name:string,value:string>>>"
#: Seconds (136 years) that event times are moved ahead by: Spark's watermark starts at 1970, and rows at or before it would count as late. pandas ends at 2262.
AHEAD = 1 << 32
CHANGES = f"seq bigint, op string, before {EVENT}, after {EVENT}"


def _in_coordinate(df: DataFrame, f: Filter, coordinates: DataFrame | None, events: list[str]) -> tuple[DataFrame, Filter]:
    """`df` with `_start_<event>` and `_end_<event>`: the times the filter tests, in its coordinate if it has one.

    The coordinates are a table that the feed meets in a stream-static join. As elsewhere they only matter with a start or an
    end, and an event the filter's other conditions fit must have one.
    """
    if coordinates is None:
        untestable(f)
    if f.time_coordinate is None or (f.start is None and f.end is None):
        times = {f"_{t}_{e}": F.col(e)[f"{t}_time"] for e in events for t in ("start", "end")}
        return df.withColumns(times), replace(f, time_coordinate=None)
    to, f = T.lit_tags(f.time_coordinate), replace(f, time_coordinate=None)
    for e in events:
        event = F.col(e)
        df = timecoord.with_times_in(df, coordinates, to, event["start_time"], event["end_time"], event["tags"],
                                     _fits(event, replace(f, start=None, end=None)), (f"_start_{e}", f"_end_{e}"))
    return df, f


def _fits(event: Column, f: Filter, start: Column | None = None, end: Column | None = None) -> Column:
    untestable(f)
    test = f.tag_test(event["tags"])
    if start is not None:
        test = test & f.time_test(start, end)
    if f.ids is not None:
        test = test & event["id"].isin(*f.ids)
    return F.coalesce(test, F.lit(False))


def change_feed(changes: DataFrame, f: Filter, coordinates: DataFrame | None = None) -> DataFrame:
    """Changes as one subscriber sees them: `change` is added, modified or removed, with the
    event. An update that enters the filter is added, one that leaves it is removed.

    A filter by time coordinate needs the table of coordinates; the events keep their own times.
    """
    columns = changes.columns
    changes, f = _in_coordinate(changes, f, coordinates, ["after", "before"])
    is_, was = (_fits(F.col(e), f, F.col(f"_start_{e}"), F.col(f"_end_{e}")) for e in ("after", "before"))
    # an update that did not touch the event itself comes without the old version
    was = F.when(F.col("before").isNull() & (F.col("op") == "update"), is_).otherwise(was)
    kind = (F.when((F.col("op") == "insert") & is_, "added")
            .when((F.col("op") == "delete") & was, "removed")
            .when((F.col("op") == "update") & was & is_, "modified")
            .when((F.col("op") == "update") & is_, "added")
            .when((F.col("op") == "update") & was, "removed"))
    event = F.coalesce(F.when(F.col("op") != "delete", F.col("after")), F.col("before"))
    rest = [c for c in columns if c not in ("op", "before", "after")]
    return (changes.withColumn("change", kind).where(F.col("change").isNotNull())
            .select(*rest, "change", F.col("op").isin("insert", "delete").alias("whole"), event.alias("event"))
            .select(*rest, "change", "whole", "event.*"))


def inserts(events: DataFrame) -> DataFrame:
    """Events as a feed of insertions."""
    row = F.struct("id", "start_time", "end_time", "tags")
    return events.select(F.lit("insert").alias("op"), F.lit(None).cast(EVENT).alias("before"), row.alias("after"))


def data_feed(samples: DataFrame, events: DataFrame, f: Filter, coordinates: DataFrame | None = None) -> DataFrame:
    """Added samples (event_id, time, value) with their event, for events that match."""
    if f.time_coordinate is None:
        ev = events.where(matches(events, f)).select("id", "start_time", "end_time", "tags")
    else:
        ev, f = _in_coordinate(events.select(F.struct("id", "start_time", "end_time", "tags").alias("event")), f, coordinates, ["event"])
        ev = ev.where(_fits(F.col("event"), f, F.col("_start_event"), F.col("_end_event"))).select("event.*")
    return (samples.join(ev, F.col("event_id") == F.col("id")).drop("event_id")
            .withColumn("change", F.lit("data_added")))


def with_lateness(stream: DataFrame, time: str, bound: str, keys: list[str] | None = None) -> DataFrame:
    """Drop rows more than `bound` behind the newest seen, and repeats of `keys` within it."""
    stamped = stream.withColumn("_at", F.timestamp_micros((F.col(time) * F.lit(1e6)).cast("bigint") + AHEAD * 10 ** 6)).withWatermark("_at", bound)
    return stamped.dropDuplicatesWithinWatermark(keys) if keys else stamped


def latest_values(reports: DataFrame, keys: list[str]) -> DataFrame:
    """Newest value per key; run it in update mode to hear of changes."""
    return reports.groupBy(*keys).agg(F.max_by("value", "time").alias("value"), F.max("time").alias("time"))
