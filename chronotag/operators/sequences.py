"""Sequences of events: grouped by tag values, ordered by start, split, matched, summarised."""

from __future__ import annotations

import numpy as np
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotag.functions import tags as T
from chronotag.operators.catalog import combination_columns
from chronotag.operators.events import shift
from chronotag.plans.bounded import small_side
from chronotag.plans.ordered import Ordered
from chronotag.plans.sequential import per_group

ORDER = ["start_time", "end_time", "id"]


def build(events: DataFrame, group: list[str] | None = None, where: str | None = None) -> tuple[DataFrame, list[str]]:
    """Events with the key columns of their sequence: one column per group tag (c0, c1, ...).

    An event with several values of a group tag belongs to several sequences. Without group
    tags everything is one sequence.
    """
    df = events.where(T.contains(F.col("tags"), where)) if where else events
    if group:
        return combination_columns(df, group)
    return df.withColumn("c0", F.lit("")), ["c0"]


def split_on_timeout(seq: DataFrame, keys: list[str], timeout: float, out: str = "part") -> DataFrame:
    """Number the parts of each sequence: a new part begins when an event starts `timeout` or
    more after the end of the event before it."""
    o = Ordered(seq, keys, ORDER).lag(_end=F.col("end_time"))
    breaks = F.when(F.col("start_time") - F.col("_end") >= F.lit(float(timeout)), 1).otherwise(0).cast("bigint")
    return o.running_sum(**{out: breaks}).done().drop("_end")


def gaps(seq: DataFrame, keys: list[str], start: float | None = None, end: float | None = None,
         min_gap: float | None = None, set_tags: str | None = None) -> DataFrame:
    """Times inside each sequence when none of its events is going on: (keys, start_time,
    end_time, tags).

    A gap has the tags of the event that ended last before it (at equal ends the last one in
    order), changed by `set_tags`. With `start` the time from there to the first event counts,
    with the first event's tags; with `end` the time after the last event.
    """
    change = T.lit_tags(set_tags)
    o = Ordered(seq.select(*keys, *ORDER, "tags"), keys, ORDER)
    ended = F.struct("end_time", "start_time", "id", "tags")
    o = o.running_max(inclusive=False, _before=ended).done()
    inner = (o.where(F.col("start_time") > F.col("_before.end_time"))
             .select(*keys, F.col("_before.end_time").alias("s"), F.col("start_time").alias("e"),
                     F.col("_before.tags").alias("tags")))
    out = inner
    edges = seq.groupBy(*keys).agg(
        F.min_by(F.struct("start_time", "tags"), F.struct(*ORDER)).alias("a"),
        F.max_by(F.struct("end_time", "tags"), F.struct("end_time", "start_time", "id")).alias("z"))
    if start is not None:
        lo = F.lit(float(start))
        lead = edges.where(F.col("a.start_time") >= lo).select(
            *keys, lo.alias("s"), F.col("a.start_time").alias("e"), F.col("a.tags").alias("tags"))
        out = out.unionByName(lead).where(F.col("e") >= lo).withColumn("s", F.greatest("s", lo))
    if end is not None:
        hi = F.lit(float(end))
        trail = edges.where(F.col("z.end_time") <= hi).select(
            *keys, F.col("z.end_time").alias("s"), hi.alias("e"), F.col("z.tags").alias("tags"))
        out = out.unionByName(trail).where(F.col("s") <= hi).withColumn("e", F.least("e", hi))
    if min_gap is not None:
        out = out.where(F.col("e") - F.col("s") >= F.lit(float(min_gap)))
    return out.select(*keys, F.col("s").alias("start_time"), F.col("e").alias("end_time"),
                      T.set_(F.col("tags"), change).alias("tags"))


def gap_of_nothing(spark, start: float, end: float, set_tags: str | None) -> DataFrame:
    """The one gap of a sequence without events."""
    return spark.range(1).select(F.lit(float(start)).alias("start_time"), F.lit(float(end)).alias("end_time"),
                                 T.lit_tags(set_tags).alias("tags"))


def summarize(seq: DataFrame, keys: list[str], change: str | None = None) -> DataFrame:
    """One event per sequence: first start, the last event's end, the union of the tags changed
    by `change` (a name without a value is removed)."""
    spans = seq.groupBy(*keys).agg(F.min("start_time").alias("start_time"),
                                   F.max_by("end_time", F.struct(*ORDER)).alias("end_time"),
                                   F.min_by("id", F.struct(*ORDER)).alias("id"),
                                   F.count(F.lit(1)).alias("n"))
    # distinct pairs first, so that what is collected is no longer than the result
    pairs = (seq.select(*keys, F.explode("tags").alias("p")).distinct()
             .groupBy(*keys).agg(F.collect_list("p").alias("union")))
    on = [F.col(f"_l{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    renamed = pairs.select(*[F.col(k).alias(f"_l{i}") for i, k in enumerate(keys)], "union")
    both = spans.join(renamed, on, "left").drop(*[f"_l{i}" for i in range(len(keys))])
    union = T.canonical(F.coalesce("union", F.expr(T.EMPTY)))
    return both.withColumn("tags", T.derive(union, T.lit_tags(change))).drop("union")


def summary_samples(seq: DataFrame, keys: list[str], samples: DataFrame, summaries: DataFrame) -> DataFrame:
    """All samples of a sequence's events under the id of its summary.

    Sequences whose series have different dimensions raise an error.
    """
    members = seq.select(*keys, F.col("id").alias("event_id"))
    owner = summaries.select(*[F.col(k).alias(f"_l{i}") for i, k in enumerate(keys)], F.col("id").alias("_owner"))
    on = [F.col(f"_l{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    rows = samples.join(members.join(owner, on).select("event_id", "_owner"), "event_id")
    dims = rows.groupBy("_owner").agg(F.min(F.size("value")).alias("a"), F.max(F.size("value")).alias("b"))
    ok = F.when(F.col("a") != F.col("b"), F.raise_error(F.lit("series of different dimension in one sequence"))
                .cast("bigint")).otherwise(F.col("_owner"))
    # one row per sequence against all of its samples: AQE splits the sample side when it is skewed
    checked = dims.select(F.col("_owner").alias("_id"), ok.alias("_ok"))
    return (rows.join(checked, F.col("_owner") == F.col("_id"))
            .select(F.col("_ok").alias("event_id"), "time", "value"))


# --- phases ---------------------------------------------------------------------------------

def phases(seq: DataFrame, keys: list[str], phase_tags: list[str], stack: bool = False) -> DataFrame:
    """Order the events of each sequence by phase and, with `stack`, move each phase's events to
    begin where the phase before ends.

    A phase is a combination of values of the phase tags (compared as numbers when all are
    numbers); it lasts as long as its longest event in any sequence. Adds `phase` (0, 1, ...) and
    `phase_start`.
    """
    cols = [f"p{i}" for i in range(len(phase_tags))]
    df = seq.withColumns({c: T.value(F.col("tags"), n) for c, n in zip(cols, phase_tags)})
    table = df.groupBy(*cols).agg(F.max(F.col("end_time") - F.col("start_time")).alias("_len"))
    numeric = table.agg(*[F.bool_and(F.col(c).try_cast("double").isNotNull()).alias(c) for c in cols]).first()
    order = [F.col(c).cast("double") if numeric[c] else F.col(c) for c in cols]
    # one row per phase
    ranked = table.withColumns({f"_o{i}": o for i, o in enumerate(order)}).withColumn("_all", F.lit(0))
    o = Ordered(ranked, "_all", [f"_o{i}" for i in range(len(cols))])
    o = o.row_number("_n").running_sum(inclusive=False, _from=F.col("_len")).done()
    starts = o.select(*[F.col(c).alias(f"_q{c}") for c in cols], (F.col("_n") - 1).alias("phase"),
                      F.coalesce("_from", F.lit(0.0)).alias("phase_start"))
    out = df.join(small_side(starts), [F.col(c).eqNullSafe(F.col(f"_q{c}")) for c in cols]).drop(
        *[f"_q{c}" for c in cols], *cols)
    if stack:
        out = shift(out, F.col("phase_start") - F.col("start_time"))
    return out.orderBy(*keys, "phase", *ORDER)


# --- regular expressions over tag values ------------------------------------------------------

def regex(seq: DataFrame, keys: list[str], tag: str, pattern: str, groups: tuple[int, ...] = (0,)) -> DataFrame:
    """Matches of a regular expression in the concatenated values of a tag along each sequence.

    One row per match and group: (keys, match, group, start_time, end_time, first, last, n)
    where first and last are positions of events in the sequence (from 0). An event counts as
    a whole when the match touches its value; a missing tag reads `null`.
    """
    compiled = re.compile(pattern)
    row = F.struct(*ORDER, F.coalesce(T.value(F.col("tags"), tag), F.lit("null")).alias("text"))
    slim = seq.select(*keys, row.alias("e")).select(*keys, "e.*")
    fields = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + (
        ", match bigint, `group` int, start_time double, end_time double, first bigint, last bigint, n bigint")

    def matches(c):
        lengths = np.fromiter(map(len, c["text"]), dtype=np.int64, count=len(c["text"]))
        ends = lengths.cumsum()
        key = tuple(c[k][0] for k in keys)
        rows = []
        for number, m in enumerate(compiled.finditer("".join(c["text"]))):
            for g in groups:
                if m.start(g) < 0 or m.end(g) == m.start(g):
                    continue  # the group took no part, or matched nothing
                a = int(np.searchsorted(ends, m.start(g), side="right"))
                b = int(np.searchsorted(ends, m.end(g) - 1, side="right"))
                rows.append((*key, number, g, c["start_time"][a], c["end_time"][b], a, b, b - a + 1))
        return rows

    return per_group(slim, list(keys), ORDER, matches, schema)
