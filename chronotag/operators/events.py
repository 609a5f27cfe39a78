"""Creating, reading, changing and removing events. Every function returns new tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotag.functions import tags as T
from chronotag.model import EVENT_COLUMNS, MAX_TIME, Store
from chronotag.operators import filters
from chronotag.operators.filters import Filter
from chronotag.plans.ordered import Ordered
from chronotag.plans.sequential import per_group


# --- creating ------------------------------------------------------------------------------

def next_id(events: DataFrame) -> int:
    return (events.agg(F.max("id")).first()[0] or 0) + 1


def create(store: Store, rows: DataFrame) -> Store:
    """Append events (start_time, end_time, tags) under new ids.

    Ids follow the largest one in use. They are unique and grow with the input partitions but
    leave holes, so that no row count has to be collected first.
    """
    first = next_id(store.events)
    new = rows.withColumn("id", F.monotonically_increasing_id() + F.lit(first))
    keep = [c for c in store.events.columns if c in new.columns]
    return store.with_(events=store.events.select(*keep).unionByName(new.select(*keep)))


def create_one(store: Store, start: float, end: float, tags: str) -> tuple[Store, int]:
    new_id = next_id(store.events)
    row = store.spark.range(1).select(F.lit(new_id).cast("bigint").alias("id"), F.lit(float(start)).alias("start_time"),
                                      F.lit(float(end)).alias("end_time"), T.lit_tags(tags).alias("tags"))
    return store.with_(events=store.events.select(*EVENT_COLUMNS).unionByName(row)), new_id


def clone(store: Store, ids: list[int], start: float | None = None, end: float | None = None,
          set_tags: str | None = None) -> Store:
    """Copy events with new times and tags, and what is attached to them inside the new span.

    A copy's id is (largest id in use) + (position in `ids`, from 1).
    """
    base = next_id(store.events)
    mapping = F.create_map(*[x for i, old in enumerate(ids) for x in (F.lit(int(old)).cast("bigint"), F.lit(base + i).cast("bigint"))])
    src = store.events.where(F.col("id").isin([int(i) for i in ids]))
    copy = src.select(
        mapping[F.col("id")].alias("id"),
        (F.lit(float(start)) if start is not None else F.col("start_time")).alias("start_time"),
        (F.lit(float(end)) if end is not None else F.col("end_time")).alias("end_time"),
        (T.set_(F.col("tags"), T.lit_tags(set_tags)) if set_tags else F.col("tags")).alias("tags"))
    out = {"events": store.events.select(*EVENT_COLUMNS).unionByName(copy)}

    def copied(table: DataFrame, timed: bool) -> DataFrame:
        rows = table.where(F.col("event_id").isin([int(i) for i in ids])).withColumn("event_id", mapping[F.col("event_id")])
        if timed:
            lo = F.lit(float(start)) if start is not None else F.lit(-MAX_TIME)
            hi = F.lit(float(end)) if end is not None else F.lit(MAX_TIME)
            rows = rows.where(F.col("time").isNull() | F.col("time").between(lo, hi))
        return table.unionByName(rows)

    for name, timed in (("samples", True), ("blobs", True), ("attachments", False)):
        if getattr(store, name) is not None:
            out[name] = copied(getattr(store, name), timed)
    return store.with_(**out)


# --- reading -------------------------------------------------------------------------------

def by_ids_in_order(store: Store, ids: list[int]) -> DataFrame:
    """Events in the order asked for; an unknown id is an error when the rows are read."""
    asked = store.spark.range(1).select(F.posexplode(F.array(*[F.lit(int(i)).cast("bigint") for i in ids])).alias("pos", "asked"))
    hit = F.broadcast(asked).join(store.events.where(F.col("id").isin([int(i) for i in ids])), F.col("asked") == F.col("id"), "left")
    checked = F.when(F.col("id").isNull(), F.raise_error(F.concat(F.lit("no event with id "), F.col("asked").cast("string")))
                     .cast("bigint")).otherwise(F.col("id"))
    return hit.withColumn("id", checked).orderBy("pos").drop("pos", "asked")


def attributes(store: Store, ids: list[int]) -> DataFrame:
    """Tags, start and end of events by id."""
    return store.events.where(F.col("id").isin([int(i) for i in ids])).select(
        "id", T.to_text(F.col("tags")).alias("tags"), "start_time", "end_time")


# smallest step find_next and find_prev take when none is given
DEFAULT_DELTA = 1e-3 + 1e-8


def find_next(store: Store, f: Filter, time: float, delta: float = DEFAULT_DELTA) -> DataFrame:
    """The first matching event that starts at least `delta` after `time`."""
    return (filters.select(store, f).where(F.col("start_time") >= F.lit(float(time) + delta))
            .orderBy("start_time", "end_time", "id").limit(1))


def find_prev(store: Store, f: Filter, time: float, delta: float = DEFAULT_DELTA) -> DataFrame:
    """The last matching event that starts at least `delta` before `time`."""
    return (filters.select(store, f).where(F.col("start_time") <= F.lit(float(time) - delta))
            .orderBy(F.desc("start_time"), F.desc("end_time"), F.desc("id")).limit(1))


def neighbours(events: DataFrame, probes: DataFrame, keys: list[str], delta: float = DEFAULT_DELTA) -> DataFrame:
    """For many probes (keys, probe_id, time): next_id/next_start and prev_id/prev_start.

    Events and probes are merged into one order per key. Probes are entered twice, moved by
    `delta` to either side, so that equal times fall on the right side.
    """
    ev = events.select(*keys, F.col("start_time").alias("at"), F.lit(1).alias("kind"), "id",
                       F.struct("start_time", "id").alias("hit"))
    after = probes.select(*keys, (F.col("time") + delta).alias("at"), F.lit(0).alias("kind"),
                          F.col("probe_id").alias("id"), F.lit(None).cast("struct<start_time:double,id:bigint>").alias("hit"))
    before = probes.select(*keys, (F.col("time") - delta).alias("at"), F.lit(2).alias("kind"),
                           F.col("probe_id").alias("id"), F.lit(None).cast("struct<start_time:double,id:bigint>").alias("hit"))
    o = Ordered(ev.unionByName(after).unionByName(before), keys, ["at", "kind", "id"])
    o = o.fill_forward(last=F.col("hit")).fill_backward(first=F.col("hit"))
    rows = o.done().where(F.col("kind") != 1)
    return (rows.groupBy(*keys, F.col("id").alias("probe_id"))
            .agg(F.max(F.when(F.col("kind") == 0, F.col("first"))).alias("n"),
                 F.max(F.when(F.col("kind") == 2, F.col("last"))).alias("p"))
            .select(*keys, "probe_id", F.col("n.id").alias("next_id"), F.col("n.start_time").alias("next_start"),
                    F.col("p.id").alias("prev_id"), F.col("p.start_time").alias("prev_start")))


# --- changing ------------------------------------------------------------------------------

def _retag(store: Store, f: Filter, change) -> Store:
    plain = [c for c in store.events.columns if c.startswith("tag:")]
    new = filters.hits(store, f).withColumn("tags", F.when(F.col("_hit"), change(F.col("tags"))).otherwise(F.col("tags"))).drop("_hit")
    # tags may have moved away from their plain columns, so these are derived again
    for c in plain:
        new = new.withColumn(c, T.value(F.col("tags"), c[4:]))
    return store.with_(events=new)


def set_tags(store: Store, f: Filter, tags: str) -> Store:
    """Replace the values of the given names on matching events."""
    if any(v is None for _, v in T.parse(tags)):
        raise ValueError("cannot set a tag without a value")
    return _retag(store, f, lambda t: T.set_(t, T.lit_tags(tags)))


def add_tags(store: Store, f: Filter, tags: str) -> Store:
    return _retag(store, f, lambda t: T.add(t, T.lit_tags(tags)))


def remove_tags(store: Store, f: Filter, tags: str) -> Store:
    """Remove pairs; a name without a value loses all its values."""
    return _retag(store, f, lambda t: T.remove(t, T.lit_tags(tags)))


def set_times(store: Store, f: Filter, start: float | None = None, end: float | None = None) -> Store:
    """Move start or end of matching events; their samples outside the new span are dropped."""
    return _move(store, filters.hits(store, f), start, end)


def _move(store: Store, ev: DataFrame, start: float | None, end: float | None) -> Store:
    """New times for the events whose column `_hit` says so."""
    def moved(col, to):
        return F.when(F.col("_hit"), F.lit(float(to))).otherwise(F.col(col)) if to is not None else F.col(col)

    new = ev.withColumns({"start_time": moved("start_time", start), "end_time": moved("end_time", end)}).drop("_hit")
    out = {"events": new}
    outside = (F.lit(False) if start is None else F.col("time") < F.lit(float(start))) | (
        F.lit(False) if end is None else F.col("time") > F.lit(float(end)))
    for name in ("samples", "blobs"):
        table = getattr(store, name)
        if table is None:
            continue
        changed = ev.where("_hit").select(F.col("id").alias("event_id"))
        # only rows outside the span are looked up among the changed events
        lost = table.where(outside).join(changed, "event_id", "left_anti")
        out[name] = table.where(~outside | F.col("time").isNull()).unionByName(lost)
    return store.with_(**out)


def set_end(store: Store, f: Filter, end: float) -> Store:
    return set_times(store, f, end=end)


def set_by_id(store: Store, id_: int, start: float | None = None, end: float | None = None, tags: str | None = None) -> Store:
    """Change one event; an unknown id is an error."""
    if store.events.where(F.col("id") == id_).limit(1).count() == 0:
        raise KeyError(f"no event with id {id_}")
    f = filters.by_ids(id_)
    if tags is not None:
        store = set_tags(store, f, tags)
    return set_times(store, f, start, end) if start is not None or end is not None else store


def shift(events: DataFrame, by: Column | float) -> DataFrame:
    by = by if isinstance(by, Column) else F.lit(float(by))
    return events.withColumns({"start_time": F.col("start_time") + by, "end_time": F.col("end_time") + by})


def truncate(store: Store, f: Filter, time: float, keep: str) -> Store:
    """Cut matching events at `time`, keeping what is 'before' or 'after'; the rest is deleted."""
    gone = F.col("start_time") > time if keep == "before" else F.col("end_time") < time
    ev = filters.hits(store, f)
    doomed = ev.where(F.col("_hit") & gone).select("id")
    kept = delete_ids(store, doomed)
    # events entirely on the kept side are not touched
    crossing = F.col("end_time") >= time if keep == "before" else F.col("start_time") <= time
    left = ev.where(~(F.col("_hit") & gone)).withColumn("_hit", F.col("_hit") & crossing)
    return _move(kept, left, *((None, time) if keep == "before" else (time, None)))


# --- deleting ------------------------------------------------------------------------------

def delete(store: Store, *fs: Filter) -> Store:
    """Remove matching events with their samples and attachments."""
    return delete_ids(store, filters.select(store, *fs).select("id"))


def delete_ids(store: Store, ids: DataFrame) -> Store:
    out = {"events": store.events.join(ids, "id", "left_anti")}
    owner = ids.withColumnRenamed("id", "event_id")
    for name in ("samples", "attachments", "blobs"):
        table = getattr(store, name)
        if table is not None:
            out[name] = table.join(owner, "event_id", "left_anti")
    return store.with_(**out)


# --- state sequences -----------------------------------------------------------------------

def state_changes(reports: DataFrame, keys: list[str], info: str = "info", time: str = "time",
                  end: Column | None = None) -> DataFrame:
    """Reports of a state over time as one event per run of the same state.

    A different state ends the event of its key and starts the next one; the last stays open
    (or ends at `end`, an aggregate over the key's reports). Reports must give the same names
    each time; see `state_changes_partial` when they may leave some out.
    """
    o = Ordered(reports.select(*keys, time, info), keys, [time, info]).lag(_before=F.col(info))
    o = o.where(F.col("_before").isNull() | (F.col("_before") != F.col(info)))
    o = o.lead(_until=F.col(time))
    out = o.done().select(*keys, F.col(info), F.col(time).alias("start_time"), "_until")
    if end is None:
        return out.select(*keys, info, "start_time", F.coalesce("_until", F.lit(MAX_TIME)).alias("end_time"))
    ends = reports.groupBy(*keys).agg(end.alias("_end"))
    return (out.join(ends, keys).select(*keys, info, "start_time", F.coalesce("_until", "_end").alias("end_time")))


def state_changes_partial(reports: DataFrame, keys: list[str], info: str = "info", time: str = "time",
                          rows_per_cell: int = 20_000) -> DataFrame:
    """As `state_changes`, where a report may leave out tags of the open state and so continues it.

    What a report means depends on the state that is open, so a key is cut into cells of rows in
    order. Within a cell only the first report of each different state can be the one that ends
    an earlier state; each of these is followed to the state it leaves behind. Walking that
    table, a few rows per cell, tells every cell which state it begins with.
    """
    o = Ordered(reports.select(*keys, F.col(time).alias("_t"), F.col(info).alias("_i")), keys, ["_t", "_i"])
    cells = o.row_number("_n").done().withColumn("_cell", F.floor((F.col("_n") - 1) / rows_per_cell)).drop("_n")
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def says_no_more(now, state):
        return state is not None and now <= state

    def leaves(c):
        said = [frozenset(T.parse(i)) for i in c["_i"]]
        exits: dict[int, int] = {}

        def follow(r):
            """Row whose state is open at the end when the state of row r opens there."""
            path = []
            while r not in exits:
                path.append(r)
                after = next((j for j in range(r + 1, len(said)) if not said[j] <= said[r]), None)
                if after is None:
                    exits[r] = r
                    break
                r = after
            for p in path:
                exits[p] = exits[r]
            return exits[path[0] if path else r]

        firsts = dict.fromkeys(said)
        rows, key = [], tuple(c[k][0] for k in keys)
        for r, state in enumerate(said):
            if state in firsts:
                del firsts[state]
                rows.append((*key, c["_cell"][0], r, c["_i"][r], c["_i"][follow(r)]))
        return rows

    table = per_group(cells, [*keys, "_cell"], ["_t", "_i"], leaves, f"{head}, _cell bigint, _r bigint, _i string, _left string")

    def walk(c):
        rows, key, state, known = [], tuple(c[k][0] for k in keys), None, None
        edges = [0, *(np.flatnonzero(np.diff(c["_cell"])) + 1), len(c["_cell"])]
        for a, b in zip(edges, edges[1:]):
            rows.append((*key, c["_cell"][a], state))
            hit = next((j for j in range(a, b) if not says_no_more(frozenset(T.parse(c["_i"][j])), known)), None)
            if hit is not None:
                state = c["_left"][hit]
                known = frozenset(T.parse(state))
        return rows

    begin = per_group(table, keys, ["_cell", "_r"], walk, f"{head}, _cell bigint, _open string")

    def starts(c):
        rows, key = [], tuple(c[k][0] for k in keys)
        known = frozenset(T.parse(c["_open"][0])) if c["_open"][0] is not None else None
        for t, i in zip(c["_t"], c["_i"]):
            now = frozenset(T.parse(i))
            if not says_no_more(now, known):
                known = now
                rows.append((*key, t, i))
        return rows

    begun = per_group(cells.join(begin, [*keys, "_cell"]), [*keys, "_cell"], ["_t", "_i"], starts, f"{head}, start_time double, `{info}` string")
    return (Ordered(begun, keys, ["start_time", info]).lead(_until=F.col("start_time")).done()
            .select(*keys, info, "start_time", F.coalesce("_until", F.lit(MAX_TIME)).alias("end_time")))
