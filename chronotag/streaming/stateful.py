"""Keyed streaming state: sequences of states, live series, co-occurrences, patterns.

Each processor gets the rows of one key and batch, puts them in order and updates the key's
state, which Spark keeps, checkpoints and moves between executors.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronotag.functions import tags as T
from chronotag.model import MAX_TIME
from chronotag.operators.filters import Filter
from chronotag.operators.patterns import _search
from chronotag.streaming.feeds import AHEAD, with_lateness
from chronotag.streaming.run import newest, use_state_store


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


def _run(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str = "append", timed: bool = False) -> DataFrame:
    use_state_store(df.sparkSession)
    return df.groupBy(*keys).transformWithStateInPandas(processor, schema, mode, "EventTime" if timed else "None")


def _watermark(timer_values) -> float:
    """Seconds up to which everything has arrived."""
    return timer_values.getCurrentWatermarkInMs() / 1000.0 - AHEAD


def _timer(handle: StatefulProcessorHandle, time: float) -> None:
    """Wake up once everything up to `time` has arrived."""
    handle.registerTimer(int(np.ceil((time + AHEAD) * 1000)) + 1)


class _Keyed(StatefulProcessor):
    def close(self) -> None:
        pass


# --- sequences of states --------------------------------------------------------------------------

@lru_cache(1 << 16)
def _tags_of(text: str) -> frozenset:
    return frozenset(T.parse(text))


class _States(_Keyed):
    """Rows of many keys go in and out together; all that is kept for a key is one value, as every access is a message to the executor."""

    def __init__(self, timed: bool):
        self.timed = timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the open event after all settled reports, the last one told, and reports that an earlier one may still overtake
        self.kept = handle.getValueState("kept", "no bigint, info string, start_time double, told bigint, times array<double>, infos array<string>")

    def handleInputRows(self, key, rows, timerValues):
        yield from self._tell(key, [(np.nan if r["time"] is None else float(r["time"]), r["info"]) for r in rows], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._tell(key, [], timerValues)

    @staticmethod
    def _walk(state, reports, out):
        for time, info in reports:
            if state and _tags_of(info) <= _tags_of(state[1]):
                continue  # the open state says the same or more
            if state:
                out.append((*state, time, False))
            state = (state[0] + 1 if state else 0, info, time)
        return state

    def _tell(self, key, new, timerValues):
        kept = self.kept.get()
        no, info, start, told, times, infos = kept if kept else (None, None, None, None, None, None)
        before = list(zip(times or [], infos or []))
        waiting = sorted(before + new, key=lambda r: r[0])
        until = _watermark(timerValues) if self.timed else np.inf
        settled = sum(t <= until for t, _ in waiting)
        out = []
        state = settled_state = self._walk((no, info, start) if no is not None else None, waiting[:settled], out)
        later = waiting[settled:]
        if later:
            _timer(self.handle, later[0][0])
        state = self._walk(state, later, out)
        if state:
            out.append((*state, MAX_TIME, True))
            # states an overtaking report has made one of are taken back
            out += [(n, None, None, None, False) for n in range(state[0] + 1, (-1 if told is None else told) + 1)]
            self.kept.update((*(settled_state or (None, None, None)), state[0], [t for t, _ in later], [i for _, i in later]))
        for r in out:
            yield Row(key=key[0], no=r[0], info=r[1], start_time=r[2], end_time=r[3], open=r[4])


def state_sequence(reports: DataFrame, lateness: str | None = None) -> DataFrame:
    """Reports (key, time, info tagset text) as events, while they arrive: versions of (key, no, info, start_time, end_time,
    open), where `no` counts a key's events. `current_states` takes the newest ones.

    A report continues the open event when its tags are among that event's tags. Without `lateness` reports arrive in order of time,
    so that an ended event is told once, and after every batch the open one. With it (such as "10 minutes") a report
    may come that much behind the newest one: it is put in its place, events that change by it are told again, and what turns out not
    to be an event is told with null info. Only reports within the bound are kept for that.
    """
    rows = reports.select("key", "time", "info")
    if lateness:
        rows = with_lateness(rows, "time", lateness)
    use_state_store(rows.sparkSession)
    return rows.groupBy("key").transformWithState(
        _States(lateness is not None), "key string, no bigint, info string, start_time double, end_time double, open boolean", "append", "EventTime" if lateness else "None")


def current_states(told: DataFrame) -> DataFrame:
    """The events of a replayed `state_sequence`: the newest version of each."""
    return newest(told, ["key", "no"]).where("info is not null")


# --- order ---------------------------------------------------------------------------------------

class _InOrder(_Keyed):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "time double")

    def handleInputRows(self, key, rows, timerValues):
        last = self.last.get()[0] if self.last.exists() else -np.inf
        df = _ordered(rows, ["seq"])
        # a sample counts when it is not before any sample accepted so far
        best = np.maximum.accumulate(np.concatenate([[last], df["time"].to_numpy()]))
        ok = df["time"].to_numpy() >= best[:-1]
        self.last.update((float(best[-1]),))
        yield df[ok][["event_id", "time", "value"]]


def in_order(samples: DataFrame) -> DataFrame:
    """Samples (seq, event_id, time, value) without those that come after a later one of their series."""
    return _run(samples.select("event_id", "seq", "time", "value"), ["event_id"], _InOrder(),
                "event_id bigint, time double, value array<float>")


# --- live view of series ------------------------------------------------------------------------------

class _Live(_Keyed):
    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.event = handle.getValueState("event", "start_time double, end_time double, tags string")
        self.samples = handle.getListState("samples", "time double, value array<float>")

    def handleInputRows(self, key, rows, timerValues):
        event = tuple(self.event.get()) if self.event.exists() else None
        kept = [(r[0], list(r[1])) for r in self.samples.get()] if self.samples.exists() else []
        for r in _ordered(rows, ["seq"]).itertuples():
            if r.change == "removed":
                event, kept = None, []
            elif r.change == "data_added":
                kept = (kept + [(float(r.time), [float(v) for v in r.value])])[-self.n:] if self.n else []
            else:
                event = (float(r.start_time), float(r.end_time), r.tags)
        if event is None:
            self.event.clear()
        else:
            self.event.update(event)
        self.samples.put(kept) if kept else self.samples.clear()
        gone = event is None
        start, end, tags = event or (None, None, None)
        yield pd.DataFrame({"id": [key[0]], "present": [not gone], "start_time": [start], "end_time": [end], "tags": [tags],
                            "times": [[t for t, _ in kept]], "values": [[v for _, v in kept]]})


def live_view(changes: DataFrame, n_samples: int) -> DataFrame:
    """Current state of every event that changes, with its newest samples.

    Input: seq, id, change (added, modified, removed, data_added), start_time, end_time, tags
    (text), time, value. Output per batch and changed event: id, present, start_time, end_time,
    tags, times, values. Further filters are applied to the output.
    """
    cols = ["id", "seq", "change", "start_time", "end_time", "tags", "time", "value"]
    return _run(changes.select(*cols), ["id"], _Live(n_samples),
                "id bigint, present boolean, start_time double, end_time double, tags string, "
                "times array<double>, values array<array<float>>")


# --- co-occurrences as they happen ---------------------------------------------------------------------

def _value(samples: list, time: float) -> list[float] | None:
    """Value on the line through the last two samples."""
    if not samples:
        return None
    if len(samples) == 1:
        return samples[0][1]
    (t1, a), (t2, b) = samples
    if time == t1:
        return a
    if time == t2:
        return b
    return [float(np.float32(x + (y - x) * ((time - t1) / (t2 - t1)))) for x, y in zip(a, b)]


#: What is kept of an event: its roles, its span and its last two samples.
ONLINE_EVENT = "roles array<int>, start_time double, end_time double, t1 double, v1 array<float>, t2 double, v2 array<float>"
ONLINE_COLUMNS = ["id", "seq", "change", "start_time", "end_time", "time", "value", "roles"]


def _numbers(values) -> list[float]:
    return [np.nan if v is None else v for v in values]


class _Online(_Keyed):
    def __init__(self, n_inputs: int, n_groups: int, timed: bool):
        self.n_inputs, self.n_groups, self.timed = n_inputs, n_groups, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "id bigint", ONLINE_EVENT)
        self.instances = handle.getMapState("instances", "ids string", "start_time double")
        self.timer = handle.getValueState("timer", "time double")  # of the one timer that is set

    def _load(self):
        """Events as [roles, start, end, samples] by id and running instances (ids: start), as they were at the end of the last batch,
        and both as they are stored."""
        stored = {id_: tuple(e) for (id_,), e in self.events.iterator()}
        events = {id_: [list(roles), start, end, [(t, list(v)) for t, v in ((t1, v1), (t2, v2)) if v is not None]]
                  for id_, (roles, start, end, t1, v1, t2, v2) in stored.items()}
        running = {tuple(map(int, k[0].split(","))): v[0] for k, v in self.instances.iterator()}
        return events, running, stored, set(running)

    def _save(self, events, running, stored, ran, fired=False):
        """Writes what has changed; with a bound on lateness one timer waits for the earliest event to end."""
        for id_ in set(stored) - set(events):
            self.events.removeKey((id_,))
        for id_, (roles, start, end, samples) in events.items():
            (t1, v1), (t2, v2) = [*samples, (None, None), (None, None)][:2]
            kept = (roles, start, end, t1, v1, t2, v2)
            if stored.get(id_) != kept:
                self.events.updateValue((id_,), kept)
        for ids in ran - set(running):
            self.instances.removeKey((",".join(map(str, ids)),))
        for ids in set(running) - ran:
            self.instances.updateValue((",".join(map(str, ids)),), (running[ids],))
        first = min((e[2] for e in events.values() if e[2] < MAX_TIME), default=None) if self.timed else None
        if first is not None:
            waits = None if fired else self.timer.get()
            if waits is None or first < waits[0]:
                _timer(self.handle, first)
                self.timer.update((first,))
        elif fired:
            self.timer.clear()

    @staticmethod
    def _close(running, id_, time, out):
        for ids in [i for i in running if id_ in i]:
            out.append(("done", ids, time, [], []))
            del running[ids]

    @staticmethod
    def _rows(key, out):
        def told(x):  # what is not known is null
            return None if x is None or x != x else x
        for kind, ids, time, vals, members in out:
            yield Row(key=key[0], kind=kind, instance_id=",".join(map(str, ids)), ids=list(ids), time=told(time),
                      values=[v and [told(x) for x in v] for v in vals], members=[(g, i, [told(x) for x in v]) for g, i, v in members])

    def handleInputRows(self, key, rows, timerValues):
        events, running, stored, ran = self._load()
        out = []
        leads = {}
        for ids in running:
            leads.setdefault(ids[0], []).append(ids)
        changes = sorted((tuple(r[c] for c in ONLINE_COLUMNS) for r in rows), key=lambda r: (r[1] is None, r[1] or 0))
        for id_, _, change, *times, value, roles in changes:
            start_time, end_time, time = _numbers(times)
            if change in ("added", "modified"):
                events[id_] = [list(roles), start_time, end_time, events[id_][3] if id_ in events else []]
                if change == "added":
                    for ids in self._begin(events, running, start_time):
                        running[ids] = start_time
                        leads.setdefault(ids[0], []).append(ids)
                        out.append(("init", ids, start_time, [], []))
                elif end_time < MAX_TIME:
                    self._close(running, id_, end_time, out)
            elif change == "removed" and id_ in events:
                self._close(running, id_, end_time, out)
                events.pop(id_)
            elif change == "data_added" and id_ in events:
                events[id_][3] = (events[id_][3] + [(time, _numbers(value))])[-2:]
                for ids in leads.get(id_, ()):
                    if ids in running:
                        self._observe(events, ids, time, out)
        self._save(events, running, stored, ran)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Everything up to the watermark has arrived: events that ended before take part in nothing more."""
        events, running, stored, ran = self._load()
        out, until = [], _watermark(timerValues)
        for id_ in sorted((i for i, e in events.items() if e[2] < until), key=lambda i: (events[i][2], i)):
            self._close(running, id_, events[id_][2], out)
            del events[id_]
        self._save(events, running, stored, ran, fired=True)
        yield from self._rows(key, out)

    def _begin(self, events, running, time):
        """Sets of different events, one for each input, that go on at `time` and are not known yet."""
        sides = [[i for i, e in events.items() if role in e[0] and e[1] <= time <= e[2]] for role in range(self.n_inputs)]
        known = {frozenset(i) for i in running}
        for ids in product(*sides):
            if len(set(ids)) == len(ids) and frozenset(ids) not in known:
                known.add(frozenset(ids))
                yield ids

    def _observe(self, events, ids, time, out):
        if any(i not in events or not events[i][3] for i in ids):
            return  # every input needs a value
        values = [_value(events[i][3], time) if events[i][1] <= time <= events[i][2] else None for i in ids]
        members = []
        for g in range(self.n_groups):
            for i, (roles, start, end, samples) in events.items():
                if self.n_inputs + g in roles and start <= time <= end and samples:
                    members.append((g, i, _value(samples, time)))
        out.append(("observe", ids, time, values, members))


def online_instances(changes: DataFrame, inputs: list[Filter], groups: list[Filter] = (), key=None, lateness: str | None = None, at=None) -> DataFrame:
    """Co-occurrences of the inputs as events and samples arrive.

    Input as for `live_view`, with tags as an array. Output rows: kind `init` when a new set of events goes on at
    the start of one of them, `observe` when its first input gets a sample and all inputs have
    one (values interpolated or extrapolated from each input's last two samples, and those of
    the group members going on), `done` when one of its events ends. `key` is a column that all
    events of an instance share, such as the tag they are bound by; keys are worked on in
    parallel.

    With `lateness` (such as "1 hour") events are forgotten once they ended that long before the newest change, and instances they are
    in are done; changes that come later are dropped. Without it only removed events are forgotten. `at` is the time of a change: that of
    its sample, its event's start when it is added, its event's end when that is known, otherwise null (never late).
    """
    every = [*inputs, *groups]
    tags = F.col("tags")
    roles = F.array_compact(F.array(*[F.when(f.tag_test(tags) & f.time_test(F.col("start_time"), F.col("end_time")), F.lit(i))
                                      for i, f in enumerate(every)]))
    default = F.coalesce(F.when(F.col("change") == "data_added", F.col("time")), F.when(F.col("change") == "added", F.col("start_time")),
                         F.when(F.col("end_time") < MAX_TIME, F.col("end_time")))
    df = changes.select((key if key is not None else F.lit("")).alias("key"), "seq", "id", "change", "start_time", "end_time",
                        "time", "value", roles.alias("roles"), (at if at is not None else default).alias("at"))
    df = df.where((F.col("change") == "data_added") | (F.size("roles") > 0))
    if lateness:
        df = with_lateness(df, "at", lateness)
    use_state_store(df.sparkSession)
    return df.groupBy("key").transformWithState(
        _Online(len(inputs), len(groups), lateness is not None), "key string, kind string, instance_id string, ids array<bigint>, time double, values array<array<float>>, "
                "members array<struct<group_no:int,member_id:bigint,value:array<float>>>", "append", "EventTime" if lateness else "None")


# --- patterns as samples arrive ---------------------------------------------------------------------------

class _Patterns(_Keyed):
    def __init__(self, patterns, warp: float, max_error: float | None):
        self.patterns, self.warp, self.max_error = patterns, warp, max_error

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n bigint")
        self.tail = handle.getListState("tail", "time double, value array<float>")

    def handleInputRows(self, key, rows, timerValues):
        seen = self.seen.get()[0] if self.seen.exists() else 0
        tail = [(r[0], list(r[1])) for r in self.tail.get()] if self.tail.exists() else []
        new = _ordered(rows, ["time"])
        points = tail + [(float(t), [float(x) for x in v]) for t, v in zip(new["time"], new["value"])]
        time, values = [t for t, _ in points], np.array([v for _, v in points], dtype=float)
        offset, out = seen - len(tail), []
        for no, (name, p) in enumerate(self.patterns):
            n = len(p)
            band = int(np.floor(self.warp * n if self.warp <= 1 else self.warp))
            for end, error, scale in _search(values, name, p, band, self.max_error):
                if end >= len(tail):  # windows of earlier batches were reported then
                    out.append((key[0], name, no, offset + end - n + 1, offset + end, time[end - n + 1], time[end], error, n, scale))
        self.seen.update((seen + len(new),))
        keep = max(len(p) for _, p in self.patterns) - 1
        self.tail.put(points[-keep:])
        yield pd.DataFrame(out, columns=["event_id", "pattern", "pattern_no", "start_pos", "end_pos", "start_time", "end_time",
                                         "error", "length", "scale"])


def pattern_windows(samples: DataFrame, patterns, warp: float, max_error: float | None) -> DataFrame:
    """As `patterns.search`, while samples (event_id, time, value) arrive in order."""
    return _run(samples.select("event_id", "time", "value"), ["event_id"], _Patterns(patterns, warp, max_error),
                "event_id bigint, pattern string, pattern_no int, start_pos bigint, end_pos bigint, "
                "start_time double, end_time double, error double, length int, scale double")
