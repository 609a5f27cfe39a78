"""Streams in several batches: late reports, state that shrinks."""

import random

import pytest
from pyspark.sql import functions as F

from chronotag.functions import tags as T
from chronotag.model import MAX_TIME
from chronotag.operators import filters
from chronotag.streaming import run, stateful


def states(reports):
    """(key, info, start, end, open) by walking each key's reports in order of time."""
    out = []
    for key in sorted({k for k, _, _ in reports}):
        now = None
        for _, time, info in sorted((r for r in reports if r[0] == key), key=lambda r: r[1]):
            if now and set(T.parse(info)) <= set(T.parse(now[1])):
                continue
            if now:
                out.append((key, now[1], now[0], time, False))
            now = time, info
        out.append((key, now[1], now[0], MAX_TIME, True))
    return out


@pytest.mark.parametrize("parts", [1, 4])
def test_late_reports_are_put_in_their_place(spark, parts):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), float(10 * i), rng.choice(["s=1", "s=2", "s=1,t=x"])) for i in range(60)]
    # each report arrives up to 300 seconds after its time
    df = spark.createDataFrame([(*r, r[1] + rng.randrange(300)) for r in rows], "key string, time double, info string, arrives double")
    told = run.replay(stateful.state_sequence(run.in_batches(df, "arrives", parts), lateness="5 minutes"))
    got = stateful.current_states(told).select("key", "info", "start_time", "end_time", "open").collect()
    assert sorted(tuple(r) for r in got) == sorted(states(rows))
    if parts > 1:  # some versions were corrected later
        assert told.where("end_time < 1e300").select("key", "no").distinct().count() < told.where("end_time < 1e300").count()


def test_states_that_a_late_report_joins_are_taken_back(spark):
    rows = [("a", 10.0, "s=1", 10.0), ("a", 20.0, "s=1,t=x", 20.0), ("a", 5.0, "s=1,t=x", 30.0)]
    df = spark.createDataFrame(rows, "key string, time double, info string, arrives double")
    told = run.replay(stateful.state_sequence(run.in_batches(df, "arrives", 3), lateness="1 minute"))
    assert [(r.no, r.batch) for r in told.where("info is null").collect()] == [(1, 2)]
    assert [tuple(r) for r in stateful.current_states(told).collect()] == [("a", 0, "s=1,t=x", 5.0, MAX_TIME, True)]


def test_batches_follow_each_other(spark):
    df = spark.createDataFrame([(i, float(i * 37 % 100)) for i in range(100)] + [(100, None)], "id long, t double")
    rows = run.replay(run.in_batches(df, "t", 4)).collect()
    assert sorted(r.id for r in rows) == list(range(101))
    last = -1.0
    for batch in sorted({r.batch for r in rows}):
        times = [r.t for r in rows if r.batch == batch and r.t is not None]
        assert min(times) > last
        last = max(times)
    assert len({r.batch for r in rows}) == 4


def test_ended_events_leave_the_state(spark):
    rows, seq = [], 0
    for i in range(6):  # two events that overlap, a pair after the other; a last change far ahead moves the watermark
        for change, id_, start, end, text, t, v in (
                ("added", 2 * i, 100.0 * i, 100.0 * i + 50, "color=red", None, None), ("added", 2 * i + 1, 100.0 * i + 5, 100.0 * i + 60, "color=blue", None, None),
                ("data_added", 2 * i + 1, 0.0, 0.0, "", 100.0 * i + 10, [1.0]), ("data_added", 2 * i, 0.0, 0.0, "", 100.0 * i + 20, [2.0])):
            rows.append((seq, id_, change, start, end, text, t, v, 100.0 * i + seq % 4))
            seq += 1
    rows.append((seq, 99, "added", 10_000.0, MAX_TIME, "color=none", None, None, 10_000.0))
    df = spark.createDataFrame(rows, "seq long, id long, change string, start_time double, end_time double, text string, time double, value array<float>, arrives double")
    live = run.in_batches(df, "arrives", 4).withColumn("tags", T.from_text(F.col("text")))
    both = [filters.by_tags("color=red"), filters.by_tags("color=blue")]
    # the last change fits no filter but moves the time on
    df = stateful.online_instances(live, [*both], [filters.by_tags("color=none")], lateness="30 seconds")
    out, marks = run.work_folder(spark, "out"), run.work_folder(spark, "marks")
    q = df.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).format("parquet").start(out)
    q.awaitTermination()
    got = spark.read.schema(df.schema).parquet(out).collect()
    kinds = {k: sorted((r.instance_id, r.time) for r in got if r.kind == k) for k in ("init", "observe", "done")}
    assert kinds["init"] == sorted((f"{2 * i},{2 * i + 1}", 100.0 * i + 5) for i in range(6))
    assert kinds["observe"] == sorted((f"{2 * i},{2 * i + 1}", 100.0 * i + 20) for i in range(6))
    assert kinds["done"] == sorted((f"{2 * i},{2 * i + 1}", 100.0 * i + 50) for i in range(6))

    def left(name):
        return spark.read.format("statestore").option("stateVarName", name).load(marks)
    assert left("instances").count() == 0
    assert [r[0] for r in left("events").select("user_map_key.id" if "user_map_key" in left("events").columns else "key").collect()] == [99]


def test_online_events_share_one_timer():
    from pyspark.sql import Row
    forever = MAX_TIME

    class State:
        def __init__(self):
            self.kept, self.value, self.written = {}, None, 0

        def iterator(self):
            return iter(list(self.kept.items()))

        def updateValue(self, key, value):
            self.written += 1
            self.kept[key] = value

        def removeKey(self, key):
            del self.kept[key]

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        timers = []

        def getMapState(self, *_):
            return State()

        def getValueState(self, *_):
            return State()

        def registerTimer(self, ms):
            self.timers.append(ms)

    class Clock:
        ms = 0

        def getCurrentWatermarkInMs(self):
            return self.ms
    handle, clock, work = Handle(), Clock(), stateful._Online(1, 1, True)
    work.init(handle)

    def row(id_, seq, change, end=forever, time=None):
        return Row(id=id_, seq=seq, change=change, start_time=0.0, end_time=end, time=time, value=None if time is None else [time], roles=[int(id_ > 0)])
    rows = [row(i, i, "added") for i in range(20)] + [row(i, 100 + i, "data_added", time=1.0 + i) for i in range(20)] + [row(0, 200, "data_added", time=50.0)]
    out = list(work.handleInputRows(("k",), iter(rows), clock))
    assert work.events.written == 20 and [r.kind for r in out].count("observe") == 2 and len(out[-1].members) == 19
    # all events end: one timer, for the first of them
    out = list(work.handleInputRows(("k",), iter([row(i, 300 + i, "modified", end=60.0 + i) for i in range(20)]), clock))
    assert len(handle.timers) == 1 and [r.kind for r in out] == ["done"]
    clock.ms = int((65.5 + stateful.AHEAD) * 1000)
    assert list(work.handleExpiredTimer(("k",), clock, None)) == [] and len(handle.timers) == 2
    assert sorted(i for i, in work.events.kept) == list(range(6, 20))
    # an event that does not change is not written again
    written = work.events.written
    list(work.handleInputRows(("k",), iter([row(7, 400, "data_added", time=99.0)]), clock))
    assert work.events.written == written + 1 and len(handle.timers) == 2
    clock.ms = int((1000 + stateful.AHEAD) * 1000)
    list(work.handleExpiredTimer(("k",), clock, None))
    assert not work.events.kept and work.timer.value is None and len(handle.timers) == 2


def test_states_are_read_and_kept_once_per_call():
    class Value:
        value, asked = None, 0

        def get(self):
            self.asked += 1
            return self.value

        def update(self, value):
            self.value, self.asked = value, self.asked + 1

    class Handle:
        made, timers = [], []

        def getValueState(self, name, schema):
            self.made.append(Value())
            return self.made[-1]

        def registerTimer(self, time):
            self.timers.append(time)

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    handle, states = Handle(), stateful._States(True)
    states.init(handle)
    one = list(states.handleInputRows(("a",), iter([{"time": 3.0, "info": "x=1"}, {"time": 1.0, "info": "x=2"}]), Times()))
    two = list(states.handleInputRows(("a",), iter([{"time": 2.0, "info": "x=2"}, {"time": 1.0, "info": "x=1"}]), Times()))
    assert [(r.no, r.info, r.start_time, r.open) for r in one] == [(0, "x=2", 1.0, False), (1, "x=1", 3.0, True)]
    assert [(r.no, r.info, r.start_time, r.open) for r in two][-1] == (3, "x=1", 3.0, True)
    assert len(handle.made) == 1 and handle.made[0].asked == 4 and len(handle.timers) == 2
