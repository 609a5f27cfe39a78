"""Feature stages, jobs and streams on small literal tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronotag.functions import tags as T
from chronotag.functions import vectors as V
from chronotag.model import MAX_TIME, Store
from chronotag.operators import features as X
from chronotag.operators import filters, jobs, patterns
from chronotag.operators.features import Chain, Observations
from chronotag.plans.durable import pinned
from chronotag.plans.sequential import small_batches
from chronotag.streaming import feeds, run, stateful
from tests.conftest import tagged

ROWS = "instance_id bigint, time double, x array<float>"


def observe(spark, rows, limit=None, **extra):
    df = spark.createDataFrame(rows, ROWS).withColumns({k: F.lit(v) for k, v in extra.items()})
    return Observations.of(df, limit=limit)


def column(obs, name):
    return [None if r[name] is None else [round(v, 5) for v in r[name]] for r in obs.df().orderBy("instance_id", "time").collect()]


def test_speed_and_turn_rate(spark):
    obs = observe(spark, [(1, 1.0, [0.0, 0.0]), (1, 1.5, [0.0, 1.0]), (1, 2.5, [2.0, 1.0]), (2, 1.0, [0.0, 0.0])])
    assert column(X.speed("s", "x").apply(obs), "s") == [[2.0], [2.0], [2.0]]
    path = [(0.0, 0, 0), (1.0, 1, 0), (2.0, 1, 1), (3.0, 2, 1), (3.5, 2, 0), (4.5, 1, 0)]  # right, up, right, down in half the time, left
    obs = observe(spark, [(1, t, [float(a), float(b)]) for t, a, b in path])
    pi = round(math.pi, 5)
    assert column(X.turn_rate("w", "x").apply(obs), "w") == [[round(math.pi / 2, 5)]] * 3 + [[round(-math.pi / 2, 5)], [-pi], [round(-math.pi / 2, 5)]]


def test_pace_over_a_distance(spark):
    rows = [(1, t, [d]) for t, d in [(1000.0, 100.0), (1006.0, 104.0), (1018.0, 114.0), (1020.0, 114.0), (1030.0, 144.0)]]
    for limit in (None, 2):
        obs = observe(spark, rows, limit)
        assert column(X.derivative("pace", "time", "x", 10.0, drop=False).apply(obs), "pace") == [None, None, [1.2], [1.4], [round(1 / 3, 5)]]
    with pytest.raises(Exception, match="falls"):
        X.derivative("p", "time", "x", 1.0).apply(observe(spark, [(1, 0.0, [2.0]), (1, 1.0, [1.0])])).df().collect()


def test_values_ahead_and_before(spark):
    obs = observe(spark, [(1, float(i), [float(i)]) for i in range(2, 7)])
    out = Chain(X.future_value("one", "x", 1), X.future_value("three", "one", 2)).run(obs)
    assert (column(out, "x"), column(out, "one"), column(out, "three")) == ([[2.0], [3.0]], [[3.0], [4.0]], [[5.0], [6.0]])
    assert column(X.feedback("f", "x", [9.0]).apply(obs), "f") == [[9.0], [2.0], [3.0], [4.0], [5.0]]
    assert column(X.feedback("f", "x", None).apply(obs), "f") == [[2.0], [3.0], [4.0], [5.0]]
    assert column(X.running_total("s", "x").apply(obs), "s") == [[2.0], [5.0], [9.0], [14.0], [20.0]]
    assert column(X.rate("r", "x").apply(obs), "r") == [None, [1.0], [1.0], [1.0], [1.0]]
    assert column(X.trajectory("t", "x", 3).apply(obs), "t")[0] == [2.0, 4.0, 6.0]
    with pytest.raises(ValueError):
        X.future_value("a", "x", 0)
    with pytest.raises(ValueError):
        Chain(X.rate("r", "x"), X.speed("r", "x"))


def test_choosing_rows(spark):
    obs = observe(spark, [(1, float(i + 1), [float(v)]) for i, v in enumerate([2, 6, 1, 2, 1])] + [(2, float(i + 4), [float(v)]) for i, v in enumerate([7, 8, 9])])
    got = X.global_minimum("x").apply(obs).df().orderBy("instance_id").collect()
    assert [(r["time"], r["x"], r["start"], r["end"]) for r in got] == [(3.0, [1.0], 3.0, 3.0), (4.0, [7.0], 4.0, 4.0)]
    assert [r["time"] for r in X.observe_once(4.5).apply(obs).df().orderBy("time").collect()] == [5.0, 5.0]
    assert [r["time"] for r in X.observe_timespan(2.5, 2.6).apply(obs).df().orderBy("time").collect()] == [3.0, 4.0]
    for stage, want in [(X.enters_area("x", [6.0], [7.0]), {1, 2}), (X.starts_in("x", [7.0], [None]), {2}), (X.ends_in("x", [None], [1.0]), {1}),
                        (X.observation_gap(1.0), set())]:
        assert {r["instance_id"] for r in stage.apply(obs).df().collect()} == want


def test_runs(spark):
    obs = observe(spark, [(1, 0.0, [0.1]), (1, 1.0, [1.1]), (1, 2.0, [2.1]), (1, 3.0, [3.1])], start=0.0, end=4.0)
    out = X.between("x", 2.0, 14.0).apply(obs).df().orderBy("time").collect()
    assert [(r["time"], r["segment"], r["start"], r["end"]) for r in out] == [(2.0, 1, 1.5, 3.5), (3.0, 1, 1.5, 3.5)]


@pytest.mark.parametrize("past, future, limit", [(1.0, 0.5, None), (None, 1.0, None), (0.7, None, None), (1.0, 0.5, 15), (6.0, 4.0, 15), (None, 1.0, 15), (0.7, None, 15)])
def test_smoothing(spark, past, future, limit):
    rnd = random.Random(8)
    times = sorted(rnd.uniform(0, 40) for _ in range(120))
    rows = [(1, t, [rnd.uniform(0, 9)]) for t in times]
    with small_batches(spark, 40):
        got = column(X.smoothing("s", "x", past, future).apply(observe(spark, rows + [(2, 20.0, [4.0])], limit)), "s")
    assert got.pop() == [4.0]

    def pdf(d, sd):
        return math.exp(-d * d / (2 * sd * sd)) / math.sqrt(2 * math.pi) / sd
    for i, (_, t, _) in enumerate(rows):
        last = next((j for j in range(i, len(rows)) if rows[j][1] - t >= 3 * (future or 0)), len(rows) - 1) if future else i
        first = [j for j in range(len(rows)) if rows[j][1] >= t - 3 * (past or 0)][0]
        total = weight = 0.0
        for j in range(first, last + 1):
            sd = future if j > i or (j == i and past is None) else past
            if sd is not None:
                w = pdf(rows[j][1] - t, sd)
                total, weight = total + w * rows[j][2][0], weight + w
        assert got[i][0] == pytest.approx(total / weight, rel=1e-3)


def test_smoothing_without_values(spark):
    rows = [(1, 0.0, None), (1, 0.1, [2.0, 3.0]), (1, 0.2, [float("nan"), 3.0]), (1, 9.0, None), (1, 9.1, [7.0, 8.0]), (2, 5.0, None)]
    obs = observe(spark, rows, name="kept")
    out = X.smoothing("x", "x", 0.01, 1.0).apply(obs).df()
    got = [r["x"] for r in out.orderBy("instance_id", "time").collect()]
    # the first row at or beyond three deviations ahead counts, although it is far away
    assert got == [[None, pytest.approx(3.0, abs=0.01)], [None, pytest.approx(3.0, abs=0.01)], [None, 3.0], [7.0, 8.0], [7.0, 8.0], None]
    assert out.select("name").distinct().collect()[0][0] == "kept" and set(out.columns) == set(obs.df().columns)
    assert X.smoothing("x", "x", 1.0, 1.0).apply(Observations.of(obs.df().limit(0))).df().count() == 0


def test_chain_is_the_same_for_long_instances(spark):
    rnd = random.Random(9)
    rows = [(k, t, [rnd.uniform(0, 9), rnd.uniform(0, 9)]) for k in (1, 2) for t in sorted({rnd.uniform(0, 50) for _ in range(60 if k == 1 else 8)})]
    stages = Chain(X.rate("r", "x"), X.speed("s", "x"), X.running_total("t", "x", 2), X.between("x", 2.0, None))
    names = ["instance_id", "time", "segment", "start", "end", "r", "s", "t"]

    def result(limit):
        out = stages.run(observe(spark, rows, limit)).df().select(*names).orderBy("instance_id", "time").collect()
        return [tuple([round(v, 3) for v in c] if isinstance(c, list) else c for c in r) for r in out]
    assert result(20) == result(None)


def test_external_program(spark):
    obs = observe(spark, [(1, 1.0, [5.0]), (1, 2.0, [6.0]), (2, 1.0, [7.0])])
    out = X.external("y", "x", ["awk", "-F,", "{print $2*2; fflush()}"]).apply(obs)
    assert column(out, "y") == [[10.0], [12.0], [14.0]]
    assert column(X.column("z", "transform(x, v -> cast(v + 1 as float))").apply(obs), "z") == [[6.0], [7.0], [8.0]]


def geometry(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_geometry(spark):
    v = V.vector
    assert geometry(spark, V.distance(v(0, 0), v(3, 4))) == 5.0
    assert geometry(spark, V.angle_degrees(v(1, 0), v(0, 2))) == pytest.approx(90.0)
    assert geometry(spark, V.haversine(v(0, 0), v(0, 1))) == pytest.approx(111194.9, abs=0.1)
    cpa = geometry(spark, V.closest_approach(v(0, 0), v(1, 0), v(5, 3), None))
    assert (cpa["distance"], cpa["time"], cpa["position_a"]) == (3.0, 5.0, [5.0, 0.0])
    assert geometry(spark, V.closest_approach(v(0, 0), v(-1, 0), v(5, 3), None, False))["time"] == 0.0
    assert geometry(spark, V.salience(v(0, 0), v(-1, 0), v(5, 0))) == pytest.approx((10 * 35) ** 2)
    rel = V.relative_position(v(1, 3), v(1, 1), v(0, 5))
    assert geometry(spark, rel) == pytest.approx([2.0, 0.0], abs=1e-6)
    assert geometry(spark, V.absolute_position(rel, v(1, 1), v(0, 5))) == pytest.approx([1.0, 3.0], abs=1e-6)
    assert geometry(spark, V.identity_map(v(1, 2), 2, 3)) == [1.0, 2.0, 0.0] and geometry(spark, V.linear_map(v(3), 2.0, 1.0)) == [7.0]
    assert geometry(spark, V.follower(v(1, 1), v(2, 0), 0.5)) == [0.0, 1.0]


# --- jobs ---------------------------------------------------------------------------------------------

def series(spark, events, samples):
    return Store(tagged(spark, events), spark.createDataFrame(samples, "event_id bigint, time double, value array<float>"))


def test_batch_with_a_group(spark):
    s = series(spark, [(1, 0.0, 4.0, "color=red,n=1"), (2, 1.0, 4.0, "color=red,n=2"), (3, 1.0, 5.0, "color=blue,n=1"), (4, 2.0, 5.0, "color=blue,n=2")],
               [(1, 1.1, [0.0]), (2, 1.1, [5.0]), (3, 1.1, [1.0]), (3, 5.0, [3.0]), (4, 2.1, [9.0])])
    chain = Chain(X.nearest("near", "red", "blues"))
    obs, inst = jobs.batch(s, {"red": "color=red"}, chain, {"blues": "color=blue"}, timestep=0.5)
    assert inst.count() == 2
    one = obs.df().where("instance_id = '1'").orderBy("time").collect()
    assert [r["time"] for r in one] == [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0]
    assert sum(r["near"] is not None for r in one) == 7 and one[0]["near"] is None
    obs, _ = jobs.batch(s, {"red": "n=1,color=red"}, chain, {"blues": "color=blue"})
    assert [(r["time"], r["near"]) for r in obs.df().collect()] == [(1.1, [1.0])]


def times(spark, **options):
    inst = spark.createDataFrame([("1", 1.0, 4.0, [1])], "instance_id string, start double, end double, ids array<bigint>")
    smp = spark.createDataFrame([(1, float(t), [0.0]) for t in range(0, 7)], "event_id bigint, time double, value array<float>")
    return sorted(r["time"] for r in jobs.observation_times(inst, smp, **options).collect())


def test_observation_times(spark):
    at = dict(interest_start=2.5, interest_end=2.5)
    assert times(spark, **at) == [2.5]
    assert times(spark, **at, warmup=1.0) == [1.0, 2.0, 2.5]
    assert times(spark, **at, warmup=None) == [1.0, 2.0, 2.5]
    assert times(spark, **at, cooldown=None) == [2.5, 3.0, 4.0]
    assert times(spark, interest_start=1.5, interest_end=1.5, cooldown=1.0) == [1.5, 2.0, 3.0]
    assert times(spark, interest_start=2.0, interest_end=3.0) == [2.0, 3.0]
    assert times(spark) == [1.0, 2.0, 3.0, 4.0]
    assert times(spark, timestep=1.5) == [1.5, 3.0]
    assert times(spark, timestep=0.4, interest_start=2.5, interest_end=2.6, warmup=0.5) == pytest.approx([1.7, 2.1, 2.5])


def test_from_one_to_another(spark):
    s = series(spark, [(1, -5.0, 10.0, "x=t"), (2, -5.0, 10.0, "x=3"), (3, -5.0, 10.0, "x=6"), (4, -5.0, 10.0, "x=8")],
               [(1, -5.0, [5.0]), (1, 0.0, [0.0]), (1, 10.0, [10.0]), (2, 0.0, [3.0]), (3, 0.0, [6.0]), (4, 0.0, [8.0])])

    def sizes(**durations):
        chain = Chain(X.from_to("mover", "xs", "xs", 0.1, **durations))
        obs, _ = jobs.batch(s, {"mover": "x=t"}, chain, {"xs": "x"}, timestep=1.0)
        return sorted((r["start"], r["end"], r["count"]) for r in obs.df().groupBy("trip", "start", "end").count().collect())
    assert sizes() == [(3.0, 6.0, 4), (6.0, 8.0, 3)]
    assert sizes(max_duration=2.5) == [(6.0, 8.0, 3)]
    assert sizes(min_duration=2.5) == [(3.0, 6.0, 4)]


def test_problem_sets_and_results(spark):
    sets = spark.createDataFrame([], jobs.PROBLEM_SETS)
    sets = jobs.novel_problem_set(sets, 1, "m", "type,session=", ["type=plane,session=1", "type=tank,session=2"])
    assert [r["input_tags"] for r in sets.collect()] == [["session=,type=plane", "session=,type=tank"]]
    assert jobs.novel_problem_set(sets, 2, "m", "type,session=", ["type=tank", "type=plane"]).count() == 1
    assert jobs.novel_problem_set(sets, 2, "m", "type,session=", ["type=ship", "type=plane"]).count() == 2
    assert jobs.delete_problem_sets(sets, "m").count() == 0
    s = Store(tagged(spark, [(1, 1.0, 2.0, "a=1")]))
    s, new = jobs.record_interaction(s, "click", "ann", 5.0, "on=map")
    assert T.text_of([(p["name"], p["value"]) for p in s.events.where(F.col("id") == new).first()["tags"]]) == "on=map,type=click,user=ann"


# --- streams ---------------------------------------------------------------------------------------------

def stream(spark, tmp_path, df, parts, by):
    """A stream that delivers the rows in several batches in order of a column."""
    rows = pinned(df.withColumn("_n", F.ntile(parts).over(Window.orderBy(by))))
    folder = str(tmp_path / "in")
    for i in range(1, parts + 1):
        rows.where(F.col("_n") == i).drop("_n").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_change_feed(spark):
    def ev(t):
        return (1, 0.0, 1.0, [("k", t)])
    rows = [(1, "insert", None, ev("a")), (2, "insert", None, ev("b")), (3, "update", ev("b"), ev("a")), (4, "update", ev("a"), ev("b")),
            (5, "update", ev("a"), ev("a")), (6, "update", None, ev("a")), (7, "delete", ev("a"), None), (8, "delete", ev("b"), None)]
    got = feeds.change_feed(spark.createDataFrame(rows, feeds.CHANGES), filters.by_tags("k=a")).orderBy("seq").collect()
    assert [(r["seq"], r["change"], r["whole"]) for r in got] == [
        (1, "added", True), (3, "added", False), (4, "removed", False), (5, "modified", False), (6, "modified", False), (7, "removed", True)]


def test_states_over_several_batches(spark, tmp_path):
    rnd = random.Random(22)
    rows = [("m", float(t), rnd.choice(["gear=1", "gear=1,lamp=on", "gear=2", "lamp=on", "gear=2,lamp=off"])) for t in range(40)]
    states = []
    for _, t, info in rows:  # a report that says nothing new continues the state
        if not states or not set(info.split(",")) <= set(states[-1][1].split(",")):
            states.append((t, info))
    df = spark.createDataFrame(rows, "key string, time double, info string")
    out = run.replay(stateful.state_sequence(stream(spark, tmp_path, df, 3, "time")))
    closed = sorted(tuple(r) for r in out.where(~F.col("open")).select("start_time", "end_time", "info").collect())
    assert closed == [(t, u, info) for (t, info), (u, _) in zip(states, states[1:])]
    assert run.newest(out.where("open"), ["key"]).select("start_time", "end_time").first() == (states[-1][0], MAX_TIME)


ONLINE = "seq bigint, id bigint, change string, start_time double, end_time double, text string, time double, value array<float>"


def test_online_instances(spark, tmp_path):
    open_ = MAX_TIME
    data = [("added", 1, 0.0, "color=red", None, None), ("added", 2, 1.0, "color=blue", None, None), ("data_added", 1, 0.0, "", 1.0, [10.0]),
            ("data_added", 2, 1.0, "", 1.0, [20.0]), ("added", 3, 1.0, "color=red", None, None), ("data_added", 3, 1.0, "", 1.0, [15.0]),
            ("data_added", 2, 1.0, "", 2.0, [30.0]), ("data_added", 3, 1.0, "", 3.0, [19.0]), ("added", 4, 4.0, "color=gray", None, None),
            ("data_added", 3, 1.0, "", 4.0, [20.0]), ("data_added", 4, 4.0, "", 5.0, [555.0]), ("data_added", 3, 1.0, "", 5.0, [20.0])]
    rows = [(i, id_, change, start, open_, text, t, v) for i, (change, id_, start, text, t, v) in enumerate(data)]
    rows.append((99, 3, "modified", 1.0, 6.0, "color=red", None, None))
    df = spark.createDataFrame(rows, ONLINE)
    live = stream(spark, tmp_path, df, 4, "seq").withColumn("tags", T.from_text(F.col("text")))
    out = run.replay(stateful.online_instances(live, [filters.by_tags("color=red"), filters.by_tags("color=blue")], [filters.by_tags("color=gray")]))
    rows = out.orderBy("batch", "time").collect()
    assert sorted((r["instance_id"], r["time"]) for r in rows if r["kind"] == "init") == [("1,2", 1.0), ("3,2", 1.0)]
    seen = [(r["time"], r["values"], [(m["member_id"], m["value"]) for m in r["members"]]) for r in rows if r["kind"] == "observe"]
    assert sorted(seen) == [(1.0, [[15.0], [20.0]], []), (3.0, [[19.0], [40.0]], []), (4.0, [[20.0], [50.0]], []), (5.0, [[20.0], [60.0]], [(4, [555.0])])]
    assert [(r["instance_id"], r["time"]) for r in rows if r["kind"] == "done"] == [("3,2", 6.0)]


def test_live_view_and_subscription(spark, tmp_path):
    rows = [(1, 7, "added", 0.0, 9.0, "a=1", None, None), (2, 7, "data_added", 0.0, 9.0, "", 1.0, [1.0]), (3, 7, "data_added", 0.0, 9.0, "", 2.0, [2.0]),
            (4, 7, "data_added", 0.0, 9.0, "", 3.0, [3.0]), (5, 8, "added", 0.0, 9.0, "a=2", None, None), (6, 8, "removed", 0.0, 9.0, "a=2", None, None)]
    df = spark.createDataFrame(rows, ONLINE).withColumnRenamed("text", "tags")
    out = run.newest(run.replay(stateful.live_view(stream(spark, tmp_path, df, 3, "seq"), 2)), ["id"])
    got = {r["id"]: r for r in out.collect()}
    assert got[7]["times"] == [2.0, 3.0] and got[7]["tags"] == "a=1" and got[8]["present"] is False
    seen = []
    q = run.subscribe(stream(spark, tmp_path / "more", df, 1, "seq"), "mine", lambda rows, n: seen.append(rows.count()))
    q.processAllAvailable()
    assert sum(seen) == 6 and run.unsubscribe(spark, "mine") and not run.unsubscribe(spark, "mine")


def test_pattern_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(10)
    data, v = [], 0.0
    for i in range(150):
        v += rnd.uniform(-1, 1)
        data.append((1, float(i), [v]))
    df = spark.createDataFrame(data, "event_id bigint, time double, value array<float>")
    shape = patterns.load(spark.createDataFrame([("up", float(i), [float(i)]) for i in range(6)], "name string, time double, value array<double>"))

    def keys(x):
        return sorted((r["pattern"], r["start_pos"], r["end_pos"], round(r["error"], 6)) for r in x.collect())
    want = keys(patterns.search(df, shape, 0.2, 0.08))
    assert want and keys(run.replay(stateful.pattern_windows(stream(spark, tmp_path, df, 5, "time"), shape, 0.2, 0.08))) == want


def test_group_values_are_made_once_per_time_and_found_by_trees(spark):
    rng = np.random.default_rng(2)
    smp = [(i, float(t), [float(np.float32(v)) for v in rng.integers(0, 30, 2)]) for i in range(300) for t in (0, 10)]
    store = Store(tagged(spark, [(i, 0.0, 10.0, "type=mover" if i < 40 else "type=member") for i in range(300)]),
                  spark.createDataFrame(smp, "event_id long, time double, value array<float>"))
    times = spark.createDataFrame([(f"{i}", float(t)) for i in range(40) for t in (0, 5, 10, 11)], "instance_id string, time double")
    members = jobs.group_members(store, times, "type=member")
    assert members.columns == ["time", "member_id", "value"] and members.count() == 260 * 3
    inst = spark.createDataFrame([(f"{i}", 0.0, 10.0, [i]) for i in range(40)], "instance_id string, start double, end double, ids array<long>")
    obs = jobs.observe(store, inst, ["a"], times, {"g": "type=member"})
    value = {(r.time, r.member_id): r.value for r in members.collect()}
    rows = {(r.instance_id, r.time): (r.a, r.best) for r in X._with(obs.rows, X.nearest_members(obs, "g", "a", 3), ["best"]).df.collect()}
    for (_, t), (a, best) in rows.items():
        if a is None:
            continue
        near = sorted((float(np.hypot(*(np.array(v) - a))), m) for (at, m), v in value.items() if at == t)[:3]
        assert [b.member_id for b in best] == [m for _, m in near]
    assert sum(a is not None for a, _ in rows.values()) == 120


def test_wrong_labels_meet_entities_that_pass_near(spark):
    rng = np.random.default_rng(6)
    series = {i: sorted(rng.choice(1000, rng.integers(1, 6), replace=False).tolist()) for i in range(40)}
    pos = {(i, t): [float(np.float32(v)) for v in rng.uniform(0, 60, 2)] for i, ts in series.items() for t in ts}
    store = Store(tagged(spark, [(i, float(ts[0]), float(ts[-1]), "a=1") for i, ts in series.items()]),
                  spark.createDataFrame([(i, float(t), v) for (i, t), v in pos.items()], "event_id long, time double, value array<float>"))
    # entities that live longer than their samples are extrapolated, one has no end
    entities = [(i, "View" if i % 2 else "Car", -50.0, 1.7976931348623157e308 if i == 7 else 1050.0) for i in range(20, 40)] + [(7, "view", 0.0, 1.7976931348623157e308)]
    labels = [(n, i, "VIEW", float(rng.uniform(series[i][0], series[i][-1]))) for n, i in enumerate(rng.integers(0, 20, 200).tolist())]

    def at(i, t):
        ts = series[i]
        if len(ts) == 1:
            return np.array(pos[i, ts[0]])
        k = min(max(np.searchsorted(ts, t, side="right") - 1, 0), len(ts) - 2)
        a, b = np.array(pos[i, ts[k]]), np.array(pos[i, ts[k + 1]])
        return a + (b - a) * (t - ts[k]) / (ts[k + 1] - ts[k])
    for within in (3.0, 15.0):
        good = {n for n, i, _, t in labels for e, kind, s, z in entities
                if kind.lower() == "view" and s <= t <= z and np.hypot(*(at(i, t) - at(e, t))) <= within}
        df = spark.createDataFrame(labels, "label_id long, track_id long, label string, time double")
        tracks = spark.createDataFrame([(i, i) for i in range(20)], "track_id long, event_id long")
        ents = spark.createDataFrame(entities, "event_id long, type string, start_time double, end_time double")
        assert {r.label_id for r in jobs.wrong_labels(store, df, tracks, ents, within).collect()} == {n for n, *_ in labels} - good
        # what is measured is a small part of all labels with all entities of their type
    assert 0 < len(good) < 200


def test_labels_stop_at_the_first_entity_that_is_near(spark):
    # all entities stand where all labels are: pairs would be 6,000 rows; entities of other types are not cut into pieces
    labels = spark.createDataFrame([(n, "view", float(n), [1.0, 2.0]) for n in range(20)], "label_id long, label string, time double, here array<float>")
    entities = spark.createDataFrame([(i, "View" if i else "car", 0.0, 20.0) for i in range(301)], "event_id long, type string, start_time double, end_time double")
    samples = spark.createDataFrame([(i, t, [1.0, 2.0 + t / 100]) for i in range(301) for t in (0.0, 20.0)], "event_id long, time double, value array<float>")
    rows = jobs._near_entities(labels, entities, samples, 3.0).select("label_id").collect()
    assert {r.label_id for r in rows} == set(range(20)) and len(rows) <= 100


def test_rows_only_meet_members_that_may_be_nearest(spark, monkeypatch):
    for name, n in (("ROW_SLICE", 60), ("MEMBER_SLICE", 100), ("CELL_MEMBERS", 40), ("BLOCK", 3000)):
        monkeypatch.setattr(X, name, n, raising=False)
    rng = np.random.default_rng(3)
    # members at two times and one that is nearly alone, many of them at the same places; one row and one member without a place
    members = [(t, i, [float(np.float32(v)) for v in rng.integers(0, 40, 2)]) for t, n in ((0.0, 1000), (5.0, 150), (7.0, 1)) for i in range(n)]
    members += [(0.0, 5000, [float("nan"), 1.0]), (7.0, 5001, [1.0, 2.0, 3.0])]
    rows = [(f"{i}", t, [float(np.float32(v)) for v in rng.uniform(-5, 45, 2)]) for i in range(200) for t in (0.0, 5.0, 7.0, 9.0)]
    rows += [("far", 0.0, [1e9, -1e9]), ("none", 0.0, [float("nan"), 0.0])]
    df = spark.createDataFrame(rows, "instance_id string, time double, p array<float>")
    group = spark.createDataFrame(members, "time double, member_id long, value array<float>")
    obs = X.Observations.of(df, {"g": group})
    for k in (1, 3):
        got = {(r.instance_id, r.time): [b.member_id for b in r.best] for r in X.nearest_members(obs, "g", "p", k).collect()}
        want = {}
        for i, t, x in rows:
            at = [(d if d == d else np.inf, m) for d, m in ((float(np.sqrt(((np.float32(v) - np.float32(x)).astype(float) ** 2).sum())), m)
                                                            for u, m, v in members if u == t and len(v) == 2)]
            if at:
                want[i, t] = [m for _, m in sorted(at)[:k]]
        assert got == want
    assert X._shared_nearest(obs.rows, group, "p", 1).count() < 2 * len(rows)
