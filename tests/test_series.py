"""Timeseries, text files, sequences, patterns and learners on small literal tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotag.functions import tags as T
from chronotag.model import MAX_TIME, Store, empty, EVENTS, SAMPLES
from chronotag.operators import filters, learners, patterns, series
from chronotag.operators import sequences as Q
from chronotag.sources import textio
from tests.conftest import tagged

NUMBERS = "event_id bigint, time double, value array<float>"


def store(spark, events, samples):
    return Store(tagged(spark, events), spark.createDataFrame(samples, NUMBERS))


def test_resample(spark):
    s = store(spark, [(1, 0.1, 5.6, "a=1"), (2, 0.7, 3.1, "a=2")],
              [(1, 0.5, [0.5, 5.0]), (1, 2.5, [2.5, 25.0]), (1, 5.5, [5.5, 55.0]), (2, 1.8, [99.0])])
    got = {(r["event_id"], r["time"]): r["value"] for r in series.resample_grid(s, s.events, 0.0, 1.0, 7).collect()}
    assert [got[1, float(t)] for t in range(7)] == [None, [1.0, 10.0], [2.0, 20.0], [3.0, 30.0], [4.0, 40.0], [5.0, 50.0], None]
    assert [got[2, float(t)] for t in range(5)] == [None, [99.0], [99.0], [99.0], None]
    early = spark.createDataFrame([(1, 0.15)], "event_id bigint, time double")
    assert series.value_linear(early, s.samples).first()["value"] == pytest.approx([0.15, 1.5])
    assert series.value_prev(early, s.samples).first()["value"] == [0.5, 5.0]
    table = series.wide(series.resample_grid(s, s.events, 1.0, 1.0, 2), [1, 2])
    assert [tuple(r) for r in table.collect()] == [(1.0, [1.0, 10.0], [99.0]), (2.0, [2.0, 20.0], [99.0])]


def test_nearest(spark):
    s = store(spark, [(1, 0.0, 1.0, "t=1"), (2, 0.0, 1.0, "t=1"), (3, 0.0, 1.0, "t=1"), (4, 2.0, 3.0, "t=1")],
              [(1, 0.0, [0.0]), (2, 0.0, [1.0]), (3, 0.0, [0.0]), (3, 1.0, [1.0]), (4, 2.0, [0.8])])
    got = [(r["id"], r["dist"]) for r in series.nearest(s, "t=1", [0.8], 0.5).collect()]
    assert [g[0] for g in got] == [2, 3, 1] and got[0][1] == pytest.approx(0.2)
    assert series.nearest(s, "t=1", [0.8], 0.5, max_dist=0.25, max_results=3).count() == 1


def brute_decimation(times, delta):
    kept = []
    for t in sorted(times):
        if not kept or t - kept[-1] >= delta:
            kept.append(t)
    return kept


@pytest.mark.parametrize("delta, cell", [(1.0, 8.0), (0.3, 2.0), (7.0, 10.0), (0.1, None)])
def test_decimation(spark, delta, cell):
    rnd = random.Random(4)
    rows = [(e, round(rnd.uniform(0, 60), 1 if e == 1 else 4), [0.0]) for e in (1, 2, 3) for _ in range(250)]
    rows = list({(e, t): (e, t, v) for e, t, v in rows}.values())
    got = series.decimate(spark.createDataFrame(rows, NUMBERS), delta, cell)
    want = sorted((e, t) for e in (1, 2, 3) for t in brute_decimation([t for f, t, _ in rows if f == e], delta))
    assert sorted((r["event_id"], r["time"]) for r in got.collect()) == want


@pytest.mark.parametrize("block", [1, 5])
def test_decimation_by_composed_step_tables(spark, block):
    rnd = random.Random(14)
    rows = [(1, i * 0.26 + rnd.uniform(0, 0.2), [0.0]) for i in range(1200)] + [(2, 40.0 * i + rnd.uniform(0, 30), [0.0]) for i in range(30)]
    got = series.decimate(spark.createDataFrame(rows, NUMBERS), 1.0, 4.0, block)
    want = sorted((e, t) for e in (1, 2) for t in brute_decimation([t for f, t, _ in rows if f == e], 1.0))
    assert sorted((r["event_id"], r["time"]) for r in got.collect()) == want


def test_decimation_of_a_long_gapless_series(spark):
    times = spark.range(1_000_000).select(F.lit(1).cast("bigint").alias("event_id"), (F.col("id") * 0.37).alias("time"), F.array(F.lit(0.0).cast("float")).alias("value"))
    got = series.decimate(times, 1.0, 500.0, 32)
    want = brute_decimation([i * 0.37 for i in range(1_000_000)], 1.0)
    assert tuple(got.agg(F.count("time"), F.max("time")).first()) == (len(want), want[-1])
    assert [r["time"] for r in got.where("time > 300000 and time < 300100").orderBy("time").collect()] == [t for t in want if 300000 < t < 300100]


def test_adding_samples(spark):
    s = Store(empty(spark, EVENTS), empty(spark, SAMPLES))
    s, found = series.add_sample_by_tags(s, "a=1", 1.0, [5.0])
    assert found == 0
    s, found = series.add_sample_by_tags(s, "a=1", 1.2, [6.0], min_delta=0.5)
    assert found == 1
    s, found = series.add_sample_by_tags(s, "a=1", 1.5, [7.0], min_delta=0.5, move_end=True)
    assert [(r["time"], r["value"]) for r in s.samples.orderBy("time").collect()] == [(1.0, [5.0]), (1.5, [7.0])]
    assert [(r["start_time"], r["end_time"]) for r in s.events.collect()] == [(1.0, 1.5)]


# --- text ------------------------------------------------------------------------------------------------

def put(spark, tmp_path, text, store_=None, **options):
    path = tmp_path / f"in{len(list(tmp_path.iterdir()))}.txt"
    path.write_text(text)
    return textio.put(store_ or Store(empty(spark, EVENTS), empty(spark, SAMPLES)), str(path), **options)


def listing(s):
    n = s.samples.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    rows = s.events.join(n, F.col("id") == F.col("event_id"), "left").select(
        "start_time", "end_time", T.to_text(F.col("tags")).alias("t"), F.coalesce("n", F.lit(0)).alias("n"))
    return sorted(map(tuple, rows.collect()))


def test_reading(spark, tmp_path):
    s = put(spark, tmp_path, "variable=x,n=1,start=0.5\n1,11,12\n2,21,22\n3\n\nvariable=emptyTimeSeries\n3.5\n"
                             "variable=event,time=123\nvariable=x,n=2\n4,11,12\n5,22,22\nlost=1\n")
    assert listing(s) == [(0.5, 3.0, "n=1,variable=x", 2), (3.5, 3.5, "variable=emptyTimeSeries", 0), (4.0, 5.0, "n=2,variable=x", 2),
                          (123.0, 123.0, "variable=event", 0)]


def test_reading_mixed_lines(spark, tmp_path):
    s = put(spark, tmp_path, "joe a=1\nbob b=1\njoe 0,1\nbob 0,2\nbob +c=2\njoe 1,3\njoe 1.2,9\njoe\nbob 1,4\nbob\n", mux=True,
            add_tags="src=test", rate_limit=0.5)
    assert listing(s) == [(0.0, 1.0, "b=1,c=2,src=test", 2), (0.0, 1.2, "a=1,src=test", 2)]


def test_reading_only_new_ones(spark, tmp_path):
    s = put(spark, tmp_path, "a=1,b=2,start=0,end=1\na=1,start=2,end=3\nc=1,start=4,end=5\n", unique=True)
    assert [t for *_, t, _ in listing(s)] == ["a=1,b=2", "c=1"]
    s = put(spark, tmp_path, "c=1,start=7,end=8\nd=1,start=7,end=8\n", s, unique=True)
    assert [t for *_, t, _ in listing(s)] == ["a=1,b=2", "c=1", "d=1"]


def test_reading_errors(spark, tmp_path):
    with pytest.raises(Exception, match="without a tag line"):
        listing(put(spark, tmp_path, "a=1\n1,2\n\n3,4\n"))
    with pytest.raises(Exception, match="time and start or end"):
        listing(put(spark, tmp_path, "a=1,time=3,end=4\n"))


@pytest.fixture(scope="module")
def planes(spark):
    samples = [(1, 10.0, [13.0, 13.1]), (1, 20.0, [23.0, 23.1]), (1, 31.0, [34.0, 34.1]), (2, 10.0, [12.0, 12.1]), (2, 20.0, [22.0, 22.1]),
               (2, 30.0, [32.0, 32.1]), (3, 10.0, [11.0, 11.1]), (3, 20.5, [21.0, 21.1]), (3, 30.0, [31.0, 31.1])]
    return store(spark, [(1, 3.0, 50.0, "name=a,dim=2"), (2, 2.0, 51.0, "name=b,dim=2"), (3, 1.0, 52.0, "name=c,dim=2")], samples)


def lines(df):
    return [r["value"] for r in df.collect()]


def test_writing(planes):
    assert lines(textio.export(planes, ["dim=2"], tags_only=True)) == [
        "dim=2,end=52.0,name=c,start=1.0", "dim=2,end=51.0,name=b,start=2.0", "dim=2,end=50.0,name=a,start=3.0"]
    assert lines(textio.export(planes, ["dim=2", "dim=2"], tags_only=True)) == [
        "dim=2,end=51.0,name=c,start=2.0 dim=2,end=51.0,name=b,start=2.0", "dim=2,end=50.0,name=c,start=3.0 dim=2,end=50.0,name=a,start=3.0",
        "dim=2,end=50.0,name=b,start=3.0 dim=2,end=50.0,name=a,start=3.0"]
    assert lines(textio.export(planes, ["name=a", "name=b;name=c"], tags_only=True)) == [
        "dim=2,end=50.0,name=a,start=3.0 dim=2,end=50.0,name=b,start=3.0", "dim=2,end=50.0,name=a,start=3.0 dim=2,end=50.0,name=c,start=3.0"]


def test_writing_samples(planes):
    assert lines(textio.export(planes, ["dim=2", "dim=2"], times=False)) == [
        "dim=2,name=c dim=2,name=b", "10.0,11.0,11.1 10.0,12.0,12.1", "20.5,21.0,21.1 20.5,22.5,22.6", "30.0,31.0,31.1 30.0,32.0,32.1", "",
        "dim=2,name=c dim=2,name=a", "10.0,11.0,11.1 10.0,13.0,13.1", "20.5,21.0,21.1 20.5,23.5,23.6", "30.0,31.0,31.1 30.0,33.0,33.1", "",
        "dim=2,name=b dim=2,name=a", "10.0,12.0,12.1 10.0,13.0,13.1", "20.0,22.0,22.1 20.0,23.0,23.1", "30.0,32.0,32.1 30.0,33.0,33.1", ""]
    assert lines(textio.export(planes, ["name=b"], times=False, id_tag="ID"))[:3] == ["ID=2,dim=2,name=b", "10.0,12.0,12.1", "20.0,22.0,22.1"]
    assert lines(textio.export(planes, ["name=b"], 9.0, 12.0, timestep=10.0, times=False, tabs=True))[:2] == ["Time\tdim=2,name=b", "2.0\t4.0\t4.1000004"]


def test_facts(spark):
    ev = tagged(spark, [(1, 1.0, 2.0, "a=x"), (2, 1.0, MAX_TIME, "a=y,b=z"), (3, 4.0, 4.0, "")])
    assert sorted(lines(textio.facts(ev))) == sorted([
        "evt-start(1, 1.0).", "evt-start(2, 1.0).", "evt-start(3, 4.0).", "evt-end(1, 2.0).", "evt-end(3, 4.0).", "evt-tag(1, 'a', 'x').",
        "evt-tag(2, 'a', 'y').", "evt-tag(2, 'b', 'z').", "evt-next-time(1.0, 4.0)."])


# --- sequences -------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def letters(spark):
    return tagged(spark, [(1, 1.0, 2.0, "a=A,n=1"), (2, 2.0, 3.0, "a=B,n=1"), (3, 3.0, 4.0, "a=C,n=1"), (4, 4.0, 5.0, "a=A,n=2"),
                          (5, 15.0, 16.0, "a=B,n=2"), (6, 16.0, 17.0, "a=C,n=2"), (7, 17.0, 18.0, "a=C,n=2"), (8, 18.0, 19.0, "foo=bar")])


def sizes(df, *keys):
    return sorted(r["count"] for r in df.groupBy(*keys).count().collect())


def test_sequences(letters):
    seq, keys = Q.build(letters)
    assert sizes(Q.split_on_timeout(seq, keys, 5.0), "c0", "part") == [4, 4]
    seq, keys = Q.build(letters, ["n"], "a")
    parts = Q.split_on_timeout(seq, keys, 5.0)
    assert sizes(parts, "c0", "part") == [1, 3, 3]
    out = Q.summarize(parts, ["c0", "part"], "n,hi=there,parentEvent").select("start_time", "end_time", T.to_text(F.col("tags")).alias("t"))
    assert sorted(map(tuple, out.collect())) == [(1.0, 4.0, "a=A,a=B,a=C,hi=there"), (4.0, 5.0, "a=A,hi=there"), (15.0, 18.0, "a=B,a=C,hi=there")]
    double = Q.build(letters.limit(0).unionByName(letters.where("id = 1")), ["n", "n"])[0]
    assert double.count() == 0


def test_gaps(spark):
    ev = tagged(spark, [(1, 1.0, 3.0, "n=1"), (2, 2.0, 4.0, "n=2"), (3, 5.0, 6.0, "n=3"), (4, 2.0, 3.0, "n=4")])
    seq, keys = Q.build(ev)

    def found(*a):
        return sorted(tuple(r) for r in Q.gaps(seq, keys, *a).select("start_time", "end_time", T.to_text(F.col("tags")).alias("t")).collect())
    assert found(0.0, 10.0, 0.5, None) == [(0.0, 1.0, "n=1"), (4.0, 5.0, "n=2"), (6.0, 10.0, "n=3")]
    assert found(None, None, None, "n=0,gap=yes") == [(4.0, 5.0, "gap=yes,n=0")]
    assert found(4.5, 5.5, None, None) == [(4.5, 5.0, "n=2")]
    assert Q.gap_of_nothing(spark, 0.0, 1.0, "x=1").count() == 1


def test_phases(spark):
    ev = tagged(spark, [(1, 1.0, 3.0, "p=2,g=a"), (2, 0.0, 1.0, "p=10,g=a"), (3, 9.0, 14.0, "p=2,g=b"), (4, 20.0, 21.0, "p=1,g=b")])
    seq, keys = Q.build(ev, ["g"])
    out = Q.phases(seq, keys, ["p"], stack=True).select("id", "start_time", "end_time", "phase")
    assert [tuple(r) for r in out.collect()] == [(1, 1.0, 3.0, 1), (2, 6.0, 7.0, 2), (4, 0.0, 1.0, 0), (3, 1.0, 6.0, 1)]


def test_regex(spark):
    words = ["happy", "birthday", "to", "you", None, "happy", "birthday", "to", "you", None, "happy", "birthday", "dear", "hailey", None,
             "happy", "birthday", "to", "you"]
    t, rows = 0.0, []
    for w in words:
        if w is None:
            t += 6
        else:
            rows.append((len(rows), t, t + 1, f"word={w}"))
            t += 2
    seq, keys = Q.build(tagged(spark, rows))
    verses = Q.split_on_timeout(seq, keys, 5.0)

    def found(pattern, groups=(0,)):
        return sorted(tuple(r) for r in Q.regex(verses, ["c0", "part"], "word", pattern, groups).select("part", "group", "first", "last").collect())
    assert found("dear") == [(2, 0, 2, 2)]
    assert found(".*dear.*") == [(2, 0, 0, 3)]
    assert found("rh") == [(2, 0, 2, 3)] and found("yb") == [(0, 0, 0, 1), (1, 0, 0, 1), (2, 0, 0, 1), (3, 0, 0, 1)]
    assert found("(birthday.*(you|hailey))", (1, 2)) == sorted([(p, g, a, 3) for p in range(4) for g, a in ((1, 1), (2, 3))])


# --- patterns -----------------------------------------------------------------------------------------------------

def test_pattern(spark):
    found = patterns.load(spark.createDataFrame([("L", float(i), v) for i, v in enumerate([[0.0, 1.0], [0.0, 0.0], [1.0, 0.0]])],
                                                "name string, time double, value array<double>"))
    data = [(1, float(i), v) for i, v in enumerate([[50.0, 50.0], [60.0, 50.0], [60.0, 40.0], [70.0, 40.0], [80.0, 40.0]])]
    got = patterns.match(spark.createDataFrame(data, NUMBERS), found, 0.1, 1.0).collect()
    assert [(r["start_pos"], r["end_pos"], r["pattern"]) for r in got] == [(1, 3, "L")] and got[0]["error"] == pytest.approx(0.0, abs=1e-8)


def test_slices_of_a_series_give_the_same_windows(spark):
    rng = np.random.default_rng(5)
    data = [(1, float(i), [float(v)]) for i, v in enumerate(rng.normal(size=400).cumsum())]
    smp = spark.createDataFrame(data, NUMBERS)
    shape = [("up", np.arange(8.0)[:, None]), ("hill", np.array([0, 1, 2, 1, 0.0])[:, None])]

    def windows(size):
        return sorted((r["pattern"], r["end_pos"], round(r["error"], 4)) for r in patterns.search(smp, shape, 0.25, 0.06, size).collect())
    assert windows(32) == windows(10_000) and len(windows(32)) > 5
    plain = [(n, e, round(err, 4)) for n, p in shape for e, err, _ in
             patterns._search(np.array([v for _, _, v in data]), n, p, int(0.25 * len(p)), None) if err < 0.06 * len(p)]
    assert sorted(plain) == windows(32)
    best = patterns.best_matches(patterns.search(smp, shape, 0.25, 0.06)).orderBy("start_pos").collect()
    assert all(a["end_pos"] < b["start_pos"] for a, b in zip(best, best[1:]))
    assert best


def test_best_matches_follow_the_rule(spark):
    rng = np.random.default_rng(11)
    rows = []
    for e in (1, 2):
        for no, length in enumerate((4, 7)):
            rows += [(e, f"p{no}", no, i, i + length - 1, float(i), float(i + length - 1), float(rng.integers(1, 6) * length), length, 1.0)
                     for i in range(60) if rng.random() < 0.6]
    got = patterns.best_matches(spark.createDataFrame(rows, patterns.WINDOWS)).collect()
    want = []
    for e in (1, 2):
        own = sorted((r[4], r[2], r[3], r[7] / r[8]) for r in rows if r[0] == e)
        candidates, matches = [], []
        for r in own:
            if all(m[0] < r[2] or m[3] > r[3] for m in candidates):
                candidates.append(r)
        for r in reversed(candidates):
            if all(r[0] < m[2] for m in matches):
                matches.append(r)
        want += [(e, m[0], m[1]) for m in matches]
    assert sorted((r["event_id"], r["end_pos"], r["pattern_no"]) for r in got) == sorted(want) and len(want) > 6
    assert patterns.best_matches(spark.createDataFrame([], patterns.WINDOWS)).count() == 0


def test_alignment(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], [1.0, 1.0, 2.0, 3.0]), (2, [0.0, 5.0], [1.0, 5.0])], "pair_id bigint, a array<double>, b array<double>")
    got = {r["pair_id"]: r for r in patterns.align(df).collect()}
    assert got[1]["distance"] == 0.0 and got[1]["a_index"] == [0, 0, 1, 2] and got[2]["distance"] == 1.0


def test_alignment_is_the_cheapest_path():
    from functools import lru_cache
    rng = np.random.default_rng(12)
    for _ in range(40):
        a, b = (rng.integers(0, 5, rng.integers(1, 9)).astype(float) for _ in range(2))

        @lru_cache(None)
        def least(i, j):
            before = [least(x, y) for x, y in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if x >= 0 and y >= 0]
            return abs(a[i] - b[j]) + min(before, default=0.0)
        distance, ai, bi = patterns._aligned(a, b)
        assert distance == least(len(a) - 1, len(b) - 1) == sum(abs(a[i] - b[j]) for i, j in zip(ai, bi))
        steps = {(x2 - x1, y2 - y1) for x1, x2, y1, y2 in zip(ai, ai[1:], bi, bi[1:])}
        assert steps <= {(1, 1), (1, 0), (0, 1)} and (ai[0], bi[0], ai[-1], bi[-1]) == (0, 0, len(a) - 1, len(b) - 1)


# --- learners -------------------------------------------------------------------------------------------------------

def test_neighbours_in_slices(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(90, 3)), rng.normal(size=90)
    train = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(90)], "train_id bigint, x array<double>, y double")
    query = spark.createDataFrame([(i, (x[i] + 0.1).tolist()) for i in range(30)], "query_id bigint, x array<double>")
    got = learners.nearest_examples(query, train, 4, query_rows=7, train_rows=20)
    want = sorted((q, int(i)) for q in range(30) for i in np.argsort(((x - x[q] - 0.1) ** 2).sum(axis=1), kind="stable")[:4])
    assert sorted((r["query_id"], r["train_id"]) for r in got.collect()) == want
    flat = learners.local_regression(query, train.withColumn("y", F.get("x", F.lit(0)) * 2 + 1), 3, query_rows=8, train_rows=25)
    for r in flat.collect():
        assert r["prediction"] == pytest.approx(2 * (x[r["query_id"]][0] + 0.1) + 1, abs=1e-6)


def test_classifiers(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=2) + (4 if i % 2 else 0)).tolist(), float(i % 2)) for i in range(80)]
    train = spark.createDataFrame(rows, "train_id bigint, x array<double>, y double")
    query = spark.createDataFrame([(0, [0.0, 0.0]), (1, [4.0, 4.0])], "query_id bigint, x array<double>")
    for predict in (learners.tree_predict, learners.bayes_predict):
        assert {r["query_id"]: r["prediction"] for r in predict(query, train).collect()} == {0: 0.0, 1: 1.0}
    assert {r["query_id"]: r["prediction"] for r in learners.svm_predict(query, train).collect()} == {0: -1.0, 1: 1.0}
    assert learners.lookup_predict(spark.createDataFrame([(5, rows[3][1])], "query_id bigint, x array<double>"), train).first()["prediction"] == 1.0
