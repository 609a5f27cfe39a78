"""The plan shapes: split ordering, interval join, as-of lookup."""

import random

import pytest
from pyspark.sql import functions as F

from chronotag.plans.asof import asof, linear, previous
from chronotag.plans.intervals import overlap_join
from chronotag.plans.ordered import Ordered


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(1)
    data = []
    for i in range(600):
        key = "hot" if rnd.random() < 0.6 else rnd.choice("abc")
        data.append((key, float(i // 2) if key == "hot" else rnd.random() * 100, i,
                     rnd.choice([None, rnd.randint(0, 9)])))
    return spark.createDataFrame(data, "k string, t double, id bigint, v bigint").repartition(5)


def everything(o):
    o = o.lag(1, l1=F.col("v")).lag(3, l3=F.col("id")).lead(2, d2=F.col("id"))
    o = o.fill_forward(ff=F.col("v")).fill_forward(inclusive=False, fx=F.col("v")).fill_backward(fb=F.col("v"))
    o = o.running_sum(rs=F.col("v")).running_sum(inclusive=False, rx=F.col("v"))
    o = o.running_max(inclusive=False, rm=F.struct("v", "id")).running_min(mn=F.col("id")).row_number("rn")
    o = o.last_rows(5, s5=F.sum("id"))
    return sorted(map(tuple, o.done().select(
        "k", "t", "id", "l1", "l3", "d2", "ff", "fx", "fb", "rs", "rx", "rm.v", "rm.id", "mn", "rn", "s5").collect()), key=str)


def test_split_keys_give_the_same_answers(rows):
    whole = Ordered(rows, "k", ["t", "id"])
    split = Ordered(rows, "k", ["t", "id"], limit=40)
    assert not whole.split and split.split
    assert split.df.select("_chunk").distinct().count() > 5
    assert everything(whole) == everything(split)


def test_overlap_join_equals_brute_force(spark):
    rnd = random.Random(2)

    def spans(n, prefix):
        out = []
        for i in range(n):
            s = rnd.choice([rnd.uniform(-50, 50), float(rnd.randint(-5, 5)), rnd.uniform(1.6e9, 1.6e9 + 50)])
            length = rnd.choice([0.0, 1e-9, rnd.random(), 8.0, 64.0, rnd.uniform(0, 1000)])
            e = 1.7976931348623157e308 if rnd.random() < 0.05 else s + length
            out.append((i, s, e, rnd.choice("xy")))
        return out

    a, b = spans(150, "a"), spans(170, "b")
    left = spark.createDataFrame(a, "ai bigint, a1 double, a2 double, ak string")
    right = spark.createDataFrame(b, "bi bigint, b1 double, b2 double, bk string")
    for equi in ([], [("ak", "bk")]):
        want = sorted((x[0], y[0]) for x in a for y in b if x[1] <= y[2] and y[1] <= x[2] and (not equi or x[3] == y[3]))
        for limit in (None, 7):
            got = overlap_join(left, right, equi, ("a1", "a2"), ("b1", "b2"), max_per_cell=limit)
            assert sorted(tuple(r) for r in got.select("ai", "bi").collect()) == want


def test_overlap_join_has_no_cross_product(spark):
    left = spark.range(10).selectExpr("id ai", "double(id) a1", "double(id+1) a2")
    right = spark.range(10).selectExpr("id bi", "double(id) b1", "double(id+1) b2")
    plan = overlap_join(left, right, [], ("a1", "a2"), ("b1", "b2"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


@pytest.mark.parametrize("limit", [None, 20])
def test_asof(spark, limit):
    rnd = random.Random(3)
    samples = [(e, t, [float(t * e), 1.0]) for e in (1, 2) for t in sorted({rnd.uniform(0, 10) for _ in range(40)})]
    samples += [(3, 5.0, [7.0, 7.0])]
    probes = [(e, t, i) for i, (e, t) in enumerate(
        [(rnd.choice([1, 2, 3, 4]), rnd.uniform(-2, 12)) for _ in range(100)] + [(1, samples[0][1]), (1, samples[5][1])])]
    s = spark.createDataFrame(samples, "event_id bigint, time double, value array<float>")
    p = spark.createDataFrame(probes, "event_id bigint, time double, n bigint")
    df = asof(p, s, limit=limit)
    got = {r["n"]: r for r in df.select("n", previous(df["at"]).alias("p"), linear(df["at"], df["time"]).alias("l")).collect()}
    assert len(got) == len(probes)
    for e, t, n in probes:
        mine = [(st, v) for se, st, v in samples if se == e]
        if not mine:
            assert got[n]["p"] is None and got[n]["l"] is None
            continue
        before = [v for st, v in mine if st <= t]
        assert got[n]["p"] == pytest.approx((before or [mine[0][1]])[-1], rel=1e-6)
        if e == 3:
            assert got[n]["l"] == [7.0, 7.0]
        else:  # the series are straight lines, inside and outside
            assert got[n]["l"] == pytest.approx([t * e, 1.0], rel=1e-4, abs=1e-4)


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    from chronotag.plans import ordered
    from chronotag.operators import features as X
    from chronotag.operators.features import Observations
    df = spark.createDataFrame([(f"{i % 50}", float(i), [float(i)]) for i in range(1000)], "instance_id string, time double, x array<float>")
    want = {(r.instance_id, r.time): r.s for r in X.smoothing("s", "x", 30.0, 0.0).apply(Observations.of(df)).df().collect()}
    assert Ordered(df, "instance_id", "time").df.rdd.getNumPartitions() == df.rdd.getNumPartitions()
    monkeypatch.setattr(ordered, "TASK_ROWS", 100)
    obs = Observations.of(df)
    assert obs.rows.tasks == 10 and obs.rows.df.rdd.getNumPartitions() == 10
    got = X.smoothing("s", "x", 30.0, 0.0).apply(obs).df()
    assert got.rdd.getNumPartitions() == 10 and {(r.instance_id, r.time): r.s for r in got.collect()} == want


def test_long_line_files_are_read_in_pieces(spark, monkeypatch, tmp_path):
    from chronotag.sources import textio
    text = "".join(f"a={i}\n" + "".join(f"{t},{t * i}\n" for t in range(i % 7)) + f"+b={i % 3}\n\n" for i in range(1, 60))
    (tmp_path / "one.txt").write_text(text)

    def read():
        heads, samples = textio.parse_lines(textio.read_lines(spark, str(tmp_path)))
        return (sorted(map(str, heads.drop("block", "line", "created").collect())), sorted(map(str, samples.collect())))
    want, sizes = read(), []
    whole = textio.Ordered

    def seen(*args, **kw):
        out = whole(*args, **kw)
        sizes.append(out.df.groupBy("_chunk").count().agg({"count": "max"}).first()[0] if out.split else None)
        return out
    monkeypatch.setattr(textio, "Ordered", seen)
    monkeypatch.setattr(textio, "FILE_LINES", 60)
    assert read() == want and sizes[0] is not None and sizes[0] <= 60


def test_rows_back_from_python_are_placed_in_bounded_tasks(spark, monkeypatch):
    from chronotag.operators import features as X
    from chronotag.plans import ordered
    # as many tasks as the session's partitions: AQE would merge them again
    monkeypatch.setattr(ordered, "TASK_ROWS", 1000)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.range(999 * tasks).select((F.col("id") % 50).alias("instance_id"), F.floor(F.col("id") / 50).cast("double").alias("time"), F.array(F.lit(1.0).cast("float")).alias("v"))
    o = X.Chain(X.rate("r", "v"), X.smoothing("s", "r", 0.5, 0.0), X.rate("r2", "s")).run(X.Observations.of(df)).rows
    assert o.tasks == tasks + 1 and o.df.rdd.getNumPartitions() == tasks + 1
    probes = df.select(F.col("instance_id").alias("event_id"), "time")
    assert asof(probes, probes.withColumn("value", F.array(F.lit(1.0).cast("float")))).rdd.getNumPartitions() > tasks
