"""Tags, filters, events, co-occurrence, catalogue and coordinates on small literal tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from chronotag.functions import tags as T
from chronotag.model import MAX_TIME, Store, empty, COORDINATES
from chronotag.operators import attachments, catalog, cooccur, filters, selection, timecoord
from chronotag.operators import events as E
from chronotag.plans import intervals
from chronotag.plans.bounded import small_side
from chronotag.streaming import feeds
from tests.conftest import tagged


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(text):
    return T.lit_tags(text)


def text(spark, column):
    return one(spark, T.to_text(column))


@pytest.mark.parametrize("raw, canonical", [
    ("b=2,a=1", "a=1,b=2"), ("a=2,a=1,a=2", "a=1,a=2"), ("n", "n"), ("n=", "n="), ("p=a/b", "p=a/b"),
    ("k=a%3Db%2C+c/d", "k=a%3Db%2C+c/d"), ("x=1%3A2", "x=1%3A2"), ("", "")])
def test_text_form(spark, raw, canonical):
    assert text(spark, T.from_text(F.lit(raw))) == canonical
    assert T.text_of(T.parse(raw)) == canonical
    assert text(spark, T.from_array(T.to_array(T.from_text(F.lit(canonical))))) == canonical


def test_three_kinds_of_value(spark):
    assert T.parse("a,b=,c=1") == [("a", None), ("b", ""), ("c", "1")]
    row = one(spark, T.from_text(F.lit("a,b=,c=1")))
    assert [(p["name"], p["value"]) for p in row] == [("a", None), ("b", ""), ("c", "1")]


@pytest.mark.parametrize("have, wanted, result", [
    ("a=1,b=2", "a=1", True), ("a=1,a=2", "a=1,a=2", True), ("a=1", "a", True), ("a=1", "b", False), ("a=1", "a=2", False), ("a=1", "", True)])
def test_containment(spark, have, wanted, result):
    assert one(spark, T.contains(lit(have), wanted)) is result
    assert one(spark, T.contains_all(lit(have), lit(wanted))) is result


def test_tag_algebra(spark):
    assert text(spark, T.set_(lit("a=1,a=2,b=3"), lit("a=9"))) == "a=9,b=3"
    assert text(spark, T.add(lit("a=1"), lit("a=0,b=2"))) == "a=0,a=1,b=2"
    assert text(spark, T.remove(lit("a=1,a=2,b=3,c=4"), lit("a=1,b"))) == "a=2,c=4"
    assert text(spark, T.template(lit("a,z=7"), lit("a=1,a=2,b=3"))) == "a=1,a=2,z=7"
    assert text(spark, T.derive(lit("a=1,n=2,a=3"), lit("n,hi=there"))) == "a=1,a=3,hi=there"
    assert text(spark, T.intersect(lit("a=1,b,c=3"), lit("a=1,b=2,c=4"))) == "a=1,b=2"
    assert one(spark, T.value(lit("a=2,a=1"), "a")) == "1"
    assert one(spark, T.value(lit("a=2"), "b")) is None
    assert str(one(spark, T.negative(F.lit(0.0)))) == "0.0"


@pytest.mark.parametrize("spec, result", [
    ("myside=wingman.side", "myside=good"), ("*=wingman.side", "side=good"), ("*=wingman.*", "name=HanSolo,side=good,species=human"),
    ("*=wingman.*,name=Luke", "name=Luke,side=good,species=human"),
    ("name=Luke,My.*=wingman.*", "My.name=HanSolo,My.side=good,My.species=human,name=Luke"),
    ("name=Luke,who=wingman.ID", "name=Luke,who=123"), ("name=Luke,name=wingman.name", "name=HanSolo,name=Luke"),
    ("a=other.b", "a=other.b"), ("a=wingman.none", "a=wingman.none")])
def test_inherited_tags(spark, spec, result):
    src = {"wingman": (lit("side=good,name=HanSolo,species=human"), F.lit(123))}
    assert text(spark, T.inherit(spec, src)) == result


# --- filters ---------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def sets(spark):
    return Store(tagged(spark, [(1, 1.0, 3.0, "set=a"), (2, 4.0, 5.5, "set=a"), (3, 2.0, 4.0, "set=b"), (4, 6.0, 7.0, "set=b"),
                                (5, 1.0, 7.5, "set=c"), (6, 9.0, MAX_TIME, "set=d,set=e"), (7, 0.0, 20.0, "")]))


def ids(df):
    return [r["id"] for r in df.collect()]


def test_find(sets):
    assert ids(filters.find(sets, "set=a")) == [1, 2]
    assert ids(filters.find(sets, "set=a;set=b", filters.by_time(3.0, 4.0))) == [1, 3, 2]
    assert ids(filters.find(sets, filters.by_tags("set=d;set=e"))) == [6]
    assert ids(filters.find(sets, filters.by_tags("set"), filters.by_start(8.0))) == [6]
    assert ids(filters.find(sets, filters.by_ids(3, 1, 99))) == [1, 3]
    assert ids(filters.find(sets, "")) == [7, 1, 5, 3, 2, 4, 6]
    assert ids(E.by_ids_in_order(sets, [3, 1])) == [3, 1]
    with pytest.raises(Exception, match="no event with id 99"):
        E.by_ids_in_order(sets, [3, 99]).collect()


def test_filter_text():
    f = filters.Filter.from_text("IDs:1,2;Schema:x;Start:0;End:9.5;timeCoordinate:timeCoordinate=s;a=1,b;c=2")
    assert f.ids == (1, 2) and f.end == 9.5 and f.time_coordinate == "timeCoordinate=s" and len(f.alternatives()) == 2
    assert filters.Filter.from_text(f.to_text()) == f
    assert f.also(filters.by_start(3)).start == 3
    with pytest.raises(ValueError):
        filters.Filter.from_text("Nonsense:1")


def test_saved_filters(spark, sets):
    saved = spark.createDataFrame([("x", "set=a;set=c"), ("y", "End:1.5"), ("z", "IDs:1,4,6"), ("w", "set,set=d;Start:100"), ("v", "")],
                                  "filter_id string, text string")
    got = {(r["filter_id"], r["id"]) for r in filters.match_saved(sets.events, saved).collect()}
    assert got == {("x", 1), ("x", 2), ("x", 5), ("y", 1), ("y", 5), ("y", 7), ("z", 1), ("z", 4), ("z", 6), ("w", 6)} | {("v", i) for i in range(1, 8)}


def test_next_and_previous(spark):
    s = Store(tagged(spark, [(i, t, t, "x=1") for i, t in enumerate([1.0, 2.0, 3.0, 3.0, 3.0, 4.0])]))
    f = filters.by_tags("x")
    assert E.find_next(s, f, 3.0).first()["start_time"] == 4.0
    assert E.find_prev(s, f, 3.0).first()["start_time"] == 2.0
    assert E.find_next(s, f, 4.0).count() == 0


# --- co-occurrence -------------------------------------------------------------------------------------

def spans(df):
    return sorted((r["start_time"], r["end_time"]) for r in df.collect())


def test_three_sets(sets):
    assert spans(cooccur.concurrent(sets, ["set=a", "set=b", "set=c"], 2.5, 100.0)) == [(2.5, 3.0), (4.0, 4.0)]


def test_alternatives(spark):
    s = Store(tagged(spark, [(1, 1.0, 2.0, "n=red1"), (2, 3.0, 4.0, "n=red2"), (3, 2.0, 7.0, "n=red3"), (4, 1.0, 5.0, "n=blue1"),
                             (5, 1.1, 10.0, "n=blue2"), (6, 11.0, 15.0, "n=blue3")]))
    assert spans(cooccur.concurrent(s, ["n=red1;n=red2", "n=blue1;n=blue2;n=blue3"])) == [(1.0, 2.0), (1.1, 2.0), (3.0, 4.0), (3.0, 4.0)]


def test_each_set_once_and_in_order_of_start(spark):
    s = Store(tagged(spark, [(1, 3.0, 50.0, "dim=2,name=a"), (2, 2.0, 51.0, "dim=2,name=b"), (3, 1.0, 52.0, "dim=2,name=c")]))
    got = [r["ids"] for r in cooccur.concurrent(s, ["dim=2", "dim=2"], with_order=True).orderBy("order").collect()]
    assert got == [[3, 2], [3, 1], [2, 1]]
    assert [r["ids"] for r in cooccur.concurrent(s, ["dim=2"] * 3).collect()] == [[3, 2, 1]]
    left = cooccur.concurrent(s, ["dim=2", "dim=2"], skip=spark.createDataFrame([([1, 3],)], "ids array<bigint>"))
    assert sorted(r["ids"] for r in left.collect()) == [[2, 1], [3, 2]]


def test_binding(spark):
    s = Store(tagged(spark, [(1, 0.0, 9.0, "t=plane,sign=joe"), (2, 0.0, 9.0, "t=tank,sign=joe"), (3, 0.0, 9.0, "t=tank,sign=fred"),
                             (4, 0.0, 9.0, "t=ship,sign=fred,sign=joe")]))
    assert [r["ids"] for r in cooccur.concurrent(s, ["t=plane,sign", "t=tank,sign="]).collect()] == [[1, 2]]
    assert [r["ids"] for r in cooccur.concurrent(s, ["t=plane", "t=ship,sign="]).collect()] == [[1, 4]]
    with pytest.raises(ValueError):
        cooccur.concurrent(s, ["t=tank,sign="])


def test_open_events_meet(spark):
    s = Store(tagged(spark, [(1, 0.0, MAX_TIME, "x=1"), (2, 1e9, MAX_TIME, "x=2"), (3, -5.0, -1.0, "x=2")]))
    assert [(r["start_time"], r["ids"]) for r in cooccur.concurrent(s, ["x=1", "x=2"]).collect()] == [(1e9, [1, 2])]


def test_permutations(spark):
    big = F.array(F.lit("a=1,b=2"), F.lit("a=2,c=3"))
    assert one(spark, cooccur.permutation_covers(big, ["c=3", "a=1"])) is True
    assert one(spark, cooccur.permutation_covers(big, ["a=1", "b=2"])) is False
    assert one(spark, cooccur.permutation_covers(big, ["a=1"])) is False


def test_gathered_tags(spark):
    s = tagged(spark, [(1, 5.0, 5.0, "who=x"), (2, 50.0, 50.0, "who=x"), (3, 5.0, 5.0, "who=y"), (10, 0.0, 9.0, "who=x,mood=good"),
                       (11, 1.0, 9.0, "who=x,mood=bad"), (12, 0.0, 9.0, "who=y")])
    out = cooccur.gather_tags(s.where("id < 10"), s.where("id >= 10"), ["who"], ["mood"])
    assert {r["id"]: r["t"] for r in out.select("id", T.to_text(F.col("tags")).alias("t")).collect()} == {
        1: "mood=good,who=x", 2: "who=x", 3: "who=y"}


# --- catalogue --------------------------------------------------------------------------------------------

def test_combinations(spark):
    texts = ["x=1,y=1", "x=1,y=2", "x=1,y=2", "x=1,y=2,z=1", "x=2,y=2", "x=2,y=3", "y=4,z=2", "y=3,r=1"]
    ev = tagged(spark, [(i, 0.0, 1.0, t) for i, t in enumerate(texts)])

    def counts(df):
        return [(r["t"], r["n"]) for r in df.select(T.to_text(F.col("tags")).alias("t"), "n").collect()]
    assert counts(catalog.combinations(ev, ["y"], "x=1")) == [("x=1,y=2", 3), ("x=1,y=1", 1)]
    assert counts(catalog.combinations(ev, [], "x=2")) == [("x=2", 2)]
    assert counts(catalog.combinations(ev, [])) == [("", 8)]
    assert counts(catalog.combinations_of(ev, "y,x=1")) == [("x=1,y=2", 3), ("x=1,y=1", 1)]
    double = tagged(spark, [(1, 0.0, 1.0, "a=1,b=1,b=2"), (2, 0.0, 1.0, "a=2,b=2,b=3,b=4")])
    assert sorted(counts(catalog.combinations(double, ["b", "b"]))) == [("b=1,b=2", 1), ("b=2,b=3", 1), ("b=2,b=4", 1), ("b=3,b=4", 1)]
    assert [r["name"] for r in catalog.tag_names(ev).collect()] == ["r", "x", "y", "z"]


def test_tagset_order(spark):
    ev = tagged(spark, [(1, 0.0, 1.0, "x=0,y=1,z=0"), (2, 0.0, 1.0, "x=1,y=0,z=1"), (3, 0.0, 1.0, "x=10,y=0"), (4, 0.0, 1.0, "y=0")])
    assert [(r["y"], r["x"]) for r in catalog.sorted_tagsets(ev, ["y", "x"]).collect()] == [("0", "1"), ("0", "10"), ("1", "0")]
    assert ids(catalog.order_by_tags(ev, ["x"])) == [4, 1, 2, 3]
    assert ids(catalog.order_by_tags(ev, None, False, "start_time"))[0] == 4


# --- coordinates -------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def coords(spark):
    c = empty(spark, COORDINATES)
    for tags, m, b in [("timeCoordinate=millisecondsUTC", 1000.0, 0.0), ("timeCoordinate=sessionSeconds,session=1", 1.0, -100.0),
                       ("timeCoordinate=sessionSeconds,session=2", 1.0, -200.0), ("timeCoordinate=secondsSinceMidnight", 1.0, 0.0),
                       ("timeCoordinate=minAfterHour,hour=1am", 1 / 60, -60.0), ("timeCoordinate=minAfterHour,hour=2am", 1 / 60, -120.0)]:
        c = timecoord.define(c, tags, m, b)
    return c


def test_conversion(spark, coords):
    def convert(t, a, b):
        df = spark.range(1).select(F.lit(t).alias("t"))
        return timecoord.convert(df, coords, "t", lit(a), lit(b)).first()["converted"]
    assert convert(100000.0, "timeCoordinate=millisecondsUTC", "timeCoordinate=sessionSeconds,session=1") == pytest.approx(0.0)
    assert convert(300000.0, "timeCoordinate=millisecondsUTC,session=2", "timeCoordinate=sessionSeconds") == pytest.approx(100.0)
    with pytest.raises(Exception, match="no time coordinate"):
        convert(1.0, "timeCoordinate=millisecondsUTC", "timeCoordinate=sessionSeconds")
    with pytest.raises(ValueError):
        timecoord.define(coords, "timeCoordinate=sessionSeconds,other=1", 1.0, 0.0)
    assert timecoord.delete(coords, "session=1").count() == 5


def moved_matches(events, coords, f):
    """Ids of the events a filter with a coordinate finds, one by one: (id, start, end, tags) and {tags: (slope, intercept)}."""
    def line(own, other):
        own, other = dict(T.parse(own)), dict(T.parse(other))
        for tags, ab in coords.items():
            named = dict(T.parse(tags))
            if all(own.get(n, None if n == "timeCoordinate" else other.get(n)) == v for n, v in named.items()):
                return ab
        raise KeyError(own)

    out = set()
    for id_, start, end, tags in events:
        have = set(T.parse(tags))
        if f.tags and not any({(n, v) for n, v in t} <= have for t in f.tags) or f.ids and id_ not in f.ids:
            continue
        if f.start is not None or f.end is not None:
            (a, b), (c, d) = line(tags, f.time_coordinate), line(f.time_coordinate, tags)
            start, end = c * (start - b) / a + d, end if end == MAX_TIME else c * (end - b) / a + d
        if (f.start is None or end >= f.start) and (f.end is None or start <= f.end):
            out.add(id_)
    return out


KNOWN = {"timeCoordinate=utc": (1.0, 0.0), "timeCoordinate=own,who=a": (1.0, -100.0), "timeCoordinate=own,who=b": (2.0, 50.0),
         "timeCoordinate=down": (-1.0, 1000.0)}
MOVED = ["timeCoordinate:timeCoordinate=own;Start:10;End:30;kind=1;kind=2", "Start:0;timeCoordinate:timeCoordinate=own,who=a;IDs:1,2,3,4,5,6,7,8",
         "End:60;timeCoordinate:timeCoordinate=own", "Start:120;End:150;timeCoordinate:timeCoordinate=utc", "timeCoordinate:timeCoordinate=down;Start:860;End:880",
         "timeCoordinate:timeCoordinate=own;kind=1", "timeCoordinate:timeCoordinate=own,who=b;Start:350;IDs:2,4,30,31", "Start:130;End:120;timeCoordinate:timeCoordinate=utc"]


@pytest.fixture(scope="module")
def moved(spark):
    rows = [(i, 90.0 + 3 * i, MAX_TIME if i % 11 == 5 else 90.0 + 3 * i + i % 9, f"kind={i % 3},timeCoordinate=utc,who={'ab'[i % 2]}") for i in range(60)]
    c = empty(spark, COORDINATES)
    for tags, (m, b) in KNOWN.items():
        c = timecoord.define(c, tags, m, b)
    return rows, Store(tagged(spark, rows), time_coordinates=c)


def test_saved_filters_by_time_coordinate(spark, moved):
    rows, store = moved
    saved = spark.createDataFrame(list(enumerate([*MOVED, "kind=1;End:100"])), "filter_id int, text string")
    got = {(r.filter_id, r.id) for r in filters.match_saved(store.events, saved, store).collect()}
    want = {(n, i) for n, text in enumerate(MOVED) for i in moved_matches(rows, KNOWN, filters.Filter.from_text(text))}
    assert got == want | {(len(MOVED), i) for i, start, _, tags in rows if "kind=1" in tags and start <= 100}
    assert {n for n, _ in got} == set(range(len(MOVED) + 1))
    # an event without its coordinate raises where a filter would convert it, and only there
    odd = store.with_(events=store.events.unionByName(tagged(spark, [(99, 0.0, 1.0, "kind=7,timeCoordinate=unknown")])))
    assert filters.match_saved(odd.events, saved.where("filter_id = 0"), odd).count() == sum(n == 0 for n, _ in got)
    with pytest.raises(Exception, match="no time coordinate"):
        filters.match_saved(odd.events, saved.where("filter_id = 2"), odd).collect()
    with pytest.raises(ValueError):
        filters.match_saved(store.events, saved, Store(store.events))


@pytest.mark.parametrize("text", [t for t in MOVED if "IDs" not in t])
def test_feeds_by_time_coordinate(spark, moved, text):
    rows, store = moved
    f = filters.Filter.from_text(text)
    want = moved_matches(rows, KNOWN, f)
    got = feeds.change_feed(feeds.inserts(store.events), f, store.time_coordinates)
    assert {(r.id, r.start_time, r.end_time) for r in got.collect()} == {r[:3] for r in rows if r[0] in want}
    # an update that moves the event by a minute
    later = moved_matches([(i, a + 60, b if b == MAX_TIME else b + 60, t) for i, a, b, t in rows], KNOWN, f)
    event = F.struct("id", "start_time", "end_time", "tags")
    moves = F.struct("id", (F.col("start_time") + 60).alias("start_time"),
                     F.when(F.col("end_time") == MAX_TIME, MAX_TIME).otherwise(F.col("end_time") + 60).alias("end_time"), "tags")
    got = feeds.change_feed(store.events.select(F.lit("update").alias("op"), event.alias("before"), moves.alias("after")), f, store.time_coordinates)
    assert {(r.id, r.change) for r in got.collect()} == (
        {(i, "modified") for i in want & later} | {(i, "added") for i in later - want} | {(i, "removed") for i in want - later})
    samples = store.events.select(F.col("id").alias("event_id"), F.lit(1.0).alias("time"))
    assert {r.id for r in feeds.data_feed(samples, store.events, f, store.time_coordinates).collect()} == want
    with pytest.raises(ValueError):
        feeds.change_feed(feeds.inserts(store.events), f)


def test_cooccurrence_in_a_coordinate(spark, coords):
    s = Store(tagged(spark, [(1, 0.0, 61.0, "timeCoordinate=minAfterHour,hour=1am,n=a"), (2, 0.0, 61.0, "timeCoordinate=minAfterHour,hour=2am,n=b")]),
              time_coordinates=coords)

    def both(target):
        r = cooccur.concurrent(s, ["n=a", "n=b"], time_coordinate=target).first()
        return r["start_time"], r["end_time"]
    assert both("timeCoordinate=secondsSinceMidnight") == pytest.approx((7200.0, 7260.0))
    assert both("timeCoordinate=minAfterHour,hour=1am") == pytest.approx((60.0, 61.0))
    assert both("timeCoordinate=minAfterHour,hour=2am") == pytest.approx((0.0, 1.0))
    assert ids(filters.find(s, filters.by_time(7205.0, 7300.0), filters.with_time_coordinate("timeCoordinate=secondsSinceMidnight"))) == [1, 2]
    assert ids(filters.find(s, filters.by_time(7261.0, None), filters.with_time_coordinate("timeCoordinate=secondsSinceMidnight"))) == [2]


# --- changes ---------------------------------------------------------------------------------------------------

def samples(spark):
    return spark.createDataFrame([(1, 1.0, [1.0]), (1, 2.0, [2.0]), (1, 3.0, [3.0]), (2, 4.0, [4.0])], "event_id bigint, time double, value array<float>")


def test_updates(spark, sets):
    s = sets.with_(samples=samples(spark))
    out = E.set_by_id(s, 1, start=1.5, end=2.5, tags="set=z")
    r = out.events.where("id = 1").select("start_time", "end_time", T.to_text(F.col("tags")).alias("t")).first()
    assert tuple(r) == (1.5, 2.5, "set=z")
    assert sorted((r["event_id"], r["time"]) for r in out.samples.collect()) == [(1, 2.0), (2, 4.0)]
    with pytest.raises(KeyError):
        E.set_by_id(s, 99, end=1.0)
    with pytest.raises(ValueError):
        E.set_tags(s, filters.by_ids(1), "set")
    gone = E.delete(s, filters.by_tags("set=a"))
    assert sorted(ids(gone.events)) == [3, 4, 5, 6, 7] and gone.samples.count() == 0
    cut = E.truncate(s, filters.by_tags("set=a"), 2.0, keep="before")
    assert sorted(ids(cut.events)) == [1, 3, 4, 5, 6, 7] and cut.samples.count() == 2
    copy = E.clone(s, [1], 1.5, 9.0, "copy=1")
    assert copy.events.count() == 8 and copy.samples.where("event_id = 8").count() == 2


def test_state_sequence(spark):
    rnd = random.Random(21)
    rows = [(k, t + rnd.random(), rnd.choice(["gear=1", "gear=2", "gear=2,lamp=on"])) for k in ("p", "q") for t in range(60)]
    want = []
    for k in ("p", "q"):
        own = [r for r in rows if r[0] == k]
        starts = [i for i, r in enumerate(own) if i == 0 or own[i - 1][2] != r[2]]
        want += [(k, own[i][1], own[j][1] if j else 100.0, own[i][2]) for i, j in zip(starts, [*starts[1:], None])]
    df = spark.createDataFrame(rows, "who string, time double, info string").repartition(3)
    out = E.state_changes(df, ["who"], end=F.lit(100.0) + F.max("time") * 0)
    assert sorted((r["who"], r["start_time"], r["end_time"], r["info"]) for r in out.collect()) == sorted(want)


@pytest.mark.parametrize("size", [3, 7, 1000])
def test_state_sequence_with_partial_reports(spark, size):
    rnd = random.Random(11)
    states = ["a=1", "a=1,b=1", "a=1,b=1,c=1", "b=1", "a=2", "a=2,b=1", "c=1"]
    rows = [(k, float(t), rnd.choice(states)) for k in "xy" for t in range(80)]
    want = []
    for k in "xy":
        open_ = None
        for _, t, i in [r for r in rows if r[0] == k]:
            if open_ is None or not set(T.parse(i)) <= set(T.parse(open_[1])):
                if open_:
                    want.append((k, open_[1], open_[0], t))
                open_ = (t, i)
        want.append((k, open_[1], open_[0], MAX_TIME))
    df = spark.createDataFrame(rows, "k string, time double, info string")
    assert sorted(map(tuple, E.state_changes_partial(df, ["k"], rows_per_cell=size).collect())) == sorted(want)


def test_blobs(spark, sets):
    s, new = attachments.create_with_blob(sets, 1.0, 2.0, "pic=1", "images", b"abc")
    assert bytes(attachments.get_blob(s, new, "images").first()["data"]) == b"abc"
    again = attachments.attach_blobs(s, spark.createDataFrame([(new, "images", bytearray(b"xyz")), (1, "sound", bytearray(b"s"))],
                                                              "event_id bigint, schema_name string, data binary"))
    assert bytes(attachments.get_blob(again, new, "images").first()["data"]) == b"xyz"
    assert [r["id"] for r in attachments.with_blobs(again, "images", "pic").collect()] == [new]
    again = attachments.attach_table(again, 1, "extra", "t1")
    assert {r["table_name"] for r in attachments.attached_tables(again, 1).collect()} == {"sound", "t1"}
    assert attachments.delete_attachments(again, event_id=1).attachments.count() == 1
    assert attachments.delete_attachments(again, "images").blobs.count() == 1
    assert [r["id"] for r in filters.find(again, filters.by_schema("images")).collect()] == [new]
    with pytest.raises(ValueError):
        attachments.delete_attachments(again)


def test_selection_and_values(spark):
    none = spark.createDataFrame([], selection.SELECTIONS)
    two = spark.createDataFrame([(1,), (2,)], "event_id bigint")
    sel = selection.select(selection.select(none, two, 1.0), spark.createDataFrame([(2,), (3,)], "event_id bigint"), 2.0)
    assert [r["event_id"] for r in selection.selected_ids(sel).collect()] == [1, 2, 3]
    assert selection.unselect(sel, two).count() == 1 and selection.deselect_all(sel).count() == 0
    vals = spark.createDataFrame([("g", "n", 1.0, [1.0]), ("g", "n", 2.0, [1.0]), ("g", "n", 3.0, [5.0])], selection.VALUES)
    latest = selection.latest_values(vals)
    assert selection.value_or(latest, "g", "n", [0.0]).first()["value"] == [5.0]
    assert selection.value_or(latest, "g", "other", [7.0]).first()["value"] == [7.0]
    assert [r["time"] for r in selection.value_changes(vals).orderBy("time").collect()] == [1.0, 3.0]


def test_broadcast_only_when_small(spark):
    df = spark.range(100)
    assert "broadcast" in small_side(df, 100)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in small_side(df, 99)._jdf.queryExecution().analyzed().toString().lower()


def test_store_is_written_and_read(spark, sets, tmp_path):
    s = sets.with_(samples=samples(spark))
    s.write(str(tmp_path / "v1"))
    back = Store.read(spark, str(tmp_path / "v1"))
    assert back.events.count() == 7 and back.samples.count() == 4
    plan = filters.select(back, filters.by_time(3.0, 4.0)).select("id")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(end_time,3.0)" in plan and "LessThanOrEqual(start_time,4.0)" in plan
    assert "ReadSchema: struct<id:bigint,start_time:double,end_time:double>" in plan


def test_updates_and_find_agree_on_every_kind_of_filter(spark):
    from chronotag.operators import filters
    ev = tagged(spark, [(i, float(10 * i), float(10 * i + 5), f"kind={i % 2},timeCoordinate={'a' if i < 4 else 'UTC'}") for i in range(8)])
    store = Store(ev, samples=spark.createDataFrame([(1, 11.0, [1.0]), (6, 61.0, [2.0])], "event_id long, time double, value array<float>"),
                  attachments=spark.createDataFrame([(2, "img", "t"), (5, "img", "t")], "event_id long, schema_name string, table_name string"))
    for f in (filters.by_schema("img"), filters.by_schema("timeseries"), filters.by_schema("img").also(filters.by_tags("kind=1")),
              filters.by_time(20, 40), filters.by_ids(3, 99), filters.by_ids(*range(5, 2000))):
        want = {r.id for r in filters.select(store, f).collect()}
        assert want
        changed = E.set_tags(store, f, "x=9").events
        assert {r.id for r in changed.where(F.exists("tags", lambda t: t["name"] == "x")).collect()} == want
        assert {r.id for r in E.set_end(store, f, 99.5).events.where("end_time = 99.5").collect()} == want
        cut = E.truncate(store, f, 52.0, "before")
        assert {r.id for r in cut.events.collect()} == {i for i in range(8) if i not in want or 10 * i <= 52}
    with pytest.raises(ValueError):
        filters.matches(ev, filters.by_schema("img"))
    saved = spark.createDataFrame([(1, "Schema:img;kind=1"), (2, "Schema:timeseries"), (3, "kind=1;Start:60")], "filter_id long, text string")
    assert {(r.filter_id, r.id) for r in filters.match_saved(ev, saved, store).collect()} == {(1, 5), (2, 1), (2, 6), (3, 7)}
    for wrong in ("timeCoordinate:a;kind=1", "Nonsense:1"):
        with pytest.raises(ValueError):
            filters.match_saved(ev, spark.createDataFrame([(1, wrong)], "filter_id long, text string"), store)


def test_streams_read_folders_of_files(spark, tmp_path):
    from chronotag.streaming import run
    spark.range(30).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    assert run.replay(run.read_table(spark, str(tmp_path), "events.parquet", 1)).count() == 30


def test_tagset_order_by_the_rule(spark):
    import random
    rng = random.Random(12)
    names = [f"n{i}" for i in range(10_000)]
    sets = [sorted({(rng.choice(["a", "b", "c"]), rng.choice(["1", "2", "10", "-3"]) if rng.random() < 0.9 else "x") for _ in range(rng.randrange(4))}) for _ in range(80)]
    sets = [[(n, v) for n, v in s if n != "b" or v != "x"] for s in sets]  # b has numbers only
    sets += [[(n, "7")] for n in names]  # one name each: more names than a plan could hold
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id long, tags array<struct<name:string,value:string>>")

    def values(s, name):
        number = all(v != "x" for t in sets for n, v in t if n == name)
        own = sorted(float(v) if number else v for n, v in s if n == name)
        return (1, own) if own else (0, [])  # a missing name comes first

    def by_all(i):
        own = sorted({n for n, _ in sets[i]})
        return own, [values(sets[i], n) for n in own], i
    want = sorted(range(len(sets)), key=by_all)
    assert [r.id for r in catalog.order_by_tags(df, None, False, "id", names_first=True).collect()] == want
    assert {r.id: r["rank"] for r in catalog.rank_by_tags(df, None, ("id",), names_first=True).collect()} == {i: k + 1 for k, i in enumerate(want)}
    every, few = sorted({n for s in sets[:81] for n, _ in s}), df.where("id < 81")
    got = [r.id for r in catalog.order_by_tags(few, None, False, "id").collect()]
    assert got == sorted(range(81), key=lambda i: ([values(sets[i], n) for n in every], i))
    some = ["c", "zz", "a", "n17"]
    want = sorted(range(len(sets)), key=lambda i: ([values(sets[i], n) for n in some], i))
    assert [r.id for r in catalog.order_by_tags(df, some, False, "id").collect()] == want
    spark.conf.set("chronotag.maxRowsPerKey", "4000")  # several range partitions
    try:
        assert {r.id: r["rank"] for r in catalog.rank_by_tags(df, some, ("id",)).collect()} == {i: k + 1 for k, i in enumerate(want)}
    finally:
        spark.conf.unset("chronotag.maxRowsPerKey")


def test_saved_filter_meets_events_by_its_rarest_pair(spark):
    ev = tagged(spark, [(i, float(i), float(i + 1), f"type=error,user={i}") for i in range(300)] + [(999, 0.0, 1.0, "user=5")])
    saved = spark.createDataFrame([(i, f"type=error,user={i}") for i in range(0, 300, 3)] + [(1000, "user=5"), (1001, "type,user=5"), (1002, "type=none,user=5"), (1003, "type,other")],
                                  "filter_id long, text string")
    got = {(r.filter_id, r.id) for r in filters.match_saved(ev, saved).collect()}
    assert got == {(i, i) for i in range(0, 300, 3)} | {(1000, 5), (1000, 999), (1001, 5)}
    # events that met a filter's rarest pair: not every error for every filter
    asked = saved.select("filter_id", T.from_text(F.col("text")).alias("need")).where("filter_id < 1000")
    plan = filters._by_rarest_need(ev, asked)
    assert plan.count() == 100
    looked_up = {(r.w_name, r.w_value) for r in filters._rarest(ev, asked.withColumn("_no", F.col("filter_id"))).collect()}
    assert looked_up == {("user", str(i)) for i in range(0, 300, 3)}


def test_sets_are_told_once_without_moving_them(spark):
    ev = tagged(spark, [(i, float(i % 7), float(i % 7 + i % 3), "type=click" if i % 3 else "type=error") for i in range(1, 30)])
    store = Store(ev)
    for fs in (["type=click;type=error"] * 2, ["type=click;type=error"] * 3, ["type=click;type=error", "type=error;type=click"], ["type", "type=click", "type=error;type=click"]):
        got = cooccur.concurrent(store, fs, with_order=True)
        assert "min_by" not in got._jdf.queryExecution().analyzed().toString()
        rows = [tuple(sorted(r.ids)) for r in got.collect()]
        assert len(rows) == len(set(rows))
        # with an id twice sets are compared across rows, as before
        twice = cooccur.concurrent(Store(ev.unionByName(ev.where("id = 3"))), fs, with_order=True)
        assert "min_by" in twice._jdf.queryExecution().analyzed().toString()
        assert sorted(map(str, got.collect())) == sorted(map(str, twice.collect()))


def test_sets_of_three_move_no_pairs(spark, monkeypatch):
    rng = random.Random(5)
    inf = float("inf")
    rows = []
    for i in range(60):
        s = rng.choice([rng.uniform(0, 40), float(rng.randrange(40)), 7.0])
        rows.append((i, s, rng.choice([s, s + rng.uniform(0, 6), s + 30, inf, s - 1]), f"t={rng.choice('abc')}"))
    rows += [(None, 3.0, 30.0, "t=a"), (200, None, 30.0, "t=b"), (201, 3.0, None, "t=c"), (4, 1.0, 50.0, "t=b"), (5, 5.0, 9.0, "t=a"), (5, 5.0, 9.0, "t=a"), (202, -inf, 2.0, "t=c")]
    store = Store(tagged(spark, rows))
    side = [[r for r in rows if r[3] == f"t={x}" and None not in r[:3] and r[1] <= r[2]] for x in "abc"]
    want = sorted((max(x[1] for x in r), min(x[2] for x in r), *[x[0] for x in r]) for r in itertools.product(*side)
                  if max(x[1] for x in r) <= min(x[2] for x in r) and len({x[0] for x in r}) == 3)
    assert len(want) > 100

    def no_checkpoint(df):
        raise AssertionError("pairs are written")

    with monkeypatch.context() as m:
        m.setattr(cooccur, "pinned", no_checkpoint)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            got = cooccur.concurrent(store, ["t=a", "t=b", "t=c"])
            assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3  # one for each filter's events
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        # many cells, and cells in slices
        for limit in (200_000, 3):
            m.setattr(intervals, "PER_CELL", 2)
            m.setattr(intervals, "MAX_PER_CELL", limit)
            got = cooccur.concurrent(store, ["t=a", "t=b", "t=c"])
            assert sorted((r.start_time, r.end_time, *r.ids) for r in got.collect()) == want
    assert cooccur.concurrent(store, ["t=x", "t=y", "t=z"]).count() == 0


def test_tagset_order_moves_no_tagsets(spark, monkeypatch):
    rng = random.Random(8)
    texts = [",".join(sorted({f"{rng.choice('abcd')}={rng.choice(['1', '10', '9', 'x'])}" for _ in range(rng.randrange(5))})) for _ in range(60)]
    ev = tagged(spark, [(i, 0.0, 1.0, t) for i, t in enumerate(texts)])
    for options in ({}, {"names_first": True}, {"names": ["c", "z", "a"]}):
        ordered = catalog.tagset_order(ev, **options)
        assert "Exchange hashpartitioning(_text" not in ordered._jdf.queryExecution().executedPlan().toString() and "_text" not in ordered._jdf.queryExecution().analyzed().toString()
        got = {r.id: r["rank"] for r in catalog.rank_by_tags(ev, **options).collect()}
        with monkeypatch.context() as m:
            m.setattr(catalog, "MAX_NAMES", 0)
            assert got == {r.id: r["rank"] for r in catalog.rank_by_tags(ev, **options).collect()}


def test_two_filters_are_joined_by_one_cell(spark, monkeypatch):
    from chronotag.operators import cooccur
    rnd = random.Random(4)
    data = [(i, t, t + rnd.uniform(0, 30), rnd.choice(["type=a", "type=b", "type=a,type=b"])) for i, t in enumerate(rnd.choices(range(60), k=120))]
    store = Store(tagged(spark, [(i, float(s), float(e), tags) for i, s, e, tags in data]))
    monkeypatch.setattr(cooccur, "overlap_join", None)
    got = sorted(tuple(r.ids) for r in cooccur.concurrent(store, ["type=a;type=b", "type=a;type=b"]).collect())

    def rank(d):
        return 0 if "type=a" in d[3] else 1, float(d[1]), d[2], d[0]
    want = sorted(tuple(d[0] for d in sorted((x, y), key=rank)) for k, x in enumerate(data) for y in data[:k] if x[1] <= y[2] and y[1] <= x[2])
    assert got == want
