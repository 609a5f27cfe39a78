"""The SQL functions give what the Python operators give."""

import pytest

from chronotag.functions import sql
from chronotag.model import Store
from chronotag.operators import timecoord
from tests.conftest import tagged


@pytest.fixture(scope="module")
def functions(spark):
    events = tagged(spark, [(1, 0.0, 4.0, "a=1,b=x"), (2, 3.0, 9.0, "a=2"), (3, 5.0, 6.0, "a=1")])
    samples = spark.createDataFrame([(1, 1.0, [1.0]), (1, 3.0, [3.0]), (2, 4.0, [7.0])], "event_id bigint, time double, value array<float>")
    coords = tagged(spark, [(1, 1.0, 0.0, "timeCoordinate=utc"), (2, 2.0, -10.0, "timeCoordinate=local,s=1")]).selectExpr(
        "tags", "start_time AS slope", "end_time AS intercept")
    return sql.register(spark, Store(events, samples, coords), "q_")


@pytest.mark.parametrize("text, result", [
    ("q_set_tags('a=1,a=2,b=3', 'a=9')", "a=9,b=3"), ("q_add_tags('a=1', 'b=c d')", "a=1,b=c+d"), ("q_remove_tags('a=1,b=2,c=3', 'a,b=9')", "b=2,c=3"),
    ("q_tagset_from_array(array('b', '2', 'a', '1'))", "a=1,b=2"), ("q_tag_value('a=x%3Dy', 'a')", "x=y"),
    ("q_time_coordinate_from_tagset('timeCoordinate=utc,x=1')", "utc"), ("q_tagset_to_array('b=2,a=1')", ["a", "1", "b", "2"]),
    ("q_distance(array(0F, 0F), array(3F, 4F))", 5.0), ("q_negative_of(0D)", 0.0), ("q_max_double()", 1.7976931348623157e308),
    ("q_interpolate(0D, array(0F), 2D, array(4F), 1D)", [2.0]), ("q_time_to_utc(10D, 'timeCoordinate=local,s=1')", 10.0),
    ("q_time_from_utc(10D, 'timeCoordinate=local,s=1')", 10.0), ("q_convert_time(30D, 'timeCoordinate=local', 's=1,timeCoordinate=utc')", 20.0)])
def test_scalars(spark, functions, text, result):
    assert spark.sql(f"SELECT {text} AS v").first()["v"] == result


@pytest.mark.parametrize("call, ids", [
    ("q_find_events('a=1', NULL, NULL)", [1, 3]), ("q_find_events('a=2;b', 1D, 4D)", [1, 2]), ("q_find_timeseries('a', 0D, 100D)", [1, 2]),
    ("q_find_next_event('a', 0D, 0.1D)", [2]), ("q_find_prev_event('a=1', 5D, 0.1D)", [1]), ("q_event_by_id(3)", [3])])
def test_tables(spark, functions, call, ids):
    assert sorted(r["id"] for r in spark.sql(f"SELECT * FROM {call}").collect()) == ids


def test_values(spark, functions):
    def value(call):
        return spark.sql(f"SELECT value FROM {call}").first()["value"]
    assert value("q_timeseries_value_prev(1, 2.5D)") == [1.0] and value("q_timeseries_value_prev(1, 0D)") == [1.0]
    assert [value(f"q_timeseries_value_linear(1, {t}D)") for t in (2.5, 3.0, 5.0, 0.0)] == [[2.5], [3.0], [5.0], [0.0]]
    assert value("q_timeseries_value_linear(2, 9D)") == [7.0]
    assert sorted(r["name"] for r in spark.sql("SELECT * FROM q_tag_names()").collect()) == ["a", "b"]
    assert len(functions) > 25


def test_concurrent_events(spark, functions):
    def pairs(call):
        return sorted(tuple(r) for r in spark.sql(f"SELECT * FROM {call}").collect())
    assert pairs("q_concurrent_events('a=1', 'a=2', NULL, NULL)") == [(1, 2, 3.0, 4.0), (3, 2, 5.0, 6.0)]
    assert pairs("q_concurrent_events('a', 'a', NULL, NULL)") == [(1, 2, 3.0, 4.0), (2, 1, 3.0, 4.0), (2, 3, 5.0, 6.0), (3, 2, 5.0, 6.0)]
    assert pairs("q_concurrent_events('a', 'a', 5D, 9D)") == [(2, 3, 5.0, 6.0), (3, 2, 5.0, 6.0)]
    assert pairs("q_concurrent_events('a=9', 'a', NULL, NULL)") == []


def test_combinations_resampling_and_nearest(spark, functions):
    def rows(call):
        return sorted(tuple(r) for r in spark.sql(f"SELECT * FROM {call}").collect())
    assert rows("q_tag_combinations('', array('a'))") == [("a=1", 2), ("a=2", 1)]
    assert rows("q_tag_combinations('b', array('a', 'b'))") == [("a=1,b=x", 1)]
    assert rows("q_resample_timeseries('a=1,b', 0D, 2D, 4)") == [(1, 0.0, [0.0]), (1, 2.0, [2.0]), (1, 4.0, [4.0]), (1, 6.0, None)]
    assert rows("q_nearest_timeseries('a', array(7F), 3.5D, NULL)") == [(1, [3.5], 3.5), (2, [7.0], 0.0)]
    assert rows("q_nearest_timeseries('a', array(7F), 3.5D, 1D)") == [(2, [7.0], 0.0)]
