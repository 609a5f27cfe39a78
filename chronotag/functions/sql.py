"""The operators as SQL functions.

`register(spark, store)` makes temporary views of the store's tables and temporary functions over
them, so that a session can say

    SELECT * FROM find_events('type=click', 0D, 100D)
    SELECT set_tags('a=1,b=2', 'a=3'), distance(array(0F, 0F), array(3F, 4F))

All are plain SQL expressions that Catalyst inlines; no Python runs. A prefix keeps the names
apart from others. Tagsets are texts here; a null time bound is open.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from chronotag.model import MAX_TIME, Store

TAGS = "ARRAY<STRUCT<name STRING, value STRING>>"

# Functions cannot be called on the variables of a lambda, so what they share is put together as text.


def _decode(s: str) -> str:
    return f"CASE WHEN {s} RLIKE '[%+]' THEN coalesce(try_url_decode({s}), {s}) ELSE {s} END"


def _encode(s: str) -> str:
    return f"CASE WHEN {s} RLIKE '[%=,\\\\t\\\\n :;+]' THEN replace(url_encode({s}), '%2F', '/') ELSE {s} END"


def _parse(t: str) -> str:
    name, value = _decode("substring_index(s, '=', 1)"), _decode("substring(s, instr(s, '=') + 1)")
    return (f"array_sort(array_distinct(transform(filter(split({t}, ','), s -> s <> ''), s -> named_struct('name', {name}, "
            f"'value', CASE WHEN contains(s, '=') THEN {value} END))))")


def _format(g: str) -> str:
    return (f"array_join(transform({g}, f -> CASE WHEN f.value IS NULL THEN {_encode('f.name')} "
            f"ELSE concat({_encode('f.name')}, '=', {_encode('f.value')}) END), ',')")


def _sorted(g: str) -> str:
    return f"array_sort(array_distinct({g}))"


def _has(g: str, w: str) -> str:
    return f"forall({_parse(w)}, x -> exists({g}, y -> y.name = x.name AND (x.value IS NULL OR y.value = x.value)))"


def _matches(g: str, w: str) -> str:
    """Alternatives are separated by `;`."""
    return f"({w} IS NULL OR exists(split({w}, ';'), alt -> {_has(g, 'alt')}))"


def _names(t: str) -> str:
    """The names of a tagset as a tagset without values."""
    return f"array_join(transform({_parse(t)}, n -> {_encode('n.name')}), ',')"


SCALARS = {
    "encode_text(s STRING) RETURNS STRING": _encode("s"),
    "decode_text(s STRING) RETURNS STRING": _decode("s"),
    f"parse_tags(t STRING) RETURNS {TAGS}": _parse("t"),
    f"format_tags(g {TAGS}) RETURNS STRING": _format("g"),
    "tagset_to_array(t STRING) RETURNS ARRAY<STRING>": f"flatten(transform({_parse('t')}, x -> array(x.name, x.value)))",
    "tagset_from_array(a ARRAY<STRING>) RETURNS STRING": _format(_sorted(
        "transform(filter(sequence(0, greatest(size(a) - 1, 0)), i -> i % 2 = 0 AND i + 1 < size(a)), "
        "i -> named_struct('name', get(a, i), 'value', get(a, i + 1)))")),
    f"has_tags(g {TAGS}, w STRING) RETURNS BOOLEAN": _has("g", "w"),
    f"matches_tags(g {TAGS}, w STRING) RETURNS BOOLEAN": _matches("g", "w"),
    "set_tags(t STRING, w STRING) RETURNS STRING": _format(_sorted(
        f"concat(filter({_parse('t')}, x -> NOT exists({_parse('w')}, y -> y.name = x.name)), {_parse('w')})")),
    "add_tags(t STRING, w STRING) RETURNS STRING": _format(_sorted(f"concat({_parse('t')}, {_parse('w')})")),
    "remove_tags(t STRING, w STRING) RETURNS STRING": _format(
        f"filter({_parse('t')}, x -> NOT exists({_parse('w')}, y -> y.name = x.name AND (y.value IS NULL OR y.value = x.value)))"),
    "tag_value(t STRING, n STRING) RETURNS STRING": f"get(filter({_parse('t')}, x -> x.name = n), 0).value",
    "time_coordinate_from_tagset(t STRING) RETURNS STRING": f"get(filter({_parse('t')}, x -> x.name = 'timeCoordinate'), 0).value",
    "tagset_id(t STRING) RETURNS BIGINT": f"xxhash64({_format(_parse('t'))})",
    "distance(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE":
        "sqrt(aggregate(zip_with(a, b, (x, y) -> (double(y) - double(x)) * (double(y) - double(x))), 0D, (s, x) -> s + x))",
    "max_double() RETURNS DOUBLE": f"{MAX_TIME!r}D",
    "negative_of(x DOUBLE) RETURNS DOUBLE": "CASE WHEN x = 0 THEN 0D ELSE -x END",
    "interpolate(t1 DOUBLE, x1 ARRAY<FLOAT>, t2 DOUBLE, x2 ARRAY<FLOAT>, t DOUBLE) RETURNS ARRAY<FLOAT>":
        "CASE WHEN t = t1 THEN x1 WHEN t = t2 THEN x2 ELSE zip_with(x1, x2, (a, b) -> float(a + (b - a) * ((t - t1) / (t2 - t1)))) END",
}

_EVENT = "id BIGINT, start_time DOUBLE, end_time DOUBLE, tags STRING"
_ROW = f"id, start_time, end_time, {_format('tags')}"
_TAGGED = _matches("tags", "w")
_WHERE = f"{_TAGGED} AND (a IS NULL OR end_time >= a) AND (z IS NULL OR start_time <= z)"

_AROUND = """SELECT 0 AS side, -time AS away, time, value FROM {p}samples WHERE event_id = i AND time <= t
    UNION ALL SELECT 1, time, time, value FROM {p}samples WHERE event_id = i AND time > t"""

# events with the cells (at most 1,001, of a thousandth of the time in which events start) that they go on in
_SPREAD = """SELECT id, start_time, end_time, tags, c, lo, explode(sequence(bigint((start_time - lo) / c), bigint((least(end_time, hi) - lo) / c))) AS cell
    FROM (SELECT *, (SELECT min(start_time) FROM {p}events) AS lo, (SELECT max(start_time) FROM {p}events) AS hi,
      (SELECT greatest((max(start_time) - min(start_time)) / 1000, 1e-6) FROM {p}events) AS c FROM {p}events) WHERE end_time >= start_time"""

# samples with their neighbours, and the value at a time on the sample `s` (the newest at or before it, or the first)
_LINKED = """SELECT event_id, time, named_struct('time', time, 'value', value, 't1', lag(time) OVER w, 'v1', lag(value) OVER w, 't2', lead(time) OVER w, 'v2', lead(value) OVER w) AS s
    FROM {p}samples WINDOW w AS (PARTITION BY event_id ORDER BY time)"""


def _on(s: str, t: str) -> str:
    return (f"CASE WHEN {t} = {s}.time OR ({s}.t1 IS NULL AND {s}.t2 IS NULL) THEN {s}.value "
            f"WHEN {s}.t2 IS NOT NULL THEN {{p}}interpolate({s}.time, {s}.value, {s}.t2, {s}.v2, {t}) ELSE {{p}}interpolate({s}.t1, {s}.v1, {s}.time, {s}.value, {t}) END")


TABLES = {
    # two different events that overlap: the later start lies in a cell of both
    "concurrent_events(w STRING, v STRING, a DOUBLE, z DOUBLE) RETURNS TABLE(first_id BIGINT, second_id BIGINT, start_time DOUBLE, end_time DOUBLE)": f"""
        SELECT e1.id, e2.id, greatest(e1.start_time, e2.start_time), least(e1.end_time, e2.end_time) FROM ({_SPREAD}) e1 JOIN ({_SPREAD}) e2 ON e1.cell = e2.cell
        WHERE e1.id <> e2.id AND e1.start_time <= e2.end_time AND e2.start_time <= e1.end_time AND e1.cell = bigint((greatest(e1.start_time, e2.start_time) - e1.lo) / e1.c)
          AND {_matches('e1.tags', 'w')} AND {_matches('e2.tags', 'v')}
          AND (a IS NULL OR (e1.end_time >= a AND e2.end_time >= a)) AND (z IS NULL OR (e1.start_time <= z AND e2.start_time <= z))""",
    "tag_combinations(w STRING, n ARRAY<STRING>) RETURNS TABLE(tags STRING, n_events BIGINT)": f"""
        SELECT {_format('own')}, count(*) FROM (SELECT DISTINCT id, own FROM (
          SELECT id, filter(tags, x -> array_contains(n, x.name)) AS own FROM {{p}}events WHERE {_TAGGED}))
        WHERE forall(n, k -> exists(own, x -> x.name = k)) GROUP BY own""",
    # samples and times asked for in one order per series; nothing is paired
    "resample_timeseries(w STRING, a DOUBLE, d DOUBLE, n BIGINT) RETURNS TABLE(event_id BIGINT, time DOUBLE, value ARRAY<FLOAT>)": f"""
        SELECT event_id, time, CASE WHEN time BETWEEN start_time AND end_time THEN {_on('at', 'time')} END FROM (
          SELECT event_id, time, asked, start_time, end_time, coalesce(last_value(s, true) OVER (PARTITION BY event_id ORDER BY time, asked ROWS UNBOUNDED PRECEDING),
              first_value(s, true) OVER (PARTITION BY event_id ORDER BY time, asked ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS at
          FROM (SELECT event_id, time, false AS asked, s, 0D AS start_time, 0D AS end_time FROM ({_LINKED})
            UNION ALL SELECT id, a + i * d, true, NULL, start_time, end_time FROM (SELECT id, start_time, end_time, explode(sequence(0L, n - 1)) AS i FROM {{p}}events WHERE {_TAGGED})))
        WHERE asked""",
    "nearest_timeseries(w STRING, point ARRAY<FLOAT>, t DOUBLE, d DOUBLE) RETURNS TABLE(id BIGINT, value ARRAY<FLOAT>, dist DOUBLE)": f"""
        SELECT id, here, {{p}}distance(here, point) FROM (SELECT id, {_on('s', 't')} AS here FROM {{p}}events JOIN ({_LINKED}) ON event_id = id
          WHERE {_TAGGED} AND start_time <= t AND end_time >= t AND ((s.time <= t AND (s.t2 IS NULL OR s.t2 > t)) OR (s.t1 IS NULL AND s.time > t)))
        WHERE d IS NULL OR {{p}}distance(here, point) <= d""",
    f"find_events(w STRING, a DOUBLE, z DOUBLE) RETURNS TABLE({_EVENT})":
        f"SELECT {_ROW} FROM {{p}}events WHERE {_WHERE}",
    f"find_timeseries(w STRING, a DOUBLE, z DOUBLE) RETURNS TABLE({_EVENT})":
        f"SELECT {_ROW} FROM {{p}}events WHERE {_WHERE} AND id IN (SELECT event_id FROM {{p}}samples)",
    f"find_next_event(w STRING, t DOUBLE, d DOUBLE) RETURNS TABLE({_EVENT})":
        f"SELECT {_ROW} FROM {{p}}events WHERE {_TAGGED} AND start_time >= t + d ORDER BY start_time, end_time, id LIMIT 1",
    f"find_prev_event(w STRING, t DOUBLE, d DOUBLE) RETURNS TABLE({_EVENT})":
        f"SELECT {_ROW} FROM {{p}}events WHERE {_TAGGED} AND start_time <= t - d ORDER BY start_time DESC, end_time DESC, id DESC LIMIT 1",
    f"event_by_id(i BIGINT) RETURNS TABLE({_EVENT})": f"SELECT {_ROW} FROM {{p}}events WHERE id = i",
    "tag_names() RETURNS TABLE(name STRING)": "SELECT DISTINCT explode(tags.name) FROM {p}events",
    "tag_counts(w STRING) RETURNS TABLE(name STRING, value STRING, n BIGINT)":
        f"SELECT p.name, p.value, count(*) FROM (SELECT explode(tags) AS p FROM {{p}}events WHERE {_TAGGED}) GROUP BY 1, 2",
    "timeseries_value_prev(i BIGINT, t DOUBLE) RETURNS TABLE(value ARRAY<FLOAT>)":
        f"SELECT value FROM ({_AROUND}) ORDER BY side, away LIMIT 1",
    # the sample on either side, or the two nearest ones where there is none on one side
    "timeseries_value_linear(i BIGINT, t DOUBLE) RETURNS TABLE(value ARRAY<FLOAT>)": f"""
        SELECT {{p}}interpolate(get(s, 0).time, get(s, 0).value, coalesce(get(s, 1).time, get(s, 0).time + 1), coalesce(get(s, 1).value, get(s, 0).value), t)
        FROM (SELECT array_sort(transform(slice(array_sort(collect_list(named_struct('rank', rank, 'time', time, 'value', value))), 1, 2),
            r -> named_struct('time', r.time, 'value', r.value))) AS s
          FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY away) AS rank FROM ({_AROUND})) WHERE rank <= 2)""",
}

# over the time coordinates of a store: the one whose tags are all among the given ones
_COORDINATE = f"FROM {{p}}time_coordinates WHERE forall(tags, x -> array_contains({_parse('w')}, x))"

COORDINATES = {
    "time_to_utc(t DOUBLE, w STRING) RETURNS DOUBLE": f"(t - (SELECT max(intercept) {_COORDINATE})) / (SELECT max(slope) {_COORDINATE})",
    "time_from_utc(t DOUBLE, w STRING) RETURNS DOUBLE": f"(SELECT max(slope) {_COORDINATE}) * t + (SELECT max(intercept) {_COORDINATE})",
    # what one side does not say is taken from the other
    "convert_time(t DOUBLE, a STRING, b STRING) RETURNS DOUBLE":
        f"{{p}}time_from_utc({{p}}time_to_utc(t, {{p}}add_tags(a, {{p}}remove_tags(b, {_names('a')}))), "
        f"{{p}}add_tags(b, {{p}}remove_tags(a, {_names('b')})))",
}


def register(spark: SparkSession, store: Store | None = None, prefix: str = "") -> list[str]:
    """Create the functions (and views of the store's tables); returns the functions' names."""
    bodies = dict(SCALARS)
    if store is not None:
        for name in ("events", "samples", "time_coordinates"):
            table = getattr(store, name)
            if table is not None:
                table.createOrReplaceTempView(f"{prefix}{name}")
        needs = {k: v for k, v in TABLES.items() if store.samples is not None or "{p}samples" not in v}
        bodies.update(needs)
        if store.time_coordinates is not None:
            bodies.update(COORDINATES)
    made = []
    for head, body in bodies.items():
        body = body.replace("{p}", prefix)
        name = head.partition("(")[0]
        statement = f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{head} RETURN {body}"
        spark.sql(statement)
        made.append(prefix + name)
    return made
