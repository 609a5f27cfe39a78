"""Events: filters, co-occurrence, catalogue, time coordinates, changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronotag.functions import tags as T
from chronotag.model import Store
from chronotag.operators import attachments, catalog, cooccur, filters, selection, timecoord
from chronotag.operators import events as E
from chronotag.plans.ordered import Ordered
from chronotag.sources import textio
from workload import views as V
from workload.registry import query

HOUR = 3600.0
DAY = 86400.0


def store(spark, folder) -> Store:
    return Store(V.events(spark, folder))


# --- filters ---------------------------------------------------------------------------------------

@query(f"WITH {V.EV} SELECT id, start_time, end_time, tags FROM ev WHERE type = 'click' "
       f"AND end_time >= {V.T0} + 86400 AND start_time <= {V.T0} + 10 * 86400")
def find_by_tags(spark, folder):
    t0 = V.t0(spark, folder)
    return V.show_tags(filters.find(store(spark, folder), filters.by_tags("type=click"), filters.by_time(t0 + DAY, t0 + 10 * DAY)))


@query(f"WITH {V.EV} SELECT id, start_time, end_time, tags FROM ev WHERE type = 'click' OR (type = 'error' AND k = '7') OR k = '42'")
def find_by_tags_or(spark, folder):
    return V.show_tags(filters.find(store(spark, folder), filters.by_tags("type=click;type=error,k=7", "k=42,user")))


@query(f"WITH {V.EV} SELECT id, start_time, end_time, tags FROM ev WHERE end_time >= {V.T0} + 5 * 86400 AND start_time <= {V.T0} + 6 * 86400")
def find_by_time(spark, folder):
    t0 = V.t0(spark, folder)
    return V.show_tags(filters.find(store(spark, folder), filters.by_start(t0 + 5 * DAY), filters.by_end(t0 + 6 * DAY)))


@query(f"WITH {V.EV} SELECT id, start_time, end_time, tags FROM ev WHERE id IN (3, 14, 159, 265, 358, 979)")
def find_by_ids(spark, folder):
    return V.show_tags(filters.find(store(spark, folder), filters.by_ids(3, 14, 159, 265, 358, 979, 10 ** 12)))


@query(f"WITH {V.EV} SELECT id, start_time, end_time, tags FROM ev WHERE type = 'view' AND end_time >= {V.T0} + 2 * 86400")
def combined_filters(spark, folder):
    t0 = V.t0(spark, folder)
    f = filters.by_tags("type=click").also(filters.by_start(t0)).also(filters.Filter.from_text(f"Start:{t0 + 2 * DAY!r};type=view"))
    return V.show_tags(filters.find(store(spark, folder), f))


@query(f"""WITH {V.EV}, saved AS (SELECT 'p' || o_orderpriority AS filter_id, count(*) AS n FROM orders GROUP BY 1)
    SELECT 's-' || type AS filter_id, id FROM ev
    UNION SELECT 'both', id FROM ev WHERE type = 'click' AND k = '5' OR type = 'view' AND k = '6'
    UNION SELECT 'wild', id FROM ev WHERE type = 'error'
    UNION SELECT 'early', id FROM ev WHERE start_time <= {V.T0} + 86400
    UNION SELECT 'late', id FROM ev WHERE type = 'view' AND end_time >= {V.T0} + 20 * 86400""")
def match_saved_filters(spark, folder):
    t0 = V.t0(spark, folder)
    ev = V.events(spark, folder)
    # one saved filter per type that occurs, and some of other shapes
    per_type = ev.select(F.concat(F.lit("s-"), "tag:type").alias("filter_id"), F.concat(F.lit("type="), "tag:type").alias("text")).distinct()
    more = spark.createDataFrame([
        ("both", "type=click,k=5;k=6,type=view"), ("wild", "type=error,user"), ("early", f"End:{t0 + DAY!r}"),
        ("late", f"Start:{t0 + 20 * DAY!r};type=view")], "filter_id string, text string")
    return filters.match_saved(ev, per_type.unionByName(more))


@query(f"WITH {V.EV}, sel AS (SELECT * FROM ev WHERE type = 'purchase') SELECT usr AS user, count(*) AS n, "
       f"round(sum(end_time - start_time), 4) AS seconds FROM sel GROUP BY 1")
def purchases_per_user(spark, folder):
    ev = filters.select(store(spark, folder), "type=purchase")
    return ev.groupBy(T.value(F.col("tags"), "user").alias("user")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("end_time") - F.col("start_time")), 4).alias("seconds"))


@query(f"WITH {V.EV} SELECT id, tags, start_time, end_time FROM ev WHERE id IN (1, 10, 100)")
def event_attributes(spark, folder):
    return E.attributes(store(spark, folder), [1, 10, 100])


@query(f"WITH {V.EV}, ask(pos, id) AS (VALUES (0, 500), (1, 7), (2, 90)) SELECT pos, ev.id, start_time, end_time, tags "
       f"FROM ask JOIN ev ON ask.id = ev.id")
def fetch_in_order(spark, folder):
    rows = V.show_tags(E.by_ids_in_order(store(spark, folder), [500, 7, 90]))
    place = F.array_position(F.array(F.lit(500), F.lit(7), F.lit(90)).cast("array<bigint>"), F.col("id")) - 1
    return rows.withColumn("pos", place.cast("int"))


# --- next and previous --------------------------------------------------------------------------------

@query(f"WITH {V.EV} SELECT id, start_time, end_time, tags FROM ev WHERE type = 'signup' AND start_time >= {V.T0} + 43200 + (1e-3 + 1e-8) "
       f"ORDER BY start_time, end_time, id LIMIT 1")
def next_event(spark, folder):
    return V.show_tags(E.find_next(store(spark, folder), filters.by_tags("type=signup"), V.t0(spark, folder) + 12 * HOUR))


@query(f"WITH {V.EV} SELECT id, start_time, end_time, tags FROM ev WHERE type = 'signup' AND start_time <= {V.T0} + 86400 - (1e-3 + 1e-8) "
       f"ORDER BY start_time DESC, end_time DESC, id DESC LIMIT 1")
def prev_event(spark, folder):
    return V.show_tags(E.find_prev(store(spark, folder), filters.by_tags("type=signup"), V.t0(spark, folder) + DAY))


@query(f"""WITH {V.EV}, p AS (SELECT * FROM ev WHERE type = 'purchase'), c AS (SELECT * FROM ev WHERE type = 'click')
    SELECT p.id AS probe_id, p.usr AS user, n.id AS next_id, n.start_time AS next_start, b.id AS prev_id, b.start_time AS prev_start
    FROM p ASOF LEFT JOIN c n ON p.usr = n.usr AND p.start_time + 60 <= n.start_time
    ASOF LEFT JOIN c b ON p.usr = b.usr AND p.start_time - 60 >= b.start_time""")
def click_around_purchase(spark, folder):
    s = store(spark, folder)
    user = T.value(F.col("tags"), "user").alias("user")
    clicks = filters.select(s, "type=click").select("id", "start_time", user)
    probes = filters.select(s, "type=purchase").select(F.col("id").alias("probe_id"), F.col("start_time").alias("time"), user)
    return E.neighbours(clicks, probes, ["user"], delta=60.0)


# --- co-occurrence --------------------------------------------------------------------------------------

def pairs(df, n):
    return df.select("start_time", "end_time", *[F.get("ids", F.lit(i)).alias(f"id{i}") for i in range(n)])


@query(f"""WITH {V.EV} SELECT greatest(a.start_time, b.start_time) AS start_time, least(a.end_time, b.end_time) AS end_time,
    a.id AS id0, b.id AS id1 FROM ev a JOIN ev b ON a.start_time <= b.end_time AND b.start_time <= a.end_time
    WHERE a.type = 'click' AND b.type = 'view'""")
def cooccur_2(spark, folder):
    return pairs(cooccur.concurrent(store(spark, folder), ["type=click", "type=view"]), 2)


@query(f"""WITH {V.EV} SELECT greatest(a.start_time, b.start_time, c.start_time) AS start_time, least(a.end_time, b.end_time, c.end_time) AS end_time,
    a.id AS id0, b.id AS id1, c.id AS id2 FROM ev a JOIN ev b ON a.start_time <= b.end_time AND b.start_time <= a.end_time
    JOIN ev c ON c.start_time <= least(a.end_time, b.end_time) AND greatest(a.start_time, b.start_time) <= c.end_time
    WHERE a.type = 'click' AND b.type = 'view' AND c.type = 'purchase'""")
def cooccur_3(spark, folder):
    return pairs(cooccur.concurrent(store(spark, folder), ["type=click", "type=view", "type=purchase"]), 3)


@query(f"""WITH {V.ORD} SELECT greatest(a.start_time, b.start_time) AS start_time, least(a.end_time, b.end_time) AS end_time,
    a.id AS id0, b.id AS id1 FROM ord a JOIN ord b ON a.cust = b.cust AND a.start_time <= b.end_time AND b.start_time <= a.end_time
    WHERE a.status = 'O' AND b.status = 'F'""")
def cooccur_bound(spark, folder):
    return pairs(cooccur.concurrent(Store(V.orders(spark, folder, with_flags=False)), ["status=O,cust", "status=F,cust="]), 2)


@query(f"""WITH {V.EV}, e AS (SELECT *, CASE type WHEN 'click' THEN 0 ELSE 1 END AS a FROM ev WHERE type IN ('click', 'error'))
    SELECT greatest(a.start_time, b.start_time) AS start_time, least(a.end_time, b.end_time) AS end_time, a.id AS id0, b.id AS id1
    FROM e a JOIN e b ON a.start_time <= b.end_time AND b.start_time <= a.end_time
    AND (a.a, a.start_time, a.end_time, a.id) < (b.a, b.start_time, b.end_time, b.id)""")
def cooccur_or(spark, folder):
    return pairs(cooccur.concurrent(store(spark, folder), ["type=click;type=error", "type=click;type=error"]), 2)


@query(f"""WITH {V.EV} SELECT greatest(a.start_time, b.start_time, {V.T0} + 86400) AS start_time,
    least(a.end_time, b.end_time, {V.T0} + 15 * 86400) AS end_time, a.id AS id0, b.id AS id1
    FROM ev a JOIN ev b ON a.start_time <= b.end_time AND b.start_time <= a.end_time
    WHERE a.type = 'click' AND b.type = 'view' AND least(a.end_time, b.end_time) >= {V.T0} + 86400
    AND greatest(a.start_time, b.start_time) <= {V.T0} + 15 * 86400 AND a.k <> b.k""")
def cooccur_skip(spark, folder):
    s, t0 = store(spark, folder), V.t0(spark, folder)
    # leave out the pairs with the same k, given in the other order
    same = cooccur.concurrent(s, ["type=view,k", "type=click,k="]).select("ids")
    return pairs(cooccur.concurrent(s, ["type=click", "type=view"], t0 + DAY, t0 + 15 * DAY, skip=same), 2)


@query(f"""WITH {V.EV}, rows_ AS (SELECT * FROM ev WHERE type = 'click'), src AS (SELECT * FROM ev WHERE type = 'view'),
    hit AS (SELECT r.id, s.k, row_number() OVER (PARTITION BY r.id ORDER BY s.start_time, s.end_time, s.id) AS rn
      FROM rows_ r JOIN src s ON r.usr = s.usr AND r.start_time BETWEEN s.start_time AND s.end_time)
    SELECT r.id, r.start_time, r.end_time, 'k=' || coalesce(h.k, r.k) || ',type=click,user=' || r.usr AS tags
    FROM rows_ r LEFT JOIN hit h ON r.id = h.id AND h.rn = 1""")
def gather_tags(spark, folder):
    s = store(spark, folder)
    rows, source = filters.select(s, "type=click"), filters.select(s, "type=view")
    return V.show_tags(cooccur.gather_tags(rows, source, ["user"], ["k"]))


@query(f"""WITH {V.EV} SELECT id, start_time, end_time, tags FROM ev WHERE (type, k) IN
    (SELECT type, k FROM ev WHERE start_time <= {V.T0} + 7200)""")
def sharing_template(spark, folder):
    s = store(spark, folder)
    chosen = filters.select(s, filters.by_end(V.t0(spark, folder) + 2 * HOUR))
    return V.show_tags(cooccur.sharing_template(s.events, chosen, ["type", "k"]))


# --- catalogue -------------------------------------------------------------------------------------------

def tag_text(df):
    return df.withColumn("tags", T.to_text(F.col("tags")))


@query(f"WITH {V.EV} SELECT type AS c0, k AS c1, 'k=' || k || ',type=' || type AS tags, count(*) AS n FROM ev GROUP BY type, k")
def tag_combinations(spark, folder):
    return tag_text(catalog.combinations(V.events(spark, folder), ["type", "k"]))


@query(f"""WITH {V.ORD}, o AS (SELECT ord.*, flag FROM ord JOIN flags USING (id) WHERE status = 'O')
    SELECT a.flag AS c0, b.flag AS c1, a.priority AS c2, 'flag=' || a.flag || ',flag=' || b.flag || ',priority=' ||
      CASE WHEN a.priority LIKE '% %' THEN replace(a.priority, ' ', '+') ELSE a.priority END || ',status=O' AS tags, count(*) AS n
    FROM o a JOIN o b ON a.id = b.id AND a.flag < b.flag GROUP BY ALL""")
def tag_combinations_repeated(spark, folder):
    return tag_text(catalog.combinations(V.orders(spark, folder), ["flag", "flag", "priority"], "status=O"))


@query(f"WITH {V.EV} SELECT usr AS c0, 'type=click,user=' || usr AS tags, count(*) AS n FROM ev WHERE type = 'click' GROUP BY usr")
def tag_combinations_short(spark, folder):
    return tag_text(catalog.combinations_of(V.events(spark, folder), "type=click,user"))


@query("SELECT unnest(['cust', 'flag', 'priority', 'status']) AS name")
def tag_names(spark, folder):
    return catalog.tag_names(V.orders(spark, folder))


@query(f"""WITH {V.EV_TAGS}, v AS (SELECT name, value, count(*) AS n FROM ev_tags GROUP BY ALL),
    t AS (SELECT name, count(*) AS n_pairs, count(DISTINCT id) AS n_events FROM ev_tags GROUP BY name)
    SELECT name, n_events, n_pairs, value, n FROM v JOIN t USING (name)""")
def count_event_tags(spark, folder):
    return catalog.count_tags(V.events(spark, folder))


@query(f"""WITH {V.EV_TAGS} SELECT name, count(*) AS n FROM ev_tags WHERE id IN (SELECT id FROM ev WHERE type = 'view') AND name <> 'type' GROUP BY name""")
def drill_down_names(spark, folder):
    return catalog.names_under(V.events(spark, folder), "type=view")


@query(f"""WITH {V.EV} SELECT k AS value, count(*) AS n FROM ev WHERE type = 'view' GROUP BY k ORDER BY n DESC, k LIMIT 10""")
def drill_down_values(spark, folder):
    return catalog.values_under(V.events(spark, folder), "type=view", "k", 10)


@query(f"""WITH {V.EV} SELECT k, type, 'k=' || k || ',type=' || type AS tags, count(*) AS n, row_number() OVER (ORDER BY CAST(k AS INT), type) AS rank
    FROM ev GROUP BY k, type""")
def sorted_tagsets(spark, folder):
    return tag_text(catalog.sorted_tagsets(V.events(spark, folder), ["k", "type"], count=True, rank=True))


_ORD_SETS = f"""{V.ORD}, sets AS (SELECT id, start_time, cust, priority, status, list_sort(coalesce((SELECT list(flag) FROM flags f WHERE f.id = ord.id), [])) AS flags FROM ord)"""


@query(f"""WITH {_ORD_SETS} SELECT id, row_number() OVER (ORDER BY len(flags) = 0, cust, flags, priority, status, start_time, id) AS rank FROM sets""")
def tagset_rank(spark, folder):
    # by all names: cust, flag (none or several), priority, status; whoever has flags has the lesser names
    return catalog.rank_by_tags(V.orders(spark, folder), names_first=True).select("id", "rank")


@query(f"""WITH {_ORD_SETS} SELECT id, row_number() OVER (ORDER BY status, flags, start_time, id) AS rank FROM sets""")
def tagset_rank_by_names(spark, folder):
    # by chosen names, some of which no order has: an order without flags comes first
    names = [f"unused{i}" for i in range(3000)] + ["status", "flag"]
    return catalog.rank_by_tags(V.orders(spark, folder), names).select("id", "rank")


@query(f"WITH {V.EV} SELECT hash_text AS text FROM (SELECT DISTINCT tags AS hash_text FROM ev)")
def tagset_dictionary(spark, folder):
    return catalog.tagset_dictionary(V.events(spark, folder)).select("text")


@query(f"""WITH {V.EV_TAGS} SELECT (SELECT count(*) FROM ev) AS n_events, (SELECT count(DISTINCT tags) FROM ev) AS n_tagsets,
    (SELECT count(*) FROM ev_tags) AS n_pairs, (SELECT count(DISTINCT user_id) FROM raw) AS n_timeseries, (SELECT count(*) FROM raw) AS n_samples,
    (SELECT 1 + count(DISTINCT user_id) FROM raw) AS n_time_coordinates, 3.0::DOUBLE AS mean_pairs,
    (SELECT count(*) / count(DISTINCT user_id) FROM raw) AS mean_samples""")
def store_stats(spark, folder):
    s = Store(V.events(spark, folder), V.user_series(spark, folder).samples, V.coordinates(spark, folder))
    return catalog.stats(s)


@query(f"""WITH {V.EV} SELECT type, CAST(NULL AS VARCHAR) AS common_k, count(DISTINCT k) + count(DISTINCT usr) + 1 AS n_union, 'type=' || type AS common
    FROM ev GROUP BY type""")
def common_tags(spark, folder):
    ev = V.events(spark, folder).withColumnRenamed("tag:type", "type")
    df = catalog.common_tags(ev, ["type"])
    return df.select("type", T.value(F.col("common"), "k").alias("common_k"), F.size("union").cast("bigint").alias("n_union"),
                     T.to_text(F.col("common")).alias("common"))


# --- time coordinates ----------------------------------------------------------------------------------------

@query(f"""WITH {V.EV}, first AS (SELECT user_id, min(t) AS t0 FROM raw GROUP BY user_id)
    SELECT id, 1.0 * start_time + -t0 AS start_time, 1.0 * end_time + -t0 AS end_time,
      'k=' || k || ',timeCoordinate=userSeconds,type=' || type || ',user=' || usr AS tags
    FROM ev JOIN first USING (user_id) WHERE type = 'click' AND 1.0 * end_time + -t0 >= 86400 AND 1.0 * start_time + -t0 <= 172800""")
def find_in_time_coordinate(spark, folder):
    s = Store(V.in_utc(V.events(spark, folder)), time_coordinates=V.coordinates(spark, folder))
    f = filters.by_tags("type=click").also(filters.by_time(DAY, 2 * DAY)).also(filters.with_time_coordinate("timeCoordinate=userSeconds"))
    return V.show_tags(filters.select(s, f))


@query(f"""WITH {V.EV}, first AS (SELECT user_id, min(t) AS t0 FROM raw GROUP BY user_id),
      m AS (SELECT ev.*, 1.0 * start_time + -t0 AS a, 1.0 * end_time + -t0 AS b FROM ev JOIN first USING (user_id))
    SELECT 'own day' AS filter_id, id FROM m WHERE b >= 86400 AND a <= 172800
    UNION ALL SELECT 'own clicks', id FROM m WHERE type = 'click' AND b >= 86400 OR type = 'view' AND k = '3' AND b >= 86400
    UNION ALL SELECT 'ids', id FROM m WHERE id < 500 AND id % 5 = 0 AND a <= 432000
    UNION ALL SELECT 'day of ' || usr, id FROM m WHERE type = 'error' AND a <= 172800
    UNION ALL SELECT 'utc', id FROM m WHERE start_time <= {V.T0} + 3600
    UNION ALL SELECT 'no bounds', id FROM m WHERE type = 'signup'
    UNION ALL SELECT 'owners', id FROM m WHERE type = 'view' AND k = '1' AND start_time <= {V.T0} + 86400""")
def saved_filters_all_fields(spark, folder):
    events = V.in_utc(V.events(spark, folder))
    t0, own = V.t0(spark, folder), "timeCoordinate:timeCoordinate=userSeconds"
    ids = ",".join(str(i) for i in range(0, 500, 5))
    saved = spark.createDataFrame([
        ("own day", f"{own};Start:{DAY};End:{2 * DAY}"), ("own clicks", f"Start:{DAY};{own};type=click;type=view,k=3"), ("ids", f"IDs:{ids};End:{5 * DAY};{own}"),
        ("utc", f"End:{t0 + 3600!r};timeCoordinate:timeCoordinate=secondsUTC"), ("no bounds", f"{own};type=signup"),
        ("owners", f"Schema:timeseries;End:{t0 + DAY!r};type=view,k=1")], "filter_id string, text string")
    # and one for each user, in that user's coordinate
    users = events.select("tag:user").distinct().select(F.concat(F.lit("day of "), "tag:user").alias("filter_id"), F.concat(
        F.lit(f"{own},user="), "tag:user", F.lit(f";End:{2 * DAY};type=error,user="), "tag:user").alias("text"))
    samples = events.select(F.col("id").alias("event_id"))
    s = Store(events, samples, time_coordinates=V.coordinates(spark, folder))
    return filters.match_saved(events, saved.unionByName(users), s)


@query(f"""WITH {V.EV}, f AS (SELECT usr, min(start_time) AS t FROM ev WHERE type = 'click' GROUP BY usr)
    SELECT 'timeCoordinate=clickMillis,user=' || usr AS tags, 1000.0::DOUBLE AS slope, -t * 1000.0 AS intercept FROM f""")
def define_coordinates_per_user(spark, folder):
    ev = V.in_utc(V.events(spark, folder))
    new = timecoord.define_for_combinations(ev, V.coordinates(spark, folder), "clickMillis", ["user"], "type=click", 1000.0)
    return new.select(T.to_text(F.col("tags")).alias("tags"), "slope", "intercept")


@query(f"""WITH {V.RAW}, first AS (SELECT user_id, min(t) AS t0 FROM raw GROUP BY user_id)
    SELECT event_id, 1.0 * t + -t0 AS converted, ((1.0 * t + -t0) - -t0) / 1.0 AS utc FROM raw JOIN first USING (user_id)""")
def convert_times(spark, folder):
    coords = V.coordinates(spark, folder)
    df = V.raw(spark, folder).select("event_id", "t", F.col("user_id").cast("string").alias("u"))
    df = timecoord.convert(df, coords, "t", T.lit_tags("timeCoordinate=secondsUTC"), T.make(timeCoordinate=F.lit("userSeconds"), user=F.col("u")))
    df = timecoord.to_utc(df, coords, "converted", T.make(timeCoordinate=F.lit("userSeconds"), user=F.col("u")))
    return df.select("event_id", "converted", "utc")


# --- changes ----------------------------------------------------------------------------------------------------

@query(f"WITH {V.EV} SELECT id, start_time, end_time, CASE WHEN type = 'click' THEN 'color=red,k=0,type=click,user=' || usr ELSE tags END AS tags FROM ev")
def set_tags(spark, folder):
    return V.show_tags(E.set_tags(store(spark, folder), filters.by_tags("type=click"), "k=0,color=red").events)


@query(f"WITH {V.EV} SELECT id, start_time, end_time, CASE WHEN type = 'click' THEN 'k=' || k || ',type=click,type=tap,user=' || usr ELSE tags END AS tags FROM ev")
def add_tags(spark, folder):
    return V.show_tags(E.add_tags(store(spark, folder), filters.by_tags("type=click"), "type=tap").events)


@query(f"WITH {V.EV} SELECT id, start_time, end_time, CASE WHEN type = 'view' THEN 'type=view' || CASE WHEN usr = '1' THEN '' ELSE ',user=' || usr END "
       f"ELSE tags END AS tags FROM ev")
def remove_tags(spark, folder):
    return V.show_tags(E.remove_tags(store(spark, folder), filters.by_tags("type=view"), "k,user=1").events)


@query(f"""WITH {V.SERIES}, cut AS (SELECT *, {V.T0} + 10 * 86400 AS c FROM ser)
    SELECT id, start_time, c AS end_time, (SELECT count(*) FROM smp WHERE event_id = id AND time <= c) AS n FROM cut""")
def set_end(spark, folder):
    s = E.set_end(V.user_series(spark, folder), filters.by_tags("user"), V.t0(spark, folder) + 10 * DAY)
    n = s.samples.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    return s.events.join(n, F.col("id") == F.col("event_id"), "left").select(
        "id", "start_time", "end_time", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {V.SERIES}, c AS (SELECT {V.T0} + 3 * 86400 AS c) SELECT id, greatest(start_time, c) AS start_time, end_time,
    (SELECT count(*) FROM smp WHERE event_id = id AND time >= c) AS n FROM ser, c WHERE end_time >= c""")
def truncate_series(spark, folder):
    s = E.truncate(V.user_series(spark, folder), filters.by_tags("user"), V.t0(spark, folder) + 3 * DAY, keep="after")
    n = s.samples.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    return s.events.join(n, F.col("id") == F.col("event_id"), "left").select(
        "id", "start_time", "end_time", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {V.SERIES}, c AS (SELECT {V.T0} + 86400 AS a, {V.T0} + 8 * 86400 AS z, (SELECT max(id) FROM ser) AS m),
    copy AS (SELECT m + CASE id WHEN 5 THEN 1 ELSE 2 END AS id, a AS start_time, z AS end_time, 'copy=yes,user=' || id AS tags,
      (SELECT count(*) FROM smp WHERE event_id = id AND time BETWEEN a AND z) AS n FROM ser, c WHERE id IN (5, 2))
    SELECT id, start_time, end_time, 'user=' || id AS tags, (SELECT count(*) FROM smp WHERE event_id = id) AS n FROM ser UNION ALL SELECT * FROM copy""")
def clone_events(spark, folder):
    t0 = V.t0(spark, folder)
    s = E.clone(V.user_series(spark, folder), [5, 2], t0 + DAY, t0 + 8 * DAY, "copy=yes")
    n = s.samples.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    return V.show_tags(s.events).join(n, F.col("id") == F.col("event_id"), "left").select(
        "id", "start_time", "end_time", "tags", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {V.TYPED} SELECT id, start_time, end_time, (SELECT count(*) FROM smp WHERE event_id = id) AS n FROM ser WHERE type <> 'error'""")
def delete_events(spark, folder):
    s = E.delete(V.typed_series(spark, folder), filters.by_tags("type=error"))
    n = s.samples.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    return s.events.join(n, F.col("id") == F.col("event_id")).select("id", "start_time", "end_time", "n")


@query(f"""WITH {V.EV} SELECT id, start_time, end_time, tags FROM ev UNION ALL
    SELECT (SELECT max(id) FROM ev) + 1, 1.0, 2.0, 'made=by+hand'""")
def create_event(spark, folder):
    s, _ = E.create_one(store(spark, folder), 1.0, 2.0, "made=by+hand")
    return V.show_tags(s.events)


@query(f"""WITH {V.EV}, r AS (SELECT usr, start_time AS time, 'state=' || type AS info, lag(type) OVER w AS was FROM ev
      WINDOW w AS (PARTITION BY usr ORDER BY start_time)),
    s AS (SELECT * FROM r WHERE was IS NULL OR 'state=' || was <> info)
    SELECT usr AS user, info, time AS start_time, coalesce(lead(time) OVER (PARTITION BY usr ORDER BY time), 1.7976931348623157e308) AS end_time FROM s""")
def state_changes(spark, folder):
    reports = V.events(spark, folder).select(F.col("tag:user").alias("user"), F.col("start_time").alias("time"),
                                             F.concat(F.lit("state="), "tag:type").alias("info"))
    return E.state_changes(reports, ["user"])


# --- selection, named values, blobs -----------------------------------------------------------------------------------

@query(f"WITH {V.EV} SELECT id, type = 'click' AND k <> '3' OR k = '9' AS selected FROM ev")
def selected_events(spark, folder):
    s = store(spark, folder)
    none = spark.createDataFrame([], selection.SELECTIONS)
    ids = [filters.select(s, f).select(F.col("id").alias("event_id")) for f in ("type=click", "k=3", "k=9")]
    sel = selection.unselect(selection.select(none, ids[0], 1.0), ids[1])
    return selection.is_selected(s.events, selection.select(sel, ids[2], 2.0)).select("id", "selected")


@query(f"""WITH {V.EV} SELECT usr AS value_group, type AS value_name, max(start_time) AS time, CAST(CAST(arg_max(k, start_time) AS FLOAT) AS DOUBLE) AS value
    FROM ev GROUP BY ALL""")
def latest_values(spark, folder):
    df = V.events(spark, folder).select(F.col("tag:user").alias("value_group"), F.col("tag:type").alias("value_name"),
                                        F.col("start_time").alias("time"),
                                        F.array(T.value(F.col("tags"), "k").cast("float")).alias("value"))
    out = selection.latest_values(df, ["value_group", "value_name"])
    return out.withColumn("value", F.get("value", F.lit(0)).cast("double"))


@query("""SELECT doc_id AS id, octet_length(encode(text)) AS n_bytes, lang FROM documents""")
def events_with_blobs(spark, folder):
    d = V.table(spark, folder, "documents")
    ev = d.select(F.col("doc_id").alias("id"), F.lit(0.0).alias("start_time"), F.lit(1.0).alias("end_time"),
                  T.make(lang=F.col("lang")).alias("tags"))
    old = d.select(F.col("doc_id").alias("event_id"), F.lit("text").alias("schema_name"), F.lit(b"old").alias("data"))
    new = d.select(F.col("doc_id").alias("event_id"), F.lit("text").alias("schema_name"), F.encode("text", "UTF-8").alias("data"))
    s = attachments.attach_blobs(attachments.attach_blobs(Store(ev), old), new)
    return attachments.with_blobs(s, "text", "lang").select("id", F.octet_length("data").cast("bigint").alias("n_bytes"),
                                                            T.value(F.col("tags"), "lang").alias("lang"))


# --- text ------------------------------------------------------------------------------------------------------------

@query(f"""WITH {V.EV}, w AS (SELECT DISTINCT start_time AS t FROM ev), n AS (SELECT t, lead(t) OVER (ORDER BY t) AS u FROM w)
    SELECT count(*) AS n, sum(length(value))::BIGINT > 0 AS filled FROM (
      SELECT 'evt-start(' || id || ')' AS value FROM ev UNION ALL SELECT 'evt-end(' || id || ')' FROM ev
      UNION ALL SELECT 'evt-tag' FROM ev, range(3) UNION ALL SELECT 'evt-next-time' FROM n WHERE u IS NOT NULL)""")
def fact_lines(spark, folder):
    return textio.facts(V.events(spark, folder)).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.length("value")) > 0).alias("filled"))


@query(f"WITH {V.EV} SELECT tags AS value FROM ev WHERE type = 'error'")
def export_tags(spark, folder):
    return textio.export(store(spark, folder), ["type=error"], tags_only=True, times=False)
