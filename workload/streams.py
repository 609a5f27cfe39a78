"""Streaming jobs replayed over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronotag.functions import tags as T
from chronotag.model import epoch_seconds
from chronotag.operators import filters, patterns
from chronotag.streaming import feeds, run, stateful
from workload import views as V
from workload.registry import query
from workload.series import SHAPE


def live(spark, folder):
    """The events table as a stream, with the columns of `views.raw`."""
    df = run.read_table(spark, folder, "events.parquet")
    return df.select("event_id", epoch_seconds(df, "ts").alias("t"), "user_id", "event_type", "value",
                     F.get_json_object("props", "$.k").alias("k"))


def arriving(spark, folder, late=None, parts=3):
    """The rows in several batches, in order of time; with `late` up to that many seconds after their time."""
    r = V.raw(spark, folder)
    arrives = F.col("t") + (F.col("event_id") * 7919 % late if late else F.lit(0.0))
    return run.in_batches(r.withColumn("arrives", arrives), "arrives", parts)


@query(f"""WITH {V.EV}, c AS (SELECT *, id % 3 AS op, CASE WHEN id % 2 = 0 THEN 'click' ELSE type END AS was FROM ev)
    SELECT id, CASE op WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE CASE WHEN type = 'click' AND was = 'click' THEN 'modified' WHEN type = 'click' THEN 'added' ELSE 'removed' END END AS change,
    op < 2 AS whole FROM c WHERE CASE op WHEN 0 THEN type = 'click' WHEN 1 THEN was = 'click' ELSE type = 'click' OR was = 'click' END""")
def change_feed(spark, folder):
    r = live(spark, folder)
    n = F.col("event_id") % 3

    def event(kind):
        return F.struct(F.col("event_id").alias("id"), F.col("t").alias("start_time"), (F.col("t") + F.col("value")).alias("end_time"),
                        T.make(type=kind).alias("tags"))
    changes = r.select(F.when(n == 0, "insert").when(n == 1, "delete").otherwise("update").alias("op"),
                       F.when(n > 0, event(F.when(F.col("event_id") % 2 == 0, "click").otherwise(F.col("event_type")))).alias("before"),
                       F.when(n != 1, event(F.col("event_type"))).alias("after"))
    return run.replay(feeds.change_feed(changes, filters.by_tags("type=click"))).select("id", "change", "whole")


@query(f"""WITH {V.EV}, first AS (SELECT user_id, min(t) AS t0 FROM raw GROUP BY user_id)
    SELECT id, start_time, end_time FROM ev JOIN first USING (user_id) WHERE type = 'click' AND 1.0 * end_time + -t0 >= 86400 AND 1.0 * start_time + -t0 <= 172800""")
def change_feed_by_coordinate(spark, folder):
    r = arriving(spark, folder)
    tags = T.make(timeCoordinate=F.lit("secondsUTC"), type=F.col("event_type"), user=F.col("user_id").cast("string"))
    events = r.select(F.col("event_id").alias("id"), F.col("t").alias("start_time"), (F.col("t") + F.col("value")).alias("end_time"), tags.alias("tags"))
    f = filters.Filter.from_text("type=click;Start:86400;End:172800;timeCoordinate:timeCoordinate=userSeconds")
    return run.replay(feeds.change_feed(feeds.inserts(events), f, V.coordinates(spark, folder))).select("id", "start_time", "end_time")


@query(f"""WITH {V.SERIES} SELECT event_id AS id, time, CAST(v AS DOUBLE) AS value FROM smp WHERE event_id % 2 = 0""")
def data_feed(spark, folder):
    r = live(spark, folder)
    smp = r.select(F.col("user_id").alias("event_id"), F.col("t").alias("time"), F.array(F.col("value").cast("float")).alias("value"))
    ev = V.user_series(spark, folder).events
    ev = ev.withColumn("tags", T.make(even=(F.col("id") % 2 == 0).cast("string")))
    out = run.replay(feeds.data_feed(smp, ev, filters.by_tags("even=true")))
    return out.select("id", "time", F.get("value", F.lit(0)).cast("double").alias("value"))


@query(f"""WITH {V.RAW} SELECT user_id AS value_group, event_type AS value_name, max(t) AS time, CAST(CAST(arg_max(k, t) AS FLOAT) AS DOUBLE) AS value FROM raw GROUP BY ALL""")
def latest_values_stream(spark, folder):
    r = arriving(spark, folder).select(F.col("user_id").alias("value_group"), F.col("event_type").alias("value_name"), F.col("t").alias("time"),
                                   F.array(F.col("k").cast("float")).alias("value"))
    keys = ["value_group", "value_name"]
    out = run.newest(run.replay(feeds.latest_values(r, keys), "update"), keys)
    return out.withColumn("value", F.get("value", F.lit(0)).cast("double"))


@query(f"""WITH {V.EV}, r AS (SELECT usr, start_time AS time, 'state=' || type AS info, lag(type) OVER w AS was FROM ev
      WINDOW w AS (PARTITION BY usr ORDER BY start_time)),
    s AS (SELECT * FROM r WHERE was IS NULL OR 'state=' || was <> info)
    SELECT usr AS key, info, time AS start_time, coalesce(lead(time) OVER w, 1.7976931348623157e308) AS end_time, lead(time) OVER w IS NULL AS open
    FROM s WINDOW w AS (PARTITION BY usr ORDER BY time)""")
def online_state_changes(spark, folder):
    r = arriving(spark, folder, late=3600).select(F.col("user_id").cast("string").alias("key"), F.col("t").alias("time"), F.concat(F.lit("state="), "event_type").alias("info"))
    return stateful.current_states(run.replay(stateful.state_sequence(r, lateness="1 hour"))).drop("no")


@query(f"""WITH {V.RAW}, s AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY xor(event_id::BIGINT, 5461) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM raw)
    SELECT user_id AS event_id, t AS time FROM s WHERE m IS NULL OR t >= m""")
def samples_in_order(spark, folder):
    r = live(spark, folder).select(F.col("event_id").cast("bigint").bitwiseXOR(F.lit(5461).cast("bigint")).alias("seq"), F.col("user_id").alias("event_id"), F.col("t").alias("time"),
                                   F.array(F.col("value").cast("float")).alias("value"))
    return run.replay(stateful.in_order(r)).select("event_id", "time")


@query(f"""WITH {V.SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY time DESC) AS k FROM smp)
    SELECT event_id AS id, true AS present, count(*) AS n, min(time) AS oldest, max(time) AS newest, round(sum(CAST(v AS DOUBLE)), 3) AS total FROM r WHERE k <= 3 GROUP BY event_id""")
def live_view(spark, folder):
    r = arriving(spark, folder)
    # every sample comes with a (re)statement of its event just before it
    parts = F.explode(F.array(F.struct(F.lit("modified").alias("change"), F.lit(0).alias("place")), F.struct(F.lit("data_added").alias("change"), F.lit(1).alias("place"))))
    df = r.withColumn("p", parts).select(
        F.col("user_id").alias("id"), (F.round(F.col("t") * 1e6).cast("bigint") * 10 + F.col("p.place")).alias("seq"), F.col("p.change").alias("change"),
        F.lit(0.0).alias("start_time"), F.col("t").alias("end_time"), F.lit("kind=user").alias("tags"), F.col("t").alias("time"),
        F.array(F.col("value").cast("float")).alias("value"))
    out = run.newest(run.replay(stateful.live_view(df, 3)), ["id"])
    total = F.aggregate("values", F.lit(0.0), lambda acc, v: acc + F.get(v, F.lit(0)))
    return out.select("id", "present", F.size("times").cast("bigint").alias("n"), F.array_min("times").alias("oldest"), F.array_max("times").alias("newest"),
                      F.round(total, 3).alias("total"))


@query(f"""WITH {V.RAW}, v AS (SELECT user_id, t, CAST(value AS FLOAT) AS b, lag(t) OVER w AS t1, lag(CAST(value AS FLOAT)) OVER w AS b1 FROM raw WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY t)),
    c AS (SELECT user_id, t, CAST(CAST(value AS FLOAT) AS DOUBLE) AS a FROM raw WHERE event_type = 'click')
    SELECT CAST(c.user_id AS VARCHAR) AS key, c.user_id * 10 + 1 || ',' || (c.user_id * 10 + 5) AS instance_id, c.t AS time, a,
      CAST(CASE WHEN v.t1 IS NULL THEN v.b ELSE CAST(v.b1 + (CAST(v.b AS DOUBLE) - v.b1) * ((c.t - v.t1) / (v.t - v.t1)) AS FLOAT) END AS DOUBLE) AS b
    FROM c ASOF JOIN v ON c.user_id = v.user_id AND c.t >= v.t""")
def online_instances(spark, folder):
    df = typed_changes(spark, folder, ["click", "view"])
    out = run.replay(stateful.online_instances(df, [filters.by_tags("type=click"), filters.by_tags("type=view")], key=T.value(F.col("tags"), "user"), lateness="1 minute"))
    seen = out.where(F.col("kind") == "observe")
    part = [F.get(F.get("values", F.lit(i)), F.lit(0)).cast("double") for i in (0, 1)]
    return seen.select("key", "instance_id", "time", part[0].alias("a"), part[1].alias("b"))


def typed_changes(spark, folder, types, ending=False):
    """The changes of each user's series of these types, in three batches: begun before the first sample, and with `ending` ended after the last one."""
    r = arriving(spark, folder).where(F.col("event_type").isin(*types))
    series = V.typed_series(spark, folder).events.select(F.col("id").alias("series"), "start_time", F.col("end_time").alias("last"))
    code = F.array_position(F.array(*[F.lit(t) for t in V.TYPES]), F.col("event_type"))
    df = r.withColumn("id", F.col("user_id") * 10 + code).join(series, F.col("id") == F.col("series"))
    begins = F.when(F.col("t") == F.col("start_time"), F.array(F.lit("added"))).otherwise(F.array().cast("array<string>"))
    ends = F.when((F.col("t") == F.col("last")) & F.lit(ending), F.array(F.lit("modified"))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("change", F.explode(F.concat(begins, F.array(F.lit("data_added")), ends)))
    place = F.when(F.col("change") == "added", 0).when(F.col("change") == "data_added", 1).otherwise(2)
    return df.select(
        "id", (F.round(F.col("t") * 1e6).cast("bigint") * 10 + place).alias("seq"), "change", "start_time",
        F.when(F.col("change") == "modified", F.col("last")).otherwise(F.lit(1.7976931348623157e308)).alias("end_time"),
        T.make(type=F.col("event_type"), user=F.col("user_id").cast("string")).alias("tags"), F.col("t").alias("time"), F.array(F.col("value").cast("float")).alias("value"))


@query(f"""WITH {V.TYPED}, n AS (SELECT event_id, time, v, lag(time) OVER w AS t1, lag(v) OVER w AS v1 FROM smp WINDOW w AS (PARTITION BY event_id ORDER BY time)),
    c AS (SELECT id, user_id, t FROM codes WHERE event_type = 'click'), i AS (SELECT * FROM ser WHERE type = 'click'),
    o AS (SELECT c.user_id, c.t, s.id AS member_id FROM c JOIN ser s ON s.user_id = c.user_id AND s.type <> 'click' AND c.t BETWEEN s.start_time AND s.end_time)
    SELECT CAST(user_id AS VARCHAR) AS key, 'init' AS kind, start_time AS time, NULL::BIGINT AS member_id, NULL::DOUBLE AS value FROM i
    UNION ALL SELECT CAST(user_id AS VARCHAR), 'done', end_time, NULL, NULL FROM i
    UNION ALL SELECT CAST(user_id AS VARCHAR), 'observe', t, NULL, NULL FROM c
    UNION ALL SELECT CAST(o.user_id AS VARCHAR), 'member', o.t, o.member_id,
      CAST(CASE WHEN n.t1 IS NULL OR n.time = o.t THEN n.v ELSE CAST(n.v1 + (CAST(n.v AS DOUBLE) - n.v1) * ((o.t - n.t1) / (n.time - n.t1)) AS FLOAT) END AS DOUBLE)
    FROM o ASOF JOIN n ON o.member_id = n.event_id AND o.t >= n.time""")
def online_groups(spark, folder):
    # a user's clicks, observed with the user's series of other types that go on at the time
    df = typed_changes(spark, folder, V.TYPES, ending=True)
    rest = filters.by_tags("type=error;type=purchase;type=signup;type=view")
    out = run.replay(stateful.online_instances(df, [filters.by_tags("type=click")], [rest], key=T.value(F.col("tags"), "user"), lateness="1 minute"))
    none = [F.lit(None).cast("bigint").alias("member_id"), F.lit(None).cast("double").alias("value")]
    members = out.select("key", F.lit("member").alias("kind"), "time", F.explode("members").alias("m"))
    members = members.select("key", "kind", "time", F.col("m.member_id").alias("member_id"), F.get("m.value", F.lit(0)).cast("double").alias("value"))
    return out.select("key", "kind", "time", *none).unionByName(members)


@query(f"""WITH {V.RAW} SELECT event_id, t FROM raw""")
def lateness(spark, folder):
    # every row is delivered twice, the second time up to ten minutes later
    r = V.raw(spark, folder).withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    r = r.withColumn("arrives", F.col("t") + F.col("again") * (F.col("event_id") % 600))
    stream = run.in_batches(r.select("event_id", "t", "arrives"), "arrives", 3)
    return run.replay(feeds.with_lateness(stream, "t", "1 hour", ["event_id"])).select("event_id", "t")


@query(f"""WITH {V.EV} SELECT 'clicks' AS subscriber, id, 'added' AS change FROM ev WHERE type = 'click'
    UNION ALL SELECT 'user 1 or 2', id, 'added' FROM ev WHERE usr IN ('1', '2')""")
def accumulated_changes(spark, folder):
    # two subscribers of one feed: each one's changes are kept until they are fetched
    out = []
    for name, f in (("clicks", "type=click"), ("user 1 or 2", "user=1;user=2")):
        r = arriving(spark, folder)
        tags = T.make(type=F.col("event_type"), user=F.col("user_id").cast("string"))
        events = r.select(F.col("event_id").alias("id"), F.col("t").alias("start_time"), (F.col("t") + F.col("value")).alias("end_time"), tags.alias("tags"))
        feed = feeds.change_feed(feeds.inserts(events), filters.by_tags(f)).select("id", "change")
        path, job = run.work_folder(spark, "kept"), f"{name} {uuid.uuid4().hex}"
        q = run.accumulate(feed, path, job)
        q.processAllAvailable()
        run.unsubscribe(spark, job)
        out.append(spark.read.schema("id long, change string").parquet(path).withColumn("subscriber", F.lit(name)))
    return out[0].unionByName(out[1])


@query()
def pattern_windows_stream(spark, folder):
    shape = spark.createDataFrame([("peak", float(i), v) for i, v in SHAPE], "name string, time double, value array<double>")
    r = live(spark, folder).select(F.col("user_id").alias("event_id"), F.col("t").alias("time"),
                                   F.array(F.col("value").cast("float"), F.col("k").cast("float")).alias("value"))
    return run.replay(stateful.pattern_windows(r, patterns.load(shape), 0.25, 0.04)).drop("batch")
