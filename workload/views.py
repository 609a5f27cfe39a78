"""The test tables as events and timeseries, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotag.functions import tags as T
from chronotag.model import Store, epoch_seconds

# --- Spark ---------------------------------------------------------------------------------------

TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw(spark, folder) -> DataFrame:
    df = table(spark, folder, "events")
    return df.select("event_id", epoch_seconds(df, "ts").alias("t"), "user_id", "event_type", "value",
                     F.get_json_object("props", "$.k").alias("k"))


def events(spark, folder) -> DataFrame:
    """Every row as an event that lasts `value` seconds, tagged with user, type and k."""
    r = raw(spark, folder)
    user = F.col("user_id").cast("string")
    return r.select(F.col("event_id").alias("id"), F.col("t").alias("start_time"), (F.col("t") + F.col("value")).alias("end_time"),
                    T.make(k=F.col("k"), type=F.col("event_type"), user=user).alias("tags"),
                    F.col("event_type").alias("tag:type"), user.alias("tag:user"))


def orders(spark, folder, with_flags: bool = True) -> DataFrame:
    """Orders as events of 30 days, tagged with customer, priority, status and, possibly several
    times, the return flags of their items."""
    o = table(spark, folder, "orders")
    if not with_flags:
        start = epoch_seconds(o, "o_orderdate")
        return o.select(F.col("o_orderkey").alias("id"), start.alias("start_time"), (start + 30 * 86400).alias("end_time"),
                        T.make(cust=F.col("o_custkey").cast("string"), priority=F.col("o_orderpriority"), status=F.col("o_orderstatus")).alias("tags"))
    items = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    o = o.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    flags = F.transform(F.coalesce("flags", F.array().cast("array<string>")), lambda f: F.struct(F.lit("flag").alias("name"), f.alias("value")))
    start = epoch_seconds(o, "o_orderdate")
    base = T.make(cust=F.col("o_custkey").cast("string"), priority=F.col("o_orderpriority"), status=F.col("o_orderstatus"))
    return o.select(F.col("o_orderkey").alias("id"), start.alias("start_time"), (start + 30 * 86400).alias("end_time"),
                    T.canonical(F.concat(base, flags)).alias("tags"))


def user_series(spark, folder) -> Store:
    """One series per user, from the first to the last time, with the values as samples."""
    r = raw(spark, folder)
    ev = r.groupBy("user_id").agg(F.min("t").alias("start_time"), F.max("t").alias("end_time"))
    ev = ev.select(F.col("user_id").alias("id"), "start_time", "end_time", T.make(user=F.col("user_id").cast("string")).alias("tags"))
    smp = r.select(F.col("user_id").alias("event_id"), F.col("t").alias("time"), F.array(F.col("value").cast("float")).alias("value"))
    return Store(ev, smp)


def plane_series(spark, folder) -> Store:
    """As `user_series`, with k as a second dimension."""
    s = user_series(spark, folder)
    r = raw(spark, folder)
    return s.with_(samples=r.select(F.col("user_id").alias("event_id"), F.col("t").alias("time"),
                                    F.array(F.col("value").cast("float"), F.col("k").cast("float")).alias("value")))


def typed_series(spark, folder) -> Store:
    """One series per user and type; ids are 10 * user + number of the type."""
    r = raw(spark, folder)
    code = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("event_type"))
    r = r.withColumn("id", F.col("user_id") * 10 + code)
    ev = r.groupBy("id", "user_id", "event_type").agg(F.min("t").alias("start_time"), F.max("t").alias("end_time"))
    ev = ev.select("id", "start_time", "end_time",
                   T.make(type=F.col("event_type"), user=F.col("user_id").cast("string")).alias("tags"))
    smp = r.select(F.col("id").alias("event_id"), F.col("t").alias("time"),
                   F.array(F.col("value").cast("float"), F.col("k").cast("float")).alias("value"))
    return Store(ev, smp)


def coordinates(spark, folder) -> DataFrame:
    """secondsUTC, and userSeconds counted from every user's first event."""
    first = raw(spark, folder).groupBy("user_id").agg(F.min("t").alias("t0"))
    own = first.select(T.make(timeCoordinate=F.lit("userSeconds"), user=F.col("user_id").cast("string")).alias("tags"),
                       F.lit(1.0).alias("slope"), (-F.col("t0")).alias("intercept"))
    utc = spark.range(1).select(T.make(timeCoordinate=F.lit("secondsUTC")).alias("tags"), F.lit(1.0).alias("slope"),
                                F.lit(0.0).alias("intercept"))
    return own.unionByName(utc)


def in_utc(df: DataFrame) -> DataFrame:
    """Events marked as being in secondsUTC."""
    return df.withColumn("tags", T.add(F.col("tags"), T.lit_tags("timeCoordinate=secondsUTC")))


def observations(spark, folder) -> DataFrame:
    """Samples of the plane series as observations: one instance per user, feature x (2-D) and v (1-D)."""
    s = plane_series(spark, folder)
    return s.samples.select(F.col("event_id").alias("instance_id"), "time", F.col("value").alias("x"),
                            F.slice("value", 1, 1).alias("v"))


def t0(spark, folder) -> float:
    """The first time of the table, as a base for query times."""
    return raw(spark, folder).agg(F.min("t")).first()[0]


def flat(df: DataFrame, *names: str) -> DataFrame:
    """Vector columns as columns name_0, name_1 of doubles."""
    for n in names:
        df = df.withColumns({f"{n}_0": F.get(F.col(n), F.lit(0)).cast("double"), f"{n}_1": F.get(F.col(n), F.lit(1)).cast("double")}).drop(n)
    return df


def show_tags(df: DataFrame) -> DataFrame:
    """The columns of events with the tagset as text."""
    return df.select("id", "start_time", "end_time", T.to_text(F.col("tags")).alias("tags"))


# --- SQL -----------------------------------------------------------------------------------------

RAW = """raw AS (SELECT event_id, epoch_us(ts) / 1e6 AS t, user_id, event_type, value, json_extract_string(props, '$.k') AS k
    FROM events)"""
EV = RAW + """, ev AS (SELECT event_id AS id, t AS start_time, t + value AS end_time, CAST(user_id AS VARCHAR) AS usr,
    event_type AS type, k, user_id, 'k=' || k || ',type=' || event_type || ',user=' || user_id AS tags FROM raw)"""
EV_TAGS = EV + """, ev_tags AS (SELECT id, 'k' AS name, k AS value FROM ev UNION ALL SELECT id, 'type', type FROM ev
    UNION ALL SELECT id, 'user', usr FROM ev)"""
FLAGS = """flags AS (SELECT DISTINCT l_orderkey AS id, l_returnflag AS flag FROM lineitem)"""
ORD = FLAGS + """, ord AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) / 1e6 AS start_time,
    epoch_us(o_orderdate) / 1e6 + 30 * 86400 AS end_time, o_custkey AS cust, o_orderpriority AS priority, o_orderstatus AS status
    FROM orders)"""
SERIES = RAW + """, ser AS (SELECT user_id AS id, min(t) AS start_time, max(t) AS end_time FROM raw GROUP BY user_id),
    smp AS (SELECT user_id AS event_id, t AS time, CAST(value AS FLOAT) AS v, CAST(k AS FLOAT) AS w FROM raw)"""
TYPED = RAW + """, codes AS (SELECT *, user_id * 10 + CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
    WHEN 'signup' THEN 4 ELSE 5 END AS id FROM raw),
    ser AS (SELECT id, user_id, event_type AS type, min(t) AS start_time, max(t) AS end_time FROM codes GROUP BY ALL),
    smp AS (SELECT id AS event_id, t AS time, CAST(value AS FLOAT) AS v, CAST(k AS FLOAT) AS w FROM codes)"""
T0 = "(SELECT min(t) FROM raw)"
# samples with their neighbours, for values at any time
NEAR = """near AS (SELECT event_id, time, v, lag(time) OVER s AS t1, lag(v) OVER s AS v1, lead(time) OVER s AS t2, lead(v) OVER s AS v2,
    w, lag(w) OVER s AS w1, lead(w) OVER s AS w2,
    min(time) OVER (PARTITION BY event_id) AS first_time FROM smp WINDOW s AS (PARTITION BY event_id ORDER BY time))"""


def value_sql(time: str, value: str = "v", n: str = "n") -> str:
    """Value at a time on the sample `n` (the newest at or before it, or the first one)."""
    f = f"CAST({{0}} + ({{1}} - {{0}}) * (({time} - {{2}}) / ({{3}} - {{2}})) AS FLOAT)"
    ahead = f.format(f"{n}.{value}", f"{n}.{value}2", f"{n}.time", f"{n}.t2")
    behind = f.format(f"{n}.{value}1", f"{n}.{value}", f"{n}.t1", f"{n}.time")
    return (f"CAST(CASE WHEN {time} = {n}.time OR ({n}.t1 IS NULL AND {n}.t2 IS NULL) THEN {n}.{value} "
            f"WHEN {n}.t2 IS NOT NULL THEN {ahead} ELSE {behind} END AS DOUBLE)")
