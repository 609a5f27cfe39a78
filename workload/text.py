"""Line files written from the tables and read back, and queries whose text is SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronotag.functions import sql
from chronotag.functions import tags as T
from chronotag.model import EVENT_COLUMNS, EVENTS, SAMPLES, Store
from chronotag.sources import textio
from chronotag.streaming.run import work_folder
from workload import views as V
from workload.registry import query
from workload.series import ASOF


def _lines(spark, folder, mux=False):
    """A folder of line files: per user a tag line, its samples, tags added half-way, a last time and, unless routed, a blank line."""
    r = V.raw(spark, folder)
    ends = r.groupBy("user_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    half = (F.col("lo") + F.col("hi")) / 2
    head = ends.select("user_id", F.col("lo").alias("at"), F.lit(0).alias("place"), F.concat(F.lit("kind=user,start="), F.col("lo") - 1.5, F.lit(",user="), "user_id").alias("text"))
    more = ends.select("user_id", half.alias("at"), F.lit(1).alias("place"), F.concat(F.lit("+seen="), F.col("user_id") % 7).alias("text"))
    data = r.select("user_id", F.col("t").alias("at"), F.lit(2).alias("place"), F.concat_ws(",", F.col("t").cast("string"), F.col("value").cast("float").cast("string"), "k").alias("text"))
    last = ends.select("user_id", F.col("hi").alias("at"), F.lit(3).alias("place"), (F.col("hi") + 60).cast("string").alias("text"))
    blank = ends.select("user_id", F.col("hi").alias("at"), F.lit(4).alias("place"), F.lit("").alias("text"))
    rows = head.unionByName(more).unionByName(data).unionByName(last)
    path = work_folder(spark, "lines")
    files = max(3, r.count() // 500_000)  # a task sorts the lines of one file
    if mux:  # the users' lines one among the other, in order of time
        rows = rows.repartition(files, F.col("user_id") % files).sortWithinPartitions("at", "user_id", "place", "text")
        rows = rows.select(F.concat(F.lit("u"), "user_id", F.lit(" "), "text").alias("value"))
    else:
        rows = rows.unionByName(blank).repartition(files, "user_id").sortWithinPartitions("user_id", "at", "place", "text").select(F.col("text").alias("value"))
    rows.write.text(path)
    return path


def _read(spark, path, store=None, **options):
    """What was read: a row per series, with how many samples it has and their sums."""
    none = Store(spark.createDataFrame([], EVENTS), spark.createDataFrame([], SAMPLES))
    old = store or none
    out = textio.put(old, path, **options)
    n = out.samples.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.get("value", F.lit(0)).cast("double")), 3).alias("v"),
                                            F.round(F.sum(F.get("value", F.lit(1)).cast("double")), 3).alias("k"))
    new = out.events.join(old.events.select("id"), "id", "left_anti")
    return new.join(n, F.col("id") == F.col("event_id")).select("start_time", "end_time", T.to_text(F.col("tags")).alias("tags"), "n", "v", "k")


_READ = f"""{V.SERIES}, got AS (SELECT id, min(time) - 1.5 AS start_time, max(time) + 60 AS end_time, 'kind=user,seen=' || id % 7 || ',user=' || id AS tags, count(*) AS n,
    round(sum(v::DOUBLE), 3) AS v, round(sum(w::DOUBLE), 3) AS k FROM ser JOIN smp ON event_id = id GROUP BY id)"""


@query(f"WITH {_READ} SELECT start_time, end_time, tags, n, v, k FROM got")
def text_ingest(spark, folder):
    return _read(spark, _lines(spark, folder))


@query(f"WITH {_READ} SELECT start_time, end_time, 'from=mux,' || tags AS tags, n, v, k FROM got")
def text_ingest_mux(spark, folder):
    return _read(spark, _lines(spark, folder, mux=True), mux=True, add_tags="from=mux")


@query(f"WITH {_READ} SELECT start_time, end_time, tags, n, v, k FROM got WHERE id % 3 <> 0")
def text_ingest_unique(spark, folder):
    # series of every third user exist already, with more tags
    old = V.user_series(spark, folder)
    known = old.events.where("id % 3 = 0").withColumn("tags", T.add(F.col("tags"), T.lit_tags("kind=user,more=1"))).select(*EVENT_COLUMNS)
    store = Store(known, old.samples.where("event_id % 3 = 0"))
    return _read(spark, _lines(spark, folder), store, unique=True)


@query(f"""WITH RECURSIVE {V.SERIES}, d AS (SELECT event_id, time, v, row_number() OVER (PARTITION BY event_id ORDER BY time) AS r FROM smp),
    ahead AS (SELECT a.event_id, a.time, min(b.time) AS nxt FROM d a LEFT JOIN d b ON a.event_id = b.event_id AND b.time - a.time >= 86400.0 GROUP BY ALL),
    kept AS (SELECT event_id, time FROM d WHERE r = 1 UNION ALL SELECT k.event_id, h.nxt FROM kept k JOIN ahead h ON h.event_id = k.event_id AND h.time = k.time WHERE h.nxt IS NOT NULL)
    SELECT 'kind=user,seen=' || k.event_id % 7 || ',user=' || k.event_id AS tags, count(*) AS n, round(sum(d.v::DOUBLE), 3) AS v FROM kept k JOIN d ON d.event_id = k.event_id AND d.time = k.time GROUP BY k.event_id""")
def text_ingest_rate(spark, folder):
    # of each series a sample a day at most
    return _read(spark, _lines(spark, folder), rate_limit=86400.0).select("tags", "n", "v")


@query(f"""WITH {V.TYPED}, a AS (SELECT * FROM ser WHERE type = 'signup'), l AS (
      SELECT id, 0 AS kind, 0.0::DOUBLE AS time, 'type=signup,user=' || user_id AS value FROM a
      UNION ALL SELECT id, 1, time, NULL FROM a JOIN smp ON event_id = id UNION ALL SELECT id, 2, 1.7976931348623157e308, '' FROM a)
    SELECT kind::INTEGER AS kind, value AS tags, count(*) AS n, sum(CASE WHEN kind = 1 THEN round(time * 1e6)::BIGINT % 1000003 END)::BIGINT AS times FROM l GROUP BY ALL""")
def export_samples(spark, folder):
    # every signup series: a tag line, its samples, a blank line
    lines = textio.export(V.typed_series(spark, folder), ["type=signup"], times=False)
    number = F.get(F.split("value", ","), F.lit(0)).try_cast("double")
    kind = F.when(F.col("value") == "", 2).when(F.contains("value", F.lit("=")), 0).otherwise(1)
    return lines.select(kind.alias("kind"), F.when(kind != 1, F.col("value")).alias("tags"), F.when(kind == 1, number).alias("t")).groupBy("kind", "tags").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("t") * 1e6).cast("bigint") % 1000003).alias("times"))


# --- queries as text ---------------------------------------------------------------------------------------

@query(f"""WITH {V.EV} SELECT x.id AS first_id, y.id AS second_id, greatest(x.start_time, y.start_time) AS start_time, least(x.end_time, y.end_time) AS end_time
    FROM ev x JOIN ev y ON x.id <> y.id AND x.start_time <= y.end_time AND y.start_time <= x.end_time WHERE x.type = 'error' AND y.type IN ('signup', 'purchase')""")
def sql_concurrent(spark, folder):
    sql.register(spark, Store(V.events(spark, folder)), "t1_")
    return spark.sql("SELECT * FROM t1_concurrent_events('type=error', 'type=signup;type=purchase', NULL, NULL)")


@query(f"WITH {V.EV} SELECT 'k=' || k || ',type=click' AS tags, count(*) AS n_events FROM ev WHERE type = 'click' GROUP BY k")
def sql_combinations(spark, folder):
    sql.register(spark, Store(V.events(spark, folder)), "t2_")
    return spark.sql("SELECT * FROM t2_tag_combinations('type=click', array('type', 'k'))")


@query(f"""WITH {V.SERIES}, {V.NEAR}, probe AS (SELECT id AS event_id, {V.T0} + 86400 + i.range * 7200.0 AS time, '' AS what FROM ser, range(200) i), {ASOF}
    SELECT n.event_id, asked AS time, CASE WHEN asked BETWEEN start_time AND end_time THEN {V.value_sql('n.asked')} END AS value FROM n JOIN ser ON ser.id = n.event_id""")
def sql_resample(spark, folder):
    sql.register(spark, V.user_series(spark, folder), "t3_")
    return spark.sql(f"SELECT event_id, time, CAST(get(value, 0) AS DOUBLE) AS value FROM t3_resample_timeseries('user', {V.t0(spark, folder) + 86400!r}D, 7200D, 200)")


@query(f"""WITH {V.SERIES}, {V.NEAR}, probe AS (SELECT id AS event_id, {V.T0} + 864000 AS time, '' AS what FROM ser WHERE {V.T0} + 864000 BETWEEN start_time AND end_time), {ASOF},
    x AS (SELECT n.event_id AS id, {V.value_sql('n.asked')} AS x FROM n) SELECT id, x, abs(x - 20.0) AS dist FROM x WHERE abs(x - 20.0) <= 15.0""")
def sql_nearest(spark, folder):
    sql.register(spark, V.user_series(spark, folder), "t4_")
    return spark.sql(f"SELECT id, CAST(get(value, 0) AS DOUBLE) AS x, dist FROM t4_nearest_timeseries('user', array(20F), {V.t0(spark, folder) + 864000!r}D, 15D)")
