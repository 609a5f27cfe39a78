"""Timeseries: values at a time, resampling, nearest, decimation, writing."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronotag.functions import tags as T
from chronotag.functions import vectors as W
from chronotag.model import MAX_TIME
from chronotag.operators import attachments, catalog, learners, patterns, series
from workload import views as V
from workload.events import DAY, HOUR
from workload.registry import query


def scalar(df, name="value"):
    return df.withColumn(name, F.get(F.col(name), F.lit(0)).cast("double"))


# every series is asked for its value at each type's first time and a little later
PROBES = """probe AS (SELECT s.id AS event_id, x.t + d.range * 1234.5 AS time, x.event_type AS what FROM ser s,
    (SELECT event_type, max(t) AS t FROM raw GROUP BY event_type) x, (SELECT -1000 AS range UNION ALL SELECT 0 UNION ALL SELECT -3 UNION ALL SELECT 5) d)"""
ASOF = """look AS (SELECT p.*, a.time AS at FROM probe p ASOF LEFT JOIN smp a ON p.event_id = a.event_id AND p.time >= a.time),
    n AS (SELECT l.event_id AS id_, l.time AS asked, l.what, near.* FROM look l JOIN near ON near.event_id = l.event_id
      AND near.time = coalesce(l.at, near.first_time))"""


def probes(spark, folder):
    # four times per type: a column of one row with all types, joined to every series
    lasts = V.raw(spark, folder).groupBy("event_type").agg(F.max("t").alias("t"))
    lasts = lasts.agg(F.collect_list(F.struct("event_type", "t")).alias("lasts")).withColumn("one", F.lit(1))
    s = V.user_series(spark, folder)
    p = (s.events.select(F.col("id").alias("event_id"), F.lit(1).alias("one")).join(F.broadcast(lasts), "one")
         .select("event_id", F.explode("lasts").alias("l")).select("event_id", "l.*", F.explode(F.array(*[F.lit(float(d)) for d in (-1000, 0, -3, 5)])).alias("d")))
    return s, p.select("event_id", (F.col("t") + F.col("d") * F.lit(1234.5)).alias("time"), F.col("event_type").alias("what"))


@query(f"WITH {V.SERIES}, {V.NEAR}, {PROBES}, {ASOF} SELECT event_id, asked AS time, what, CAST(v AS DOUBLE) AS value FROM n")
def value_prev(spark, folder):
    s, p = probes(spark, folder)
    return scalar(series.value_prev(p, s.samples))


@query(f"WITH {V.SERIES}, {V.NEAR}, {PROBES}, {ASOF} SELECT event_id, asked AS time, what, {V.value_sql('n.asked')} AS value FROM n")
def value_linear(spark, folder):
    s, p = probes(spark, folder)
    return scalar(series.value_linear(p, s.samples))


@query(f"""WITH {V.SERIES}, {V.NEAR}, {PROBES}, {ASOF} SELECT n.event_id, asked AS time, what, CASE WHEN n.event_id % 2 = 0 THEN CAST(v AS DOUBLE)
    ELSE {V.value_sql('n.asked')} END AS value FROM n""")
def value_in_tagged_mode(spark, folder):
    s, p = probes(spark, folder)
    # half of the series say that they hold their value
    mode = F.when(F.col("id") % 2 == 0, T.lit_tags("interpolate=prev")).otherwise(F.expr(T.EMPTY))
    s = s.with_(events=s.events.withColumn("tags", T.add(F.col("tags"), mode)))
    return scalar(series.value(p, s))


GRID = f"""probe AS (SELECT id AS event_id, {V.T0} + 86400 + i.range * 7200.0 AS time, '' AS what FROM ser, range(200) i)"""


@query(f"""WITH {V.SERIES}, {V.NEAR}, {GRID}, {ASOF} SELECT n.event_id, asked AS time,
    CASE WHEN asked BETWEEN start_time AND end_time THEN {V.value_sql('n.asked')} END AS value FROM n JOIN ser ON ser.id = n.event_id""")
def resample_grid(spark, folder):
    s = V.user_series(spark, folder)
    return scalar(series.resample_grid(s, s.events, V.t0(spark, folder) + DAY, 2 * HOUR, 200))


@query(f"""WITH {V.SERIES}, {V.NEAR}, probe AS (SELECT id AS event_id, start_time + unnest(range(CAST(1 + floor((end_time - start_time) / 43200.0) AS BIGINT))) * 43200.0 AS time,
      '' AS what FROM ser), {ASOF} SELECT n.event_id, asked AS time, {V.value_sql('n.asked')} AS value FROM n""")
def resample_each(spark, folder):
    s = V.user_series(spark, folder)
    return scalar(series.resample_each(s, s.events, DAY / 2))


@query(f"""WITH {V.SERIES}, {V.NEAR}, probe AS (SELECT id AS event_id, start_time + unnest(range(CAST(1 + floor((end_time - start_time) / 43200.0) AS BIGINT))) * 43200.0 AS time,
      '' AS what FROM ser), {ASOF} SELECT n.event_id, asked AS time, {V.value_sql('n.asked')} AS value FROM n""")
def resample_each_open(spark, folder):
    # every second user's series has no end yet: its grid goes to its newest sample
    s = V.user_series(spark, folder)
    ev = s.events.withColumn("end_time", F.when(F.col("id") % 2 == 0, F.lit(MAX_TIME)).otherwise(F.col("end_time")))
    return scalar(series.resample_each(s.with_(events=ev), ev, DAY / 2))


@query(f"""WITH {V.TYPED}, {V.NEAR}, grp AS (SELECT user_id AS group_id, list(id ORDER BY id) AS ids, max(start_time) AS lo, min(end_time) AS hi FROM ser GROUP BY user_id),
    probe AS (SELECT m.id AS event_id, s.time, group_id, list_position(ids, m.id) - 1 AS what FROM grp, unnest(ids) m(id), smp s
      WHERE s.event_id = ids[1] AND s.time BETWEEN lo AND hi), {ASOF}
    SELECT n.event_id // 10 AS group_id, n.asked AS time, CAST(what AS INTEGER) AS position, n.event_id, {V.value_sql('n.asked')} AS value FROM n""")
def resample_on_first(spark, folder):
    s = V.typed_series(spark, folder)
    user = T.value(F.col("tags"), "user").cast("bigint")
    groups = s.events.groupBy(user.alias("group_id")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return scalar(series.resample_on_first(s, groups))


@query(f"WITH {V.SERIES} SELECT time FROM smp WHERE event_id = 7 AND time >= {V.T0} + 86400")
def sample_times(spark, folder):
    return series.sample_times(V.user_series(spark, folder).samples, 7, V.t0(spark, folder) + DAY)


@query(f"""WITH {V.SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY time DESC) AS rn FROM smp)
    SELECT id, start_time, end_time, time, CAST(v AS DOUBLE) AS value FROM r JOIN ser ON id = event_id WHERE rn <= 5""")
def recent_samples(spark, folder):
    return scalar(series.with_samples(V.user_series(spark, folder), "user", recent=5)).drop("tags")


@query(f"""WITH {V.SERIES}, c AS (SELECT {V.T0} + 5 * 86400 AS a, {V.T0} + 6 * 86400 AS z),
    b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY time DESC) AS rn FROM smp, c WHERE time < a),
    f AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY time) AS rn FROM smp, c WHERE time > z)
    SELECT event_id, time, CAST(v AS DOUBLE) AS value FROM smp, c WHERE time BETWEEN a AND z
    UNION ALL SELECT event_id, time, CAST(v AS DOUBLE) FROM b WHERE rn <= 2 UNION ALL SELECT event_id, time, CAST(v AS DOUBLE) FROM f WHERE rn <= 3""")
def samples_in_range(spark, folder):
    t0 = V.t0(spark, folder)
    return scalar(series.samples_in_range(V.user_series(spark, folder).samples, t0 + 5 * DAY, t0 + 6 * DAY, 2, 3))


@query(f"""WITH {V.SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY time) AS rn FROM smp)
    SELECT event_id, time, CAST(v AS DOUBLE) AS value FROM r WHERE rn > 10 AND rn <= 15""")
def samples_by_offset(spark, folder):
    return scalar(series.samples_by_offset(V.user_series(spark, folder).samples, 10, 5))


@query(f"""WITH {V.SERIES}, t AS (SELECT {V.T0} + 12 * 86400 AS t),
    b AS (SELECT event_id, time, row_number() OVER (PARTITION BY event_id ORDER BY time DESC) AS rn FROM smp, t WHERE time < t),
    a AS (SELECT event_id, time, row_number() OVER (PARTITION BY event_id ORDER BY time) AS rn FROM smp, t WHERE time > t)
    SELECT ser.id AS event_id, coalesce(b.time, t) AS before, coalesce(a.time, t) AS after FROM ser CROSS JOIN t
    LEFT JOIN b ON b.event_id = ser.id AND b.rn = 3 LEFT JOIN a ON a.event_id = ser.id AND a.rn = 4""")
def nth_sample_times(spark, folder):
    smp, t = V.user_series(spark, folder).samples, V.t0(spark, folder) + 12 * DAY
    before = series.nth_before(smp, t, 3).withColumnRenamed("time", "before")
    return before.join(series.nth_after(smp, t, 4).withColumnRenamed("time", "after"), "event_id")


@query(f"""WITH {V.SERIES} SELECT ser.id, 2 AS dim, count(*) AS n, max(time) AS last_time FROM ser JOIN smp ON event_id = ser.id GROUP BY ser.id""")
def series_facts(spark, folder):
    s = V.plane_series(spark, folder)
    return series.dimensions(s).join(series.count_and_last(s.samples), F.col("id") == F.col("event_id")).drop("event_id")


@query(f"""WITH {V.SERIES} SELECT min(time) AS min_time, max(time) AS max_time, CAST(min(v) AS DOUBLE) AS min_0, CAST(max(v) AS DOUBLE) AS max_0,
    CAST(min(w) AS DOUBLE) AS min_1, CAST(max(w) AS DOUBLE) AS max_1 FROM smp""")
def data_range(spark, folder):
    df = catalog.data_range(V.plane_series(spark, folder).samples, 2)
    return df.select("min_time", "max_time", *[F.col(f"{m}_{i}").cast("double") for m in ("min", "max") for i in (0, 1)])


@query(f"""WITH {V.SERIES}, {V.NEAR}, probe AS (SELECT id AS event_id, {V.T0} + 10 * 86400 AS time, '' AS what FROM ser
      WHERE {V.T0} + 10 * 86400 BETWEEN start_time AND end_time), {ASOF},
    x AS (SELECT event_id AS id, {V.value_sql('n.asked')} AS x FROM n)
    SELECT id, x, abs(x - 20.0) AS dist FROM (SELECT *, abs(x - 20.0) AS d FROM x ORDER BY d, id LIMIT 25) WHERE d <= 15.0""")
def nearest_series(spark, folder):
    df = series.nearest(V.user_series(spark, folder), "user", [20.0], V.t0(spark, folder) + 10 * DAY, 15.0, 25)
    return scalar(df, "x").select("id", "x", "dist")


@query(f"WITH {V.SERIES} SELECT DISTINCT event_id FROM smp WHERE v >= 100 AND v <= 150 AND w <= 20")
def inside_box(spark, folder):
    return series.inside_box(V.plane_series(spark, folder).samples, [100.0, None], [150.0, 20.0])


@query(f"""WITH RECURSIVE {V.SERIES}, kept AS (SELECT event_id, min(time) AS time FROM smp GROUP BY event_id
    UNION ALL SELECT k.event_id, (SELECT min(s.time) FROM smp s WHERE s.event_id = k.event_id AND s.time - k.time >= 7200.0) AS time FROM kept k
      WHERE k.time IS NOT NULL) SELECT event_id, time FROM kept WHERE time IS NOT NULL""")
def decimate(spark, folder):
    return series.decimate(V.user_series(spark, folder).samples, 2 * HOUR, cell=DAY).select("event_id", "time")


@query(f"""WITH {V.SERIES}, e AS (SELECT event_id, max(time) AS m FROM smp GROUP BY event_id)
    SELECT ser.id, start_time, m + 60 AS end_time, count(*) + 1 AS n FROM ser JOIN e ON e.event_id = ser.id JOIN smp ON smp.event_id = ser.id GROUP BY ALL""")
def add_samples(spark, folder):
    s = V.user_series(spark, folder)
    last = s.samples.groupBy("event_id").agg(F.max("time").alias("t"))
    # two new samples each, of which the second comes too soon after the first
    new = last.select("event_id", F.explode(F.array(F.col("t") + 60, F.col("t") + 65)).alias("time"), W.vector(1.0).alias("value"))
    s = series.add_samples(s, new, min_delta=30.0, move_end=True)
    n = s.samples.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    return s.events.join(n, F.col("id") == F.col("event_id")).select("id", "start_time", "end_time", "n")


@query(f"WITH {V.TYPED} SELECT max(start_time) AS start_time, min(end_time) AS end_time FROM ser WHERE id IN (11, 12, 13, 14, 15)")
def shared_lifetime(spark, folder):
    return series.shared_lifetime(V.typed_series(spark, folder), [11, 12, 13, 14, 15])


# one sample for every click series that lives then, and a series begun where no series has the tags
@query(f"""WITH {V.TYPED}, hit AS (SELECT id FROM ser WHERE type = 'click' AND {V.T0} + 864000 BETWEEN start_time AND end_time)
    SELECT type, count(DISTINCT ser.id) AS n_series, count(*) + CASE WHEN type = 'click' THEN (SELECT count(*) FROM hit) ELSE 0 END AS n_samples
    FROM ser JOIN smp ON smp.event_id = ser.id GROUP BY type UNION ALL SELECT 'none', 1, 1""")
def add_sample_by_tags(spark, folder):
    s, time = V.typed_series(spark, folder), V.t0(spark, folder) + 10 * DAY
    s, _ = series.add_sample_by_tags(s, "type=click", time, [1.0, 2.0])
    s, _ = series.add_sample_by_tags(s, "type=none", time, [1.0, 2.0])
    kinds = s.events.select(F.col("id").alias("event_id"), T.value(F.col("tags"), "type").alias("type"))
    return s.samples.join(kinds, "event_id").groupBy("type").agg(F.countDistinct("event_id").alias("n_series"), F.count(F.lit(1)).alias("n_samples"))


# tables linked to all errors; one link replaced, one added in another schema, one taken away
@query(f"""WITH {V.RAW} SELECT event_id, 'log' AS schema_name, 'log_' || k AS table_name FROM raw WHERE event_type = 'error' AND event_id NOT IN (3, 5)
    UNION ALL SELECT 3, 'log', 'other' UNION ALL SELECT 4, 'img', 'picture'""")
def linked_tables(spark, folder):
    links = V.raw(spark, folder).where("event_type = 'error'").select(
        "event_id", F.lit("log").alias("schema_name"), F.concat(F.lit("log_"), "k").alias("table_name"))
    s = V.typed_series(spark, folder).with_(attachments=links)
    s = attachments.attach_table(attachments.attach_table(s, 3, "log", "other"), 4, "img", "picture")
    return attachments.delete_attachments(s, "log", 5).attachments


# --- vectors -----------------------------------------------------------------------------------------

@query("""WITH q AS (SELECT [CAST(0.1 AS FLOAT) for x in range(64)] AS q), d AS (SELECT vec_id, label, list_sum(list_transform(range(1, 65),
      lambda i: (CAST(q[i] - embedding[i] AS DOUBLE)) * (CAST(q[i] - embedding[i] AS DOUBLE)))) AS d2 FROM embeddings, q)
    SELECT vec_id, label, round(sqrt(d2), 9) AS dist FROM d ORDER BY d2, vec_id LIMIT 20""")
def nearest_embedding(spark, folder):
    e = V.table(spark, folder, "embeddings")
    point = W.vector(*[0.1] * 64)
    return (e.withColumn("d", W.distance(F.col("embedding"), point)).orderBy("d", "vec_id").limit(20)
            .select("vec_id", "label", F.round("d", 9).alias("dist")))


EMB = """e AS (SELECT vec_id, label, embedding AS x FROM embeddings), s AS (SELECT i.range + 1 AS i, avg(CAST(x[i.range + 1] AS DOUBLE)) AS m,
      sqrt(var_samp(CAST(x[i.range + 1] AS DOUBLE)) + 1e-5) AS s FROM e, range(64) i GROUP BY 1),
    z AS (SELECT vec_id, any_value(label) AS label, list((CAST(x[i] AS DOUBLE) - m) / s ORDER BY i) AS z FROM e, s GROUP BY vec_id)"""


@query(f"""WITH {EMB}, d AS (SELECT a.vec_id AS query_id, b.vec_id AS train_id, b.label, list_sum(list_transform(range(1, 65),
      lambda i: (a.z[i] - b.z[i]) * (a.z[i] - b.z[i]))) AS d2 FROM z a, z b),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, train_id) AS rn FROM d)
    SELECT query_id, round(avg(label), 9) AS prediction FROM r WHERE rn <= 5 GROUP BY query_id""")
def knn_predict(spark, folder):
    e = V.table(spark, folder, "embeddings").withColumnRenamed("embedding", "x")
    train = e.select(F.col("vec_id").alias("train_id"), "x", F.col("label").cast("double").alias("y"))
    out = learners.knn_predict(e.select(F.col("vec_id").alias("query_id"), "x"), train, 64, query_rows=200, train_rows=300)
    return out.withColumn("prediction", F.round("prediction", 9))


@query(f"""WITH {V.RAW}, tr AS (SELECT event_type, k, arg_max(value, event_id) AS y FROM raw GROUP BY ALL)
    SELECT event_id AS query_id, y AS prediction FROM raw LEFT JOIN tr USING (event_type, k)""")
def lookup_predict(spark, folder):
    r = V.raw(spark, folder).withColumn("x", F.array((F.array_position(F.array(*[F.lit(t) for t in V.TYPES]), F.col("event_type"))).cast("float"),
                                                     F.col("k").cast("float")))
    train = r.select(F.col("event_id").alias("train_id"), "x", F.col("value").alias("y"))
    return learners.lookup_predict(r.select(F.col("event_id").alias("query_id"), "x"), train)


@query()
def local_regression(spark, folder):
    return learners.local_regression(*_labelled(spark, folder), 64)


def _labelled(spark, folder):
    e = V.table(spark, folder, "embeddings").withColumnRenamed("embedding", "x")
    return (e.select(F.col("vec_id").alias("query_id"), "x"),
            e.select(F.col("vec_id").alias("train_id"), "x", F.col("label").cast("double").alias("y")))


@query()
def tree_predict(spark, folder):
    return learners.tree_predict(*_labelled(spark, folder))


@query()
def bayes_predict(spark, folder):
    return learners.bayes_predict(*_labelled(spark, folder))


@query()
def svm_predict(spark, folder):
    q, t = _labelled(spark, folder)
    return learners.svm_predict(q, t.withColumn("y", F.when(F.col("y") >= 5, 1.0).otherwise(-1.0)))


# --- patterns ------------------------------------------------------------------------------------------

# a rise and fall in the values
SHAPE = [(i, [v, 0.0]) for i, v in enumerate([0.0, 1.0, 3.0, 9.0, 3.0, 1.0, 0.0])]


@query()
def pattern_matches(spark, folder):
    shape = spark.createDataFrame([("peak", float(i), v) for i, v in SHAPE], "name string, time double, value array<double>")
    found = patterns.load(shape, patterns.rates(1.5, 2))
    return patterns.match(V.plane_series(spark, folder).samples, found, 0.25, 0.04)


@query()
def aligned_users(spark, folder):
    # every user's daily totals against those of the next user
    r = V.raw(spark, folder).withColumn("day", F.floor(F.col("t") / DAY))
    daily = r.groupBy("user_id", "day").agg(F.round(F.sum("value"), 2).alias("v"))
    runs = daily.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "v"))), lambda s: s["v"]).alias("a"))
    other = runs.select((F.col("user_id") - 1).alias("user_id"), F.col("a").alias("b"))
    return patterns.align(runs.join(other, "user_id").withColumnRenamed("user_id", "pair_id"))
