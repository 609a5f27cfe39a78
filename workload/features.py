"""Feature stages over the users' series: one instance per user."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from chronotag.functions import tags as T
from chronotag.functions import vectors as W
from chronotag.operators import features as X
from chronotag.operators.features import Chain, Observations
from workload import views as V
from workload.events import DAY, HOUR
from workload.registry import query

# x = (v, w): the row, the row before and the row after
OBS = f"""{V.SERIES}, o AS (SELECT event_id AS instance_id, time, v, w, lag(time) OVER s AS pt, lag(v) OVER s AS pv, lag(w) OVER s AS pw,
    lead(time) OVER s AS nt, lead(v) OVER s AS nv, lead(w) OVER s AS nw, row_number() OVER s AS rn, count(*) OVER (PARTITION BY event_id) AS n,
    min(time) OVER (PARTITION BY event_id) AS a, max(time) OVER (PARTITION BY event_id) AS z
    FROM smp WINDOW s AS (PARTITION BY event_id ORDER BY time))"""


def run(spark, folder, *stages, keep=(), extra=None, groups=None):
    df = V.observations(spark, folder)
    if extra:
        df = df.withColumns(extra)
    return Chain(*stages).run(Observations.of(df, groups)).df().select("instance_id", "time", *keep)


def doubles(df, *names):
    """Vectors of one number as that number."""
    return df.withColumns({n: F.get(F.col(n), F.lit(0)).cast("double") for n in names})


def rounded(df, digits, *names):
    return df.withColumns({n: F.round(F.get(F.col(n), F.lit(0)).cast("double"), digits) for n in names})


RATE = "CAST(CAST(1.0::DOUBLE / CAST(CAST(time - pt AS FLOAT) AS DOUBLE) AS FLOAT) * ({0} - p{0}) AS DOUBLE)"


@query(f"WITH {OBS} SELECT instance_id, time, {RATE.format('v')} AS r_0, {RATE.format('w')} AS r_1 FROM o")
def rate(spark, folder):
    return V.flat(run(spark, folder, X.rate("r", "x"), keep=["r"]), "r")


@query(f"""WITH {OBS}, s AS (SELECT *, CASE WHEN rn = 1 THEN sqrt(CAST(nv - v AS DOUBLE) * (nv - v) + CAST(nw - w AS DOUBLE) * (nw - w)) / (nt - time)
    ELSE sqrt(CAST(v - pv AS DOUBLE) * (v - pv) + CAST(w - pw AS DOUBLE) * (w - pw)) / (time - pt) END AS s FROM o WHERE n > 1)
    SELECT instance_id, time, CAST(CAST(s AS FLOAT) AS DOUBLE) AS s FROM s""")
def speed(spark, folder):
    return doubles(run(spark, folder, X.speed("s", "x"), keep=["s"]), "s")


@query(f"""WITH {OBS}, d AS (SELECT *, CAST(v - pv AS DOUBLE) AS bx, CAST(w - pw AS DOUBLE) AS by_, lag(v - pv) OVER s::DOUBLE AS ax, lag(w - pw) OVER s::DOUBLE AS ay
      FROM o WINDOW s AS (PARTITION BY instance_id ORDER BY time)),
    r AS (SELECT *, CASE WHEN rn >= 3 THEN CAST(CAST(atan2(ax * by_ - ay * bx, ax * bx + ay * by_) / (time - pt) AS FLOAT) AS DOUBLE) END AS r FROM d WHERE n >= 3)
    SELECT instance_id, time, round(coalesce(r, first_value(r IGNORE NULLS) OVER (PARTITION BY instance_id ORDER BY time ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)), 6) AS r FROM r"""
       .replace("lag(v - pv) OVER s::DOUBLE", "CAST(lag(v - pv) OVER s AS DOUBLE)").replace("lag(w - pw) OVER s::DOUBLE", "CAST(lag(w - pw) OVER s AS DOUBLE)"))
def turn_rate(spark, folder):
    return rounded(run(spark, folder, X.turn_rate("r", "x"), keep=["r"]), 6, "r")


@query(f"""WITH {OBS}, c AS (SELECT instance_id, time, a, sum(CAST(v AS DOUBLE)) OVER (PARTITION BY instance_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS d, rn FROM o),
    f AS (SELECT *, CAST(CAST(d AS FLOAT) AS DOUBLE) AS x, time - a AS y FROM c),
    nx AS (SELECT *, lead(x) OVER s AS x2, lead(y) OVER s AS y2 FROM f WINDOW s AS (PARTITION BY instance_id ORDER BY time)),
    j AS (SELECT f.instance_id, f.time, f.x, f.y, b.x AS bx, b.y AS by_, b.x2, b.y2, row_number() OVER (PARTITION BY f.instance_id, f.time ORDER BY b.x DESC, b.time DESC) AS k
      FROM f JOIN nx b ON f.instance_id = b.instance_id AND b.x <= f.x - 500.0)
    SELECT instance_id, time, round(CAST(CAST((y - (by_ + (y2 - by_) * ((x - 500.0 - bx) / (x2 - bx)))) / 500.0 AS FLOAT) AS DOUBLE), 4) AS pace FROM j WHERE k = 1""")
def derivative_dx(spark, folder):
    # seconds per unit over the last 500 units of the running total
    df = run(spark, folder, X.running_total("d", "v"), X.derivative("pace", "time", "d", 500.0), keep=["pace"])
    return rounded(df, 4, "pace")


@query(f"WITH {OBS} SELECT instance_id, time, CAST(CAST((v - pv) / (time - pt) AS FLOAT) AS DOUBLE) AS d FROM o WHERE rn > 1"
       .replace("(v - pv) / (time - pt)", "(CAST(v AS DOUBLE) - CAST(pv AS DOUBLE)) / ((time - a) - (pt - a))"))
def derivative_dt(spark, folder):
    return doubles(run(spark, folder, X.derivative("d", "v"), keep=["d"]), "d")


def gauss(sd):
    return f"exp(-(b.time - x.time) * (b.time - x.time) / (2 * {sd} * {sd})) / {math.sqrt(2 * math.pi) * sd!r}"


@query(f"""WITH {OBS}, j AS (SELECT x.instance_id, x.time, b.v, CASE WHEN b.time <= x.time THEN {gauss(10800.0)} ELSE {gauss(3600.0)} END AS k
      FROM o x JOIN o b ON x.instance_id = b.instance_id AND b.time >= x.time - 32400.0 AND (b.time <= x.time + 10800.0 OR (b.pt < x.time + 10800.0 AND b.pt >= x.time)))
    SELECT instance_id, time, round(CAST(CAST(sum(k * v) / sum(k) AS FLOAT) AS DOUBLE), 3) AS s FROM j GROUP BY ALL""")
def smooth(spark, folder):
    return rounded(run(spark, folder, X.smoothing("s", "v", 3 * HOUR, HOUR), keep=["s"]), 3, "s")


@query(f"""WITH {OBS} SELECT instance_id, time, round(sum(CAST(v AS DOUBLE)) OVER s, 2) AS t_0, round(sum(CAST(w AS DOUBLE)) OVER s, 2) AS t_1
    FROM o WINDOW s AS (PARTITION BY instance_id ORDER BY time ROWS UNBOUNDED PRECEDING)""".replace("round(sum(CAST(v AS DOUBLE)) OVER s, 2)",
       "round(CAST(CAST(sum(CAST(v AS DOUBLE)) OVER s AS FLOAT) AS DOUBLE), 1)").replace("round(sum(CAST(w AS DOUBLE)) OVER s, 2)",
       "round(CAST(CAST(sum(CAST(w AS DOUBLE)) OVER s AS FLOAT) AS DOUBLE), 1)"))
def running_total(spark, folder):
    df = V.flat(run(spark, folder, X.running_total("t", "x", 2), keep=["t"]), "t")
    return df.withColumns({c: F.round(c, 1) for c in ("t_0", "t_1")})


@query(f"""WITH {OBS}, f AS (SELECT *, lead(v, 1) OVER s AS a1, lead(v, 3) OVER s AS a3 FROM o WINDOW s AS (PARTITION BY instance_id ORDER BY time))
    SELECT instance_id, time, CAST(a1 AS DOUBLE) AS one, CAST(a3 AS DOUBLE) AS three FROM f WHERE a3 IS NOT NULL""")
def future_value(spark, folder):
    # the second stage looks two rows ahead among the rows the first one left
    df = run(spark, folder, X.future_value("one", "v", 1), X.future_value("three", "one", 2), keep=["one", "three"])
    return doubles(df, "one", "three")


@query(f"WITH {OBS} SELECT instance_id, time, CAST(coalesce(pv, 0.5) AS DOUBLE) AS f, CAST(CAST(time - a AS FLOAT) AS DOUBLE) AS age, "
       f"CAST(CAST(abs(v - pv) AS FLOAT) AS DOUBLE) AS d FROM o")
def feedback(spark, folder):
    df = run(spark, folder, X.feedback("f", "v", [0.5]), X.problem_age("age"), X.step_distance("d", "v"), keep=["f", "age", "d"])
    return doubles(df, "f", "age", "d")


@query(f"""WITH {OBS}, g AS (SELECT *, v >= 5 AND v <= 60 AS open FROM o), e AS (SELECT *, lag(open) OVER s AS po, lead(open) OVER s AS no FROM g WINDOW s AS (PARTITION BY instance_id ORDER BY time)),
    r AS (SELECT *, sum(CASE WHEN open AND NOT coalesce(po, false) THEN 1 ELSE 0 END) OVER (PARTITION BY instance_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS segment FROM e)
    SELECT instance_id, CAST(segment AS BIGINT) AS segment, count(*) AS n, min((time + coalesce(pt, a)) / 2) AS start_time, max((time + coalesce(nt, z)) / 2) AS end_time
    FROM r WHERE open GROUP BY instance_id, segment""")
def between_segments(spark, folder):
    obs = X.between("v", 5.0, 60.0).apply(Observations.of(V.observations(spark, folder)))
    return obs.df().groupBy("instance_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start_time"), F.max("end").alias("end_time"))


@query(f"WITH {OBS} SELECT instance_id, min(time) AS time, CAST(arg_min(v, time) AS DOUBLE) AS v FROM o WHERE time >= {V.T0} + 3 * 86400 GROUP BY instance_id")
def observe_once(spark, folder):
    return doubles(run(spark, folder, X.observe_once(V.t0(spark, folder) + 3 * DAY), keep=["v"]), "v")


@query(f"""WITH {OBS}, f AS (SELECT *, min(time) OVER (PARTITION BY instance_id) AS f FROM o WHERE time >= {V.T0} + 259200.0)
    SELECT instance_id, time, f AS start, CAST(v AS DOUBLE) AS v FROM f WHERE time <= {V.T0} + 302400.0 OR time = f""")
def observe_timespan(spark, folder):
    t0 = V.t0(spark, folder)
    return doubles(run(spark, folder, X.observe_timespan(t0 + 3 * DAY, t0 + 3.5 * DAY), keep=["start", "v"]), "v")


@query(f"WITH {OBS} SELECT instance_id, arg_min(time, (v, time)) AS time, CAST(min(v) AS DOUBLE) AS v FROM o GROUP BY instance_id")
def global_minimum(spark, folder):
    return doubles(run(spark, folder, X.global_minimum("v"), keep=["v"]), "v")


@query(f"""WITH {OBS}, s AS (SELECT instance_id, any_value(n) AS n FROM o GROUP BY 1),
    p AS (SELECT instance_id, i.range AS i, CAST(floor(i.range * (n - 1) / 3) AS BIGINT) + 1 AS rn FROM s, range(4) i),
    t AS (SELECT p.instance_id, list(CAST(v AS DOUBLE) ORDER BY i) AS t FROM p JOIN o ON p.instance_id = o.instance_id AND p.rn = o.rn GROUP BY 1)
    SELECT o.instance_id, time, t[1] AS t0, t[2] AS t1, t[3] AS t2, t[4] AS t3 FROM o JOIN t USING (instance_id)""")
def trajectory(spark, folder):
    df = run(spark, folder, X.trajectory("t", "v", 4), keep=["t"])
    return df.select("instance_id", "time", *[F.get("t", F.lit(i)).cast("double").alias(f"t{i}") for i in range(4)])


ACCEPT = f"""WITH {OBS}, ok AS (SELECT instance_id FROM o GROUP BY instance_id HAVING {{}}) SELECT instance_id, time FROM o JOIN ok USING (instance_id)"""


@query(ACCEPT.format("bool_or(v >= 200 AND w <= 10)"))
def enters_area(spark, folder):
    return run(spark, folder, X.enters_area("x", [200.0, None], [None, 10.0]))


@query(ACCEPT.format("arg_min(v, time) >= 20"))
def starts_in(spark, folder):
    return run(spark, folder, X.starts_in("v", [20.0], [None]))


@query(ACCEPT.format("arg_max(v, time) <= 30"))
def ends_in(spark, folder):
    return run(spark, folder, X.ends_in("v", [None], [30.0]))


@query(ACCEPT.format("bool_or(time - pt > 172800)"))
def observation_gap(spark, folder):
    return run(spark, folder, X.observation_gap(2 * DAY))


@query(f"WITH {OBS} SELECT instance_id, time, CAST(instance_id AS VARCHAR) AS who FROM o WHERE instance_id <> 3")
def exclude_tags(spark, folder):
    mine = {"mover_tags": T.make(user=F.col("instance_id").cast("string"))}
    return run(spark, folder, X.exclude_tags("user=3", ["mover"]), X.tag_value("who", "mover", "user"), keep=["who"], extra=mine)


@query(f"""WITH {OBS}, m AS (SELECT *, avg(v) OVER s AS mv, avg(w) OVER s AS mw, sqrt(var_pop(CAST(v AS DOUBLE)) OVER s + var_pop(CAST(w AS DOUBLE)) OVER s) AS r FROM o
      WINDOW s AS (PARTITION BY instance_id ORDER BY time ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT instance_id, time, round(mv, 5) AS mean_0, round(mw, 5) AS mean_1, round(r, 5) AS radial FROM m WHERE rn >= 5""".replace("avg(v)", "avg(CAST(v AS DOUBLE))").replace("avg(w)", "avg(CAST(w AS DOUBLE))"))
def moving_moments(spark, folder):
    smp = V.plane_series(spark, folder).samples
    df = X.moving_moments(smp, 5, 2)
    return df.select(F.col("event_id").alias("instance_id"), "time", *[F.round(c, 5).alias(c) for c in ("mean_0", "mean_1", "radial")])


@query(f"""WITH {OBS}, q AS (SELECT *, time - 600.0 AS q FROM o) SELECT instance_id, time,
    CASE WHEN rn = 1 THEN CAST(v AS DOUBLE) ELSE CAST(CAST(pv + (v - pv) * ((q - pt) / (time - pt)) AS FLOAT) AS DOUBLE) END AS b FROM q
    WHERE rn = 1 OR q >= pt""")
def buffered_value(spark, folder):
    # ten minutes ago, from a buffer of the last two rows, where these reach back that far
    obs = X.recent("buffer", "v", 2).apply(Observations.of(V.observations(spark, folder)))
    ago = F.col("time") - 600.0
    b = X.value_at(F.col("buffer"), ago)
    df = obs.df().where((F.size("buffer") == 1) | (ago >= F.get("buffer", F.lit(0))["time"]))
    return doubles(df.select("instance_id", "time", b.alias("b")), "b")


# --- geometry --------------------------------------------------------------------------------------

@query(f"""WITH {OBS}, g AS (SELECT instance_id, time, v * 0.15 AS la, w AS lo, pv * 0.15 AS pla, pw AS plo FROM (SELECT instance_id, time, CAST(v AS DOUBLE) AS v, CAST(w AS DOUBLE) AS w,
      CAST(pv AS DOUBLE) AS pv, CAST(pw AS DOUBLE) AS pw FROM o WHERE rn > 1)),
    f AS (SELECT instance_id, time, CAST(CAST(la AS FLOAT) AS DOUBLE) AS la, lo, CAST(CAST(pla AS FLOAT) AS DOUBLE) AS pla, plo FROM g),
    h AS (SELECT *, pow(sin(radians(CAST(CAST(pla AS FLOAT) - CAST(la AS FLOAT) AS DOUBLE)) / 2), 2) + pow(sin(radians(plo - lo) / 2), 2) * cos(radians(la)) * cos(radians(pla)) AS a FROM f)
    SELECT instance_id, time, round(6371000.0 * 2 * atan2(sqrt(a), sqrt(1 - a)) / 1000, 1) AS km FROM h""")
def haversine(spark, folder):
    df = V.observations(spark, folder)
    place = W.vector(F.get("x", F.lit(0)).cast("double") * 0.15, F.get("x", F.lit(1)))
    obs = Observations.of(df.withColumn("p", place)).rows.lag(q=F.col("p"))
    return obs.done().where(F.col("q").isNotNull()).select(
        "instance_id", "time", F.round(W.haversine(F.col("p"), F.col("q")) / 1000, 1).alias("km"))


@query(f"""WITH {OBS}, d AS (SELECT instance_id, time, CAST(v AS DOUBLE) AS ax, CAST(w AS DOUBLE) AS ay, CAST(pv AS DOUBLE) AS bx, CAST(pw AS DOUBLE) AS by_ FROM o WHERE rn > 1),
    l AS (SELECT *, sqrt(ax * ax + ay * ay) AS la, sqrt(bx * bx + by_ * by_) AS lb FROM d)
    SELECT instance_id, time, round(degrees(acos(greatest(-1.0, least(1.0, (ax * bx + ay * by_) / ((CASE WHEN la = 0 THEN 1 ELSE la END) * (CASE WHEN lb = 0 THEN 1 ELSE lb END)))))), 4) AS deg FROM l""")
def angle(spark, folder):
    o = Observations.of(V.observations(spark, folder)).rows.lag(q=F.col("x"))
    return o.done().where(F.col("q").isNotNull()).select(
        "instance_id", "time", F.round(W.angle_degrees(F.col("x"), F.col("q")), 4).alias("deg"))


@query(f"""WITH {OBS} SELECT instance_id, time, CAST(CAST(0.0 + 2.0 * v + -1.0 * w + 3.0 AS FLOAT) AS DOUBLE) AS y_0, CAST(CAST(0.5 * w + 1.0 AS FLOAT) AS DOUBLE) AS y_1,
    CAST(w AS DOUBLE) AS sel, CAST(CAST(v + 1.5 AS FLOAT) AS DOUBLE) AS moved, CAST(CAST(v * -2.0 AS FLOAT) AS DOUBLE) AS scaled_0, CAST(CAST(w * -2.0 AS FLOAT) AS DOUBLE) AS scaled_1
    FROM (SELECT instance_id, time, CAST(v AS DOUBLE) AS v, CAST(w AS DOUBLE) AS w FROM o)""")
def affine(spark, folder):
    df = run(spark, folder, X.affine("y", "x", [[2.0, -1.0], [0.0, 0.5]], [3.0, 1.0]), X.column("sel", W.select_dim(F.col("x"), 1)),
             X.constant("moved", [1.5], "v"), X.scale("scaled", "x", -2.0), keep=["y", "sel", "moved", "scaled"])
    return doubles(V.flat(df, "y", "scaled"), "sel", "moved")


CPA = f"""{OBS}, p AS (SELECT instance_id, time, CAST(v AS DOUBLE) - CAST(coalesce(pv, v) AS DOUBLE) AS px, CAST(w AS DOUBLE) - CAST(coalesce(pw, w) AS DOUBLE) AS py,
    CAST(CAST(coalesce(nv, v) - v AS FLOAT) AS DOUBLE) AS vx, CAST(CAST(coalesce(nw, w) - w AS FLOAT) AS DOUBLE) AS vy FROM o),
    t AS (SELECT *, CASE WHEN abs(vx) + abs(vy) >= 1e-6 THEN -(px * vx + py * vy) / (vx * vx + vy * vy) ELSE 0.0 END AS t FROM p)"""


@query(f"WITH {CPA} SELECT instance_id, time, round(CAST(CAST(t AS FLOAT) AS DOUBLE), 4) AS t, "
       f"round(CAST(CAST(sqrt((px + t * vx) * (px + t * vx) + (py + t * vy) * (py + t * vy)) AS FLOAT) AS DOUBLE), 3) AS d FROM t")
def cpa(spark, folder):
    # each row's point moving towards the next one, against the point before it
    o = Observations.of(V.observations(spark, folder)).rows.lag(was=F.col("x")).lead(will=F.col("x"))
    o = o.with_columns(velocity=W.difference(F.coalesce("will", "x"), F.col("x")), other=F.coalesce("was", "x"))
    stage = X.closest_approach("x", "velocity", "other", None, "d", "t")
    df = Chain(stage).run(Observations(o)).df().select("instance_id", "time", "d", "t")
    return rounded(rounded(df, 4, "t"), 3, "d")


@query(f"""WITH {OBS}, d AS (SELECT instance_id, time, CAST(v AS DOUBLE) AS x, CAST(w AS DOUBLE) AS y, CAST(pv AS DOUBLE) AS px, CAST(pw AS DOUBLE) AS py,
      CAST(v - pv AS DOUBLE) AS hx, CAST(w - pw AS DOUBLE) AS hy FROM o WHERE rn > 1 AND (v <> pv OR w <> pw)),
    u AS (SELECT *, hx / sqrt(hx * hx + hy * hy) AS c, hy / sqrt(hx * hx + hy * hy) AS s FROM d)
    SELECT instance_id, time, round(CAST(CAST(c * hx + s * hy AS FLOAT) AS DOUBLE), 3) AS ahead, 0.0::DOUBLE AS aside, round(x, 2) AS back_0, round(y, 2) AS back_1 FROM u""")
def relative_position(spark, folder):
    o = Observations.of(V.observations(spark, folder)).rows.lag(p=F.col("x"))
    o = o.with_columns(h=W.difference(F.col("x"), F.col("p")))
    o = o.where(F.col("p").isNotNull() & (W.norm(F.col("h")) > 0))
    rel = Chain(X.relative_position("r", "x", "p", "h"), X.absolute_position("b", "r", "p", "h")).run(Observations(o))
    df = V.flat(rel.df().select("instance_id", "time", "r", "b"), "r", "b")
    return df.select("instance_id", "time", F.round("r_0", 3).alias("ahead"), F.round(F.abs("r_1"), 2).alias("aside"),
                     F.round("b_0", 2).alias("back_0"), F.round("b_1", 2).alias("back_1"))


@query("""WITH p AS (SELECT c_custkey, c_custkey % 90 AS lat, c_custkey % 180 AS lon, c_acctbal AS alt FROM customer),
    r AS (SELECT *, radians(lat) AS phi, radians(lon) AS lam, 6378137.0 / sqrt(1 - 0.0066943799901975955 * sin(radians(lat)) * sin(radians(lat))) AS n FROM p)
    SELECT c_custkey, round((n + alt) * cos(phi) * cos(lam), 3) AS x, round((n + alt) * cos(phi) * sin(lam), 3) AS y,
      CAST(round(lat, 6) AS DOUBLE) AS lat, CAST(round(lon, 6) AS DOUBLE) AS lon, abs(alt) < 1e5 AS low FROM r""")
def ecef_round_trip(spark, folder):
    c = V.table(spark, folder, "customer").select("c_custkey", (F.col("c_custkey") % 90).cast("double").alias("lat"),
                                                  (F.col("c_custkey") % 180).cast("double").alias("lon"), F.col("c_acctbal").alias("alt"))
    c = c.withColumn("e", W.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("alt")))
    c = c.withColumn("g", W.ecef_to_geodetic(F.col("e.x"), F.col("e.y"), F.col("e.z")))
    return c.select("c_custkey", F.round("e.x", 3).alias("x"), F.round("e.y", 3).alias("y"), F.round("g.lat", 6).alias("lat"),
                    F.round("g.lon", 6).alias("lon"), (F.abs(F.col("g.alt") - F.col("alt")) < 1e-2).alias("low"))
