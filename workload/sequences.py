"""Sequences: sessions, gaps, summaries, phases, regular expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronotag.functions import tags as T
from chronotag.model import Store
from chronotag.operators import events as E
from chronotag.operators import sequences as Q
from workload import views as V
from workload.events import DAY, HOUR
from workload.registry import query

SESSIONS = f"""{V.EV}, m AS (SELECT *, lag(end_time) OVER (PARTITION BY usr ORDER BY start_time, end_time, id) AS pe FROM ev),
    ses AS (SELECT *, sum(CASE WHEN start_time - pe >= 21600.0 THEN 1 ELSE 0 END) OVER (PARTITION BY usr ORDER BY start_time, end_time, id
      ROWS UNBOUNDED PRECEDING) AS part FROM m)"""


def sessions(spark, folder):
    seq, keys = Q.build(V.events(spark, folder), ["user"])
    return Q.split_on_timeout(seq, keys, 6 * HOUR), keys


@query(f"WITH {SESSIONS} SELECT usr AS user, id, CAST(part AS BIGINT) AS part FROM ses")
def seq_timeout(spark, folder):
    df, _ = sessions(spark, folder)
    return df.select(F.col("c0").alias("user"), "id", "part")


@query(f"""WITH {V.EV}, b AS (SELECT *, max(end_time) OVER w AS pm FROM ev WINDOW w AS (PARTITION BY type ORDER BY start_time, end_time, id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), w AS (SELECT {V.T0} - 3600 AS a, {V.T0} + 31 * 86400 AS z),
    g AS (SELECT type, pm AS s, start_time AS e FROM b WHERE start_time > pm
      UNION ALL SELECT type, a, min(start_time) FROM ev, w GROUP BY type, a UNION ALL SELECT type, max(end_time), z FROM ev, w GROUP BY type, z)
    SELECT type, s AS start_time, e AS end_time FROM g WHERE e - s >= 7200.0""")
def seq_gaps(spark, folder):
    t0 = V.t0(spark, folder)
    seq, keys = Q.build(V.events(spark, folder), ["type"])
    return Q.gaps(seq, keys, t0 - HOUR, t0 + 31 * DAY, 2 * HOUR, "gap=yes").select(F.col("c0").alias("type"), "start_time", "end_time")


@query(f"""WITH {V.EV}, b AS (SELECT *, arg_max(tags, (end_time, start_time, id)) OVER w AS pt, max(end_time) OVER w AS pm FROM ev
      WINDOW w AS (PARTITION BY type ORDER BY start_time, end_time, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT start_time AS end_time, pm AS start_time, replace(pt, 'type=', 'gap=yes,type=') AS t0, pt AS prev FROM b WHERE start_time > pm""",
       name="seq_gap_tags")
def seq_gap_tags(spark, folder):
    seq, keys = Q.build(V.events(spark, folder), ["type"])
    g = Q.gaps(seq, keys, set_tags="gap=yes")
    plain = T.remove(F.col("tags"), T.lit_tags("gap"))
    return g.select("start_time", "end_time", T.to_text(plain).alias("prev"),
                    F.replace(T.to_text(plain), F.lit("type="), F.lit("gap=yes,type=")).alias("t0"))


@query(f"""WITH {SESSIONS} SELECT usr AS user, CAST(part AS BIGINT) AS part, min(start_time) AS start_time,
    arg_max(end_time, (start_time, end_time, id)) AS end_time, count(*) AS n,
    list_aggregate(list_sort(list(DISTINCT 'type=' || type)), 'string_agg', ',') || ',what=session' AS tags
    FROM ses GROUP BY usr, part""")
def seq_summarize(spark, folder):
    df, keys = sessions(spark, folder)
    out = Q.summarize(df, [*keys, "part"], "k,user,what=session")
    return out.select(F.col("c0").alias("user"), "part", "start_time", "end_time", "n", T.to_text(F.col("tags")).alias("tags"))


@query(f"""WITH {V.TYPED}, one AS (SELECT user_id, min(start_time) AS start_time, arg_max(end_time, (start_time, end_time, id)) AS end_time, min_by(id, (start_time, end_time, id)) AS id
      FROM ser GROUP BY user_id) SELECT one.id AS event_id, count(*) AS n, min(time) AS first_time, max(time) AS last_time
    FROM one JOIN ser ON ser.user_id = one.user_id JOIN smp ON smp.event_id = ser.id GROUP BY one.id""")
def seq_summary_samples(spark, folder):
    s = V.typed_series(spark, folder)
    seq, keys = Q.build(s.events, ["user"])
    return (Q.summary_samples(seq, keys, s.samples, Q.summarize(seq, keys)).groupBy("event_id")
            .agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first_time"), F.max("time").alias("last_time")))


@query(f"""WITH {V.EV}, p AS (SELECT k, type, max(end_time - start_time) AS len FROM ev GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (ORDER BY CAST(k AS INT), type) - 1 AS phase, coalesce(sum(len) OVER (ORDER BY CAST(k AS INT), type
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS phase_start FROM p)
    SELECT id, phase, round(phase_start, 4) AS phase_start, round(phase_start, 4) AS start_time, round(phase_start + (end_time - start_time), 4) AS end_time FROM ev JOIN o USING (k, type)""")
def seq_phase_stack(spark, folder):
    seq, keys = Q.build(V.events(spark, folder), ["user"])
    df = Q.phases(seq, keys, ["k", "type"], stack=True)
    return df.select("id", "phase", *[F.round(c, 4).alias(c) for c in ("phase_start", "start_time", "end_time")])


@query(f"""WITH {SESSIONS}, txt AS (SELECT usr, part, string_agg(CASE type WHEN 'view' THEN 'v' WHEN 'click' THEN 'c' ELSE 'x' END, '' ORDER BY start_time, end_time, id) AS s
      FROM ses GROUP BY usr, part) SELECT usr AS user, CAST(part AS BIGINT) AS part, CAST(len(regexp_extract_all(s, 'v+c')) AS BIGINT) AS matches,
      CAST(list_sum(list_transform(regexp_extract_all(s, 'v+c'), lambda x: len(x))) AS BIGINT) AS events FROM txt WHERE regexp_matches(s, 'v+c')""")
def seq_regex(spark, folder):
    df, keys = sessions(spark, folder)
    # the types as one letter each, so that a pattern over events is a pattern over letters
    kind = T.value(F.col("tags"), "type")
    letter = F.when(kind == "view", "v").when(kind == "click", "c").otherwise("x")
    df = df.withColumn("tags", T.add(F.col("tags"), T.make(letter=letter)))
    found = Q.regex(df, [*keys, "part"], "letter", "v+c")
    return found.groupBy(F.col("c0").alias("user"), "part").agg(F.count(F.lit(1)).alias("matches"), F.sum("n").alias("events"))


@query()
def seq_regex_groups(spark, folder):
    df, keys = sessions(spark, folder)
    return Q.regex(df, [*keys, "part"], "type", "(click).*(purchase)", (1, 2))


@query(f"WITH {SESSIONS}, g AS (SELECT usr, part FROM ses GROUP BY ALL) SELECT (SELECT count(*) FROM ev) + (SELECT count(*) FROM g) AS n_events, "
       f"(SELECT count(*) FROM g) AS n_sessions")
def store_sequences(spark, folder):
    df, keys = sessions(spark, folder)
    s = Store(V.events(spark, folder))
    out = E.create(s, Q.summarize(df, [*keys, "part"], "k,user,what=session").select("start_time", "end_time", "tags"))
    return out.events.agg(F.count_distinct("id").alias("n_events"), F.count_if(T.has_pair(F.col("tags"), "what", "session")).alias("n_sessions"))
