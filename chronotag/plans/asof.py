"""As-of lookups: what a series was at a given time.

Probes and samples are merged into one ordered stream per series, where the samples nearest to a
probe give the previous value, the interpolated value and the extrapolated value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotag.functions.vectors import interpolate
from chronotag.plans.ordered import Ordered, max_rows, tasks_for

_NEVER = -1.7976931348623157e308  # sorts before every sample


def with_neighbours(samples: DataFrame, key: str = "event_id", limit: int | None = None) -> DataFrame:
    """Samples with the time and value of the sample before and after."""
    point = F.struct(F.col("time").alias("t"), F.col("value").alias("v"))
    o = Ordered(samples.select(key, "time", "value"), key, "time", limit)
    return o.lag(before=point).lead(after=point).done()


def asof(probes: DataFrame, samples: DataFrame, key: str = "event_id", limit: int | None = None) -> DataFrame:
    """Every probe (key, time, anything else) with the column `at`.

    `at` is the newest sample at or before the probe's time as (t, v, before, after); for a
    probe ahead of the first sample it is that first sample; null when the series has none.
    """
    rest = [c for c in probes.columns if c not in (key, "time")]
    payload = F.struct(*rest) if rest else F.struct(F.lit(1).alias("_one"))
    asked = probes.select(key, "time", F.lit(2).alias("_kind"), payload.alias("_row"))
    keys_only = samples.select(key).unionByName(probes.select(key))
    facts = keys_only.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n").alias("rows"), F.max("_n").alias("most")).first()
    if (facts["most"] or 0) > (limit or max_rows(samples)):
        found = _asof_split(asked, samples, key, limit, keys_only)
    else:
        found = _asof_whole(asked, samples, key, tasks_for(samples, facts["rows"] or 0))
    return found.select(key, "time", *[F.col(f"_row.{c}").alias(c) for c in rest], "at")


def _asof_whole(asked: DataFrame, samples: DataFrame, key: str, tasks: int) -> DataFrame:
    """One shuffle and one sort: the two samples on either side of a probe are the nearest
    non-null ones in the merged order."""
    point = F.struct(F.col("time").alias("t"), F.col("value").alias("v"))
    both = samples.select(key, "time", F.lit(1).alias("_kind"), point.alias("_s")).unionByName(asked, allowMissingColumns=True)
    if tasks != int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        both = both.repartition(tasks, key)
    over = f"IGNORE NULLS OVER (PARTITION BY `{key}` ORDER BY time, _kind)"
    near = both.withColumns({n: F.expr(f"{f}(_s, {i}) {over}") for n, f, i in (
        ("_a", "lag", 1), ("_a2", "lag", 2), ("_b", "lead", 1), ("_b2", "lead", 2))}).where(F.col("_kind") == 2)

    def sample(at, before, after):
        return F.struct(F.col(f"{at}.t").alias("t"), F.col(f"{at}.v").alias("v"), before.alias("before"), after.alias("after"))
    none = F.lit(None).cast(near.schema["_a"].dataType)
    at = (F.when(F.col("_a").isNotNull(), sample("_a", F.col("_a2"), F.col("_b")))
          .when(F.col("_b").isNotNull(), sample("_b", none, F.col("_b2"))))
    return near.withColumn("at", at)


def _asof_split(asked: DataFrame, samples: DataFrame, key: str, limit: int | None, keys_only: DataFrame) -> DataFrame:
    """The same for series too long for one task: each sample brings its neighbours along and is
    carried forward over the probes, across the chunks of the series."""
    near = with_neighbours(samples, key, limit)
    at = F.struct(F.col("time").alias("t"), F.col("value").alias("v"), "before", "after")
    marked = near.select(key, "time", F.lit(1).alias("_kind"), at.alias("_at"), F.col("before").isNull().alias("_first"))
    # the first sample is entered a second time ahead of everything, for probes that come early
    starts = F.when(F.col("_first"), F.array(F.lit(_NEVER), F.col("time"))).otherwise(F.array("time"))
    stream = marked.withColumn("time", F.explode(starts)).drop("_first")
    both = stream.unionByName(asked, allowMissingColumns=True)
    o = Ordered(both, key, ["time", "_kind"], limit, counted=keys_only).fill_forward(at=F.col("_at"))
    return o.done().where(F.col("_kind") == 2)


def linear(at, time):
    """Interpolated (or, outside the samples, extrapolated) value from an `at` column."""
    a = F.when(at["after"].isNotNull(), F.struct(at["t"].alias("t"), at["v"].alias("v"))).otherwise(at["before"])
    b = F.when(at["after"].isNotNull(), at["after"]).otherwise(F.struct(at["t"].alias("t"), at["v"].alias("v")))
    only = at["after"].isNull() & at["before"].isNull()
    return (F.when(at.isNull(), F.lit(None))
            .when((at["t"] == time) | only, at["v"])
            .otherwise(interpolate(a["t"], a["v"], b["t"], b["v"], time)))


def previous(at):
    return at["v"]
