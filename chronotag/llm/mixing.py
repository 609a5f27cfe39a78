"""Operator 2, mixing sources to target weights along a curriculum. DataFrame functions only.

Each source has a target (words the mix takes from it) and a schedule: a weight at some times between 0 and 1, linear in
between. The integral of the schedule, scaled to the target, is the source's cumulative demand. Its documents, in the order of
a hash, use up that demand one after the other, as many times round as the target asks for, so the inverse of the demand at
a document's running word count is the time at which training reads it. Documents are range-sorted by that position.

Nulls: a null text has size 0 and takes nothing; null sources are one source, the last; a null doc_id is a document like
any other. Repeated rows are documents of their own. An empty table gives no rows. Other columns are only passed on by `copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotag.llm.common import pinned, running, word_count

WEIGHTS = (1, 2, 3)
MOST_TIMES = 3
#: Times and relative weights of the curriculum by a source's weight: light sources early, heavy ones late.
SCHEDULE = {1: ((0.0, 1.3), (0.5, 1.0), (1.0, 0.7)), 2: ((0.0, 1.0), (1.0, 1.0)), 3: ((0.0, 0.7), (0.5, 1.0), (1.0, 1.3))}


def order_key(doc_id: Column, text: Column) -> Column:
    """Evenly spread text that fixes the order of a source's documents."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(F.md5(text), F.lit("-"))).cast("binary"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and order key of every document: one scan of the texts."""
    text = F.col("text")
    return pinned(docs.select("doc_id", "source", word_count(text).alias("size"), order_key(F.col("doc_id"), text).alias("order_key")))


def targets(sizes: DataFrame, weights=WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """source, source_size, weight and target, one row per source.

    Sharing the excess of full sources until none is above its limit ends where every open source gets weight x level. Sources
    fill up in the order of limit / weight, so the level follows from running sums over that order.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ring = F.array(*map(F.lit, weights))
    rows = rows.withColumn("weight", ring[F.pmod(F.row_number().over(by_name) - 1, len(weights))])
    limit = F.col("source_size") * most_times
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("limit", limit).select(
        "*", F.row_number().over(fill).alias("turn"),
        ((F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(after)).alias("try"))
    rows = rows.withColumn("full", F.col("limit") <= F.col("try") * F.col("weight"))
    level = F.min_by(F.col("try"), F.when(~F.col("full"), F.col("turn"))).over(everything)
    return rows.withColumn("level", level).select(
        "source", "source_size", "weight",
        F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def _pieces(knots) -> Column:
    """Linear pieces of a schedule with the share of its integral that lies before each."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    out, done = [], 0.0
    for (t0, h0), (t1, h1) in zip(knots, knots[1:]):
        out.append(F.struct(F.lit(done).alias("before"), F.lit(t0).alias("t"), F.lit(h0 / area).alias("height"), F.lit((h1 - h0) / (t1 - t0) / area).alias("slope")))
        done += (t1 - t0) * (h0 + h1) / 2 / area
    return F.array(*out)


def time_of(share: Column, weight: Column, schedule=None) -> Column:
    """When a source of this weight has had `share` (0 to 1) of its demand: the inverse of the integral."""
    schedule = schedule or SCHEDULE
    pieces = F.lit(None)
    for w, knots in schedule.items():
        pieces = F.when(weight == w, _pieces(knots)).otherwise(pieces)
    piece = F.try_element_at(F.filter(pieces, lambda p: p["before"] <= share), F.lit(-1))
    rest = share - piece["before"]
    root = F.sqrt(F.greatest(piece["height"] * piece["height"] + 2 * piece["slope"] * rest, F.lit(0.0)))
    return piece["t"] + F.coalesce(2 * rest / F.nullif(piece["height"] + root, F.lit(0.0)), F.lit(0.0))


def mix(docs: DataFrame, weights=WEIGHTS, most_times: int = MOST_TIMES, schedule=None) -> DataFrame:
    """doc_id, source, size, source_size, weight, target, taken, position of the first reading, rounds, before, order_key."""
    sizes = sized(docs)
    plan = F.broadcast(pinned(targets(sizes, weights, most_times)).withColumnRenamed("source", "_source"))  # a row per source
    rows = running(sizes, ["source"], [F.col("order_key"), F.col("size")], F.col("size"))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    words = F.floor("target").cast("long")
    rows = rows.withColumn("rounds", F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0)))
    rest = words - F.col("rounds") * F.col("source_size")
    rows = rows.withColumn("taken", F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))))
    first = F.when(F.col("taken") > 0, F.least(F.lit(1.0), F.col("before") / F.col("target")))
    return rows.withColumn("position", F.round(time_of(first, F.col("weight"), schedule), 9))


def ordered(mixed: DataFrame) -> DataFrame:
    """Range-sorted by position; documents the mix leaves out come last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "order_key")


def copies(docs: DataFrame, weights=WEIGHTS, most_times: int = MOST_TIMES, schedule=None) -> DataFrame:
    """The documents as training reads them: all columns of `docs`, a row for each time a document is read, range-sorted by position.

    A document whose last reading the target cuts short is read whole; one of which nothing is taken does not appear,
    but documents without words stay once, at the end.
    """
    mixed = mix(docs, weights, most_times, schedule)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.ceil(F.col("taken") / F.col("size")))
    reads = mixed.where(times > 0).select(F.col("order_key").alias("_key"), F.col("source").alias("_src"), "before", "source_size", "target", "weight", times.alias("_times"))
    same_text = F.md5(F.col("text"))
    # repeated rows share a key: number them on both sides, so that each row finds its own reads
    nth = Window.partitionBy("_key", "_src").orderBy("before")
    reads = reads.withColumn("_nth", F.row_number().over(nth))
    rows = docs.withColumns({"_key": order_key(F.col("doc_id"), F.col("text")), "_src": F.col("source")})
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_key", "_src").orderBy(same_text)))
    on = [F.col("l._key") == F.col("r._key"), F.col("l._src").eqNullSafe(F.col("r._src")), F.col("l._nth") == F.col("r._nth")]
    out = rows.alias("l").join(reads.alias("r"), on).withColumn("_round", F.explode(F.sequence(F.lit(0), F.col("_times").cast("int") - 1)))
    share = F.least(F.lit(1.0), (F.col("_round") * F.col("source_size") + F.col("before")) / F.col("target"))
    position = F.when(F.col("target") > 0, time_of(share, F.col("weight"), schedule))
    return out.select(*[F.col(f"l.`{c}`") for c in docs.columns], position.alias("_position"), F.col("l._key").alias("_order")).orderBy(
        F.col("_position").asc_nulls_last(), "_order").drop("_position", "_order")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(md5(text), '-')) AS order_key FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS lim FROM sources),
tries AS (
  SELECT *, row_number() OVER w AS turn,
         (sum(source_size) OVER ()::BIGINT - coalesce(sum(lim) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
         / (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS try
  FROM named WINDOW w AS (ORDER BY lim::DOUBLE / weight, source NULLS LAST)),
lvl AS (SELECT min_by(try, turn) AS level FROM tries WHERE lim > try * weight),
plan AS (SELECT source, source_size, weight, CASE WHEN lim <= try * weight THEN lim::DOUBLE ELSE weight * level END AS target FROM tries, lvl),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.weight, p.target, floor(p.target)::BIGINT AS words,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.order_key, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size > 0 THEN words // source_size * size + greatest(0, least(size, words % source_size - before)) ELSE 0 END AS taken
FROM placed"""
