"""Overlap joins of time intervals without a cross product.

Two closed intervals overlap exactly when the later of their starts lies inside the other one,
so an overlap join is two point-in-interval joins: left starts inside right intervals, and right
starts inside left intervals. A point-in-interval join becomes an equi join on time cells whose
width is a power of eight chosen from the length of the interval, so that an interval touches at
most two cells however long it is, and a point is looked up once per width in use. Cells with
very many intervals are salted.

Three or more intervals share a point exactly when the latest of their starts lies in all of them.
`overlap_sets` deals the intervals into cells of about as many starts as intervals go on at a time
and joins all sides by that one key, so that pairs are never written or shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotag.plans.durable import pinned

MIN_LEVEL, MAX_LEVEL = -20, 341  # cell widths 8^level; 8^341 is the largest a double holds

# Intervals of one cell that one task is asked to compare with.
MAX_PER_CELL = 200_000

# Stretches of time with equally many starts, known to the driver; starts of a cell at least.
STRETCHES, PER_CELL = 256, 64


def _level(start: Column, end: Column) -> Column:
    length = F.least(end - start, F.lit(1.7976931348623157e308))
    # one level of slack keeps rounding of the logarithm from giving a cell shorter than the interval
    level = F.ceil(F.log2(length) / 3 + F.lit(1e-9))
    return F.when(length <= 0, F.lit(MIN_LEVEL)).otherwise(
        F.greatest(F.lit(MIN_LEVEL), F.least(F.lit(MAX_LEVEL), level))).cast("int")


def _cell_of(time: str) -> Column:
    """Cell number as a double; exact, because the width is a power of two."""
    x = F.col(time) / F.col("_width")
    # floor() goes through a 64-bit integer, which tiny cells overflow; from 2^52 on a double is whole anyway
    return F.when(F.abs(x) >= F.lit(float(2 ** 52)), x).otherwise(F.floor(x).cast("double"))


def point_in_interval(points: DataFrame, intervals: DataFrame, equi: list[tuple[str, str]],
                      point: str, start: str, end: str, open_start: bool = False,
                      max_per_cell: int | None = None, meets: Column | None = None) -> DataFrame:
    """Inner join of points and the intervals they lie in.

    Column names of the two sides must differ. With `open_start` the interval's own start does
    not count as inside. Intervals ending before they start never match. With `meets`, a condition on both
    sides, only points come out: those that meet one of their intervals, a few times each at most, and a task
    looks no further than the first one a point meets in a cell.
    """
    spark = points.sparkSession
    limit = max_per_cell or int(spark.conf.get("chronotag.maxPerCell", str(MAX_PER_CELL)))
    ikeys = [r for _, r in equi]

    placed = (intervals.where(F.col(end) >= F.col(start))
              .withColumn("_il", _level(F.col(start), F.col(end)))
              .withColumn("_width", F.pow(F.lit(2.0), F.col("_il") * 3)))
    lo, hi = _cell_of(start), _cell_of(end)
    touched = F.sequence(F.lit(0), (hi - lo).cast("int"))
    placed = (placed.withColumns({"_lo": lo, "_cells": touched})
              .withColumn("_ic", F.explode(F.transform("_cells", lambda i: F.col("_lo") + i)))
              .drop("_lo", "_cells"))

    per_cell = placed.groupBy(*ikeys, "_il", "_ic").agg(F.count(F.lit(1)).alias("_n"))
    facts = per_cell.agg(F.sort_array(F.collect_set("_il")).alias("levels"), F.max("_n").alias("most")).first()
    levels = facts["levels"]
    if not levels:
        levels = [MIN_LEVEL]

    asked = (points.withColumn("_pl", F.explode(F.array(*[F.lit(v) for v in levels])))
             .withColumn("_width", F.pow(F.lit(2.0), F.col("_pl") * 3))
             .withColumn("_pc", _cell_of(point)).drop("_width"))
    placed = placed.drop("_width")

    on = [F.col(p) == F.col(i) for p, i in equi]
    on += [F.col("_pl") == F.col("_il"), F.col("_pc") == F.col("_ic")]
    if facts["most"] and facts["most"] > limit:
        # crowded cells: spread the intervals over slices and look every point up in each slice
        crowded = pinned(per_cell.where(F.col("_n") > limit)
                         .withColumn("_slices", F.ceil(F.col("_n") / limit).cast("int")).drop("_n"))
        names = {c: f"_c{i}" for i, c in enumerate([*ikeys, "_il", "_ic"])}
        small = F.broadcast(crowded.select(*[F.col(c).alias(a) for c, a in names.items()], "_slices"))
        at_i = reduce(lambda a, b: a & b, [F.col(c) == F.col(a_) for c, a_ in names.items()])
        pcols = [p for p, _ in equi] + ["_pl", "_pc"]
        at_p = reduce(lambda a, b: a & b, [F.col(p) == F.col(a_) for p, a_ in zip(pcols, names.values())])
        placed = (placed.join(small, at_i, "left")
                  .withColumn("_is", F.pmod(F.xxhash64(*intervals.columns), F.coalesce("_slices", F.lit(1))).cast("int"))
                  .drop("_slices", *names.values()))
        asked = (asked.join(small, at_p, "left")
                 .withColumn("_ps", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1)))
                 .drop("_slices", *names.values()))
        on.append(F.col("_ps") == F.col("_is"))

    inside = (F.col(point) > F.col(start) if open_start else F.col(point) >= F.col(start)) & (
        F.col(point) <= F.col(end))
    if meets is not None:
        inside = inside & meets
    joined = asked.join(placed, reduce(lambda a, b: a & b, on) & inside, "inner" if meets is None else "left_semi")
    return joined.drop("_pl", "_pc", "_il", "_ic", "_ps", "_is")


def overlap_join(left: DataFrame, right: DataFrame, equi: list[tuple[str, str]],
                 left_span: tuple[str, str], right_span: tuple[str, str],
                 max_per_cell: int | None = None) -> DataFrame:
    """Inner join of rows whose closed intervals overlap (touching counts).

    Column names of the two sides must differ.
    """
    ls, le = left_span
    rs, re_ = right_span
    cols = left.columns + right.columns
    left = left.where(F.col(ls) <= F.col(le))
    right = right.where(F.col(rs) <= F.col(re_))
    starts_inside_right = point_in_interval(left, right, equi, ls, rs, re_, max_per_cell=max_per_cell)
    starts_inside_left = point_in_interval(right, left, [(r, l) for l, r in equi], rs, ls, le,
                                           open_start=True, max_per_cell=max_per_cell)
    return starts_inside_right.select(*cols).unionByName(starts_inside_left.select(*cols))


def _rank_of(time: Column, bounds: list[float]) -> Column:
    """About how far a time is among all starts, from 0 to len(bounds) - 1; never less for a later time."""
    edges = F.split(F.lit(" ".join(map(str, bounds))), " ").cast("array<double>")  # one literal once the plan is optimized
    last = len(bounds) - 1
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(last.bit_length()))])

    def within(at: Column) -> Column:
        lo, hi = F.get(edges, at), F.get(edges, at + 1)
        # infinite and undefined shares end up at 0 or 1
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (time - lo) / (hi - lo)))
        return F.least(F.lit(float(last)), at + F.when(hi > lo, share).otherwise(F.lit(0.0)))

    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step) <= time, at + step).otherwise(at), within)


def overlap_sets(sides: list[DataFrame], spans: list[tuple[str, str]], unequal: list[str] | None = None,
                 max_per_cell: int | None = None) -> DataFrame:
    """Inner join of one row of each side whose closed intervals share a point.

    Column names of the sides must differ. `unequal` names a column of each side; the rows of a set
    have different values there. What is shuffled grows with the sides, not with pairs or sets.
    """
    spark = sides[0].sparkSession
    limit = max_per_cell or int(spark.conf.get("chronotag.maxPerCell", str(MAX_PER_CELL)))
    columns = [c for df in sides for c in df.columns]
    sides = [df.where(F.col(s) <= F.col(e)) for df, (s, e) in zip(sides, spans)]
    every = reduce(DataFrame.unionByName, [df.select(F.lit(i).alias("_side"), F.col(s).cast("double").alias("_s"), F.col(e).cast("double").alias("_e"))
                                           for i, (df, (s, e)) in enumerate(zip(sides, spans))])
    facts = every.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("_side") == i).alias(f"n{i}") for i in range(len(sides))],
                      F.percentile_approx("_s", [i / STRETCHES for i in range(STRETCHES + 1)]).alias("bounds")).first()
    bounds, cells = facts["bounds"], 1
    if facts["n"] > PER_CELL:
        # an interval goes on while as many others start as it spans ranks
        spanned = every.agg(F.avg(_rank_of(F.col("_e"), bounds) - _rank_of(F.col("_s"), bounds))).first()[0]
        going_on = spanned * facts["n"] / STRETCHES
        cells = max(1, int(facts["n"] / max(PER_CELL, going_on)))

    def cell(time: str) -> Column:
        if cells == 1:
            return F.lit(0).cast("long")
        return F.floor(_rank_of(F.col(time).cast("double"), bounds) * F.lit(cells / STRETCHES)).cast("long")

    # a set belongs to the cell of its latest start
    placed = [df.withColumns({f"_f{i}": cell(s), f"_l{i}": cell(e)}).withColumn(f"_c{i}", F.explode(F.sequence(f"_f{i}", f"_l{i}"))).drop(f"_l{i}")
              for i, (df, (s, e)) in enumerate(zip(sides, spans))]
    keys = ["_c"]
    large = max(range(len(sides)), key=lambda i: facts[f"n{i}"])
    per_cell = placed[large].groupBy(F.col(f"_c{large}").alias("_cc")).agg(F.count(F.lit(1)).alias("_n"))
    if facts[f"n{large}"] > limit and per_cell.agg(F.max("_n")).first()[0] > limit:
        # crowded cells: spread the largest side over slices and look the others up in each slice
        crowded = F.broadcast(pinned(per_cell.where(F.col("_n") > limit).select("_cc", F.ceil(F.col("_n") / limit).cast("int").alias("_slices"))))
        slices = F.coalesce("_slices", F.lit(1))
        for i, df in enumerate(placed):
            mark = F.pmod(F.xxhash64(*sides[i].columns), slices).cast("int") if i == large else F.explode(F.sequence(F.lit(0), slices - 1))
            placed[i] = df.join(crowded, F.col(f"_c{i}") == F.col("_cc"), "left").withColumn(f"_p{i}", mark).drop("_cc", "_slices")
        keys.append("_p")

    out = placed[0]
    for i in range(1, len(sides)):
        s, e = spans[i]
        on = [F.col(f"{k}0") == F.col(f"{k}{i}") for k in keys]
        for j in range(i):
            on += [F.col(spans[j][0]) <= F.col(e), F.col(s) <= F.col(spans[j][1])]
            if unequal:
                on.append(F.col(unequal[j]) != F.col(unequal[i]))
        out = out.join(placed[i], reduce(lambda a, b: a & b, on))
    return out.where(F.greatest(*[f"_f{i}" for i in range(len(sides))]) == F.col("_c0")).select(*columns)
