"""Feature extraction over observations.

An observation is a row per instance and time: `instance_id`, `time`, the instance's `start` and
`end`, and one column per feature (a vector). A chain is a list of stages; each stage is a
function from observations to observations, so a chain is one Spark plan. Stages that look at
neighbouring rows use `Ordered`, which copes with instances of any length.
"""

from __future__ import annotations

import math
import subprocess
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from chronotag.functions import tags as T
from chronotag.functions import vectors as V
from chronotag.operators.learners import BLOCK, _matrix, nearest_rows
from chronotag.operators.series import in_box
from chronotag.plans.durable import pinned
from chronotag.plans.ordered import Ordered
from chronotag.plans.sequential import per_group
from chronotag.plans.sliding import over_time


@dataclass(frozen=True)
class Observations:
    """Rows in order of time inside each instance, and the members of each group input as
    (keys, time, member_id, value) rows, without keys when all instances have the same members at a time."""

    rows: Ordered
    groups: dict[str, DataFrame] = field(default_factory=dict)

    @staticmethod
    def of(df: DataFrame, groups: dict[str, DataFrame] | None = None, limit: int | None = None,
           counted: DataFrame | None = None) -> "Observations":
        """Needs instance_id and time; start and end default to the first and last time."""
        if "start" not in df.columns or "end" not in df.columns:
            span = df.groupBy("instance_id").agg(F.min("time").alias("_a"), F.max("time").alias("_z"))
            df = df.join(span, "instance_id")
            df = df.withColumns({c: F.col(x) for c, x in (("start", "_a"), ("end", "_z")) if c not in df.columns})
            df = df.drop("_a", "_z")
        return Observations(Ordered(df, "instance_id", "time", limit, counted), groups or {})

    def with_rows(self, rows: Ordered) -> "Observations":
        return replace(self, rows=rows)

    def df(self) -> DataFrame:
        return self.rows.done()


@dataclass(frozen=True)
class Stage:
    """One link of a chain. warmup / cooldown: how much time before / after the time of interest
    it needs to see (None for all of it)."""

    outputs: tuple[str, ...]
    apply: Callable[[Observations], Observations]
    warmup: float | None = 0.0
    cooldown: float | None = 0.0


@dataclass(frozen=True)
class Chain:
    stages: tuple[Stage, ...]

    def __init__(self, *stages: Stage):
        outs = [o for s in stages for o in s.outputs]
        if len(outs) != len(set(outs)):
            raise ValueError(f"output names must be unique: {outs}")
        object.__setattr__(self, "stages", tuple(stages))

    def run(self, obs: Observations) -> Observations:
        return reduce(lambda o, s: s.apply(o), self.stages, obs)

    @property
    def warmup(self) -> float | None:
        """The largest need of any stage, None when one is unbounded."""
        return _widest([s.warmup for s in self.stages])

    @property
    def cooldown(self) -> float | None:
        return _widest([s.cooldown for s in self.stages])

    def stored_outputs(self) -> list[str]:
        """Names starting with an underscore are for later stages only."""
        return [o for s in self.stages for o in s.outputs if not o.startswith("_")]


def _widest(needs: list) -> float | None:
    return None if any(n is None for n in needs) else max(needs, default=0.0)


def _rows(outputs, fn: Callable[[Ordered], Ordered], warmup=0.0, cooldown=0.0) -> Stage:
    return Stage(tuple(outputs), lambda obs: obs.with_rows(fn(obs.rows)), warmup, cooldown)


TINY = 1e-6  # asks for the one row before, however long ago it was


# --- per-row stages ------------------------------------------------------------------------

def column(out: str, expr: Column | str) -> Stage:
    """Any expression over the features of a row; a string is SQL."""
    c = F.expr(expr) if isinstance(expr, str) else expr
    return _rows([out], lambda o: o.with_columns(**{out: c}))


def constant(out: str, value: list[float], x: str | None = None) -> Stage:
    return column(out, V.constant(value, None if x is None else F.col(x)))


def affine(out: str, x: str, matrix: list[list[float]], offset: list[float]) -> Stage:
    return column(out, V.affine(F.col(x), matrix, offset))


def scale(out: str, x: str, by: float) -> Stage:
    return column(out, V.scaled(F.col(x), F.lit(float(by))))


def distance(out: str, a: str, b: str, kind: str = "scalar") -> Stage:
    """kind: scalar, vector (a - b) or lat_lon (metres)."""
    return column(out, _distance(F.col(a), F.col(b), kind))


def _distance(a: Column, b: Column, kind: str) -> Column:
    if kind == "vector":
        return V.difference(a, b)
    d = V.haversine(a, b) if kind == "lat_lon" else V.distance(a, b)
    return F.when(a.isNotNull() & b.isNotNull(), F.array(d.cast("float")))


def angle(out: str, a: str, b: str) -> Stage:
    return column(out, F.array(V.angle_degrees(F.col(a), F.col(b)).cast("float")))


def closest_approach(pa: str, va: str | None, pb: str, vb: str | None, distance_: str | None = None,
                     time_: str | None = None, position_a: str | None = None, position_b: str | None = None) -> Stage:
    cpa = V.closest_approach(F.col(pa), F.col(va) if va else None, F.col(pb), F.col(vb) if vb else None)
    outs = {distance_: F.array(F.col("_cpa.distance")), time_: F.array(F.col("_cpa.time")),
            position_a: F.col("_cpa.position_a"), position_b: F.col("_cpa.position_b")}
    outs = {k: v for k, v in outs.items() if k}
    return _rows(outs, lambda o: o.with_columns(_cpa=cpa).with_columns(**outs).drop("_cpa"))


def follower(out: str, position: str, velocity: str, lag: float) -> Stage:
    return column(out, V.follower(F.col(position), F.col(velocity), lag))


def relative_position(out: str, x: str, position: str, heading: str) -> Stage:
    return column(out, V.relative_position(F.col(x), F.col(position), F.col(heading)))


def absolute_position(out: str, y: str, position: str, heading: str) -> Stage:
    return column(out, V.absolute_position(F.col(y), F.col(position), F.col(heading)))


def tag_value(out: str, input_: str, name: str) -> Stage:
    """A tag of an input's event (column `<input>_tags`) as a text feature."""
    return column(out, T.value(F.col(f"{input_}_tags"), name))


def problem_age(out: str) -> Stage:
    return column(out, F.array((F.col("time") - F.col("start")).cast("float")))


# --- stages over neighbouring rows ------------------------------------------------------------

def rate(out: str, x: str) -> Stage:
    """Change per unit of time since the row before; null on the first row."""
    def run(o: Ordered) -> Ordered:
        o = o.lag(_p=F.struct("time", F.col(x).alias("x")))
        per = (F.lit(1.0) / (F.col("time") - F.col("_p.time")).cast("float")).cast("float")
        val = F.transform(V.difference(F.col(x), F.col("_p.x")), lambda d: (per * d).cast("float"))
        return o.with_columns(**{out: val}).drop("_p")
    return _rows([out], run, warmup=TINY)


def step_distance(out: str, x: str, kind: str = "scalar") -> Stage:
    """Distance between successive values of one input."""
    def run(o: Ordered) -> Ordered:
        o = o.lag(_p=F.col(x))
        return o.with_columns(**{out: _distance(F.col(x), F.col("_p"), kind)}).drop("_p")
    return _rows([out], run, warmup=TINY)


def speed(out: str, x: str) -> Stage:
    """Distance per unit of time; the first row repeats the second's. A lone row is dropped."""
    def run(o: Ordered) -> Ordered:
        point = F.struct("time", F.col(x).alias("x"))
        o = o.lag(_p=point).lead(_n=point)

        def between(a_t, a_x, b_t, b_x):
            return F.array((V.distance(b_x, a_x) / (b_t - a_t)).cast("float"))
        back = between(F.col("_p.time"), F.col("_p.x"), F.col("time"), F.col(x))
        ahead = between(F.col("time"), F.col(x), F.col("_n.time"), F.col("_n.x"))
        o = o.with_columns(**{out: F.when(F.col("_p").isNull(), ahead).otherwise(back)})
        return o.where(F.col("_p").isNotNull() | F.col("_n").isNotNull()).drop("_p", "_n")
    return _rows([out], run, warmup=TINY)


def turn_rate(out: str, x: str) -> Stage:
    """Radians per unit of time about the z axis from the last two displacements; the first two
    rows repeat the third's. An instance of fewer than three rows is dropped."""
    def run(o: Ordered) -> Ordered:
        o = o.lag(1, _a=F.struct("time", F.col(x).alias("x"))).lag(2, _b=F.col(x)).row_number("_rn")

        def d(i, later, earlier):
            return (F.get(later, F.lit(i)) - F.get(earlier, F.lit(i))).cast("double")
        p, q, r = F.col("_b"), F.col("_a.x"), F.col(x)
        ax, ay, bx, by = d(0, q, p), d(1, q, p), d(0, r, q), d(1, r, q)
        cross, along = ax * by - ay * bx, ax * bx + ay * by
        # Spark's atan2 drops the sign of a zero, which tells the side of an exact reversal
        left = (along < 0) & (cross.cast("string") == "-0.0")
        theta = F.when(left, F.lit(-math.pi)).otherwise(F.atan2(cross, along))
        val = F.when(F.col("_rn") >= 3, F.array((theta / (F.col("time") - F.col("_a.time"))).cast("float")))
        o = o.with_columns(_w=val).lead(1, _w1=F.col("_w")).lead(2, _w2=F.col("_w"))
        chosen = F.when(F.col("_rn") == 1, F.col("_w2")).when(F.col("_rn") == 2, F.col("_w1")).otherwise(F.col("_w"))
        o = o.with_columns(**{out: chosen}).drop("_a", "_b", "_w", "_w1", "_w2")
        return o.where((F.col("_rn") >= 3) | F.col(out).isNotNull()).drop("_rn")
    return _rows([out], run, warmup=TINY)


def derivative(out: str, y: str, x: str = "time", dx: float | None = None, drop: bool = True) -> Stage:
    """Change of y per change of x over a distance dx back, with y interpolated there.

    `time` stands for the time since the instance's first row. Without dx the row before is
    used. Rows before dx is reached have no value and are dropped (kept with null when `drop` is
    False). x must not fall; falling x is an error.
    """
    def run(o: Ordered) -> Ordered:
        o = o.running_min(_t0=F.col("time"))

        def value(name):
            return F.array(F.col("time") - F.col("_t0")) if name == "time" else F.col(name)
        o = o.with_columns(_x=F.get(value(x), F.lit(0)).cast("double"), _y=value(y).cast("array<double>"))
        point = F.struct(F.col("_x").alias("x"), F.col("_y").alias("y"))
        o = o.lag(_p=point)
        falls = F.col("_x") < F.col("_p.x")
        o = o.with_columns(_x=F.when(falls, F.raise_error(F.lit(f"{x} falls")).cast("double")).otherwise(F.col("_x")))
        if dx is None:
            step = F.col("_x") - F.col("_p.x")
            val = F.zip_with(F.col("_y"), F.col("_p.y"), lambda a, b: ((a - b) / step).cast("float"))
        else:
            o = _look_back(o.lead(_n=point), dx)
            before, after = F.col("_then"), F.col("_then.next")
            share = (F.col("_x") - F.lit(float(dx)) - before["x"]) / (after["x"] - before["x"])
            old = F.zip_with(before["y"], after["y"], lambda p, q: p + (q - p) * share)
            val = F.zip_with(F.col("_y"), old, lambda now, then: ((now - then) / F.lit(float(dx))).cast("float"))
        o = o.with_columns(**{out: val}).drop("_x", "_y", "_p", "_n", "_t0", "_then")
        return o.where(F.col(out).isNotNull()) if drop else o
    need = None if x != "time" else (TINY if dx is None else float(dx))
    return _rows([out], run, warmup=need)


def _look_back(o: Ordered, dx: float) -> Ordered:
    """Adds `_then`: the newest row whose _x is at least dx smaller, with the row after it.

    Rows and lookups are merged along _x, as in an as-of join; _x never falls, so the order of
    the lookups is the order of the rows.
    """
    columns = [c for c in o.df.columns if c not in o.keys]
    there = F.struct(F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_n").alias("next"))
    points = o.df.select(*o.keys, F.col("_x").alias("_at"), F.lit(0).alias("_kind"), F.col("time").alias("_t"),
                         there.alias("_there"))
    asked = o.df.select(*o.keys, (F.col("_x") - F.lit(float(dx))).alias("_at"), F.lit(1).alias("_kind"),
                        F.col("time").alias("_t"), F.struct(*[c for c in columns if c != "_chunk"]).alias("_row"))
    merged = o.like(points.unionByName(asked, allowMissingColumns=True), o.keys, ["_at", "_kind", "_t"])
    merged = merged.fill_forward(_then=F.col("_there")).where(F.col("_kind") == 1)
    merged = merged.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns if c != "_chunk"], "_then")
    merged.order = list(o.order)
    return merged


SIGMAS = 3.0  # how far the kernel reaches


def _kernel_means(past: float | None, future: float | None):
    """Means weighted by Gaussian kernels, for `over_time`: a block of rows against a slice of their neighbours at a time."""
    back, ahead = SIGMAS * (past or 0.0), SIGMAS * (future or 0.0)

    def kernel(d, sd):
        return np.exp(-(d * d) / (2 * sd * sd)) / (math.sqrt(2 * math.pi) * sd) if sd else np.zeros_like(d)

    def means(t, v, present, a, b):
        lo = np.searchsorted(t, t[a:b] - back, side="left")
        hi = np.minimum(np.searchsorted(t, t[a:b] + ahead, side="left") + 1, len(t))
        # a weight of zero hides a neighbour that is out of reach only when its value is finite
        block = 64 if np.isfinite(v).all() else 1
        out = []
        for i in range(0, b - a, block):
            j = min(i + block, b - a)
            total, sums = np.zeros(j - i), np.zeros((j - i, v.shape[1]))
            for first in range(lo[i], hi[j - 1], 16384):
                at = np.arange(first, min(first + 16384, hi[j - 1]))
                d = t[at] - t[a + i:a + j, None]
                w = np.where((d < 0) | ((d == 0) & bool(past)), kernel(d, past), kernel(d, future))
                w = np.where((at >= lo[i:j, None]) & (at < hi[i:j, None]) & present[at], w, 0.0)
                total += w.sum(axis=1)
                sums += w @ v[at]
            out += [s / n if n > 0 else None for s, n in zip(sums, total)]
        return out
    return means


def _with_borders(o: Ordered, back: float, ahead: float) -> DataFrame:
    """Rows, and copies (`_own` false) of those that rows of another chunk of the same key reach."""
    if not o.split:
        return o.df.withColumn("_own", F.lit(True))
    df = o.lag(_before=F.col("time")).df
    spans = pinned(df.where(F.col("_chunk") > 0).groupBy(*o.keys, "_chunk")
                   .agg(F.min("time").alias("lo"), F.max("time").alias("hi"), F.min("_before").alias("before")))
    there = spans.select(*[F.col(k).alias(f"_k_{k}") for k in o.keys], F.col("_chunk").alias("_to"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in o.keys])
    behind, beyond = F.col("_chunk") < F.col("_to"), F.col("_chunk") > F.col("_to")
    reached = F.col("_lo") - F.lit(back), F.col("_hi") + F.lit(ahead)
    pairs = spans.join(there, same).where((behind & (F.col("hi") >= reached[0])) | (beyond & (F.col("before") < reached[1])))
    pairs = pinned(pairs.select(*[f"_k_{k}" for k in o.keys], F.col("_chunk").alias("_from"), "_to", "_lo", "_hi"))
    copies = df.join(pairs, same & (F.col("_chunk") == F.col("_from"))).where(
        (behind & (F.col("time") >= reached[0])) | (beyond & (F.col("_before") < reached[1])))
    copies = copies.withColumns({"_chunk": F.col("_to"), "_own": F.lit(False)})
    both = df.withColumn("_own", F.lit(True))
    return both.unionByName(copies.select(*both.columns)).drop("_before")


def smoothing(out: str, x: str, past: float | None, future: float | None) -> Stage:
    """Mean weighted by Gaussian kernels with standard deviations `past` and `future`.

    Values up to three deviations back count, and ahead up to the first row three deviations or
    more away, that one included. A side that is None does not count. A component that is null or
    NaN in one of the values is null. Chunks of a long instance exchange the rows at their borders;
    a task holds the rows within reach of one batch.
    """
    back = SIGMAS * (past or 0.0)
    ahead = SIGMAS * (future or 0.0)

    def run(o: Ordered) -> Ordered:
        df = _with_borders(o, back, ahead).withColumn("_v", F.col(x).cast("array<double>"))
        df = over_time(df, o._parts(), "time", "_v", back, ahead, _kernel_means(past, future), "_mean", own="_own", tasks=o.tasks)
        return o.from_python(df.withColumn(out, F.col("_mean")).drop("_v", "_mean"))
    return _rows([out], run, warmup=back, cooldown=ahead)


def running_total(out: str, x: str, dim: int = 1) -> Stage:
    """Running sum of every dimension; a missing value counts as zero."""
    def run(o: Ordered) -> Ordered:
        parts = {f"_s{i}": F.coalesce(F.get(F.col(x), F.lit(i)).cast("double"), F.lit(0.0)) for i in range(dim)}
        o = o.running_sum(**parts)
        return o.with_columns(**{out: F.array(*[F.col(p).cast("float") for p in parts])}).drop(*parts)
    return _rows([out], run, warmup=None)


def future_value(out: str, x: str, n: int = 1) -> Stage:
    """The value n rows ahead; the last n rows are dropped."""
    if n <= 0:
        raise ValueError("future_value looks ahead: n > 0")

    def run(o: Ordered) -> Ordered:
        o = o.lead(n, _f=F.struct(F.col(x).alias("x")))
        return o.where(F.col("_f").isNotNull()).with_columns(**{out: F.col("_f.x")}).drop("_f")
    return _rows([out], run, cooldown=None)


def feedback(out: str, x: str, initial: list[float] | None) -> Stage:
    """The newest non-null value before the row, at first `initial`; rows without one are dropped."""
    def run(o: Ordered) -> Ordered:
        o = o.fill_forward(inclusive=False, **{out: F.col(x)})
        if initial is not None:
            return o.with_columns(**{out: F.coalesce(F.col(out), V.vector(*initial))})
        return o.where(F.col(out).isNotNull())
    return _rows([out], run, warmup=None)


def trajectory(out: str, x: str, n: int) -> Stage:
    """The whole instance as n samples, evenly by position, put end to end; on every row."""
    if n < 2:
        raise ValueError("trajectory needs n >= 2")

    def run(o: Ordered) -> Ordered:
        o = o.row_number("_rn")
        sizes = o.df.groupBy(*o.keys).agg(F.count(F.lit(1)).alias("_size"))
        spots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                            lambda i: F.struct(i.alias("i"), (F.floor(i * (F.col("_size") - 1) / (n - 1)) + 1).alias("_spot")))
        wanted = sizes.withColumn("s", F.explode(spots)).select(*o.keys, "s.i", "s._spot")
        at = [F.col(k).eqNullSafe(F.col(f"_q{k}")) for k in o.keys]
        picks = wanted.select(*[F.col(k).alias(f"_q{k}") for k in o.keys], "i", "_spot")
        # n rows per instance
        vec = (o.df.join(picks, [*at, F.col("_rn") == F.col("_spot")]).groupBy(*o.keys)
               .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col(x).alias("v")))),
                                          lambda r: r["v"])).alias(out)))
        vec = vec.select(*[F.col(k).alias(f"_q{k}") for k in o.keys], out)
        return o._next(o.df.join(vec, at, "left").drop("_rn", *[f"_q{k}" for k in o.keys]))
    return _rows([out], run, warmup=None, cooldown=None)


def recent(out: str, x: str, n: int) -> Stage:
    """The newest n observations of a feature as an array of (time, value)."""
    return _rows([out], lambda o: o.last_rows(n, **{out: F.collect_list(F.struct("time", F.col(x).alias("value")))}),
                 warmup=None)


def value_at(buffer: Column, time: Column) -> Column:
    """Interpolate (or extrapolate) a `recent` buffer at a time."""
    earlier = F.filter(buffer, lambda r: r["time"] <= time)
    i = F.greatest(F.lit(0), F.least(F.size(earlier) - 1, F.size(buffer) - 2))
    a, b = F.get(buffer, i), F.get(buffer, i + 1)
    return F.when(F.size(buffer) == 1, F.get(buffer, F.lit(0))["value"]).otherwise(
        V.interpolate(a["time"], a["value"], b["time"], b["value"], time))


def moving_moments(samples: DataFrame, n: int, dim: int, key: str = "event_id") -> DataFrame:
    """Mean per dimension and one shared radial deviation of the last n samples; rows with fewer
    than n samples before them are left out."""
    o = Ordered(samples.select(key, "time", "value"), key, "time").row_number("_rn")
    comps = {f"_x{i}": F.get("value", F.lit(i)).cast("double") for i in range(dim)}
    o = o.with_columns(**comps)
    o = o.last_rows(n, **{f"mean_{i}": F.avg(f"_x{i}") for i in range(dim)},
                    **{f"_var{i}": F.var_pop(f"_x{i}") for i in range(dim)})
    radial = F.sqrt(reduce(lambda a, b: a + b, [F.col(f"_var{i}") for i in range(dim)]))
    df = o.done().where(F.col("_rn") >= n).withColumn("radial", radial)
    return df.drop("_rn", *comps, *[f"_var{i}" for i in range(dim)])


# --- stages that choose rows ----------------------------------------------------------------------

def observe_once(time: float) -> Stage:
    """The first row at or after a time."""
    def run(o: Ordered) -> Ordered:
        df = _one_per_instance(o.df.where(F.col("time") >= F.lit(float(time))), o, F.min_by, F.col("time"))
        return Ordered.whole(df, o.keys, o.order)
    return _rows([], run)


def _one_per_instance(df: DataFrame, o: Ordered, pick, by: Column) -> DataFrame:
    columns = [c for c in df.columns if c not in o.keys and c != "_chunk"]
    best = df.groupBy(*o.keys).agg(pick(F.struct(*columns), by).alias("_r"))
    return (best.select(*o.keys, *[F.col(f"_r.`{c}`").alias(c) for c in columns])
            .withColumns({"start": F.col("time"), "end": F.col("time")}))


def observe_timespan(start: float | None, end: float | None) -> Stage:
    """Rows in [start, end], and in any case the first one at or after start."""
    def run(o: Ordered) -> Ordered:
        if start is not None:
            o = o.where(F.col("time") >= F.lit(float(start)))
        o = o.running_min(_first=F.col("time")).lead(_next=F.col("time"))
        hi = F.lit(float(end)) if end is not None else None
        kept = o.with_columns(start=F.col("_first"))
        if hi is not None:
            # the row that comes after the end (or the lone row itself) closes the instance
            closing = F.when(F.col("time") > hi, F.col("time")).when(F.col("_next") > hi, F.col("_next"))
            kept = kept.with_columns(_close=closing).where((F.col("time") <= hi) | (F.col("time") == F.col("_first")))
            kept = kept.fill_backward(_close=F.col("_close")).with_columns(end=F.coalesce("_close", "end")).drop("_close")
        return kept.drop("_first", "_next")
    return _rows([], run)


def global_minimum(x: str) -> Stage:
    """The one row where the feature is smallest, the first of equals."""
    def run(o: Ordered) -> Ordered:
        by = F.struct(F.get(F.col(x), F.lit(0)), F.col("time"))
        return Ordered.whole(_one_per_instance(o.df, o, F.min_by, by), o.keys, o.order)
    return _rows([], run)


def segments(test: Column, name: str = "segment") -> Stage:
    """Split every instance into runs of rows for which a test holds; other rows are dropped.

    A run begins and ends half way to the neighbouring row, or to the instance's start or end.
    """
    def run(o: Ordered) -> Ordered:
        o = o.with_columns(_open=F.coalesce(test, F.lit(False)))
        o = o.lag(_pt=F.col("time"), _po=F.col("_open")).lead(_nt=F.col("time"), _no=F.col("_open"))
        opens = F.col("_open") & ~F.coalesce("_po", F.lit(False))
        closes = F.col("_open") & ~F.coalesce("_no", F.lit(False))
        o = o.with_columns(
            _s=F.when(opens, (F.col("time") + F.coalesce("_pt", "start")) / 2),
            _e=F.when(closes, (F.col("time") + F.coalesce("_nt", "end")) / 2))
        o = o.running_sum(**{name: opens.cast("bigint")}).where(F.col("_open"))
        o = o.fill_forward(start=F.col("_s")).fill_backward(end=F.col("_e"))
        return o.drop("_open", "_pt", "_po", "_nt", "_no", "_s", "_e").regroup(name)
    return _rows([], run, warmup=TINY, cooldown=TINY)


def between(x: str, low: float | None, high: float | None, name: str = "segment") -> Stage:
    """Runs of rows whose feature is in a range."""
    return segments(in_box(F.col(x), [low], [high]), name)


def _accept(decide: Callable[[Ordered], DataFrame]) -> Stage:
    """Keep the instances whose keys `decide` returns."""
    def run(o: Ordered) -> Ordered:
        ok = decide(o).select(*[F.col(k).alias(f"_q{k}") for k in o.keys])
        return o._next(o.df.join(ok, [F.col(k).eqNullSafe(F.col(f"_q{k}")) for k in o.keys], "left_semi"))
    return _rows([], run, warmup=None, cooldown=None)


def enters_area(x: str, low: list, high: list) -> Stage:
    return _accept(lambda o: o.df.where(in_box(F.col(x), low, high)).select(*o.keys).distinct())


def starts_in(x: str, low: list, high: list) -> Stage:
    """The first non-null value lies in the box."""
    return _accept(lambda o: o.df.where(F.col(x).isNotNull()).groupBy(*o.keys)
                   .agg(F.min_by(F.col(x), "time").alias("_v")).where(in_box(F.col("_v"), low, high)))


def ends_in(x: str, low: list, high: list) -> Stage:
    """The last non-null value lies in the box."""
    return _accept(lambda o: o.df.where(F.col(x).isNotNull()).groupBy(*o.keys)
                   .agg(F.max_by(F.col(x), "time").alias("_v")).where(in_box(F.col("_v"), low, high)))


def observation_gap(gap: float) -> Stage:
    """Some two successive rows are more than `gap` apart."""
    return _accept(lambda o: o.lag(_p=F.col("time")).df
                   .where(F.col("time") - F.col("_p") > F.lit(float(gap))).select(*o.keys).distinct())


def exclude_tags(tags: str, inputs: list[str]) -> Stage:
    """Drop instances one of whose input events (columns `<input>_tags`) has the tags."""
    hit = reduce(lambda a, b: a | b, [F.coalesce(T.contains(F.col(f"{i}_tags"), tags), F.lit(False)) for i in inputs])
    return _rows([], lambda o: o.where(~hit))


# --- groups ---------------------------------------------------------------------------------------

def ranked_members(obs: Observations, group: str, position: str, velocity: str | None = None,
                   max_distance: float | None = None, exclude: str | None = None) -> DataFrame:
    """(keys, time, member_id, value, score) of the group members at each row's time.

    `exclude` names a column whose member id does not count.
    """
    o = obs.rows
    cols = [position] + ([velocity] if velocity else []) + ([exclude] if exclude else [])
    df = o.df.select(*o.keys, "time", *dict.fromkeys(cols)).where(F.col(position).isNotNull())
    df = _with_members(df, obs.groups[group].where(F.col("value").isNotNull()))
    if exclude:
        df = df.where(F.col(exclude).isNull() | (F.col("member_id") != F.col(exclude)))
    df = df.withColumn("score", V.salience(F.col(position), F.col(velocity) if velocity else None, F.col("_gv")))
    if max_distance is not None:
        df = df.where(F.col("score") <= F.lit(float(max_distance)))
    return df.select(*o.keys, "time", "member_id", F.col("_gv").alias("value"), "score")


def _with_members(df: DataFrame, members: DataFrame) -> DataFrame:
    """Rows with `member_id` and the value `_gv` of each member at their time."""
    members = members.withColumnsRenamed({"instance_id": "_gi", "time": "_gt", "value": "_gv"})
    on = F.col("time") == F.col("_gt")
    if "_gi" in members.columns:
        on = (F.col("instance_id") == F.col("_gi")) & on
    return df.join(members, on)


#: Rows and members of one time that meet in a task; members of a cell, about, and cells at most, for times that have more.
ROW_SLICE, MEMBER_SLICE = 20_000, 50_000
CELL_MEMBERS, MAX_MEMBER_CELLS = 5000, 20_000


def _shared_nearest(o: Ordered, members: DataFrame, position: str, k: int) -> DataFrame:
    """(keys, time, member_id, value, score) of at least the k nearest members per row, for members that all instances share.

    Rows and members of a time meet in a task, where a tree finds the nearest: pairs are not made one by one. Where that is too many for a
    task, members lie in cells of bounded size, and rows only go to the cells that may hold one of their nearest (see `_nearest_in_cells`).
    """
    keys = [*o.keys, "time"]
    rows = pinned(o.df.select(*keys, F.col(position).alias("_x")).where(F.col("_x").isNotNull()))
    members = pinned(members.select(F.col("time").alias("_gt"), "member_id", F.col("value").alias("_gv")).where(F.col("_gv").isNotNull()))

    def whole(c):
        return ~F.exists(c, lambda v: v.isNull())

    def pairs(left, right):
        return left.join(right, F.col("time") == F.col("_gt")).withColumn("score", V.distance(F.col("_x"), F.col("_gv"))).select(
            *keys, "member_id", F.col("_gv").alias("value"), "score")
    parts, good, sound = [], rows, members
    # a value with a part missing has no distance, which comes before all others
    if rows.where(~whole("_x")).limit(1).count():
        parts.append(pairs(rows.where(~whole("_x")), members))
        good = rows.where(whole("_x"))
    if members.where(~whole("_gv")).limit(1).count():
        parts.append(pairs(good, members.where(~whole("_gv"))))
        sound = members.where(whole("_gv"))

    def most(df, time):
        return df.groupBy(time).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    left, right = good.where("time is not null").withColumn("_d", F.size("_x")), sound.where("_gt is not null").withColumn("_d", F.size("_gv"))
    if most(left, "time") <= ROW_SLICE and most(right, "_gt") <= MEMBER_SLICE:
        schema = _near_schema(rows, members, keys)
        near = left.groupBy("time", "_d").cogroup(right.groupBy("_gt", "_d")).applyInArrow(
            lambda a, b: _best_members(a, b, keys, k, schema), from_arrow_schema(schema))
    else:
        near = _nearest_in_cells(left, right, keys, k)
    return reduce(DataFrame.unionByName, parts, near)


def _near_schema(rows: DataFrame, members: DataFrame, keys: list[str]) -> pa.Schema:
    return to_arrow_schema(rows.select(*keys).join(members.select("member_id", F.col("_gv").alias("value"), F.lit(0.0).alias("score"))).schema)


def _best_members(a: pa.Table, b: pa.Table, keys: list[str], k: int, schema: pa.Schema, extra: list[str] = ()) -> pa.Table:
    """The k nearest rows of `b` for each row of `a`. With `extra`, columns of `a` to keep, also `_reach`, how far the k-th is, on the first
    one of each row (infinite when there are fewer than k, or when it is not a number); null on the others."""
    if not a.num_rows or not b.num_rows:
        return schema.empty_table()
    b = b.sort_by("member_id")
    xs, ys = a["_x"].combine_chunks(), b["_gv"].combine_chunks()
    kind = np.float32 if xs.type.value_type == ys.type.value_type == pa.float32() else np.float64
    out = []
    for i, row, col, score in nearest_rows(_matrix(xs), _matrix(ys), k, lambda p, q: _distances(p.astype(kind), q.astype(kind))):
        at, to = a.take(pa.array(row + i)), b.take(pa.array(col))
        columns = [*[at[c] for c in keys], to["member_id"], to["_gv"], pa.array(score)]
        if extra:
            begin = np.flatnonzero(np.diff(row, prepend=-1))
            found = np.diff(np.append(begin, len(row)))
            last = score[begin + found - 1]
            reach = np.full(len(row), np.nan)
            reach[begin] = np.where((found < k) | np.isnan(last), np.inf, last)
            columns += [*[at[c] for c in extra], pa.array(reach, from_pandas=True)]
        out.append(pa.table(columns, schema.names).cast(schema))
    return pa.concat_tables(out)


class _Boxes:
    """The cells of each time's members: bounds of their first two dimensions and how many they are."""

    def __init__(self, facts: list):
        self.of: dict = {}
        for r in sorted(facts, key=lambda r: r["_cell"]):  # in the members' order
            self.of.setdefault(self.key(r["_gt"], r["_d"]), []).append((r["_cell"], r["a0"], r["a1"], r["z0"], r["z1"]))
        for key, cells in self.of.items():
            self.of[key] = np.array([c[0] for c in cells], np.int64), np.array([c[1:] for c in cells], float)

    @staticmethod
    def key(time, dim):
        return repr(float(time) + 0.0), int(dim)

    def visits(self, times: np.ndarray, x: pa.Array, home: np.ndarray | None = None, reach: np.ndarray | None = None):
        """(row, cell): the cell among whose first dimensions a row is, or all other cells that may hold a member within its reach."""
        sizes = x.value_lengths().to_numpy(zero_copy_only=False)
        rows, cells = [], []
        kinds, code = np.unique(np.stack([times.astype(float) + 0.0, sizes.astype(float)]), axis=1, return_inverse=True)
        order = np.argsort(code, kind="stable")
        edges = np.searchsorted(code[order], np.arange(kinds.shape[1] + 1))
        for i, (time, dim) in enumerate(kinds.T):
            at, box = order[edges[i]:edges[i + 1]], self.of.get(self.key(time, dim))
            if box is None or not len(at):
                continue
            ids, (a0, a1, z0, z1) = box[0], box[1].T
            p = np.zeros((len(at), 2))
            d = min(2, int(dim))
            p[:, :d] = _matrix(x.take(pa.array(at)))[:, :d] if d else 0.0
            if reach is None:
                rows.append(at)
                cells.append(ids[np.clip(np.searchsorted(a0, p[:, 0], side="right") - 1, 0, len(ids) - 1)])
                continue
            step = max(1, BLOCK // len(ids))
            for j in range(0, len(at), step):
                some, q = at[j:j + step], p[j:j + step]
                with np.errstate(invalid="ignore"):
                    away = [np.maximum(np.maximum(lo - q[:, [n]], q[:, [n]] - hi), 0) for n, (lo, hi) in enumerate(((a0, z0), (a1, z1)))]
                    limit = reach[some] * (1 + 1e-6) + 1e-6 * (1 + np.abs(q).max(1))  # room for the rounding of distances
                    # what is not a number rules nothing out
                    row, cell = np.nonzero(~(np.sqrt(away[0] ** 2 + away[1] ** 2) > limit[:, None]) & (ids != home[some][:, None]))
                rows.append(some[row])
                cells.append(ids[cell])
        return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _nearest_in_cells(rows: DataFrame, members: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k nearest members of the row's time, and some more, for any number of both.

    Members of a time are sorted by their first two dimensions and cut into cells. A row first visits the cell it lies in, which tells how
    far its k-th best is at most; then the cells whose bounds are not beyond that. So rows and members travel about twice.
    """
    n = members.count()
    size = max(CELL_MEMBERS, -(-n // MAX_MEMBER_CELLS))
    order = ["_gt", "_d", F.get("_gv", F.lit(0)), F.get("_gv", F.lit(1)), "member_id"]
    slim = members.select("_gt", "_d", "member_id", "_gv")
    schema = to_arrow_schema(slim.withColumn("_cell", F.lit(0).cast("bigint")).schema)

    def number(batches):
        cell, seen, was = TaskContext.get().partitionId() << 32, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            t, d = b.column("_gt").to_numpy(zero_copy_only=False).astype(float) + 0.0, b.column("_d").to_numpy()
            change = np.flatnonzero(((t[1:] != t[:-1]) & ~(np.isnan(t[1:]) & np.isnan(t[:-1]))) | (d[1:] != d[:-1])) + 1
            out = np.zeros(len(t), np.int64)
            for x, y in zip([0, *change], [*change, len(t)]):
                now = repr(t[x]), d[x]
                if now != was:
                    cell, seen, was = cell + 1, 0, now
                place = seen + np.arange(y - x)
                out[x:y] = cell + place // size
                cell, seen = cell + (seen + y - x) // size, (seen + y - x) % size
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], schema=schema)
    parts = max(1, min(1000, -(-n // MEMBER_SLICE)))
    placed = pinned(slim.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(number, from_arrow_schema(schema)))

    def bound(f, i):
        return f(F.coalesce(F.get("_gv", F.lit(i)).cast("double"), F.lit(0.0)))
    # a row per cell, of which there are about MAX_MEMBER_CELLS and one per time at most
    boxes = _Boxes(placed.groupBy("_cell", "_gt", "_d").agg(*[bound(f, i).alias(f"{c}{i}") for c, f in (("a", F.min), ("z", F.max)) for i in (0, 1)]).collect())
    asked = to_arrow_schema(rows.select(*keys, "_x").withColumn("_cell", F.lit(0).cast("bigint")).schema)

    def visits(df, far):
        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                more = (b.column("_home").to_numpy(), b.column("_reach").to_numpy()) if far else ()
                row, cell = boxes.visits(b.column("time").to_numpy(zero_copy_only=False), b.column("_x"), *more)
                took = b.select([*keys, "_x"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array(cell)], schema=asked)
        return pinned(df.mapInArrow(run, from_arrow_schema(asked)))

    def meet(visitors, extra):
        many = pinned(visitors.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / ROW_SLICE).cast("int").alias("_qs")).where("_qs > 1"))
        slices = F.coalesce("_qs", F.lit(1))
        left = visitors.join(F.broadcast(many), "_cell", "left").withColumn("_q", F.pmod(F.xxhash64(*keys), slices).cast("int")).drop("_qs")
        right = placed.join(F.broadcast(many), "_cell", "left").withColumn("_q", F.explode(F.sequence(F.lit(0), slices - 1))).select("_cell", "_q", "member_id", "_gv")
        out = _near_schema(rows, members, keys)
        if extra:
            out = out.append(asked.field("_x")).append(pa.field("_cell", pa.int64())).append(pa.field("_reach", pa.float64()))
        return left.groupBy("_cell", "_q").cogroup(right.groupBy("_cell", "_q")).applyInArrow(
            lambda a, b: _best_members(a, b, keys, k, out, ["_x", "_cell"] if extra else []), from_arrow_schema(out))

    near = pinned(meet(visits(rows.select(*keys, "_x"), False), True))
    rest = meet(visits(near.where("_reach is not null").select(*keys, "_x", F.col("_cell").alias("_home"), "_reach"), True), False)
    return near.drop("_x", "_cell", "_reach").unionByName(rest)


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """As `vectors.distance`, row by row and in the same order of operations."""
    total = np.zeros(len(p))
    for i in range(p.shape[1]):
        d = (q[:, i] - p[:, i]).astype(float)
        total += d * d
    return np.sqrt(total)


def nearest_members(obs: Observations, group: str, position: str, k: int, **options) -> DataFrame:
    """(keys, time, best): the k best members per row as an array of (score, member_id, value)."""
    if "instance_id" not in obs.groups[group].columns and not any(v is not None for v in options.values()):
        ranked = _shared_nearest(obs.rows, obs.groups[group], position, k)
    else:
        ranked = ranked_members(obs, group, position, **options)
    w = Window.partitionBy(*obs.rows.keys, "time").orderBy("score", "member_id")
    return (ranked.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k)
            .groupBy(*obs.rows.keys, "time")
            .agg(F.array_sort(F.collect_list(F.struct("score", "member_id", "value"))).alias("best")))


def _with(o: Ordered, side: DataFrame, columns: list[str]) -> Ordered:
    """Left join a table with one row per keys and time."""
    on = [*o.keys, "time"]
    side = side.select(*[F.col(c).alias(f"_q{c}") for c in on], *columns)
    return o._next(o.df.join(side, [F.col(c).eqNullSafe(F.col(f"_q{c}")) for c in on], "left").drop(*[f"_q{c}" for c in on]))


def nearest(out: str, position: str, group: str, k: int = 1, velocity: str | None = None, split: bool = False,
            name: str = "membership") -> Stage:
    """Values of the k nearest members: `out`, or `out-1` .. `out-k`.

    With a velocity, members are ranked by how soon and near they will be passed. With `split`
    an instance is divided where the set or order of the nearest changes.
    """
    outs = [out] if k == 1 else [f"{out}-{i + 1}" for i in range(k)]

    def run(obs: Observations) -> Observations:
        best = nearest_members(obs, group, position, k, velocity=velocity)
        o = _with(obs.rows, best, ["best"])
        o = o.with_columns(**{c: F.get(F.col("best"), F.lit(i))["value"] for i, c in enumerate(outs)})
        if split:
            ids = F.coalesce(F.array_join(F.transform("best", lambda b: b["member_id"].cast("string")), ","), F.lit(""))
            o = o.with_columns(_ids=ids).lag(_was=F.col("_ids"))
            change = (F.col("_was").isNotNull()) & (F.col("_was") != F.col("_ids"))
            o = o.with_columns(_cut=change).running_sum(**{name: change.cast("bigint")})
            # the row that brings the change ends one part and begins the next
            o = o.lead(_nt=F.col("time"), _nc=F.col("_cut"))
            o = o.fill_forward(_s=F.when(F.col("_cut"), F.col("time")))
            o = o.fill_backward(_e=F.when(F.col("_nc"), F.col("_nt")))
            o = o.with_columns(start=F.coalesce("_s", "start"), end=F.coalesce("_e", "end"))
            o = o.drop("_ids", "_was", "_cut", "_nt", "_nc", "_s", "_e").regroup(name)
        return obs.with_rows(o.drop("best"))
    return Stage(tuple(outs), run)


def from_to(mover: str, from_group: str, to_group: str, threshold: float, mover_id: str = "mover_id",
            min_duration: float | None = None, max_duration: float | None = None,
            out_from: str = "from", out_to: str = "to", name: str = "trip") -> Stage:
    """Rows of the mover between leaving one member and reaching a different one.

    A trip begins at the last row that touches a member of `from_group` (within `threshold`)
    and ends at the first later row that touches another member of `to_group`. Every touch of
    the from group begins anew; a trip longer than max_duration is given up, a shorter one than
    min_duration is not reported. `mover_id` is the column with the mover's own member id. The
    members' positions come out as `out_from` and `out_to`, their ids as `<out>_id`.
    """
    def run(obs: Observations) -> Observations:
        keys = obs.rows.keys
        # read three times here, and the legs twice below: computed once each
        obs = obs.with_rows(obs.rows.pinned())
        touch = nearest_members(obs, from_group, mover, 1, max_distance=threshold, exclude=mover_id)
        # the two nearest suffice: at most one of them is the member the trip came from
        reach = nearest_members(obs, to_group, mover, 2, max_distance=threshold, exclude=mover_id)
        o = _with(obs.rows, touch.withColumnRenamed("best", "_touch"), ["_touch"])
        o = _with(o, reach.withColumnRenamed("best", "_reach"), ["_reach"])
        o = o.with_columns(_f=F.get(F.col("_touch"), F.lit(0))["member_id"])
        since = F.when(F.col("_f").isNotNull(), F.struct(F.col("_f").alias("from_id"), F.col("time").alias("left")))
        o = o.fill_forward(inclusive=False, _since=since)
        # all rows after a touch up to and including the next touch share a number
        o = o.running_sum(inclusive=False, _leg=F.col("_f").isNotNull().cast("bigint"))
        to = F.get(F.filter("_reach", lambda m: m["member_id"] != F.col("_since.from_id")), F.lit(0))
        took = F.col("time") - F.col("_since.left")
        o = o.with_columns(_to=to, _took=took).pinned()
        arrive = F.col("_since").isNotNull() & F.col("_to").isNotNull()
        if max_duration is not None:
            arrive = arrive & (F.col("_took") <= F.lit(float(max_duration)))
        first = (o.df.where(arrive).groupBy(*keys, "_leg")
                 .agg(F.min_by(F.struct("time", F.col("_since.left").alias("left"), F.col("_since.from_id").alias("from_id"),
                                        F.col("_to.member_id").alias("to_id"), "_took"), "time").alias("t")))
        if min_duration is not None:
            first = first.where(F.col("t._took") >= F.lit(float(min_duration)))
        # the trip's rows: those of its leg up to the arrival, and the touch that began it, which is
        # the last row of the leg before
        trips = first.select(*[F.col(k).alias(f"_q{k}") for k in keys], F.col("_leg").alias(name),
                             F.col("t.left").alias("_a"), F.col("t.time").alias("_z"),
                             F.col("t.from_id").alias(f"{out_from}_id"), F.col("t.to_id").alias(f"{out_to}_id"))
        here = F.coalesce("_leg", F.lit(0))
        df = o.df.withColumn("_trip", F.explode(F.when(F.col("_f").isNotNull(), F.array(here, here + 1)).otherwise(F.array(here))))
        on = [F.col(k).eqNullSafe(F.col(f"_q{k}")) for k in keys] + [F.col("_trip") == F.col(name)]
        df = df.join(trips, on).where((F.col("time") >= F.col("_a")) & (F.col("time") <= F.col("_z")))
        df = df.withColumns({"start": F.col("_a"), "end": F.col("_z")}).drop(
            *[f"_q{k}" for k in keys], "_trip", "_leg", "_touch", "_reach", "_f", "_since", "_to", "_took", "_a", "_z")
        rows = o._next(df).regroup(name)
        for which, group in ((out_from, from_group), (out_to, to_group)):
            rows = _member_position(rows, obs.groups[group], f"{which}_id", which)
        return obs.with_rows(rows)
    return Stage((out_from, out_to), run, None, None)


def _member_position(o: Ordered, group: DataFrame, id_column: str, out: str) -> Ordered:
    side = group.withColumnsRenamed({"instance_id": "_gi", "time": "_gt", "member_id": "_gm", "value": out})
    on = (F.col("time") == F.col("_gt")) & (F.col(id_column) == F.col("_gm"))
    if "_gi" in side.columns:
        on = (F.col("instance_id") == F.col("_gi")) & on
    return o._next(o.df.join(side, on, "left").drop("_gi", "_gt", "_gm"))


# --- external programs ---------------------------------------------------------------------------

def external(out: str, x: str, command: list[str]) -> Stage:
    """Feed every instance to a program as `time,x1,x2,...` lines; its output lines, one per row,
    become the feature.

    The program gets one instance per run, as a stream of lines in order of time, and is
    expected to answer line by line.
    """
    def run(o: Ordered) -> Ordered:
        slim = o.df.select(*o.keys, "time", F.col(x).alias("_x"))
        kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
        schema = ", ".join(f"`{k}` {kinds[k]}" for k in o.keys) + f", time double, `{out}` array<float>"

        keys = list(o.keys)

        def feed(c):
            lines = (",".join([str(t), *map(str, v)]) for t, v in zip(c["time"], c["_x"]))
            text = "".join(f"{line}\n" for line in lines)
            done = subprocess.run(command, input=text, capture_output=True, text=True, check=True)
            key = tuple(c[k][0] for k in keys)
            return [(*key, t, [float(v) for v in line.split(",")]) for t, line in zip(c["time"], done.stdout.splitlines())]
        return _with(o, per_group(slim, o.keys, ["time"], feed, schema), [out])
    return _rows([out], run, warmup=None, cooldown=None)
