"""Vector, geometry and time functions as Column expressions.

Vectors are arrays of float. Arithmetic is done in double where the result needs it and stored
as float, so every vector expression ends in a cast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _floats(x: Column) -> Column:
    return x.cast("array<float>")


def vector(*xs) -> Column:
    return F.array(*[(x if isinstance(x, Column) else F.lit(float(x))).cast("float") for x in xs])


def interpolate(t1: Column, x1: Column, t2: Column, x2: Column, t: Column) -> Column:
    """Value at t on the line through (t1, x1) and (t2, x2); a sample's own time gives the sample."""
    f = (t - t1) / (t2 - t1)
    line = F.zip_with(x1, x2, lambda a, b: (a + (b - a) * f).cast("float"))
    return F.when(t == t1, x1).when(t == t2, x2).otherwise(line)


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (y - x).cast("double") * (y - x).cast("double")))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(distance_squared(a, b))


def difference(a: Column, b: Column) -> Column:
    return _floats(F.zip_with(a, b, lambda x, y: x - y))


def plus(a: Column, b: Column) -> Column:
    return _floats(F.zip_with(a, b, lambda x, y: x + y))


def scaled(a: Column, by: Column) -> Column:
    return _floats(F.transform(a, lambda x: x * by))


EARTH_RADIUS_M = 6371000.0


def haversine(a: Column, b: Column) -> Column:
    """Great-circle metres between (lat, lon) in degrees."""
    def rad(x):
        return x.cast("double") * F.lit(math.pi / 180.0)
    lat1, lat2 = rad(F.get(a, 0)), rad(F.get(b, 0))
    half_lat, half_lon = rad(F.get(b, 0) - F.get(a, 0)) / 2, rad(F.get(b, 1) - F.get(a, 1)) / 2
    h = F.sin(half_lat) * F.sin(half_lat) + F.sin(half_lon) * F.sin(half_lon) * F.cos(lat1) * F.cos(lat2)
    return F.lit(EARTH_RADIUS_M) * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def angle_degrees(a: Column, b: Column) -> Column:
    """Interior angle; a zero vector counts as it is, which makes its angle 90."""
    def length(v):
        n = norm(v)
        return F.when(n == 0, F.lit(1.0)).otherwise(n)
    cosine = dot(a, b) / (length(a) * length(b))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


# --- affine maps ---------------------------------------------------------------------------

def affine(x: Column, matrix: list[list[float]], offset: list[float]) -> Column:
    """y = Mx + b."""
    def row(m, b):
        return (_sum(F.zip_with(F.array(*[F.lit(float(v)) for v in m]), x, lambda c, v: c * v)) + F.lit(float(b))).cast("float")
    return F.array(*[row(m, b) for m, b in zip(matrix, offset)])


def identity_map(x: Column, input_dim: int, output_dim: int) -> Column:
    """Cut or zero-pad to output_dim."""
    rows = [[1.0 if i == j else 0.0 for j in range(input_dim)] for i in range(output_dim)]
    return affine(x, rows, [0.0] * output_dim)


def linear_map(x: Column, m: float, b: float) -> Column:
    return affine(x, [[m]], [b])


def select_dim(x: Column, which: int) -> Column:
    return F.array(F.get(x, which).cast("float"))


def _unit(h: Column) -> Column:
    return F.transform(h, lambda v: v.cast("double") / norm(h))


def relative_position(x: Column, position: Column, heading: Column) -> Column:
    """2-D position of x in the frame of a mover at `position` going towards `heading`."""
    u = _unit(heading)
    dx, dy = F.get(x, 0) - F.get(position, 0), F.get(x, 1) - F.get(position, 1)
    c, s = F.get(u, 0), F.get(u, 1)
    return vector(c * dx + s * dy, c * dy - s * dx)


def absolute_position(y: Column, position: Column, heading: Column) -> Column:
    """Inverse of `relative_position`."""
    u = _unit(heading)
    c, s = F.get(u, 0), F.get(u, 1)
    return vector(c * F.get(y, 0) - s * F.get(y, 1) + F.get(position, 0),
                  s * F.get(y, 0) + c * F.get(y, 1) + F.get(position, 1))


def constant(value: list[float], x: Column | None = None) -> Column:
    """The constant, or the input moved by it."""
    c = vector(*value)
    return c if x is None else plus(x, c)


def follower(position: Column, velocity: Column, lag: float) -> Column:
    """Where something trailing by `lag` would be."""
    return _floats(F.zip_with(position, velocity, lambda x, v: x - v * F.lit(float(lag))))


# --- closest point of approach --------------------------------------------------------------

def closest_approach(pa: Column, va: Column | None, pb: Column, vb: Column | None,
                     allow_negative_time: bool = True) -> Column:
    """Struct of distance, time, position_a, position_b at the closest approach.

    Speeds are relative; without relative motion the time is 0. A missing velocity is zero.
    """
    def still(p):
        return F.transform(p, lambda _: F.lit(0.0).cast("float"))
    va = still(pa) if va is None else va
    vb = still(pb) if vb is None else vb
    p = F.zip_with(pa, pb, lambda a, b: a.cast("double") - b.cast("double"))
    v = F.zip_with(va, vb, lambda a, b: a.cast("double") - b.cast("double"))
    moving = _sum(F.transform(v, lambda x: F.abs(x))) >= F.lit(1e-6)
    t = F.when(moving, -dot(p, v) / dot(v, v)).otherwise(F.lit(0.0))
    if not allow_negative_time:
        t = F.greatest(F.lit(0.0), t)
    at_a = F.zip_with(pa, va, lambda x, y: x.cast("double") + t * y)
    at_b = F.zip_with(pb, vb, lambda x, y: x.cast("double") + t * y)
    gap = F.sqrt(_sum(F.zip_with(at_a, at_b, lambda x, y: (x - y) * (x - y))))
    return F.struct(gap.cast("float").alias("distance"), t.cast("float").alias("time"),
                    _floats(at_a).alias("position_a"), _floats(at_b).alias("position_b"))


def salience(position: Column, velocity: Column | None, other: Column) -> Column:
    """How far `other` is; for a mover, how soon and how near it will pass (past counts double)."""
    if velocity is None:
        return distance(position, other)
    cpa = closest_approach(position, velocity, other, None)
    t = F.when(cpa["time"] < 0, cpa["time"] * F.lit(-2.0)).otherwise(cpa["time"])
    return F.pow(t * 35, F.lit(2.0)) + F.pow(cpa["distance"], F.lit(2.0))


# --- earth-centred coordinates (WGS84) ------------------------------------------------------

WGS84_A = 6378137.0
WGS84_E = 8.1819190842622e-2


def geodetic_to_ecef(lat: Column, lon: Column, alt: Column) -> Column:
    """Struct x, y, z in metres from degrees and metres."""
    phi, lam = F.radians(lat), F.radians(lon)
    n = F.lit(WGS84_A) / F.sqrt(1 - F.lit(WGS84_E ** 2) * F.sin(phi) * F.sin(phi))
    return F.struct(((n + alt) * F.cos(phi) * F.cos(lam)).alias("x"),
                    ((n + alt) * F.cos(phi) * F.sin(lam)).alias("y"),
                    ((n * (1 - F.lit(WGS84_E ** 2)) + alt) * F.sin(phi)).alias("z"))


def ecef_to_geodetic(x: Column, y: Column, z: Column) -> Column:
    """Struct lat, lon (degrees), alt (metres), by the closed approximation with one angle."""
    a, e2 = WGS84_A, WGS84_E ** 2
    b = math.sqrt(a * a * (1 - e2))
    ep2 = (a * a - b * b) / (b * b)
    p = F.sqrt(x * x + y * y)
    th = F.atan2(z * a, p * b)
    lat = F.atan2(z + F.lit(ep2 * b) * F.pow(F.sin(th), F.lit(3.0)), p - F.lit(e2 * a) * F.pow(F.cos(th), F.lit(3.0)))
    n = F.lit(a) / F.sqrt(1 - F.lit(e2) * F.sin(lat) * F.sin(lat))
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"),
                    (p / F.cos(lat) - n).alias("alt"))
