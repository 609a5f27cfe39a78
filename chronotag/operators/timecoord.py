"""Time coordinates: affine maps t' = slope * t_utc + intercept, chosen by tags.

A coordinate is a row of `time_coordinates` whose tags hold `timeCoordinate=<name>` and one tag
per parameter. All rows of one name have the same parameter names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotag.functions import tags as T
from chronotag.model import MAX_TIME
from chronotag.plans.bounded import small_side

NAME = "timeCoordinate"
MAX_TYPES = 10_000


def define(coordinates: DataFrame, tags: str, slope: float, intercept: float) -> DataFrame:
    """Add one coordinate; its parameter names must be those of earlier ones of the same name."""
    pairs = T.parse(tags)
    names = sorted({n for n, _ in pairs})
    if NAME not in names:
        raise ValueError(f"{tags!r} has no {NAME} tag")
    kind = dict(pairs)[NAME]
    known = parameter_names(coordinates).get(kind)
    if known is not None and known != [n for n in names if n != NAME]:
        raise ValueError(f"{kind} was defined with parameters {known}")
    row = coordinates.sparkSession.range(1).select(
        T.lit_tags(pairs).alias("tags"), F.lit(float(slope)).alias("slope"), F.lit(float(intercept)).alias("intercept"))
    return coordinates.unionByName(row)


def delete(coordinates: DataFrame, tags: str) -> DataFrame:
    """Remove the coordinates that have all of the tags."""
    return coordinates.where(~T.contains(F.col("tags"), tags))


def parameter_names(coordinates: DataFrame) -> dict[str, list[str]]:
    """Parameter names per coordinate name: one row per *kind* of coordinate, whatever their number."""
    kinds = (coordinates.select(T.value(F.col("tags"), NAME).alias("kind"),
                                F.array_remove(T.names(F.col("tags")), NAME).alias("names"))
             .groupBy("kind").agg(F.first("names").alias("names"), F.count_distinct("names").alias("n")))
    rows = kinds.limit(MAX_TYPES + 1).collect()
    if len(rows) > MAX_TYPES:
        raise ValueError("too many kinds of time coordinate")
    for r in rows:
        if r["n"] > 1:
            raise ValueError(f"{r['kind']} is defined with different parameters")
    return {r["kind"]: sorted(r["names"]) for r in rows}


def _lookup_key(kind: Column, tags: Column, fallback: Column, kinds: dict[str, list[str]]) -> Column:
    """Canonical text of the coordinate that applies to a row."""
    key = F.lit(None).cast("string")
    for name, params in sorted(kinds.items()):
        parts = [F.concat(F.lit("|"), F.lit(p), F.lit("="), F.coalesce(T.value(tags, p), T.value(fallback, p)))
                 for p in params]
        key = F.when(kind == F.lit(name), F.concat(F.lit(name), *parts)).otherwise(key)
    return key


def _keyed(coordinates: DataFrame, kinds: dict, prefix: str) -> DataFrame:
    tags = F.col("tags")
    return coordinates.select(_lookup_key(T.value(tags, NAME), tags, F.expr(T.EMPTY), kinds).alias(f"{prefix}_key"),
                              F.col("slope").alias(f"{prefix}_m"), F.col("intercept").alias(f"{prefix}_b"))


def with_parameters(df: DataFrame, coordinates: DataFrame, from_tags: Column, to_tags: Column) -> DataFrame:
    """`df` with `_m` and `_b`, the map from one coordinate to the other, null when one is missing.

    Parameters missing on one side are taken from the other side.
    """
    kinds = parameter_names(coordinates)
    table = coordinates
    df = df.withColumns({
        "_fk": _lookup_key(T.value(from_tags, NAME), from_tags, to_tags, kinds),
        "_tk": _lookup_key(T.value(to_tags, NAME), to_tags, from_tags, kinds)})
    source, target = small_side(_keyed(table, kinds, "_f")), small_side(_keyed(table, kinds, "_t"))
    df = df.join(source, F.col("_fk") == F.col("_f_key"), "left").join(target, F.col("_tk") == F.col("_t_key"), "left")
    # the same order of operations everywhere keeps converted times comparable
    m = F.col("_t_m") / F.col("_f_m")
    b = -F.col("_f_b") * F.col("_t_m") / F.col("_f_m") + F.col("_t_b")
    return df.withColumns({"_m": m, "_b": b}).drop("_fk", "_tk", "_f_key", "_f_m", "_f_b", "_t_key", "_t_m", "_t_b")


def _checked(df: DataFrame, tags: Column) -> Column:
    return F.when(F.col("_m").isNull(), F.raise_error(
        F.concat(F.lit("no time coordinate for "), T.to_text(tags)))).otherwise(F.col("_m"))


def to_coordinate(events: DataFrame, coordinates: DataFrame, target: str) -> DataFrame:
    """Events with times in the target coordinate and the coordinate's tags set.

    An event whose coordinate is not defined raises an error. An open end stays open.
    """
    to = T.lit_tags(target)
    df = with_parameters(events, coordinates, F.col("tags"), to)
    m, b = _checked(df, F.col("tags")), F.col("_b")
    open_end = F.col("end_time") == F.lit(MAX_TIME)
    return (df.withColumns({
        "start_time": m * F.col("start_time") + b,
        "end_time": F.when(open_end, F.col("end_time")).otherwise(m * F.col("end_time") + b),
        "tags": T.set_(F.col("tags"), to)})
        .drop("_m", "_b", f"tag:{NAME}"))


def with_times_in(df: DataFrame, coordinates: DataFrame, to: Column, start: Column, end: Column, tags: Column, wanted: Column,
                  names: tuple[str, str] = ("at_start", "at_end")) -> DataFrame:
    """`df`, a table or a stream, with the two times of an event in the coordinate of the tags `to`, which may differ from row to row.

    An open end stays open. A `wanted` row without a coordinate raises an error, other rows without one get nulls.
    """
    df = with_parameters(df.withColumns({"_from_tags": tags, "_to_tags": to}), coordinates, F.col("_from_tags"), F.col("_to_tags"))
    m = F.when(F.coalesce(wanted, F.lit(False)), _checked(df, F.col("_from_tags"))).otherwise(F.col("_m"))
    stays = end == F.lit(MAX_TIME)
    return (df.withColumn("_m", m).withColumns({names[0]: F.col("_m") * start + F.col("_b"), names[1]: F.when(stays, end).otherwise(F.col("_m") * end + F.col("_b"))})
            .drop("_m", "_b", "_from_tags", "_to_tags"))


def convert(df: DataFrame, coordinates: DataFrame, time: str, from_tags: Column, to_tags: Column,
            out: str = "converted") -> DataFrame:
    """Convert a time column between the coordinates two tag columns name."""
    df = df.withColumns({"_from": from_tags, "_to": to_tags})
    df = with_parameters(df, coordinates, F.col("_from"), F.col("_to"))
    m = _checked(df, F.col("_from"))
    return df.withColumn(out, m * F.col(time) + F.col("_b")).drop("_from", "_to", "_m", "_b")


def _own(df: DataFrame, coordinates: DataFrame, tags: Column) -> DataFrame:
    kinds = parameter_names(coordinates)
    df = df.withColumn("_fk", _lookup_key(T.value(tags, NAME), tags, F.expr(T.EMPTY), kinds))
    return df.join(small_side(_keyed(coordinates, kinds, "_f")), F.col("_fk") == F.col("_f_key"), "left")


def to_utc(df: DataFrame, coordinates: DataFrame, time: str, tags: Column, out: str = "utc") -> DataFrame:
    """Times of each row's own coordinate as UTC."""
    df = _own(df, coordinates, tags)
    return df.withColumn(out, unmap(F.col(time), F.col("_f_m"), F.col("_f_b"))).drop("_fk", "_f_key", "_f_m", "_f_b")


def from_utc(df: DataFrame, coordinates: DataFrame, time: str, tags: Column, out: str = "local") -> DataFrame:
    """UTC times in each row's own coordinate."""
    df = _own(df, coordinates, tags)
    return df.withColumn(out, map_(F.col(time), F.col("_f_m"), F.col("_f_b"))).drop("_fk", "_f_key", "_f_m", "_f_b")


def map_(x: Column, slope: Column, intercept: Column) -> Column:
    return slope * x + intercept


def unmap(y: Column, slope: Column, intercept: Column) -> Column:
    return (y - intercept) / slope


def define_for_combinations(events: DataFrame, coordinates: DataFrame, name: str, tag_names: list[str],
                            where: str | None = None, scale: float = 1.0) -> DataFrame:
    """One new coordinate per combination of tag values, with its zero at the earliest start.

    Starts are converted to UTC with the coordinate of the event that starts first.
    """
    from chronotag.operators.catalog import combination_columns

    df = events.where(T.contains(F.col("tags"), where)) if where else events
    rows, keys = combination_columns(df, tag_names)
    first = rows.groupBy(*keys).agg(
        F.min_by(F.struct("start_time", "tags"), F.struct("start_time", "id")).alias("e"))
    first = first.select(*keys, F.col("e.start_time").alias("start_time"), F.col("e.tags").alias("first_tags"))
    timed = to_utc(first, coordinates, "start_time", F.col("first_tags"))
    # no coordinate for the first event: no new coordinate either
    timed = timed.where(F.col("utc").isNotNull())
    tags = T.canonical(F.array(
        F.struct(F.lit(NAME).alias("name"), F.lit(name).alias("value")),
        *[F.struct(F.lit(n).alias("name"), F.col(k).alias("value")) for n, k in zip(tag_names, keys)]))
    return timed.select(tags.alias("tags"), F.lit(float(scale)).alias("slope"),
                        (-F.col("utc") * F.lit(float(scale))).alias("intercept"))
