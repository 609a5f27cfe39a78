"""Co-occurrence: one event per filter, all overlapping in time."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotag.functions import tags as T
from chronotag.model import Store
from chronotag.operators import filters
from chronotag.operators.filters import Filter
from chronotag.plans.durable import pinned
from chronotag.plans.intervals import overlap_join, overlap_sets, point_in_interval


def _bindings(fs: list[Filter]) -> list[list[str]]:
    """Per filter the names with an empty value, which take their value from the left.

    The value comes from the nearest event to the left that has the name, and a filter that sets
    the name there makes sure of one.
    """
    out = []
    for i, f in enumerate(fs):
        empty = {n for alt in f.tags or () for n, v in alt if v == ""}
        for n in empty:
            if i == 0:
                raise ValueError(f"tag {n!r} has an empty value but no filter to its left")
            for alt in f.tags:
                if dict(alt).get(n) != "":
                    raise ValueError(f"tag {n!r} must be empty in every alternative of a filter or in none")
        out.append(sorted(empty))
    return out


def concurrent(store: Store, fs: list[Filter | str], start: float | None = None, end: float | None = None,
               skip: DataFrame | None = None, time_coordinate: str | None = None, schema: str | None = None,
               dedupe: bool | None = None, with_order: bool = False) -> DataFrame:
    """(start_time, end_time, ids): sets of events, one per filter in order, that overlap.

    start_time and end_time are the shared span, limited to [start, end]. Each set of events
    is returned once: of several orders the first one when the events of each filter are taken by
    alternative, start, end and id. `skip` is a table with a column `ids` of sets to leave out, in
    any order. `dedupe=None` looks whether any event matches two of the filters, without which
    no set can come up twice. `with_order` adds `order`, the sort key of that enumeration.
    """
    fs = [Filter.from_text(f) if isinstance(f, str) else f for f in fs]
    bound = _bindings(fs)
    common = Filter(start=start, end=end, time_coordinate=time_coordinate, schema=schema)
    wanted = sorted({n for b in bound for n in b})

    if dedupe is None:
        dedupe = len(fs) > 1 and _some_event_fits_two(store, fs)
    # without bindings every order of a set overlaps, so a row can tell itself whether an earlier order comes up as well
    told = dedupe and not any(bound) and len(fs) <= MAX_ORDERED and not time_coordinate and not any(
        f.schema or f.time_coordinate or len(f.ids or ()) > filters.MAX_INLINE_IDS for f in fs) and _ids_differ(store, fs)

    def side(i: int) -> DataFrame:
        df = filters.select(store, common.also(fs[i]) if time_coordinate is None else fs[i].also(common))
        rank = F.struct(_alternative(fs[i]).alias("a"), F.col("start_time").alias("s"), F.col("end_time").alias("e"),
                        F.col("id").alias("i"), *([_alternatives(store.events, fs).alias("f")] if told else []))
        df = df.select(F.col("id").alias(f"id{i}"), F.col("start_time").alias(f"s{i}"), F.col("end_time").alias(f"e{i}"),
                       rank.alias(f"r{i}"),
                       *[T.values(F.col("tags"), n).alias(f"_v{i}_{n}") for n in wanted])
        for n in bound[i]:  # an event with several values of a bound name can join through each of them
            df = df.withColumn(f"{n}@{i}", F.explode(f"_v{i}_{n}"))
        return df

    if len(fs) > 1 and not any(bound):  # no values go from one event to the next: all sides are joined at once
        ranked = with_order or dedupe
        # sort keys are worked out once for each event, not again in what compares the orders of a set
        sides = [pinned(side(i)) if ranked else side(i).drop(f"r{i}") for i in range(len(fs))]
        n = range(len(fs))
        joined = overlap_sets(sides, [(f"s{i}", f"e{i}") for i in n], [f"id{i}" for i in n])
        joined = joined.select(*[f"id{i}" for i in n], *[f"r{i}" if ranked else F.lit(0).alias(f"r{i}") for i in n],
                               F.greatest(*[f"s{i}" for i in n]).alias("s"), F.least(*[f"e{i}" for i in n]).alias("e"))
    else:
        joined = _one_by_one(fs, side, bound, wanted)

    lo = F.greatest("s", F.lit(float(start))) if start is not None else F.col("s")
    hi = F.least("e", F.lit(float(end))) if end is not None else F.col("e")
    n = range(len(fs))
    out = joined.select(lo.alias("start_time"), hi.alias("end_time"), F.array(*[f"id{i}" for i in n]).alias("ids"),
                        F.array(*[f"r{i}" for i in n]).alias("order"))
    if skip is not None:
        seen = skip.select(F.array_sort("ids").alias("_set")).distinct()
        out = out.withColumn("_set", F.array_sort("ids")).join(seen, "_set", "left_anti").drop("_set")
    if told:
        out = out.where(_first_order(F.col("order"), len(fs))).withColumn("order", F.transform("order", lambda r: r.dropFields("f")))
    elif dedupe or any(bound):
        out = (out.groupBy(F.array_sort("ids").alias("_set"))
               .agg(F.min_by(F.struct("start_time", "end_time", "ids", "order"), "order").alias("r")).select("r.*"))
    return out if with_order else out.drop("order")


def _one_by_one(fs: list[Filter], side, bound: list[list[str]], wanted: list[str]) -> DataFrame:
    """Ids, sort keys and shared spans of the sets; each filter takes bound values from those before it."""
    first = side(0)
    joined = first.select("id0", "r0", F.col("s0").alias("s"), F.col("e0").alias("e"),
                          *[F.get(f"_v0_{n}", F.lit(0)).alias(f"ctx_{n}") for n in wanted])
    for i in range(1, len(fs)):
        right = side(i)
        ids = [f"id{j}" for j in range(i)]
        pairs = overlap_join(joined, right, [(f"ctx_{n}", f"{n}@{i}") for n in bound[i]], ("s", "e"), (f"s{i}", f"e{i}"))
        pairs = pairs.where(reduce(lambda a, b: a & b, [F.col(c) != F.col(f"id{i}") for c in ids]))
        joined = pairs.select(
            *ids, f"id{i}", *[f"r{j}" for j in range(i + 1)], F.greatest("s", f"s{i}").alias("s"), F.least("e", f"e{i}").alias("e"),
            *[(F.col(f"ctx_{n}") if n in bound[i] else
               F.coalesce(F.get(f"_v{i}_{n}", F.lit(0)), F.col(f"ctx_{n}"))).alias(f"ctx_{n}") for n in wanted])
        if i < len(fs) - 1:
            joined = pinned(joined)  # the next join reads it several times
    return joined


def _alternative(f: Filter) -> Column:
    """Number of the first alternative of a filter that an event matches."""
    out = F.lit(len(f.tags or ()))
    for i, alt in reversed(list(enumerate(f.tags or ()))):
        out = F.when(T.contains(F.col("tags"), [(n, v or None) for n, v in alt]), F.lit(i)).otherwise(out)
    return out


#: Filters up to which all orders of a set are compared in its row.
MAX_ORDERED = 4


def _alternatives(events: DataFrame, fs: list[Filter]) -> Column:
    """Per filter the number of its first alternative that an event matches, null when it does not match the filter."""
    return F.array(*[F.when(filters.matches(events, f), _alternative(f)) for f in fs])


def _first_order(order: Column, n: int) -> Column:
    """Whether no other order of the set's events, which all filters must match, comes before this one.

    The events of a set have different ids, so the first place that another order fills differently decides.
    """
    first = F.lit(True)
    for p in permutations(range(n)):
        if p == tuple(range(n)):
            continue
        fits = [F.get(F.get(order, F.lit(j))["f"], F.lit(i)) for i, j in enumerate(p)]
        place = next(i for i, j in enumerate(p) if i != j)
        this, other = F.get(order, F.lit(place)), F.get(order, F.lit(p[place]))
        sooner = other["i"] < this["i"]
        for c, was, now in [(c, this[c], other[c]) for c in "es"] + [("a", this["a"], fits[place])]:
            sooner = (now < was) | ((now == was) & sooner)
        first = first & ~(reduce(lambda a, b: a & b, [a.isNotNull() for a in fits]) & sooner)
    return first


def _ids_differ(store: Store, fs: list[Filter]) -> bool:
    """Whether each event that matches a filter has an id of its own."""
    ev = store.events
    some = ev.where(reduce(lambda a, b: a | b, [F.coalesce(filters.matches(ev, f), F.lit(False)) for f in fs]))
    return some.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() == 0


def _some_event_fits_two(store: Store, fs: list[Filter]) -> bool:
    ev = store.events
    loose = [filters.matches(ev, Filter(tags=f.tags)).cast("int") for f in fs]
    fits = reduce(lambda a, b: a + b, loose)
    return ev.where(fits > 1).limit(1).count() > 0


def gather_tags(rows: DataFrame, events: DataFrame, join_names: list[str], add_names: list[str],
                key: str = "id", time: str = "start_time") -> DataFrame:
    """Add tags of an event that is going on at each row's time and has the same join tags.

    The earliest such event (start, end, id) that has all the names to add is used; a row
    without one keeps its tags.
    """
    probe = rows.select(F.col(key).alias("_rk"), F.col(time).alias("_rt"),
                        *[T.value(F.col("tags"), n).alias(f"_rj{i}") for i, n in enumerate(join_names)])
    ev = events.where(reduce(lambda a, b: a & b, [T.has_name(F.col("tags"), n) for n in add_names]))
    added = F.filter("tags", lambda p: p["name"].isin(add_names))
    source = ev.select(F.col("start_time").alias("_es"), F.col("end_time").alias("_ee"), F.col("id").alias("_ei"),
                       added.alias("_add"),
                       *[T.value(F.col("tags"), n).alias(f"_ej{i}") for i, n in enumerate(join_names)])
    equi = [(f"_rj{i}", f"_ej{i}") for i in range(len(join_names))]
    hits = point_in_interval(probe, source, equi, "_rt", "_es", "_ee")
    # min_by combines on the map side, so a time with many running events is no burden
    best = hits.groupBy("_rk").agg(F.min_by("_add", F.struct("_es", "_ee", "_ei")).alias("_add"))
    return (rows.join(best, F.col(key) == F.col("_rk"), "left")
            .withColumn("tags", F.when(F.col("_add").isNull(), F.col("tags")).otherwise(T.set_(F.col("tags"), F.col("_add"))))
            .drop("_rk", "_add"))


def sharing_template(events: DataFrame, chosen: DataFrame, names: list[str]) -> DataFrame:
    """All events whose values of the names equal those of some chosen event."""
    def keyed(df):
        return df.withColumn("_key", F.transform(F.array(*[F.lit(n) for n in names]), lambda n: T.values(F.col("tags"), n)))
    wanted = keyed(chosen).select("_key").distinct()
    return keyed(events).join(wanted, "_key", "left_semi").drop("_key")


def permutation_covers(big: Column, small: list[str]) -> Column:
    """Whether the tagset texts in array column `big`, in some order, are each a superset of
    the tagsets in `small`. Meant for short lists (inputs of a problem)."""
    parsed = F.transform(big, T.from_text)
    needs = [T.lit_tags(s) for s in small]
    tries = []
    for order in permutations(range(len(small))):
        tests = [T.contains_all(F.get(parsed, F.lit(j)), needs[i]) for i, j in enumerate(order)]
        tries.append(reduce(lambda a, b: a & b, tests))
    return (F.size(big) == len(small)) & reduce(lambda a, b: a | b, tries)
