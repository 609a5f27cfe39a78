"""What is in the store: tag names, combinations, counts, statistics, tagset order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotag.functions import tags as T
from chronotag.model import Store
from chronotag.plans.bounded import small_side
from chronotag.plans.durable import pinned
from chronotag.plans.ordered import Ordered


def event_tags(events: DataFrame, *also: str) -> DataFrame:
    """One row per event and tag pair."""
    return events.select("id", *also, F.explode("tags").alias("p")).select("id", *also, "p.name", "p.value")


def combination_columns(events: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """Events repeated for every combination of values of the names, in columns c0, c1, ...

    Stays inside the row: values are exploded in place, with no join. A name asked for twice
    gives ascending pairs of different values. Events without one of the names drop out.
    """
    df, keys = events, []
    for i, name in enumerate(names):
        key = f"c{i}"
        vals = T.values(F.col("tags"), name)
        earlier = [j for j in range(i) if names[j] == name]
        if earlier:
            vals = F.filter(vals, _after(f"c{earlier[-1]}"))
        df = df.withColumn(key, F.explode(vals))
        keys.append(key)
    return df, keys


def _after(column: str):
    return lambda v: v > F.col(column)


def combinations(events: DataFrame, names: list[str], where: str | None = None) -> DataFrame:
    """Value combinations of the names with the number of events, most frequent first.

    `where` restricts the events; its tags are repeated in the output tagset.
    Columns: one per position (c0, c1, ...), tags, n.
    """
    pairs = T.parse(where)
    df = events.where(T.contains(F.col("tags"), pairs)) if pairs else events
    if not names:
        out = df.agg(F.count(F.lit(1)).alias("n")).select(T.lit_tags(pairs).alias("tags"), "n")
        return out.where(F.col("n") > 0)
    rows, keys = combination_columns(df.select("tags"), names)
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    found = F.array(*[F.struct(F.lit(n).alias("name"), F.col(k).alias("value")) for n, k in zip(names, keys)])
    return (counted.withColumn("tags", T.canonical(F.concat(found, T.lit_tags(pairs))))
            .select(*keys, "tags", "n").orderBy(F.desc("n"), *keys))


def combinations_of(events: DataFrame, tags: str) -> DataFrame:
    """Short form: names without a value are counted, the others filter."""
    pairs = T.parse(tags)
    names = [n for n, v in pairs if v is None]
    given = [(n, v) for n, v in pairs if v is not None]
    return combinations(events, names, T.text_of(given))


def tag_names(events: DataFrame) -> DataFrame:
    return events.select(F.explode(T.names(F.col("tags"))).alias("name")).distinct().orderBy("name")


def count_tags(events: DataFrame) -> DataFrame:
    """Per name and value the number of pairs; per name the number of pairs and of events."""
    per_value = event_tags(events).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    per_name = (events.select(F.explode(T.names(F.col("tags"))).alias("name"))
                .groupBy("name").agg(F.count(F.lit(1)).alias("n_events")))
    totals = per_value.groupBy("name").agg(F.sum("n").alias("n_pairs"))
    return (per_value.join(totals.join(per_name, "name"), "name")
            .select("name", "n_events", "n_pairs", "value", "n")
            .orderBy(F.desc("n_pairs"), "name", F.desc("n"), "value"))


def names_under(events: DataFrame, path: str, limit: int | None = None) -> DataFrame:
    """Names on the events below a tag path with their counts: one step of a drill-down."""
    used = [n for n, _ in T.parse(path)]
    out = (event_tags(events.where(T.contains(F.col("tags"), path)))
           .where(~F.col("name").isin(used) if used else F.lit(True))
           .groupBy("name").agg(F.count_distinct("id").alias("n")).orderBy(F.desc("n"), "name"))
    return out.limit(limit) if limit else out


def values_under(events: DataFrame, path: str, name: str, limit: int | None = None) -> DataFrame:
    """Values of one name on the events below a tag path with their counts."""
    out = (events.where(T.contains(F.col("tags"), path))
           .select(F.explode(T.values(F.col("tags"), name)).alias("value"))
           .groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value"))
    return out.limit(limit) if limit else out


def sorted_tagsets(events: DataFrame, names: list[str], where: str | None = None,
                   count: bool = False, descending: bool = False, rank: bool = False) -> DataFrame:
    """Distinct value combinations in order of the names, with `rank` their place in it (from 1).

    A column is compared as numbers when all of its values are numbers.
    """
    found = combinations(events, names, where)
    keys = [f"c{i}" for i in range(len(names))]
    numeric = found.agg(*[F.bool_and(F.col(k).try_cast("double").isNotNull()).alias(k) for k in keys]).first()
    cols = [F.col(k).cast("double") if numeric[k] else F.col(k) for k in keys]
    if rank:
        found = ranked(found.withColumns({f"_o{i}": c for i, c in enumerate(cols)}), [f"_o{i}" for i in range(len(keys))], descending)
    return found.orderBy(*[c.desc() if descending else c.asc() for c in cols]).select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], "tags", *(["n"] if count else []), *(["rank"] if rank else []))


def ranked(df: DataFrame, order: list[str], descending: bool = False) -> DataFrame:
    """`df` with `rank`, its rows' place (from 1) in a total order, whole or by range partitions with carried counts."""
    out = Ordered(df.withColumn("_all", F.lit(0)), "_all", order).row_number("rank").done().drop("_all")
    if descending:
        n = F.broadcast(out.agg(F.count(F.lit(1)).alias("_n")))  # one row
        out = out.join(n, F.col("_n") > 0).withColumn("rank", F.col("_n") + 1 - F.col("rank")).drop("_n")
    return out


def tagset_order(df: DataFrame, names: list[str] | None = None, names_first: bool = False) -> DataFrame:
    """`df` with `_order`, a column that compares as tagsets do.

    By chosen names, or by all names of the table, one after the other: a missing name comes first, then the name's sorted values are
    compared one by one, and where they are equal so far fewer values come first. With `names_first` the sorted names of two sets are
    compared in the same way before the values of each name are. Values of a name are compared as numbers when all of them are numbers.

    A row's key is made of its own tags and of the places of the names, which are one small row as long as there are at most MAX_NAMES
    of them: no tagset is moved. With more names the key of each distinct tagset is put together from its pairs.
    """
    names_of = df.select(F.explode("tags").alias("p")).groupBy(F.col("p.name").alias("_name")).agg(
        F.bool_and(F.col("p.value").try_cast("double").isNotNull()).alias("_numeric"))
    if names is None:
        kinds = ranked(names_of, ["_name"]).withColumnRenamed("rank", "_place")
    else:
        places = df.sparkSession.createDataFrame([(n, i) for i, n in enumerate(dict.fromkeys(names))], "_name string, _place long")
        kinds = names_of.join(small_side(places), "_name")
    kinds = pinned(kinds)
    if kinds.limit(MAX_NAMES + 1).count() > MAX_NAMES:
        return _order_by_pairs(df, kinds, names_first)
    about = F.broadcast(kinds.agg(F.map_from_entries(F.collect_list(F.struct("_name", F.struct("_place", "_numeric")))).alias("_kinds")))  # one row
    here = F.filter(F.array_distinct(F.transform("tags", lambda t: t["name"])), lambda n: F.map_contains_key("_kinds", n))

    def values(name):
        mine = F.filter("tags", lambda t: t["name"] == name)
        return F.sort_array(F.transform(mine, lambda t: _comparable(t["value"], F.element_at("_kinds", name)["_numeric"])))

    def entry(name):
        return F.struct(F.element_at("_kinds", name)["_place"].alias("_place"), values(name).alias("values"))
    # a set without any of the names is null and comes first
    df = df.crossJoin(about).withColumn("_entries", F.transform(here, entry))
    return df.withColumn("_order", F.when(F.size("_entries") > 0, _tagset_key(F.col("_entries"), names_first))).drop("_entries", "_kinds")


#: Names whose places go to every task.
MAX_NAMES = 10_000


def _comparable(value: Column, numeric: Column) -> Column:
    return F.struct(F.when(numeric, value.try_cast("double")).alias("number"), F.when(~numeric, value).alias("text"))


def _tagset_key(entries: Column, names_first: bool) -> Column:
    """The key of a tagset from its (_place, values)."""
    if names_first:
        entries = F.sort_array(entries)
        return F.struct(F.transform(entries, lambda e: e["_place"]).alias("names"), F.transform(entries, lambda e: e["values"]).alias("values"))
    # of two sets the one that has the earlier name is the greater: places count down
    return F.sort_array(F.transform(entries, lambda e: F.struct((-e["_place"]).alias("place"), e["values"].alias("values"))), asc=False)


def _order_by_pairs(df: DataFrame, kinds: DataFrame, names_first: bool) -> DataFrame:
    """`tagset_order` for any number of names: keys once per distinct tagset, from its pairs."""
    text = T.to_text(F.col("tags"))
    pairs = df.select(text.alias("_text"), "tags").dropDuplicates(["_text"]).select("_text", F.explode("tags").alias("p")).select("_text", "p.name", "p.value")
    pairs = pairs.join(small_side(kinds), F.col("name") == F.col("_name")).drop("_name")
    # what is collected is as long as one tagset
    per_name = pairs.groupBy("_text", "_place").agg(F.sort_array(F.collect_list(_comparable(F.col("value"), F.col("_numeric")))).alias("values"))
    key = per_name.groupBy(F.col("_text").alias("_key")).agg(F.collect_list(F.struct("_place", "values")).alias("_e")).select("_key", _tagset_key(F.col("_e"), names_first).alias("_order"))
    return df.withColumn("_text", text).join(key, F.col("_text") == F.col("_key"), "left").drop("_text", "_key")


def order_by_tags(df: DataFrame, names: list[str] | None = None, descending: bool = False, *then: str, names_first: bool = False) -> DataFrame:
    """Rows in order of their tagsets (see `tagset_order`), equal ones in order of the columns `then`."""
    key = F.col("_order")
    return tagset_order(df, names, names_first).orderBy(key.desc() if descending else key.asc(), *then).drop("_order")


def rank_by_tags(df: DataFrame, names: list[str] | None = None, then: tuple[str, ...] = ("start_time", "id"), names_first: bool = False) -> DataFrame:
    """`df` with `rank`, the place (from 1) of each row in the order of tagsets; `then` makes it a total order."""
    return ranked(tagset_order(df, names, names_first), ["_order", *then]).drop("_order")


def tagset_dictionary(events: DataFrame) -> DataFrame:
    """Distinct tagsets with an id derived from the text, the same in every run."""
    text = events.select(T.to_text(F.col("tags")).alias("text")).distinct()
    return text.select(F.xxhash64("text").alias("tagset_id"), "text")


def exact(events: DataFrame, tags: str) -> DataFrame:
    """Events whose tagset is exactly the given one."""
    return events.where(T.to_text(F.col("tags")) == F.lit(T.text_of(T.parse(tags))))


def stats(store: Store) -> DataFrame:
    """One row of counts over all tables."""
    text = T.to_text(F.col("tags"))
    ev = store.events.agg(F.count(F.lit(1)).alias("n_events"),
                          F.count_distinct(text).alias("n_tagsets"),
                          F.sum(F.size("tags").cast("bigint")).alias("n_pairs"))
    smp = (store.samples.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
           .agg(F.count(F.lit(1)).alias("n_timeseries"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_samples")))
    tables = [ev, smp]
    if store.time_coordinates is not None:
        tables.append(store.time_coordinates.agg(F.count(F.lit(1)).alias("n_time_coordinates")))
    one = tables[0].withColumn("_k", F.lit(1))
    for t in tables[1:]:  # each has exactly one row
        one = one.join(F.broadcast(t.withColumn("_k", F.lit(1))), "_k")
    return (one.drop("_k")
            .withColumn("mean_pairs", F.col("n_pairs") / F.col("n_events"))
            .withColumn("mean_samples", F.col("n_samples") / F.col("n_timeseries")))


def data_range(samples: DataFrame, dims: int) -> DataFrame:
    """Extent of all samples in time and in every dimension."""
    return samples.agg(F.min("time").alias("min_time"), F.max("time").alias("max_time"),
                       *[f(F.get("value", F.lit(i))).alias(f"{n}_{i}") for i in range(dims)
                         for n, f in (("min", F.min), ("max", F.max))])


def common_tags(df: DataFrame, group: list[str]) -> DataFrame:
    """Per group: pairs that all of its events have, and all pairs that any has."""
    pairs = (df.select(*group, "id", F.explode("tags").alias("p"))
             .groupBy(*group, "p").agg(F.count_distinct("id").alias("k")))
    sizes = df.groupBy(*group).agg(F.count_distinct("id").alias("n"))
    return (pairs.join(sizes, group).groupBy(*group)
            .agg(F.array_sort(F.collect_list(F.when(F.col("k") == F.col("n"), F.col("p")))).alias("common"),
                 F.array_sort(F.collect_list("p")).alias("union")))
