"""Event filters: tags, time, ids, time coordinate, attachment schema."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotag.functions import tags as T
from chronotag.model import MAX_TIME, Store
from chronotag.operators import timecoord
from chronotag.plans.bounded import small_side
from chronotag.plans.durable import pinned
from chronotag.plans.intervals import overlap_join

# Up to this many ids are put into the query text; more are joined.
MAX_INLINE_IDS = 1000


@dataclass(frozen=True)
class Filter:
    """All given conditions hold. `tags` is a tuple of alternatives, each a tuple of pairs."""

    tags: tuple | None = None
    start: float | None = None
    end: float | None = None
    ids: tuple | None = None
    time_coordinate: str | None = None
    schema: str | None = None

    # -- combining --

    def also(self, *others: "Filter") -> "Filter":
        """A later condition replaces an earlier one of the same kind."""
        out = self
        for o in others:
            out = replace(out, **{k: v for k, v in vars(o).items() if v is not None})
        return out

    def alternatives(self) -> list["Filter"]:
        """One filter per alternative tagset."""
        return [replace(self, tags=(t,)) for t in self.tags] if self.tags else [self]

    # -- text form --

    def to_text(self) -> str:
        parts = []
        if self.ids is not None:
            parts.append("IDs:" + ",".join(str(i) for i in self.ids))
        if self.schema is not None:
            parts.append("Schema:" + self.schema)
        if self.start is not None:
            parts.append(f"Start:{self.start}")
        if self.end is not None:
            parts.append(f"End:{self.end}")
        if self.time_coordinate is not None:
            parts.append("timeCoordinate:" + self.time_coordinate)
        parts += [T.text_of(t) for t in self.tags or ()]
        return ";".join(parts)

    @staticmethod
    def from_text(text: str) -> "Filter":
        fields, alternatives = {}, []
        for part in text.split(";"):
            head, colon, rest = part.partition(":")
            kind = head.lower() if colon else ""
            if kind == "ids":
                fields["ids"] = tuple(int(i) for i in rest.split(",") if i)
            elif kind == "schema":
                fields["schema"] = rest
            elif kind in ("start", "end"):
                fields[kind] = float(rest)
            elif kind == "timecoordinate":
                fields["time_coordinate"] = rest
            elif colon:
                raise ValueError(f"unknown filter field {head!r}")
            elif part:
                alternatives.append(tuple(T.parse(part)))
        if alternatives:
            fields["tags"] = tuple(alternatives)
        return Filter(**fields)

    # -- meaning --

    def names(self) -> list[str]:
        return sorted({n for t in self.tags or () for n, _ in t})

    def tag_test(self, tags: Column, promoted: dict[str, Column] | None = None) -> Column:
        """Any alternative is contained. Empty values are treated as "any value"."""
        if not self.tags:
            return F.lit(True)
        test = F.lit(False)
        for pairs in self.tags:
            if not pairs:
                return F.lit(True)
            test = test | T.contains(tags, [(n, v or None) for n, v in pairs], promoted)
        return test

    def time_test(self, start: Column, end: Column) -> Column:
        test = F.lit(True)
        if self.start is not None:
            test = test & (end >= F.lit(float(self.start)))
        if self.end is not None:
            test = test & (start <= F.lit(float(self.end)))
        return test


def by_tags(*alternatives: str) -> Filter:
    """by_tags('a=1,b=2'), by_tags('a=1;a=2') or by_tags('a=1', 'a=2')."""
    return Filter(tags=tuple(tuple(p) for text in alternatives for p in T.parse_many(text)))


def by_time(start: float | None, end: float | None) -> Filter:
    return Filter(start=start, end=end)


def by_start(start: float) -> Filter:
    return Filter(start=start)


def by_end(end: float) -> Filter:
    return Filter(end=end)


def by_ids(*ids: int) -> Filter:
    return Filter(ids=tuple(ids))


def by_schema(schema: str) -> Filter:
    return Filter(schema=schema)


def with_time_coordinate(coordinate: str) -> Filter:
    return Filter(time_coordinate=coordinate)


def promoted(df: DataFrame) -> dict[str, Column]:
    """Tags that also exist as plain columns."""
    return {c[4:]: F.col(f"`{c}`") for c in df.columns if c.startswith("tag:")}


def matches(df: DataFrame, f: Filter) -> Column:
    """Tag, time and id conditions as one predicate, for batch and streams alike. Schema and time
    coordinate need other tables and raise here; `hits` tests every kind of condition."""
    untestable(f)
    test = f.tag_test(F.col("tags"), promoted(df)) & f.time_test(F.col("start_time"), F.col("end_time"))
    if f.ids is not None:
        test = test & F.col("id").isin(*f.ids)
    return test


def untestable(f: Filter) -> None:
    """Raise on conditions that an event alone does not decide."""
    for field in ("schema", "time_coordinate"):
        if getattr(f, field) is not None:
            raise ValueError(f"a filter by {field} needs the store")


def hits(store: Store, f: Filter, name: str = "_hit") -> DataFrame:
    """All events with a column saying whether the filter finds them, by the same rules as `select`."""
    ev = store.events
    if f.schema is None and f.time_coordinate is None and len(f.ids or ()) <= MAX_INLINE_IDS:
        return ev.withColumn(name, F.coalesce(matches(ev, f), F.lit(False)))
    found = select(store, f).select("id").distinct().withColumn(name, F.lit(True))
    return ev.join(found, "id", "left").select(*[F.col(f"`{c}`") for c in ev.columns], F.coalesce(name, F.lit(False)).alias(name))


def select(store: Store, *filters: Filter | str) -> DataFrame:
    """Events matching all filters, unordered."""
    f = Filter()
    for g in filters:
        f = f.also(Filter.from_text(g) if isinstance(g, str) else g)
    df = store.events
    if f.ids is not None and len(f.ids) > MAX_INLINE_IDS:
        wanted = store.spark.createDataFrame([(int(i),) for i in f.ids], "id bigint")
        df = df.join(wanted.distinct(), "id", "left_semi")
        f = replace(f, ids=None)
    if f.schema is not None:
        df = df.join(with_schema(store, f.schema), "id", "left_semi")
        f = replace(f, schema=None)
    if f.time_coordinate is None:
        return df.where(matches(df, f))
    # convert first, then filter on the converted times
    untimed = replace(f, start=None, end=None, time_coordinate=None)
    df = timecoord.to_coordinate(df.where(matches(df, untimed)), store.time_coordinates, f.time_coordinate)
    return df.where(f.time_test(F.col("start_time"), F.col("end_time")))


def with_schema(store: Store, schema: str) -> DataFrame:
    """Ids of events that own data in a schema; `timeseries` means samples."""
    if schema == "timeseries":
        return store.samples.select(F.col("event_id").alias("id")).distinct()
    return (store.attachments.where(F.col("schema_name") == schema)
            .select(F.col("event_id").alias("id")).distinct())


def find(store: Store, *filters: Filter | str) -> DataFrame:
    """Events matching all filters in order of start, end and id."""
    return select(store, *filters).orderBy("start_time", "end_time", "id")


def find_attached(store: Store, schema: str, *filters: Filter | str) -> DataFrame:
    """Matching events with what they own in a schema: adds schema_name and table_name."""
    links = store.attachments.where(F.col("schema_name") == schema)
    return (select(store, *filters).join(links, F.col("id") == F.col("event_id")).drop("event_id")
            .orderBy("start_time", "end_time", "id"))


def match_saved(events: DataFrame, saved: DataFrame, store: Store | None = None) -> DataFrame:
    """(filter_id, id) pairs for a table of saved filters (filter_id, text) and all events.

    Filters with a `Schema:` need the store that has the samples and attachments, those with a `timeCoordinate:` its time
    coordinates. A coordinate only says what Start and End mean; an event a filter would convert must have one. Unknown fields raise.

    Each alternative of each filter meets the events that have its rarest needed pair (name for
    wildcards), and matches those that meet every other need of it.
    Filters without tags meet the events through an interval join; if they have a coordinate, every event is
    converted once for each coordinate such filters name. Other filters convert what their tags and ids found.
    """
    split = saved.select("filter_id", F.split("text", ";").alias("p"))
    strange = F.exists("p", lambda s: F.contains(s, F.lit(":")) & ~F.lower(F.substring_index(s, ":", 1)).isin("ids", "schema", "start", "end", "timecoordinate"))
    shape = split.select(
        "filter_id", strange.alias("strange"), _field("schema").alias("schema"), _field("start").cast("double").alias("lo"), _field("end").cast("double").alias("hi"),
        _field("timecoordinate").alias("coordinate"),
        F.transform(F.split(_field("ids"), ","), lambda s: s.cast("bigint")).alias("ids"),
        F.posexplode_outer(F.filter("p", lambda s: (s != "") & ~F.contains(s, F.lit(":")))).alias("alt", "alt_text"))
    shape = shape.withColumns({"need": T.from_text(F.coalesce("alt_text", F.lit(""))), "to": F.when(F.coalesce("lo", "hi").isNotNull(), F.col("coordinate"))})
    # bounds in a coordinate are tested on converted times, all others at once
    shape = shape.withColumns({c: F.when(F.col("to").isNull(), F.col(c)) for c in ("lo", "hi")} | {"to_lo": F.coalesce("lo", F.lit(-MAX_TIME)), "to_hi": F.coalesce("hi", F.lit(MAX_TIME))})
    shape = pinned(shape)  # every branch below reads it
    # which kinds of filter there are: the others need no join
    untagged_, timed_, moved_ = F.col("alt_text").isNull(), F.col("ids").isNull(), F.col("to").isNotNull()
    has = shape.agg(F.bool_or("strange").alias("strange"), F.bool_or(F.col("coordinate").isNotNull()).alias("coordinate"), F.bool_or(F.col("schema").isNotNull()).alias("schema"), F.bool_or(untagged_ & timed_ & ~moved_).alias("spans"), F.bool_or(untagged_ & ~timed_).alias("ids"),
                    F.bool_or(moved_).alias("moved"), F.bool_or(untagged_ & timed_ & moved_).alias("moved_spans"),
                    F.bool_or(~untagged_ & F.exists("need", lambda w: w["value"].isNotNull())).alias("pairs"),
                    F.bool_or(~untagged_ & F.exists("need", lambda w: w["value"].isNull())).alias("names")).first()
    if has["strange"]:
        raise ValueError("saved filters may have IDs, Schema, Start, End, timeCoordinate and tags only")
    if has["schema"] and store is None:
        raise ValueError("saved filters with a schema need the store")
    if has["coordinate"] and (store is None or store.time_coordinates is None):
        raise ValueError("saved filters with a time coordinate need the store's time coordinates")
    parts = []
    if has["pairs"] or has["names"]:
        tagged = shape.where(~untagged_).select("filter_id", "alt", "lo", "hi", "ids", "need")
        met = _by_rarest_need(events, tagged)
        parts.append(met.where((F.col("lo").isNull() | (F.col("end_time") >= F.col("lo")))
                               & (F.col("hi").isNull() | (F.col("start_time") <= F.col("hi")))
                               & (F.col("ids").isNull() | F.array_contains("ids", F.col("id")))).select("filter_id", "id").distinct())
    untagged = shape.where(untagged_).select(
        "filter_id", "to", F.coalesce("lo", F.lit(-MAX_TIME)).alias("lo"), F.coalesce("hi", F.lit(MAX_TIME)).alias("hi"), "ids")
    spans = events.select("id", "start_time", "end_time")
    if has["spans"]:
        timed = untagged.where(timed_ & ~moved_).drop("ids", "to")
        parts.append(overlap_join(spans, timed, [], ("start_time", "end_time"), ("lo", "hi")).select("filter_id", "id"))
    if has["ids"]:
        picked = untagged.select("filter_id", "lo", "hi", F.explode("ids").alias("id")).join(spans, "id")
        parts.append(picked.where((F.col("end_time") >= F.col("lo")) & (F.col("start_time") <= F.col("hi"))).select("filter_id", "id"))
    if has["moved"]:
        whole = shape.where(moved_).select("filter_id", "to", F.col("to_lo").alias("lo"), F.col("to_hi").alias("hi"), (untagged_ & timed_).alias("alone"))
        if parts:
            asked = whole.where("NOT alone").drop("alone").distinct()
            found = pinned(reduce(DataFrame.unionByName, parts).distinct())
            held = found.join(small_side(asked), "filter_id").join(events.select("id", "start_time", "end_time", "tags"), "id")
            parts = [found.join(small_side(asked.select("filter_id")), "filter_id", "left_anti"), _in_bounds(held, store.time_coordinates)]
        if has["moved_spans"]:
            parts.append(_spans_in_coordinates(events, whole.where("alone").drop("alone"), store.time_coordinates))
    if not parts:
        return saved.select("filter_id", F.lit(0).cast("bigint").alias("id")).limit(0)
    out = reduce(DataFrame.unionByName, parts).distinct()
    if not has["schema"]:
        return out
    out = pinned(out)
    owned = [df for df in (
        store.samples.select(F.col("event_id").alias("id"), F.lit("timeseries").alias("schema")) if store.samples is not None else None,
        store.attachments.where("schema_name <> 'timeseries'").select(F.col("event_id").alias("id"), F.col("schema_name").alias("schema"))
        if store.attachments is not None else None) if df is not None]
    asked = shape.where(F.col("schema").isNotNull()).select("filter_id", "schema").distinct()
    owned = reduce(DataFrame.unionByName, owned).distinct()
    return out.join(asked, "filter_id", "left_anti").unionByName(
        out.join(asked, "filter_id").join(owned, ["id", "schema"], "left_semi").select("filter_id", "id"))


def _met() -> Column:
    return (F.col("t.name") == F.col("w_name")) & F.col("t.value").eqNullSafe(F.col("w_value"))


def _by_needs(events: DataFrame) -> DataFrame:
    """Events with `t`, each thing an event can be looked up by: its pairs, and its names with a null value."""
    keys = F.concat(F.col("tags"), F.transform(T.names(F.col("tags")), lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("value"))))
    return events.select("id", "start_time", "end_time", "tags", F.explode(keys).alias("t"))


def _rarest(events: DataFrame, asked: DataFrame) -> DataFrame:
    """(_no, w_name, w_value): the need of each alternative that the fewest events meet, none if some need is met by no event."""
    each = asked.select("_no", F.explode("need").alias("w")).select("_no", F.col("w.name").alias("w_name"), F.col("w.value").alias("w_value"))
    often = _by_needs(events).join(small_side(each.select("w_name", "w_value").distinct()), _met()).groupBy("w_name", "w_value").agg(F.count(F.lit(1)).alias("n"))
    often = pinned(often).select(F.col("w_name").alias("_n"), F.col("w_value").alias("_v"), "n")
    known = (F.col("w_name") == F.col("_n")) & F.col("w_value").eqNullSafe(F.col("_v"))
    return (each.join(small_side(often), known, "left").groupBy("_no")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w_name", "w_value")).alias("r")).where("r.n > 0").select("_no", "r.w_name", "r.w_value"))


def _by_rarest_need(events: DataFrame, asked: DataFrame) -> DataFrame:
    """Events (id, start_time, end_time) with each alternative of `asked` (need, ...) whose needs they meet.

    An alternative looks its events up by the one of its needs that the fewest events meet, so that a frequent pair next to a rare one costs
    nothing; the other needs are tested there.
    """
    asked = pinned(asked.withColumn("_no", F.monotonically_increasing_id()))
    asked = asked.join(_rarest(events, asked), "_no").drop("_no")
    met = _by_needs(events).join(small_side(asked), _met())
    return met.where(F.forall("need", lambda w: F.exists("tags", lambda t: (t["name"] == w["name"]) & (w["value"].isNull() | (t["value"] == w["value"]))))).drop("t", "tags", "w_name", "w_value")


def _converted(rows: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Events with `at_start` and `at_end`, their times in the coordinate their column `to` names."""
    return timecoord.with_times_in(rows, coordinates, T.from_text(F.col("to")), F.col("start_time"), F.col("end_time"), F.col("tags"), F.lit(True))


def _in_bounds(rows: DataFrame, coordinates: DataFrame) -> DataFrame:
    """(filter_id, id) of rows whose times in the filter's coordinate lie within its bounds."""
    return _converted(rows, coordinates).where("at_end >= lo AND at_start <= hi").select("filter_id", "id")


def _spans_in_coordinates(events: DataFrame, asked: DataFrame, coordinates: DataFrame) -> DataFrame:
    """(filter_id, id) for filters that have nothing but bounds in a coordinate: an interval join per coordinate named."""
    named = [r["to"] for r in asked.select("to").distinct().collect()]  # one per coordinate that filters name, not per filter or event
    rows = events.select("id", "start_time", "end_time", "tags", F.explode(F.array(*map(F.lit, named))).alias("to"))
    rows = _converted(rows, coordinates)
    # a falling coordinate swaps the two times: the join takes them in order, the test as they are
    rows = rows.select("id", F.col("to").alias("e_to"), "at_start", "at_end", F.least("at_start", "at_end").alias("e_lo"), F.greatest("at_start", "at_end").alias("e_hi"))
    asked = asked.withColumns({"f_lo": F.least("lo", "hi"), "f_hi": F.greatest("lo", "hi")})
    met = overlap_join(rows, asked, [("e_to", "to")], ("e_lo", "e_hi"), ("f_lo", "f_hi"))
    return met.where("at_end >= lo AND at_start <= hi").select("filter_id", "id")


def _field(name: str) -> Column:
    """A `name:value` part of a saved filter's text; the last one counts, null when missing."""
    given = F.filter("p", lambda s: F.startswith(F.lower(s), F.lit(f"{name}:")))
    return F.get(F.reverse(F.transform(given, lambda s: F.substr(s, F.lit(len(name) + 2)))), F.lit(0))
