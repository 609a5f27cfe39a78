"""The line format for events and timeseries, and the fact export.

    name=value,name2=value2     begins a series (or, with start/end or time, an event)
    1.5,11,12                   a sample: time and values; a time alone moves the end
    +name3=value3               adds tags to the series in progress
                                a blank line ends it

With `mux` every line begins with a token that tells interleaved series apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotag.functions import tags as T
from chronotag.model import EVENT_COLUMNS, MAX_TIME, Store
from chronotag.operators import cooccur, filters, series
from chronotag.operators import events as E
from chronotag.operators.filters import Filter
from chronotag.plans.durable import pinned
from chronotag.plans.ordered import Ordered, max_rows

# Tags of a header line that are not stored as tags.
RESERVED = ["start", "end", "time", "ID"]

# Lines of one file that a task reads in order; a longer file is read in pieces.
FILE_LINES = 250_000


# --- reading -----------------------------------------------------------------------------------

def read_lines(spark: SparkSession, path: str, mux: bool = False) -> DataFrame:
    """(file, mux, block, line, text, kind): lines in the order block, line inside each file.

    Files are read in parallel pieces; a line's place is the offset of its piece in the file and
    its place in the piece.
    """
    df = (spark.read.text(path)
          .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                  F.monotonically_increasing_id().alias("line"), F.trim("value").alias("text")))
    if mux:
        df = df.where(F.col("text") != "").withColumns({
            "mux": F.substring_index("text", " ", 1),
            "text": F.trim(F.when(F.contains(F.col("text"), F.lit(" ")), F.substr("text", F.instr("text", " ") + 1)).otherwise(""))})
    else:
        df = df.withColumn("mux", F.lit(""))
    kind = (F.when(F.col("text") == "", "blank")
            .when(F.contains(F.col("text"), F.lit("=")), F.when(F.startswith(F.col("text"), F.lit("+")), "more").otherwise("header"))
            .otherwise("data"))
    return pinned(df.withColumn("kind", kind))


def parse_lines(lines: DataFrame, add_tags: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(series, samples) of a table of lines.

    series: file, mux, number, block, line, tags, start_time, end_time (null when no time is
    known), n_lines. samples: file, mux, number, time, value.
    """
    keys = ["file", "mux"]
    state = F.when(F.col("kind") == "blank", "closed").when(F.col("kind") != "data", "open")
    o = Ordered(lines, keys, ["block", "line"], min(FILE_LINES, max_rows(lines))).fill_forward(inclusive=False, _state=state)
    closed = F.coalesce(F.col("_state") == "closed", F.lit(True))
    o = o.with_columns(kind=F.when((F.col("kind") == "more") & closed, "header").otherwise(F.col("kind")),
                       _bad=(F.col("kind") == "data") & closed)
    o = o.running_sum(number=(F.col("kind") == "header").cast("bigint"))
    df = o.done().where(F.col("kind") != "blank")
    text = F.when(F.col("_bad"), F.raise_error(F.concat(F.lit("data without a tag line before it: "), F.col("text"))))
    df = df.withColumn("text", text.otherwise(F.col("text")))
    keys = [*keys, "number"]

    fields = F.split("text", ",")
    data = df.where(F.col("kind") == "data").select(
        *keys, "block", "line", F.get(fields, F.lit(0)).cast("double").alias("time"),
        F.slice(fields, 2, F.size(fields)).cast("array<float>").alias("value"))
    timing = data.groupBy(*keys).agg(
        F.min_by("time", F.struct("block", "line")).alias("first_time"),
        F.max_by("time", F.struct("block", "line")).alias("last_time"), F.count(F.lit(1)).alias("n_lines"),
        F.min(F.struct("block", "line")).alias("created"))

    tagline = df.where(F.col("kind") != "data").withColumn("t", T.from_text(F.regexp_replace("text", r"^\+", "")))
    heads = tagline.where(F.col("kind") == "header")
    more = (tagline.where(F.col("kind") == "more").groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("block", "line", "t"))).alias("more")))
    heads = heads.join(more, keys, "left").join(timing, keys, "left")

    def number(name: str) -> Column:
        return T.value(F.col("t"), name).cast("double")
    both = number("time").isNotNull() & (number("start").isNotNull() | number("end").isNotNull())
    heads = heads.withColumns({
        "given_start": F.when(both, F.raise_error(F.concat(F.lit("time and start or end in one line: "), F.col("text")))
                              .cast("double")).otherwise(F.coalesce(number("time"), number("start"))),
        "given_end": F.coalesce(number("time"), number("end"))})
    none = [F.struct(F.lit(n).alias("name"), F.lit(None).cast("string").alias("value")) for n in RESERVED]
    tags = F.col("t")
    if add_tags:
        tags = T.add(tags, T.lit_tags(add_tags))
    tags = T.remove(tags, F.array(*none))
    final = F.aggregate(F.coalesce(F.col("more"), F.slice(F.array(F.struct("block", "line", "t")), 1, 0)), tags,
                        lambda acc, m: T.set_(acc, T.remove(m["t"], F.array(*none))))
    # an event without samples needs both of its times in the line
    timed = F.col("n_lines").isNotNull()
    out = heads.select(
        *keys, "block", "line", final.alias("tags"), tags.alias("head_tags"), "n_lines", "created",
        F.when(timed, F.coalesce("given_start", "first_time")).when(F.col("given_end").isNotNull(), F.col("given_start")).alias("start_time"),
        F.when(timed, F.coalesce("given_end", "last_time")).when(F.col("given_start").isNotNull(), F.col("given_end")).alias("end_time"))
    return out, data.where(F.size("value") > 0).select(*keys, "time", "value")


def put(store: Store, path: str, mux: bool = False, add_tags: str | None = None, rate_limit: float | None = None,
        unique: bool = False) -> Store:
    """Read files of lines into the store.

    Tag lines without samples and without times are left out. `rate_limit` drops samples less
    than that after the last one accepted; `unique` leaves out a series when an event with its
    tags exists already or comes earlier in the same files.
    """
    heads, samples = parse_lines(read_lines(store.spark, path, mux), add_tags)
    heads = heads.where(F.col("start_time").isNotNull())
    if unique:
        heads = _novel(heads, store.events)
    keys = ["file", "mux", "number"]
    first = E.next_id(store.events)
    numbered = pinned(heads.sort("file", "block", "line")
                      .withColumn("id", F.monotonically_increasing_id() + F.lit(first)))
    rows = samples.join(numbered.select(*keys, F.col("id").alias("event_id")), keys).select("event_id", "time", "value")
    if rate_limit is not None:
        rows = series.decimate(rows, rate_limit)
    old = store.samples
    return store.with_(events=store.events.select(*EVENT_COLUMNS).unionByName(numbered.select(*EVENT_COLUMNS)),
                       samples=rows if old is None else old.unionByName(rows))


def _novel(heads: DataFrame, events: DataFrame) -> DataFrame:
    """Series whose tags are not contained in an existing event's or an earlier series' tags.

    A series left out because of another one may still stand for it here: whatever contains the
    first contains what the first contains. A candidate is looked up by its rarest pair.
    """
    heads = pinned(heads)
    place = F.struct("file", "block", "line")
    known = events.select("tags", F.lit(None).cast(heads.select(place.alias("p")).schema["p"].dataType).alias("place")).unionByName(
        heads.select("tags", place.alias("place")))
    pairs = known.select("tags", "place", F.explode("tags").alias("pair"))
    frequency = pairs.groupBy(F.col("pair").alias("_fp")).agg(F.count(F.lit(1)).alias("_n"))
    mine = heads.select("file", "mux", "number", place.alias("at"), "head_tags", F.explode("head_tags").alias("pair"))
    rare = (mine.join(frequency, F.col("pair") == F.col("_fp"), "left")
            .groupBy("file", "mux", "number").agg(F.min_by(F.struct("at", "head_tags", "pair"), F.coalesce("_n", F.lit(0))).alias("r"))
            .select("file", "mux", "number", "r.*"))
    other = pairs.select(F.col("pair").alias("_op"), F.col("tags").alias("_ot"), F.col("place").alias("_oa"))
    repeats = rare.join(other, (F.col("pair") == F.col("_op")) & (F.col("_oa").isNull() | (F.col("_oa") < F.col("at")))
                        & T.contains_all(F.col("_ot"), F.col("head_tags")), "left_semi")
    return heads.join(repeats.select("file", "mux", "number"), ["file", "mux", "number"], "left_anti")


# --- writing -----------------------------------------------------------------------------------

def export(store: Store, columns: list[Filter | str], start: float | None = None, end: float | None = None,
           timestep: float | None = None, tags_only: bool = False, times: bool = True, id_tag: str | None = None,
           tabs: bool = False, schema: str | None = None, time_coordinate: str | None = None) -> DataFrame:
    """Lines (`value`) in order: for every event, or set of co-occurring events when there are
    several columns, a line of tagsets, then a line per sample time and a blank line.

    Samples are those of the event itself (one column, no timestep), or interpolated at the
    first series' times, or on a grid. `tabs` separates all fields by tabs.
    """
    fs = [Filter.from_text(c) if isinstance(c, str) else c for c in columns]
    if len(fs) == 1:
        common = filters.by_time(start, end).also(Filter(schema=schema, time_coordinate=time_coordinate))
        ev = filters.select(store, fs[0].also(common))
        sets = ev.select("start_time", "end_time", F.array("id").alias("ids"),
                         F.array(F.struct(F.lit(0).alias("a"), F.col("start_time").alias("s"), F.col("end_time").alias("e"),
                                          F.col("id").alias("i"))).alias("order"))
    else:
        sets = cooccur.concurrent(store, fs, start, end, None, time_coordinate, schema, with_order=True)
    sets = pinned(sets.withColumn("group_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")))
    if time_coordinate is not None:
        store = store.with_(events=filters.select(store, Filter(time_coordinate=time_coordinate)),
                            samples=series.samples_in_coordinate(store, time_coordinate))
    sep = "\t" if tabs else " "
    dims = series.dimensions(store)
    member = (sets.select("group_id", "order", F.col("start_time").alias("s"), F.col("end_time").alias("e"),
                          F.posexplode("ids").alias("position", "id"))
              .join(store.events.select("id", "tags", "start_time", "end_time"), "id").join(dims, "id"))
    tags = F.col("tags")
    if times:
        span = F.when(F.col("s") == F.col("e"), _pair("time", "s")).otherwise(F.concat(_pair("start", "s"), _pair("end", "e")))
        tags = T.add(tags, span)
    if id_tag:
        tags = T.set_(tags, _pair(id_tag, "id"))
    pad = F.repeat(F.lit("\t"), F.coalesce("dim", F.lit(1)).cast("int")) if tabs and not tags_only else F.lit(sep)
    if tabs and tags_only:
        pad = F.lit("\t")
    last = F.col("position") == F.lit(len(fs) - 1)
    cell = F.concat(F.lit("Time\t" if tabs else ""), T.to_text(tags), F.when(last, F.lit("")).otherwise(pad))
    heads = (member.withColumn("cell", cell).groupBy("group_id", "order")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "cell"))), lambda c: c["cell"]), "").alias("value"),
                  F.count("dim").alias("n_series")))
    lines = heads.select("order", F.lit(0).alias("kind"), F.lit(0.0).alias("time"), "value")
    if not tags_only and store.samples is not None:
        with_data = heads.where(F.col("n_series") > 0).select("group_id", "order")
        body = _body(store, sets.join(with_data.select("group_id"), "group_id", "left_semi"), member, len(fs), timestep, sep, tabs)
        lines = lines.unionByName(body).unionByName(
            with_data.select("order", F.lit(2).alias("kind"), F.lit(MAX_TIME).alias("time"), F.lit("").alias("value")))
    return lines.orderBy("order", "kind", "time").select("value")


def _pair(name: str, column: str) -> Column:
    return F.array(F.struct(F.lit(name).alias("name"), F.col(column).cast("string").alias("value")))


def _body(store, sets, member, n, timestep, sep, tabs) -> DataFrame:
    inner = "\t" if tabs else ","
    if timestep is not None:
        # a set of open events goes on to the newest sample of its events
        ids = sets.where(F.col("end_time") >= MAX_TIME).select("group_id", F.explode("ids").alias("event_id"))
        newest = ids.join(series.newest_times(store.samples.join(ids.select("event_id").distinct(), "event_id", "left_semi")), "event_id")
        newest = newest.groupBy(F.col("group_id").alias("_group")).agg(F.max("newest").alias("_newest"))
        sets = sets.join(newest, F.col("group_id") == F.col("_group"), "left")
        end = F.when(F.col("end_time") >= MAX_TIME, F.col("_newest")).otherwise(F.col("end_time"))
        steps = 1 + F.floor((end - F.col("start_time")) / F.lit(float(timestep)))
        at = series.on_grid(sets, F.col("start_time"), F.lit(float(timestep)), steps).select("group_id", "time")
    else:
        at = (sets.select("group_id", "start_time", "end_time", F.get("ids", F.lit(0)).alias("event_id"))
              .join(store.samples.select("event_id", "time"), "event_id")
              .where(F.col("time").between(F.col("start_time"), F.col("end_time"))).select("group_id", "time"))
    who = member.select("group_id", "order", "position", F.col("id").alias("event_id"))
    asked = at.join(who, "group_id")
    if n == 1 and timestep is None:
        got = asked.join(store.samples, ["event_id", "time"])
    else:
        got = series.value_linear(asked.select("event_id", "time", "group_id", "order", "position"), store.samples,
                                  series.spans(store.events))
    numbers = F.transform("value", lambda v: v.cast("string"))
    text = F.concat_ws(inner, F.col("time").cast("string"), F.array_join(numbers, inner))
    text = F.when(F.col("value").isNull(), F.col("time").cast("string")).otherwise(text)
    return (got.withColumn("cell", text).groupBy("group_id", "order", "time")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "cell"))), lambda c: c["cell"]), sep).alias("value"))
            .select("order", F.lit(1).alias("kind"), "time", "value"))


def facts(events: DataFrame) -> DataFrame:
    """Facts about events as lines: start, end (when there is one), every tag, and which start
    time follows which."""
    t0, t1 = F.col("start_time").cast("string"), F.col("end_time").cast("string")
    id_ = F.col("id").cast("string")

    def fact(name, *args):
        return F.concat(F.lit(f"{name}("), F.concat_ws(", ", *args), F.lit(")."))
    starts = events.select(fact("evt-start", id_, t0).alias("value"))
    ends = events.where(F.col("end_time") < F.lit(MAX_TIME)).select(fact("evt-end", id_, t1).alias("value"))

    def quoted(c):
        return F.concat(F.lit("'"), c, F.lit("'"))
    tags = events.select("id", F.explode("tags").alias("p")).select(
        fact("evt-tag", id_, quoted(F.col("p.name")), quoted(F.col("p.value"))).alias("value"))
    o = Ordered(events.select("start_time").distinct().withColumn("_all", F.lit(0)), "_all", "start_time")
    nxt = o.lead(_n=F.col("start_time")).done().where(F.col("_n").isNotNull()).select(
        fact("evt-next-time", t0, F.col("_n").cast("string")).alias("value"))
    return starts.unionByName(ends).unionByName(tags).unionByName(nxt)


# The rules that give meaning to the facts.
RULES = [
    "evt-next(ID1, ID2) :- evt-start(ID1, T1), evt-next-time(T1, T2), evt-start(ID2, T2).",
    "evt-next(ID1, ID2, 1) :- evt-next(ID1, ID2).",
    "evt-next(ID1, ID3, N) :- N > 1, M is N-1, evt-next(ID1, ID2), evt-next(ID2, ID3, M).",
]
