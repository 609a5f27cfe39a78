"""Operator 5, n-gram Jaccard join: rare-first prefixes with length, positional and suffix filters.

1. One pass gives every document its set's size and a fingerprint of the set, equal sets being one class from here on. Counts of all shingles
   by hash bucket, summed by Spark, fix one order of all shingles, rare ones first. The order decides about speed only; any order gives the same links.
2. A second pass gives every class its prefix in that order (size - ceil(t * size) + 1 shingles: two sets that link share one of these) and a histogram.
3. Classes that share a prefix shingle meet on it. First each meets the class that has the shingle furthest in front (a pair per
   entry, never all pairs of a group); length, positional and suffix filters leave the pairs to verify, once each, on the whole sets.
   Then classes that share a prefix shingle and are not yet connected meet, by the same filters, so that no link between components is missed.
4. Components of the links; a document's component is the smallest doc_id in it.
5. The links found so far are enough for the components, not all there are. All links lie within components: the classes of each are dealt into tiles
   (by bands of set sizes, then by hash), and each pair of tiles that can hold a link compares all its sets at once.

Nulls: a null text, like one without words, has no shingle and links with nothing, its component_id is its own doc_id; a document with a null doc_id
is linked but never names a component unless all ids are null. Rows that repeat a doc_id are documents of their own. A text of fewer words than a
shingle is one shingle. Empty tables give no rows. `join` gives all links between classes, `connect` only as many as the components need; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotag.llm import arrays as A
from chronotag.llm.common import keep_broadcast, small_batches, spare, tidy, written
from chronotag.llm.components import components

BUCKET_BITS, CHUNKS = 17, 64
PARTS = 64
#: A part's count is one byte; this one means "or more".
FULL = 127
#: Bytes of a shingle's hash in the final comparison of two sets.
ITEM = 6
#: Pairs of one class that are compared in one piece; a class with more meets its partners in several.
PIECE = 2000
#: Classes and shingles of a tile; shared shingles that are compared at once.
TILE, TILE_SHINGLES, STEP = 256, 400_000, 4096


def shingles(buf, offsets, k):
    """(hash, text) of all runs of k words; a text of fewer words has one, of all its words."""
    plain = A.lower(buf)
    starts, ends, no = A.words(plain, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = A.spans(A.prefix_sums(plain), starts, ends)
    hashes, at = A.grams(words, no, k)
    out, owner = [hashes], [no[at]]
    count = np.bincount(no, minlength=len(offsets) - 1)
    for few in range(1, k):
        own = np.flatnonzero(count[no] == few)
        if len(own):
            hashes, at = A.grams(words[own], no[own], few)
            out.append(A.mix(hashes + np.uint64(few)))
            owner.append(no[own][at])
    return np.concatenate(out), np.concatenate(owner)


def distinct(hashes, owner, rank):
    """The distinct shingles of each text, ordered by text, rank and hash."""
    order = np.lexsort((hashes, (owner.astype(np.uint64) << np.uint64(44)) | rank))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def _bucket(hashes):
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _sized(buf, offsets, k, counts):
    """Distinct shingles of the texts in order of `counts` (of hash alone without), their text, sizes, and set fingerprints."""
    hashes, owner = shingles(buf, offsets, k)
    hashes, owner = distinct(hashes, owner, counts[_bucket(hashes)] if counts is not None else np.zeros(len(hashes), np.uint64))
    size = np.bincount(owner, minlength=len(offsets) - 1)
    begin = np.concatenate([[0], np.cumsum(size)])
    running = np.concatenate([[np.uint64(0)], np.cumsum(A.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))])
    key = A.mix(running[begin[1:]] - running[begin[:-1]] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    return hashes, owner, size, begin, key


def survey(docs: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """One pass: (doc_id, key, n) of every document, key being the fingerprint of its set; and in how many documents the shingles
    of each hash bucket occur, 2**BUCKET_BITS numbers at any size of the input, summed by Spark."""
    kind, wide = dict(docs.dtypes)["doc_id"], 1 << BUCKET_BITS

    def run(batches):
        total, names = np.zeros(wide, np.int64), ["doc_id", "key", "n", "chunk", "counts"]
        ids = pa.null()
        for b in batches:
            ids = b.schema.field("doc_id").type
            for row, buf, offsets in A.pieces(b.column("text")):
                hashes, _, size, _, key = _sized(buf, offsets, k, None)
                total += np.bincount(_bucket(hashes), minlength=wide)
                m = len(size)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(row, m), pa.array(key), pa.array(size), pa.nulls(m, pa.int32()), pa.nulls(m, pa.list_(pa.int64()))], names)
        if total.any():
            parts = total.reshape(CHUNKS, -1)
            yield pa.RecordBatch.from_arrays([pa.nulls(CHUNKS, ids), pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.int64()), pa.array(range(CHUNKS), pa.int32()), pa.array(list(parts), pa.list_(pa.int64()))], names)

    rows = written(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key long, n long, chunk int, counts array<long>"))
    sums = rows.where("chunk is not null").select("chunk", F.posexplode("counts").alias("at", "n")).groupBy("chunk", "at").agg(F.sum("n").alias("n"))
    counts = np.zeros((CHUNKS, wide // CHUNKS), np.uint64)
    chunk, at, n = (c.to_numpy() for c in sums.where("n > 0").toArrow().columns)  # a row for each bucket costs the driver hundreds of bytes
    counts[chunk, at] = n
    return rows.where("chunk is null").select("doc_id", "key", "n"), counts.reshape(-1)


def _of_classes(docs: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id and text of one document of each class in `members`. Rows that repeat a doc_id come along; they do no harm."""
    ids = written(members.groupBy("key").agg(F.min("doc_id").alias("_only")).select("_only").distinct())
    return docs.select("doc_id", "text").join(keep_broadcast(ids), F.col("doc_id").eqNullSafe(F.col("_only")), "left_semi")


def describe(docs: DataFrame, members: DataFrame, counts: np.ndarray, k: int, percent: int) -> DataFrame:
    """key, n, prefix and parts (a histogram of the set) of every class."""
    def run(batches):
        for b in batches:
            for _, buf, offsets in A.pieces(b.column("text")):
                hashes, owner, size, begin, key = _sized(buf, offsets, k, counts)
                length = np.where(size > 0, size - -(-percent * size // 100) + 1, 0)
                inside = np.arange(len(hashes)) - np.repeat(begin[:-1], size) < np.repeat(length, size)
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(hashes[inside].view(np.int64)))
                parts = np.zeros((len(size), PARTS), np.int32)
                np.add.at(parts, (owner, (hashes & np.uint64(PARTS - 1)).astype(np.int64)), 1)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(size), prefix, pa.array(list(np.minimum(parts, FULL).astype(np.int8)), pa.list_(pa.int8()))], ["key", "n", "prefix", "parts"])

    rows = _of_classes(docs, members.where("n > 0")).select("text")
    return written(rows.mapInArrow(run, "key long, n long, prefix array<long>, parts array<tinyint>").where("n > 0"))


def _enough(overlap: Column, x: Column, y: Column, percent: int) -> Column:
    """An overlap of sets of sizes x and y makes a similarity of at least `percent`."""
    return (100 + percent) * overlap >= percent * (x + y)


def _possible(percent: int) -> Column:
    """Length and positional filter at the first shingle two sets share: positions p and q, sizes n and m."""
    fits = (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    return fits & _enough(F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q")), F.col("n"), F.col("m"), percent)


def _common() -> Column:
    """The most shingles two sets can share by their histograms, and so by what follows their prefixes; no bound where a part is full in both."""
    least = F.zip_with("parts_a", "parts_b", lambda x, y: F.least(x, y).cast("long"))
    return F.aggregate(least, F.lit(0).cast("long"), lambda t, x: t + F.when(x == FULL, 1 << 40).otherwise(x))


def _packed(docs: DataFrame, members: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """key and items (the set in ITEM bytes a shingle) of the classes in `wanted` (key). A class may come more than once."""
    def run(batches):
        for b in batches:
            for _, buf, offsets in A.pieces(b.column("text")):
                hashes, _, _, begin, key = _sized(buf, offsets, k, None)
                items = hashes.view(np.uint8).reshape(-1, 8)[:, 8 - ITEM:]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([items[i:j].tobytes() for i, j in zip(begin, begin[1:])], pa.binary())], ["key", "items"])

    own = _of_classes(docs, members.join(keep_broadcast(wanted), "key", "left_semi"))
    return own.select("text").mapInArrow(run, "key long, items binary")


def _unpacked(cell) -> np.ndarray:
    out = np.zeros((len(cell) // ITEM, 8), np.uint8)
    out[:, :ITEM] = np.frombuffer(cell, np.uint8).reshape(-1, ITEM)
    return out.view(np.uint64).reshape(-1)


def _verify(pairs: DataFrame, members: DataFrame, meta: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link: suffix filter on histograms, then the whole sets, once for each pair.

    The set of a travels to b once per pair, from where it is made if the pairs are few enough to be sent there.
    The set of b travels once for every PIECE partners."""
    side = lambda c: meta.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("parts").alias(f"parts_{c}"))
    once = pairs.groupBy(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).agg(F.min("b").alias("b"))
    once = once.select((F.when(F.col("b") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))).alias("a"), "b")
    once = written(once.join(side("a"), "a").join(side("b"), "b").where(_enough(_common(), F.col("n_a"), F.col("n_b"), percent)).select("a", "b"))
    crowded = written(once.groupBy("b").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces")).where("pieces > 1"))
    once = once.join(keep_broadcast(crowded), "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), "pieces"), F.lit(0)).alias("piece"))
    ends = written(once.select("b", "piece").distinct())

    def sets(wanted, c, name):
        """The sets of the classes in column `c` of `wanted`, with its columns."""
        own = _packed(docs, members, wanted.select(F.col(c).alias("key")).distinct(), k)
        return own.join(keep_broadcast(wanted), F.col("key") == F.col(c)).select(*wanted.columns, F.col("items").alias(name))

    both = sets(once, "a", "x").join(sets(ends, "b", "y"), ["b", "piece"])

    def check(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("x"), b.column("y"))):
                x, y = _unpacked(x.as_py()), _unpacked(y.as_py())
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct()


def connect(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, key, n; links between classes: a, b). Links connect all classes whose sets are similar enough;
    classes that are connected already may have more links, which `join` gives."""
    with small_batches(docs.sparkSession):
        return _connect(docs, k, percent)


def _connect(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    members, counts = survey(docs, k)
    classes = describe(docs, members, counts, k, percent)
    # one shuffle by shingle: each entry with the class that has its shingle far in front; ties by key, so that a group's shingles choose the same one
    entries = classes.select("key", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("p", "gram")).repartition("gram")
    front = F.shiftleft(F.shiftright("p", 2).cast("long"), 40) + F.col("key").bitwiseAND((1 << 40) - 1)
    hubs = entries.groupBy("gram").agg(F.count("*").alias("classes"), F.min_by("key", front).alias("hub"), F.min_by("p", front).alias("q"), F.min_by("n", front).alias("m"))
    live = written(entries.join(hubs.where("classes > 1").drop("classes"), "gram"))
    tidy(docs.sparkSession)
    meta = written(classes.select("key", "n", "parts").join(live.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]))
    pairs = live.where((F.col("key") != F.col("hub")) & _possible(percent)).select(F.col("key").alias("a"), F.col("hub").alias("b"))
    near = written(_verify(pairs, members, meta, docs, k, percent))
    tidy(docs.sparkSession)
    # what the first links have not connected meets within each shared shingle
    place = keep_broadcast(written(components(near).withColumnRenamed("node", "key")))
    placed = live.select("gram", "key", "n", "p").join(place, "key", "left").withColumn("component", F.coalesce("component", "key")).repartition("gram")
    mixed = placed.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("gram")
    left = written(placed.join(mixed, "gram").join(meta.select("key", F.col("parts").alias("parts_a")), "key")).repartition("gram")  # both sides of the join read this one shuffle
    tidy(docs.sparkSession)
    other = left.select("gram", F.col("key").alias("key2"), F.col("n").alias("m"), F.col("p").alias("q"), F.col("component").alias("component2"), F.col("parts_a").alias("parts_b"))
    rest = left.join(other, "gram").where((F.col("component") < F.col("component2")) & _possible(percent) & _enough(_common(), F.col("n"), F.col("m"), percent))
    more = _verify(rest.select(F.col("key").alias("a"), F.col("key2").alias("b")), members, meta, docs, k, percent)
    found = written(near.union(more))
    tidy(docs.sparkSession)
    return members, found


def _overlaps(x, y, n, m):
    """How many items each of n sets shares with each of m: x and y are pairs of items and the number of their set."""
    common = np.intersect1d(x[0], y[0])
    total, sides = np.zeros((n, m)), []
    for items, owner in (x, y):
        at = np.minimum(np.searchsorted(common, items), max(len(common) - 1, 0))
        found = np.flatnonzero(common[at] == items) if len(common) else np.zeros(0, int)
        found = found[np.argsort(at[found], kind="stable")]
        sides.append((at[found], owner[found]))
    for first in range(0, len(common), STEP):
        have = []
        for (at, owner), rows in zip(sides, (n, m)):
            i, j = np.searchsorted(at, [first, first + STEP])
            have.append(np.zeros((rows, min(STEP, len(common) - first)), np.float32))
            have[-1][owner[i:j], at[i:j] - first] = 1
        total += have[0] @ have[1].T
    return total


def _tiled(docs: DataFrame, classes: DataFrame, members: DataFrame, k: int, percent: int, counted: bool) -> DataFrame:
    """All links between `classes` (key, component, n, c documents), each pair of one component compared once: a and b, or if `counted`
    key and n_links, documents of linked classes, in parts to be added up.

    A component that fits a tile is compared as one. The classes of a larger one are dealt into bands of set sizes, so that links are within
    a band or between neighbours, and bands into tiles; a set travels once for each tile that its own meets."""
    width = math.log(100 / percent) + 1e-3
    size = classes.groupBy("component").agg(F.count("*").alias("classes"), F.sum("n").alias("shingles"))
    large = size.where((F.col("classes") > TILE) | (F.col("shingles") > TILE_SHINGLES)).select("component", F.lit(True).alias("large"))
    rows = written(classes.join(keep_broadcast(written(large)), "component", "left").withColumn("large", F.coalesce("large", F.lit(False))))
    banded = rows.where("large").withColumn("band", F.floor(F.log("n") / width).cast("int"))
    tiles = written(banded.groupBy("component", "band").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_SHINGLES)).cast("int").alias("tiles")))
    near = lambda name, by: keep_broadcast(tiles.select("component", (F.col("band") + by).alias("band"), F.col("tiles").alias(name)))
    banded = banded.join(near("tiles", 0), ["component", "band"]).join(near("up", -1), ["component", "band"], "left").join(near("down", 1), ["component", "band"], "left")
    banded = banded.withColumn("tile", F.pmod(F.xxhash64("key"), "tiles").cast("int"))

    def cells(count, lo, hi, i, j, side):
        cell = lambda u: F.struct(lo.alias("lo"), hi.alias("hi"), i(u).alias("i"), j(u).alias("j"), side(u).alias("side"))
        return F.when(F.coalesce(F.col(count), F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), cell)).otherwise(F.array())

    band, tile = F.col("band"), F.col("tile")
    own = cells("tiles", band, band, lambda u: F.least(tile, u), lambda u: F.greatest(tile, u), lambda u: F.when(u < tile, 1).otherwise(0))
    over = cells("up", band, band + 1, lambda u: tile, lambda u: u, lambda u: F.lit(0))
    under = cells("down", band - 1, band, lambda u: u, lambda u: tile, lambda u: F.lit(1))
    split = banded.select("key", "c", "component", F.explode(F.concat(own, over, under)).alias("cell")).select("key", "c", "component", "cell.*")
    split = split.withColumn("work", F.xxhash64("component", "lo", "hi", "i", "j"))
    whole = rows.where("not large")
    bins = int((whole.agg(F.sum("n")).first()[0] or 0) // TILE_SHINGLES) + 1
    zero = F.lit(0)
    whole = whole.select("key", "c", "component", zero.alias("lo"), zero.alias("hi"), zero.alias("i"), zero.alias("j"), zero.alias("side"), F.pmod(F.xxhash64("component"), F.lit(bins)).alias("work"))
    wanted = written(split.union(whole))
    sets = _packed(docs, members, rows.select("key"), k).join(keep_broadcast(wanted), "key")

    def compare(table):
        col = {c: table.column(c).to_numpy() for c in ("key", "c", "component", "lo", "hi", "i", "j", "side")}
        items = table.column("items")
        order = np.lexsort([col[c] for c in ("key", "side", "j", "i", "hi", "lo", "component")])
        same = np.ones(len(order), bool)
        for c in ("component", "lo", "hi", "i", "j"):
            same[1:] &= col[c][order][1:] == col[c][order][:-1]
        again = np.zeros(len(order), bool)  # rows that repeat a doc_id bring a class more than once
        again[1:] = same[1:] & (col["key"][order][1:] == col["key"][order][:-1])
        begin = np.flatnonzero(~same[1:]) + 1
        out = []
        for at, repeated in zip(np.split(order, begin), np.split(again, begin)):
            at = at[~repeated]
            first = at[0]
            inside = col["lo"][first] == col["hi"][first] and col["i"][first] == col["j"][first]
            sides = [at, at] if inside else [at[col["side"][at] == 0], at[col["side"][at] == 1]]
            if not len(sides[0]) or not len(sides[1]) or (inside and len(at) < 2):
                continue
            packed = []
            for x in sides[:1] if inside else sides:
                each = [_unpacked(items[int(r)].as_py()) for r in x]
                sizes = np.array([len(e) for e in each])
                packed.append(((np.concatenate(each), np.repeat(np.arange(len(each)), sizes)), sizes))
            (x, n), (y, m) = packed[0], packed[-1]
            shared = _overlaps(x, y, len(n), len(m))
            linked = 100 * shared >= percent * (n[:, None] + m[None, :] - shared)
            if inside:
                linked = np.triu(linked, 1)
            if counted:
                out += [(col["key"][sides[0]], linked @ col["c"][sides[1]]), (col["key"][sides[1]], linked.T @ col["c"][sides[0]])]
            else:
                a, b = np.nonzero(linked)
                a, b = col["key"][sides[0][a]], col["key"][sides[1][b]]
                out.append((np.minimum(a, b), np.maximum(a, b)))
        names = ["key", "n_links"] if counted else ["a", "b"]
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *[o[i] for o in out]]), pa.int64()) for i in (0, 1)], names)

    return sets.groupBy("work").applyInArrow(compare, "key long, n_links long" if counted else "a long, b long")


def _placed(members: DataFrame, links: DataFrame) -> DataFrame:
    """key, component, n and c (documents) of the classes that have a link."""
    place = keep_broadcast(written(components(links).withColumnRenamed("node", "key")))
    return written(members.join(place, "key").groupBy("key", "component").agg(F.first("n").alias("n"), F.count("*").alias("c")))


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, key, n; links between classes: a < b). All pairs of classes whose sets are similar enough, each once;
    documents of one class have equal sets."""
    with small_batches(docs.sparkSession):
        members, some = _connect(docs, k, percent)
        return members, written(_tiled(docs, _placed(members, some), members, k, percent, False))


def _components(members: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles and component_id of every document."""
    members = members.join(components(links).withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    first = members.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    return members.join(first, "component", "left").select(
        "doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links, the number of other documents that are similar enough, of every document."""
    with small_batches(docs.sparkSession):
        members, some = _connect(docs, k, percent)
        linked = _tiled(docs, _placed(members, some), members, k, percent, True).groupBy("key").agg(F.sum("n_links").alias("others"))
        equal = members.where("n > 0").groupBy("key").agg((F.count("*") - 1).alias("copies")).where("copies > 0")
        links = written(linked.join(equal, "key", "full").select("key", (F.coalesce("others", F.lit(0)) + F.coalesce("copies", F.lit(0))).alias("n_links")))
    tidy(docs.sparkSession)
    return _components(members, some).join(keep_broadcast(links), "key", "left").select(
        "doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each component: that of the smallest doc_id (null last), among rows of one id that of the smallest hash of its
    text, among equal ones one. Ids need not differ: a text is only left out for another one that stays. Documents without words all stay."""
    text = F.coalesce("text", F.lit(""))
    mark = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.unhex(F.md5(text)).alias("text"))
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.select(mark.alias("doc_id"), "text")
    members, links = connect(rows, k, percent)
    kept = _components(members, links).where((F.col("doc_id") == F.col("component_id")) & (F.col("n_shingles") > 0)).select(
        F.col("doc_id.none").alias("none"), F.col("doc_id.id").alias("id"), F.col("doc_id.text").alias("hash")).distinct()
    name, = spare(docs.columns, "mark")
    marked = docs.withColumn(name, mark)
    here = F.col(name)
    kept = kept.select(*[F.col(c).alias(n) for c, n in zip(("none", "id", "hash"), spare([*docs.columns, name], "none", "id", "hash"))])
    kept = written(kept)
    on = (here["none"] == kept[kept.columns[0]]) & here["id"].eqNullSafe(kept[kept.columns[1]]) & (here["text"] == kept[kept.columns[2]])
    whole = marked.where(~wordless).join(keep_broadcast(kept), on, "left_semi")
    repeated = members.where("n > 0").groupBy("doc_id").count().where("count > 1").limit(1).count()
    return (whole.dropDuplicates([name]) if repeated else whole).drop(name).union(docs.where(wordless))
