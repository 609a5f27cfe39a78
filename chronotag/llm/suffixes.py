"""Operator 10, suffix-array dedup with a logarithmic family of indexes.

A byte goes if a string of `LENGTH` bytes that covers it also starts in a document with a smaller doc_id. The index holds sparse suffixes: a window
of LENGTH bytes is represented by the suffix at its anchor, the `GRAM` bytes in it with the least hash, so equal windows have equal anchors at
equal places wherever they stand. Neighbouring windows with the same anchor form a run, whose context (all bytes of its windows) is compared at once.

1. Every batch of texts sorts its runs and sends them, packed, to the hash range of their anchor. Copies inside a batch are settled there, so a
   text or passage that a third of all documents share arrives once per batch.
2. Each hash range keeps a family of sorted arrays: a new batch is merge-scanned against every level, then becomes the lowest level, and levels of equal
   size merge. Runs whose context a smaller document has go. Runs that share an anchor and 15 more bytes on one side with a different
   context (the edges of shared passages) are looked at again.
3. The windows of those runs only, hashed one by one, go through the same family.
4. Removed windows are joined per document to maximal spans.

Texts are moved for documents with edges or removed bytes alone. Contexts and windows are compared by 64-bit hashes.

Nulls: a null text is empty; null doc_ids count as larger than all others and do not remove from each other, nor do rows that repeat a doc_id. Texts
under LENGTH bytes stay. An empty table gives no rows; `cleaned` keeps other columns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotag.llm import arrays as A
from chronotag.llm.common import keep_broadcast, pinned, small_batches, tidy

LENGTH, GRAM = 50, 20
SIDE = 15
PIECE = 2 << 20
NO_ID = (1 << 63) - 1
RUN = np.dtype([("key", "<u8"), ("anchor", "<u2"), ("left", "<u2"), ("right", "<u2"), ("more", "u1"), ("side", "u1"), ("doc", "<u2"), ("at", "<u4")])
ROW = "id long, mark long, kind int, spans binary"
PACKED = "bucket int, ids binary, marks binary, n int, columns binary"


def anchors(buf, offsets):
    """Runs of windows with one anchor: first window, last window, anchor, text; and the prefix sums of the bytes."""
    n = len(buf) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, None
    sums, inverse = A.prefix_sums(buf), A.powers(len(buf) + 1)[1]
    least = A.mix((sums[GRAM:] - sums[:-GRAM]) * inverse[:len(buf) - GRAM + 1])
    least = (least & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(least), dtype=np.uint64)
    width, have = LENGTH - GRAM + 1, 1
    while have < width:  # the minimum over `have` places, doubled until it spans a window
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    anchor = (least[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    no = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    inside = no[:n] == no[LENGTH - 1:]
    first = inside.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= (anchor[1:] != anchor[:-1]) | ~inside[1:]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    return first, last, anchor[first], no[first].astype(np.int64), sums


def runs(buf, offsets):
    """RUN rows of a batch of texts, in the order of their places, and the 64-bit hash of each anchor."""
    first, last, at, no, sums = anchors(buf, offsets)
    out = np.zeros(len(first), RUN)
    if not len(first):
        return out, np.zeros(0, np.uint64)
    gram = A.spans(sums, at, at + GRAM)
    out["key"] = A.spans(sums, first, last + LENGTH)
    out["anchor"] = (gram & np.uint64(0xFFFF)).astype(np.uint16)  # with the side codes, 32 bits tell edges apart inside a hash range
    # a window reaches SIDE bytes beyond its anchor on one side at least; 0 stands for no window on that side
    left, right = first <= at - SIDE, last > at - SIDE
    for name, has, a, b in (("left", left, at - SIDE, at + GRAM), ("right", right, at, at + GRAM + SIDE)):
        code = np.zeros(len(first), np.uint64)
        code[has] = A.spans(sums, a[has], b[has]) % np.uint64(65535) + np.uint64(1)
        out[name] = code
    out["more"], out["side"], out["doc"], out["at"] = last - first, at - first, no, first - offsets[no]
    return out, gram


def windows(buf, offsets, wanted):
    """RUN rows of single windows, and the hashes of their anchors; `wanted` gives (first, last, anchor) places for each text."""
    sums = A.prefix_sums(buf)
    no = np.repeat(np.arange(len(wanted)), [len(w) for w in wanted])
    spans = (np.concatenate(wanted) if len(no) else np.zeros((0, 3), np.int64)) + offsets[no][:, None]
    length = spans[:, 1] - spans[:, 0] + 1
    begin = np.cumsum(length) - length
    starts = np.arange(length.sum()) + np.repeat(spans[:, 0] - begin, length)
    out, no = np.zeros(len(starts), RUN), np.repeat(no, length)
    out["key"] = A.spans(sums, starts, starts + LENGTH)
    out["doc"], out["at"] = no, starts - offsets[no]
    return out, np.repeat(A.spans(sums, spans[:, 2], spans[:, 2] + GRAM), length)


def _spans_by_text(rows, ids, marks, kind, which=None):
    """(id, mark, kind, packed places) of each text among `rows`: spans (first, last) to remove, neighbours put together; or, with
    `which` (1 the left side is shared, 2 the right, 3 both), (first, last, anchor) of the windows to look at again."""
    if not len(rows):
        return
    order = np.lexsort((rows["at"], rows["doc"]))
    rows = rows[order]
    lo, hi, doc = rows["at"].astype(np.int64), rows["at"].astype(np.int64) + rows["more"], rows["doc"]
    if which is None:
        new = np.r_[True, (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1] + 1)]
        spans, doc = np.stack([lo[new], hi[np.r_[new[1:], True]]], 1), doc[new]
    else:
        which, at = which[order], lo + rows["side"]
        spans = np.stack([np.where(which & 1, lo, np.maximum(lo, at - SIDE + 1)), np.where(which & 2, hi, np.minimum(hi, at - SIDE)), at], 1)
    begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    spans = spans.astype("<u4")
    for i, j in zip(begin, np.r_[begin[1:], len(doc)]):
        yield int(ids[doc[i]]), int(marks[doc[i]]), kind, spans[i:j].tobytes()


def settle(rows, ids):
    """Which rows of a batch have a key that a smaller id of the batch has, too."""
    beaten = np.zeros(len(rows), bool)
    if len(rows):
        order, group = A.grouped(rows["key"])
        owner = ids[rows["doc"]][order]
        beaten[order] = owner > np.minimum.reduceat(owner, np.flatnonzero(np.r_[True, group[1:] != group[:-1]]))[group]
    return beaten


def pack(rows, hashes, ids, marks, buckets):
    """The rows of a batch by bucket (the top of `hashes`): columns one after the other, split into byte planes and compressed."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    for part, b in zip(np.split(rows, np.flatnonzero(np.diff(bucket)) + 1), bucket[np.flatnonzero(np.diff(bucket, prepend=-1))]):
        if len(part):
            docs, part["doc"] = np.unique(part["doc"], return_inverse=True)
            planes = b"".join(np.ascontiguousarray(np.ascontiguousarray(part[c]).view(np.uint8).reshape(len(part), -1).T).tobytes() for c in RUN.names)
            yield int(b), _squeeze(ids[docs]), _squeeze(marks[docs]), len(part), pa.compress(planes, "zstd", asbytes=True)


def _squeeze(numbers):
    """64-bit numbers, compressed by byte planes, with their count in front."""
    planes = np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(numbers).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True)


def _expand(cell):
    n = int.from_bytes(cell[:4], "little")
    planes = np.frombuffer(pa.decompress(cell[4:], 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").reshape(n)


def unpack(n, planes):
    out, at = np.zeros(n, RUN), 0
    planes = np.frombuffer(pa.decompress(planes, n * RUN.itemsize, "zstd", asbytes=True), np.uint8)
    for c in RUN.names:
        size = n * RUN[c].itemsize
        out[c] = np.ascontiguousarray(planes[at:at + size].reshape(-1, n).T).view(RUN[c]).reshape(n)
        at += size
    return out


class Family:
    """Sorted arrays (keys, least id of each key) of geometrically growing sizes."""

    def __init__(self):
        self.levels = []

    @staticmethod
    def _sorted(keys, ids):
        order = np.argsort(keys, kind="stable")  # two sorted arrays end to end are merged in one go
        keys, ids = keys[order], ids[order]
        begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[begin], np.minimum.reduceat(ids, begin)

    def add(self, keys, ids):
        """Scan a new batch against all levels, the least id of a key wins; what no level has becomes a level of its own."""
        if not len(keys):
            return
        keys, ids = self._sorted(keys, ids)
        for have, least in self.levels:
            at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
            known = have[at] == keys
            np.minimum.at(least, at[known], ids[known])
            keys, ids = keys[~known], ids[~known]
        if len(keys):
            self.levels.append((keys, ids))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            a, b = self.levels.pop(), self.levels.pop()
            self.levels.append(self._sorted(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])))

    def least(self, keys):
        out = np.full(len(keys), NO_ID, np.int64)
        for have, ids in self.levels:
            at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
            known = have[at] == keys
            out[known] = np.minimum(out[known], ids[at][known])
        return out


def _edges(rows, owner):
    """Which rows share their anchor and the bytes left (1) or right (2) of it with another document's different context; 3 is both."""
    out = np.zeros(len(rows), np.uint8)
    for bit, side in ((1, "left"), (2, "right")):
        own = np.flatnonzero(rows[side])
        code = (rows["anchor"][own].astype(np.uint64) << np.uint64(16)) | rows[side][own]
        order, group = A.grouped(code)
        if not len(order):
            continue
        docs, keys = owner[own][order], rows["key"][own][order]
        begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        several = (np.minimum.reduceat(docs, begin) != np.maximum.reduceat(docs, begin)) & (np.minimum.reduceat(keys, begin) != np.maximum.reduceat(keys, begin))
        out[own[order[several[group]]]] |= bit
    return out


def _matched(table, edges: bool):
    """What one hash range finds: kind 1 spans to remove, kind 2 spans to look at again."""
    batches = []
    for ids, marks, n, columns in zip(*(table.column(c).to_pylist() for c in ("ids", "marks", "n", "columns"))):
        batches.append((_expand(ids), _expand(marks), unpack(n, columns)))
    batches.sort(key=lambda b: int(b[0].min()))
    family, out = Family(), []
    for ids, _, rows in batches:
        family.add(rows["key"], ids[rows["doc"]])
    kept = []
    for ids, marks, rows in batches:
        owner = ids[rows["doc"]]
        beaten = family.least(rows["key"]) < owner
        out += _spans_by_text(rows[beaten], ids, marks, 1)
        kept.append((rows[~beaten], owner[~beaten]))
    if edges and kept:
        again = _edges(np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept]))
        at = 0
        for (ids, marks, _), (rows, _) in zip(batches, kept):
            which = again[at:at + len(rows)]
            out += _spans_by_text(rows[which > 0], ids, marks, 2, which[which > 0])
            at += len(rows)
    cols = list(zip(*out)) or [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["id", "mark", "kind", "spans"])


def _round(rows: DataFrame, buckets: int, single: bool) -> DataFrame:
    """One pass of the family over (id, mark, text[, wanted]): spans to remove and, for runs, spans to look at again."""
    def send(batches):
        for b in batches:
            ids, marks = b.column("id").to_numpy(), b.column("mark").to_numpy()
            out, local = [], []
            for row, buf, offsets in A.pieces(b.column("text"), PIECE):
                n = len(offsets) - 1
                if single:
                    wanted = [np.concatenate([np.frombuffer(s, "<u4").reshape(-1, 3) for s in w]).astype(np.int64) for w in b.column("wanted").slice(row, n).to_pylist()]
                    found, hashes = windows(buf, offsets, wanted)
                else:
                    found, hashes = runs(buf, offsets)
                own, own_marks = ids[row:row + n], marks[row:row + n]
                beaten = settle(found, own)
                local += _spans_by_text(found[beaten], own, own_marks, 1)
                out += pack(found[~beaten], hashes[~beaten], own, own_marks, buckets)
                if len(out) > 4 * buckets:
                    yield _packed(out, local)
                    out, local = [], []
            yield _packed(out, local)

    sent = rows.mapInArrow(send, f"{PACKED}, {ROW}")
    # the spans settled inside a batch travel along, dealt over all buckets
    return sent.groupBy("bucket").applyInArrow(lambda t: _reduce(t, not single), ROW)


def _packed(out, local):
    n, m = len(out), len(local)
    a, b = list(zip(*out)) or [[]] * 5, list(zip(*local)) or [[]] * 4
    where = [x * 2654435761 >> 16 & 0xFFFF for x in b[0]] if m else []
    return pa.RecordBatch.from_arrays([
        pa.array([*a[0], *where], pa.int32()), *[pa.array([*a[i], *[None] * m], t) for i, t in ((1, pa.binary()), (2, pa.binary()), (3, pa.int32()), (4, pa.binary()))],
        *[pa.array([*[None] * n, *b[i]], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))]],
        ["bucket", "ids", "marks", "n", "columns", "id", "mark", "kind", "spans"])


def _reduce(table, edges):
    import pyarrow.compute as pc
    settled = table.filter(pc.is_valid(table.column("id"))).select(["id", "mark", "kind", "spans"])
    found = _matched(table.filter(pc.is_valid(table.column("n"))), edges)
    return pa.concat_tables([settled, found]).combine_chunks()


def _keyed(docs: DataFrame) -> DataFrame:
    """`docs` with the id that orders its rows, its text, and a mark: 0, or a hash of the text where rows with different texts share an id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), text.alias("_text"))
    mark = F.xxhash64("_text")
    several = pinned(rows.groupBy("_id").agg(F.count("*").alias("n"), F.min(mark).alias("a"), F.max(mark).alias("b")).where("n > 1 and a <> b").select(F.col("_id").alias("_only")))
    if several.limit(1).count() == 0:
        return rows.withColumn("_mark", F.lit(0).cast("long"))
    return _only(rows, several, "left").withColumn("_mark", F.when(F.col("_only").isNotNull(), mark).otherwise(F.lit(0).cast("long"))).drop("_only")


def _only(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    return rows.join(keep_broadcast(ids), rows["_id"] == ids["_only"], how)


def removed(keyed: DataFrame, bucket_bytes: int = 16 << 20) -> DataFrame:
    """id, mark and the list of packed window spans to remove of every document that loses bytes, from `_keyed` documents."""
    rows = keyed.where(F.octet_length("_text") >= LENGTH)
    buckets = max(64, -(-(rows.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0) // bucket_bytes))
    text = rows.select(F.col("_id").alias("id"), F.col("_mark").alias("mark"), F.col("_text").alias("text"))
    first = pinned(_round(text, buckets, single=False))
    tidy(keyed.sparkSession)
    again = first.where("kind = 2").groupBy("id", "mark").agg(F.collect_list("spans").alias("wanted"))
    again = pinned(again)
    ids = pinned(again.select(F.col("id").alias("_only")).distinct())
    text = _only(rows.select("_id", "_mark", "_text"), ids, "left_semi")
    text = text.join(again, (F.col("_id") == F.col("id")) & (F.col("_mark") == F.col("mark"))).select("id", "mark", F.col("_text").alias("text"), "wanted")
    second = _round(text, buckets, single=True)
    return pinned(first.where("kind = 1").union(second).groupBy("id", "mark").agg(F.collect_list("spans").alias("spans")))


def spans_of(packed, size) -> np.ndarray:
    """Maximal removed byte spans (start, end) from packed spans of windows."""
    spans = np.concatenate([np.frombuffer(s, "<u4").reshape(-1, 2) for s in packed]).astype(np.int64)
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, spans[:, 0], 1)
    np.add.at(change, spans[:, 1] + LENGTH, -1)
    gone = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
    return np.stack([np.flatnonzero(gone[1:] & ~gone[:-1]), np.flatnonzero(~gone[1:] & gone[:-1])], 1)


def _each(docs: DataFrame, carry: list[str], fn, schema: str) -> tuple[DataFrame, DataFrame]:
    """Documents that lose bytes, through `fn` (text bytes, spans); and the others, as they are."""
    rows = _keyed(docs)
    with small_batches(docs.sparkSession):
        found = removed(rows.select("_id", "_mark", "_text"))
    found = found.select(F.col("id").alias("_of"), F.col("mark").alias("_as"), F.col("spans").alias("_spans"))
    tidy(docs.sparkSession)
    ids = pinned(found.select(F.col("_of").alias("_only")).distinct())
    some = _only(rows, ids, "left_semi").join(found, (F.col("_id") == F.col("_of")) & (F.col("_mark") == F.col("_as")), "left")

    def run(batches):
        for b in batches:
            made = []
            for text, packed in zip(b.column("_text").cast(pa.binary()).to_pylist(), b.column("_spans").to_pylist()):
                made.append(fn(text, spans_of(packed, len(text)) if packed else np.zeros((0, 2), np.int64)))
            cols = list(zip(*made)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], *[pa.array(c, t) for c, t in zip(cols, types)]], [*carry, *names])

    parts = [p.split() for p in schema.split(", ")]
    names, types = [p[0] for p in parts], [{"long": pa.int64(), "string": pa.string()}[p[1]] for p in parts]
    kinds = [f"`{c}` {k}" for c, k in docs.select(*carry).dtypes]
    return some.select(*carry, "_text", "_spans").mapInArrow(run, ", ".join([*kinds, schema])), _only(rows, ids, "left_anti")


def _kept(text, spans):
    keep, at = [], 0
    for a, b in spans:
        keep.append(text[at:a])
        at = b
    return b"".join([*keep, text[at:]])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    def digest(text, spans):
        return len(text), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(_kept(text, spans)).hexdigest()

    some, others = _each(docs.select("doc_id", "text"), ["doc_id"], digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    zero = F.lit(0).cast("long")
    return some.union(others.select("doc_id", F.octet_length("_text").cast("long"), zero, zero, F.sha2(F.col("_text").cast("binary"), 256)))


def cleaned(docs: DataFrame) -> DataFrame:
    """`docs` with the repeated bytes taken out of `text`; a character cut in two goes as a whole."""
    carry = [c for c in docs.columns if c != "text"]
    some, others = _each(docs, carry, lambda text, spans: (_kept(text, spans).decode("utf-8", "ignore"),), "text string")
    return some.select(*docs.columns).union(others.select(*docs.columns))
