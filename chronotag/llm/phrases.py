"""Operator 13, phrase collocations by a weighted de Bruijn graph over words.

Nodes are pairs of neighbouring words, edges are runs of three words (the longest gram) between two overlapping nodes, weighted by how often
they occur; languages are graphs of their own. Every place of a text gives one row, the longest gram that starts there: an edge, or, where the
piece ends, the pair or the single word that is left. Those shorter rows are the piece-end corrections: how often a pair occurs is the flow out
of its node (its edges) plus its corrections, how often a word occurs is the flow of the pairs it starts plus its corrections. So one count of
longest grams gives all counts.

Edges below `least` matter for flows only. To keep them out of the shuffle, pairs are first counted in hashed buckets (`_buckets`): a place whose
pair lies in a bucket below `least` is treated like the end of a piece. Counts do not change by it: a pair that is dropped there cannot reach `least`, nor can an
edge through it. The buckets become a bit map of at most 2**28 bits (32 MB), the only thing that is broadcast; if
a corpus fills all buckets, all edges are counted, with the same result.

Edges of `least` and more form the heavy graph. Its unary paths (nodes with one edge in and one out) are compacted by pointer doubling into
`paths`: passages with a weight per edge, in stretches of at most 1,000 edges. Candidates of three words are read from the paths, those of two from the node flows.

A null text is empty, a null language is `und`; the key of a document is not used, so null, equal and repeated ones count like any other row. Texts
without words give nothing, an empty table gives no rows. Very long texts are read whole. Ties: equal cuts go to the shorter first part, equal ranks to the phrase that comes first by UTF-8 bytes. Other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotag.llm import arrays as A
from chronotag.llm.common import small_batches, written

LONGEST = 3
#: Edges in a row of `paths`, rows a task collects before it counts them, salts of hot words.
STRETCH, GATHER, SALTS = 1000, 1 << 18, 16
_READ = np.arange(256, dtype=np.uint8)
_READ[65:91] += 32
_READ[list(b".,;:!?\x0b\x0c\r")] = 10
_READ[9] = 32


class Batch:
    """The words of some texts: `joined` has them lower-cased with one blank after each, `first` and `last` say where each lies in it."""

    def __init__(self, buf, offsets, lang, seeds):
        buf = _READ[buf]
        starts, ends, no = A.words(buf, offsets)
        sizes = ends - starts
        self.first = np.cumsum(sizes + 1) - (sizes + 1)
        self.last = self.first + sizes
        at = np.arange(int((sizes + 1).sum())) + np.repeat(starts - self.first, sizes + 1)
        self.joined = buf[np.minimum(at, len(buf) - 1)] if len(at) else buf[:0]
        self.joined[self.last] = 32
        broken = np.concatenate([[0], np.cumsum(buf == 10)])[starts]
        self.together = np.zeros(len(starts), bool)  # a word and the next one lie in the same piece
        self.together[:-1] = (no[1:] == no[:-1]) & (broken[1:] == broken[:-1])
        self.lang = lang[no]
        hashes = A.spans(A.prefix_sums(self.joined), self.first, self.last)
        pairs = np.zeros(len(starts), np.uint64)
        pairs[:-1] = A.mix(hashes[:-1] * np.uint64(0x9FB21C651E98DF25) + hashes[1:])
        self.pairs = A.mix(pairs + seeds[self.lang])

    def grams(self, lengths):
        """The run of `lengths` words that starts at each word, as Arrow strings."""
        stop = self.last[np.arange(len(lengths)) + lengths - 1]
        sizes = stop - self.first
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(offsets[-1]) + np.repeat(self.first - offsets[:-1], sizes)
        return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.joined[at])))


def _read(batches):
    """(Batch, names) of some texts at a time; `Batch.lang` numbers the languages in `names`."""
    for b in batches:
        column = b.column("lang").dictionary_encode()
        names, lang = column.dictionary.to_pylist(), column.indices.to_numpy()
        seeds = np.array([zlib.crc32(x.encode()) for x in names], np.uint64) * np.uint64(0xA0761D6478BD642F)  # for buckets only: they may be shared
        for row, buf, offsets in A.pieces(b.column("text")):
            batch = Batch(buf, offsets, lang[row:row + len(offsets) - 1], seeds)
            if len(batch.first):
                yield batch, names


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def _buckets(docs: DataFrame, least: int, bits: int) -> np.ndarray:
    """A bit for each bucket of pairs that occurs `least` times or more, as bytes (bit 0 first)."""
    def run(batches):
        have, n = [], 0

        def counted():
            bucket, times = np.unique(np.concatenate(have), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(times.astype(np.int64))], ["bucket", "n"])

        for batch, _ in _read(batches):
            have.append((batch.pairs[batch.together] >> np.uint64(64 - bits)).astype(np.uint32))
            n += len(have[-1])
            if n >= GATHER:
                yield counted()
                have, n = [], 0
        if n:
            yield counted()

    often = docs.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    parts = often.groupBy(F.shiftright("bucket", 15).alias("part")).agg(F.expr("bitmap_construct_agg(bucket & 32767)").alias("bits")).collect()  # 4 KB for 32,768 buckets
    out = np.zeros((1 << max(0, bits - 15)) * 4096, np.uint8)
    for r in parts:
        out[r.part * 4096:(r.part + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def edges(docs: DataFrame, least: int, bits: int | None = None) -> DataFrame:
    """lang, k, gram, n: the longest grams of all places (k = 3: edges of the graph; k = 2, 1: what corrects the flows) and how often they occur."""
    docs, spark = _texts(docs), docs.sparkSession
    if bits is None:  # about a bucket for 16 bytes of text
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(28, max(16, int(size // 16).bit_length()))
    with small_batches(spark, 2000):
        shared = spark.sparkContext.broadcast(_buckets(docs, least, bits))

        def run(batches):
            often, rows, n = shared.value, [], 0

            def counted():
                t = pa.concat_tables(rows).group_by(["lang", "k", "gram"]).aggregate([("one", "sum")])
                yield from t.select(["lang", "k", "gram", "one_sum"]).rename_columns(["lang", "k", "gram", "n"]).to_batches(max_chunksize=50_000)

            for batch, names in _read(batches):
                bucket = (batch.pairs >> np.uint64(64 - bits)).astype(np.int64)
                go = batch.together & ((often[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1).astype(bool)
                more = np.zeros(len(go), bool)
                more[:-1] = go[:-1] & go[1:]
                k = 1 + go + more
                lang = pa.array(names, pa.large_string()).take(pa.array(batch.lang))
                rows.append(pa.table([lang, pa.array(k.astype(np.int32)), batch.grams(k), pa.array(np.ones(len(k), np.int64))], ["lang", "k", "gram", "one"]))
                n += len(k)
                if n >= GATHER:
                    yield from counted()
                    rows, n = [], 0
            if n:
                yield from counted()

        rows = docs.mapInArrow(run, "lang string, k int, gram string, n long")
        return written(rows.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")))


def flows(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, words): lang, gram, n. Pairs are right from the `least` of `edges` on, words always."""
    node = F.substring_index("gram", " ", 2).alias("gram")
    pairs = written(found.where("k >= 2").select("lang", node, "n").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    word = F.substring_index("gram", " ", 1).alias("gram")
    words = pairs.select("lang", word, "n").unionByName(found.where("k = 1").select("lang", "gram", "n"))
    return pairs, written(words.groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def _starts(heavy: DataFrame) -> DataFrame:
    """id, root, hops for all edges that continue a unary path: the edge the path starts with and how many edges back it is.

    Every round doubles how far an edge sees back. When a round finishes no edge, those left lie on rings without a start; they stay apart.
    """
    ends = heavy.select("lang", F.col("head").alias("node"), F.lit(None).cast("long").alias("into"), F.col("id").alias("out")).union(
        heavy.select("lang", F.col("tail").alias("node"), F.col("id").alias("into"), F.lit(None).cast("long").alias("out")))
    nodes = ends.groupBy("lang", "node").agg(F.count("into").alias("n_in"), F.count("out").alias("n_out"), F.min("into").alias("into"), F.min("out").alias("out"))
    back = written(nodes.where("n_in = 1 and n_out = 1 and into <> out").select(F.col("out").alias("id"), F.col("into").alias("root"), F.lit(1).cast("long").alias("hops")))
    left = None
    while True:
        far = back.select(F.col("id").alias("at"), F.col("root").alias("root2"), F.col("hops").alias("hops2"))
        after = written(back.join(far, F.col("root") == F.col("at"), "left").select(
            "id", F.coalesce("root2", "root").alias("root"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"), F.col("at").isNotNull().alias("going")))
        now = after.where("going").count()
        if now in (0, left):
            return after.where("not going").drop("going")
        back, left = after.drop("going"), now


def paths(found: DataFrame, least: int) -> DataFrame:
    """lang, path, part, words, weights: the unary paths of the edges with `least` occurrences or more.

    `words` has two words more than `weights` has edges; edge i covers words i to i + 2. A path of more than 1,000 edges takes several rows, numbered by `part`.
    """
    heavy = written(found.where((F.col("k") == LONGEST) & (F.col("n") >= least)).select(
        F.monotonically_increasing_id().alias("id"), "lang", F.substring_index("gram", " ", 2).alias("head"), F.substring_index("gram", " ", -2).alias("tail"), "gram", "n"))
    starts = _starts(heavy).select(F.col("id").alias("at"), "root", "hops")
    rows = heavy.join(starts, F.col("id") == F.col("at"), "left").select(
        "lang", F.coalesce("root", "id").alias("path"), F.coalesce("hops", F.lit(0)).alias("hops"), "gram", "n")
    rows = rows.groupBy("lang", "path", F.floor(F.col("hops") / STRETCH).alias("part")).agg(F.sort_array(F.collect_list(F.struct("hops", "gram", "n"))).alias("run"))  # at most STRETCH
    ahead = F.transform(F.slice("run", 2, STRETCH), lambda e: F.substring_index(e["gram"], " ", -1))
    return rows.select("lang", "path", "part", F.concat(F.split(F.col("run")[0]["gram"], " "), ahead).alias("words"), F.col("run.n").alias("weights"))


def phrases(docs: DataFrame, least: int = 10, within: int = 50, best: int = 2000, bits: int | None = None) -> DataFrame:
    """The `best` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of two or three words that occurs a >= `least` times is scored by its weakest cut, floor(10**6 a a / (l r)) with the counts l and r of
    the two sides. It goes if a longer candidate holds it and occurs at least `within` percent as often.
    """
    found = edges(docs, least, bits)
    pairs, words = flows(found)
    at = F.posexplode("weights").alias("i", "a")
    three = paths(found, least).select("lang", "words", at).select("lang", F.array_join(F.slice("words", F.col("i") + 1, F.lit(LONGEST)), " ").alias("phrase"), "a")
    three = written(three)
    inner = three.select("lang", F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"), "a")
    longest = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    two = pairs.where(F.col("n") >= least).select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"))
    two = two.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < within * F.col("a"))).drop("longer")

    # both sides of each cut meet the counts; a word that starts or ends very many phrases is spread over salts
    salt = F.pmod(F.xxhash64("phrase"), SALTS).cast("int")

    def cut(k, left, right):
        return F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right"))

    def cuts(rows, *each):
        sides = rows.select("lang", "phrase", "a", F.explode(F.array(*each)).alias("cut"))
        side = F.explode(F.array(F.struct(F.col("cut.left").alias("gram"), F.lit(True).alias("is_left")), F.struct(F.col("cut.right").alias("gram"), F.lit(False).alias("is_left"))))
        return sides.select("lang", "phrase", "a", F.col("cut.k").alias("k"), side.alias("side")).select("lang", "phrase", "a", "k", "side.*", salt.alias("salt"))

    one, last = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)
    sides = cuts(two, cut(1, one, last)).union(cuts(three, cut(1, one, F.substring_index("phrase", " ", -2)), cut(2, F.substring_index("phrase", " ", 2), last)))
    counts = pairs.union(words).where(F.col("n") >= least).withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    sides = sides.join(counts, ["lang", "gram", "salt"]).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("is_left"), F.col("n"))).alias("l"), F.max(F.when(~F.col("is_left"), F.col("n"))).alias("r"))
    wide = [F.col(c).cast("decimal(19,0)") for c in "alr"]  # exact up to 38 digits
    scored = sides.withColumns({"_top": wide[0] * wide[0] * F.lit(1_000_000), "_low": wide[1] * wide[2]}).withColumn("score", F.expr("_top div _low"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), 64)).orderBy(*order))).where(F.col("rank") <= best)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)  # at most 64 x best rows a language
    total = F.broadcast(words.groupBy("lang").agg(F.sum("n").alias("n")))  # a row per language
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM words, range(1, 4) AS t(k)),
counts AS (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, g, f AS a FROM counts WHERE k > 1 AND f >= 10),
inside AS (
  SELECT lang, unnest([array_to_string(string_split(g, ' ')[1:2], ' '), array_to_string(string_split(g, ' ')[2:3], ' ')]) AS g, a FROM candidates WHERE k = 3),
longer AS (SELECT lang, g, max(a) AS a FROM inside GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN longer o ON c.k = 2 AND c.lang = o.lang AND c.g = o.g WHERE o.a IS NULL OR 100 * o.a < 50 * c.a),
cuts AS (
  SELECT lang, k, g, a, c, array_to_string(string_split(g, ' ')[1:c], ' ') AS lg, array_to_string(string_split(g, ' ')[c + 1:k], ' ') AS rg
  FROM kept, range(1, 3) AS t(c) WHERE c < k),
scored AS (
  SELECT x.lang, x.g, x.a, x.c, p.f AS l, q.f AS r, (1000000::HUGEINT * x.a * x.a // (p.f::HUGEINT * q.f))::BIGINT AS score
  FROM cuts x JOIN counts p ON p.lang = x.lang AND p.g = x.lg AND p.k = x.c JOIN counts q ON q.lang = x.lang AND q.g = x.rg AND q.k = x.k - x.c),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank FROM weakest)
SELECT r.lang, rank, g AS phrase, a, l, r.r AS r, n, score FROM ranked r JOIN totals t ON r.lang = t.lang WHERE rank <= 2000"""
