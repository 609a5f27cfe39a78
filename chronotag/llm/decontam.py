"""Operator 4, benchmark decontamination: a BM25 index of the test items, searched by every passage with block-max WAND.

Terms are runs of `TERM` words. The index side (the benchmark) is cut into blocks of a bounded number of items; postings, document
frequencies and lengths come from Spark, and one block at a time goes to the executors. Weights are scaled so that an item's score against
itself is 1. Every document is cut into overlapping passages; a passage whose terms' highest weights cannot reach the threshold is passed over
at once, the others are searched by block-max WAND. What is found is verified on the whole document: the shares of the item's five-word shingles,
of the question and of the answer. A document holds an item if it has `overlap` of all its shingles, or of those within its question: a copied question counts
without its answer when it has at least `ASKED` words, shorter ones are ordinary prose. Questions are segments of the index of their own, so that
BM25 finds them alone. An answer alone counts only where it is that share of all shingles. Documents are read where they lie: one scan for each block of items, no shuffle.

Nulls: null or empty texts match nothing, null items are left out; a null doc_id is reported as null. Items of three or four words are one
shingle; those of one or two words are not looked for, as ordinary prose holds them. Long texts are searched whole, long items in segments. Every item that
fits is reported, ties included. Repeated rows are reported each; repeated item_ids are items of their own. Empty tables give no rows. `clean` keeps all columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chronotag.llm import arrays as A
from chronotag.llm.common import pinned

TERM, SHINGLE = 3, 5
K1, B = 1.2, 0.75
SEGMENT = 64
#: Words a question needs to count without its answer.
ASKED = 8
POSTINGS_PER_BLOCK = 16
BREAKS = [c for c in range(128) if not chr(c).isalnum()]


def spelled(buf):
    """Everything but letters, digits and other scripts as a space."""
    return np.where(A.table(BREAKS)[buf], np.uint8(32), buf)


def hashed(buf, offsets):
    """Word hashes of texts and the text each word is in."""
    plain = spelled(buf)
    starts, ends, no = A.words(plain, offsets)
    return (A.spans(A.prefix_sums(plain), starts, ends) if len(starts) else np.zeros(0, np.uint64)), no


def short_grams(words, k):
    """Hashes of the runs of k words of one text; all its words together when there are fewer."""
    return A.grams(words, np.zeros(len(words), int), min(k, len(words)))[0] if len(words) else np.zeros(0, np.uint64)


def segments(n):
    """Where the segments of n words begin and end; a short rest belongs to the last one."""
    starts = range(0, max(1, n - SEGMENT // 4), SEGMENT)
    return [(at, at + SEGMENT if at + SEGMENT + SEGMENT // 4 < n else n) for at in starts]


@dataclass(frozen=True)
class Index:
    """Postings by term, ordered by segment: segment numbers and scaled weights; the highest weight of a term and of each block of postings."""
    terms: np.ndarray
    begin: np.ndarray
    segment: np.ndarray
    weight: np.ndarray
    highest: np.ndarray
    owner: np.ndarray
    item_ids: list
    shingles: list
    asks: list
    decides: list


def _postings(benchmark: DataFrame, question: str, answer: str | None) -> DataFrame:
    """A row per segment of an item and of its question: terms, and with an item's first one its shingles, how many of these lie in the question,
    and whether the question counts alone."""
    def run(batches):
        for b in batches:
            out = []
            for row, key, q, a in zip(b.column("row").to_pylist(), b.column("item").to_pylist(), pc.utf8_lower(b.column("q")).to_pylist(), pc.utf8_lower(b.column("a")).to_pylist()):
                q, a = (q or "").encode(), (a or "").encode()
                if not answer:  # the last sentence answers, what comes before asks
                    body = q.rstrip(b" .!?\n\t\r")
                    at = max(body.rfind(b". "), body.rfind(b".\n"), body.rfind(b"? "), body.rfind(b"! ")) + 1
                    q, a = q[:at], q[at:]
                buf = np.frombuffer(q + b" " + a, np.uint8)
                words, _ = hashed(buf, np.array([0, len(buf)]))
                n_q = len(hashed(np.frombuffer(q, np.uint8), np.array([0, len(q)]))[0])
                if len(words) < TERM:
                    continue
                shingles = short_grams(words, SHINGLE)
                within = n_q - SHINGLE + 1 if n_q >= SHINGLE else min(n_q, len(shingles))
                alone = ASKED <= n_q < len(words)
                parts = segments(len(words))
                parts += [x for x in segments(n_q) if x not in parts] if alone else []
                for i, (start, stop) in enumerate(parts):
                    terms, tf = np.unique(short_grams(words[start:stop], TERM), return_counts=True)
                    out.append((row, key, i, terms.view(np.int64), tf, shingles.view(np.int64) if i == 0 else [], within, alone))
            cols = list(zip(*out)) or [[]] * 8
            kinds = [pa.int64(), b.schema.field("item").type, pa.int32(), *[pa.list_(pa.int64())] * 3, pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["row", "item", "part", "terms", "tf", "shingles", "n_question", "alone"])

    rows = benchmark.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").alias("item"), F.col(question).alias("q"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("a"))
    kind = dict(rows.dtypes)["item"]
    return pinned(rows.mapInArrow(run, f"row long, item {kind}, part int, terms array<long>, tf array<long>, shingles array<long>, n_question long, alone boolean"))


def indexes(benchmark: DataFrame, question: str = "text", answer: str | None = None, block_items: int = 20_000, block_terms: int = 2_000_000):
    """The index in blocks of about `block_items` items or `block_terms` terms, one after the other; BM25 statistics are those of all items."""
    rows = _postings(benchmark, question, answer)
    whole = rows.agg(F.count("*").alias("n"), F.avg(F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x)).alias("length")).first()
    if not whole.n:
        return
    frequency = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    blocks = max(-(-whole.n // block_items), int(whole.n * whole.length / block_terms) + 1)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), blocks))
    for block in range(blocks):
        own = rows.where(F.col("block") == block)
        df = {r.term: r.df for r in own.select(F.explode("terms").alias("term")).distinct().join(frequency, "term").collect()}
        parts = sorted(own.collect(), key=lambda r: (str(r.item), r.row, r.part))
        if not parts:
            continue
        term, segment, weight, item_ids, shingles, asks, decides, owner = [], [], [], [], [], [], [], []
        for s, r in enumerate(parts):
            if r.part == 0:
                item_ids.append(r.item)
                shingles.append(np.unique(np.array(r.shingles, np.int64).view(np.uint64)))
                in_order = np.array(r.shingles, np.int64).view(np.uint64)
                asks.append(np.isin(shingles[-1], in_order[:r.n_question]))
                decides.append(r.alone)
            owner.append(len(item_ids) - 1)
            tf, length = np.array(r.tf, float), sum(r.tf)
            idf = np.log1p((whole.n - np.array([df[t] for t in r.terms]) + 0.5) / (np.array([df[t] for t in r.terms]) + 0.5))
            w = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / whole.length))
            term.append(np.array(r.terms, np.int64).view(np.uint64))
            segment.append(np.full(len(w), s))
            weight.append(w / w.sum())
        term, segment, weight = map(np.concatenate, (term, segment, weight))
        order = np.lexsort((segment, term))
        term, segment, weight = term[order], segment[order], weight[order]
        terms, begin = np.unique(term, return_index=True)
        yield Index(terms, np.append(begin, len(term)), segment, weight, np.maximum.reduceat(weight, begin), np.array(owner), item_ids, shingles, asks, decides)


def block_max_wand(index: Index, terms, threshold: float) -> list[tuple[int, float]]:
    """All (segment, score) with a score of at least `threshold` for these term numbers."""
    lists = [[index.begin[t], index.begin[t + 1], index.highest[t], index.begin[t]] for t in terms]  # at, end, highest weight, begin
    found, segment, weight = [], index.segment, index.weight
    slack = threshold - 1e-9

    def block(x):
        """End of the block of postings that x stands in, and its highest weight."""
        stop = min(x[1], x[3] + ((x[0] - x[3]) // POSTINGS_PER_BLOCK + 1) * POSTINGS_PER_BLOCK)
        return stop, weight[stop - POSTINGS_PER_BLOCK if stop - x[3] > POSTINGS_PER_BLOCK else x[3]:stop].max()

    def forward(x, to):
        x[0] += np.searchsorted(segment[x[0]:x[1]], to)

    while True:
        lists = sorted((x for x in lists if x[0] < x[1]), key=lambda x: segment[x[0]])
        bound, pivot = 0.0, None
        for i, x in enumerate(lists):
            bound += x[2]
            if bound >= slack:
                pivot = segment[x[0]]
                last = i
                break
        if pivot is None:
            return found
        while last + 1 < len(lists) and segment[lists[last + 1][0]] == pivot:
            last += 1
        for x in lists[:last + 1]:
            if segment[x[0]] < pivot:
                forward(x, pivot)
        here = [x for x in lists[:last + 1] if x[0] < x[1]]
        blocks = [block(x) for x in here]
        if sum(b[1] for b in blocks) < slack:
            # no segment before the first end of these blocks can reach the threshold
            beyond = [segment[lists[last + 1][0]]] if last + 1 < len(lists) else []
            to = min([segment[stop - 1] + 1 for stop, _ in blocks] + beyond, default=pivot + 1)
            for x in here:
                forward(x, max(to, pivot + 1))
            continue
        there = [x for x in here if segment[x[0]] == pivot]
        score = sum(weight[x[0]] for x in there)
        if score >= slack:
            found.append((int(pivot), float(score)))
        for x in there:
            x[0] += 1


def search(index: Index, buf, offsets, threshold: float, overlap: float):
    """(text, item, score, question share, answer share) of what is found in these texts and verified."""
    words, no = hashed(buf, offsets)
    grams, at = A.grams(words, no, TERM)
    light = np.zeros(1 << 20, bool)
    light[(index.terms >> np.uint64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(light[(grams >> np.uint64(44)).astype(np.int64)])
    place = np.minimum(np.searchsorted(index.terms, grams[maybe]), len(index.terms) - 1)
    hit = index.terms[place] == grams[maybe]
    where, term = at[maybe][hit], place[hit]
    if not len(where):
        return []
    # passages of 2 * SEGMENT words that overlap by half, numbered from the start of their text
    first = np.searchsorted(no, no[where])
    half = (where - first) // SEGMENT
    key = np.concatenate([no[where] * (1 << 32) + half, (no[where] * (1 << 32) + half - 1)[half > 0]])
    both, owner = np.concatenate([term, term[half > 0]]), key
    passages, inverse = np.unique(owner, return_inverse=True)
    reach = np.bincount(inverse, weights=index.highest[both])
    best: dict = {}
    order = np.argsort(inverse, kind="stable")
    cuts = np.searchsorted(inverse[order], np.arange(len(passages) + 1))
    for p in np.flatnonzero(reach >= threshold - 1e-9):
        for s, score in block_max_wand(index, np.unique(both[order[cuts[p]:cuts[p + 1]]]), threshold):
            pair = (int(passages[p] >> 32), int(index.owner[s]))
            best[pair] = max(score, best.get(pair, 0.0))
    out, own = [], {}
    for (text, item), score in sorted(best.items()):
        shingles, asks = index.shingles[item], index.asks[item]
        size = SHINGLE if len(shingles) > 1 else None
        if text not in own:
            own[text] = words[no == text]
        have = own[text]
        lengths = {SHINGLE} if size else set(range(1, SHINGLE + 1))
        there = np.isin(shingles, np.concatenate([A.grams(have, np.zeros(len(have), int), k)[0] for k in lengths]))
        question = float(there[asks].mean()) if asks.any() else 1.0
        if there.mean() >= overlap or index.decides[item] and question >= overlap:
            out.append((text, item, score, question, float(there[~asks].mean()) if (~asks).any() else 1.0))
    return out


def _found(index, column, threshold, overlap):
    for row, buf, offsets in A.pieces(pc.utf8_lower(column)):
        for text, *rest in search(index, buf, offsets, threshold, overlap):
            yield row + text, *rest


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8, **kw) -> DataFrame:
    """doc_id, item_id, score, question_overlap and answer_overlap of every document that contains an item."""
    key, item = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {key}, item_id {item}, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(benchmark, **kw):
        def run(batches, index=index, ids=to_arrow_type(benchmark.schema["item_id"].dataType)):
            for b in batches:
                rows = list(_found(index, b.column("text"), threshold, overlap))
                cols = [b.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([index.item_ids[r[1]] for r in rows], ids),
                        *[pa.array([r[i] for r in rows], pa.float64()) for i in (2, 3, 4)]]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])
        out = out.union(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8, **kw) -> DataFrame:
    """`docs` without the documents that contain an item, in place: no shuffle, all columns kept."""
    for index in indexes(benchmark, **kw):
        def run(batches, index=index):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[r[0] for r in _found(index, b.column("text"), threshold, overlap)]] = False
                yield b.filter(pa.array(keep))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
