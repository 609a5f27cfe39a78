"""Operator 8, language identification by string kernels.

The kernel of two texts is the number of byte n-grams (1 to 3, over an alphabet of 32 symbols) that occur in both, divided by
the root of the product of how many occur in each: a blended-spectrum presence kernel. A bounded sample of each
language gives Nyström landmarks and training rows; one-versus-rest kernel ridge regression is solved from normal
equations summed by partition. A text's score is its presence vector times (landmarks x weights), one matrix product a
batch; the texts are scored where they lie, without a shuffle.

Nulls: a text that is null or has no letter is `und` with score 0; rows with a null doc_id or lang are scored, not learned from.
Without any row to learn from, everything is `und`. Repeated rows and other columns change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotag.llm import arrays as A
from chronotag.llm.common import held_out, keep_broadcast, pinned

UNKNOWN = "und"
SYMBOLS = 32
SIZE = SYMBOLS + SYMBOLS ** 2 + SYMBOLS ** 3


def alphabet():
    """a-z (A-Z the same) are 1 to 26, bytes of other scripts share 27 to 31, everything else is 0."""
    out = np.zeros(256, np.uint8)
    out[97:123] = out[65:91] = np.arange(1, 27)
    out[128:] = 27 + np.arange(128) % 5
    return out


def presence(buf, offsets):
    """Which n-grams occur in each text: booleans, one row per text; n-grams never span two texts."""
    n = len(offsets) - 1
    out = np.zeros((n, SIZE), bool)
    flat, lengths = out.reshape(-1), np.diff(offsets)
    c = alphabet()[buf].astype(np.int64)
    base = np.repeat(np.arange(n) * SIZE, lengths)
    left = np.repeat(offsets[1:], lengths) - np.arange(len(buf))
    flat[base + c] = True
    start, code = SYMBOLS, c
    for k in (2, 3):
        if len(code) < 2:
            break
        code = code[:-1] * SYMBOLS + c[k - 1:]
        fits = left[:len(code)] >= k
        flat[(base[:len(code)] + start + code)[fits]] = True
        start += SYMBOLS ** k
    return out


def unit(column, rows=48):
    """Presence vectors of length one, in blocks of a few texts."""
    for _, buf, offsets in A.pieces(column):
        for i in range(0, len(offsets) - 1, rows):
            cut = offsets[i:i + rows + 1]
            x = presence(buf[cut[0]:cut[-1]], cut - cut[0]).astype(np.float32)
            yield x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray | None


def _sample(docs: DataFrame, per_language: int) -> DataFrame:
    """At most `per_language` texts of each language, chosen by a hash of their ids."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    some = known.select("doc_id", "lang").join(keep_broadcast(pinned(sizes)), "lang").where(spread * F.col("n") < 3 * per_language)  # thins large languages before the window
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    some = some.dropDuplicates(["doc_id", "lang"]).withColumn("place", F.row_number().over(first)).where(F.col("place") <= per_language)
    some = some.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "place")
    same = (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))
    return docs.select("doc_id", "lang", "text").join(F.broadcast(some), same).select("lang", "text", "place").where(F.col("text").isNotNull())


def fit(docs: DataFrame, per_language: int = 800, landmarks: int = 64, ridge: float = 1.0) -> Model:
    """Learn from at most `per_language` documents of each language, of which `landmarks` are landmarks."""
    sample = pinned(_sample(docs, per_language).coalesce(8))
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    if not languages:
        return Model([], None)

    def pack(batches):
        for b in batches:
            for x in unit(b.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array([np.packbits(r > 0).tobytes() for r in x])], ["bits"])

    marks = sample.where(F.col("place") <= landmarks).select("text").mapInArrow(pack, "bits binary").collect()  # landmarks x languages vectors of 4 kB
    marks = np.unpackbits(np.stack([np.frombuffer(r.bits, np.uint8) for r in sorted(marks)]), axis=1)[:, :SIZE].astype(np.float32)
    marks /= np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))
    m, place = len(marks), {x: i for i, x in enumerate(languages)}
    packed = np.packbits(marks > 0, axis=1)

    def add(batches):
        at = np.unpackbits(packed, axis=1)[:, :SIZE].astype(np.float32)
        at /= np.sqrt(np.maximum(at.sum(1, keepdims=True), 1))
        total = np.zeros((m, m + len(place)))
        for b in batches:
            y = np.array([place[x] for x in b.column("lang").to_pylist()], int)
            k = np.concatenate([x @ at.T for x in unit(b.column("text"))] or [np.zeros((0, m))]).astype(float)
            total += k.T @ np.hstack([k, 2.0 * (y[:, None] == np.arange(len(place))) - 1])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["part"])

    parts = sample.select("lang", "text").mapInArrow(add, "part binary").collect()
    total = sum(np.frombuffer(r.part).reshape(m, -1) for r in parts)
    kernel = (marks @ marks.T).astype(float)
    alpha = np.linalg.solve(total[:, :m] + ridge * kernel + 1e-6 * np.eye(m), total[:, m:])
    return Model(languages, (marks.T @ alpha).astype(np.float32))


def predict(docs: DataFrame, model: Model, carry: list[str] | None = None, sharpness: float = 4.0) -> DataFrame:
    """doc_id, held_out (and `carry`), lang_pred and score of every document."""
    carry = [c for c in carry or [] if c not in ("doc_id", "held_out", "lang_pred", "score")]
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *carry,
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"), F.col("text").alias("_text"))
    names = ["doc_id", "held_out", *carry]
    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.select(*names).dtypes)

    def run(batches):
        for b in batches:
            letters = b.column("_letters").to_numpy(zero_copy_only=False)
            if model.weights is None:
                best, top = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows)
            else:
                s = np.concatenate([x @ model.weights for x in unit(b.column("_text"))] or [np.zeros((0, len(model.languages)))]).astype(float)
                e = np.exp(sharpness * (s - s.max(1, keepdims=True, initial=-9)))
                best = np.where(letters, np.array(model.languages, object)[s.argmax(1)], UNKNOWN)
                top = np.where(letters, e.max(1, initial=0) / np.maximum(e.sum(1), 1e-9), 0.0)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(best, pa.string()), pa.array(top, pa.float64())], [*names, "lang_pred", "score"])

    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")



def keep(docs: DataFrame, model: Model, languages: list[str] | None = None, label: str | None = None) -> DataFrame:
    """`docs` with a predicted language among `languages` (any learned one if not given), in place: all columns, no shuffle.

    With `label`, a column, documents that read as another language than it says go as well; a null says nothing.
    """
    wanted = np.array([not languages or x in languages for x in model.languages], bool)

    def run(batches):
        for b in batches:
            if model.weights is not None and b.num_rows:
                best = np.concatenate([(x @ model.weights).argmax(1) for x in unit(b.column("text"))])
                kept = wanted[best]
                if label:
                    kept &= np.array([x is None or x == model.languages[i] for x, i in zip(b.column(label).to_pylist(), best)], bool)
                yield b.filter(pa.array(kept))

    return docs.where(F.col("text").rlike(r"\p{L}")).mapInArrow(run, docs.schema)
