"""Operator 1, quality classifier: random Fourier features, partition-summed normal equations, isotonic calibration.

The Gaussian kernel over standardised document statistics is approximated by `features` random cosines. Every partition
of the labelled rows adds up its share of the normal equations, by fold; their sum gives the ridge weights, and the sum
without a fold gives scores for the rows of that fold that never saw their own label. Those scores are calibrated by
isotonic regression (pyspark.ml). Documents are scored where they lie: one scan, no shuffle.

Nulls: a null or empty text has all statistics 0 and gets the score of that point; a null doc_id is held out and scored;
labels without doc_id or quality are ignored, several labels of one document are averaged. Without any label, or with one class
only, every score is that class's share (0.5 without labels). Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotag.llm import stats
from chronotag.llm.common import bounded_ids, held_out, pinned

FOLDS, PARTS = 3, 8
CLIP = 4.0


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    calibrated: np.ndarray
    constant: float | None = None


def _cosines(x, mean, scale, frequencies, phases):
    z = np.clip((x - mean) / scale, -CLIP, CLIP) @ frequencies + phases
    return np.hstack([np.cos(z) * np.sqrt(2 / len(phases)), np.ones((len(x), 1))])


def _sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """Statistics, label and fold of at most `most` labelled documents that are not held out."""
    y = (labels.select("doc_id", F.col(label).cast("double").alias("y")).dropna().where(~held_out(F.col("doc_id")))
         .groupBy("doc_id").agg(F.avg("y").alias("y")))
    y = bounded_ids(y, "doc_id", most)

    def read(batches):
        for b in batches:
            _, ratios = stats.batches(b.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(list(ratios), pa.list_(pa.float64())), b.column("y"), b.column("fold")], ["x", "y", "fold"])

    fold = F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string")).cast("binary")) % FOLDS
    rows = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").select("text", "y", fold.cast("int").alias("fold"))
    return pinned(rows.mapInArrow(read, "x array<double>, y double, fold int").coalesce(PARTS))


def _sums(sample: DataFrame, place) -> np.ndarray:
    """Normal equations of each fold, summed by partition first: (fold, feature, feature + label)."""
    def add(batches):
        total = None
        for b in batches:
            x, y, fold = np.array(b.column("x").to_pylist()), b.column("y").to_numpy(), b.column("fold").to_numpy()
            if len(x):
                z = _cosines(x, *place)
                zy = np.hstack([z, y[:, None]])
                part = np.stack([z[fold == k].T @ zy[fold == k] for k in range(FOLDS)])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["part"])

    size = len(place[3]) + 1
    found = sample.mapInArrow(add, "part binary").collect()  # one matrix from each of at most PARTS partitions
    return sum(np.frombuffer(r.part).reshape(FOLDS, size, size + 1) for r in found)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", features: int = 256, gamma: float = 0.02, ridge: float = 0.05,
        most: int = 20_000, seed: int = 11) -> Model:
    """Learn from at most `most` labelled documents (the documented bound of the sample)."""
    sample = _sample(docs, labels, label, most)
    d = len(stats.RATIOS)
    moments = sample.select(F.count("*").alias("n"), F.avg("y").alias("y"), F.min("y").alias("lo"), F.max("y").alias("hi"),
                            *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)]).first()
    none = np.zeros(0)
    if not moments.n or moments.lo == moments.hi:
        return Model(none, none, none, none, none, none, none, constant=0.5 if not moments.n else float(moments.y))
    mean, scale = np.array([moments[f"m{i}"] for i in range(d)]), np.array([moments[f"s{i}"] or 1.0 for i in range(d)])
    rng = np.random.default_rng(seed)
    place = (mean, scale, rng.normal(0, np.sqrt(2 * gamma), (d, features)), rng.uniform(0, 2 * np.pi, features))
    sums = _sums(sample, place)

    def solve(s):
        penalty = np.full(len(s), ridge)
        penalty[-1] = 1e-9
        return np.linalg.solve(s[:, :-1] + np.diag(penalty), s[:, -1])

    weights, without = solve(sums.sum(0)), np.stack([solve(sums.sum(0) - sums[k]) for k in range(FOLDS)])

    def unseen(batches):
        for b in batches:
            x, fold = np.array(b.column("x").to_pylist()).reshape(-1, d), b.column("fold").to_numpy()
            raw = (_cosines(x, *place) * without[fold]).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(raw), b.column("y")], ["raw", "y"])

    curve = IsotonicRegression(featuresCol="raw", labelCol="y").fit(sample.mapInArrow(unseen, "raw double, y double"))
    return Model(*place, weights, np.array(curve.boundaries.toArray()), np.array(curve.predictions.toArray()))


def score(docs: DataFrame, model: Model, good: float = 0.7) -> DataFrame:
    """doc_id, held_out, score in [0, 1] and predicted (score >= good) of every document."""
    def run(batches):
        for b in batches:
            if model.constant is not None:
                s = np.full(b.num_rows, model.constant)
            else:
                raw = _cosines(stats.batches(b.column("text"))[1], *(model.mean, model.scale, model.frequencies, model.phases)) @ model.weights
                # the calibrated value, and within a flat step a little of the uncalibrated one, so that order is kept
                s = 0.98 * np.interp(raw, model.raw, model.calibrated) + 0.02 * np.clip(raw, 0, 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(np.clip(s, 0, 1), pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    return (rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= good).cast("int")))
