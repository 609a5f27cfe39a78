"""Operator 3, quality rules: a decision list learned by sequential covering.

Statistics of the labelled documents are cut into quantile bins once. To grow a rule, one Spark aggregate counts good and
bad rows per (statistic, bin) among the rows the rule still covers; the threshold with the best information gain is added.
A rule is pruned on rows it was not grown on, and what it covers is taken away before the next one. The driver sees bin
counts only, so all labelled rows are used. The list is emitted as one ordered `CASE WHEN` over columns.

Nulls: a null or empty text has all statistics 0 and fails the base rule; rows with a null doc_id are judged, not learned from;
labels without doc_id or label are ignored, several of one document averaged (bad below 0.5). Without labels of both
kinds the list is empty and every document that passes the base rule is kept. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotag.llm import stats
from chronotag.llm.common import held_out, keep_broadcast, pinned

BINS = 48


@dataclass(frozen=True)
class Test:
    """`name` > bound, or <= bound."""
    name: str
    above: bool
    bound: float

    def column(self) -> Column:
        return F.col(self.name) > self.bound if self.above else F.col(self.name) <= self.bound


def covers(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t.column()
    return out


def with_statistics(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns `carry`, the counts and the ratios of every text; one pass, no shuffle."""
    names = [*carry, *stats.COUNTS, *stats.RATIOS]
    kinds = [f"`{c}` {k}" for c, k in docs.select(*carry).dtypes] + [f"{c} long" for c in stats.COUNTS] + [f"{c} double" for c in stats.RATIOS]

    def run(batches):
        for b in batches:
            counts, ratios = stats.batches(b.column("text"))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], *map(pa.array, counts.T), *map(pa.array, ratios.T)], names)

    return docs.select(*carry, "text").mapInArrow(run, ", ".join(kinds))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _gain(p0, n0, p1, n1):
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def _bin(name: str, edges: list[float]) -> Column:
    """How many of the ascending `edges` the value is above."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: F.col(name) > e))


def _grow(rows: DataFrame, edges: dict, most_tests: int) -> list[Test]:
    """Add the threshold of the highest gain until no good row is covered or nothing gains."""
    tests: list[Test] = []
    while len(tests) < most_tests:
        counts = (rows.where(covers(tests)).select("bad", F.posexplode("bins").alias("f", "bin"))
                  .groupBy("f", "bin").agg(F.sum(F.col("bad").cast("long")).alias("p"), F.count("*").alias("n")).collect())
        if not counts:
            break
        by: dict = {}
        for r in counts:
            by.setdefault(r.f, {})[r.bin] = (r.p, r.n - r.p)
        p0, n0 = (sum(x[i] for x in by[0].values()) for i in (0, 1))
        best, found = 1e-9, None
        for f, name in enumerate(stats.RATIOS):
            low_p = low_n = 0
            for b, bound in enumerate(edges[name]):
                p, n = by.get(f, {}).get(b, (0, 0))
                low_p, low_n = low_p + p, low_n + n
                for above, p1, n1 in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                    if (g := _gain(p0, n0, p1, n1)) > best:
                        best, found = g, (Test(name, above, bound), n1)
        if found is None:
            break
        tests.append(found[0])
        if found[1] == 0:
            break
    return tests


def _prune(rows: DataFrame, tests: list[Test]) -> tuple[list[Test], int, int]:
    """The leading tests with the best (bad - good) / covered on rows not grown on, and what they cover there."""
    cuts = range(1, len(tests) + 1)
    got = rows.select(*[F.count(F.when(covers(tests[:k]) & (F.col("bad") == want), 1)).alias(f"{'pn'[not want]}{k}") for k in cuts for want in (True, False)]).first()
    worth = {k: (got[f"p{k}"] - got[f"n{k}"]) / max(1, got[f"p{k}"] + got[f"n{k}"]) for k in cuts}
    k = max(cuts, key=lambda k: (worth[k], -k))
    return tests[:k], got[f"p{k}"], got[f"n{k}"]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", precision: float = 0.9, most_rules: int = 12, most_tests: int = 4) -> list[list[Test]]:
    """Ordered rules that mark bad documents, learned from all labelled documents that are not held out."""
    y = (labels.select("doc_id", F.col(label).cast("double").alias("y")).dropna().where(~held_out(F.col("doc_id")))
         .groupBy("doc_id").agg((F.avg("y") < 0.5).alias("bad")))
    learn = docs.select("doc_id", "text").join(keep_broadcast(y), "doc_id")
    part = F.crc32(F.concat(F.lit("prune"), F.col("doc_id").cast("string")).cast("binary")) % 3 == 0
    rows = pinned(with_statistics(learn, ["doc_id", "bad"]).where(~base_failed()).select("bad", part.alias("to_prune"), *stats.RATIOS))
    share = rows.select(F.min("bad"), F.max("bad")).first()
    if share[0] is None or share[0] == share[1]:
        return []
    quantiles = rows.approxQuantile(list(stats.RATIOS), [i / BINS for i in range(1, BINS)], 0.001)
    edges = {name: sorted(set(q)) for name, q in zip(stats.RATIOS, quantiles)}
    rows = pinned(rows.withColumn("bins", F.array(*[_bin(c, edges[c]) for c in stats.RATIOS])))
    rules: list[list[Test]] = []
    left = rows
    while len(rules) < most_rules:
        tests = _grow(left.where(~F.col("to_prune")), edges, most_tests)
        if not tests:
            break
        tests, p, n = _prune(left.where(F.col("to_prune")), tests)
        if p == 0 or p < precision * (p + n):
            break
        rules.append(tests)
        left = left.where(~covers(tests))
    return rules


def verdict(rules: list[list[Test]]) -> Column:
    """The list as one expression: the first rule that covers a row drops it, a row no rule covers stays."""
    out = F.when(base_failed(), False)
    for tests in rules:
        out = out.when(covers(tests), False)
    return out.otherwise(True)


def judge(docs: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """doc_id, counts, base_failed, kept and the number of the rule that dropped it (0 the base rule, null none)."""
    out = with_statistics(docs, ["doc_id"])
    which = F.when(base_failed(), 0)
    for i, tests in enumerate(rules, 1):
        which = which.when(covers(tests), i)
    return out.select("doc_id", *stats.COUNTS, base_failed().alias("base_failed"), verdict(rules).alias("kept"), which.alias("rule"))
