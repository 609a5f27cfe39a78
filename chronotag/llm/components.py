"""Connected components of a table of links, in rounds of large and small stars.

Half rounds are written as files and not pinned: however many shuffle partitions there are, a small table of links is read again by few tasks,
of which the driver keeps a record each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotag.llm.common import written


def _least_of(edges: DataFrame) -> DataFrame:
    """Every edge in both directions with the least neighbour of its start (itself included)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a")


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for all nodes of `links` (a, b). Rounds end when every link points at its component."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        # large star: larger neighbours move to the least; small star: smaller ones do, and the node itself
        edges = written(_least_of(edges).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        stars = edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a")
        moved = F.explode(F.array(*[F.struct(F.col(c).alias("a"), F.col("m").alias("b")) for c in ("b", "a")]))
        edges = written(stars.select(moved.alias("edge")).select("edge.*").where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = now
