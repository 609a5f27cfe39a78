"""What the operators share: tables, the held-out rule, bounded samples, distributed running sums."""

from __future__ import annotations

import gc
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotag.plans.durable import ensure_checkpoint_dir, pinned

__all__ = ["bounded_ids", "held_out", "keep_broadcast", "pinned", "running", "small_batches", "spare", "table", "tidy", "word_count", "written"]

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of ids (8 bytes each) up to which a set of ids is sent to every executor; beyond it Spark shuffles.
MAX_IDS = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spare(columns, *names: str) -> list[str]:
    """A column name that `columns` does not use for each of `names`."""
    used, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in used:
            n = "_" + n
        used.add(n.lower())
        out.append(n)
    return out


def written(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed once and kept as compressed columns in the checkpoint folder: smaller than `pinned` where
    rows hold small numbers and repeated keys. Column names must differ."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files that led up to what is pinned by now; it works when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of few rows for the jobs that run inside: rows here hold whole texts or sets. The caller's setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def held_out(doc_id: Column) -> Column:
    """Documents kept from learning; a null id is held out as well."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def word_count(text: Column) -> Column:
    """Words of a text without building an array of them: one space for each run of spaces, then count."""
    plain = F.regexp_replace(text, WORD, "w")
    return F.coalesce(F.length(plain) - F.length(F.replace(plain, F.lit("w"), F.lit(""))), F.lit(0)).cast("long")


def bounded_ids(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, chosen by the hash of `key`: the same ones on each run."""
    return rows.orderBy(F.xxhash64(key), key).limit(most)


def keep_broadcast(ids: DataFrame) -> DataFrame:
    """Hint a broadcast of a one-column set of ids that was counted and found small."""
    return F.broadcast(ids) if ids.limit(MAX_IDS + 1).count() <= MAX_IDS else ids


def running(rows: DataFrame, keys: list[str], order: list[Column], value: Column, per_block: int = 20_000) -> DataFrame:
    """`before`: the sum of `value` over the rows of the same `keys` that come earlier in `order`.

    `order` starts with a column of evenly spread text in hexadecimal digits (a hash). Its leading digits cut each key
    into blocks of about `per_block` rows, so that a key with a third of all rows is summed by many
    tasks: one pass adds up the blocks, one small window runs over the blocks of a key, one window over the rows of a block.
    """
    n, digits = rows.count(), 0
    while 16 ** digits * per_block < n and digits < 8:
        digits += 1
    rows = rows.withColumns({"_v": value, "_b": F.substring(order[0], 1, digits)})
    blocks = rows.groupBy(*keys, "_b").agg(F.sum("_v").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_bb"),
                           F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    out = out.join(blocks, [*same, F.col("_b") == F.col("_bb")])
    return out.withColumn("before", F.col("_base") + F.col("_in")).drop("_v", "_b", "_bb", "_base", "_in", *[f"_k{i}" for i in range(len(keys))])
