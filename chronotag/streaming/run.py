"""Starting, stopping and replaying streaming jobs."""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from chronotag.plans.durable import ensure_checkpoint_dir, pinned

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """The store that keyed state with lists and maps needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, where every executor can reach it."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, folder: str, file_name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table, one file or a folder of files, as a stream of its files."""
    table = spark.read.parquet(f"{folder}/{file_name}")
    one_file = all(f.rstrip("/").endswith(f"/{file_name}") for f in table.inputFiles())
    reader = spark.readStream.schema(table.schema)
    reader, folder = (reader.option("pathGlobFilter", file_name), folder) if one_file else (reader, f"{folder}/{file_name}")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def in_batches(df: DataFrame, by: str, parts: int) -> DataFrame:
    """The rows of a table as a stream of about `parts` batches that follow each other in order of `by`: as it would have arrived."""
    spark = df.sparkSession
    rows, folder = pinned(df), work_folder(spark, "batches")
    cuts = sorted(set(rows.approxQuantile(by, [i / parts for i in range(1, parts)], 0.001))) if parts > 1 else []
    files = max(1, rows.rdd.getNumPartitions() // (len(cuts) + 1))
    for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):  # the folders are written one after the other
        after = F.coalesce(F.col(by) > low, F.lit(False)) if low is not None else F.lit(True)
        upto = F.coalesce(F.col(by) <= high, F.lit(low is None)) if high is not None else F.lit(True)
        rows.where(after & upto).repartition(files).write.parquet(f"{folder}/part={i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/part=*")


def subscribe(changes: DataFrame, name: str, on_batch: Callable[[DataFrame, int], None], checkpoint: str | None = None,
              interval: str = "1 second", mode: str = "append") -> StreamingQuery:
    """Call `on_batch(rows, batch number)` for every batch of a stream until `unsubscribe`."""
    folder = checkpoint or work_folder(changes.sparkSession, name)
    return (changes.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", folder)
            .trigger(processingTime=interval).foreachBatch(on_batch).start())


def unsubscribe(spark: SparkSession, name: str) -> bool:
    """Stop a subscription by name; False when there is none."""
    hits = [q for q in spark.streams.active if q.name == name]
    for q in hits:
        q.stop()
    return bool(hits)


def accumulate(changes: DataFrame, path: str, name: str, checkpoint: str | None = None,
               interval: str = "1 second") -> StreamingQuery:
    """Append every change to a table, to be fetched whenever wanted."""
    folder = checkpoint or work_folder(changes.sparkSession, name)
    return (changes.writeStream.queryName(name).outputMode("append").option("checkpointLocation", folder)
            .trigger(processingTime=interval).format("parquet").start(path))


def replay(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything that is there now; its output rows with their `batch` number."""
    spark = stream.sparkSession
    out, marks = work_folder(spark, "replay"), work_folder(spark, "replay-marks")

    def keep(rows: DataFrame, batch: int) -> None:
        # overwriting the batch's own folder makes a repeated batch harmless
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    return spark.read.schema(schema).parquet(out)


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of every key in the output of an update-mode replay."""
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
            .select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest]))
