"""Cutting lineage so that a lost executor costs a re-read and not a re-run."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; make one only in local mode."""
    if spark.sparkContext.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="chronotag-checkpoint-")
    spark.sparkContext.setCheckpointDir(shared)


def pinned(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed once and kept in the checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
