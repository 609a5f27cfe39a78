"""Data attached to events: blobs and tables of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotag.model import ATTACHMENTS, BLOBS, Store, empty
from chronotag.operators import events as E
from chronotag.operators import filters


def _blobs(store: Store) -> DataFrame:
    return store.blobs if store.blobs is not None else empty(store.spark, BLOBS)


def _attachments(store: Store) -> DataFrame:
    return store.attachments if store.attachments is not None else empty(store.spark, ATTACHMENTS)


def attach_blobs(store: Store, new: DataFrame) -> Store:
    """Attach (event_id, schema_name, data); an event has one blob per schema, the new one counts."""
    new = new.select("event_id", F.lit(None).cast("double").alias("time"), "schema_name", "data")
    key = new.select("event_id", "schema_name").distinct()
    kept = _blobs(store).join(key, ["event_id", "schema_name"], "left_anti")
    out = store.with_(blobs=kept.unionByName(new, allowMissingColumns=True))
    return _link(out, key.select("event_id", "schema_name", F.col("schema_name").alias("table_name")))


def _link(store: Store, new: DataFrame) -> Store:
    kept = _attachments(store).join(new.select("event_id", "schema_name"), ["event_id", "schema_name"], "left_anti")
    return store.with_(attachments=kept.unionByName(new))


def read_files(spark, paths: str) -> DataFrame:
    """Files as (path, data) rows."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("content").alias("data"))


def create_with_blob(store: Store, start: float, end: float, tags: str, schema: str, data: bytes) -> tuple[Store, int]:
    store, new_id = E.create_one(store, start, end, tags)
    row = store.spark.createDataFrame([(new_id, schema, bytearray(data))], "event_id bigint, schema_name string, data binary")
    return attach_blobs(store, row), new_id


def get_blob(store: Store, event_id: int, schema: str) -> DataFrame:
    return _blobs(store).where((F.col("event_id") == event_id) & (F.col("schema_name") == schema)).select("data")


def with_blobs(store: Store, schema: str, *fs) -> DataFrame:
    """Matching events with their blob of a schema, e.g. events with images."""
    ev = filters.select(store, *fs)
    b = _blobs(store).where(F.col("schema_name") == schema).select("event_id", "data")
    return ev.join(b, F.col("id") == F.col("event_id")).drop("event_id")


def attach_table(store: Store, event_id: int, schema: str, table: str) -> Store:
    """Link an event to a table; an earlier link in the schema is replaced."""
    row = store.spark.createDataFrame([(event_id, schema, table)], ATTACHMENTS)
    return _link(store, row)


def attached_tables(store: Store, event_id: int, schema: str | None = None) -> DataFrame:
    df = _attachments(store).where(F.col("event_id") == event_id)
    return df.where(F.col("schema_name") == schema) if schema else df


def delete_attachments(store: Store, schema: str | None = None, event_id: int | None = None) -> Store:
    """Remove what is attached to an event, in a schema, or both."""
    if schema is None and event_id is None:
        raise ValueError("give a schema, an event id or both")
    gone = F.lit(True)
    if schema is not None:
        gone = gone & (F.col("schema_name") == schema)
    if event_id is not None:
        gone = gone & (F.col("event_id") == event_id)
    out = {"attachments": _attachments(store).where(~gone), "blobs": _blobs(store).where(~gone)}
    if store.samples is not None and schema in (None, "timeseries"):
        hit = F.lit(True) if event_id is None else F.col("event_id") == event_id
        out["samples"] = store.samples.where(~hit)
    return store.with_(**out)
