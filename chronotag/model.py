"""Table layouts shared by every operator.

events            id, start_time, end_time, tags (sorted array of name/value structs), and
                  optionally `tag:<name>` columns holding single-valued tags that should be
                  filterable by the Parquet reader
samples           event_id, time, value (array of float)
time_coordinates  tags, slope, intercept
attachments       event_id, schema_name, table_name
blobs             event_id, time, schema_name, data
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# End time of an event that is still going on.
MAX_TIME = 1.7976931348623157e308

TAGS = "array<struct<name:string,value:string>>"
EVENTS = f"id bigint, start_time double, end_time double, tags {TAGS}"
SAMPLES = "event_id bigint, time double, value array<float>"
COORDINATES = f"tags {TAGS}, slope double, intercept double"
ATTACHMENTS = "event_id bigint, schema_name string, table_name string"
BLOBS = "event_id bigint, time double, schema_name string, data binary"

EVENT_COLUMNS = ["id", "start_time", "end_time", "tags"]


@dataclass(frozen=True)
class Store:
    """The tables of one event store. Operators return new stores; nothing is changed in place."""

    events: DataFrame
    samples: DataFrame | None = None
    time_coordinates: DataFrame | None = None
    attachments: DataFrame | None = None
    blobs: DataFrame | None = None
    options: dict = field(default_factory=dict)

    def with_(self, **tables) -> "Store":
        return replace(self, **tables)

    @property
    def spark(self) -> SparkSession:
        return self.events.sparkSession

    def write(self, path: str, partitions: int | None = None) -> None:
        """Write a new version of the store under `path`, which must not exist yet.

        Events are clustered by start time so that time filters skip row groups, samples by
        series and time so that per-series work reads neighbouring files.
        """
        def clustered(df, *cols):
            spread = (df.repartitionByRange(partitions, *cols) if partitions
                      else df.repartitionByRange(*cols))
            return spread.sortWithinPartitions(*cols)

        layout = {"events": ("start_time", "id"), "samples": ("event_id", "time")}
        for name in ("events", "samples", "time_coordinates", "attachments", "blobs"):
            df = getattr(self, name)
            if df is None:
                continue
            if name in layout:
                df = clustered(df, *layout[name])
            df.write.mode("errorifexists").parquet(f"{path}/{name}")

    @staticmethod
    def read(spark: SparkSession, path: str, tables=("events", "samples")) -> "Store":
        return Store(**{t: spark.read.parquet(f"{path}/{t}") for t in tables})


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def epoch_seconds(df: DataFrame, name: str):
    """Seconds since 1970 as a double, whatever kind of timestamp the column is."""
    kind = dict(df.dtypes)[name]
    if kind == "timestamp_ntz":
        # by parts, because a cast to an instant would read the clock time in the session's zone
        micros = F.expr(f"unix_date(date(`{name}`)) * 86400000000L + hour(`{name}`) * 3600000000L + minute(`{name}`) * 60000000L "
                        f"+ bigint(extract(SECOND FROM `{name}`) * 1000000)")
    else:
        micros = F.unix_micros(F.col(name))
    return micros.cast("double") / F.lit(1e6)


def session(app: str = "chronotag", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
