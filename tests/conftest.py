import os

import pytest

from chronotag.model import session


@pytest.fixture(scope="session")
def spark():
    s = session("chronotag-tests", "local[8]", **{
        # a few rows per query: compiling each plan would take most of the time
        "spark.sql.codegen.wholeStage": "false",
        "spark.sql.codegen.factoryMode": "NO_CODEGEN",
        "spark.sql.shuffle.partitions": "2",
        "spark.default.parallelism": "2",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1",  # short runs: compile quickly
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def tagged(spark, rows, schema="id bigint, start_time double, end_time double, text string"):
    """Events from (id, start, end, 'n=v,...') rows."""
    from pyspark.sql import functions as F

    from chronotag.functions import tags as T
    df = spark.createDataFrame(rows, schema)
    return df.select("id", "start_time", "end_time", T.from_text(F.col("text")).alias("tags"))
