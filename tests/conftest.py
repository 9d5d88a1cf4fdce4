import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.session import configure  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("tidemark.scan.tasks", "8")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def documents(spark):
    """Make a document DataFrame (``rid, doc``) out of JSON texts."""

    def make(*texts: str):
        from tidemark.functions.once import evaluate_once

        rows = spark.createDataFrame(list(enumerate(texts)), "rid long, raw string")
        return evaluate_once(rows, doc="try_parse_json(raw)")

    return make
