"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on (first group) or are faster with (second).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.codegen.maxFields": "20",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session.

    Of repeated object keys the last one counts, as in Python's decoder.
    Generated methods over 8000 bytes are never compiled by the JVM; with the
    limit set to that size Spark splits long rule sets into small methods.
    ``maxFields`` does the same for the wide steps that hold a rule set's
    helper columns, before time is lost on generating them as one method.
    """
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def landed(df: DataFrame) -> DataFrame:
    """``df``, computed once and written to the shared folder (see ``work_folder``)."""
    work_folder(df.sparkSession, "landed")
    return df.checkpoint(eager=True)


def landed_table(df: DataFrame) -> DataFrame:
    """``df``, computed once and written as Parquet, so that later passes read only their columns."""
    folder = work_folder(df.sparkSession, "landed")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    A session of one process may go without the setting and gets a temporary
    folder; on a cluster, where executors would write to their own disks, a
    missing setting is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
