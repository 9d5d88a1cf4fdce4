"""Queries over stored drift findings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.validate import timestamp_sql

# Ties in time are broken by these, so that every limit is deterministic.
_TIES = ["drift_type", "entity", "field_name", "metric_name"]


def recent_drifts(drifts: DataFrame, limit: int = 100) -> DataFrame:
    """The latest findings."""
    return drifts.orderBy(F.col("detected_at").desc(), *_TIES).limit(limit)


def critical_drifts(drifts: DataFrame, as_of: datetime | str, hours: float = 24) -> DataFrame:
    """Critical findings of the last hours (inclusive), latest first."""
    since = f"{timestamp_sql(as_of)} - make_dt_interval(0, 0, 0, {hours} * 3600)"
    return drifts.filter(f"severity = 'CRITICAL' AND detected_at >= {since}").orderBy(
        F.col("detected_at").desc(), *_TIES
    )


def drift_frequency(drifts: DataFrame) -> DataFrame:
    """Findings per drift type and severity."""
    return drifts.groupBy("drift_type", "severity").agg(F.count("*").alias("drifts")).orderBy("drift_type", "severity")


def most_drifted_fields(drifts: DataFrame, limit: int = 10) -> DataFrame:
    """The fields with most findings and their highest score."""
    return (
        drifts.groupBy("entity", "field_name")
        .agg(F.count("*").alias("drift_count"), F.max("drift_score").alias("max_score"))
        .orderBy(F.col("drift_count").desc(), F.col("max_score").desc(), "entity", "field_name")
        .limit(limit)
    )


def report_rows(drifts: DataFrame, info_limit: int = 10) -> DataFrame:
    """Every critical and warning finding, the first INFO ones, and a row telling how many more there are."""
    columns = ["severity", "drift_type", "entity", "field_name", "metric_name", "drift_score"]
    rows = drifts.select(*columns, F.lit(None).cast("bigint").alias("more"))
    info = rows.filter("severity = 'INFO'")
    listed = info.orderBy(F.col("drift_score").desc(), *_TIES).limit(info_limit)
    more = info.agg(F.count("*").alias("n")).filter(f"n > {info_limit}").selectExpr(
        "'INFO' AS severity",
        *[f"CAST(NULL AS STRING) AS {c}" for c in columns[1:5]],
        "CAST(NULL AS DOUBLE) AS drift_score",
        f"n - {info_limit} AS more",
    )
    return rows.filter("severity <> 'INFO'").unionByName(listed).unionByName(more)


def report_json(drifts: DataFrame) -> DataFrame:
    """Each finding as one JSON text in column ``finding``, null values included; write it with ``.write.text``.

    Totals are ``drift.summarise``. Metadata, JSON text in the drift table, is
    nested as JSON; text that is not JSON becomes null.
    """
    keys = ["drift_type", "entity", "field_name", "metric_name", "drift_score", "severity", "baseline_value", "current_value"]
    return drifts.select(
        F.to_json(
            F.struct(*keys, F.expr("try_parse_json(metadata)").alias("metadata"), "detected_at"), {"ignoreNullFields": "false"}
        ).alias("finding")
    )
