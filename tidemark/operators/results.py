"""Aggregations over validation results.

All of them are partial-then-final aggregates or top-k selections; nothing is
gathered per group.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.sqltext import name
from tidemark.operators.validate import ENGINE_ERROR, timestamp_sql

_PASSED = "count_if(status = 'PASS')"
_WARNED = "count_if(status = 'WARN')"
_FAILED = "count_if(status = 'FAIL')"


def _rate(part: str, total: str = "total") -> str:
    return f"coalesce(try_divide(CAST({part} AS DOUBLE), {total}), 0D)"


def _aggregate(df: DataFrame, **aggregates: str) -> DataFrame:
    return df.agg(*[F.expr(sql).alias(column) for column, sql in aggregates.items()])


def run_stats(validated: DataFrame) -> DataFrame:
    """Totals, rates and mean failures of a run; rows that ended in an engine error are not counted."""
    counted = _aggregate(
        validated.filter(f"NOT array_contains(failed_checks, '{ENGINE_ERROR}')"),
        total_validated="count(*)",
        passed=_PASSED,
        warned=_WARNED,
        failed=_FAILED,
        total_failures="coalesce(sum(size(failed_checks)), 0)",
    )
    return counted.selectExpr(
        "*",
        _rate("passed", "total_validated") + " AS pass_rate",
        _rate("warned", "total_validated") + " AS warn_rate",
        _rate("failed", "total_validated") + " AS fail_rate",
        _rate("total_failures", "total_validated") + " AS avg_failures_per_event",
    )


def status_counters(validated: DataFrame) -> DataFrame:
    """Total, passed, warned, failed and the pass rate."""
    counted = _aggregate(validated, total="count(*)", passed=_PASSED, warned=_WARNED, failed=_FAILED)
    return counted.selectExpr("*", _rate("passed") + " AS pass_rate")


def failures_by(validated: DataFrame, attribute: str) -> DataFrame:
    """Failures per ``check_type`` or ``severity``."""
    return (
        validated.selectExpr(f"explode(failures.{attribute}) AS {attribute}")
        .groupBy(attribute)
        .agg(F.count("*").alias("failures"))
    )


# Upper bounds of the duration buckets, in seconds.
DURATION_BUCKETS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0]


def duration_histogram(df: DataFrame, milliseconds: str, buckets: list[float] | None = None) -> DataFrame:
    """E5: cumulative counts per bucket, with sum and count; zero and missing durations are left out.

    One global aggregate; the buckets become rows afterwards.
    """
    bounds = sorted(buckets or DURATION_BUCKETS)
    timed = df.selectExpr(f"{name(milliseconds)} / 1000D AS seconds").filter("seconds <> 0 AND NOT isnan(seconds)")
    counted = _aggregate(
        timed,
        **{f"b{n}": f"count_if(seconds <= {bound}D)" for n, bound in enumerate(bounds)},
        duration_sum="coalesce(sum(seconds), 0D)",
        duration_count="count(*)",
    )
    rows = ", ".join(f"'{bound}', b{n}" for n, bound in enumerate(bounds))
    return counted.selectExpr(
        f"stack({len(bounds) + 1}, {rows}, '+Inf', duration_count) AS (le, cumulative_count)",
        "duration_sum",
        "duration_count",
    )


def recent_results(validated: DataFrame, limit: int = 10, tie_break: str = "event_id") -> DataFrame:
    """The latest WARN and FAIL results with their number of failures."""
    return (
        validated.filter("status IN ('WARN', 'FAIL')")
        .orderBy(F.col("validation_ts").desc(), F.col(tie_break).desc())
        .limit(limit)
        .selectExpr(
            *dict.fromkeys([name(tie_break), "`event_id`"]),
            "status",
            "size(failed_checks) AS failures",
            "validation_ts",
        )
    )


# Alert thresholds, all strict.
MAX_FAIL_RATE = 0.05
MAX_WARN_RATE = 0.20
MAX_MEAN_SECONDS = 0.1


def alert_conditions(validated: DataFrame, milliseconds: str | None = None) -> DataFrame:
    """One row of alert flags and the rates behind them."""
    duration = name(milliseconds) if milliseconds else "CAST(NULL AS DOUBLE)"
    counted = _aggregate(
        validated,
        total="count(*)",
        warned=_WARNED,
        failed=_FAILED,
        mean_seconds=f"avg(CASE WHEN {duration} <> 0 THEN {duration} / 1000D END)",
    ).selectExpr(
        "total",
        _rate("failed") + " AS failure_rate",
        _rate("warned") + " AS warning_rate",
        "coalesce(mean_seconds, 0D) AS avg_duration_seconds",
    )
    return counted.selectExpr(
        f"failure_rate > {MAX_FAIL_RATE}D AS high_failure_rate",
        f"warning_rate > {MAX_WARN_RATE}D AS high_warning_rate",
        f"avg_duration_seconds > {MAX_MEAN_SECONDS}D AS slow_validation",
        "total = 0 AS no_data",
        "failure_rate",
        "warning_rate",
        "avg_duration_seconds",
    )


def stats_between(
    results: DataFrame,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    milliseconds: str = "processing_time_ms",
) -> DataFrame:
    """Statistics of stored results in an inclusive time range."""
    if start is not None:
        results = results.filter(f"validation_ts >= {timestamp_sql(start)}")
    if end is not None:
        results = results.filter(f"validation_ts <= {timestamp_sql(end)}")
    counted = _aggregate(
        results,
        total="count(*)",
        passed=_PASSED,
        warned=_WARNED,
        failed=_FAILED,
        avg_processing_time_ms=f"coalesce(avg({name(milliseconds)}), 0D)",
        earliest_validation="min(validation_ts)",
        latest_validation="max(validation_ts)",
    )
    return counted.selectExpr(
        "*",
        _rate("passed") + " AS pass_rate",
        _rate("warned") + " AS warn_rate",
        _rate("failed") + " AS fail_rate",
    )


def recent_failures(results: DataFrame, limit: int = 100, severity: str | None = None) -> DataFrame:
    """Latest WARN and FAIL results, optionally of one severity, lists kept as arrays."""
    chosen = results.filter("status IN ('WARN', 'FAIL')")
    if severity:
        chosen = chosen.filter(F.col("severity") == severity)
    return (
        chosen.orderBy(F.col("validation_ts").desc(), F.col("event_id"))
        .limit(limit)
        .select(
            "event_id", "table_name", "status", "failed_checks", "error_messages", "severity", "validation_ts", "failures"
        )
    )


def hourly_fail_rate(results: DataFrame, ts: str = "validation_ts") -> DataFrame:
    """Percent of failed results per hour."""
    return (
        results.withColumn("hour", F.date_trunc("hour", F.col(ts)))
        .groupBy("hour")
        .agg(F.count("*").alias("total"), F.expr(f"100D * {_FAILED} / count(*)").alias("fail_rate"))
    )


def top_failing_checks(results: DataFrame, limit: int | None = None) -> DataFrame:
    """Failures per check name, most frequent first."""
    counted = (
        results.select(F.explode("failed_checks").alias("check_name"))
        .groupBy("check_name")
        .agg(F.count("*").alias("failures"))
        .orderBy(F.col("failures").desc(), "check_name")
    )
    return counted.limit(limit) if limit else counted


def batch_type_counts(df: DataFrame, event_type: str) -> DataFrame:
    """Events per non-empty type (see ``batch_size`` for the total)."""
    typed = df.selectExpr(f"{event_type} AS event_type").filter("event_type <> ''")
    return typed.groupBy("event_type").agg(F.count("*").alias("events"))


def batch_size(df: DataFrame) -> DataFrame:
    """Number of events in the batch."""
    return df.agg(F.count("*").alias("batch_size"))
