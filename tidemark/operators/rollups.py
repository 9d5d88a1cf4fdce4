"""Hourly rollups of results: partial aggregates that merge.

A rollup row holds one hour's counts, sums and duration buckets. Rows of the same hour
from different batches add up, so a stream appends small rollups, late rows included,
and readers merge them; results themselves need not be read again.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.sqltext import name
from tidemark.operators.results import DURATION_BUCKETS
from tidemark.operators.validate import timestamp_sql

#: Added up when rollups merge; the buckets of ``DURATION_BUCKETS`` are ``b0``, ``b1`` and so on, each with all below it.
COUNTS = ["total", "passed", "warned", "failed", "timed", "durations"]
BUCKETS = [f"b{n}" for n in range(len(DURATION_BUCKETS))]


def hourly_rollup(results: DataFrame, ts: str = "validation_ts", milliseconds: str | None = "processing_time_ms") -> DataFrame:
    """One row for each hour of ``ts``; rows without a time form an hour of their own (null)."""
    duration = f"CAST({name(milliseconds)} AS DOUBLE)" if milliseconds else "CAST(NULL AS DOUBLE)"
    seconds = f"nullif(nanvl({duration} / 1000D, 0D), 0D)"
    sums = {
        "total": "count(*)", "passed": "count_if(status = 'PASS')", "warned": "count_if(status = 'WARN')",
        "failed": "count_if(status = 'FAIL')", "timed": f"count({duration})", "durations": f"count({seconds})",
        "ms_sum": f"coalesce(sum({duration}), 0D)", "seconds_sum": f"coalesce(sum({seconds}), 0D)",
        "first": f"min({name(ts)})", "last": f"max({name(ts)})",
    }
    sums |= {b: f"count_if({seconds} <= {bound}D)" for b, bound in zip(BUCKETS, DURATION_BUCKETS)}
    return results.groupBy(F.date_trunc("hour", F.col(f"`{ts}`")).alias("hour")).agg(*[F.expr(sql).alias(c) for c, sql in sums.items()])


def _sums() -> list:
    added = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*COUNTS, *BUCKETS]]
    return [*added, *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("ms_sum", "seconds_sum")], F.min("first").alias("first"), F.max("last").alias("last")]


def merged(rollups: DataFrame) -> DataFrame:
    """One row for each hour again."""
    return rollups.groupBy("hour").agg(*_sums())


def _rate(part: str) -> str:
    return f"if(total > 0, {part} / total, 0D)"


def fail_rate_per_hour(rollups: DataFrame) -> DataFrame:
    """E10 from rollups."""
    return merged(rollups).selectExpr("hour", "total", "100D * failed / total AS fail_rate")


def counters(rollups: DataFrame) -> DataFrame:
    """E2 from rollups."""
    return rollups.agg(*_sums()).selectExpr("total", "passed", "warned", "failed", _rate("passed") + " AS pass_rate")


def durations(rollups: DataFrame) -> DataFrame:
    """E5 from rollups."""
    rows = ", ".join(f"'{bound}', {b}" for b, bound in zip(BUCKETS, DURATION_BUCKETS))
    return rollups.agg(*_sums()).selectExpr(
        f"stack({len(BUCKETS) + 1}, {rows}, '+Inf', durations) AS (le, cumulative_count)", "seconds_sum AS duration_sum", "durations AS duration_count"
    )


def stats_between(
    rollups: DataFrame, results: DataFrame, start: datetime | str, end: datetime | str, ts: str = "validation_ts", milliseconds: str | None = "processing_time_ms"
) -> DataFrame:
    """E8 from rollups of the whole hours in an inclusive range; of ``results`` only the two ends' hours are read."""
    begin, stop = (datetime.fromisoformat(m) if isinstance(m, str) else m for m in (start, end))
    hour = timedelta(hours=1)
    first = begin.replace(minute=0, second=0, microsecond=0)
    first = first if first == begin else first + hour
    last = stop.replace(minute=0, second=0, microsecond=0)  # the range's end is inclusive: its hour is never whole
    column = name(ts)
    if first >= last:
        ends = results.filter(f"{column} >= {timestamp_sql(begin)} AND {column} <= {timestamp_sql(stop)}")
        parts = hourly_rollup(ends, ts, milliseconds)
    else:
        ends = results.filter(
            f"({column} >= {timestamp_sql(begin)} AND {column} < {timestamp_sql(first)}) OR "
            f"({column} >= {timestamp_sql(last)} AND {column} <= {timestamp_sql(stop)})"
        )
        whole = rollups.filter(f"hour >= {timestamp_sql(first)} AND hour < {timestamp_sql(last)}")
        parts = whole.unionByName(hourly_rollup(ends, ts, milliseconds))
    return parts.agg(*_sums()).selectExpr(
        "total", "passed", "warned", "failed",
        "if(timed > 0, ms_sum / timed, 0D) AS avg_processing_time_ms",
        "first AS earliest_validation", "last AS latest_validation",
        _rate("passed") + " AS pass_rate", _rate("warned") + " AS warn_rate", _rate("failed") + " AS fail_rate",
    )
