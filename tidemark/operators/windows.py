"""Time windows of a drift run (G1, A11) and the minimum-sample gate."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.functions.sqltext import case, name

BASELINE, CURRENT = "baseline", "current"


@dataclass(frozen=True)
class TimeWindow:
    """Half-open range ``[start, end)``."""

    start: datetime
    end: datetime

    @property
    def hours(self) -> float:
        return (self.end - self.start).total_seconds() / 3600

    def predicate(self, df: DataFrame, ts: str) -> str:
        """Plain comparisons with literals of the column's own type, so that sources can use them."""
        kind = "TIMESTAMP_NTZ" if isinstance(df.schema[ts].dataType, T.TimestampNTZType) else "TIMESTAMP"
        start, end = (f"{kind} '{moment.isoformat(sep=' ')}'" for moment in (self.start, self.end))
        return f"({name(ts)} >= {start} AND {name(ts)} < {end})"

    def of(self, df: DataFrame, ts: str) -> DataFrame:
        """The rows inside the window."""
        return df.filter(self.predicate(df, ts))


def drift_windows(
    as_of: datetime | str, current_hours: float = 24, baseline_days: float = 7, gap_hours: float = 0
) -> tuple[TimeWindow, TimeWindow]:
    """G1: the baseline and the current window that end at ``as_of``."""
    end = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    start = end - timedelta(hours=current_hours)
    baseline_end = start - timedelta(hours=gap_hours)
    return TimeWindow(baseline_end - timedelta(days=baseline_days), baseline_end), TimeWindow(start, end)


def tag_windows(df: DataFrame, ts: str, baseline: TimeWindow, current: TimeWindow) -> DataFrame:
    """Rows of both windows in one scan, tagged ``baseline`` or ``current``.

    The range predicates are plain comparisons on ``ts`` and reach the source.
    """
    tag = case([(current.predicate(df, ts), f"'{CURRENT}'"), (baseline.predicate(df, ts), f"'{BASELINE}'")])
    return df.filter(f"{baseline.predicate(df, ts)} OR {current.predicate(df, ts)}").selectExpr("*", f"{tag} AS window")


def window_counts(tagged: DataFrame) -> DataFrame:
    """One row with the sizes of both windows."""
    return tagged.agg(
        F.expr(f"count_if(window = '{BASELINE}')").alias("baseline_rows"),
        F.expr(f"count_if(window = '{CURRENT}')").alias("current_rows"),
    )


def gate(findings: DataFrame, tagged: DataFrame, min_rows: int = 100) -> DataFrame:
    """The findings, or nothing when either window has fewer than ``min_rows`` rows.

    An uncorrelated subquery: the counts are taken once, no join is planned.
    """
    enough = window_counts(tagged).filter(f"baseline_rows >= {min_rows} AND current_rows >= {min_rows}")
    return findings.filter(enough.exists())
