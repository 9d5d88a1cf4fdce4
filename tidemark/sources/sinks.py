"""Sinks (A3, A8-A10): row shapes and writers for tables, JDBC and topics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tidemark.functions.paths import DocumentFields
from tidemark.functions.severity import FAILURE_TYPE
from tidemark.functions.sqltext import name

# Fixed value: rows per insert statement of the JDBC sinks.
JDBC_PAGE = 100


@dataclass
class Sink:
    """Where rows go: a Spark format with its options.

    ``Sink("parquet", path=...)``, ``Sink("jdbc", options={"url": ...,
    "dbtable": ...})`` or ``Sink("kafka", options={...})``.
    """

    format: str = "parquet"
    path: str | None = None
    options: dict = field(default_factory=dict)
    partition_by: list[str] = field(default_factory=list)
    mode: str = "append"

    def write(self, df: DataFrame) -> None:
        writer = df.write.format(self.format).mode(self.mode)
        if self.format == "jdbc":
            writer = writer.option("batchsize", str(JDBC_PAGE))
        writer = writer.options(**self.options)
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        writer.save(self.path) if self.path else writer.save()


def publish_rows(df: DataFrame, key: str = "id", columns: list[str] | None = None) -> DataFrame:
    """A3: rows as topic messages, ``key`` the text of the id and ``value`` the row as JSON."""
    members = ", ".join(name(c) for c in columns or df.columns)
    return df.selectExpr(f"CAST({name(key)} AS STRING) AS key", f"to_json(struct({members})) AS value")


def publish_documents(df: DataFrame, doc: str = "doc", key_path: str = "id") -> DataFrame:
    """A3 for documents: keyed by ``str(id)``, the value is the document."""
    fields = DocumentFields(doc, tag="p")
    key = fields.field(key_path).text
    return fields.attach(df).selectExpr(f"{key} AS key", f"to_json({name(doc)}) AS value")


def processed_rows(validated: DataFrame, doc: str = "doc", processed_at: str = "current_timestamp()") -> DataFrame:
    """Rows of the processed-events table; the document stays a VARIANT column."""
    return validated.filter("status <> 'FAIL'").selectExpr(
        "event_id", f"{name(doc)} AS event_data", f"{processed_at} AS processed_at", "status AS validation_status"
    )


def result_rows(validated: DataFrame, milliseconds: str | None = None) -> DataFrame:
    """Rows of the result table, lists and maps as JSON text."""
    duration = f"CAST({name(milliseconds)} AS DOUBLE)" if milliseconds else "CAST(NULL AS DOUBLE)"
    return validated.selectExpr(
        "event_id",
        "table_name",
        "status",
        "to_json(failed_checks) AS failed_checks",
        "to_json(error_messages) AS error_messages",
        "severity",
        "validation_ts",
        f"{duration} AS processing_time_ms",
        "to_json(metadata) AS metadata",
        "to_json(failures, map('ignoreNullFields', 'false')) AS failure_details",
    )


def stored_results(rows: DataFrame) -> DataFrame:
    """Result rows read back from a table, lists as arrays again."""
    return rows.selectExpr(
        "event_id",
        "table_name",
        "status",
        "from_json(failed_checks, 'array<string>') AS failed_checks",
        "from_json(error_messages, 'array<string>') AS error_messages",
        "severity",
        "validation_ts",
        "processing_time_ms",
        "from_json(metadata, 'map<string,string>') AS metadata",
        f"from_json(failure_details, 'array<{FAILURE_TYPE}>') AS failures",
    )


def write_results(validated: DataFrame, sink: Sink, milliseconds: str | None = None) -> None:
    """A9."""
    sink.write(result_rows(validated, milliseconds))


def write_drifts(drifts: DataFrame, sink: Sink) -> None:
    """A10: findings have the drift table's columns already."""
    sink.write(drifts)
