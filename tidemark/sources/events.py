"""Event sources: streams and tables of JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tidemark.functions.once import evaluate_once
from tidemark.functions.paths import parse_document
from tidemark.functions.sqltext import name


#: Columns that tell where a message stood in its source; together they are a unique arrival order.
ARRIVAL = ["received_at", "source", "part", "position"]


def read_event_stream(spark: SparkSession, source: str = "kafka", **options: str) -> DataFrame:
    """A1: a stream with the message text in ``raw`` and its place in the source in ``ARRIVAL``.

    For Kafka pass its options (``kafka.bootstrap.servers``, ``subscribe``);
    reading starts at the earliest offset unless told otherwise, and every
    query has its own offsets, as separate consumer groups do. The place is
    topic, partition and offset. For files pass ``path`` and use ``text``; the
    place is the file, and the row's position once ``with_positions`` has seen
    the micro-batch (a stream itself cannot number rows).
    """
    if source == "kafka":
        options.setdefault("startingOffsets", "earliest")
        return kafka_rows(spark.readStream.format("kafka").options(**options).load())
    path = options.pop("path")
    stream = spark.readStream.format(source).options(**options).load(path)
    others = [name(c) for c in stream.columns if c != "value"]
    return stream.selectExpr(
        *others, "value AS raw", "current_timestamp() AS received_at", "_metadata.file_path AS source", "0 AS part", "CAST(NULL AS BIGINT) AS position"
    )


def kafka_rows(records: DataFrame) -> DataFrame:
    """A1: text and place of Kafka records."""
    return records.selectExpr(
        "CAST(value AS STRING) AS raw", "timestamp AS received_at", "topic AS source", "partition AS part", "offset AS position"
    )


def with_positions(batch: DataFrame) -> DataFrame:
    """A1: number the rows of a micro-batch that came from files, in the order in which tasks read them.

    The numbers depend on files and splits only, so a repeated task gives the same ones.
    """
    if not set(ARRIVAL) <= set(batch.columns):
        return batch
    return batch.withColumn("position", F.coalesce("position", F.monotonically_increasing_id()))


def decode(df: DataFrame, raw: str = "raw", doc: str = "doc") -> DataFrame:
    """A2: add the parsed document; ``doc`` is NULL where the text is not JSON."""
    return evaluate_once(df, **{doc: parse_document(name(raw))})


def decoded(df: DataFrame, doc: str = "doc") -> DataFrame:
    """A2: the rows that could be decoded."""
    return df.filter(F.col(doc).isNotNull())


def dead_letters(df: DataFrame, doc: str = "doc") -> DataFrame:
    """A2: the rows that could not be decoded, kept instead of only logged."""
    return df.filter(F.col(doc).isNull()).drop(doc).withColumn("reason", F.lit("invalid JSON"))


def archive_rows(df: DataFrame, raw: str = "raw", ingested: str = "current_timestamp()") -> DataFrame:
    """The text to store and the ingest date that names its folder."""
    return df.selectExpr(f"{name(raw)} AS value", f"date_format({ingested}, 'yyyy-MM-dd') AS ingest_date")


def ingest_stats(df: DataFrame, raw: str = "raw", seconds: float | None = None) -> DataFrame:
    """Messages and size of a batch, and the rate if the batch took ``seconds`` (0 for no time)."""
    stats = df.agg(
        F.count("*").alias("messages"),
        F.expr(f"coalesce(sum(octet_length({name(raw)})), 0)").alias("bytes"),
    )
    if seconds is None:
        return stats
    rate = F.col("messages") / F.lit(float(seconds)) if seconds > 0 else F.lit(0.0)
    return stats.withColumn("messages_per_second", rate)


def observe_ingest(df: DataFrame, raw: str = "raw", label: str = "ingest") -> tuple[DataFrame, Observation]:
    """A12 without a pass of its own: the numbers appear once an action has run.

    On a stream use the label to find them in the query's progress, whose
    ``processedRowsPerSecond`` is the rate.
    """
    observation = Observation(label)
    watched = df.observe(
        observation,
        F.count(F.lit(1)).alias("messages"),
        F.expr(f"coalesce(sum(octet_length({name(raw)})), 0)").alias("bytes"),
    )
    return watched, observation
