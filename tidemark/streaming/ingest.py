"""Streaming forms (S1-S6). Batch operators are reused unchanged inside ``foreachBatch``.

Every attempt at a micro-batch writes into folders of its own, which one commit record
makes visible together. A batch that has committed is not run again; a replay after a
lost executor or driver starts from the same state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.paths import DocumentFields
from tidemark.operators.duplicates import first_per_key, mark_duplicates, mark_duplicates_within, spread_nulls
from tidemark.operators.rollups import hourly_rollup, merged
from tidemark.operators.validate import duplicates_enabled, timestamp_sql, validate, with_event_key
from tidemark.sources.events import ARRIVAL, archive_rows, dead_letters, decode, decoded, with_positions
from tidemark.sources.flat_events import flat_rejects, flat_rows, flatten_events
from tidemark.sources.sinks import processed_rows, result_rows
from tidemark.streaming.commits import CommitLog, Entry, State
from tidemark.streaming.keystore import KeyStore

#: Given as a lookback: a key once seen is a duplicate for good.
FOREVER = None
#: Given as a lookback: that of the rule set, ``lookback_window_seconds`` of its duplicate check.
OF_RULES = "of rules"
#: Seconds that an event may lag behind the newest one of earlier batches before it counts as late.
DELAY = 86_400


@dataclass(frozen=True)
class CommittedTable:
    """A table of a commit log."""

    root: str
    name: str

    def read(self, spark: SparkSession) -> DataFrame:
        return CommitLog(spark, self.root).read(self.name)


@dataclass(frozen=True)
class IngestTables:
    """The outputs of the ingest stream below one folder."""

    root: str

    def __getattr__(self, table: str) -> CommittedTable:
        if table not in ("results", "processed", "flat", "flat_rejects", "quarantine", "dead_letters", "late", "rollup"):
            raise AttributeError(table)
        return CommittedTable(self.root, table)


@dataclass
class Attempt:
    """One attempt at a micro-batch: the state it reads, what it will commit, what it holds in memory."""

    log: CommitLog
    state: State
    added: list[Entry]
    removed: list[Entry]
    held: list[DataFrame]

    @staticmethod
    def begun(log: CommitLog) -> "Attempt":
        return Attempt(log, log.state(), [], [], [])

    def write(self, table: str, df: DataFrame) -> None:
        path = self.log.attempt(table)
        df.write.parquet(path)
        self.added.append(Entry(table, path))

    def hold(self, df: DataFrame) -> DataFrame:
        self.held.append(df.persist())
        return df

    def release(self, df: DataFrame) -> None:
        """``df`` is not read again: what reads it is held or written."""
        df.unpersist()
        self.held = [h for h in self.held if h is not df]

    def store(self, keys: KeyStore, fresh: DataFrame, horizon: datetime | None = None) -> None:
        added, replaced = keys.write(self.state, fresh, horizon)
        self.added += added
        self.removed += replaced


def rule_lookback(rules: dict) -> int | None:
    """How far back, in seconds, the rule set looks for a duplicate key; None for ever."""
    return (rules.get("duplicate_check") or {}).get("lookback_window_seconds")


def key_slices(log: CommitLog, lookback_seconds: int | None, delay: int = DELAY) -> KeyStore:
    """The store of duplicate keys; its slices are as long as a lookback, or a quarter of what is kept if that is longer."""
    return KeyStore(log, "keys", None if lookback_seconds is None else max(1, lookback_seconds, (lookback_seconds + delay) // 4))


def report_duplicates(
    batch: DataFrame,
    attempt: Attempt,
    order_by: list[str],
    ts: str | None = None,
    lookback_seconds: int | None = FOREVER,
    delay: int = DELAY,
    horizon: datetime | None = None,
) -> DataFrame:
    """Flag rows whose ``event_key`` came earlier, in this batch or in one before.

    Only distinct keys are stored and compared. Given an event time and a
    lookback, keys seen longer ago than that are ignored, in this batch as in
    earlier ones, so the result does not depend on how batches are cut. Of the
    stored keys only slices that the lookback reaches are asked, and only buckets
    read that may hold a key of this batch. Rows without a key, and under a
    lookback rows without a time, are no duplicates. Keys are not stored if they
    were seen at ``horizon`` or before.
    """
    bounded = ts is not None and lookback_seconds is not None
    store = key_slices(attempt.log, lookback_seconds if bounded else None, delay)
    keyed = batch.filter(F.col("event_key").isNotNull() & (F.col(ts).isNotNull() if bounded else F.lit(True)))
    time = F.max(ts) if ts else F.lit(None).cast("timestamp")
    fresh = keyed.groupBy(F.col("event_key").alias("key")).agg(time.alias("seen"))
    reach = None
    if bounded:
        marked = mark_duplicates_within(batch, ["event_key"], ts, order_by, lookback_seconds, "in_batch")
        earliest = keyed.agg(F.unix_micros(F.min(ts))).first()[0]
        reach = None if earliest is None else _moment(earliest) - timedelta(seconds=lookback_seconds)
    else:
        marked = mark_duplicates(batch, F.col("event_key"), order_by, "in_batch")
    known = store.lookup(attempt.state, fresh, reach, attempt.held).select(F.col("key").alias("__known"), F.col("seen").alias("__seen"))
    recent = F.col("__known").isNotNull()
    if bounded:
        recent = recent & (F.unix_micros(ts) - F.unix_micros("__seen") < lookback_seconds * 1_000_000)
    out = (
        marked.withColumn("__join", spread_nulls(F.col("event_key"), order_by))
        .join(known, F.col("__join") == F.col("__known"), "left")
        .withColumn("is_duplicate", F.col("in_batch") | F.coalesce(recent, F.lit(False)))
        .drop("in_batch", "__join", "__known", "__seen")
    )
    attempt.store(store, fresh, horizon)
    return out


def _moment(micros: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)


def ingest_batch(
    batch: DataFrame,
    batch_id: int,
    rules: dict,
    as_of: str,
    tables: IngestTables,
    order_by: list[str] | None = None,
    raw: str = "raw",
    lookback: tuple[str, int] | None = FOREVER,
    *,
    query: str = "direct",
    event_time: str | None = None,
    delay: int = DELAY,
) -> None:
    """Decode, report duplicates, validate, write every output of one micro-batch, and commit them together.

    ``order_by`` is a unique arrival order, by default the place in the source
    (A1). ``lookback`` names an event time column and seconds. Given ``event_time``
    (by default that column), rows more than ``delay`` seconds behind the newest
    event of earlier batches are also listed in the table ``late`` (S5), and
    stored keys that only later rows could meet are dropped.
    """
    order_by = order_by or ARRIVAL
    attempt = Attempt.begun(CommitLog(batch.sparkSession, tables.root))
    if attempt.state.batches.get(query, -1) >= batch_id:
        return  # committed before the query could note it
    ts = event_time or (lookback[0] if lookback else None)
    # A micro-batch is bounded by its trigger; it is decoded once for all outputs.
    parsed = decode(with_positions(batch), raw)
    if duplicates_enabled(rules):
        parsed = with_event_key(parsed, rules, DocumentFields("doc"))
    parsed = attempt.hold(parsed)
    try:
        facts = _event_times(parsed, attempt, as_of, order_by, ts, delay)
        horizon = None
        if lookback and "newest" in facts:
            horizon = _moment(facts["newest"]) - timedelta(seconds=lookback[1] + delay)
        _write_outputs(parsed, attempt, rules, as_of, order_by, lookback, delay, horizon, ts)
        if lookback:
            gone = {e.path for e in attempt.removed}
            expired = key_slices(attempt.log, lookback[1], delay).expired(attempt.state, horizon)
            attempt.removed += [e for e in expired if e.path not in gone]
        attempt.log.commit(attempt.state, query, batch_id, attempt.added, attempt.removed, facts)
    finally:
        for df in attempt.held:
            df.unpersist()


def _event_times(parsed: DataFrame, attempt: Attempt, as_of: str, order_by: list[str], ts: str | None, delay: int) -> dict:
    """The newest event so far, in microseconds, not beyond ``as_of``; writes the late rows."""
    if ts is None:
        return {}
    before = attempt.state.facts.get("newest")
    bound = F.lit(None if before is None else before - delay * 1_000_000).cast("long")
    late = parsed.filter(F.unix_micros(ts) < bound)
    attempt.write("late", late.select(*order_by, F.col(ts).alias("event_time"), F.timestamp_micros(bound).alias("bound")))
    newest = parsed.agg(F.least(F.unix_micros(F.max(ts)), F.expr(f"unix_micros(CAST({timestamp_sql(as_of)} AS TIMESTAMP))"))).first()[0]
    known = [n for n in (before, newest) if n is not None]
    return {"newest": max(known)} if known else {}


def _write_outputs(
    parsed: DataFrame,
    attempt: Attempt,
    rules: dict,
    as_of: str,
    order_by: list[str],
    lookback: tuple[str, int] | None,
    delay: int,
    horizon: datetime | None,
    time: str | None,
) -> None:
    """Every output of a decoded micro-batch; ``time`` is the event time, if there is one."""
    attempt.write("dead_letters", dead_letters(parsed.drop("event_key") if duplicates_enabled(rules) else parsed))
    events = decoded(parsed)
    fields = DocumentFields("doc")
    if duplicates_enabled(rules):
        ts, seconds = lookback or (None, None)
        events = report_duplicates(events, attempt, order_by, ts, seconds, delay, horizon).drop("event_key")
        checked = validate(events, rules, as_of, fields, duplicate_flag="is_duplicate")
    else:
        checked = validate(events, rules, as_of, fields)
    checked = attempt.hold(checked)
    attempt.write("results", result_rows(checked))
    attempt.release(parsed)
    _write_rollup(checked, attempt, time)
    attempt.write("quarantine", checked.filter("status = 'FAIL'").drop("doc", "metadata"))
    passed = checked.filter("status <> 'FAIL'").withColumnRenamed("event_id", "result_id")
    flattened = attempt.hold(flatten_events(passed, keep=[*order_by, "status", "result_id", "doc"]))
    attempt.write("flat_rejects", flat_rejects(flattened).drop("doc", "result_id"))
    attempt.release(checked)
    # Both tables get the same rows: an event that one cannot store is stored in neither.
    fresh = _fresh(flat_rows(flattened), attempt, order_by)
    attempt.write("flat", fresh.drop("doc", "result_id"))
    stored = fresh.drop("event_id").withColumnRenamed("result_id", "event_id")
    stored_at = f"TIMESTAMP '{as_of}'" if as_of != "now" else "current_timestamp()"
    attempt.write("processed", processed_rows(stored, processed_at=stored_at))
    ids = fresh.filter("event_id IS NOT NULL").select(F.col("event_id").alias("key"), F.lit(None).cast("timestamp").alias("seen"))
    attempt.store(KeyStore(attempt.log, "ids"), ids)


def _write_rollup(checked: DataFrame, attempt: Attempt, time: str | None) -> None:
    """The batch's results per hour, by event time or else by validation time, beside those of earlier batches."""
    rows = hourly_rollup(checked, time or "validation_ts", None)
    before = [e for e in attempt.state.entries if e.table == "rollup"]
    if len(before) + 1 >= COMPACTED:
        rows = merged(attempt.log.read("rollup", attempt.state).unionByName(rows))
        attempt.removed += before
    attempt.write("rollup", rows)


def _fresh(rows: DataFrame, attempt: Attempt, order_by: list[str]) -> DataFrame:
    """A7 in a micro-batch: first of each event id that no earlier batch stored; held."""
    rows = attempt.hold(first_per_key(rows, "event_id", order_by))
    if not any(e.table == "ids" for e in attempt.state.entries):
        return rows
    asked = rows.filter("event_id IS NOT NULL").select(F.col("event_id").alias("key"))
    stored = KeyStore(attempt.log, "ids").lookup(attempt.state, asked, None, attempt.held)
    return attempt.hold(rows.join(stored.select(F.col("key").alias("__stored")), F.col("event_id") == F.col("__stored"), "left_anti"))


def validate_stream(
    stream: DataFrame,
    rules: dict,
    as_of: str,
    root: str,
    order_by: list[str] | None = None,
    *,
    raw: str = "raw",
    lookback: tuple[str, int] | str | None = OF_RULES,
    event_time: str | None = None,
    delay: int = DELAY,
    available_now: bool = False,
) -> StreamingQuery:
    """Start the ingest; its tables and checkpoint live below ``root``.

    Duplicates are looked for as far back as the rule set says, by ``event_time``
    (``received_at`` if the stream has it), unless ``lookback`` names a time column
    and seconds, or is ``FOREVER``.
    """
    tables = IngestTables(root)
    if event_time is None and "received_at" in stream.columns:
        event_time = "received_at"
    if lookback == OF_RULES:
        seconds = rule_lookback(rules) if duplicates_enabled(rules) else None
        if seconds is not None and event_time is None:
            raise ValueError("the rule set has a lookback: name the event_time, or give lookback=FOREVER")
        lookback = FOREVER if seconds is None else (event_time, seconds)

    def run(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
        ingest_batch(batch, batch_id, rules, as_of, tables, order_by, raw, lookback, query=query, event_time=event_time, delay=delay)

    return _start(stream, run, root, available_now)


def dedup_stream(stream: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """S3: drop repeated keys; state of a key expires with the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def counters_stream(validated: DataFrame, ts: str, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Running counters and fail rate per tumbling window.

    Rows later than the watermark (S5) are left out of these counters only.
    """
    return (
        validated.withWatermark(ts, delay)
        .groupBy(F.window(ts, width))
        .agg(
            F.count("*").alias("total"),
            F.expr("count_if(status = 'PASS')").alias("passed"),
            F.expr("count_if(status = 'WARN')").alias("warned"),
            F.expr("count_if(status = 'FAIL')").alias("failed"),
        )
        .selectExpr("window.start AS hour", "total", "passed", "warned", "failed", "100D * failed / total AS fail_rate")
    )


#: Folders of one table that are merged into one when there are so many.
COMPACTED = 16


def keep_latest(stream: DataFrame, root: str, keys: list[str], *, available_now: bool = False) -> StreamingQuery:
    """Write an updating aggregate; ``latest`` reads the newest row per key.

    Every ``COMPACTED`` batches their newest rows are written as one folder, so
    readers open few folders, and superseded rows go.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
        keep_batch(batch, batch_id, root, keys, query=query)

    return _start(stream, run, root, available_now, "update")


def keep_batch(batch: DataFrame, batch_id: int, root: str, keys: list[str], *, query: str = "direct") -> None:
    """One batch of ``keep_latest``; committed batches are not written again."""
    attempt = Attempt.begun(CommitLog(batch.sparkSession, root))
    if attempt.state.batches.get(query, -1) >= batch_id:
        return
    rows = batch.withColumn("version", F.lit(attempt.state.number + 1).cast("long"))
    before = [e for e in attempt.state.entries if e.table == "updates"]
    if len(before) + 1 >= COMPACTED:
        rows = _newest(attempt.log.read("updates", attempt.state).unionByName(rows), keys)
        attempt.removed += before
    attempt.write("updates", rows)
    attempt.log.commit(attempt.state, query, batch_id, attempt.added, attempt.removed)


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "version").alias("v"))
    return newest.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def latest(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    """The newest version of each updated row."""
    return _newest(CommitLog(spark, root).read("updates"), keys).drop("version")


def archive_stream(
    stream: DataFrame, root: str, *, raw: str = "raw", ingested: str = "current_timestamp()", available_now: bool = False
) -> StreamingQuery:
    """Append the raw text under ``raw/ingest_date=YYYY-MM-DD``."""
    writer = (
        archive_rows(stream, raw, ingested)
        .writeStream.format("text")
        .partitionBy("ingest_date")
        .option("path", f"{root}/raw")
        .option("checkpointLocation", f"{root}/_checkpoint_archive")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_stream(stream: DataFrame, root: str, *, available_now: bool = False) -> StreamingQuery:
    """Append rows to a parquet table below ``root``."""
    writer = (
        stream.writeStream.format("parquet")
        .option("path", f"{root}/rows")
        .option("checkpointLocation", f"{root}/_checkpoint")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _start(
    stream: DataFrame, run: Callable, root: str, available_now: bool, mode: str = "append"
) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(run).option("checkpointLocation", f"{root}/_checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
