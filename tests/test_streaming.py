"""Streams over several micro-batches against the batch result."""

import json
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.paths import DocumentFields
from tidemark.operators import rollups
from tidemark.operators.results import duration_histogram, stats_between
from tidemark.operators.validate import validate
from tidemark.plans.event_rules import event_rules
from tidemark.sources import events
from tidemark.sources.events import decode, decoded
from tidemark.streaming import commits, ingest, keystore
from tidemark.streaming.commits import CommitLog, Entry, State
from tidemark.streaming.keystore import KeyStore

AS_OF = "2024-01-30 00:00:00"


def event(n, **changes):
    doc = {
        "id": str(n), "type": "WatchEvent", "actor": {"id": 1, "login": "u1", "url": "u", "avatar_url": "a"},
        "repo": {"id": 1, "name": "o/r", "url": "r"}, "public": True, "payload": {}, "created_at": "2024-01-29T10:00:00Z",
    }
    doc.update(changes)
    return json.dumps(doc)


def write(folder, n, rows):
    (folder / f"part-{n}.json").write_text("\n".join(json.dumps({"rid": rid, "raw": raw}) for rid, raw in rows))


def start(spark, source, root):
    stream = spark.readStream.schema("rid long, raw string").option("maxFilesPerTrigger", 1).json(str(source))
    ingest.validate_stream(stream, event_rules(), AS_OF, root, ["rid"], lookback=ingest.FOREVER, available_now=True).awaitTermination()
    return ingest.IngestTables(root)


def test_ingest_over_batches(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    first = [(1, event(1)), (2, event(2)), (3, event(1)), (4, '{"id": broken'), (5, event(5, public=None))]
    second = [(6, event(2)), (7, event(7)), (8, event(8, created_at="2024-01-29T10:00:00.5Z")), (9, event(9, id=9))]
    write(source, 1, first)
    start(spark, source, root)
    write(source, 2, second)
    tables = start(spark, source, root)

    raw = spark.createDataFrame(first + second, "rid long, raw string")
    whole = validate(decoded(decode(raw)), event_rules(), AS_OF, DocumentFields(), order_by=["rid"])
    want = sorted((r["event_id"], r["status"]) for r in whole.collect())
    got = sorted((r["event_id"], r["status"]) for r in tables.results.read(spark).collect())
    assert got == want
    rejected = {r["rid"]: r["failed_checks"] for r in tables.quarantine.read(spark).collect()}
    assert rejected[3] == ["duplicate.id"] and rejected[6] == ["duplicate.id"]
    assert [r["rid"] for r in tables.dead_letters.read(spark).collect()] == [4]
    assert sorted(r["event_id"] for r in tables.processed.read(spark).collect()) == ["1", "2", "5", "7"]
    assert sorted(r["event_id"] for r in tables.flat.read(spark).collect()) == ["1", "2", "5", "7"]
    assert [r["rejected"] for r in tables.flat_rejects.read(spark).collect()] == [["created_at"]]


def test_replayed_batch_changes_nothing(spark, tmp_path):
    tables = ingest.IngestTables(str(tmp_path / "out"))
    batch = spark.createDataFrame([(1, event(1)), (2, event(2)), (3, event(1))], "rid long, raw string")
    later = spark.createDataFrame([(4, event(1)), (5, event(5))], "rid long, raw string")
    for _ in range(2):
        ingest.ingest_batch(batch, 0, event_rules(), AS_OF, tables, ["rid"])
    for _ in range(2):
        ingest.ingest_batch(later, 1, event_rules(), AS_OF, tables, ["rid"])
    assert sorted(r["event_id"] for r in tables.flat.read(spark).collect()) == ["1", "2", "5"]
    assert tables.results.read(spark).filter("status = 'FAIL'").count() == 2


def test_tables_stay_unique_without_a_duplicate_check(spark, tmp_path):
    rules = {k: v for k, v in event_rules().items() if k != "duplicate_check"}
    tables = ingest.IngestTables(str(tmp_path / "out"))
    for n, ids in enumerate([[1, 1, 8], [1, 2]]):
        rows = [(10 * n + i, event(e)) for i, e in enumerate(ids)]
        ingest.ingest_batch(spark.createDataFrame(rows, "rid long, raw string"), n, rules, AS_OF, tables, ["rid"])
    for table in (tables.flat, tables.processed):
        assert sorted(r["event_id"] for r in table.read(spark).collect()) == ["1", "2", "8"]


def reported(spark, root, rows, ts=None, seconds=None):
    """``{rid: is_duplicate}`` of one batch, which is committed."""
    attempt = ingest.Attempt.begun(CommitLog(spark, root))
    out = {r["rid"]: r["is_duplicate"] for r in ingest.report_duplicates(rows, attempt, ["rid"], ts, seconds).collect()}
    attempt.log.commit(attempt.state, "test", attempt.state.number + 1, attempt.added, attempt.removed)
    return out


def keyed(spark, *rows):
    df = spark.createDataFrame(rows, "rid long, event_key string, t string")
    return df.withColumn("ts", F.col("t").cast("timestamp"))


def test_lookback_does_not_depend_on_how_batches_are_cut(spark, tmp_path):
    rows = keyed(spark, (1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 09:00:00"), (3, "a", "2024-01-01 09:30:00"))
    assert reported(spark, f"{tmp_path}/one", rows, "ts", 3600) == {1: False, 2: False, 3: True}
    cut = {}
    for n in range(3):
        cut |= reported(spark, f"{tmp_path}/many", rows.filter(f"rid = {n + 1}"), "ts", 3600)
    assert cut == {1: False, 2: False, 3: True}


def test_lookback_forgets_old_keys(spark, tmp_path):
    root = str(tmp_path)
    reported(spark, root, keyed(spark, (1, "a", "2024-01-01 00:00:00"), (2, "b", "2024-01-01 02:00:00"), (9, "n", None)), "ts", 3600)
    later = keyed(spark, (3, "a", "2024-01-01 02:30:00"), (4, "b", "2024-01-01 02:30:00"), (5, None, "2024-01-01 02:30:00"), (6, "n", None))
    assert reported(spark, root, later, "ts", 3600) == {3: False, 4: True, 5: False, 6: False}


@pytest.mark.parametrize("seconds", [None, 3600])
def test_many_batches_against_brute_force(spark, tmp_path, seconds):
    """Merged slices, false positives of the filters and unread buckets change nothing."""
    rng, start, rows = random.Random(7), datetime(2024, 1, 1), []
    for n in range(1200):
        rows.append((n, f"k{rng.randrange(300)}" if n % 9 else None, str(start + timedelta(seconds=20 * n))))
    last, want = {}, {}
    for n, key, t in rows:
        now = datetime.fromisoformat(t)
        want[n] = key in last and (seconds is None or (now - last[key]).total_seconds() < seconds)
        if key is not None:
            last[key] = now
    got = {}
    for n in range(0, 1200, 400):
        got |= reported(spark, str(tmp_path), keyed(spark, *rows[n : n + 400]), "ts" if seconds else None, seconds)
    assert got == want


def test_a_batch_reads_only_slices_and_buckets_that_it_may_meet(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keystore, "KEYS_PER_BUCKET", 3)
    log = CommitLog(spark, str(tmp_path))
    store = KeyStore(log, "keys", 3600)

    def commit(rows):
        state = log.state()
        added, replaced = store.write(state, rows.select(F.col("event_key").alias("key"), F.col("ts").alias("seen")))
        log.commit(state, "test", state.number + 1, added, replaced)

    for hour in range(5):
        commit(keyed(spark, *[(n, f"{hour}-{n}", f"2024-01-01 {hour:02}:10:00") for n in range(40)]))
    state, held = log.state(), []
    assert sorted(e.facts["slice"] % 24 for e in state.entries) == [0, 1, 2, 3, 4]
    asked = keyed(spark, (1, "4-7", None), (2, "0-7", None)).select(F.col("event_key").alias("key"))
    found = store.lookup(state, asked, datetime(2024, 1, 1, 3, 30), held)
    assert [r["key"] for r in found.collect()] == ["4-7"]
    read = {tuple(map(int, re.search(r"slice=(\d+)/bucket=(\d+)", p).groups())) for p in found.inputFiles()}
    # of two slices within reach and thirteen buckets each, the one of the key (and what a filter errs about)
    assert len(read) <= 3 and {s % 24 for s, _ in read} <= {3, 4}
    nothing = store.lookup(state, keyed(spark, (1, "new", None)).select(F.col("event_key").alias("key")), None, held)
    assert len(nothing.inputFiles()) <= 1 and nothing.count() == 0
    assert {e.facts["slice"] % 24 for e in store.expired(state, datetime(2024, 1, 1, 3, 0))} == {0, 1, 2}
    # a second batch of the same hour is merged with the first
    commit(keyed(spark, *[(n, f"4x-{n}", "2024-01-01 04:20:00") for n in range(40)]))
    assert [e.facts["rows"] for e in log.state().entries if e.facts["slice"] % 24 == 4] == [80]


def test_old_slices_are_dropped_and_late_rows_told(spark, tmp_path):
    tables = ingest.IngestTables(str(tmp_path / "out"))

    def run(n, *events):
        df = keyed(spark, *[(rid, "", t) for rid, _, t in events]).drop("event_key", "t")
        raws = spark.createDataFrame([(rid, event(e)) for rid, e, _ in events], "rid long, raw string")
        ingest.ingest_batch(df.join(raws, "rid"), n, event_rules(), AS_OF, tables, ["rid"], lookback=("ts", 3600), delay=7200)

    def slices():
        return sorted(e.facts["slice"] % 24 for e in CommitLog(spark, tables.root).state().entries if e.table == "keys")

    run(0, (1, 1, "2024-01-02 00:10:00"), (2, 2, "2024-01-02 05:00:00"))
    assert slices() == [5]  # what was seen at 00:10 is out of reach of all that is not late
    run(1, (3, 2, "2024-01-02 05:30:00"), (4, 4, "2024-01-02 02:59:59"), (5, 5, "2024-01-02 03:00:00"))
    assert slices() == [2, 3, 5]
    assert [r["rid"] for r in tables.late.read(spark).collect()] == [4]
    status = {r["rid"]: r["failed_checks"] for r in tables.quarantine.read(spark).collect()}
    assert status == {3: ["duplicate.id"]} and tables.results.read(spark).count() == 5
    # nothing a clock runs ahead of the run's own time drops keys
    run(2, (6, 6, "2031-01-01 00:00:00"))
    assert CommitLog(spark, tables.root).state().facts["newest"] == 1706572800 * 10**6


def test_failure_between_two_tables_leaves_neither_visible(spark, tmp_path, monkeypatch):
    tables = ingest.IngestTables(str(tmp_path / "out"))
    batch = spark.createDataFrame([(1, event(1)), (2, event(2))], "rid long, raw string")
    later = spark.createDataFrame([(3, event(3))], "rid long, raw string")
    ingest.ingest_batch(batch, 0, event_rules(), AS_OF, tables, ["rid"])
    written = ingest.Attempt.write

    def failing(self, table, df):
        if table == "processed":
            raise OSError("disk")
        written(self, table, df)

    with monkeypatch.context() as m:
        m.setattr(ingest.Attempt, "write", failing)
        with pytest.raises(OSError):
            ingest.ingest_batch(later, 1, event_rules(), AS_OF, tables, ["rid"])
    for table in (tables.flat, tables.processed):
        assert sorted(r["event_id"] for r in table.read(spark).collect()) == ["1", "2"]
    ingest.ingest_batch(later, 1, event_rules(), AS_OF, tables, ["rid"])
    for table in (tables.flat, tables.processed):
        assert sorted(r["event_id"] for r in table.read(spark).collect()) == ["1", "2", "3"]


def test_lost_checkpoint_overwrites_nothing(spark, tmp_path):
    source, root = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    write(source, 1, [(1, event(1)), (2, event(2))])
    start(spark, source, str(root))
    (root / "_checkpoint").rename(root / "_checkpoint_lost")
    write(source, 2, [(3, event(3))])
    tables = start(spark, source, str(root))
    assert sorted(r["event_id"] for r in tables.flat.read(spark).collect()) == ["1", "2", "3"]
    again = tables.quarantine.read(spark).filter("array_contains(failed_checks, 'duplicate.id')")
    assert sorted(r["rid"] for r in again.collect()) == [1, 2]  # the source came again, and is told to be a repetition


def test_snapshots_and_conflicts(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    for n in range(2 * commits.SNAPSHOT + 3):
        state = log.state()
        assert state.number == n - 1
        log.commit(state, "q", n, [Entry("t", f"{tmp_path}/t/{n}", {"n": n})], state.entries[:1] if n % 2 else [], {"n": n})
    assert len([p for p in (tmp_path / "_commits").iterdir() if p.name.startswith("snapshot")]) == 2
    state = log.state()
    assert state.batches == {"q": 34} and state.facts == {"n": 34} and len(state.entries) == 35 - 17
    with pytest.raises(commits.Conflict):
        log.commit(State(number=10), "other", 0, [])
    assert log.state() == state


def test_rule_lookback_is_the_default(spark, tmp_path):
    stream = spark.readStream.schema("rid long, raw string").json(str(tmp_path))
    with pytest.raises(ValueError, match="event_time"):
        ingest.validate_stream(stream, event_rules(), AS_OF, str(tmp_path), ["rid"])
    assert ingest.rule_lookback(event_rules()) == 3600


def test_late_rows_leave_the_counters_only(spark, tmp_path):
    """A row behind the watermark is in no counter; the ingest validates it and lists it as late."""
    source, root = tmp_path / "in", str(tmp_path / "counters")
    source.mkdir()

    def put(n, *rows):
        lines = [json.dumps({"rid": r, "raw": event(r), "ts": t}) for r, t in rows]
        (source / f"part-{n}.json").write_text("\n".join(lines))

    def run():
        stream = spark.readStream.schema("rid long, raw string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(source))
        rules = {k: v for k, v in event_rules().items() if k != "duplicate_check"}
        checked = validate(decode(stream), rules, AS_OF, DocumentFields())
        ingest.keep_latest(ingest.counters_stream(checked, "ts"), root, ["hour"], available_now=True).awaitTermination()
        ingest.validate_stream(stream, event_rules(), AS_OF, f"{root}-ingest", ["rid"], event_time="ts", delay=3600, available_now=True).awaitTermination()

    put(1, (1, "2024-01-02 10:00:00"), (2, "2024-01-02 12:00:00"))
    run()
    put(2, (3, "2024-01-02 12:30:00"))
    run()
    put(3, (4, "2024-01-02 08:00:00"), (5, "2024-01-02 12:40:00"))
    run()
    counted = {r["hour"].hour: r["total"] for r in ingest.latest(spark, root, ["hour"]).collect()}
    assert counted == {10: 1, 12: 3}
    tables = ingest.IngestTables(f"{root}-ingest")
    assert tables.results.read(spark).count() == 5 and [r["rid"] for r in tables.late.read(spark).collect()] == [4]


def test_ties_of_a_file_stream_are_told_apart(spark, tmp_path):
    """A1: rows of one micro-batch share the time they were received; their place in the source orders them."""
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.txt").write_text("\n".join([event(1), event(1), event(2), "broken"]))
    (source / "b.txt").write_text("\n".join([event(1), event(3), event(3)]))
    stream = events.read_event_stream(spark, "text", path=str(source))
    assert set(events.ARRIVAL) <= set(stream.columns)
    ingest.validate_stream(stream, event_rules(), AS_OF, root, available_now=True).awaitTermination()
    tables = ingest.IngestTables(root)
    rejected = tables.quarantine.read(spark).collect()
    assert sorted(r["event_id"] for r in rejected) == ["1", "1", "3"] and {tuple(r["failed_checks"]) for r in rejected} == {("duplicate.id",)}
    assert sorted(r["event_id"] for r in tables.flat.read(spark).collect()) == ["1", "2", "3"]
    places = [(r["source"], r["position"]) for r in rejected]
    assert len(set(places)) == 3 and all(p is not None for _, p in places)
    assert tables.dead_letters.read(spark).count() == 1


def test_kafka_records_keep_their_place(spark):
    records = spark.sql("SELECT CAST('{}' AS BINARY) AS value, 't' AS topic, 3 AS partition, 7L AS offset, TIMESTAMP '2024-01-01' AS timestamp")
    row = events.kafka_rows(records).first()
    assert (row["raw"], row["source"], row["part"], row["position"]) == ("{}", "t", 3, 7)
    assert events.with_positions(events.kafka_rows(records)).first()["position"] == 7


def test_updates_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "COMPACTED", 4)
    root = str(tmp_path)
    for n in range(9):
        batch = spark.createDataFrame([("a", n), (f"k{n % 3}", 10 * n)], "key string, value long")
        for _ in range(2):  # a replay changes nothing
            ingest.keep_batch(batch, n, root, ["key"])
    assert {r["key"]: r["value"] for r in ingest.latest(spark, root, ["key"]).collect()} == {"a": 8, "k0": 60, "k1": 70, "k2": 80}
    log = CommitLog(spark, root)
    assert len(log.state().entries) <= 3 and log.read("updates").count() <= 8


def test_rollups_of_batches_are_the_full_aggregate(spark, tmp_path, monkeypatch):
    """Also after compaction, and with late rows."""
    monkeypatch.setattr(ingest, "COMPACTED", 3)
    tables = ingest.IngestTables(str(tmp_path / "out"))
    times = ["2024-01-02 10:00:00", "2024-01-02 10:30:00", "2024-01-02 12:00:00", "2024-01-02 09:59:59", None]
    for n in range(4):
        raws = spark.createDataFrame([(10 * n + i, event(10 * n + i), t) for i, t in enumerate(times)], "rid long, raw string, t string")
        batch = raws.withColumn("ts", F.col("t").cast("timestamp")).drop("t")
        ingest.ingest_batch(batch, n, event_rules(), AS_OF, tables, ["rid"], event_time="ts")
    assert len([e for e in CommitLog(spark, tables.root).state().entries if e.table == "rollup"]) <= 2
    found = {r["hour"] and r["hour"].hour: (r["total"], r["passed"]) for r in rollups.merged(tables.rollup.read(spark)).collect()}
    assert found == {9: (4, 4), 10: (8, 8), 12: (4, 4), None: (4, 4)}


def test_rollup_durations(spark):
    rows = spark.range(500).selectExpr("'PASS' AS status", "timestamp_seconds(id * 100) AS validation_ts", "if(id % 50 = 0, NULL, if(id % 7 = 0, 0D, CAST(id * 3 AS DOUBLE))) AS ms")
    parts = rollups.hourly_rollup(rows.filter("ms < 600 OR ms IS NULL"), milliseconds="ms").unionByName(rollups.hourly_rollup(rows.filter("ms >= 600"), milliseconds="ms"))
    got, want = rollups.durations(parts).collect(), duration_histogram(rows, "ms").collect()
    assert [(r["le"], r["cumulative_count"], round(r["duration_sum"], 6), r["duration_count"]) for r in got] == [
        (r["le"], r["cumulative_count"], round(r["duration_sum"], 6), r["duration_count"]) for r in want
    ]
    for start, end in (("1970-01-01 00:10:00", "1970-01-01 07:30:00"), ("1970-01-01 02:00:00", "1970-01-01 02:30:00"), ("1970-01-01 01:00:00", "1970-01-01 05:00:00")):
        got = rollups.stats_between(parts, rows, start, end, milliseconds="ms").first().asDict()
        want = stats_between(rows, start, end, "ms").first().asDict()
        assert {k: round(v, 9) if isinstance(v, float) else v for k, v in got.items()} == {k: round(v, 9) if isinstance(v, float) else v for k, v in want.items()}


def test_flat_columns_are_made_once_and_copies_released(spark, tmp_path, monkeypatch):
    """Rows and rejects come from one held copy of the flat columns; what is no longer read is given back."""
    held, seen = [], []
    hold, rejects = ingest.Attempt.hold, ingest.flat_rejects
    monkeypatch.setattr(ingest.Attempt, "hold", lambda self, df: held.append(hold(self, df)) or held[-1])

    def watched(flattened):
        seen.append((flattened.storageLevel.useMemory, sum(df.storageLevel.useMemory for df in held)))
        return rejects(flattened)

    monkeypatch.setattr(ingest, "flat_rejects", watched)
    batch = spark.createDataFrame([(1, event(1)), (2, event(2, id=None)), (3, event(1))], "rid long, raw string")
    ingest.ingest_batch(batch, 0, event_rules(), AS_OF, ingest.IngestTables(str(tmp_path)), ["rid"])
    # checked rows and flat columns; the decoded rows are given back
    assert seen == [(True, 2)]
    assert not any(df.storageLevel.useMemory for df in held)
