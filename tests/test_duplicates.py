"""Duplicate operators against brute force, with one key holding a third of the rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import duplicates


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    start = datetime(2024, 1, 1)
    out = []
    for n in range(3000):
        key = "hot" if n % 3 == 0 else (None if n % 50 == 1 else f"k{rng.randrange(400)}")
        out.append((n, key, start + timedelta(seconds=rng.randrange(400_000))))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, ts timestamp").repartition(8)


def test_seen_before(frame, rows):
    seen, want = set(), {}
    for n, key, _ in rows:
        want[n] = key is not None and key in seen
        seen.add(key)
    got = duplicates.mark_duplicates(frame, F.col("key"), ["id"], "dup").collect()
    assert {r["id"]: r["dup"] for r in got} == want


@pytest.mark.parametrize("seconds", [60, 3600, 100_000])
def test_within_lookback(frame, rows, seconds):
    last, want = {}, {}
    for n, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        want[n] = key is not None and key in last and (ts - last[key]).total_seconds() < seconds
        last[key] = ts
    got = duplicates.mark_duplicates_within(frame, ["key"], "ts", ["id"], seconds, "dup").collect()
    assert {r["id"]: r["dup"] for r in got} == want


def test_insert_if_absent(spark, frame, rows):
    target = spark.createDataFrame([("hot",), ("k1",), (None,)], "key string")
    first = {}
    for n, key, _ in rows:
        if key is None:
            first[("null", n)] = n
        elif key not in ("hot", "k1"):
            first.setdefault(key, n)
    got = duplicates.insert_if_absent(frame, target, "key", ["id"]).collect()
    assert sorted(r["id"] for r in got) == sorted(first.values())


def test_against_history(spark):
    t = datetime(2024, 1, 1)
    history = spark.createDataFrame([("a", t, 1), ("b", t - timedelta(hours=3), 2)], "key string, ts timestamp, id long")
    batch = spark.createDataFrame(
        [("a", t + timedelta(minutes=5), 10), ("b", t, 11), ("b", t + timedelta(minutes=1), 12), ("c", t, 13)],
        "key string, ts timestamp, id long",
    )
    got = duplicates.duplicates_against_history(batch, history, ["key"], "ts", ["id"], 3600, "dup").collect()
    assert {r["id"]: r["dup"] for r in got} == {10: True, 11: False, 12: True, 13: False}
