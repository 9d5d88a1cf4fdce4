"""Text and timestamp forms against Python itself."""

import random

from pyspark.sql import functions as F

from tidemark.functions.pytext import float_text, iso_timestamp, strict_utc_timestamp


def test_float_text(spark):
    rng = random.Random(7)
    values = [0.0, 1.0, -1.5, 1e7, 12345678.9, 1e15, 1e16, 1.5e300, 1e-3, 1e-4, 9.9e-5, -1e-7, 123456789012345.6, 0.1 + 0.2]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 18) for _ in range(300)]
    values += [float("inf"), float("-inf"), float("nan")]
    rows = spark.createDataFrame([(v,) for v in values], "d double").select("d", F.expr(float_text("d")).alias("t")).collect()
    # The JVM prints some doubles with one digit too many; the text must still be the same number.
    for row in rows:
        if row["t"] != str(row["d"]):
            assert float(row["t"]) == row["d"], row


#: Texts and the instants they mean in UTC, worked out by hand; None where they mean none.
INSTANTS = {
    "2024-01-10T00:00:00Z": "2024-01-10 00:00:00",
    "2024-01-10T00:00:00.250Z": "2024-01-10 00:00:00.25",
    "2024-01-10 01:02:03": "2024-01-10 01:02:03",
    "2024-01-10": "2024-01-10 00:00:00",
    "2024-01-10T01:02": "2024-01-10 01:02:00",
    "2024-01-10T01": "2024-01-10 01:00:00",
    "2024-01-10T01:02:03+05:30": "2024-01-09 19:32:03",
    "2024-01-10T01:02:03-0800": "2024-01-10 09:02:03",
    "2024-01-10T01:02:03+02": "2024-01-09 23:02:03",
    "2024-01-10T01:02:03+05:30:15": "2024-01-09 19:31:48",
    "20240110": "2024-01-10 00:00:00",
    "20240110T010203": "2024-01-10 01:02:03",
    "20240110T010203.5Z": "2024-01-10 01:02:03.5",
    "2024-W02-3": "2024-01-10 00:00:00",
    "2024W023": "2024-01-10 00:00:00",
    "2024-W02": "2024-01-08 00:00:00",
    "2020-W53-7": "2021-01-03 00:00:00",
    "2021-W53-1": None,
    "2024-W00-1": None,
    "2024-1-5": "2024-01-05 00:00:00",
    "2024-1-5 1:2:3": "2024-01-05 01:02:03",
    "2024-01-10x01:02:03": "2024-01-10 01:02:03",
    "2024-01-10T01:02:03,5": "2024-01-10 01:02:03.5",
    "2024-01-10T01:02:03.123456789": "2024-01-10 01:02:03.123456",
    "0001-01-01": "0001-01-01 00:00:00",
    "2025": None,
    "2024-02-30": None,
    "2024-13-01": None,
    "2024-01-10T25:00:00": None,
    "2024-01-10T01:60:00": None,
    "0000-01-01": None,
    "x": None,
    "": None,
    "2024-01-10T": None,
    "12345": None,
}


def test_iso_timestamp(spark):
    rows = spark.createDataFrame([(t,) for t in INSTANTS], "t string").select(
        "t", F.expr(f"CAST({iso_timestamp('t')} AS STRING)").alias("p")
    ).collect()
    assert {r["t"]: r["p"] for r in rows} == INSTANTS


def test_strict_timestamp(spark):
    texts = ["2024-01-10T00:00:00Z", "2024-01-10T00:00:00.1Z", "2024-01-10 00:00:00", "2024-01-10T00:00:00+00:00", "2024-1-2T3:4:5Z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.expr(strict_utc_timestamp("t")).alias("p")).collect()
    assert [r["p"] is not None for r in rows] == [True, False, False, False, True]
