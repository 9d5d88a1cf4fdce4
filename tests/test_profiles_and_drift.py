"""Profiles, ranks, tests and detectors on worked examples and against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.paths import DocumentFields, TableFields, flatten_document
from tidemark.operators import batch_drift, drift, profiles, results, windows

BASELINE, CURRENT = windows.drift_windows("2024-01-30 00:00:00")


def both(spark, baseline, current, schema="field string, value double"):
    b = spark.createDataFrame(baseline, schema).withColumn("window", F.lit("baseline"))
    return b.unionByName(spark.createDataFrame(current, schema).withColumn("window", F.lit("current")))


def test_percentiles_worked(spark):
    values = both(spark, [("x", v) for v in (1.0, 2.0, 3.0, 10.0)], [("x", 5.0)])
    rows = {r["window"]: r for r in profiles.numeric_profile(values).collect()}
    b, c = rows["baseline"], rows["current"]
    assert (b["p50"], round(b["p95"], 6), round(b["p99"], 6), b["std"]) == (2.5, 8.95, 9.79, 3.5355)
    assert (c["p50"], c["p95"], c["p99"], c["std"]) == (5.0, 5.0, 5.0, 0.0)


@pytest.mark.parametrize("shape", ["uniform", "skewed", "few"])
def test_percentiles_against_numpy(spark, shape):
    rng = np.random.default_rng(3)
    data = {
        "uniform": rng.normal(1e9, 1, 20_000),
        "skewed": np.where(rng.random(20_000) < 0.4, 7.0, rng.pareto(1, 20_000) * 1e6 - 5e5),
        "few": rng.integers(0, 3, 500).astype(float),
    }[shape]
    values = spark.createDataFrame([("w", "x", float(v)) for v in data], "window string, field string, value double")
    row = profiles.numeric_percentiles(values, [0, 1, 50, 95, 99, 100]).collect()[0]
    for p in (0, 1, 50, 95, 99, 100):
        assert row[f"p{p}"] == pytest.approx(np.percentile(data, p), rel=1e-12)


def test_ks_against_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 1, 3000).round(2), np.where(rng.random(900) < 0.35, 0.5, rng.normal(0.2, 1.2, 900).round(2))
    values = both(spark, [("x", float(v)) for v in a], [("x", float(v)) for v in b])
    row = batch_drift.ks_two_sample(values).collect()[0]
    grid = np.union1d(a, b)
    want = np.max(np.abs(np.searchsorted(np.sort(a), grid, "right") / a.size - np.searchsorted(np.sort(b), grid, "right") / b.size))
    assert row["statistic"] == pytest.approx(want, abs=1e-12) and row["severity"] == "WARNING"


def test_capped_cardinality_beyond_the_sketch(spark, documents):
    rows = spark.range(20_000).selectExpr(
        "'baseline' AS window", "id", "TIMESTAMP '2024-01-25 00:00:00' AS ts",
        "concat('{\"many\":', id, ',\"few\":\"', id % 7, '\",\"edge\":', id % 999, ',\"cap\":', id % 1000, ',\"none\":null,\"empty\":{},\"list\":[1,2]}') AS raw",
    ).selectExpr("window", "ts", "try_parse_json(raw) AS doc")
    profile = profiles.schema_profile(flatten_document(rows), profiles.row_counts(rows))
    got = {r["field"]: (r["type"], r["nullable"], r["cardinality"], r["cardinality_exact"]) for r in profile.collect()}
    assert got == {
        "many": ("int", False, 1000, False),
        "few": ("str", False, 7, True),
        "edge": ("int", False, 999, True),
        "cap": ("int", False, 1000, False),
        "none": ("null", True, 0, True),
        "list": ("str", False, 1, True),
    }


def test_flatten_opens_every_level(documents):
    keys = [f"k{i}" for i in range(1, 13)]
    deep = "".join(f'{{"{k}":' for k in keys) + "1" + "}" * 12
    docs = documents(deep, '{"a":{"b":{}},"x":2,"odd <key>":{"y>":"s"},"l":[{"z":{"w":1}}],"n":null}')
    got = {r["path"]: (r["kind"], r["text"]) for r in flatten_document(docs.select("rid", "doc")).collect()}
    assert got == {
        ".".join(keys): ("int", "1"), "x": ("int", "2"), "odd <key>.y>": ("str", "s"), "l": ("str", "<array[1]>"), "n": ("NoneType", None),
    }
    profile = profiles.schema_profile(
        flatten_document(docs.selectExpr("'baseline' AS window", "TIMESTAMP'2024-01-01' AS ts", "doc")),
        profiles.row_counts(docs.selectExpr("'baseline' AS window")),
    )
    assert ".".join(keys) in {r["field"] for r in profile.collect()}


def test_flatten_of_nothing(documents):
    assert flatten_document(documents("x").select("rid", "doc").limit(0)).count() == 0


def test_dominant_type_tie_goes_to_the_first_seen(spark):
    rows = spark.sql(
        "SELECT 'baseline' AS window, ts, try_parse_json(raw) AS doc FROM VALUES "
        "(TIMESTAMP '2024-01-25 00:00:01', '{\"a\":\"x\"}'), (TIMESTAMP '2024-01-25 00:00:00', '{\"a\":1}') AS t(ts, raw)"
    )
    profile = profiles.schema_profile(flatten_document(rows), profiles.row_counts(rows)).collect()
    assert profile[0]["type"] == "int"


def test_psi_worked(spark):
    cats = both(spark, [("t", "a", 0.5), ("t", "b", 0.5)], [("t", "a", 0.9), ("t", "b", 0.1)], "field string, value string, proportion double")
    row = drift.psi_comparisons(cats).collect()[0]
    assert round(row["measure"], 6) == 0.878890 and (row["severity"], row["drift_score"]) == ("CRITICAL", 1.0)
    assert '"a":0.9' in row["current_value"]


def test_psi_ignores_fields_of_one_window(spark):
    cats = both(spark, [("t", "a", 1.0)], [("u", "a", 1.0)], "field string, value string, proportion double")
    assert {r["field_name"]: (r["severity"], r["checks"]) for r in drift.psi_comparisons(cats).collect()} == {
        "t": ("NONE", 1), "u": ("NONE", 0),
    }


def test_mean_shift_and_null_ratio_worked(spark):
    stats = both(spark, [("x", 10.0, 2.0), ("flat", 1.0, 0.0)], [("x", 15.0, 9.0), ("flat", 99.0, 1.0)], "field string, mean double, std double")
    got = {r["field_name"]: (r["severity"], r["drift_score"]) for r in drift.mean_shift_comparisons(stats).collect()}
    assert got == {"x": ("WARNING", 0.5), "flat": ("NONE", 0.0)}
    nulls = both(spark, [("x", 0.05)], [("x", 0.20)], "field string, null_ratio double")
    row = drift.null_ratio_comparisons(nulls).collect()[0]
    assert row["severity"] == "WARNING" and row["drift_score"] == pytest.approx(0.3)


def test_cardinality_growth_worked(spark):
    schema = "field string, type string, nullable boolean, presence_ratio double, cardinality long"
    profile = both(
        spark,
        [("w", "int", False, 1.0, 10), ("c", "int", False, 1.0, 10), ("gone", "str", False, 0.5, 1), ("t", "int", False, 1.0, 5)],
        [("w", "int", False, 1.0, 20), ("c", "int", False, 1.0, 50), ("new", "str", True, 1.0, 1), ("t", "str", False, 1.0, 10)],
        schema,
    )
    found = drift.findings(drift.schema_comparisons(profile)).collect()
    got = sorted((r["field_name"], r["metric_name"], r["severity"], r["drift_score"]) for r in found)
    assert got == [
        ("c", "cardinality_explosion", "CRITICAL", 0.5),
        ("gone", "field_removed", "CRITICAL", 1.0),
        ("new", "field_added", "INFO", 0.5),
        ("t", "cardinality_explosion", "WARNING", 0.2),
        ("t", "type_change", "CRITICAL", 1.0),
        ("w", "cardinality_explosion", "WARNING", 0.2),
    ]


def test_rates_and_entities_worked(spark):
    counts = spark.createDataFrame([(16800, 3120)], "baseline_rows long, current_rows long")
    row = drift.global_rate_comparison(counts, BASELINE, CURRENT).collect()[0]
    assert round(row["measure"], 6) == 3.0 and (row["severity"], round(row["drift_score"], 6)) == ("CRITICAL", 0.6)
    history = spark.createDataFrame([(16800,), (16800,)], "n long")
    row = drift.global_rate_comparison(counts, BASELINE, CURRENT, history=history).collect()[0]
    assert round(row["measure"], 6) == 3.0
    history = spark.createDataFrame([(16800,), (33600,)], "n long")
    row = drift.global_rate_comparison(counts, BASELINE, CURRENT, history=history).collect()[0]
    assert round(row["measure"], 6) == round((130 - 150) / 50, 6) and row["severity"] == "WARNING"
    entities = both(
        spark, [("f", v, 100, n + 1) for n, v in enumerate("abcd")],
        [("f", "a", 160, 1), ("f", "b", 125, 2), ("f", "c", 110, 3), ("f", "e", 1, 4)],
        "field string, value string, n long, rank int",
    )
    got = {r["field_name"]: (r["severity"], round(r["drift_score"], 6)) for r in drift.findings(drift.entity_comparisons(entities)).collect()}
    assert got == {"a": ("WARNING", 0.6), "b": ("INFO", 0.25)}


def test_chi_square_worked(spark):
    schema = "field string, value string, n long"
    counts = both(spark, [("t", v, 200) for v in "abc"], [("t", "a", 10), ("t", "b", 20), ("t", "c", 30)], schema)
    row = batch_drift.chi_square(counts).collect()[0]
    assert (round(row["statistic"], 6), row["freedom"], round(row["p_value"], 6), row["drift_detected"]) == (10.0, 2, 0.006738, True)
    unseen = both(spark, [("t", "a", 5)], [("t", "b", 5)], schema)
    assert batch_drift.chi_square(unseen).collect()[0]["p_value"] == 0.0


def test_numeric_drift_becomes_failure_rows(spark):
    moved = [("moved", float(i % 100)) for i in range(1000)], [("moved", float(i % 100 + 40)) for i in range(500)]
    same = [("same", float(i % 100)) for i in range(1000)], [("same", float(i % 100)) for i in range(500)]
    gone = [("gone", 1.0)] * 9, []
    values = both(spark, moved[0] + same[0] + gone[0], moved[1] + same[1] + gone[1])
    bins = batch_drift.histogram_compare(values, 20)
    ks = batch_drift.ks_two_sample(values)
    counts = both(spark, [("t", v, 200) for v in "abc"], [("t", "a", 10), ("t", "b", 20), ("t", "c", 30)], "field string, value string, n long")
    rows = batch_drift.distribution_drift_failures(batch_drift.chi_square(counts), ks=ks, histograms=bins).collect()
    assert sorted((r["check_name"], r["field_path"]) for r in rows) == [
        ("drift.distribution.histogram.moved", "moved"), ("drift.distribution.ks.moved", "moved"), ("drift.distribution.t", "t"),
    ]
    table = np.array([[r["baseline_n"], r["current_n"]] for r in bins.filter("field = 'moved'").collect()], float)
    expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    got = {r["field"]: r for r in batch_drift.histogram_test(bins).collect()}
    assert got["moved"]["statistic"] == pytest.approx(((table - expected) ** 2 / expected).sum()) and got["moved"]["freedom"] == len(table) - 1
    assert sorted(got) == ["moved", "same"] and got["same"]["p_value"] == pytest.approx(1.0)


def test_gate_shuts_on_small_windows(spark):
    tagged = both(spark, [("x", 1.0)] * 3, [("x", 1.0)] * 2)
    sizes = windows.window_counts(tagged)
    assert windows.gate(sizes, tagged, 2).count() == 1
    assert windows.gate(sizes, tagged, 3).count() == 0


def test_empty_results(spark):
    empty = spark.createDataFrame([], "event_id string, status string, failed_checks array<string>, processing_time_ms double, validation_ts timestamp")
    assert results.run_stats(empty).collect()[0]["pass_rate"] == 0
    alerts = results.alert_conditions(empty, "processing_time_ms").collect()[0]
    assert alerts["no_data"] and not alerts["high_failure_rate"]
    assert results.stats_between(empty).collect()[0]["total"] == 0


def test_recent_results_default_tie_break(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES ('a', 'FAIL', array('x'), TIMESTAMP '2024-01-01 00:00:00'), ('b', 'WARN', array('x', 'y'), "
        "TIMESTAMP '2024-01-01 00:00:00'), ('c', 'PASS', array(), TIMESTAMP '2024-01-02 00:00:00') AS t(event_id, status, failed_checks, validation_ts)"
    )
    got = results.recent_results(rows, 1)
    assert got.columns == ["event_id", "status", "failures", "validation_ts"] and got.collect()[0]["event_id"] == "b"


@pytest.mark.parametrize("tracked, spread", [(64, 3), (65_536, 1), (64, 1)])
def test_top_entities_of_many_values(spark, tracked, spread):
    """Candidates of a summary, counted exactly; where its bound does not decide, all values are."""
    values = spark.range(60_000).selectExpr(
        "if(id % 2 = 0, 'baseline', 'current') AS window", "'f' AS field",
        f"if(id % {spread} = 0 OR id % 7 = 0, concat('v', CAST(id % 40 * (id % 40) DIV 60 AS STRING)), concat('r', id)) AS value",
        "timestamp_seconds(id) AS ts",
    )
    summaries = profiles.value_summaries(values, 5, 100, tracked)
    got = profiles.entity_top_values(values, summaries, 5).collect()
    want = profiles.entity_top_n(profiles.value_counts(values.withColumnRenamed("value", "f"), TableFields(values.withColumnRenamed("value", "f")), ["f"]), 5)
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect())) and len(got) == 10
    if tracked > 1000:
        assert all(s.bound < 60_000 / 40 for s in summaries.values())


def test_summaries_bound_what_they_do_not_name(spark):
    values = spark.range(30_000).selectExpr("'baseline' AS window", "'f' AS field", "concat('v', CAST(sqrt(id) AS INT)) AS value", "timestamp_seconds(id) AS ts")
    for tracked in (16, 64, 512):
        (summary,) = profiles.value_summaries(values, 2, 100, tracked).values()
        counts = {r["value"]: r["count"] for r in values.groupBy("value").count().collect()}
        assert summary.total == 30_000 and all(n <= summary.bound for v, n in counts.items() if v not in summary.top)


def test_fields_beyond_the_category_limit_are_not_counted(spark):
    values = spark.range(5_000).selectExpr(
        "'baseline' AS window", "inline(array(named_struct('field', 'few', 'value', CAST(id % 9 AS STRING)), named_struct('field', 'many', 'value', CAST(id AS STRING))))",
    ).withColumn("ts", F.current_timestamp())
    summaries = profiles.value_summaries(values, 3, 100)
    counts = profiles.counts_of_narrow(values, summaries, 100)
    assert {r["field"] for r in counts.collect()} == {"few"} and counts.count() == 9
    assert {f for (_, f), s in summaries.items() if s.distinct > 100} == {"many"}


def test_flatten_needs_no_look_at_the_data(spark):
    """The plan is built without a pass over the documents, so it also runs on a stream."""
    stream = spark.readStream.format("rate").load().selectExpr("value AS rid", """try_parse_json('{"a": {"b": 1}}') AS doc""")
    assert flatten_document(stream).isStreaming


def test_flatten_of_documents_deeper_than_the_chain(documents):
    rows = documents(
        '{"a":{"b":{"c":{"d":{"e":{"f":{"g":[1,{"h":2}],"i":{},"j":null}}}}}}}',
        '{"":{"":{"":{"":{"":{"x":1}}}}},"{{":"{{{{"}',
        '{"a":{"b":{"c":{"d":{"e":{}}}}}}',
        '[{"a":1}]',
    )
    got = sorted((r["rid"], r["path"], r["kind"], r["text"]) for r in flatten_document(rows.select("rid", "doc")).collect())
    assert got == [
        (0, "a.b.c.d.e.f.g", "str", "<array[2]>"),
        (0, "a.b.c.d.e.f.j", "NoneType", None),
        (1, "x", "int", "1"),
        (1, "{{", "str", "{{{{"),
    ]
