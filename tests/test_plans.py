"""Plans: no Python on rows, one parse per row, predicates at the scan."""

from datetime import datetime

import pytest

from tests.conftest import SF_DIR
from tidemark.operators import drift, ranks, windows
from tidemark.plans import catalogue
from tidemark.plans.faults import AS_OF, table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["validate_status", "schema_profile", "percentiles", "ks_two_sample", "drift_run", "dup_lookback"])
def test_no_python_on_rows(spark, name):
    text = plan(catalogue.QUERIES[name](spark, SF_DIR))
    assert "Python" not in text and "ArrowEval" not in text and "CartesianProduct" not in text


def test_status_filter_does_not_repeat_the_parse(spark):
    from tidemark.functions.paths import DocumentFields
    from tidemark.operators.validate import validate
    from tidemark.plans.event_rules import event_rules, without

    docs = catalogue.event_docs(spark, SF_DIR)
    checked = validate(docs, without(event_rules(), "duplicate_check"), AS_OF, DocumentFields())
    assert plan(checked.filter("status = 'FAIL'").select("rid")).count("parseJson") == 1


def test_duplicates_are_found_in_one_decode(spark, monkeypatch):
    """One pass decodes and lands the checked rows; keys and results come from the narrow table."""
    from tidemark.operators import validate

    passes = []
    plain = validate.landed_table

    def watched(df):
        passes.append(plan(df))
        return plain(df)

    monkeypatch.setattr(validate, "landed_table", watched)
    last = plan(catalogue.QUERIES["validate_status"](spark, SF_DIR))
    assert [p.count("parseJson") for p in passes] == [1] and "parseJson" not in last
    keys = [line for line in last.splitlines() if "ReadSchema" in line or "FileScan" in line]
    assert any("__key" in line and "failures" not in line.split("ReadSchema")[-1] for line in keys)


def test_time_windows_reach_the_scan(spark):
    baseline, current = windows.drift_windows(AS_OF)
    text = plan(windows.tag_windows(table(spark, SF_DIR, "events"), "ts", baseline, current).select("event_id", "window"))
    pushed = text.split("PushedFilters: ")[1]
    assert "GreaterThanOrEqual(ts" in pushed and "ReadSchema: struct<event_id:bigint,ts" in text


def test_drift_run_reads_and_decodes_twice(spark, monkeypatch):
    """One pass lands the configured fields, one profiles the leaves; counts come without decoding."""
    passes = []
    plain = drift.landed

    def watched(df):
        passes.append(plan(df))
        return plain(df)

    monkeypatch.setattr(drift, "landed", watched)
    passes.append(plan(catalogue.QUERIES["drift_run_documents"](spark, SF_DIR)))
    assert len(passes) == 2
    assert sum(p.count("FileScan") for p in passes) == 2 and sum(p.count("parseJson") for p in passes) == 2


def test_percentiles_exchange_values_of_few_cells_only(spark):
    text = plan(catalogue.QUERIES["percentiles_lineitem"](spark, SF_DIR))
    exchanges = [n for n, line in enumerate(text.splitlines()) if "Exchange hashpartitioning(" in line and "value#" in line.split("ENSURE")[0]]
    assert exchanges
    below = "\n".join(text.splitlines()[exchanges[0] :])
    assert "LeftSemi" in below and text.index("LeftSemi") < text.rindex("FileScan")


@pytest.mark.parametrize("cells", [2, 16, 256])
def test_distance_opens_few_cells(spark, cells):
    """Bounds of cell counts leave few cells; the distance is that of all values."""
    values = spark.range(20_000).selectExpr(
        "if(id % 3 = 0, 'current', 'baseline') AS window", "'f' AS field", "if(id % 3 = 0, pow(id % 997, 1.1), id % 997) * 1.0D AS value"
    )
    bounds = ranks.distance_bounds(ranks.with_cells(values, ["field"], cells=cells), ["field"]).collect()
    known = max(r["least"] for r in bounds)
    if cells == 256:
        assert 0 < len([r for r in bounds if r["most"] > known]) < 16
    found = ranks.largest_distance(values, ["field"], cells).first()
    rows = sorted((r["value"], r["window"] == "baseline") for r in values.collect())
    total = {True: sum(b for _, b in rows), False: sum(not b for _, b in rows)}
    seen, most = {True: 0, False: 0}, 0.0
    for n, (value, b) in enumerate(rows):
        seen[b] += 1
        if n + 1 == len(rows) or rows[n + 1][0] != value:
            most = max(most, abs(seen[True] / total[True] - seen[False] / total[False]))
    assert found["statistic"] == pytest.approx(most, abs=1e-12)
    assert (found["total_b"], found["total_c"]) == (total[True], total[False])


def test_documents_of_one_row_group_are_made_by_every_core(spark, tmp_path):
    from tidemark.plans import faults

    rows = [(n, datetime(2024, 1, 1), n, "click") for n in range(100)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    tasks = spark.conf.get(faults.SCAN_TASKS)
    spark.conf.unset(faults.SCAN_TASKS)
    try:
        text = faults.event_text(spark, str(tmp_path))
        assert text.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
        assert text.count() == 100
    finally:
        spark.conf.set(faults.SCAN_TASKS, tasks)
