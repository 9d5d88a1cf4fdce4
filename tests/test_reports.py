import json

from tidemark.operators import drift_reports
from tidemark.sources.events import ingest_stats


def test_report_json(spark):
    columns = "drift_type string, entity string, field_name string, metric_name string, drift_score double, severity string"
    columns += ", baseline_value string, current_value string, metadata string, detected_at timestamp"
    rows = spark.createDataFrame([], columns).unionByName(
        spark.sql(
            """SELECT 'schema' AS drift_type, 'e' AS entity, 'f' AS field_name, 'm' AS metric_name, 0.5D AS drift_score,
            'INFO' AS severity, CAST(NULL AS STRING) AS baseline_value, 'say "x"' AS current_value, metadata,
            TIMESTAMP '2024-01-30 00:00:00' AS detected_at FROM VALUES ('{"top": [1, 2]}'), ('not json'), (NULL) AS t(metadata)"""
        )
    )
    found = [json.loads(r.finding) for r in drift_reports.report_json(rows).collect()]
    assert [f.pop("metadata") for f in found] == [{"top": [1, 2]}, None, None]
    assert all(f.pop("detected_at").startswith("2024-01-30T00:00:00") for f in found)
    expected = {
        "drift_type": "schema", "entity": "e", "field_name": "f", "metric_name": "m", "drift_score": 0.5, "severity": "INFO",
        "baseline_value": None, "current_value": 'say "x"',
    }
    assert found == [expected] * 3
    assert drift_reports.report_json(rows.limit(0)).count() == 0


def test_ingest_rate(spark):
    rows = spark.createDataFrame([("ab",), ("é",), (None,)], "raw string")
    assert ingest_stats(rows).first().asDict() == {"messages": 3, "bytes": 4}
    assert ingest_stats(rows, seconds=1.5).first().messages_per_second == 2.0
    assert ingest_stats(rows, seconds=0).first().messages_per_second == 0.0
