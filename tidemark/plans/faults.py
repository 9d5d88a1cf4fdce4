"""Deterministic fault injection over the clean test tables (see FIXTURES.md, section 3).

The statements are the contract between queries and oracles: both engines run
the same text, so both start from identical faulty rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.once import evaluate_once
from tidemark.functions.paths import parse_document

AS_OF = "2024-01-30 00:00:00"

EVENT_DOCS_SQL = """
SELECT event_id AS rid, ts, '{' ||
 CASE WHEN event_id % 101 = 0 THEN '' WHEN event_id % 103 = 0 THEN '"id":null,'
      WHEN event_id % 107 = 0 THEN '"id":' || CAST(event_id AS STRING) || ','
      WHEN event_id % 109 = 0 THEN '"id":"ev-' || CAST(event_id AS STRING) || '",'
      WHEN event_id % 113 = 0 THEN '"id":"",'
      WHEN event_id % 211 = 0 THEN '"id":["x"],'
      WHEN event_id % 29 = 0 THEN '"id":"' || CAST(event_id - 1 AS STRING) || '",'
      ELSE '"id":"' || CAST(event_id AS STRING) || '",' END ||
 CASE WHEN event_id % 127 = 0 THEN '"type":"OddEvent",'
      ELSE '"type":"' || CASE event_type WHEN 'click' THEN 'PushEvent' WHEN 'view' THEN 'IssuesEvent'
           WHEN 'purchase' THEN 'PullRequestEvent' WHEN 'signup' THEN 'ForkEvent' ELSE 'WatchEvent' END || '",' END ||
 CASE WHEN event_id % 131 = 0 THEN '"actor":null,'
      ELSE '"actor":{"id":' ||
           CASE WHEN event_id % 137 = 0 THEN '"7"' WHEN event_id % 139 = 0 THEN '0'
                WHEN event_id % 149 = 0 THEN 'true' WHEN event_id % 151 = 0 THEN '1.5'
                ELSE CAST(user_id + 1 AS STRING) END ||
           ',"login":"' || CASE WHEN event_id % 157 = 0 THEN '-bad' ELSE 'user' || CAST(user_id AS STRING) END || '"' ||
           CASE WHEN event_id % 163 = 0 THEN '' ELSE ',"url":"u/' || CAST(user_id AS STRING) || '"' END ||
           ',"avatar_url":"a/' || CAST(user_id AS STRING) || '"},' END ||
 '"repo":{"id":' || CAST(user_id % 20 + 1 AS STRING) || ',"name":"' ||
           CASE WHEN event_id % 167 = 0 THEN 'noslash' ELSE 'org/r' || CAST(user_id % 20 AS STRING) END || '","url":"r"},' ||
 CASE WHEN event_id % 173 = 0 THEN '' WHEN event_id % 179 = 0 THEN '"public":"yes",' ELSE '"public":true,' END ||
 CASE WHEN event_id % 181 = 0 THEN '' WHEN event_id % 191 = 0 THEN '"payload":{},'
      ELSE '"payload":{"ref":"main","action":"open","issue":{"n":1},"pull_request":{},"forkee":null,"push_id":' ||
           CAST(event_id AS STRING) ||
           CASE WHEN event_id % 19 = 0 THEN '' ELSE ',"commits":[1,2]' END ||
           CASE WHEN ts >= TIMESTAMP '2024-01-29 00:00:00' THEN ',"beta":true' ELSE ',"legacy":1' END ||
           ',"k":' || CASE WHEN ts >= TIMESTAMP '2024-01-29 00:00:00' THEN '"s"' ELSE '5' END ||
           ',"size":' || CAST(event_id % 40 + CASE WHEN ts >= TIMESTAMP '2024-01-29 00:00:00' THEN 30 ELSE 0 END AS STRING) || '},' END ||
 '"created_at":' ||
 CASE WHEN event_id % 193 = 0 THEN '"not-a-date"' WHEN event_id % 197 = 0 THEN '"2030-01-01T00:00:00Z"'
      WHEN event_id % 199 = 0 THEN '"2010-01-01T00:00:00Z"' WHEN event_id % 223 = 0 THEN '12345'
      WHEN event_id % 227 = 0 THEN '"2024-01-10T00:00:00.250Z"'
      ELSE '"' || replace(substr(CAST(ts AS STRING), 1, 19), ' ', 'T') || 'Z"' END || '}' AS raw
FROM events
"""

DIRTY_EVENTS_SQL = """
SELECT event_id, ts, props,
 CASE WHEN event_id % 67 = 0 THEN NULL
      WHEN ts >= TIMESTAMP '2024-01-29 00:00:00' AND event_id % 3 = 0 THEN NULL ELSE user_id END AS user_id,
 CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN '' WHEN event_id % 83 = 0 THEN 'refund'
      WHEN ts >= TIMESTAMP '2024-01-29 00:00:00' AND event_id % 2 = 0 THEN 'purchase' ELSE event_type END AS event_type,
 CASE WHEN event_id % 79 = 0 THEN NULL WHEN event_id % 73 = 0 THEN -value
      WHEN event_id % 71 = 0 THEN CAST('NaN' AS DOUBLE)
      WHEN ts >= TIMESTAMP '2024-01-29 00:00:00' THEN value * 5 ELSE value END AS value
FROM events
"""


#: Session setting: tasks that event documents are dealt to, by default one for each core.
SCAN_TASKS = "tidemark.scan.tasks"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to the number of tasks in ``SCAN_TASKS``, or to one for each core.

    A file is read by as many tasks as it has row groups at most, and a row group holds
    up to a million events: the costly steps on documents would leave most cores idle.
    The narrow table rows are exchanged, not the documents. Nothing is looked up in the data.
    """
    spark = df.sparkSession
    return df.repartition(int(spark.conf.get(SCAN_TASKS, None) or spark.sparkContext.defaultParallelism))


def _over_events(spark: SparkSession, events: DataFrame, sql: str) -> DataFrame:
    view = f"events_{uuid.uuid4().hex}"
    events.createOrReplaceTempView(view)
    out = spark.sql(sql.replace("FROM events", f"FROM {view}"))
    spark.catalog.dropTempView(view)
    return out


def event_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rid, ts, raw``: one JSON text per event, with faults."""
    return over_documents(spark, table(spark, sf_dir, "events"))


def over_documents(spark: SparkSession, events: DataFrame) -> DataFrame:
    """``event_text`` of an events table or stream."""
    return _over_events(spark, dealt(events.select("event_id", "ts", "user_id", "event_type")), EVENT_DOCS_SQL)


def event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rid, ts, raw, doc`` with the text parsed once into a VARIANT."""
    return evaluate_once(event_text(spark, sf_dir), doc=parse_document("raw"))


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return _over_events(spark, dealt(events) if spark.conf.get(SCAN_TASKS, None) else events, DIRTY_EVENTS_SQL)
