"""Catalogue queries: every operator over the whole test tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame. Lists are joined
to text and floats rounded so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.paths import (
    DocumentFields,
    TableFields,
    flatten_document,
    flatten_table,
    missing_fields,
    present_fields,
)
from tidemark.functions.severity import severity_sql
from tidemark.operators import adhoc, batch_drift, drift, drift_reports, duplicates, profiles, results, rollups, validate as v, windows
from tidemark.plans.event_rules import event_rules, only, without
from tidemark.plans.faults import AS_OF, dirty_events, event_docs, event_text, over_documents, table
from tidemark.session import configure, work_folder
from tidemark.sources import events as ev, flat_events as fl, sinks
from tidemark.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(make: Query) -> Query:
    """Register a query under its function name; the session gets the settings first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(configure(spark), sf_dir)

    QUERIES[make.__name__] = run
    return make


def listed(column: str) -> str:
    return f"array_join({column}, '|') AS {column}"


BASELINE, CURRENT = windows.drift_windows(AS_OF)
PATHS = ["id", "type", "actor.id", "actor.login", "repo.name", "public", "payload", "payload.commits", "org"]


# ---- B: paths -------------------------------------------------------------


@query
def missing_and_present_fields(spark, sf):
    fields = DocumentFields()
    missing, present = missing_fields(fields, PATHS), present_fields(fields, PATHS)
    return fields.attach(event_docs(spark, sf)).selectExpr(
        "rid", f"array_join({missing}, '|') AS missing", f"array_join({present}, '|') AS present"
    )


@query
def nested_values(spark, sf):
    fields = DocumentFields()
    picks = {p: fields.field(p) for p in ("actor.login", "actor.id", "payload.size", "repo.name", "public")}
    columns = [f"{f.text} AS {p.replace('.', '_')}" for p, f in picks.items()]
    nulls = [f"{f.is_none} AS {p.replace('.', '_')}_none" for p, f in picks.items()]
    return fields.attach(event_docs(spark, sf)).selectExpr("rid", *columns, *nulls)


@query
def infer_types(spark, sf):
    fields = DocumentFields()
    picks = {p: fields.field(p) for p in ("id", "actor", "actor.id", "public", "payload.commits", "payload.forkee", "created_at")}
    columns = [f"{f.inferred_type} AS {p.replace('.', '_')}" for p, f in picks.items()]
    return fields.attach(event_docs(spark, sf)).selectExpr("rid", *columns)


@query
def event_ids(spark, sf):
    fields = DocumentFields()
    id_text = fields.field("id").id_text
    return fields.attach(event_docs(spark, sf)).selectExpr("rid", f"{id_text} AS event_id")


@query
def severity_names(spark, sf):
    orders = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "CASE o_orderkey % 7 WHEN 0 THEN 'fail' WHEN 1 THEN 'Critical' WHEN 2 THEN 'WARN' WHEN 3 THEN 'warning' "
        "WHEN 4 THEN 'Info' WHEN 5 THEN 'other' END AS spelled",
    )
    return orders.selectExpr("o_orderkey", f"{severity_sql('spelled')} AS severity")


@query
def flatten_paths(spark, sf):
    return flatten_document(event_docs(spark, sf).select("rid", "doc"))


# ---- C: checks ------------------------------------------------------------


def checked(spark, sf, rules) -> DataFrame:
    """Failures of a reduced rule set over the event documents."""
    return v.failure_rows(v.validate(event_docs(spark, sf), rules, AS_OF, DocumentFields()), "rid")


def _rules(section: str, keep: Callable[[dict], bool]) -> dict:
    rules = only(event_rules(), section)
    rules[section] = [r for r in rules[section] if keep(r)]
    return rules


@query
def check_required(spark, sf):
    rules = only(event_rules(), "schema")
    return checked(spark, sf, {"schema": {"required_fields": rules["schema"]["required_fields"]}})


@query
def check_optional(spark, sf):
    rules = only(event_rules(), "schema")
    return checked(spark, sf, {"schema": {"optional_fields": rules["schema"]["optional_fields"]}})


@query
def check_types(spark, sf):
    return checked(spark, sf, only(event_rules(), "type_checks"))


@query
def check_nulls(spark, sf):
    rules = {"null_checks": [{**r, "allow_empty": True} for r in event_rules()["null_checks"]]}
    return checked(spark, sf, rules)


@query
def check_empty(spark, sf):
    rules = {"null_checks": [{**r, "allow_null": True} for r in event_rules()["null_checks"]]}
    rules["null_checks"].append({"field": "payload", "allow_empty": False, "severity": "WARN"})
    return checked(spark, sf, rules)


@query
def check_regex(spark, sf):
    return checked(spark, sf, _rules("value_checks", lambda r: r["check_type"] == "regex"))


@query
def check_enum(spark, sf):
    return checked(spark, sf, _rules("value_checks", lambda r: r["check_type"] == "enum"))


@query
def check_range(spark, sf):
    return checked(spark, sf, _rules("value_checks", lambda r: r["check_type"] == "range"))


def table_checked(spark, sf, name: str, key: list[str], rules: dict) -> DataFrame:
    df = table(spark, sf, name)
    return v.failure_rows(v.validate(df, rules, AS_OF, TableFields(df)), *key)


@query
def check_range_table(spark, sf):
    rules = {
        "value_checks": [
            {"field": "l_discount", "check_type": "range", "min_value": 0.01, "max_value": 0.09, "severity": "WARN"},
            {"field": "l_quantity", "check_type": "range", "min_value": 2, "max_value": 49},
            {"field": "l_shipdate", "check_type": "range", "min_value": 0},
        ]
    }
    failures = table_checked(spark, sf, "lineitem", ["l_orderkey", "l_linenumber"], rules)
    return failures.groupBy("check_name", "severity", "expected_value").agg(
        F.count("*").alias("failures"), F.countDistinct("l_orderkey", "l_linenumber").alias("lines")
    )


@query
def check_enum_table(spark, sf):
    rules = {
        "value_checks": [
            {"field": "o_orderpriority", "check_type": "enum", "allowed_values": ["1-URGENT", "2-HIGH", "3-MEDIUM"]},
            {"field": "o_orderstatus", "check_type": "enum", "allowed_values": ["F", 1, None], "severity": "INFO"},
        ]
    }
    return table_checked(spark, sf, "orders", ["o_orderkey"], rules)


@query
def check_regex_table(spark, sf):
    rules = {
        "value_checks": [
            {"field": "c_name", "check_type": "regex", "pattern": "Customer#[0-9]*[02468]$", "severity": "WARN"},
            {"field": "c_mktsegment", "check_type": "regex", "pattern": "[A-M]"},
            {"field": "c_nationkey", "check_type": "regex", "pattern": "1"},
        ]
    }
    return table_checked(spark, sf, "customer", ["c_custkey"], rules).drop("rule_definition")


@query
def check_length(spark, sf):
    rules = {
        "value_checks": [
            {"field": "text", "check_type": "length", "min_length": 50, "max_length": 2000, "severity": "WARN"},
            {"field": "lang", "check_type": "length", "max_length": 2},
            {"field": "n_chars", "check_type": "length", "min_length": 1, "severity": "INFO"},
        ]
    }
    return table_checked(spark, sf, "documents", ["doc_id"], rules)


@query
def check_length_document(spark, sf):
    rules = {
        "value_checks": [
            {"field": "payload.commits", "check_type": "length", "min_length": 3},
            {"field": "actor.login", "check_type": "length", "max_length": 6, "severity": "WARN"},
            {"field": "payload", "check_type": "length", "max_length": 8, "severity": "INFO"},
            {"field": "repo.id", "check_type": "length", "min_length": 1},
        ]
    }
    return checked(spark, sf, rules)


def _time_check(kind: str) -> dict:
    return _rules("timestamp_checks", lambda r: r["check_type"] == kind)


@query
def check_ts_parse(spark, sf):
    rules = {"timestamp_checks": [r for r in event_rules()["timestamp_checks"] if r["check_type"] in ("format", "parseable")]}
    rules["timestamp_checks"].append({"field": "created_at", "check_type": "ISO8601"})
    return checked(spark, sf, rules)


@query
def check_not_future(spark, sf):
    return checked(spark, sf, _time_check("not_future"))


@query
def check_not_too_old(spark, sf):
    return checked(spark, sf, _time_check("not_too_old"))


@query
def check_too_old_table(spark, sf):
    rules = {"timestamp_checks": [{"field": "o_orderdate", "check_type": "not_too_old", "max_age_days": 10000}]}
    return table_checked(spark, sf, "orders", ["o_orderkey"], rules).select("o_orderkey", "check_name", "expected_value")


@query
def check_conditional(spark, sf):
    return checked(spark, sf, _rules("consistency_checks", lambda r: "rules" in r)).drop("rule_definition")


@query
def check_all_or_none(spark, sf):
    return checked(spark, sf, _rules("consistency_checks", lambda r: "fields" in r)).drop("rule_definition")


@query
def dup_seen_before(spark, sf):
    events = dirty_events(spark, sf)
    key = F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_type"))
    usable = F.when(F.col("user_id").isNotNull() & F.col("event_type").isNotNull(), key)
    return duplicates.mark_duplicates(events, usable, ["event_id"]).select("event_id", "is_duplicate")


@query
def dup_lookback(spark, sf):
    events = dirty_events(spark, sf)
    marked = duplicates.mark_duplicates_within(events, ["user_id", "event_type"], "ts", ["event_id"], 3600)
    return marked.select("event_id", "is_duplicate")


@query
def dup_against_history(spark, sf):
    events = dirty_events(spark, sf).select("event_id", "ts", "user_id", "event_type")
    history = BASELINE.of(events, "ts")
    batch = CURRENT.of(events, "ts")
    marked = duplicates.duplicates_against_history(batch, history, ["user_id", "event_type"], "ts", ["event_id"], 7200)
    return marked.select("event_id", "is_duplicate")


@query
def duplicate_key_error(spark, sf):
    rules = only(event_rules(), "duplicate_check")
    checked_events = v.validate(event_docs(spark, sf), rules, AS_OF, DocumentFields(), order_by=["rid"])
    return v.failure_rows(checked_events, "rid")


@query
def adhoc_checks(spark, sf):
    docs, fields = event_docs(spark, sf), DocumentFields()
    with_all = adhoc.with_failures(
        docs,
        fields,
        adhoc.require_fields(fields, ["id", "payload.commits"]),
        adhoc.require_types(fields, {"id": "string", "public": "boolean"}, "WARN"),
        adhoc.require_match(fields.field("repo.name").text, "org/", "repo"),
        adhoc.require_match(fields.field("repo.name").text, "org[", "broken"),
        adhoc.require_member(fields, "type", ["PushEvent", "ForkEvent"], "type"),
        adhoc.require_timestamp(fields, "created_at", "created"),
    )
    names = with_all.selectExpr("rid", "explode(failures) AS f")
    return names.select("rid", "f.check_name", "f.severity", "f.error_message", "f.expected_value", "f.actual_value")


@query
def custom_check(spark, sf):
    from tidemark.functions.severity import fail_when

    def even_id(rule, fields):
        number = fields.field(rule["field"]).number
        return fail_when(f"{number} % {rule['modulus']} = 0", "custom.modulus", rule["field"], "custom", "WARN", "Divisible")

    df = table(spark, sf, "part")
    rules = {"custom_checks": [{"check": "modulus", "field": "p_size", "modulus": 5}]}
    checked_parts = v.validate(df, rules, AS_OF, TableFields(df), custom={"modulus": even_id})
    return v.failure_rows(checked_parts, "p_partkey").select("p_partkey", "check_name", "check_type", "error_message")


# ---- D: validation --------------------------------------------------------


def validated(spark, sf, keep=("rid", "ts")) -> DataFrame:
    """The full rule set over the event documents; ``keep=None`` keeps the documents."""
    return v.validate(event_docs(spark, sf), event_rules(), AS_OF, DocumentFields(), order_by=["rid"], keep=keep and list(keep))


def stored(spark, sf) -> DataFrame:
    """Validated events as a result table: validated at event time, with a duration."""
    return (
        validated(spark, sf)
        .drop("validation_ts")
        .selectExpr("*", "ts AS validation_ts", "CAST(rid % 210 AS DOUBLE) AS processing_time_ms")
    )


@query
def validate_status(spark, sf):
    return validated(spark, sf).selectExpr("rid", "event_id", "table_name", "status", "validation_ts")


@query
def validate_severity(spark, sf):
    return validated(spark, sf).groupBy("status", "severity").agg(F.count("*").alias("events"))


@query
def failed_checks_list(spark, sf):
    return validated(spark, sf).selectExpr("rid", listed("failed_checks"), listed("error_messages"))


@query
def failure_groups(spark, sf):
    checked_events = validated(spark, sf)
    return checked_events.select(
        "rid",
        F.size(v.failures_of(checked_events, "FAIL")).alias("critical_failures"),
        F.size(v.failures_of(checked_events, "WARN")).alias("warning_failures"),
    )


@query
def failure_details(spark, sf):
    return v.failure_rows(validated(spark, sf), "rid").drop("rule_definition")


@query
def field_severity(spark, sf):
    return v.field_severity(validated(spark, sf), "rid")


@query
def event_summary(spark, sf):
    return v.event_summary(validated(spark, sf), "rid")


@query
def result_metadata(spark, sf):
    return validated(spark, sf).selectExpr(
        "rid", "metadata['rules_version'] AS rules_version", "metadata['event_type'] AS event_type", "metadata['validation_engine'] AS validation_engine"
    )


@query
def validate_table(spark, sf):
    events = dirty_events(spark, sf)
    rules = {
        "schema": {"required_fields": [{"path": "user_id"}, {"path": "missing_column", "severity": "INFO"}]},
        "type_checks": [{"field": "value", "expected_type": "number"}],
        "null_checks": [
            {"field": "user_id", "allow_null": False},
            {"field": "event_type", "allow_null": False, "allow_empty": False, "severity": "WARN"},
        ],
        "value_checks": [
            {"field": "event_type", "check_type": "enum", "allowed_values": ["click", "view", "purchase", "signup", "error"]},
            {"field": "value", "check_type": "range", "min_value": 0, "max_value": 500, "severity": "WARN"},
        ],
        "timestamp_checks": [{"field": "ts", "check_type": "not_future", "severity": "WARN"}],
    }
    checked_events = v.validate(events, rules, AS_OF, TableFields(events), event_id="event_id", table_name="events")
    return checked_events.selectExpr("event_id", "status", "severity", listed("failed_checks"))


# ---- A: gate, tables, sources, sinks --------------------------------------


@query
def gate_processed(spark, sf):
    return sinks.processed_rows(validated(spark, sf, None), processed_at="ts").selectExpr(
        "event_id", "try_variant_get(event_data, '$.repo.name', 'string') AS repo_name", "processed_at", "validation_status"
    )


@query
def gate_should_process(spark, sf):
    return v.should_process(validated(spark, sf)).groupBy("status").agg(F.count("*").alias("events"))


@query
def gate_quarantine(spark, sf):
    return v.quarantine(validated(spark, sf)).selectExpr("rid", "event_id", listed("failed_checks"))


@query
def flatten_events(spark, sf):
    return fl.flat_rows(fl.flatten_events(event_docs(spark, sf), keep=["rid"]))


@query
def flatten_rejects(spark, sf):
    return fl.flat_rejects(fl.flatten_events(event_docs(spark, sf), keep=["rid"])).selectExpr("rid", listed("rejected"))


@query
def insert_if_absent(spark, sf):
    rows = fl.flat_rows(fl.flatten_events(event_docs(spark, sf), keep=["rid", "ts"]))
    target = BASELINE.of(rows, "ts")
    return duplicates.insert_if_absent(rows, target, "event_id", ["rid"]).select("rid", "event_id", "event_type")


@query
def publish_rows(spark, sf):
    return sinks.publish_rows(table(spark, sf, "orders"), "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus"])


@query
def publish_documents(spark, sf):
    published = sinks.publish_documents(event_docs(spark, sf))
    return published.selectExpr("key", "get_json_object(value, '$.repo.name') AS repo_name", "get_json_object(value, '$.type') AS type")


@query
def time_range_scan(spark, sf):
    tagged = windows.tag_windows(table(spark, sf, "events"), "ts", BASELINE, CURRENT)
    return tagged.select("event_id", "ts", "window")


@query
def dead_letter(spark, sf):
    broken = event_text(spark, sf).selectExpr("rid", "CASE WHEN rid % 37 = 0 THEN left(raw, length(raw) - 1) ELSE raw END AS raw")
    return ev.dead_letters(ev.decode(broken)).select("rid", "raw", "reason")


@query
def decoded_messages(spark, sf):
    broken = event_text(spark, sf).selectExpr("rid", "CASE WHEN rid % 37 = 0 THEN left(raw, length(raw) - 1) ELSE raw END AS raw")
    return ev.decoded(ev.decode(broken)).selectExpr("rid", "try_variant_get(doc, '$.type', 'string') AS type")


@query
def archive_by_date(spark, sf):
    rows = ev.archive_rows(event_text(spark, sf), "raw", "ts")
    return rows.groupBy("ingest_date").agg(F.count("*").alias("events"), F.sum(F.length("value")).alias("chars"))


@query
def ingest_stats(spark, sf):
    return ev.ingest_stats(event_text(spark, sf))


@query
def ingest_observed(spark, sf):
    target = work_folder(spark, "observed")
    watched, observation = ev.observe_ingest(event_text(spark, sf), label=f"ingest-{target[-8:]}")
    sinks.Sink("parquet", path=target).write(watched.select("rid"))
    seen = observation.get
    return spark.read.parquet(target).agg(F.count("*").alias("rows_written")).selectExpr(
        "rows_written", f"{seen['messages']}L AS messages", f"{seen['bytes']}L AS bytes"
    )


@query
def results_roundtrip(spark, sf):
    target = work_folder(spark, "results")
    sinks.write_results(stored(spark, sf), sinks.Sink("parquet", path=target), "processing_time_ms")
    back = sinks.stored_results(spark.read.parquet(target))
    return back.selectExpr(
        "event_id", "status", listed("failed_checks"), "size(failures) AS failures", "processing_time_ms",
        "metadata['event_type'] AS event_type", "validation_ts",
    )


# ---- E: result analytics --------------------------------------------------


def _rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query
def run_stats(spark, sf):
    stats = results.run_stats(validated(spark, sf))
    return _rounded(stats, "pass_rate", "warn_rate", "fail_rate", "avg_failures_per_event")


@query
def status_counters(spark, sf):
    return _rounded(results.status_counters(validated(spark, sf)), "pass_rate")


@query
def failures_by_check_type(spark, sf):
    return results.failures_by(validated(spark, sf), "check_type")


@query
def failures_by_severity(spark, sf):
    return results.failures_by(validated(spark, sf), "severity")


@query
def duration_histogram(spark, sf):
    events = table(spark, sf, "events").selectExpr("value * 10 AS ms")
    return _rounded(results.duration_histogram(events, "ms"), "duration_sum", digits=4)


@query
def recent_results(spark, sf):
    return results.recent_results(stored(spark, sf), 10, tie_break="rid")


@query
def alert_conditions(spark, sf):
    alerts = results.alert_conditions(stored(spark, sf), "processing_time_ms")
    return _rounded(alerts, "failure_rate", "warning_rate", "avg_duration_seconds")


@query
def stats_between(spark, sf):
    stats = results.stats_between(stored(spark, sf), "2024-01-10 00:00:00", "2024-01-20 12:00:00")
    return _rounded(stats, "pass_rate", "warn_rate", "fail_rate", "avg_processing_time_ms")


@query
def recent_failures(spark, sf):
    keyed = stored(spark, sf).withColumn("event_id", F.col("rid").cast("string"))
    return results.recent_failures(keyed, 50, "CRITICAL").selectExpr(
        "event_id", "table_name", "status", listed("failed_checks"), "severity", "validation_ts", "size(failures) AS failures"
    )


@query
def hourly_fail_rate(spark, sf):
    return _rounded(results.hourly_fail_rate(stored(spark, sf)), "fail_rate")


def rollup_parts(spark, sf) -> DataFrame:
    """Rollups of three parts of the stored results, hours in common."""
    rows = stored(spark, sf)
    parts = [rollups.hourly_rollup(rows.filter(f"pmod(rid, 3) = {n}")) for n in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def rollup_fail_rate(spark, sf):
    return _rounded(rollups.fail_rate_per_hour(rollup_parts(spark, sf)), "fail_rate")


@query
def rollup_stats_between(spark, sf):
    """Whole hours from rollups, the ends of the range from the results."""
    stats = rollups.stats_between(rollup_parts(spark, sf), stored(spark, sf), "2024-01-10 00:00:00", "2024-01-20 12:00:00")
    return _rounded(stats, "pass_rate", "warn_rate", "fail_rate", "avg_processing_time_ms")


@query
def top_failing_checks(spark, sf):
    return results.top_failing_checks(validated(spark, sf))


@query
def batch_type_counts(spark, sf):
    fields = DocumentFields()
    kind = fields.field("type").text
    return results.batch_type_counts(fields.attach(event_docs(spark, sf)), kind)


@query
def batch_size(spark, sf):
    return results.batch_size(table(spark, sf, "events"))


# ---- F: profiles ----------------------------------------------------------


def tagged_docs(spark, sf) -> DataFrame:
    return windows.tag_windows(event_docs(spark, sf), "ts", BASELINE, CURRENT).select("window", "rid", "ts", "doc")


def tagged_events(spark, sf) -> DataFrame:
    return windows.tag_windows(dirty_events(spark, sf), "ts", BASELINE, CURRENT)


def document_profile(spark, sf, cap: int = 1000) -> DataFrame:
    tagged = tagged_docs(spark, sf)
    leaves = flatten_document(tagged.select("window", "ts", "doc"))
    return profiles.schema_profile(leaves, row_counts_of_docs(spark, sf), cap)


def row_counts_of_docs(spark, sf) -> DataFrame:
    """Rows per window of ``tagged_docs``, without parsing them."""
    return profiles.row_counts(windows.tag_windows(event_text(spark, sf), "ts", BASELINE, CURRENT))


EVENT_COLUMNS = ["event_id", "user_id", "event_type", "value", "props"]


@query
def schema_profile(spark, sf):
    return document_profile(spark, sf)


@query
def capped_cardinality(spark, sf):
    return document_profile(spark, sf, 50).select("window", "field", "cardinality", "cardinality_exact")


@query
def schema_profile_table(spark, sf):
    tagged = tagged_events(spark, sf)
    leaves = flatten_table(tagged, EVENT_COLUMNS, ["window", "ts"])
    return profiles.schema_profile(leaves, profiles.row_counts(tagged)).select(
        "window", "field", "type", "nullable", "null_ratio", "present_count", "presence_ratio",
        "cardinality", "cardinality_exact",
    )


def event_counts(spark, sf, paths=("event_type", "user_id")) -> DataFrame:
    tagged = tagged_events(spark, sf)
    return profiles.value_counts(tagged, TableFields(tagged), list(paths))


def event_numbers(spark, sf) -> DataFrame:
    tagged = tagged_events(spark, sf)
    return profiles.numeric_values(tagged, TableFields(tagged), ["value", "user_id"])


@query
def categorical_profile(spark, sf):
    profile = profiles.categorical_profile(event_counts(spark, sf), 100)
    return _rounded(profile, "proportion").select("window", "field", "value", "n", "proportion", "categories")


@query
def null_ratios(spark, sf):
    tagged = tagged_events(spark, sf)
    ratios = profiles.null_ratios(tagged, TableFields(tagged), ["event_type", "user_id"], ["value", "props"])
    return _rounded(ratios, "null_ratio")


@query
def numeric_profile(spark, sf):
    stats = profiles.numeric_stats(event_numbers(spark, sf))
    return _rounded(_rounded(stats, "mean", "std", digits=3), "min", "max", digits=6)


@query
def percentiles(spark, sf):
    return _rounded(profiles.numeric_percentiles(event_numbers(spark, sf)), "p50", "p95", "p99", digits=6)


@query
def percentiles_lineitem(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr(
        "l_returnflag AS window",
        "inline(array(named_struct('field', 'l_extendedprice', 'value', l_extendedprice), "
        "named_struct('field', 'l_quantity', 'value', l_quantity)))",
    )
    return _rounded(profiles.numeric_percentiles(lines), "p50", "p95", "p99", digits=6)


@query
def numeric_profile_document(spark, sf):
    tagged, fields = tagged_docs(spark, sf), DocumentFields()
    numbers = profiles.numeric_values(tagged, fields, ["payload.size", "actor.id"])
    return _rounded(profiles.numeric_profile(numbers), "mean", "std", digits=3)


@query
def volume_total(spark, sf):
    return profiles.row_counts(tagged_events(spark, sf))


@query
def entity_top_n(spark, sf):
    return profiles.entity_top_n(event_counts(spark, sf), 5)


@query
def profile_lookup(spark, sf):
    """F9 look-ups, one row per answer."""
    counts = event_counts(spark, sf)
    entities = profiles.entity_top_n(counts, 50)
    shape = document_profile(spark, sf)
    answers = [
        profiles.field_names(shape, "current").selectExpr("'field' AS question", "field AS name", "CAST(NULL AS DOUBLE) AS answer"),
        profiles.field_type(shape, "baseline", "payload.k").selectExpr("'type' AS question", "type AS name", "CAST(cardinality AS DOUBLE) AS answer"),
        profiles.distribution_of(profiles.categorical_profile(counts), "current", "event_type").selectExpr("'share' AS question", "value AS name", "round(proportion, 9) AS answer"),
        profiles.statistics_of(profiles.numeric_stats(event_numbers(spark, sf)), "current", "value").selectExpr("'mean' AS question", "field AS name", "round(mean, 3) AS answer"),
        profiles.entity_count(entities, "current", "event_type", "purchase").selectExpr("'count' AS question", "'purchase' AS name", "CAST(n AS DOUBLE) AS answer"),
        profiles.top_entities(entities, "baseline", "event_type", 3).selectExpr("'top' AS question", "value AS name", "CAST(n AS DOUBLE) AS answer"),
    ]
    return drift._union(answers)


# ---- G: drift -------------------------------------------------------------


@query
def drift_window_bounds(spark, sf):
    tagged = tagged_events(spark, sf)
    return tagged.groupBy("window").agg(F.count("*").alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query
def drift_gate(spark, sf):
    tagged = tagged_events(spark, sf)
    sizes = windows.window_counts(tagged)
    return windows.gate(sizes, tagged, 300)


KEY = ["entity", "field_name", "metric_name", "severity"]


def scored(comparisons: DataFrame, *extra: str) -> DataFrame:
    return comparisons.selectExpr("drift_type", *KEY, "round(drift_score, 6) AS drift_score", *extra)


@query
def drift_fields(spark, sf):
    found = drift.schema_comparisons(document_profile(spark, sf))
    return scored(found.filter("metric_name IN ('field_added', 'field_removed')"), "checks")


@query
def drift_types(spark, sf):
    found = drift.schema_comparisons(document_profile(spark, sf))
    return scored(found.filter("metric_name = 'type_change'"), "baseline_value", "current_value", "checks")


@query
def drift_cardinality(spark, sf):
    found = drift.schema_comparisons(document_profile(spark, sf, 400))
    return scored(found.filter("metric_name = 'cardinality_explosion'"), "baseline_value", "current_value")


@query
def drift_psi(spark, sf):
    compared = drift.psi_comparisons(profiles.categorical_profile(event_counts(spark, sf)))
    return scored(compared, "round(measure, 6) AS psi", "checks")


@query
def drift_top_values(spark, sf):
    return _rounded(drift.top_values(profiles.categorical_profile(event_counts(spark, sf))), "proportion")


@query
def drift_mean_shift(spark, sf):
    compared = drift.mean_shift_comparisons(profiles.numeric_stats(event_numbers(spark, sf)))
    return compared.selectExpr("drift_type", *KEY, "round(drift_score, 3) AS drift_score", "round(measure, 3) AS shift")


@query
def drift_null_ratio(spark, sf):
    tagged = tagged_events(spark, sf)
    ratios = profiles.null_ratios(tagged, TableFields(tagged), ["event_type", "user_id"], ["value"])
    return scored(drift.null_ratio_comparisons(ratios), "round(measure, 6) AS change")


@query
def drift_global_rate(spark, sf):
    compared = drift.global_rate_comparison(windows.window_counts(tagged_events(spark, sf)), BASELINE, CURRENT)
    return scored(compared, "round(measure, 6) AS z")


@query
def drift_global_history(spark, sf):
    events = dirty_events(spark, sf)
    history = drift.history_counts(events, "ts", BASELINE, 3)
    counts = windows.window_counts(windows.tag_windows(events, "ts", BASELINE, CURRENT))
    return scored(drift.global_rate_comparison(counts, BASELINE, CURRENT, history=history), "round(measure, 6) AS z")


@query
def drift_entities(spark, sf):
    entities = profiles.entity_top_n(event_counts(spark, sf), 50)
    return scored(drift.entity_comparisons(entities), "round(measure, 6) AS change", "checks")


@query
def drift_entities_normalized(spark, sf):
    entities = profiles.entity_top_n(event_counts(spark, sf, ("event_type",)), 50)
    return scored(drift.entity_comparisons(entities, normalize=(BASELINE.hours, CURRENT.hours)), "round(measure, 6) AS change")


RUN_CONFIG = {
    "targets": {
        "distribution_drift": {"categorical_fields": ["event_type", "user_id"], "numerical_fields": ["value"]},
    }
}


def comparisons(spark, sf, config: dict | None = None) -> DataFrame:
    events = dirty_events(spark, sf)
    return drift.compare_windows(
        events,
        AS_OF,
        TableFields(events),
        lambda tagged: flatten_table(tagged, EVENT_COLUMNS, ["window", "ts"]),
        config=config or RUN_CONFIG,
    )


@query
def drift_run(spark, sf):
    return scored(drift.findings(comparisons(spark, sf))).withColumn("drift_score", F.round("drift_score", 3))


@query
def drift_run_documents(spark, sf):
    docs = event_docs(spark, sf)
    compared = drift.compare_windows(docs, AS_OF, DocumentFields())
    return scored(drift.findings(compared)).withColumn("drift_score", F.round("drift_score", 3))


@query
def drift_switches(spark, sf):
    config = {
        "targets": {
            **RUN_CONFIG["targets"],
            "schema_drift": {"check_cardinality": False},
            "volume_drift": {"check_per_entity_volume": False},
        }
    }
    return scored(drift.findings(comparisons(spark, sf, config), include_stable=True)).withColumn(
        "drift_score", F.round("drift_score", 3)
    )


@query
def drift_summary(spark, sf):
    return drift.summarise(comparisons(spark, sf))


@query
def drift_by_type(spark, sf):
    return drift.drifts_by_type(comparisons(spark, sf))


def stored_drifts(spark, sf) -> DataFrame:
    """Hourly drift findings over lineitem suppliers, as a drift table of many runs.

    The report operators need more findings than one run over five columns
    gives: each order line is read as one finding.
    """
    return table(spark, sf, "lineitem").selectExpr(
        "CASE l_linenumber % 3 WHEN 0 THEN 'schema' WHEN 1 THEN 'distribution' ELSE 'volume' END AS drift_type",
        "l_returnflag AS entity",
        "concat('f', l_suppkey % 40) AS field_name",
        "concat('m', l_orderkey, '.', l_linenumber) AS metric_name",
        "l_shipdate AS baseline_start",
        "l_shipdate AS baseline_end",
        "l_shipdate AS current_start",
        "l_shipdate AS current_end",
        "CAST(l_quantity AS STRING) AS baseline_value",
        "CAST(l_extendedprice AS STRING) AS current_value",
        "l_discount * 10 AS drift_score",
        "CASE WHEN l_quantity < 5 THEN 'CRITICAL' WHEN l_quantity < 12 THEN 'WARNING' ELSE 'INFO' END AS severity",
        "l_shipdate AS detected_at",
        "'{}' AS metadata",
    )


DRIFT_COLUMNS = ["drift_type", "entity", "field_name", "metric_name", "severity", "detected_at"]


@query
def drift_recent(spark, sf):
    return drift_reports.recent_drifts(stored_drifts(spark, sf), 100).select(*DRIFT_COLUMNS)


@query
def drift_critical(spark, sf):
    return drift_reports.critical_drifts(stored_drifts(spark, sf), "1998-09-01 00:00:00", 2400).select(*DRIFT_COLUMNS)


@query
def drift_frequency(spark, sf):
    return drift_reports.drift_frequency(stored_drifts(spark, sf))


@query
def drift_hot_fields(spark, sf):
    return _rounded(drift_reports.most_drifted_fields(stored_drifts(spark, sf)), "max_score")


@query
def drift_report(spark, sf):
    rows = drift_reports.report_rows(stored_drifts(spark, sf))
    return _rounded(rows, "drift_score")


@query
def drift_roundtrip(spark, sf):
    target = work_folder(spark, "drifts")
    sinks.write_drifts(drift.findings(comparisons(spark, sf)), sinks.Sink("parquet", path=target))
    back = spark.read.parquet(target)
    return back.selectExpr(
        "drift_type", "entity", "field_name", "metric_name", "severity", "detected_at", "baseline_start", "current_end"
    )


# ---- H: batch comparisons -------------------------------------------------


def schemas(spark, sf) -> DataFrame:
    tagged = tagged_docs(spark, sf)
    leaves = flatten_document(tagged.select("window", "ts", "doc"))
    rows = row_counts_of_docs(spark, sf)
    return batch_drift.extract_schema(profiles.schema_profile(leaves, rows), rows)


@query
def extract_schema(spark, sf):
    return _rounded(schemas(spark, sf), "frequency")


@query
def compare_schemas(spark, sf):
    return batch_drift.compare_schemas(schemas(spark, sf), tolerance=0.01).select("field", "change")


@query
def new_fields(spark, sf):
    both = schemas(spark, sf)
    return batch_drift.new_fields(both.filter("window = 'current'"), both.filter("window = 'baseline'"))


@query
def missing_or_rare_fields(spark, sf):
    both = schemas(spark, sf)
    current, baseline = both.filter("window = 'current'"), both.filter("window = 'baseline'")
    return _rounded(batch_drift.missing_or_rare_fields(current, baseline, 0.985), "frequency")


@query
def schema_drift_failures(spark, sf):
    return batch_drift.schema_drift_failures(batch_drift.compare_schemas(schemas(spark, sf)))


@query
def distribution(spark, sf):
    counts = event_counts(spark, sf, ("user_id",))
    return _rounded(profiles.categorical_profile(counts, None), "proportion")


@query
def chi_square(spark, sf):
    counts = event_counts(spark, sf, ("event_type",))
    tested = batch_drift.chi_square(counts)
    return _rounded(tested, "statistic", digits=4).select("field", "statistic", "freedom", "drift_detected", "significance_level")


@query
def distribution_drift_failures(spark, sf):
    tests = batch_drift.chi_square(event_counts(spark, sf, ("event_type",)))
    return batch_drift.distribution_drift_failures(tests).select("check_name", "check_type", "severity", "expected_value")


@query
def distribution_drift_failures_all(spark, sf):
    """All three tests: value counts by chi-square, numbers by Kolmogorov-Smirnov and by histogram."""
    numbers = event_numbers(spark, sf)
    tests = batch_drift.chi_square(event_counts(spark, sf, ("event_type",)))
    return batch_drift.distribution_drift_failures(
        tests, ks=batch_drift.ks_two_sample(numbers), histograms=batch_drift.histogram_compare(numbers, 50)
    ).select("check_name", "field_path", "check_type", "severity", "expected_value")


@query
def ks_two_sample(spark, sf):
    tested = batch_drift.ks_two_sample(event_numbers(spark, sf)).drop("drift_detected", "significance_level")
    return _rounded(tested, "statistic", "p_value", digits=6)


@query
def histogram_compare(spark, sf):
    return _rounded(batch_drift.histogram_compare(event_numbers(spark, sf), 50), "lower", digits=6)


# ---- S: streams -----------------------------------------------------------


def event_stream(spark, sf) -> DataFrame:
    """The event table replayed as a stream of JSON texts."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return over_documents(spark, stream).withColumn("ts", F.col("ts").cast("timestamp"))


def _ingested(spark, sf) -> ingest.IngestTables:
    root = work_folder(spark, "ingest")
    stream = event_stream(spark, sf)
    ingest.validate_stream(stream, event_rules(), AS_OF, root, ["rid"], lookback=ingest.FOREVER, available_now=True).awaitTermination()
    return ingest.IngestTables(root)


REPLAYED = 4


def replay_in_batches(spark, sf) -> DataFrame:
    """The event table as a stream of about ``REPLAYED`` micro-batches, in the order of event time."""
    folder = work_folder(spark, "replay")
    rows = event_text(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    cuts = rows.agg(F.percentile_approx(F.unix_micros("ts"), [n / REPLAYED for n in range(1, REPLAYED)])).first()[0] or []
    # later files are read later
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows if low is None else rows.filter(F.unix_micros("ts") >= low)
        (part if high is None else part.filter(F.unix_micros("ts") < high)).write.mode("append").parquet(folder)
    files = len(spark.read.parquet(folder).inputFiles())
    stream = spark.readStream.schema("rid long, ts timestamp, raw string").option("maxFilesPerTrigger", max(1, -(-files // REPLAYED)))
    return stream.parquet(folder)


@query
def stream_replay(spark, sf):
    """Several micro-batches under the rule set's own lookback, by event time."""
    root = work_folder(spark, "ingest")
    stream = replay_in_batches(spark, sf)
    ingest.validate_stream(stream, event_rules(), AS_OF, root, ["rid"], event_time="ts", available_now=True).awaitTermination()
    rejected = ingest.IngestTables(root).quarantine.read(spark)
    return rejected.selectExpr("rid", "event_id", "array_join(failed_checks, '|') AS failed_checks")


@query
def stream_validate(spark, sf):
    return _ingested(spark, sf).results.read(spark).groupBy("status", "severity").agg(F.count("*").alias("events"))


@query
def stream_processed(spark, sf):
    return _ingested(spark, sf).processed.read(spark).select("event_id", "validation_status")


@query
def stream_flat(spark, sf):
    return _ingested(spark, sf).flat.read(spark).select("event_id", "event_type", "repo_id", "public", "created_at")


@query
def stream_dup_report(spark, sf):
    rows = _ingested(spark, sf).quarantine.read(spark)
    return rows.filter("array_contains(failed_checks, 'duplicate.id')").select("rid", "event_id")


@query
def stream_dedup(spark, sf):
    root = work_folder(spark, "dedup")
    keyed = event_stream(spark, sf).selectExpr("rid", "ts", "coalesce(get_json_object(raw, '$.id'), concat('~', rid)) AS event_id")
    ingest.append_stream(ingest.dedup_stream(keyed, "event_id", "ts", "40 days"), root, available_now=True).awaitTermination()
    return spark.read.parquet(f"{root}/rows").select("event_id")


@query
def stream_counters(spark, sf):
    root = work_folder(spark, "counters")
    parsed = ev.decode(event_stream(spark, sf))
    checked_events = v.validate(parsed, without(event_rules(), "duplicate_check"), AS_OF, DocumentFields())
    counted = ingest.counters_stream(checked_events, "ts")
    ingest.keep_latest(counted, root, ["hour"], available_now=True).awaitTermination()
    return _rounded(ingest.latest(spark, root, ["hour"]), "fail_rate")


@query
def stream_archive(spark, sf):
    root = work_folder(spark, "archive")
    ingest.archive_stream(event_stream(spark, sf), root, ingested="ts", available_now=True).awaitTermination()
    rows = spark.read.text(f"{root}/raw")
    return rows.groupBy(F.col("ingest_date").cast("string").alias("ingest_date")).agg(
        F.count("*").alias("events"), F.sum(F.length("value")).alias("chars")
    )
