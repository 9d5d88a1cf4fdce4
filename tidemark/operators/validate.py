"""Validation of events against a rule set.

``validate`` is a lazy transform for batch and streaming input alike. The
failures of a row are built by one generated expression; status, severity and
lists are read off that array.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.once import evaluate_once
from tidemark.functions.paths import DICT, LIST, DocumentFields, Fields
from tidemark.functions.severity import FAIL, WARN, Sql, combine, fail_when, normalise_severity
from tidemark.functions.sqltext import name, quote
from tidemark.operators.checks import CustomCheck, row_checks
from tidemark.operators.duplicates import mark_duplicates
from tidemark.session import landed_table

#: Names the validator in the metadata of results.
ENGINE = "tidemark"
ENGINE_ERROR = "validation_engine.error"


def timestamp_sql(moment: datetime | str) -> str:
    """A timestamp literal (naive means UTC), or ``now`` for the start of the query."""
    if moment == "now":
        return "current_timestamp()"
    if isinstance(moment, datetime):
        moment = moment.isoformat(sep=" ")
    return f"TIMESTAMP {quote(moment)}"


def _duplicate_check(config: dict, is_duplicate: str, text: str) -> str:
    """C15 failure of a repeated key whose value reads ``text``."""
    path = config.get("key_field", "id")
    return fail_when(
        is_duplicate,
        f"duplicate.{path}",
        path,
        "duplicate",
        normalise_severity(config.get("severity", FAIL)),
        config.get("error_message", "Duplicate event detected"),
        "unique value",
        Sql(f"concat('duplicate: ', {text})"),
    )


def _unusable_key_check(config: dict, fields: Fields) -> str:
    """C17 failure of a key that cannot be compared; such a row has no key and is no duplicate."""
    field = fields.field(config.get("key_field", "id"))
    reason = f"concat('unhashable type: \\'', {field.kind}, '\\'')"
    return fail_when(
        field.is_kind(LIST, DICT),
        ENGINE_ERROR,
        "<engine>",
        "system",
        FAIL,
        Sql(f"concat('Validation engine error: ', {reason})"),
        None,
        Sql(reason),
    )


def duplicates_enabled(rules: dict) -> bool:
    return bool((rules.get("duplicate_check") or {}).get("enabled", False))


def with_event_key(df: DataFrame, rules: dict, fields: Fields, column: str = "event_key") -> DataFrame:
    """Add the rule set's duplicate key as comparable text, NULL where there is none."""
    path = rules["duplicate_check"].get("key_field", "id")
    keys = DocumentFields(fields.doc, tag="k") if isinstance(fields, DocumentFields) else fields
    key = keys.field(path).key
    return keys.attach(df).selectExpr(*[name(c) for c in df.columns], f"{key} AS {column}")


def _with_duplicates(checked: DataFrame, config: dict, columns: list[str], order_by: list[str]) -> DataFrame:
    """The checked rows, written once, with the C15 failure of those whose key came before."""
    kept = [name(c) for c in columns if c not in ("event_id", "failures")]
    order = [f"{name(c)} AS __by{n}" for n, c in enumerate(order_by)]
    rows = landed_table(
        checked.selectExpr(
            *kept, "failures", "event_id", "event_type", "__key", "if(__key IS NULL, NULL, __key_text) AS __key_text",
            *order, "monotonically_increasing_id() AS __place",
        )
    )
    marked = mark_duplicates(rows, F.col("__key"), [f"__by{n}" for n in range(len(order))] + ["__place"], "__is_duplicate")
    failure = _duplicate_check(config, "__is_duplicate", "__key_text")
    return evaluate_once(marked.selectExpr(*kept, "event_id", "event_type", f"concat(failures, {failure}) AS failures"), failures="failures")


def validate(
    df: DataFrame,
    rules: dict,
    as_of: datetime | str,
    fields: Fields,
    *,
    table_name: str = "events_raw",
    order_by: list[str] | None = None,
    duplicate_flag: str | None = None,
    event_id: str | None = None,
    custom: dict[str, CustomCheck] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """The input rows with their validation result.

    Adds ``event_id, table_name, status, failures, failed_checks,
    error_messages, severity, validation_ts, metadata``. When the rule set
    enables duplicate detection, give ``order_by`` (unique arrival order) to
    have duplicates found here, or ``duplicate_flag``, a boolean column that
    already tells them (streams).

    ``keep`` names the input columns that the result carries (default: all). With
    it duplicates are found in one decode: the checked rows, without documents, are
    written to the shared folder when the plan is built, and keys meet on that table.
    Rows that tie in ``order_by`` then rank by their place in it, so that one of them
    is the first. Without ``keep`` nothing is written, each document is decoded once
    for its key and once for its checks, and no row of a tie for the first is a duplicate.
    """
    now = timestamp_sql(as_of)
    columns = [c for c in (df.columns if keep is None else keep) if c != duplicate_flag]
    checks = row_checks(rules, fields, now, custom)
    finds = duplicates_enabled(rules) and duplicate_flag is None
    if finds and not order_by:
        raise ValueError("duplicate detection needs order_by or duplicate_flag")
    lands = finds and keep is not None
    found = {}
    if duplicates_enabled(rules):
        config = rules["duplicate_check"]
        key = fields.field(config.get("key_field", "id"))
        if lands:
            found = {"__key": key.key, "__key_text": key.text}
        elif finds:
            keyed = with_event_key(df, rules, fields, "__event_key")
            df = mark_duplicates(keyed, F.col("__event_key"), order_by, "__is_duplicate").drop("__event_key")
            duplicate_flag = "__is_duplicate"
        if not lands:
            checks.append(_duplicate_check(config, name(duplicate_flag), key.text))
        checks.append(_unusable_key_check(config, fields))
    id_text = f"CAST({name(event_id)} AS STRING)" if event_id else fields.field("id").id_text
    event_type = fields.field("type").text
    checked = evaluate_once(
        fields.attach(df),
        failures=combine(checks),
        event_id=id_text,
        event_type=event_type,
        **found,
    )
    if lands:
        checked = _with_duplicates(checked, config, columns, order_by)
    graded = "CASE WHEN array_contains(failures.severity, 'FAIL') THEN {} WHEN array_contains(failures.severity, 'WARN') THEN {} ELSE 'PASS' END"
    return checked.selectExpr(
        *[name(c) for c in columns if c not in ("event_id", "failures")],
        "event_id",
        f"{quote(table_name)} AS table_name",
        graded.format("'FAIL'", "'WARN'") + " AS status",
        "failures",
        "failures.check_name AS failed_checks",
        "failures.error_message AS error_messages",
        graded.format("'CRITICAL'", "'WARNING'") + " AS severity",
        f"{now} AS validation_ts",
        f"map('rules_version', {quote(rules.get('version', 'unknown'))}, 'event_type', event_type, "
        f"'validation_engine', {quote(ENGINE)}) AS metadata",
    )


def failures_of(validated: DataFrame, severity: str) -> Column:
    """The failures of one severity (``FAIL`` or ``WARN``)."""
    return F.filter("failures", lambda f: f["severity"] == severity)


def failure_rows(validated: DataFrame, *keep: str) -> DataFrame:
    """One row per failure beside the kept columns."""
    return validated.select(*keep, F.inline("failures"))


def failure_details(validated: DataFrame, *keep: str) -> DataFrame:
    """D5 serialised: the failures of an event as one JSON text."""
    return validated.select(
        *keep, F.to_json("failures", {"ignoreNullFields": "false"}).alias("failure_details")
    )


def field_severity(validated: DataFrame, *keep: str) -> DataFrame:
    """Highest severity per event and field, as CRITICAL, WARNING or INFO."""
    rank = F.when(F.col("severity") == FAIL, 3).when(F.col("severity") == WARN, 2).otherwise(1)
    top = failure_rows(validated, *keep).groupBy(*keep, "field_path").agg(
        F.max(rank).alias("__rank"), F.count("*").alias("failures")
    )
    name = F.when(F.col("__rank") == 3, "CRITICAL").when(F.col("__rank") == 2, "WARNING").otherwise("INFO")
    return top.select(*keep, "field_path", name.alias("severity"), "failures")


def event_summary(validated: DataFrame, *keep: str) -> DataFrame:
    """Counters of one event; ``total_checks`` is failures plus one."""
    total = F.size("failures")
    severities = F.col("failures.severity")
    return validated.select(
        *keep,
        (total + 1).alias("total_checks"),
        (total - F.size(F.array_remove(severities, FAIL))).alias("critical_failures"),
        (total - F.size(F.array_remove(severities, WARN))).alias("warning_failures"),
        F.when(F.col("status") == "PASS", 1).otherwise(0).alias("passed"),
    )


def should_process(validated: DataFrame) -> DataFrame:
    """Everything but FAIL."""
    return validated.filter(F.col("status") != "FAIL")


def quarantine(validated: DataFrame) -> DataFrame:
    """A6 complement: the rejected rows with their failures."""
    return validated.filter(F.col("status") == "FAIL")
