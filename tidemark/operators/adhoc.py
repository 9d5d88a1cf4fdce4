"""Ad-hoc checks (C18): a failures column without a full rule set.

Each helper returns an expression for ``with_failures``; names and messages
differ from those of rule-set checks on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.functions.once import evaluate_once
from tidemark.functions.paths import Fields
from tidemark.functions.pytext import java_pattern
from tidemark.functions.severity import FAIL, Sql, combine, fail_when, normalise_severity
from tidemark.functions.sqltext import quote
from tidemark.operators.checks import type_checks, valid_pattern


def require_fields(fields: Fields, paths: list[str], severity: str = FAIL) -> list[str]:
    return [
        fail_when(
            f"NOT ({fields.field(path).exists})",
            f"schema.required.{path}",
            path,
            "schema",
            normalise_severity(severity),
            f"Required field '{path}' is missing",
            "field present",
            "field missing",
        )
        for path in paths
    ]


def require_types(fields: Fields, types: dict[str, str], severity: str = FAIL) -> list[str]:
    """Field path to type name; one entry is the single-field check."""
    rules = [{"field": path, "expected_type": kind, "severity": severity} for path, kind in types.items()]
    return type_checks(rules, fields)


def require_match(value: str, pattern: str, label: str = "value") -> list[str]:
    """A text expression against a pattern; an invalid pattern fails every row."""
    if valid_pattern(pattern):
        condition = f"NOT coalesce({value} RLIKE {quote(java_pattern(pattern))}, false)"
        message, expected, actual = "Value does not match pattern", f"matches {pattern}", Sql(value)
    else:
        condition, message, expected, actual = "true", "Invalid regex pattern", pattern, "invalid pattern"
    return [fail_when(condition, f"regex.{label}", label, "regex", FAIL, message, expected, actual)]


def require_member(fields: Fields, path: str, allowed: list, label: str = "value") -> list[str]:
    field = fields.field(path)
    return [
        fail_when(
            f"NOT {field.one_of(allowed)}",
            f"enum.{label}",
            label,
            "enum",
            FAIL,
            "Value not in allowed list",
            f"one of {allowed}",
            Sql(field.text),
        )
    ]


def require_timestamp(fields: Fields, path: str, label: str = "timestamp") -> list[str]:
    field = fields.field(path)
    return [
        fail_when(
            f"{field.timestamp} IS NULL",
            f"timestamp.{label}",
            label,
            "timestamp",
            FAIL,
            "Invalid timestamp format",
            "ISO8601 format",
            Sql(field.text),
        )
    ]


def with_failures(df: DataFrame, fields: Fields, *checks: list[str], column: str = "failures") -> DataFrame:
    """The input columns and the failures of all given checks."""
    merged = [check for group in checks for check in group]
    attached = fields.attach(df)
    return evaluate_once(attached, **{column: combine(merged)}).select(*df.columns, column)
