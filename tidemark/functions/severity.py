"""Severity vocabulary (B7) and the failure record shared by every check."""

from __future__ import annotations

from tidemark.functions.sqltext import case, quote

# Stored severity texts of a validation failure.
FAIL = "FAIL"
WARN = "WARN"
INFO = "INFO"

# Accepted spellings of a rule's severity, unknown spellings mean WARN.
SEVERITY_SPELLINGS = {
    "FAIL": FAIL,
    "CRITICAL": FAIL,
    "WARN": WARN,
    "WARNING": WARN,
    "INFO": INFO,
}

FAILURE_TYPE = (
    "struct<check_name:string,field_path:string,check_type:string,severity:string,"
    "error_message:string,expected_value:string,actual_value:string,rule_definition:string>"
)
NO_FAILURES = f"CAST(array() AS array<{FAILURE_TYPE}>)"


def normalise_severity(text: str) -> str:
    """B7 on the driver: resolve a rule's severity once, when the rule is compiled."""
    return SEVERITY_SPELLINGS.get(str(text).upper(), WARN)


def severity_sql(text: str) -> str:
    """B7 as an expression, for severities that live in data."""
    known = [(f"upper({text}) = {quote(s)}", quote(v)) for s, v in SEVERITY_SPELLINGS.items()]
    return case([(f"{text} IS NULL", quote(None)), *known], quote(WARN))


class Sql(str):
    """Marks a part of a failure as an expression; plain strings are literals."""


def _part(value) -> str:
    return str(value) if isinstance(value, Sql) else quote(value)


def fail_when(
    condition: str,
    check_name: str,
    field_path: str,
    check_type: str,
    severity: str,
    error_message,
    expected=None,
    actual=None,
    definition=None,
) -> str:
    """One check: a one-element failure array when the condition holds, else empty.

    Arrays (joined with ``flatten``) keep every check in generated code;
    filtering a nullable array with a lambda would not.
    """
    parts = {
        "check_name": check_name,
        "field_path": field_path,
        "check_type": check_type,
        "severity": severity,
        "error_message": error_message,
        "expected_value": expected,
        "actual_value": actual,
        "rule_definition": definition,
    }
    record = ", ".join(f"'{key}', {_part(value)}" for key, value in parts.items())
    return f"CASE WHEN {condition} THEN array(named_struct({record})) ELSE {NO_FAILURES} END"


def combine(checks: list[str]) -> str:
    """All failures of a row, in rule order."""
    return "flatten(array(" + ", ".join(checks) + "))" if checks else NO_FAILURES
