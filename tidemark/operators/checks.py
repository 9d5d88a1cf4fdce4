"""Row-level checks (C1-C14): each rule becomes one expression for its failures.

Rules are plain dicts grouped in sections. They are examined on the driver
when the plan is built: a malformed rule raises ``RuleError`` there instead of
failing every event at run time.
"""

from __future__ import annotations

import numbers
import re
from collections.abc import Callable

from tidemark.functions.paths import BOOL, DICT, FLOAT, INT, LIST, NONE, STR, Fields
from tidemark.functions.pytext import java_pattern
from tidemark.functions.severity import FAIL, INFO, WARN, Sql, fail_when, normalise_severity
from tidemark.functions.sqltext import all_of, any_of, case, quote

CustomCheck = Callable[[dict, Fields], str]


class RuleError(ValueError):
    """A rule that could never be evaluated."""


# Type names a rule may use and the decoded types each accepts.
# Booleans are integers; an unknown name means text.
ACCEPTED_KINDS = {
    "string": (STR,),
    "str": (STR,),
    "integer": (INT, BOOL),
    "int": (INT, BOOL),
    "float": (FLOAT,),
    "number": (INT, FLOAT, BOOL),
    "boolean": (BOOL,),
    "bool": (BOOL,),
    "list": (LIST,),
    "array": (LIST,),
    "dict": (DICT,),
    "object": (DICT,),
    "null": (NONE,),
    "none": (NONE,),
}


def _need(rule: dict, key: str):
    if key not in rule:
        raise RuleError(f"rule without {key!r}: {rule}")
    return rule[key]


def _bound(rule: dict, key: str):
    bound = rule.get(key)
    if bound is not None and not isinstance(bound, numbers.Real):
        raise RuleError(f"{key} must be a number: {rule}")
    return bound


def schema_checks(section: dict, fields: Fields) -> list[str]:
    """C1 and C2. Optional fields of INFO severity never report."""
    checks = []
    for rule in section.get("required_fields") or []:
        path = _need(rule, "path")
        checks.append(
            fail_when(
                f"NOT ({fields.field(path).exists})",
                f"schema.required_field.{path}",
                path,
                "schema",
                normalise_severity(rule.get("severity", FAIL)),
                f"Required field '{path}' is missing",
                "field present",
                "field missing",
                rule.get("description", f"Required field: {path}"),
            )
        )
    for rule in section.get("optional_fields") or []:
        path = _need(rule, "path")
        severity = normalise_severity(rule.get("severity", WARN))
        if severity == INFO:
            continue
        checks.append(
            fail_when(
                f"NOT ({fields.field(path).exists})",
                f"schema.optional_field.{path}",
                path,
                "schema",
                severity,
                f"Optional field '{path}' is missing",
                "field present (optional)",
                "field missing",
                rule.get("description", f"Optional field: {path}"),
            )
        )
    return checks


def type_checks(section: list[dict], fields: Fields) -> list[str]:
    """C3. Absent fields are skipped; a JSON null is not."""
    checks = []
    for rule in section:
        path, expected = _need(rule, "field"), _need(rule, "expected_type")
        field = fields.field(path)
        accepted = ACCEPTED_KINDS.get(str(expected).lower(), (STR,))
        checks.append(
            fail_when(
                f"{field.exists} AND NOT ({field.is_kind(*accepted)})",
                f"type_check.{path}",
                path,
                "type",
                normalise_severity(rule.get("severity", FAIL)),
                rule.get("error_message", f"Field '{path}' has incorrect type"),
                expected,
                Sql(field.kind),
                f"Expected type: {expected}",
            )
        )
    return checks


def null_checks(section: list[dict], fields: Fields) -> list[str]:
    """C4 and C5. A null failure leaves nothing for the empty check to find."""
    checks = []
    for rule in section:
        path = _need(rule, "field")
        field = fields.field(path)
        severity = normalise_severity(rule.get("severity", FAIL))
        message = rule.get("error_message", f"Field '{path}' has invalid null/empty value")
        if not rule.get("allow_null", True):
            checks.append(
                fail_when(
                    field.is_none, f"null_check.{path}", path, "null", severity, message, "non-null value", "null"
                )
            )
        if not rule.get("allow_empty", True):
            checks.append(
                fail_when(
                    f"{field.is_kind(STR, LIST, DICT)} AND {field.size} = 0",
                    f"empty_check.{path}",
                    path,
                    "empty",
                    severity,
                    message,
                    "non-empty value",
                    Sql(f"concat('empty ', {field.kind})"),
                )
            )
    return checks


def valid_pattern(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def value_checks(section: list[dict], fields: Fields) -> list[str]:
    """C6-C9. One pattern is kept per field, the last valid one, for all its regex rules."""
    patterns = {}
    for rule in section:
        if rule.get("check_type") == "regex" and valid_pattern(_need(rule, "pattern")):
            patterns[_need(rule, "field")] = rule["pattern"]
    makers = {"regex": _regex_check, "enum": _enum_check, "range": _range_check, "length": _length_check}
    checks = []
    for rule in section:
        path, check = _need(rule, "field"), _need(rule, "check_type")
        if check not in makers or (check == "regex" and path not in patterns):
            continue
        field = fields.field(path)
        condition, message, expected, actual, definition = makers[check](
            rule, field, rule.get("error_message", f"Value check failed for field '{path}'"), patterns.get(path)
        )
        checks.append(
            fail_when(
                f"NOT ({field.is_none}) AND {condition}",
                f"value_check.{check}.{path}",
                path,
                check,
                normalise_severity(rule.get("severity", FAIL)),
                message,
                expected,
                actual,
                definition,
            )
        )
    return checks


def _regex_check(rule, field, message, pattern):
    """The value's text, matched from its start but not to its end."""
    matched = f"coalesce({field.text} RLIKE {quote(java_pattern(pattern))}, false)"
    return f"NOT {matched}", message, f"matches pattern: {rule['pattern']}", Sql(field.text), rule["pattern"]


def _enum_check(rule, field, message, _):
    """C7."""
    allowed = rule.get("allowed_values", [])
    if not isinstance(allowed, (list, tuple)):
        raise RuleError(f"allowed_values must be a list: {rule}")
    return f"NOT {field.one_of(list(allowed))}", message, f"one of {allowed}", Sql(field.text), str(allowed)


def _limits(rule: dict, low_key: str, high_key: str, beyond: Callable) -> list[tuple[str, str]]:
    """``(condition, bound text)`` of the bounds a rule has, the lower one first."""
    pairs = [(_bound(rule, low_key), "<", ">="), (_bound(rule, high_key), ">", "<=")]
    return [
        (f"coalesce({beyond(bound, sign)}, false)", f"{allowed} {bound}")
        for bound, sign, allowed in pairs
        if bound is not None
    ]


def _range_check(rule, field, message, _):
    """Inclusive bounds, at most one failure, the lower bound first."""
    numeric = field.is_number
    limits = _limits(rule, "min_value", "max_value", field.beyond)
    condition = any_of([f"NOT ({numeric})", *[c for c, _ in limits]])
    must = quote(f"Field '{field.path}' must be numeric for range check")
    expected = case([(f"NOT ({numeric})", "'numeric value'"), *[(c, quote(text)) for c, text in limits]])
    return (
        condition,
        Sql(f"if({numeric}, {quote(message)}, {must})"),
        Sql(expected),
        Sql(f"if({numeric}, {field.text}, {field.kind})"),
        None,
    )


def _length_check(rule, field, message, _):
    """Text in code points, lists and objects in members."""
    sized = field.is_kind(STR, LIST, DICT)
    limits = _limits(rule, "min_length", "max_length", lambda bound, sign: f"{field.size} {sign} {bound}")
    condition = any_of([f"NOT ({sized})", *[c for c, _ in limits]])
    must = quote(f"Field '{field.path}' must have length for length check")
    expected = case(
        [(f"NOT ({sized})", "'string or list'"), *[(c, quote(f"length {text}")) for c, text in limits]]
    )
    return (
        condition,
        Sql(f"if({sized}, {quote(message)}, {must})"),
        Sql(expected),
        Sql(f"if({sized}, concat('length = ', {field.size}), {field.kind})"),
        None,
    )


def timestamp_checks(section: list[dict], fields: Fields, as_of: str) -> list[str]:
    """C10-C12. ``as_of`` (an expression) takes the place of the clock."""
    checks = []
    for rule in section:
        path, check = _need(rule, "field"), _need(rule, "check_type")
        field = fields.field(path)
        if check in ("format", "parseable"):
            name, expected = "parse", "parseable ISO8601 timestamp"
            condition = f"NOT ({field.is_none}) AND {field.timestamp} IS NULL"
        elif check == "not_future":
            seconds = rule.get("tolerance_seconds", 0)
            name, expected = check, f"not more than {seconds}s in future"
            condition = f"{field.timestamp} > {as_of} + make_dt_interval(0, 0, 0, {seconds})"
        elif check == "not_too_old":
            days = rule.get("max_age_days", 365)
            name, expected = check, f"not older than {days} days"
            condition = f"{field.timestamp} < {as_of} - make_dt_interval(0, 0, 0, {days} * 86400)"
        else:
            # "ISO8601" and unknown kinds never report.
            continue
        checks.append(
            fail_when(
                condition,
                f"timestamp.{name}.{path}",
                path,
                "timestamp",
                normalise_severity(rule.get("severity", FAIL)),
                rule.get("error_message", f"Timestamp validation failed for '{path}'"),
                expected,
                Sql(field.text),
            )
        )
    return checks


def _name_list(flags: list[tuple[str, str]]) -> str:
    """Python list text of the names whose flag holds."""
    named = ", ".join(f"if({flag}, {quote(repr(path))}, NULL)" for path, flag in flags)
    return f"concat('[', concat_ws(', ', array({named})), ']')"


def consistency_checks(section: list[dict], fields: Fields) -> list[str]:
    """C13 and C14. A rule with ``rules`` is conditional whatever its check type."""
    checks = []
    for rule in section:
        name = rule.get("name", "consistency_check")
        check = rule.get("check_type", "conditional")
        severity = normalise_severity(rule.get("severity", WARN))
        if check == "conditional" or "rules" in rule:
            for condition in rule.get("rules", []):
                checks.append(_conditional(condition, name, severity, fields))
        elif check == "all_or_none":
            checks.append(_all_or_none(rule, name, severity, fields))
    return checks


def _conditional(rule: dict, name: str, severity: str, fields: Fields) -> str:
    path, equals = _need(rule, "if_field"), rule.get("equals")
    required = rule.get("then_required", [])
    absent = [(p, f"NOT ({fields.field(p).exists})") for p in required]
    return fail_when(
        f"{fields.field(path).equals(equals)} AND {any_of([flag for _, flag in absent])}",
        f"consistency.{name}",
        path,
        "consistency",
        severity,
        rule.get("error_message", "Conditional requirement failed"),
        f"fields {required} present when {path}={equals}",
        Sql(f"concat('missing fields: ', {_name_list(absent)})"),
        str(rule),
    )


def _all_or_none(rule: dict, name: str, severity: str, fields: Fields) -> str:
    group = rule.get("fields", [])
    present = [(p, fields.field(p).exists) for p in group]
    absent = [(p, f"NOT ({flag})") for p, flag in present]
    return fail_when(
        f"{any_of([flag for _, flag in present])} AND NOT {all_of([flag for _, flag in present])}",
        f"consistency.all_or_none.{name}",
        ",".join(group),
        "consistency",
        severity,
        rule.get("error_message", "Field group incomplete"),
        f"all fields {group} present or all absent",
        Sql(f"concat('present: ', {_name_list(present)}, ', missing: ', {_name_list(absent)})"),
        str(rule),
    )


def row_checks(
    rules: dict, fields: Fields, as_of: str, custom: dict[str, CustomCheck] | None = None
) -> list[str]:
    """Every check that needs one row only, in the contract's order.

    ``custom_checks`` entries name a function of ``custom``; it receives the
    rule and the fields and returns an expression (see ``fail_when``).
    """
    checks = [
        *schema_checks(rules.get("schema") or {}, fields),
        *type_checks(rules.get("type_checks") or [], fields),
        *null_checks(rules.get("null_checks") or [], fields),
        *value_checks(rules.get("value_checks") or [], fields),
        *timestamp_checks(rules.get("timestamp_checks") or [], fields, as_of),
        *consistency_checks(rules.get("consistency_checks") or [], fields),
    ]
    for rule in rules.get("custom_checks") or []:
        name = _need(rule, "check")
        if not custom or name not in custom:
            raise RuleError(f"no custom check registered as {name!r}")
        checks.append(custom[name](rule, fields))
    return checks
