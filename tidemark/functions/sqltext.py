"""Small helpers for expressions written as Spark SQL text.

Rule sets compile to one SQL expression. Building the same tree through
Column calls costs thousands of driver round trips per plan.
"""

from __future__ import annotations


def quote(value) -> str:
    """A string literal; NULL for None."""
    if value is None:
        return "CAST(NULL AS STRING)"
    escaped = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def name(column: str) -> str:
    """A quoted column name (one part)."""
    return "`" + column.replace("`", "``") + "`"


def dotted(path: str) -> str:
    """A quoted reference to a nested column."""
    return ".".join(name(part) for part in path.split("."))


def any_of(conditions: list[str]) -> str:
    return "(" + " OR ".join(conditions) + ")" if conditions else "false"


def all_of(conditions: list[str]) -> str:
    return "(" + " AND ".join(conditions) + ")" if conditions else "true"


def case(branches: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + f" ELSE {otherwise} END"
