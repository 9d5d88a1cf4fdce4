"""Evaluate an expensive expression once per row."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.functions.sqltext import name


def evaluate_once(df: DataFrame, **columns: str) -> DataFrame:
    """Add columns that later filters cannot copy below their definition.

    Catalyst pushes a filter through a projection by substituting the
    projected expression, so ``parse -> check -> filter(status)`` would parse
    and check every row twice or more. A one-element ``inline`` is a narrow
    step whose outputs are opaque to that substitution, while predicates on
    the other columns still move down to the scan.
    """
    kept = [name(c) for c in df.columns if c not in columns]
    staged = df.selectExpr(*kept, *[f"{sql} AS __once_{column}" for column, sql in columns.items()])
    record = ", ".join(f"'{column}', __once_{column}" for column in columns)
    return staged.selectExpr(*kept, f"inline(array(named_struct({record})))")
