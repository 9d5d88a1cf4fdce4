"""The flat event table (A5): typed columns out of a document, rejects beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.functions.once import evaluate_once
from tidemark.functions.paths import DocumentField, DocumentFields
from tidemark.functions.pytext import strict_utc_timestamp
from tidemark.functions.sqltext import all_of, case, name, quote

# Flat column, document path, column type.
FLAT_COLUMNS = [
    ("event_id", "id", "text"),
    ("event_type", "type", "text"),
    ("repo_id", "repo.id", "bigint"),
    ("repo_name", "repo.name", "text"),
    ("repo_url", "repo.url", "text"),
    ("actor_id", "actor.id", "bigint"),
    ("actor_login", "actor.login", "text"),
    ("actor_url", "actor.url", "text"),
    ("actor_avatar", "actor.avatar_url", "text"),
    ("payload_ref", "payload.ref", "text"),
    ("payload_head", "payload.head", "text"),
    ("payload_before", "payload.before", "text"),
    ("push_id", "payload.push_id", "bigint"),
    ("public", "public", "boolean"),
    ("created_at", "created_at", "timestamp"),
]
OPTIONAL_PATHS = {"payload.ref", "payload.head", "payload.before", "payload.push_id"}


def _typed(field: DocumentField, kind: str) -> tuple[str, str]:
    """The column's value, and whether a value of another type can be stored in it."""
    if kind == "text":
        stored = case([(field.is_kind("bool"), f"lower({field.text})"), (field.is_kind("str", "int", "float"), field.text)])
    elif kind == "bigint":
        stored = case(
            [
                (field.is_kind("str"), f"try_cast(trim({field.text}) AS BIGINT)"),
                (field.is_kind("int"), f"try_cast({field.text} AS BIGINT)"),
                (field.is_kind("float"), f"try_cast(round({field.number}) AS BIGINT)"),
            ]
        )
    elif kind == "boolean":
        word = f"lower(trim({field.text}))"
        stored = case(
            [
                (f"{field.is_kind('bool', 'str')} AND {word} IN ('true', 't', 'yes', 'y', 'on', '1')", "true"),
                (f"{field.is_kind('bool', 'str')} AND {word} IN ('false', 'f', 'no', 'n', 'off', '0')", "false"),
            ]
        )
    else:
        stored = case([(field.is_kind("str"), strict_utc_timestamp(field.text))])
        return stored, f"({stored}) IS NOT NULL"
    return stored, f"({field.is_none} OR ({stored}) IS NOT NULL)"


def flatten_events(df: DataFrame, doc: str = "doc", keep: list[str] | None = None) -> DataFrame:
    """A5: the flat columns and ``rejected``, the columns that made the row unusable.

    A mandatory key must exist (its value may be null), the payload must be an
    object, ``created_at`` must have the one accepted form, and values must
    fit their column. Use ``flat_rows`` and ``flat_rejects`` to split.
    """
    keep = keep or []
    fields = DocumentFields(doc, tag="e")
    columns, reasons = {}, []
    for column, path, kind in FLAT_COLUMNS:
        field = fields.field(path)
        stored, fits = _typed(field, kind)
        columns[f"flat_{column}"] = stored
        good = fits if path in OPTIONAL_PATHS else all_of([field.exists, fits])
        reasons.append(f"if({good}, NULL, {quote(column)})")
    payload = fields.field("payload")
    reasons.append(f"if({payload.is_kind('dict')}, NULL, 'payload')")
    made = evaluate_once(
        fields.attach(df), **columns, rejected=f"array_compact(array({', '.join(reasons)}))"
    )
    return made.selectExpr(
        *[name(k) for k in keep], *[f"flat_{column} AS {column}" for column, _, _ in FLAT_COLUMNS], "rejected"
    )


def flat_rows(flattened: DataFrame) -> DataFrame:
    """The rows of the flat table."""
    return flattened.filter("size(rejected) = 0").drop("rejected")


def flat_rejects(flattened: DataFrame) -> DataFrame:
    """The rows that cannot be stored, with the columns at fault."""
    return flattened.filter("size(rejected) > 0")
