"""Reference answers in plain SQL (DuckDB dialect), one per catalogue query.

They are written from the semantics, not from the Spark expressions: documents
are taken apart with JSON functions and every rule is one ``SELECT``.
"""

from __future__ import annotations

from tidemark.plans import event_rules as er
from tidemark.plans.faults import AS_OF, DIRTY_EVENTS_SQL, EVENT_DOCS_SQL

ORACLES: dict[str, str] = {}

DOCS = f"event_docs AS ({EVENT_DOCS_SQL})"
DIRTY = f"dirty_events AS ({DIRTY_EVENTS_SQL})"
NOW = f"TIMESTAMP '{AS_OF}'"
CURRENT = "ts >= TIMESTAMP '2024-01-29 00:00:00' AND ts < TIMESTAMP '2024-01-30 00:00:00'"
BASELINE = "ts >= TIMESTAMP '2024-01-22 00:00:00' AND ts < TIMESTAMP '2024-01-29 00:00:00'"


def tagged(source: str) -> str:
    return (
        f"tagged AS (SELECT *, CASE WHEN {CURRENT} THEN 'current' ELSE 'baseline' END AS \"window\" "
        f"FROM {source} WHERE ({CURRENT}) OR ({BASELINE}))"
    )


def q(text: str) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def jt(path: str) -> str:
    return f"json_type(raw, '$.{path}')"


def js(path: str) -> str:
    return f"json_extract_string(raw, '$.{path}')"


def exists(path: str) -> str:
    return f"({jt(path)} IS NOT NULL)"


def is_null(path: str) -> str:
    return f"(coalesce({jt(path)}, 'NULL') = 'NULL')"


def kind(path: str) -> str:
    return (
        f"CASE {jt(path)} WHEN 'VARCHAR' THEN 'str' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' "
        f"WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'bool' WHEN 'ARRAY' THEN 'list' "
        f"WHEN 'OBJECT' THEN 'dict' WHEN 'NULL' THEN 'NoneType' ELSE 'absent' END"
    )


def text(path: str) -> str:
    return (
        f"CASE {jt(path)} WHEN 'NULL' THEN NULL WHEN 'BOOLEAN' THEN upper({js(path)}[1]) || {js(path)}[2:] "
        f"ELSE {js(path)} END"
    )


def is_a(path: str, *kinds: str) -> str:
    return f"(({kind(path)}) IN ({', '.join(map(q, kinds))}))"


def number(path: str) -> str:
    return f"(CASE {jt(path)} WHEN 'BOOLEAN' THEN CASE {js(path)} WHEN 'true' THEN 1 ELSE 0 END ELSE TRY_CAST({js(path)} AS DOUBLE) END)"


def moment(path: str) -> str:
    shape = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?Z"
    return (
        f"(CASE WHEN {jt(path)} = 'VARCHAR' AND regexp_full_match({js(path)}, '{shape}') "
        f"THEN TRY_CAST(replace(replace({js(path)}, 'T', ' '), 'Z', '') AS TIMESTAMP) END)"
    )


class Rule:
    """One failure-producing rule of the oracle side."""

    def __init__(self, name, path, check, severity, condition, message, expected="NULL", actual="NULL", definition="NULL"):
        self.name, self.path, self.check, self.severity = name, path, check, severity
        self.condition, self.message = condition, message
        self.expected, self.actual, self.definition = expected, actual, definition

    def select(self, order: int, source: str = "event_docs") -> str:
        return (
            f"SELECT rid, {order} AS ord, {q(self.name)} AS check_name, {q(self.path)} AS field_path, "
            f"{q(self.check)} AS check_type, {q(self.severity)} AS severity, "
            f"{self.message} AS error_message, {self.expected} AS expected_value, {self.actual} AS actual_value, "
            f"{self.definition} AS rule_definition FROM {source} WHERE {self.condition}"
        )


def required_rules() -> list[Rule]:
    return [
        Rule(
            f"schema.required_field.{p}", p, "schema", "WARN" if p == "public" else "FAIL", f"NOT {exists(p)}",
            q(f"Required field '{p}' is missing"), q("field present"), q("field missing"), q(f"Required field: {p}"),
        )
        for p in [*er.REQUIRED, "public"]
    ]


def optional_rules() -> list[Rule]:
    p = "payload"
    return [
        Rule(
            f"schema.optional_field.{p}", p, "schema", "WARN", f"NOT {exists(p)}",
            q(f"Optional field '{p}' is missing"), q("field present (optional)"), q("field missing"),
            q(f"Optional field: {p}"),
        )
    ]


def type_rules() -> list[Rule]:
    accepted = {"string": ["str"], "integer": ["int", "bool"], "boolean": ["bool"]}
    return [
        Rule(
            f"type_check.{p}", p, "type", "WARN" if p == "public" else "FAIL",
            f"{exists(p)} AND NOT {is_a(p, *accepted[t])}", q(f"Field '{p}' has incorrect type"), q(t), kind(p),
            q(f"Expected type: {t}"),
        )
        for p, t in er.TYPES.items()
    ]


def null_rule(p: str) -> Rule:
    return Rule(
        f"null_check.{p}", p, "null", "FAIL", is_null(p), q(f"Field '{p}' has invalid null/empty value"),
        q("non-null value"), q("null"),
    )


def empty_rule(p: str, severity: str = "FAIL") -> Rule:
    return Rule(
        f"empty_check.{p}", p, "empty", severity, f"json_extract(raw, '$.{p}')::VARCHAR IN ('\"\"', '[]', '{{}}')",
        q(f"Field '{p}' has invalid null/empty value"), q("non-empty value"), f"'empty ' || {kind(p)}",
    )


def null_and_empty_rules() -> list[Rule]:
    out = []
    for p in er.NOT_NULL:
        out.append(null_rule(p))
        if p not in er.MAY_BE_EMPTY:
            out.append(empty_rule(p))
    return out


def regex_rule(p: str, pattern: str) -> Rule:
    return Rule(
        f"value_check.regex.{p}", p, "regex", "FAIL",
        f"NOT {is_null(p)} AND NOT regexp_matches({text(p)}, {q('^(?:' + pattern + ')')})",
        q(f"Value check failed for field '{p}'"), q(f"matches pattern: {pattern}"), text(p), q(pattern),
    )


def enum_rule() -> Rule:
    allowed = ", ".join(map(q, er.EVENT_TYPES))
    return Rule(
        "value_check.enum.type", "type", "enum", "WARN",
        f"NOT {is_null('type')} AND NOT ({is_a('type', 'str')} AND {js('type')} IN ({allowed}))",
        q("Value check failed for field 'type'"), q(f"one of {er.EVENT_TYPES}"), text("type"), q(str(er.EVENT_TYPES)),
    )


def range_rule(p: str) -> Rule:
    numeric = is_a(p, "int", "float", "bool")
    return Rule(
        f"value_check.range.{p}", p, "range", "FAIL",
        f"NOT {is_null(p)} AND (NOT {numeric} OR {number(p)} < {er.MIN_ID} OR {number(p)} > {er.MAX_ID})",
        f"CASE WHEN {numeric} THEN {q(f'Value check failed for field {chr(39)}{p}{chr(39)}')} "
        f"ELSE {q(f'Field {chr(39)}{p}{chr(39)} must be numeric for range check')} END",
        f"CASE WHEN NOT {numeric} THEN 'numeric value' WHEN {number(p)} < {er.MIN_ID} THEN '>= {er.MIN_ID}' ELSE '<= {er.MAX_ID}' END",
        f"CASE WHEN {numeric} THEN {text(p)} ELSE {kind(p)} END",
    )


def regex_rules() -> list[Rule]:
    return [
        regex_rule("id", er.ID_PATTERN),
        regex_rule("actor.login", er.LOGIN_PATTERN),
        regex_rule("repo.name", er.REPO_PATTERN),
    ]


def value_rules() -> list[Rule]:
    ids, login, repo = regex_rules()
    return [ids, enum_rule(), login, repo, range_rule("actor.id"), range_rule("repo.id")]


def parse_rule() -> Rule:
    p = "created_at"
    return Rule(
        f"timestamp.parse.{p}", p, "timestamp", "FAIL", f"NOT {is_null(p)} AND {moment(p)} IS NULL",
        q(f"Timestamp validation failed for '{p}'"), q("parseable ISO8601 timestamp"), text(p),
    )


def future_rule() -> Rule:
    p = "created_at"
    return Rule(
        f"timestamp.not_future.{p}", p, "timestamp", "WARN", f"{moment(p)} > {NOW} + INTERVAL 300 SECOND",
        q(f"Timestamp validation failed for '{p}'"), q("not more than 300s in future"), text(p),
    )


def old_rule() -> Rule:
    p = "created_at"
    return Rule(
        f"timestamp.not_too_old.{p}", p, "timestamp", "WARN", f"{moment(p)} < {NOW} - INTERVAL 365 DAY",
        q(f"Timestamp validation failed for '{p}'"), q("not older than 365 days"), text(p),
    )


def name_list(paths: list[str], present: bool) -> str:
    flag = (lambda p: exists(p)) if present else (lambda p: f"NOT {exists(p)}")
    quoted = [q("'" + p + "'") for p in paths]
    parts = ", ".join(f"CASE WHEN {flag(p)} THEN {t} END" for p, t in zip(paths, quoted))
    return f"'[' || concat_ws(', ', {parts}) || ']'"


def conditional_rules() -> list[Rule]:
    return [
        Rule(
            "consistency.payload_structure_matches_event_type", "type", "consistency", "WARN",
            f"{jt('type')} = 'VARCHAR' AND {js('type')} = {q(t)} AND NOT ({' AND '.join(exists(p) for p in paths)})",
            q("Conditional requirement failed"), q(f"fields {paths} present when type={t}"),
            f"'missing fields: ' || {name_list(paths, False)}",
        )
        for t, paths in er.PAYLOAD_FIELDS.items()
    ]


def group_rules() -> list[Rule]:
    # Names and fields of the two groups.
    groups = {
        "actor_fields_consistent": ["actor.id", "actor.login", "actor.url"],
        "repo_fields_consistent": ["repo.id", "repo.name", "repo.url"],
    }
    out = []
    for group, paths in groups.items():
        some, every = " OR ".join(map(exists, paths)), " AND ".join(map(exists, paths))
        out.append(
            Rule(
                f"consistency.all_or_none.{group}", ",".join(paths), "consistency", "FAIL",
                f"({some}) AND NOT ({every})", q("Field group incomplete"),
                q(f"all fields {paths} present or all absent"),
                f"'present: ' || {name_list(paths, True)} || ', missing: ' || {name_list(paths, False)}",
            )
        )
    return out


KEYED = (
    f"keyed AS (SELECT *, CASE WHEN {is_a('id', 'str', 'int', 'float', 'bool')} THEN "
    f"CASE WHEN {jt('id')} = 'VARCHAR' THEN 's' ELSE 'n' END || {js('id')} END AS event_key FROM event_docs), "
    "ranked AS (SELECT *, CASE WHEN event_key IS NOT NULL THEN "
    "row_number() OVER (PARTITION BY event_key ORDER BY rid) ELSE 1 END AS occurrence FROM keyed)"
)


def duplicate_rules() -> list[Rule]:
    reason = f"'unhashable type: ''' || {kind('id')} || ''''"
    return [
        Rule(
            "duplicate.id", "id", "duplicate", "FAIL", "occurrence > 1", q("Duplicate event detected"),
            q("unique value"), f"'duplicate: ' || {text('id')}",
        ),
        Rule(
            "validation_engine.error", "<engine>", "system", "FAIL", is_a("id", "list", "dict"),
            f"'Validation engine error: ' || {reason}", "NULL", reason,
        ),
    ]


def all_rules() -> list[Rule]:
    return [
        *required_rules(), *optional_rules(), *type_rules(), *null_and_empty_rules(), *value_rules(),
        parse_rule(), future_rule(), old_rule(), parse_rule(), *conditional_rules(), *group_rules(), *duplicate_rules(),
    ]


FAILURE_COLUMNS = "check_name, field_path, check_type, severity, error_message, expected_value, actual_value"


def failures(rules: list[Rule], definition: bool = True, source: str = "event_docs") -> str:
    union = " UNION ALL ".join(r.select(n, source) for n, r in enumerate(rules))
    columns = FAILURE_COLUMNS + (", rule_definition" if definition else "")
    return f"SELECT rid, {columns} FROM ({union})"


def docs(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([DOCS, *ctes]) + " " + body


def dirty(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([DIRTY, *ctes]) + " " + body


# ---- B --------------------------------------------------------------------

_PATHS = ["id", "type", "actor.id", "actor.login", "repo.name", "public", "payload", "payload.commits", "org"]


def _joined(flag: str) -> str:
    parts = ", ".join(f"CASE WHEN {flag.format(exists(p))} THEN {q(p)} END" for p in _PATHS)
    return f"concat_ws('|', {parts})"


ORACLES["missing_and_present_fields"] = docs(
    f"SELECT rid, {_joined('NOT {}')} AS missing, {_joined('{}')} AS present FROM event_docs"
)
_NESTED = ["actor.login", "actor.id", "payload.size", "repo.name", "public"]
ORACLES["nested_values"] = docs(
    "SELECT rid, "
    + ", ".join(f"{text(p)} AS {p.replace('.', '_')}, {is_null(p)} AS {p.replace('.', '_')}_none" for p in _NESTED)
    + " FROM event_docs"
)
_INFERRED = {
    "str": "string", "int": "integer", "float": "float", "bool": "boolean", "list": "list", "dict": "dict",
    "NoneType": "null",
}
_TYPED = ["id", "actor", "actor.id", "public", "payload.commits", "payload.forkee", "created_at"]
ORACLES["infer_types"] = docs(
    "SELECT rid, "
    + ", ".join(
        f"CASE {kind(p)} " + " ".join(f"WHEN {q(k)} THEN {q(n)}" for k, n in _INFERRED.items()) + f" END AS {p.replace('.', '_')}"
        for p in _TYPED
    )
    + " FROM event_docs"
)
EVENT_ID = f"(CASE WHEN {is_null('id')} OR {js('id')} = '' OR {js('id')} = '0' THEN 'unknown' ELSE {text('id')} END)"
ORACLES["event_ids"] = docs(f"SELECT rid, {EVENT_ID} AS event_id FROM event_docs")
ORACLES["severity_names"] = (
    "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'WARN' WHEN 3 THEN 'WARN' "
    "WHEN 4 THEN 'INFO' WHEN 5 THEN 'WARN' END AS severity FROM orders"
)


def leaves(source: str, keep: str) -> str:
    """Leaf rows by a recursive JSON walk; members of arrays and objects themselves are left out."""
    return (
        f"leaves AS (SELECT {keep}, replace(replace(fullkey, '$.', ''), '\"', '') AS path, "
        "CASE t.type WHEN 'VARCHAR' THEN 'str' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' "
        "WHEN 'BOOLEAN' THEN 'bool' WHEN 'ARRAY' THEN 'str' ELSE 'NoneType' END AS kind, "
        "CASE t.type WHEN 'ARRAY' THEN '<array[' || json_array_length(t.value) || ']>' WHEN 'NULL' THEN NULL "
        "WHEN 'BOOLEAN' THEN upper((t.value::VARCHAR)[1]) || (t.value::VARCHAR)[2:] "
        "ELSE t.value->>'$' END AS text, t.type = 'NULL' AS is_null "
        f"FROM {source}, json_tree({source}.raw::JSON) t WHERE t.type <> 'OBJECT' AND fullkey NOT LIKE '%[%')"
    )


ORACLES["flatten_paths"] = docs(
    "SELECT rid, path, kind, text, is_null FROM leaves", leaves("event_docs", "rid")
)

# ---- C --------------------------------------------------------------------

ORACLES["check_required"] = docs(failures(required_rules()))
ORACLES["check_optional"] = docs(failures(optional_rules()))
ORACLES["check_types"] = docs(failures(type_rules()))
ORACLES["check_nulls"] = docs(failures([null_rule(p) for p in er.NOT_NULL]))
ORACLES["check_empty"] = docs(
    failures([*[empty_rule(p) for p in er.NOT_NULL if p not in er.MAY_BE_EMPTY], empty_rule("payload", "WARN")])
)
ORACLES["check_regex"] = docs(failures(regex_rules()))
ORACLES["check_enum"] = docs(failures([enum_rule()]))
ORACLES["check_range"] = docs(failures([range_rule("actor.id"), range_rule("repo.id")]))
ORACLES["check_range_table"] = """
WITH bad AS (
 SELECT l_orderkey, l_linenumber, 'value_check.range.l_discount' AS check_name, 'WARN' AS severity,
        CASE WHEN l_discount < 0.01 THEN '>= 0.01' ELSE '<= 0.09' END AS expected_value
 FROM lineitem WHERE l_discount < 0.01 OR l_discount > 0.09
 UNION ALL
 SELECT l_orderkey, l_linenumber, 'value_check.range.l_quantity', 'FAIL', CASE WHEN l_quantity < 2 THEN '>= 2' ELSE '<= 49' END
 FROM lineitem WHERE l_quantity < 2 OR l_quantity > 49
 UNION ALL
 SELECT l_orderkey, l_linenumber, 'value_check.range.l_shipdate', 'FAIL', 'numeric value' FROM lineitem WHERE l_shipdate IS NOT NULL)
SELECT check_name, severity, expected_value, count(*) AS failures, count(DISTINCT (l_orderkey, l_linenumber)) AS lines
FROM bad GROUP BY ALL"""
ORACLES["check_enum_table"] = """
SELECT o_orderkey, 'value_check.enum.o_orderpriority' AS check_name, 'o_orderpriority' AS field_path, 'enum' AS check_type,
 'FAIL' AS severity, 'Value check failed for field ''o_orderpriority''' AS error_message,
 'one of [''1-URGENT'', ''2-HIGH'', ''3-MEDIUM'']' AS expected_value, o_orderpriority AS actual_value,
 '[''1-URGENT'', ''2-HIGH'', ''3-MEDIUM'']' AS rule_definition
FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
UNION ALL
SELECT o_orderkey, 'value_check.enum.o_orderstatus', 'o_orderstatus', 'enum', 'INFO',
 'Value check failed for field ''o_orderstatus''', 'one of [''F'', 1, None]', o_orderstatus, '[''F'', 1, None]'
FROM orders WHERE o_orderstatus <> 'F'"""
ORACLES["check_regex_table"] = "\nUNION ALL\n".join(
    f"SELECT c_custkey, 'value_check.regex.{c}' AS check_name, '{c}' AS field_path, 'regex' AS check_type, '{sev}' AS severity, "
    f"'Value check failed for field ''{c}''' AS error_message, {q('matches pattern: ' + pat)} AS expected_value, "
    f"CAST({c} AS VARCHAR) AS actual_value FROM customer WHERE NOT regexp_matches(CAST({c} AS VARCHAR), {q('^(?:' + pat + ')')})"
    for c, pat, sev in [
        ("c_name", "Customer#[0-9]*[02468]$", "WARN"), ("c_mktsegment", "[A-M]", "FAIL"), ("c_nationkey", "1", "FAIL"),
    ]
)
ORACLES["check_length"] = """
SELECT doc_id, 'value_check.length.text' AS check_name, 'text' AS field_path, 'length' AS check_type, 'WARN' AS severity,
 'Value check failed for field ''text''' AS error_message,
 CASE WHEN length(text) < 50 THEN 'length >= 50' ELSE 'length <= 2000' END AS expected_value,
 'length = ' || length(text) AS actual_value, NULL AS rule_definition
FROM documents WHERE length(text) < 50 OR length(text) > 2000
UNION ALL
SELECT doc_id, 'value_check.length.lang', 'lang', 'length', 'FAIL', 'Value check failed for field ''lang''', 'length <= 2',
 'length = ' || length(lang), NULL FROM documents WHERE length(lang) > 2
UNION ALL
SELECT doc_id, 'value_check.length.n_chars', 'n_chars', 'length', 'INFO',
 'Field ''n_chars'' must have length for length check', 'string or list', 'int', NULL FROM documents WHERE n_chars IS NOT NULL"""


def _length(path: str, severity: str, sign: str, bound: int) -> Rule:
    size = (
        f"CASE {jt(path)} WHEN 'VARCHAR' THEN length({js(path)}) WHEN 'ARRAY' THEN json_array_length(raw, '$.{path}') "
        f"WHEN 'OBJECT' THEN len(json_keys(raw, '$.{path}')) END"
    )
    sized = is_a(path, "str", "list", "dict")
    allowed = ">=" if sign == "<" else "<="
    return Rule(
        f"value_check.length.{path}", path, "length", severity,
        f"NOT {is_null(path)} AND (NOT {sized} OR {size} {sign} {bound})",
        f"CASE WHEN {sized} THEN {q(f'Value check failed for field {chr(39)}{path}{chr(39)}')} "
        f"ELSE {q(f'Field {chr(39)}{path}{chr(39)} must have length for length check')} END",
        f"CASE WHEN {sized} THEN 'length {allowed} {bound}' ELSE 'string or list' END",
        f"CASE WHEN {sized} THEN 'length = ' || ({size}) ELSE {kind(path)} END",
    )


ORACLES["check_length_document"] = docs(
    failures(
        [
            _length("payload.commits", "FAIL", "<", 3), _length("actor.login", "WARN", ">", 6),
            _length("payload", "INFO", ">", 8), _length("repo.id", "FAIL", "<", 1),
        ]
    )
)
ORACLES["check_ts_parse"] = docs(failures([parse_rule(), parse_rule()]))
ORACLES["check_not_future"] = docs(failures([future_rule()]))
ORACLES["check_not_too_old"] = docs(failures([old_rule()]))
ORACLES["check_too_old_table"] = f"""
SELECT o_orderkey, 'timestamp.not_too_old.o_orderdate' AS check_name, 'not older than 10000 days' AS expected_value
FROM orders WHERE o_orderdate < {NOW} - INTERVAL 10000 DAY"""
ORACLES["check_conditional"] = docs(failures(conditional_rules(), definition=False))
ORACLES["check_all_or_none"] = docs(failures(group_rules(), definition=False))
ORACLES["dup_seen_before"] = dirty("""
SELECT event_id, user_id IS NOT NULL AND event_type IS NOT NULL AND
 row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS is_duplicate FROM dirty_events""")
_LOOKBACK = """
SELECT event_id, coalesce(user_id IS NOT NULL AND event_type IS NOT NULL AND
 epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) < {0}000000, false) AS is_duplicate
FROM {1}"""
ORACLES["dup_lookback"] = dirty(_LOOKBACK.format(3600, "dirty_events"))
ORACLES["dup_against_history"] = dirty(
    f"SELECT event_id, is_duplicate FROM marked WHERE {CURRENT}",
    "marked AS (SELECT d.ts, m.* FROM (" + _LOOKBACK.format(7200, f"(SELECT * FROM dirty_events WHERE ({CURRENT}) OR ({BASELINE}))")
    + ") m JOIN dirty_events d USING (event_id))",
)
ORACLES["duplicate_key_error"] = docs(failures(duplicate_rules(), source="ranked"), KEYED)
ORACLES["adhoc_checks"] = docs(
    f"""
SELECT rid, 'schema.required.' || p AS check_name, 'FAIL' AS severity, 'Required field ''' || p || ''' is missing' AS error_message,
 'field present' AS expected_value, 'field missing' AS actual_value
FROM (SELECT rid, 'id' AS p FROM event_docs WHERE NOT {exists('id')} UNION ALL
      SELECT rid, 'payload.commits' FROM event_docs WHERE NOT {exists('payload.commits')})
UNION ALL SELECT rid, 'type_check.id', 'WARN', 'Field ''id'' has incorrect type', 'string', {kind('id')} FROM event_docs
 WHERE {exists('id')} AND NOT {is_a('id', 'str')}
UNION ALL SELECT rid, 'type_check.public', 'WARN', 'Field ''public'' has incorrect type', 'boolean', {kind('public')} FROM event_docs
 WHERE {exists('public')} AND NOT {is_a('public', 'bool')}
UNION ALL SELECT rid, 'regex.repo', 'FAIL', 'Value does not match pattern', 'matches org/', {js('repo.name')} FROM event_docs
 WHERE NOT regexp_matches({js('repo.name')}, '^org/')
UNION ALL SELECT rid, 'regex.broken', 'FAIL', 'Invalid regex pattern', 'org[', 'invalid pattern' FROM event_docs
UNION ALL SELECT rid, 'enum.type', 'FAIL', 'Value not in allowed list', 'one of [''PushEvent'', ''ForkEvent'']', {js('type')} FROM event_docs
 WHERE {js('type')} NOT IN ('PushEvent', 'ForkEvent')
UNION ALL SELECT rid, 'timestamp.created', 'FAIL', 'Invalid timestamp format', 'ISO8601 format', {text('created_at')} FROM event_docs
 WHERE {moment('created_at')} IS NULL"""
)
ORACLES["custom_check"] = """
SELECT p_partkey, 'custom.modulus' AS check_name, 'custom' AS check_type, 'Divisible' AS error_message
FROM part WHERE p_size % 5 = 0"""

# ---- D --------------------------------------------------------------------

FAILED = "failed AS (" + " UNION ALL ".join(r.select(n, "ranked") for n, r in enumerate(all_rules())) + ")"
VALIDATED = (
    f"validated AS (SELECT r.rid, r.ts, r.raw, {EVENT_ID} AS event_id, "
    "coalesce(f.criticals, 0) AS criticals, coalesce(f.warnings, 0) AS warnings, coalesce(f.n, 0) AS n, "
    "coalesce(f.names, '') AS failed_checks, coalesce(f.messages, '') AS error_messages, "
    "CASE WHEN f.criticals > 0 THEN 'FAIL' WHEN f.warnings > 0 THEN 'WARN' ELSE 'PASS' END AS status, "
    "CASE WHEN f.criticals > 0 THEN 'CRITICAL' WHEN f.warnings > 0 THEN 'WARNING' ELSE 'PASS' END AS severity "
    "FROM event_docs r LEFT JOIN (SELECT rid, count(*) FILTER (WHERE severity = 'FAIL') AS criticals, "
    "count(*) FILTER (WHERE severity = 'WARN') AS warnings, count(*) AS n, "
    "string_agg(check_name, '|' ORDER BY ord) AS names, string_agg(error_message, '|' ORDER BY ord) AS messages "
    "FROM failed GROUP BY rid) f ON r.rid = f.rid)"
)


def valid(body: str, *ctes: str) -> str:
    return docs(body, KEYED, FAILED, VALIDATED, *ctes)


ORACLES["validate_status"] = valid(
    f"SELECT rid, event_id, 'events_raw' AS table_name, status, {NOW} AS validation_ts FROM validated"
)
ORACLES["validate_severity"] = valid("SELECT status, severity, count(*) AS events FROM validated GROUP BY ALL")
ORACLES["failed_checks_list"] = valid("SELECT rid, failed_checks, error_messages FROM validated")
ORACLES["failure_groups"] = valid(
    "SELECT rid, CAST(criticals AS INTEGER) AS critical_failures, CAST(warnings AS INTEGER) AS warning_failures FROM validated"
)
ORACLES["failure_details"] = valid(f"SELECT rid, {FAILURE_COLUMNS} FROM failed")
ORACLES["field_severity"] = valid("""
SELECT rid, field_path, CASE max(CASE severity WHEN 'FAIL' THEN 3 WHEN 'WARN' THEN 2 ELSE 1 END)
 WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'WARNING' ELSE 'INFO' END AS severity, count(*) AS failures FROM failed GROUP BY rid, field_path""")
ORACLES["event_summary"] = valid("""
SELECT rid, CAST(n + 1 AS INTEGER) AS total_checks, CAST(criticals AS INTEGER) AS critical_failures,
 CAST(warnings AS INTEGER) AS warning_failures, CASE WHEN status = 'PASS' THEN 1 ELSE 0 END AS passed FROM validated""")
ORACLES["result_metadata"] = docs(f"SELECT rid, '1.0' AS rules_version, {text('type')} AS event_type, 'tidemark' AS validation_engine FROM event_docs")
ORACLES["validate_table"] = dirty("""
SELECT CAST(event_id AS VARCHAR) AS event_id,
 CASE WHEN user_id IS NULL OR event_type NOT IN ('click', 'view', 'purchase', 'signup', 'error') THEN 'FAIL'
      WHEN event_type IS NULL OR event_type = '' OR bad_value OR late THEN 'WARN' ELSE 'PASS' END AS status,
 CASE WHEN user_id IS NULL OR event_type NOT IN ('click', 'view', 'purchase', 'signup', 'error') THEN 'CRITICAL'
      WHEN event_type IS NULL OR event_type = '' OR bad_value OR late THEN 'WARNING' ELSE 'PASS' END AS severity,
 concat_ws('|', 'schema.required_field.missing_column', CASE WHEN value IS NULL THEN 'type_check.value' END,
  CASE WHEN user_id IS NULL THEN 'null_check.user_id' END,
  CASE WHEN event_type IS NULL THEN 'null_check.event_type' WHEN event_type = '' THEN 'empty_check.event_type' END,
  CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup', 'error') THEN 'value_check.enum.event_type' END,
  CASE WHEN bad_value THEN 'value_check.range.value' END, CASE WHEN late THEN 'timestamp.not_future.ts' END) AS failed_checks
FROM (SELECT *, coalesce(NOT isnan(value) AND (value < 0 OR value > 500), false) AS bad_value, ts > TIMESTAMP '2024-01-30 00:00:00' AS late
      FROM dirty_events)""").replace("WHEN user_id IS NULL OR event_type NOT IN", "WHEN value IS NULL OR user_id IS NULL OR event_type NOT IN")

# ---- A --------------------------------------------------------------------

ORACLES["gate_processed"] = valid(
    f"SELECT event_id, {js('repo.name')} AS repo_name, ts AS processed_at, status AS validation_status FROM validated WHERE status <> 'FAIL'"
)
ORACLES["gate_should_process"] = valid("SELECT status, count(*) AS events FROM validated WHERE status <> 'FAIL' GROUP BY status")
ORACLES["gate_quarantine"] = valid("SELECT rid, event_id, failed_checks FROM validated WHERE status = 'FAIL'")

_STRICT = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z"
_CREATED = (
    f"CASE WHEN {jt('created_at')} = 'VARCHAR' AND regexp_full_match({js('created_at')}, '{_STRICT}') "
    f"THEN TRY_CAST(replace(replace({js('created_at')}, 'T', ' '), 'Z', '') AS TIMESTAMP) END"
)
_BIG = {p: f"CASE WHEN {jt(p)} = 'DOUBLE' THEN CAST(round(CAST({js(p)} AS DOUBLE)) AS BIGINT) WHEN {jt(p)} <> 'BOOLEAN' THEN TRY_CAST({js(p)} AS BIGINT) END"
        for p in ("repo.id", "actor.id", "payload.push_id")}
_FLAT = f"""flat AS (SELECT rid, ts, {js('id')} AS event_id, {js('type')} AS event_type, {_BIG['repo.id']} AS repo_id,
 {js('repo.name')} AS repo_name, {js('repo.url')} AS repo_url, {_BIG['actor.id']} AS actor_id, {js('actor.login')} AS actor_login,
 {js('actor.url')} AS actor_url, {js('actor.avatar_url')} AS actor_avatar, {js('payload.ref')} AS payload_ref,
 {js('payload.head')} AS payload_head, {js('payload.before')} AS payload_before, {_BIG['payload.push_id']} AS push_id,
 CASE WHEN {js('public')} IN ('true', 'yes') THEN true WHEN {js('public')} IN ('false', 'no') THEN false END AS public,
 {_CREATED} AS created_at,
 concat_ws('|', CASE WHEN NOT {exists('id')} OR {is_a('id', 'list', 'dict')} THEN 'event_id' END,
  CASE WHEN NOT {exists('type')} THEN 'event_type' END, CASE WHEN NOT {exists('repo.id')} THEN 'repo_id' END,
  CASE WHEN NOT {exists('repo.name')} THEN 'repo_name' END, CASE WHEN NOT {exists('repo.url')} THEN 'repo_url' END,
  CASE WHEN NOT {exists('actor.id')} OR {jt('actor.id')} = 'BOOLEAN' THEN 'actor_id' END,
  CASE WHEN NOT {exists('actor.login')} THEN 'actor_login' END, CASE WHEN NOT {exists('actor.url')} THEN 'actor_url' END,
  CASE WHEN NOT {exists('actor.avatar_url')} THEN 'actor_avatar' END, CASE WHEN NOT {exists('public')} THEN 'public' END,
  CASE WHEN {_CREATED} IS NULL THEN 'created_at' END, CASE WHEN NOT {is_a('payload', 'dict')} THEN 'payload' END) AS rejected
 FROM event_docs)"""
_FLAT_COLUMNS = (
    "event_id, event_type, repo_id, repo_name, repo_url, actor_id, actor_login, actor_url, actor_avatar, "
    "payload_ref, payload_head, payload_before, push_id, public, created_at"
)
ORACLES["flatten_events"] = docs(f"SELECT rid, {_FLAT_COLUMNS} FROM flat WHERE rejected = ''", _FLAT)
ORACLES["flatten_rejects"] = docs("SELECT rid, rejected FROM flat WHERE rejected <> ''", _FLAT)
ORACLES["insert_if_absent"] = docs(
    f"""SELECT rid, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY rid) AS k
    FROM flat WHERE rejected = '') WHERE (k = 1 OR event_id IS NULL) AND NOT coalesce(event_id IN
    (SELECT event_id FROM flat WHERE rejected = '' AND event_id IS NOT NULL AND {BASELINE}), false)""",
    _FLAT,
)
ORACLES["publish_rows"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS key, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey ||
 ',"o_orderstatus":"' || o_orderstatus || '"}' AS value FROM orders"""
ORACLES["publish_documents"] = docs(f"SELECT {text('id')} AS key, {js('repo.name')} AS repo_name, {js('type')} AS type FROM event_docs")
ORACLES["time_range_scan"] = "WITH " + tagged("events") + ' SELECT event_id, ts, "window" FROM tagged'
ORACLES["dead_letter"] = docs(
    "SELECT rid, raw[:-2] AS raw, 'invalid JSON' AS reason FROM event_docs WHERE rid % 37 = 0"
)
ORACLES["decoded_messages"] = docs(f"SELECT rid, {js('type')} AS type FROM event_docs WHERE rid % 37 <> 0")
_ARCHIVE = docs(
    "SELECT strftime(ts, '%Y-%m-%d') AS ingest_date, count(*) AS events, CAST(sum(length(raw)) AS BIGINT) AS chars "
    "FROM event_docs GROUP BY 1"
)
ORACLES["archive_by_date"] = _ARCHIVE
_BYTES = "count(*) AS messages, CAST(sum(octet_length(encode(raw))) AS BIGINT) AS bytes FROM event_docs"
ORACLES["ingest_stats"] = docs(f"SELECT {_BYTES}")
ORACLES["ingest_observed"] = docs(f"SELECT count(*) AS rows_written, {_BYTES}")
ORACLES["results_roundtrip"] = valid(
    f"SELECT event_id, status, failed_checks, CAST(n AS INTEGER) AS failures, CAST(rid % 210 AS DOUBLE) AS processing_time_ms, "
    f"{text('type')} AS event_type, ts AS validation_ts FROM validated"
)

# ---- E --------------------------------------------------------------------

ORACLES["run_stats"] = valid("""
SELECT count(*) AS total_validated, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'WARN') AS warned,
 count(*) FILTER (WHERE status = 'FAIL') AS failed, CAST(sum(n) AS BIGINT) AS total_failures,
 round(count(*) FILTER (WHERE status = 'PASS') / count(*), 9) AS pass_rate,
 round(count(*) FILTER (WHERE status = 'WARN') / count(*), 9) AS warn_rate,
 round(count(*) FILTER (WHERE status = 'FAIL') / count(*), 9) AS fail_rate,
 round(CAST(sum(n) AS DOUBLE) / count(*), 9) AS avg_failures_per_event
FROM validated WHERE failed_checks NOT LIKE '%validation_engine.error%'""")
ORACLES["status_counters"] = valid("""
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'WARN') AS warned,
 count(*) FILTER (WHERE status = 'FAIL') AS failed, round(count(*) FILTER (WHERE status = 'PASS') / count(*), 9) AS pass_rate FROM validated""")
ORACLES["failures_by_check_type"] = valid("SELECT check_type, count(*) AS failures FROM failed GROUP BY check_type")
ORACLES["failures_by_severity"] = valid("SELECT severity, count(*) AS failures FROM failed GROUP BY severity")
_BUCKETS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0]
ORACLES["duration_histogram"] = (
    "WITH d AS (SELECT value * 10 / 1000 AS s FROM events WHERE value <> 0) SELECT le, "
    "CAST(CASE WHEN le = '+Inf' THEN (SELECT count(*) FROM d) ELSE (SELECT count(*) FROM d WHERE s <= TRY_CAST(le AS DOUBLE)) END AS BIGINT) "
    "AS cumulative_count, round((SELECT sum(s) FROM d), 4) AS duration_sum, (SELECT count(*) FROM d) AS duration_count "
    f"FROM (SELECT unnest([{', '.join(q(b) for b in _BUCKETS)}, '+Inf']) AS le)"
)
ORACLES["recent_results"] = valid("""
SELECT event_id, status, CAST(n AS INTEGER) AS failures, ts AS validation_ts, rid FROM validated WHERE status <> 'PASS' ORDER BY ts DESC, rid DESC LIMIT 10""")
ORACLES["alert_conditions"] = valid("""
SELECT fr > 0.05 AS high_failure_rate, wr > 0.2 AS high_warning_rate, d > 0.1 AS slow_validation, false AS no_data,
 round(fr, 9) AS failure_rate, round(wr, 9) AS warning_rate, round(d, 9) AS avg_duration_seconds
FROM (SELECT count(*) FILTER (WHERE status = 'FAIL') / count(*) AS fr, count(*) FILTER (WHERE status = 'WARN') / count(*) AS wr,
      avg(CASE WHEN rid % 210 <> 0 THEN (rid % 210) / 1000.0 END) AS d FROM validated)""")
ORACLES["stats_between"] = valid("""
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'WARN') AS warned,
 count(*) FILTER (WHERE status = 'FAIL') AS failed, round(avg(CAST(rid % 210 AS DOUBLE)), 9) AS avg_processing_time_ms,
 min(ts) AS earliest_validation, max(ts) AS latest_validation,
 round(count(*) FILTER (WHERE status = 'PASS') / count(*), 9) AS pass_rate,
 round(count(*) FILTER (WHERE status = 'WARN') / count(*), 9) AS warn_rate,
 round(count(*) FILTER (WHERE status = 'FAIL') / count(*), 9) AS fail_rate
FROM validated WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'""")
ORACLES["recent_failures"] = valid("""
SELECT CAST(rid AS VARCHAR) AS event_id, 'events_raw' AS table_name, status, failed_checks, severity, ts AS validation_ts, CAST(n AS INTEGER) AS failures
FROM validated WHERE status <> 'PASS' AND severity = 'CRITICAL' ORDER BY ts DESC, CAST(rid AS VARCHAR) LIMIT 50""")
ORACLES["hourly_fail_rate"] = valid("""
SELECT date_trunc('hour', ts) AS hour, count(*) AS total, round(100.0 * count(*) FILTER (WHERE status = 'FAIL') / count(*), 9) AS fail_rate
FROM validated GROUP BY 1""")
ORACLES["top_failing_checks"] = valid("SELECT check_name, count(*) AS failures FROM failed GROUP BY check_name")
ORACLES["batch_type_counts"] = docs(f"SELECT {js('type')} AS event_type, count(*) AS events FROM event_docs GROUP BY 1")
ORACLES["batch_size"] = "SELECT count(*) AS batch_size FROM events"

# ---- F --------------------------------------------------------------------


def profile_ctes(source: str, cap: int = 1000) -> list[str]:
    """Schema profile over ``leaves`` (window, ts, path, kind, text, is_null) and ``tagged``."""
    return [
        "sizes AS (SELECT \"window\", count(*) AS rows FROM tagged GROUP BY 1)",
        "votes AS (SELECT \"window\", path, kind, count(*) AS n, min(ts) AS seen FROM leaves WHERE kind <> 'NoneType' GROUP BY ALL)",
        "winner AS (SELECT \"window\", path, kind FROM votes QUALIFY row_number() OVER "
        "(PARTITION BY \"window\", path ORDER BY n DESC, seen, kind DESC) = 1)",
        "profile AS (SELECT l.\"window\", l.path AS field, coalesce(max(w.kind), 'null') AS type, count(*) FILTER (WHERE is_null) > 0 AS nullable, "
        "round(count(*) FILTER (WHERE is_null) / max(s.rows), 4) AS null_ratio, count(*) AS present_count, "
        "round(count(*) / max(s.rows), 4) AS presence_ratio, "
        f"least(count(DISTINCT text), {cap}) AS cardinality, count(DISTINCT text) < {cap} AS cardinality_exact, max(s.rows) AS rows "
        "FROM leaves l JOIN sizes s USING (\"window\") LEFT JOIN winner w ON w.\"window\" = l.\"window\" AND w.path = l.path GROUP BY 1, 2)",
    ]


DOC_PROFILE = [tagged("event_docs"), leaves("tagged", '"window", ts'), *profile_ctes("tagged")]
_PROFILE_COLUMNS = (
    '"window", field, type, nullable, null_ratio, present_count, presence_ratio, cardinality, cardinality_exact'
)
ORACLES["schema_profile"] = docs(f"SELECT {_PROFILE_COLUMNS} FROM profile", *DOC_PROFILE)
ORACLES["capped_cardinality"] = docs(
    'SELECT "window", field, cardinality, cardinality_exact FROM profile',
    tagged("event_docs"), leaves("tagged", '"window", ts'), *profile_ctes("tagged", 50),
)
_TABLE_LEAVES = "leaves AS (" + " UNION ALL ".join(
    f"SELECT \"window\", ts, '{c}' AS path, CASE WHEN {c} IS NULL THEN 'NoneType' ELSE '{k}' END AS kind, "
    f"CAST({c} AS VARCHAR) AS text, {c} IS NULL AS is_null FROM tagged"
    for c, k in [("event_id", "int"), ("user_id", "int"), ("event_type", "str"), ("value", "float"), ("props", "str")]
) + ")"
TABLE_PROFILE = [tagged("dirty_events"), _TABLE_LEAVES, *profile_ctes("tagged")]
ORACLES["schema_profile_table"] = dirty(f"SELECT {_PROFILE_COLUMNS} FROM profile", *TABLE_PROFILE)

EVENTS = [
    tagged("dirty_events"),
    "vals AS (SELECT \"window\", 'event_type' AS field, event_type AS value, ts FROM tagged UNION ALL "
    "SELECT \"window\", 'user_id', CAST(user_id AS VARCHAR), ts FROM tagged)",
    "counts AS (SELECT \"window\", field, value, count(*) AS n, min(ts) AS seen FROM vals WHERE value IS NOT NULL GROUP BY ALL)",
    "cats AS (SELECT *, n / sum(n) OVER w AS proportion, count(*) OVER w AS categories FROM counts "
    "WINDOW w AS (PARTITION BY \"window\", field) QUALIFY categories <= 100)",
    "tops AS (SELECT \"window\", field, value, n, row_number() OVER (PARTITION BY \"window\", field ORDER BY n DESC, seen, value) AS rank FROM counts)",
    "nums AS (SELECT \"window\", 'value' AS field, CASE WHEN NOT isnan(value) THEN value END AS value FROM tagged UNION ALL "
    "SELECT \"window\", 'user_id', CAST(user_id AS DOUBLE) FROM tagged)",
    "stats AS (SELECT \"window\", field, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, min(value) AS min, max(value) AS max, "
    "count(*) AS n FROM nums WHERE value IS NOT NULL GROUP BY ALL)",
    "nulls AS (SELECT \"window\", 'event_type' AS field, avg(CASE WHEN event_type IS NULL THEN 1.0 ELSE 0 END) AS null_ratio FROM tagged GROUP BY 1 "
    "UNION ALL SELECT \"window\", 'user_id', avg(CASE WHEN user_id IS NULL THEN 1.0 ELSE 0 END) FROM tagged GROUP BY 1 "
    "UNION ALL SELECT \"window\", 'value', avg(CASE WHEN value IS NULL OR isnan(value) THEN 1.0 ELSE 0 END) FROM tagged GROUP BY 1)",
    "sides AS (SELECT count(*) FILTER (WHERE \"window\" = 'baseline') AS nb, count(*) FILTER (WHERE \"window\" = 'current') AS nc FROM tagged)",
]


def evs(body: str, *ctes: str) -> str:
    return dirty(body, *EVENTS, *ctes)


ORACLES["categorical_profile"] = evs(
    'SELECT "window", field, value, n, round(proportion, 9) AS proportion, categories FROM cats'
)
ORACLES["null_ratios"] = evs(
    "SELECT \"window\", field, round(null_ratio, 9) AS null_ratio FROM nulls UNION ALL SELECT \"window\", 'props', 1.0 FROM tagged GROUP BY 1"
)
ORACLES["numeric_profile"] = evs(
    'SELECT "window", field, round(mean, 3) AS mean, round(std, 3) AS std, round(min, 6) AS min, round(max, 6) AS max, n FROM stats'
)


def quantiles(group: str, source: str) -> str:
    picks = ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (50, 95, 99))
    return f'SELECT "window", field, {picks} FROM {source} WHERE value IS NOT NULL GROUP BY {group}'


ORACLES["percentiles"] = evs(quantiles('"window", field', "nums"))
ORACLES["percentiles_lineitem"] = (
    "WITH nums AS (SELECT l_returnflag AS \"window\", 'l_extendedprice' AS field, l_extendedprice AS value FROM lineitem "
    "UNION ALL SELECT l_returnflag, 'l_quantity', l_quantity FROM lineitem) " + quantiles('"window", field', "nums")
)
ORACLES["numeric_profile_document"] = docs(
    "SELECT \"window\", field, round(round(avg(value), 4), 3) AS mean, round(round(stddev_pop(value), 4), 3) AS std, min(value) AS min, "
    "max(value) AS max, count(*) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 "
    "FROM nums WHERE value IS NOT NULL GROUP BY 1, 2",
    tagged("event_docs"),
    f"nums AS (SELECT \"window\", 'payload.size' AS field, {number('payload.size')} AS value FROM tagged UNION ALL "
    f"SELECT \"window\", 'actor.id', {number('actor.id')} FROM tagged)",
)
ORACLES["volume_total"] = evs('SELECT "window", count(*) AS rows FROM tagged GROUP BY 1')
ORACLES["entity_top_n"] = evs('SELECT "window", field, value, n, CAST(rank AS INTEGER) AS rank FROM tops WHERE rank <= 5')
ORACLES["profile_lookup"] = (
    "WITH "
    + ", ".join(
        [
            DOCS, DIRTY,
            *[c.replace("tagged", "dtagged").replace("leaves AS", "dleaves AS") for c in [tagged("event_docs")]],
            leaves("dtagged", '"window", ts'), *[c.replace("tagged", "dtagged") for c in profile_ctes("tagged")],
            *EVENTS,
        ]
    )
    + """
SELECT 'field' AS question, field AS name, CAST(NULL AS DOUBLE) AS answer FROM profile WHERE "window" = 'current'
UNION ALL SELECT 'type', type, CAST(cardinality AS DOUBLE) FROM profile WHERE "window" = 'baseline' AND field = 'payload.k'
UNION ALL SELECT 'share', value, round(proportion, 9) FROM cats WHERE "window" = 'current' AND field = 'event_type'
UNION ALL SELECT 'mean', field, round(mean, 3) FROM stats WHERE "window" = 'current' AND field = 'value'
UNION ALL SELECT 'count', 'purchase', CAST(coalesce(max(n), 0) AS DOUBLE) FROM tops WHERE "window" = 'current' AND field = 'event_type' AND value = 'purchase' AND rank <= 50
UNION ALL SELECT 'top', value, CAST(n AS DOUBLE) FROM tops WHERE "window" = 'baseline' AND field = 'event_type' AND rank <= 3"""
)

# ---- G --------------------------------------------------------------------

ORACLES["drift_window_bounds"] = evs(
    'SELECT "window", count(*) AS rows, min(ts) AS first, max(ts) AS last FROM tagged GROUP BY 1'
)
ORACLES["drift_gate"] = evs(
    "SELECT nb AS baseline_rows, nc AS current_rows FROM sides WHERE nb >= 300 AND nc >= 300"
)

SCHEMA_PAIR = (
    "pair AS (SELECT coalesce(b.field, c.field) AS field, b.type AS bt, c.type AS ct, b.cardinality AS bc, c.cardinality AS cc, "
    "b.field IS NOT NULL AS hb, c.field IS NOT NULL AS hc, b.nullable AS bn, c.nullable AS cn "
    "FROM (SELECT * FROM profile WHERE \"window\" = 'baseline') b FULL JOIN (SELECT * FROM profile WHERE \"window\" = 'current') c ON b.field = c.field)"
)
_FIELD_DRIFT = """
SELECT 'schema' AS drift_type, 'schema' AS entity, field AS field_name, 'field_added' AS metric_name,
 CASE WHEN cn THEN 'INFO' ELSE 'WARNING' END AS severity, CAST(CASE WHEN cn THEN 0.5 ELSE 0.8 END AS DOUBLE) AS drift_score{0} FROM pair WHERE NOT hb
UNION ALL SELECT 'schema', 'schema', field, 'field_removed', 'CRITICAL', CAST(1 AS DOUBLE){0} FROM pair WHERE NOT hc"""
_TYPE_DRIFT = """
SELECT 'schema' AS drift_type, 'schema' AS entity, field AS field_name, 'type_change' AS metric_name,
 CASE WHEN bt <> ct THEN 'CRITICAL' ELSE 'NONE' END AS severity, CAST(CASE WHEN bt <> ct THEN 1 ELSE 0 END AS DOUBLE) AS drift_score{0} FROM pair WHERE hb AND hc"""
_CARD_DRIFT = """
SELECT 'schema' AS drift_type, 'schema' AS entity, field AS field_name, 'cardinality_explosion' AS metric_name,
 CASE WHEN cc / bc >= 5 THEN 'CRITICAL' WHEN cc / bc >= 2 THEN 'WARNING' ELSE 'NONE' END AS severity,
 round(CASE WHEN cc / bc >= 5 THEN least(1.0, cc / bc / 10) WHEN cc / bc >= 2 THEN cc / bc / 10 ELSE 0.0 END, 6) AS drift_score{0}
FROM pair WHERE hb AND hc AND bc > 0 AND cc > 0"""
ORACLES["drift_fields"] = docs(_FIELD_DRIFT.format(", CAST(1 AS BIGINT) AS checks"), *DOC_PROFILE, SCHEMA_PAIR)
ORACLES["drift_types"] = docs(
    _TYPE_DRIFT.format(", bt AS baseline_value, ct AS current_value, CAST(2 AS BIGINT) AS checks"), *DOC_PROFILE, SCHEMA_PAIR
)
ORACLES["drift_cardinality"] = docs(
    _CARD_DRIFT.format(", CAST(bc AS VARCHAR) AS baseline_value, CAST(cc AS VARCHAR) AS current_value"),
    tagged("event_docs"), leaves("tagged", '"window", ts'), *profile_ctes("tagged", 400), SCHEMA_PAIR,
)
_PSI_PAIR = [
    "psi_pair AS (SELECT field, value, max(proportion) FILTER (WHERE \"window\" = 'baseline') AS b, "
    "max(proportion) FILTER (WHERE \"window\" = 'current') AS c FROM cats GROUP BY ALL)",
    "psi AS (SELECT field, count(b) > 0 AS hb, count(b) > 0 AND count(c) > 0 AS common, "
    "abs(sum((greatest(coalesce(c, 0), 1e-10) - greatest(coalesce(b, 0), 1e-10)) * "
    "ln(greatest(coalesce(c, 0), 1e-10) / greatest(coalesce(b, 0), 1e-10)))) AS psi FROM psi_pair GROUP BY field)",
]
_PSI_DRIFT = """
SELECT 'distribution' AS drift_type, 'categorical' AS entity, field AS field_name, 'psi' AS metric_name,
 CASE WHEN NOT common THEN 'NONE' WHEN psi >= 0.25 THEN 'CRITICAL' WHEN psi >= 0.1 THEN 'WARNING' ELSE 'NONE' END AS severity,
 round(CASE WHEN NOT common OR psi < 0.1 THEN 0.0 ELSE least(1.0, psi / 0.5) END, {1}) AS drift_score{0} FROM psi"""
ORACLES["drift_psi"] = evs(
    _PSI_DRIFT.format(", round(CASE WHEN common THEN psi END, 6) AS psi, CAST(hb AS BIGINT) AS checks", 6), *_PSI_PAIR
)
ORACLES["drift_top_values"] = evs("""
SELECT "window", field, value, round(proportion, 9) AS proportion, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "window", field
 ORDER BY proportion DESC, value) AS rank FROM cats) WHERE rank <= 5""")
_MEAN_PAIR = (
    "mean_pair AS (SELECT coalesce(b.field, c.field) AS field, CASE WHEN b.std > 0 THEN abs(c.mean - b.mean) / b.std ELSE 0 END AS shift "
    "FROM (SELECT * FROM stats WHERE \"window\" = 'baseline') b JOIN (SELECT * FROM stats WHERE \"window\" = 'current') c ON b.field = c.field)"
)
_MEAN_DRIFT = """
SELECT 'distribution' AS drift_type, 'numerical' AS entity, field AS field_name, 'mean_shift' AS metric_name,
 CASE WHEN shift >= 3 THEN 'CRITICAL' WHEN shift >= 2 THEN 'WARNING' WHEN shift >= 1 THEN 'INFO' ELSE 'NONE' END AS severity,
 round(CASE WHEN shift >= 1 THEN least(1.0, shift / 5) ELSE 0.0 END, 3) AS drift_score{0} FROM mean_pair"""
ORACLES["drift_mean_shift"] = evs(_MEAN_DRIFT.format(", round(shift, 3) AS shift"), _MEAN_PAIR)
_NULL_PAIR = (
    "null_pair AS (SELECT b.field, abs(c.null_ratio - b.null_ratio) AS change "
    "FROM (SELECT * FROM nulls WHERE \"window\" = 'baseline') b JOIN (SELECT * FROM nulls WHERE \"window\" = 'current') c ON b.field = c.field)"
)
_NULL_DRIFT = """
SELECT 'distribution' AS drift_type, 'null_ratio' AS entity, field AS field_name, 'null_ratio_change' AS metric_name,
 CASE WHEN change >= 0.25 THEN 'CRITICAL' WHEN change >= 0.1 THEN 'WARNING' ELSE 'NONE' END AS severity,
 round(CASE WHEN change >= 0.1 THEN least(1.0, change / 0.5) ELSE 0.0 END, {1}) AS drift_score{0} FROM null_pair"""
ORACLES["drift_null_ratio"] = evs(_NULL_DRIFT.format(", round(change, 6) AS change", 6), _NULL_PAIR)
_RATE_DRIFT = """
SELECT 'volume' AS drift_type, 'global' AS entity, CAST(NULL AS VARCHAR) AS field_name, 'event_rate_change' AS metric_name,
 CASE WHEN abs(z) >= 3 OR abs(pct) >= 0.5 THEN 'CRITICAL' WHEN abs(z) >= 2 OR abs(pct) >= 0.2 THEN 'WARNING' ELSE 'NONE' END AS severity,
 round(CASE WHEN abs(z) >= 3 OR abs(pct) >= 0.5 THEN least(1.0, abs(z) / 5) WHEN abs(z) >= 2 OR abs(pct) >= 0.2 THEN abs(z) / 5 ELSE 0.0 END, {1})
 AS drift_score{0} FROM rate"""
_RATE = "rate AS (SELECT (nc / 24 - nb / 168) / (nb / 168 * 0.1) AS z, (nc / 24 - nb / 168) / (nb / 168) AS pct FROM sides)"
ORACLES["drift_global_rate"] = evs(_RATE_DRIFT.format(", round(z, 6) AS z", 6), _RATE)
ORACLES["drift_global_history"] = evs(
    _RATE_DRIFT.format(", round(z, 6) AS z", 6),
    "periods AS (SELECT floor(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) / 604800) AS p, count(*) AS n FROM dirty_events "
    "WHERE ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts < TIMESTAMP '2024-01-22 00:00:00' GROUP BY 1)",
    "rate AS (SELECT (nc / 24 - m / 168) / (CASE WHEN s > 0 THEN s / 168 ELSE nb / 168 * 0.1 END) AS z, (nc / 24 - nb / 168) / (nb / 168) AS pct "
    "FROM sides, (SELECT avg(n) AS m, stddev_pop(n) AS s FROM periods))",
)
_ENTITY_PAIR = (
    "entity_pair AS (SELECT coalesce(b.field, c.field) AS field, coalesce(b.value, c.value) AS value, b.n AS bn, c.n AS cn, b.rank AS br, "
    "(c.n - b.n) / b.n AS change FROM (SELECT * FROM tops WHERE \"window\" = 'baseline' AND rank <= 50) b FULL JOIN "
    "(SELECT * FROM tops WHERE \"window\" = 'current' AND rank <= 50) c ON b.field = c.field AND b.value = c.value)"
)
_ENTITY_DRIFT = """
SELECT 'volume' AS drift_type, field AS entity, value AS field_name, 'entity_count_change' AS metric_name,
 CASE WHEN abs(change) >= 0.5 THEN 'WARNING' WHEN abs(change) >= 0.2 THEN 'INFO' ELSE 'NONE' END AS severity,
 round(CASE WHEN abs(change) >= 0.2 THEN least(1.0, abs(change)) ELSE 0.0 END, {1}) AS drift_score{0} FROM entity_pair"""
ORACLES["drift_entities"] = evs(
    _ENTITY_DRIFT.format(", round(change, 6) AS change, CAST(coalesce(br, 0) = 1 AS BIGINT) AS checks", 6), _ENTITY_PAIR
)
ORACLES["drift_entities_normalized"] = evs(
    _ENTITY_DRIFT.format(", round(change, 6) AS change", 6) + " WHERE field = 'event_type'",
    _ENTITY_PAIR.replace("(c.n - b.n) / b.n AS change", "(c.n / 24 - b.n / 168) / (b.n / 168) AS change"),
)

# A run over the event table: both CTE sets share ``tagged``.
RUN_CTES = [*TABLE_PROFILE, SCHEMA_PAIR, *EVENTS[1:], *_PSI_PAIR, _MEAN_PAIR, _NULL_PAIR, _RATE, _ENTITY_PAIR]
_ONE, _TWO, _ZERO = ", CAST(1 AS BIGINT) AS checks", ", CAST(2 AS BIGINT) AS checks", ", CAST(0 AS BIGINT) AS checks"


def run_cte(cardinality: bool = True, entities: bool = True) -> str:
    parts = [
        _FIELD_DRIFT.format(_ONE),
        _TYPE_DRIFT.format(_TWO),
        _CARD_DRIFT.format(_ZERO) if cardinality
        else "SELECT 'schema', 'schema', field, 'cardinality_explosion', 'NONE', 0.0, CAST(0 AS BIGINT) FROM pair WHERE hb AND hc AND bc > 0 AND cc > 0",
        _PSI_DRIFT.format(", CAST(hb AS BIGINT) AS checks", 6),
        _MEAN_DRIFT.format(_ONE),
        _NULL_DRIFT.format(_ZERO, 6),
        _RATE_DRIFT.format(_ONE, 6),
    ]
    if entities:
        parts.append(_ENTITY_DRIFT.format(", CAST(coalesce(br, 0) = 1 AS BIGINT) AS checks", 6))
    return (
        "run AS (SELECT * FROM (" + " UNION ALL ".join(f"({p})" for p in parts)
        + ") WHERE (SELECT nb >= 100 AND nc >= 100 FROM sides))"
    )


# ``value`` alone is the numeric field of the run.
_RUN_CTES = [c.replace("FROM stats WHERE \"window\" = 'baseline'", "FROM stats WHERE field = 'value' AND \"window\" = 'baseline'") for c in RUN_CTES]
_RUN_COLUMNS = "drift_type, entity, field_name, metric_name, severity, round(drift_score, 3) AS drift_score"
ORACLES["drift_run"] = dirty(f"SELECT {_RUN_COLUMNS} FROM run WHERE severity <> 'NONE'", *_RUN_CTES, run_cte())
ORACLES["drift_switches"] = dirty(f"SELECT {_RUN_COLUMNS} FROM run", *_RUN_CTES, run_cte(False, False))
ORACLES["drift_summary"] = dirty("""
SELECT CAST(coalesce(sum(checks), 0) AS BIGINT) AS total_checks, count(*) FILTER (WHERE severity <> 'NONE') AS total_drifts,
 count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_count, count(*) FILTER (WHERE severity = 'WARNING') AS warning_count,
 count(*) FILTER (WHERE severity = 'INFO') AS info_count FROM run""", *_RUN_CTES, run_cte())
ORACLES["drift_by_type"] = dirty(
    "SELECT drift_type, count(*) AS drifts FROM run WHERE severity <> 'NONE' GROUP BY 1", *_RUN_CTES, run_cte()
)
ORACLES["drift_roundtrip"] = dirty(
    f"SELECT drift_type, entity, field_name, metric_name, severity, {NOW} AS detected_at, TIMESTAMP '2024-01-22 00:00:00' AS baseline_start, "
    f"{NOW} AS current_end FROM run WHERE severity <> 'NONE'",
    *_RUN_CTES, run_cte(),
)
_DOC_VALS = [
    "vals AS (" + " UNION ALL ".join(
        f"SELECT \"window\", '{p}' AS field, {text(p)} AS value, ts FROM tagged" for p in ("type", "actor.login", "repo.name")
    ) + ")",
    *EVENTS[2:5],
    f"nums AS (SELECT \"window\", 'payload.size' AS field, {number('payload.size')} AS value FROM tagged)",
    EVENTS[6],
    "nulls AS (" + " UNION ALL ".join(
        f"SELECT \"window\", '{p}' AS field, avg(CASE WHEN {is_null(p)} THEN 1.0 ELSE 0 END) AS null_ratio FROM tagged GROUP BY 1"
        for p in ("type", "actor.login", "repo.name", "payload.size")
    ) + ")",
    EVENTS[8],
]
ORACLES["drift_run_documents"] = docs(
    f"SELECT {_RUN_COLUMNS} FROM run WHERE severity <> 'NONE'",
    *DOC_PROFILE, SCHEMA_PAIR, *_DOC_VALS, *_PSI_PAIR, _MEAN_PAIR, _NULL_PAIR, _RATE, _ENTITY_PAIR, run_cte(),
)

_DRIFTS = """drifts AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'schema' WHEN 1 THEN 'distribution' ELSE 'volume' END AS drift_type,
 l_returnflag AS entity, 'f' || (l_suppkey % 40) AS field_name, 'm' || l_orderkey || '.' || l_linenumber AS metric_name, l_discount * 10 AS drift_score,
 CASE WHEN l_quantity < 5 THEN 'CRITICAL' WHEN l_quantity < 12 THEN 'WARNING' ELSE 'INFO' END AS severity, l_shipdate AS detected_at FROM lineitem)"""
_DC = "drift_type, entity, field_name, metric_name, severity, detected_at"
ORACLES["drift_recent"] = (
    f"WITH {_DRIFTS} SELECT {_DC} FROM drifts ORDER BY detected_at DESC, drift_type, entity, field_name, metric_name LIMIT 100"
)
ORACLES["drift_critical"] = (
    f"WITH {_DRIFTS} SELECT {_DC} FROM drifts WHERE severity = 'CRITICAL' AND detected_at >= TIMESTAMP '1998-09-01 00:00:00' - INTERVAL 2400 HOUR"
)
ORACLES["drift_frequency"] = f"WITH {_DRIFTS} SELECT drift_type, severity, count(*) AS drifts FROM drifts GROUP BY ALL"
ORACLES["drift_hot_fields"] = (
    f"WITH {_DRIFTS} SELECT entity, field_name, count(*) AS drift_count, round(max(drift_score), 9) AS max_score FROM drifts GROUP BY ALL "
    "ORDER BY drift_count DESC, max(drift_score) DESC, entity, field_name LIMIT 10"
)
ORACLES["drift_report"] = (
    f"WITH {_DRIFTS}, r AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY drift_score DESC, drift_type, entity, field_name, metric_name) AS k FROM drifts) "
    "SELECT severity, drift_type, entity, field_name, metric_name, round(drift_score, 9) AS drift_score, CAST(NULL AS BIGINT) AS more FROM r "
    "WHERE severity <> 'INFO' OR k <= 10 UNION ALL SELECT 'INFO', NULL, NULL, NULL, NULL, NULL, count(*) - 10 FROM r WHERE severity = 'INFO' HAVING count(*) > 10"
)

# ---- H --------------------------------------------------------------------

_SCHEMAS = 'schemas AS (SELECT "window", field, type, present_count / rows AS frequency, rows AS sample_size FROM profile)'
_SP = (
    "sp AS (SELECT coalesce(b.field, c.field) AS field, b.type AS bt, c.type AS ct, b.frequency AS bf, c.frequency AS cf "
    "FROM (SELECT * FROM schemas WHERE \"window\" = 'baseline') b FULL JOIN (SELECT * FROM schemas WHERE \"window\" = 'current') c ON b.field = c.field)"
)
ORACLES["extract_schema"] = docs(
    'SELECT "window", field, type, round(frequency, 9) AS frequency, sample_size FROM schemas', *DOC_PROFILE, _SCHEMAS
)
ORACLES["compare_schemas"] = docs("""
SELECT field, 'new_field' AS change FROM sp WHERE bt IS NULL UNION ALL SELECT field, 'missing_field' FROM sp WHERE ct IS NULL
UNION ALL SELECT field, 'type_change' FROM sp WHERE bt <> ct UNION ALL SELECT field, 'frequency_change' FROM sp WHERE abs(bf - cf) > 0.01""",
    *DOC_PROFILE, _SCHEMAS, _SP)
ORACLES["new_fields"] = docs("SELECT field FROM sp WHERE bt IS NULL", *DOC_PROFILE, _SCHEMAS, _SP)
ORACLES["missing_or_rare_fields"] = docs(
    "SELECT field, round(coalesce(cf, 0.0), 9) AS frequency FROM sp WHERE bt IS NOT NULL AND coalesce(cf, 0) < 0.985", *DOC_PROFILE, _SCHEMAS, _SP
)
ORACLES["schema_drift_failures"] = docs("""
SELECT 'drift.schema.' || change || '.' || field AS check_name, field AS field_path, 'schema_drift' AS check_type, 'WARN' AS severity,
 'Schema drift: ' || change AS error_message, bt AS expected_value, ct AS actual_value
FROM (SELECT *, CASE WHEN bt IS NULL THEN 'new_field' WHEN ct IS NULL THEN 'missing_field' WHEN bt <> ct THEN 'type_change' END AS change FROM sp)
WHERE change IS NOT NULL""", *DOC_PROFILE, _SCHEMAS, _SP)
ORACLES["distribution"] = evs(
    'SELECT "window", field, value, n, round(proportion, 9) AS proportion, categories FROM '
    "(SELECT *, n / sum(n) OVER w AS proportion, count(*) OVER w AS categories FROM counts WHERE field = 'user_id' WINDOW w AS (PARTITION BY \"window\", field))"
)
_CHI = (
    "chi AS (SELECT field, sum((c - b * tc / tb) ** 2 / (b * tc / tb)) AS statistic, CAST(count(*) - 1 AS BIGINT) AS freedom FROM ("
    "SELECT field, value, coalesce(sum(n) FILTER (WHERE \"window\" = 'baseline'), 0)::DOUBLE AS b, coalesce(sum(n) FILTER (WHERE \"window\" = 'current'), 0)::DOUBLE AS c, "
    "sum(sum(n) FILTER (WHERE \"window\" = 'baseline')) OVER (PARTITION BY field)::DOUBLE AS tb, sum(sum(n) FILTER (WHERE \"window\" = 'current')) OVER (PARTITION BY field)::DOUBLE AS tc "
    "FROM counts WHERE field = 'event_type' GROUP BY field, value) GROUP BY field)"
)
# 18.475 is the 1 % point and 14.067 the 5 % point for 7 degrees; the event types give 6.
_CRITICAL = "(CASE freedom WHEN 4 THEN 9.4877 WHEN 5 THEN 11.0705 WHEN 6 THEN 12.5916 WHEN 7 THEN 14.0671 END)"
ORACLES["chi_square"] = evs(
    f"SELECT field, round(statistic, 4) AS statistic, freedom, statistic > {_CRITICAL} AS drift_detected, CAST(0.05 AS DOUBLE) AS significance_level FROM chi", _CHI
)
ORACLES["distribution_drift_failures"] = evs(
    "SELECT 'drift.distribution.' || field AS check_name, 'distribution_drift' AS check_type, 'WARN' AS severity, 'p >= 0.05' AS expected_value "
    f"FROM chi WHERE statistic > {_CRITICAL}",
    _CHI,
)
_KS_P = "(SELECT sum(CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0 * k * k * l * l)) FROM range(1, 101) t(k))"
ORACLES["distribution_drift_failures_all"] = evs(
    f"""
SELECT 'drift.distribution.' || kind || field AS check_name, field AS field_path, 'distribution_drift' AS check_type, 'WARN' AS severity,
 'p >= 0.05' AS expected_value
FROM (SELECT '' AS kind, field FROM chi WHERE statistic > {_CRITICAL}
 UNION ALL SELECT 'ks.', field FROM (SELECT *, sqrt(nb::DOUBLE * nc / (nb + nc)) * d AS l FROM ks) WHERE l >= 0.2 AND {_KS_P} < 0.05
 UNION ALL SELECT 'histogram.', field FROM hist WHERE x > 0 AND (SELECT sum(exp(-x / 2 + (a + n) * ln(x / 2) - lgamma(a + n + 1))) FROM range(0, 20000) t(n)) > 0.95)""",
    _CHI,
    "steps AS (SELECT field, value, count(*) FILTER (WHERE \"window\" = 'baseline') AS b, count(*) FILTER (WHERE \"window\" = 'current') AS c "
    "FROM nums WHERE value IS NOT NULL GROUP BY ALL)",
    "tot AS (SELECT field, sum(b)::DOUBLE AS nb, sum(c)::DOUBLE AS nc, min(value) AS low, max(value) AS high FROM steps GROUP BY field)",
    "cum AS (SELECT field, sum(b) OVER o AS ub, sum(c) OVER o AS uc FROM steps WINDOW o AS (PARTITION BY field ORDER BY value))",
    "ks AS (SELECT field, nb, nc, max(abs(ub / nb - uc / nc)) AS d FROM cum JOIN tot USING (field) WHERE nb > 0 AND nc > 0 GROUP BY ALL)",
    "bins AS (SELECT field, nb, nc, sum(b) AS b, sum(c) AS c FROM steps JOIN tot USING (field) WHERE nb > 0 AND nc > 0 "
    "GROUP BY field, nb, nc, CASE WHEN high = low THEN 1 ELSE least(50, CAST(floor((value - low) / (high - low) * 50) AS INTEGER) + 1) END)",
    "hist AS (SELECT field, sum((b - nb * (b + c) / (nb + nc)) ** 2 / (nb * (b + c) / (nb + nc)) + (c - nc * (b + c) / (nb + nc)) ** 2 / (nc * (b + c) / (nb + nc))) AS x, "
    "(count(*) - 1) / 2.0 AS a FROM bins GROUP BY field)",
)
ORACLES["ks_two_sample"] = evs(
    """
SELECT field, round(statistic, 6) AS statistic, baseline_n, current_n,
 round(CASE WHEN l < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, (SELECT sum(CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0 * k * k * l * l)) FROM range(1, 101) t(k)))) END, 6) AS p_value,
 CASE WHEN l >= 0.2 AND (SELECT sum(CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0 * k * k * l * l)) FROM range(1, 101) t(k)) < 0.01 THEN 'WARNING'
      WHEN l >= 0.2 AND (SELECT sum(CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0 * k * k * l * l)) FROM range(1, 101) t(k)) < 0.05 THEN 'INFO' ELSE 'NONE' END AS severity
FROM (SELECT *, sqrt(baseline_n::DOUBLE * current_n / (baseline_n + current_n)) * statistic AS l FROM ks)""",
    "steps AS (SELECT field, value, count(*) FILTER (WHERE \"window\" = 'baseline') AS b, count(*) FILTER (WHERE \"window\" = 'current') AS c "
    "FROM nums WHERE value IS NOT NULL GROUP BY ALL)",
    "cum AS (SELECT field, sum(b) OVER o AS ub, sum(c) OVER o AS uc, sum(b) OVER (PARTITION BY field) AS tb, sum(c) OVER (PARTITION BY field) AS tc "
    "FROM steps WINDOW o AS (PARTITION BY field ORDER BY value))",
    "ks AS (SELECT field, max(abs(ub / tb - uc / tc)) AS statistic, CAST(max(tb) AS BIGINT) AS baseline_n, CAST(max(tc) AS BIGINT) AS current_n FROM cum GROUP BY field)",
)
ORACLES["histogram_compare"] = evs(
    """SELECT field, bin, round(low + (bin - 1) * (high - low) / 50, 6) AS lower, count(*) FILTER (WHERE "window" = 'baseline') AS baseline_n,
 count(*) FILTER (WHERE "window" = 'current') AS current_n
FROM (SELECT n.*, low, high, CASE WHEN high = low THEN 1 ELSE least(50, CAST(floor((value - low) / (high - low) * 50) AS INTEGER) + 1) END AS bin
 FROM nums n JOIN ext USING (field) WHERE value IS NOT NULL) GROUP BY field, bin, low, high""",
    "ext AS (SELECT field, min(value) AS low, max(value) AS high FROM nums GROUP BY field)",
)

# ---- S: a replayed stream must equal its batch form -----------------------

ORACLES["stream_validate"] = ORACLES["validate_severity"]
# an event that cannot be flattened is in neither table
ORACLES["stream_processed"] = valid(
    "SELECT event_id, status AS validation_status FROM validated WHERE status <> 'FAIL' AND rid IN (SELECT rid FROM flat WHERE rejected = '')",
    _FLAT,
)
ORACLES["stream_flat"] = valid(
    "SELECT event_id, event_type, repo_id, public, created_at FROM flat WHERE rejected = '' AND rid IN (SELECT rid FROM validated WHERE status <> 'FAIL')",
    _FLAT,
)
ORACLES["stream_dup_report"] = valid("SELECT rid, event_id FROM validated WHERE '|' || failed_checks || '|' LIKE '%|duplicate.id|%'")
ORACLES["stream_dedup"] = docs(f"SELECT DISTINCT coalesce({text('id')}, '~' || rid) AS event_id FROM event_docs")
ORACLES["stream_counters"] = docs(
    "SELECT date_trunc('hour', ts) AS hour, count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS passed, "
    "count(*) FILTER (WHERE status = 'WARN') AS warned, count(*) FILTER (WHERE status = 'FAIL') AS failed, "
    "round(100.0 * count(*) FILTER (WHERE status = 'FAIL') / count(*), 9) AS fail_rate FROM validated GROUP BY 1",
    KEYED,
    "failed AS (" + " UNION ALL ".join(r.select(n, "ranked") for n, r in enumerate(all_rules()[:-2])) + ")",
    VALIDATED,
)
ORACLES["stream_archive"] = _ARCHIVE
# a key is repeated if it came less than an hour before
ORACLES["stream_replay"] = docs(
    "SELECT rid, event_id, failed_checks FROM validated WHERE status = 'FAIL'",
    KEYED.replace(
        "row_number() OVER (PARTITION BY event_key ORDER BY rid)",
        "CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_key ORDER BY ts, rid)) < 3600000000 THEN 2 ELSE 1 END",
    ),
    FAILED,
    VALIDATED,
)
# rollups of parts, merged, are the full aggregate
ORACLES["rollup_fail_rate"] = ORACLES["hourly_fail_rate"]
ORACLES["rollup_stats_between"] = ORACLES["stats_between"]
