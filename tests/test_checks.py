"""Hand-worked cases of the row checks, in document mode unless noted."""

import pytest

from tidemark.functions.paths import DocumentFields, TableFields
from tidemark.operators.checks import RuleError
from tidemark.operators.validate import validate

AS_OF = "2024-01-30 00:00:00"


@pytest.fixture
def failures(documents):
    def run(rules, *texts, **options):
        out = validate(documents(*texts), rules, AS_OF, DocumentFields(), **options).orderBy("rid").collect()
        return [[(f["check_name"], f["severity"], f["actual_value"]) for f in r["failures"]] for r in out]

    return run


def names(rows):
    return [[f[0] for f in row] for row in rows]


PRESENCE = {
    "schema": {"required_fields": [{"path": "id"}]},
    "type_checks": [{"field": "id", "expected_type": "string"}],
    "null_checks": [{"field": "id", "allow_null": False}],
}


def test_null_and_absent_differ(failures):
    assert names(failures(PRESENCE, '{"id":null}', "{}", '{"id":"7"}')) == [
        ["type_check.id", "null_check.id"],
        ["schema.required_field.id", "null_check.id"],
        [],
    ]


def test_null_parent_is_absent_below(failures):
    rules = {
        "schema": {"required_fields": [{"path": "a"}, {"path": "a.b"}]},
        "type_checks": [{"field": "a.b", "expected_type": "string"}],
    }
    assert names(failures(rules, '{"a":null}', '{"a":{"b":null}}', '{"a":[1]}')) == [
        ["schema.required_field.a.b"],
        ["type_check.a.b"],
        ["schema.required_field.a.b"],
    ]


def test_booleans_are_integers_and_numbers(failures):
    rules = {
        "type_checks": [{"field": "a", "expected_type": t} for t in ("integer", "number", "float", "boolean", "strange")],
        "value_checks": [{"field": "a", "check_type": "range", "min_value": 1, "max_value": 5}],
    }
    found = failures(rules, '{"a":true}', '{"a":1.0}', '{"a":3}', '{"a":1e3}', '{"a":12345678901234567890}')
    assert [[f[2] for f in row] for row in found] == [
        ["bool", "bool"],
        ["float", "float", "float"],
        ["int", "int", "int"],
        ["float", "float", "float", "1000.0"],
        ["int", "int", "int", "12345678901234567890"],
    ]


def test_range_of_text_and_order_of_bounds(failures):
    rules = {"value_checks": [{"field": "a", "check_type": "range", "min_value": 1, "max_value": 50}]}
    found = failures(rules, '{"a":"12"}', '{"a":0.5}', '{"a":51}', '{"a":50}')
    assert found == [
        [("value_check.range.a", "FAIL", "str")],
        [("value_check.range.a", "FAIL", "0.5")],
        [("value_check.range.a", "FAIL", "51")],
        [],
    ]


def test_large_integer_bounds_are_exact(failures):
    rules = {"value_checks": [{"field": "a", "check_type": "range", "max_value": 9007199254740993}]}
    assert names(failures(rules, '{"a":9007199254740993}', '{"a":9007199254740994}')) == [[], ["value_check.range.a"]]


def test_regex_is_anchored_at_the_start_only(failures):
    rules = {"value_checks": [{"field": "a", "check_type": "regex", "pattern": "ab"}]}
    assert names(failures(rules, '{"a":"abc"}', '{"a":"xab"}', '{"a":"x\\nab"}')) == [
        [], ["value_check.regex.a"], ["value_check.regex.a"],
    ]


def test_last_valid_regex_wins_for_its_field(failures):
    rules = {
        "value_checks": [
            {"field": "a", "check_type": "regex", "pattern": "x"},
            {"field": "a", "check_type": "regex", "pattern": "y"},
            {"field": "a", "check_type": "regex", "pattern": "("},
            {"field": "b", "check_type": "regex", "pattern": "("},
        ]
    }
    assert [len(r) for r in failures(rules, '{"a":"x","b":"q"}', '{"a":"y"}')] == [3, 0]


def test_named_groups_and_text_of_booleans(failures):
    rules = {
        "value_checks": [
            {"field": "a", "check_type": "regex", "pattern": r"(?P<c>[a-z])(?P=c)\Z"},
            {"field": "b", "check_type": "regex", "pattern": "True$"},
        ]
    }
    assert names(failures(rules, '{"a":"zz","b":true}', '{"a":"zy","b":"true"}')) == [
        [], ["value_check.regex.a", "value_check.regex.b"],
    ]


def test_enum_uses_typed_equality(failures):
    def enum(allowed, *texts):
        rules = {"value_checks": [{"field": "a", "check_type": "enum", "allowed_values": allowed}]}
        return [len(r) for r in failures(rules, *texts)]

    assert enum([1], '{"a":"1"}', '{"a":1.0}', '{"a":true}', '{"a":2}') == [1, 0, 0, 1]
    assert enum([[1, 2]], '{"a":[1,2]}', '{"a":[2]}') == [0, 1]
    assert enum([], '{"a":1}', "{}") == [1, 0]


def test_empty_values_by_type(failures):
    rules = {"null_checks": [{"field": "a", "allow_empty": False}]}
    found = failures(rules, '{"a":""}', '{"a":[]}', '{"a":{}}', '{"a":0}', "{}", '{"a":" "}')
    assert [[f[2] for f in r] for r in found] == [["empty str"], ["empty list"], ["empty dict"], [], [], []]


def test_length_counts_code_points_and_members(failures):
    rules = {"value_checks": [{"field": "a", "check_type": "length", "min_length": 2, "max_length": 3}]}
    found = failures(rules, '{"a":"äö"}', '{"a":"😀"}', '{"a":[1,2,3,4]}', '{"a":{"x":1,"y":2}}', '{"a":5}')
    assert [[f[2] for f in r] for r in found] == [[], ["length = 1"], ["length = 4"], [], ["int"]]


def test_only_info_failures_pass(documents):
    rules = {"schema": {"required_fields": [{"path": "x", "severity": "info"}], "optional_fields": [{"path": "y", "severity": "INFO"}]}}
    row = validate(documents("{}"), rules, AS_OF, DocumentFields()).collect()[0]
    assert (row["status"], row["severity"], row["failed_checks"]) == ("PASS", "PASS", ["schema.required_field.x"])


def test_timestamp_kinds(failures):
    kinds = ["format", "parseable", "ISO8601", "not_future", "not_too_old"]
    rules = {"timestamp_checks": [{"field": "t", "check_type": k} for k in kinds]}
    assert names(failures(rules, '{"t":"x"}', '{"t":20240101}', '{"t":"2024-01-30T00:00:01Z"}', '{"t":"2022-01-01"}')) == [
        ["timestamp.parse.t"] * 2,
        ["timestamp.parse.t"] * 2,
        ["timestamp.not_future.t"],
        ["timestamp.not_too_old.t"],
    ]


def test_conditional_on_absent_value(failures):
    rules = {"consistency_checks": [{"name": "n", "rules": [{"if_field": "a", "equals": None, "then_required": ["b", "c"]}]}]}
    found = failures(rules, "{}", '{"a":null,"b":1,"c":null}', '{"a":1}')
    assert found == [[("consistency.n", "WARN", "missing fields: ['b', 'c']")], [], []]


def test_duplicates_after_failures_and_unusable_keys(failures):
    rules = {
        "type_checks": [{"field": "id", "expected_type": "string"}],
        "duplicate_check": {"enabled": True, "key_field": "id"},
    }
    texts = ['{"id":1}', '{"id":1.0}', '{"id":"1"}', '{"id":true}', '{"id":null}', "{}", '{"id":[1]}', '{"id":"1"}']
    found = names(failures(rules, *texts, order_by=["rid"]))
    assert found == [
        ["type_check.id"],
        ["type_check.id", "duplicate.id"],
        [],
        ["type_check.id", "duplicate.id"],
        ["type_check.id"],
        [],
        ["type_check.id", "validation_engine.error"],
        ["duplicate.id"],
    ]


def test_event_id_of_falsy_values(documents):
    texts = ['{"id":""}', '{"id":0}', '{"id":false}', '{"id":[]}', '{"id":{}}', "{}", '{"id":5}', '{"id":"a"}', '{"id":0.0}']
    rows = validate(documents(*texts), {}, AS_OF, DocumentFields()).orderBy("rid").collect()
    assert [r["event_id"] for r in rows] == ["unknown"] * 6 + ["5", "a", "unknown"]


@pytest.mark.parametrize(
    "rules",
    [
        {"type_checks": [{"expected_type": "string"}]},
        {"value_checks": [{"field": "a"}]},
        {"value_checks": [{"field": "a", "check_type": "range", "min_value": "1"}]},
        {"value_checks": [{"field": "a", "check_type": "enum", "allowed_values": None}]},
        {"consistency_checks": [{"rules": [{"equals": 1}]}]},
        {"custom_checks": [{"check": "nobody"}]},
    ],
)
def test_malformed_rules_are_rejected_when_compiled(documents, rules):
    with pytest.raises(RuleError):
        validate(documents("{}"), rules, AS_OF, DocumentFields())


def test_repeated_keys_keep_the_last(failures):
    rules = {"value_checks": [{"field": "a", "check_type": "enum", "allowed_values": [2]}]}
    assert failures(rules, '{"a":1,"a":2}') == [[]]


def test_awkward_names_and_texts(failures):
    rules = {
        "schema": {"required_fields": [{"path": "it's", "description": "a \\ and a 'quote'"}]},
        "value_checks": [{"field": "it's", "check_type": "enum", "allowed_values": ["o'neil\\"]}],
    }
    assert failures(rules, '{"it\'s":"o\'neil\\\\"}', "{}") == [[], [("schema.required_field.it's", "FAIL", "field missing")]]


def test_table_mode_nan_and_types(spark):
    df = spark.createDataFrame(
        [(1, float("nan"), True, "2024-13-01"), (2, 9.0, None, "2024-02-01 10:00:00")],
        "id long, x double, flag boolean, t string",
    )
    rules = {
        "value_checks": [
            {"field": "x", "check_type": "range", "max_value": 5},
            {"field": "flag", "check_type": "range", "min_value": 2},
        ],
        "timestamp_checks": [{"field": "t", "check_type": "parseable"}, {"field": "t", "check_type": "not_future"}],
        "schema": {"required_fields": [{"path": "gone"}]},
    }
    rows = validate(df, rules, AS_OF, TableFields(df)).orderBy("id").collect()
    assert [r["failed_checks"] for r in rows] == [
        ["schema.required_field.gone", "value_check.range.flag", "timestamp.parse.t"],
        ["schema.required_field.gone", "value_check.range.x", "timestamp.not_future.t"],
    ]


def test_duplicates_of_landed_rows(spark):
    """Landed or not, the results are the same; rows that tie for the first of a key leave one of them."""
    from tidemark.plans.event_rules import event_rules
    from tidemark.sources.events import decode, decoded

    texts = ['{"id": "a"}', '{"id": 1}', '{"id": 1.0}', '{"id": [1]}', '{"id": null}', "{}", '{"id": "1"}'] * 3
    raw = spark.createDataFrame([(n, n // 7, t) for n, t in enumerate(texts)], "rid long, at long, raw string").repartition(4)
    events = decoded(decode(raw))
    options = {"rules": event_rules(), "as_of": AS_OF}

    def rows(df):
        return sorted((r.rid, r.status, r.event_id, [tuple(f) for f in r.failures], tuple(sorted(r.metadata.items()))) for r in df.collect())

    whole = validate(events, fields=DocumentFields(), order_by=["rid"], **options)
    once = validate(events, fields=DocumentFields(), order_by=["rid"], keep=["rid"], **options)
    assert rows(whole) == rows(once) and "doc" in whole.columns and "doc" not in once.columns
    tied = validate(events.filter("at = 0"), fields=DocumentFields(), order_by=["at"], keep=["rid"], **options)
    again = tied.filter("array_contains(failed_checks, 'duplicate.id')").collect()
    assert len(again) == 1 and again[0].rid in (1, 2)
    none = validate(events.filter("rid < 0"), fields=DocumentFields(), order_by=["rid"], keep=["rid"], **options)
    assert none.collect() == []
