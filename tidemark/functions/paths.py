"""Field access by dotted path (B1-B6, B8) over two forms of input.

* document mode - one VARIANT column holding the whole event;
* table mode - ordinary typed columns.

A ``Fields`` object hands out ``Field`` objects whose members are SQL text, so
checks and profiles are written once for both forms. In document mode every
path is extracted once into a helper column by ``attach`` no matter how many
checks read it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, types as T

from tidemark.functions.pytext import float_text, iso_timestamp
from tidemark.functions.sqltext import any_of, case, dotted, name, quote

# Type names of decoded JSON values.
STR, INT, FLOAT, BOOL, LIST, DICT, NONE = "str", "int", "float", "bool", "list", "dict", "NoneType"
ABSENT = "absent"

# Names used when a type is inferred rather than checked.
INFERRED_NAMES = {
    STR: "string",
    INT: "integer",
    FLOAT: "float",
    BOOL: "boolean",
    LIST: "list",
    DICT: "dict",
    NONE: "null",
}


def parse_document(raw: str) -> str:
    """JSON text to VARIANT, NULL when it is not JSON."""
    return f"try_parse_json({raw})"


def variant_path(path: str) -> str:
    """``actor.id`` as a variant path; keys are quoted, dots always separate."""
    parts = []
    for key in path.split("."):
        if "'" not in key:
            parts.append(f"['{key}']")
        elif '"' not in key:
            parts.append(f'["{key}"]')
        else:
            raise ValueError(f"field name mixes both quote characters: {path!r}")
    return "$" + "".join(parts)


def _get(value: str, as_type: str) -> str:
    return f"try_variant_get({value}, '$', '{as_type}')"


def variant_kind(schema_text: str) -> str:
    """Python type name of a variant from its ``schema_of_variant`` text.

    JSON integers within 64 bits are BIGINT; longer ones are DECIMAL(p,0) with
    p >= 19; any other number is a float (``1.0`` is stored as DECIMAL(1,0)).
    """
    return case(
        [
            (f"{schema_text} IS NULL", quote(ABSENT)),
            (f"{schema_text} = 'STRING'", quote(STR)),
            (f"{schema_text} = 'BIGINT'", quote(INT)),
            (f"{schema_text} = 'BOOLEAN'", quote(BOOL)),
            (f"{schema_text} = 'VOID'", quote(NONE)),
            (f"{schema_text} LIKE 'OBJECT%'", quote(DICT)),
            (f"{schema_text} LIKE 'ARRAY%'", quote(LIST)),
            (f"{schema_text} RLIKE '^DECIMAL[(](19|2[0-9]|3[0-9]),0[)]$'", quote(INT)),
        ],
        quote(FLOAT),
    )


def variant_text(value: str, kind: str) -> str:
    """``str(value)`` of a decoded JSON value; lists and objects as JSON text."""
    return case(
        [
            (f"{kind} IN ('str', 'int')", _get(value, "string")),
            (f"{kind} = 'bool'", f"initcap({_get(value, 'string')})"),
            (f"{kind} = 'float'", float_text(_get(value, "double"))),
            (f"{kind} IN ('list', 'dict')", f"to_json({value})"),
        ]
    )


class Field:
    """One path. Members are SQL expressions; the boolean ones are never NULL."""

    path: str
    exists: str
    is_none: str
    kind: str
    text: str
    number: str
    size: str
    timestamp: str

    def is_kind(self, *kinds: str) -> str:
        return f"{self.kind} IN ({', '.join(map(quote, kinds))})"

    @property
    def is_number(self) -> str:
        """Booleans count as numbers, as they do in Python."""
        return self.is_kind(INT, FLOAT, BOOL)

    @property
    def inferred_type(self) -> str:
        """B4; NULL for an absent field."""
        return case([(self.is_kind(kind), quote(named)) for kind, named in INFERRED_NAMES.items()])

    def equals(self, literal) -> str:
        """Python ``==``: text only equals text, ``1 == 1.0 == True``."""
        return self.one_of([literal])

    def one_of(self, allowed: list) -> str:
        """Python ``in`` over a list of JSON values."""
        texts = [quote(a) for a in allowed if isinstance(a, str)]
        numbers = [f"{float(a)!r}D" for a in allowed if isinstance(a, (bool, int, float))]
        containers = [quote(_compact_json(a)) for a in allowed if isinstance(a, (list, dict))]
        tests = []
        if texts:
            tests.append(f"({self.is_kind(STR)} AND {self.text} IN ({', '.join(texts)}))")
        if numbers:
            tests.append(f"({self.is_number} AND {self.number} IN ({', '.join(numbers)}))")
        if containers:
            tests.append(f"({self.is_kind(LIST, DICT)} AND {self.text} IN ({', '.join(containers)}))")
        if any(a is None for a in allowed):
            tests.append(self.is_none)
        return f"coalesce({any_of(tests)}, false)"

    def beyond(self, bound, sign: str) -> str:
        """The number is below (``<``) or above (``>``) the bound; NaN is neither."""
        raise NotImplementedError

    @property
    def number_text(self) -> str:
        """Equal numbers have equal text, whatever their type."""
        whole = f"regexp_replace({float_text(self.number)}, '[.]0$', '')"
        return f"if({self.is_kind(INT)}, {self.text}, {whole})"

    @property
    def key(self) -> str:
        """Grouping key under Python equality: text and numbers never collide."""
        return case(
            [
                (self.is_kind(STR), f"concat('s:', {self.text})"),
                (self.is_number, f"concat('n:', {self.number_text})"),
            ]
        )

    @property
    def id_text(self) -> str:
        """The value as text, ``unknown`` for every falsy value."""
        falsy = any_of(
            [
                self.is_none,
                f"({self.is_kind(INT, FLOAT, BOOL)} AND {self.text} IN ('0', '0.0', '-0.0', 'False'))",
                f"({self.is_kind(STR, LIST, DICT)} AND {self.text} IN ('', '[]', '{{}}'))",
            ]
        )
        return f"if({falsy}, 'unknown', {self.text})"


class DocumentField(Field):
    """A path into the document; derived forms become helper columns when first asked for.

    Helpers are flags, short names, texts and numbers. The value itself is
    never kept in a column: a VARIANT carries the key names of the whole
    document with it. Walking to a value is the expensive part, so whatever
    the kind and the text can tell is read off them.
    """

    FORMS = ("kind", "exists", "is_none", "text", "number", "size", "timestamp")
    # Forms of a later layer read the earlier ones.
    LAYERS = (("kind",), ("exists", "is_none", "text"), ("number", "size", "timestamp"))

    def __init__(self, path: str, prefix: str, doc: str):
        self.path = path
        self._prefix = prefix
        self._doc = doc
        self._uses: set[str] = set()

    def __getattr__(self, form: str) -> str:
        if form not in self.FORMS:
            raise AttributeError(form)
        self._uses.add(form)
        return self.column(form)

    def column(self, form: str) -> str:
        return f"{self._prefix}_{form}"

    def _as(self, as_type: str) -> str:
        return f"try_variant_get({self._doc}, {quote(variant_path(self.path))}, '{as_type}')"

    def beyond(self, bound, sign: str) -> str:
        if not isinstance(bound, int) or abs(bound) < 2**53:
            return f"{self.number} {sign} {float(bound)!r}D"
        # Beyond 2**53 doubles cannot tell integers apart; their text can.
        exact = f"try_cast({self.text} AS DECIMAL(38,0)) {sign} {bound}"
        return f"if({self.is_kind(INT)}, {exact}, {self.number} {sign} {float(bound)!r}D)"

    def define(self) -> dict[str, str]:
        """Definitions of the forms in use."""
        wanted = set(self._uses)
        if wanted & {"number", "size", "timestamp"}:
            wanted.add("text")
        if "text" in wanted:
            wanted.add("kind")
        value, kind, text = self._as("variant"), self.column("kind"), self.column("text")
        made = {
            "exists": f"{kind} <> 'absent'" if "kind" in wanted else f"{value} IS NOT NULL",
            "is_none": (
                f"{kind} IN ('absent', 'NoneType')"
                if "kind" in wanted
                else f"({value} IS NULL OR is_variant_null({value}))"
            ),
            "kind": variant_kind(f"schema_of_variant({value})"),
            "text": case(
                [
                    (f"{kind} IN ('str', 'int')", self._as("string")),
                    (f"{kind} = 'bool'", f"initcap({self._as('string')})"),
                    (f"{kind} = 'float'", float_text(self._as("double"))),
                    (f"{kind} IN ('list', 'dict')", f"to_json({value})"),
                ]
            ),
            "number": case(
                [
                    (f"{kind} IN ('int', 'float')", f"try_cast({text} AS DOUBLE)"),
                    (f"{kind} = 'bool'", f"if({text} = 'True', 1D, 0D)"),
                ]
            ),
            "size": case(
                [
                    (f"{kind} = 'str'", f"length({text})"),
                    (f"{kind} = 'list'", f"size({self._as('array<variant>')})"),
                    (f"{kind} = 'dict'", f"size({self._as('map<string,variant>')})"),
                ]
            ),
            "timestamp": f"CASE WHEN {kind} = 'str' THEN {iso_timestamp(text)} END",
        }
        return {form: made[form] for form in self.FORMS if form in wanted}


class TableField(Field):
    """A typed column; absent and NULL cannot be told apart, so it always exists."""

    def __init__(self, path: str, dtype: T.DataType | None):
        self.path = path
        self.dtype = dtype
        self.value = "CAST(NULL AS STRING)" if dtype is None else dotted(path)
        self.exists = "false" if dtype is None else "true"
        self.is_none = f"{self.value} IS NULL"
        self._static = ABSENT if dtype is None else table_kind(dtype)
        self._is_float = isinstance(dtype, (T.DoubleType, T.FloatType))

    @property
    def kind(self) -> str:
        if self._static == ABSENT:
            return quote(ABSENT)
        return f"if({self.is_none}, 'NoneType', {quote(self._static)})"

    def is_kind(self, *kinds: str) -> str:
        if self._static == ABSENT:
            return "true" if ABSENT in kinds else "false"
        if self._static in kinds:
            return "true" if NONE in kinds else f"{self.value} IS NOT NULL"
        return self.is_none if NONE in kinds else "false"

    @property
    def text(self) -> str:
        return column_text(self.value, self.dtype)

    @property
    def number(self) -> str:
        if self._static in (INT, FLOAT):
            return f"CAST({self.value} AS DOUBLE)"
        if self._static == BOOL:
            return f"CAST(CAST({self.value} AS INT) AS DOUBLE)"
        return "CAST(NULL AS DOUBLE)"

    def beyond(self, bound, sign: str) -> str:
        literal = f"{bound!r}D" if isinstance(bound, float) else str(int(bound))
        if self._is_float:
            # Spark orders NaN above every number; in Python it compares false.
            return f"(NOT isnan({self.value}) AND {self.value} {sign} {literal})"
        value = self.value if self._static in (INT, FLOAT) else self.number
        return f"{value} {sign} {literal}"

    @property
    def size(self) -> str:
        if self._static == STR:
            return f"length({self.value})"
        if isinstance(self.dtype, (T.ArrayType, T.MapType)):
            return f"size({self.value})"
        return str(len(self.dtype.fields)) if isinstance(self.dtype, T.StructType) else "CAST(NULL AS INT)"

    @property
    def timestamp(self) -> str:
        if isinstance(self.dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return f"CAST({self.value} AS TIMESTAMP)"
        return iso_timestamp(self.value) if self._static == STR else "CAST(NULL AS TIMESTAMP)"


def table_kind(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return STR
    if isinstance(dtype, T.BooleanType):
        return BOOL
    if isinstance(dtype, T.IntegralType):
        return INT
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return FLOAT
    if isinstance(dtype, T.ArrayType):
        return LIST
    if isinstance(dtype, (T.MapType, T.StructType)):
        return DICT
    return "datetime"


def column_text(value: str, dtype: T.DataType | None) -> str:
    """``str(value)`` of a typed column."""
    if isinstance(dtype, T.BooleanType):
        return f"initcap(CAST({value} AS STRING))"
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return float_text(f"CAST({value} AS DOUBLE)")
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return f"to_json({value})"
    return f"CAST({value} AS STRING)"


def _compact_json(value) -> str:
    return json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


class DocumentFields:
    """Paths into a VARIANT column."""

    def __init__(self, doc: str = "doc", tag: str = "f"):
        self.doc = doc
        self._tag = tag
        self._paths: dict[str, DocumentField] = {}

    def field(self, path: str) -> DocumentField:
        if path not in self._paths:
            self._paths[path] = DocumentField(path, f"__{self._tag}{len(self._paths)}", name(self.doc))
        return self._paths[path]

    def attach(self, df: DataFrame) -> DataFrame:
        """Add the helper columns the checks asked for, each once however many checks read it."""
        defined = [(f, f.define()) for f in self._paths.values()]
        for layer in DocumentField.LAYERS:
            made = [f"{forms[form]} AS {f.column(form)}" for f, forms in defined for form in layer if form in forms]
            if made:
                df = df.selectExpr("*", *made)
        return df


class TableFields:
    """Paths into the typed columns of a DataFrame."""

    def __init__(self, df: DataFrame):
        self._schema = df.schema

    def field(self, path: str) -> TableField:
        dtype: T.DataType = self._schema
        for part in path.split("."):
            if not (isinstance(dtype, T.StructType) and part in dtype.fieldNames()):
                return TableField(path, None)
            dtype = dtype[part].dataType
        return TableField(path, dtype)

    def attach(self, df: DataFrame) -> DataFrame:
        return df


Fields = DocumentFields | TableFields


def missing_fields(fields: Fields, paths: list[str]) -> str:
    """The listed paths that do not exist, in the given order."""
    flags = ", ".join(f"if({fields.field(p).exists}, NULL, {quote(p)})" for p in paths)
    return f"array_compact(array({flags}))"


def present_fields(fields: Fields, paths: list[str]) -> str:
    """The listed paths that exist, in the given order."""
    flags = ", ".join(f"if({fields.field(p).exists}, {quote(p)}, NULL)" for p in paths)
    return f"array_compact(array({flags}))"


#: Levels of objects that are opened row by row; what lies deeper is opened within its row.
LEVELS = 4


def _opened(level: DataFrame, others: list[str]) -> DataFrame:
    """One row per member of each object, by its path; every other value passes through, empty objects vanish."""
    return (
        level.selectExpr(*others, "path", "__v", f"{_get('__v', 'map<string,variant>')} AS __map")
        .selectExpr(*others, "path", "__v", "__map IS NOT NULL AS __open", "explode_outer(__map) AS (__key, __child)")
        .filter("NOT (__open AND __key IS NULL)")
        .selectExpr(
            *others,
            "CASE WHEN NOT __open THEN path WHEN path = '' THEN __key ELSE concat(path, '.', __key) END AS path",
            "if(__open, __child, __v) AS __v",
        )
    )


def _leaves_within(path: str, value: str) -> str:
    """The leaves of one object, however deep, as an array of ``path, v``.

    A loop over levels. An object's text has a brace for each object in it, so there
    are no more levels than braces; steps after the last level do nothing.
    """
    kids = (
        "flatten(transform(level.open, o -> transform(map_entries(o.m), e -> named_struct("
        "'path', if(o.path = '', e.key, concat(o.path, '.', e.key)), 'v', e.value, 'm', " + _get("e.value", "map<string,variant>") + "))))"
    )
    step = (
        f"if(size(level.open) = 0, level, element_at(transform(array({kids}), kids -> named_struct("
        "'done', concat(level.done, transform(filter(kids, c -> c.m IS NULL), c -> named_struct('path', c.path, 'v', c.v))), "
        "'open', transform(filter(kids, c -> c.m IS NOT NULL), c -> named_struct('path', c.path, 'm', c.m)))), 1))"
    )
    start = (
        "named_struct('done', CAST(array() AS array<struct<path:string,v:variant>>), "
        f"'open', array(named_struct('path', {path}, 'm', {_get(value, 'map<string,variant>')})))"
    )
    braces = f"aggregate(array(to_json({value})), 0, (n, t) -> length(t) - length(replace(t, '{{', '')))"
    return f"aggregate(sequence(1, {braces}), {start}, (level, n) -> {step}, level -> level.done)"


def flatten_document(df: DataFrame, doc: str = "doc") -> DataFrame:
    """One row per leaf, as ``path``, ``kind``, ``text``, ``is_null`` beside the other columns.

    A linear chain of steps, each opening one level of objects; finished rows pass
    through. Nothing is shuffled and nothing is looked up in the data beforehand: the
    objects that are left after ``LEVELS`` steps are opened to their end within their
    row. Empty objects vanish, lists become ``<array[n]>`` text of kind ``str``.
    """
    others = [name(c) for c in df.columns if c != doc]
    level = df.selectExpr(*others, "'' AS path", f"{name(doc)} AS __v").filter("__v IS NOT NULL")
    for _ in range(LEVELS):
        level = _opened(level, others)
    within = f"if(schema_of_variant(__v) LIKE 'OBJECT%', {_leaves_within('path', '__v')}, array(named_struct('path', path, 'v', __v)))"
    level = level.selectExpr(*others, f"inline({within}) AS (path, __v)")
    leaves = level.filter("path <> ''").selectExpr(*others, "path", "__v", "schema_of_variant(__v) AS __schema")
    typed = leaves.selectExpr(*others, "path", "__v", f"{variant_kind('__schema')} AS __kind")
    array_text = f"concat('<array[', size({_get('__v', 'array<variant>')}), ']>')"
    return typed.selectExpr(
        *others,
        "path",
        "if(__kind = 'list', 'str', __kind) AS kind",
        f"if(__kind = 'list', {array_text}, {variant_text('__v', '__kind')}) AS text",
        "__kind = 'NoneType' AS is_null",
    )


def flatten_table(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """B5 for typed columns: unpivot the leaves of the listed columns."""

    def leaves(path: str, dtype: T.DataType):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                yield from leaves(f"{path}.{f.name}", f.dataType)
        else:
            yield path, dtype

    records = []
    for column in columns:
        for path, dtype in leaves(column, df.schema[column].dataType):
            value = dotted(path)
            if isinstance(dtype, T.ArrayType):
                kind, text = STR, f"concat('<array[', size({value}), ']>')"
            else:
                kind, text = table_kind(dtype), column_text(value, dtype)
            records.append(
                f"named_struct('path', {quote(path)}, 'kind', if({value} IS NULL, 'NoneType', {quote(kind)}), "
                f"'text', if({value} IS NULL, NULL, {text}), 'is_null', {value} IS NULL)"
            )
    return df.selectExpr(*[name(k) for k in keep], f"inline(array({', '.join(records)}))")
