"""Text and timestamp forms that must agree with Python's ``str`` and ISO parsing."""

from __future__ import annotations

from tidemark.functions.sqltext import case, quote


def rare(value: str, make) -> str:
    """``make(value)`` for branches few rows take.

    The lambda binds the value once and is interpreted, so a long expression
    adds a few lines instead of pages to the generated code.
    """
    return f"element_at(transform(array({value}), rare_x -> {make('rare_x')}), 1)"


def float_text(d: str) -> str:
    """``str(float)``: as the JVM prints it, but for exponents, NaN and infinities."""
    java = f"CAST({d} AS STRING)"
    return f"if({java} RLIKE '[EN]|Inf', {rare(d, _unusual_float)}, {java})"


def _unusual_float(d: str) -> str:
    """Fixed notation between 1e-4 and 1e16, else a two-digit exponent."""
    java = f"CAST({d} AS STRING)"
    digits = f"regexp_replace(CAST(CAST({d} AS DECIMAL(38,20)) AS STRING), '0+$', '')"
    fixed = f"regexp_replace({digits}, '[.]$', '.0')"
    mantissa = f"regexp_replace(substring_index({java}, 'E', 1), '[.]0$', '')"
    power = f"CAST(substring_index({java}, 'E', -1) AS INT)"
    exponent = f"format_string('%se%s%02d', {mantissa}, if({power} < 0, '-', '+'), abs({power}))"
    return case(
        [
            (f"isnan({d})", "'nan'"),
            (f"abs({d}) = double('infinity')", f"if({d} > 0, 'inf', '-inf')"),
            (f"abs({d}) >= 1e-4 AND abs({d}) < 1e16", fixed),
            (f"{d} IS NOT NULL", exponent),
        ]
    )


# Shapes accepted as an ISO-8601 timestamp: date, any one separator, time, offset.
_CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?(Z|[+-][0-9]{2}:[0-9]{2})?$"
_DATE = r"([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8}|[0-9]{4}-?W[0-9]{2}(?:-?[1-7])?)"
_CLOCK = r"([0-9]{2}(?::[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?|[0-9]{2}(?:[0-9]{2}(?:[.,][0-9]+)?)?)?)"
_OFFSET = r"(Z|[+-][0-9]{2}(?::?[0-9]{2}(?::?[0-9]{2}(?:\.[0-9]+)?)?)?)?"
_GENERAL = rf"(?s)^{_DATE}(?:.{_CLOCK}{_OFFSET})?$"
_LENIENT = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ][0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2})?$"


def iso_timestamp(text: str) -> str:
    """Timestamp of an ISO-8601 string, NULL when it is not one (naive means UTC).

    The canonical form is tried first, so almost every row pays one regex and
    one cast; basic, week-date and reduced-precision forms are rebuilt into it.
    """
    return case(
        [
            (f"{text} LIKE '0000%'", "CAST(NULL AS TIMESTAMP)"),
            (f"{text} RLIKE {quote(_CANONICAL)}", f"try_cast({text} AS TIMESTAMP)"),
            (f"{text} RLIKE {quote(_GENERAL)}", rare(text, _rebuilt_timestamp)),
            (f"{text} RLIKE {quote(_LENIENT)}", f"try_cast({text} AS TIMESTAMP)"),
        ]
    )


def _rebuilt_timestamp(text: str) -> str:
    """The canonical form of any accepted one, cast to a timestamp."""
    general = quote(_GENERAL)
    date, clock, offset = (f"regexp_extract({text}, {general}, {n})" for n in (1, 2, 3))

    day = f"replace({date}, '-', '')"
    year, week = f"try_cast(left({day}, 4) AS INT)", f"try_cast(substr({day}, 6, 2) AS INT)"
    weekday = f"coalesce(try_cast(substr({day}, 8, 1) AS INT), 1)"
    monday = f"date_add(trunc(make_date({year}, 1, 4), 'week'), ({week} - 1) * 7)"
    in_year = f"{year} >= 1 AND {week} >= 1 AND {monday} < trunc(make_date({year} + 1, 1, 4), 'week')"
    date_text = case(
        [
            (f"{date} NOT LIKE '%W%'", f"concat_ws('-', left({day}, 4), substr({day}, 5, 2), substr({day}, 7, 2))"),
            (in_year, f"CAST(date_add({monday}, {weekday} - 1) AS STRING)"),
        ]
    )

    packed = f"replace(replace({clock}, ':', ''), ',', '.')"
    hour, minute, second = (f"coalesce(nullif(substr({packed}, {n}, 2), ''), '00')" for n in (1, 3, 5))
    clock_text = f"concat({hour}, ':', {minute}, ':', {second}, substr({packed}, 7, 7))"

    zone = f"replace({offset}, ':', '')"
    offset_text = case(
        [
            (f"{zone} IN ('', 'Z')", zone),
            (f"length({zone}) <= 3", f"concat({zone}, ':00')"),
        ],
        f"concat_ws(':', left({zone}, 3), substr({zone}, 4, 2), nullif(substr({zone}, 6, 2), ''))",
    )
    return f"try_cast(concat({date_text}, 'T', {clock_text}, {offset_text}) AS TIMESTAMP)"


_STRICT_UTC = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}T[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}Z$"


def strict_utc_timestamp(text: str) -> str:
    """Exactly ``YYYY-MM-DDTHH:MM:SSZ`` (no fraction, no offset), else NULL."""
    shaped = f"{text} RLIKE {quote(_STRICT_UTC)} AND {text} NOT LIKE '0000%'"
    return f"CASE WHEN {shaped} THEN try_cast({text} AS TIMESTAMP) END"


def java_pattern(pattern: str) -> str:
    """A Python pattern as used with ``re.match``: anchored at the start only.

    ``(?d)`` limits line terminators to ``\\n`` and ``(?U)`` turns on Unicode
    classes, both as in Python; named groups and ``\\Z`` are respelled.
    """
    body = pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z")
    start = 0
    while (at := body.find("(?P=", start)) >= 0:
        end = body.index(")", at)
        body = f"{body[:at]}\\k<{body[at + 4:end]}>{body[end + 1:]}"
        start = at
    return rf"(?dU)\A(?:{body})"
