"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

Values are found by pattern, then validated: payment cards (Luhn check), IBANs
(mod 97), dates (calendar), IPv4 addresses (octets), telephone and social security
numbers (digit counts and ranges), e-mail addresses and quoted secrets. A valid
value becomes another one of its format: every digit stays a digit, every ASCII
letter a letter of its case, separators stay, checks hold again, and a date
becomes a real date of its century. Under one key the mapping is a permutation of
all values of a kind and length, so equal values stay equal across documents and
different ones stay different. Two kinds are exceptions. Dates with slashes are read
in two ways, by month or by day first, and what comes out may read the other way, so
two of them can become equal. A telephone number with a country code is split where
it is punctuated, so the same number written without blanks gets another pseudonym.

Everything is a Catalyst expression; no Python runs on rows.

The value is a list of symbols, each with a radix (10, 26, 256, or the factors of
the days in a century). It is cut in halves; each of ``ROUNDS`` rounds adds to
every symbol of one half, modulo its radix, a number that SHA-256 derives from
key, kind, round, place and the other half.

Defined results: a null text stays null, an empty one empty; a value that is not
valid stays as it is; the country code of a telephone number and of an IBAN, the
domain of an address and letters outside ASCII stay; all other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
#: Days of a century block (years ..30 to ..29) and the two factors they split into.
CENTURIES = {36525: (75, 487), 36524: (92, 397)}

#: Kind to pattern. Earlier kinds win where two match at one place. Runs are
#: possessive, and every alternative fails on its first characters in plain prose.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,8}+",
    "secret": r"(?:(?<![A-Za-z])(?=[tspaTSPA])(?i:token|secret|password|passwd|api_?key|access_?key)\s{0,3}+[=:]\s{0,3}+\"[A-Za-z0-9+/=_-]{16,256}+\")",
    "iban": r"(?:(?=[A-Z]{2}\d{2})(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))",
    "ip": r"(?:(?=\d)(?<![\d.])\d{1,3}+\.\d{1,3}+\.\d{1,3}+\.\d{1,3}+(?!\d|\.\d))",
    "date": r"(?:(?=\d)(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?!\d))",
    "phone": r"(?:(?=[+(\d])(?:(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,12}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])))",
    "ssn": r"(?:(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))",
    "card": r"(?:(?=\d)(?<![\d-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19}+)(?!\d))",
}
PATTERN = "|".join(PATTERNS.values())
#: Every kind holds one of these, so texts without them need no further look.
NEEDED = "[0-9@\"]"

DIGITS = "[^0-9]"


def _number(hashed: Column, radix: Column) -> Column:
    return F.pmod(F.conv(F.substring(hashed, 1, 12), 16, 10).cast("long"), radix.cast("long"))


def feistel(symbols: Column, radices: Column, kind: str, key: str, inverse: bool = False) -> Column:
    """``symbols`` (array of long) permuted within ``radices``; the inverse undoes it."""
    half = F.floor(F.size(symbols) / 2).cast("int")
    rounds = range(ROUNDS, 0, -1) if inverse else range(1, ROUNDS + 1)

    def one(state: Column, r: Column) -> Column:
        first = F.pmod(r, F.lit(2)) == 1  # whether this round changes the first half

        def changed(x: Column, i: Column) -> Column:
            other = F.when(first, F.slice(state, half + 1, F.size(state))).otherwise(F.slice(state, F.lit(1), half))
            hashed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r, i, F.array_join(other, ",")), 256)
            radix = F.get(radices, i)
            step = _number(hashed, radix)
            return F.when((i < half) == first, F.pmod(x - step if inverse else x + step, radix)).otherwise(x)

        return F.transform(state, changed)

    return F.aggregate(F.array(*(F.lit(r) for r in rounds)), symbols, one)


def _characters(text: Column, kind: str, key: str, inverse: bool) -> Column:
    """ASCII letters and digits of ``text`` permuted, each within its class."""
    plain = F.regexp_replace(text, "[^0-9A-Za-z]", "")
    codes = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    radices = F.transform(codes, lambda c: F.when(c < 58, F.lit(10)).otherwise(F.lit(26)).cast("long"))
    bases = F.transform(codes, lambda c: F.when(c < 58, F.lit(48)).when(c < 91, F.lit(65)).otherwise(F.lit(97)).cast("long"))
    values = F.zip_with(codes, bases, lambda c, b: c - b)
    new = F.array_join(F.zip_with(feistel(values, radices, kind, key, inverse), bases, lambda v, b: F.char(v + b)), "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), new.alias("new"))

    def put(state: Column, c: Column) -> Column:
        alike = c.rlike("^[0-9A-Za-z]$")
        return F.struct(
            F.concat(state["out"], F.when(alike, F.substring(state["new"], state["at"] + 1, F.lit(1))).otherwise(c)).alias("out"),
            F.when(alike, state["at"] + 1).otherwise(state["at"]).alias("at"),
            state["new"].alias("new"),
        )

    return F.aggregate(F.split(text, ""), start, put, lambda s: s["out"])


def luhn_sum(digits: Column, odd: int) -> Column:
    """Luhn sum; ``odd`` tells which places from the right are doubled."""
    marks = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(
        marks, lambda d, i: F.when(F.pmod(i, F.lit(2)) == odd, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def _mod97(text: Column) -> Column:
    """Letters as 10..35, the whole number modulo 97."""
    return F.aggregate(
        F.filter(F.split(text, ""), lambda c: c != ""),
        F.lit(0),
        lambda a, c: F.pmod(
            F.when(F.ascii(c) < 58, a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55), F.lit(97)
        ).cast("int"),
    )


def _card(value: Column, key: str, inverse: bool) -> Column:
    digits = F.regexp_replace(value, DIGITS, "")
    body = _characters(F.substring(value, F.lit(1), F.length(value) - 1), "card", key, inverse)
    check = F.pmod(10 - F.pmod(luhn_sum(F.regexp_replace(body, DIGITS, ""), 0), F.lit(10)), F.lit(10))
    return F.when(F.pmod(luhn_sum(digits, 1), F.lit(10)) == 0, F.concat(body, check.cast("string")))


def _iban(value: Column, key: str, inverse: bool) -> Column:
    plain = F.regexp_replace(value, " ", "")
    valid = F.length(plain).between(15, 34) & (_mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1)
    rest = _characters(F.substring(value, F.lit(5), F.length(value)), "iban", key, inverse)
    country = F.substring(value, 1, 2)
    check = 98 - _mod97(F.concat(F.regexp_replace(rest, " ", ""), country, F.lit("00")))
    return F.when(valid, F.concat(country, F.lpad(check.cast("string"), 2, "0"), rest))


def _ip(value: Column, key: str, inverse: bool) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    valid = F.forall(octets, lambda x: x < 256)
    new = feistel(octets, F.array(*(F.lit(256).cast("long"),) * 4), "ip", key, inverse)
    return F.when(valid, F.array_join(F.transform(new, lambda x: x.cast("string")), "."))


def _date(value: Column, key: str, inverse: bool) -> Column:
    def moved(pattern: str) -> Column:
        day = F.to_date(F.try_to_timestamp(value, F.lit(pattern)))
        start_year = F.floor((F.year(day) - 30) / 100) * 100 + 30
        start = F.make_date(start_year.cast("int"), F.lit(1), F.lit(1))
        days = F.datediff(F.make_date((start_year + 100).cast("int"), F.lit(1), F.lit(1)), start)
        n = F.datediff(day, start).cast("long")
        high, low = (
            F.when(days == 36525, F.lit(CENTURIES[36525][i])).otherwise(F.lit(CENTURIES[36524][i])).cast("long") for i in (0, 1)
        )
        pair = feistel(F.array(F.floor(n / low).cast("long"), F.pmod(n, low)), F.array(high, low), "date", key, inverse)
        new = F.get(pair, F.lit(0)) * low + F.get(pair, F.lit(1))
        moved_day = F.date_format(F.date_add(start, new.cast("int")), pattern)
        return F.when(F.year(day).between(1030, 9929), moved_day)

    # where day and month can be told either way, the day comes first
    return (
        F.when(value.rlike("-"), moved("yyyy-MM-dd")).when(value.rlike(r"\."), moved("dd.MM.yyyy"))
        .otherwise(F.coalesce(moved("dd/MM/yyyy"), moved("MM/dd/yyyy")))
    )


def _phone(value: Column, key: str, inverse: bool) -> Column:
    code = F.regexp_extract(value, r"^\+(?:\d{1,3}(?=[ .(-])|\d)", 0)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    digits = F.length(F.regexp_replace(value, DIGITS, ""))
    return F.when(digits.between(7, 15), F.concat(code, _characters(rest, "phone", key, inverse)))


def _ssn(value: Column, key: str, inverse: bool) -> Column:
    valid = ~value.rlike(r"^(?:000|666|9)|-00-|-0000$")
    # area numbers stay, so the result is of the same region and valid; the rest is shifted past zero
    group = F.substring(value, 5, 2).cast("long") - 1
    serial = F.substring(value, 8, 4).cast("long") - 1
    new = feistel(F.array(group, serial), F.array(F.lit(99).cast("long"), F.lit(9999).cast("long")), "ssn", key, inverse)
    return F.when(
        valid,
        F.concat_ws(
            "-", F.substring(value, 1, 3), F.lpad((F.get(new, F.lit(0)) + 1).cast("string"), 2, "0"),
            F.lpad((F.get(new, F.lit(1)) + 1).cast("string"), 4, "0"),
        ),
    )


def _email(value: Column, key: str, inverse: bool) -> Column:
    name = F.substring_index(value, "@", 1)
    return F.concat(_characters(name, "email", key, inverse), F.substring(value, F.length(name) + 1, F.length(value)))


def _secret(value: Column, key: str, inverse: bool) -> Column:
    head = F.regexp_extract(value, '^[^"]*"', 0)
    return F.concat(head, _characters(F.substring(value, F.length(head) + 1, F.length(value)), "secret", key, inverse))


KINDS = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "phone": _phone, "ssn": _ssn, "card": _card}


def pseudonym(value: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of one found value; null where it is not valid."""
    return F.coalesce(*(F.when(value.rlike(f"^(?:{PATTERNS[k]})$"), make(value, key, inverse)) for k, make in KINDS.items()))


def _found(text: str) -> Column:
    """The values in a text; an empty array if there are none."""
    return F.when(F.col(text).rlike(NEEDED), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(
        F.array().cast("array<string>")
    )


def _rebuilt(text: str, found: str, new: Column) -> Column:
    """``text`` with every found value replaced by its new one."""
    gaps = F.split(text, PATTERN, -1)
    pieces = F.zip_with(gaps, new, lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(F.col(text))


def pseudonymised(documents: DataFrame, key: str, inverse: bool = False) -> DataFrame:
    """``documents`` with a new ``text``; every other column as it was."""
    found = documents.withColumn("__found", _found("text"))
    new = F.transform("__found", lambda m: F.coalesce(pseudonym(m, key, inverse), m))
    return found.select(*(_rebuilt("text", "__found", new).alias("text") if c == "text" else F.col(c) for c in documents.columns))


def replaced(documents: DataFrame, key: str) -> DataFrame:
    """``doc_id, text`` and how many values were found and how many replaced, per document row."""
    found = documents.select("doc_id", "text", _found("text").alias("found"))
    made = found.withColumn("new", F.transform("found", lambda m: pseudonym(m, key)))
    return made.select(
        "doc_id",
        _rebuilt("text", "found", F.zip_with("found", "new", lambda m, n: F.coalesce(n, m))).alias("text"),
        F.size("found").cast("long").alias("n_found"),
        F.size(F.filter("new", lambda n: n.isNotNull())).cast("long").alias("n_replaced"),
    )
