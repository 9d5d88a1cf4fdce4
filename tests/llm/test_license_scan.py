"""Operator 12: base places against a plain reading, expressions against Python's own evaluation, awkward input."""

import random
import re

import pytest

from tests.conftest import SF_DIR
from tidemark.llm import license_scan
from tidemark.llm.queries import QUERIES

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def base_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        expected = base_of(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == expected
        labels = r.labels.split(",") if r.labels else []
        assert set(filter(None, r.base_labels.split(","))) <= set(labels) and labels == sorted(set(labels))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels) == (r.permission is not None)


def test_query_equals_plain_reading(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    check(QUERIES["op12_licenses"](spark, SF_DIR).collect(), texts)


def test_awkward(spark):
    texts = dict(
        enumerate(
            [
                None, "", " \n", "MIT License", "mit-license, MIT  LICENSE;mit license license", "cc by cc by-sa cc-BY", "cc by cc\u0085by",
                "the (GNU) General\nPublic License", "Apache Licence, apache license", "mitt license smit license mit licenses", "mit\x7flicense",
                "word " * 200_000 + "MIT license", "license: " * 50_000, "SPDX-License-Identifier: MIT " * 2_000, "İMIT License K apache license",
                "apache license mit license gnu general public license cc by",
            ]
        )
    )
    df = spark.createDataFrame([(i, t, "s", 1.0) for i, t in texts.items()], "doc_id long, text string, labels string, score double").repartition(3)
    check(license_scan.scan(df).collect(), texts)
    assert license_scan.scan(df.limit(0)).count() == 0
    twice = license_scan.scan(df.union(df).selectExpr("CAST(null AS long) AS doc_id", "text")).collect()
    assert len(twice) == 2 * len(texts) and {r.doc_id for r in twice} == {None}


@pytest.mark.parametrize(
    "text, shown, labels, permission",
    [
        ("MIT", "mit", "mit", 0.9),
        ("(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0", "(mit OR apache-2.0) AND gpl-2.0-only WITH classpath-exception-2.0", "apache,gpl,mit", 0.475),
        ("MIT OR GPL-3.0-or-later AND CC0-1.0", "mit OR gpl-3.0-or-later AND cc0-1.0", "cc0,gpl,mit", 0.9),
        ("((bsd-3-clause))", "bsd-3-clause", "bsd", 0.9),
        ("mit or", "mit", "mit", 0.9),
        ("mit or (apache-2.0 and", "mit OR apache-2.0", "apache,mit", 0.9),
        ("mit) or gpl-2.0", "mit", "mit", 0.9),
        ("mit gpl-2.0", "mit", "mit", 0.9),
        ("MIT. See LICENSE", "mit", "mit", 0.9),
        ("LicenseRef-Own", "licenseref-own", "licenseref-own", 0.1),
    ],
)
def test_expressions(text, shown, labels, permission):
    licence = license_scan.evaluated(text.lower())
    assert (licence.text, ",".join(sorted(licence.labels))) == (shown, labels)
    assert licence.permission == pytest.approx(permission)


@pytest.mark.parametrize("text", ["", "or mit", "()", ") mit", "...", "and", "( or )"])
def test_no_expression(text):
    assert license_scan.evaluated(text) is None


def test_random_expressions_evaluate_as_python_does():
    """``&`` and ``|`` of Python's own parser bind as AND and OR do."""
    random.seed(5)

    class Value(float):
        def __and__(self, other):
            return Value(min(self, other))

        def __or__(self, other):
            return Value(max(self, other))

    names = {"mit": "mit", "gpl": "gpl-2.0", "lgpl": "lgpl-2.1", "cc0": "cc0-1.0", "agpl": "agpl-3.0"}

    def expression(depth):
        if depth == 0 or random.random() < 0.3:
            name = random.choice(list(names))
            return names[name], name
        (a, x), (b, y) = expression(depth - 1), expression(depth - 1)
        word, sign = random.choice([("and", "&"), ("or", "|")])
        return (f"({a} {word} {b})", f"({x} {sign} {y})") if random.random() < 0.5 else (f"{a} {word} {b}", f"{x} {sign} {y}")

    scope = {n: Value(license_scan.permits(n)) for n in names}
    for _ in range(300):
        text, code = expression(4)
        licence = license_scan.evaluated(text)
        assert licence.permission == eval(code, scope)
        again = license_scan.evaluated(licence.text.lower())
        assert again == licence


def test_tags_and_notices():
    automatons = license_scan.automatons()
    names = [c.split()[0] for c in license_scan.COLUMNS.split(", ")][1:]

    def scan(text):
        return dict(zip(names, license_scan.scanned(text, *automatons)))

    assert scan("# SPDX-License-Identifier: MPL-2.0\nMIT License")["labels"] == "mit,mpl"
    assert scan("License: see LICENSE.txt")["labels"] == scan("license: the usual")["labels"] == ""
    assert scan("Licence: Apache-2.0, see there")["expressions"] == "apache-2.0"
    assert scan("GNU Lesser General Public License")["labels"] == "lgpl"
    assert scan("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: MIT")["score"] == pytest.approx(0.95)
    assert scan("Permission is hereby granted, free of charge, to any")["base_labels"] == ""
