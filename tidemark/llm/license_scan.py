"""License scan: Aho-Corasick finds notices and tags, a shunting-yard parser evaluates licence expressions.

A text is read twice by automatons, each once from end to end:

* its *words* (A-Z lower-cased; runs of digits, letters and everything beyond ASCII),
  joined by one space, for the phrases of ``BASE`` and ``NOTICES``;
* its lower-cased characters, for the identifier tags of ``TAGS``. Behind a tag, to the
  end of the line, stands a licence expression such as ``(MIT OR Apache-2.0) AND
  GPL-2.0-only WITH Classpath-exception-2.0``. ``WITH`` binds more tightly than ``AND``
  and ``AND`` more tightly than ``OR``; an expression ends before the first token that
  cannot go on with it, and unclosed brackets are closed there.

Evaluating an expression gives its labels (identifiers without versions) and how much it
permits, 0 to 1: ``OR`` leaves the choice (maximum), ``AND`` binds to both (minimum), an
exception after ``WITH`` lifts a quarter of what is missing to 1.

``score`` is the strength of the evidence that a document carries a licence: one minus
the product of ``1 - weight`` over its distinct findings.

Defined results: a null or empty text has no words, no labels (empty strings), score 0
and null positions and permission; rows are independent, so repeated rows, ties and null
ids give one result each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Phrases that count as base places, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases and their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "proprietary",
}
#: Tags before an expression; only after the first two may an identifier be unknown.
TAGS = ("spdx-license-identifier:", "license-expression:", "license:", "licence:")
#: How much a licence permits. Others permit ``UNKNOWN``.
PERMITS = {
    "cc0": 1.0, "unlicense": 1.0, "0bsd": 1.0,
    "mit": 0.9, "bsd": 0.9, "apache": 0.9, "isc": 0.9, "bsl": 0.9, "zlib": 0.9, "cc-by": 0.9,
    "lgpl": 0.6, "mpl": 0.6, "epl": 0.6,
    "gpl": 0.3, "cc-by-sa": 0.3, "agpl": 0.2, "cc-by-nc": 0.2, "cc-by-nd": 0.2,
    "proprietary": 0.0,
}
UNKNOWN = 0.1
#: Weights of one finding.
TAG_WEIGHT, BASE_WEIGHT, NOTICE_WEIGHT = 0.95, 0.6, 0.5
#: How tightly the operators bind.
BINDING = {"or": 1, "and": 2, "with": 3}

TOKEN = re.compile(r"[()]|[0-9a-z][0-9a-z.+_-]*")
#: What may stand between the tokens of an expression.
BETWEEN = re.compile(r"[ \t\"'`]*")
#: What is no part of a word becomes a blank.
BLANKED = bytes(c if c >= 0x80 or bytes([c]).isalnum() else 0x20 for c in range(256))

COLUMNS = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, expressions string, permission double"
)


class Licence(NamedTuple):
    """A licence expression: its text, its labels, what it permits, and how tightly its last operator binds."""

    text: str
    labels: frozenset[str]
    permission: float
    binding: int = 4


def label_of(identifier: str) -> str:
    """The identifier without its version: ``gpl-2.0-or-later`` is ``gpl``, ``bsd-3-clause`` is ``bsd``."""
    return re.sub(r"(-v?\d.*|-only|-or-later|\+)$", "", identifier) or identifier


def permits(label: str) -> float:
    return PERMITS.get(label, UNKNOWN)


def _identifier(token: str) -> Licence:
    label = label_of(token)
    return Licence(token, frozenset([label]), permits(label))


def _applied(operator: str, x: Licence, y: Licence) -> Licence:
    binding = BINDING[operator]
    texts = (f"({z.text})" if z.binding < binding else z.text for z in (x, y))
    text = f" {operator.upper()} ".join(texts)
    if operator == "with":  # y is an exception, not a licence
        return Licence(text, x.labels, x.permission + (1 - x.permission) / 4, binding)
    pick = max if operator == "or" else min
    return Licence(text, x.labels | y.labels, pick(x.permission, y.permission), binding)


def tokens(text: str, at: int, stop: int) -> Iterator[str]:
    """The tokens of an expression that begins at ``at`` in a lower-cased text, up to what cannot be one."""
    at = BETWEEN.match(text, at, stop).end()
    while found := TOKEN.match(text, at, stop):
        yield found[0]
        at = BETWEEN.match(text, found.end(), stop).end()


def evaluated(text: str, at: int = 0, stop: int | None = None, known_only: bool = False) -> Licence | None:
    """The licence expression at ``at`` of a lower-cased text, by the shunting-yard algorithm; None if none is there."""
    values: list[Licence] = []
    operators: list[str] = []

    def reduce() -> None:
        y, x = values.pop(), values.pop()
        values.append(_applied(operators.pop(), x, y))

    operand_next = True
    for token in tokens(text, at, len(text) if stop is None else stop):
        if operand_next:
            if token == "(":
                operators.append(token)
            elif token == ")" or token in BINDING:
                break
            else:
                token = token.rstrip(".-_")
                if known_only and label_of(token) not in PERMITS and not (operators and operators[-1] == "with"):
                    break
                values.append(_identifier(token))
                operand_next = False
        elif token in BINDING:
            while operators and operators[-1] != "(" and BINDING[operators[-1]] >= BINDING[token]:
                reduce()
            operators.append(token)
            operand_next = True
        elif token == ")" and "(" in operators:
            while operators[-1] != "(":
                reduce()
            operators.pop()
        else:
            break
    # what opened or joined an operand that never came falls away
    while operators and len(values) < 1 + sum(o != "(" for o in operators):
        operators.pop()
    while operators:
        if operators[-1] == "(":
            operators.pop()
        else:
            reduce()
    return values[0] if values else None


def automatons() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """Of phrases, each between blanks, and of tags."""
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in (BASE | NOTICES).items():
        phrases.add_word(f" {phrase} ", (len(phrase) + 1, label, phrase in BASE))
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scanned(text: str | None, phrases: ahocorasick.Automaton, tags: ahocorasick.Automaton) -> tuple:
    """What ``COLUMNS`` holds for one text, without its id."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
    words = raw.translate(BLANKED).split()
    line = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
    places, base, noticed = [], set(), set()
    at = word = 0  # the word that begins behind line[at]
    for end, (length, label, is_base) in sorted(phrases.iter(line), key=lambda m: m[0] - m[1][0]):
        begin = end - length
        word, at = word + line.count(" ", at, begin), begin
        if is_base:
            places.append(word)
            base.add(label)
        else:
            noticed.add(label)
    lower = raw.decode("utf-8", "replace")
    expressions: dict[str, Licence] = {}
    stop = -1  # the end of the line that is being read
    for end, tag in tags.iter(lower):
        if end >= stop:
            stop = lower.find("\n", end)
            stop = len(lower) if stop < 0 else stop
        licence = evaluated(lower, end + 1, stop, known_only=tag in TAGS[2:])
        if licence is not None:
            expressions[licence.text] = licence
    licences = list(expressions.values())
    labels = base.union(noticed, *(x.labels for x in licences))
    missing = (1 - TAG_WEIGHT) ** len(licences) * (1 - BASE_WEIGHT) ** len(base) * (1 - NOTICE_WEIGHT) ** len(noticed - base)
    permitted = [permits(x) for x in base | noticed] + [x.permission for x in licences]
    return (
        len(words), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), 1 - missing,
        "; ".join(sorted(expressions)), min(permitted, default=None),
    )


def scan(documents: DataFrame) -> DataFrame:
    """Licence labels, places, expressions and score of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, tags = automatons()
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.float64()]
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for batch in batches:
            if batch.num_rows:
                columns = zip(*(scanned(text.as_py(), phrases, tags) for text in batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names=names)

    return documents.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(work, COLUMNS)
