"""Operator 11 against brute force, and on awkward input."""

import collections
import re
import zlib

import numpy as np
import pytest

from tests.conftest import SF_DIR
from tidemark.llm import spelling
from tidemark.llm.queries import QUERIES

DOCS = "doc_id long, text string, word string, n string, near string, key string"


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute(documents):
    counts = collections.Counter()
    for doc_id, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    by_length = collections.defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    rows, form = [], {}
    near = {w: [x for d in (-1, 0, 1) for x in by_length[len(w) + d] if one_edit(w, x)] for w in words}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best
    for w in words:
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))))
    return sorted(rows)


def found(df):
    return sorted(map(tuple, df.collect()))


def test_query_equals_brute_force(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert found(QUERIES["op11_spelling"](spark, SF_DIR)) == brute(documents)


def test_awkward(spark):
    dense = " ".join(f"{a}{b}cdef " * (3 + i + j) for i, a in enumerate("abcde") for j, b in enumerate("abcde"))
    runs = ["q" * k for k in (5, 6, 31, 32, 33, 34, 35, 300, 301, 302)]
    mixed = "abcdefghijklmnopqrstuvwxyz" * 40
    longs = [mixed, mixed[:500] + "q" + mixed[501:], mixed + "x", "x" + mixed, mixed[1:], mixed[:32], mixed[:33], mixed[:31] + "é", "é" + mixed[1:33]]
    rows = [
        (1, dense), (1, dense), (2, None), (3, ""), (4, " 12 ,"), (None, "Straße STRASSE strasse straße STRASSE ÀÉÎÕÜ àéîõü ÀÉÎÕÜ ÀÉÎÕÜ"),
        (5, " ".join(r + " " + r.upper() for r in runs + longs)), (6, " ".join(runs + longs + longs)), (7, "tie-aabbb " * 9 + "ccbbb " * 9 + "acbbb " * 3),
        (8, "ab x " * 300_000 + "z" * 40 + " letters×letters÷letters " * 5),
    ]
    df = spark.createDataFrame([(i, t, "w", "n", "e", "k") for i, t in rows], DOCS).repartition(3)
    assert found(spelling.variants(df)) == brute(rows)
    assert spelling.variants(df.limit(0)).count() == 0


def test_chains_of_forms_reach_their_root(spark):
    """Each word is one letter from the next and half as frequent."""
    words = ["abcdefgh"[:i] + "q" * (8 - i) for i in range(9)]
    text = " ".join(w for i, w in enumerate(words) for _ in range(4 << i))
    rows = found(spelling.variants(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert {r[2] for r in rows} == {"abcdefgh"} and rows == brute([(1, text)])


def test_cuts_keep_runs_whole(monkeypatch):
    monkeypatch.setattr(spelling, "CHUNK", 7)
    for text in ("a" * 50 + " b", "é" * 20 + "×÷ é1é", "1" * 30, "abc def ghi jkl mno", ""):
        data = text.encode()
        parts = list(spelling.pieces(data))
        assert b"".join(parts) == data
        assert [r for p in parts for r in spelling.RUN.findall(p)] == spelling.RUN.findall(data)


def test_neighbourhood_holds_every_edit():
    def key(symbols):
        return int(spelling.keys(np.array([symbols], np.uint64))[0])

    word = [3, 1, 4, 1, 5]
    every = range(1, spelling.SYMBOLS + 1)
    expected = {key(word)} | {key(word[:i] + word[i + 1 :]) for i in range(5)}
    expected |= {key(word[:i] + [s] + word[i + 1 :]) for i in range(5) for s in every}
    expected |= {key(word[:i] + [s] + word[i:]) for i in range(6) for s in every}
    assert set(spelling.neighbourhood(np.array([word], np.uint64))[0].tolist()) == expected


@pytest.mark.parametrize("bits", [15, 25])
def test_bitmap_changes_nothing(spark, monkeypatch, bits):
    """Fifteen bits are one bitmap of Spark's; a full one only lets more through."""
    monkeypatch.setattr(spelling, "BITS", bits)
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").filter("doc_id < 40")
    assert found(spelling.variants(documents)) == brute(documents.collect())
