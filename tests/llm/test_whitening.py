"""Operator 13 against numpy, and on awkward input."""

import math

import numpy as np
import pytest

from tests.conftest import SF_DIR
from tidemark.llm import whitening
from tidemark.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, x string, deviation string"


def brute(rows):
    """``{(vec_id, component): (n, deviation, whitened, explained)}`` in lists, and how many rows remain."""
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    falling = np.argsort(-values)
    values, vectors = values[falling], vectors[:, falling]
    out = {}
    for i, x in kept:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for k in range(min(4, int((values > 1e-12 * values[0]).sum()))):
            white = (np.array(x) - np.array(sums) / n) @ vectors[:, k] / math.sqrt(values[k])
            out.setdefault((i, k + 1), []).append((n, deviation, white, values[k] / values.sum()))
    return out


def compare(found, rows):
    expected = brute(rows)
    assert len(found) == sum(map(len, expected.values()))
    signs = {}
    for r in found:
        n, deviation, white, explained = next(e for e in expected[r.vec_id, r.component] if e[1] == r.deviation)
        assert (r.n, r.deviation) == (n, deviation) and isinstance(r.deviation, int)
        assert r.explained == pytest.approx(explained, rel=1e-9) and 0 <= r.identity_error < 1e-9
        assert abs(r.whitened) == pytest.approx(abs(white), abs=1e-8)
        if abs(white) > 1e-6:
            signs.setdefault(r.component, set()).add(r.whitened * white > 0)
    assert all(len(s) == 1 for s in signs.values())
    assert len({r.identity_error for r in found}) <= 1


def test_query_equals_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    compare(QUERIES["op13_whitening"](spark, SF_DIR).collect(), rows)


def test_awkward(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 16)  # several blocks a task, most of them not full
    random = np.random.default_rng(3)
    good = [(i, v.tolist()) for i, v in enumerate(random.normal(size=(300, 5)) * [9, 5, 3, 2, 1])]
    odd = [
        (1000, None), (1001, []), (1002, [1.0, None, 0.0, 0.0, 0.0]), (1003, [float("nan")] * 5), (1004, [float("inf")] + [0.0] * 4),
        (1006, [0.0] * 5), (1007, [-0.0] * 5), (None, [0.25] * 5), (5, good[5][1]), (5, good[5][1]), (7, [1e4, 0.0, 0.0, 0.0, -1e4]),
    ]
    other_length = [(2000, [1.0, 2.0])]
    rows = good + odd + [(3000 + i, [0.5] * 5) for i in range(400)]  # one vector in half of all rows
    df = spark.createDataFrame([(i, v, 0, "x", "d") for i, v in rows + other_length], VECTORS).repartition(5)
    compare(whitening.whitened(df).collect(), rows)


def test_without_variance(spark):
    def vectors(*lists):
        return spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "vec_id long, embedding array<float>")

    assert whitening.whitened(vectors([1.0, 2.0]).limit(0)).count() == 0
    assert whitening.whitened(vectors(None, [])).count() == 0
    assert whitening.whitened(vectors([1.0, 2.0], [1.0, 2.0])).count() == 0
    line = whitening.whitened(vectors([0.0, 0.0], [1.0, 1.0], [2.0, 2.0])).collect()
    assert {r.component for r in line} == {1} and len(line) == 3


def test_exact_deviations():
    x = np.array([[2**40, -(2**40)], [5, 7]])
    assert whitening.deviations(x[1:], 3, [1, 2]) == [14**2 + 19**2]
    assert whitening.deviations(x, 3, [1, 2]) == [None, 14**2 + 19**2]
    assert whitening._exact_sums(np.array([[2**62, 1], [2**62, 1], [2**62, 1]])) == [3 * 2**62, 3]
