"""Toxicity as graded severity: cumulative-link (proportional odds) regression.

Grades come from ``labels``: 0 not toxic, 1 toxic in an otherwise good text, 2
toxic and of low quality. One weight per word is shared by all grades; ordered
thresholds t1 < t2 separate them: P(grade >= k) = sigmoid(w.x - t_k). A text is
the set of its lower-cased words (runs of letters), so its length does not
dilute what it says. The expected severity is the sum of P(grade >= k).

The model is fitted on at most ``per_grade`` labelled documents of each grade,
those with the smallest hash of their id; rows are weighted so that the sample
stands for all labelled rows. Words found in fewer than ``least_documents`` of
the sample, or no more often in toxic documents than chance explains
(``least_z``), have no weight, and at most ``max_words`` have one.

Defined results: a null or empty text has no words and the severity of the
intercepts alone; with no labelled document, or none that is toxic, severity is 0
and nothing is rejected; a document with several label rows takes the worst of
each; null labels count as 0 (toxic) and 1 (quality); repeated documents are
scored row by row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.frames import landed

GRADES = (0, 1, 2)
LETTERS = re.compile(r"[^\W\d_]+")
MODEL = "words array<string>, weights array<double>, thresholds array<double>"


def word_set(text: str | None) -> set[str]:
    return set(LETTERS.findall(text.lower())) if text else set()


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Severity:
    """A fitted model; without thresholds it knows no toxicity."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def probabilities(self, text: str | None) -> list[float]:
        """P(grade >= 1), P(grade >= 2), ..."""
        # the same order of additions whatever the order of a set
        known = sorted(self.weights.keys() & word_set(text))
        score = sum(self.weights[w] for w in known)
        return [float(_sigmoid(score - t)) for t in self.thresholds]


def select_words(sets: list[set[str]], grade: np.ndarray, least_documents: int, least_z: float, max_words: int) -> list[str]:
    """Words that toxic and other documents use at clearly different rates."""
    toxic = grade > 0
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    in1: Counter = Counter()
    in0: Counter = Counter()
    for words, bad in zip(sets, toxic):
        (in1 if bad else in0).update(words)
    scored = []
    for word in in1.keys() | in0.keys():
        a, b = in1[word], in0[word]
        if a + b >= least_documents:
            p = (a + b) / (n1 + n0)
            z = (a / n1 - b / n0) / np.sqrt(max(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
            if abs(z) >= least_z:
                scored.append((-abs(z), word))
    return sorted(w for _, w in sorted(scored)[:max_words])


def fit(
    sets: list[set[str]], grade: np.ndarray, row_weight: np.ndarray,
    ridge: float = 1.0, least_documents: int = 3, least_z: float = 4.0, max_words: int = 5000, steps: int = 400,
) -> Severity:
    """Weighted maximum likelihood with a ridge, by accelerated gradient steps."""
    if len(grade) == 0 or not (grade > 0).any() or (grade > 0).all():
        return Severity()
    words = select_words(sets, grade, least_documents, least_z, max_words)
    index = {w: i for i, w in enumerate(words)}
    hits = [[index[w] for w in s if w in index] for s in sets]
    rows = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    columns = np.array([i for h in hits for i in h], dtype=np.int64)
    levels = np.arange(1, max(int(grade.max()), 1) + 1)
    above = (grade[:, None] >= levels[None, :]).astype(float)
    share = (row_weight[:, None] * above).sum(0) / row_weight.sum()
    start = -np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))
    # thresholds are start[0] and non-negative gaps, so their order cannot break
    gaps = np.maximum(np.diff(start), 1e-3)
    params = np.concatenate([np.zeros(len(words)), [start[0]], gaps])
    w_count, scale = len(words), row_weight.sum()

    def gradient(p: np.ndarray) -> np.ndarray:
        score = np.bincount(rows, weights=p[columns], minlength=len(hits)) if len(columns) else np.zeros(len(hits))
        cuts = np.cumsum(p[w_count:])
        ge = np.hstack([np.ones((len(hits), 1)), _sigmoid(score[:, None] - cuts[None, :]), np.zeros((len(hits), 1))])
        at = np.arange(len(hits))
        upper, lower = ge[at, grade], ge[at, grade + 1]
        # d log(upper - lower) / d score, and by each cut
        mass = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / mass, lower * (1 - lower) / mass
        by_score = -(du - dl) * row_weight
        by_cut = np.zeros(len(cuts))
        for k in range(len(cuts)):
            by_cut[k] = ((du * (grade == k + 1) - dl * (grade == k)) * row_weight).sum()
        g = np.empty_like(p)
        g[:w_count] = (np.bincount(columns, weights=by_score[rows], minlength=w_count) if len(columns) else 0) + ridge * p[:w_count]
        g[w_count:] = np.cumsum(by_cut[::-1])[::-1]  # a gap moves every later cut
        return g / scale

    velocity = np.zeros_like(params)
    second = np.zeros_like(params)
    for step in range(1, steps + 1):  # Adam: words differ widely in how often they occur
        g = gradient(params)
        velocity = 0.9 * velocity + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        rate = 0.1 * min(1.0, 2 * (1 - step / (steps + 1)))
        params = params - rate * (velocity / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        params[w_count + 1 :] = np.maximum(params[w_count + 1 :], 1e-3)
    return Severity(dict(zip(words, params[:w_count].tolist())), np.cumsum(params[w_count:]).tolist())


def graded_labels(labels: DataFrame) -> DataFrame:
    """``labels`` to (id, grade), one row per document."""
    worst = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.coalesce(F.col("toxic").cast("int"), F.lit(0))).alias("toxic"),
        F.min(F.coalesce(F.col("quality").cast("int"), F.lit(1))).alias("quality"),
    )
    return worst.select("id", F.expr("CASE WHEN toxic < 1 THEN 0 WHEN quality > 0 THEN 1 ELSE 2 END").alias("grade"))


def train(documents: DataFrame, labels: DataFrame, per_grade: int = 4000) -> Severity:
    """Fit on a bounded sample of the labelled documents, in one task."""
    graded = landed(graded_labels(labels).join(documents.select(F.col("doc_id").cast("long").alias("id")).distinct(), "id"))
    totals = {r["grade"]: r["count"] for r in graded.groupBy("grade").count().collect()}  # a row per grade
    picked = None
    for grade in GRADES:
        some = graded.filter(F.col("grade") == grade).orderBy(F.xxhash64("id"), "id").limit(per_grade)
        picked = some if picked is None else picked.union(some)
    sample = (
        documents.select(F.col("doc_id").cast("long").alias("id"), "text")
        .join(F.broadcast(picked), "id")  # at most per_grade rows of each grade
        .groupBy("id", "grade").agg(F.min("text").alias("text"))
    )

    def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(word_set(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string()))], names=["id", "grade", "words"]
            )

    def learn(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        grade = rows.column("grade").to_numpy().astype(np.int64)
        sampled = Counter(grade.tolist())
        weight = np.array([totals[g] / sampled[g] for g in grade.tolist()])
        model = fit([set(w) for w in rows.column("words").to_pylist()], grade, weight)
        return pa.table(
            {
                "words": pa.array([list(model.weights)], pa.list_(pa.string())),
                "weights": pa.array([list(model.weights.values())], pa.list_(pa.float64())),
                "thresholds": pa.array([model.thresholds], pa.list_(pa.float64())),
            }
        )

    learned = (
        sample.mapInArrow(word_rows, "id long, grade int, words array<string>")
        .groupBy(F.lit(0).alias("whole_sample"))
        .applyInArrow(learn, MODEL)
        .first()
    )
    return Severity(dict(zip(learned["words"], learned["weights"])), list(learned["thresholds"])) if learned else Severity()


def scores(text: Column, model: Severity) -> Column:
    """Struct of ``severity``, ``p_toxic`` and ``grade`` (the most probable) of a text column."""

    @F.arrow_udf("severity double, p_toxic double, grade int")
    def score(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            p = model.probabilities(text.as_py())
            mass = -np.diff([1.0, *p, 0.0])
            out.append((sum(p), p[0] if p else 0.0, int(mass.argmax())))
        severity, p_toxic, grade = zip(*out) if out else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(severity, pa.float64()), pa.array(p_toxic, pa.float64()), pa.array(grade, pa.int32())],
            names=["severity", "p_toxic", "grade"],
        )

    return score(text)


def graded(documents: DataFrame, model: Severity, limit: float = 0.5) -> DataFrame:
    """``doc_id, severity, p_toxic, grade, toxic, kept`` per document row."""
    return documents.select(F.col("doc_id"), scores(F.col("text"), model).alias("s")).select(
        "doc_id", "s.*", (F.col("s.p_toxic") >= limit).alias("toxic"), (F.col("s.p_toxic") < limit).alias("kept")
    )


def keep_civil(documents: DataFrame, model: Severity, limit: float = 0.5) -> DataFrame:
    """The documents below the limit, with their own columns."""
    return documents.filter(scores(documents["text"], model)["p_toxic"] < limit)
