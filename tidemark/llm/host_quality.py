"""Quality rules per document, shrunk failure rates per host, host verdicts for documents.

Every document is tested against a few rules. Their failures are counted per
host; a host's failure rate is shrunk towards an empirical beta prior that the
moments of all hosts give, so a host with few documents is not judged by chance.
A host whose shrunk rate of any rule is above ``max_host_rate`` is rejected, and
with it all its documents.

Defined results: a null or empty text has no words and fails the base rule; a
null host is not a host and gets no verdict (its documents stand on the base rule
alone); repeated rows are judged row by row; an empty table gives an empty
result; columns other than those named are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.frames import landed

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = "doc_id long, host string, text_key long, " + ", ".join(f"{c} long" for c in COUNTS)

#: Rule name to the condition under which a document fails it.
RULES = {
    "base": "n_words < 10 OR 100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "dup_lines": "n_dup_lines >= 5",
    "word_length": "n_words >= 10 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)",
}


def repeat_words(words: list) -> int:
    """Word positions inside windows of five words that occur twice or more."""
    grams = list(zip(*(words[i:] for i in range(WINDOW))))
    seen = Counter(grams)
    if len(seen) == len(grams):
        return 0
    covered = end = 0
    for i, gram in enumerate(grams):
        if seen[gram] > 1:
            covered += i + WINDOW - max(i, end)
            end = i + WINDOW
    return covered


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """The five counts of one text, in the order of ``COUNTS``."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split on exactly the ASCII white space
    blanks = len(data) - sum(map(len, words))
    lines = Counter(data.split(b"\n")) if b"\n" in data else {}
    repeated = sum(n - 1 for line, n in lines.items() if n > 1 and line.split())
    return len(words), len(text) - blanks, sum(map(data.count, (bytes([s]) for s in SYMBOLS))), repeated, repeat_words(words)


def features(documents: DataFrame, host: str = "source") -> DataFrame:
    """One row of counts per document; ``text_key`` tells rows with one id apart."""
    rows = documents.select(
        F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.xxhash64("text").alias("text_key"), "text"
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_counts(t.as_py()) for t in batch.column(3)]
            columns = list(zip(*found)) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), *(pa.array(c, pa.int64()) for c in columns)],
                names=["doc_id", "host", "text_key", *COUNTS],
            )

    return rows.mapInArrow(count, FEATURES)


@dataclass(frozen=True)
class Prior:
    alpha: float
    beta: float

    def shrunk(self, failed: Column, docs: Column) -> Column:
        return (failed + F.lit(self.alpha)) / (docs + F.lit(self.alpha + self.beta))


def beta_prior(hosts: int, docs: int, failed: int, docs_squared: float, rate_squared: float, strongest: float = 1e6) -> Prior:
    """Moments of a beta-binomial over hosts.

    ``docs_squared`` is the sum of n^2, ``rate_squared`` the sum of f^2 / n over
    hosts. Where hosts don't differ more than chance allows the prior is as
    strong as ``strongest`` documents; it is never weaker than one document.
    """
    mean = failed / docs if docs else 0.0
    spread = mean * (1 - mean)
    room = docs - docs_squared / docs if docs else 0.0
    if spread <= 0 or room <= 0:
        return Prior(mean * strongest, (1 - mean) * strongest)
    between = (rate_squared - docs * mean * mean - (hosts - 1) * spread) / room
    correlation = min(max(between / spread, 1 / (strongest + 1)), 0.5)
    strength = 1 / correlation - 1
    return Prior(mean * strength, (1 - mean) * strength)


def rejected_hosts(counted: DataFrame, max_host_rate: float = 0.5) -> DataFrame:
    """Hosts with a shrunk failure rate above the limit, for any rule."""
    per_host = landed(
        counted.filter("host IS NOT NULL").groupBy("host").agg(
            F.count("*").alias("docs"), *(F.count_if(F.expr(rule)).alias(name) for name, rule in RULES.items())
        )
    )
    # one row, whatever the number of hosts
    totals = per_host.agg(
        F.count("*").alias("hosts"),
        F.sum("docs").alias("docs"),
        F.sum(F.col("docs").cast("double") * F.col("docs")).alias("docs_squared"),
        *(F.sum(r).alias(r) for r in RULES),
        *(F.sum(F.col(r).cast("double") * F.col(r) / F.col("docs")).alias(f"{r}_squared") for r in RULES),
    ).first()
    over = F.lit(False)
    for rule in RULES:
        prior = beta_prior(
            totals["hosts"], totals["docs"] or 0, totals[rule] or 0, totals["docs_squared"] or 0.0, totals[f"{rule}_squared"] or 0.0
        )
        over = over | (prior.shrunk(F.col(rule), F.col("docs")) > max_host_rate)
    return per_host.filter(over).select("host")


def judged(documents: DataFrame, host: str = "source", max_host_rate: float = 0.5) -> DataFrame:
    """Counts and verdict per document row: ``base_failed``, ``host_rejected``, ``kept``."""
    counted = landed(features(documents, host))
    # a derived key: both sides are plain exchanges, so the planner can split a hot host
    bad = rejected_hosts(counted, max_host_rate).select(F.reverse("host").alias("bad_key"), F.lit(True).alias("bad"))
    verdict = counted.join(bad, F.reverse("host") == F.col("bad_key"), "left")
    return verdict.select(
        "doc_id", "host", "text_key", *COUNTS,
        F.expr(RULES["base"]).alias("base_failed"),
        F.coalesce("bad", F.lit(False)).alias("host_rejected"),
    ).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep_good(documents: DataFrame, host: str = "source", max_host_rate: float = 0.5) -> DataFrame:
    """The documents that pass, with their own columns."""
    gone = judged(documents, host, max_host_rate).filter("NOT kept").select(
        F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"), F.col("host").alias("gone_host")
    )
    same = (
        documents["doc_id"].cast("long").eqNullSafe(gone["gone_id"])
        & (F.xxhash64(documents["text"]) == gone["gone_key"])
        & documents[host].cast("string").eqNullSafe(gone["gone_host"])
    )
    return documents.join(gone, same, "left_anti")
