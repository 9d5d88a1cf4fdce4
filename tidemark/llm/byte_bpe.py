"""Byte-level BPE encoding and decoding by recursive queries inside each task.

Every partition opens its own in-memory DuckDB. Pre-tokens it has not met are
laid out as (word, position, token) rows, one per byte. A recursive query joins
neighbours with the merge table and contracts each word's leftmost pair of lowest
rank, until no word has a pair left. The ids of a batch of documents are decoded
by an ordered aggregation over (document, position) rows joined with the vocabulary.

A vocabulary file in the tiktoken form gives ranks; any two neighbours whose
joint bytes have a rank may merge, as in the tiktoken library, and a pre-token
that is itself in the vocabulary is one token.

Defined results: a null text is encoded as the empty text, which has no tokens;
special tokens are ordinary text; repeated rows are encoded row by row; an empty
table gives an empty result; other columns are ignored. The state of a word is
kept once, not once per step, so a word needs memory in proportion to its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.pieces import split

OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Pre-tokens remembered by a task, bytes laid out, tokens decoded and characters taken at once.
REMEMBERED, LAID_OUT, DECODED, TAKEN = 300_000, 400_000, 500_000, 5_000_000
#: Words up to so many bytes are contracted together, step by step; from ``LONG`` bytes on, a step takes
#: all places of a rank. The ids are the same either way, only the work differs.
SHORT, LONG = 64, 2_000

#: ``state`` holds one row per byte; a contracted byte has token null. Each step emits the two
#: rows that change in every word that still has a pair.
CONTRACT = """
WITH RECURSIVE state(word, pos, tok) USING KEY (word, pos) AS (
    SELECT word, pos, tok FROM laid_out
  UNION
    SELECT word, unnest([pos, npos]), unnest([rank, NULL])
    FROM (
        SELECT n.word, min({'rank': m.rank, 'pos': n.pos, 'npos': n.npos}) AS b
        FROM (
            SELECT word, pos, tok, lead(pos) OVER w AS npos, lead(tok) OVER w AS ntok
            FROM recurring.state WHERE tok IS NOT NULL AND word IN (SELECT word FROM state)
            WINDOW w AS (PARTITION BY word ORDER BY pos)
        ) n JOIN merges m ON m.a = n.tok AND m.b = n.ntok
        GROUP BY n.word
    ) x, (SELECT b.rank AS rank, b.pos AS pos, b.npos AS npos)
)
SELECT word, pos, tok FROM state WHERE tok IS NOT NULL ORDER BY word, pos
"""

#: The same for long words: each step contracts all places of a word's lowest rank, from left to right
#: and without overlap (every second pair of a run), as single steps would: up to and with the first
#: place whose new token makes a pair of a still lower rank with a neighbour, which must then go first.
#: So a long word needs a step per rank that it holds, not one per merge.
CONTRACT_LONG = """
WITH RECURSIVE state(word, pos, tok) USING KEY (word, pos) AS (
    SELECT word, pos, tok FROM laid_out
  UNION
    SELECT word, unnest([pos, npos]), unnest([rank, NULL])
    FROM (
        SELECT t.word, t.pos, t.npos, t.rank,
            count(coalesce(l.rank, r.rank)) OVER (PARTITION BY t.word ORDER BY t.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS urgent
        FROM (
            SELECT word, pos, npos, rank, nntok, CASE WHEN k - 2 = lag(k) OVER (PARTITION BY word ORDER BY k) THEN rank ELSE ptok END AS ptok
            FROM (
                SELECT *, k - first_value(k) OVER (PARTITION BY word, run ORDER BY k) AS place
                FROM (
                    SELECT p.*, k - row_number() OVER (PARTITION BY word ORDER BY k) AS run
                    FROM (
                        SELECT n.*, m.rank, min(m.rank) OVER (PARTITION BY n.word) AS lowest
                        FROM (
                            SELECT word, pos, tok, lag(tok) OVER w AS ptok, lead(pos) OVER w AS npos, lead(tok) OVER w AS ntok,
                                lead(tok, 2) OVER w AS nntok, row_number() OVER w AS k
                            FROM recurring.state WHERE tok IS NOT NULL AND word IN (SELECT word FROM state)
                            WINDOW w AS (PARTITION BY word ORDER BY pos)
                        ) n JOIN merges m ON m.a = n.tok AND m.b = n.ntok
                    ) p WHERE rank = lowest
                )
            ) WHERE place % 2 = 0
        ) t
        LEFT JOIN merges l ON l.a = t.ptok AND l.b = t.rank AND l.rank < t.rank
        LEFT JOIN merges r ON r.a = t.rank AND r.b = t.nntok AND r.rank < t.rank
    ) WHERE urgent = 0
)
SELECT word, pos, tok FROM state WHERE tok IS NOT NULL ORDER BY word, pos
"""

#: The same for short words: all rows of active words at every step, each with its neighbour to the
#: right, so that no step sorts. A pair's rank and places are one number (places are below 2^16).
CONTRACT_SHORT = """
WITH RECURSIVE state AS (
    SELECT word, pos, tok, npos, ntok, 0 AS step FROM laid_out
  UNION ALL
    SELECT s.word, s.pos, CASE WHEN s.pos = b.pos THEN b.rank ELSE s.tok END,
      CASE WHEN s.pos = b.pos THEN b.nnpos ELSE s.npos END,
      CASE WHEN s.pos = b.pos THEN b.nntok WHEN s.npos = b.pos THEN b.rank ELSE s.ntok END, s.step + 1
    FROM state s JOIN (
        SELECT x.word, x.rank, x.pos, x.npos, n.npos AS nnpos, n.ntok AS nntok
        FROM (
            SELECT word, (best >> 32)::INT AS rank, ((best >> 16) & 65535)::INT AS pos, (best & 65535)::INT AS npos FROM (
                SELECT s.word, min(m.rank::BIGINT * 4294967296 + s.pos * 65536 + s.npos) AS best
                FROM state s JOIN merges m ON m.a = s.tok AND m.b = s.ntok GROUP BY s.word)
        ) x JOIN state n ON n.word = x.word AND n.pos = x.npos
    ) b ON b.word = s.word AND s.pos <> b.npos
)
SELECT word, pos, tok FROM state SEMI JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) USING (word, step)
ORDER BY word, pos
"""

DECODE = """
SELECT doc, string_agg(bytes, '' ORDER BY pos) AS bytes
FROM encoded JOIN vocabulary USING (tok) GROUP BY doc ORDER BY doc
"""


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Coder:
    """Encodes and decodes by queries; remembers the ids of pre-tokens as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        import duckdb

        self.ranks = ranks_of(path)
        self.known: dict[str, bytes] = {}
        self.one = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        vocabulary = pa.table({"tok": list(self.ranks.values()), "bytes": [t.hex() for t in self.ranks]})
        merges = [
            (self.ranks[token[:i]], self.ranks[token[i:]], rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if token[:i] in self.ranks and token[i:] in self.ranks
        ]
        a, b, rank = np.array(merges or np.empty((0, 3)), dtype=np.int32).T
        self.con.register("vocabulary_rows", vocabulary)
        self.con.register("merge_rows", pa.table({"a": a, "b": b, "rank": rank}))
        self.con.execute("CREATE TABLE vocabulary AS SELECT tok::INT AS tok, bytes FROM vocabulary_rows")
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")

    def _contract(self, words: list[bytes], query: str) -> list[bytes]:
        lengths = np.array([len(w) for w in words])
        pos = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
        tok = self.one[np.frombuffer(b"".join(words), np.uint8)]
        last = np.zeros(len(tok), bool)
        last[np.cumsum(lengths) - 1] = True
        laid_out = pa.table(
            {
                "word": np.repeat(np.arange(len(words), dtype=np.int32), lengths), "pos": pos, "tok": tok,
                "npos": pa.array(pos + 1, mask=last), "ntok": pa.array(np.append(tok[1:], tok[:1]), mask=last),
            }
        )
        self.con.register("laid_out", laid_out)
        found = self.con.execute(query).fetchnumpy()
        self.con.unregister("laid_out")
        ids = np.asarray(found["tok"]).astype("<u4")
        ends = np.searchsorted(found["word"], np.arange(1, len(words) + 1))
        return [x.tobytes() for x in np.split(ids, ends[:-1])]

    def learn(self, pieces: set[str]) -> None:
        """Encode the pre-tokens that are not known yet."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [(p, p.encode("utf-8", "surrogatepass")) for p in pieces if p not in self.known]
        short, middle, long = [], [], []
        for piece, data in new:
            if data in self.ranks:
                self.known[piece] = self.ranks[data].to_bytes(4, "little")
            else:
                (short if len(data) <= SHORT else middle if len(data) < LONG else long).append((piece, data))
        short.sort(key=lambda x: len(x[1]))
        for words, query in ((short, CONTRACT_SHORT), (middle, CONTRACT), (long, CONTRACT_LONG)):
            at = 0
            while at < len(words):
                to, size = at, 0
                while to < len(words) and (to == at or size + len(words[to][1]) <= LAID_OUT):
                    size += len(words[to][1])
                    to += 1
                for (piece, _), ids in zip(words[at:to], self._contract([d for _, d in words[at:to]], query)):
                    self.known[piece] = ids
                at = to

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [split(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn(set(chain.from_iterable(pieces)))
        return [b"".join(map(self.known.__getitem__, p)) for p in pieces]

    def decoded(self, encoded: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """(document, bytes) in order; a long document comes in several stretches."""
        lengths = np.array([len(e) // 4 for e in encoded])
        ids = np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)
        docs = np.repeat(np.arange(len(encoded), dtype=np.int32), lengths)
        for at in range(0, len(ids), DECODED):
            part = slice(at, at + DECODED)
            self.con.register("encoded", pa.table({"doc": docs[part], "pos": np.arange(len(ids[part]), dtype=np.int32), "tok": ids[part]}))
            rows = self.con.execute(DECODE).fetchall()
            self.con.unregister("encoded")
            for doc, text in rows:
                yield doc, bytes.fromhex(text)


def stretches(texts: pa.Array, most: int = TAKEN) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about ``most`` characters, with the place of the first."""
    start, size, held = 0, 0, []
    for i, text in enumerate(texts):
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size >= most:
            yield start, held
            start, size, held = i + 1, 0, []
    if held:
        yield start, held


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per document row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or Coder(path)
            for start, texts in stretches(batch.column(1)):
                encoded = coder.encode(texts)
                digests = [hashlib.sha256() for _ in texts]
                for doc, data in coder.decoded(encoded):
                    digests[doc].update(data)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(texts)),
                        pa.array([len(e) // 4 for e in encoded], pa.int64()),
                        pa.array([hashlib.sha256(e).hexdigest() for e in encoded]),
                        pa.array([d.hexdigest() for d in digests]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, OUT)
