"""Spelling variants: near words by one-edit neighbourhoods over a reduced alphabet.

1. *Vocabulary.* Tasks count the words of whole texts; counts are added up by word.
2. *Reduced words.* Each letter becomes one of ``SYMBOLS`` symbols by its code point. Words
   one edit apart have reduced words at most one edit apart, so B's reduced word lies in
   the full one-edit neighbourhood (itself, deletions, replacements, insertions) of A's.
   Few symbols keep neighbourhoods small. Reduced words are 64-bit hashes, from which the
   neighbours' hashes follow without spelling them out.
3. *Join* of the neighbourhoods with the reduced vocabulary; each pair meets once, and the
   join itself verifies it on the original words: Levenshtein distance 1. A bitmap of the
   reduced vocabulary, of fixed size, keeps most neighbours that are no reduced word out of
   the exchange; in a vocabulary that fills it, it saves less and changes nothing.
4. *Long words*, of more than ``SHORT`` code points, would have neighbourhoods that grow
   with the square of their length. An edit leaves one half of the shorter word as it is, so
   long words meet on either half instead, and are verified likewise.
5. *Forms* are a mergeable minimum over near words; *roots* follow them by doubling: a
   form occurs twice as often as its word, so a few rounds reach every last one.

A word is a maximal run of ``A-Za-z`` and U+00C0 to U+00FF with only A-Z lower-cased.
Where ``NOISE`` divides the CRC-32 of ``<doc_id>:<run>``, the run first loses the code
point that the CRC names (a repeatable typing error). Words of at least ``LETTERS`` code
points that occur ``OCCURRENCES`` times count.

Defined results: null and empty texts have no words; a null doc_id is written as nothing
before the colon; repeated rows count as often as they occur; of near words with equal
counts the first in code-point order is the form; an empty table gives an empty result;
other columns are ignored. A word's near words are bounded by its length, but nothing
gathers them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.frames import landed, landed_and_seen

LETTERS, OCCURRENCES, NOISE = 5, 3, 97
#: A form occurs at least so many times as often as its word.
RATIO = 2
SYMBOLS = 8
#: Longest word, in code points, whose neighbourhood is generated.
SHORT = 32
#: Bits of the bitmap, a power of two, and neighbours that a task hashes at once.
BITS, HASHED = 25, 1 << 18
#: Distinct words that a task counts before it passes the counts on, and bytes of a text it cuts into words at once.
COUNTED, CHUNK = 100_000, 1 << 20

#: Runs of the letters in UTF-8; C3 begins all of U+00C0 to U+00FF and nothing else.
RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
#: Fixed odd multiplier of the hashes of reduced words.
BASE = np.uint64(0x9E3779B97F4A7C15)


def pieces(data: bytes) -> Iterator[bytes]:
    """The text in parts of about ``CHUNK`` bytes, cut where no letter stands."""
    begin = 0
    while len(data) - begin > CHUNK:
        end = begin + CHUNK
        run = RUN.search(data, end)
        # a cut between two letters, or inside one, is moved behind the run
        while run and run.start() <= end + 1 and run.end() > end:
            end = run.end()
            run = RUN.search(data, end)
        yield data[begin:end]
        begin = end
    yield data[begin:]


def shortened(run: bytes, crc: int) -> bytes:
    """The run without the code point that its CRC names."""
    word = run.decode("utf-8")
    at = crc % len(word)
    return (word[:at] + word[at + 1 :]).encode("utf-8")


def counted(doc_id: int | None, text: str | None, counts: Counter) -> None:
    """Add the words of one document to ``counts``."""
    crc32 = zlib.crc32
    begun = crc32(b"" if doc_id is None else b"%d" % doc_id)
    begun = crc32(b":", begun)
    for data in pieces((text or "").encode("utf-8", "surrogatepass").lower()):  # bytes: A-Z only
        runs = RUN.findall(data)
        counts.update(runs)
        for run in runs:
            crc = crc32(run, begun)
            if not crc % NOISE:
                counts[run] -= 1
                counts[shortened(run, crc)] += 1


def vocabulary(documents: DataFrame) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            words, numbers = [], []
            for run, n in counts.items():
                if n and len(run) >= LETTERS and len(word := run.decode("utf-8")) >= LETTERS:
                    words.append(word)
                    numbers.append(n)
            counts.clear()
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(numbers, pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counted(doc_id, text.as_py(), counts)
                if len(counts) >= COUNTED:
                    yield from told()
        yield from told()

    words = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OCCURRENCES)


def reduced(words: list[str]) -> np.ndarray:
    """Symbols, from 1, of words of one length: one row a word."""
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)
    return (letters % SYMBOLS + 1).astype(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _beginnings(symbols: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, ... symbols: each is the one before times ``BASE``, plus the symbol."""
    out = np.zeros((symbols.shape[0], symbols.shape[1] + 1), np.uint64)
    for i in range(symbols.shape[1]):
        out[:, i + 1] = out[:, i] * BASE + symbols[:, i]
    return out


def keys(symbols: np.ndarray) -> np.ndarray:
    """One hash for each reduced word."""
    return _mixed(_beginnings(symbols)[:, -1])


def neighbourhood(symbols: np.ndarray) -> np.ndarray:
    """Hashes of all strings over the symbols at most one edit away from each reduced word; repeats are possible."""
    count, length = symbols.shape
    power = np.full(length + 2, BASE)
    power[0] = 1
    power = np.multiply.accumulate(power)
    start = _beginnings(symbols)
    whole = start[:, -1:]
    behind = whole - start * power[length::-1]  # of the symbols from 0, 1, ... on
    every = np.arange(1, SYMBOLS + 1, dtype=np.uint64)
    at = power[length - 1 :: -1] if length else power[:0]  # what a symbol at 0, 1, ... weighs
    deleted = start[:, :-1] * at + behind[:, 1:]
    replaced = (whole - symbols * at)[:, :, None] + (at[:, None] * every)
    inserted = (start * power[length + 1 : 0 : -1] + behind)[:, :, None] + power[length::-1][:, None] * every
    return _mixed(np.concatenate([whole, deleted, replaced.reshape(count, -1), inserted.reshape(count, -1)], axis=1))


def _by_length(words: list[str]) -> Iterator[list[str]]:
    """The words in lists of one length, with at most ``HASHED`` neighbours each (one word at least)."""
    lists: dict[int, list[str]] = {}
    for word in words:
        lists.setdefault(len(word), []).append(word)
    for length, same in lists.items():
        step = max(1, HASHED // ((2 * length + 1) * (SYMBOLS + 1)))
        for i in range(0, len(same), step):
            yield same[i : i + step]


def reduced_vocabulary(words: DataFrame) -> DataFrame:
    """``near, near_n, met`` of the words that a neighbourhood may hold; ``met`` is the reduced word's key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for same in _by_length(list(counts)):
                columns = [pa.array(same), pa.array([counts[w] for w in same], pa.int64()), pa.array(keys(reduced(same)).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["near", "near_n", "met"])

    return words.filter(F.length("word") <= SHORT + 1).select("word", "n").mapInArrow(work, "near string, near_n long, met long")


def known_keys(vocabulary: DataFrame) -> np.ndarray:
    """Bitmap of the top ``BITS`` bits of all keys: at most 2 ** BITS / 8 bytes, whatever the vocabulary."""
    position = F.shiftrightunsigned("met", 64 - BITS) + 1
    parts = vocabulary.groupBy(F.bitmap_bucket_number(position).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("bits"))
    found = {r["part"]: r["bits"] for r in parts.collect()}
    size = 4096  # bytes of Spark's bitmaps
    bits = b"".join(bytes(found.get(i + 1, bytes(size))) for i in range((1 << BITS) // 8 // size))
    return np.frombuffer(bits, np.uint8)


def neighbours(words: DataFrame, known: np.ndarray) -> DataFrame:
    """``word, key``: the neighbourhood of each reduced word, but for keys that the bitmap rules out."""
    shared = words.sparkSession.sparkContext.broadcast(known)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for same in _by_length(batch.column(0).to_pylist()):
                around = neighbourhood(reduced(same))
                around.sort(axis=1)
                at = around >> np.uint64(64 - BITS)
                keep = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0
                keep[:, 1:] &= around[:, 1:] != around[:, :-1]
                row, column = np.nonzero(keep)
                columns = [pa.array(same).take(pa.array(row)), pa.array(around[row, column].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "key"])

    return words.filter(F.length("word") <= SHORT).select("word").mapInArrow(work, "word string, key long")


def halves(own: str, other: str) -> Column:
    """Keys of a long word for the words of ``other`` length: both halves of the shorter length, with both lengths in order."""
    half = "(least(length(word), length(word) + d) DIV 2)"
    return F.expr(f"""
        flatten(transform(array(-1, 0, 1), d -> array(
          xxhash64('first', {own}, {other}, left(word, {half})),
          xxhash64('last', {own}, {other}, right(word, {half})))))""")


def near(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: every ordered pair of words exactly one edit apart, once."""
    one_edit = F.levenshtein("word", "near", 1) == 1
    known = landed(reduced_vocabulary(words))
    around = neighbours(words, known_keys(known))
    pairs = around.join(known, (F.col("key") == F.col("met")) & one_edit).select("word", "near", "near_n")

    long_words = words.filter(F.length("word") >= SHORT)
    from_long = long_words.filter(F.length("word") > SHORT).select("word", F.explode(halves("length(word)", "length(word) + d")).alias("key"))
    to_long = long_words.select(
        F.col("word").alias("near"), F.col("n").alias("near_n"), F.explode(halves("length(word) + d", "length(word)")).alias("met")
    )
    # a pair may share both halves
    long_pairs = from_long.join(to_long, (F.col("key") == F.col("met")) & one_edit).select("word", "near", "near_n").distinct()
    return pairs.union(long_pairs)


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last word that ``word, form`` leads to, for words that have a form."""
    current = landed(forms.select("word", F.col("form").alias("root")))
    while True:
        further = current.select(F.col("word").alias("k"), F.col("root").alias("next"))
        current, seen = landed_and_seen(
            current.join(further, F.col("root") == F.col("k"), "left").select("word", F.coalesce("next", "root").alias("root"), "next"),
            moved=F.count("next"),
        )
        current = current.select("word", "root")
        if not seen["moved"]:
            return current


def variants(documents: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    words = landed(vocabulary(documents))
    best = near(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    )
    told = words.join(best.withColumnRenamed("word", "k"), F.col("word") == F.col("k"), "left")
    has_form = -F.col("best.minus") >= RATIO * F.col("n")
    formed = landed(
        told.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(has_form, F.col("best.near")).alias("form"), F.when(has_form, -F.col("best.minus")).alias("form_n"),
        )
    )
    last = roots(formed.filter("form IS NOT NULL")).withColumnRenamed("word", "k")
    return formed.join(last, F.col("word") == F.col("k"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
