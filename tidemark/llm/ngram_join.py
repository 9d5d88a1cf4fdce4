"""Exact Jaccard self-join on word n-grams by rare-first prefix filtering.

A document is the set of its distinct five-word shingles (A-Z lower-cased). Two
documents link when their sets overlap in at least 80 % of the union. Links are
found, and connected, without comparing all documents:

1. *Classes.* Documents with equal sets form one class, named by a hash of the set.
2. *Rare first.* A count sketch over all shingles of all documents orders the
   shingles, rarest first. Any order gives the same links; a bad one costs time.
3. *Prefixes.* Linked sets share one of their first ``n - ceil(0.8 n) + 1``
   shingles. Only these are exchanged. Sets that meet on a shingle are candidates
   if their sizes (length filter) and positions (positional filter) still allow
   80 %.
4. *Suffix filter.* Small histograms of the sets bound the overlap of a candidate.
5. *Verification* of the distinct candidates, once each, on the full sets.
6. *Frequent shingles.* Where more than ``RUN`` classes meet on one shingle, first
   only a leader and classes ``STRIDES`` apart in size order are compared: a few
   pairs a class, which join most of a group of near copies. Once these links are
   joined to components, the classes of a shingle that still holds several components
   meet as whole sets in blocks of at most ``TOGETHER``, and every two blocks of a
   shingle in one task. There all pairs of different components are compared by parity
   sketches, whose distance never exceeds that of the sets, and what these cannot rule
   out by the sets themselves. A link joins its components at once, so a task gives at
   most one row a class, never pairs, and no link between components is lost. Very
   frequent shingles are dealt to ``SALTS`` tasks before.

The result holds components, for which pairs inside one component add nothing.

Defined results: null and empty texts, and texts without words, have no shingles
and link with nothing; texts of one to four words are one shingle, their whole
sequence; rows that repeat a doc_id count as one document whose links are those
of all its texts; a null doc_id has ``component_id`` null; an empty table gives
an empty result; other columns are ignored. Shingles and sets are represented by
64-bit hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.frames import components, landed, landed_and_seen

WORDS = 5
#: Similarity of 80 % as a ratio of integers.
SHARE, WHOLE = 80, 100
#: Largest number of classes on one shingle whose pairs are all candidates at once, and the
#: distances in size order at which the classes of a larger number are.
RUN = 32
STRIDES = (1, 2, 4, 8, 16)
SALTS = 16
#: Classes, and bytes of their sets, that one block of a frequent shingle holds at most.
TOGETHER, TOGETHER_BYTES = 1024, 8 << 20
#: Counters of the sketch, and the slices in which tasks' sketches are added up.
COUNTERS, SLICES = 1 << 20, 64
#: Distinct words whose hashes a task remembers.
REMEMBERED = 300_000

#: Fixed odd multipliers, one for each word of a shingle.
MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64
)

KEYS = "doc_id long, text_key long, n_shingles long, class long, bounds binary, slice int, counts binary"
ENTRIES = "shingle long, salt int, size int, class long, position int"


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII blanks only
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(WORDS, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out += h[i : len(h) - k + 1 + i] * MULTIPLIERS[i]
    return np.unique(_mixed(out))


def _bounds(shingles: np.ndarray) -> bytes:
    """Counts of the shingles by their low bits; the number of cells is a power of two near n / 4."""
    cells = 1 << max(2, (len(shingles) // 4).bit_length() - 1)
    counts = np.bincount((shingles & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def may_overlap(x: bytes, y: bytes, nx: int, ny: int) -> bool:
    """False only if the histograms prove an overlap below the limit."""
    if not x or not y:
        return True
    a, b = np.frombuffer(x, np.uint8).astype(np.int32), np.frombuffer(y, np.uint8).astype(np.int32)
    while len(a) > len(b):
        a = a[: len(a) // 2] + a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] + b[len(b) // 2 :]
    return (SHARE + WHOLE) * int(np.minimum(a, b).sum()) >= SHARE * (nx + ny)


def class_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def document_keys(documents: DataFrame) -> DataFrame:
    """Rows with ``slice`` null: id, set size, class and histogram per document; others: the task's sketch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        sketch = np.zeros(COUNTERS, dtype=np.uint32)
        used = False
        for batch in batches:
            rows = []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), hashes)
                if len(s):
                    np.add.at(sketch, (s >> np.uint64(44)).astype(np.int64), 1)
                    used = True
                    rows.append((len(s), class_of(s), _bounds(s)))
                else:
                    rows.append((0, None, None))
            n = len(rows)
            if n:
                sizes, classes, bounds = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(bounds, pa.binary()),
                        pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "class", "bounds", "slice", "counts"],
                )
        if used:
            parts = [zlib.compress(p.tobytes(), 1) for p in np.split(sketch, SLICES)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.nulls(SLICES, pa.int64())] * 4, pa.nulls(SLICES, pa.binary()),
                    pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary()),
                ],
                names=["doc_id", "text_key", "n_shingles", "class", "bounds", "slice", "counts"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(work, KEYS)


def added_sketch(keys: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches, added slice by slice; ``COUNTERS`` numbers at any input size."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(COUNTERS // SLICES, dtype=np.uint64)
        for piece in table.column("counts"):
            total += np.frombuffer(zlib.decompress(piece.as_py()), np.uint32)
        added = np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()
        return pa.table({"slice": table.column("slice").slice(0, 1), "counts": pa.array([added], pa.binary())})

    pieces = keys.filter("slice IS NOT NULL").select("slice", "counts")
    found = {r["slice"]: r["counts"] for r in pieces.groupBy("slice").applyInArrow(add, "slice int, counts binary").collect()}
    empty = bytes(COUNTERS // SLICES * 4)
    return np.frombuffer(b"".join(found.get(i, empty) for i in range(SLICES)), dtype=np.uint32)


def prefix_entries(documents: DataFrame, sketch: np.ndarray, salted_from: int) -> DataFrame:
    """The rarest shingles of every class, those that a linked class must share."""
    shared = documents.sparkSession.sparkContext.broadcast(sketch)  # COUNTERS numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        hashes = WordHashes()
        done: set[int] = set()  # classes this task has sent; forgetting some only sends them again
        for batch in batches:
            parts = []
            for text in batch.column(0):
                s = shingle_set(text.as_py(), hashes)
                n = len(s)
                if not n:
                    continue
                name = class_of(s)
                if name in done:
                    continue
                if len(done) < REMEMBERED:
                    done.add(name)
                often = counts[(s >> np.uint64(44)).astype(np.int64)]
                keep = n - (SHARE * n + WHOLE - 1) // WHOLE + 1
                first = np.lexsort((s, often))[:keep]
                salt = np.where(often[first] >= salted_from, 1 + name % SALTS, 0).astype(np.int32)
                parts.append((s[first].view(np.int64), salt, n, name))
            if parts:
                lengths = [len(p[0]) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([p[0] for p in parts])),
                        pa.array(np.concatenate([p[1] for p in parts])),
                        pa.array(np.repeat(np.array([p[2] for p in parts], np.int32), lengths)),
                        pa.array(np.repeat(np.array([p[3] for p in parts], np.int64), lengths)),
                        pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])),
                    ],
                    names=["shingle", "salt", "size", "class", "position"],
                )

    return documents.select("text").mapInArrow(work, ENTRIES)


def _allowed(n1, p1, n2, p2):
    """Length and positional filter, on arrays. n1 <= n2."""
    best = 1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1)
    return (WHOLE * n1 >= SHARE * n2) & ((SHARE + WHOLE) * best >= SHARE * (n1 + n2))


MEETINGS = "a long, na int, b long, nb int, shingle long, salt int, position int"


def meetings(entries: DataFrame) -> DataFrame:
    """Candidate pairs (b not null); for shingles met by more than ``RUN`` classes also each of them (b null)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last run, which may go on in the next batch
        hot_head: list | None = None  # of a long run under way: its first and last row

        def pairs(x, y, cols):
            _, _, size, name, pos = cols
            ok = _allowed(size[x].astype(np.int64), pos[x], size[y].astype(np.int64), pos[y])
            x, y = x[ok], y[ok]
            if not len(x):
                return None
            swap = name[x] > name[y]
            lo, hi = np.where(swap, y, x), np.where(swap, x, y)
            key = np.unique(np.stack([name[lo], name[hi], size[lo].astype(np.int64), size[hi].astype(np.int64)]), axis=1)
            none = len(key[0])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(key[0]), pa.array(key[2].astype(np.int32)), pa.array(key[1]), pa.array(key[3].astype(np.int32)),
                    pa.nulls(none, pa.int64()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.int32()),
                ],
                names=["a", "na", "b", "nb", "shingle", "salt", "position"],
            )

        def frequent(i, cols):
            sh, salt, size, name, pos = cols
            return pa.RecordBatch.from_arrays(
                [pa.array(name[i]), pa.array(size[i]), pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.int32()), pa.array(sh[i]), pa.array(salt[i]), pa.array(pos[i])],
                names=["a", "na", "b", "nb", "shingle", "salt", "position"],
            )

        def settle(cols, going_on):
            """Yield what complete runs give; ``going_on``: the first run continues a long one."""
            sh, salt, size, name, pos = cols
            n = len(sh)
            new = np.empty(n, bool)
            new[0] = True
            new[1:] = (sh[1:] != sh[:-1]) | (salt[1:] != salt[:-1])
            start = np.flatnonzero(new)
            length = np.diff(np.append(start, n))
            run_of = np.cumsum(new) - 1
            long_run = (length > RUN) | (salt[start] > 0)
            if going_on:
                long_run[0] = True
            is_long = long_run[run_of]
            found = []
            for d in range(1, min(RUN, int(length.max()))):
                i = np.flatnonzero((run_of[d:] == run_of[:-d]) & (~is_long[d:] | (d in STRIDES)))
                found.append((i, i + d))
            i = np.flatnonzero(is_long & ~new)
            found.append((start[run_of[i]], i))
            out = pairs(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), cols)
            if out is not None:
                yield out
            # of a continued run the first two rows, its leader and its last row, have been told
            told = np.flatnonzero(is_long)
            if going_on:
                told = told[told >= going_on]
            if len(told):
                yield frequent(told, cols)

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            going_on = 0
            if hot_head is not None:
                going_on = len(hot_head[0])
                cols = [np.concatenate([h, c]) for h, c in zip(hot_head, cols)]
                hot_head = None
            elif held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            held = None
            twin = np.zeros(len(cols[0]), bool)  # one class from two tasks
            twin[1:] = (cols[0][1:] == cols[0][:-1]) & (cols[3][1:] == cols[3][:-1])
            twin[:going_on] = False
            cols = [c[~twin] for c in cols]
            sh, salt = cols[0], cols[1]
            last = np.flatnonzero((sh != sh[-1]) | (salt != salt[-1]))
            begin = int(last[-1]) + 1 if len(last) else 0
            run = len(sh) - begin
            if run <= RUN and not (going_on and begin == 0):
                held = [c[begin:] for c in cols]
                cols = [c[:begin] for c in cols]
                if begin:
                    yield from settle(cols, going_on)
            else:
                yield from settle(cols, going_on)
                first = begin
                hot_head = [c[[first, len(c) - 1]] if len(c) - 1 > first else c[[first]] for c in cols]
        if held is not None:
            yield from settle(held, 0)

    ordered = entries.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "size", "class")
    return ordered.mapInArrow(work, MEETINGS)


def texts_of(wanted: DataFrame, representatives: DataFrame, documents: DataFrame) -> DataFrame:
    """``k, text``: the text of one document of every class ``k`` in question."""
    readers = wanted.join(representatives.select(F.col("class").alias("k"), F.col("id"), F.col("text_key")), "k")
    return readers.join(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text"),
        (F.col("id").eqNullSafe(F.col("doc_id"))) & (F.col("text_key") == F.col("key")),
    ).groupBy("k").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, representatives: DataFrame, documents: DataFrame) -> DataFrame:
    """Links among the candidate pairs ``a, na, b, nb``; each is verified once, on whole texts."""
    bounds = representatives.select(F.col("class").alias("k"), "bounds")
    pairs = pairs.select("a", "na", "b", "nb").distinct()
    both = (
        pairs.join(bounds.withColumnRenamed("bounds", "bounds_a"), F.col("a") == F.col("k")).drop("k")
        .join(bounds.withColumnRenamed("bounds", "bounds_b"), F.col("b") == F.col("k")).drop("k")
    )

    def suffix_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, na, b, nb, x, y = (c.to_pylist() for c in batch.columns)
            keep = [i for i in range(len(a)) if may_overlap(x[i], y[i], na[i], nb[i])]
            yield batch.select([0, 2]).take(pa.array(keep, pa.int64()))

    likely = landed(both.mapInArrow(suffix_filter, "a long, b long"))
    wanted = likely.select(F.col("a").alias("k")).union(likely.select("b")).distinct()
    texts = landed(texts_of(wanted, representatives, documents))
    full = (
        likely.join(texts.select(F.col("k").alias("ka"), F.col("text").alias("text_a")), F.col("a") == F.col("ka"))
        .join(texts.select(F.col("k").alias("kb"), F.col("text").alias("text_b")), F.col("b") == F.col("kb"))
        .select("a", "b", "text_a", "text_b")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        recent: dict[int, np.ndarray] = {}
        def of(name, text):
            if name not in recent:
                if sum(map(len, recent.values())) > 4_000_000:
                    recent.clear()
                recent[name] = shingle_set(text.as_py(), hashes)
            return recent[name]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i in range(len(a)):
                x, y = of(a[i], batch.column(2)[i]), of(b[i], batch.column(3)[i])
                common = len(np.intersect1d(x, y, assume_unique=True))
                if WHOLE * common >= SHARE * (len(x) + len(y) - common):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return full.mapInArrow(compare, "a long, b long")


def _salt_leaders(frequent: DataFrame) -> DataFrame:
    """Pairs that tie the parts of a salted shingle together: each part's leader and the leader of all."""
    parts = frequent.filter("salt > 0").groupBy("shingle", "salt").agg(F.min(F.struct("na", "a")).alias("part"))
    whole = parts.groupBy("shingle").agg(F.min("part").alias("all"))
    both = parts.join(whole, "shingle").filter("part.a != all.a")
    low, high = F.least("part.a", "all.a"), F.greatest("part.a", "all.a")
    return both.select(
        low.alias("a"), F.when(low == F.col("part.a"), F.col("part.na")).otherwise(F.col("all.na")).alias("na"),
        high.alias("b"), F.when(high == F.col("part.a"), F.col("part.na")).otherwise(F.col("all.na")).alias("nb"),
    )


def parity_sketches(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """One row of ``bits`` bits a set: whether an odd number of its members falls into a cell.

    Two sketches differ in no more cells than the sets differ in members.
    """
    out = np.zeros((len(sets), bits // 8), np.uint8)
    for row, members in zip(out, sets):
        cells = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
        row[:] = np.packbits((cells & 1).astype(np.uint8))
    return out.view(np.uint64)


def joining_links(size: np.ndarray, position: np.ndarray, component: np.ndarray, sets: list[np.ndarray], block: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the components of these classes as all their links would; pairs of one block only if there is one block.

    Every pair of different components is compared. Found links are joined at once, so there are fewer than classes.
    """
    bits = min(1 << 16, max(256, 1 << (8 * int(np.median(size)) - 1).bit_length()))
    sketches = parity_sketches(sets, bits)
    two = len(np.unique(block)) > 1
    size, position, component = size.astype(np.int64), position.astype(np.int64), component.copy()
    links = []
    for i in range(len(size) - 1):
        j = np.arange(i + 1, len(size))
        j = j[(component[j] != component[i]) & (not two or (block[j] != block[i]))]
        small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        best = 1 + np.minimum(size[i] - position[i], size[j] - position[j]) - 1
        j = j[(WHOLE * small >= SHARE * large) & ((SHARE + WHOLE) * best >= SHARE * (small + large))]
        if not len(j):
            continue
        apart = np.bitwise_count(sketches[j] ^ sketches[i]).sum(axis=1, dtype=np.int64)
        j = j[(SHARE + WHOLE) * apart <= (WHOLE - SHARE) * (size[i] + size[j])]
        for k in j.tolist():
            if component[k] == component[i]:
                continue  # joined by a link found since
            common = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
            if WHOLE * common >= SHARE * (size[i] + size[k] - common):
                links.append((i, k))
                component[component == component[k]] = component[i]
    return links


def _between_components(frequent: DataFrame, labels: DataFrame, representatives: DataFrame, documents: DataFrame) -> DataFrame:
    """Verified links that join all components whose classes meet, and link, on a frequent shingle."""
    seen = landed(frequent.join(labels.select(F.col("id").alias("k"), "component"), F.col("a") == F.col("k")).drop("k"))
    mixed = seen.groupBy("shingle").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"),
        F.greatest(F.ceil(F.count("*") / TOGETHER), F.ceil(8 * F.sum("na") / TOGETHER_BYTES)).cast("int").alias("blocks"),
    ).filter("lo < hi")
    rows = landed(
        seen.join(mixed.select((-F.col("shingle")).alias("m"), "blocks"), -F.col("shingle") == F.col("m"))
        .select("shingle", "a", "position", "component", F.pmod(F.xxhash64("a"), "blocks").cast("int").alias("block"), "blocks").distinct()
    )

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = pa.array([shingle_set(text.as_py(), hashes).tobytes() for text in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["k", "members"])

    wanted = rows.select(F.col("a").alias("k")).distinct()
    sets = texts_of(wanted, representatives, documents).mapInArrow(members, "k long, members binary")
    # every two blocks of a shingle meet once
    dealt = rows.join(sets, F.col("a") == F.col("k")).select(
        "shingle", "a", "position", "component", "block", "members", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
    ).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def compare(group: pa.Table) -> pa.Table:
        names = group.column("a").to_numpy()
        sets = [np.frombuffer(m.as_py(), np.uint64) for m in group.column("members")]
        size = np.array([len(s) for s in sets])
        columns = (group.column(c).to_numpy() for c in ("position", "component", "block"))
        position, component, block = columns
        pairs = joining_links(size, position, component, sets, block)
        a, b = names[[i for i, _ in pairs]], names[[k for _, k in pairs]]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    columns = ("a", "position", "component", "block", "members")
    return dealt.groupBy("shingle", "low", "high").applyInArrow(
        lambda group: compare(group.select(columns)), "a long, b long"
    )


def _joined_up(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further links between classes."""
    ends = labels.select(F.col("id").alias("k"), F.col("component").alias("c"))
    between = (
        links.join(ends, F.col("a") == F.col("k")).select(F.col("c").alias("ca"), "b")
        .join(ends, F.col("b") == F.col("k")).select(F.col("ca").alias("a"), F.col("c").alias("b"))
    )
    merged = components(labels.select(F.col("component").alias("id")).distinct(), between)
    return labels.join(
        merged.select((-F.col("id")).alias("k"), F.col("component").alias("whole")), -F.col("component") == F.col("k")
    ).select("id", F.col("whole").alias("component"))


def _class_components(documents: DataFrame, one_per_id: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (``doc_id, text_key, n_shingles, class``), classes, and the component of every class (``id, component``).

    With ``one_per_id`` the classes of rows that repeat a doc_id are one component.
    """
    keys = landed(document_keys(documents))
    rows = keys.filter("slice IS NULL").drop("slice", "counts")
    sketch = added_sketch(keys)
    classes = landed(
        rows.filter("n_shingles > 0").groupBy("class").agg(
            F.min(F.struct("doc_id", "text_key")).alias("read"), F.min("doc_id").alias("lowest"), F.first("bounds").alias("bounds")
        ).select("class", F.col("read.doc_id").alias("id"), F.col("read.text_key").alias("text_key"), "lowest", "bounds")
    )
    salted_from = 2 * int(sketch.mean()) + 100_000
    met, seen = landed_and_seen(
        meetings(prefix_entries(documents, sketch, salted_from)),
        frequent=F.count_if(F.col("b").isNull()), salted=F.count_if(F.col("b").isNull() & (F.col("salt") > 0)),
    )
    frequent = met.filter("b IS NULL").select("a", "na", "shingle", "salt", "position")
    candidates = met.filter("b IS NOT NULL").select("a", "na", "b", "nb")
    links = verified(candidates.union(_salt_leaders(frequent)) if seen["salted"] else candidates, classes, documents)
    if one_per_id:
        repeated, seen_again = landed_and_seen(
            rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id")
            .agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi"),
            n=F.count(F.lit(1)),
        )
        if seen_again["n"]:
            links = links.union(
                rows.filter("n_shingles > 0").join(repeated.select(F.col("doc_id").alias("k"), "lo"), F.col("doc_id") == F.col("k"))
                .select(F.col("class").alias("a"), F.col("lo").alias("b"))
            )
    labels = landed(components(classes.select(F.col("class").alias("id")), links))
    if seen["frequent"]:
        more, still = landed_and_seen(_between_components(frequent, labels, classes, documents), n=F.count(F.lit(1)))
        if still["n"]:
            labels = landed(_joined_up(labels, more))
    return rows, classes, labels


def linked(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per document row."""
    rows, classes, labels = _class_components(documents, one_per_id=True)
    named = landed(labels.join(classes.select("class", "lowest"), F.col("id") == F.col("class")).select("class", F.col("component").alias("whole"), "lowest"))
    lowest = named.groupBy("whole").agg(F.min("lowest").alias("component_id"))
    by_class = named.select((-F.col("whole")).alias("w"), "class").join(
        lowest.select((-F.col("whole")).alias("v"), "component_id"), F.col("w") == F.col("v")
    ).select((-F.col("class")).alias("k"), F.col("component_id").alias("found"))
    return rows.join(by_class, -F.col("class") == F.col("k"), "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id")
    )


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each group of linked texts, with its own columns.

    That is the row with the smallest doc_id, rows without one last, then with the
    smallest hash of its text; of rows alike in both any one. Different texts under one
    doc_id are documents of their own here. Rows without words all stay.
    """
    rows, classes, labels = _class_components(documents, one_per_id=False)
    # each class's first row, then each component's
    of_class = rows.filter("n_shingles > 0").groupBy("class").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first"), F.count("*").alias("n")
    )
    first = labels.join(of_class, F.col("id") == F.col("class")).groupBy("component").agg(F.min("first").alias("first"))
    stay = landed(first.select(F.col("first.doc_id").alias("stay_id"), F.col("first.text_key").alias("stay_key")))
    whole = documents.select(
        F.struct(*(documents[_quoted(c)] for c in documents.columns)).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_key")
    )
    # only rows that a group keeps, or that have no words, remain
    wordless = ~F.coalesce(F.col("row.text"), F.lit("")).rlike("[^ \\t-\\r]")
    kept = whole.filter(~wordless).join(stay, F.col("own_id").eqNullSafe(F.col("stay_id")) & (F.col("own_key") == F.col("stay_key")), "left_semi")
    again = rows.filter("n_shingles > 0").groupBy("doc_id", "text_key").count().filter("count > 1")
    if not again.isEmpty():
        kept = kept.dropDuplicates(["own_id", "own_key"])
    return kept.union(whole.filter(wordless)).select("row.*")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
