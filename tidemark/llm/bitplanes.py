"""Token ids in files of shuffled planes.

A file holds the ids of consecutive documents. They are cut into chunks of
``CHUNK`` ids; a chunk is transposed into planes, one per byte (or bit) of an id,
and each plane is compressed by zstandard on its own, since high planes are nearly
constant. Planes of zeros take no room. The footer holds the chunk index (place,
number of ids, length of each plane) and the documents' lengths, so a range of ids
is read from its chunks alone.

    "IDPLANE1" | planes of chunk 0 | planes of chunk 1 | ... | index | documents
    | sizes of index and documents, plane kind (3 x uint32) | "IDPLANE1"

Documents are range-partitioned and sorted by doc_id, so files follow each other
in that order, and written once. A task's file is named after its attempt and
listed in the manifest that the task returns: after a lost executor only listed
files count.

Defined results: null and empty texts are their end id alone; a null doc_id sorts
first; rows that repeat a doc_id are in the order of a hash of their texts; an
empty table gives no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.frames import landed
from tidemark.llm.pieces import PieceIds
from tidemark.llm.stores import attempt_name, fresh_folder, opened, written

MAGIC, CHUNK, END = b"IDPLANE1", 1 << 16, 2
BYTES, BITS = 0, 1
PLANES = {BYTES: 4, BITS: 32}
#: What the footer has of a document.
DOCUMENT = np.dtype([("doc_id", "<i8"), ("ids", "<u8"), ("named", "u1")])
#: Ids in one file.
FILE_IDS = 1 << 24
MANIFEST = "part int, number int, file string, documents long, ids long"


def to_planes(ids: np.ndarray, kind: int) -> list[bytes]:
    """The planes of a block of ids, lowest first; a plane of zeros is empty."""
    cells = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == BYTES:
        planes = [cells[:, i] for i in range(4)]
    else:
        bits = np.unpackbits(cells, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, i], bitorder="little") for i in range(32)]
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], count: int, kind: int) -> np.ndarray:
    """The ids of a block; the inverse of ``to_planes``."""
    if kind == BYTES:
        cells = np.zeros((count, 4), np.uint8)
        for i, plane in enumerate(planes):
            if plane:
                cells[:, i] = np.frombuffer(plane, np.uint8)
    else:
        bits = np.zeros((count, 32), np.uint8)
        for i, plane in enumerate(planes):
            if plane:
                bits[:, i] = np.unpackbits(np.frombuffer(plane, np.uint8), bitorder="little")[:count]
        cells = np.packbits(bits, axis=1, bitorder="little")
    return cells.reshape(-1).view("<u4")


@dataclass
class Writer:
    """Builds one file in memory from compressed planes."""

    kind: int = BYTES
    level: int = 3
    body: bytearray = field(default_factory=lambda: bytearray(MAGIC))
    index: list[tuple] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    names: list[int | None] = field(default_factory=list)
    waiting: list[np.ndarray] = field(default_factory=list)
    held: int = 0
    ids: int = 0

    def add(self, name: int | None, ids: np.ndarray) -> None:
        self.names.append(name)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        if self.held >= CHUNK:
            self._flush(self.held - self.held % CHUNK)

    def _flush(self, upto: int) -> None:
        ids = np.concatenate(self.waiting)
        packer = zstandard.ZstdCompressor(level=self.level)
        for at in range(0, upto, CHUNK):
            block = ids[at : min(at + CHUNK, upto)]
            planes = [packer.compress(p) if p else b"" for p in to_planes(block, self.kind)]
            self.index.append((len(self.body), len(block), *map(len, planes)))
            for p in planes:
                self.body += p
        self.waiting = [ids[upto:]]
        self.held = len(ids) - upto

    def finished(self) -> bytes:
        if self.held:
            self._flush(self.held)
        index = zstandard.compress(np.array(self.index, "<u8").tobytes())
        rows = np.zeros(len(self.names), DOCUMENT)
        rows["ids"] = self.lengths
        rows["named"] = [n is not None for n in self.names]
        rows["doc_id"] = [n or 0 for n in self.names]
        documents = zstandard.compress(rows.tobytes())
        return bytes(self.body) + index + documents + struct.pack("<3I", len(index), len(documents), self.kind) + MAGIC


class Reader:
    """Reads documents, or any range of ids, from one file."""

    TAIL = 12 + len(MAGIC)

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = file.read_at(self.TAIL, size - self.TAIL)
        if tail[12:] != MAGIC:
            raise ValueError("not a file of id planes, or cut short")
        index, documents, self.kind = struct.unpack("<3I", tail[:12])
        start = size - self.TAIL - index - documents
        both = file.read_at(index + documents, start)
        self.index = np.frombuffer(zstandard.decompress(both[:index]), "<u8").reshape(-1, 2 + PLANES[self.kind]).astype(np.int64)
        rows = np.frombuffer(zstandard.decompress(both[index:]), DOCUMENT)
        self.lengths = rows["ids"].astype(np.int64)
        self.names = [d if named else None for d, named in zip(rows["doc_id"].tolist(), rows["named"].tolist())]
        self.firsts = np.concatenate([[0], np.cumsum(self.index[:, 1])]) if len(self.index) else np.zeros(1, np.int64)

    def chunk(self, k: int) -> np.ndarray:
        place, count, *sizes = self.index[k].tolist()
        data, at, planes = self.file.read_at(sum(sizes), place), 0, []
        for n in sizes:
            planes.append(zstandard.decompress(data[at : at + n]) if n else b"")
            at += n
        return from_planes(planes, count, self.kind)

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from ``start``, from the chunks that hold them."""
        if not count:
            return np.zeros(0, "<u4")
        k = int(np.searchsorted(self.firsts, start, side="right")) - 1
        parts, at = [], start
        while at < start + count:
            block, off = self.chunk(k), at - int(self.firsts[k])
            parts.append(block[off : off + start + count - at])
            at += len(parts[-1])
            k += 1
        return np.concatenate(parts)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of every document, chunk by chunk."""
        held, at, k = np.zeros(0, "<u4"), 0, 0
        for name, n in zip(self.names, self.lengths.tolist()):
            parts, size = [held], len(held)
            while size < n:
                parts.append(self.chunk(k))
                size += len(parts[-1])
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield name, at, held[:n]
            held, at = held[n:], at + n


def write_ids(documents: DataFrame, path: str, folder: str, end: int = END, kind: int = BYTES, parts: int | None = None) -> DataFrame:
    """Encode and write all documents in the order of doc_id; the manifest of files."""
    spark = documents.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
        .repartitionByRange(parts, "doc_id", "text_key")
        .sortWithinPartitions("doc_id", "text_key")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, writer, number = None, Writer(kind), 0
        part = TaskContext.get().partitionId()
        last = np.array([end], "<u2")

        def done():
            name = written(folder, attempt_name("ids", number) + ".planes", writer.finished())
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([name]), pa.array([len(writer.lengths)], pa.int64()), pa.array([writer.ids], pa.int64())],
                names=["part", "number", "file", "documents", "ids"],
            )

        for batch in batches:
            ids_of = ids_of or PieceIds(path)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                writer.add(doc, np.concatenate([np.frombuffer(ids_of.encode(text.as_py()), "<u2"), last]))
                if writer.ids >= FILE_IDS:
                    yield done()
                    writer, number = Writer(kind), number + 1
        if writer.lengths:
            yield done()

    return ordered.mapInArrow(work, MANIFEST)


def read_ids(spark, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files.

    Only the manifest passes through the driver, a row per file of up to
    ``FILE_IDS`` ids, to find how many ids lie before each file.
    """
    files, before = [], 0
    for row in manifest.orderBy("part", "number").toLocalIterator():
        files.append((row["file"], before))
        before += row["ids"]
    if not files:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    parts = min(len(files), max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    placed = spark.createDataFrame(files, "file string, before long").repartition(parts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, at = opened(uri)
                with system.open_input_file(at) as file:
                    rows = []
                    for name, start, ids in Reader(file).documents():
                        rows.append((name, first + start, len(ids), zlib.crc32(ids.tobytes())))
                        if len(rows) >= 50_000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    return placed.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"]
    )


def written_and_read(documents: DataFrame, path: str, kind: int = BYTES) -> DataFrame:
    """Write all documents' ids to files in the shared folder, then read them back."""
    spark = documents.sparkSession
    manifest = landed(write_ids(documents, path, fresh_folder(spark, "ids"), kind=kind))
    return read_ids(spark, manifest)
