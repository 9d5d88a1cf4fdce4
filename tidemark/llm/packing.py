"""Sum-of-squares online packing of tokenized documents into windows.

Each task packs the documents of its partition as they come. ``N(h)`` counts the
windows filled to level h, 0 < h < capacity. A document goes to the open level, or
to a new window, that gives the smallest sum of N(h)^2 (Csirik et al., "On the
Sum-of-Squares Algorithm for Bin Packing", 2006); of equal choices the fullest
window is taken. Documents longer than a window fill whole windows and only their
rest is placed. When a partition ends, or ``OPEN`` windows are open, the pieces of
the open windows are laid end to end and cut at the capacity, so a task pads one
window.

Sequence ids are unique: the partition's number in the upper, a count in the lower
32 bits. Which documents share a window depends on the partitions of the input.

Defined results: null and empty texts are their end id alone; rows that repeat a
doc_id are documents of their own; an empty table gives no pieces; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.pieces import PieceIds

CAPACITY, OPEN, END = 2048, 8192, 1
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Windows:
    """The windows of one task. ``rows`` collects finished pieces."""

    def __init__(self, first_id: int = 0, capacity: int = CAPACITY):
        self.capacity = capacity
        self.next_id = first_id
        self.levels = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list]] = {}  # level to windows, each a list of pieces
        self.count = 0
        self.rows: list[tuple] = []

    def _finish(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), crc(ids), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc, ids: np.ndarray) -> None:
        """Place a document of at least one id."""
        total, whole = len(ids), len(ids) - len(ids) % self.capacity
        for start in range(0, whole, self.capacity):
            self._finish([(doc, start, ids[start : start + self.capacity], total)])
        if whole < total:
            self._place((doc, whole, ids[whole:], total))

    def _place(self, piece: tuple) -> None:
        size, n = len(piece[2]), self.levels
        # change of the sum of squares for every open level that has room, and for a new window
        last = self.capacity - size
        change = 2 * (n[size : last + size + 1] - n[: last + 1])
        change[last] -= 1 if last else 0  # a full window is counted nowhere: -2 N(h) + 1, not + 2
        change[1:][n[1 : last + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * n[size] - 1  # 2 N(size) + 1, less the 2 that the others leave out
        if last == 0:
            level = 0
        else:
            level = last - int(np.argmin(change[::-1]))
        window = [] if level == 0 else self.open[level].pop()
        if level:
            n[level] -= 1
            self.count -= 1
        window.append(piece)
        if level + size == self.capacity:
            self._finish(window)
            return
        n[level + size] += 1
        self.open.setdefault(level + size, []).append(window)
        self.count += 1
        if self.count >= OPEN:
            self.close()

    def close(self) -> None:
        """Lay the open windows' pieces end to end and cut them at the capacity."""
        held, room = [], self.capacity
        for level in sorted(self.open, reverse=True):
            for window in self.open[level]:
                for doc, start, ids, total in window:
                    while len(ids):
                        held.append((doc, start, ids[:room], total))
                        taken = len(held[-1][2])
                        start, ids, room = start + taken, ids[taken:], room - taken
                        if not room:
                            self._finish(held)
                            held, room = [], self.capacity
        if held:
            self._finish(held)
        self.open, self.count = {}, 0
        self.levels[:] = 0


def packed(documents: DataFrame, path: str, end: int = END) -> DataFrame:
    """One row per piece, see ``PIECES``. ``path``: vocabulary of the tokenizers library."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(TaskContext.get().partitionId() << 32)
        ids_of = None

        def told():
            columns = list(zip(*windows.rows))
            windows.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)

        for batch in batches:
            ids_of = ids_of or PieceIds(path)
            last = np.array([end], "<u2")
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                windows.add(doc, np.concatenate([np.frombuffer(ids_of.encode(text.as_py()), "<u2"), last]))
            if windows.rows:
                yield told()
        windows.close()
        if windows.rows:
            yield told()

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, PIECES)
