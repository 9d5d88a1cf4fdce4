"""WARC archives as seekable Zstandard bundles.

Pages become WARC 1.1 records. Records are grouped into frames of about
``FRAME`` bytes, each an independent Zstandard frame; a bundle ends with the seek
table of the Zstandard seekable format (a skippable frame listing the compressed
and plain size of every frame), so a reader finds any frame from the end of the
file. The index maps a record to bundle, frame and offset inside the plain frame.

Of the pages with equal payloads, compared by SHA-1, that with the smallest page_id is
stored as a response and the others as revisits that refer to it; payloads smaller
than ``least_bytes`` are always responses. A revisit keeps the digest and the HTTP header
with the length of the full payload.

A task's bundles are named after its attempt and listed in the index it returns,
so after a lost executor only listed bundles count.

Defined results: a null html is the empty payload; a null url has no target URI;
a null page_id is stored under a name of its own, as a revisit if a page with an id
has its payload, else as a response; rows that repeat the smallest page_id of
their payload are responses too; an empty table writes nothing; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.frames import landed
from tidemark.llm.stores import attempt_name, fresh_folder, opened, written

FRAME, BUNDLE, LEVEL = 1 << 18, 1 << 24, 3
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed text: the profile of a revisit with an equal payload, by the WARC standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, bundle string, frame int, offset long, length long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:page:none:{digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record; ``first`` is the page a revisit refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = first is not None
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_name(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(first, digest)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block and end of the record at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    fields = dict(line.split(": ", 1) for line in data[at:stop].decode("utf-8", "surrogatepass").split("\r\n")[1:])
    start, size = stop + 4, int(fields["Content-Length"])
    return fields, data[start : start + size], start + size + 4


class Bundle:
    """Collects records into frames; ``finished`` is the whole file."""

    def __init__(self, level: int = LEVEL):
        self.packer = zstandard.ZstdCompressor(level=level)
        self.body, self.table, self.frame = bytearray(), [], bytearray()

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        if self.frame and len(self.frame) + len(data) > FRAME:
            self.cut()
        place = len(self.table), len(self.frame)
        self.frame += data
        return place

    def cut(self) -> None:
        packed = self.packer.compress(bytes(self.frame))
        self.table.append((len(packed), len(self.frame)))
        self.body += packed
        self.frame = bytearray()

    def finished(self) -> bytes:
        if self.frame:
            self.cut()
        entries = b"".join(struct.pack("<2I", *sizes) for sizes in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        return bytes(self.body) + struct.pack("<2I", SKIPPABLE, len(entries) + len(footer)) + entries + footer


class BundleReader:
    """Frames of a bundle by number, found through its seek table."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        count, _, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table, or cut short")
        entries = file.read_at(8 * count, size - 9 - 8 * count)
        self.places, at = [], 0
        for packed, plain in struct.iter_unpack("<2I", entries):
            self.places.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.places[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)


def read_record(bundle: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index: header fields and block."""
    system, path = opened(bundle)
    with system.open_input_file(path) as file:
        fields, block, _ = parsed(BundleReader(file).frame(frame), offset)
    return fields, block


def write_bundles(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write all pages; the index of records."""
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    repeated = (
        rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    )
    # a derived key: both sides are plain exchanges, so the planner can split a hot payload
    joined = rows.join(
        repeated.select(F.reverse("digest").alias("again"), "first"), F.reverse("digest") == F.col("again"), "left"
    ).select(
        "page_id", "url", "payload",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, places, number, size = Bundle(), [], 0, 0

        def done():
            name = written(folder, attempt_name("pages", number) + ".warc.zst", bundle.finished())
            page, frame, offset, length = zip(*places)
            return pa.RecordBatch.from_arrays(
                [pa.array(page, pa.int64()), pa.array([name] * len(page)), pa.array(frame, pa.int32()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())],
                names=["page_id", "bundle", "frame", "offset", "length"],
            )

        for batch in batches:
            ids, urls, firsts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            for page, url, payload, first in zip(ids, urls, batch.column(2), firsts):
                payload = payload.as_py()
                data = record(page, url, payload, digest32(payload), first)
                places.append((page, *bundle.add(data), len(data)))
                size += len(data)
                if size >= BUNDLE:
                    yield done()
                    bundle, places, number, size = Bundle(), [], number + 1, 0
        if places:
            yield done()

    return joined.mapInArrow(work, INDEX)


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of the listed bundles, read frame by frame."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = opened(uri)
                with system.open_input_file(path) as file:
                    reader = BundleReader(file)
                    for k in range(len(reader.places)):
                        data, at, rows = reader.frame(k), 0, []
                        while at < len(data):
                            fields, block, at = parsed(data, at)
                            rows.append(_page(fields, block))
                        columns = zip(*rows)
                        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=READ_NAMES)

    bundles = index.select("bundle").distinct()
    # a few small rows, but much to read behind each: one task a bundle
    return bundles.repartition(max(1, bundles.count())).mapInArrow(work, READ)


READ_NAMES = [c.split()[0] for c in READ.split(", ")]


def _number(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _page(fields: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    if kind == "response" and (len(payload) != size or digest32(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return _number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest, kind, _number(fields.get("WARC-Refers-To"))


def written_and_read(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages to bundles in the shared folder, then read the bundles back."""
    index = landed(write_bundles(pages, fresh_folder(pages.sparkSession, "warc"), least_bytes))
    return read_bundles(index)
