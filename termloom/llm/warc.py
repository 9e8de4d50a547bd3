"""Web archives in seekable Zstandard bundles.

A bundle is a WARC file in independent Zstandard frames, each of some records,
with a seek table as its last, skippable frame. Any reader of Zstandard reads it
from front to back; one that knows the seek table reads a single frame. An index
table maps record identifiers to bundle, frame and place in the frame.

Tasks write bundles under names of their own attempt and return the index rows.
What a lost or repeated task wrote is not in the index and is not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.batches import text_slices
from termloom.session import materialize

# Fixed values of the formats.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_TABLE_MAGIC = 0x8F92EAB1
SEEK_ENTRY = "<II"
SEEK_FOOTER = "<IBI"
RECORD_ID = "urn:page:"

#: Payloads of fewer bytes are never revisits.
MIN_REVISIT_BYTES = 1000
#: Uncompressed sizes at which a frame and a bundle close.
FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 64 * 1024 * 1024
COMPRESSION_LEVEL = 3
DATE = "2000-01-01T00:00:00Z"

INDEX = "record_id string, bundle string, frame int, offset bigint, length bigint"
MOST_READ_TASKS = 20_000


def file_system(uri: str):
    """The file system of a shared folder and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def sha1_base32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def record_id(page_id: int | None) -> str:
    return f"<{RECORD_ID}{'' if page_id is None else page_id}>"


def page_of(identifier: str | None) -> int | None:
    """The page of a record identifier; none if it has none."""
    number = (identifier or "").strip("<>").removeprefix(RECORD_ID)
    return int(number) if number else None


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool
) -> bytes:
    """A response record of a payload, or a revisit record of one stored elsewhere.

    `digest` is the payload's SHA-1 in hexadecimal. A revisit holds the HTTP
    header with the length of the payload, and no payload.
    """
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{sha1_base32(digest)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        fields["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    if revisit:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to)}
    head = "".join(f"{name}: {value}\r\n" for name, value in fields.items())
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    """A record as read back, with its header fields and its HTTP payload."""

    fields: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _header(data: bytes, start: int) -> tuple[dict[str, str], int]:
    """Header fields, lower-cased names, from `start` on, and where the body begins."""
    end = data.index(b"\r\n\r\n", start)
    lines = data[start:end].decode().split("\r\n")[1:]
    pairs = (line.partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}, end + 4


def parse_records(data: bytes) -> Iterator[tuple[int, int, Record]]:
    """(offset, length, record) of the records of a frame."""
    at = 0
    while at < len(data):
        fields, body = _header(data, at)
        end = body + int(fields["content-length"])
        http, payload = _header(data, body)
        yield at, end + 4 - at, Record(fields, http, data[payload:end])
        at = end + 4


class BundleWriter:
    """Writes records into frames of one bundle and remembers where they are."""

    def __init__(self, sink: BinaryIO, name: str):
        self.sink, self.name = sink, name
        self.compressor = zstandard.ZstdCompressor(level=COMPRESSION_LEVEL, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[str, str, int, int, int]] = []
        self.pending = bytearray()
        self.written = 0

    def add(self, identifier: str, data: bytes) -> None:
        self.index.append((identifier, self.name, len(self.frames), len(self.pending), len(data)))
        self.pending += data
        self.written += len(data)
        if len(self.pending) >= FRAME_BYTES:
            self.end_frame()

    def end_frame(self) -> None:
        if self.pending:
            frame = self.compressor.compress(bytes(self.pending))
            self.sink.write(frame)
            self.frames.append((len(frame), len(self.pending)))
            self.pending.clear()

    def close(self) -> list[tuple[str, str, int, int, int]]:
        """End the bundle with its seek table; the index rows of its records."""
        self.end_frame()
        table = b"".join(struct.pack(SEEK_ENTRY, *frame) for frame in self.frames)
        table += struct.pack(SEEK_FOOTER, len(self.frames), 0, SEEK_TABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.sink.close()
        return self.index


class BundleReader:
    """Frames of a bundle, one at a time, by its seek table."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        end = size - struct.calcsize(SEEK_FOOTER)
        count, _, magic = struct.unpack(SEEK_FOOTER, source.read_at(size - end, end))
        if magic != SEEK_TABLE_MAGIC:
            raise ValueError("the bundle has no seek table")
        length = count * struct.calcsize(SEEK_ENTRY)
        self.frames = list(struct.iter_unpack(SEEK_ENTRY, source.read_at(length, end - length)))
        self.starts = [0]
        for compressed, _ in self.frames:
            self.starts.append(self.starts[-1] + compressed)

    def frame(self, number: int) -> bytes:
        compressed, size = self.frames[number]
        data = self.source.read_at(compressed, self.starts[number])
        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)

    def record(self, frame: int, offset: int, length: int) -> Record:
        """One record by its place in the index."""
        return next(parse_records(self.frame(frame)[offset : offset + length]))[2]


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, digest, refers_to, revisit) of every row of `pages`.

    Of equal payloads of at least `min_bytes` the page with the largest id is
    the response and the others revisit it; rows that share that id are all
    responses, pages without an id revisit one that has. A payload stays where
    it is: only digests are grouped, and those that repeat meet their pages by
    a join that Spark plans by their written size.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digested = pages.select(
        F.col("page_id").cast("bigint"), "url", "html", F.sha1(payload).alias("digest")
    )
    repeated = (
        digested.where(F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("last_page"), F.count("*").alias("n"))
        .where("n > 1 AND last_page IS NOT NULL")
        .drop("n")
    )
    repeated = materialize(repeated, "repeated_payloads")
    revisit = F.col("last_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_page"))
    return digested.join(repeated, "digest", "left").select(
        "page_id",
        "url",
        "html",
        "digest",
        F.when(revisit, F.col("last_page")).alias("refers_to"),
        revisit.alias("revisit"),
    )


def write_bundles(pages: DataFrame, folder: str) -> DataFrame:
    """Write all `pages` (page_id, url, html) as bundles in `folder`; returns their index.

    A null page has an empty payload. An empty table writes no bundle. The
    folder must be one that all executors share; its index lies beside it.
    """
    names = [column.split()[0] for column in INDEX.split(", ")]

    def write(batches):
        files, root = file_system(folder)
        files.create_dir(root)
        writer = None

        def index_of(rows):
            arrays = [pa.array(column) for column in zip(*rows)]
            return pa.RecordBatch.from_arrays([*arrays[:2], arrays[2].cast(pa.int32()), *arrays[3:]], names)

        for batch in batches:
            for part in text_slices(batch, "html"):
                for row in part.to_pylist():
                    if writer is None:
                        name = f"{uuid.uuid4().hex}.warc.zst"
                        # By its ending the file would be compressed a second time.
                        sink = files.open_output_stream(f"{root}/{name}", compression=None)
                        writer = BundleWriter(sink, name)
                    payload = (row["html"] or "").encode()
                    data = record(
                        row["page_id"], row["url"], payload, row["digest"], row["refers_to"], row["revisit"]
                    )
                    writer.add(record_id(row["page_id"]), data)
                    if writer.written >= BUNDLE_BYTES:
                        yield index_of(writer.close())
                        writer = None
        if writer is not None:
            yield index_of(writer.close())

    return materialize(with_revisits(pages).mapInArrow(write, INDEX), "warc_index")


def read_bundles(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the bundles in `index`, as (page_id, record_id, url, payload_bytes,
    payload_digest, record_type, refers_to, payload).

    `payload_bytes` and `payload_digest` are of the full payload for a revisit
    too, whose own payload is null. A response whose payload does not have the
    digest of its header stops the job. Without `payloads` they are checked and
    left out.
    """
    schema = (
        "page_id bigint, record_id string, url string, payload_bytes bigint, payload_digest string,"
        " record_type string, refers_to bigint, payload binary"
    )
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [column.split()[0] for column in schema.split(", ")]

    def row_of(found: Record) -> tuple:
        fields = found.fields
        revisit = fields["warc-type"] == "revisit"
        _, _, digest = fields["warc-payload-digest"].partition(":")
        digest = base64.b32decode(digest).hex()
        if not revisit and hashlib.sha1(found.payload).hexdigest() != digest:
            raise ValueError(f"damaged payload in record {fields['warc-record-id']}")
        return (
            page_of(fields["warc-record-id"]),
            fields["warc-record-id"],
            fields.get("warc-target-uri"),
            int(found.http["content-length"]),
            digest,
            fields["warc-type"],
            page_of(fields.get("warc-refers-to")),
            None if revisit or not payloads else found.payload,
        )

    def read(batches):
        files, root = file_system(folder)
        for batch in batches:
            for bundle in batch.column("bundle").to_pylist():
                with files.open_input_file(f"{root}/{bundle}") as source:
                    reader = BundleReader(source)
                    for number in range(len(reader.frames)):
                        rows = [row_of(found) for _, _, found in parse_records(reader.frame(number))]
                        arrays = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                        yield pa.RecordBatch.from_arrays(arrays, names)

    bundles = index.select("bundle").distinct()
    # Names are small and bundles large: a fixed number of tasks, which are not joined again.
    tasks = min(MOST_READ_TASKS, max(1, bundles.count()))
    return bundles.repartition(tasks, "bundle").mapInArrow(read, schema)


def read_record(index_row, folder: str) -> Record:
    """One record by its row of the index; reads the seek table and one frame."""
    files, root = file_system(folder)
    with files.open_input_file(f"{root}/{index_row['bundle']}") as source:
        return BundleReader(source).record(index_row["frame"], index_row["offset"], index_row["length"])
