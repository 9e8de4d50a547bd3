"""Token ids of a corpus as files of wavelet matrices, one per shard.

Documents are ordered by doc_id over all shards. A shard holds whole documents: the
bit planes of their ids (`wavelet.py`), a table of the documents with their places,
and a footer. From one file a reader gets the ids at any place, how often an id occurs
and where, without reading the rest.

Rows are dealt by ranges of (doc_id, text hash, row number), so neither a frequent
doc_id nor a text in many copies gathers in one task, and a text is encoded where its
shard is written: no table of ids stands between. Tasks write files under names of
their own attempt and return index rows; what a lost or repeated task wrote is not in
the index and is not read.

A null doc_id comes first. A null text is the empty one. Rows that share a doc_id are
ordered by a hash of their texts and stay documents of their own. An empty table
writes no shard. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm import wavelet
from termloom.llm.batches import text_slices, texts_of
from termloom.llm.byte_bpe import Vocabulary
from termloom.llm.warc import MOST_READ_TASKS, file_system
from termloom.session import materialize

END_ID = 2
#: A shard closes with the document that brings it to so many ids. A longer document is a shard.
SHARD_TOKENS = 1 << 22

INDEX = "part int, number int, shard string, n_documents bigint, n_tokens bigint"
DOCUMENTS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


class ShardWriter:
    """Gathers whole documents and writes them as one file."""

    def __init__(self):
        self.doc_ids: list[int | None] = []
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.ids.append(ids)
        self.size += len(ids)

    def write(self, sink) -> None:
        lengths = np.array([len(ids) for ids in self.ids], "<u8")
        directory = wavelet.write_planes(np.concatenate(self.ids), sink.write)
        known = np.array([doc_id is not None for doc_id in self.doc_ids], np.uint8)
        doc_ids = np.array([doc_id or 0 for doc_id in self.doc_ids], "<i8")
        table = known.tobytes() + doc_ids.tobytes() + lengths.tobytes()
        tail = struct.pack("<QQ", len(lengths), len(directory)) + directory + table
        tail = zstandard.ZstdCompressor().compress(tail)
        place = sink.tell()
        sink.write(tail)
        sink.write(struct.pack(wavelet.FOOTER, place, len(tail), wavelet.MAGIC))


class Shard:
    """A written shard. `source` is an open file that has `size` and `read_at`."""

    def __init__(self, source):
        length = struct.calcsize(wavelet.FOOTER)
        place, size, magic = struct.unpack(
            wavelet.FOOTER, source.read_at(length, source.size() - length)
        )
        if magic != wavelet.MAGIC:
            raise ValueError("not a shard of token ids")
        tail = zstandard.ZstdDecompressor().decompress(source.read_at(size, place))
        n, directory = struct.unpack_from("<QQ", tail)
        self.planes = wavelet.Planes(tail[16 : 16 + directory], source.read_at)
        table = tail[16 + directory :]
        known = np.frombuffer(table, np.uint8, n)
        doc_ids = np.frombuffer(table, "<i8", n, n)
        self.doc_ids = [int(d) if k else None for d, k in zip(doc_ids.tolist(), known.tolist())]
        self.lengths = np.frombuffer(table, "<u8", n, 9 * n).astype(np.int64)
        self.starts = self.lengths.cumsum() - self.lengths

    def ids(self, row: int) -> np.ndarray:
        """The ids of one document, by its row in the shard."""
        start = self.starts[row]
        return self.planes.access(np.arange(start, start + self.lengths[row]))


def write_shards(
    documents: DataFrame,
    folder: str,
    vocabulary: Vocabulary,
    end_id: int | None = END_ID,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Encode all `documents` (doc_id, text) and write them as shards in `folder`.

    Returns the index of the shards. `end_id` is added to every document. The folder
    must be one that all executors share.
    """
    names = [column.split()[0] for column in INDEX.split(", ")]

    def shards(batches) -> Iterator[ShardWriter]:
        encoder, writer = vocabulary.encoder(), ShardWriter()
        end = np.array([] if end_id is None else [end_id], "<u4")
        for batch in batches:
            for part in text_slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts_of(part, "text")):
                    ids = np.concatenate([encoder.encode(text), end])
                    if writer.size and writer.size + len(ids) > shard_tokens:
                        yield writer
                        writer = ShardWriter()
                    writer.add(doc_id, ids)
        if writer.doc_ids:
            yield writer

    def write(batches):
        from pyspark import TaskContext

        files, root = file_system(folder)
        files.create_dir(root)
        part = TaskContext.get().partitionId()
        for number, writer in enumerate(shards(batches)):
            name = f"{uuid.uuid4().hex}.wvm"
            with files.open_output_stream(f"{root}/{name}", compression=None) as sink:
                writer.write(sink)
            row = [part, number, name, len(writer.doc_ids), writer.size]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            arrays = [pa.array([value], kind) for value, kind in zip(row, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    order = ["doc_id", "text_hash", "row"]
    ordered = (
        documents.select(F.col("doc_id").cast("bigint"), "text")
        .withColumns({"text_hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    return materialize(ordered.mapInArrow(write, INDEX), "token_shards")


def with_starts(index: DataFrame) -> DataFrame:
    """`index` with `start`, the ids of all shards before each.

    Parts are the tasks that wrote; their totals are few and meet in one window,
    shards are summed within their part.
    """
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = totals.select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start")
    )
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number"))
    return (
        index.withColumn("inside", inside - F.col("n_tokens"))
        .join(parts, "part")
        .withColumn("start", F.col("part_start") + F.col("inside"))
        .drop("part_start", "inside")
    )


def _read(index: DataFrame, folder: str, schema: str, rows_of) -> DataFrame:
    """What `rows_of(shard, start)` yields of every shard, as record batches of `schema`."""

    def read(batches):
        files, root = file_system(folder)
        for batch in batches:
            for name, start in zip(*(batch.column(c).to_pylist() for c in ("shard", "start"))):
                with files.open_input_file(f"{root}/{name}") as source:
                    yield from rows_of(Shard(source), start)

    # Names are small and shards large: a fixed number of tasks, which are not joined again.
    tasks = min(MOST_READ_TASKS, max(1, index.count()))
    shards = with_starts(index).select("shard", "start").repartition(tasks, "shard")
    return shards.mapInArrow(read, schema)


def read_documents(index: DataFrame, folder: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the shards.

    `start` counts the ids of all documents before it; the checksum is over the ids as
    little-endian unsigned 32-bit numbers. `keep_ids` adds them as `ids`, in that form.
    """
    schema = DOCUMENTS + (", ids binary" if keep_ids else "")
    names = [column.split()[0] for column in schema.split(", ")]

    def rows_of(shard: Shard, start: int):
        data = memoryview(shard.planes.decode().astype("<u4").tobytes())
        cuts = zip((4 * shard.starts).tolist(), (4 * (shard.starts + shard.lengths)).tolist())
        parts = [data[low:high] for low, high in cuts]
        arrays = [
            pa.array(shard.doc_ids, pa.int64()),
            pa.array(start + shard.starts),
            pa.array(shard.lengths),
            pa.array([zlib.crc32(part) for part in parts], pa.int64()),
        ]
        if keep_ids:
            arrays.append(pa.array([part.tobytes() for part in parts], pa.binary()))
        yield pa.RecordBatch.from_arrays(arrays, names)

    return _read(index, folder, schema, rows_of)


def count_ids(index: DataFrame, folder: str, *numbers: int) -> DataFrame:
    """(id, n): how often each of `numbers` occurs in the corpus, by rank alone."""

    def rows_of(shard: Shard, start: int):
        counts = [shard.planes.count(number) for number in numbers]
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(counts)], ["id", "n"])

    found = _read(index, folder, "id bigint, n bigint", rows_of)
    return found.groupBy("id").agg(F.sum("n").alias("n"))


def find_id(index: DataFrame, folder: str, number: int) -> DataFrame:
    """(doc_id, position, place) of every occurrence of an id, by select alone.

    `position` counts from the document's own first id, `place` from the corpus'.
    """

    def rows_of(shard: Shard, start: int):
        at = shard.planes.occurrences(number)
        rows = np.searchsorted(shard.starts, at, side="right") - 1
        doc_ids = pa.array(shard.doc_ids, pa.int64()).take(pa.array(rows))
        columns = [doc_ids, pa.array(at - shard.starts[rows]), pa.array(at + start)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "position", "place"])

    return _read(index, folder, "doc_id bigint, position bigint, place bigint", rows_of)
