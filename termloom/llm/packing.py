"""Best-fit decreasing packing of documents into token sequences of one length.

Lengths are whole numbers up to the capacity, so documents of one length are
interchangeable and the packing is decided on the count of each length: at most
`capacity` numbers, whatever the size of the corpus. Lengths are placed in
descending order, each into the tightest open sequences, which a segment tree
over the remaining capacities finds in logarithmic time. The decision is the one
best-fit decreasing takes on the whole corpus. Documents then look up their
place by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.batches import text_slices, texts_of
from termloom.llm.byte_bpe import Vocabulary
from termloom.session import materialize

CAPACITY = 1024
END_ID = 2
#: Parts that the documents of one length are ranked in. Bounds the table of counts.
RANK_PARTS = 256

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def cuts(n_tokens: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be short."""
    first = n_tokens % capacity or min(n_tokens, capacity)
    yield 0, first
    for start in range(first, n_tokens, capacity):
        yield start, capacity


def pieces(
    documents: DataFrame,
    vocabulary: Vocabulary,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """Token pieces of every row of `documents` (doc_id, text), whole texts.

    Each text ends with `end_id`; a null text is the empty one. Repeated rows
    stay repeated. `keep_ids` adds the ids as `ids` (little-endian uint32).
    """
    schema = PIECES + (", ids binary" if keep_ids else "")
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = [column.split()[0] for column in schema.split(", ")]

    def tokenize(batches):
        encoder, end = vocabulary.encoder(), np.array([end_id], "<u4")
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows = []
                ids_of_documents = part.column("doc_id").to_pylist()
                for doc_id, text in zip(ids_of_documents, texts_of(part, "text")):
                    ids = np.concatenate([encoder.encode(text), end])
                    for number, (start, length) in enumerate(cuts(len(ids), capacity)):
                        data = ids[start : start + length].tobytes()
                        rows.append((doc_id, number, start, length, zlib.crc32(data), data))
                columns = list(zip(*rows))[: len(names)]
                arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tokenize, schema)


class OpenSequences:
    """Open sequences by remaining capacity, under a segment tree of their counts."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _count(self, remaining: int, change: int) -> None:
        node = self.leaves + remaining
        while node:
            self.tree[node] += change
            node //= 2

    def add(self, remaining: int, first: int, count: int) -> None:
        """Open `count` sequences from number `first`; full ones are forgotten."""
        if remaining and count:
            self.ranges[remaining].append((first, count))
            self._count(remaining, 1)

    def take(self, remaining: int) -> tuple[int, int]:
        self._count(remaining, -1)
        return self.ranges[remaining].pop()

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of an open sequence that is at least `length`."""
        node = self.leaves + length
        if not self.tree[node]:
            # Up to the first right sibling that holds something, then down to its left end.
            while node > 1 and (node % 2 or not self.tree[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_decreasing(counts: Mapping[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Runs (length, first rank, items, items per sequence, first sequence, offset).

    A run puts `items` consecutively ranked pieces of one length into
    consecutive sequences, so many into each from `offset` on. A run either
    uses up a range of sequences or ends its length: there are a few runs per
    length, however many pieces.
    """
    opened, runs, following = OpenSequences(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = opened.tightest(length)
            if remaining is None:
                remaining = capacity
                needed = -(-left // (capacity // length))
                first, available = following, needed
                following += needed
            else:
                first, available = opened.take(remaining)
            each = remaining // length
            items = min(left, available * each)
            full, rest = divmod(items, each)
            runs.append((length, rank, items, each, first, capacity - remaining))
            opened.add(remaining - each * length, first, full)
            if rest:
                opened.add(remaining - rest * length, first + full, 1)
            used = full + bool(rest)
            opened.add(remaining, first + used, available - used)
            rank, left = rank + items, left - items
    return runs


def pack(pieces_table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces_table` with (sequence_id, offset) of every piece.

    Pass a written table: it is read for the counts and again for the places.
    Every row gets a place of its own, repeated rows too; rows of equal length
    are ranked by (doc_id, piece), null first. Full pieces are sequences by
    themselves and need no rank: theirs have negative numbers. Offsets in a sequence are gapless
    from 0. An empty table has an empty result.
    """
    full = pieces_table.where(F.col("length") == capacity).withColumns(
        {
            "sequence_id": -1 - F.monotonically_increasing_id(),
            "offset": F.lit(0).cast("bigint"),
        }
    )
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANK_PARTS)).cast("int")
    parted = pieces_table.where(F.col("length") < capacity).withColumn("rank_part", part)
    counts = parted.groupBy("length", "rank_part").agg(F.count("*").alias("n"))
    upward = Window.partitionBy("length").orderBy("rank_part")
    before = counts.withColumn("before", F.sum("n").over(upward) - F.col("n"))
    before = materialize(before, "length_counts")
    # Less than `capacity` rows.
    totals = before.groupBy("length").agg(F.sum("n").alias("n")).collect()
    runs = best_fit_decreasing({row["length"]: row["n"] for row in totals}, capacity)
    ordered = np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)

    ranking = Window.partitionBy("length", "rank_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        parted.withColumn("place", F.row_number().over(ranking) - 1)
        # At most capacity * RANK_PARTS rows of four numbers.
        .join(F.broadcast(before.drop("n")), ["length", "rank_part"])
        .withColumn("place", F.col("place") + F.col("before"))
        .select(*pieces_table.columns, "place")
    )
    names = [*pieces_table.columns, "sequence_id", "offset"]

    def place(batches):
        # Runs are sorted by (length, rank); both fit one number to search for.
        width = int((ordered[:, 1] + ordered[:, 2]).max(initial=1)) + 1
        keys = ordered[:, 0] * width + ordered[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("place").to_numpy()
            run = ordered[np.searchsorted(keys, length * width + rank, side="right") - 1]
            sequence, position = np.divmod(rank - run[:, 1], run[:, 3])
            found = [pa.array(run[:, 4] + sequence), pa.array(run[:, 5] + position * length)]
            kept = [batch.column(name) for name in names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, *found], names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces_table.schema)
    placed = ranked.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")
    return placed.unionByName(full)


def pack_documents(
    documents: DataFrame,
    vocabulary: Vocabulary,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of all `documents` with their places in sequences of `capacity` tokens."""
    cut = pieces(documents, vocabulary, capacity, end_id, keep_ids)
    return pack(materialize(cut, "token_pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences themselves.

    `packed` comes from `pack_documents(keep_ids=True)`. A sequence holds at
    most `capacity` tokens, so no group is large.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.aggregate(parts, F.lit(b""), lambda ids, part: F.concat(ids, part["ids"])).alias("ids"),
    )
