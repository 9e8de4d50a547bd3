"""Near-duplicates by SimHash, found with a binary trie joined to itself.

A fingerprint has 64 bits. Two fingerprints that differ in at most k bits agree
on one of k + 1 blocks of bits. For each block the fingerprints are rotated so
that it stands on top of a binary trie, and pairs lie below one node of that
block in one of the tries. Those subtries are the unit of distribution. Within
one, pairs of nodes are traversed together: both go down a bit, a pair whose
bits differ adds to its errors, and it is given up once they exceed k.

A subtrie of more than `UNIT_SIZE` fingerprints is traversed as tables first: its
pairs of nodes go down some bits at a time, pairs beyond the error budget are given
up, and those that hold few enough fingerprints become units. So a fingerprint is
sent to the nodes that may hold its partners, not to all, and no task holds more
than a unit, however many near copies one node has.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.batches import text_slices, texts_of
from termloom.llm.components import connected_components
from termloom.session import materialize

# Fixed values.
SEED = 42
BITS = 64
SHINGLE_WORDS = 3
MAX_DISTANCE = 3

#: Most fingerprints of a unit.
UNIT_SIZE = 20_000
#: Bits that large node pairs go down at a time.
STEP = 4
#: Fingerprints that a task traverses at a time, if its units are small.
CHUNK_SIZE = 200_000
#: Node pairs held at once; the traversal goes depth first beyond that.
FRONTIER = 1_000_000
#: Two nodes with at most so many pairs of fingerprints are compared directly.
LEAF_PAIRS = 16


def shingle_hashes(text: str, size: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every word shingle of a text, A-Z lower-cased, as uint64.

    Fewer words than `size` make one shingle; no word makes none.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest, last = xxhash.xxh64_intdigest, max(1, len(words) - size + 1)
    starts, ends, position = [], [], 0
    for word in words:
        starts.append(position)
        position += len(word) + 1
        ends.append(position - 1)
    stops = ends[size - 1 :] or ends[-1:]
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:last], stops)]
    return np.array(hashes, np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as an unsigned number; 0 without hashes.

    Eight bits of a hash at a time stand in the bytes of a number, so sums of up
    to 255 hashes count 64 bits in eight additions.
    """
    if not len(hashes):
        return 0
    spread = (hashes[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(0x0101010101010101)
    sums = np.add.reduceat(spread, np.arange(0, len(hashes), 255), axis=0)
    # By shift and byte; bit number 8 * byte + shift.
    counts = sums.astype("<u8").view(np.uint8).reshape(-1, 8, 8).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts.T.ravel() > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(documents: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_hash, fingerprint) of every row of `documents`, 64 bits as a signed number.

    Whole texts; null and blank texts have fingerprint 0. `text_hash` tells
    rows with the same id, or without one, apart.
    """
    names = ["doc_id", "text_hash", "fingerprint"]

    def hash_texts(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                values = [fingerprint_of(shingle_hashes(t, size)) for t in texts_of(part, "text")]
                column = pa.array(np.array(values, np.uint64).view(np.int64))
                kept = [part.column("doc_id"), part.column("text_hash")]
                yield pa.RecordBatch.from_arrays([*kept, column], names)

    return documents.select(
        F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("text_hash")
    ).mapInArrow(hash_texts, "doc_id bigint, text_hash bigint, fingerprint bigint")


def _descend(
    values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.ndarray
) -> np.ndarray:
    """Where the 1 child of each node begins, for nodes [low, high) of sorted `values`."""
    one = np.uint64(1) << (np.uint64(BITS - 1) - bit.astype(np.uint64))
    # All values of a node agree above the bit, so the child begins at that prefix.
    prefix = (values[low] & ~(one | (one - np.uint64(1)))) | one
    return np.clip(np.searchsorted(values, prefix), low, high)


def trie_self_join(values: np.ndarray, first_bit: int, k: int) -> Iterator[np.ndarray]:
    """Index pairs of sorted distinct `values` that agree on the first bits and differ by <= k."""
    if len(values) < 2:
        return
    top = values >> np.uint64(BITS - first_bit) if first_bit else np.zeros(len(values), np.uint64)
    cuts = np.flatnonzero(np.diff(top)) + 1
    low, high = np.r_[0, cuts], np.r_[cuts, len(values)]
    keep = high - low > 1
    low, high = low[keep].astype(np.int64), high[keep].astype(np.int64)
    zeros = np.zeros(len(low), np.int64)
    yield from _traverse(values, np.stack([low, high, low, high, zeros, zeros + first_bit], axis=1), k)


def trie_cross_join(values: np.ndarray, bits: int, k: int) -> Iterator[np.ndarray]:
    """Index pairs within k bits of sorted distinct `values` between the two nodes they lie below.

    The values have two prefixes of `bits` bits. Pairs below one node are not returned.
    """
    prefixes = values >> np.uint64(BITS - bits)
    cuts = np.flatnonzero(np.diff(prefixes)) + 1
    if not len(cuts):
        return
    middle, errors = int(cuts[0]), int(prefixes[0] ^ prefixes[-1]).bit_count()
    yield from _traverse(values, np.array([[0, middle, middle, len(values), errors, bits]]), k)


def _traverse(values: np.ndarray, start: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Index pairs within k bits below the node pairs of `start`.

    Columns of a node pair: first node, second node, errors so far, next bit.
    Breadth first over node pairs in numpy, depth first over parts of the
    frontier, so memory follows the frontier and not all pairs. Yields the
    pairs in parts.
    """
    stack = [start]
    while stack:
        pairs = stack.pop()
        if len(pairs) > FRONTIER:
            half = len(pairs) // 2
            stack += [pairs[:half], pairs[half:]]
            continue
        size = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        leaf = (size <= LEAF_PAIRS) | (pairs[:, 5] == BITS)
        yield _compare(values, pairs[leaf], k)
        pairs = pairs[~leaf]
        if not len(pairs):
            continue
        a, b, c, d, errors, bit = pairs.T
        m, n = _descend(values, a, b, bit), _descend(values, c, d, bit)
        same = (a == c) & (b == d)
        children = [
            np.stack([a, m, c, n, errors, bit + 1], axis=1),
            np.stack([m, b, n, d, errors, bit + 1], axis=1),
            np.stack([a, m, n, d, errors + 1, bit + 1], axis=1),
            np.stack([m, b, c, n, errors + 1, bit + 1], axis=1)[~same],
        ]
        following = np.concatenate(children)
        alone = (following[:, 0] == following[:, 2]) & (following[:, 1] - following[:, 0] < 2)
        empty = (following[:, 0] >= following[:, 1]) | (following[:, 2] >= following[:, 3])
        following = following[~(alone | empty) & (following[:, 4] <= k)]
        if len(following):
            stack.append(following)


def _compare(values: np.ndarray, pairs: np.ndarray, k: int) -> np.ndarray:
    """Index pairs within k bits of the fingerprints below small node pairs."""
    a, b, c, d = pairs[:, :4].T
    width, count = d - c, (b - a) * (d - c)
    pair = np.repeat(np.arange(len(pairs)), count)
    within = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
    one, other = a[pair] + within // width[pair], c[pair] + within % width[pair]
    near = (one < other) & (np.bitwise_count(values[one] ^ values[other]) <= k)
    return np.stack([one[near], other[near]], axis=1)


def merge_roots(root: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """`root`, the smallest node of each node's component, with `pairs` linked too."""
    root = root.copy()
    while True:
        ends = root[pairs]
        ends = ends[ends[:, 0] != ends[:, 1]]
        if not len(ends):
            return root
        np.minimum.at(root, ends.max(axis=1), ends.min(axis=1))
        while not np.array_equal(root, further := root[root]):
            root = further


def _rotated(fingerprint: Column, by: int) -> Column:
    left = F.shiftleft(fingerprint, by)
    return left.bitwiseOR(F.shiftrightunsigned(fingerprint, BITS - by)) if by else fingerprint


def blocks(k: int) -> list[tuple[int, int]]:
    """(first bit, bits) of k + 1 blocks that cover all bits."""
    cuts = [BITS * i // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _node(level: int) -> Column:
    """The node above a row (width, turned), `level` steps below its subtrie's top."""
    return F.expr(f"shiftrightunsigned(turned, greatest(0, {BITS} - width - {level * STEP}))")


def _node_pairs(held: DataFrame, tops: DataFrame, k: int, unit_size: int) -> list[DataFrame]:
    """Node pairs (block, low, high) that are units, from level 1 on, one table a level.

    `held` (block, width, top, turned) has the rows of the subtries `tops`
    (block, top). The loop ends, since nodes of all bits hold one row each.
    """
    found, unit_size = [], max(2, unit_size)
    grown = tops.select("block", F.col("top").alias("low"), F.col("top").alias("high"))
    while not grown.isEmpty():
        level = len(found) + 1
        ends = F.explode(F.array_distinct(F.array("low", "high"))).alias("above")
        needed = grown.select("block", ends).distinct()
        children = (
            held.select("block", _node(level - 1).alias("above"), _node(level).alias("node"))
            .join(needed, ["block", "above"], "left_semi")
            .groupBy("block", "above", "node")
            .agg(F.count("*").alias("n"))
        )
        children = materialize(children, "trie_nodes")
        one, other = (
            children.select(
                "block", F.col("above").alias(end), F.col("node").alias(f"{end}_node"), F.col("n").alias(f"{end}_n")
            )
            for end in ("low", "high")
        )
        same = F.col("low_node") == F.col("high_node")
        errors = F.bit_count(F.col("low_node").bitwiseXOR(F.col("high_node")))
        size = F.col("low_n") + F.when(same, 0).otherwise(F.col("high_n"))
        pairs = (
            grown.join(one, ["block", "low"])
            .join(other, ["block", "high"])
            # Pairs below one node come in both orders.
            .where((F.col("low") != F.col("high")) | (F.col("low_node") <= F.col("high_node")))
            .where((errors <= k) & (size > 1))
            .select("block", F.col("low_node").alias("low"), F.col("high_node").alias("high"), size.alias("n"))
        )
        pairs = materialize(pairs, "node_pairs")
        found.append(pairs.where(F.col("n") <= unit_size).drop("n"))
        grown = pairs.where(F.col("n") > unit_size).drop("n")
    return found


def _units(distinct: DataFrame, k: int, unit_size: int) -> DataFrame:
    """(block, level, top, low, high, turned): every fingerprint in all units that it belongs to.

    Small subtries are units of level 0, large ones come as node pairs.
    """
    turned = F.array(
        *[
            F.struct(
                F.lit(i).alias("block"),
                F.lit(bits).alias("width"),
                F.shiftrightunsigned(_rotated(F.col("fingerprint"), first), BITS - bits).alias("top"),
                _rotated(F.col("fingerprint"), first).alias("turned"),
            )
            for i, (first, bits) in enumerate(blocks(k))
        ]
    )
    rows = distinct.select(F.inline(turned))
    sizes = rows.groupBy("block", "top").agg(F.count("*").alias("n"))
    large = materialize(sizes.where(F.col("n") > unit_size).drop("n"), "large_subtries")
    columns = ["block", "level", "top", "low", "high", "turned"]
    none = F.lit(0).cast("bigint")
    units = rows.withColumns({"level": F.lit(0), "low": none, "high": none})
    if large.isEmpty():
        return units.select(columns)
    units = units.join(large, ["block", "top"], "left_anti").select(columns)
    held = materialize(rows.join(large, ["block", "top"], "left_semi"), "rows_of_large_subtries")
    for level, pairs in enumerate(_node_pairs(held, large, k, unit_size), start=1):
        ends = F.explode(F.array_distinct(F.array("low", "high"))).alias("node")
        members = held.withColumn("node", _node(level)).join(
            pairs.select("block", "low", "high", ends), ["block", "node"]
        )
        units = units.unionByName(members.withColumn("level", F.lit(level)).select(columns))
    return units


def links_within(distinct: DataFrame, k: int = MAX_DISTANCE, unit_size: int = UNIT_SIZE) -> DataFrame:
    """(node, other) links that connect all fingerprints within k bits of each other.

    `distinct` is a written table (fingerprint) without repeats. A task returns
    links that span what it found connected, one per fingerprint at most, so a
    large group of near copies does not return its pairs.
    """
    table = blocks(k)
    units = (
        _units(distinct, k, unit_size)
        .repartition("block", "level", "top", "low", "high")
        # In the order of unsigned numbers, so that a subtrie's rows stand together.
        .sortWithinPartitions("block", "level", "low", "high", F.shiftrightunsigned("turned", 1))
    )
    firsts = {i: first for i, (first, _) in enumerate(table)}
    widths = {i: bits for i, (_, bits) in enumerate(table)}

    def join_units(kind: tuple[int, int, int, int], values: np.ndarray) -> pa.RecordBatch:
        block, level, low, high = kind
        bits = min(BITS, widths[block] + level * STEP)
        join = trie_self_join if low == high else trie_cross_join
        root = np.arange(len(values))
        for pairs in join(values, bits, k):
            root = merge_roots(root, pairs)
        node = np.flatnonzero(root != np.arange(len(root)))
        ends = []
        for side in (values[node], values[root[node]]):
            by = np.uint64(firsts[block])
            back = (side >> by) | (side << (np.uint64(BITS) - by)) if by else side
            ends.append(pa.array(back.view(np.int64)))
        return pa.RecordBatch.from_arrays(ends, ["node", "other"])

    def join_tries(batches):
        """Units come in order of kind and top bits; several small ones are joined at a time."""
        held, size, kind = [], 0, None
        for batch in batches:
            names = ("block", "level", "low", "high")
            kinds = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in names], axis=1)
            values = batch.column("turned").to_numpy().view(np.uint64)
            changes = np.flatnonzero((np.diff(kinds, axis=0) != 0).any(axis=1)) + 1
            for start, end in pairwise([0, *changes.tolist(), len(values)]):
                following = tuple(kinds[start].tolist()) if end else kind
                if held and following != kind:
                    yield join_units(kind, np.sort(np.concatenate(held)))
                    held, size = [], 0
                kind = following
                held.append(values[start:end])
                size += end - start
                if size >= CHUNK_SIZE:
                    joined = np.sort(np.concatenate(held))
                    top = joined >> np.uint64(BITS - widths[kind[0]])
                    # The last subtrie may go on.
                    cut = int(np.searchsorted(top, top[-1]))
                    if cut:
                        yield join_units(kind, joined[:cut])
                    held, size = [joined[cut:]], len(joined) - cut
        if held:
            yield join_units(kind, np.sort(np.concatenate(held)))

    return units.mapInArrow(join_tries, "node bigint, other bigint")


def near_duplicates(
    documents: DataFrame, size: int = SHINGLE_WORDS, k: int = MAX_DISTANCE
) -> DataFrame:
    """(doc_id, text_hash, fingerprint, component_id) of every row of `documents` (doc_id, text).

    Fingerprints link at `k` or fewer differing bits; a component is named by
    its smallest document, null ids aside (null if it has no other). Equal
    fingerprints are taken together before anything is joined, so exact copies
    cost one row. Repeated rows get a row each; an empty table gives none.
    """
    marked = materialize(fingerprints(documents, size), "fingerprints")
    distinct = materialize(
        marked.groupBy("fingerprint").agg(F.min("doc_id").alias("smallest")), "distinct_fingerprints"
    )
    links = links_within(distinct.select("fingerprint"), k)
    components = connected_components(links).withColumnRenamed("node", "fingerprint")
    head = F.coalesce("component", "fingerprint")
    named = distinct.join(components, "fingerprint", "left").withColumn("head", head)
    smallest = named.groupBy("head").agg(F.min("smallest").alias("component_id"))
    of_fingerprint = named.select("fingerprint", "head").join(smallest, "head")
    of_fingerprint = materialize(of_fingerprint.drop("head"), "fingerprint_components")
    return marked.join(of_fingerprint, "fingerprint").select(
        "doc_id", "text_hash", "fingerprint", "component_id"
    )


def keep_one_of_each(
    documents: DataFrame, size: int = SHINGLE_WORDS, k: int = MAX_DISTANCE
) -> DataFrame:
    """The rows of `documents` that stand for their near-duplicates, with all their columns.

    Of a component the document with the smallest id stays. If several rows hold
    that id, the greatest by all columns stays. Where no row of a component has
    an id, its different rows stay.
    """
    found = near_duplicates(documents, size, k)
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    stays = found.where(first).groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"))
    stays = materialize(stays, "representatives")
    same = documents["doc_id"].eqNullSafe(stays["doc_id"]) & (
        F.xxhash64(documents["text"]) == stays["text_hash"]
    )
    kept = documents.join(stays, same, "left_semi")
    # Told by the ids of the representatives, so the texts are joined only once.
    repeated = stays.groupBy("doc_id").agg(F.sum("rows").alias("rows")).where("rows > 1")
    if not repeated.isEmpty():
        columns = kept.columns
        row = F.when(F.col("doc_id").isNull(), F.xxhash64(*columns)).alias("row_hash")
        last = kept.groupBy("doc_id", row).agg(F.max(F.struct(*columns)).alias("last"))
        kept = last.select("last.*")
    return kept
