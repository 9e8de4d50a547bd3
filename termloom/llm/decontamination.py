"""Documents that hold an item of a benchmark, by SimHash of item-sized windows.

A window of a document has as many word shingles as the item it may hold. Only
windows that share a shingle with an item of their size can be similar to one,
so only those are looked at: where a shingle of the document is one of an item,
the window lies as it would if both stood in the same place. The places are found
first, then cut out of the few documents that have any. Windows and items
then get fingerprints. Two fingerprints within the radius differ in at most one
bit in one of a few blocks of bits, so an index of the items' blocks, with one
bit changed at a time, finds all items within the radius. Their exact similarity,
shared shingles over all shingles, each by its number, decides.

Everything is built-in functions. Documents are hashed once for each number of
words in a shingle, whatever the size of the benchmark.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.quality import let, window_hashes, words_of
from termloom.operators.reducing import key_bitmap, may_hold
from termloom.session import materialize

SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
#: Similar windows of 0.8 differ in 10 of 64 bits on average, with deviation 3.
RADIUS = 18
#: The screen for the benchmark's shingles has so many numbers of 64 bits. Up to 100,000
#: shingles let a tenth of others pass; more let more pass, which the join removes.
SCREEN_SLOTS = 1 << 14
#: Hashes of a text's windows that are cut out together.
STRETCH = 1 << 21
#: A window is compared with so many starts before it, as far back as LOOK_BACK hashes.
#: Larger numbers find more repetition early; equal windows are made one in any case.
LOOK_BACK_STARTS = 8
LOOK_BACK = 64

BITS = 64


def fingerprint(hashes: Column) -> Column:
    """SimHash of an array of 64-bit hashes: a bit is set if set in over half of them."""
    bit_of = lambda value, bit: F.call_function("shiftright", value, bit).bitwiseAND(F.lit(1))

    def bit(position: Column) -> Column:
        set_in = F.aggregate(
            hashes, F.lit(0).cast("bigint"), lambda n, value: n + bit_of(value, position)
        )
        one = F.when(2 * set_in > F.size(hashes), F.lit(1).cast("bigint")).otherwise(0)
        return F.call_function("shiftleft", one, position)

    positions = F.sequence(F.lit(0), F.lit(BITS - 1))
    return F.aggregate(
        F.transform(positions, bit), F.lit(0).cast("bigint"), lambda all_, one: all_.bitwiseOR(one)
    )


def bit_blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of as few blocks as leave one with at most one error.

    `radius` errors over more than radius / 2 blocks leave one with one at most.
    """
    n = radius // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(low, high - low) for low, high in zip(cuts, cuts[1:])]


def _block_value(value: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << bits) - 1))


def _block_keys(value: Column, radius: int, changed: bool) -> Column:
    """An array of (block, key): the blocks' bits, and with one bit changed if `changed`."""
    keys = []
    for number, (first, bits) in enumerate(bit_blocks(radius)):
        for flip in [0] + [1 << bit for bit in range(bits)] * changed:
            key = _block_value(value, first, bits).bitwiseXOR(F.lit(flip))
            keys.append(F.struct(F.lit(number).alias("block"), key.alias("key")))
    return F.array(*keys)


def multiset_similarity(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays, repeated elements by their number."""
    times = lambda array, x: F.size(F.filter(array, lambda y: y == x))
    single = lambda array: F.size(F.array_distinct(array)) == F.size(array)
    in_both = F.array_intersect(a, b)
    shared = F.when(single(a) & single(b), F.size(in_both)).otherwise(
        F.aggregate(in_both, F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    )
    return let(shared, lambda n: n / (F.size(a) + F.size(b) - n))


def _items(benchmark: DataFrame, shingle_words: int) -> DataFrame:
    """(item_id, k, words) of the items that have a word; k words make a shingle."""
    words = benchmark.select("item_id", words_of(F.lower("text")).alias("words"))
    return words.where(F.size("words") > 0).select(
        "item_id", F.least(F.size("words"), F.lit(shingle_words)).alias("k"), "words"
    )


def _screen(positions: DataFrame) -> Callable[[Column], Column]:
    """A test that every hash of `positions` passes, and others by chance.

    It looks into a bitmap that is part of the plan, as one constant of
    SCREEN_SLOTS numbers, however many hashes there are.
    """
    slot_of = lambda h: F.pmod(h, F.lit(SCREEN_SLOTS)).cast("int")
    bit_of = lambda h: F.shiftrightunsigned(h, 58).cast("int")
    held = positions.select(slot_of(F.col("hash")).alias("slot"), bit_of(F.col("hash")).alias("bit"))
    bits = [0] * SCREEN_SLOTS
    # At most SCREEN_SLOTS rows.
    for row in held.groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).collect():
        bits[row["slot"]] = row["bits"]
    # Spark folds this to an array; numbers one by one would make a plan of as many nodes.
    bitmap = F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")
    return lambda h: F.getbit(F.get(bitmap, slot_of(h)), bit_of(h)) == 1


def _starts(
    documents: DataFrame, positions: DataFrame, may_be: Callable[[Column], Column], k: int
) -> DataFrame:
    """(doc_id, text_hash, size, start) of the windows that lie as items do around a shared shingle.

    `positions` (hash, before, size, position) are those of items, `before` the
    hash before. A hit carries its place alone. Where the hashes before agree
    as well, they lie in the same place of the item, so only the first hit of
    such a stretch counts.
    """

    def hits(hashes: Column) -> Column:
        # For no hashes this is the place 0, which has no hash and is no hit.
        places = F.sequence(F.lit(0), F.greatest(F.size(hashes) - 1, F.lit(0)))
        hit = lambda at: F.struct(
            F.get(hashes, at).alias("hash"),
            F.get(hashes, at - 1).alias("before_hit"),
            at.alias("at"),
            F.size(hashes).alias("n"),
        )
        return F.transform(F.filter(places, lambda at: may_be(F.get(hashes, at))), hit)

    hashed = window_hashes(words_of(F.lower("text")), k)
    # Named before, or every hit would carry its text to be hashed again.
    own = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = own.select("doc_id", "text_hash", F.inline(let(hashed, hits)))
    first = ~F.coalesce(F.col("before_hit") == F.col("before"), F.lit(False))
    placed = found.join(positions, "hash").where(first)
    start = F.greatest(F.lit(0), F.least(F.col("at") - F.col("position"), F.col("n") - F.col("size")))
    return placed.select("doc_id", "text_hash", "size", start.alias("start")).distinct()


def _windows(
    documents: DataFrame,
    starts: DataFrame,
    may_be: Callable[[Column], Column],
    k: int,
    min_similarity: float,
) -> DataFrame:
    """(doc_id, text_hash, size, hashes, start) of windows that may be similar to an item.

    Windows at `starts` are cut out of their documents, which are few. To reach
    `min_similarity` so many of a window's shingles must be an item's, so
    others are dropped by number. Equal windows of a document are one, the first;
    those of texts that repeat themselves are mostly dropped before they are cut.
    """
    names = ["doc_id", "text_hash"]
    # A row has the starts of one stretch of a text, in order.
    listed = starts.groupBy(*names, "size", F.floor(F.col("start") * F.col("size") / STRETCH)).agg(
        F.array_sort(F.collect_list(F.struct("size", "start"))).alias("places")
    )
    listed = materialize(listed.select(*names, "places"), "window_starts")
    own = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    near = may_hold(own, key_bitmap(listed, *names), *names).alias("d")
    same = [F.col(f"d.{name}").eqNullSafe(F.col(f"s.{name}")) for name in names]
    # Rows that share id and text are one document.
    held = near.join(listed.alias("s"), same).select("d.doc_id", "d.text_hash", "text", "places")

    def repeats(hashes: Column, place: Column, earlier: Column) -> Column:
        """Whether the window at `place` holds the same shingles as the one `earlier`.

        It does if those it leaves out are those that it takes in.
        """
        start, back = place["start"], place["start"] - earlier["start"]
        stretch = lambda first: F.array_sort(
            F.transform(F.sequence(F.lit(1), back), lambda j: F.get(hashes, first + j))
        )
        left, taken = earlier["start"] - 1, earlier["start"] + place["size"] - 1
        return (
            (back <= F.least(place["size"], F.lit(LOOK_BACK)))
            & (F.get(hashes, earlier["start"]) == F.get(hashes, start))
            & (stretch(left) == stretch(taken))
        )

    def firsts(hashes: Column) -> Column:
        def is_new(place: Column, i: Column) -> Column:
            before = F.sequence(F.lit(1), F.least(i, F.lit(LOOK_BACK_STARTS)))
            same = lambda q: let(
                F.get("places", i - q), lambda earlier: repeats(hashes, place, earlier)
            )
            return (i == 0) | ~F.exists(before, same)

        return F.filter("places", is_new)

    def cut(hashes: Column) -> Column:
        # Single elements: a slice would copy the whole array for every window.
        part = lambda place: F.sequence(
            place["start"], F.least(place["start"] + place["size"], F.size(hashes)) - 1
        )
        return F.transform(
            firsts(hashes),
            lambda place: F.struct(
                place["size"].alias("size"),
                place["start"].alias("start"),
                F.transform(part(place), lambda at: F.get(hashes, at)).alias("hashes"),
            ),
        )

    def enough(window: Column) -> Column:
        shared = F.size(F.filter(window["hashes"], may_be))
        both = window["size"] + F.size(window["hashes"])
        # A little less than the bound, which is not exact in doubles.
        return shared >= both * (min_similarity / (1 + min_similarity)) - 1e-6

    hashed = window_hashes(words_of(F.lower("text")), k)
    windows = let(hashed, lambda hashes: F.filter(cut(hashes), enough))
    return (
        held.select(*names, F.inline(windows))
        .groupBy(*names, "size", "hashes")
        .agg(F.min("start").alias("start"))
    )


def _leaks_of_size(
    documents: DataFrame, items: DataFrame, k: int, radius: int, min_similarity: float
) -> DataFrame:
    """Leaks of a written table of `items` (item_id, hashes), k words to a shingle."""
    placed = items.select(
        "hashes", F.size("hashes").alias("size"), F.posexplode("hashes").alias("position", "hash")
    )
    before = F.get("hashes", F.col("position") - 1).alias("before")
    placed = placed.select("hash", before, "size", "position").distinct()
    placed = materialize(placed, "item_shingles")
    may_be = _screen(placed)
    starts = _starts(documents, placed, may_be, k)
    windows = _windows(documents, starts, may_be, k, min_similarity)
    marked = windows.withColumn("fingerprint", fingerprint(F.col("hashes")))
    index = items.select(
        "item_id",
        F.size("hashes").alias("size"),
        F.col("hashes").alias("item_hashes"),
        F.col("fingerprint").alias("item_fingerprint"),
        F.inline(_block_keys(F.col("fingerprint"), radius, changed=True)),
    )
    keyed = marked.select("*", F.inline(_block_keys(F.col("fingerprint"), radius, changed=False)))
    candidates = keyed.join(index, ["size", "block", "key"])
    differing = F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))
    agrees = [
        F.bit_count(_block_value(differing, first, bits)) <= 1 for first, bits in bit_blocks(radius)
    ]
    # A pair is verified for the first block that agrees, not for each.
    near = candidates.where(
        (F.bit_count(differing) <= radius)
        & (F.array_position(F.array(*agrees), True) == F.col("block") + 1)
    )
    similarity = multiset_similarity(F.col("hashes"), F.col("item_hashes"))
    return near.select(
        "doc_id", "text_hash", "item_id", "start", similarity.alias("similarity")
    ).where(F.col("similarity") >= min_similarity)


def find_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    min_similarity: float = MIN_SIMILARITY,
    radius: int = RADIUS,
) -> DataFrame:
    """(doc_id, text_hash, item_id, similarity, first_word) of documents that hold an item.

    For each document and item the most similar window, the first of equal
    ones. `documents` has (doc_id, text), `benchmark` (item_id, text); whole
    texts. An item of fewer words than a shingle is one shingle. Null and empty
    texts hold nothing and items without a word are in no text; repeated rows
    count once; items without an id are found under a null one.
    """
    spark = documents.sparkSession
    items = materialize(_items(benchmark, shingle_words), "benchmark_items")
    # As many rows as a shingle has words, at most.
    sizes = items.select("k").distinct().orderBy("k").collect()
    found = []
    for row in sizes:
        k = row["k"]
        hashes = window_hashes(F.col("words"), k)
        of_size = items.where(F.col("k") == k).select("item_id", hashes.alias("hashes"))
        hashed = of_size.withColumn("fingerprint", fingerprint(F.col("hashes")))
        hashed = materialize(hashed, "item_fingerprints")
        found.append(_leaks_of_size(documents, hashed, k, radius, min_similarity))
    if not found:
        return spark.createDataFrame(
            [], "doc_id bigint, text_hash bigint, item_id bigint, similarity double, first_word int"
        )
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back")))
    return (
        reduce(DataFrame.unionByName, found)
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(best.alias("best"))
        .select(
            "doc_id",
            "text_hash",
            "item_id",
            F.col("best.similarity").alias("similarity"),
            (-F.col("best.back")).alias("first_word"),
        )
    )


def remove_leaks(documents: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of `documents` that hold no item, with all their columns.

    Rows are matched by id and text, so ids may repeat or be missing.
    """
    found = find_leaks(documents, benchmark, **settings)
    leaks = materialize(found.select("doc_id", "text_hash").distinct(), "leaking_documents")
    same = documents["doc_id"].eqNullSafe(leaks["doc_id"]) & (
        F.xxhash64(documents["text"]) == leaks["text_hash"]
    )
    return documents.join(leaks, same, "left_anti")
