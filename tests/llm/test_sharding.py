import random
import zlib

import pytest
from llm_fixtures import texts  # noqa: F401

from termloom.llm import sharding
from termloom.session import scratch_path


@pytest.fixture
def path(spark):
    return scratch_path(spark, "test_maps")


def loads(rows):
    sizes = {}
    for row in rows:
        sizes[row["shard"]] = sizes.get(row["shard"], 0) + row["size"]
    return sizes


def test_bytes_are_even_and_places_gapless(texts, path):
    rows = [(i, "ü" * (i * 37 % 400)) for i in range(3000)] + [(5, None), (5, None), (None, "x" * 3000)]
    found = sharding.shard(texts(rows), path, shards=10, slots=512).collect()
    assert len(found) == len(rows)
    sizes = loads(found)
    assert len(sizes) == 10 and max(sizes.values()) - min(sizes.values()) <= 3016
    for shard in sizes:
        places = sorted(r["place"] for r in found if r["shard"] == shard)
        assert places == list(range(len(places)))
    expected = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((r["size"], r["text_crc32"]) for r in found) == expected


def test_a_map_is_edited_not_made_anew(spark, texts, path):
    rows = [(i, "x" * (i % 100)) for i in range(2000)]
    first = sharding.shard(texts(rows), path, shards=4, slots=256).collect()
    again = sharding.shard(texts(rows + [(9999, "y" * 500)]), path, shards=4, slots=256).collect()
    assert {r["version"] for r in first} == {2} and {r["version"] for r in again} == {3}
    before = {r["doc_id"]: r["shard"] for r in first}
    moved = sum(before[r["doc_id"]] != r["shard"] for r in again if r["doc_id"] in before)
    assert moved < 0.1 * len(rows)
    fewer = sharding.shard(texts(rows), path, shards=3, slots=256).collect()
    assert set(loads(fewer)) == {0, 1, 2}
    assert sharding.read_map(spark, path, 2).count() == 256


def test_no_documents(texts, path):
    assert sharding.shard(texts([]), path).collect() == []


def slow_rebalance(current, sizes, shards):
    """Largest slots first stay while they fit an equal part; the others go where least is."""
    share, loads, placed, moving = sum(sizes.values()) / shards, [0] * shards, {}, []
    held = {}
    for slot in sorted(current, key=lambda s: (-sizes[s], s)):
        at = current[slot]
        held[at] = held.get(at, 0) + sizes[slot]
        if at < shards and held[at] <= share:
            loads[at] += sizes[slot]
            placed[slot] = at
        else:
            moving.append(slot)
    for slot in sorted(moving, key=lambda s: (-sizes[s], -s)):
        least = loads.index(min(loads))
        loads[least] += sizes[slot]
        placed[slot] = least
    return placed


@pytest.mark.parametrize("shards", [1, 3, 5, 8])
def test_a_map_is_edited_as_a_plain_greedy_version_does(spark, shards):
    rng = random.Random(shards)
    sizes = {slot: rng.choice([0, 5, 5, 17, rng.randrange(400), 3000]) for slot in range(97)}
    current = {slot: rng.randrange(5) for slot in sizes}
    slot_map = spark.createDataFrame([(s, h, 7) for s, h in current.items()], sharding.MAP)
    by_slot = spark.createDataFrame([(s, b, 1) for s, b in sizes.items()], "slot int, bytes bigint, rows bigint")
    found = sharding.rebalanced(slot_map, by_slot, shards).collect()
    assert {r["version"] for r in found} == {8} and len(found) == len(sizes)
    assert {r["slot"]: r["shard"] for r in found} == slow_rebalance(current, sizes, shards)


def test_a_whole_table_gets_one_more_shard(spark, path):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    before = {r["doc_id"]: r["shard"] for r in sharding.shard(documents, path, shards=39).collect()}
    after = sharding.shard(documents, path, shards=40).collect()
    sizes = loads(after)
    total = sum(sizes.values())
    assert len(after) == documents.count() and max(sizes.values()) < 1.02 * total / 40
    assert {r["version"] for r in after} == {3}
    # Little more than the new shard's part moves.
    assert sum(r["size"] for r in after if before[r["doc_id"]] != r["shard"]) < 0.06 * total


def test_other_errors_are_not_taken_for_an_empty_store(spark, texts, path):
    spark.createDataFrame([(1, "a")], "slot int, shard string").write.parquet(f"{path}/version=1")
    with pytest.raises(Exception):
        sharding.shard(texts([(1, "a")]), path)
    assert spark.read.parquet(path).count() == 1


def test_a_very_long_text(texts, path):
    found = sharding.shard(texts([(1, "é" * 5_000_000), (2, "")]), path, shards=2).collect()
    assert sorted(r["size"] for r in found) == [16, 10_000_016]
