"""Sharding by fixed virtual slots and a versioned map of slots to shards.

A record is hashed to one of a few thousand slots, and always to the same one.
Only the map from slots to shards changes: a new version of it is made by
editing the one before, moving the few slots whose bytes put shards out of
balance. The map and the bytes by slot have one row per slot, whatever the size
of the corpus.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.session import materialize

SLOTS = 4096
SHARDS = 40
#: Bytes of a record beside its text.
RECORD_BYTES = 16

MAP = "slot int, shard int, version int"


def slot_of(*columns: str, slots: int = SLOTS) -> Column:
    """The slot of a record, by a hash of the columns that make it out."""
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, bytes, rows) of every slot, empty ones too, from (slot, size)."""
    held = records.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(held, "slot", "left").select(
        "slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows")
    )


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt to shards in turn."""
    slot = F.col("id").cast("int")
    return spark.range(slots).select(
        slot.alias("slot"), (slot % shards).alias("shard"), F.lit(1).alias("version")
    )


def rebalanced(slot_map: DataFrame, by_slot: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, edited until the bytes of shards are nearly equal.

    A shard keeps its slots, largest first, as long as they fit an equal part of
    all bytes; slots of shards that are no more keep nothing. The others go,
    largest first, to the shard that then holds least. Both steps see one row
    per slot.
    """
    sized = slot_map.join(by_slot, "slot").select("slot", "shard", "bytes", "version")
    share = sized.agg(F.sum("bytes") / shards).scalar()
    largest_first = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot")
    kept = (F.sum("bytes").over(largest_first) <= share) & (F.col("shard") < shards)
    marked = sized.withColumn("kept", kept).withColumn("share", share)

    loads = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda shard: F.aggregate(
            F.filter("slots", lambda s: s["kept"] & (s["shard"] == shard)),
            F.lit(0).cast("bigint"),
            lambda total, s: total + s["bytes"],
        ),
    )
    moving = F.filter("slots", lambda s: ~s["kept"])

    def place(state: Column, slot: Column) -> Column:
        least = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        grown = F.transform(
            state["loads"], lambda load, i: F.when(i == least, load + slot["bytes"]).otherwise(load)
        )
        placed = F.array_append(
            state["placed"], F.struct(slot["slot"].alias("slot"), least.alias("shard"))
        )
        return F.struct(grown.alias("loads"), placed.alias("placed"))

    nothing = F.array().cast("array<struct<slot:int,shard:int>>")
    state = F.aggregate(
        moving, F.struct(F.col("loads").alias("loads"), nothing.alias("placed")), place
    )
    ordered = F.sort_array(
        F.collect_list(F.struct("bytes", "slot", "shard", "kept", "version")), asc=False
    )
    # One row that holds one entry per slot.
    gathered = marked.agg(ordered.alias("slots"))
    moved = (
        gathered.select("slots", loads.alias("loads"))
        .select("slots", state.alias("state"))
        .select(
            F.concat(
                F.transform(
                    F.filter("slots", lambda s: s["kept"]),
                    lambda s: F.struct(s["slot"].alias("slot"), s["shard"].alias("shard")),
                ),
                F.col("state.placed"),
            ).alias("edited"),
            (F.array_max(F.transform("slots", lambda s: s["version"])) + 1).alias("version"),
        )
    )
    return moved.select(F.inline("edited"), "version")


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored maps; a version written again replaces itself."""
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.drop("version").write.mode("overwrite").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the newest unless given."""
    maps = spark.read.schema(MAP).parquet(path)
    wanted = F.lit(version) if version is not None else maps.agg(F.max("version")).scalar()
    return maps.where(F.col("version") == wanted)


def sized_records(documents: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, slot) of every row of `documents` (doc_id, text).

    The slot follows id and text, so ids that repeat spread over slots. A null
    text has no bytes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + RECORD_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        slot_of("doc_id", "text", slots=slots).alias("slot"),
    )


def shard(
    documents: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS
) -> DataFrame:
    """(doc_id, size, text_crc32, slot, shard, place, version) of every row of `documents`.

    Uses the newest map stored at `path`, or a first one, edits it by the bytes
    found and stores the next version; one job at a time may do so. `place`
    numbers the records of a shard from 0 without gaps: slots in order, records
    of a slot by id. Equal rows get a place each; an empty table stores a map
    and returns no row.
    """
    spark = documents.sparkSession
    records = materialize(sized_records(documents, slots), "sized_records")
    by_slot = materialize(slot_bytes(records, slots), "slot_bytes")
    try:
        current = read_map(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # Nothing stored yet.
        store_map(first_map(spark, shards, slots), path)
        current = read_map(spark, path)
    store_map(rebalanced(current, by_slot, shards), path)
    slot_map = read_map(spark, path)
    before = Window.partitionBy("shard").orderBy("slot")
    placed = slot_map.join(by_slot, "slot").select(
        "slot", "shard", "version", (F.sum("rows").over(before) - F.col("rows")).alias("before")
    )
    within = Window.partitionBy("slot").orderBy("doc_id", "text_crc32", "size")
    # One row per slot.
    return (
        records.withColumn("in_slot", F.row_number().over(within) - 1)
        .join(F.broadcast(placed), "slot")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "slot",
            "shard",
            (F.col("before") + F.col("in_slot")).alias("place"),
            "version",
        )
    )
