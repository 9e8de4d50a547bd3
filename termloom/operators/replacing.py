"""Replacement of documents by name, and the catalogue of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import without_extension
from termloom.operators.reducing import key_bitmap, may_hold
from termloom.session import materialize

# Endings of result names.
RAW_ENDING = ".png"
NORMALIZED_ENDING = "-normalized.png"

# Broadcast bound for id pairs: two numbers and their hash slots per row.
BROADCAST_PAIRS = 1_000_000


def newest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by `order`, then by its other columns.

    Keys and the first column of `order`, the version, decide which rows are
    the last of their key; nothing else is aggregated or moved for that, and a
    key with most of the rows costs one row per task. Rows of other versions
    are dropped where they are before the rest of the columns is joined. Only
    rows that share key and version are compared by all of their columns.
    """
    version = list(order[:1])
    names = [key, *version]
    counted = rows.groupBy(*names).agg(F.count("*").alias("n"))
    if version:
        counted = counted.groupBy(key).agg(
            F.max(version[0]).alias(version[0]), F.max_by("n", version[0]).alias("n")
        )
    # Versions that are null together are told apart as rows that share one.
    last = materialize(counted.withColumn("n", F.coalesce("n", F.lit(2))), "newest_versions")

    def of(versions: DataFrame) -> DataFrame:
        held = may_hold(rows, key_bitmap(versions, *names), *names).alias("row")
        same = [F.col(f"row.{name}").eqNullSafe(F.col(f"last.{name}")) for name in names]
        return held.join(versions.select(*names).alias("last"), same, "left_semi")

    # Without ties, adaptive execution drops the second branch.
    others = [*order[1:], *(c for c in rows.columns if c != key and c not in order)]
    tied = of(last.where("n > 1")).groupBy(*names).agg(F.max(F.struct(*others)).alias("tied"))
    return of(last.where("n = 1")).select(*rows.columns).unionByName(
        tied.select(*names, "tied.*").select(*rows.columns)
    )


def without_superseded(rows: DataFrame, versions: DataFrame, key: str, version: str) -> DataFrame:
    """Drop rows of versions that a newer version of the same key replaces.

    `versions` lists the (key, version) pairs delivered so far, each once, so
    a key has at most as many as there were deliveries. Few of them are
    superseded as a rule: those are broadcast if their number allows, and then
    `rows` is not shuffled.
    """
    current = versions.groupBy(key).agg(F.max(version).alias("current"))
    superseded = (
        versions.select(key, version)
        .join(current, key)
        .where(F.col(version) < F.col("current"))
        .select(key, version)
    )
    superseded = materialize(superseded, "superseded")
    if superseded.count() <= BROADCAST_PAIRS:
        superseded = F.broadcast(superseded)
    return rows.join(superseded, [key, version], "left_anti")


def document_names(documents: DataFrame) -> DataFrame:
    """(doc_id, doc_name): the name `source.doc_id.txt` without its extension."""
    file_name = F.concat("source", F.lit("."), "doc_id", F.lit(".txt"))
    return documents.select("doc_id", without_extension(file_name).alias("doc_name"))


def result_catalog(raw_tags: DataFrame, tags: DataFrame, key: str = "doc_id") -> DataFrame:
    """Which documents have raw tags and which have normalized ones, by result name."""

    def listed(table: DataFrame, ending: str, flag: str, name: str) -> DataFrame:
        return (
            table.select(key)
            .distinct()
            .withColumn(name, F.concat(F.col(key).cast("string"), F.lit(ending)))
            .where(F.col(name).endswith(RAW_ENDING))
            .withColumn(flag, F.lit(True))
        )

    raw = listed(raw_tags, RAW_ENDING, "has_raw", "raw_name")
    normalized = listed(tags, NORMALIZED_ENDING, "has_normalized", "normalized_name")
    return raw.join(normalized, key, "full_outer").select(
        key,
        F.coalesce("has_raw", F.lit(False)).alias("has_raw"),
        F.coalesce("has_normalized", F.lit(False)).alias("has_normalized"),
        "raw_name",
        "normalized_name",
    )
