"""From raw documents to packed training sequences, stage by stage.

Every stage works on all documents that the one before kept, and is written as
Parquet and read again before the next. Empty tables give empty results. Further
columns are kept by all stages but the last, whatever their names. Rows without
an id are documents like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import decontamination, language, packing, quality, simhash
from termloom.llm.queries import VOCABULARY
from termloom.session import scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one learned language has the greater part.

    Null texts and those without a letter have none. Where no document has a
    language to learn from, none is kept.
    """
    return language.keep_identified(docs, language.train(docs))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold all quality rules; null and empty texts do not."""
    return quality.keep_good(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id.

    Of rows with the same id one stays, of a group without ids all that differ.
    Texts without a word are one group.
    """
    return simhash.keep_one_of_each(docs)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Items without a word are in no document, nor is anything in an empty text.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.remove_leaks(docs, benchmark)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in token sequences; null texts are empty ones."""
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [
    ("language identification", identify_language),
    ("quality rules", apply_quality_rules),
    ("near duplicates", remove_near_duplicates),
    ("benchmark decontamination", remove_benchmark_leaks),
    ("best-fit packing", pack_sequences),
]

#: The stages learn, connect and pack, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of `sf_dir` to the places of their pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = scratch_path(spark, "pipeline_stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
