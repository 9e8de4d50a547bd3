"""Arriving documents: term frequencies, running totals, scores by the last IDF.

Every sink writes a micro-batch under its own batch number, so a batch that is
replayed after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import tokens
from termloom.operators.counting import Shape, document_frequency, term_frequency_of
from termloom.operators.replacing import newest, without_superseded
from termloom.operators.weighting import idf_of_terms, tf_idf
from termloom.session import materialize
from termloom.sources.tables import CorpusTables, IdfTable, batch_path, read_batches, write_batch

# Number of the batch that holds compacted totals.
COMPACTED = -1


def _drain(
    stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str
) -> None:
    """Process everything that has arrived, then stop."""
    (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
        .awaitTermination()
    )


def ingest_documents(stream: DataFrame, tables: CorpusTables, checkpoint: str) -> None:
    """Store arrived (doc_id, text, arrived) and their term frequencies."""
    _drain(
        stream,
        checkpoint,
        lambda batch, batch_id: tables.deliver(batch, batch_id, "arrived"),
        "append",
    )


def count_corpus_terms(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Keep the running corpus total of each term.

    A batch writes only the totals it changed. A document sent again counts
    again; totals that must follow replacements come from `CorpusTables`.
    """
    totals = stream.select(F.explode(tokens("text")).alias("term")).groupBy("term").count()
    _drain(
        totals.withColumnRenamed("count", "tf"),
        checkpoint,
        lambda batch, batch_id: write_batch(batch, path, batch_id),
        "update",
    )


def read_corpus_terms(spark: SparkSession, path: str) -> DataFrame:
    """(term, tf): the last written total of each term. Totals only grow."""
    changed = read_batches(spark, path, "term string, tf bigint")
    return changed.groupBy("term").agg(F.max("tf").alias("tf"))


def compact_corpus_terms(spark: SparkSession, path: str) -> None:
    """Gather the totals of all batches so far in one, while no batch is written.

    Totals only grow, so it does no harm if the run is repeated or stops half
    way, or if the stream replays its last batch.
    """
    batches = read_batches(spark, path, "term string, tf bigint").select("batch_id").distinct()
    # One row per micro-batch since the last compaction.
    numbers = [row["batch_id"] for row in batches.collect()]
    totals = materialize(read_corpus_terms(spark, path), "corpus_terms")
    write_batch(totals, path, COMPACTED)
    for number in numbers:
        if number != COMPACTED:
            write_batch(totals.limit(0), path, number)


def score_documents(stream: DataFrame, idf_table: IdfTable, path: str, checkpoint: str) -> None:
    """Score arrived documents by a fixed IDF table as they come.

    A micro-batch reads the buckets of the IDF that its terms fall in. Its term
    frequencies are a part of it, under its number.
    """

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        shape = Shape.of(batch)
        if shape.has_repeated_ids:
            batch = newest(batch, "doc_id", "arrived")
        tables = {name: f"{path}/{name}" for name in ("term_freq", "terms", "known", "scores", "documents")}

        def written(df: DataFrame, name: str) -> DataFrame:
            write_batch(df, tables[name], batch_id)
            spark = batch.sparkSession
            return spark.read.schema(df.schema).parquet(batch_path(tables[name], batch_id))

        term_freq = written(term_frequency_of(batch, shape.longest), "term_freq")
        terms = written(document_frequency(term_freq), "terms")
        known = written(idf_of_terms(terms, idf_table.of_terms(terms)), "known")
        write_batch(tf_idf(term_freq, known), tables["scores"], batch_id)
        write_batch(batch.select("doc_id"), tables["documents"], batch_id)

    _drain(stream, checkpoint, score_batch, "append")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, term, tf, idf, tf_idf) of the newest arrival of each document."""
    scores = read_batches(
        spark,
        f"{path}/scores",
        "doc_id bigint, term string, tf bigint, idf double, tf_idf double",
    )
    versions = read_batches(spark, f"{path}/documents", "doc_id bigint")
    return without_superseded(scores, versions, "doc_id", "batch_id").drop("batch_id")
