"""Result tables: Parquet by batch, whole-table Parquet, and delimited text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators.counting import Shape, raw_word_top_of, term_frequency_of
from termloom.operators.partitioning import spread
from termloom.operators.ranking import RANKING_SIZE, ordered_by_score
from termloom.operators.replacing import newest, result_catalog, without_superseded
from termloom.sources.commits import (
    BATCH,
    COMPACTION,
    RESULTS,
    Commit,
    CommitList,
    attempt_path,
    new_attempt,
    read_attempts,
)

# Buckets that an IDF table is stored in. More of them let a small delivery read less of
# a large table; each is a file of its own.
IDF_BUCKETS = 64
IDF_SCHEMA = "term string, df bigint, idf double"


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write `df` as one batch of a table, replacing that batch only.

    The batch's own folder is overwritten, so a batch that is sent again without
    rows leaves none behind.
    """
    df.write.mode("overwrite").parquet(batch_path(path, batch_id))


def batch_path(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches of a table. The schema is given, so an empty batch reads too."""
    return spark.read.schema(f"{schema}, batch_id bigint").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """Write a table, replacing what was there."""
    df.write.mode("overwrite").parquet(path)


def write_ranked(scores: DataFrame, path: str) -> None:
    """One ranking as `score<TAB>term` text, highest score first over all files."""
    ranked = ordered_by_score(scores)
    write_delimited(ranked.select(F.col("tf_idf").cast("string"), "term"), path)


def write_all_tf_idf(scores: DataFrame, path: str, key: str = "doc_id") -> None:
    """All documents' scores, in (document, term) order over all files."""
    (
        scores.repartitionByRange(key, "term")
        .sortWithinPartitions(key, "term")
        .write.mode("overwrite")
        .parquet(path)
    )


def write_delimited(df: DataFrame, path: str) -> None:
    """The columns of `df` as tab-separated text lines, in its order.

    A null is written as an empty field. A field with a tab or a line break
    stops the job, since it could not be read back.
    """
    broken = F.raise_error(F.lit("a field holds a tab or a line break"))

    def field(name: str) -> Column:
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.when(text.rlike(r"[\t\r\n]"), broken).otherwise(text)

    line = F.concat_ws("\t", *[field(name) for name in df.columns])
    df.select(line.alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def read_delimited(
    spark: SparkSession, path: str, text_column: str, number_column: str, number_first: bool = False
) -> DataFrame:
    """(text, number) of two-field tab-separated lines.

    Terms may hold quotes and backslashes, which a CSV reader would interpret.
    A field that is no number reads as null.
    """
    fields = F.split("value", "\t")
    number, text = (0, 1) if number_first else (1, 0)
    return (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.get(fields, F.lit(text)).alias(text_column),
            F.get(fields, F.lit(number)).try_cast("double").alias(number_column),
        )
    )


class IdfTable:
    """A stored (term, df, idf), in buckets by term.

    New documents hold few of the terms of a large corpus. Those that are asked
    for decide which buckets are read; the others are not opened. The number of
    buckets is stored with them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def write(self, idf: DataFrame, buckets: int = IDF_BUCKETS) -> None:
        """Store an IDF, replacing what was there; each bucket is one sorted file."""
        placed = idf.select("term", "df", "idf").withColumns(
            {"of": F.lit(buckets), "bucket": self._bucket(buckets)}
        )
        (
            placed.repartition(buckets, "bucket")
            .sortWithinPartitions("bucket", "term")
            .write.mode("overwrite")
            .partitionBy("of", "bucket")
            .parquet(self.path)
        )

    def read(self) -> DataFrame:
        """All of (term, df, idf)."""
        return self._stored().select("term", "df", "idf")

    def of_terms(self, terms: DataFrame) -> DataFrame:
        """(term, df, idf) of the buckets that the terms of `terms` fall in."""
        stored = self._stored()
        row = stored.select("of").first()
        if row is None:
            return stored.select("term", "df", "idf")
        # At most as many numbers as there are buckets.
        asked = terms.select(self._bucket(row["of"]).alias("bucket")).distinct().collect()
        within = F.col("bucket").isin([found["bucket"] for found in asked])
        return stored.where(within).select("term", "df", "idf")

    @staticmethod
    def _bucket(buckets: int) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(f"{IDF_SCHEMA}, of int, bucket int").parquet(self.path)


class CorpusTables:
    """Documents, their term frequencies and tags, delivered batch by batch.

    A delivery writes its own attempt of each table and touches no other, so
    adding a document costs that document. It counts once its commit is
    written, which is the last step: until then, and if it stops before,
    readers see what was there, also of a batch that is sent again. The newest
    delivery of a document counts, decided on the lists of documents: a text
    without any token leaves no TF row, yet replaces the earlier text. Batch
    numbers belong to one writer: a stream counts its own from 0, so it needs
    tables of its own. Replaced attempts stay for their owner to expire.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        root = root.rstrip("/")
        self.commits = CommitList(spark, f"{root}/commits")
        self.documents_path = f"{root}/documents"
        self.texts_path = f"{root}/texts"
        self.term_freq_path = f"{root}/term_freq"
        self.raw_tags_path = f"{root}/raw_tags"
        self.results_path = f"{root}/results"

    SCHEMAS = {
        "texts": "doc_id bigint, text string",
        "term_freq": "doc_id bigint, term string, tf bigint",
        "raw_tags": "doc_id bigint, term string, freq bigint, rank int",
        "documents": "doc_id bigint",
    }

    def _path(self, table: str) -> str:
        return getattr(self, f"{table}_path")

    def deliver(self, documents: DataFrame, batch_id: int, *order: str) -> None:
        """Store (doc_id, text) as batch `batch_id`.

        If a document comes more than once in the delivery, the last one by
        `order`, then by text, is kept. A batch that was compacted is closed
        and cannot be sent again.
        """
        closed = [c.last_batch for c in self.commits.batches() if c.kind == COMPACTION]
        if closed and batch_id <= max(closed):
            raise ValueError(f"batch {batch_id} is part of a compacted one and cannot be replaced")
        shape = Shape.of(documents)
        if shape.has_repeated_ids:
            documents = newest(documents, "doc_id", *order)
        attempt = new_attempt()

        def write(table: str, df: DataFrame) -> DataFrame:
            path = attempt_path(self._path(table), batch_id, attempt)
            df.write.parquet(path)
            return self.spark.read.schema(self.SCHEMAS[table]).parquet(path)

        own = write("texts", documents.select("doc_id", "text"))
        texts = spread(own)
        write("term_freq", term_frequency_of(texts, shape.longest))
        write("raw_tags", raw_word_top_of(texts, RANKING_SIZE, shape.longest))
        write("documents", own.select("doc_id"))
        self.commits.add(attempt, BATCH, batch_id, batch_id)

    def compact(self, keep_newest: int = 1) -> None:
        """Gather the deliveries so far in one, without the rows that others of them replace.

        The newest `keep_newest` stay as they are, since a stream may send its
        last batch again; what those replace stays too. The gathered batches
        are closed. Results of reading are the same before and after.
        """
        live = self.commits.batches()
        gathered = live[: len(live) - keep_newest]
        if len(gathered) < 2:
            return
        attempt, last = new_attempt(), gathered[-1].last_batch
        for table in self.SCHEMAS:
            rows = self._current(table, gathered)
            rows.write.parquet(attempt_path(self._path(table), last, attempt))
        self.commits.add(attempt, COMPACTION, gathered[0].first_batch, last)

    def store_results(self, idf: DataFrame, tags: DataFrame) -> None:
        """Store (term, df, idf) and normalized tags, replacing earlier ones together."""
        attempt = new_attempt()
        IdfTable(self.spark, f"{self.results_path}/{attempt}/idf").write(idf)
        tags.write.parquet(f"{self.results_path}/{attempt}/tags")
        self.commits.add(attempt, RESULTS)

    def ids(self) -> DataFrame:
        """(doc_id) of all delivered documents."""
        return self._rows("documents", self.commits.batches()).select("doc_id").distinct()

    def documents(self) -> DataFrame:
        """(doc_id, text) of the newest delivery of each document."""
        return self._current("texts", self.commits.batches())

    def term_frequency(self) -> DataFrame:
        """(doc_id, term, tf) of the newest delivery of each document."""
        return self._current("term_freq", self.commits.batches())

    def raw_tags(self) -> DataFrame:
        """(doc_id, term, freq, rank) of the newest delivery of each document."""
        return self._current("raw_tags", self.commits.batches())

    def idf_table(self) -> IdfTable:
        """The stored IDF, by its buckets."""
        return IdfTable(self.spark, f"{self._results()}/idf")

    def idf(self) -> DataFrame:
        """The stored (term, df, idf)."""
        return self.idf_table().read()

    def tags(self) -> DataFrame:
        """The stored normalized tags of documents and corpus."""
        return self.spark.read.parquet(f"{self._results()}/tags")

    def catalog(self) -> DataFrame:
        """Which documents have stored raw tags and which have normalized ones."""
        return result_catalog(self.raw_tags(), self.tags().where(F.col("scope") == "document"))

    def _results(self) -> str:
        found = self.commits.results()
        if found is None:
            raise LookupError("no results are stored")
        return f"{self.results_path}/{found.attempt}"

    def _rows(self, table: str, commits: list[Commit]) -> DataFrame:
        return read_attempts(self.spark, self._path(table), commits, self.SCHEMAS[table])

    def _current(self, table: str, commits: list[Commit]) -> DataFrame:
        rows = self._rows(table, commits)
        if len(commits) < 2:
            return rows.drop("batch_id")
        listed = self._rows("documents", commits)
        return without_superseded(rows, listed, "doc_id", "batch_id").drop("batch_id")
