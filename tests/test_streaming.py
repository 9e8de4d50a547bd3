import pytest
from conftest import SF_DIR, rows
from pyspark.sql import functions as F

from termloom.operators import counting
from termloom.plans.corpus import Corpus
from termloom.session import scratch_path
from termloom.sources.documents import stream_documents
from termloom.sources.tables import CorpusTables, IdfTable, write_batch
from termloom.streaming import ingest


def same(one, other):
    return one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


@pytest.fixture
def root(spark):
    return scratch_path(spark, "test_stream")


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text"))


@pytest.fixture(scope="module")
def four_files(spark, corpus):
    path = scratch_path(spark, "test_stream_input")
    corpus.documents.repartition(4, "doc_id").write.parquet(path)
    return path


def drop(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def test_term_frequency_over_four_batches(spark, corpus, four_files, root):
    tables = CorpusTables(spark, f"{root}/tables")
    stream = stream_documents(spark, four_files, files_per_batch=1)
    ingest.ingest_documents(stream, tables, f"{root}/checkpoint")
    assert same(tables.term_frequency(), corpus.term_freq)
    assert spark.read.parquet(tables.documents_path).select("batch_id").distinct().count() == 4


def test_corpus_terms_over_four_batches(spark, corpus, four_files, root):
    stream = stream_documents(spark, four_files, files_per_batch=1)
    ingest.count_corpus_terms(stream, f"{root}/totals", f"{root}/checkpoint")
    found = ingest.read_corpus_terms(spark, f"{root}/totals")
    assert same(found, counting.corpus_term_frequency(corpus.term_freq))


def test_scores_over_four_batches(spark, corpus, four_files, root):
    idf_table = IdfTable(spark, f"{root}/idf")
    idf_table.write(corpus.idf_table)
    stream = stream_documents(spark, four_files, files_per_batch=1)
    ingest.score_documents(stream, idf_table, f"{root}/scored", f"{root}/checkpoint")
    found = ingest.read_scores(spark, f"{root}/scored")
    assert same(found.select(corpus.scores.columns), corpus.scores)


def test_documents_arriving_later_and_again(spark, documents, root):
    source, tables = f"{root}/in", CorpusTables(spark, f"{root}/tables")
    drop(documents({1: "apple apple", 2: "pear"}), source)
    run = lambda: ingest.ingest_documents(
        stream_documents(spark, source), tables, f"{root}/checkpoint"
    )
    run()
    run()
    assert rows(tables.term_frequency(), "doc_id", "term", "tf") == [(1, "apple", 2), (2, "pear", 1)]
    drop(documents({1: "plum", 3: "42"}), source)
    run()
    assert rows(tables.term_frequency(), "doc_id", "term", "tf") == [(1, "plum", 1), (2, "pear", 1)]
    assert rows(Corpus(tables.documents()).size, "n") == [(3,)]


def test_a_replayed_batch_changes_nothing(spark, documents, root):
    tables = CorpusTables(spark, f"{root}/tables")
    batch = documents({1: "apple"}).withColumn("arrived", F.current_timestamp())
    for _ in range(2):
        tables.deliver(batch, 7, "arrived")
    assert rows(tables.term_frequency(), "doc_id", "term", "tf") == [(1, "apple", 1)]


def test_running_totals_resume(spark, documents, root):
    source = f"{root}/in"
    run = lambda: ingest.count_corpus_terms(
        stream_documents(spark, source), f"{root}/totals", f"{root}/checkpoint"
    )
    drop(documents(["apple pear"]), source)
    run()
    drop(documents(["apple"]), source)
    run()
    found = ingest.read_corpus_terms(spark, f"{root}/totals")
    assert rows(found, "term", "tf") == [("apple", 2), ("pear", 1)]


def test_a_document_scored_again_replaces_its_scores(spark, documents, root):
    idf_table = IdfTable(spark, f"{root}/idf")
    idf_table.write(Corpus(documents(["apple", "pear"])).idf_table, buckets=8)
    source = f"{root}/in"
    run = lambda: ingest.score_documents(
        stream_documents(spark, source), idf_table, f"{root}/scored", f"{root}/checkpoint"
    )
    drop(documents({1: "apple", 2: "pear"}), source)
    run()
    drop(documents({1: "1 2 3", 2: "apple kiwi"}), source)
    run()
    found = ingest.read_scores(spark, f"{root}/scored").withColumn("known", F.col("tf_idf") > 0)
    assert rows(found, "doc_id", "term", "known") == [(2, "apple", True), (2, "kiwi", False)]


def test_an_empty_batch_reads_as_empty(spark, documents, root):
    write_batch(counting.term_frequency(documents({1: "123"})), f"{root}/totals", 0)
    assert spark.read.schema("term string, batch_id bigint").parquet(f"{root}/totals").count() == 0


def test_a_stream_over_an_empty_folder(spark, documents, tmp_path, root):
    tables = CorpusTables(spark, f"{root}/tables")
    run = lambda: ingest.ingest_documents(
        stream_documents(spark, str(tmp_path), schema="doc_id bigint, text string"),
        tables,
        f"{root}/checkpoint",
    )
    run()
    drop(documents({1: "apple"}), str(tmp_path))
    run()
    assert rows(tables.term_frequency(), "doc_id", "term", "tf") == [(1, "apple", 1)]


def test_compacted_totals_are_the_same(spark, corpus, four_files, root):
    path = f"{root}/totals"
    stream = stream_documents(spark, four_files, files_per_batch=1)
    ingest.count_corpus_terms(stream, path, f"{root}/checkpoint")
    for _ in range(2):
        ingest.compact_corpus_terms(spark, path)
        found = ingest.read_corpus_terms(spark, path)
        assert same(found, counting.corpus_term_frequency(corpus.term_freq))
    held = spark.read.parquet(path).groupBy("batch_id").count()
    assert rows(held, "batch_id") == [(ingest.COMPACTED,)]
