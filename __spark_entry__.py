"""Registered queries, each with the same question in SQL for DuckDB."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.weights import rounded
from termloom.operators import counting, ranking, replacing, weighting
from termloom.operators.partitioning import spread
from termloom.plans.corpus import Corpus
from termloom.session import scratch_path
from termloom.sources.documents import read_documents, read_text_folder, stream_documents
from termloom.sources.tables import (
    CorpusTables,
    IdfTable,
    read_batches,
    read_delimited,
    write_all_tf_idf,
    write_batch,
    write_delimited,
    write_ranked,
)
from termloom.streaming import ingest

try:  # absent where the library is used without its text preparation
    import corpus_pipeline
    from termloom.llm import queries as llm
except ModuleNotFoundError as error:
    if error.name not in ("corpus_pipeline", "termloom.llm"):
        raise
    llm = None

# The tables come in few files: tasks for the texts of a micro-batch.
STREAM_TASKS = 16

# ---------------------------------------------------------------- inputs


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(spark, f"{sf_dir}/documents.parquet")


def _corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus.read(spark, f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> Corpus:
    """Web pages, as documents that are not part of the corpus."""
    return Corpus.read(spark, f"{sf_dir}/pages.parquet", "page_id", "html")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, tf) of all conversations read as the rows of one document."""
    turns = spread(read_documents(spark, f"{sf_dir}/conversations.parquet", "conv_id"))
    return counting.corpus_term_frequency(counting.term_frequency(turns))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c)) for c in columns})


def _in_millionths(df: DataFrame, *columns: str) -> DataFrame:
    """Scores as whole numbers of millionths, so that large results compare exactly."""
    return df.select(
        *(c for c in df.columns if c not in columns),
        *(rounded(F.col(c) * 1_000_000, 0).cast("bigint").alias(f"{c}_millionths") for c in columns),
    )


# ---------------------------------------------------------------- queries


def tokens(spark, sf_dir):
    return counting.tokenize(spread(_documents(spark, sf_dir)))


def corpus_lines(spark, sf_dir):
    return counting.line_count(spread(_documents(spark, sf_dir)))


def term_frequency(spark, sf_dir):
    return _corpus(spark, sf_dir).term_freq


def term_frequency_by_key(spark, sf_dir):
    return ranking.ordered_by_key(_corpus(spark, sf_dir).term_freq_table, "term", "doc_id")


def corpus_term_frequency(spark, sf_dir):
    return counting.corpus_term_frequency(_corpus(spark, sf_dir).term_freq)


def term_frequency_of_cut_texts(spark, sf_dir):
    """Most texts are cut here, and counted in parts by different tasks."""
    documents = _documents(spark, sf_dir)
    return Corpus(documents, spread(documents), longest=1000).term_freq


def document_frequency(spark, sf_dir):
    return counting.document_frequency(_corpus(spark, sf_dir).term_freq)


def corpus_size(spark, sf_dir):
    return counting.corpus_size(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def idf(spark, sf_dir):
    return _rounded(_corpus(spark, sf_dir).idf(), "idf")


def idf_with_corpus_document(spark, sf_dir):
    return _rounded(_corpus(spark, sf_dir).idf(include_corpus_document=True), "idf")


def tf_idf_sparse(spark, sf_dir):
    return _in_millionths(_corpus(spark, sf_dir).scores, "idf", "tf_idf")


def tf_idf_small_budget(spark, sf_dir):
    """With most terms too rare to be broadcast."""
    corpus = _corpus(spark, sf_dir)
    scores = weighting.tf_idf(corpus.term_freq_table, corpus.idf_table, budget=20_000)
    return _in_millionths(scores, "idf", "tf_idf")


def tf_idf_top300(spark, sf_dir):
    tags = _corpus(spark, sf_dir).tags(rounded=True)
    return _rounded(tags.select("doc_id", "term", "tf_idf", "rank"), "tf_idf")


def tags_truncated_weight(spark, sf_dir):
    return _corpus(spark, sf_dir).weighted_tags()


def tag_font_size(spark, sf_dir):
    return _rounded(ranking.with_font_size(_corpus(spark, sf_dir).weighted_tags()), "font_size")


def tags_as_array(spark, sf_dir):
    arrays = ranking.tags_as_array(_corpus(spark, sf_dir).tags())
    return arrays.select("doc_id", F.array_join("tags", " ").alias("tags"))


def tf_idf_dense(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    totals = weighting.dense_totals(corpus.scores, corpus.idf_table, corpus.documents)
    return totals.withColumn("tf_idf_sum", F.round("tf_idf_sum", 4))


def dense_top300(spark, sf_dir):
    return _corpus(spark, sf_dir).dense_tags()


def global_tf_idf(spark, sf_dir):
    return _rounded(_corpus(spark, sf_dir).corpus_scores().select("term", "tf_idf"), "tf_idf")


def global_tf_idf_top300(spark, sf_dir):
    top = ranking.top_terms(_corpus(spark, sf_dir).corpus_scores())
    return _rounded(top.select("term", "tf_idf", "rank"), "tf_idf")


def single_tf_idf(spark, sf_dir):
    scores = weighting.single_tf_idf(_log(spark, sf_dir), _corpus(spark, sf_dir).idf())
    return _rounded(ranking.ordered_by_score(scores), "tf_idf")


def single_tf_idf_top300(spark, sf_dir):
    scores = weighting.single_tf_idf(_log(spark, sf_dir), _corpus(spark, sf_dir).idf())
    return _rounded(ranking.top_terms(scores), "tf_idf")


def tf_idf_by_union(spark, sf_dir):
    scores = weighting.single_tf_idf_by_union(_log(spark, sf_dir), _corpus(spark, sf_dir).idf())
    return _rounded(scores, "tf_idf")


def score_against_snapshot(spark, sf_dir):
    scores = _corpus(spark, sf_dir).score(_pages(spark, sf_dir))
    return _rounded(scores.select("doc_id", "term", "tf_idf"), "tf_idf")


def normalized_tags(spark, sf_dir):
    return _rounded(_corpus(spark, sf_dir).normalized_tags(), "font_size")


def raw_word_frequency(spark, sf_dir):
    return _corpus(spark, sf_dir).raw_freq


def raw_word_top300(spark, sf_dir):
    return _corpus(spark, sf_dir).raw_tags()


def raw_tag_font_size(spark, sf_dir):
    tags = ranking.with_font_size(_corpus(spark, sf_dir).raw_tags(), "freq")
    return _rounded(tags, "font_size")


def document_name(spark, sf_dir):
    return replacing.document_names(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def document_upsert(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return replacing.newest(turns, "conv_id", "turn", "role", "text")


def _two_deliveries(spark: SparkSession, sf_dir: str) -> CorpusTables:
    """All documents, then the newest turn of every conversation under its number."""
    tables = CorpusTables(spark, scratch_path(spark, "incremental"))
    tables.deliver(_documents(spark, sf_dir), 0)
    second = document_upsert(spark, sf_dir)
    tables.deliver(second.select(F.col("conv_id").alias("doc_id"), "text"), 1)
    return tables


def incremental_term_frequency(spark, sf_dir):
    return _two_deliveries(spark, sf_dir).term_frequency()


def incremental_raw_tags(spark, sf_dir):
    return _two_deliveries(spark, sf_dir).raw_tags()


def _resent_batch(spark: SparkSession, sf_dir: str) -> CorpusTables:
    """All documents; all pages; the pages again with nothing but their digits."""
    tables = CorpusTables(spark, scratch_path(spark, "resent"))
    tables.deliver(_documents(spark, sf_dir), 0)
    pages = read_documents(spark, f"{sf_dir}/pages.parquet", "page_id", "html")
    tables.deliver(pages, 1)
    digits = F.regexp_replace("text", "[^0-9]+", " ")
    tables.deliver(pages.withColumn("text", digits), 1)
    return tables


def resent_batch_term_frequency(spark, sf_dir):
    return _resent_batch(spark, sf_dir).term_frequency()


def resent_batch_raw_tags(spark, sf_dir):
    return _resent_batch(spark, sf_dir).raw_tags()


def _stored(spark: SparkSession, sf_dir: str) -> CorpusTables:
    """Two deliveries, and the results of the corpus they leave."""
    tables = _two_deliveries(spark, sf_dir)
    corpus = Corpus.stored(tables)
    tables.store_results(corpus.idf_table, corpus.normalized_tags())
    return tables


def stored_idf(spark, sf_dir):
    return _rounded(_stored(spark, sf_dir).idf(), "idf")


def stored_normalized_tags(spark, sf_dir):
    return _rounded(_stored(spark, sf_dir).tags(), "font_size")


def term_freq_table_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "term_freq_roundtrip")
    term_freq = _corpus(spark, sf_dir).term_freq
    write_batch(term_freq, path, 0)
    write_batch(term_freq, path, 0)
    return read_batches(spark, path, "doc_id bigint, term string, tf bigint").drop("batch_id")


def tsv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "idf_tsv")
    write_delimited(_corpus(spark, sf_dir).idf().select("term", "idf"), path)
    return _rounded(read_delimited(spark, path, "term", "idf"), "idf")


def single_tf_idf_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "single_tf_idf_tsv")
    write_ranked(weighting.single_tf_idf(_log(spark, sf_dir), _corpus(spark, sf_dir).idf()), path)
    return _rounded(read_delimited(spark, path, "term", "tf_idf", number_first=True), "tf_idf")


def tf_idf_table_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "all_tf_idf")
    write_all_tf_idf(_corpus(spark, sf_dir).scores, path)
    return _in_millionths(spark.read.parquet(path).select("doc_id", "term", "tf_idf"), "tf_idf")


def corpus_term_frequency_of_text_files(spark, sf_dir):
    path = scratch_path(spark, "text_files")
    spread(_documents(spark, sf_dir)).select("text").write.text(path)
    lines = read_text_folder(spark, path)
    return counting.corpus_term_frequency(counting.term_frequency(lines))


def text_folder_term_frequency(spark, sf_dir):
    """A folder of text files for each source, and the number of folders."""
    path = scratch_path(spark, "text_folders")
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "text")
    spread(table).write.partitionBy("source").text(path)
    corpus = Corpus.read_text_folder(spark, path, by_folder=True)
    n = corpus.size.select("n").scalar()
    return corpus.term_freq.select(
        F.regexp_replace("doc_id", "^source=", "").alias("source"), "term", "tf", n.alias("n")
    )


def result_catalog(spark, sf_dir):
    tables = CorpusTables(spark, scratch_path(spark, "catalog"))
    tables.deliver(_documents(spark, sf_dir), 0)
    corpus = Corpus.stored(tables)
    tables.store_results(corpus.idf_table, corpus.normalized_tags())
    return tables.catalog()


def stream_term_frequency(spark, sf_dir):
    root = scratch_path(spark, "stream_term_frequency")
    tables = CorpusTables(spark, f"{root}/tables")
    stream = stream_documents(spark, f"{sf_dir}/documents*.parquet")
    ingest.ingest_documents(stream, tables, f"{root}/checkpoint")
    return tables.term_frequency()


def stream_corpus_term_frequency(spark, sf_dir):
    root = scratch_path(spark, "stream_corpus_term_frequency")
    stream = stream_documents(spark, f"{sf_dir}/documents*.parquet", tasks=STREAM_TASKS)
    ingest.count_corpus_terms(stream, f"{root}/totals", f"{root}/checkpoint")
    return ingest.read_corpus_terms(spark, f"{root}/totals")


def stream_score_against_snapshot(spark, sf_dir):
    root = scratch_path(spark, "stream_scores")
    pages = f"{sf_dir}/pages*.parquet"
    stream = stream_documents(spark, pages, "page_id", "html", tasks=STREAM_TASKS)
    idf_table = IdfTable(spark, f"{root}/idf")
    idf_table.write(_corpus(spark, sf_dir).idf_table)
    ingest.score_documents(stream, idf_table, f"{root}/scored", f"{root}/checkpoint")
    scores = ingest.read_scores(spark, f"{root}/scored")
    return _rounded(scores.select("doc_id", "term", "tf_idf"), "tf_idf")


def entry(spark: SparkSession) -> DataFrame:
    """Top 300 terms of every document by TF-IDF."""
    return tf_idf_top300(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    added = llm.queries() | {"pipeline": corpus_pipeline.run} if llm else {}
    return core_queries() | added


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        query.__name__: query
        for query in (
            tokens,
            corpus_lines,
            term_frequency,
            term_frequency_by_key,
            corpus_term_frequency,
            term_frequency_of_cut_texts,
            document_frequency,
            corpus_size,
            idf,
            idf_with_corpus_document,
            tf_idf_sparse,
            tf_idf_small_budget,
            tf_idf_top300,
            tags_truncated_weight,
            tag_font_size,
            tags_as_array,
            tf_idf_dense,
            dense_top300,
            global_tf_idf,
            global_tf_idf_top300,
            single_tf_idf,
            single_tf_idf_top300,
            tf_idf_by_union,
            score_against_snapshot,
            normalized_tags,
            raw_word_frequency,
            raw_word_top300,
            raw_tag_font_size,
            document_name,
            document_upsert,
            incremental_term_frequency,
            incremental_raw_tags,
            resent_batch_term_frequency,
            resent_batch_raw_tags,
            stored_idf,
            stored_normalized_tags,
            term_freq_table_roundtrip,
            tsv_roundtrip,
            single_tf_idf_roundtrip,
            tf_idf_table_roundtrip,
            corpus_term_frequency_of_text_files,
            text_folder_term_frequency,
            result_catalog,
            stream_term_frequency,
            stream_corpus_term_frequency,
            stream_score_against_snapshot,
        )
    }


# ---------------------------------------------------------------- SQL


def _term_cte(name: str, source: str) -> str:
    """CTEs ending in `name`(doc_id, term), one row per token of `source`.

    The SQL engine has no look-around, so digit runs become markers at the
    ends of a run of token characters, and the ends are trimmed by marker.
    """
    return rf"""
{name}_runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
    regexp_replace(text, '[0-9]+', '00', 'g'), '0?[^\s\x0B0-9\-.:]+0?')) AS r
  FROM ({source})),
{name}_left AS (
  SELECT doc_id, CASE WHEN r LIKE '0%'
    THEN regexp_replace(r, '^0[\p{{L}}\p{{Nd}}\p{{Mn}}_]*', '')
    ELSE regexp_replace(r, '^[^\p{{L}}\p{{Nd}}\p{{Mn}}_]+', '') END AS r FROM {name}_runs),
{name}_both AS (
  SELECT doc_id, CASE WHEN r LIKE '%0'
    THEN regexp_replace(r, '[\p{{L}}\p{{Nd}}\p{{Mn}}_]*0$', '')
    ELSE regexp_replace(r, '[^\p{{L}}\p{{Nd}}\p{{Mn}}_]+$', '') END AS r FROM {name}_left),
{name} AS (SELECT doc_id, lower(r) AS term FROM {name}_both WHERE r <> '')"""


def _raw_cte(source: str) -> str:
    return rf"""WITH words AS (
  SELECT doc_id, lower(regexp_replace(unnest(regexp_split_to_array(text, '[\s\x0B]+')),
    '[.:;()",?!<>/]', '', 'g')) AS term FROM {source}),
raw AS (SELECT doc_id, term, count(*) AS freq FROM words
  WHERE length(term) BETWEEN 4 AND 32 GROUP BY ALL),
rawtags AS (SELECT *, row_number() OVER
  (PARTITION BY doc_id ORDER BY freq DESC, term)::INT AS rank FROM raw QUALIFY rank <= 300)"""


def _font_size(weight: str, source: str) -> str:
    """SELECT of `source` with the font size of `weight` within each document."""
    return f"""SELECT * EXCLUDE (lo, hi), round(CASE WHEN hi = lo THEN 50.0
  ELSE 8 + 42 * (sqrt({weight}) - lo) / (hi - lo) END, 6) AS font_size
FROM (SELECT *, sqrt(min({weight}) OVER (PARTITION BY doc_id)) AS lo,
  sqrt(max({weight}) OVER (PARTITION BY doc_id)) AS hi FROM {source})"""


def oracle_sql() -> dict[str, str]:
    return core_oracle_sql() | (llm.oracle_sql() if llm else {})


def core_oracle_sql() -> dict[str, str]:
    documents = "SELECT doc_id, text FROM documents"
    terms = "WITH" + _term_cte("terms", documents)
    tf = terms + ",\ntf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL)"
    idf_ = tf + (
        ",\nn AS (SELECT count(DISTINCT doc_id) AS n FROM documents)"
        ",\nidf AS (SELECT term, count(*) AS df, ln(n::DOUBLE / count(*)) AS idf"
        " FROM tf, n GROUP BY term, n)"
    )
    scores = idf_ + (
        ",\ns AS (SELECT doc_id, term, tf, idf, tf * idf AS tf_idf FROM tf JOIN idf USING (term))"
    )
    tags = scores + (
        ",\ntags AS (SELECT doc_id, term, round(tf_idf, 6) AS tf_idf, row_number() OVER"
        " (PARTITION BY doc_id ORDER BY round(tf_idf, 6) DESC, term)::INT AS rank FROM s"
        " QUALIFY rank <= 300)"
    )
    weighted = scores + (
        ",\nw AS (SELECT doc_id, term, floor(round(tf_idf, 6))::INT AS weight FROM s)"
        ",\nwtags AS (SELECT *, row_number() OVER"
        " (PARTITION BY doc_id ORDER BY weight DESC, term)::INT AS rank FROM w QUALIFY rank <= 300)"
    )
    corpus = scores + (
        ",\nc AS (SELECT term, round(sum(tf) * any_value(idf), 6) AS tf_idf"
        " FROM s GROUP BY term)"
    )
    corpus_top = (
        "SELECT term, tf_idf, row_number() OVER (ORDER BY tf_idf DESC, term)::INT AS rank"
        " FROM c QUALIFY rank <= 300"
    )
    single = (
        idf_
        + ","
        + _term_cte("log", "SELECT conv_id AS doc_id, text FROM conversations")
        + ",\nlogtf AS (SELECT term, count(*) AS tf FROM log GROUP BY term)"
        ",\nc AS (SELECT term, round(coalesce(tf * idf, 0.0), 6) AS tf_idf"
        " FROM logtf FULL JOIN idf USING (term))"
    )
    snapshot = (
        idf_
        + ","
        + _term_cte("pg", "SELECT page_id AS doc_id, html AS text FROM pages")
        + ",\npgtf AS (SELECT doc_id, term, count(*) AS tf FROM pg GROUP BY ALL)\n"
        "SELECT doc_id, term, round(coalesce(tf * idf, 0.0), 6) AS tf_idf"
        " FROM pgtf LEFT JOIN idf USING (term)"
    )
    newest = (
        "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER"
        " (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1"
    )
    delivered = (
        f"SELECT conv_id AS doc_id, text FROM ({newest}) UNION ALL SELECT doc_id, text"
        " FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM conversations)"
    )
    pages_resent = (
        "SELECT page_id AS doc_id, regexp_replace(html, '[^0-9]+', ' ', 'g') AS text FROM pages"
        " UNION ALL SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages)"
    )
    stored = (
        "WITH delivered AS ("
        + delivered
        + "),"
        + _term_cte("terms", "SELECT * FROM delivered")
        + ",\ntf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL)"
        ",\nn AS (SELECT count(DISTINCT doc_id) AS n FROM delivered)"
        ",\nidf AS (SELECT term, count(*) AS df, ln(n::DOUBLE / count(*)) AS idf"
        " FROM tf, n GROUP BY term, n)"
    )
    raw = _raw_cte("documents")
    tf_rows = tf + "\nSELECT * FROM tf"
    corpus_tf_rows = terms + "\nSELECT term, count(*) AS tf FROM terms GROUP BY term"
    normalized = f""",
c AS (SELECT term, round(sum(tf) * any_value(idf), 6) AS tf_idf FROM s GROUP BY term),
both_scopes AS (SELECT 'document' AS scope, doc_id, term, floor(tf_idf)::INT AS weight, rank
  FROM tags UNION ALL SELECT 'corpus', -1, term, floor(tf_idf)::INT, rank FROM ({corpus_top}))
""" + _font_size("weight", "both_scopes")
    once = scores.replace("tf AS (", "tf AS MATERIALIZED (", 1)
    scores_rows = once + (
        "\nSELECT doc_id, term, tf, round(idf * 1000000)::BIGINT AS idf_millionths,"
        " round(tf_idf * 1000000)::BIGINT AS tf_idf_millionths FROM s"
    )
    idf_rows = idf_ + "\nSELECT term, df, round(idf, 6) AS idf FROM idf"
    # The grid of the next two is written out here, as the long way round.
    grid = scores + (
        ",\ngrid AS (SELECT d.doc_id, idf.term, coalesce(s.tf_idf, 0.0) AS tf_idf"
        " FROM (SELECT DISTINCT doc_id FROM documents) d CROSS JOIN idf"
        " LEFT JOIN s ON s.doc_id = d.doc_id AND s.term = idf.term)"
    )
    return {
        "tokens": terms + "\nSELECT doc_id, term FROM terms",
        "corpus_lines": r"""
WITH t AS (SELECT doc_id, text,
  regexp_replace(text, '(\r\n|\r|\n)$', '') AS closed FROM documents)
SELECT doc_id, CASE WHEN text = '' THEN 0
  ELSE len(regexp_extract_all(closed, '\r\n|\r|\n')) + 1 END::BIGINT AS n_lines FROM t""",
        "term_frequency": tf_rows,
        "term_frequency_by_key": tf_rows,
        "term_frequency_of_cut_texts": tf_rows,
        "corpus_term_frequency": corpus_tf_rows,
        "document_frequency": tf + "\nSELECT term, count(*) AS df FROM tf GROUP BY term",
        "corpus_size": "SELECT count(DISTINCT doc_id) AS n FROM documents",
        "idf": idf_rows,
        "idf_with_corpus_document": idf_
        + "\nSELECT term, df + 1 AS df, round(ln((n + 1)::DOUBLE / (df + 1)), 6) AS idf"
        " FROM idf, n",
        "tf_idf_small_budget": scores_rows,
        "tf_idf_sparse": scores_rows,
        "tf_idf_top300": tags + "\nSELECT * FROM tags",
        "tags_truncated_weight": weighted + "\nSELECT * FROM wtags",
        "tag_font_size": weighted + "\n" + _font_size("weight", "wtags"),
        "tags_as_array": tags
        + "\nSELECT doc_id, string_agg(term, ' ' ORDER BY rank) AS tags FROM tags GROUP BY doc_id",
        "tf_idf_dense": grid
        + "\nSELECT doc_id, count(*) AS cells, count(*) FILTER (tf_idf = 0) AS zero_cells,"
        " round(sum(tf_idf), 4) AS tf_idf_sum FROM grid GROUP BY doc_id",
        "dense_top300": grid
        + """,
best AS (SELECT doc_id, min({'w': -floor(round(tf_idf, 6))::INT, 't': term}, 300) AS tags
  FROM grid GROUP BY doc_id)
SELECT doc_id, unnest(tags).t AS term, -unnest(tags).w AS weight,
  unnest(range(1, len(tags) + 1))::INT AS rank FROM best""",
        "global_tf_idf": corpus + "\nSELECT term, tf_idf FROM c",
        "global_tf_idf_top300": corpus + "\n" + corpus_top,
        "single_tf_idf": single + "\nSELECT term, tf_idf FROM c",
        "single_tf_idf_top300": single + "\n" + corpus_top,
        "tf_idf_by_union": single + "\nSELECT term, tf_idf FROM c",
        "score_against_snapshot": snapshot,
        "normalized_tags": tags + normalized,
        "stored_idf": stored + "\nSELECT term, df, round(idf, 6) AS idf FROM idf",
        "stored_normalized_tags": stored + tags.removeprefix(idf_) + normalized,
        "resent_batch_term_frequency": "WITH"
        + _term_cte("terms", pages_resent)
        + "\nSELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL",
        "resent_batch_raw_tags": _raw_cte(f"({pages_resent})") + "\nSELECT * FROM rawtags",
        "text_folder_term_frequency": "WITH"
        + _term_cte("terms", "SELECT source AS doc_id, text FROM documents")
        + "\nSELECT doc_id AS source, term, count(*) AS tf,"
        " (SELECT count(DISTINCT source) FROM documents) AS n FROM terms GROUP BY ALL",
        "raw_word_frequency": raw + "\nSELECT * FROM raw",
        "raw_word_top300": raw + "\nSELECT * FROM rawtags",
        "raw_tag_font_size": raw + "\n" + _font_size("freq", "rawtags"),
        "document_name": "SELECT doc_id, regexp_replace(concat(source, '.', doc_id, '.txt'),"
        r" '\.[^./]*$', '') AS doc_name FROM documents",
        "document_upsert": newest,
        "incremental_term_frequency": "WITH"
        + _term_cte("terms", delivered)
        + "\nSELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL",
        "incremental_raw_tags": _raw_cte(f"({delivered})") + "\nSELECT * FROM rawtags",
        "term_freq_table_roundtrip": tf_rows,
        "tsv_roundtrip": idf_ + "\nSELECT term, round(idf, 6) AS idf FROM idf",
        "single_tf_idf_roundtrip": single + "\nSELECT term, tf_idf FROM c",
        "tf_idf_table_roundtrip": once
        + "\nSELECT doc_id, term, round(tf_idf * 1000000)::BIGINT AS tf_idf_millionths FROM s",
        "corpus_term_frequency_of_text_files": corpus_tf_rows,
        "result_catalog": tags
        + ","
        + raw.removeprefix("WITH")
        + """
SELECT coalesce(r.doc_id, t.doc_id) AS doc_id, r.doc_id IS NOT NULL AS has_raw,
  t.doc_id IS NOT NULL AS has_normalized, r.doc_id || '.png' AS raw_name,
  t.doc_id || '-normalized.png' AS normalized_name
FROM (SELECT DISTINCT doc_id FROM rawtags) r
FULL JOIN (SELECT DISTINCT doc_id FROM tags) t ON r.doc_id = t.doc_id""",
        "stream_term_frequency": tf_rows,
        "stream_corpus_term_frequency": corpus_tf_rows,
        "stream_score_against_snapshot": snapshot,
    }
