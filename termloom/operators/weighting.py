"""Inverse document frequencies and TF-IDF joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.weights import inverse_document_frequency, score
from termloom.operators.reducing import key_bitmap, may_hold

# The frequent terms of an IDF table may be broadcast up to this size. A row
# is charged its term and the fixed part of its hashed form.
BROADCAST_BYTES = 64 * 1024 * 1024
ROW_BYTES = 64


def idf(
    document_freq: DataFrame, size: DataFrame, include_corpus_document: bool = False
) -> DataFrame:
    """(term, df, idf) from (term, df) and the one-row corpus size.

    `include_corpus_document` counts the corpus as a whole as one document
    more, as on a run repeated over its own earlier output: N + 1 and df + 1.
    """
    extra = 1 if include_corpus_document else 0
    n = size.select("n").scalar() + extra
    return document_freq.select("term", (F.col("df") + extra).alias("df")).withColumn(
        "idf", inverse_document_frequency(n, F.col("df"))
    )


def split_frequent(
    idf_table: DataFrame, budget: int = BROADCAST_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Split an IDF table into frequent terms, within `budget` bytes, and the rest.

    Terms are classed by the number of bits of their df. As many of the upper
    classes are frequent as fit the budget together, by their true sizes. If a
    class no longer fits, the terms from it upward exceed the budget and have
    at least half its greatest df each, so a remaining term has at most
    2 * bytes / budget of all TF bytes: the rest can be shuffled by term
    without a hot key.
    """
    bits = F.length(F.bin("df"))
    classes = idf_table.groupBy(bits.alias("bits")).agg(
        F.sum(F.octet_length("term") + ROW_BYTES).alias("bytes")
    )
    # At most 63 rows are left, so one task may add them up.
    upward = Window.orderBy(F.col("bits").desc())
    fitting = classes.withColumn("total", F.sum("bytes").over(upward)).where(
        F.col("total") <= budget
    )
    lowest = fitting.agg(F.coalesce(F.min("bits"), F.lit(64))).scalar()
    return idf_table.where(bits >= lowest), idf_table.where(bits < lowest)


def tf_idf(
    term_freq: DataFrame, idf_table: DataFrame, budget: int = BROADCAST_BYTES
) -> DataFrame:
    """(document, term, tf, idf, tf_idf) of the terms a document holds.

    A term without IDF scores 0. Rows of frequent terms, nearly all of a
    corpus, meet their IDF by broadcast and stay where they are. Only rows of
    rare terms are shuffled, and hashed to their IDF, which is far the smaller
    side, instead of sorted. Both inputs are read by several branches: pass
    written tables.
    """
    frequent, rare = split_frequent(idf_table, budget)
    stay = term_freq.join(F.broadcast(frequent.select("term", "idf")), "term")
    move = term_freq.join(F.broadcast(frequent.select("term")), "term", "left_anti")
    moved = move.join(rare.select("term", "idf").hint("shuffle_hash"), "term", "left")
    return (
        stay.unionByName(moved)
        .select(
            *term_freq.columns,
            "idf",
            score(F.col("tf"), F.col("idf")).alias("tf_idf"),
        )
    )


def idf_of_terms(terms: DataFrame, idf_table: DataFrame) -> DataFrame:
    """(term, df, idf) of new documents' `terms` (term, df), with their IDF elsewhere.

    A term that `idf_table` lacks has IDF 0. The IDF of a large corpus is read
    and left where it is: only its rows that the new terms may need are joined.
    Each term comes to the join once, however many documents hold it, so no key
    of it is hot. With `tf_idf`, which then broadcasts the terms that are
    frequent in the new documents, these are scored at a cost that follows them
    and neither their hottest term nor the corpus. `terms` is read twice: pass a
    written table.
    """
    needed = may_hold(idf_table.select("term", "idf"), key_bitmap(terms, "term"), "term")
    return terms.join(needed, "term", "left").select(
        "term", "df", F.coalesce("idf", F.lit(0.0)).alias("idf")
    )


def corpus_tf_idf(term_freq: DataFrame, size: DataFrame) -> DataFrame:
    """(term, tf, df, idf, tf_idf) of the corpus as one document.

    Corpus TF and DF come from the same rows, so one grouping gives both and
    the join by term falls away.
    """
    n = size.select("n").scalar()
    return (
        term_freq.groupBy("term")
        .agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
        .withColumn("idf", inverse_document_frequency(n, F.col("df")))
        .withColumn("tf_idf", score(F.col("tf"), F.col("idf")))
    )


def single_tf_idf(one_document: DataFrame, idf_table: DataFrame) -> DataFrame:
    """(term, tf_idf) of one document (term, tf) over every term of both sides.

    A term of only one side scores 0. Both sides hold a term once.
    """
    return one_document.select("term", "tf").join(
        idf_table.select("term", "idf"), "term", "full_outer"
    ).select("term", score(F.col("tf"), F.col("idf")).alias("tf_idf"))


def single_tf_idf_by_union(one_document: DataFrame, idf_table: DataFrame) -> DataFrame:
    """`single_tf_idf` as a union grouped by term."""
    both = one_document.select("term", "tf").unionByName(
        idf_table.select("term", "idf"), allowMissingColumns=True
    )
    return (
        both.groupBy("term")
        .agg(F.max("tf").alias("tf"), F.max("idf").alias("idf"))
        .select("term", score(F.col("tf"), F.col("idf")).alias("tf_idf"))
    )


def dense_totals(
    scores: DataFrame, idf_table: DataFrame, documents: DataFrame, key: str = "doc_id"
) -> DataFrame:
    """(document, cells, zero_cells, tf_idf_sum) of the document x term matrix.

    Every document has a cell for every term of the vocabulary, 0 where it
    does not hold the term. The zeros are counted, never written out.
    """
    vocabulary = idf_table.agg(F.count("*")).scalar()
    held = scores.groupBy(key).agg(
        F.count_if(F.col("tf_idf") > 0).alias("positive"), F.sum("tf_idf").alias("tf_idf_sum")
    )
    return (
        documents.select(key)
        .distinct()
        .join(held, key, "left")
        .select(
            key,
            vocabulary.alias("cells"),
            (vocabulary - F.coalesce("positive", F.lit(0))).alias("zero_cells"),
            F.coalesce("tf_idf_sum", F.lit(0.0)).alias("tf_idf_sum"),
        )
    )
