"""Orders, top-k rankings and the tables made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.weights import font_size, ranking_score, truncated_weight

# Fixed value.
RANKING_SIZE = 300


def ordered_by_key(df: DataFrame, *keys: str) -> DataFrame:
    """A total order by key, over range partitions."""
    return df.orderBy(*keys)


def ordered_by_score(scores: DataFrame) -> DataFrame:
    """A total order, highest score first, equal scores by term."""
    return scores.orderBy(ranking_score(F.col("tf_idf")).desc(), "term")


def top_terms(scores: DataFrame, k: int = RANKING_SIZE) -> DataFrame:
    """The first `k` terms of one ranking, with their rank."""
    first = scores.withColumn("score", ranking_score(F.col("tf_idf")))
    first = first.orderBy(F.col("score").desc(), "term").limit(k)
    # At most k rows are left, so one task may number them.
    numbered = Window.orderBy(F.col("score").desc(), "term")
    return first.withColumn("rank", F.row_number().over(numbered)).drop("score")


def top_per_document(
    rows: DataFrame, order: Column, k: int = RANKING_SIZE, key: str = "doc_id"
) -> DataFrame:
    """The first `k` rows of each document, descending by `order`, then by term.

    The limit stands right on the rank, so each task cuts its own share to k
    rows per document before the shuffle. Spark does so while k is not above
    `spark.sql.optimizer.windowGroupLimitThreshold`, 1000 unless set.
    """
    ranking = Window.partitionBy(key).orderBy(order.desc(), "term")
    return rows.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k)


def top_by_score(
    scores: DataFrame, k: int = RANKING_SIZE, key: str = "doc_id", rounded: bool = False
) -> DataFrame:
    """Top `k` terms per document by TF-IDF.

    With `rounded` only (document, term, tf_idf, rank), the score at ranking precision:
    one number of each row is sorted, spilled and shuffled instead of two.
    """
    if rounded:
        ranked = scores.select(key, "term", ranking_score(F.col("tf_idf")).alias("tf_idf"))
        return top_per_document(ranked, F.col("tf_idf"), k, key)
    scored = scores.withColumn("score", ranking_score(F.col("tf_idf")))
    return top_per_document(scored, F.col("score"), k, key).drop("score")


def top_by_weight(scores: DataFrame, k: int = RANKING_SIZE, key: str = "doc_id") -> DataFrame:
    """Top `k` terms per document by whole-number weight."""
    weighted = scores.select(key, "term", truncated_weight(F.col("tf_idf")).alias("weight"))
    return top_per_document(weighted, F.col("weight"), k, key)


def top_raw_words(frequencies: DataFrame, k: int = RANKING_SIZE, key: str = "doc_id") -> DataFrame:
    """Top `k` raw words per document by frequency."""
    return top_per_document(frequencies, F.col("freq"), k, key)


def dense_top(
    scores: DataFrame,
    vocabulary: DataFrame,
    documents: DataFrame,
    k: int = RANKING_SIZE,
    key: str = "doc_id",
) -> DataFrame:
    """Top `k` of every document by weight over the whole vocabulary.

    A document with too few weighted terms is filled up with terms of weight
    0, in term order. Fewer than k weighted terms can stand in the way, so the
    first k terms of the vocabulary always suffice for filling, and the
    document x vocabulary grid is not needed.

    Every document has one more row, which ranks behind its weighted terms. In
    a document that has k of them it falls behind the cut; elsewhere it becomes
    the missing terms. So full documents pass as they are, in one shuffle.
    """
    first = vocabulary.select("term").orderBy("term").limit(k)
    pool = first.agg(F.array_sort(F.collect_list("term"))).scalar()
    # At most k rows, so one task may number them.
    places = first.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("place"))
    weighted = scores.select(key, "term", truncated_weight(F.col("tf_idf")).alias("weight"))
    filler = documents.select(key).distinct().select(
        key, F.lit(None).cast("string").alias("term"), F.lit(0).alias("weight")
    )
    rows = weighted.where("weight > 0").unionByName(filler)
    ranked = top_per_document(rows, F.col("weight"), k, key)
    # Places in the pool that a document's weighted terms hold: a few, or none.
    held = F.collect_list("place").over(Window.partitionBy(key))
    placed = ranked.join(F.broadcast(places), "term", "left").withColumn("held", held)
    free = F.array_except(F.transform("pool", lambda _, place: place), "held")
    missing = F.transform(
        F.slice(free, F.lit(1), k + 1 - F.col("rank")),
        lambda place, i: F.struct(
            F.get("pool", place).alias("term"), F.lit(0).alias("weight"), (F.col("rank") + i).alias("rank")
        ),
    )
    tags = F.when(F.col("term").isNull(), missing).otherwise(F.array(F.struct("term", "weight", "rank")))
    return placed.select(key, "term", "weight", "rank", "held", pool.alias("pool")).select(
        key, F.inline(tags)
    )


def with_font_size(tags: DataFrame, weight: str = "weight", key: str = "doc_id") -> DataFrame:
    """Tags with the size each is shown at within its document."""
    document = Window.partitionBy(key)
    smallest, largest = F.min(weight).over(document), F.max(weight).over(document)
    return tags.withColumn("font_size", font_size(F.col(weight), smallest, largest))


def tags_as_array(tags: DataFrame, key: str = "doc_id") -> DataFrame:
    """(document, tags): the terms of an already cut ranking, in rank order."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return tags.groupBy(key).agg(ranked.alias("ranked")).select(
        key, F.col("ranked.term").alias("tags")
    )


def normalized_tags(
    document_tags: DataFrame, corpus_tags: DataFrame, key: str = "doc_id"
) -> DataFrame:
    """Both rankings as one table (scope, document, term, weight, rank, font_size).

    `scope` tells documents and corpus apart; the corpus has document -1.
    """

    def shown(tags: DataFrame, scope: str) -> DataFrame:
        weighted = tags.withColumn("weight", truncated_weight(F.col("tf_idf")))
        return with_font_size(weighted, key=key).select(
            F.lit(scope).alias("scope"), key, "term", "weight", "rank", "font_size"
        )

    corpus = corpus_tags.withColumn(key, F.lit(-1).cast("bigint"))
    return shown(document_tags, "document").unionByName(shown(corpus, "corpus"))
