import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from termloom.operators import ranking
from termloom.plans.corpus import Corpus


def test_fewer_terms_than_asked_for(documents):
    tags = Corpus(documents({1: "apple apple pear", 2: "pear plum"})).tags()
    assert rows(tags, "doc_id", "rank", "term") == [
        (1, 1, "apple"),
        (1, 2, "pear"),
        (2, 1, "plum"),
        (2, 2, "pear"),
    ]


def test_ties_go_by_term(documents):
    corpus = Corpus(documents({1: "zeta alpha mid", 2: "other"}))
    assert [r.term for r in corpus.tags().where("doc_id = 1").orderBy("rank").collect()] == [
        "alpha",
        "mid",
        "zeta",
    ]
    top = ranking.top_terms(corpus.corpus_scores(), 3)
    assert rows(top, "rank", "term") == [(1, "alpha"), (2, "mid"), (3, "other")]


def test_orders_are_total(documents):
    corpus = Corpus(documents({i: f"same w{'x' * i} w{'y' * (i % 3)}" for i in range(30)}))
    keys = [(r.term, r.doc_id) for r in ranking.ordered_by_key(corpus.term_freq, "term", "doc_id").collect()]
    assert keys == sorted(keys)
    scores = [(-round(r.tf_idf, 6), r.term) for r in ranking.ordered_by_score(corpus.corpus_scores()).collect()]
    assert scores == sorted(scores)


def test_font_sizes(spark):
    tags = spark.createDataFrame(
        [(1, "a", 9), (1, "b", 4), (1, "c", 1), (2, "x", 7), (2, "y", 7), (3, "z", 0)],
        "doc_id bigint, term string, weight int",
    )
    assert rows(ranking.with_font_size(tags), "doc_id", "term", "font_size") == [
        (1, "a", 50.0),
        (1, "b", 29.0),
        (1, "c", 8.0),
        (2, "x", 50.0),
        (2, "y", 50.0),
        (3, "z", 50.0),
    ]


def test_arrays_keep_the_rank_order(spark):
    tags = spark.createDataFrame(
        [(1, "b", 2), (1, "c", 1), (1, "a", 10)], "doc_id bigint, term string, rank int"
    )
    assert ranking.tags_as_array(tags).collect()[0].tags == ["c", "b", "a"]


def test_normalized_tags_hold_documents_and_corpus(documents):
    found = Corpus(documents({1: "apple apple pear", 2: "pear plum"})).normalized_tags()
    assert rows(found.where("scope = 'corpus'"), "doc_id", "rank", "term") == [
        (-1, 1, "apple"),
        (-1, 2, "plum"),
        (-1, 3, "pear"),
    ]
    assert found.where("scope = 'document'").count() == 4


def test_truncated_weight(spark):
    from termloom.functions.weights import truncated_weight

    values = [(0.0,), (0.9999994,), (0.9999996,), (2.7,), (math.log(2) * 3,)]
    table = spark.createDataFrame(values, "s double").select(truncated_weight(F.col("s")).alias("w"))
    assert [r.w for r in table.collect()] == [0, 0, 1, 2, 2]


@pytest.mark.parametrize("words", ["", "a b c", "5 6 7"])
def test_raw_tags_of_documents_without_long_words(documents, words):
    assert Corpus(documents([words])).raw_tags().count() == 0


def test_raw_tags(documents):
    tags = Corpus(documents(["Wolf wolf. bear BEAR, (bear) ant lynx"])).raw_tags()
    assert rows(tags, "rank", "term", "freq") == [(1, "bear", 3), (2, "wolf", 2), (3, "lynx", 1)]
