import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

import brute
from termloom.functions.weights import rounded
from termloom.operators import counting, ranking, weighting
from termloom.plans.corpus import Corpus

TWO = {1: "apple apple pear", 2: "pear plum"}
LN2 = math.log(2)


def approx(pairs):
    return [(*row[:-1], pytest.approx(row[-1])) for row in pairs]


def generated(n, vocabulary=60):
    """Documents over a small vocabulary with a term in all and skewed others."""
    return {
        i: " ".join(f"w{'x' * (j * j * (i + 3) % vocabulary)}" for j in range(i % 17)) + " common"
        for i in range(n)
    }


def test_counts_of_two_documents(documents):
    corpus = Corpus(documents(TWO))
    assert rows(corpus.term_freq, "doc_id", "term", "tf") == [
        (1, "apple", 2),
        (1, "pear", 1),
        (2, "pear", 1),
        (2, "plum", 1),
    ]
    assert rows(counting.document_frequency(corpus.term_freq), "term", "df") == [
        ("apple", 1),
        ("pear", 2),
        ("plum", 1),
    ]
    assert rows(corpus.idf(), "term", "idf") == approx(
        [("apple", LN2), ("pear", 0.0), ("plum", LN2)]
    )


def test_scores_of_two_documents(documents):
    corpus = Corpus(documents(TWO))
    assert rows(corpus.scores, "doc_id", "term", "tf_idf") == approx(
        [(1, "apple", 2 * LN2), (1, "pear", 0.0), (2, "pear", 0.0), (2, "plum", LN2)]
    )
    assert rows(corpus.corpus_scores(), "term", "tf", "tf_idf") == approx(
        [("apple", 2, 2 * LN2), ("pear", 2, 0.0), ("plum", 1, LN2)]
    )


def test_a_document_without_tokens_counts(documents):
    corpus = Corpus(documents({**TWO, 3: ""}))
    assert rows(corpus.size, "n") == [(3,)]
    assert rows(corpus.idf(), "term", "idf") == approx(
        [("apple", math.log(3)), ("pear", math.log(1.5)), ("plum", math.log(3))]
    )


def test_repeated_run(documents):
    corpus = Corpus(documents(TWO))
    assert rows(corpus.idf(include_corpus_document=True), "term", "df", "idf") == approx(
        [("apple", 2, math.log(1.5)), ("pear", 3, 0.0), ("plum", 2, math.log(1.5))]
    )


def test_stale_idf(documents):
    scores = Corpus(documents(TWO)).score(Corpus(documents({3: "apple kiwi"})))
    assert rows(scores, "doc_id", "term", "tf_idf") == approx([(3, "apple", LN2), (3, "kiwi", 0.0)])


def test_single_document_over_both_vocabularies(documents):
    idf = Corpus(documents(TWO)).idf()
    one = counting.corpus_term_frequency(counting.term_frequency(documents(["apple apple kiwi"])))
    expected = approx([("apple", 2 * LN2), ("kiwi", 0.0), ("pear", 0.0), ("plum", 0.0)])
    assert rows(weighting.single_tf_idf(one, idf), "term", "tf_idf") == expected
    assert rows(weighting.single_tf_idf_by_union(one, idf), "term", "tf_idf") == expected


def test_corpus_as_single_document(documents):
    corpus = Corpus(documents(generated(40)))
    one = counting.corpus_term_frequency(corpus.term_freq)
    by_join = weighting.single_tf_idf(one, corpus.idf())
    assert rows(by_join, "term", "tf_idf") == approx(
        rows(corpus.corpus_scores(), "term", "tf_idf")
    )


@pytest.mark.parametrize("budget", [1, 2_000, 5_000, weighting.BROADCAST_BYTES])
def test_scores_do_not_depend_on_the_broadcast_budget(documents, budget):
    texts = generated(60)
    corpus = Corpus(documents(texts))
    scores = weighting.tf_idf(corpus.term_freq_table, corpus.idf_table, budget)
    expected = [(*k, pytest.approx(v)) for k, v in sorted(brute.Model(texts).scores().items())]
    assert rows(scores, "doc_id", "term", "tf_idf") == expected


@pytest.mark.parametrize("budget", [1, 2_000, 5_000])
def test_frequent_terms_stay_within_the_budget(documents, budget):
    table = Corpus(documents(generated(60))).idf_table
    frequent, rare = weighting.split_frequent(table, budget)
    taken = frequent.agg(
        F.coalesce(F.sum(F.octet_length("term") + weighting.ROW_BYTES), F.lit(0))
    ).first()[0]
    assert taken <= budget
    assert frequent.count() + rare.count() == table.count()


def test_unknown_terms_score_zero_on_both_sides_of_the_split(documents):
    corpus = Corpus(documents(generated(60)))
    new = counting.term_frequency(documents({i: "common strange" for i in range(1000, 1100)}))
    scores = weighting.tf_idf(new, corpus.idf_table, 2_000)
    assert rows(scores.groupBy("term").agg(F.count("*"), F.max("tf_idf")), "*") == [
        ("common", 100, 0.0),
        ("strange", 100, 0.0),
    ]


def test_documents_of_many_rows(spark):
    lines = [(1, "apple apple"), (1, "pear"), (2, "pear plum"), (1, "apple")]
    parts = spark.createDataFrame(lines, "doc_id bigint, text string")
    expected = [(1, "apple", 3), (1, "pear", 1), (2, "pear", 1), (2, "plum", 1)]
    assert counting.Shape.of(parts).has_repeated_ids
    assert rows(Corpus(parts).term_freq, "doc_id", "term", "tf") == expected
    assert rows(Corpus(parts).size, "n") == [(2,)]


def test_line_by_line_counts_equal_whole_text_counts(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lines = counting.document_lines(documents).select("doc_id", F.col("line").alias("text"))
    by_line = counting.term_frequency_of_parts(lines)
    whole = counting.term_frequency(documents)
    assert by_line.exceptAll(whole).isEmpty() and whole.exceptAll(by_line).isEmpty()


def test_frequencies_add_up(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    corpus = Corpus(documents)
    total = corpus.term_freq.agg(F.sum("tf")).first()[0]
    assert total == counting.tokenize(documents).count()
    corpus_total = counting.corpus_term_frequency(corpus.term_freq).agg(F.sum("tf")).first()[0]
    assert corpus_total == total
    n = corpus.size.first()[0]
    low, high, smallest = corpus.idf().agg(F.min("df"), F.max("df"), F.min("idf")).first()
    assert 1 <= low <= high <= n and smallest >= 0


def test_dense_totals(documents):
    texts = {**generated(40), 99: ""}
    corpus = Corpus(documents(texts))
    totals = weighting.dense_totals(corpus.scores, corpus.idf_table, corpus.documents)
    grid = brute.Model(texts).dense()
    expected = []
    for doc in sorted(texts):
        cells = [s for (d, _), s in grid.items() if d == doc]
        expected.append((doc, len(cells), cells.count(0), pytest.approx(sum(cells))))
    assert rows(totals, "doc_id", "cells", "zero_cells", "tf_idf_sum") == expected


def test_one_document_of_the_corpus(documents):
    texts = generated(40)
    corpus = Corpus(documents(texts))
    row = {term: s for (doc, term), s in brute.Model(texts).dense().items() if doc == 7}
    expected = [(term, pytest.approx(s)) for term, s in sorted(row.items())]
    assert rows(corpus.document_scores(7), "term", "tf_idf") == expected
    top = [(7, r.term, r.rank) for r in corpus.document_tags(7).collect()]
    assert sorted(top) == brute.rank({(7, term): s for term, s in row.items()}, 300)


def test_raw_rankings_agree(spark, documents):
    corpus = Corpus(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    by_window = ranking.top_raw_words(corpus.raw_freq)
    assert by_window.exceptAll(corpus.raw_tags()).isEmpty()
    assert by_window.count() == corpus.raw_tags().count()
    lines = counting.document_lines(corpus.documents).select("doc_id", F.col("line").alias("text"))
    assert Corpus(lines).raw_tags().exceptAll(by_window).isEmpty()


@pytest.mark.parametrize("k", [1, 3, 8, 300])
def test_rankings_match_brute_force(documents, k):
    texts = {**generated(50), 99: ""}
    model = brute.Model(texts)
    corpus = Corpus(documents(texts))
    found = lambda df: rows(df, "doc_id", "term", "rank")
    assert found(ranking.top_by_score(corpus.scores, k)) == brute.rank(model.scores(), k)
    assert found(ranking.top_by_weight(corpus.scores, k)) == brute.rank(model.scores(), k, True)
    dense = ranking.dense_top(corpus.scores, corpus.idf_table, corpus.documents, k)
    assert found(dense) == brute.rank(model.dense(), k, True)


def test_an_unknown_term_on_every_document_meets_the_idf_once(documents):
    corpus = Corpus(documents(["apple", "pear plum"]))
    new = Corpus(documents({i: "kiwi apple" for i in range(40)}))
    terms = counting.document_frequency(new.term_freq_table)
    known = weighting.idf_of_terms(terms, corpus.idf_table)
    assert rows(known, "term", "df") == [("apple", 40), ("kiwi", 40)]
    found = corpus.score(new)
    assert found.count() == 80
    assert found.where("term = 'kiwi'").selectExpr("max(tf_idf)").first()[0] == 0
    small = weighting.tf_idf(new.term_freq_table, known, budget=0)
    assert sorted(small.collect()) == sorted(found.collect())


def test_a_document_of_many_megabytes(spark):
    text = " ".join(f"{word} common" for word in ("alpha", "beta", "gamma") * 300_000)
    table = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert rows(Corpus(table).term_freq, "term", "tf") == [
        ("alpha", 300_000),
        ("beta", 300_000),
        ("common", 900_000),
        ("gamma", 300_000),
    ]


@pytest.mark.parametrize("digits", [0, 6])
def test_rounded_is_round(spark, digits):
    ties = F.expr("(id - 2000) / 2 / power(10, id % 13)")
    near = ties * (1 + (F.col("id") % 5 - 2) * 2.0**-52)
    spread = F.rand(7) * F.expr("power(10, id % 25 - 8)")
    odd = spark.createDataFrame(
        [(x,) for x in (None, 0.0, -0.0, float("nan"), float("inf"), -float("inf"), 1e300, 5e-324)], "x double"
    )
    numbers = spark.range(20_000)
    for x in (ties, near, spread, -spread):
        odd = odd.unionByName(numbers.select(x.cast("double").alias("x")))
    same = rounded(F.col("x"), digits).eqNullSafe(F.round("x", digits))
    assert odd.where(~same).collect() == []


def test_few_scores_are_rounded_by_text(spark):
    score = spark.range(100_000).select((F.ln(F.col("id") + 2) * 3).alias("x"))
    raised = F.col("x") * 1e6 + 0.5
    plan = score.select(rounded(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan
    assert score.where(F.abs(raised - F.round(raised)) <= 1e-3).count() < 1000
