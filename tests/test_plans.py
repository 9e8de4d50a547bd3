"""What the plans must not lose: pruning, narrow counting, partial limits."""

import pytest
from conftest import SF_DIR

from termloom.operators import counting, partitioning, ranking
from termloom.plans.corpus import Corpus


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def split_documents(documents):
    """A document table with splits enough, so that it is not divided again."""
    return documents.repartition(16, "doc_id")


def test_counting_adds_no_shuffle(split_documents):
    plan = physical(counting.term_frequency(split_documents))
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    assert "Aggregate" not in plan


def test_the_pattern_runs_once(documents):
    for df in (counting.tokenize(documents), counting.term_frequency(documents)):
        assert physical(df).count("regexp_extract_all") == 1


def test_only_needed_columns_are_read(documents):
    plan = physical(counting.term_frequency(documents))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "ReadSchema: struct<doc_id:bigint>" in physical(counting.corpus_size(documents))


def test_top_k_is_cut_before_the_shuffle(documents):
    corpus = Corpus(documents)
    for tags in (corpus.tags(), corpus.weighted_tags()):
        plan = physical(tags)
        assert "300, Partial" in plan and "300, Final" in plan
    assert "TakeOrderedAndProject(limit=300" in physical(
        ranking.top_terms(corpus.corpus_scores())
    )


def test_raw_words_are_ranked_without_a_shuffle(split_documents):
    plan = physical(Corpus(split_documents).raw_tags())
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


def test_frequent_terms_meet_by_broadcast(documents):
    plan = physical(Corpus(documents).scores)
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan


def test_only_small_tables_are_divided(spark, documents, monkeypatch):
    texts = documents.select("doc_id", "text")
    assert "REPARTITION_BY_NUM" in physical(partitioning.spread(texts))
    divided = sorted(counting.term_frequency(partitioning.spread(texts)).collect())
    monkeypatch.setattr(partitioning, "SMALL_TABLE_BYTES", 1000)
    assert "Exchange" not in physical(partitioning.spread(texts))
    assert sorted(counting.term_frequency(partitioning.spread(texts)).collect()) == divided


def test_one_number_of_each_score_is_shuffled(split_documents):
    corpus = Corpus(split_documents)
    for tags in (corpus.tags(rounded=True), corpus.normalized_tags()):
        plan = tags._jdf.queryExecution().optimizedPlan().toString()
        window = next(line for line in plan.splitlines() if "WindowGroupLimit" in line or "Window [row_number()" in line)
        assert "score#" not in window and "tf_idf#" in window
    rounded = {tuple(r) for r in corpus.tags(rounded=True).select("doc_id", "term", "rank").collect()}
    assert rounded == {tuple(r) for r in corpus.tags().select("doc_id", "term", "rank").collect()}


def test_rare_terms_are_hashed_not_sorted(split_documents):
    plan = physical(Corpus(split_documents).scores)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
