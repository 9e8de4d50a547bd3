import itertools
import time

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F
from llm_fixtures import texts  # noqa: F401

from termloom.llm import language


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return language.train(documents)


def test_paths_are_the_best(rng=np.random.default_rng(3)):
    scores = rng.normal(size=(6, 3)) * 3
    lengths = np.array([4, 0, 1, 6])
    words = rng.integers(0, 6, lengths.sum())
    found = language.best_paths(scores, words, lengths, penalty=2.0)
    at = 0
    for length in lengths:
        part = words[at : at + length]
        value = lambda path: sum(scores[w, p] for w, p in zip(part, path)) - 2.0 * sum(
            a != b for a, b in itertools.pairwise(path)
        )
        best = max(itertools.product(range(3), repeat=int(length)), key=value)
        assert value(best) == pytest.approx(value(tuple(found[at : at + length])))
        at += length


def test_held_out_accuracy(documents, model):
    held = documents.where(language.held_out(F.col("doc_id")))
    found = language.identify(held.select("doc_id", "text"), model)
    right = found.join(documents, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")))
    assert right.first()[0] > 0.95


def test_spans_and_odd_texts(texts, model):
    english = "and the this with that from have not which by are was for"
    french = "dans les des pour avec une elle sur par qui est que leur"
    rows = [(1, f"{english} {french}"), (2, None), (3, "12 +- ² !"), (4, ""), (None, english), (5, english * 9000)]
    found = {r["doc_id"]: r for r in language.identify(texts(rows), model).collect()}
    assert [s["lang"] for s in found[1]["spans"]] == ["en", "fr"]
    assert sum(s["n_words"] for s in found[1]["spans"]) == len(rows[0][1].split())
    assert 0.5 <= found[1]["score"] < 1
    for doc_id in (2, 3, 4):
        assert (found[doc_id]["lang_pred"], found[doc_id]["score"]) == ("und", 0.0)
    assert found[None]["lang_pred"] == found[5]["lang_pred"] == "en"
    kept = language.keep_identified(texts(rows), model)
    assert kept.columns == texts(rows).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "5", "None"]


def test_nothing_to_learn_from(documents, texts):
    model = language.train(documents.where("lang IS NULL"))
    assert [r["lang_pred"] for r in language.identify(texts([(1, "the")]), model).collect()] == ["und"]


def test_scripts_narrow(spark):
    rows = [(i, text, lang) for i in range(8) for text, lang in (("привет мир", "ru"), ("hello world", "en"))]
    model = language.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    table = spark.createDataFrame([(1, "жжжж"), (2, "zzzz")], "doc_id bigint, text string")
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(table, model).collect()}
    assert found == {1: "ru", 2: "en"}


def test_long_texts_walked_alone_have_the_same_path(monkeypatch):
    rng = np.random.default_rng(8)
    scores = np.maximum(rng.normal(size=(500, 5)) * 4 - 4, -8).astype("f4")
    lengths = np.array([3, 0, 700, 45_000, 2, 900])
    words = rng.integers(0, 500, lengths.sum())
    found = language.best_paths(scores, words, lengths)
    monkeypatch.setattr(language, "FEW_LANGUAGES", 0)
    assert (found == language.best_paths(scores, words, lengths)).all()


def test_a_very_long_text_takes_seconds(model):
    text = "and the this with dans les pour und der die " * 100_000
    started = time.process_time()
    (found,) = language.label_texts([text], language.WordScores(model))
    assert time.process_time() - started < 15
    assert sum(n for _, _, n in found.spans) == 1_000_000


def test_three_hundred_languages(spark):
    rng = np.random.default_rng(2)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    own = [["".join(rng.choice(letters, 5)) for _ in range(6)] for _ in range(300)]
    rows = [(i * 4 + copy, " ".join(own[i]), f"l{i:03d}") for i in range(300) for copy in range(4)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(table)
    assert len(model.languages) == 300
    asked = spark.createDataFrame([(i, " ".join(own[i] * 3), None) for i in range(300)], table.schema)
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(asked, model).collect()}
    assert sum(found[i] == f"l{i:03d}" for i in range(300)) >= 295


def test_an_empty_table_and_repeated_rows(texts, model):
    assert language.identify(texts([]), model).collect() == []
    found = language.identify(texts([(1, "the and with"), (1, "the and with")]), model).collect()
    assert len(found) == 2 and found[0] == found[1]
