import math
import random
import re

import numpy as np
import pytest
from llm_fixtures import texts  # noqa: F401

from termloom.llm import ranked_search
from termloom.llm.queries import op11_ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def slow_search(documents, queries, top=10):
    held = [(doc_id, terms(text)) for doc_id, text in documents]
    held = [(doc_id, words) for doc_id, words in held if words]
    n, length = len(held), sum(len(words) for _, words in held)
    df = {}
    for _, words in held:
        for word in set(words):
            df[word] = df.get(word, 0) + 1
    found = []
    for item_id, text in queries:
        scores = []
        for doc_id, words in held:
            m = 25 + (75 * len(words) * n) // length
            score = 0
            for word in terms(text):
                tf = words.count(word)
                if tf:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[word] + 1)))
                    score += w * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0))
        for rank, (score, known, doc_id) in enumerate(sorted(scores)[:top], 1):
            found.append((item_id, rank, doc_id if known else None, -score))
    return found


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((x is not None, x or 0) for x in row))


def random_texts(rng, n, vocabulary=40, longest=30):
    words = [f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(2000)]
    return [" ".join(rng.choices(words, k=rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_brute_force(spark, texts, seed):
    rng = random.Random(seed)
    documents = list(enumerate(random_texts(rng, 400)))
    documents += [(i, documents[3][1]) for i in range(500, 540)]  # ties
    documents += [(7, "w1 W1 É é"), (None, "w1 w2 w3"), (1, None), (2, ""), (3, "., !"), (9, "x " * 30_000 + "w5")]
    queries = list(enumerate(random_texts(rng, 25, longest=60)))
    queries += [(3, "É é W1"), (None, "w2 w2"), (90, None), (91, ""), (92, "unknown"), (93, documents[3][1] * 3)]
    found = ranked_search.search(
        texts(documents),
        spark.createDataFrame([(*q, "x", 1) for q in queries], "item_id bigint, text string, row string, rank int"),
        block_pairs=rng.choice([60, 10_000]),
        lot_postings=rng.choice([1, 300, 100_000]),
    )
    rows = [tuple(row) for row in found.collect()]
    assert ordered(rows) == ordered(slow_search(documents, queries))


def test_a_lot_is_not_read_to_its_end():
    """Few long documents hold both rare terms: their lists end early, the common one is cut off."""
    n = 200_000
    documents, common = np.arange(n), np.sort(np.random.default_rng(0).integers(1, 1000, n))[::-1]
    first = np.arange(0, 40)
    rare = (first, np.full(40, 100_000) - first)
    lot = ranked_search.Lot(np.arange(n), {0: rare, 1: (documents, common)})
    found, scores = lot.search(np.array([0, 1]), np.array([1, 1]), 10, 0)
    assert lot.reads < n / 10
    exact = np.zeros(n, int)
    exact[first] += rare[1]
    exact[documents] += common
    best = sorted(zip(scores.tolist(), found.tolist()), key=lambda x: (-x[0], x[1]))[:10]
    assert best == sorted(((s, d) for d, s in enumerate(exact.tolist())), key=lambda x: (-x[0], x[1]))[:10]
    lot.reads = 0
    assert not len(lot.search(np.array([1]), np.array([2]), 10, 5000)[0]) and lot.reads == 0


def test_terms_are_cut_and_lower_cased_in_ascii_only():
    text = "".join(map(chr, range(1, 0x250))) + " Straße İI 中文A1 \x85x x́"
    assert [t.decode() for t in ranked_search.terms_of(text)] == terms(text)


def test_no_documents_or_queries(spark, texts):
    some = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert ranked_search.search(texts([]), some).collect() == []
    assert ranked_search.search(texts([(1, "a")]), some.where("false")).collect() == []


def test_query_over_the_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    documents = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(row) for row in op11_ranked_search(spark, sf_dir).collect()]
    assert ordered(rows) == ordered(slow_search(documents, items))
