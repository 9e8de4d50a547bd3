import random

import pytest
from llm_fixtures import texts  # noqa: F401

from termloom.llm import token_counts
from termloom.llm.queries import PIECES_PATH


def slow_best(word, scores):
    """Best (score, -tokens) over all segmentations."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = []
        for start in range(end):
            piece = word[start:end]
            if piece in scores:
                options.append((best[start][0] + scores[piece], best[start][1] - 1))
        if word[end - 1] not in scores:
            n = len(word[end - 1].encode())
            options.append((best[end - 1][0] + n * token_counts.BYTE_SCORE, best[end - 1][1] - n))
        best.append(max(options))
    return -best[-1][1]


@pytest.mark.parametrize("seed", range(20))
def test_trie_counts_as_every_segmentation_does(seed):
    rng = random.Random(seed)
    pick = lambda n: "".join(rng.choice("abcé") for _ in range(rng.randint(1, n)))
    scores = {pick(4): -rng.random() * 9 for _ in range(12)} | {"a": -5.0}
    trie = token_counts.CountingTrie(scores)
    words = {pick(9) for _ in range(60)}
    counts = trie.count_all(words)
    assert {word: counts[word] for word in words} == {word: slow_best(word, scores) for word in words}


def test_a_full_trie_begins_anew(monkeypatch):
    scores = token_counts.piece_scores(PIECES_PATH)
    words = [f"▁word{i}" for i in range(200)]
    whole = dict(token_counts.CountingTrie(scores).count_all(words))
    monkeypatch.setattr(token_counts, "MAX_NODES", 20)
    trie = token_counts.CountingTrie(scores)
    assert {w: trie.count_all([w])[w] for w in words} == whole


def test_counts_of_documents(texts):
    rows = [(1, "the  the\tthe\n"), (2, None), (3, ""), (None, "the"), (4, "the " * 200_000)]
    found = token_counts.count_tokens(texts(rows), PIECES_PATH).collect()
    counted = {row["doc_id"]: tuple(row)[1:] for row in found}
    assert counted == {
        1: (3, 3, 13),
        2: (0, 0, 0),
        3: (0, 0, 0),
        None: (1, 1, 3),
        4: (200_000, 200_000, 800_000),
    }
    assert token_counts.count_tokens(texts([]), PIECES_PATH).collect() == []


def test_long_words_count_alike_without_a_trie():
    rng = random.Random(3)
    scores = token_counts.piece_scores(PIECES_PATH)
    trie = token_counts.CountingTrie(scores)
    for n in (1, 2, 17, 199, 900):
        word = "▁" + "".join(rng.choice("theinanré中😀x1") for _ in range(n))
        assert trie.count_long(word) == trie.insert(word) == slow_best(word, scores)
    nodes = len(trie.children)
    word = "ab7é" * 50_000
    assert trie.count_all({word})[word] == 150_000 and len(trie.children) == nodes
    assert word not in trie.counts


def test_counts_stay_right_when_dropped(monkeypatch):
    scores = token_counts.piece_scores(PIECES_PATH)
    words = {f"▁word{i}" for i in range(200)}
    whole = token_counts.CountingTrie(scores).count_all(words)
    monkeypatch.setattr(token_counts, "MAX_WORDS", 3)
    monkeypatch.setattr(token_counts, "MAX_NODES", 20)
    trie = token_counts.CountingTrie(scores)
    for _ in range(2):
        assert trie.count_all(words) == whole
