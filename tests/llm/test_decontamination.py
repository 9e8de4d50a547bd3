import random
import time

import pytest
from llm_fixtures import texts  # noqa: F401

from termloom.llm import decontamination


def slow_similarity(a, b):
    shared = sum(min(a.count(x), b.count(x)) for x in set(a))
    return shared / (len(a) + len(b) - shared)


def slow_leaks(documents, items):
    found = {}
    shingles = lambda words, k: [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    for doc_id, text in documents:
        for item_id, item in items:
            wanted = (item or "").lower().split()
            k = min(5, len(wanted))
            if not k:
                continue
            own, wanted = shingles((text or "").lower().split(), k), shingles(wanted, k)
            for start in range(max(1, len(own) - len(wanted) + 1)):
                similarity = slow_similarity(own[start : start + len(wanted)], wanted)
                if own and similarity >= 0.8 and similarity > found.get((doc_id, item_id), (0,))[0]:
                    found[doc_id, item_id] = similarity, start
    return {key: (round(s, 6), start) for key, (s, start) in found.items()}


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(99)) for _ in range(n))
    items = [(i, prose(rng.randint(20, 45))) for i in range(12)]
    items += [(20, "Two Words"), (21, None), (22, " "), (23, items[0][1]), (24, "ha " * 30)]
    documents = [(i, prose(60)) for i in range(20)]
    for i, (_, item) in enumerate(items[:12]):
        words = item.split()
        words[len(words) // 2] = "changed"
        documents.append((100 + i, f"{prose(15)} {item.upper()} {prose(10)}"))
        documents.append((200 + i, f"{prose(7)} {' '.join(words)} {prose(3)}"))
        documents.append((300 + i, " ".join(item.split()[:-1])))
    documents += [(400, "two words"), (401, ""), (402, None), (403, "ha ha " * 50)]
    return documents, items


def test_leaks_equal_brute_force(spark, texts, cases):
    documents, items = cases
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontamination.find_leaks(texts(documents), benchmark)
    got = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 6), r["first_word"]) for r in found.collect()}
    assert got == slow_leaks(documents, items)
    assert "Python" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_screen_that_lets_all_pass_and_removal(spark, texts, cases, monkeypatch):
    documents, items = cases
    monkeypatch.setattr(decontamination, "SCREEN_SLOTS", 1)
    benchmark = spark.createDataFrame(items[:14], "item_id bigint, text string")
    table = texts([*documents[:24], (None, items[0][1]), (None, "clean of all")])
    kept = decontamination.remove_leaks(table, benchmark)
    leaking = {doc_id for doc_id, _ in slow_leaks(documents[:24], items[:14])}
    assert kept.columns == table.columns
    expected = [str(i) for i, _ in documents[:24] if i not in leaking] + ["None"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(expected)


def test_no_documents_and_no_items(spark, texts):
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.find_leaks(texts([(1, "a")]), benchmark).collect() == []
    assert decontamination.remove_leaks(texts([(1, "a")]), benchmark).count() == 1


def test_repetitive_texts_and_long_items(spark, texts):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijkl", k=4)) for _ in range(n))
    long_item = prose(5000)
    words = long_item.split()
    words[2500:2520] = prose(20).split()
    changed = " ".join(words)
    items = [(1, "ha " * 30), (2, long_item), (3, "ho he " * 20), (4, prose(30))]
    documents = [
        (1, "ha " * 20_000),
        (2, f"{prose(300)} {changed} {prose(300)}"),
        (3, "x " + "ho he " * 2_000 + "ha " * 40),
        (4, prose(10) + " ha" * 2_000),
    ]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    started = time.time()
    found = decontamination.find_leaks(texts(documents), benchmark).collect()
    assert time.time() - started < 60
    got = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 6), r["first_word"]) for r in found}
    short = [(1, "ha " * 100), (3, "x " + "ho he " * 60 + "ha " * 40), (4, " ".join(documents[3][1].split()[:100]))]
    expected = slow_leaks(short, [items[0], items[2]])
    shift = {(3, 1): 2 * (2_000 - 60)}
    assert {key: got[key] for key in got if key[0] != 2} == {
        key: (s, start + shift.get(key, 0)) for key, (s, start) in expected.items()
    }
    # 24 of 4,996 shingles are others.
    assert got[2, 2] == (round(4972 / 5020, 6), 300)


def test_repeated_windows_left_out_change_nothing(spark, texts, monkeypatch):
    rng = random.Random(4)
    repeat = lambda words, n: " ".join((words * n)[:n])
    items = [(i, repeat([rng.choice("ab") for _ in range(period)], 30)) for i, period in enumerate([1, 2, 3, 5, 7])]
    documents = []
    for i in range(40):
        parts = [rng.choice(items)[1].split()[: rng.randint(5, 30)] * rng.randint(1, 6) for _ in range(4)]
        documents.append((i, " ".join(word for part in parts for word in part)))
    documents.append((99, "".join(f"{item} x " * 2 for _, item in items)))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    pruned = decontamination.find_leaks(texts(documents), benchmark).collect()
    monkeypatch.setattr(decontamination, "LOOK_BACK", 0)
    assert sorted(pruned) == sorted(decontamination.find_leaks(texts(documents), benchmark).collect())
    assert {row["item_id"] for row in pruned} == {0, 1, 2, 3, 4}


def test_a_million_repetitions(spark, texts):
    benchmark = spark.createDataFrame([(1, "ha " * 30), (2, "ho he " * 18 + "ho")], "item_id bigint, text string")
    documents = [(1, "ha " * 1_000_000), (2, "ho he " * 100_000)]
    started = time.time()
    found = decontamination.find_leaks(texts(documents), benchmark).collect()
    assert time.time() - started < 60
    assert sorted((r["doc_id"], r["item_id"], r["similarity"], r["first_word"]) for r in found) == [
        (1, 1, 1.0, 0),
        (2, 2, 1.0, 0),
    ]
