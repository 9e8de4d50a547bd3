import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from termloom.functions import text
from termloom.functions.text import lines, raw_words, tokens, without_extension
from termloom.operators import counting
from termloom.plans.corpus import Corpus

TOKENS = [
    ("don't stop", ["don't", "stop"]),
    ("well-known e.g.", ["well", "known", "e", "g"]),
    ("abc3 3rd", []),
    ("5,6", [","]),
    ("5;6", [";"]),
    ("a;b x,y", ["a;b", "x,y"]),
    ('"(foo)"', ["foo"]),
    ("1,abc", [",abc"]),
    ("5$ab", ["$ab"]),
    ("5,b,5", [",b,"]),
    ("a,5,b", ["a,", ",b"]),
    ("Übung größe l'été", ["übung", "größe", "l'été"]),
    ("foo\u00a0bar", ["foo\u00a0bar"]),
    ("baz\u2028qux", ["baz\u2028qux"]),
    ("a_b _x_ __", ["a_b", "_x_", "__"]),
    ("10€ €10", []),
    ("http://a.b/c?d=e&f", ["http", "a", "b/c?d=e&f"]),
    ("中文字,测试", ["中文字,测试"]),
    (".-: ", []),
    ("", []),
    ("e\u0301te\u0301", ["e\u0301te\u0301"]),
    (" \u0301x", ["\u0301x"]),
    ("one\ttwo\x0bthree\ffour\rfive\nsix", ["one", "two", "three", "four", "five", "six"]),
]

LINES = [
    ("", []),
    ("a", ["a"]),
    ("a\n", ["a"]),
    ("\n", [""]),
    ("a\n\n", ["a", ""]),
    ("a\r\nb\rc\nd", ["a", "b", "c", "d"]),
    ("\n\r\n\r", ["", "", ""]),
    ("a\r\n", ["a"]),
]


def applied(spark, texts, function):
    table = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = table.select("i", function("text").alias("x")).collect()
    return [r.x for r in sorted(found, key=lambda r: r.i)]


def test_tokens(spark):
    assert applied(spark, [t for t, _ in TOKENS], tokens) == [e for _, e in TOKENS]


def test_brute_force_tokens_agree_with_the_table():
    assert [brute.tokens(t) for t, _ in TOKENS] == [e for _, e in TOKENS]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="abÄé_'5,;.-: \n\t€\u00a0\u0301中", max_size=40), max_size=200))
def test_tokens_of_random_texts(spark, texts):
    assert applied(spark, texts, tokens) == [brute.tokens(t) for t in texts]


def test_lines(spark):
    assert applied(spark, [t for t, _ in LINES], lines) == [e for _, e in LINES]


def test_line_count_is_the_number_of_lines(spark):
    count = lambda name: text.line_count(F.col(name))
    assert applied(spark, [t for t, _ in LINES], count) == [len(e) for _, e in LINES]


def test_tokens_never_span_lines(spark):
    texts = [t for t, _ in TOKENS]
    by_line = applied(spark, texts, lambda c: F.flatten(F.transform(lines(c), tokens)))
    assert by_line == applied(spark, texts, tokens)


@pytest.mark.parametrize(
    "given_text, expected",
    [
        ("The quick, (brown) fox!", ["quick", "brown"]),
        ("e.g. http://ab.cd x\tYES! Yes-man", ["httpabcd", "yes-man"]),
        ("a" * 32 + " " + "b" * 33, ["a" * 32]),
        ("", []),
    ],
)
def test_raw_words(spark, given_text, expected):
    assert applied(spark, [given_text], raw_words) == [expected]


def test_only_the_last_extension_goes(spark):
    names = ["a.txt", "a.tar.gz", "plain", "dir.d/plain", ".hidden"]
    assert applied(spark, names, without_extension) == ["a", "a.tar", "plain", "dir.d/plain", ""]


def cut(spark, texts, longest):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    parts = counting.cut_texts(table, longest).collect()
    # Binary numbers of the halves, so those of a text sort as fractions.
    key = lambda row: (row["doc_id"], int(f"{row['part']:b}"[1:].ljust(64, "0"), 2))
    return [[r["text"] for r in sorted(parts, key=key) if r["doc_id"] == i] for i in range(len(texts))]


CUT_TEXTS = [
    "",
    "short",
    "one two  three\tfour\nfive\u00a0six é\u0301 😀 b😀c " * 40,
    "x" * 5000,
    " " * 3000,
    "a b " + "y" * 70_000 + " c d",
    "😀 " * 3000,
    "5,6 1,abc 3rd-abc3 \u0301x " * 50,
]


def test_cut_texts_are_whole_and_short(spark):
    for longest in (50, 1000):
        for text, parts in zip(CUT_TEXTS, cut(spark, CUT_TEXTS, longest)):
            assert "".join(parts) == text
            for before, after in zip(parts, parts[1:]):
                assert not before or before[-1] in "\t\n\x0b\f\r "
            blanks = [len(stretch.encode()) for stretch in re.split(r"(?<=[\t\n\x0b\f\r ])", text)]
            assert max(len(part.encode()) for part in parts) <= 2 * longest + max(blanks, default=0)
    assert 8 <= len(cut(spark, ["w " * 4000], 1000)[0]) <= 16


def test_cut_texts_count_as_whole_ones(spark):
    table = spark.createDataFrame(list(enumerate(CUT_TEXTS)), "doc_id bigint, text string")
    longest = max(len(text.encode()) for text in CUT_TEXTS)
    same = lambda one, other: one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()
    whole = counting.term_frequency(table)
    assert same(counting.term_frequency_of(table, longest, longest=60), whole)
    assert same(counting.raw_word_frequency_of(table, longest, longest=60), counting.raw_word_frequency(table))
    assert same(counting.raw_word_top_of(table, 3, longest, longest=60), counting.raw_word_top(table, 3))
    assert "cut" not in counting.term_frequency_of(table, longest)._jdf.queryExecution().toString()
    corpus = Corpus(table, longest=60)
    assert same(corpus.term_freq, whole) and same(corpus.raw_tags(), counting.raw_word_top(table, 300))


def test_one_text_is_counted_by_several_tasks(spark):
    table = spark.range(1).selectExpr("id AS doc_id", "repeat('one two three four ', 50000) AS text")
    parts = counting.cut_texts(table, 20_000).repartition(16, "doc_id", "part")
    assert parts.select(F.spark_partition_id()).distinct().count() > 8
    found = counting.term_frequency_of(table, 950_000, longest=20_000)
    assert sorted(map(tuple, found.collect())) == [(0, w, 50_000) for w in ("four", "one", "three", "two")]


def test_raw_words_lose_their_punctuation_without_a_look_at_each_character(documents):
    table = documents({1: '(Abc.d): "e;f,gh"? <i!jkl/> [kept] a^b-c& .:;()",?!<>/ Ä.ÖÜß\U0001f600', 2: "", 3: None})
    dropped = table.select("doc_id", F.explode(text.raw_words("text")).alias("word"))
    assert sorted(map(tuple, dropped.collect())) == [
        (1, "[kept]"), (1, "a^b-c&"), (1, "abcd"), (1, "efgh"), (1, "ijkl"), (1, "äöüß\U0001f600")
    ]
    assert "translate" not in dropped._jdf.queryExecution().optimizedPlan().toString()
