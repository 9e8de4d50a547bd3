"""Quality rules: a table of thresholds compiled into one projection.

Measures are counted from the text by built-in functions, and every rule is a
ratio of measures with bounds. The rules become one condition each of a single
projection; nothing is shuffled and no user function runs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD_CHARACTER = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 3
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
PUNCTUATION = ".,;:!?\"'()"
STOP_WORDS = {
    "en": "the of and to in a is that for it as with on be at by this have from or was are not he his you all had but",
    "fr": "de la le et les des en un une que qui du pour dans sur pas au par est elle il avec ce plus ne se son sont ou",
    "de": "der die das und in zu den von mit ist nicht ein eine für auf im sich auch aus bei dem des es sie er als an wir",
    "es": "de la que el y en los se del las un por con una su para es al lo como más o pero sus le ha me si sin",
}

#: (name, numerator, denominator or None for 1, least or None, most or None)
RULES = (
    ("word_length", "word_chars", "n_words", 2.5, 11.0),
    ("symbols", "n_symbols", "n_words", None, 0.25),
    ("stop_words", "n_stop_words", "n_words", 0.06, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
)
MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_stop_words",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` names it.

    Unlike a named column it stays computed once when Spark moves a condition
    below the projection that names it.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text, in order; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda word: word != "")


def window_hashes(words: Column, window: int = WINDOW) -> Column:
    """A 64-bit hash of every window of words, in order."""

    def hashed(words: Column) -> Column:
        last = F.size(words) - window
        found = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(window)]),
        )
        return F.when(last >= 0, found).otherwise(F.array().cast("array<bigint>"))

    return let(words, hashed)


def covered_words(hashes: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window whose hash occurs twice or more.

    Hashes are sorted with their positions and those next to an equal one are
    kept. Windows in order of position overlap only with their neighbours, so
    the union of them is a sum: n log n for any text.
    """
    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def starts(a: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(a, k)["h"] == x["h"], F.lit(False))
        repeated = F.filter(a, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.array_sort(F.transform(repeated, lambda x: x["i"]))

    def union(s: Column) -> Column:
        step = lambda start, k: F.coalesce(start - F.get(s, k - 1), F.lit(window))
        added = F.transform(s, lambda start, k: F.least(F.lit(window), step(start, k)))
        return F.aggregate(added, F.lit(0), lambda total, n: total + n)

    return let(F.array_sort(placed), lambda a: let(starts(a), union))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of words that the text holds twice or more.

    Windows are compared by hash. Most texts repeat none, and their hashes are
    not sorted.
    """
    return let(
        window_hashes(words, window),
        lambda hashes: F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes), covered_words(hashes, window)
        ).otherwise(0),
    )


def measures(text: Column) -> Column:
    """A struct of the MEASURES of a text; a null text measures as the empty one.

    `n_words`, `word_chars` (code points in words), `n_symbols`, `n_stop_words`
    (lower-cased, outer punctuation off, of any language of the list), `n_lines`
    (line-feed separated, with a word), `n_dup_lines` (equal to an earlier one)
    and `n_repeat_words` (in three-word windows found twice or more).
    """
    text = F.coalesce(text, F.lit(""))
    stop_words = sorted({word for listed in STOP_WORDS.values() for word in listed.split()})
    plain = lambda word: F.lower(F.trim(word, F.lit(PUNCTUATION)))
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(WORD_CHARACTER)))

    def counted(words: Column) -> Column:
        values = (
            F.size(words),
            F.length(F.array_join(words, "")),
            F.regexp_count(text, F.lit(SYMBOL)),
            F.size(F.filter(words, lambda word: plain(word).isin(stop_words))),
            F.size(lines),
            let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))),
            repeated_words(words),
        )
        return F.struct(*[v.cast("bigint").alias(name) for v, name in zip(values, MEASURES)])

    return let(words_of(text), counted)


def base_failed(m: Column) -> Column:
    """Whether a text is too short or mostly repeats itself."""
    return (m["n_words"] < MIN_WORDS) | (
        100 * m["n_repeat_words"] > MAX_REPEATED_PERCENT * m["n_words"]
    )


def passes(m: Column, rules: Sequence[tuple] = RULES) -> Column:
    """Whether all rules of a threshold table hold for measures.

    Bounds are compared as products, so an empty text passes or fails without
    a division: a ratio over 0 counts as 0.
    """
    held = F.lit(True)
    for _, numerator, denominator, least, most in rules:
        below = m[denominator] if denominator else F.lit(1)
        if least is not None:
            held &= m[numerator] >= below * F.lit(float(least))
        if most is not None:
            held &= m[numerator] <= below * F.lit(float(most))
    return held


def judge(documents: DataFrame, rules: Sequence[tuple] = RULES) -> DataFrame:
    """(doc_id, measures, base_failed, kept) of every row of `documents` (doc_id, text).

    Null and empty texts have no words and are not kept. Repeated rows are
    judged each; other columns are not read.
    """
    m = F.col("m")
    return documents.select("doc_id", measures(F.col("text")).alias("m")).select(
        "doc_id",
        "m.*",
        base_failed(m).alias("base_failed"),
        (~base_failed(m) & passes(m, rules)).alias("kept"),
    )


def keep_good(documents: DataFrame, rules: Sequence[tuple] = RULES) -> DataFrame:
    """The rows of `documents` that `judge` keeps, with all their columns."""
    good = lambda m: ~base_failed(m) & passes(m, rules)
    return documents.where(let(measures(F.col("text")), good))
