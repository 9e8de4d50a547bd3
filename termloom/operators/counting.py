"""Term, document and raw word frequencies.

A document is one row, so its terms can be counted inside the row: sort the
tokens, find where each run of equal tokens starts, and take the distances
between the starts. That needs no shuffle, where grouping exploded tokens by
(document, term) would move several times the size of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import text
from termloom.functions.text import BLANKS, lines, raw_words, tokens

# A text of more bytes is cut before it is counted, so that no task has it alone.
LONG_TEXT = 8 * 1024 * 1024
# Where a text is cut: at the first blank within so many characters from its middle.
CUT_WINDOW = 65_536
# Tasks that the parts of long texts are dealt to, unless there are more shuffle partitions.
PART_TASKS = 64


def _runs_in_row(documents: DataFrame, key: str, words: Column) -> tuple[DataFrame, Column]:
    """Rows to work on, and the array of (term, count) of each as a column of them.

    The column is meant to be exploded as it is, for the reason given at `tokens`.
    """
    ordered = documents.select(key, F.sort_array(words).alias("words"))
    starts = F.transform(
        "words",
        lambda word, i: F.when((i == 0) | (F.get("words", i - 1) != word), i),
    )
    rows = ordered.select(key, "words", F.array_compact(starts).alias("starts"))

    def run(start: Column, i: Column) -> Column:
        following = F.coalesce(F.get("starts", i + 1), F.size("words"))
        return F.struct(
            F.get("words", start).alias("term"), (following - start).cast("bigint").alias("count")
        )

    return rows, F.transform("starts", run)


@dataclass(frozen=True)
class Shape:
    """What decides how documents are counted: rows with an id, different ids, and the
    bytes of the longest text."""

    rows: int
    ids: int
    longest: int = 0

    @classmethod
    def of(cls, documents: DataFrame, key: str = "doc_id") -> Shape:
        """In one pass, which shuffles ids only."""
        totals = [F.count(key), F.count_distinct(key)]
        if "text" in documents.columns:
            totals.append(F.coalesce(F.max(F.octet_length("text")), F.lit(0)))
        return cls(*documents.agg(*totals).first())

    @property
    def has_repeated_ids(self) -> bool:
        return self.ids < self.rows


def cut_texts(documents: DataFrame, longest: int = LONG_TEXT, key: str = "doc_id") -> DataFrame:
    """(document, part, text): texts of more than `longest` bytes in parts, others whole.

    A text is halved at white space near its middle, its halves likewise, until
    they are short enough. Neither tokens nor raw words reach over white space,
    so the parts have those of the text. A stretch without any is not cut.
    """
    whole = F.struct(F.col("part"), F.col("text"))
    middle = F.length("text").cast("int") / 2
    window = F.substr("text", middle.cast("int") + 1, F.lit(CUT_WINDOW))
    parts = documents.select(key, F.lit(1).cast("bigint").alias("part"), "text")
    # A string has at most 2^31 bytes.
    for _ in range(max(1, (2**31 // longest).bit_length())):
        # Its length in characters; positions of a match would count UTF-16 units.
        stretch = F.length(F.regexp_extract(window, f"^[^{BLANKS}]*", 0))
        cut = F.when(
            (F.octet_length("text") > longest) & (stretch < F.length(window)),
            middle.cast("int") + stretch + 1,
        )
        halves = F.array(
            F.struct((F.col("part") * 2).alias("part"), F.substr("text", F.lit(1), F.col("cut")).alias("text")),
            F.struct((F.col("part") * 2 + 1).alias("part"), F.substr("text", F.col("cut") + 1).alias("text")),
        )
        parts = parts.withColumn("cut", cut).select(
            key, F.inline(F.when(F.col("cut").isNull(), F.array(whole)).otherwise(halves))
        )
    return parts


def _counted_by_length(documents: DataFrame, longest: int, key: str, in_row, of_parts) -> DataFrame:
    """`in_row` of the texts of up to `longest` bytes and `of_parts` of the others' parts."""
    short = documents.where(F.octet_length("text") <= longest)
    long = cut_texts(documents.where(F.octet_length("text") > longest), longest, key)
    tasks = max(PART_TASKS, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return in_row(short).unionByName(of_parts(long.repartition(tasks, key, "part")))


def term_frequency_of(
    documents: DataFrame, longest_text: int, key: str = "doc_id", longest: int = LONG_TEXT
) -> DataFrame:
    """`term_frequency` where the longest text has `longest_text` bytes.

    Beyond `longest` such a text is counted by many tasks.
    """
    if longest_text <= longest:
        return term_frequency(documents, key)
    return _counted_by_length(
        documents,
        longest,
        key,
        lambda short: term_frequency(short, key),
        lambda parts: term_frequency_of_parts(parts, key),
    )


def raw_word_frequency_of(
    documents: DataFrame, longest_text: int, key: str = "doc_id", longest: int = LONG_TEXT
) -> DataFrame:
    """`raw_word_frequency` where the longest text has `longest_text` bytes."""
    if longest_text <= longest:
        return raw_word_frequency(documents, key)
    return _counted_by_length(
        documents,
        longest,
        key,
        lambda short: raw_word_frequency(short, key),
        lambda parts: raw_word_frequency_of_parts(parts, key),
    )


def raw_word_top_of(
    documents: DataFrame, k: int, longest_text: int, key: str = "doc_id", longest: int = LONG_TEXT
) -> DataFrame:
    """`raw_word_top` where the longest text has `longest_text` bytes."""
    if longest_text <= longest:
        return raw_word_top(documents, k, key)

    def top_of_parts(parts: DataFrame) -> DataFrame:
        order = Window.partitionBy(key).orderBy(F.col("freq").desc(), "term")
        ranked = raw_word_frequency_of_parts(parts, key).withColumn("rank", F.row_number().over(order))
        return ranked.where(F.col("rank") <= k)

    return _counted_by_length(
        documents, longest, key, lambda short: raw_word_top(short, k, key), top_of_parts
    )


def tokenize(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(document, term), one row per token."""
    return documents.select(key, F.explode(tokens("text")).alias("term"))


def document_lines(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(document, line number from 0, line)."""
    return documents.select(key, F.posexplode(lines("text")).alias("line_no", "line"))


def line_count(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(document, n_lines)."""
    return documents.select(key, text.line_count(F.col("text")).cast("bigint").alias("n_lines"))


def term_frequency(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(document, term, tf) for documents of one row each. No shuffle."""
    rows, runs = _runs_in_row(documents, key, tokens("text"))
    return rows.select(key, F.inline(runs).alias("term", "tf"))


def term_frequency_of_parts(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(document, term, tf) where a document may have many rows, such as lines.

    Each row is counted on its own first. The grouping key holds the term too,
    so a document with most of the rows still spreads over all tasks.
    """
    return term_frequency(parts, key).groupBy(key, "term").agg(F.sum("tf").alias("tf"))


def corpus_term_frequency(term_freq: DataFrame) -> DataFrame:
    """(term, tf) over all documents."""
    return term_freq.groupBy("term").agg(F.sum("tf").alias("tf"))


def document_frequency(term_freq: DataFrame) -> DataFrame:
    """(term, df). A term has one row per document, so rows are documents."""
    return term_freq.groupBy("term").agg(F.count("*").alias("df"))


def corpus_size(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row `n`. Counted on the documents: one without any token counts too."""
    return documents.agg(F.count_distinct(key).alias("n"))


def raw_word_frequency(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(document, term, freq) of raw words, for documents of one row each."""
    rows, runs = _runs_in_row(documents, key, raw_words("text"))
    return rows.select(key, F.inline(runs).alias("term", "freq"))


def raw_word_top(documents: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """(document, term, freq, rank) of the `k` most frequent raw words of each document.

    For documents of one row each: a row holds all there is to rank, so it is
    cut where it is, without a shuffle.
    """
    rows, runs = _runs_in_row(documents, key, raw_words("text"))
    descending = F.transform(runs, lambda run: F.struct((-run["count"]).alias("n"), run["term"]))
    top = F.slice(F.array_sort(descending), 1, k)
    return rows.select(key, F.posexplode(top).alias("position", "run")).select(
        key,
        F.col("run.term").alias("term"),
        (-F.col("run.n")).alias("freq"),
        (F.col("position") + 1).alias("rank"),
    )


def raw_word_frequency_of_parts(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(document, term, freq) of raw words where a document may have many rows."""
    return raw_word_frequency(parts, key).groupBy(key, "term").agg(F.sum("freq").alias("freq"))
