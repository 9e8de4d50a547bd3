"""Jobs over a corpus: frequencies first, then every weighting from them.

Counting terms is the costly step. A job that needs term frequencies in more
than one branch writes them once, as a table, and all branches read that.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import counting, ranking, weighting
from termloom.operators.partitioning import spread
from termloom.session import materialize
from termloom.sources.documents import list_text_documents, read_documents, read_text_folder
from termloom.sources.tables import CorpusTables


class Corpus:
    """A table (doc_id, text) and what derives from it.

    `texts` may hold the same rows divided otherwise, for the work on texts;
    questions about ids alone go to `documents`. With `in_parts` a document may
    have several rows in `texts`; without it the ids of `documents` tell. Texts of
    more than `longest` bytes are cut and counted by many tasks.
    """

    def __init__(
        self,
        documents: DataFrame,
        texts: DataFrame | None = None,
        in_parts: bool = False,
        longest: int = counting.LONG_TEXT,
    ):
        self.in_parts = in_parts
        self.longest = longest
        self.documents = documents
        self.texts = documents if texts is None else texts

    @classmethod
    def read(
        cls, spark: SparkSession, path: str, key: str = "doc_id", text: str = "text"
    ) -> Corpus:
        """The corpus of a Parquet table."""
        table = read_documents(spark, path, key, text)
        return cls(table, spread(table))

    @classmethod
    def read_text_folder(cls, spark: SparkSession, path: str, by_folder: bool = False) -> Corpus:
        """The corpus of a folder of text files. An empty file is a document too."""
        names = list_text_documents(spark, path, by_folder)
        return cls(names, read_text_folder(spark, path, by_folder), in_parts=True)

    @classmethod
    def stored(cls, tables: CorpusTables) -> Corpus:
        """The corpus of delivered documents, by their stored term frequencies.

        Nothing is tokenized again.
        """
        corpus = cls(tables.ids(), tables.documents())
        corpus.term_freq = corpus.term_freq_table = tables.term_frequency()
        return corpus

    @cached_property
    def shape(self) -> counting.Shape:
        """Rows, documents and the longest text."""
        return counting.Shape.of(self.documents)

    @property
    def has_parts(self) -> bool:
        """Whether some document has several rows, which must be added up."""
        return self.in_parts or self.shape.has_repeated_ids

    @cached_property
    def term_freq(self) -> DataFrame:
        """(doc_id, term, tf), computed by whoever reads it."""
        if self.has_parts:
            return counting.term_frequency_of_parts(self.texts)
        return counting.term_frequency_of(self.texts, self.shape.longest, longest=self.longest)

    @cached_property
    def raw_freq(self) -> DataFrame:
        """(doc_id, term, freq) of raw words."""
        if self.has_parts:
            return counting.raw_word_frequency_of_parts(self.texts)
        return counting.raw_word_frequency_of(self.texts, self.shape.longest, longest=self.longest)

    @cached_property
    def term_freq_table(self) -> DataFrame:
        """`term_freq`, written once."""
        return materialize(self.term_freq, "term_freq")

    @cached_property
    def size(self) -> DataFrame:
        """One row `n`."""
        spark = self.documents.sparkSession
        return spark.range(1).select(F.lit(self.shape.ids).cast("bigint").alias("n"))

    def idf(self, include_corpus_document: bool = False) -> DataFrame:
        """(term, df, idf) in one pass over the texts."""
        return weighting.idf(
            counting.document_frequency(self.term_freq), self.size, include_corpus_document
        )

    @cached_property
    def idf_table(self) -> DataFrame:
        """`idf`, from the written table of terms."""
        return self.term_table.select("term", "df", "idf")

    @cached_property
    def term_table(self) -> DataFrame:
        """(term, tf, df, idf, tf_idf) of the corpus, written once, in one grouping by term."""
        return materialize(weighting.corpus_tf_idf(self.term_freq_table, self.size), "terms")

    @cached_property
    def scores(self) -> DataFrame:
        """(doc_id, term, tf, idf, tf_idf) of all documents."""
        return weighting.tf_idf(self.term_freq_table, self.idf_table)

    def tags(self, rounded: bool = False) -> DataFrame:
        """Top terms of every document by TF-IDF; `rounded` as in `ranking.top_by_score`."""
        return ranking.top_by_score(self.scores, rounded=rounded)

    def weighted_tags(self) -> DataFrame:
        """Top terms of every document by whole-number weight."""
        return ranking.top_by_weight(self.scores)

    def dense_tags(self) -> DataFrame:
        """Top terms of every document over the whole vocabulary."""
        return ranking.dense_top(self.scores, self.idf_table, self.documents)

    def corpus_scores(self) -> DataFrame:
        """(term, tf, df, idf, tf_idf) of the corpus as one document."""
        return weighting.corpus_tf_idf(self.term_freq, self.size)

    def normalized_tags(self) -> DataFrame:
        """The full recompute: top terms of every document and of the corpus."""
        return ranking.normalized_tags(self.tags(rounded=True), ranking.top_terms(self.term_table))

    def document_scores(self, doc_id: int) -> DataFrame:
        """(term, tf_idf) of one document over the whole vocabulary, highest first."""
        one = self.term_freq_table.where(F.col("doc_id") == doc_id)
        return ranking.ordered_by_score(weighting.single_tf_idf(one, self.idf_table))

    def document_tags(self, doc_id: int) -> DataFrame:
        """Top terms of one document."""
        one = self.term_freq_table.where(F.col("doc_id") == doc_id)
        return ranking.top_terms(weighting.single_tf_idf(one, self.idf_table))

    def raw_tags(self) -> DataFrame:
        """Most frequent raw words of every document."""
        if self.has_parts:
            return ranking.top_raw_words(self.raw_freq)
        return counting.raw_word_top_of(
            self.texts, ranking.RANKING_SIZE, self.shape.longest, longest=self.longest
        )

    def score(self, new: Corpus) -> DataFrame:
        """TF-IDF of documents outside the corpus by its IDF; unknown terms score 0."""
        terms = materialize(counting.document_frequency(new.term_freq_table), "new_terms")
        known = weighting.idf_of_terms(terms, self.idf_table)
        return weighting.tf_idf(new.term_freq_table, materialize(known, "known_terms"))
