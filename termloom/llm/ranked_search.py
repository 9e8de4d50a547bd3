"""Ranked lexical search by NRA: no random access, only reads in order of impact.

A term's occurrence in a document adds a whole-number impact to the document's score,
which depends on its frequency there, the document's length and the term's weight. For
every term of a query its documents are read from the highest impact downward. What was
read is a lower bound of a document's score; with the last impact read of each term it
has not been seen under, it is an upper bound. Reading goes on until no other document
can enter the first k, and every one that could has equal bounds, so that membership,
ties and scores are final.

Documents are counted into a table of terms once. Each task of the search holds some of
its documents at a time as impact-sorted lists of the queries' terms only, and carries
the k best of each query from one lot to the next: a lot whose highest impacts cannot
reach them is passed over. A task returns k rows a query, whatever it read.

Terms are runs of ASCII letters, digits and characters beyond ASCII; only A to Z are
lower-cased. Null and empty texts have none and are no documents. Rows that share an id
are documents, or queries, of their own. A null doc_id comes first among equal scores.
No documents, or a query without a known term: no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.batches import text_slices, texts_of
from termloom.session import materialize

# Fixed values of the ranking.
TOP = 10
IMPACT_SCALE = 1_000_000_000
FREQUENCY_WEIGHT = 1000
LENGTH_WEIGHT = 8
LENGTH_PERCENT = 75
WEIGHT_SCALE = 1000

#: Postings that a task holds at a time.
LOT_POSTINGS = 2_000_000
#: Entries read of each list at first; every round reads twice as many.
FIRST_READ = 64
#: (query, term) pairs that travel to the tasks at a time. More queries are dealt into
#: blocks of about so many, each searched over the table of terms.
BLOCK_PAIRS = 500_000

TERMS = "terms array<string>, tf array<int>"

#: Bytes to themselves in lower case, or to a blank where they belong to no term.
_BYTES = bytes(
    byte if byte >= 0x80 or chr(byte).isdigit() or chr(byte).islower()
    else byte + 32 if chr(byte).isupper() else 0x20
    for byte in range(256)
)


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode().translate(_BYTES).split()


def term_rows(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, terms, tf) of every row of (key, text) with a term; `n` counts repeats."""

    def count(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = [Counter(terms_of(text)) for text in texts_of(part, "text")]
                flat = pa.array([term for terms in found for term in terms], pa.binary())
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                times = pa.array([n for terms in found for n in terms.values()], pa.int32())
                columns = [
                    part.column("id"),
                    pa.array([terms.total() for terms in found], pa.int64()),
                    pa.ListArray.from_arrays(ends, flat.cast(pa.string())),
                    pa.ListArray.from_arrays(ends, times),
                ]
                counted = pa.RecordBatch.from_arrays(columns, ["id", "n", "terms", "tf"])
                yield counted.filter(pc.greater(counted.column("n"), 0))

    named = rows.select(F.col(key).cast("bigint").alias("id"), "text")
    counted = named.mapInArrow(count, f"id bigint, n bigint, {TERMS}")
    return counted.withColumnRenamed("id", key)


def weight(n_documents: int, document_frequency: int) -> int:
    """A term's weight, from doubles cut to a whole number."""
    return math.floor(
        WEIGHT_SCALE * math.log((2 * n_documents + 2) / (2 * document_frequency + 1))
    )


@dataclass
class Queries:
    """Queries over a vocabulary of weighted terms, and the corpus totals they score by."""

    vocabulary: list[str]
    weights: list[int]
    #: For each query the numbers of its terms and how often it holds each.
    terms: list[tuple[np.ndarray, np.ndarray]]
    n_documents: int
    n_terms: int
    top: int = TOP


@dataclass
class Lot:
    """Some documents, as a list for each term of (document, impact), highest impact first."""

    doc_ids: np.ndarray
    lists: dict[int, tuple[np.ndarray, np.ndarray]]
    reads: int = field(default=0)

    def search(self, terms: np.ndarray, times: np.ndarray, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that hold at least the `top` best of this lot, ties in full.

        A document that scores less than `floor`, or 0, may be left out.
        """
        held = [(self.lists[t], n) for t, n in zip(terms.tolist(), times.tolist()) if t in self.lists]
        lists = [(documents, impacts * n) for (documents, impacts), n in held]
        if not lists:
            return np.array([], np.int64), np.array([], np.int64)
        lower = np.zeros(len(self.doc_ids), np.int64)
        seen = np.zeros((len(lists), len(self.doc_ids)), bool)
        at, step = [0] * len(lists), FIRST_READ
        # The most that a document not seen yet in a list can get from it.
        frontier = np.array([impacts[0] for _, impacts in lists])
        threshold, others, wanted = max(floor, 1), True, np.ones(len(lists), bool)
        while True:
            if others and frontier.sum() < threshold:
                # None of the documents not seen at all can reach the first ones.
                others = False
            candidates = np.flatnonzero(lower)
            unseen = frontier @ ~seen[:, candidates]
            in_reach = lower[candidates] + unseen >= threshold
            candidates, unseen = candidates[in_reach], unseen[in_reach]
            if not others:
                if not unseen.any():
                    return candidates, lower[candidates]
                # A list is read on while it can say something about a candidate.
                wanted = ~seen[:, candidates].all(axis=1)
            for i in np.flatnonzero(wanted & (frontier > 0)):
                documents, impacts = lists[i]
                read = slice(at[i], at[i] + step)
                lower[documents[read]] += impacts[read]
                seen[i, documents[read]] = True
                at[i] += step
                self.reads += len(documents[read])
                frontier[i] = impacts[at[i] - 1] if at[i] < len(impacts) else 0
            step *= 2
            if len(lower) > top:
                threshold = max(threshold, int(np.partition(lower, -top)[-top]))


class Postings:
    """Gathers documents of one task into lots."""

    def __init__(self, queries: Queries):
        self.queries = queries
        self.vocabulary = pa.array(queries.vocabulary, pa.string())
        self.weights = np.array(queries.weights, np.int64)
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.doc_ids: list[int | None] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch) -> None:
        """Documents of (id, n, terms, tf), with their impacts."""
        terms = batch.column("terms")
        number = pc.index_in(terms.flatten(), self.vocabulary)
        known = pc.is_valid(number).to_numpy(zero_copy_only=False)
        term = number.drop_null().to_numpy().astype(np.int64)
        tf = batch.column("tf").flatten().to_numpy()[known].astype(np.int64)
        ends = terms.offsets.to_numpy()
        document = np.repeat(np.arange(batch.num_rows), np.diff(ends))[known]
        total, length = self.queries.n_documents, self.queries.n_terms
        # In whole numbers of any size: the product may exceed 64 bits on a large corpus.
        norms = np.array(
            [
                100 - LENGTH_PERCENT + LENGTH_PERCENT * n * total // length
                for n in batch.column("n").to_pylist()
            ],
            np.int64,
        )
        share = IMPACT_SCALE * tf // (FREQUENCY_WEIGHT * tf + LENGTH_WEIGHT * norms[document])
        impact = self.weights[term] * share
        some = impact > 0
        self.parts.append((term[some], document[some] + len(self.doc_ids), impact[some]))
        self.doc_ids += batch.column(0).to_pylist()
        self.size += int(some.sum())

    def lot(self) -> Lot:
        term, document, impact = (np.concatenate(column) for column in zip(*self.parts))
        order = np.lexsort((-impact, term))
        term, document, impact = term[order], document[order], impact[order]
        present, starts = np.unique(term, return_index=True)
        cuts = [*starts.tolist(), len(term)]
        lists = {
            t: (document[low:high], impact[low:high])
            for t, low, high in zip(present.tolist(), cuts, cuts[1:])
        }
        doc_ids = np.array(self.doc_ids, object)
        self.clear()
        return Lot(doc_ids, lists)


def best(found: list[tuple[int, int | None]], top: int) -> list[tuple[int, int | None]]:
    """The first `top` of (score, doc_id): highest scores, then ascending ids, null first."""
    return sorted(found, key=lambda row: (-row[0], row[1] is not None, row[1] or 0))[:top]


def search_task(batches, queries: Queries, lot_postings: int = LOT_POSTINGS):
    """(query, doc_id, score): the best of every query among the documents of one task."""
    postings = Postings(queries)
    kept: list[list[tuple[int, int | None]]] = [[] for _ in queries.terms]

    def search_lot() -> None:
        lot = postings.lot()
        for number, (terms, times) in enumerate(queries.terms):
            so_far = kept[number]
            floor = so_far[-1][0] if len(so_far) == queries.top else 0
            documents, scores = lot.search(terms, times, queries.top, floor)
            if len(documents):
                found = list(zip(scores.tolist(), lot.doc_ids[documents].tolist()))
                kept[number] = best(so_far + found, queries.top)

    for batch in batches:
        postings.add(batch)
        if postings.size >= lot_postings:
            search_lot()
    if postings.parts:
        search_lot()
    rows = [(number, doc_id, score) for number, found in enumerate(kept) for score, doc_id in found]
    columns = list(zip(*rows)) or [(), (), ()]
    kinds = [pa.int32(), pa.int64(), pa.int64()]
    arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds)]
    yield pa.RecordBatch.from_arrays(arrays, ["query", "doc_id", "score"])


def search(
    documents: DataFrame,
    queries: DataFrame,
    key: str = "item_id",
    top: int = TOP,
    block_pairs: int = BLOCK_PAIRS,
    lot_postings: int = LOT_POSTINGS,
) -> DataFrame:
    """(key, rank, doc_id, score): the `top` documents (doc_id, text) of every row of
    `queries` (key, text), whole texts on both sides, scores above 0."""
    spark = documents.sparkSession
    table = materialize(term_rows(documents, "doc_id"), "document_terms")
    totals = table.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    asked = materialize(
        term_rows(queries, key).withColumn("row", F.monotonically_increasing_id()), "query_terms"
    )
    words = asked.select(F.explode("terms").alias("term")).distinct()
    frequencies = (
        table.select(F.explode("terms").alias("term"))
        .join(words, "term", "left_semi")
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )
    frequencies = materialize(frequencies, "term_weights")
    pairs = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_blocks = -(-pairs // block_pairs)
    schema = f"{key} bigint, rank int, doc_id bigint, score bigint"
    results = []
    for block in range(n_blocks):
        mine = asked.where(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == block)
        results.append(_search_block(table, mine, frequencies, totals, key, top, lot_postings))
    if not results:
        return spark.createDataFrame([], schema)
    found = results[0]
    for other in results[1:]:
        found = found.unionByName(other)
    return found


def _search_block(table, asked, frequencies, totals, key, top, lot_postings) -> DataFrame:
    """`search` of the queries of one block, whose terms fit a task."""
    exploded = asked.select("row", key, F.inline(F.arrays_zip("terms", "tf")).alias("term", "times"))
    # About BLOCK_PAIRS rows.
    rows = exploded.join(frequencies, "term").collect()
    vocabulary = {}
    asking: dict[int, list] = {}
    for row in rows:
        number = vocabulary.setdefault(row["term"], (len(vocabulary), row["df"]))[0]
        asking.setdefault(row["row"], []).append((number, row["times"]))
    ids = {row["row"]: row[key] for row in rows}
    queries = Queries(
        list(vocabulary),
        [weight(totals["documents"], df) for _, df in vocabulary.values()],
        [tuple(np.array(column, np.int64) for column in zip(*terms)) for terms in asking.values()],
        totals["documents"],
        totals["terms"],
        top,
    )

    def task(batches):
        yield from search_task(batches, queries, lot_postings)

    found = table.mapInArrow(task, "query int, doc_id bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    spark = table.sparkSession
    # One row for each query of the block.
    names = spark.createDataFrame(
        list(enumerate(ids[row] for row in asking)), f"query int, {key} bigint"
    )
    return ranked.join(F.broadcast(names), "query").select(key, "rank", "doc_id", "score")
