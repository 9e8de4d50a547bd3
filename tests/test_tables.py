import glob

import pytest
from conftest import rows
from pyspark.sql import functions as F

from termloom.operators import counting, ranking, reducing, replacing, weighting
from termloom.plans.corpus import Corpus
from termloom.session import materialize, scratch_path
from termloom.sources import tables
from termloom.sources.documents import list_files, read_documents, read_text_folder

TERM_FREQ = "doc_id bigint, term string, tf bigint"


@pytest.fixture
def store(spark):
    return tables.CorpusTables(spark, scratch_path(spark, "test_store"))


def test_a_batch_replaces_itself_only(spark, documents):
    path = scratch_path(spark, "test_batches")
    first = counting.term_frequency(documents({1: "apple pear"}))
    second = counting.term_frequency(documents({2: "plum"}))
    tables.write_batch(first, path, 0)
    tables.write_batch(second, path, 1)
    tables.write_batch(first, path, 0)
    assert rows(tables.read_batches(spark, path, TERM_FREQ), "batch_id", "term", "tf") == [
        (0, "apple", 1),
        (0, "pear", 1),
        (1, "plum", 1),
    ]


def test_an_emptied_batch_leaves_nothing(store, documents):
    store.deliver(documents({1: "apple", 2: "pear"}), 0)
    store.deliver(documents({1: "123"}), 0)
    assert rows(store.documents(), "doc_id", "text") == [(1, "123")]
    assert rows(store.term_frequency(), "term") == [] and rows(store.raw_tags(), "term") == []


def test_a_batch_that_is_not_listed_is_not_read(store, documents):
    store.deliver(documents({1: "apple"}), 0)
    tables.write_batch(counting.term_frequency(documents({2: "pear"})), store.term_freq_path, 1)
    assert rows(store.term_frequency(), "doc_id", "term", "tf") == [(1, "apple", 1)]


def test_results_of_stored_tables(store, documents):
    store.deliver(documents({1: "apple apple pear", 2: "old words"}), 0)
    store.deliver(documents({2: "pear plum", 3: ""}), 1)
    corpus = Corpus.stored(store)
    direct = Corpus(documents({1: "apple apple pear", 2: "pear plum", 3: ""}))
    store.store_results(corpus.idf_table, corpus.normalized_tags())
    assert rows(store.idf(), "*") == rows(direct.idf(), "*")
    assert rows(store.tags(), "*") == rows(direct.normalized_tags(), "*")
    assert rows(store.catalog(), "doc_id", "has_raw", "has_normalized") == [
        (1, True, True),
        (2, True, True),
    ]
    for df in (corpus.idf_table, corpus.normalized_tags(), store.catalog()):
        assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_whole_table_is_replaced(spark, documents):
    path = scratch_path(spark, "test_idf")
    tables.write_table(Corpus(documents(["apple", "pear"])).idf(), path)
    tables.write_table(Corpus(documents(["plum"])).idf(), path)
    assert rows(spark.read.parquet(path), "term", "df", "idf") == [("plum", 1, 0.0)]


def test_delimited_text_keeps_quotes_and_backslashes(spark):
    path = scratch_path(spark, "test_tsv")
    terms = [('"', 1.5), ("\\", 2.0), ("a\\tb", 0.0), ("l'été", 3.25), ('x,"y"', 1e-7)]
    tables.write_delimited(spark.createDataFrame(terms, "term string, idf double"), path)
    assert rows(tables.read_delimited(spark, path, "term", "idf"), "term", "idf") == sorted(terms)


def test_delimited_text_without_rows_and_with_bad_numbers(spark):
    empty, bad = scratch_path(spark, "test_tsv"), scratch_path(spark, "test_tsv")
    tables.write_delimited(spark.createDataFrame([], "term string, idf double"), empty)
    assert tables.read_delimited(spark, empty, "term", "idf").count() == 0
    spark.createDataFrame([("a\tnone",), ("b",)], "value string").write.text(bad)
    assert rows(tables.read_delimited(spark, bad, "term", "idf"), "term", "idf") == [
        ("a", None),
        ("b", None),
    ]


def test_ranked_text_descends_over_all_files(spark, documents):
    path = scratch_path(spark, "test_ranked")
    texts = {i: " ".join(f"w{'x' * j}" for j in range(i)) for i in range(1, 20)}
    scores = Corpus(documents(texts)).corpus_scores()
    tables.write_ranked(scores, path)
    written = []
    for name in sorted(glob.glob(f"{path}/part-*")):
        with open(name, encoding="utf-8") as lines:
            written += [line.rstrip("\n").split("\t") for line in lines]
    keys = [(-round(float(score), 6), term) for score, term in written]
    assert len(written) == scores.count() and keys == sorted(keys)
    back = tables.read_delimited(spark, path, "term", "tf_idf", number_first=True)
    assert back.exceptAll(scores.select("term", "tf_idf")).isEmpty()


def test_all_scores_are_written_in_key_order(spark, documents):
    path = scratch_path(spark, "test_all")
    corpus = Corpus(documents({i: f"same w{'x' * i}" for i in range(1, 30)}))
    tables.write_all_tf_idf(corpus.scores, path)
    stored = spark.read.parquet(path)
    assert stored.count() == corpus.scores.count()
    keys = []
    for name in sorted(glob.glob(f"{path}/part-*")):
        part = spark.read.parquet(name).select("doc_id", "term").toPandas()
        keys += list(part.itertuples(index=False, name=None))
    assert keys == sorted(keys)


def test_text_folder(spark, documents):
    path = scratch_path(spark, "test_texts")
    table = spark.createDataFrame([("apple apple\npear",), ("plum",)], "value string")
    table.repartition(1).write.text(path)
    found = Corpus(read_text_folder(spark, f"{path}/*.txt")).term_freq
    assert rows(found, "term", "tf") == [("apple", 2), ("pear", 1), ("plum", 1)]
    assert not found.where(F.col("doc_id").contains(".txt")).count()
    assert found.select("doc_id").distinct().count() == 1


def test_an_empty_text_file_is_a_document(spark, tmp_path):
    for name, text in (("a", "apple"), ("b", "pear"), ("empty", "")):
        (tmp_path / f"{name}.txt").write_text(text)
    corpus = Corpus.read_text_folder(spark, str(tmp_path))
    assert rows(corpus.size, "n") == [(3,)]
    assert rows(corpus.documents, "doc_id") == [("a",), ("b",), ("empty",)]
    assert rows(corpus.term_freq, "doc_id", "term", "tf") == [("a", "apple", 1), ("b", "pear", 1)]


def test_delimited_text_keeps_fields_apart(spark):
    path = scratch_path(spark, "test_tsv")
    table = spark.createDataFrame([("apple", None), (None, 1.0)], "term string, idf double")
    tables.write_delimited(table, path)
    back = tables.read_delimited(spark, path, "term", "idf")
    assert sorted(back.collect(), key=str) == [("", 1.0), ("apple", None)]
    with pytest.raises(Exception, match="a tab or a line break"):
        bad = spark.createDataFrame([("a\tb", 1.0)], "term string, idf double")
        tables.write_delimited(bad, scratch_path(spark, "test_tsv"))


def test_redelivery_replaces_the_document(store, documents):
    store.deliver(documents({1: "apple apple pear", 2: "pear"}), 0)
    store.deliver(documents({1: "plum", 3: "fig"}), 1)
    expected = [(1, "plum", 1), (2, "pear", 1), (3, "fig", 1)]
    assert rows(store.term_frequency(), "doc_id", "term", "tf") == expected
    store.deliver(documents({1: "plum", 3: "fig"}), 1)
    assert rows(store.term_frequency(), "doc_id", "term", "tf") == expected
    assert rows(store.documents(), "doc_id", "text") == [(1, "plum"), (2, "pear"), (3, "fig")]
    tags = [(1, "plum", 1, 1), (2, "pear", 1, 1)]
    assert rows(store.raw_tags(), "doc_id", "term", "freq", "rank") == tags


def test_a_text_without_tokens_replaces_too(store, documents):
    store.deliver(documents({1: "apple", 2: "pear"}), 0)
    store.deliver(documents({1: "123"}), 1)
    assert rows(store.term_frequency(), "doc_id", "term", "tf") == [(2, "pear", 1)]
    assert rows(Corpus(store.documents()).size, "n") == [(2,)]


def test_a_document_twice_in_one_delivery(spark, store):
    twice = spark.createDataFrame(
        [(1, "old words", 1), (1, "new", 2), (2, "pear", 1)],
        "doc_id bigint, text string, version int",
    )
    store.deliver(twice, 0, "version")
    assert rows(store.term_frequency(), "doc_id", "term", "tf") == [(1, "new", 1), (2, "pear", 1)]


def test_many_superseded_versions_without_broadcast(spark, documents, store, monkeypatch):
    monkeypatch.setattr(replacing, "BROADCAST_PAIRS", 0)
    store.deliver(documents({i: "old" for i in range(50)}), 0)
    store.deliver(documents({i: "new" for i in range(0, 50, 2)}), 1)
    found = store.term_frequency().groupBy("term").count()
    assert rows(found, "term", "count") == [("new", 25), ("old", 25)]


def test_newest_breaks_ties_by_the_other_columns(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "z"), (1, 3, "a", "x"), (1, 3, "b", "c"), (2, 5, "user", "only")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    found = replacing.newest(turns, "conv_id", "turn", "role", "text")
    assert found.columns == turns.columns
    assert rows(found, "*") == [(1, 3, "b", "c"), (2, 5, "user", "only")]


def test_document_names(spark):
    table = spark.createDataFrame([(7, "web.v2"), (8, "mail")], "doc_id bigint, source string")
    assert rows(replacing.document_names(table), "doc_id", "doc_name") == [
        (7, "web.v2.7"),
        (8, "mail.8"),
    ]


def test_catalog(store, documents):
    store.deliver(documents({1: "apple", 2: "fig", 3: "12345", 4: ""}), 0)
    corpus = Corpus.stored(store)
    store.store_results(corpus.idf_table, corpus.normalized_tags())
    found = store.catalog()
    assert rows(found, "doc_id", "has_raw", "has_normalized", "raw_name", "normalized_name") == [
        (1, True, True, "1.png", "1-normalized.png"),
        (2, False, True, None, "2-normalized.png"),
        (3, True, False, "3.png", None),
    ]


def test_scratch_follows_the_session_setting(spark):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = scratch_path(spark, "somewhere")
    assert path != scratch_path(spark, "somewhere")
    if base:
        assert path.startswith(base)


def test_reading_takes_two_columns(spark):
    table = read_documents(spark, "/root/testdata/sf0.001/pages.parquet", "page_id", "html")
    assert table.columns == ["doc_id", "text"]
    assert ranking.RANKING_SIZE == 300


class Stopped(Exception):
    pass


@pytest.mark.parametrize("written", [1, 2, 3, 4])
def test_a_resend_that_stops_half_way_changes_nothing(store, documents, monkeypatch, written):
    store.deliver(documents({1: "apple", 2: "pear"}), 0)
    store.deliver(documents({2: "plum plum"}), 1)

    def state():
        parts = (store.documents(), store.term_frequency(), store.raw_tags(), store.ids())
        return [sorted(map(tuple, part.collect())) for part in parts]

    before, planned = state(), store.term_frequency()
    paths = iter([tables.attempt_path] * written)

    def attempt_path(*place):
        """Fails once so many tables are written."""
        try:
            return next(paths)(*place)
        except StopIteration:
            raise Stopped from None

    def add(*commit):
        raise Stopped

    with monkeypatch.context() as patch:
        patch.setattr(tables, "attempt_path", attempt_path)
        patch.setattr(store.commits, "add", add)
        with pytest.raises(Stopped):
            store.deliver(documents({3: "fig"}), 1)
    assert state() == before
    store.deliver(documents({3: "fig"}), 1)
    assert rows(store.documents(), "doc_id", "text") == [(1, "apple"), (2, "pear"), (3, "fig")]
    # A reader that planned before the new attempt finishes with the former one.
    assert sorted(map(tuple, planned.collect())) == before[1]


def test_compaction_keeps_results_and_reads_fewer_files(store, documents):
    for batch in range(6):
        store.deliver(documents({i: f"word{'abcdef'[batch]} same" for i in range(batch, 20, 3)}), batch)
    tables_of = lambda: (store.documents(), store.term_frequency(), store.raw_tags(), store.ids())
    state = lambda: [sorted(map(tuple, part.collect())) for part in tables_of()]
    before, files = state(), len(store._rows("term_freq", store.commits.batches()).inputFiles())
    store.compact()
    assert state() == before
    live = store.commits.batches()
    assert [(c.first_batch, c.last_batch) for c in live] == [(0, 4), (5, 5)]
    held = store._rows("term_freq", live)
    assert len(held.inputFiles()) < files
    # Superseded rows are gone, but for those that only the open batch replaces.
    assert held.where("batch_id = 4").select("doc_id").distinct().count() == 20
    assert held.where("batch_id = 4").count() == 40
    store.compact()
    assert store.commits.batches() == live
    store.deliver(documents({0: "again"}), 5)
    store.deliver(documents({1: "last"}), 6)
    for batch in (0, 2, 4):
        with pytest.raises(ValueError, match="compacted"):
            store.deliver(documents({0: "late"}), batch)
    after = state()
    assert (0, "again", 1) in after[1] and (1, "last", 1) in after[1] and len(after[3]) == 20
    store.compact(keep_newest=0)
    assert state() == after and len(store.commits.batches()) == 1


def test_tables_without_any_delivery(store):
    assert store.term_frequency().collect() == [] and store.ids().collect() == []
    with pytest.raises(LookupError):
        store.idf()
    store.compact()


def test_results_are_replaced_together(store, documents):
    store.deliver(documents({1: "apple pear", 2: "pear"}), 0)
    first = Corpus.stored(store)
    store.store_results(first.idf_table, first.normalized_tags())
    former = store.tags()
    expected = rows(former, "*")
    second = Corpus(documents({1: "plum"}))
    store.store_results(second.idf_table, second.normalized_tags())
    assert rows(store.idf(), "term") == [("plum",)] and rows(former, "*") == expected


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_few_terms_read_their_buckets_only(spark, documents):
    idf = Corpus(documents({i: f"w{'x' * i} same" for i in range(1, 60)})).idf_table
    stored = tables.IdfTable(spark, scratch_path(spark, "test_idf"))
    stored.write(idf, buckets=32)
    assert rows(stored.read(), "*") == rows(idf, "*")
    asked = spark.createDataFrame([("same",), ("unknown",)], "term string")
    found = stored.of_terms(asked)
    assert "PartitionFilters: [bucket" in plan_of(found)
    read = {row["f"] for row in found.select(F.input_file_name().alias("f")).collect()}
    assert 1 <= len(read) <= 2
    assert rows(found.where("term = 'same'"), "term") == [("same",)]
    stored.write(idf.limit(0))
    assert stored.read().collect() == [] and stored.of_terms(asked).collect() == []


def test_terms_are_scored_without_moving_the_idf(spark):
    idf = spark.range(200_000).selectExpr("concat('t', id) AS term", "1L AS df", "id * 1.0D AS idf")
    path = scratch_path(spark, "test_large_idf")
    idf.write.parquet(path)
    terms = spark.createDataFrame([("t5", 2), ("t199999", 1), ("new", 3)], "term string, df bigint")
    known = weighting.idf_of_terms(terms, spark.read.parquet(path))
    assert rows(known, "term", "df", "idf") == [("new", 3, 0.0), ("t199999", 1, 199999.0), ("t5", 2, 5.0)]
    # The rows of the IDF meet the bitmap where they are read, and few are left behind it.
    lines = plan_of(known).splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "idf" in line)
    above = [line for line in lines[:scan] if "Exchange" in line or "LeftSemi" in line]
    assert "LeftSemi" in above[-1]
    near = reducing.may_hold(spark.read.parquet(path), reducing.key_bitmap(terms, "term"), "term")
    assert near.count() < 20
    assert "Exchange hash" not in plan_of(near).split("BroadcastExchange")[0]


def test_bitmap_holds_all_keys(spark):
    keys = spark.range(5000).selectExpr("nullif(id, 7) AS a", "concat('k', id % 50) AS b")
    found = reducing.may_hold(keys, reducing.key_bitmap(keys.where("a % 2 = 0 OR a IS NULL"), "a", "b"), "a", "b")
    assert 2500 <= found.count() < 2600 and found.where("a IS NULL").count() == 1


def test_newest_moves_no_text_for_its_decision(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "z"), (1, 3, "a", "x"), (None, None, "b", "c"), (None, None, "b", "d"),
         (2, None, "user", "v"), (2, 1, "user", "w"), (3, None, "user", "v")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    found = replacing.newest(turns, "conv_id", "turn", "role", "text")
    expected = [(1, 3, "a", "x"), (2, 1, "user", "w"), (3, None, "user", "v"), (None, None, "b", "d")]
    assert sorted(map(tuple, found.collect()), key=lambda r: (r[0] is None, r[0])) == expected
    path = scratch_path(spark, "test_turns")
    turns.write.parquet(path)
    written = []
    def spy(df, name):
        written.append(plan_of(df))
        return materialize(df, name)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(replacing, "materialize", spy)
        replacing.newest(spark.read.parquet(path), "conv_id", "turn", "role", "text").collect()
    assert "text" not in written[0] and "SortAggregate" not in written[0]


def test_files_in_folders_are_listed(spark, tmp_path):
    for name in ("a b/x.txt", "a b/empty.txt", "c%d/é#1.v2.txt", "_hidden/no.txt", "a b/.no.txt", "c%d/_SUCCESS", "top.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("" if "empty" in name else "word\n")
    found = [path for (path,) in rows(list_files(spark, str(tmp_path)), "path")]
    assert [path[len(str(tmp_path)) :] for path in found] == [
        "/a%20b/empty.txt", "/a%20b/x.txt", "/c%25d/é%231.v2.txt", "/top.txt"
    ]
    assert rows(list_files(spark, str(tmp_path), subfolders=False), "path") == [(f"{tmp_path}/top.txt",)]
    corpus = Corpus.read_text_folder(spark, str(tmp_path), by_folder=True)
    assert {d for (d,) in rows(corpus.term_freq, "doc_id")} <= {d for (d,) in rows(corpus.documents, "doc_id")}
