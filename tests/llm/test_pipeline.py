import duckdb
import pytest
from conftest import SF_DIR

import corpus_pipeline
from termloom.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    found = queries.queries()[name](spark, SF_DIR).toArrow()
    expected = connection.sql(SQL[name]).to_arrow_table()
    columns = ", ".join(f'"{c}"' for c in found.column_names)
    for one, other in (("found", "expected"), ("expected", "found")):
        extra = connection.sql(f"SELECT {columns} FROM {one} EXCEPT ALL SELECT {columns} FROM {other}")
        assert extra.fetchall() == []


def test_stages_drop_what_they_reject(spark, tmp_path):
    words = "the of and to in is that for it as with on be at by this have from or was are not which their more"
    prose = lambda tag: " ".join(f"{tag}{i} {w}" for i, w in enumerate(words.split() * 2))
    item = " ".join(f"item{i} of the" for i in range(12))
    rows = [(1, prose("a")), (2, prose("a")), (3, prose("b") + " " + item), (4, "1 2 3"), (5, "too short"), (6, prose("c")), (7, None)]
    table = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(table, schema).write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        left.append(sorted(r["doc_id"] for r in docs.collect()))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert left == [[1, 2, 3, 5, 6], [1, 2, 3, 6], [1, 3, 6], [1, 6]]
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [1, 6]


def written(spark, folder, rows, items):
    """Writes both tables, the documents with columns named as the stages name theirs."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, hashes string, start int, row string"
    table = [(i, t, lang, None, None, "h", 1, "r") for i, t, lang in rows]
    spark.createDataFrame(table, schema).write.parquet(f"{folder}/documents.parquet")
    items = spark.createDataFrame(items, "item_id bigint, text string")
    items.write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [], [])).collect() == []


def test_nulls_repeated_rows_and_clashing_names(spark, tmp_path):
    words = "the of and to in is that for it as with on be at by this have from or was are not which their more"
    prose = lambda tag: " ".join(f"{tag}{i} {w}" for i, w in enumerate(words.split() * 2))
    rows = [(1, prose("a"), "en"), (1, prose("a"), "en"), (None, prose("b"), None), (3, "", "en"), (None, None, None)]
    folder = written(spark, tmp_path, rows, [(None, None), (2, "")])
    found = corpus_pipeline.run(spark, folder).collect()
    assert sorted(str(row["doc_id"]) for row in found) == ["1", "None"]


def test_without_labels_no_document_is_identified(spark, tmp_path):
    rows = [(1, "one of the texts", None)]
    assert corpus_pipeline.run(spark, written(spark, tmp_path, rows, [])).collect() == []
