import duckdb
import pytest
from conftest import SF_DIR

import __spark_entry__ as registered

QUERIES = registered.core_queries()
SQL = registered.core_oracle_sql()
TABLES = ("documents", "pages", "conversations", "benchmark")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert registered.entry(spark).columns == ["doc_id", "term", "tf_idf", "rank"]


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, sql, name):
    query = QUERIES[name](spark, SF_DIR)
    plan = query._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas"):
        assert unwanted not in plan
    found = query.toArrow()
    expected = sql.sql(SQL[name]).to_arrow_table()
    assert sorted(found.column_names) == sorted(expected.column_names)
    for column in found.column_names:
        assert found.schema.field(column).type == expected.schema.field(column).type
    columns = ", ".join(f'"{c}"' for c in found.column_names)
    for one, other in (("found", "expected"), ("expected", "found")):
        extra = sql.sql(f"SELECT {columns} FROM {one} EXCEPT ALL SELECT {columns} FROM {other}")
        assert extra.fetchall() == []
    assert found.num_rows == expected.num_rows
