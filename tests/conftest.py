import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from termloom.session import local_session

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 8, spark__sql__shuffle__partitions="4")


@pytest.fixture
def documents(spark):
    """Makes (doc_id, text) from texts, or from a mapping of ids to texts."""

    def make(texts):
        pairs = texts.items() if isinstance(texts, dict) else enumerate(texts, 1)
        return spark.createDataFrame(list(pairs), "doc_id bigint, text string")

    return make


def rows(df, *columns):
    """The rows of `df` as a sorted list of tuples."""
    return sorted(tuple(r) for r in df.select(*columns).collect())
