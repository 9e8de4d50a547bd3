import pytest

EXTRA = "kept boolean, m string, row string, hashes string, n int"


@pytest.fixture
def texts(spark):
    """Makes (doc_id, text) with further columns whose names the operators use too."""

    def make(pairs):
        extra = (True, "m", "r", "h", 1)
        return spark.createDataFrame(
            [(*pair, *extra) for pair in pairs], f"doc_id bigint, text string, {EXTRA}"
        )

    return make
