import pytest

from termloom.llm import url_filters
from termloom.llm.queries import URL_RULES


@pytest.fixture
def judged(spark):
    def make(pages, labels):
        table = spark.createDataFrame(pages, "page_id bigint, url string, host string, good int")
        marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
        found = url_filters.filter_urls(table, marks, URL_RULES).collect()
        return {row["page_id"]: row for row in found}

    return make


def test_rules_hosts_and_reputation(judged):
    bad = [(i, f"http://spam.example.net/{i}", "h", 1) for i in range(100, 160)]
    good = [(i, f"http://a{i % 7}.fine.net/{i}", "h", 1) for i in range(200, 400)]
    pages = [
        (1, "HTTP://WWW.Example.ORG/es/1?x#y", "h", 1),
        (2, "http://example.org/en/12", "h", 1),
        (3, "http://notexample.org/es/", "h", 1),
        (4, "http://a.com/fr/x", "h", 1),
        (5, "http://a.com/de/", "h", 1),
        (6, None, "h", 1),
        (7, "no scheme", "h", 1),
        (8, "x://É.net?q", "h", 1),
        (9, "http://other.spam.example.net", "h", 1),
        (None, "http://com/fr/", "h", 1),
    ]
    labels = [(i, 0, 1) for i, *_ in bad] + [(i, 1, 0) for i, *_ in good] + [(1, None, 1), (None, 0, 0)]
    found = judged(pages + bad + good, labels)
    got = {k: tuple(found[k])[1:5] for k in (1, 2, 3, 4, 5, 6, 7, 8, None)}
    assert got[1] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3] == ("notexample.org", "/es/", "org/", "allow")
    assert got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block")
    assert got[None] == ("com", "/fr/", "com/fr/", "allow")
    assert got[6][:3] == got[7][:3] == ("", "", None)
    assert got[8][:3] == ("É.net", "", None)
    assert found[100]["verdict"] == "block" and found[200]["verdict"] == "allow"
    # A host without labels follows its domain.
    assert found[9]["rate"] < found[8]["rate"]


def test_without_labels_and_without_pages(judged):
    assert judged([(1, "http://a.net", "h", 1)], [])[1]["verdict"] == "allow"
    assert judged([], [(1, 0, 1)]) == {}


def test_the_bound_decides_not_the_mean(judged):
    """Few bad labels leave a host of a good domain alone, many block it; repeats count."""
    bad = [(i, f"http://bad.mixed.org.uk/{i}", "h", 1) for i in range(100, 140)]
    few = [(i, f"http://few.fine.net/{i}", "h", 1) for i in (150, 151)]
    good = [(i, f"http://a{i % 9}.fine.net/{i}", "h", 1) for i in range(200, 300)]
    pages = [*bad, *few, *good, (100, "http://bad.mixed.org.uk/" + "x" * 500_000, "h", 1)]
    labels = [(i, 0, 0) for i, *_ in bad + few] + [(i, 1, 0) for i, *_ in good] + [(100, 0, 0)]
    found = judged(pages, labels)
    assert found[100]["verdict"] == "block" and found[100]["upper"] < url_filters.MIN_GOOD
    assert found[150]["verdict"] == "allow" and found[150]["upper"] >= url_filters.MIN_GOOD
    assert found[200]["upper"] > found[150]["upper"] > found[100]["upper"]
    assert all(row["rate"] <= row["upper"] for row in found.values())


def test_the_last_of_equally_long_rules_wins(spark):
    rules = [("a.com/x", "allow"), ("a.com/x", "block"), ("b.com/x", "allow")]
    table = spark.createDataFrame([("a.com", "/xy"), ("b.com", "/x"), ("c.com", "/x")], "host string, path string")
    match = url_filters.matching_rule(table["host"], table["path"], rules)
    verdicts = [row["verdict"] for row in table.select(match["verdict"].alias("verdict")).collect()]
    assert verdicts == ["block", "allow", None]


def test_a_short_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.net")], "page_id bigint, url string")
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id bigint, quality int, toxic int")
    found = url_filters.filter_urls(pages, labels, URL_RULES)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 20
