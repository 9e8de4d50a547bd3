"""Connected components of a table of links, by alternating star operations.

Each round writes its links to the shared scratch folder, so a lost executor
costs a part of one round, and plans do not grow. Smallest neighbours are
combined before the shuffle, and a node with a large part of all links is split
by adaptive execution in the join, as any hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import materialize


def _pairs(table: DataFrame, node: str, other: str) -> DataFrame:
    return table.select(F.col(node).alias("node"), F.col(other).alias("other"))


def _large_star(links: DataFrame) -> DataFrame:
    """Link every greater neighbour of a node to the smallest of node and neighbours."""
    both = links.unionByName(_pairs(links, "other", "node"))
    smallest = both.groupBy("node").agg(F.least(F.min("other"), "node").alias("smallest"))
    greater = both.where("other > node").join(smallest, "node")
    return _pairs(greater, "other", "smallest").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    smallest = links.groupBy("node").agg(F.min("other").alias("smallest"))
    others = links.join(smallest, "node").where("other != smallest")
    return _pairs(others, "other", "smallest").unionByName(
        _pairs(smallest, "node", "smallest")
    ).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none."""
    heads = links.groupBy("node").agg(F.count("*").alias("n"), F.min("other").alias("other"))
    linked = _pairs(heads, "node", "n").select(F.col("node").alias("other"))
    further = heads.join(linked, "other", "left_semi").select("node")
    return heads.where("n > 1").select("node").unionByName(further).isEmpty()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for all nodes but those smallest ones.

    `links` holds (node, other) of one orderable type, in any direction and
    number; links of a node to itself and to null say nothing. Both star
    operations together halve the depth of the trees, until all are stars.
    """
    downward = _pairs(
        links.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")),
        "a",
        "b",
    )
    stars = materialize(downward.where("node != other").distinct(), "links")
    for _ in range(max_rounds):
        if _are_stars(stars):
            return stars.withColumnRenamed("other", "component")
        stars = materialize(_small_star(_large_star(stars)), "links")
    raise RuntimeError(f"components are not complete after {max_rounds} rounds")
