"""Connected components by alternating stars.

Links become stars around the smallest id of their surroundings in a number of rounds that grows with the logarithm
of the longest chain (Kiveris et al., Connected Components in MapReduce and Beyond, 2014). All rounds are joins and
aggregates; each is checkpointed, since a plan of all rounds would double with every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolsentry.llm.tables import landed


def _largest(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("least").alias("a"), "b").filter("a < b").distinct()


def _smallest(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("b").agg(F.min("a").alias("least"))
    moved = links.join(least, "b")
    up = moved.select(F.col("least").alias("a"), F.col("a").alias("b"))
    return up.unionByName(least.select(F.col("least").alias("a"), "b")).filter("a < b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the links ``(a, b)`` that is not the smallest of its component.

    Ids are compared as given; repeated links and links of a node to itself change nothing.
    """
    ordered = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    stars, before = landed(ordered, "links"), None
    while True:
        row = stars.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (row.n, row.x) == before:
            return stars.select(F.col("b").alias("node"), F.col("a").alias("component"))
        before = (row.n, row.x)
        stars = landed(_smallest(_largest(stars)), "stars")
