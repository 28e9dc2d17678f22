"""Connected components of a link table, by hooking to the least neighbour and pointer jumping.

Defined results: an empty table has no rows. Links from a node to itself, repeated links and links with a null end say
nothing. Nodes without links to others are left out. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) longs. Returns (node, label), label the least node that is reachable.

    Each round joins links with labels (one row a link, one a node) and then jumps once; nothing but a flag comes to the
    driver. Rounds are the logarithm of the longest path, about. A node with very many links, or a component that holds most
    nodes, is a hot key of these joins: both sides are read from files, so that Spark can split such a key's partition, and
    what is joined is reduced before it is shuffled again.
    """
    links = links.filter("a <> b").select("a", "b")
    both = settle(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = settle(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = settle(hooked.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")))
        labels = new.select("node", "label")
        if new.filter("label <> old").isEmpty():
            return labels
