"""Connected components of a table of links, by rounds of joins-free grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.session import stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Point the neighbours of every node at the smallest of them and the node itself.

    A large star moves the larger neighbours, a small star the smaller ones and the node.
    The smallest neighbour comes from a combining aggregate, so a node with very many links
    only meets them in a join, which Spark splits.
    """
    both = links if not large else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:  # from the larger end to the smaller
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    near = both.join(least, "a")
    if large:
        moved = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = near.select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node) for every node of the links a-b.

    Alternates large and small stars until nothing changes, each round written to the
    shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    links = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        links = stage(_star(_star(links, large=True), large=False))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
