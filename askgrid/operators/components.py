"""Connected components of a table of links, without gathering the links of any node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long, a <> b) to (node, root): root is the smallest node reachable.

    Each round links a node's larger neighbours, then its smaller ones, to the smallest of them
    (alternating stars, Kiveris et al., SoCC 2014), until nothing changes; rounds grow with the
    logarithm of the nodes. The smallest neighbours are stored before links meet them: a join with
    a stored side of one row per node may split the links of a node that has very many.
    """
    links = cut_lineage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        # larger neighbours of a node to its minimum
        large = cut_lineage(
            links.join(low, "a").select(F.col("b").alias("n"), "m").filter("n <> m").distinct())
        # each node's smaller neighbours, and the node, to the smallest of them
        least = cut_lineage(large.groupBy("n").agg(F.min("m").alias("low")))
        ends = F.array(F.struct(F.col("m").alias("b"), F.col("low").alias("a")), F.struct(F.col("n").alias("b"), F.col("low").alias("a")))
        links = cut_lineage(
            large.join(least, "n").select(F.explode(ends).alias("e")).select("e.a", "e.b").filter("a <> b").distinct())
        after = mark(links)
        if after == before:
            break
        before = after
    # every link now leads from a root to one of its nodes
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
