"""Replace retrieved children by their parent where enough of them were hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.operators.sizing import broadcast_if_small, top_per_group
from askgrid.session import cut_lineage

# Fixed value: share of a parent's children that must be exceeded.
MERGE_RATIO = 0.2


def with_parents(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add parent_id to hits. Hits are few: where their count allows it they are broadcast,
    and the nodes are scanned in place. They are used several times, so the search that finds them
    is run once, here."""
    hits = cut_lineage(hits)
    parents = nodes.filter(F.col("parent_id").isNotNull()).select("node_id", "parent_id")
    small = broadcast_if_small(hits)
    found = parents.join(small, "node_id").select(*hits.columns, "parent_id")
    rootless = hits.join(broadcast_if_small(found.select("query_id", "node_id").distinct()),
                         ["query_id", "node_id"], "left_anti")
    return found.unionByName(rootless.withColumn("parent_id", F.lit(None).cast("string")
                                                 .cast(nodes.schema["parent_id"].dataType)))


def children_of(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Number of all children of the given parents."""
    wanted = broadcast_if_small(parents.select("parent_id").distinct())
    return (
        nodes.join(wanted, "parent_id", "left_semi")
        .groupBy("parent_id").agg(F.count("*").alias("n_children"))
    )


def merge_ratio(hits: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Per query and parent: children hit, all children, their ratio, mean distance.

    Hits may carry parent_id and n_siblings from the index; else both are looked up.
    """
    if "parent_id" not in hits.columns:
        hits = cut_lineage(with_parents(hits, nodes))
    known = "n_siblings" in hits.columns
    groups = hits.filter(F.col("parent_id").isNotNull()).groupBy("query_id", "parent_id").agg(
        F.count("*").alias("n_hit"),
        F.round(F.avg("dist"), 6).alias("dist"),
        *([F.max("n_siblings").cast("long").alias("n_children")] if known else []),
    )
    if not known:
        groups = groups.join(children_of(nodes, hits), "parent_id")
    return groups.withColumn("ratio", F.col("n_hit") / F.col("n_children"))


def auto_merge(hits: DataFrame, nodes: DataFrame | None = None, ratio: float = MERGE_RATIO,
               levels: int = 2) -> DataFrame:
    """Hits (query_id, node_id, dist) after merging, best first: (.., dist, rank, merged).

    A parent takes the place of its hit children, with their mean distance, where
    hit / all children exceeds the ratio (strictly). Done once per step up the tree.
    """
    current = hits.withColumn("merged", F.lit(False))
    for step in range(levels - 1):
        if "parent_id" not in current.columns:
            current = with_parents(current, nodes)
        parents = merge_ratio(current, nodes).filter(F.col("ratio") > ratio)
        kept = current.join(
            parents.select("query_id", "parent_id"), ["query_id", "parent_id"], "left_anti"
        ).select("query_id", "node_id", "dist", "merged")
        current = (
            kept.unionByName(parents.select(
                "query_id", F.col("parent_id").alias("node_id"), "dist", F.lit(True).alias("merged")
            ))
            .groupBy("query_id", "node_id")
            .agg(F.min("dist").alias("dist"), F.bool_or("merged").alias("merged"))
        )
    # merging never adds hits, so this ranks all of them
    return top_per_group(current, ["query_id"], [F.col("dist"), F.col("node_id")], 2**31 - 1)
