"""Candidate lists: union of the retrievers, of the sub-queries, and node texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.operators.sizing import broadcast_if_small

# Order of the retrievers within one query.
DENSE, SPARSE = 0, 1


def hybrid_union(dense: DataFrame, sparse: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Merged dense results followed by sparse results, duplicates kept; the list order is
    (source_order, rank)."""
    columns = [*keys, "node_id", "rank"]
    return (
        dense.select(*columns).withColumn("source_order", F.lit(DENSE))
        .unionByName(sparse.select(*columns).withColumn("source_order", F.lit(SPARSE)))
    )


def query_table(questions: DataFrame, subqueries: DataFrame | None = None) -> DataFrame:
    """All queries as one table: the question as number 0, its sub-queries from 1 on.
    query_id is the pair (question_idx, subquery_no)."""
    queries = questions.select(
        F.col("question_idx"), F.lit(0).alias("subquery_no"), F.col("question").alias("text"))
    if subqueries is not None:
        queries = queries.unionByName(
            subqueries.select("question_idx", F.col("subquery_no").cast("int"), F.col("subquery").alias("text")))
    return queries.select(F.struct("question_idx", "subquery_no").alias("query_id"), "text")


def union_subqueries(hits: DataFrame) -> DataFrame:
    """Results of a question followed by those of its sub-queries. ``ord`` is the place
    in that list: a text key that sorts like (subquery_no, source_order, rank)."""
    return hits.select(
        "query_id.question_idx", "query_id.subquery_no", "source_order", "rank", "node_id",
        F.format_string("%06d-%d-%06d", "query_id.subquery_no", "source_order", "rank").alias("ord"),
    )


def join_docstore(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add node texts to hits. The wanted ids are broadcast where their count allows it, so
    the node table is scanned in place."""
    wanted = broadcast_if_small(hits.select("node_id").distinct())
    texts = nodes.select("node_id", "text").join(wanted, "node_id", "left_semi")
    return hits.join(texts, "node_id")
