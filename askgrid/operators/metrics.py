"""Counts and times of the stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.functions.text import average

STAGES = ("retrieval", "rerank", "generation")


def rerank_metrics(log: DataFrame, by: str = "device", elapsed: str = "elapsed_s") -> DataFrame:
    """Queries, total time and average time per device."""
    return log.groupBy(by).agg(
        F.count("*").alias("total_queries"), F.sum(elapsed).alias("total_time")
    ).withColumn("average_time_per_query", average("total_time", "total_queries"))


def stage_metrics(log: DataFrame, query: str = "query_id", stage: str = "stage",
                  elapsed: str = "elapsed_s", stages: Sequence[str] = STAGES) -> DataFrame:
    """Time per stage and in total of each query; a stage that did not run counts 0."""
    times = log.groupBy(query).pivot(stage, list(stages)).agg(F.sum(elapsed))
    named = times.select(query, *[F.coalesce(F.col(s), F.lit(0.0)).alias(f"{s}_time") for s in stages])
    total = sum((F.col(f"{s}_time") for s in stages), F.lit(0.0))
    return named.withColumn("total_time", total)


def dedup_counts(marked: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Candidates of each question before and after de-duplication, in one pass."""
    return marked.groupBy(*groups).agg(
        F.count("*").alias("n_before"), F.count_if(F.col("kept")).alias("n_after"))


def exists_any(df: DataFrame, condition: Column) -> DataFrame:
    """One row telling whether any row meets the condition."""
    return df.agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias("found"))
