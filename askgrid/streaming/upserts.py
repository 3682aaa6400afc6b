"""Repeated answers to a question: the latest wins."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from askgrid.sources.responses import latest_responses


def stream_upserts(answers: DataFrame, keys: list[str], version: str, out: str,
                   checkpoint: str) -> StreamingQuery:
    """Store a stream of answers so that only rows that changed are written: each batch adds
    its latest row per key in a folder of its own, overwritten if the batch is retried."""
    def store(batch: DataFrame, batch_id: int) -> None:
        latest_responses(batch, keys, version).write.mode("overwrite").parquet(
            os.path.join(out, f"batch_id={batch_id}"))

    return (
        answers.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_latest(spark: SparkSession, out: str, keys: list[str], version: str) -> DataFrame:
    """The current answer per key over all batches."""
    return latest_responses(spark.read.parquet(out).drop("batch_id"), keys, version)
