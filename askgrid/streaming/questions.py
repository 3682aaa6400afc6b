"""Answering question files as they arrive."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from askgrid.operators.lexical import TOP_K, LexicalIndex, bm25_topk


def stream_questions(spark: SparkSession, index: LexicalIndex, source: str, schema: str, out: str,
                     checkpoint: str, k: int = TOP_K, pattern: str = "*.parquet",
                     files_per_batch: int = 100, id_column: str = "query_id") -> StreamingQuery:
    """Retrieve for every new file of questions (``id_column``, text) and add the results to
    ``out``. Each batch owns one folder that a repeated run overwrites, so a batch that is
    retried after a failure is stored once."""
    def store(batch: DataFrame, batch_id: int) -> None:
        bm25_topk(index, batch, k).write.mode("overwrite").parquet(os.path.join(out, f"batch_id={batch_id}"))

    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch).parquet(source)
    )
    return (
        stream.select(F.col(id_column).alias("query_id"), "text").writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
