"""The stored answers: append, read, update, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.functions.text import format_ts
from askgrid.operators.sizing import broadcast_if_small

SCHEMA = (
    "run_id string, question_id long, question string, answer string, context string, "
    "justification string, ts string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
VALUES = ["answer", "justification", "context", "ts"]


def stamped(rows: DataFrame, at: Column | None = None) -> DataFrame:
    """Add the time of saving as text."""
    return rows.withColumn("ts", format_ts(F.current_timestamp() if at is None else at))


def conform(rows: DataFrame) -> DataFrame:
    """All stored columns in order; those an older form lacks are null."""
    empty = rows.sparkSession.createDataFrame([], SCHEMA)
    return empty.unionByName(rows, allowMissingColumns=True).select(*COLUMNS)


def append_responses(rows: DataFrame, path: str, at: Column | None = None) -> None:
    """Append rows to the store, which is made if absent. Rows of the older form (question_id,
    question, answer) are accepted."""
    conform(stamped(rows, at)).write.mode("append").parquet(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def update_responses(stored: DataFrame, updates: DataFrame, key: str = "question_id") -> DataFrame:
    """Stored rows with new answer, justification, context and time where their key has an
    update; every row of that key is changed, a new value may be null, and a key that is not
    stored changes nothing. Of several updates of a key the one with the latest time counts, of
    equal times the largest values. To be written to a new path."""
    latest = updates.groupBy(key).agg(F.max(F.struct("ts", *[F.col(v).alias(f"_{v}") for v in VALUES])).alias("_u"))
    fresh = latest.select(key, F.lit(True).alias("_hit"), *[f"_u._{v}" for v in VALUES])
    joined = stored.join(broadcast_if_small(fresh), key, "left")
    changed = {v: F.when(F.col("_hit"), F.col(f"_{v}")).otherwise(F.col(v)) for v in VALUES}
    return joined.withColumns(changed).select(*stored.columns)


def latest_responses(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest row per key. A null version is older than every other; of equal versions the
    largest values count. The aggregate keeps one row per key in each task before the
    shuffle, so a key answered very often is no heavier than others."""
    values = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(version, *values)).alias("_r"))
        .select(*keys, "_r.*").select(*rows.columns)
    )


def upsert_responses(stored: DataFrame, answers: DataFrame, keys: list[str], version: str) -> DataFrame:
    """First answers insert, repeated ones update: the latest version of stored and new rows.
    Stored rows may lack a version and are then older than every answer; of equal versions the
    new row counts."""
    if version not in answers.columns:
        raise ValueError(f"answers have no column {version}")
    both = stored.withColumn("_new", F.lit(0)).unionByName(answers.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = F.struct(version, "_new").alias("_order")
    return latest_responses(both.select("*", order).drop("_new"), keys, "_order").drop("_order")
