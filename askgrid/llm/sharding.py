"""Shards by rendezvous hashing of a stable record key.

Every (key, shard) pair has a pseudo-random draw u; the shard with the largest
weight / -ln(u) takes the record. A further shard only takes records into itself: the draws
of the others do not change. Weights give shards shares in proportion.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askgrid.llm.rows import parts_for, written

SLOT_ROWS = 50_000


def draw(key: Column, shard: int) -> Column:
    """Number in (0, 1) fixed by key and shard: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{shard}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0-based) of a key. Weights are positive; ties go to the larger shard number."""
    scores = [F.struct((F.lit(float(w)) / -F.log(draw(key, i))).alias("s"), F.lit(i).alias("i")) for i, w in enumerate(weights)]
    return F.greatest(*scores)["i"] if len(scores) > 1 else F.lit(0)


def shard_rows(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, grown: float = 1.0) -> DataFrame:
    """Shard and gapless slot of every row of ``docs`` (doc_id, text; more columns are ignored).

    Returns doc_id, size (UTF-8 bytes and 1; null text: 1), text_crc32 (of the text, null as
    empty), law, shard, slot (0-based in the shard), grown_shard (with a shard of weight
    ``grown`` added). The key alone decides: equal texts spread, rows that repeat a doc_id
    share its shard, null ids are one key. Slots are counted in parts dealt by row number, so a
    hot key or shard meets in no task. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    placed = base.select(
        "*", shard_of(F.col("doc_id"), weights).cast("int").alias("shard"),
        shard_of(F.col("doc_id"), [*weights, grown]).cast("int").alias("grown_shard"))
    placed = written(placed, "shards")
    parts = parts_for(placed, SLOT_ROWS * 16, F.lit(0))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("row_id"), F.lit(parts)).cast("int"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shifts = placed.groupBy("shard", "part").agg(F.count("*").alias("rows")).select(
        "shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("shift"))
    inside = F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "row_id")) - 1
    return placed.withColumn("n", inside).join(shifts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("n") + F.col("shift")).cast("long").alias("slot"), "grown_shard")
