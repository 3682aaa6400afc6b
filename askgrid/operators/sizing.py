"""Helpers that keep joins, numbering and concatenation safe at any size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgrid.session import cut_lineage

# A side is broadcast only after its rows and bytes were measured and found within both.
MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 64 << 20
# A key with more rows than this is joined apart from the others.
HOT_KEY_ROWS = 100_000
# Bytes of text a Python task works on at a time.
BLOCK_BYTES = 4 << 20
# Parts a hot key is split into where its rows cannot be met by a broadcast.
SALTS = 64


def _bytes(c: Column, kind: T.DataType) -> Column:
    """Approximate size of a value."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(c) + 16
    elif isinstance(kind, T.StructType):
        size = sum((_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(8))
    elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.StructType, T.ArrayType)):
        size = F.size(c) * 8 + 16
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        size = F.octet_length(F.to_json(c)) + 16
    else:
        return F.lit(8)
    return F.coalesce(size, F.lit(8))


def fits_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                   max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Measure at most max_rows + 1 rows to decide; never reads a large table to its end."""
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    rows, total = df.select(size.cast("long").alias("b")).limit(max_rows + 1).agg(
        F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return rows <= max_rows and total <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side of checked size. A larger one is returned as it is: the join is
    then a shuffle join, whose skewed partitions adaptive execution splits."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, end) whose sizes together stay below ``most``, of one row at least."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield first, end
        first = end


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of few splits; an input of many splits is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parts_by_bytes(df: DataFrame, column: str, part_bytes: int) -> int:
    """Partitions to place the rows in: as many as there are cores, and as hold the given bytes of a text column each."""
    total = df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-total // part_bytes))


def join_hot_apart(big: DataFrame, unique: DataFrame, keys: Sequence[str], rows: str,
                   total_rows: int) -> DataFrame:
    """Inner join of a table with one row per key, which knows the rows of each key.

    Keys that hold many rows are few by construction. Where their rows of the unique side
    fit, they are broadcast; else the big side is salted by the content of its rows and
    the unique side is repeated per salt. All other keys go through an ordinary join.
    """
    keys = list(keys)
    if total_rows <= HOT_KEY_ROWS:
        return big.join(unique, keys)
    hot, cold = unique.filter(F.col(rows) > HOT_KEY_ROWS), unique.filter(F.col(rows) <= HOT_KEY_ROWS)
    names = broadcast_if_small(hot.select(*keys))
    apart = big.join(names, keys, "left_anti").join(cold, keys)
    if fits_broadcast(hot):
        return apart.unionByName(big.join(F.broadcast(hot), keys))
    salted = big.join(names, keys, "left_semi").withColumn(
        "_salt", F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int"))
    repeated = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return apart.unionByName(salted.join(repeated, [*keys, "_salt"]).drop("_salt"))


def number_rows(df: DataFrame, key: str, out: str, start: int = 0,
                partition_by: Sequence[str] = (), part_rows: int = 200_000) -> DataFrame:
    """Dense row numbers in the order of a distinct key, without sorting everything (or one
    large group) in one task.

    Rows are dealt into ranges of the key, about ``part_rows`` each, and counted on inside their
    range; the rows of the ranges before it are added. Any number of ranges will do.
    """
    groups = list(partition_by)
    parts = df.count() // part_rows + 1
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = cut_lineage(
        df.repartitionByRange(parts, *groups, key).sortWithinPartitions(*groups, key)
        .withColumn("_part", F.spark_partition_id()).withColumn("_row", within))
    before = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = dealt.groupBy(*groups, "_part").agg(F.count("*").alias("_rows"), F.min("_row").alias("_first")).select(
        *[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_part").alias("_p"),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    same = dealt["_part"] == shifts["_p"]
    for g in groups:
        same = same & dealt[g].eqNullSafe(shifts[f"_g_{g}"])
    return dealt.join(broadcast_if_small(shifts), same).withColumn(
        out, (F.col("_row") + F.col("_shift") + F.lit(start)).cast("long")).select(*df.columns, out)


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int,
                  out: str = "rank") -> DataFrame:
    """First k rows of each group. Spark keeps k rows per group in every task before the
    shuffle, so a large group never meets in one task."""
    rank = F.row_number().over(W.partitionBy(*groups).orderBy(*order))
    return df.withColumn(out, rank).filter(F.col(out) <= k)


def concat_in_order(df: DataFrame, groups: Sequence[str], order: str, text: str, sep: str,
                    out: str = "text", block: int = 1024) -> DataFrame:
    """Join the texts of a group in order. Runs of ``block`` order values are joined first,
    in separate tasks, so a group with many rows arrives as few pieces."""
    runs = (
        df.withColumn("_run", F.floor(F.col(order) / block))
        .groupBy(*groups, "_run")
        .agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_p"))
        .withColumn("_t", F.array_join(F.transform("_p", lambda p: p["t"]), sep))
    )
    return (
        runs.groupBy(*groups)
        .agg(F.sort_array(F.collect_list(F.struct(F.col("_run").alias("o"), F.col("_t").alias("t")))).alias("_p"))
        .select(*groups, F.array_join(F.transform("_p", lambda p: p["t"]), sep).alias(out))
    )
