"""Exact duplicates by deterministic block naming.

A text is cut into blocks of fixed size. All blocks are sorted and each distinct block gets
its place in that order as an integer name, compared byte by byte, not by hash. Adjacent names
are paired and the distinct pairs named in the same way, until every document has one name.
(number of blocks, last name) then is an identity free of collisions.

The text is shuffled once. Equal blocks, however many, are dealt over several sorted
partitions by a salt; partitions that meet inside one block share its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgrid.llm.rows import keep_rows, parts_for, written
from askgrid.operators.sizing import broadcast_if_small

BLOCK_BYTES = 65536
PART_BYTES = 24 << 20
SALTS = 64  # at least; a block that very many rows hold may go to all partitions


class NameClash(RuntimeError):
    """Two different blocks agree in both sort hashes; another seed is to be taken."""


def _rank_sorted(keep: list[str], has_block: bool):
    """Number the distinct keys of a sorted partition; first and last row carry their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, rank, last, held = TaskContext.get().partitionId(), -1, None, None
        names = [*keep, "a", "b", "part", "rank", "first", "edge"]

        def out(batch, ranks, first, edge):
            n = batch.num_rows
            cols = [batch.column(batch.schema.get_field_index(c)) for c in (*keep, "a", "b")]
            edges = pa.array(edge, pa.binary())
            return pa.RecordBatch.from_arrays(
                [*cols, pa.array(np.full(n, part), pa.int32()), pa.array(ranks, pa.int64()), pa.array(first), edges], names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a = batch.column(batch.schema.get_field_index("a")).to_numpy()
            b = batch.column(batch.schema.get_field_index("b")).to_numpy()
            new = np.empty(n, bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            block = batch.column(batch.schema.get_field_index("block")) if has_block else None
            if has_block and n > 1:
                new[1:] |= pc.not_equal(block[1:], block[:-1]).to_numpy(zero_copy_only=False)
            end = (a[-1], b[-1], block[n - 1].as_py() if has_block else b"")
            start = (a[0], b[0], block[0].as_py() if has_block else b"")
            new[0] = last is None or start != last
            ranks = rank + np.cumsum(new)
            first, edge = np.zeros(n, bool), [None] * n
            if last is None:
                first[0], edge[0] = True, start[2]
            if held is not None:
                yield out(*held)
            held, rank, last = [batch, ranks, first, edge], int(ranks[-1]), end
        if held is not None:
            held[3][-1] = last[2]
            yield out(*held)

    return run


def name_sorted(df: DataFrame, keep: list[str], parts: int, block: str | None = None) -> DataFrame:
    """Integer names of sorted keys (a, b[, block]): equal keys one name, others different ones.

    ``a`` and ``b`` are longs and decide alone unless ``block`` is given; they then are hashes
    that set the order, and the block itself is compared. Returns keep + name, written out.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in (*keep, "a", "b")] + [
        T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType()),
        T.StructField("first", T.BooleanType()), T.StructField("edge", T.BinaryType())])
    columns = [*keep, "a", "b", *(["block"] if block else [])]
    salt = F.pmod(F.xxhash64(*keep), F.lit(max(SALTS, parts)))
    ranged = df.select(*columns, salt.alias("salt")).repartitionByRange(parts, "a", "b", "salt")
    order = ["a", "b", *(["block"] if block else [])]
    ranked = written(ranged.sortWithinPartitions(*order).select(*columns).mapInArrow(
        _rank_sorted(keep, bool(block)), schema), "names")
    # A row per partition; its edge blocks are compared with those of the one before by a join.
    edges = written(ranked.filter("edge is not null").groupBy("part").agg(
        F.max("rank").alias("last_rank"),
        F.max(F.when(F.col("first"), F.struct("a", "b", "edge"))).alias("low"),
        F.max(F.struct("rank", F.struct("a", "b", "edge").alias("v"))).alias("high")), "edges")
    order = W.orderBy("part")  # over integers alone
    line = edges.select("part", "last_rank").withColumn("prev", F.lag("part").over(order))
    one, two = edges.select("part", "low"), edges.select(F.col("part").alias("prev"), F.col("high.v").alias("high"))
    met = written(line.join(one, "part").join(two, "prev", "left").select(
        "part", "last_rank", F.coalesce((F.col("low.a") == F.col("high.a")) & (F.col("low.b") == F.col("high.b")), F.lit(False)).alias("keys"),
        F.coalesce(F.col("low.edge") == F.col("high.edge"), F.lit(False)).alias("blocks")), "met")
    clash = met.filter("keys and not blocks").select("part").first()
    if clash is not None:
        raise NameClash(f"partition {clash.part}")
    # partitions that meet inside one block share its name
    shifts = met.select("part", (
        F.coalesce(F.sum(F.col("last_rank") + 1).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        - F.sum(F.col("keys").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0))).alias("shift"))
    return ranked.join(broadcast_if_small(written(shifts, "shifts")), "part").select(*keep, (F.col("rank") + F.col("shift")).alias("name"))


def _cut(docs: DataFrame, block_bytes: int, seed: int) -> DataFrame:
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    whole = docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row_id"), data.alias("data"),
        F.unhex(F.sha2(data, 256)).alias("sha"),
        F.greatest(F.lit(1), F.ceil(F.octet_length(data) / block_bytes)).cast("int").alias("blocks"))
    cut = whole.select(
        "doc_id", "row_id", "sha", "blocks",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                                 lambda i: F.substring(F.col("data"), i * block_bytes + 1, F.lit(block_bytes)))).alias("pos", "block"))
    first = F.col("pos") == 0
    return cut.select(
        F.when(first, F.col("doc_id")).alias("doc_id"), "row_id", F.when(first, F.col("sha")).alias("sha"), "blocks", "pos", "block",
        F.xxhash64(F.lit(seed), "block").alias("a"), F.xxhash64("block", F.lit(seed)).alias("b"))


def text_identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, row_id, sha (binary), blocks, name. Equal (blocks, name)
    means equal text and the reverse. ``row_id`` is unique within the result."""
    docs = docs.select("doc_id", "text")
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, parts_for(docs, PART_BYTES))
    for seed in range(8):
        try:
            level = name_sorted(_cut(docs, block_bytes, seed), ["doc_id", "row_id", "sha", "blocks", "pos"], parts, "block")
            break
        except NameClash:
            continue
    else:
        raise NameClash("eight seeds")
    level = written(level.withColumn("left", F.col("blocks")), "blocks")
    done = [level.filter("left = 1").select("row_id", "blocks", "name")]
    heads = level.filter("pos = 0").select("row_id", "doc_id", "sha")
    largest = level.agg(F.max("blocks")).first()[0] or 1
    level = level.filter("left > 1").select("row_id", "blocks", "pos", "left", "name")
    while largest > 1:
        largest = -(-largest // 2)
        paired = level.groupBy("row_id", "blocks", F.floor(F.col("pos") / 2).cast("int").alias("pos"), ((F.col("left") + 1) / 2).cast("int").alias("left")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).cast("long").alias("b"))
        named = name_sorted(paired, ["row_id", "blocks", "pos", "left"], parts)
        level = written(named, "pairs")
        done.append(level.filter("left = 1").select("row_id", "blocks", "name"))
        level = level.filter("left > 1")
    names = done[0]
    for more in done[1:]:
        names = names.unionByName(more)
    if len(done) == 1:  # every text has one block: its first row has all
        return names.join(heads, "row_id")
    return heads.join(names, "row_id")


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Groups of equal texts over all rows of ``docs`` (doc_id, text; more columns are ignored).

    Returns one row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256. The row
    with the largest doc_id of a group stays; ids sort below null never: null ids count as
    smallest. Of rows that repeat the largest doc_id with the same text, exactly one is kept.
    Null text counts as empty. An empty table gives no rows.
    """
    ids = written(text_identities(docs, block_bytes), "identities")
    # a written table on this side lets the join split the rows of a hot group
    groups = written(ids.groupBy("blocks", "name").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"),
        # structs order null first, so a group of null ids also has one row that stays
        F.max(F.struct("doc_id", "row_id")).alias("stays")), "groups")
    return ids.join(groups, ["blocks", "name"]).select(
        "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("stays.row_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def keep_distinct(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs`` with one row per distinct text left, all columns as they were."""
    kept = written(exact_dedup(docs, block_bytes), "decisions").groupBy("doc_id", F.col("text_sha256").alias("sha")).agg(
        F.count("*").alias("rows"), F.bool_or("kept").alias("kept"))
    return keep_rows(docs, kept.filter("kept").select("doc_id", "sha", "rows"))
