"""How filters that run one after another interact, for every order of them.

What a filter removes depends on the filters before it only through the set of those filters, so
the 2^k sets replace the k! orders. Documents are counted per part and failure mask, at most 2^k
cells a part. A Gray code then walks the sets, each set differing from the one before in one
filter: that filter's cells gain or lose one active failure, and a cell whose counter leaves or
reaches zero leaves or joins the running survivors. The survivors of each set are kept; a step of
an order is the difference of two of them.

Cells are counted in Spark; the walk goes over batches of parts, all parts of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.llm.rows import BLANKS, columns_of, written

MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITALS_PERCENT = 5
SIGNS = "#$%&*|"
FILTERS = "ABCDE"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ("n", "good", "toxic")
BATCH_PARTS = 256
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def text_failures(text: str = "t") -> list[Column]:
    """Failure conditions A to D of a text that is not null."""
    t = F.col(text)
    words = F.array_remove(F.split(t, "[" + BLANKS + "]+", -1), "")
    n = F.size(words)
    return [n < MIN_WORDS,
            100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * n,
            100 * (F.length(t) - F.length(F.translate(t, CAPITALS, ""))) > MAX_CAPITALS_PERCENT * F.length(t),
            F.length(t) > F.length(F.translate(t, SIGNS, ""))]


def _mask(failures: Sequence[Column]) -> Column:
    bits = F.lit(0)
    for i, failed in enumerate(failures):
        bits = bits + F.when(failed, F.lit(1 << i)).otherwise(F.lit(0))
    return bits.cast("int")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents per part and failure mask: part, mask, n, good, toxic.

    Texts are read once and become a digest and a mask. Copies are counted per part, labels and
    digest before digests meet, so a text that a third of the rows hold reaches the comparison of
    ids as one row per part; failure E needs of it the smallest id alone.
    """
    docs = columns_of(docs, ["doc_id", "text", "source"])
    texts = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("t"))
    rows = texts.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("sha"), _mask(text_failures()).alias("mask"))
    # rows that repeat are one row with a count from here on
    rows = rows.groupBy("doc_id", "part", "sha", "mask").agg(F.count("*").alias("c"))
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("sha")).otherwise(F.lit(0).cast("long")))
    known = columns_of(labels, ["doc_id", "quality", "toxic"]).filter("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    labelled = rows.join(known.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    flags = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "bad")]
    copies = written(labelled.select("doc_id", "part", "sha", "mask", "c", *flags).groupBy("sha", "mask", "part", "good", "bad").agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("c")).otherwise(0)).alias("n_ids"),
        F.min("doc_id").alias("low"), F.min_by("c", "doc_id").alias("n_low")), "copies")
    lowest = written(copies.groupBy("sha").agg(F.min("low").alias("lowest")), "lowest")
    first = F.when(F.col("low") == F.col("lowest"), F.col("n_low")).otherwise(F.lit(0))
    later = F.coalesce(F.col("n_ids") - first, F.lit(0)).cast("long")
    repeat = 1 << FILTERS.index("E")
    split = copies.join(lowest, "sha").select("part", "good", "bad", F.explode(F.array(
        F.struct(F.col("mask"), (F.col("n") - later).alias("n")),
        F.struct((F.col("mask") + repeat).cast("int").alias("mask"), later.alias("n")))).alias("e"))
    n = F.col("e.n")
    return split.groupBy("part", F.col("e.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("bad")).alias("toxic"))


def gray_walk(cells: np.ndarray, filters: int) -> np.ndarray:
    """Survivors of every set of filters: ``cells`` [.., 2^k] by failure mask to [.., 2^k] by set."""
    masks = np.arange(1 << filters)
    active = np.zeros(1 << filters, int)  # failures of each cell among the filters that are on
    alive = cells.sum(axis=-1)
    out = np.empty_like(cells)
    out[..., 0] = alive
    on = 0
    for step in range(1, 1 << filters):
        turned = (step & -step).bit_length() - 1  # the one filter by which this set differs from the last
        on ^= 1 << turned
        holds = masks[masks >> turned & 1 == 1]
        if on >> turned & 1:
            alive = alive - cells[..., holds[active[holds] == 0]].sum(axis=-1)
            active[holds] += 1
        else:
            active[holds] -= 1
            alive = alive + cells[..., holds[active[holds] == 0]].sum(axis=-1)
        out[..., on] = alive
    return out


def order_steps(cells: np.ndarray, filters: int) -> dict[str, np.ndarray]:
    """Counts [parts, orders, steps] of all orders from ``cells`` [parts, measure, mask]."""
    alive = gray_walk(cells, filters)
    full = (1 << filters) - 1
    orders = np.array(list(permutations(range(filters))))
    after = np.cumsum(1 << orders, axis=1)
    before = after - (1 << orders)
    lost = alive[..., before] - alive[..., after]
    masks = np.arange(1 << filters)
    bits = [1 << f for f in range(filters)]
    failing = np.stack([cells[:, 0, masks & b > 0].sum(axis=-1) for b in bits], axis=-1)
    unique = np.stack([alive[:, 0, full ^ b] - alive[:, 0, full] for b in bits], axis=-1)
    share = np.zeros_like(unique)
    for f, b in enumerate(bits):
        for s in masks[masks & b == 0]:
            size = int(s).bit_count()
            share[:, f] += factorial(size) * factorial(filters - 1 - size) * (alive[:, 0, s] - alive[:, 0, s | b])
    return {"kept": alive[:, 0, after], "removed": lost[:, 0], "redundant": failing[:, orders] - lost[:, 0],
            "unique_fails": unique[:, orders], "good_lost": lost[:, 1], "toxic_lost": lost[:, 2], "shapley": share[:, orders]}


def _walk(filters: str):
    k = len(filters)
    names = ["".join(o) for o in permutations(filters)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_PARTS):
                batch = whole.slice(at, BATCH_PARTS)
                n = batch.num_rows
                parts = batch.column(0).to_numpy(zero_copy_only=False)
                table = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:]], axis=1)
                found = order_steps(table.reshape(n, len(MEASURES), 1 << k), k)
                columns = [pa.array(np.repeat(parts, len(names) * k), pa.string()),
                           pa.array(np.tile(np.repeat(names, k), n), pa.string()),
                           pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n * len(names)))]
                columns += [pa.array(found[c].reshape(-1), pa.int64()) for c in COUNTS]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *COUNTS])

    return run


def order_audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of ``filters`` and step, from ``cells`` (part, mask, n, good, toxic):
    bit i of a mask says that the i-th filter fails. Masks that do not occur count nothing."""
    size = 1 << len(filters)
    wide = cells.groupBy("part").agg(*[
        F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long").alias(f"{c}_{m}") for c in MEASURES for m in range(size)])
    return wide.mapInArrow(_walk(filters), SCHEMA)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders of the filters A to E over all rows of ``docs`` (doc_id, text, source; others are
    ignored), with what they take of the good and the toxic documents of ``labels`` (doc_id, quality, toxic).

    Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    Null source is the part of the empty string, null text the empty text. A document fails E if a
    smaller doc_id has the same text; a null id neither is smaller nor has smaller ones, and of rows with one
    id and one text none is smaller, so all of them stay or go together. Each repeated row counts. A
    document is good or toxic if any label of its id says 1; labels without id or value say nothing.
    A text of any length is one row. No documents: no rows.
    """
    return order_audit(cells(docs, labels))
