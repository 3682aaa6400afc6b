"""Vector best-fit packing of token sequences under three capacities.

A piece of n tokens asks for the vector (n, 1, n^2): tokens, documents and attention cost. A sequence
has what is left of its capacities. Pieces come in decreasing size; each goes, of all open sequences
that can take it in every dimension, into the one whose residual vector behind it has the smallest
weighted norm, or before it the smallest weighted dot product with the piece, and else opens a new one.

Only documents longer than the largest piece are cut. Pieces of that size are sequences by themselves
and are not shuffled. The others are dealt by chance into groups of bounded size, which are packed
apart: each group is a fair sample of all lengths, so it loses at most a few sequences in thousands.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.llm.rows import text_bytes, whole_ids, written

TOKENS = 2048
WEIGHTS = (1.0, 0.01, 0.01)
GROUP = 8192  # pieces packed together
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, place long"
ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *[(n, pa.int64()) for n in ("start", "length", "ids_crc32", "place")]])
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Capacity:
    """What a sequence holds: tokens, documents, and attention cost, the sum of squared piece lengths.

    Without ``docs`` and ``cost`` both follow from the tokens (a piece has one token at least, and
    the squares of its parts are at most the square of a sequence), so they steer the choice but never
    refuse a piece. ``piece`` is the longest piece a sequence takes.
    """

    def __init__(self, tokens: int = TOKENS, docs: int | None = None, cost: int | None = None):
        self.tokens, self.docs, self.cost = tokens, docs or tokens, cost or tokens * tokens
        if min(self.tokens, self.docs, self.cost) < 1:
            raise ValueError("a capacity below 1 takes no piece")
        self.piece = min(self.tokens, math.isqrt(self.cost))


def best_fit(lengths: np.ndarray, capacity: Capacity, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> np.ndarray:
    """Number of the sequence of each piece; ``lengths`` are in decreasing order, none above ``capacity.piece``."""
    n = len(lengths)
    limits = (capacity.tokens, capacity.docs, capacity.cost)
    scale = [w / c ** 2 for w, c in zip(weights, limits)]
    left, number = np.empty((3, n), np.int64), np.empty(n, np.int64)
    out, used, opened = np.empty(n, np.int64), 0, 0
    smallest = int(lengths[-1]) if n else 0
    least = np.array([smallest, 1, smallest ** 2])[:, None]
    for i, length in enumerate(lengths.tolist()):
        need = (length, 1, length * length)
        # every open sequence has a piece of this size at least, so two beyond half never share one
        if 2 * length <= capacity.tokens:
            fits = np.flatnonzero((left[0, :used] >= need[0]) & (left[1, :used] >= 1) & (left[2, :used] >= need[2]))
        else:
            fits = ()
        if len(fits):
            if rule == "norm":
                score = sum(s * (r[fits] - d).astype(float) ** 2 for s, r, d in zip(scale, left, need))
            else:
                score = sum(s * d * r[fits].astype(float) for s, r, d in zip(scale, left, need))
            at = int(fits[score.argmin()])
        else:
            at = used
            left[:, at], number[at] = limits, opened
            used, opened = used + 1, opened + 1
        left[:, at] -= need
        out[i] = number[at]
        if (left[:, at] < least[:, 0]).any():  # nothing to come fits here
            used -= 1
            left[:, at], number[at] = left[:, used], number[used]
    return out


def _cut(tokenizer: Callable[[], Callable[[bytes], bytes]], end_id: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, place = tokenizer(), TaskContext.get().partitionId() << 33
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(ids_of(text.as_py()) + end)
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, longest)):
                    length = min(longest, n - start)
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), place))
                    place += 1
            columns = zip(*rows) if rows else [[] for _ in ARROW]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)

    return run


def _fill(capacity: Capacity, weights: tuple[float, float, float], rule: str):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("place", "ascending")])
        lengths = group.column("length").to_numpy()
        bins = best_fit(lengths, capacity, weights, rule)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        first = np.r_[True, bins[order][1:] != bins[order][:-1]]
        begins = np.maximum.accumulate(np.where(first, ends - lengths[order], 0))
        offset = np.empty(len(bins), np.int64)
        offset[order] = ends - lengths[order] - begins
        ids = (group.column("worker").to_numpy() << 33) + 2 * bins
        columns = [group.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        return pa.table([*columns, pa.array(ids), pa.array(offset)], names=[c.split()[0] for c in PACKED.split(", ")])

    return run


def pack(docs: DataFrame, tokenizer: Callable[[], Callable[[bytes], bytes]], end_id: int, capacity: Capacity | None = None,
         weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", group: int = GROUP) -> DataFrame:
    """Pack all rows of ``docs`` (doc_id, text; more columns are ignored) into few sequences.

    ``tokenizer`` makes, once per worker, a function from UTF-8 text to little-endian 32-bit ids;
    ``end_id`` closes every document. Returns one row per piece: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset. Only a document longer than ``capacity.piece`` is cut, into pieces of
    that length and a rest; pieces stand gapless in their sequence, which keeps every capacity.

    Null and empty texts are the end id alone. Rows that repeat are packed each, ties keep the order they were
    read in. Null ids are carried; ids that are no whole numbers raise TypeError. An empty table
    gives no rows.
    """
    capacity = capacity or Capacity()
    data = whole_ids(docs).select("doc_id", text_bytes().alias("text"))
    pieces = written(data.mapInArrow(_cut(tokenizer, end_id, capacity.piece), PIECE), "pieces")
    # a piece that leaves no room for another one is a sequence
    full = (F.col("length") == capacity.tokens) | (F.col("length") * F.col("length") == capacity.cost) | F.lit(capacity.docs == 1)
    alone = pieces.filter(full).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("place") * 2 + 1).alias("sequence_id"),
                                       F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(~full)
    groups = max(1, -(-rest.count() // group))
    dealt = rest.withColumn("worker", F.pmod(F.xxhash64("place"), F.lit(groups)).cast("long"))
    return alone.unionByName(dealt.groupBy("worker").applyInArrow(_fill(capacity, weights, rule), PACKED))
