"""Harmonic packing of token sequences.

Class k holds pieces longer than capacity/(k+1) and at most capacity/k; a bin of class k is
filled by exactly k pieces. A document is cut into whole bins and a rest. A rest that
would leave more than a small share of its slot unused is cut once more: a piece of exactly
capacity/(k+1), which fills a slot of the next class, and a far shorter rest.

Every task fills bins of its own and sends nothing. What remains of its classes, at most
k-1 pieces each, is packed again by groups of tasks until one group is left; the number of
pieces a group holds depends on the capacity and the group size, not on the data. The last
group puts its pieces, longest first, into the fullest bin that takes them.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.llm.rows import text_bytes, whole_ids, written

CAPACITY = 2048
SLACK = 64  # a rest is left whole if at most 1/SLACK of its slot stays unused
GROUP = 32
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SCHEMA = PIECE + ", worker long, sequence_id long, offset long"


def cut(n: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    pieces = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        slot = capacity // k
        exact = capacity // (k + 1)
        if (slot - rest) * slack <= slot or not exact:
            pieces.append(rest)
            break
        pieces.append(exact)
        rest -= exact
    return pieces


class Bins:
    """Open bins of each class; a bin that has its k pieces is given out."""

    def __init__(self, capacity: int, worker: int, first: int):
        self.capacity, self.worker, self.next = capacity, worker, first
        self.open: dict[int, list[tuple]] = {}

    def add(self, piece: tuple) -> list[tuple]:
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) < k:
            return []
        self.open[k] = []
        return self.close(held)

    def close(self, held: list[tuple]) -> list[tuple]:
        out, at = [], 0
        for p in held:
            out.append((*p, self.worker, self.next, at))
            at += p[2]
        self.next += 1
        return out

    def rest(self) -> list[tuple]:
        return [(*p, self.worker, None, None) for held in self.open.values() for p in held]

    def last(self) -> list[tuple]:
        """Best fit of all that is left, longest first."""
        pieces = sorted((p for held in self.open.values() for p in held), key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1]))
        room: list[tuple[int, int]] = []
        bins: list[list[tuple]] = []
        for p in pieces:
            i = bisect.bisect_left(room, (p[2], -1))
            left, b = room.pop(i) if i < len(room) else (self.capacity, len(bins))
            if b == len(bins):
                bins.append([])
            bins[b].append(p)
            if left > p[2]:
                bisect.insort(room, (left - p[2], b))
        return [row for held in bins for row in self.close(held)]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "worker", "sequence_id", "offset")])


def _first_round(tokenizer: Callable[[], Callable[[bytes], bytes]], end_id: int, capacity: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, worker = tokenizer(), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        bins = Bins(capacity, worker, worker << 33)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(ids_of(text.as_py()) + end)
                n, at = len(ids) // 4, 0
                for length in cut(n, capacity, slack):
                    rows += bins.add((doc_id, at, length, zlib.crc32(ids[4 * at:4 * (at + length)]), n))
                    at += length
            yield _batch(rows, ARROW)
        yield _batch(bins.rest(), ARROW)

    return run


def _next_round(round_no: int, capacity: int, last: bool):
    def run(rest: pa.Table) -> pa.Table:
        worker = rest.column("worker")[0].as_py() // GROUP
        rest = rest.sort_by([("worker", "ascending"), ("doc_id", "ascending"), ("start", "ascending"), ("length", "ascending")])
        bins = Bins(capacity, worker, (round_no << 56) + (worker << 24))
        rows = []
        for p in zip(*[rest.column(c).to_pylist() for c in ARROW.names[:5]]):
            rows += bins.add(p)
        rows += bins.last() if last else bins.rest()
        return pa.Table.from_batches([_batch(rows, ARROW)])

    return run


def pack(docs: DataFrame, tokenizer: Callable[[], Callable[[bytes], bytes]], end_id: int, capacity: int = CAPACITY,
         slack: int = SLACK) -> DataFrame:
    """Pack all rows of ``docs`` (doc_id, text; more columns are ignored) into sequences.

    ``tokenizer`` makes, once per worker, a function from UTF-8 text to little-endian 32-bit ids;
    ``end_id`` closes every document. Returns one row per piece: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset. Each id of a document is in exactly one piece,
    pieces stand gapless in their sequence, a sequence holds at most ``capacity`` ids.

    Null and empty texts are the end id alone. A text of any length is cut; rows that repeat are
    packed each. Null ids are carried; ids that are no whole numbers raise TypeError. An empty table
    gives no rows.
    """
    data = whole_ids(docs).select("doc_id", text_bytes().alias("text"))
    packed = written(data.mapInArrow(_first_round(tokenizer, end_id, capacity, slack), SCHEMA), "packed")
    done = packed.filter("sequence_id is not null")
    rest = packed.filter("sequence_id is null")
    most = rest.agg(F.max("worker")).first()[0]
    round_no = 1
    while most is not None:
        last = most // GROUP == 0
        regrouped = rest.groupBy(F.floor(F.col("worker") / GROUP).alias("next")).applyInArrow(_next_round(round_no, capacity, last), SCHEMA)
        packed = written(regrouped, "packed")
        done = done.unionByName(packed.filter("sequence_id is not null"))
        rest = packed.filter("sequence_id is null")
        most = None if last else most // GROUP
        round_no += 1
    return done.drop("worker")
