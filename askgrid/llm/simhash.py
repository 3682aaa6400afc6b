"""SimHash fingerprints and their near duplicates by anchor points.

Two fingerprints of 64 bits that differ in at most t bits agree in one of their halves up to t//2
bits. In a half, anchors are the words of the Hamming code of 31 bits (one bit is left out of
the comparison): every point is within radius 1 of exactly one. A fingerprint is replicated to all
anchors within radius 1 plus the half's threshold, and is at home at the nearest. For any two
that differ in at most the threshold, the home of one is among the anchors of the other, so it is
enough to compare, per anchor, those at home with all that are there.

Equal fingerprints are merged first. An anchor's members are compared in one task if they are
few; beyond that homes and members are both dealt into slices and each pair of slices is a task.
A task names links by a tree of its linked members, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.llm.rows import keep_rows, text_bytes, written
from askgrid.operators.components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
SLICE = 4096  # members of an anchor that one task compares
BLOCK = 1 << 16
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half the hashes of the text's word shingles."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
    ends = (starts + lengths)[size - 1:].tolist()
    starts, n = starts.tolist(), len(ends)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        some = [digest(joined[a:b], SEED) for a, b in zip(starts[at:min(n, at + BLOCK)], ends[at:at + BLOCK])]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # sums of bytes in blocks of 255 rows at most cannot overflow a byte
        full = len(bits) // 255 * 255
        if full:
            ones += bits[:full].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        ones += bits[full:].sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long, the 64 bits), sha (of the text) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps)], ["doc_id", "sha", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_bytes().alias("text"), F.sha2(text_bytes(), 256).alias("sha")).mapInArrow(
        run, f"doc_id {kind}, sha string, fp long")


# -- anchors -------------------------------------------------------------------------------
def _syndrome(x: np.ndarray) -> np.ndarray:
    """Of the low 31 bits: the exclusive or of the places (1 to 31) of the bits that are set."""
    s = np.zeros(len(x), np.uint64)
    for place in range(1, 32):
        s ^= ((x >> np.uint64(place - 1)) & np.uint64(1)) * np.uint64(place)
    return s


def _patterns(weight: int) -> dict[int, np.ndarray]:
    """By syndrome: all changes of at most ``weight`` bits that lead from a point to an anchor."""
    found: dict[int, list[int]] = {s: [] for s in range(32)}
    for w in range(weight + 1):
        for places in combinations(range(1, 32), w):
            s = 0
            for p in places:
                s ^= p
            found[s].append(sum(1 << (p - 1) for p in places))
    return {s: np.array(v, np.uint64) for s, v in found.items()}


def replicas(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, at home) of every replica; the half is the lowest bit of the anchor."""
    patterns = _patterns(1 + max_bits // 2)
    rows, anchors, homes = [], [], []
    for half in (0, 1):
        part = (fps >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)
        s = _syndrome(part)
        for value in np.unique(s).tolist():
            at, changes = np.flatnonzero(s == value), patterns[int(value)]
            rows.append(np.repeat(at, len(changes)))
            anchors.append(((part[at][:, None] ^ changes[None, :]) << np.uint64(1) | np.uint64(half)).ravel())
            homes.append(np.tile(np.bitwise_count(changes) <= 1, len(at)))
    return np.concatenate(rows), np.concatenate(anchors), np.concatenate(homes)


def _replicate(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fps = batch.column(0)[at:at + 20_000].to_numpy().view(np.uint64)
                row, anchor, home = replicas(fps, max_bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(fps[row].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])

    return run


def link_tree(homes: np.ndarray, members: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of: a home and a member that differ in at most max_bits."""
    every = np.unique(np.concatenate([homes, members]))
    root = np.arange(len(every))
    links = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    mine = np.searchsorted(every, members)
    for h in np.unique(homes):
        i = int(np.searchsorted(every, h))
        near = np.unique(mine[np.bitwise_count(members ^ h) <= max_bits])
        # one link to each tree the near members stand in joins all of them
        for r in np.unique(root[near]).tolist():
            a, b = find(i), find(r)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((int(h), int(every[r])))
    return links


def _compare(max_bits: int):
    """Links of all anchors of a partition sorted by anchor."""

    def links_of(anchor, fp, home):
        n = len(fp)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        size = np.diff(np.append(first, n))
        out = []
        small = np.repeat(size <= 32, size)
        for step in range(1, 32):  # neighbours at each distance, all small anchors at once
            if n <= step:
                break
            i = np.flatnonzero(small[step:] & (anchor[step:] == anchor[:-step]) & (home[step:] | home[:-step]))
            near = i[(np.bitwise_count(fp[i] ^ fp[i + step]) <= max_bits) & (fp[i] != fp[i + step])]
            out += zip(fp[near].tolist(), fp[near + step].tolist())
        for a, k in zip(first[size > 32].tolist(), size[size > 32].tolist()):
            f, h = fp[a:a + k], home[a:a + k]
            if h.any():
                out += link_tree(f[h], f, max_bits)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def emit(anchor, fp, home):
            links = np.array(links_of(anchor, fp.view(np.uint64), home), np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
            # the last anchor may go on in the next batch
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if cut:
                yield emit(*[c[:cut] for c in cols])
            held = [c[cut:].copy() for c in cols]
        if held is not None and len(held[0]):
            yield emit(*held)

    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fps`` (fp long, distinct) to links (a, b): their components are those of all pairs of
    fingerprints that differ in at most ``max_bits`` (at most 3: halves differ in 1)."""
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits 0 to 3")
    placed = written(fps.select("fp").mapInArrow(_replicate(max_bits), "anchor long, fp long, home boolean"), "anchors")
    crowded = placed.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > SLICE)
    crowded = written(crowded.select("anchor", F.ceil(F.col("n") / SLICE).cast("int").alias("slices")), "crowded")
    parts = max(placed.sparkSession.sparkContext.defaultParallelism, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    compare, schema = _compare(max_bits), "a long, b long"
    if crowded.isEmpty():
        dealt = placed.repartition(parts, "anchor").sortWithinPartitions("anchor")
        return dealt.mapInArrow(compare, schema)
    usual = placed.join(crowded, "anchor", "left_anti").repartition(parts, "anchor").sortWithinPartitions("anchor")
    hot = placed.join(crowded, "anchor").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int"))
    # home slice i meets member slice j in task (i, j)
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    homes = hot.filter("home").select("anchor", "fp", "home", F.col("own").alias("i"), other.alias("j"))
    members = hot.select("anchor", "fp", F.lit(False).alias("home"), other.alias("i"), F.col("own").alias("j"))
    cell = F.xxhash64("anchor", "i", "j").alias("cell")
    dealt = homes.unionByName(members).select(cell, "fp", "home").repartition(parts, "cell").sortWithinPartitions("cell")
    return usual.mapInArrow(compare, schema).unionByName(dealt.mapInArrow(compare, schema))


def near_components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, sha (of the text), fp, component_id, root (a fingerprint that names the component) for
    every row of ``docs`` (doc_id, text; more columns are ignored).

    component_id: the smallest doc_id reachable by links of at most ``max_bits`` differing bits,
    equal fingerprints included. Null and empty texts have fingerprint 0 and are linked like any
    other. Null ids never are the smallest, unless a component has no other. Repeated rows
    are alike. An empty table gives no rows.
    """
    marked = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(links(distinct, max_bits)).withColumnRenamed("node", "fp")
    rooted = written(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    # a written side lets the joins split a root or a fingerprint that very many rows have
    lows = written(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    labelled = written(rooted.join(lows, "root").select("fp", "component_id", "root"), "labels")
    return marked.join(labelled, "fp").select("doc_id", "sha", "fp", "component_id", "root")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """As the contract asks: doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return near_components(docs, shingle, max_bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows of ``docs`` with one document of each component left: the one with the smallest id, a null
    id only if there is no other. Of rows of the component that share that id, the first by text
    hash stays. Components are told apart by their root, as several may have the same smallest id
    or none. Columns stay as they were."""
    marked = written(near_components(docs, shingle, max_bits), "near")
    texts = marked.groupBy("root", "doc_id", "sha").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sha", "rows"))
    return keep_rows(docs, texts.groupBy("root").agg(first.alias("f")).select("f.doc_id", "f.sha", "f.rows"))
