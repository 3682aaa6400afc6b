"""Exact vector search and the default text vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from askgrid.operators.lexical import SEGMENT, TOP_K, numbers, split_bags
from askgrid.operators.sizing import BLOCK_BYTES, blocks, top_per_group
from askgrid.session import cut_lineage

DIMENSION = 256
# Query vectors reach the tasks as one matrix of at most this many bytes; more queries
# are searched in several passes.
MAX_QUERY_BYTES = 64 << 20
# Queries multiplied with a batch at a time.
QUERY_BLOCK = 256
# Vectors made at a time from the counts of a run of nodes.
VECTOR_ROWS = 8192
SPARSE_VECTOR = T.StructType([
    T.StructField("dim", T.IntegerType(), False), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.DoubleType()))])


def vector_dimension(vectors: DataFrame) -> DataFrame:
    """Smallest and largest vector length; both must agree before vectors are searched."""
    length = vector_length(F.col("vector"), is_sparse(vectors))
    return vectors.agg(
        F.min(length).alias("min_dim"), F.max(length).alias("max_dim"), F.count("*").alias("n_vectors"),
    ).withColumn("is_constant", F.col("min_dim") == F.col("max_dim"))


def hashed_vectors(postings: DataFrame, dim: int = DIMENSION, keep: Sequence[str] = ()) -> DataFrame:
    """Default text vectors: term counts hashed into ``dim`` buckets, scaled to length 1, as
    struct (dim, at, x) of the buckets in use. Stays inside the placement by node_id, so
    nothing is shuffled. A text without terms has no vector."""
    bucket = (F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long") % dim).cast("int")
    counts = postings.groupBy("node_id", *keep, bucket.alias("bucket")).agg(F.sum("tf").alias("n"))
    by_node = counts.groupBy("node_id", *keep).agg(
        F.collect_list(F.struct("bucket", "n")).alias("e"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm")
    )
    values = F.transform("e.n", lambda n: n / F.col("norm"))
    return by_node.select("node_id", *keep, F.struct(
        F.lit(dim).alias("dim"), F.col("e.bucket").alias("at"), values.alias("x")).alias("vector"))


def term_buckets(terms: pa.Array, dim: int) -> np.ndarray:
    """The bucket of each term, as in hashed_vectors."""
    heads = b"".join([hashlib.md5(t).digest()[:4] for t in terms.cast(pa.binary()).to_numpy(zero_copy_only=False)])
    return np.frombuffer(heads, ">u4").astype(np.int64) % dim


def _vectors(row: np.ndarray, bucket: np.ndarray, n: np.ndarray, n_rows: int, dim: int) -> pa.StructArray:
    """Sparse vectors of the counts of buckets, in the order of their rows."""
    norms = np.sqrt(np.bincount(row, n * n, n_rows))
    ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=n_rows))), pa.int32())
    return pa.StructArray.from_arrays([
        pa.array(np.full(n_rows, dim), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(bucket, pa.int32())),
        pa.ListArray.from_arrays(ends, pa.array(n / norms[row], pa.float64()))], ["dim", "at", "x"])


@dataclass(frozen=True)
class SegmentVectors:
    """The default vectors of one level of the nodes in segments whose terms were hashed when they were
    written. A search makes them inside its tasks (``made``); ``rows`` are the vectors as a table."""

    segments: DataFrame
    level: int
    dim: int = DIMENSION
    keep: tuple[str, ...] = ()

    def source(self) -> DataFrame:
        return self.segments.select(*dict.fromkeys(["buckets", "codes", "tfs", "n", "level", "node_id", *self.keep]))

    def schema(self) -> T.StructType:
        kinds = [T.StructField(c, SEGMENT[c].dataType.elementType) for c in ("node_id", *self.keep)]
        return T.StructType([*kinds, T.StructField("vector", SPARSE_VECTOR)])

    def rows(self) -> DataFrame:
        return self.source().mapInArrow(self.made(), self.schema())

    def made(self) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        level, dim, columns = self.level, self.dim, ("node_id", *self.keep)

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    n, leaf = numbers(batch.column("n"), i), numbers(batch.column("level"), i) == level
                    some, leaves = np.repeat(leaf, n), np.flatnonzero(leaf)
                    row = np.repeat(np.arange(len(leaves)), n[leaves])
                    bucket = numbers(batch.column("buckets"), i)[numbers(batch.column("codes"), i)[some]]
                    tf = numbers(batch.column("tfs"), i)[some]
                    for first in range(0, len(leaves), VECTOR_ROWS):  # a dense matrix of counts at a time
                        held = slice(*np.searchsorted(row, (first, first + VECTOR_ROWS)))
                        rows = pa.array(leaves[first:first + VECTOR_ROWS])
                        counts = np.bincount((row[held] - first) * dim + bucket[held], tf[held])
                        cells = np.flatnonzero(counts)
                        vector = _vectors(cells // dim, cells % dim, counts[cells], len(rows), dim)
                        yield pa.RecordBatch.from_arrays(
                            [*[batch.column(c)[i].values.take(rows) for c in columns], vector], [*columns, "vector"])

        return vectors


def hashed_bags(bags: DataFrame, dim: int = DIMENSION, keep: Sequence[str] = ()) -> DataFrame:
    """As hashed_vectors, of one row of words and counts per node: each vector is made inside its row."""
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column("words")).to_numpy(zero_copy_only=False)
            for first, end in blocks(sizes, BLOCK_BYTES):
                rows = batch.slice(first, end - first)
                lengths, words = split_bags(rows.column("words"))
                coded = words.dictionary_encode()
                buckets = term_buckets(coded.dictionary, dim)
                keys = np.repeat(np.arange(rows.num_rows), lengths) * dim + buckets[coded.indices.to_numpy(zero_copy_only=False)]
                keys, at = np.unique(keys, return_inverse=True)
                n = np.bincount(at, rows.column("tfs").flatten().to_numpy())
                vector = _vectors(keys // dim, keys % dim, n, rows.num_rows, dim)
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("node_id", *keep)], vector], ["node_id", *keep, "vector"])

    schema = T.StructType([*[bags.schema[c] for c in ("node_id", *keep)], T.StructField("vector", SPARSE_VECTOR)])
    return bags.select("node_id", *keep, "words", "tfs").mapInArrow(vectors, schema)


def vector_length(vector: Column, sparse: bool) -> Column:
    return vector["dim"] if sparse else F.size(vector)


def is_sparse(vectors: DataFrame) -> bool:
    return isinstance(vectors.schema["vector"].dataType, T.StructType)


def searchable(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors that can be compared with one of length ``dim``: not null, of that length, no null value."""
    v = F.col("vector")
    if is_sparse(vectors):
        return vectors.filter(v.isNotNull() & (v["dim"] == dim) & ~F.exists(v["x"], F.isnull))
    return vectors.filter(v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, F.isnull))


def rejected_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """The rows a search for vectors of length ``dim`` leaves out."""
    v = F.col("vector")
    if is_sparse(vectors):
        return vectors.filter(v.isNull() | (v["dim"] != dim) | F.exists(v["x"], F.isnull))
    return vectors.filter(v.isNull() | (F.size(v) != dim) | F.exists(v, F.isnull))


def _without_nulls(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows whose vector holds no null value."""
    lists = batch.column("vector")
    lists = lists.field("x") if pa.types.is_struct(lists.type) else lists
    values = lists.flatten()
    if not values.null_count:
        return batch
    rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    whole = np.ones(len(lists), bool)
    whole[rows[values.is_null().to_numpy(zero_copy_only=False)]] = False
    return batch.filter(pa.array(whole))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of vectors as a matrix; sparse vectors are filled up with zeros here."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_struct(values.type):
        at, x = values.field("at"), values.field("x")
        rows = np.repeat(np.arange(len(values)), at.value_lengths().to_numpy(zero_copy_only=False))
        m = np.zeros((len(values), dim))
        m[rows, at.flatten().to_numpy(zero_copy_only=False)] = x.flatten().to_numpy(zero_copy_only=False)
        return m
    m = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    if len(m) != len(values):
        raise ValueError("vectors of unequal length")
    return m


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def _first_k(found: pa.Table, k: int) -> pa.Table:
    """First k rows per query by key, then node id."""
    found = found.sort_by([("q", "ascending"), ("key", "ascending"), ("node_id", "ascending")])
    q = found["q"].to_numpy()
    starts = np.searchsorted(q, q, side="left")
    return found.filter(pa.array(np.arange(len(q)) - starts < k))


def _search_slice(vectors: DataFrame | SegmentVectors, queries: pa.Table, k: int, cosine: bool,
                  threshold: float | None, value: str, carry: Sequence[str]) -> DataFrame:
    first = queries["vector"][0].as_py()
    dim = first["dim"] if isinstance(first, dict) else len(first)
    wanted = _matrix(queries["vector"], dim)
    wanted = _unit(wanted) if cosine else wanted
    sizes = np.einsum("ij,ij->i", wanted, wanted)
    query_ids = queries["query_id"].combine_chunks()
    made = vectors.made() if isinstance(vectors, SegmentVectors) else None
    kinds = vectors.schema() if made else vectors.schema

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, floor = None, np.full(len(wanted), np.inf)
        for batch in map(_without_nulls, batches if made is None else made(batches)):
            if batch.num_rows == 0:
                continue
            rows = _matrix(batch.column("vector"), dim)
            rows = _unit(rows) if cosine else rows
            norms = np.einsum("ij,ij->i", rows, rows)
            longest = norms.max()
            picked = []
            for j in range(len(wanted)):
                # a quick estimate narrows the rows; the few left are measured exactly
                if j % QUERY_BLOCK == 0:
                    products = rows @ wanted[j:j + QUERY_BLOCK].T
                rough = norms + sizes[j] - 2.0 * products[:, j % QUERY_BLOCK]
                slack = 2e-6 + 1e-12 * (longest + sizes[j])
                near = np.flatnonzero(rough <= floor[j] + slack)
                if len(near) > k:
                    cut = np.partition(rough[near], k - 1)[k - 1]
                    near = near[rough[near] <= cut + slack]
                if not len(near):
                    continue
                if cosine:
                    key = -np.round(rows[near] @ wanted[j], 6)
                else:
                    diff = rows[near] - wanted[j]
                    key = np.round(np.einsum("ij,ij->i", diff, diff), 6)
                if threshold is not None:
                    keep = -key >= threshold if cosine else key <= threshold
                    near, key = near[keep], key[keep]
                table = pa.table({
                    "q": np.full(len(near), j), "key": key,
                    **{c: batch.column(c).take(pa.array(near)) for c in ("node_id", *carry)},
                })
                picked.append(_first_k(table, k) if len(near) > k else table)
            if not picked:
                continue
            merged = pa.concat_tables(picked if best is None else [best, *picked])
            best = _first_k(merged, k)
            # a row beyond a query's k-th estimate so far is none of its k best
            q, n = np.unique(best["q"].to_numpy(), return_counts=True)
            last = best["key"].to_numpy()[np.cumsum(n)[n == k] - 1]
            floor[q[n == k]] = 2 + 2 * last if cosine else last
        if best is not None and best.num_rows:
            key = best["key"].to_numpy()
            out = pa.table({
                "query_id": query_ids.take(best["q"].combine_chunks()),
                "node_id": best["node_id"], value: -key if cosine else key,
                **{c: best[c] for c in carry},
            })
            yield from out.combine_chunks().to_batches()

    schema = T.StructType([
        T.StructField("query_id", from_arrow_type(queries.schema.field("query_id").type)),
        T.StructField("node_id", kinds["node_id"].dataType),
        T.StructField(value, T.DoubleType()),
        *[T.StructField(c, kinds[c].dataType) for c in carry],
    ])
    if made:
        return vectors.source().mapInArrow(search, schema)
    alike = vector_length(F.col("vector"), is_sparse(vectors)) == dim
    return vectors.select("node_id", "vector", *carry).filter(F.col("vector").isNotNull() & alike).mapInArrow(search, schema)


def _search(vectors: DataFrame | SegmentVectors, queries: DataFrame, k: int, cosine: bool, threshold: float | None,
            value: str, carry: Sequence[str]) -> DataFrame:
    """Every task keeps its k best rows per query; only those are shuffled and ranked. Queries of
    each length are searched apart, among vectors of that length."""
    queries = queries.select("query_id", "vector").filter("vector is not null")
    queries = cut_lineage(queries)
    length = vector_length(F.col("vector"), is_sparse(queries))
    whole = ~F.exists(F.col("vector")["x"] if is_sparse(queries) else F.col("vector"), F.isnull)
    lengths = queries.filter(whole & (length > 0)).groupBy(length.alias("dim")).agg(F.count("*").alias("n")).collect()
    if isinstance(vectors, SegmentVectors):
        lengths = [r for r in lengths if r.dim == vectors.dim]
        kinds = vectors.schema()
    else:
        kinds = vectors.schema
    if len(lengths) > 1:  # only those some stored vector has are worth a search
        stored = vector_length(F.col("vector"), is_sparse(vectors))
        found = vectors.filter(stored.isin([r.dim for r in lengths])).select(stored.alias("dim")).distinct().collect()
        lengths = [r for r in lengths if r.dim in {f.dim for f in found}]
    parts = []
    for dim, n in sorted(lengths):
        alike = searchable(queries, dim)
        passes = max(1, -(-n * dim * 8 // MAX_QUERY_BYTES))
        for i in range(passes):
            part = alike if passes == 1 else alike.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)
            table = part.toArrow()
            if table.num_rows:
                parts.append(_search_slice(vectors, table, k, cosine, threshold, value, carry))
    if not parts:
        return queries.select(
            "query_id", F.lit(None).cast(kinds["node_id"].dataType).alias("node_id"),
            F.lit(None).cast("double").alias(value),
            *[F.lit(None).cast(kinds[c].dataType).alias(c) for c in carry],
            F.lit(None).cast("int").alias("rank"),
        ).filter(F.lit(False))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = F.col(value).desc() if cosine else F.col(value)
    return top_per_group(found, ["query_id"], [best, F.col("node_id")], k)


def knn_l2(vectors: DataFrame | SegmentVectors, queries: DataFrame, k: int = TOP_K, carry: Sequence[str] = ()) -> DataFrame:
    """Exact k nearest vectors of each query by squared Euclidean distance, rounded to
    6 digits, ties by node id: (query_id, node_id, dist, carried columns, rank). A query meets
    the vectors of its own length (``rejected_vectors`` names the others). Vectors that are null,
    empty or hold nulls are no neighbours of any query, and such queries have no result; other
    queries are not touched by them."""
    return _search(vectors, queries, k, False, None, "dist", carry)


def similarity_topk(vectors: DataFrame, queries: DataFrame, threshold: float = 0.5, k: int = 2) -> DataFrame:
    """Best k vectors of each query whose cosine similarity reaches the threshold."""
    return _search(vectors, queries, k, True, threshold, "similarity", ())
