"""The index of a corpus: nodes, term table and leaf vectors, built once for all questions."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.functions.text import ENGLISH_STOP_WORDS
from askgrid.operators.chunking import CHILD_SIZE, OVERLAP, PARENT_SIZE, chunk_hierarchical
from askgrid.operators.dense import DIMENSION, SegmentVectors, hashed_bags, hashed_vectors
from askgrid.operators.models import EmbedFactory, embed_with
from askgrid.operators.lexical import LexicalIndex, build_lexical_index, term_postings
from askgrid.operators.sizing import spread
from askgrid.session import scratch_path

TREE = ("level", "parent_id", "n_siblings")


@dataclass(frozen=True)
class RetrievalIndex:
    nodes: DataFrame      # node_id, doc_id, level, parent_id, seq, n_siblings, text
    lexical: LexicalIndex  # of all nodes
    vectors: DataFrame    # node_id, parent_id, n_siblings, vector - of the leaves
    stop_words: tuple[str, ...]
    embed: EmbedFactory | None = None  # the model that made the vectors; queries need the same
    made: SegmentVectors | None = None  # where the vectors are a view of segments

    @property
    def searched(self) -> DataFrame | SegmentVectors:
        """The vectors in the form that a search reads them in."""
        return self.vectors if self.made is None else self.made

    def query_vectors(self, queries: DataFrame) -> DataFrame:
        """Vectors of queries (query_id, text), made like those of the nodes."""
        if self.embed is not None:
            return embed_with(queries.select("query_id", "text"), self.embed).drop("text")
        terms = term_postings(queries.withColumnRenamed("query_id", "node_id"), self.stop_words, stemmed=self.lexical.stemmed)
        return hashed_vectors(terms).withColumnRenamed("node_id", "query_id")

    def unpersist(self) -> None:
        self.vectors.unpersist()
        self.lexical.unpersist()


def build_index(docs: DataFrame, sizes: Sequence[int] = (PARENT_SIZE, CHILD_SIZE), overlap: int = OVERLAP,
                stop_words: Iterable[str] = ENGLISH_STOP_WORDS, embed: EmbedFactory | None = None,
                stemmed: bool = False) -> RetrievalIndex:
    """Chunk documents (doc_id, text) and index the nodes: one pass over the documents finds the nodes and
    their terms, for stems one more over the node texts; the vectors are made from the rows of the term table, or by a model
    (``embed``) from the texts of the leaves. ``stemmed`` indexes English stems in place of terms; all
    plans over the index then match by stems.

    Nodes and their terms are written as tables in the shared folder, from which each step reads
    only the columns it needs. Vectors are made from the written rows by each search, or where there
    are none cached when first used; blocks lost with an executor are rebuilt from the tables.
    """
    words = tuple(stop_words)
    spark = docs.sparkSession
    path = scratch_path(spark, "nodes")
    counted = {} if stemmed else {"stop_words": words, "dim": DIMENSION if embed is None else None}
    cut = chunk_hierarchical(spread(docs.select("doc_id", "text")), sizes, overlap, **counted)
    cut.write.parquet(path)
    table = spark.read.parquet(path)
    nodes = table.select("node_id", "doc_id", *TREE[:2], "seq", TREE[2], "text")
    lexical = build_lexical_index(table, words, TREE, stemmed)
    leaf = F.col("level") == len(sizes) - 1
    made = None
    if embed is None and lexical.segments is not None:
        made = SegmentVectors(lexical.segments, len(sizes) - 1, keep=("parent_id", "n_siblings"))
        vectors = made.rows()
    elif embed is None and lexical.bags is not None:
        vectors = hashed_bags(lexical.bags.filter(leaf), keep=("parent_id", "n_siblings"))
    elif embed is None:
        vectors = hashed_vectors(lexical.postings.filter(leaf), keep=("parent_id", "n_siblings"))
    else:
        texts = nodes.filter(leaf).select("node_id", "parent_id", "n_siblings", "text")
        vectors = embed_with(texts.filter("text is not null"), embed).drop("text")
    if made is None:
        vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    return RetrievalIndex(nodes, lexical, vectors, words, embed, made)


def save_index(index: RetrievalIndex, path: str, buckets: int = 200) -> None:
    """Keep an index for later sessions. The term table is bucketed by node, which is the
    placement its queries rely on; every task writes the one file of its bucket."""
    spark = index.nodes.sparkSession
    index.nodes.write.parquet(os.path.join(path, "nodes"))
    index.vectors.write.parquet(os.path.join(path, "vectors"))
    index.lexical.terms.write.parquet(os.path.join(path, "terms"))
    table = f"askgrid_{uuid.uuid4().hex}"
    (index.lexical.postings.repartition(buckets, "node_id").write.bucketBy(buckets, "node_id")
        .option("path", os.path.join(path, "postings")).saveAsTable(table))
    spark.sql(f"DROP TABLE {table}")  # the files stay where they are
    facts = [(index.lexical.n_nodes, float(index.lexical.avg_len), list(index.stop_words), buckets, index.lexical.stemmed)]
    spark.createDataFrame(
        facts, "n_nodes long, avg_len double, stop_words array<string>, buckets int, stemmed boolean"
    ).coalesce(1).write.parquet(os.path.join(path, "facts"))


def load_index(spark: SparkSession, path: str, embed: EmbedFactory | None = None) -> RetrievalIndex:
    """An index saved by save_index, read from its tables instead of being built. ``embed`` is the
    model it was built with, if any."""
    facts = spark.read.parquet(os.path.join(path, "facts")).first()
    place = os.path.join(path, "postings")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(place).schema)
    table = f"askgrid_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet "
        f"CLUSTERED BY (node_id) INTO {facts.buckets} BUCKETS LOCATION '{place}'"
    )
    lexical = LexicalIndex(spark.table(table), facts.n_nodes, facts.avg_len, spark.read.parquet(os.path.join(path, "terms")), facts.stemmed)
    return RetrievalIndex(
        spark.read.parquet(os.path.join(path, "nodes")), lexical,
        spark.read.parquet(os.path.join(path, "vectors")), tuple(facts.stop_words), embed,
    )


def index_summary(index: RetrievalIndex) -> DataFrame:
    """Nodes per level with their words and terms."""
    nodes = index.nodes.groupBy("level").agg(
        F.count("*").alias("n_nodes"), F.count_distinct("doc_id").alias("n_docs"))
    terms = index.lexical.postings.groupBy("level").agg(
        F.sum("tf").alias("n_terms"), F.count("*").alias("n_postings"))
    return nodes.join(terms, "level", "left")
