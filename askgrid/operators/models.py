"""Slots for models: embedding, pair scoring and text generation.

A slot takes a factory that is called once per Python worker and returns a function on a
batch of values. Models see Arrow batches; everything around them stays in the JVM. Without
a model the engine uses hashed_vectors, cosine_scores and keyword_subqueries instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgrid.functions.stem import stem_table
from askgrid.functions.text import ENGLISH_STOP_WORDS
from askgrid.operators.lexical import LexicalIndex, document_frequencies, idf, query_terms
from askgrid.operators.sizing import broadcast_if_small, top_per_group
from askgrid.session import cut_lineage

# Pairs per scoring call and longest text, in model tokens.
BATCH_SIZE = 32
MAX_LENGTH = 1024

EmbedFactory = Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]]
ScoreFactory = Callable[[], Callable[[list[str], list[str]], Sequence[float]]]
InferFactory = Callable[[], Callable[[list[str]], Sequence[str]]]


def embed_with(df: DataFrame, factory: EmbedFactory, text: str = "text", out: str = "vector",
               batch_size: int = BATCH_SIZE) -> DataFrame:
    """Add model vectors of a text column."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for batch in texts:
            values = batch.tolist()
            vectors = [
                list(map(float, v))
                for i in range(0, len(values), batch_size) for v in model(values[i:i + batch_size])
            ]
            yield pd.Series(vectors, dtype=object)

    return df.withColumn(out, embed(F.col(text)))


def score_with(df: DataFrame, factory: ScoreFactory, query: str = "question", text: str = "text",
               out: str = "score", batch_size: int = BATCH_SIZE) -> DataFrame:
    """Add model scores of (query, text) pairs. The model cuts texts to its length limit."""
    @F.pandas_udf(T.DoubleType())
    def score(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for queries, texts in columns:
            q, t = queries.tolist(), texts.tolist()
            scores = [
                float(s)
                for i in range(0, len(t), batch_size)
                for s in model(q[i:i + batch_size], t[i:i + batch_size])
            ]
            yield pd.Series(scores, dtype="float64")

    return df.withColumn(out, score(F.col(query), F.col(text)))


def score_or_error(df: DataFrame, factory: ScoreFactory, query: str = "question", text: str = "text",
                   batch_size: int = BATCH_SIZE) -> DataFrame:
    """As score_with, where a pair the model fails on gets no score and the message as ``score_err``.
    A batch that fails is scored pair by pair, so one pair costs only itself its score."""
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("score_err", T.StringType())])

    @F.pandas_udf(kind)
    def score(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        def run(model, q, t):
            try:
                return [(float(s), None) for s in model(q, t)]
            except Exception as e:  # any failure of the model is an outcome, not the end of the job
                return [(None, f"{e}")] if len(q) == 1 else [run(model, [a], [b])[0] for a, b in zip(q, t)]

        model = factory()
        for queries, texts in columns:
            q, t = queries.tolist(), texts.tolist()
            rows = [r for i in range(0, len(t), batch_size) for r in run(model, q[i:i + batch_size], t[i:i + batch_size])]
            yield pd.DataFrame(rows, columns=["score", "score_err"])

    return df.withColumn("_scored", score(F.col(query), F.col(text))).select("*", "_scored.*").drop("_scored")


def infer_with(df: DataFrame, factory: InferFactory, prompt: str = "prompt", out: str = "raw",
               batch_size: int = BATCH_SIZE) -> DataFrame:
    """Add model replies to a prompt column."""
    @F.pandas_udf(T.StringType())
    def infer(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for batch in prompts:
            values = batch.tolist()
            yield pd.Series([
                r for i in range(0, len(values), batch_size) for r in model(values[i:i + batch_size])
            ], dtype=object)

    return df.withColumn(out, infer(F.col(prompt)))


def keyword_subqueries(index: LexicalIndex, questions: DataFrame, n: int | None = None,
                       stop_words: Iterable[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """Key terms of each question (all, or the first n), rarest in the corpus first, joined by
    commas: (question_idx, subquery). Terms the corpus does not hold are left out."""
    terms = cut_lineage(query_terms(
        questions.select(F.col("question_idx").alias("query_id"), F.col("question").alias("text")), stop_words))
    # looked up as the index holds them, shown as the question has them
    vocabulary = terms.select("term").distinct()
    vocabulary = stem_table(vocabulary) if index.stemmed else vocabulary.withColumn("stem", F.col("term"))
    terms = cut_lineage(terms.join(broadcast_if_small(vocabulary), "term"))
    wanted = terms.select(F.col("stem").alias("term")).distinct()
    frequency = document_frequencies(index.facts(wanted)).withColumnRenamed("term", "stem")
    weighted = terms.join(frequency, "stem").withColumn("w", F.round(idf(F.col("df"), index.n_nodes), 6))
    if n is not None:
        weighted = top_per_group(weighted, ["query_id"], [F.col("w").desc(), F.col("term")], n)
    return (
        weighted.groupBy(F.col("query_id").alias("question_idx"))
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("w"), "term"))).alias("t"))
        .select("question_idx", F.array_join(F.transform("t", lambda t: t["term"]), ", ").alias("subquery"))
    )
