"""Scoring of (question, context) pairs and everything ranked by the score."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askgrid.functions.text import ENGLISH_STOP_WORDS, tokenize_terms
from askgrid.operators.lexical import LexicalIndex, stems_of
from askgrid.operators.sizing import broadcast_if_small, top_per_group
from askgrid.session import cut_lineage

# Contexts kept per question, candidates before and after reranking.
CONTEXTS_KEPT = 5
TOP_K_RETRIEVAL = 20
TOP_K_RERANK = 5


def question_vectors(questions: DataFrame, stop_words: Iterable[str] = ENGLISH_STOP_WORDS, stemmed: bool = False) -> DataFrame:
    """Term counts of the questions with their length: (question_idx, term, qtf, qnorm)."""
    terms = questions.select("question_idx", F.explode(tokenize_terms("question", stop_words)).alias("term"))
    terms = stems_of(terms, ["question_idx"]) if stemmed else terms
    counts = terms.groupBy("question_idx", "term").agg(F.count("*").alias("qtf"))
    norms = counts.groupBy("question_idx").agg(F.sqrt(F.sum(F.col("qtf") * F.col("qtf"))).alias("qnorm"))
    return counts.join(norms, "question_idx")


def cosine_scores(pairs: DataFrame, questions: DataFrame, postings: DataFrame | LexicalIndex,
                  stop_words: Iterable[str] = ENGLISH_STOP_WORDS, stemmed: bool = False) -> DataFrame:
    """Default scorer: cosine of the term counts of question and context, added to pairs
    (question_idx, node_id, ..) as ``score``. Counts come from the term table, of which
    only the rows of the candidate nodes are read on; 0 where no term is shared."""
    wanted = cut_lineage(pairs.select("question_idx", "node_id").distinct())
    nodes = broadcast_if_small(wanted.select("node_id").distinct())
    found = postings.of_nodes(nodes) if isinstance(postings, LexicalIndex) else postings.join(nodes, "node_id", "left_semi")
    terms = cut_lineage(found.select("node_id", "term", "tf"))
    norms = terms.groupBy("node_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("dnorm"))
    asked = wanted.join(question_vectors(questions, stop_words, stemmed), "question_idx")
    scores = (
        asked.join(terms, ["node_id", "term"])
        .groupBy("question_idx", "node_id")
        .agg(F.sum(F.col("qtf") * F.col("tf")).alias("dot"), F.first("qnorm").alias("qnorm"))
        .join(norms, "node_id")
        .select("question_idx", "node_id",
                F.round(F.col("dot") / (F.col("qnorm") * F.col("dnorm")), 6).alias("score"))
    )
    return pairs.join(scores, ["question_idx", "node_id"], "left").withColumn(
        "score", F.coalesce("score", F.lit(0.0)))


def rank_per_group(df: DataFrame, groups: Sequence[str], score: str = "score", idx: str = "idx",
                   out: str = "rank") -> DataFrame:
    """Position by descending score; equal scores keep their input order."""
    order = W.partitionBy(*groups).orderBy(F.col(score).desc(), F.col(idx))
    return df.withColumn(out, F.row_number().over(order))


def rerank_topn(scored: DataFrame, groups: Sequence[str], top_n: int | None = None,
                idx: str = "idx") -> DataFrame:
    """Contexts by descending score, ties in input order; no or non-positive top_n keeps all."""
    order = [F.col("score").desc(), F.col(idx)]
    if top_n is not None and top_n > 0:
        return top_per_group(scored, groups, order, top_n)
    return rank_per_group(scored, groups, idx=idx)


def rerank_keep_original(docs: DataFrame, groups: Sequence[str], new_score: Column | None,
                         top_k: int | None = None, idx: str = "idx", return_scores: bool = True,
                         score: str = "score", original: str = "original_score") -> DataFrame:
    """Re-rank scored records. An old score moves to ``original`` where there is one; with
    return_scores off the old score stays and orders the records, so it must exist."""
    had_score = score in docs.columns
    if not return_scores and not had_score:
        raise ValueError(f"without new scores the records need a column {score}")
    out = docs
    if had_score:
        out = out.withColumn(original, F.col(score))
    if return_scores:
        out = out.withColumn(score, new_score)
    order = [F.col(score).desc(), F.col(idx)]
    if top_k is not None and top_k > 0:
        return top_per_group(out, groups, order, top_k)
    return out.withColumn("rank", F.row_number().over(W.partitionBy(*groups).orderBy(*order)))


def limit_prerank(candidates: DataFrame, groups: Sequence[str], use_reranker: bool = True,
                  k_retrieval: int = TOP_K_RETRIEVAL, k_rerank: int = TOP_K_RERANK,
                  idx: str = "idx") -> DataFrame:
    """The first k_retrieval by retrieval order, of them the best k_rerank: by score, or by
    retrieval order with the reranker off."""
    first = top_per_group(candidates, groups, [F.col(idx)], k_retrieval, "retrieval_rank")
    order = [F.col("score").desc(), F.col(idx)] if use_reranker else [F.col(idx)]
    return top_per_group(first, groups, order, k_rerank)


def contexts_per_question(ranked: DataFrame, n: int = CONTEXTS_KEPT) -> DataFrame:
    """The first n contexts of each question as one ordered array (question_idx, contexts)."""
    return (
        ranked.filter(F.col("rank") <= n)
        .groupBy("question_idx")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("c"))
        .select("question_idx", F.transform("c", lambda c: c["text"]).alias("contexts"))
    )
