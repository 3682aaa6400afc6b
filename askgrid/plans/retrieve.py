"""Retrieval of contexts for all questions in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.operators.candidates import hybrid_union, join_docstore, query_table, union_subqueries
from askgrid.operators.dedup import THRESHOLD, greedy_dedup
from askgrid.operators.dense import knn_l2
from askgrid.operators.lexical import TOP_K, bm25_topk
from askgrid.operators.models import ScoreFactory, score_or_error, score_with
from askgrid.operators.sizing import broadcast_if_small
from askgrid.operators.merging import MERGE_RATIO, auto_merge
from askgrid.operators.reranking import CONTEXTS_KEPT, cosine_scores, rerank_topn
from askgrid.plans.index import RetrievalIndex
from askgrid.session import cut_lineage


def retrieve(index: RetrievalIndex, queries: DataFrame, k: int = TOP_K, ratio: float = MERGE_RATIO) -> DataFrame:
    """Candidates of every query (query_id, text): merged dense results, then BM25 results."""
    hits = cut_lineage(
        knn_l2(index.searched, index.query_vectors(queries), k, carry=("parent_id", "n_siblings")))
    dense = auto_merge(hits.drop("rank"), index.nodes, ratio)
    sparse = bm25_topk(index.lexical, queries, k, stop_words=index.stop_words)
    return hybrid_union(dense, sparse)


def candidate_lists(index: RetrievalIndex, questions: DataFrame, subqueries: DataFrame | None = None,
                    k: int = TOP_K) -> DataFrame:
    """Candidates of each question and its sub-queries in retrieval order (.., node_id, ord)."""
    queries = cut_lineage(query_table(questions, subqueries))
    return cut_lineage(union_subqueries(retrieve(index, queries, k)))


def candidate_texts(index: RetrievalIndex, candidates: DataFrame) -> DataFrame:
    """Texts (node_id, text) of all candidates: the one scan of the node texts."""
    return cut_lineage(join_docstore(candidates.select("node_id").distinct(), index.nodes))


def dedup_candidates(candidates: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Mark the candidates of each question that stay; done before reranking, so the first
    in retrieval order survives."""
    rows = candidates.select("question_idx", "ord", F.col("node_id").alias("item_id"))
    items = texts.withColumnRenamed("node_id", "item_id")
    return cut_lineage(greedy_dedup(rows, items, ["question_idx"], "ord", threshold)
                       .withColumnRenamed("item_id", "node_id"))


def rank_contexts(index: RetrievalIndex, questions: DataFrame, marked: DataFrame, texts: DataFrame,
                  top: int | None = CONTEXTS_KEPT, score: ScoreFactory | None = None) -> DataFrame:
    """Best contexts against the question itself, never a sub-query:
    (question_idx, rank, node_id, score, text). Scored by a model where one is given, else by
    the cosine of term counts."""
    pairs = marked.filter("kept").select("question_idx", "ord", "node_id")
    if score is None:
        scored = cosine_scores(pairs, questions, index.lexical, index.stop_words, index.lexical.stemmed)
    else:
        scored = score_with(_asked(pairs, questions, texts), score).select("question_idx", "ord", "node_id", "score")
    return _top(scored, texts, top)


def _asked(pairs: DataFrame, questions: DataFrame, texts: DataFrame) -> DataFrame:
    return join_docstore(pairs, texts).join(broadcast_if_small(questions.select("question_idx", "question")), "question_idx")


def _top(scored: DataFrame, texts: DataFrame, top: int | None) -> DataFrame:
    ranked = rerank_topn(scored, ["question_idx"], top, idx="ord")
    return join_docstore(cut_lineage(ranked.select("question_idx", "rank", "node_id", "score")), texts)


def retrieve_or_fail(index: RetrievalIndex, questions: DataFrame, subqueries: DataFrame | None = None,
                     top: int | None = CONTEXTS_KEPT, score: ScoreFactory | None = None) -> tuple[DataFrame, DataFrame]:
    """As retrieve_contexts, and the questions (question_idx, rerank_err) the scoring model failed on,
    which have no contexts."""
    candidates = candidate_lists(index, questions, subqueries)
    texts = candidate_texts(index, candidates)
    marked = dedup_candidates(candidates, texts)
    if score is None:
        none = questions.select("question_idx", F.lit(None).cast("string").alias("rerank_err")).filter(F.lit(False))
        return rank_contexts(index, questions, marked, texts, top), none
    pairs = marked.filter("kept").select("question_idx", "ord", "node_id")
    scored = cut_lineage(score_or_error(_asked(pairs, questions, texts), score).select("question_idx", "ord", "node_id", "score", "score_err"))
    failed = cut_lineage(scored.filter("score_err is not null").groupBy("question_idx").agg(
        F.min_by("score_err", "ord").alias("rerank_err")))
    return _top(scored.join(failed, "question_idx", "left_anti").drop("score_err"), texts, top), failed


def retrieve_contexts(index: RetrievalIndex, questions: DataFrame, subqueries: DataFrame | None = None,
                      top: int | None = CONTEXTS_KEPT, score: ScoreFactory | None = None) -> DataFrame:
    """Questions (question_idx, question) with sub-queries (question_idx, subquery_no, subquery)
    to their top contexts: retrieve, expand, de-duplicate, rerank, keep the best."""
    candidates = candidate_lists(index, questions, subqueries)
    texts = candidate_texts(index, candidates)
    return rank_contexts(index, questions, dedup_candidates(candidates, texts), texts, top, score)
