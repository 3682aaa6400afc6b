"""Search, optional rerank, optional answer: one result row per question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.operators.candidates import join_docstore
from askgrid.functions.contracts import answer_prompt
from askgrid.operators.models import InferFactory, ScoreFactory, infer_with, score_with
from askgrid.operators.lexical import LexicalIndex, bm25_topk
from askgrid.operators.reranking import TOP_K_RERANK, TOP_K_RETRIEVAL, cosine_scores, limit_prerank
from askgrid.operators.selection import format_docs
from askgrid.session import cut_lineage


def _list(df: DataFrame, rank: str, value: str, out: str) -> DataFrame:
    return df.groupBy("question_idx").agg(
        F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(value).alias("v")))).alias("l")
    ).select("question_idx", F.transform("l", lambda x: x["v"]).alias(out))


def rag_answer(lexical: LexicalIndex, nodes: DataFrame, questions: DataFrame, use_reranker: bool = True,
               k_retrieval: int = TOP_K_RETRIEVAL, k_rerank: int = TOP_K_RERANK,
               metrics: DataFrame | None = None, score: ScoreFactory | None = None,
               generate: InferFactory | None = None) -> DataFrame:
    """(question_idx, question, retrieved, reranked, context): ids found, ids after reranking
    (null with the reranker off), and the text handed to the generator. ``score`` reranks in place
    of the cosine, ``generate`` adds its reply as response. Stage times (question_idx, ..) are joined
    on where given."""
    queries = questions.select(F.col("question_idx").alias("query_id"), F.col("question").alias("text"))
    found = cut_lineage(bm25_topk(lexical, queries, k_retrieval).select(
        F.col("query_id").alias("question_idx"), "node_id", F.col("rank").alias("idx")))
    if not use_reranker:
        scored = found
    elif score is None:
        scored = cosine_scores(found, questions, lexical, stemmed=lexical.stemmed)
    else:
        asked = join_docstore(found, nodes).join(questions.select("question_idx", "question"), "question_idx")
        scored = score_with(asked, score).select("question_idx", "node_id", "idx", "score")
    best = cut_lineage(limit_prerank(scored, ["question_idx"], use_reranker, k_retrieval, k_rerank))
    texts = join_docstore(best.select("question_idx", "rank", "node_id"), nodes)
    out = (
        questions.join(_list(found, "idx", "node_id", "retrieved"), "question_idx", "left")
        .join(_list(best, "rank", "node_id", "reranked"), "question_idx", "left")
        .join(_list(texts, "rank", "text", "texts"), "question_idx", "left")
        .withColumn("context", format_docs("texts")).drop("texts")
    )
    if not use_reranker:
        out = out.withColumn("reranked", F.lit(None).cast(out.schema["reranked"].dataType))
    if generate is not None:
        prompts = out.withColumn("prompt", answer_prompt("question", F.coalesce("context", F.lit(""))))
        out = infer_with(prompts, generate, out="response").drop("prompt")
    return out if metrics is None else out.join(metrics, "question_idx", "left")
