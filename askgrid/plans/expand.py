"""Sub-queries of questions from model replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.functions.contracts import expansion_prompt, parse_subqueries
from askgrid.operators.lexical import LexicalIndex
from askgrid.operators.models import InferFactory, infer_with, keyword_subqueries
from askgrid.session import cut_lineage


def keyword_replies(index: LexicalIndex, questions: DataFrame) -> DataFrame:
    """Replies (question_idx, raw) in the form a model gives, with the key terms of the
    question as the one sub-query; used where no model is at hand."""
    keywords = keyword_subqueries(index, questions)
    reply = F.to_json(F.struct(F.array(F.struct(
        F.lit(3).alias("id"), F.col("subquery"))).alias("sotto_query")))
    return keywords.select("question_idx", reply.alias("raw"))


def model_replies(questions: DataFrame, model: InferFactory) -> DataFrame:
    prompts = questions.select("question_idx", expansion_prompt("question").alias("prompt"))
    return infer_with(prompts, model).select("question_idx", "raw")


def expand_questions(questions: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sub-queries (question_idx, subquery_no, subquery) and status (question_idx, expand_err,
    n_subqueries). A question without a readable reply is marked as failed."""
    parsed = cut_lineage(parse_subqueries(
        questions.select("question_idx").join(replies, "question_idx", "left")))
    subqueries = parsed.select(
        "question_idx", F.posexplode("subqueries").alias("subquery_no", "subquery")
    ).withColumn("subquery_no", F.col("subquery_no") + 1)
    status = parsed.select("question_idx", "expand_err", F.size("subqueries").alias("n_subqueries"))
    return subqueries, status
