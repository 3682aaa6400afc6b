"""From a questionnaire to stored answers, all questions in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.functions.contracts import answer_prompt, parse_answer
from askgrid.operators.models import InferFactory, ScoreFactory, infer_with
from askgrid.operators.reranking import contexts_per_question
from askgrid.operators.selection import question_ids, route_outcome, saved_rows, select_context
from askgrid.plans.expand import expand_questions, model_replies
from askgrid.plans.index import RetrievalIndex
from askgrid.plans.retrieve import retrieve_or_fail
from askgrid.session import cut_lineage
from askgrid.sources.responses import append_responses


def answer_replies(selected: DataFrame, model: InferFactory) -> DataFrame:
    """Model replies (question_idx, raw) for questions with a selected context."""
    prompts = selected.filter(F.col("selected").isNotNull()).select(
        "question_idx", answer_prompt("question", "selected").alias("prompt"))
    return infer_with(prompts, model).select("question_idx", "raw")


def answer_questions(selected: DataFrame, replies: DataFrame) -> DataFrame:
    """Add (response, justification, answer_err) from the replies to the answer prompts."""
    return parse_answer(selected.join(replies, "question_idx", "left"))


def assess_questionnaire(index: RetrievalIndex, questions: DataFrame, expansions: DataFrame | InferFactory,
                         selections: DataFrame, answers: DataFrame | InferFactory, start_id: int = 0,
                         score: ScoreFactory | None = None) -> DataFrame:
    """Rows to store (question_id, question_idx, question, answer, context, justification).

    Expansions and answers are model replies (question_idx, raw), or the models that give them:
    the answer prompt then holds the context that was selected. Selections are choices
    (question_idx, choice). Every question leads to one outcome; an interrupt ends the run.
    Only questions whose expansion can be read are retrieved; one the scoring model (``score``) fails
    on is stored with that error.
    """
    if callable(expansions):
        expansions = cut_lineage(model_replies(questions, expansions))
    subqueries, status = expand_questions(questions, expansions)
    expanded = questions.join(status.filter("expand_err is null").select("question_idx"), "question_idx", "left_semi")
    best, failed = retrieve_or_fail(index, expanded, subqueries, score=score)
    contexts = contexts_per_question(best)
    staged = (
        questions.join(status, "question_idx", "left").join(contexts, "question_idx", "left")
        .join(selections, "question_idx", "left")
        .withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
        .withColumn("n_left", F.size("contexts"))
        .join(failed, "question_idx", "left")
    )
    selected = select_context(staged)
    if callable(answers):
        selected = cut_lineage(selected)
        answers = cut_lineage(answer_replies(selected, answers))
    answered = answer_questions(selected, answers)
    rows = saved_rows(cut_lineage(route_outcome(answered)))
    return question_ids(rows, start_id).select(
        "question_id", "question_idx", "question", "answer", "context", F.col("reason").alias("justification"))


def store_assessment(rows: DataFrame, run_id: str, path: str) -> None:
    """Append the rows of a run in one write. Ids start anew in each run, so the run is part
    of the key."""
    append_responses(rows.drop("question_idx").withColumn("run_id", F.lit(run_id)), path)
