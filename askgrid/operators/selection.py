"""Choice of a context per question, the outcome of each question, and its numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.functions.text import WHITESPACE, col, strip_text, whole_number
from askgrid.operators.sizing import number_rows

# Wording of combined contexts, choices, outcomes and status messages.
COMBINED_HEADER = "=== CONTESTI RILEVANTI ===\n\n"
COMBINED_ITEM = "--- CONTESTO {} ---\n"
COMBINED_FOOTER = "=== FINE CONTESTI ==="
NO_CONTEXT = "Nessun contesto disponibile."
CHOICE_ITEM = "Contesto "
CHOICE_ALL = "Combina tutti"
CHOICE_SKIP = "Salta domanda"
SKIPPED = "SKIPPED"
SKIPPED_CONTEXT = "N/A"
SKIPPED_REASON = "Domanda saltata dall'utente"
ERROR_RETRIEVAL = "Error: Initial retrieval failed"
ERROR_RERANK = "Error: Reranking failed"
ERROR_ANSWER = "Error"
ERROR_ANSWER_PREFIX = "Processing failed: "
NOTHING_LEFT = "No relevant documents found after reranking"
STATUS_NO_CONTEXT = "Nessun contesto disponibile"
STATUS_SKIPPED = "Domanda saltata (salvata)"
STATUS_BAD_NUMBER = "Selezione contesto non valida"
STATUS_BAD_FORMAT = "Formato selezione non valido"
STATUS_ANSWERED = "Risposta generata con successo"
STATUS_UPDATED = "Risposta aggiornata"
PROGRESS = "Domanda %d di %d"
ALL_DONE = "Tutte le domande completate!"
DONE = "Completato"

INTERRUPT = "interrupt"


def combine_contexts(contexts: Column | str) -> Column:
    """All contexts, stripped and numbered, between a header and a footer."""
    contexts = col(contexts)
    before, after = COMBINED_ITEM.split("{}")
    items = F.transform(contexts, lambda text, i: F.concat(
        F.lit(before), (i + 1).cast("string"), F.lit(after), strip_text(text), F.lit("\n\n")))
    return F.when(F.coalesce(F.size(contexts), F.lit(0)) <= 0, F.lit(NO_CONTEXT)).otherwise(
        F.concat(F.lit(COMBINED_HEADER), F.array_join(items, ""), F.lit(COMBINED_FOOTER)))


def format_docs(contexts: Column | str) -> Column:
    """Texts joined by an empty line."""
    return F.array_join(col(contexts), "\n\n")


def _element(contexts: Column, number: Column) -> Column:
    """1-based element, null outside the array (never counted from the end)."""
    inside = number.between(1, F.size(contexts))
    return F.when(inside, F.try_element_at(contexts, F.when(inside, number)))


def select_context(df: DataFrame, contexts: str = "contexts", choice: str = "choice") -> DataFrame:
    """Apply a numbered choice: 1..n that context, n+1 all combined, n+2 skip, the interrupt
    word stops the run, anything else decides nothing: adds (decision, selected)."""
    number, size, c = whole_number(choice), F.size(contexts), F.col(contexts)
    decision = (
        F.when(F.lower(F.col(choice)) == INTERRUPT, "interrupted")
        .when(number.between(1, size), "one")
        .when(number == size + 1, "all")
        .when(number == size + 2, "skipped")
        .otherwise("undecided")
    )
    return df.withColumn("decision", decision).withColumn(
        "selected",
        F.when(F.col("decision") == "one", _element(c, number))
        .when(F.col("decision") == "all", combine_contexts(c)),
    )


def select_context_label(df: DataFrame, contexts: str = "contexts", label: str = "label",
                         answered: Column | None = None) -> DataFrame:
    """Apply a labelled choice and say what came of it: adds (decision, selected, status).
    ``answered`` tells whether the question has an earlier answer, which is then updated."""
    c, choice = F.col(contexts), F.col(label)
    words = F.array_remove(F.split(choice, WHITESPACE), "")
    number = whole_number(F.try_element_at(words, F.lit(2)))
    earlier = F.coalesce(answered, F.lit(False)) if answered is not None else F.lit(False)
    decision = (
        F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, "empty")
        .when(choice == CHOICE_ALL, "all")
        .when(choice == CHOICE_SKIP, "skipped")
        .when(number.isNull(), "bad format")
        .when(number.between(1, F.size(c)), "one")
        .otherwise("bad number")
    )
    kind = F.col("decision")
    return df.withColumn("decision", decision).withColumns({
        "selected": F.when(kind == "one", _element(c, number)).when(kind == "all", combine_contexts(c)),
        "status": F.when(kind == "empty", STATUS_NO_CONTEXT)
        .when(kind == "skipped", STATUS_SKIPPED)
        .when(kind == "bad format", STATUS_BAD_FORMAT)
        .when(kind == "bad number", STATUS_BAD_NUMBER)
        .when(earlier, STATUS_UPDATED).otherwise(STATUS_ANSWERED),
    })


def list_choices(df: DataFrame, keys: Sequence[str], contexts: str = "contexts", most: int = 5) -> DataFrame:
    """Choices offered per question: one per context, then all and skip; none without contexts."""
    numbered = F.transform(
        F.slice(F.col(contexts), 1, most),
        lambda _, i: F.concat(F.lit(CHOICE_ITEM), (i + 1).cast("string")))
    offered = F.when(
        F.size(contexts) > 0, F.concat(numbered, F.array(F.lit(CHOICE_ALL), F.lit(CHOICE_SKIP))))
    return df.select(*keys, F.posexplode(offered).alias("choice_no", "choice"))


def until_interrupt(df: DataFrame, interrupted: Column, order: str = "question_idx") -> DataFrame:
    """Rows before the first interrupted one; all rows if none is."""
    first = df.filter(interrupted).agg(F.min(order)).first()[0]
    return df if first is None else df.filter(F.col(order) < first)


def route_outcome(df: DataFrame) -> DataFrame:
    """The row each question leads to, from its stage columns (expand_err, rerank_err, n_left,
    decision, selected, answer_err, response, justification): adds (outcome, answer, context,
    reason). Outcomes ``interrupted`` and ``undecided`` save no row."""
    outcome = (
        F.when(F.col("expand_err").isNotNull(), "expansion failed")
        .when(F.col("rerank_err").isNotNull() | (F.col("n_left") <= 0), "reranking failed")
        .when(F.col("decision") == "skipped", "skipped")
        .when(F.col("decision") == "interrupted", "interrupted")
        .when(F.col("decision") == "undecided", "undecided")
        .when(F.col("answer_err").isNotNull(), "answer failed")
        .otherwise("answered")
    )
    o = F.col("outcome")
    return df.withColumn("outcome", outcome).withColumns({
        "answer": F.when(o == "expansion failed", ERROR_RETRIEVAL)
        .when(o == "reranking failed", ERROR_RERANK)
        .when(o == "skipped", SKIPPED)
        .when(o == "answer failed", ERROR_ANSWER)
        .when(o == "answered", F.col("response")),
        "context": F.when(o == "skipped", SKIPPED_CONTEXT).when(o == "answered", F.col("selected")),
        "reason": F.when(o == "expansion failed", F.col("expand_err"))
        .when(o == "reranking failed", F.coalesce("rerank_err", F.lit(NOTHING_LEFT)))
        .when(o == "skipped", SKIPPED_REASON)
        .when(o == "answer failed", F.concat(F.lit(ERROR_ANSWER_PREFIX), F.col("answer_err")))
        .when(o == "answered", F.col("justification")),
    })


def saved_rows(routed: DataFrame) -> DataFrame:
    """Rows that are stored: all up to an interrupt, without undecided questions."""
    kept = until_interrupt(routed, F.col("outcome") == "interrupted")
    return kept.filter(~F.col("outcome").isin("interrupted", "undecided"))


def question_ids(rows: DataFrame, start: int = 0, order: str = "question_idx") -> DataFrame:
    """Dense ids from ``start`` on in question order, added as question_id."""
    return number_rows(rows, order, "question_id", start)


def question_progress(questions: DataFrame, order: str = "question_idx") -> DataFrame:
    """Place of each question among all, with the message shown for it, and the closing
    message as the row after the last: (position, total, question, progress)."""
    total = questions.count()
    placed = number_rows(questions, order, "position", 1).select(
        "position", F.lit(total).cast("long").alias("total"), "question",
        F.format_string(PROGRESS, "position", F.lit(total)).alias("progress"))
    closing = questions.sparkSession.range(1).select(
        F.lit(total + 1).cast("long").alias("position"), F.lit(total).cast("long").alias("total"),
        F.lit(ALL_DONE).alias("question"), F.lit(DONE).alias("progress"))
    return placed.unionByName(closing)
