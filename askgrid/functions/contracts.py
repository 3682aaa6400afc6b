"""Prompts sent to a model and the contract its JSON replies have to meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.functions.text import col

# Answer labels, JSON keys, message formats and error texts.
ANSWER_LABELS = (
    "Si",
    "No",
    "Si, ma senza una struttura ben definita",
    "Si, ma con controlli che avvengono in oltre un anno",
)
EXPAND_MESSAGE = "Espandi questa query: %s"
ANSWER_MESSAGE = "Query: %s\n Context: %s"
GRADE_MESSAGE = "Query: %s\n\nContesto: %s"
EXPAND_ERROR = "Errore nella query expansion: "
ANSWER_ERROR = "Errore durante la generazione della risposta: "
GRADE_ERROR = "Errore durante la valutazione della rilevanza: "
BAD_SUBQUERIES = "Campo 'sotto_query' mancante o non valido"
BAD_ANSWER = "JSON di risposta non valido o incompleto"
BAD_JSON = "JSON non leggibile"
BAD_GRADE = "is_relevant mancante o non booleano"

# Instructions for the model; any other text can be passed instead.
EXPAND_SYSTEM = (
    "Riformula la domanda dell'utente in tre ricerche: due domande affini e un elenco di "
    "termini chiave separati da virgole. Rispondi con un oggetto JSON che ha la chiave "
    '"sotto_query", una lista di oggetti con "id" e "subquery".'
)
ANSWER_SYSTEM = (
    "In base al solo contesto scegli una di queste risposte: "
    + "; ".join(ANSWER_LABELS)
    + '. Rispondi con un oggetto JSON con le chiavi "response" e "justification".'
)
GRADE_SYSTEM = (
    "Indica se il contesto aiuta a rispondere alla query, con un oggetto JSON che ha la "
    'chiave booleana "is_relevant".'
)


def _messages(system: Column | str, user: Column) -> Column:
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    system = F.lit(system) if isinstance(system, str) else system
    return F.to_json(F.array(message("system", system), message("user", user)))


def expansion_prompt(question: Column | str, system: Column | str = EXPAND_SYSTEM) -> Column:
    return _messages(system, F.format_string(EXPAND_MESSAGE, col(question)))


def answer_prompt(question: Column | str, context: Column | str,
                  system: Column | str = ANSWER_SYSTEM) -> Column:
    return _messages(system, F.format_string(ANSWER_MESSAGE, col(question), col(context)))


def grade_prompt(question: Column | str, context: Column | str,
                 system: Column | str = GRADE_SYSTEM) -> Column:
    return _messages(system, F.format_string(GRADE_MESSAGE, col(question), col(context)))


def _json_kind(raw: Column, path: str = "$") -> Column:
    """Schema text of a JSON value, null if the text is not JSON or holds no such value."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), path, "variant"))


def parse_subqueries(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Sub-queries of a reply: adds (subqueries, expand_err).

    A missing key is an empty list; a value other than a list is an error, as is broken
    JSON; items without a sub-query are left out.
    """
    reply = F.col(raw)
    whole, field = _json_kind(reply), _json_kind(reply, "$.sotto_query")
    err = (
        F.when(whole.isNull(), BAD_JSON)
        .when(~whole.startswith("OBJECT"), BAD_JSON)
        .when(field.isNotNull() & ~field.startswith("ARRAY"), BAD_SUBQUERIES)
    )
    # each item as its JSON text, so one that is no object spoils none of the others
    items = F.from_json(reply, "struct<sotto_query:array<string>>")["sotto_query"]
    texts = F.filter(F.transform(items, lambda i: F.from_json(i, "struct<subquery:string>")["subquery"]), lambda t: t.isNotNull())
    empty = F.array().cast("array<string>")
    return df.withColumn(
        "expand_err", F.when(err.isNotNull(), F.concat(F.lit(EXPAND_ERROR), err))
    ).withColumn("subqueries", F.when(F.col("expand_err").isNull(), F.coalesce(texts, empty)).otherwise(empty))


def parse_answer(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Answer of a reply: adds (response, justification, answer_err). Both keys must be
    there; the label itself is not checked."""
    reply = F.col(raw)
    kind = _json_kind(reply)
    fields = F.from_json(reply, "map<string,string>")
    complete = F.map_contains_key(fields, "response") & F.map_contains_key(fields, "justification")
    err = (
        F.when(kind.isNull(), BAD_JSON)
        .when(~kind.startswith("OBJECT") | ~F.coalesce(complete, F.lit(False)), BAD_ANSWER)
    )
    ok = F.col("answer_err").isNull()
    return df.withColumn("answer_err", F.when(err.isNotNull(), F.concat(F.lit(ANSWER_ERROR), err))).withColumns({
        "response": F.when(ok, F.try_element_at(fields, F.lit("response"))),
        "justification": F.when(ok, F.try_element_at(fields, F.lit("justification"))),
    })


def parse_grade(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Relevance grade of a reply: adds (is_relevant, grade_err); the grade is required."""
    reply = F.col(raw)
    value = F.from_json(reply, "struct<is_relevant:boolean>")["is_relevant"]
    return df.withColumn("is_relevant", value).withColumn(
        "grade_err", F.when(value.isNull(), F.lit(GRADE_ERROR + BAD_GRADE)))


def relevant_only(graded: DataFrame) -> DataFrame:
    """Contexts graded relevant; rows whose grade is an error belong to the reject table."""
    return graded.filter(F.col("is_relevant"))
