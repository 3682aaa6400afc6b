"""One query per operator, each over whole tables of a data folder."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.functions import contracts, text
from askgrid.functions.stem import stem_table
from askgrid.operators import (
    candidates, chunking, dedup, dense, lexical, merging, metrics, models, reranking, selection,
)
from askgrid.operators.sizing import number_rows, spread
from askgrid.plans import assess, expand, index, rag, retrieve
from askgrid.session import cut_lineage, scratch_path
from askgrid.sources import documents, questionnaire, responses
from askgrid.streaming import questions as question_stream
from askgrid.streaming import upserts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_indexes: dict[tuple, object] = {}


class Tables:
    """Tables of a folder by name, and the indexes built from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def questions(self) -> DataFrame:
        return self.benchmark.select(
            F.col("item_id").alias("question_idx"), F.col("text").alias("question"))

    @property
    def queries(self) -> DataFrame:
        return self.benchmark.select(F.col("item_id").alias("query_id"), "text")

    def _once(self, kind: str, build: Callable):
        key = (self.spark.sparkContext.applicationId, self.folder, kind)
        if key not in _indexes:
            _indexes[key] = build()
        return _indexes[key]

    @property
    def lexical(self) -> lexical.LexicalIndex:
        """Term table with whole documents as nodes."""
        docs = self.documents.select(F.col("doc_id").alias("node_id"), "text")
        return self._once("lexical", lambda: lexical.build_lexical_index(docs))

    @property
    def stems(self) -> lexical.LexicalIndex:
        """As lexical, of stems."""
        docs = self.documents.select(F.col("doc_id").alias("node_id"), "text")
        return self._once("stems", lambda: lexical.build_lexical_index(docs, stemmed=True))

    @property
    def index(self) -> index.RetrievalIndex:
        """Index of the chunks of all documents."""
        return self._once("index", lambda: index.build_index(self.documents))

    @property
    def subqueries(self) -> DataFrame:
        """One sub-query of key terms per question."""
        return expand.expand_questions(
            self.questions, expand.keyword_replies(self.index.lexical, self.questions))[0]


def forget_indexes() -> None:
    """Drop all indexes, so that the next query builds its own."""
    for value in _indexes.values():
        if hasattr(value, "unpersist"):
            value.unpersist()
    _indexes.clear()


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, folder: fn(Tables(spark, folder))
    return fn


# --- sources and sinks -------------------------------------------------------------------

@query
def src_markdown(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "files")
    t.benchmark.select("text").write.option("maxRecordsPerFile", 1).text(folder)
    docs, _ = documents.read_text_files(t.spark, folder, "*.txt")
    return docs.select("text", F.length("text").cast("long").alias("n_chars"))


def _paged(t: Tables) -> DataFrame:
    return documents.assemble_pages(
        t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text"))


@query
def src_page_assembly(t: Tables) -> DataFrame:
    return _paged(t)


def _all_documents(t: Tables) -> DataFrame:
    return documents.union_documents(
        _paged(t).withColumnRenamed("doc_id", "doc_key"), t.documents.withColumnRenamed("doc_id", "doc_key"))


@query
def src_union_documents(t: Tables) -> DataFrame:
    return _all_documents(t)


@query
def src_quarantine(t: Tables) -> DataFrame:
    # the files of an older system: Latin-1, which is UTF-8 only without accents
    files = t.documents.select(
        F.col("doc_id").cast("string").alias("path"), F.encode("text", "ISO-8859-1").alias("content"))
    good, rejected = documents.split_valid_utf8(files)
    return good.select("path", F.lit("loaded").alias("status"), F.length("text").cast("long").alias("n_chars")).unionByName(
        rejected.select("path", F.lit("rejected").alias("status"), F.lit(0).cast("long").alias("n_chars")))


@query
def src_load_count(t: Tables) -> DataFrame:
    return documents.count_documents(_all_documents(t))


def _raw_sheets(t: Tables) -> DataFrame:
    """Exported sheets of ten columns; the first data row of each holds the column names."""
    filler = [F.lit("x").alias(f"c{i}") for i in range(4, 10)]
    body = t.benchmark.select(
        (F.col("item_id") % 6).cast("int").alias("sheet_no"), (F.col("item_id") + 1).alias("row_no"),
        F.col("item_id").cast("string").alias("c0"), F.lit("area").alias("c1"),
        F.col("text").alias("c2"), F.lit("note").alias("c3"), *filler)
    head = t.spark.range(6).select(
        F.col("id").cast("int").alias("sheet_no"), F.lit(0).cast("long").alias("row_no"),
        F.lit("ID").alias("c0"), F.lit("Area").alias("c1"),
        F.lit(questionnaire.QUESTION_COLUMN).alias("c2"), F.lit("Notes").alias("c3"), *filler)
    return body.unionByName(head)


@query
def src_questionnaire(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "workbook")
    raw = cut_lineage(_raw_sheets(t))
    for i, name in enumerate(questionnaire.SHEETS):
        (raw.filter(F.col("sheet_no") == i).drop("sheet_no").write
            .options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                     ignoreTrailingWhiteSpace=False).csv(f"{folder}/{name}.csv"))
    sheets, _ = questionnaire.load_questionnaire(t.spark, folder)
    return questionnaire.extract_questions(sheets).select("sheet_no", "sheet", "row_no", "question")


def _answers(t: Tables) -> DataFrame:
    """Answers to the questions: one of the four labels each."""
    labels = F.array(*[F.lit(a) for a in contracts.ANSWER_LABELS])
    return t.benchmark.select(
        F.lit("run-1").alias("run_id"), F.col("item_id").alias("question_id"), F.col("text").alias("question"),
        F.element_at(labels, (F.col("item_id") % 4 + 1).cast("int")).alias("answer"),
        F.lit(None).cast("string").alias("context"), F.lit("motivo").alias("justification"))


def _turns(t: Tables) -> DataFrame:
    return t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"),
        F.col("role").alias("answer"))


@query
def sink_append_response(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "responses")
    responses.append_responses(_answers(t), path)
    responses.append_responses(_turns(t).withColumns({
        "run_id": F.lit("run-2"), "context": F.col("question"), "justification": F.lit("turno")}), path)
    return responses.read_responses(t.spark, path).drop("ts")


@query
def sink_append_legacy(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "responses")
    responses.append_responses(_answers(t), path)
    responses.append_responses(_turns(t), path)
    return responses.read_responses(t.spark, path).drop("ts")


def _event_answers(t: Tables) -> DataFrame:
    """Events as stored answers: the user is the question, the time the time of saving."""
    return t.events.select(
        F.lit("run-1").alias("run_id"), F.col("user_id").alias("question_id"),
        F.col("event_id").cast("string").alias("question"), F.col("event_type").alias("answer"),
        F.col("props").alias("context"), F.lit(None).cast("string").alias("justification"),
        text.format_ts("ts").alias("ts"))


@query
def src_responses(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "responses")
    _event_answers(t).write.parquet(path)
    return responses.read_responses(t.spark, path)


def _updates(t: Tables) -> DataFrame:
    return t.labels.select(
        F.col("doc_id").alias("question_id"), F.concat(F.lit("quality "), "quality").alias("answer"),
        F.when(F.col("toxic") == 1, "toxic").alias("justification"),
        F.lit(None).cast("string").alias("context"), F.lit("2024-06-01 00:00:00").alias("ts"))


@query
def sink_update_response(t: Tables) -> DataFrame:
    return responses.update_responses(_event_answers(t), _updates(t))


@query
def sink_upsert_response(t: Tables) -> DataFrame:
    stored = t.labels.select(
        F.col("doc_id").alias("question_id"), F.lit("stored").alias("answer"), F.lit(-1).cast("long").alias("version"))
    answers = t.events.select(
        F.col("user_id").alias("question_id"), F.col("event_type").alias("answer"),
        F.col("event_id").alias("version"))
    return responses.upsert_responses(stored, answers, ["question_id"], "version")


# --- projections, filters, predicates ----------------------------------------------------

@query
def proj_drop_positional(t: Tables) -> DataFrame:
    numbered = t.lineitem.withColumn("row_no", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return questionnaire.drop_positional(numbered).withColumn("l_shipdate", text.format_ts("l_shipdate"))


@query
def proj_promote_header(t: Tables) -> DataFrame:
    sheet = t.benchmark.select(
        (F.col("item_id") + 1).alias("row_no"), F.col("item_id").cast("string").alias("c0"),
        F.col("text").alias("c1"))
    head = t.spark.range(1).select(F.lit(0).cast("long").alias("row_no"), F.lit("ID").alias("c0"),
                                   F.lit(questionnaire.QUESTION_COLUMN).alias("c1"))
    named = questionnaire.promote_header(sheet.unionByName(head))
    return named.select("row_no", F.col("ID").alias("id"),
                        F.col(f"`{questionnaire.QUESTION_COLUMN}`").alias("question"))


def _question_rows(t: Tables) -> DataFrame:
    """Sheets are the sources; documents without a label have no question."""
    return t.documents.join(t.labels, "doc_id", "left").select(
        F.substring("source", 4, 10).cast("int").alias("sheet_no"), F.col("source").alias("sheet"),
        F.col("doc_id").alias("row_no"), F.when(F.col("quality").isNotNull(), F.col("text")).alias("question"))


@query
def filter_nonnull_questions(t: Tables) -> DataFrame:
    kept = questionnaire.nonnull_questions(_question_rows(t)).withColumn(
        "_key", F.col("sheet_no").cast("long") * (1 << 40) + F.col("row_no"))
    return number_rows(kept, "_key", "question_idx").drop("_key")


@query
def filter_sheet_schema(t: Tables) -> DataFrame:
    def sheet(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col(key).alias("row_no"), F.col("text").alias(questionnaire.QUESTION_COLUMN))

    sheets = {
        "documents": sheet(t.documents, "doc_id"), "labels": t.labels.withColumnRenamed("doc_id", "row_no"),
        "benchmark": sheet(t.benchmark, "item_id"), "conversations": sheet(t.conversations, "conv_id"),
    }
    return questionnaire.extract_questions(sheets).groupBy("sheet_no", "sheet").agg(
        F.count("*").alias("n_questions"))


@query
def filter_leaf_nodes(t: Tables) -> DataFrame:
    return chunking.leaf_nodes(t.index.nodes).select("node_id", "doc_id", "level", "parent_id", "seq")


@query
def filter_root_nodes(t: Tables) -> DataFrame:
    return chunking.root_nodes(t.index.nodes).select("node_id", "doc_id", "level", "seq")


@query
def filter_relevance_grade(t: Tables) -> DataFrame:
    good = F.to_json(F.struct((F.col("quality") == 1).alias("is_relevant")))
    replies = t.documents.join(t.labels, "doc_id").select(
        "doc_id", "source", F.when(F.col("toxic") == 1, F.lit('{"relevance": ')).otherwise(good).alias("raw"))
    return contracts.relevant_only(contracts.parse_grade(replies)).select("doc_id", "source")


def _centroids(t: Tables) -> DataFrame:
    """Mean vector per label, as queries."""
    means = (
        t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    )
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")
    ).select("query_id", F.transform("v", lambda e: e["x"]).alias("vector"))


def _vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"))


@query
def filter_similarity_topk(t: Tables) -> DataFrame:
    firsts = t.embeddings.groupBy(F.col("label").alias("query_id")).agg(
        F.min_by("embedding", "vec_id").alias("vector"))
    return dense.similarity_topk(_vectors(t), firsts)


@query
def proj_attach_metadata(t: Tables) -> DataFrame:
    nodes = chunking.chunk_hierarchical(spread(t.documents), keep=("source",))
    return chunking.attach_metadata(nodes).select(
        "node_id", "source", "level", "n_chars", "n_tokens", "is_root")


@query
def proj_text_field(t: Tables) -> DataFrame:
    body, lang = F.col("text"), F.col("lang")
    record = (
        F.when(lang == "en", F.create_map(F.lit("text"), body))
        .when(lang == "fr", F.create_map(F.lit("content"), body))
        .when(lang == "de", F.create_map(F.lit("content"), F.lit("other"), F.lit("text"), body))
        .otherwise(F.create_map(F.lit("title"), F.col("source")))
    )
    return t.documents.select("doc_id", text.text_field(record).alias("text"))


@query
def proj_preview(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", text.preview("text").alias("preview"), text.log_preview("text").alias("log_line"))


@query
def proj_question_id(t: Tables) -> DataFrame:
    saved = t.documents.join(t.labels, "doc_id").select(F.col("doc_id").alias("question_idx"), "quality")
    return selection.question_ids(saved, start=0)


def _stages(t: Tables) -> DataFrame:
    """Documents as questions, with a stage status that reaches every outcome."""
    kind = F.col("doc_id") % 8
    return t.documents.join(t.labels, "doc_id", "left").select(
        F.col("doc_id").alias("question_idx"),
        F.when(kind == 0, "no reply").alias("expand_err"),
        F.when(kind == 1, "scorer failed").alias("rerank_err"),
        F.when(kind == 2, 0).otherwise(5).alias("n_left"),
        F.when(kind == 3, "skipped").when(kind == 4, "undecided").otherwise("one").alias("decision"),
        F.col("source").alias("selected"), F.when(kind == 5, "bad reply").alias("answer_err"),
        F.when(F.col("quality") == 1, "Si").otherwise("No").alias("response"),
        F.concat(F.lit("lang "), "lang").alias("justification"))


@query
def route_outcome(t: Tables) -> DataFrame:
    return selection.route_outcome(_stages(t)).select("question_idx", "outcome", "answer", "context", "reason")


def _top_contexts(t: Tables) -> DataFrame:
    """Question texts with their five best documents by BM25."""
    hits = lexical.bm25_topk(t.lexical, t.queries, reranking.CONTEXTS_KEPT)
    nodes = t.documents.select(F.col("doc_id").alias("node_id"), "text")
    found = candidates.join_docstore(cut_lineage(hits), nodes).withColumnRenamed("query_id", "question_idx")
    return reranking.contexts_per_question(found)


@query
def select_context(t: Tables) -> DataFrame:
    df = _top_contexts(t).withColumn("choice", F.when(
        F.col("question_idx") % 9 == 8, "none").otherwise((F.col("question_idx") % 9).cast("string")))
    return selection.select_context(df).select("question_idx", "choice", "decision", "selected")


def _labels_chosen(t: Tables) -> DataFrame:
    n = F.col("question_idx") % 10
    return _top_contexts(t).withColumn("label", (
        F.when(n == 9, "").when(n == 8, "Contesto x").when(n == 7, selection.CHOICE_ALL)
        .when(n == 6, selection.CHOICE_SKIP).otherwise(F.concat(F.lit("Contesto "), (n * 2 - 1).cast("string")))))


@query
def select_context_label(t: Tables) -> DataFrame:
    chosen = selection.select_context_label(_labels_chosen(t), answered=F.col("question_idx") % 20 >= 10)
    return chosen.select("question_idx", "label", "decision", "selected", "status")


@query
def filter_until_interrupt(t: Tables) -> DataFrame:
    return selection.until_interrupt(
        t.events.select("event_id", "event_type", "value"),
        (F.col("event_type") == "error") & (F.col("value") > 300), "event_id")


@query
def list_context_choices(t: Tables) -> DataFrame:
    return selection.list_choices(_top_contexts(t), ["question_idx"])


# --- joins -------------------------------------------------------------------------------

@query
def knn_l2_exact(t: Tables) -> DataFrame:
    return dense.knn_l2(_vectors(t), _centroids(t))


@query
def bm25_topk(t: Tables) -> DataFrame:
    return lexical.bm25_topk(t.lexical, t.queries)


@query
def bm25_stemmed(t: Tables) -> DataFrame:
    """BM25 by English stems on both sides."""
    return lexical.bm25_topk(t.stems, t.queries)


def _dense_hits(t: Tables) -> DataFrame:
    return dense.knn_l2(
        t.index.searched, t.index.query_vectors(t.queries), carry=("parent_id", "n_siblings"))


@query
def auto_merge(t: Tables) -> DataFrame:
    return merging.auto_merge(_dense_hits(t).drop("rank"), t.index.nodes)


@query
def join_docstore(t: Tables) -> DataFrame:
    hits = cut_lineage(lexical.bm25_topk(t.index.lexical, t.queries, reranking.CONTEXTS_KEPT))
    return candidates.join_docstore(hits, t.index.nodes).select("query_id", "rank", "node_id", "text")


def _scored_documents(t: Tables, k: int = lexical.TOP_K) -> DataFrame:
    hits = cut_lineage(lexical.bm25_topk(t.lexical, t.queries, k).select(
        F.col("query_id").alias("question_idx"), "node_id", F.col("score").alias("bm25"),
        F.col("rank").alias("idx")))
    return reranking.cosine_scores(hits, t.questions, t.lexical)


@query
def join_rank_to_context(t: Tables) -> DataFrame:
    ranked = cut_lineage(reranking.rerank_topn(_scored_documents(t), ["question_idx"], reranking.CONTEXTS_KEPT))
    nodes = t.documents.select(F.col("doc_id").alias("node_id"), "text")
    return candidates.join_docstore(ranked.select("question_idx", "idx", "rank", "node_id"), nodes).select(
        "question_idx", "idx", "rank", "text")


def _document_lists(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.documents.select("lang", "doc_id", F.col("doc_id").alias("item_id"))
    return rows, t.documents.select(F.col("doc_id").alias("item_id"), "text")


@query
def dedup_jaccard(t: Tables) -> DataFrame:
    rows, items = _document_lists(t)
    return dedup.greedy_dedup(rows, items, ["lang"], "doc_id").filter("kept").select("lang", "doc_id")


@query
def jaccard_pairs_corpus(t: Tables) -> DataFrame:
    rows, items = _document_lists(t)
    return dedup.duplicate_pairs(rows.withColumn("lang", F.lit("all")), items, ["lang"], "doc_id").drop("lang")


@query
def join_update_mask(t: Tables) -> DataFrame:
    changed = responses.update_responses(_event_answers(t), _updates(t))
    return changed.groupBy("answer").agg(F.count("*").alias("n_rows"))


# --- aggregations ------------------------------------------------------------------------

@query
def term_statistics(t: Tables) -> DataFrame:
    stats = lexical.corpus_statistics(t.lexical)
    return stats.select("term", "df", "cf", F.round("idf", 6).alias("idf"))


@query
def merge_ratio(t: Tables) -> DataFrame:
    groups = merging.merge_ratio(_dense_hits(t).drop("n_siblings", "parent_id"), t.index.nodes)
    return groups.select("query_id", "parent_id", "n_hit", "n_children", F.round("ratio", 6).alias("ratio"), "dist")


@query
def combine_contexts(t: Tables) -> DataFrame:
    return _top_contexts(t).select("question_idx", selection.combine_contexts("contexts").alias("combined"))


@query
def format_docs(t: Tables) -> DataFrame:
    return _top_contexts(t).select("question_idx", selection.format_docs("contexts").alias("context"))


@query
def rerank_metrics(t: Tables) -> DataFrame:
    out = metrics.rerank_metrics(t.events.select(F.col("event_type").alias("device"), F.col("value").alias("elapsed_s")))
    return out.withColumns({
        "total_time": F.round("total_time", 4), "average_time_per_query": F.round("average_time_per_query", 4)})


@query
def stage_metrics(t: Tables) -> DataFrame:
    log = t.events.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("stage"),
                          F.col("value").alias("elapsed_s"))
    out = metrics.stage_metrics(log, stages=("view", "click", "purchase", "signup", "error"))
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c != "query_id"})


@query
def dedup_counts(t: Tables) -> DataFrame:
    rows, items = _document_lists(t)
    return metrics.dedup_counts(dedup.greedy_dedup(rows, items, ["lang"], "doc_id"), ["lang"])


@query
def exists_any(t: Tables) -> DataFrame:
    return metrics.exists_any(t.events, (F.col("event_type") == "error") & (F.col("value") > 400))


@query
def vector_dimension(t: Tables) -> DataFrame:
    return dense.vector_dimension(_vectors(t))


# --- windows, sorts, top-k ---------------------------------------------------------------

@query
def rank_per_question(t: Tables) -> DataFrame:
    return reranking.rank_per_group(_scored_documents(t), ["question_idx"]).select(
        "question_idx", "node_id", "idx", "score", "rank")


@query
def question_progress(t: Tables) -> DataFrame:
    return selection.question_progress(
        t.documents.select(F.col("doc_id").alias("question_idx"), F.col("source").alias("question")))


@query
def sheet_head(t: Tables) -> DataFrame:
    return questionnaire.sheet_head(_question_rows(t)).select("sheet", "row_no", "place", "question")


@query
def rerank_topn(t: Tables) -> DataFrame:
    return reranking.rerank_topn(_scored_documents(t), ["question_idx"], 10).select(
        "question_idx", "node_id", "idx", "score", "rank")


@query
def rerank_keep_original(t: Tables) -> DataFrame:
    docs = _scored_documents(t).withColumnsRenamed({"score": "new", "bm25": "score"})
    return reranking.rerank_keep_original(docs, ["question_idx"], F.col("new"), reranking.TOP_K_RERANK).select(
        "question_idx", "node_id", "score", "original_score", "rank")


@query
def top5_contexts(t: Tables) -> DataFrame:
    return reranking.rerank_topn(_scored_documents(t), ["question_idx"], reranking.CONTEXTS_KEPT).select(
        "question_idx", "rank", "node_id", "score")


@query
def limit_k_prerank(t: Tables) -> DataFrame:
    scored = _scored_documents(t, reranking.TOP_K_RETRIEVAL)
    on = reranking.limit_prerank(scored, ["question_idx"], True).withColumn("reranked", F.lit(True))
    off = reranking.limit_prerank(scored, ["question_idx"], False).withColumn("reranked", F.lit(False))
    return on.unionByName(off).select("question_idx", "reranked", "rank", "node_id", "retrieval_rank")


# --- set operations ----------------------------------------------------------------------

@query
def hybrid_union(t: Tables) -> DataFrame:
    return retrieve.retrieve(t.index, cut_lineage(t.queries))


@query
def union_subqueries(t: Tables) -> DataFrame:
    return retrieve.candidate_lists(t.index, t.questions, t.subqueries)


@query
def jaccard_similarity(t: Tables) -> DataFrame:
    turns = t.conversations.select("conv_id", "turn", "text")
    follow = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return turns.join(follow, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(text.jaccard_similarity("text", "next_text"), 6).alias("similarity"))


# --- scalar functions --------------------------------------------------------------------

@query
def chunk_hierarchical(t: Tables) -> DataFrame:
    return chunking.chunk_hierarchical(spread(t.documents))


@query
def tokenize_ws(t: Tables) -> DataFrame:
    return spread(t.documents).select("doc_id", F.explode_outer(text.tokenize_ws("text")).alias("word")).filter(
        F.col("word").isNotNull()).groupBy("doc_id").agg(
        F.count("*").alias("n_words"), F.count_distinct("word").alias("n_distinct"), F.max("word").alias("last_word"))


@query
def tokenize_terms(t: Tables) -> DataFrame:
    return spread(t.documents).select("doc_id", F.explode_outer(text.tokenize_terms("text")).alias("term")).filter(
        F.col("term").isNotNull()).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query
def parse_subqueries(t: Tables) -> DataFrame:
    kind = F.col("doc_id") % 5
    item = F.struct(F.lit(1).alias("id"), F.col("text").alias("subquery"))
    raw = (
        F.when(kind == 0, F.to_json(F.struct(F.array(item, item).alias("sotto_query"))))
        .when(kind == 1, '{"altro": 1}').when(kind == 2, '{"sotto_query": "uno"}')
        .when(kind == 3, '{"sotto_query": [{"id": 1}, {"id": 2, "subquery": "due"}]}').otherwise('{"sotto_query": [')
    )
    parsed = contracts.parse_subqueries(t.documents.select("doc_id", raw.alias("raw")))
    return parsed.select("doc_id", F.size("subqueries").alias("n_subqueries"),
                         F.array_join("subqueries", "|").alias("joined"), "expand_err")


def _answer_replies(t: Tables) -> DataFrame:
    kind = F.col("doc_id") % 5
    raw = (
        F.when(kind == 0, F.to_json(F.struct(F.lit("Si").alias("response"), F.col("text").alias("justification"))))
        .when(kind == 1, '{"response": "No"}').when(kind == 2, '[1, 2]')
        .when(kind == 3, '{"response": "Forse", "justification": "?"}').otherwise('{"response": ')
    )
    return t.documents.select("doc_id", raw.alias("raw"))


@query
def parse_answer(t: Tables) -> DataFrame:
    return contracts.parse_answer(_answer_replies(t)).drop("raw")


@query
def build_prompt(t: Tables) -> DataFrame:
    return t.conversations.select(
        "conv_id", "turn", contracts.expansion_prompt("role", "S").alias("expansion"),
        contracts.answer_prompt("role", "text", "S").alias("answer"),
        contracts.grade_prompt("role", "text", "S").alias("grade"))


@query
def strip_text(t: Tables) -> DataFrame:
    padded = F.concat(F.lit(" \n\t"), "text", F.lit(" \n "))
    return t.documents.select("doc_id", text.strip_text(padded).alias("text"))


@query
def format_ts(t: Tables) -> DataFrame:
    return t.events.select("event_id", text.format_ts("ts").alias("ts"))


@query
def array_slice(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", F.array_join(text.head_of_array(text.split_words("text"), 5), " ").alias("first_words"),
        F.substring("text", 1, 500).alias("opening"))


@query
def safe_ratio(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "click").alias("clicks"),
        F.count_if(F.col("event_type") == "purchase").alias("purchases"),
    ).select("user_id", F.round(text.safe_ratio("purchases", "clicks"), 6).alias("guarded"),
             F.round(text.average("purchases", "clicks"), 6).alias("average"))


@query
def map_lookup_default(t: Tables) -> DataFrame:
    props = F.from_json("props", "map<string,string>")
    return t.events.select("event_id", text.map_get(props, "k", "none").alias("k"),
                           text.map_get(props, "missing", "none").alias("missing"))


# --- streaming ---------------------------------------------------------------------------

@query
def stream_questions(t: Tables) -> DataFrame:
    out, state = scratch_path(t.spark, "stream"), scratch_path(t.spark, "state")
    run = question_stream.stream_questions(
        t.spark, t.lexical, t.folder, "item_id long, text string", out, state, pattern="benchmark.parquet",
        id_column="item_id")
    run.awaitTermination()
    return t.spark.read.parquet(out).drop("batch_id")


@query
def stream_upsert_latest(t: Tables) -> DataFrame:
    out, state = scratch_path(t.spark, "stream"), scratch_path(t.spark, "state")
    stream = (
        t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet")
        .parquet(t.folder).selectExpr("user_id AS question_id", "event_type AS answer", "event_id AS version")
    )
    upserts.stream_upserts(stream, ["question_id"], "version", out, state).awaitTermination()
    return upserts.read_latest(t.spark, out, ["question_id"], "version")


# --- models ------------------------------------------------------------------------------

@query
def udf_embed(t: Tables) -> DataFrame:
    vectors = dense.hashed_vectors(t.lexical.postings)
    return vectors.select("node_id", F.explode(F.arrays_zip("vector.at", "vector.x")).alias("e")).select(
        "node_id", F.col("e.at").alias("bucket"), F.round("e.x", 6).alias("x"))


@query
def udf_embed_model(t: Tables) -> DataFrame:
    """The model slot for vectors, with a model that counts signs by their code."""
    def by_code():
        def vectors(texts):
            counts = [np.bincount(np.frombuffer(x.encode("utf-32-le"), "<u4") % 16, minlength=16) for x in texts]
            return [c.tolist() for c in counts]
        return vectors

    docs = t.documents.select(F.col("doc_id").alias("node_id"), F.coalesce("text", F.lit("")).alias("text"))
    return models.embed_with(docs, by_code).select("node_id", F.posexplode("vector").alias("bucket", "x"))


@query
def udf_score_pair(t: Tables) -> DataFrame:
    def shared_words():
        def score(queries, texts):
            sets = [(set(q.lower().split()), set(x.lower().split())) for q, x in zip(queries, texts)]
            return [float(len(q & x)) for q, x in sets]
        return score

    nodes = t.documents.select(F.col("doc_id").alias("node_id"), "text")
    hits = cut_lineage(lexical.bm25_topk(t.lexical, t.queries).select(
        F.col("query_id").alias("question_idx"), "node_id"))
    pairs = candidates.join_docstore(hits, nodes).join(t.questions, "question_idx")
    return models.score_with(pairs, shared_words).select("question_idx", "node_id", "score")


@query
def udf_infer(t: Tables) -> DataFrame:
    def measure():
        return lambda prompts: [f'{{"is_relevant": {str(len(p) % 2 == 0).lower()}}}' for p in prompts]

    prompts = t.conversations.select("conv_id", "turn", contracts.grade_prompt("role", "text", "S").alias("prompt"))
    graded = contracts.parse_grade(models.infer_with(prompts, measure))
    return graded.select("conv_id", "turn", "is_relevant")


@query
def keyword_subquery(t: Tables) -> DataFrame:
    return models.keyword_subqueries(t.lexical, t.questions)


@query
def udf_stem(t: Tables) -> DataFrame:
    return stem_table(t.lexical.terms.select("term").distinct())


# --- composite plans ---------------------------------------------------------------------

@query
def build_index(t: Tables) -> DataFrame:
    return index.index_summary(t.index)


@query
def expand_questions(t: Tables) -> DataFrame:
    subs, status = expand.expand_questions(
        t.questions, expand.keyword_replies(t.lexical, t.questions))
    return status.join(subs, "question_idx", "left")


@query
def answer_questions(t: Tables) -> DataFrame:
    chosen = t.documents.select(F.col("doc_id").alias("question_idx"), F.col("source").alias("selected"))
    answered = assess.answer_questions(chosen, _answer_replies(t).withColumnRenamed("doc_id", "question_idx"))
    return answered.drop("raw")


@query
def answer_questions_model(t: Tables) -> DataFrame:
    """Prompts of questions with a context go to the model slot; replies are read by their contract."""
    def by_length():
        def reply(prompt):
            n = len(json.loads(prompt)[1]["content"])
            good = json.dumps({"response": "Si" if n % 2 == 0 else "No", "justification": f"length {n}"})
            return "no answer" if n % 5 == 0 else good
        return lambda prompts: [reply(p) for p in prompts]

    chosen = t.questions.join(
        t.documents.select(F.col("doc_id").alias("question_idx"), F.col("source").alias("selected")), "question_idx")
    answered = assess.answer_questions(chosen, assess.answer_replies(chosen, by_length))
    return answered.select("question_idx", "response", "justification", F.col("answer_err").isNotNull().alias("failed"))


@query
def retrieve_contexts(t: Tables) -> DataFrame:
    return retrieve.retrieve_contexts(t.index, t.questions, t.subqueries).select(
        "question_idx", "rank", "node_id", "score", "text")


def _assessment_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Model replies and choices for all questions, some of them faulty."""
    idx = F.col("question_idx")
    expansions = expand.keyword_replies(t.index.lexical, t.questions).withColumn(
        "raw", F.when(idx % 11 == 10, '{"sotto_query": "x"}').otherwise(F.col("raw")))
    choices = t.questions.select("question_idx", (idx % 8).cast("string").alias("choice"))
    good = F.to_json(F.struct(F.lit("Si").alias("response"), F.concat(F.lit("q"), idx).alias("justification")))
    answers = t.questions.select("question_idx", F.when(
        idx % 7 == 6, '{"response": "No"}').otherwise(good).alias("raw"))
    return expansions, choices, answers


@query
def assess_questionnaire(t: Tables) -> DataFrame:
    return assess.assess_questionnaire(t.index, t.questions, *_assessment_inputs(t))


@query
def rag_answer(t: Tables) -> DataFrame:
    nodes = t.documents.select(F.col("doc_id").alias("node_id"), "text")
    out = rag.rag_answer(t.lexical, nodes, t.questions)
    return out.select("question_idx", F.array_join(F.transform("retrieved", lambda i: i.cast("string")), ",").alias("retrieved"),
                      F.array_join(F.transform("reranked", lambda i: i.cast("string")), ",").alias("reranked"), "context")
