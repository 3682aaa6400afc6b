import pytest
from pyspark.sql import functions as F

from askgrid.functions import contracts
from askgrid.operators import metrics, reranking, selection

CTX = [" uno ", "due", "tre"]


def test_combine_contexts(spark):
    df = spark.createDataFrame([(CTX,), ([],), (None,)], "contexts array<string>")
    got = [r.c for r in df.select(selection.combine_contexts("contexts").alias("c")).collect()]
    want = ("=== CONTESTI RILEVANTI ===\n\n--- CONTESTO 1 ---\nuno\n\n--- CONTESTO 2 ---\ndue\n\n"
            "--- CONTESTO 3 ---\ntre\n\n=== FINE CONTESTI ===")
    assert got == [want, "Nessun contesto disponibile.", "Nessun contesto disponibile."]


def test_numbered_choices(spark):
    cases = {"1": ("one", " uno "), " 3 ": ("one", "tre"), "4": ("all", None), "5": ("skipped", None), "0": ("undecided", None),
             "6": ("undecided", None), "-1": ("undecided", None), "x": ("undecided", None), "1.5": ("undecided", None),
             "interrupt": ("interrupted", None), None: ("undecided", None)}
    df = spark.createDataFrame([(k, CTX) for k in cases], "choice string, contexts array<string>")
    for r in selection.select_context(df).collect():
        decision, selected = cases[r.choice]
        assert r.decision == decision
        if decision == "all":
            assert r.selected.startswith("=== CONTESTI")
        else:
            assert r.selected == selected


def test_labelled_choices(spark):
    cases = {"Contesto 1": "one", "Contesto 3": "one", "Contesto 0": "bad number", "Contesto 9": "bad number",
             "Contesto x": "bad format", "Contesto": "bad format", "": "bad format", "Combina tutti": "all", "Salta domanda": "skipped"}
    df = spark.createDataFrame([(k, CTX) for k in cases], "label string, contexts array<string>")
    got = {r.label: r for r in selection.select_context_label(df).collect()}
    assert {k: r.decision for k, r in got.items()} == cases
    assert got["Contesto 3"].selected == "tre" and got["Contesto 9"].status == "Selezione contesto non valida"
    assert got["Contesto 1"].status == "Risposta generata con successo"
    none = selection.select_context_label(df.withColumn("contexts", F.array().cast("array<string>"))).collect()
    assert {r.status for r in none} == {"Nessun contesto disponibile"}


def test_choices_offered(spark):
    df = spark.createDataFrame([(1, CTX), (2, []), (3, list("abcdefg"))], "q int, contexts array<string>")
    got = {}
    for r in selection.list_choices(df, ["q"]).orderBy("q", "choice_no").collect():
        got.setdefault(r.q, []).append(r.choice)
    assert got[1] == ["Contesto 1", "Contesto 2", "Contesto 3", "Combina tutti", "Salta domanda"]
    assert 2 not in got and len(got[3]) == 7


def stages(spark, *rows):
    return spark.createDataFrame(
        rows, "question_idx int, expand_err string, rerank_err string, n_left int, decision string, selected string, "
              "answer_err string, response string, justification string")


def test_outcomes_and_interrupt(spark):
    df = stages(
        spark,
        (0, "e", None, 0, "interrupted", None, None, None, None),   # failed before the choice: no interrupt
        (1, None, "r", 5, "one", "c", None, "Si", "j"),
        (2, None, None, 0, "one", "c", None, "Si", "j"),
        (3, None, None, 5, "skipped", None, None, None, None),
        (4, None, None, 5, "one", "c", "bad", None, None),
        (5, None, None, 5, "one", "c", None, "Si", "j"),
        (6, None, None, 5, "undecided", None, None, None, None),
        (7, None, None, 5, "interrupted", None, None, None, None),
        (8, None, None, 5, "one", "c", None, "Si", "j"),
    )
    routed = selection.route_outcome(df)
    got = {r.question_idx: (r.answer, r.context, r.reason) for r in routed.collect()}
    assert got[0] == ("Error: Initial retrieval failed", None, "e")
    assert got[1] == ("Error: Reranking failed", None, "r")
    assert got[2] == ("Error: Reranking failed", None, "No relevant documents found after reranking")
    assert got[3] == ("SKIPPED", "N/A", "Domanda saltata dall'utente")
    assert got[4] == ("Error", None, "Processing failed: bad")
    assert got[5] == ("Si", "c", "j")
    saved = selection.question_ids(selection.saved_rows(routed), 10).collect()
    assert sorted((r.question_id, r.question_idx) for r in saved) == [(10 + i, i) for i in range(6)]


def test_progress(spark):
    df = spark.createDataFrame([(5, "a"), (9, "b")], "question_idx int, question string")
    got = selection.question_progress(df).orderBy("position").collect()
    assert [(r.question, r.progress) for r in got] == [
        ("a", "Domanda 1 di 2"), ("b", "Domanda 2 di 2"), ("Tutte le domande completate!", "Completato")]


def test_rerank_is_stable(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate((0.1, 0.9, 0.9, 0.5))], "q int, idx int, score double")
    order = lambda n: [r.idx for r in reranking.rerank_topn(df, ["q"], n).orderBy("rank").collect()]
    assert order(None) == [1, 2, 3, 0] and order(0) == [1, 2, 3, 0] and order(-1) == [1, 2, 3, 0] and order(2) == [1, 2]


def test_rerank_keeps_an_old_score_only_if_there_was_one(spark):
    docs = spark.createDataFrame([(1, i, 0.75 - 0.05 * i) for i in range(10)], "q int, idx int, score double")
    new = F.col("idx") * 0.1
    got = reranking.rerank_keep_original(docs, ["q"], new, 3).orderBy("rank").collect()
    assert [(r.idx, round(r.original_score, 2)) for r in got] == [(9, 0.3), (8, 0.35), (7, 0.4)]
    bare = docs.drop("score")
    assert "original_score" not in reranking.rerank_keep_original(bare, ["q"], new).columns
    kept = reranking.rerank_keep_original(docs, ["q"], None, 2, return_scores=False).orderBy("rank").collect()
    assert [r.idx for r in kept] == [0, 1] and kept[0].original_score == kept[0].score
    with pytest.raises(ValueError):
        reranking.rerank_keep_original(bare, ["q"], None, return_scores=False)


def test_limits_before_reranking(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(30)], "q int, idx int, score double")
    on = reranking.limit_prerank(df, ["q"]).orderBy("rank").collect()
    off = reranking.limit_prerank(df, ["q"], use_reranker=False).orderBy("rank").collect()
    assert [r.idx for r in on] == [19, 18, 17, 16, 15] and [r.idx for r in off] == [0, 1, 2, 3, 4]


def test_stage_times(spark):
    log = spark.createDataFrame([(1, "retrieval", 1.0), (1, "rerank", 2.0), (2, "generation", 4.0)], "query_id int, stage string, elapsed_s double")
    got = {r.query_id: r.asDict() for r in metrics.stage_metrics(log).collect()}
    assert got[1]["total_time"] == 3.0 and got[1]["generation_time"] == 0.0 and got[2]["total_time"] == 4.0
    assert metrics.exists_any(log, F.col("elapsed_s") > 9).first().found is False
    assert metrics.exists_any(log.limit(0), F.col("elapsed_s") > 9).first().found is False


def test_subquery_replies(spark):
    raw = [
        '{"sotto_query": [{"id": 1, "subquery": "a"}, {"id": 2, "subquery": "b"}, {"id": 3, "subquery": "c, d"}]}',
        '{"x": 1}', '{"sotto_query": "a"}', '{"sotto_query": {"subquery": "a"}}', '{"sotto_query": [{"id": 1}, {"id": 2, "subquery": "b"}]}',
        '{"sotto_query": [', "[1]", None, '{"sotto_query": []}',
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = {r.i: (r.subqueries, r.expand_err) for r in contracts.parse_subqueries(df).collect()}
    ok = {0: ["a", "b", "c, d"], 1: [], 4: ["b"], 8: []}
    assert {i: v[0] for i, v in got.items() if v[1] is None} == ok
    assert got[2][1] == got[3][1] == "Errore nella query expansion: Campo 'sotto_query' mancante o non valido"


def test_answer_replies(spark):
    raw = ['{"response": "Si", "justification": "j"}', '{"response": "Si"}', "[1]", '{"response": "Boh", "justification": null}', "{", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = {r.i: r for r in contracts.parse_answer(df).collect()}
    assert [got[i].answer_err is None for i in range(6)] == [True, False, False, True, False, False]
    assert (got[0].response, got[0].justification) == ("Si", "j") and got[3].response == "Boh"


def test_grades(spark):
    raw = ['{"is_relevant": true}', '{"is_relevant": false}', '{"is_relevant": true}', '{"x": 1}', "{"]
    df = contracts.parse_grade(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string"))
    assert [r.i for r in contracts.relevant_only(df).orderBy("i").collect()] == [0, 2]
    assert [r.i for r in df.filter("grade_err is not null").orderBy("i").collect()] == [3, 4]
