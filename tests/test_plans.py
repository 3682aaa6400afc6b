from pyspark.sql import functions as F

from askgrid.plans import assess, expand, index, rag, retrieve
from askgrid.sources.responses import read_responses

TEXTS = {
    1: "Password policy: passwords are rotated every year and stored hashed.",
    2: "password policy: passwords are rotated every year and stored hashed.",
    3: "Backups are encrypted. Restore tests take place twice a year.",
    4: "Incident response: incidents are logged, triaged and reviewed.",
    5: " ".join(f"filler{i}" for i in range(700)) + " backups offsite",
}


def setup(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    questions = spark.createDataFrame(
        [(0, "Is there a password policy?"), (1, "Are backups encrypted?"), (2, "?! ..."), (3, "How are incidents reviewed?"),
         (4, "Are restore tests done?")], "question_idx long, question string")
    return docs, questions


def test_retrieval_dedups_before_reranking(spark):
    docs, questions = setup(spark)
    ix = index.build_index(docs, (300, 40), 5)
    got = retrieve.retrieve_contexts(ix, questions).collect()
    top = {r.question_idx: r for r in got if r["rank"] == 1}
    assert top[0].node_id.split("/")[0] == "1" and top[1].node_id.split("/")[0] == "3" and 2 not in top
    first = [r for r in got if r.question_idx == 0]
    # texts 1 and 2 have the same words: the second never shows
    assert not any(r.node_id.startswith("2/") for r in first)
    assert all(r["rank"] <= 5 for r in got)
    ix.unpersist()


def test_assessment_end_to_end(spark, tmp_path):
    docs, questions = setup(spark)
    ix = index.build_index(docs, (300, 40), 5)
    keywords = expand.keyword_replies(ix.lexical, questions)
    expansions = keywords.unionByName(
        spark.createDataFrame([(2, '{"sotto_query": []}')], "question_idx long, raw string"))
    choices = spark.createDataFrame([(0, "1"), (1, "99"), (2, "1"), (3, "interrupt"), (4, "1")], "question_idx long, choice string")
    answers = spark.createDataFrame(
        [(0, '{"response": "Si", "justification": "j"}'), (4, '{"response": "Si", "justification": "j"}')], "question_idx long, raw string")
    rows = assess.assess_questionnaire(ix, questions, expansions, choices, answers)
    got = {r.question_idx: (r.question_id, r.answer) for r in rows.collect()}
    # 1 is undecided, 3 interrupts the run, so 4 is never reached
    assert got == {0: (0, "Si"), 2: (1, "Error: Reranking failed")}
    path = str(tmp_path / "responses")
    assess.store_assessment(rows, "run", path)
    assess.store_assessment(rows, "run-b", path)
    stored = read_responses(spark, path)
    assert stored.count() == 4 and stored.select("run_id", "question_id").distinct().count() == 4
    ix.unpersist()


def test_stems_run_through_all_plans(spark, tmp_path):
    """Another form of a word finds the text in BM25, vectors and scores, in a saved index too."""
    docs, _ = setup(spark)
    questions = spark.createDataFrame([(0, "rotation of hashing passwords yearly"), (1, "encryption backup"), (2, "reviewing an incident")],
                                      "question_idx long, question string")
    ix = index.build_index(docs, (300, 40), 5, stemmed=True)
    assert {"password", "rotat", "review"} <= {r.term for r in ix.lexical.terms.select("term").collect()}
    index.save_index(ix, str(tmp_path / "ix"), buckets=4)
    for one in (ix, index.load_index(spark, str(tmp_path / "ix"))):
        assert one.lexical.stemmed
        got = retrieve.retrieve_contexts(one, questions).filter("rank = 1").collect()
        assert {r.question_idx: r.node_id.split("/")[0] for r in got} == {0: "1", 1: "3", 2: "4"} and all(r.score > 0 for r in got)
        words = {r.question_idx: set(r.subquery.split(", ")) for r in expand.keyword_subqueries(one.lexical, questions).collect()}
        assert words[1] == {"encryption", "backup"}
    found = rag.rag_answer(ix.lexical, ix.nodes, questions).collect()
    assert all(r.reranked for r in found)
    ix.unpersist()


def test_a_scorer_that_fails_is_an_outcome_of_its_question(spark):
    docs, questions = setup(spark)
    ix = index.build_index(docs, (300, 40), 5)

    def breaks():
        def score(queries, texts):
            if any("backups" in q for q in queries):
                raise ValueError("scorer out of memory")
            return [float(len(t)) for t in texts]
        return score

    expansions = questions.select("question_idx", F.lit('{"sotto_query": []}').alias("raw"))
    choices = questions.select("question_idx", F.lit("1").alias("choice"))
    answers = questions.select("question_idx", F.lit('{"response": "Si", "justification": "j"}').alias("raw"))
    rows = assess.assess_questionnaire(ix, questions, expansions, choices, answers, score=breaks)
    got = {r.question_idx: (r.answer, r.justification) for r in rows.collect()}
    assert got[1] == ("Error: Reranking failed", "scorer out of memory")
    assert got[0] == got[3] == got[4] == ("Si", "j") and got[2][0] == "Error: Reranking failed"
    ix.unpersist()


def test_models_in_the_slots(spark):
    _, questions = setup(spark)

    def expander():
        return lambda prompts: ['{"sotto_query": [{"id": 1, "subquery": "a b"}]}' if "password" in p else "no" for p in prompts]

    subs, status = expand.expand_questions(questions, expand.model_replies(questions, expander))
    assert [(r.question_idx, r.subquery_no, r.subquery) for r in subs.collect()] == [(0, 1, "a b")]
    assert {r.question_idx for r in status.filter("expand_err is null").collect()} == {0}
    chosen = questions.withColumn("selected", F.when(F.col("question_idx") < 2, "ctx"))
    replies = assess.answer_replies(chosen, lambda: lambda ps: ['{"response": "No", "justification": "x"}' for _ in ps])
    got = {r.question_idx: r.response for r in assess.answer_questions(chosen, replies).collect()}
    assert got == {0: "No", 1: "No", 2: None, 3: None, 4: None}


def test_rag_with_and_without_reranker(spark):
    docs, questions = setup(spark)
    from askgrid.operators.lexical import build_lexical_index
    nodes = docs.withColumnRenamed("doc_id", "node_id")
    lex = build_lexical_index(nodes)
    on = {r.question_idx: r for r in rag.rag_answer(lex, nodes, questions).collect()}
    off = {r.question_idx: r for r in rag.rag_answer(lex, nodes, questions, use_reranker=False).collect()}
    assert on[0].reranked[0] == 1 and on[2].retrieved is None
    assert off[0].reranked is None and off[0].context == "\n\n".join(TEXTS[i] for i in off[0].retrieved[:5])


def test_saved_index_answers_like_the_built_one(spark, tmp_path):
    from askgrid.operators.lexical import bm25_topk
    docs, questions = setup(spark)
    built = index.build_index(docs, (300, 40), 5)
    path = str(tmp_path / "index")
    index.save_index(built, path, buckets=4)
    loaded = index.load_index(spark, path)
    rows = lambda ix: sorted(map(tuple, retrieve.retrieve_contexts(ix, questions).collect()))
    assert rows(loaded) == rows(built)
    queries = questions.selectExpr("question_idx AS query_id", "question AS text")
    plan = bm25_topk(loaded.lexical, queries)._jdf.queryExecution().executedPlan().toString()
    # the buckets take the place of a shuffle: only the best rows per task are exchanged
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    built.unpersist()


def test_models_take_part_in_the_plans(spark):
    """Every slot by a model whose decisions can be told from those of the defaults."""
    docs, questions = setup(spark)

    def embed():
        return lambda texts: [[float(len(t)), float(t.lower().count("backup"))] for t in texts]

    def score():
        return lambda asked, texts: [float(-len(t)) for t in texts]

    def expand_model():
        return lambda prompts: ['{"sotto_query": [{"id": 1, "subquery": "incident response"}]}' if "incidents" in p else "no json" for p in prompts]

    def answer_model():
        return lambda prompts: ['{"response": "Si", "justification": "%d"}' % ("Incident response" in p) for p in prompts]

    ix = index.build_index(docs, (300, 40), 5, embed=embed)
    assert ix.vectors.first().vector is not None and len(ix.query_vectors(questions.selectExpr("question_idx query_id", "question text")).first().vector) == 2
    ranked = retrieve.retrieve_contexts(ix, questions, score=score).collect()
    for q in {r.question_idx for r in ranked}:
        lengths = [len(r.text) for r in sorted(ranked, key=lambda r: r["rank"]) if r.question_idx == q]
        assert lengths == sorted(lengths)
    choices = questions.selectExpr("question_idx", "'1' choice")
    rows = {r.question_idx: r for r in assess.assess_questionnaire(ix, questions, expand_model, choices, answer_model, score=score).collect()}
    assert rows[3].answer == "Si" and rows[3].context and rows[3].justification in ("0", "1")
    assert rows[1].answer != "Si" and rows[1].context is None
    nodes = docs.selectExpr("doc_id node_id", "text")
    from askgrid.operators.lexical import build_lexical_index

    lexical = build_lexical_index(nodes)
    out = rag.rag_answer(lexical, nodes, questions, score=score, generate=answer_model).collect()
    assert all('"response"' in r.response for r in out)
    ix.unpersist()
