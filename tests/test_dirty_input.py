"""Wrong answers on input that clean tables do not hold."""

from pyspark.sql import functions as F

from askgrid.functions import contracts
from askgrid.operators import chunking, dedup, dense, sizing
from askgrid.sources import responses


def test_null_and_ragged_vectors_do_not_shift_the_others(spark):
    vectors = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [5.0, 5.0]), (5, [1.0]), (6, [1.0, 0.0, 0.0]),
                                     (7, [None, 1.0])], "node_id long, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, vector array<double>")
    near = dense.knn_l2(vectors, queries, 2).orderBy("rank").collect()
    assert [(r.query_id, r.node_id, r.dist) for r in near] == [(1, 2, 0.0), (1, 3, 2.0)]
    assert {r.node_id for r in dense.rejected_vectors(vectors, 2).collect()} == {1, 5, 6, 7}


def test_upsert_keeps_stored_rows_without_a_version(spark):
    stored = spark.createDataFrame([(1, "old1"), (2, "old2")], "question_id long, answer string")
    answers = spark.createDataFrame([(1, "new1", 5), (3, "a", 1), (3, "b", 1)], "question_id long, answer string, version long")
    out = responses.upsert_responses(stored.withColumn("version", F.lit(None).cast("long")), answers, ["question_id"], "version")
    assert {r.question_id: r.answer for r in out.collect()} == {1: "new1", 2: "old2", 3: "b"}
    out = responses.upsert_responses(stored, answers, ["question_id"], "version")
    assert {r.question_id: r.answer for r in out.collect()} == {1: "new1", 2: "old2", 3: "b"}


def test_equal_versions_take_the_new_row(spark):
    stored = spark.createDataFrame([(1, "z", 5)], "question_id long, answer string, version long")
    answers = spark.createDataFrame([(1, "a", 5)], "question_id long, answer string, version long")
    assert responses.upsert_responses(stored, answers, ["question_id"], "version").first().answer == "a"


def test_two_updates_of_a_key_change_one_row(spark):
    stored = responses.conform(spark.createDataFrame([(1, "q", "old")], "question_id long, question string, answer string"))
    updates = spark.createDataFrame([(1, "first", None, None, "2024-01-01"), (1, "second", "j", None, "2024-01-02")],
                                    "question_id long, answer string, justification string, context string, ts string")
    out = responses.update_responses(stored, updates).collect()
    assert [(r.answer, r.justification) for r in out] == [("second", "j")]


def test_null_text_and_missing_items_are_kept(spark):
    rows = spark.createDataFrame([("g", i, i) for i in range(5)], "g string, ord int, item_id int")
    items = spark.createDataFrame([(0, "a b"), (1, None), (2, None), (3, "a b")], "item_id int, text string")
    kept = {r.ord for r in dedup.greedy_dedup(rows, items, ["g"], "ord").filter("kept").collect()}
    assert kept == {0, 1, 2, 4}


def test_an_odd_item_spoils_no_other_subquery(spark):
    raws = ['{"sotto_query": ["a", {"id": 1, "subquery": "b"}, {"id": "x", "subquery": "c"}, 3, null]}']
    out = contracts.parse_subqueries(spark.createDataFrame([(r,) for r in raws], "raw string")).first()
    assert out.subqueries == ["b", "c"] and out.expand_err is None


def test_node_ids_of_ids_with_separators(spark):
    docs = spark.createDataFrame([("a", "one two three"), ("a/0", "one two three")], "doc_id string, text string")
    nodes = chunking.chunk_hierarchical(docs)
    assert nodes.count() == nodes.select("node_id").distinct().count()


def test_numbers_over_many_ranges_and_groups(spark):
    df = spark.range(5000).selectExpr("id * 7 k", "id % 3 g")
    out = sizing.number_rows(df, "k", "n", 1, ["g"], part_rows=300).collect()
    for g in range(3):
        mine = sorted((r.k, r.n) for r in out if r.g == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))
    assert sorted(r.n for r in sizing.number_rows(df, "k", "n", part_rows=300).collect()) == list(range(5000))
    assert sizing.number_rows(df.limit(0), "k", "n").count() == 0


def test_odd_queries_lose_only_their_own_result(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0, 0.0]), (4, [])], "node_id long, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0, None, 0.0, 0.0]), (5, [1.0] * 5), (6, [])],
                                    "query_id long, vector array<double>")
    near = {(r.query_id, r.node_id) for r in dense.knn_l2(vectors, queries, 1).collect()}
    assert near == {(1, 1), (2, 2), (3, 3)}
    alike = {(r.query_id, r.node_id) for r in dense.similarity_topk(vectors, queries).collect()}
    assert alike == {(1, 1), (2, 2), (3, 3)}
