import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plain_porter import porter_stem
from askgrid.operators import candidates, chunking, dense, lexical, merging, models, sizing

DOCS = [
    (1, "Password policy requires rotation of passwords every year"),
    (2, "Backups are encrypted and the backups are tested"),
    (3, "The policy for encryption of backups"),
    (4, "the and of"),
    (5, "Password managers"),
]


def plain_bm25(docs, query, k1=1.5, b=0.75, stem=lambda w: w):
    from askgrid.functions.text import ENGLISH_STOP_WORDS
    cut = lambda t: [stem(w) for w in t.lower().split() if w not in ENGLISH_STOP_WORDS]
    bags = {i: cut(t) for i, t in docs}
    avg = sum(map(len, bags.values())) / len(bags)
    scores = {}
    for i, bag in bags.items():
        s, tf = 0.0, Counter(bag)
        for w in set(cut(query)):
            df = sum(w in x for x in bags.values())
            if tf[w]:
                s += math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * tf[w] * (k1 + 1) / (
                    tf[w] + k1 * (1 - b + b * len(bag) / avg))
        if any(tf[w] for w in set(cut(query))):
            scores[i] = round(s, 6)
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))


def tables(spark, queries):
    nodes = spark.createDataFrame(DOCS, "node_id long, text string")
    return nodes, spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")


def test_bm25_equals_plain_formula(spark):
    texts = ["password policy password", "encryption of backups", "nothing here matches"]
    nodes, queries = tables(spark, texts)
    index = lexical.build_lexical_index(nodes)
    got = lexical.bm25_topk(index, queries, k=3).orderBy("query_id", "rank").collect()
    for q, text in enumerate(texts):
        assert [(r.node_id, r.score) for r in got if r.query_id == q] == plain_bm25(DOCS, text)[:3]


def test_bm25_with_stems(spark):
    texts = ["encrypting backup", "passwords"]
    nodes, queries = tables(spark, texts)
    index = lexical.build_lexical_index(nodes)
    got = lexical.bm25_topk(index, queries, stemmed=True).orderBy("query_id", "rank").collect()
    for q, text in enumerate(texts):
        assert [(r.node_id, r.score) for r in got if r.query_id == q] == plain_bm25(DOCS, text, stem=porter_stem)


def test_bm25_without_broadcast_is_the_same(spark, monkeypatch):
    nodes, queries = tables(spark, ["password policy", "backups tested"])
    index = lexical.build_lexical_index(nodes)
    want = sorted(map(tuple, lexical.bm25_topk(index, queries).collect()))
    monkeypatch.setattr(lexical, "broadcast_if_small", lambda df: df)
    assert sorted(map(tuple, lexical.bm25_topk(index, queries).collect())) == want


def test_scores_do_not_shuffle_the_term_table(spark):
    nodes, queries = tables(spark, ["password policy"])
    index = lexical.build_lexical_index(nodes)
    plan = lexical.bm25_topk(index, queries)._jdf.queryExecution().executedPlan().toString()
    before_cache = plan.split("InMemoryTableScan")[0]
    assert "WindowGroupLimit" in before_cache
    # one exchange of the k best rows per task; the other is the broadcast of the query terms
    assert before_cache.count("Exchange hashpartitioning") == 1


def test_terms_that_cannot_reach_the_threshold_are_left_out(spark, monkeypatch):
    """Long queries of a few rare and many common words over nodes of very different lengths."""
    monkeypatch.setattr(lexical, "FIRST_NODES", 2)
    rng = np.random.default_rng(7)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(150)]
    docs = []
    for i in range(400):
        words = [str(w) for w in rng.choice(common, int(rng.integers(3, 60)))] + [str(w) for w in rng.choice(rare, int(rng.integers(0, 6)))]
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, docs[3][1]) for i in range(30)]  # ties go by id
    texts = [" ".join([*common[:9], *map(str, rng.choice(rare, 5))]) for _ in range(12)] + ["c1 c2 c3", "r1", "unknown", docs[3][1]]
    index = lexical.build_lexical_index(spark.createDataFrame(docs, "node_id long, text string").repartition(4))
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    got = {}
    for r in lexical.bm25_topk(index, queries, k=4, steps=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.node_id, r.score))
    for q, text in enumerate(texts):
        want = plain_bm25(docs, text)[:4]
        assert [i for i, _ in got.get(q, [])] == [i for i, _ in want]
        assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in want], abs=2e-6)
    once = lexical.bm25_topk(index, queries, k=4, steps=False).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.node_id) for r in once] == [(q, i) for q in sorted(got) for i, _ in got[q]]
    read = lexical.postings_read(index, queries, 4).first()
    assert read.n_left and read.n_first + read.n_full + read.n_found + read.n_left < read.n_postings / 2
    monkeypatch.setattr(lexical, "STEPS_FROM", 0)  # taken by itself where many rows are asked for
    assert lexical.bm25_topk(index, queries, k=4).count() == len(once)


def test_merged_term_tables_are_those_of_the_whole(spark):
    index = lexical.build_lexical_index(tables(spark, [])[0])
    parts = [lexical.term_table(index.postings.filter(f"node_id % 2 = {i}")) for i in (0, 1)]
    merged = lexical.merge_term_tables(parts[0].unionByName(parts[1])).select(index.terms.columns)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, index.terms.collect()))


def test_knn_equals_numpy_with_ties(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 8)).round(1)
    m[100:200] = m[0]  # a third are copies: ties go by id
    q = np.vstack([m[0], rng.normal(size=(4, 8))])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "node_id long, vector array<float>").repartition(7)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id int, vector array<double>")
    m32 = m.astype(np.float32).astype(np.float64)
    want = set()
    for i, v in enumerate(q):
        d = np.round(((m32 - v) ** 2).sum(1), 6)
        for r, j in enumerate(np.lexsort((np.arange(300), d))[:15]):
            want.add((i, int(j), float(d[j]), r + 1))
    assert {tuple(r) for r in dense.knn_l2(vectors, queries).collect()} == want
    monkeypatch.setattr(dense, "MAX_QUERY_BYTES", 2 * 8 * 8)  # several passes
    assert {tuple(r) for r in dense.knn_l2(vectors, queries).collect()} == want


def test_knn_of_large_vectors_is_exact(spark):
    base = np.full(4, 1e6)
    vectors = spark.createDataFrame([(i, (base + i * 1e-2).tolist()) for i in range(40)], "node_id long, vector array<double>")
    queries = spark.createDataFrame([(0, base.tolist())], "query_id int, vector array<double>")
    got = dense.knn_l2(vectors, queries, 5).orderBy("rank").collect()
    assert [r.node_id for r in got] == [0, 1, 2, 3, 4]


def test_knn_without_queries(spark):
    vectors = spark.createDataFrame([(1, [1.0])], "node_id long, vector array<double>")
    queries = spark.createDataFrame([], "query_id int, vector array<double>")
    assert dense.knn_l2(vectors, queries).count() == 0


def test_similarity_threshold_and_top(spark):
    vectors = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0]), (4, [0.5, 0.0]), (5, [0.0, 0.0])], "node_id long, vector array<double>")
    queries = spark.createDataFrame([(0, [2.0, 0.0])], "query_id int, vector array<double>")
    got = dense.similarity_topk(vectors, queries).orderBy("rank").collect()
    assert [(r.node_id, r.similarity) for r in got] == [(1, 1.0), (4, 1.0)]
    got = dense.similarity_topk(vectors, queries, 0.5, 9).orderBy("rank").collect()
    assert [r.node_id for r in got] == [1, 4, 2]


def test_vector_dimension(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "node_id long, vector array<double>")
    r = dense.vector_dimension(df).first()
    assert (r.min_dim, r.max_dim, r.is_constant) == (1, 2, False)


def windows(words, size, overlap):
    n = max(1, math.ceil((len(words) - overlap) / (size - overlap)))
    return [words[i * (size - overlap): i * (size - overlap) + size] for i in range(n)]


def test_chunks_of_three_levels(spark):
    docs = [(i, " ".join(f"d{i}w{j}" for j in range(n))) for i, n in enumerate((0, 1, 7, 40, 133))]
    sizes, overlap = (40, 15, 6), 3
    got = chunking.chunk_hierarchical(spark.createDataFrame(docs, "doc_id long, text string"), sizes, overlap)
    want = {}

    def cut(path, words, level, parent):
        if level == len(sizes):
            return
        parts = windows(words, sizes[level], overlap)
        for i, p in enumerate(parts):
            want[f"{path}/{i}"] = (level, parent, i, len(parts), " ".join(p))
            cut(f"{path}/{i}", p, level + 1, f"{path}/{i}")

    for i, t in docs:
        cut(str(i), t.split(), 0, None)
    assert {r.node_id: (r.level, r.parent_id, r.seq, r.n_siblings, r.text) for r in got.collect()} == want
    leaves = {r.node_id for r in chunking.leaf_nodes(got).collect()}
    assert leaves == {k for k, v in want.items() if v[0] == 2}
    assert {r.node_id for r in chunking.root_nodes(got).collect()} == {k for k, v in want.items() if v[0] == 0}


def test_children_cover_the_document(spark):
    text = " ".join(f"w{j}" for j in range(9001))
    got = chunking.chunk_hierarchical(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    parents = [r.text.split() for r in got.filter("level = 0").orderBy("seq").collect()]
    joined = parents[0] + [w for p in parents[1:] for w in p[100:]]
    assert joined == text.split() and len(parents) == 3


def tree(spark):
    nodes = [(1, None, 0), (2, None, 0), (11, 1, 1)] + [(20 + i, 2, 1) for i in range(10)]
    return spark.createDataFrame(nodes, "node_id long, parent_id long, level int")


def test_auto_merge_is_strict(spark):
    hits = [("two", 20, 0.1), ("two", 21, 0.3), ("three", 20, 0.1), ("three", 21, 0.3), ("three", 22, 0.5),
            ("one", 11, 0.7), ("one", 20, 0.2)]
    got = merging.auto_merge(spark.createDataFrame(hits, "query_id string, node_id long, dist double"), tree(spark))
    out = {}
    for r in got.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.node_id, r.dist, r.merged))
    assert out["two"] == [(20, 0.1, False), (21, 0.3, False)]
    assert out["three"] == [(2, 0.3, True)]
    assert out["one"] == [(20, 0.2, False), (1, 0.7, True)]


def test_union_order(spark):
    dense_hits = spark.createDataFrame([((0, 0), "n1", 1), ((0, 1), "n2", 1)],
                                       "query_id struct<question_idx:int,subquery_no:int>, node_id string, rank int")
    sparse = spark.createDataFrame([((0, 0), "n1", 1), ((0, 0), "n3", 2)], dense_hits.schema)
    got = candidates.union_subqueries(candidates.hybrid_union(dense_hits, sparse)).orderBy("ord")
    assert [r.node_id for r in got.collect()] == ["n1", "n1", "n3", "n2"]


def test_model_slots_run_in_batches(spark):
    seen = []

    def embedder():
        def run(texts):
            assert len(texts) <= 3
            return [[float(len(t)), 1.0] for t in texts]
        return run

    df = spark.createDataFrame([(f"{'x' * i}", f"{'y' * i}") for i in range(10)], "question string, text string").coalesce(1)
    assert [r.vector for r in models.embed_with(df, embedder, batch_size=3).collect()] == [[float(i), 1.0] for i in range(10)]
    scored = models.score_with(df, lambda: lambda q, t: [len(a) + len(b) for a, b in zip(q, t)], batch_size=4)
    assert [r.score for r in scored.collect()] == [2.0 * i for i in range(10)]
    replies = models.infer_with(df, lambda: lambda p: [x.upper() for x in p], prompt="text")
    assert [r.raw for r in replies.collect()] == ["Y" * i for i in range(10)]


def test_row_numbers_over_buckets(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    got = sizing.number_rows(df, "k", "n", 5, part_rows=50).collect()
    assert all(r.n == r.k + 5 for r in got) and len(got) == 1000
    by_group = sizing.number_rows(df, "k", "n", 0, ["g"], part_rows=90).orderBy("g", "k").collect()
    for g in range(3):
        assert [r.n for r in by_group if r.g == g] == list(range(sum(r.g == g for r in by_group)))


@pytest.mark.parametrize("fits", [True, False])
def test_join_hot_apart(spark, monkeypatch, fits):
    monkeypatch.setattr(sizing, "fits_broadcast", lambda df, *limits: fits)
    monkeypatch.setattr(sizing, "HOT_KEY_ROWS", 10)
    big = spark.range(100).select(F.when(F.col("id") < 60, 0).otherwise(F.col("id")).alias("k"), "id")
    unique = big.groupBy("k").agg(F.count("*").alias("rows"))
    got = sizing.join_hot_apart(big, unique, ["k"], "rows", 100)
    assert sorted((r.id, r.rows) for r in got.collect()) == [(i, 60 if i < 60 else 1) for i in range(100)]
    plan = got._jdf.queryExecution().toString()
    assert ("_salt" in plan) != fits  # beyond the broadcast the hot keys are salted


def test_concat_in_order_over_runs(spark):
    df = spark.range(50).select(F.lit("d").alias("doc_id"), F.col("id").alias("n"), F.col("id").cast("string").alias("t")).repartition(5)
    got = sizing.concat_in_order(df, ["doc_id"], "n", "t", "-", block=8).first()
    assert got.text == "-".join(map(str, range(50)))


def test_broadcast_needs_few_rows_and_few_bytes(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.array("id").alias("a"),
                                 F.create_map(F.lit("k"), F.lit("v")).alias("m"), F.struct("id").alias("s"))
    assert sizing.fits_broadcast(df) and not sizing.fits_broadcast(df, max_rows=99)
    assert not sizing.fits_broadcast(df, max_bytes=50_000)
    assert sizing.fits_broadcast(df.limit(0))


def test_postings_are_counted_in_rows_of_bounded_partitions(spark, monkeypatch):
    """Counts hold no table of a task's terms, and a task gets some bytes of text however many there are."""
    docs = [(i, " ".join(f"w{(i * j) % 7} X{j}" for j in range(9)) if i % 5 else None if i % 2 else " the ") for i in range(40)]
    nodes = spark.createDataFrame(docs, "node_id long, text string")
    want = {(i, len(t.split()), w, n) for i, t in docs if t and t.strip() != "the" for w, n in Counter(t.lower().split()).items()}
    monkeypatch.setattr(lexical, "PART_BYTES", 100)
    got = lexical.term_postings(nodes)
    assert {(r.node_id, r.dl, r.term, r.tf) for r in got.collect()} == want
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.rdd.getNumPartitions() >= sum(len(t or "") for _, t in docs) // 100
    stems = lexical.term_postings(nodes, stemmed=True)
    assert stems.rdd.getNumPartitions() >= sum(len(t or "") for _, t in docs) // 100
    twice = lexical.term_postings(nodes.unionByName(nodes)).collect()  # rows of one id are counted together
    assert sorted((r.node_id, r.dl, r.term, r.tf) for r in twice) == sorted((i, dl, w, 2 * n) for i, dl, w, n in want)


ODD_TEXTS = [None, "", " .,; ", "the and of", "É ÉTÉ été İstanbul ΣΑΣ straße", "a_b a-b a.b 1st 2² ½ x" * 3, "日本 語 日本", "é 🙂 𝔘 𐐀"]


def test_a_node_is_one_row_of_the_term_table(spark, monkeypatch):
    """Counts made row by row are those of the exploded table, and its searches the same in blocks and passes."""
    rng = np.random.default_rng(11)
    docs = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    docs += [(100 + i, " ".join(map(str, rng.choice([f"w{j}" for j in range(40)], int(rng.integers(1, 30)))))) for i in range(300)]
    docs += [(1000 + i, docs[20][1]) for i in range(40)]  # ties go by id
    nodes = spark.createDataFrame(docs, "node_id long, text string").repartition(3)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 500)
    index = lexical.build_lexical_index(nodes)
    assert index.bags.groupBy("node_id").count().filter("count > 1").isEmpty()
    want = sorted(map(tuple, lexical.term_postings(nodes).collect()))
    assert sorted(map(tuple, index.postings.collect())) == want and index.n_postings == len(want)
    texts = [" ".join(map(str, rng.choice([f"w{j}" for j in range(45)], 8))) for _ in range(20)] + [docs[20][1], "été 日本", "unknown", None]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    plain = lexical.LexicalIndex(lexical.term_postings(nodes).persist(), index.n_nodes, index.avg_len, index.terms)
    want = sorted(map(tuple, lexical.bm25_topk(plain, queries, 4, steps=False).collect()))
    assert sorted(map(tuple, lexical.bm25_topk(index, queries, 4, steps=False).collect())) == want
    for name, most in (("MAX_SCORES", 60), ("MAX_PARTS", 90), ("MAX_QUERY_TERMS", 20)):
        monkeypatch.setattr(lexical, name, most)
    assert sorted(map(tuple, lexical.bm25_topk(index, queries, 4, steps=False).collect())) == want
    both = [dense.hashed_vectors(index.postings), dense.hashed_bags(index.bags)]
    one, other = [{r.node_id: {a: round(x, 9) for a, x in zip(r.vector.at, r.vector.x)} for r in v.collect()} for v in both]
    assert one == other


def test_chunks_are_those_of_plain_windows(spark, monkeypatch):
    """Ids with separators, null ids and texts, white space of every kind, and blocks of few bytes."""
    monkeypatch.setattr(chunking, "BLOCK_BYTES", 50)
    docs = [("a/b", "x\u00a0y\u2003z\x1cq\x85r s\t\nt", 1), ("c", None, None), (None, "p q", 3), ("d", "", 4), ("e", " ".join(map(str, range(60))), 5)]
    got = chunking.chunk_hierarchical(spark.createDataFrame(docs, "doc_id string, text string, extra int"), (7, 3), 1, keep=("extra",))
    assert got.columns == ["node_id", "doc_id", "level", "parent_id", "seq", "n_siblings", "text", "extra"]
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    want = []
    for doc, text, extra in docs:
        words = None if text is None else text.split()
        cut = lambda w, size: [None] if w is None else [w[i:i + size] for i in range(0, max(1, len(w) - 1), size - 1)]
        tops = cut(words, 7)
        for i, top in enumerate(tops):
            name = "/".join([*([doc.replace("/", "//")] if doc is not None else []), str(i)])
            line = lambda w: None if w is None else " ".join(w)
            want.append((name, doc, 0, None, i, len(tops), line(top), extra))
            low = cut(top, 3)
            want += [(f"{name}/{j}", doc, 1, name, j, len(low), line(w), extra) for j, w in enumerate(low)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_an_index_holds_no_term_table_in_memory(spark):
    """Also where some rows come twice; their counts are added up as before."""
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    nodes = tables(spark, [])[0]
    before = held()
    lexical.build_lexical_index(nodes)
    twice = lexical.build_lexical_index(nodes.unionByName(nodes.filter("node_id < 3")))
    assert held() == before
    want = lexical.term_postings(nodes.unionByName(nodes.filter("node_id < 3"))).select(twice.postings.columns)
    assert sorted(map(tuple, twice.postings.collect())) == sorted(map(tuple, want.collect()))
    assert twice.n_nodes == 7 and twice.avg_len * 7 == want.agg(F.sum("tf")).first()[0]
    plain = lexical.LexicalIndex(want, twice.n_nodes, twice.avg_len, lexical.term_table(want))
    words = spark.createDataFrame([("policy",), ("backups",), ("none",)], "term string")
    assert sorted(map(tuple, twice.facts(words).collect())) == sorted(map(tuple, plain.facts(words).collect()))
    wanted = spark.createDataFrame([(1,), (5,)], "node_id long")
    assert {tuple(r) for r in twice.of_nodes(wanted).select("node_id", "term", "tf").collect()} == {
        tuple(r) for r in plain.of_nodes(wanted).select("node_id", "term", "tf").collect()}


def test_hits_without_parents_are_searched_once(spark):
    """The parents of hits, and their children, are looked up without a second search."""
    searched = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            searched.add(batch.num_rows)
            yield batch

    hits = spark.createDataFrame([(1, 20, 0.1), (1, 21, 0.3), (2, 11, 0.7), (2, 2, 0.5)], "query_id long, node_id long, dist double")
    got = merging.merge_ratio(hits.mapInArrow(seen, hits.schema), tree(spark)).collect()
    assert {(r.query_id, r.parent_id, r.n_hit, r.n_children) for r in got} == {(1, 2, 2, 10), (2, 1, 1, 1)}
    assert searched.value == 4


def test_candidates_of_subqueries_come_from_rows_per_node(spark):
    """The plan of a search reads one row per node, never the rows per term."""
    nodes, queries = tables(spark, ["password policy", "backups"])
    index = lexical.build_lexical_index(nodes)
    for plan in (lexical.bm25_topk(index, queries), index.facts(queries.select("text").withColumnRenamed("text", "term"))):
        assert "Generate" not in plan._jdf.queryExecution().executedPlan().toString()


def test_documents_are_read_once_into_nodes_and_their_terms(spark, monkeypatch):
    """An index of distinct documents cuts, counts and hashes in one pass, which gives what the steps give one by one;
    the facts of the same words are looked up once."""
    from askgrid.plans import index as plan

    rng = np.random.default_rng(5)
    docs = [*enumerate([*ODD_TEXTS, "ĀĂ Žluťoučký kůň ŸŒ\u0149\u00a0\u00b5\u0085x \u0130I\u017f K\u212a Ǆ ΑΣ ΑΣα", "-" * 30, "\x01a\x01b \x1cc"])]
    docs += [(100 + i, " ".join(map(str, rng.choice([f"w{j}, É{j}." for j in range(40)], int(rng.integers(1, 90)))))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    cut = chunking.chunk_hierarchical(frame, (30, 9), 2)
    bags = {r.node_id: (r.dl, dict(zip(r.words.split(), r.tfs))) for r in lexical.bag_rows(cut).collect()}
    vectors = {r.node_id: dict(zip(r.vector.at, r.vector.x)) for r in dense.hashed_bags(lexical.bag_rows(cut.filter("level = 1"))).collect()}
    steps = lexical.build_lexical_index(cut, keep=plan.TREE)
    queries = spark.createDataFrame([(0, "w1 É7 kůň"), (1, "w3 w3 w9"), (2, "ασ x"), (3, "none"), (4, None)], "query_id int, text string")
    want = sorted(map(tuple, lexical.bm25_topk(steps, queries, 4).collect()))

    for name, value in (("BLOCK_BYTES", 300), ("BLOCK_WORDS", 40)):
        monkeypatch.setattr(chunking, name, value)
    monkeypatch.setattr(lexical, "FACT_RUNS", 2)
    monkeypatch.setattr(lexical, "BAG_ROWS", 3)
    monkeypatch.setattr(dense, "VECTOR_ROWS", 2)
    monkeypatch.setattr(lexical, "bag_rows", lambda *a: pytest.fail("a second pass over the texts"))
    calls, count = [], lexical._count_facts
    monkeypatch.setattr(lexical, "_count_facts", lambda *a: calls.append(a) or count(*a))
    built = plan.build_index(frame, (30, 9), 2)
    assert sorted(map(tuple, built.nodes.collect()), key=str) == sorted(map(tuple, cut.collect()), key=str)
    assert {r.node_id: (r.dl, dict(zip(r.words.split(), r.tfs))) for r in built.lexical.bags.collect()} == bags
    assert {r.node_id: dict(zip(r.vector.at, r.vector.x)) for r in built.vectors.collect()} == vectors
    assert (built.lexical.n_postings, built.lexical.n_nodes, built.lexical.avg_len) == (steps.n_postings, steps.n_nodes, steps.avg_len)
    models.keyword_subqueries(built.lexical, queries.withColumnsRenamed({"query_id": "question_idx", "text": "question"})).collect()
    assert sorted(map(tuple, lexical.bm25_topk(built.lexical, queries, 4).collect())) == want and len(calls) == 1
    some = spark.createDataFrame([(n,) for n in list(bags)[:5]], "node_id string")
    assert {(r.node_id, r.term): r.tf for r in built.lexical.of_nodes(some).collect()} == {
        (n, w): c for n in list(bags)[:5] for w, c in bags[n][1].items()}
    asked = built.query_vectors(queries)
    got = [sorted(map(tuple, dense.knn_l2(v, asked, 3, ("parent_id",)).collect())) for v in (built.searched, built.vectors)]
    assert got[0] == got[1] and len(got[0]) == 12
