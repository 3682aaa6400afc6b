"""Registered queries against their SQL, and the pipeline stage by stage."""

import pytest

duckdb = pytest.importorskip("duckdb")

import corpus_pipeline  # noqa: E402
from askgrid.llm.oracle import ORACLE  # noqa: E402
from askgrid.llm.queries import QUERIES  # noqa: E402
from tools.check import rows_of  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    cur = con.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_quality_sql_at_the_fences(spark, tmp_path):
    """Texts that stray by a little more each: half their lines repeated, more signs, longer words, in large and small groups."""
    import numpy as np

    rng, rows = np.random.default_rng(11), []
    for i in range(900):
        n = int(rng.integers(12, 120))
        words = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(1, 8)))) + str(rng.integers(0, 10_000)) for _ in range(n)]
        if i % 45 == 0:  # signs
            words = [w + "##" * (k < i / 25) for k, w in enumerate(words)]
        if i % 45 == 1:  # longer words
            words = [w * (1 + 4 * (k < i / 20)) for k, w in enumerate(words)]
        text = " ".join(words)
        if i % 45 == 2:  # repeated lines
            text = "\n".join(" ".join(words[k:k + 3]) + ("\nReply" if k < i / 15 else "") for k in range(0, n, 3))
        if i % 45 == 3:  # repeated windows
            text += " " + " ".join(words[:5 + i // 200])
        rows.append((i, text, ["en", "de", None][i % 3 if i % 50 else 2], f"s{i % 2}" if i % 7 else f"small{i % 5}"))
    rows += [(1000, None, "en", "s0"), (1001, "", None, None), (1002, "\n\n", "xx", "s1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES["op6_quality_rules"](spark, str(tmp_path))
    cur = con.execute(ORACLE["op6_quality_rules"])
    got, want = rows_of(df.columns, df.collect()), rows_of([d[0] for d in cur.description], cur.fetchall())
    assert got == want
    lost = df.filter("not kept and not base_failed").count()
    assert 10 < lost < 400


def pipeline_rows():
    """(doc_id, text, lang, source, n_chars, _text, row, sha): copies, near copies, shared passages; null and
    repeated ids, null and odd texts, columns with the names of working columns."""
    import numpy as np

    rng, words = np.random.default_rng(4), [f"w{i}" for i in range(3000)]
    say = lambda n: " ".join(rng.choice(words, n))
    texts = [(i, say(int(rng.integers(20, 90)))) for i in range(60)]
    passage = say(30)
    texts += [(100 + i, f"{say(25)} {passage} {say(25)}") for i in range(6)]  # a shared passage
    texts += [(200 + i, texts[3][1]) for i in range(4)] + [(None, texts[3][1]), (None, texts[5][1] + " x y")]  # copies
    long = say(900)
    texts += [(300 + i, long + f" end{i}") for i in range(4)] + [(None, long + " other end")]  # near copies
    texts += [(400, None), (401, ""), (402, "too short"), (403, "same words " * 60), (None, None), (None, "a clean text without any id " + say(30))]
    texts += [(7, say(40)), (7, say(40)), (8, texts[8][1])]  # ids that stand twice
    texts += [(500, "é ü 日本 " + say(20)), (501, say(30_000))]
    return [(i, t, ["en", "de"][k % 2], ["s", None][k % 5 == 4], None if t is None else len(t), "mine", k, "h") for k, (i, t) in enumerate(texts)]


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_quality(rows, tmp_path, spark, schema):
    """Rows the SQL of the rules keeps; rows are told apart by their place, as ids may repeat."""
    spark.createDataFrame([(r[6], r[1], r[2], r[3]) for r in rows], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(
        f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(ORACLE["op6_quality_rules"])
    at = [d[0] for d in cur.description]
    kept = {r[at.index("doc_id")] for r in cur.fetchall() if r[at.index("kept")]}
    return [r for r in rows if r[6] in kept]


def by_text(rows):
    """Of equal texts the largest id, a null id only if there is no other."""
    last = {}
    for r in rows:
        best = last.get(r[1] or "")
        if best is None or (r[0] is not None and (best[0] is None or r[0] > best[0])):
            last[r[1] or ""] = r
    return list(last.values())


def by_fingerprint(rows):
    """Of texts joined by chains of near fingerprints the smallest id; a null id last, then by hash of the text."""
    import hashlib

    from askgrid.llm import simhash

    prints = [simhash.fingerprint((r[1] or "").encode()) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())
    return [min((r for r, g in zip(rows, group) if g == k), key=order) for k in set(group)]


def by_windows(rows):
    """Texts without the words of windows that a smaller id has; null ids are larger than all."""
    low, big = {}, 1 << 62
    cut = [words_of(r[1]) for r in rows]
    for r, w in zip(rows, cut):
        for j in range(len(w) - 12):
            low[tuple(w[j:j + 13])] = min(low.get(tuple(w[j:j + 13]), big), big if r[0] is None else r[0])
    out = []
    for r, w in zip(rows, cut):
        gone = {k for j in range(len(w) - 12) if low[tuple(w[j:j + 13])] < (big if r[0] is None else r[0]) for k in range(j, j + 13)}
        text = " ".join(x for k, x in enumerate(w) if k not in gone)
        if not gone:
            out.append(r)
        elif text:
            out.append((r[0], text, r[2], r[3], len(text), *r[5:]))
    return out


def test_pipeline_stage_by_stage(spark, tmp_path):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    schema = "doc_id long, text string, lang string, source string, n_chars long, _text string, row int, sha string"
    rows = pipeline_rows()
    docs = spark.createDataFrame(rows, schema).repartition(3)
    plain = dict(zip([n for n, _ in corpus_pipeline.STAGES], [
        lambda x: by_quality(x, tmp_path, spark, schema), by_text, by_fingerprint, by_windows]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), name)
        before, rows = rows, plain[name](rows)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        got = [tuple(r) for r in docs.collect()]
        same = lambda xs: sorted(repr((x[0], x[1], x[4])) for x in xs)
        assert same(got) == same(rows), name
        whole = {r[6]: (r[0], *r[2:4], *r[5:]) for r in before}  # of rows that repeat, any may stay
        assert all(whole[r[6]] == (r[0], *r[2:4], *r[5:]) for r in got), name
        rows = got
        assert len(rows) < len(before) or name == "substring_dedup"
    assert any("w" in r[1] and r[0] is None for r in rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in rows:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((str(r[0]), len(ids), zlib.crc32(ids.tobytes())))
    pieces, whole = corpus_pipeline.pack(spark, docs, FOLDER).collect(), {}
    assert sum(p.length for p in pieces) == sum(n for _, n, _ in want)
    for p in pieces:  # documents in one piece are compared id by id, the others by their length
        whole.setdefault((str(p.doc_id), p.doc_tokens), []).append(p)
    assert {k for k in whole} == {(i, n) for i, n, _ in want}
    one = {(str(p.doc_id), p.doc_tokens, p.ids_crc32) for p in pieces if p.length == p.doc_tokens}
    assert one <= set(want)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0, name


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns
        sizes.append(docs.count())
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "exact_dedup":
            assert sizes[-1] == before.select("text").distinct().count()
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 100
    packed = corpus_pipeline.pack(spark, docs, FOLDER).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
