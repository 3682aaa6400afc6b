import random

import pyarrow as pa
from pyspark.sql import functions as F

from askgrid.functions import text as tx
from askgrid.functions.stem import stem_table
from askgrid.functions.words import distinct_word_hashes
from plain_porter import porter_stem


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("r")).first()["r"]


def test_tokenize_ws_matches_python_split(spark):
    samples = ["Ab  cd\tEF\n", "", "  ", "a b c", "x\x1cy\x0bz\x85w", "È già ciò"]
    for s in samples:
        assert one(spark, s, tx.tokenize_ws("t")) == s.lower().split()
        assert one(spark, s, tx.strip_text("t")) == s.strip()


def test_terms_without_stop_words(spark):
    assert one(spark, "The cat, and a Dog_2!", tx.tokenize_terms("t")) == ["cat", "dog_2"]
    assert one(spark, "The cat", tx.tokenize_terms("t", ())) == ["the", "cat"]


def test_jaccard(spark):
    rows = [("a b c", "A b"), ("", ""), ("a", ""), (" ".join(map(str, range(20))), " ".join(map(str, range(19))))]
    got = [r.j for r in spark.createDataFrame(rows, "a string, b string").select(
        tx.jaccard_similarity("a", "b").alias("j")).collect()]
    assert got == [2 / 3, 0.0, 0.0, 0.95]


def test_threshold_is_strict(spark):
    rows = [(19, 20, 19), (57, 58, 59), (20, 21, 20), (39, 40, 39)]
    got = [r.x for r in spark.createDataFrame(rows, "c int, a int, b int").select(
        tx.exceeds_jaccard(F.col("c"), F.col("a"), F.col("b"), 0.95).alias("x")).collect()]
    assert got == [19 / 20 > 0.95, 57 / 60 > 0.95, 20 / 21 > 0.95, 39 / 40 > 0.95]


def test_text_field_goes_by_key_presence(spark):
    docs = [({"text": "a"},), ({"content": "b"},), ({"text": "a", "content": "b"},), ({"x": "1"},), ({"text": None, "content": "b"},)]
    got = [r.t for r in spark.createDataFrame(docs, "doc map<string,string>").select(tx.text_field("doc").alias("t")).collect()]
    assert got == ["a", "b", "a", '{"x":"1"}', None]


def test_preview(spark):
    assert one(spark, "x" * 500, tx.preview("t")) == "x" * 500
    assert one(spark, "x" * 501, tx.preview("t")) == "x" * 500 + "..."
    assert one(spark, "ab", tx.log_preview("t")) == "ab..."


def test_whole_number_like_int(spark):
    cases = {" 3 ": 3, "+4": 4, "-1": -1, "3.7": None, "x": None, "": None, "99999999999": None}
    for k, v in cases.items():
        assert one(spark, k, tx.whole_number("t")) == v


def test_ratios(spark):
    df = spark.createDataFrame([(1, 2), (1, 0)], "a long, b long")
    got = df.select(tx.safe_ratio("a", "b").alias("r"), tx.average("a", "b").alias("m")).collect()
    assert [(r.r, r.m) for r in got] == [(0.5, 0.5), (0.0, 1.0)]


def test_porter_examples():
    # examples of the paper
    want = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre",
        "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop",
        "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
        "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope",
        "goodness": "good", "revival": "reviv", "adoption": "adopt", "probate": "probat", "rate": "rate",
        "controlling": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil",
    }
    assert {w: porter_stem(w) for w in want} == want


def test_stem_table(spark):
    df = spark.createDataFrame([("cats",), ("cat",), (None,)], "term string")
    assert {(r.term, r.stem) for r in stem_table(df).collect()} == {("cats", "cat"), ("cat", "cat"), (None, None)}


def test_every_white_space_character(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    text = "".join(f"a{c}B" for c in spaces)
    assert one(spark, text, tx.tokenize_ws("t")) == text.lower().split()
    others = "".join(chr(c) for c in range(1, 0x3100) if not chr(c).isspace() and not chr(c).isupper())
    assert one(spark, "x" + others, F.size(tx.split_words("t"))) == 1
    for c in spaces:
        assert one(spark, f"{c}{c}x{c}", tx.strip_text("t")) == "x"


def test_stems_equal_the_paper_word_by_word(spark):
    """Every step and its exceptions: made-up words of few letters with all suffixes, odd signs, y in all places."""
    import random

    from askgrid.functions.stem import STEP2, STEP3, STEP4

    rng = random.Random(2)
    ends = [x for x, _ in STEP2 + STEP3] + list(STEP4) + ["ed", "ing", "eed", "s", "es", "ies", "sses", "ss", "y", "e", "ll", "le", ""]
    words = ["".join(rng.choice("abeiloustyywxzr") for _ in range(rng.randint(0, 5))) + rng.choice(ends) + rng.choice(["", "", "s", "ed", "ing", "ly"])
             for _ in range(6000)] + ["yyyyy", "sky", "syzygy", "été", "日本", "x1", "_", "a", "", "caresses", "hopping", "falling", "relational"]
    words = sorted(set(words))
    got = stem_table(spark.createDataFrame([(w,) for w in words], "term string"))
    assert {r.term: r.stem for r in got.collect()} == {w: porter_stem(w) for w in words}
    assert got.count() == len(words)


def test_word_hashes_are_of_the_words_split_finds():
    """Every white space character, words of all lengths, nulls, and texts of a slice."""
    vocab = ["a", "b", "\u00e9", "x" * 8, "x" * 9, "y" * 16, "y" * 17, "z" * 64, "z" * 65, "z" * 200, "\u2019", "\u200b", "a\0", "a\0\0", "\u65e5\u672c"]
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    rnd = random.Random(2)
    texts = ["", None, "\u3000", "a"] + [
        "".join(rnd.choice(vocab) + rnd.choice(spaces) * rnd.randrange(3) for _ in range(rnd.randrange(30))) for _ in range(300)]
    for column in (pa.array(texts), pa.array(texts).slice(2, 100), pa.array([], pa.string())):
        hashes, begins = distinct_word_hashes(column)
        known = {}
        for text, a, b in zip(column.to_pylist(), begins, begins[1:]):
            known.setdefault(frozenset((text or "").split()), set()).add(tuple(hashes[a:b].tolist()))
        assert all(len(found) == 1 and len(next(iter(found))) == len(words) for words, found in known.items())
        assert len({next(iter(found)) for found in known.values()}) == len(known)
