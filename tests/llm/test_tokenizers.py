"""Encoders against the libraries that define them, on made-up texts and on the test tables."""

import base64
import random

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")

from askgrid.llm import sentencepiece_codec, token_counts  # noqa: E402
from askgrid.llm.word_bpe import WordBpe  # noqa: E402

SIGNS = ["a", "b", "e", "th", "ing", " ", " ", "  ", "    ", "\n", "\n\n", "\t", "é", "日", "😀", "▁", "0", "12", ".", "...", "'s", "'LL", "<s>", "Σ",
         "İ", "é", "K", "²", "ª", "ß", "<|endoftext|>", "<|x", "\x85", "\x1c", "ﬁ", "’", "return", "word "]


def texts(n, size, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, size))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_word_bpe():
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    own, library = WordBpe(path, memo=500), Tokenizer.from_file(path)
    for t in texts(3000, 12, 1):
        assert np.frombuffer(own.ids(t.encode()), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_word_bpe_of_latin_texts(docs):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    own, library = WordBpe(path, memo=500), Tokenizer.from_file(path)
    rng, signs = random.Random(9), [chr(i) for i in (*range(9, 14), *range(32, 127), *range(0xA1, 0x180))] + ["'s", "'ve", "  ", "ab"]
    latin = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    latin += [r.text or "" for r in docs.select("text").collect()]
    assert sum(map(own.is_plain, latin)) > 4000
    for t in latin:
        assert np.frombuffer(own.ids(t.encode()), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_sentencepiece_equals_library(spark, docs):
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    own, library = sentencepiece_codec.Codec(path, memo=50_000), sentencepiece.SentencePieceProcessor(model_file=path)
    for t in texts(3000, 14, 2):
        ids = own.encode(t).tolist()
        assert ids == library.encode(t), t
        assert own.decode(ids) == library.decode(ids)
    some = docs.select("doc_id", "text", "lang").limit(40)
    odd = spark.createDataFrame([(None, None, "x"), (-1, "", "x"), (-1, "", "x"), (-2, "word " * 50_000, "x")], some.schema)
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(some.union(odd), path, ["lang"]), path, ["lang"]).collect()
    want = {r.doc_id: (r.text or "") for r in some.union(odd).collect()}
    assert len(out) == 44 and all(r.text == want[r.doc_id] and list(r.ids) == library.encode(want[r.doc_id]) for r in out)
    assert sentencepiece_codec.encode(docs.limit(0), path).count() == 0


def test_viterbi_of_a_unigram_model_against_all_segmentations():
    rng = random.Random(4)
    pieces = {c: -rng.random() * 9 for c in "abc▁"}
    for _ in range(25):
        pieces["".join(rng.choice("abc") for _ in range(rng.randint(2, 4)))] = -rng.random() * 9
    own = sentencepiece_codec.Codec.of_pieces(list(pieces.items()))

    def best(s):
        return max((pieces[s[:k]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in pieces), default=-1e9) if s else 0.0

    for _ in range(200):
        s = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        ids = own.viterbi(s)
        assert "".join(own.texts[i] for i in ids) == s
        assert abs(sum(own.scores[i] for i in ids) - best(s)) < 1e-9
    assert own.viterbi("axb")[1] == 0  # a sign in no piece


def encoding():
    import tiktoken

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


MAKE = token_counts.TiktokenCounter(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def test_trees_follow_edits():
    counter, whole, rng = MAKE(), encoding(), random.Random(6)
    recounted = 0
    for t in texts(500, 600, 3):
        tree = token_counts.Tree.of_text(t, counter)
        assert tree.n_tokens == len(whole.encode_ordinary(t))
        for new in texts(4, rng.choice([1, 4, 500]), rng.random()):
            start, length = rng.randint(0, len(t) + 2), rng.choice([0, 1, 3, rng.randint(0, 300)])
            want = t[:start] + new + t[start + length:]
            tree, t, n = tree.edit(t, start, length, new, counter)
            recounted += n
            assert t == want and tree.n_tokens == len(whole.encode_ordinary(t))
            assert tree.chars[1 if len(tree.chars) > 1 else 0] == len(t)


def test_edit_of_a_long_text_recounts_little():
    counter = MAKE()
    tree = token_counts.Tree.of_text("one two three four " * 20_000, counter)
    _, _, n = tree.edit("one two three four " * 20_000, 200_000, 3, "xyz", counter)
    assert n < 400


def test_count_jobs(spark, docs):
    whole = encoding()
    rows = [(1, None, "x"), (2, "", "x"), (3, "one two three", "x"), (None, "four", "x"), (3, "one two three", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, tree string")
    edits = spark.createDataFrame([(3, 1, 0, 3, "1"), (3, 0, 100, 5, " end"), (None, 0, None, None, None), (2, 0, 0, 0, "new"), (9, 0, 0, 0, "lost")],
                                  "doc_id long, edit_no int, start int, length int, replacement string")
    trees = token_counts.build_trees(frame, MAKE)
    out = token_counts.apply_edits(token_counts.with_edits(trees, edits), MAKE).collect()
    want = {1: "", 2: "new", 3: "1 two three end", None: "four"}
    assert len(out) == 5
    for r in out:
        assert r.text == want[r.doc_id] and r.n_tokens == len(whole.encode_ordinary(want[r.doc_id]))
    assert token_counts.build_trees(docs.limit(0), MAKE).count() == 0


def test_registered_queries_equal_the_libraries(spark, docs):
    """op2, op3 and op4 over a whole table, document by document."""
    import zlib

    import sentencepiece
    from tokenizers import Tokenizer

    from askgrid.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in docs.collect()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    got = QUERIES["op2_sentencepiece"](spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r.doc_id].text or ""
        assert list(r.ids) == pieces.encode(text) and r.n_pieces == len(r.ids)
        assert r.round_trip == (pieces.decode(list(r.ids)) == text.replace("▁", " "))

    whole = encoding()
    for r in QUERIES["op3_token_counts"](spark, folder).collect():
        d = rows[r.doc_id]
        text = before = d.text or ""
        n = len(before)
        for start, length, new in ((0, 0, f"{d.source}: "), (n // 2, 0, before[:min(n // 5, 200)]), (n * 2 // 3, min(n // 10, 37), ""),
                                   (2 * n + 100, 0, f"\n({d.lang})")):
            text = text[:start] + new + text[start + length:]
        assert (r.n_tokens, r.root_tokens, r.n_chars) == (len(whole.encode_ordinary(text)),) * 2 + (len(text),)

    words, sequences, parts = Tokenizer.from_file(public.path("word_bpe_49k.json")), {}, {}
    for p in QUERIES["op4_packing"](spark, folder).collect():
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        parts.setdefault(p.doc_id, []).append(p)
    assert set(parts) == set(rows)
    for i, held in parts.items():
        ids = np.array([*words.encode(rows[i].text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        at = 0
        for p in sorted(held, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) // 4 and p.ids_crc32 == zlib.crc32(ids[4 * at:4 * (at + p.length)])
            at += p.length
        assert at == len(ids) // 4
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
