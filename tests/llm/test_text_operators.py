"""Each operator against brute force, and the odd rows: nulls, empty and long texts, repeats, clashing columns, no rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from askgrid.llm import chat_format, exact_dedup, language_id, packing, quality_rules, sharding, simhash, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "the red fox ran over a long low hill and then went home to sleep until the sun was up again at noon".split()


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def rows():
    """(doc_id, text, lang, source): copies, near copies, shared passages, odd texts."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(words, 40))
    out = [(i, " ".join(rng.choice(words, int(rng.integers(1, 90)))), "xx", "a") for i in range(30)]
    out += [(100 + i, f"start {i} {passage} end {i}", "xx", "b") for i in range(6)]
    out += [(200 + i, " ".join(BASE), "yy", "b") for i in range(4)]
    out += [(210 + i, " ".join(BASE[: 20 - i]) + f" tail{i}", "yy", "a") for i in range(5)]
    out += [(300, None, None, None), (301, "", "xx", "a"), (302, " \t\n", "yy", "a"), (None, " ".join(BASE), "yy", None), (None, None, "xx", "a")]
    out += [(400, "long " + " ".join(rng.choice(words, 30_000)), "xx", "a")]
    out += [(401, "same row twice", "xx", "a"), (401, "same row twice", "xx", "a"), (402, "é ü 日本  x", "yy", "a")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, lang string, source string, kept string, row string, name int, words string"
    return spark.createDataFrame([(*r, "k", "r", 1, "w") for r in rows()], schema).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_dedup(docs, block_bytes=8192).collect()
    texts = Counter((t or "") for _, t, *_ in rows())
    largest = {}
    for i, t, *_ in rows():
        if i is not None:
            largest[t or ""] = max(largest.get(t or "", i), i)
    want = sorted((str(i), str(largest.get(t or "")), texts[t or ""], sha(t)) for i, t, *_ in rows())
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == Counter(dict.fromkeys(map(sha, texts), 1))
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    stay = exact_dedup.keep_distinct(docs)
    assert stay.columns == docs.columns and sorted((r.text or "") for r in stay.collect()) == sorted(texts)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_names_are_equal_for_equal_blocks_only(spark):
    frame = spark.range(3000).selectExpr("id", "cast(id % 7 as long) a", "cast(if(id % 2 = 0, 0, id % 3) as long) b").repartition(5)
    named = exact_dedup.name_sorted(frame, ["id"], 9).join(frame, "id").collect()
    names = {}
    for r in named:
        assert names.setdefault((r.a, r.b), r.name) == r.name
    assert sorted(names.values()) == list(range(len(names))) and sorted(names, key=names.get) == sorted(names)


def test_quality_counts(docs, none):
    got = {}
    for r in quality_rules.quality_counts(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text, *_ in rows():
        words = WORD.findall(text or "")
        seen = Counter(tuple(words[j:j + 5]) for j in range(len(words) - 4))
        covered = {j + k for j in range(len(words) - 4) if seen[tuple(words[j:j + 5])] > 1 for k in range(5)}
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        want = (len(words), sum(map(len, words)), len(covered), failed)
        assert want in [(r.n_words, r.word_chars, r.n_repeat_words, r.base_failed) for r in got[i]], i
        assert all(not (r.base_failed and r.kept) for r in got[i])
    assert quality_rules.quality_counts(none).count() == 0
    judged = quality_rules.quality_rules(docs)
    assert judged.filter("kept").select("row.*").columns == docs.columns and judged.count() == len(rows())


def test_quality_fences_follow_the_source(spark):
    """A rate of signs usual in one source is odd in another."""
    plain = "one two three four five six seven eight nine ten eleven twelve"
    signs = plain.replace(" ", " # ")
    data = [(i, f"{plain} {i}", "en", "prose") for i in range(300)] + [(1000 + i, f"{signs} {i}", "en", "code") for i in range(300)]
    data += [(2000, f"{signs} x", "en", "prose"), (2001, f"{signs} x", "en", "code"), (2002, f"{plain}\n{plain} x", None, "code")]
    kept = {r.doc_id: r.kept for r in quality_rules.quality_counts(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert not kept[2000] and kept[2001] and all(kept[i] for i in (*range(300), *range(1000, 1300)))


def test_repeated_lines_and_windows_are_judged_beyond_the_base_rule(spark):
    """Half the lines repeated, or a tenth of the words in repeated windows: odd in one source, lines usual in another."""
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    words = ["".join(rng.choice(letters, int(rng.integers(2, 9)))) for _ in range(3000)]
    some = lambda n: rng.choice(words, n).tolist()
    plain = lambda n: "\n".join(" ".join(some(10)) for _ in range(n))
    replies = lambda n: "\n".join(" ".join(some(3)) + "\nReply" for _ in range(n))
    passage = " ".join(some(20))
    data = [(i, plain(int(rng.integers(3, 60))), "en", "prose") for i in range(300)]
    data += [(1000 + i, replies(int(rng.integers(20, 60))), "en", "forum") for i in range(250)]
    data += [(2000, replies(40), "en", "prose"), (2001, f"{plain(18)} {passage} {plain(18)} {passage}", "en", "prose")]
    data += [(2002, f"{plain(20)}\nNotes\n{plain(20)}\nNotes\n{plain(5)}", "en", "prose")]
    got = {r.doc_id: r for r in quality_rules.quality_counts(
        spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert not got[2000].kept and not got[2001].kept and got[2002].kept
    assert all(got[i].kept for i in (*range(300), *range(1000, 1250)))


def test_sketch_buckets_keep_order(spark):
    values = [0, 1, 31, 32, 33, 63, 64, 65, 1000, 1023, 1024, 10**6, 10**12]
    out = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality_rules.bucket(F.col("v")).alias("b"))
    out = out.select("v", "b", quality_rules.bucket_floor(out["b"]).alias("low")).collect()
    assert all(r.low <= r.v < r.low * 17 / 16 + 1 for r in out)
    assert [r.b for r in sorted(out)] == sorted(r.b for r in out)


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[j:j + 3]) for j in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, none):
    got = simhash.near_dedup(docs).collect()
    prints = [(i, brute_fingerprint(t)) for i, t, *_ in rows()]
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{f:016x}") for i, f in prints)
    reach = list(range(len(prints)))
    for _ in prints:
        for a in range(len(prints)):
            for b in range(len(prints)):
                if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                    reach[a] = reach[b] = min(reach[a], reach[b])
    low = {}
    for root, (i, _) in zip(reach, prints):
        if i is not None:
            low[root] = min(low.get(root, i), i)
    want = sorted((str(i), str(low.get(root))) for root, (i, _) in zip(reach, prints))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == want
    stay = simhash.keep_representatives(docs)
    assert stay.columns == docs.columns and stay.count() == len(set(reach))
    assert simhash.near_dedup(none).count() == 0


def test_each_component_keeps_a_document_whatever_its_ids(spark):
    """Components of null ids alone, and one id that names two components."""
    texts = ["one red fox ran home over hills", "blue ships sail far north at dawn", "green tea is served in small cups",
             "old clocks tick loudly in the hall", "snow fell on quiet roofs all night"]
    ids = [None, None, 7, 7, 8]
    data = list(zip(ids, texts)) + [(None, texts[0]), (9, texts[2]), (None, texts[4])]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    stay = [(r.doc_id, r.text) for r in simhash.keep_representatives(docs).collect()]
    assert sorted(stay, key=str) == sorted(zip(ids, texts), key=str)


def test_all_links_within_three_bits_are_found(spark):
    """Chains and dense balls of fingerprints, with anchors crowded beyond a slice."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = set()
    for c in centres.tolist():
        for _ in range(60):
            x = c
            for b in rng.integers(0, 64, int(rng.integers(0, 5))).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    root = np.arange(len(fps))
    changed = True
    while changed:
        before = root.copy()
        for k in range(len(fps)):
            near = np.bitwise_count(fps ^ fps[k]) <= 3
            root[near] = root[near].min()
        changed = (before != root).any()
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for size in (simhash.SLICE, 20):
        held, simhash.SLICE = simhash.SLICE, size
        try:
            links = simhash.links(frame).distinct().collect()
        finally:
            simhash.SLICE = held
        place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
        found = np.arange(len(fps))
        for _ in range(len(fps)):
            before = found.copy()
            for a, b in links:
                i, j = place[a], place[b]
                found[i] = found[j] = min(found[i], found[j])
            if (before == found).all():
                break
        same = lambda r: [np.flatnonzero(r == v).tolist() for v in np.unique(r)]
        assert sorted(same(found)) == sorted(same(root))


@pytest.mark.parametrize("limit", [substring_dedup.GROUP_RECORDS, 0])
def test_substring_dedup(docs, none, limit):
    low = {}
    big = 1 << 62
    for i, t, *_ in rows():
        w = WORD.findall(t or "")
        for j in range(len(w) - 12):
            k = tuple(w[j:j + 13])
            low[k] = min(low.get(k, big), big if i is None else i)
    want = []
    for i, t, *_ in rows():
        w = WORD.findall(t or "")
        gone = set()
        for j in range(len(w) - 12):
            if low[tuple(w[j:j + 13])] < (big if i is None else i):
                gone |= set(range(j, j + 13))
        want.append((str(i), len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = substring_dedup.remove_repeats(docs, chunk_bytes=40_000, group_records=limit).collect()
    assert sorted((str(r.row.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == sorted(want)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    if limit:
        stay = substring_dedup.keep_first(docs)
        assert stay.columns == docs.columns
        texts = {r.doc_id: r.text for r in stay.filter("doc_id is not null").collect()}
        assert 201 not in texts and texts[200] == " ".join(BASE) and texts[300] is None
        assert substring_dedup.repeat_counts(none).count() == 0


def tokenizer():
    def make():
        return lambda text: np.array([len(w) for w in text.split()], "<u4").tobytes()

    return make


ids_of = tokenizer()()


def test_packing(docs, none):
    got = packing.pack(docs, tokenizer(), 1, capacity=64).collect()
    docs_of = {}
    for i, t, *_ in rows():
        docs_of.setdefault(i, []).append(np.frombuffer(ids_of((t or "").encode()), "<u4").tolist() + [1])
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at <= 64
    total = sum(len(d) for ds in docs_of.values() for d in ds)
    assert sum(r.length for r in got) == total and len(bins) * 64 <= 1.05 * total + 64
    for i, texts in docs_of.items():
        pieces = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == i)
        want = sorted((s, n, c, len(d)) for d in texts for s, n, c in cut_of(d))
        assert pieces == want
    assert packing.pack(none, tokenizer(), 1).count() == 0


def cut_of(ids):
    at, out = 0, []
    for n in packing.cut(len(ids), 64):
        out.append((at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes())))
        at += n
    return out


def test_cuts_waste_little():
    for n in range(1, 5000):
        pieces = packing.cut(n)
        assert sum(pieces) == n and len(pieces) <= n // 2048 + 8 and max(pieces) <= 2048


def test_sharding(docs, none):
    got = sharding.shard_rows(docs, (1.0, 1.0, 2.0)).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    for s in range(3):
        mine = sorted(r.slot for r in got if r.shard == s)
        assert mine == list(range(len(mine)))
    assert all(r.grown_shard in (r.shard, 3) for r in got)
    assert sharding.shard_rows(none).count() == 0


def test_shards_follow_their_weights(spark):
    many = spark.range(20_000).selectExpr("id doc_id", "'x' text")
    n = Counter(r.shard for r in sharding.shard_rows(many, (1.0, 3.0)).collect())
    assert abs(n[1] / 20_000 - 0.75) < 0.02


TURNS = [(1, 0, "user", "a </s> b"), (1, 1, "user", "<sep>"), (1, 2, "assistant", "[INST] <\\s> [/INST"), (1, 3, None, None),
         (2, 1, "assistant", "later"), (2, 0, "assistant", "<\\\\/s>"), (2, None, "user", "first"), (None, 0, "assistant", "no id"),
         (3, 0, "a[/INST]", "role"), (3, 1, "assistant", ""), (3, 1, "assistant", "")]


def test_chat_format(spark):
    frame = spark.createDataFrame([(*r, "x") for r in TURNS], "conv_id long, turn long, role string, text string, turns string")
    formatted = chat_format.format_conversations(frame)
    got = {r.conv_id: r for r in chat_format.digests(formatted).collect()}
    convs = {}
    for c, t, r, x in sorted(TURNS, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    texts = {r.conv_id: r.formatted for r in formatted.collect()}
    assert texts[1].startswith("<s>[INST] user [/INST]a <\\/s> b<sep><\\sep></s><s>[INST] assistant [/INST]")
    assert chat_format.format_conversations(frame.limit(0)).count() == 0


def test_chat_of_very_many_turns(spark):
    long = spark.range(1500).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('t', id) text")
    r = chat_format.digests(chat_format.format_conversations(long)).first()
    assert r.n_turns == 1500 and r.loss_sha256 == sha("".join(f"t{i}" for i in range(1, 1500, 2)))


def test_language_id(spark, docs, none):
    rng = np.random.default_rng(1)
    sounds = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "eit", "der"], "cc": ["ño", "ció", "que", "las"]}
    data = [(i, " ".join("".join(rng.choice(sounds[s], 2)) for _ in range(int(rng.integers(2, 60)))), s)
            for i, s in enumerate(list(sounds) * 60)]
    data += [(900, None, "aa"), (901, "12 34 !", "bb"), (902, "kalo " * 5, None), (None, "schung", "bb")]
    out = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert len(out) == len(data)
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in data if i is not None)
    assert out[900].lang_pred == out[901].lang_pred == "und" and out[902].lang_pred == "aa"
    held = [(out[i].lang_pred, lang) for i, _, lang in data if i is not None and i < 900 and out[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values())
    assert language_id.identify(none).count() == 0
    far = language_id.predict(spark.createDataFrame([(1, "ωψχ φυτ")], "doc_id long, text string"), *language_id.train(
        spark.createDataFrame([r[1:] for r in data], "text string, lang string"))).first()
    assert far.rejected


def plain_grams(text):
    """Counts of the letter n-grams of a text, one by one; None without a letter."""
    signs = [ord(c) if c.isalpha() else 0 for c in text.lower()]
    if not any(signs):
        return None
    line = [0]
    for c in [*signs, 0]:
        if c or line[-1]:
            line.append(c)
    line.append(0)
    counts = np.zeros(language_id.BUCKETS)
    for i in range(len(line) - 2):
        for size in (1, 2, 3):
            gram = line[i:i + size]
            if (size == 1 and not gram[0]) or (size == 3 and not gram[1]):
                continue
            x = 0
            for c in gram:
                x = (x * 0x110000 + c) % 2**64
            counts[(((x * 8 + size) * 0x9E3779B97F4A7C15 % 2**64) >> 40) % language_id.BUCKETS] += 1
    return counts


def test_language_id_equals_plain_tfidf_and_cosine(spark):
    """Whole real texts, odd rows, clashing columns; all languages at once and in blocks."""
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").limit(150).collect()
    data = [tuple(r) for r in real] + [(9000, None, "en"), (9001, "12 !", "en"), (9002, "", None), (9003, "word " * 300_000, "xx"),
                                       (9004, "twice the same", "en"), (9004, "twice the same", "en"), (None, "no id", "en")]
    docs = spark.createDataFrame([(*r, 5, 1.0, "h") for r in data], "doc_id long, text string, lang string, row_id int, score double, h string")
    idf, centroids = language_id.train(docs.select("text", "lang"))
    table = centroids.orderBy("lang", "j").collect()
    grams = [None if t is None else plain_grams(t) for _, t, _ in data]
    known = [g for g, (_, _, lang) in zip(grams, data) if g is not None and lang is not None]
    df = sum(g > 0 for g in known)
    assert np.allclose(idf, np.log((1 + len(known)) / (1 + df)) + 1)
    want = []
    for (i, _, _), g in zip(data, grams):
        if g is None:
            want.append((str(i), "und", 0.0, True))
            continue
        v = np.where(g > 0, 1 + np.log(np.maximum(g, 1)), 0) * idf
        v /= np.sqrt(v @ v)
        score, j = max((float(np.dot(v, r.c)), -k) for k, r in enumerate(table))
        want.append((str(i), table[-j].lang, min(score, 1.0), 1 - score > language_id.MARGIN * table[-j].radius))
    for at_once in (256, 2):
        got = language_id.predict(docs, idf, centroids, at_once).collect()
        assert len(got) == len(want)
        for r, w in zip(sorted(got, key=lambda r: (str(r.doc_id), r.score)), sorted(want, key=lambda w: (w[0], w[2]))):
            assert (str(r.doc_id), r.lang_pred) == w[:2] and abs(r.score - w[2]) < 1e-5
            edges = [language_id.MARGIN * c.radius for c in table if c.lang == r.lang_pred]
            assert r.rejected == w[3] or min(abs(1 - r.score - e) for e in edges) < 1e-4


def test_gram_counts_do_not_depend_on_windows(monkeypatch):
    text = "Ein Satz, der 12 Wörter hat; und\n\n noch   einer. " * 20
    whole = language_id.gram_counts(text)
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(language_id, "WINDOW", size)
        assert (language_id.gram_counts(text) == whole).all(), size


def test_language_of_copies_is_learned(spark):
    """Few distinct texts in very many rows: each language still gets its centroids, from each text once."""
    copies = {"aa": ["kalo mitu lomi"], "bb": ["schung eitder dereit", "ungsch derung"], "cc": ["cióque lasño"]}
    data = [(t, lang) for lang, texts in copies.items() for t in texts for _ in range(4000)] + [("12 34 !", "dd")] * 50
    data += [("kalo " + "mi" * n, "aa") for n in range(1, 30)]
    model = language_id.train(spark.createDataFrame(data, "text string, lang string").repartition(5))
    langs = [r.lang for r in model[1].collect()]
    assert sorted(set(langs)) == sorted(copies) and langs.count("bb") == 2
    ask = spark.createDataFrame([(i, t) for i, t in enumerate(t for ts in copies.values() for t in ts)], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.predict(ask, *model).orderBy("doc_id").collect()] == ["aa", "bb", "bb", "cc"]


def test_smallest_hashes_do_not_depend_on_flushes(spark, monkeypatch):
    data = [(" ".join(["kalo", "mitu"][(n >> b) & 1] for b in range(8)), "aa") for n in range(200)]
    frame = spark.createDataFrame(data, "text string, lang string").coalesce(2)
    whole = language_id.train(frame, 20)
    monkeypatch.setattr(language_id, "HELD_HASHES", 7)
    parts = language_id.train(frame, 20)
    assert (whole["centroids"] == parts["centroids"]).all() and (whole["radius"] == parts["radius"]).all()


def test_many_rows_of_one_id_and_text_go_as_one(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "COPIES", 5)
    rng = np.random.default_rng(12)
    words = [f"v{i}" for i in range(400)]
    passage = " ".join(rng.choice(words, 30))
    rows = [(i, f"{' '.join(rng.choice(words, 20))} {passage} tail{i}", i) for i in range(20)]
    rows += [(7, rows[3][1], 100 + i) for i in range(30)] + [(None, rows[4][1], 200 + i) for i in range(9)] + [(2, None, 300 + i) for i in range(8)]
    docs = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, key int, _text string").repartition(4)
    got = substring_dedup.remove_repeats(docs).select("row.key", "kept", "n_removed", "row._text").collect()
    monkeypatch.setattr(substring_dedup, "COPIES", 1000)
    want = substring_dedup.remove_repeats(docs).select("row.key", "kept", "n_removed", "row._text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == len(rows)
    assert any(r.n_removed for r in got if r.key >= 200) and all(r._text == "t" for r in got)


def test_anchor_with_very_many_records_is_lengthened():
    """Counts of an anchor's records are exact, however many one chunk has."""
    import pyarrow as pa

    same = " ".join(f"a{i}" for i in range(13))
    docs = pa.table({"chunk": pa.array([0] * 700, pa.int32()), "doc_id": list(range(700)),
                     "text": pa.array([f"{same} t{i} u{i}".encode() for i in range(700)])})
    sent = substring_dedup._scan(13, 6, 0)(docs)
    assert np.frombuffer(b"".join(sent.column("records").to_pylist()), "<u4").max() >= 300
    code = substring_dedup._decide(600)(pa.concat_tables([sent, sent]))
    assert substring_dedup.LONG in b"".join(code.column("data").to_pylist())


def test_ids_that_are_no_whole_numbers_are_refused(spark):
    docs = spark.createDataFrame([("a", "some text")], "doc_id string, text string")
    with pytest.raises(TypeError):
        substring_dedup.remove_repeats(docs)
    with pytest.raises(TypeError):
        packing.pack(docs, lambda: lambda t: b"", 1)
