"""Language of a text by its nearest centroid.

A text becomes a vector of letter n-grams (one to three signs, words padded by a blank), hashed
into buckets, weighted by (1 + ln count) * idf and scaled to length one. Every language has
several centroids, found by spherical k-means over a bounded sample of its distinct training texts. The
language of the most similar centroid (cosine) is predicted; a text farther from it than the
centroid's own texts ever were, by a margin, is marked as rejected.

Document frequencies cover all training texts. Only the k-means sample is bounded: of each language
the distinct texts with the smallest hashes, so copies neither fill it nor leave it empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.llm.rows import written
from askgrid.operators.sizing import broadcast_if_small, number_rows, top_per_group

BUCKETS = 8192
SAMPLE_PER_LANGUAGE = 512  # distinct training texts k-means sees of one language, at most
LANGUAGES_AT_ONCE = 256  # languages whose centroids a task holds; more are scored block after block
SPREAD = 64  # parts the sampled hashes of a language are ranked in before they meet
CENTROIDS = 3
ROUNDS = 12
MARGIN = 1.25
WINDOW = 1 << 20
HELD_HASHES = 1 << 18  # a task passes on its smallest hashes when it holds that many
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _fold(x: np.ndarray, order: int) -> np.ndarray:
    x = (x * np.uint64(8) + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(40)).astype(np.int64) % BUCKETS


def gram_counts(text: str) -> np.ndarray | None:
    """Count of each n-gram bucket over the whole text; None if it has no letter.

    The text is read in windows, two signs of the last one carried over, so memory does not
    grow with its length.
    """
    letters, counts, carry, seen = _letters(), np.zeros(BUCKETS, np.int64), np.zeros(1, np.uint64), False
    low = text.lower()
    for at in range(0, len(low), WINDOW):
        codes = np.frombuffer(low[at:at + WINDOW].encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter = letters[codes]
        seen = seen or bool(is_letter.any())
        codes = np.concatenate([carry, np.where(is_letter, codes, 0).astype(np.uint64)])
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        if len(carry) > 1:
            keep[:len(carry)] = True
        codes = codes[keep]
        if at + WINDOW >= len(low):
            codes = np.concatenate([codes, np.zeros(1 if codes[-1] == 0 else 2, np.uint64)])
        if len(codes) < 3:
            carry = codes
            continue
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        one, two = a[a != 0], a * np.uint64(0x110000) + b
        three = (two * np.uint64(0x110000) + c)[(b != 0)]
        for order, grams in ((1, one), (2, two), (3, three)):
            counts += np.bincount(_fold(grams, order), minlength=BUCKETS)
        carry = codes[-2:]
    return counts if seen else None


def _vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    return (v / max(np.sqrt(v @ v), 1e-12)).astype(np.float32)


def _frequencies(sample: int):
    """Of a task: how many texts have each bucket (BUCKETS: how many have a letter), and of each
    language the ``sample`` smallest hashes of texts with a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(BUCKETS, np.int64), 0
        least: dict[str, set[int]] = {}
        bound: dict[str, int] = {}
        size = 0

        def out(buckets, n, langs, hashes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(buckets, pa.int32()), pa.array(n, pa.int64()), pa.array(langs, pa.string()), pa.array(hashes, pa.int64())],
                ["bucket", "n", "lang", "h"])

        def held() -> pa.RecordBatch:
            pairs = [(lang, h) for lang, some in least.items() for h in sorted(some)[:sample]]
            return out([None] * len(pairs), [None] * len(pairs), [p[0] for p in pairs], [p[1] for p in pairs])

        for batch in batches:
            for text, lang, h in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                counts = gram_counts(text)
                if counts is None:
                    continue
                df += counts > 0
                rows += 1
                some = least.setdefault(lang, set())
                if h in some or (lang in bound and h > bound[lang]):
                    continue
                some.add(h)
                size += 1
                if len(some) >= 2 * sample:
                    least[lang] = set(sorted(some)[:sample])
                    bound[lang] = max(least[lang])
                    size += len(least[lang]) - len(some)
                if size >= HELD_HASHES:
                    yield held()
                    least, size = {}, 0
        at = np.flatnonzero(df)
        n = np.append(df[at], rows)
        yield out(np.append(at, BUCKETS), n, [None] * len(n), [None] * len(n))
        if least:
            yield held()

    return run


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids of length one, and each row's place. Starts from the row
    nearest to the mean, then the rows farthest from those taken; no random numbers."""
    start = [int(np.argmax(x @ x.mean(0)))]
    near = x @ x[start[0]]
    while len(start) < min(k, len(x)):
        start.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[start[-1]])
    c = x[start].copy()
    for _ in range(rounds):
        place = np.argmax(x @ c.T, 1)
        for j in range(len(c)):
            if (place == j).any():
                m = x[place == j].sum(0)
                c[j] = m / max(np.sqrt(m @ m), 1e-12)
    return c, np.argmax(x @ c.T, 1)


class Model(NamedTuple):
    """What was learned: idf, and a stored table of the centroids of every language (lang, j, c, radius). By the
    name of ``centroids`` or ``radius`` it gives those of all languages as one array, to look at a small model."""

    idf: np.ndarray
    centroids: DataFrame

    def __getitem__(self, key):
        if not isinstance(key, str):
            return tuple.__getitem__(self, key)
        column = {"centroids": "c", "radius": "radius"}[key]
        return np.array([r[column] for r in self.centroids.orderBy("lang", "j").collect()])


def train(rows: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS) -> Model:
    """Fit on rows (text, lang), nulls left out. Returns idf, and a stored table of the centroids of
    every language (lang, j, c, radius)."""
    rows = rows.filter("text is not null and lang is not null").select("text", "lang")
    hashed = rows.select("text", "lang", F.xxhash64("text").alias("h"))
    passed = written(hashed.mapInArrow(_frequencies(sample_per_language), "bucket int, n long, lang string, h long"), "frequencies")
    found = passed.filter("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(BUCKETS + 1), 0
    for b, n in found:
        df[b] = n
    total = df[BUCKETS]
    idf = np.log((1 + total) / (1 + df[:BUCKETS])) + 1
    # The smallest hashes of each language. Those of copies are equal and count once; at most the
    # wanted number of each language leaves a partition, and then each of its parts.
    distinct = passed.filter("bucket is null").select("lang", "h").distinct().withColumn("part", F.pmod(F.xxhash64("h"), F.lit(SPREAD)))
    few = top_per_group(distinct, ["lang", "part"], [F.col("h")], sample_per_language, "place").drop("place")
    picked = written(top_per_group(few, ["lang"], [F.col("h")], sample_per_language, "place").select("lang", "h"), "picked")
    drawn = hashed.join(broadcast_if_small(picked), ["lang", "h"]).select("lang", "h", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            out = []
            for lang, h, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                counts = gram_counts(text) if (lang, h) not in seen else None
                if counts is not None:
                    seen.add((lang, h))
                    some = np.flatnonzero(counts)
                    out.append((lang, h, some.tolist(), counts[some].tolist()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out]), pa.array([o[1] for o in out], pa.int64()),
                     pa.array([o[2] for o in out], pa.list_(pa.int32())), pa.array([o[3] for o in out], pa.list_(pa.int64()))],
                    ["lang", "h", "at", "n"])

    sample = drawn.mapInArrow(vectors, "lang string, h long, at array<int>, n array<bigint>").dropDuplicates(["lang", "h"])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("h", kind="stable").head(sample_per_language)
        x = np.zeros((len(group), BUCKETS), np.float32)
        for i, (at, n) in enumerate(zip(group["at"], group["n"])):
            counts = np.zeros(BUCKETS, np.int64)
            counts[at] = n
            x[i] = _vector(counts, idf)
        c, place = kmeans(x, centroids)
        far = 1 - (x * c[place]).sum(1)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "j": range(len(c)), "c": [v.tolist() for v in c],
                             "radius": [float(far[place == j].max(initial=0)) for j in range(len(c))]})

    return Model(idf, written(sample.groupBy("lang").applyInPandas(fit, "lang string, j int, c array<float>, radius double"), "centroids"))


def _nearest(idf: np.ndarray, rows: list):
    """Rows with the nearest of some centroids: cosine, language, radius; null without a letter."""
    table = np.array([r.c for r in rows], np.float32).reshape(len(rows), BUCKETS)
    langs, radius = [r.lang for r in rows], [r.radius for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: list[tuple] = []
            for text in batch.column("text").to_pylist():
                counts = gram_counts(text) if text and langs else None
                if counts is None:
                    best.append((None, None, None))
                    continue
                cos = table @ _vector(counts, idf)
                j = int(np.argmax(cos))
                best.append((float(min(1.0, max(0.0, cos[j]))), langs[j], radius[j]))
            score, lang, far = zip(*best) if best else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "row_id")], pa.array(score, pa.float64()), pa.array(lang, pa.string()), pa.array(far, pa.float64())],
                ["doc_id", "row_id", "score", "lang", "radius"])

    return run


def predict(docs: DataFrame, idf: np.ndarray, centroids: DataFrame, at_once: int = LANGUAGES_AT_ONCE) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of ``docs`` (doc_id, text; no other
    column is read). ``und`` with score 0 if the text is null, empty or has no letter, or if
    nothing was learned. ``rejected``: farther from its centroid than MARGIN times the farthest
    training text. Ties go to the language first in the alphabet.

    Tasks get the centroids of ``at_once`` languages; where there are more, each block of languages is
    scored by itself and a row takes the best of its blocks.
    """
    names = centroids.select("lang").distinct()
    n = names.count()
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row_id long, score double, lang string, radius double"
    if n <= at_once:
        rows = centroids.orderBy("lang", "j").collect()  # bounded by at_once
        best = docs.withColumn("row_id", F.lit(0).cast("long")).mapInArrow(_nearest(idf, rows), schema)
    else:
        numbered = written(number_rows(names, "lang", "no"), "languages")
        blocks = written(centroids.join(broadcast_if_small(numbered), "lang"), "blocks")
        stored = written(docs.withColumn("row_id", F.monotonically_increasing_id()), "texts")
        each = []
        for first in range(0, n, at_once):
            rows = blocks.filter(F.col("no").between(first, first + at_once - 1)).orderBy("lang", "j").collect()
            each.append(written(stored.mapInArrow(_nearest(idf, rows), schema), "scored"))
        every = each[0]
        for more in each[1:]:
            every = every.unionByName(more)
        # equal scores: the first language; null scores are those of every block
        order = F.struct((-F.col("score")).alias("s"), "lang", "radius")
        best = every.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.min(F.when(F.col("score").isNotNull(), order)).alias("b")).select(
            "doc_id", "row_id", (-F.col("b.s")).alias("score"), "b.lang", "b.radius")
    return best.select(
        "doc_id", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce(1 - F.col("score") > MARGIN * F.col("radius"), F.lit(True)).alias("rejected"))


def held_out() -> Column:
    """crc32 of the id as text leaves 1 when divided by 3; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows of ``docs`` (doc_id, text, lang) that are not held out, predict all.

    Returns doc_id, held_out, lang_pred, score, rejected. Null lang: not learned from. Repeated
    rows are predicted each. An empty table gives no rows.
    """
    idf, centroids = train(docs.filter(~held_out()).select("text", "lang"))
    return predict(docs, idf, centroids).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
