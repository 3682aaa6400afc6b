"""Greedy removal of near-duplicates in a given order, exact at any group size.

The rule: walk the rows of a group in order and keep one unless its Jaccard similarity with
a row already kept exceeds the threshold. It is evaluated without forming the pairs of a
group:

1. Rows with equal word sets are one set; all but its first row go. (Empty sets have
   similarity 0 with everything and all stay.)
2. Two different sets above threshold t differ in less than (1-t)/(1+t) * (|A|+|B|) words.
   Words are hashed into one part more than that bound, so at least one part must agree in
   full (Arasu, Ganti, Kaushik, VLDB 2006). A block is a part with its content; only rows
   of a common block can be duplicates. At t = 0.95 a part holds some 17 words, so
   blocks of unrelated rows are rare.
3. Rows that share blocks hang together in components, and a row depends on those of its component
   alone. Only now are texts cut into words, those of these rows. A component of up to some
   thousand rows is walked in one task as the rule is told: a row's words are counted in those of
   the rows kept before it, so copies cost one comparison with each kept row.
4. In larger components rounds thin the blocks out: a row that comes first in all its
   blocks has no earlier rival left, so it is kept, and the rows of its blocks are compared
   with it alone and dropped if they exceed the threshold. A block of a million copies
   costs a million comparisons, not their square.
5. A block that hardly shrinks holds texts that are alike without being duplicates, such as
   filled-in templates. It is split by the rarest words of its rows: of the d + l rarest words
   of a set that can miss d, a duplicate has l at least (Wang, Li, Feng, SIGMOD 2012), so
   blocks of rows that also share one, two, three of them still hold every duplicate pair, and
   words of the template are never among them.
6. Blocks of few rows that rounds leave are compared in full, a fixed multiple of their rows. The duplicates
   found are a graph; the order rule is settled by a walk through each of its components, large
   ones in rounds: a row without an earlier undecided duplicate is kept and drops its later ones.

Sets are equal, and parts agree, if the 64-bit hashes of their words do; similarities are
counted on the words themselves.

Groups of few rows, such as the candidates of a question, need none of this: each is walked
as one sorted array.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgrid.functions.text import exceeds_jaccard, safe_ratio, token_set
from askgrid.functions.words import distinct_word_hashes, mix
from askgrid.operators.components import components
from askgrid.operators.sizing import (
    BLOCK_BYTES, blocks, broadcast_if_small, fits_broadcast, join_hot_apart, spread,
)
from askgrid.session import cut_lineage, scratch_path

# Fixed value: similarity that must be exceeded.
THRESHOLD = 0.95
# Rows of a block up to which its rows are compared with one another.
FEW_ROWS = 64
# Rare words a block may be split by, and the blocks a row may get from one block on the way.
RARE_WORDS = 3
SPLIT_BLOCKS = 512
# A group is walked as one array up to this many rows and bytes of text.
WALK_ROWS = 256
WALK_BYTES = 32 << 20
# Duplicate pairs, or links of rows that share a block, one task walks through.
WALK_PAIRS = 100_000
# Rows that hang together by blocks are walked in one task up to this many rows and words.
COMPONENT_ROWS = 4096
COMPONENT_WORDS = 4_000_000
# Words of such rows a task takes.
TASK_WORDS = 1_000_000


def _comparable(n: Column, threshold: float) -> Column:
    """Two different sets exceed t only if each has more than t / (1 - t) words."""
    t = Fraction(str(threshold))
    return n * F.lit(t.denominator - t.numerator) > F.lit(t.numerator)


class Signed(NamedTuple):
    """Size, fingerprint and blocks of the word sets of items; ``sets`` are the word sets of all of them
    where items come more than once, else None."""

    signatures: DataFrame
    sets: DataFrame | None


def word_sets(items: DataFrame) -> DataFrame:
    """The word set of each item (item_id, words), cut once and written as a table in the shared folder, from
    which every later step reads the items it needs."""
    path = scratch_path(items.sparkSession, "words")
    spread(items.select("item_id", "text")).select("item_id", token_set("text").alias("words")).write.parquet(path)
    return items.sparkSession.read.parquet(path)


def _signatures(threshold: float):
    """Signatures of batches of lower-cased texts (item_id, n, p1, p2, blocks): for both levels of a set the
    hashes of its words are dealt into parts, and a block is a part with their sum and number."""
    base, t = math.log(1 / float(threshold)), float(threshold)
    limit = Fraction(str(threshold))

    def blocks_of(hashes: np.ndarray, mixed: np.ndarray, n: np.ndarray) -> pa.Array:
        row = np.repeat(np.arange(len(n)), n)
        used = n * (limit.denominator - limit.numerator) > limit.numerator
        level = np.floor(np.log(np.maximum(n, 1)) / base).astype(np.int64)
        mine = used[row]
        h, m, r = hashes[mine], mixed[mine], row[mine]
        sizes, found = np.zeros(len(n), np.int64), []
        for at in (level, level - 1):
            parts = np.where(used, np.floor(2 * (1 - t) / (1 + t) * (np.ceil((1 / t) ** (at + 2.0)) + 1)) + 2, 0).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(parts)])
            part = first[r] + (h % parts[r].astype(np.uint64)).astype(np.int64)
            total, count = np.zeros(first[-1], np.uint64), np.bincount(part, minlength=first[-1])
            np.add.at(total, part, m)
            owner = np.repeat(np.arange(len(n)), parts)
            number = np.arange(first[-1]) - first[owner]
            name = mix(total ^ mix(count.astype(np.uint64) ^ mix((at[owner] * (1 << 32) + number).astype(np.uint64))))
            found.append((owner, name))
            sizes += parts
        owner = np.concatenate([f[0] for f in found])
        name = np.concatenate([f[1] for f in found])[np.argsort(owner, kind="stable")].view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(name))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy(zero_copy_only=False)
            for a, b in blocks(lengths.astype(np.int64), BLOCK_BYTES):
                batch = whole.slice(a, b - a)
                hashes, begins = distinct_word_hashes(batch.column("text"))
                mixed, n = mix(hashes), np.diff(begins)
                # 128 bits of a set: two sums over its words
                prints = []
                for words in (mixed, mix(mixed ^ np.uint64(0xD6E8FEB86659FD93))):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words, dtype=np.uint64)])
                    prints.append(pa.array((sums[begins[1:]] - sums[begins[:-1]]).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id"), pa.array(n, pa.int64()), *prints, blocks_of(hashes, mixed, n)],
                    ["item_id", "n", "p1", "p2", "blocks"])

    return signed


def _parts(level: Column, threshold: float) -> Column:
    """Number of parts at a size level: one more than the largest number of words in
    which two similar sets of this level and the next can differ."""
    t = float(threshold)
    largest = F.ceil(F.pow(F.lit(1 / t), level + 2)) + 1
    return (F.floor(2 * (1 - t) / (1 + t) * largest) + 2).cast("int")


def _signatures_of_repeated(sets: DataFrame, threshold: float) -> DataFrame:
    """As signatures, where items come more than once: the rows of an item make its blocks together."""
    base = math.log(1 / float(threshold))
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(base)).cast("int")
    sets = (
        sets.repartition("item_id")
        .select("item_id", F.coalesce("words", F.array().cast("array<string>")).alias("words"))
        .select("item_id", "words", F.size("words").cast("long").alias("n"),
                F.sha2(F.array_join("words", " "), 256).alias("sha"))
        # 120 bits of the digest as two numbers, which aggregates can keep in place
        .select("item_id", "words", "n", *[
            F.conv(F.substring("sha", at, 15), 16, 10).cast("long").alias(name)
            for name, at in (("p1", 1), ("p2", 16))
        ])
    )
    words = (
        sets.select("item_id", "n", "p1", "p2",
                    F.explode_outer(F.when(_comparable(F.col("n"), threshold), F.col("words"))).alias("word"))
        .select("*", F.explode(F.array(level, level - 1)).alias("level"))
        .withColumn("parts", F.when(F.col("word").isNotNull(), _parts(F.col("level"), threshold)))
    )
    facts = [F.first(c).alias(c) for c in ("n", "p1", "p2")]
    by_part = words.groupBy(
        "item_id", "level", "parts", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part")
    ).agg(F.bit_xor(F.xxhash64("word", F.lit("#"))).alias("h"), F.count("word").alias("c"), *facts)
    by_level = by_part.groupBy("item_id", "level", "parts").agg(
        F.collect_list(F.xxhash64("level", "part", "h", "c")).alias("b"), F.collect_list("part").alias("used"), *facts)
    # a part without words is a block as well
    bare = F.array_except(F.sequence(F.lit(0), F.col("parts") - 1), F.col("used"))
    bare = F.transform(bare, lambda part: F.xxhash64(F.col("level"), part, F.lit(0)))
    none = F.array().cast("array<bigint>")
    return (
        by_level.select("item_id", "n", "p1", "p2", F.when(
            F.col("parts").isNotNull(), F.concat("b", bare)).otherwise(none).alias("b"))
        .groupBy("item_id").agg(*facts, F.flatten(F.collect_list("b")).alias("blocks"))
        .select("item_id", "n", F.struct("p1", "p2").alias("print"), "blocks")
    )


def sign(items: DataFrame, threshold: float = THRESHOLD) -> Signed:
    """Size, fingerprint and blocks of the word set of each item (item_id, n, print, blocks).

    One pass over the texts, whose words are cut and hashed in place; only the signatures are written. A set
    belongs to the level of its size and is compared within that level and with the next ones, hence it has
    blocks of two levels.
    """
    spark = items.sparkSession
    texts = spread(items.select("item_id", F.lower("text").alias("text")))
    long = T.LongType()
    schema = T.StructType([texts.schema["item_id"], *[T.StructField(c, long) for c in ("n", "p1", "p2")],
                           T.StructField("blocks", T.ArrayType(long))])
    path = scratch_path(spark, "signatures")
    texts.mapInArrow(_signatures(threshold), schema).select(
        "item_id", "n", F.struct("p1", "p2").alias("print"), "blocks").write.parquet(path)
    signed = spark.read.schema(T.StructType([
        texts.schema["item_id"], T.StructField("n", long),
        T.StructField("print", T.StructType([T.StructField("p1", long), T.StructField("p2", long)])),
        T.StructField("blocks", T.ArrayType(long))])).parquet(path)
    if signed.groupBy("item_id").agg(F.count("*").alias("rows")).filter("rows > 1").isEmpty():
        return Signed(signed, None)
    sets = word_sets(items)
    return Signed(cut_lineage(_signatures_of_repeated(sets, threshold)), sets)


def _compare(pairs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """Pairs (.., item_id, pivot_item) whose word sets exceed the threshold. Words are read
    for the items in question only."""
    uses = pairs.groupBy(F.col("pivot_item").alias("item_id")).agg(F.count("*").alias("_uses"))
    wanted = cut_lineage(
        pairs.select("item_id", F.lit(0).cast("long").alias("_uses")).unionByName(uses)
        .groupBy("item_id").agg(F.sum("_uses").alias("_uses"))
    )
    total = wanted.agg(F.coalesce(F.sum("_uses"), F.lit(0))).first()[0]
    sets = cut_lineage(
        items.join(broadcast_if_small(wanted), "item_id").select("item_id", "_uses", "words")
    )
    pivots = sets.filter("_uses > 0").select(
        F.col("item_id").alias("pivot_item"), F.col("words").alias("pivot_words"), "_uses")
    both = join_hot_apart(pairs.join(sets.select("item_id", "words"), "item_id"), pivots, ["pivot_item"], "_uses", total)
    t = Fraction(str(threshold))
    n, pivot_n = F.size("words"), F.size("pivot_words")
    return (
        both.filter(F.least(n, pivot_n) * F.lit(t.denominator) > F.greatest(n, pivot_n) * F.lit(t.numerator))
        .withColumn("common", F.size(F.array_intersect("words", "pivot_words")))
        .filter(exceeds_jaccard(F.col("common"), n, pivot_n, threshold))
        .withColumn("similarity", F.round(safe_ratio("common", n + pivot_n - F.col("common")), 6))
        .drop("words", "pivot_words", "common", "_uses")
    )



def _differences(n: Column, threshold: float) -> Column:
    """Words of a set of n that one above the threshold may lack."""
    t = Fraction(str(threshold))
    return F.floor(n * F.lit(t.denominator - t.numerator) / F.lit(t.denominator)).cast("int")


def _any_null(columns: Sequence[str]) -> Column:
    null = F.lit(False)
    for c in columns:
        null = null | F.col(c).isNull()
    return null


def _walk_groups(rows: DataFrame, items: DataFrame, groups: list[str], order: str, threshold: float) -> DataFrame:
    """The rule as it is told, for groups of few rows: each is one sorted array."""
    t = Fraction(str(threshold))
    sets = items.select("item_id", F.coalesce(token_set("text"), F.array().cast("array<string>")).alias("_words"))
    whole = F.struct(F.col(order).alias("o"), F.struct(*[F.col(f"r.{c}") for c in rows.columns]).alias("row"),
                     F.col("r.item_id").alias("item"), F.col("_words").alias("words"))
    listed = (
        rows.select(F.struct(*rows.columns).alias("r"), *groups, order, "item_id")
        .join(broadcast_if_small(sets), "item_id", "left")
        .groupBy(*groups).agg(F.array_sort(F.collect_list(whole), lambda a, b: (
            F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))).alias("list"))
    )
    none = F.array().cast("array<string>")

    def alike(kept: Column, x: Column) -> Column:
        n, m = F.size(x["words"]), F.size(kept["words"])
        common = F.size(F.array_intersect(kept["words"], x["words"]))
        near = F.least(n, m) * F.lit(t.denominator) > F.greatest(n, m) * F.lit(t.numerator)
        return F.when(kept["item"] == x["item"], True).when(near, exceeds_jaccard(common, n, m, threshold)).otherwise(False)

    def step(kept: Column, x: Column) -> Column:
        lost = (F.size(x["words"]) > 0) & F.exists(kept, lambda k: (F.size(k["words"]) > 0) & alike(k, x))
        return F.when(lost, kept).otherwise(F.concat(kept, F.array(x)))

    entry = listed.schema["list"].dataType.simpleString()
    listed = listed.withColumn("list", F.transform("list", lambda x: x.withField("words", F.coalesce(x["words"], none))))
    first = F.aggregate("list", F.array().cast(entry), step)
    marked = listed.select("list", F.transform(first, lambda k: k["o"]).alias("stay"))
    return marked.select("stay", F.explode("list").alias("x")).select(
        "x.row.*", F.array_contains("stay", F.col("x.o")).alias("kept"))


def greedy_dedup(rows: DataFrame, items: DataFrame, groups: Sequence[str], order: str,
                 threshold: float = THRESHOLD, signed: Signed | None = None) -> DataFrame:
    """Add ``kept`` to rows (groups, order, item_id); items hold (item_id, text).

    ``order`` is a number or string distinct within its group. Items may occur in many
    groups and several times in one; their words are hashed once. ``signed`` are the
    signatures of the items, where they exist already.
    """
    groups = list(groups)
    counts = cut_lineage(rows.groupBy(*groups).agg(F.count("*").alias("_rows")))
    least, most, unnamed = counts.agg(F.min("_rows"), F.max("_rows"), F.max(_any_null(groups))).first()
    if unnamed:  # a struct holds null like any other value
        return greedy_dedup(rows.withColumn("_group", F.struct(*groups)), items, ["_group"], order, threshold, signed).drop("_group")
    if most is None or least > WALK_ROWS:
        return _dedup_large(rows, items, groups, order, threshold, signed)
    longest = items.agg(F.max(F.octet_length("text"))).first()[0] or 1
    limit = min(WALK_ROWS, WALK_BYTES // longest)
    if most <= limit:
        return _walk_groups(rows, items, groups, order, threshold)
    if least > limit:
        return _dedup_large(rows, items, groups, order, threshold, signed)
    few = cut_lineage(counts.filter(F.col("_rows") <= limit).select(*[F.col(g).alias(f"_g_{g}") for g in groups]))
    same = F.lit(True)
    for g in groups:
        same = same & rows[g].eqNullSafe(few[f"_g_{g}"])
    few = broadcast_if_small(few)
    return _walk_groups(rows.join(few, same, "left_semi"), items, groups, order, threshold).unionByName(
        _dedup_large(rows.join(few, same, "left_anti"), items, groups, order, threshold, signed))


def _dedup_large(rows: DataFrame, items: DataFrame, groups: list[str], order: str, threshold: float,
                 signed: Signed | None) -> DataFrame:
    """As greedy_dedup, for groups of any size."""
    signed = signed or sign(items, threshold)
    return _mark(rows, _decide(rows, items, groups, order, threshold, signed), groups, order)


class Decided(NamedTuple):
    """Rows in place (groups, ord, item_id, n, print), the first row of every distinct set, and of these the
    ones dropped: in components walked whole, with the kept row each one meets first (groups, ord, print,
    kept_item, similarity), and in the others (groups, ord), where ``sets`` has the words of their items."""

    placed: DataFrame
    firsts: DataFrame
    walked: DataFrame | None
    dropped: list[DataFrame]
    sets: DataFrame | None


def _decide(rows: DataFrame, items: DataFrame, groups: list[str], order: str, threshold: float, signed: Signed) -> Decided:
    placed = cut_lineage(
        rows.select(*groups, F.col(order).alias("ord"), "item_id")
        .join(signed.signatures.select("item_id", "n", "print"), "item_id", "left")
        .withColumn("n", F.coalesce("n", F.lit(0).cast("long")))  # an item that is missing is an empty one
    )
    # first row of every distinct set in a group
    firsts = cut_lineage(placed.filter(F.col("n") > 0).groupBy(*groups, "print").agg(
        F.min("ord").alias("ord"), F.min_by("item_id", "ord").alias("item_id"), F.min("n").alias("n")))
    rivals = firsts.filter(_comparable(F.col("n"), threshold))
    if signed.sets is not None:
        return Decided(placed, firsts, None, _drop_by_blocks(rivals, signed.signatures, signed.sets, groups, threshold, 0), signed.sets)
    near = _components_of(rivals, signed.signatures, groups)
    if near is None:
        return Decided(placed, firsts, None, [], None)
    sizes = near.groupBy("root").agg(F.count("*").alias("_rows"), F.sum("n").alias("_words"))
    large = cut_lineage(sizes.filter((F.col("_rows") > COMPONENT_ROWS) | (F.col("_words") > COMPONENT_WORDS)).select("root"))
    if large.isEmpty():
        return Decided(placed, firsts, _walk_near(near, items, groups, threshold), [], None)
    large = broadcast_if_small(large)
    walked = _walk_near(near.join(large, "root", "left_anti"), items, groups, threshold)
    rest = cut_lineage(near.join(large, "root", "left_semi").drop("root"))
    sets = word_sets(items.join(broadcast_if_small(rest.select("item_id").distinct()), "item_id", "left_semi"))
    return Decided(placed, firsts, walked, _drop_by_blocks(rest, signed.signatures, sets, groups, threshold, 1), sets)


def _mark(rows: DataFrame, decided: Decided, groups: list[str], order: str) -> DataFrame:
    winners = decided.firsts.select(*groups, "ord")
    dropped = [] if decided.walked is None else [decided.walked.select(*groups, "ord")]
    for gone in dropped + decided.dropped:
        winners = winners.join(gone, [*groups, "ord"], "left_anti")
    winners = winners.unionByName(decided.placed.filter(F.col("n") == 0).select(*groups, "ord"))
    marked = winners.withColumn("_kept", F.lit(True))
    return (
        rows.join(marked.withColumnRenamed("ord", order), [*groups, order], "left")
        .withColumn("kept", F.coalesce("_kept", F.lit(False))).drop("_kept")
    )


def _components_of(rivals: DataFrame, signatures: DataFrame, groups: list[str]) -> DataFrame | None:
    """The rows that share a block with another one, and the component each belongs to (root, then the columns
    of rivals); None if there are none. Rows and blocks are named by hashes here: where two fall
    together, more rows are looked at together, which changes nothing."""
    node = F.xxhash64(*groups, "ord")
    listed = cut_lineage(rivals.join(signatures.select("item_id", "blocks"), "item_id").select(
        node.alias("node"), F.transform("blocks", lambda b: F.xxhash64(*groups, b)).alias("blocks")))
    named = listed.select("node", F.explode("blocks").alias("block"))
    shared = cut_lineage(named.groupBy("block").agg(F.count("*").alias("_rows"), F.min("node").alias("low")).filter(F.col("_rows") > 1))
    total = shared.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    if not total:
        return None
    # a row that is the lowest of its block is linked to itself
    links = cut_lineage(_join_blocks(named, shared, ["block"], total).select("low", "node").distinct())
    between = links.filter("low <> node").select(F.col("low").alias("a"), F.col("node").alias("b"))
    if between.count() <= WALK_PAIRS:
        roots = between.groupBy(F.lit(0).alias("task")).applyInArrow(_walk_links, "node long, root long")
    else:
        roots = components(between)
    roots = cut_lineage(links.select("node").distinct().join(roots, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")))
    return cut_lineage(rivals.withColumn("node", node).join(broadcast_if_small(roots), "node").drop("node"))


def _walk_links(links: pa.Table) -> pa.Table:
    """Components of few links: every node and the smallest one it hangs together with."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for a, b in zip(links.column("a").to_pylist(), links.column("b").to_pylist()):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    nodes = list(root)
    return pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array([find(x) for x in nodes], pa.int64())})


def _walk_near(near: DataFrame, items: DataFrame, groups: list[str], threshold: float) -> DataFrame:
    """The rows dropped in components (root, groups, print, ord, item_id, n), each walked in one task, with
    the first kept row they duplicate (groups, ord, print, kept_item, similarity)."""
    words = near.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(near.sparkSession.sparkContext.defaultParallelism, words // TASK_WORDS)
    rows = near.select("root", *groups, "ord", "print", "item_id")
    cut = items.join(broadcast_if_small(rows), "item_id").select(
        "root", *groups, "ord", "print.p1", "print.p2", "item_id", token_set("text").alias("words"))
    schema = T.StructType([*[cut.schema[c] for c in (*groups, "ord", "p1", "p2")], T.StructField("kept_item", cut.schema["item_id"].dataType),
                           T.StructField("common", T.LongType()), T.StructField("either", T.LongType())])
    walked = cut.groupBy(F.pmod(F.xxhash64("root"), F.lit(tasks)).alias("task")).applyInArrow(_walk_components(groups, threshold), schema)
    return cut_lineage(walked.select(*groups, "ord", F.struct("p1", "p2").alias("print"), "kept_item",
                                     F.round(safe_ratio("common", "either"), 6).alias("similarity")))


def _walk_components(groups: list[str], threshold: float):
    """The rule as it is told, for all components of a task: in order, a row's words are counted in
    those of all rows kept before it."""
    t = Fraction(str(threshold))

    def walk(rows: pa.Table) -> pa.Table:
        keys = list(zip(rows.column("root").to_pylist(), map(repr, zip(*[rows.column(g).to_pylist() for g in groups]))))
        order = [(o is not None, o) for o in rows.column("ord").to_pylist()]
        lists = rows.column("words").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        coded = pc.dictionary_encode(lists.flatten())
        codes = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
        mine = np.zeros(len(coded.dictionary), np.uint8)
        gone, partner, both, either = [], [], [], []
        last = None
        for i in sorted(range(rows.num_rows), key=lambda i: (keys[i], order[i])):
            if keys[i] != last:
                last, kept, begins, sizes, held = keys[i], [], [], [], np.empty(1 << 10, codes.dtype)
                used = 0
            words = codes[ends[i]:ends[i + 1]]
            if kept:
                mine[words] = 1
                common = np.add.reduceat(mine[held[:used]], begins, dtype=np.int64)
                mine[words] = 0
                union = np.array(sizes) + len(words) - common
                near = common * t.denominator > union * t.numerator
                k = int(near.argmax())
                if near[k]:
                    gone.append(i)
                    partner.append(kept[k])
                    both.append(int(common[k]))
                    either.append(int(union[k]))
                    continue
            if used + len(words) > len(held):
                held = np.concatenate([held[:used], np.empty(used + len(words), codes.dtype)])
            held[used:used + len(words)] = words
            kept.append(i)
            begins.append(used)
            sizes.append(len(words))
            used += len(words)
        found = rows.select([*groups, "ord", "p1", "p2"]).take(pa.array(gone, pa.int64()))
        return (found.append_column("kept_item", rows.column("item_id").take(pa.array(partner, pa.int64())))
                .append_column("common", pa.array(both, pa.int64())).append_column("either", pa.array(either, pa.int64())))

    return walk


def _drop_by_blocks(rivals: DataFrame, signatures: DataFrame, items: DataFrame, groups: list[str], threshold: float,
                    least: int) -> list[DataFrame]:
    """Tables of rows (groups, ord) dropped, found in blocks of any size; items hold word sets."""
    keys = [*groups, "block"]
    blocks = rivals.join(signatures.select("item_id", "blocks"), "item_id").select(
        *groups, "ord", "item_id", "n", F.explode("blocks").alias("block")).persist(StorageLevel.MEMORY_AND_DISK)
    shared = cut_lineage(blocks.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > 1))
    total = shared.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    dropped = []
    if total:
        undecided = cut_lineage(_join_blocks(blocks, shared, keys, total).select(
            *keys, "ord", "item_id", "n", F.col("block").alias("base"), F.array().cast("array<bigint>").alias("used")))
        dropped, undecided = _thin_out(undecided, items, groups, threshold, least)
        if undecided is not None:
            dropped += _settle(_duplicates(undecided, items, groups, threshold), groups)
    blocks.unpersist()
    return dropped


def _join_blocks(rows: DataFrame, blocks: DataFrame, keys: list[str], total: int) -> DataFrame:
    if fits_broadcast(blocks):
        return rows.join(F.broadcast(blocks), keys)
    return join_hot_apart(rows, blocks, keys, "_rows", total)


def _rarest(items: DataFrame, wanted: DataFrame, threshold: float) -> DataFrame:
    """The hashes of the rarest words of the wanted items, rarest first, as many as splits may need
    (item_id, d, rare). Rarity is counted among these items."""
    words = cut_lineage(items.join(broadcast_if_small(wanted), "item_id", "left_semi").select(
        "item_id", F.explode("words").alias("word")))
    counts = cut_lineage(words.groupBy("word").agg(F.count("*").alias("df")))
    listed = words.join(counts, "word").groupBy("item_id").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("df", F.xxhash64("word").alias("w")))).alias("r"))
    d = _differences(F.col("n"), threshold)
    return cut_lineage(listed.select("item_id", d.alias("d"), F.slice("r.w", F.lit(1), d + RARE_WORDS).alias("rare")))


def _split(rows: DataFrame, items: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """Rows of blocks, dealt into smaller blocks by one rare word more."""
    rare = _rarest(items, rows.select("item_id").distinct(), threshold)
    level = F.size("used") + 1
    more = F.array_except(F.slice("rare", F.lit(1), F.col("d") + level), F.col("used"))
    columns = [c for c in rows.columns if c not in ("block", "used")]
    return (
        rows.join(rare, "item_id")
        .select(*columns, F.col("used").alias("u"), F.explode(more).alias("w"))
        .select(*columns, F.array_sort(F.concat("u", F.array("w"))).alias("used"))
        .withColumn("block", F.xxhash64("base", "used")).dropDuplicates([*keys, "ord"])
    )


def _splittable(n: Column, used: Column, threshold: float) -> Column:
    """A block of sets of n words may be split by one word more."""
    level = F.size(used)
    return (level < RARE_WORDS) & ((level == 0) | (F.pow(_differences(n, threshold) + 1, level + 1) <= SPLIT_BLOCKS))


def _thin_out(undecided: DataFrame, items: DataFrame, groups: list[str], threshold: float,
              least: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Decide rows in rounds, in ``least`` of them at least and until every block has few: the dropped
    rows (groups, ord) and the rows (groups, block, ord, item_id) of the blocks left, None if there are none."""
    dropped, last = [], None
    keys = [*groups, "block"]
    rest = ["ord", "item_id", "n", "base", "used"]
    while True:
        firsts = undecided.groupBy(*keys).agg(
            F.min("ord").alias("first"), F.min_by("item_id", "ord").alias("pivot_item"),
            F.count("*").alias("_rows"), F.max("n").alias("_n"), F.first("used").alias("_used"),
        ).filter(F.col("_rows") > 1)
        seen = firsts.join(last, keys, "left") if last is not None else firsts.withColumn("_last", F.lit(None).cast("long"))
        # a block that was thinned out and has more than half its rows left is split
        stuck = (F.col("_rows") > FEW_ROWS) & (F.col("_rows") * 2 > F.col("_last")) & _splittable(F.col("_n"), F.col("_used"), threshold)
        firsts = cut_lineage(seen.withColumn("_stuck", F.coalesce(stuck, F.lit(False))).drop("_last", "_n", "_used"))
        total, largest, any_stuck = firsts.agg(
            F.coalesce(F.sum("_rows"), F.lit(0)), F.max("_rows"), F.max("_stuck")).first()
        if total == 0:
            return dropped, None
        # blocks with one row left decide nothing and leave the table here
        live = _join_blocks(undecided, firsts, keys, total)
        if largest <= FEW_ROWS and len(dropped) >= least:
            return dropped, live.select(*keys, "ord", "item_id")
        live = cut_lineage(live)
        last = firsts.select(*keys, F.col("_rows").alias("_last"))
        if any_stuck:
            parts = _split(live.filter("_stuck").select(*keys, *rest), items, threshold, keys)
            undecided = cut_lineage(live.filter(~F.col("_stuck")).select(*keys, *rest).unionByName(parts.select(*keys, *rest)))
            continue
        leads = cut_lineage(
            live.groupBy(*groups, "ord").agg(F.bool_and(F.col("ord") == F.col("first")).alias("lead"))
            .filter("lead").select(*groups, F.col("ord").alias("first"))
        )
        # rows behind a kept row in some block, each pair once
        behind = (
            live.join(broadcast_if_small(leads), [*groups, "first"], "left_semi")
            .filter(F.col("ord") > F.col("first"))
            .select(*groups, "ord", "item_id", "pivot_item").distinct()
        )
        gone = cut_lineage(_compare(cut_lineage(behind), items, threshold).select(*groups, "ord").distinct())
        dropped.append(gone)
        decided = gone.unionByName(leads.withColumnRenamed("first", "ord"))
        undecided = cut_lineage(
            live.select(*keys, *rest)
            .join(broadcast_if_small(decided), [*groups, "ord"], "left_anti")
        )


def _duplicates(rows: DataFrame, items: DataFrame, groups: list[str], threshold: float) -> DataFrame:
    """Pairs (groups, first, ord) above the threshold within blocks of few rows."""
    together = rows.groupBy(*groups, "block").agg(
        F.sort_array(F.collect_list(F.struct("ord", "item_id"))).alias("r"))
    pairs = (
        together.select(*groups, "r", F.posexplode("r").alias("i", "lead"))
        .select(*groups, "lead", F.explode(F.slice(
            F.col("r"), F.col("i") + 2, F.lit(FEW_ROWS))).alias("later"))
        .select(
            *groups, F.col("lead.ord").alias("first"), F.col("lead.item_id").alias("pivot_item"),
            F.col("later.ord").alias("ord"), F.col("later.item_id").alias("item_id"),
        ).distinct()
    )
    return _compare(cut_lineage(pairs), items, threshold).select(*groups, "first", "ord")


def _walk_pairs(groups: list[str]):
    """The order rule on all pairs of some components: in order, a row is dropped if a kept one comes first."""

    def walk(pairs: pa.Table) -> pa.Table:
        dropped = {}
        keys = list(map(repr, zip(*[pairs.column(g).to_pylist() for g in groups]))) or [""] * pairs.num_rows
        rows = zip(pairs.column("ord").to_pylist(), pairs.column("first").to_pylist(), keys, range(pairs.num_rows))
        for later, first, key, at in sorted(rows, key=lambda r: r[0]):
            if (key, first) not in dropped and (key, later) not in dropped:
                dropped[key, later] = at
        return pairs.select([*groups, "ord"]).take(pa.array(list(dropped.values()), pa.int64()))

    return walk


def _settle(pairs: DataFrame, groups: list[str]) -> list[DataFrame]:
    """Tables of rows (groups, ord) the order rule drops, from all duplicate pairs (groups, first, ord).

    A row depends on rows of its component alone, so components are walked apart. Node and
    component names are hashes: two that fall together are walked together, which changes nothing.
    """
    pairs = cut_lineage(pairs)
    n = pairs.count()
    if not n:
        return []
    schema = T.StructType([pairs.schema[c] for c in (*groups, "ord")])
    if n <= WALK_PAIRS:
        return [cut_lineage(pairs.groupBy(F.lit(0).alias("task")).applyInArrow(_walk_pairs(groups), schema))]
    named = pairs.withColumn("a", F.xxhash64(*groups, "first")).withColumn("b", F.xxhash64(*groups, "ord"))
    roots = cut_lineage(components(named.select("a", "b").filter("a <> b")).withColumnRenamed("node", "a"))
    named = cut_lineage(named.join(roots, "a", "left").withColumn("root", F.coalesce("root", "a")).drop("a", "b"))
    sizes = cut_lineage(named.groupBy("root").agg(F.count("*").alias("_pairs")))
    # components of few pairs share tasks
    tasks = max(named.sparkSession.sparkContext.defaultParallelism, n // WALK_PAIRS)
    small = named.join(sizes.filter(F.col("_pairs") <= WALK_PAIRS).select("root"), "root", "left_semi")
    walked = small.groupBy(F.pmod(F.xxhash64("root"), F.lit(tasks)).alias("task")).applyInArrow(_walk_pairs(groups), schema)
    large = named.join(broadcast_if_small(sizes.filter(F.col("_pairs") > WALK_PAIRS).select("root")), "root", "left_semi").drop("root")
    return [cut_lineage(walked), *_settle_in_rounds(large, groups)]


def _settle_in_rounds(pairs: DataFrame, groups: list[str]) -> list[DataFrame]:
    dropped = []
    pairs = cut_lineage(pairs)
    while not pairs.isEmpty():
        later = pairs.select(*groups, "ord").distinct()
        leads = pairs.join(later.withColumnRenamed("ord", "first"), [*groups, "first"], "left_anti")
        gone = cut_lineage(leads.select(*groups, "ord").distinct())
        dropped.append(gone)
        small = broadcast_if_small(gone)
        pairs = cut_lineage(
            pairs.join(small, [*groups, "ord"], "left_anti")
            .join(small.withColumnRenamed("ord", "first"), [*groups, "first"], "left_anti")
        )
    return dropped


def duplicate_pairs(rows: DataFrame, items: DataFrame, groups: Sequence[str], order: str,
                    threshold: float = THRESHOLD) -> DataFrame:
    """Every dropped row with the first kept row it duplicates and their similarity:
    (groups, dup_item, kept_item, similarity). One row per dropped row, however many
    copies a text has."""
    groups = list(groups)
    if not rows.filter(_any_null(groups)).isEmpty():
        named = rows.withColumn("_group", F.struct(*groups))
        return duplicate_pairs(named, items, ["_group"], order, threshold).select("_group.*", "dup_item", "kept_item", "similarity")
    signed = sign(items, threshold)
    if signed.sets is None:
        decided = _decide(rows, items, groups, order, threshold, signed)
        walked, sets, marked = decided.walked, decided.sets, _mark(rows, decided, groups, order)
    else:
        walked, sets, marked = None, signed.sets, greedy_dedup(rows, items, groups, order, threshold, signed)
    marked = marked.select(*groups, F.col(order).alias("ord"), "item_id", "kept")
    known = cut_lineage(marked.join(signed.signatures.select("item_id", "n", "print"), "item_id").filter("n > 0").drop("n"))
    # one stand-in per distinct set: all copies of it share their first kept partner
    kept = known.filter("kept").select(
        *groups, "print", F.col("ord").alias("kept_ord"), F.col("item_id").alias("pivot_item"))
    lost = cut_lineage(known.filter(~F.col("kept")).groupBy(*groups, "print").agg(
        F.min_by("item_id", "ord").alias("item_id")))
    keys = [*groups, "print"]
    partner = kept.join(lost.select(*keys), keys).select(
        *keys, F.col("pivot_item").alias("kept_item"), F.lit(1.0).alias("similarity"))
    if walked is not None:
        partner = partner.unionByName(walked.drop("ord"))
    if sets is not None:
        near = lost.join(kept, keys, "left_anti")
        near = near if walked is None else near.join(walked, keys, "left_anti")
        partner = partner.unionByName(_first_partners(near, kept, signed.signatures, sets, groups, threshold))
    return known.filter(~F.col("kept")).join(partner, keys).select(
        *groups, F.col("item_id").alias("dup_item"), "kept_item", "similarity")


def _first_partners(lost: DataFrame, kept: DataFrame, signatures: DataFrame, sets: DataFrame, groups: list[str],
                    threshold: float) -> DataFrame:
    """The first kept row each lost set (groups, print, item_id) duplicates (groups, print, kept_item, similarity)."""
    keys = [*groups, "print"]
    blocks = signatures.select("item_id", F.explode("blocks").alias("block"))
    near = cut_lineage(lost.join(blocks, "item_id"))
    wanted = broadcast_if_small(near.select(*groups, "block").distinct())
    rivals = (
        kept.drop("print").withColumnRenamed("pivot_item", "item_id").join(blocks, "item_id")
        .join(wanted, [*groups, "block"], "left_semi").withColumnRenamed("item_id", "pivot_item")
    )
    pairs = near.join(rivals, [*groups, "block"]).select(*keys, "item_id", "pivot_item", "kept_ord").distinct()
    return _compare(cut_lineage(pairs), sets, threshold).groupBy(*keys).agg(
        F.min_by("pivot_item", "kept_ord").alias("kept_item"), F.min_by("similarity", "kept_ord").alias("similarity"))
