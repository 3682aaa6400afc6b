"""Prefix trie of conversations with subtree totals, by depth bands.

A turn enters as a digest and a word count; its text is not shuffled. The prefix of d turns is
named by the XOR of 128 bits of each (place, turn), so prefixes of one conversation come from a running
aggregate over blocks of it. A node is named by its smallest member and its depth: whoever owns a node owns
all nodes below it on its own path, so a conversation's row at a depth either is the node or names its owner.

Totals of subtrees go up in bands of fixed height. Inside a band a path's row adds its node to the
ancestors on the path, at most as many as a band has depths; a path sends each of them one sum.
The first nodes of the bands, with what their bands hold, are a tree whose height is smaller by the
height of a band, and are rolled up the same way; their completed totals then go to the ancestors in the band
above them. Rounds grow with the logarithm of the depth, and no row meets more ancestors than a band holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgrid.llm.rows import WORD, columns_of, written
from askgrid.operators.sizing import broadcast_if_small, number_rows

FAMILY = 20  # conversations c - c % FAMILY .. share the first turns of the first of them
HEADS = 4    # crc32(c) % HEADS turns are shared
HEIGHT = 32  # depths of a band
BLOCK = 4096  # turns of a conversation whose running aggregate is one task's work
PART_ROWS = 200_000
CHUNK = 4096  # ids hashed or sent on at a time
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def _parts(df: DataFrame, rows: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, rows // PART_ROWS + 1)


def shared_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from the first of its family."""
    return (F.crc32(conv.cast("string")) % HEADS).cast("int")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, digest, words and place (from 1) of every row with a conv_id, in the order of turn, null
    first, then of the digest. Rows are numbered in ranges, so a conversation may have any size."""
    rows = columns_of(conversations, ["conv_id", "turn", "role", "text"])
    if not isinstance(rows.schema["conv_id"].dataType, T.IntegralType):
        raise TypeError("conv_id has to be a whole number")
    rows = rows.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    turns = written(rows.select("conv_id", "turn", F.unhex(F.sha2(turn, 256)).alias("digest"),
                                F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")), "turns")
    # rows that repeat are told apart by where they stand, or their ranges could not be split
    keyed = turns.select("conv_id", "digest", "words", F.struct("turn", "digest", F.monotonically_increasing_id().alias("id")).alias("key"))
    n = turns.count()
    return written(number_rows(keyed, "key", "place", 1, ["conv_id"], max(1, n // _parts(turns, n))).drop("key"), "numbered")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, length) of every conversation, and its rows (conv, depth, digest, words, length), depth from 1."""
    own = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("place") < HEADS)).groupBy(F.col("conv_id").alias("first")).agg(
        F.sort_array(F.collect_list(F.struct("place", "digest", "words"))).alias("head"))
    h = shared_turns(F.col("conv_id"))
    taken = F.slice(F.coalesce("head", F.array().cast("array<struct<place:bigint,digest:binary,words:bigint>>")), F.lit(1), F.col("h"))
    convs = own.withColumn("first", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", h).join(heads, "first", "left").select(
        F.col("conv_id").alias("conv"), taken.alias("head"), (F.greatest(F.col("n") - F.col("h"), F.lit(0)) + F.size(taken)).alias("length"))
    convs = written(convs, "conversations")
    kept = turns.withColumn("h", h).filter("place > h").join(convs.withColumnRenamed("conv", "conv_id"), "conv_id").select(
        F.col("conv_id").alias("conv"), (F.col("place") - F.col("h") + F.size("head")).cast("long").alias("depth"), "digest", "words", "length")
    begun = convs.select("conv", "length", F.explode("head").alias("t")).select(
        "conv", F.col("t.place").alias("depth"), "t.digest", "t.words", "length")
    return convs.select("conv", "length"), begun.unionByName(kept)


def _prefixes(rows: DataFrame, block: int) -> DataFrame:
    """Rows with the name (k1, k2) of the prefix that ends in them."""
    rows = rows.withColumn("h1", F.xxhash64("depth", "digest")).withColumn("h2", F.xxhash64("digest", "depth")).drop("digest").withColumn(
        "block", F.floor((F.col("depth") - 1) / block))
    run = W.partitionBy("conv", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    inside = written(rows.withColumn("k1", F.bit_xor("h1").over(run)).withColumn("k2", F.bit_xor("h2").over(run)).drop("h1", "h2"), "prefixes")
    ends = inside.filter((F.col("depth") % block == 0) & (F.col("depth") < F.col("length")))
    before = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, 0)  # a row per block
    carried = written(ends.select("conv", (F.col("block") + 1).alias("block"), F.bit_xor("k1").over(before).alias("c1"),
                                  F.bit_xor("k2").over(before).alias("c2")), "carried")
    if carried.isEmpty():
        return inside.drop("block")
    zero = F.lit(0).cast("long")
    return inside.join(broadcast_if_small(carried), ["conv", "block"], "left").withColumn(
        "k1", F.col("k1").bitwiseXOR(F.coalesce("c1", zero))).withColumn("k2", F.col("k2").bitwiseXOR(F.coalesce("c2", zero))).drop("block", "c1", "c2")


def paths(turns: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int] | None:
    """Every conversation's rows from the root down, each naming its node, and the largest depth.

    Columns: conv, depth, owner (smallest member of the node), n_convs (its members), leaf, saved
    ((n_convs - 1) * words), ended (the conversation has no further turn). None without conversations.
    """
    convs, rows = rebuilt(turns)
    named = _prefixes(rows, block)
    n, first, longest = convs.agg(F.count("*"), F.min("conv"), F.max("length")).first()
    if not n:
        return None
    shared = written(named.groupBy("depth", "k1", "k2").agg(
        F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.max("length").alias("longest")).filter("n_convs > 1"), "shared")
    met = named.join(shared, ["depth", "k1", "k2"], "left").select(
        "conv", "depth", F.coalesce("owner", "conv").alias("owner"), F.coalesce("n_convs", F.lit(1)).alias("n_convs"),
        (F.coalesce("longest", "length") == F.col("depth")).alias("leaf"), "words", (F.col("length") == F.col("depth")).alias("ended"))
    root = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(first).cast("long").alias("owner"), F.lit(n).cast("long").alias("n_convs"),
                        F.lit(longest == 0).alias("leaf"), F.lit(0).cast("long").alias("words"), (F.col("length") == 0).alias("ended"))
    every = met.unionByName(root).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).drop("words")
    return written(every, "paths"), longest


def _in_bands(rows: DataFrame, step: int, height: int) -> DataFrame:
    """Nodes (conv_id, depth) with parent, n_convs, children and the sums of leaves and saved over
    their subtree as far as their band reaches.

    ``rows`` has conv, depth (multiples of ``step``), owner, n_convs, leaves, saved. Rows of a path in
    a band meet, at most ``height`` and the last one of the band before, the parent of their first.
    """
    size = step * height
    band = F.floor(F.col("depth") / size)
    also = F.when((F.col("depth") + step) % size == 0, F.array(band, band + 1)).otherwise(F.array(band))
    parts = rows.select("conv", F.explode(also).alias("band"), F.struct("depth", "owner", "n_convs", "leaves", "saved").alias("x")).groupBy(
        "conv", "band").agg(F.sort_array(F.collect_list("x")).alias("path"))
    path, conv, zero = F.col("path"), F.col("conv"), F.lit(0).cast("long")
    inside = lambda x: x["depth"] >= F.col("band") * size
    below = lambda x, i, c: F.when(inside(x), F.aggregate(
        F.slice(path, i + 1, F.lit(height + 1)), zero, lambda acc, y: acc + F.when(y["owner"] == conv, y[c]).otherwise(zero))).otherwise(zero)
    mine = lambda x: inside(x) & (x["owner"] == conv)
    sent = F.transform(path, lambda x, i: F.struct(
        x["owner"].alias("conv_id"), x["depth"].alias("depth"),
        F.when(mine(x) & (i > 0), F.get(path, i - 1)["owner"]).alias("parent"), F.when(mine(x), x["n_convs"]).alias("n_convs"),
        F.when(F.get(path, i + 1)["owner"] == conv, F.lit(1)).otherwise(F.lit(0)).alias("children"),
        below(x, i, "leaves").alias("leaves"), below(x, i, "saved").alias("saved")))
    each = parts.select(F.explode(sent).alias("s")).select("s.*").filter("n_convs is not null or children > 0 or leaves <> 0 or saved <> 0")
    return each.groupBy("conv_id", "depth").agg(
        F.max("parent").alias("parent"), F.max("n_convs").alias("n_convs"), F.sum("children").alias("children"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def roll_up(rows: DataFrame, longest: int, step: int = 1, height: int = HEIGHT) -> DataFrame:
    """As _in_bands, with sums over whole subtrees."""
    size = step * height
    sums = written(_in_bands(rows, step, height), "bands")
    if longest < size:
        return sums
    tops = sums.filter(F.col("depth") % size == 0).select(F.col("conv_id").alias("conv"), "depth", "leaves", "saved")
    zero = F.lit(0).cast("long")
    # only the row that owns a node carries the node's sums
    upper = rows.filter(F.col("depth") % size == 0).drop("leaves", "saved").join(tops, ["conv", "depth"], "left").select(
        "conv", "depth", "owner", "n_convs", *[F.when(F.col("owner") == F.col("conv"), F.coalesce(c, zero)).otherwise(zero).alias(c) for c in ("leaves", "saved")])
    whole = roll_up(written(upper, "tops"), longest, size, height).filter("depth > 0").select(
        F.col("conv_id").alias("conv"), (F.col("depth") / size - 1).cast("long").alias("band"), "leaves", "saved")
    above = rows.select("conv", F.floor(F.col("depth") / size).alias("band"), "owner", "depth").join(whole, ["conv", "band"])
    passed = above.groupBy(F.col("owner").alias("conv_id"), "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    none = [F.lit(None).cast("long").alias(c) for c in ("parent", "n_convs", "children")]
    return written(sums.unionByName(passed.select("conv_id", "depth", *none, "leaves", "saved")).groupBy("conv_id", "depth").agg(
        F.max("parent").alias("parent"), F.max("n_convs").alias("n_convs"), F.sum("children").alias("children"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "totals")


SPANS = "conv_id long, depth long, first long, ids string, ends_sha256 string"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted (conv_id, depth, member): the digest of each node whose members all stand
    here; members of the first and the last node, which other partitions may have too, in chunks."""
    held: list[np.ndarray] = []
    node, nodes = None, 0

    def out(rows):
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "depth", "first", "ids", "ends_sha256"])

    def chunks(members):
        return [(*node, int(members[i]), ",".join(map(str, members[i:i + CHUNK].tolist())), None) for i in range(0, len(members), CHUNK)]

    for batch in batches:
        if not batch.num_rows:
            continue
        a, d, m = (batch.column(i).to_numpy() for i in range(3))
        cuts = np.flatnonzero((a[1:] != a[:-1]) | (d[1:] != d[:-1])) + 1
        rows = []
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(a)]):
            if node != (int(a[i]), int(d[i])):
                if node is not None:
                    members = np.concatenate(held)
                    rows += chunks(members) if nodes == 1 else [
                        (*node, None, None, hashlib.sha256(",".join(map(str, members.tolist())).encode()).hexdigest())]
                node, nodes, held = (int(a[i]), int(d[i])), nodes + 1, []
            held.append(m[i:j])
        yield out(rows)
    if node is not None:
        yield out(chunks(np.concatenate(held)))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted (conv_id, depth, first, ids): the digest of each node, chunk by chunk."""
    node = digest = None

    def out(rows):
        columns = list(zip(*rows)) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()))],
                                          ["conv_id", "depth", "ends_sha256"])

    for batch in batches:
        rows = []
        for a, d, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
            if (a, d) != node:
                if node is not None:
                    rows.append((*node, digest.hexdigest()))
                node, digest = (a, d), hashlib.sha256(ids.as_py().encode())
            else:
                digest.update(b"," + ids.as_py().encode())
        yield out(rows)
    if node is not None:
        yield out([(*node, digest.hexdigest())])


def ends_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 from (conv_id, depth, member): ids are sorted in ranges, so the members of
    one node are dealt over tasks; only its ready chunks of text meet, in order, as SHA-256 asks."""
    parts = _parts(ends, ends.count())
    order = ["conv_id", "depth", "member"]
    spans = written(ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_spans, SPANS), "spans")
    order = ["conv_id", "depth", "first"]
    joined = spans.filter("ids is not null").select(*order, "ids").repartition("conv_id", "depth").sortWithinPartitions(*order).mapInArrow(
        _joined, "conv_id long, depth long, ends_sha256 string")
    return spans.filter("ids is null").select("conv_id", "depth", "ends_sha256").unionByName(joined)


def trie_nodes(turns: DataFrame, height: int = HEIGHT, block: int = BLOCK) -> DataFrame | None:
    """The nodes of the trie over ``turns`` (conv_id, digest, words, place); None without conversations."""
    found = paths(turns, block)
    if found is None:
        return None
    rows, longest = found
    every = rows.select("conv", "depth", "owner", "n_convs", F.col("leaf").cast("long").alias("leaves"), "saved")
    nodes = roll_up(every, longest, 1, height)
    ends = ends_digests(rows.filter("ended").select(F.col("owner").alias("conv_id"), "depth", F.col("conv").alias("member")))
    return nodes.join(ends, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, height: int = HEIGHT, block: int = BLOCK) -> DataFrame:
    """Trie of all rebuilt conversations of ``conversations`` (conv_id, turn, role, text; others are ignored).

    A conversation c begins with the first crc32(c) % 4 turns of conversation c - c % 20, as far as
    there are, and goes on with its own behind as many. One row per node: conv_id (smallest
    member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null role or text is empty, null turn comes first; turns of one number stand in the order of the
    SHA-256 of (bytes of the role, ":", role, text), so rows that repeat are turns each. Rows
    without conv_id belong to no conversation. c % 20 has the sign of c. A text of any length is one row; a
    conversation of any length is dealt over tasks. No conversations: no rows.
    """
    nodes = trie_nodes(numbered_turns(conversations), height, block)
    if nodes is None:
        empty = ", ".join(f"{c} long" for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"))
        return conversations.sparkSession.createDataFrame([], empty + ", ends_sha256 string")
    return nodes
