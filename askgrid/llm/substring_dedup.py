"""Repeated passages across documents, by groups of suffixes with a common prefix.

The suffixes of all documents (by words) that are long enough to hold a window are to be sorted
into groups small enough for memory. A group is named by an anchor: of the k-word grams inside a
window the one with the smallest hash. The suffixes that start at an anchor have its k words as
prefix; a record carries such a suffix as far as its windows reach, and the words before the
anchor that they reach back to. Equal windows have equal anchors, so they meet in one group.

That replaces trees over the suffixes at every word: those would be sent once for each of their
places, some seven times as many records, and only their inner nodes at the depth of the
window are asked for. What is found are the nodes of that depth, not the maximal repeats below.

1. Documents are dealt into chunks; each sends the distinct anchors of its records to the
   range of hash values they fall in. An anchor found in one document only has a tree with
   one leaf and no inner node: it can hold no repeat, and is left out.
2. Each chunk sends its distinct records of the other anchors, with the smallest doc_id they
   have there. Where an anchor has more records than a group should hold, the prefix is made
   longer, to the whole window, and each window is sent to the group of its own words.
   Rows of one id and text lose the same words; where there are many, one goes for all.
3. A group ranks its suffixes by prefix doubling. Suffixes with one rank at the depth of the
   window are the leaves under one inner node that deep; the smallest doc_id under it goes back
   to the chunks, which mark the words their documents lose.

Between chunks and groups go sorted arrays, one per pair, and each chunk merges what it
has several times, so a passage in a third of all rows arrives at most once per chunk.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.llm.rows import parts_for, whole_ids, written
from askgrid.operators.sizing import broadcast_if_small

WINDOW = 13
GRAM = 6
CHUNK_BYTES = 4 << 20
GROUP_RECORDS = 20_000  # records of one anchor, beyond which its prefix is made longer
NO_ID = np.iinfo(np.int64).max  # a null id: larger than every other
COPIES = 64  # rows of one id and text, beyond which they are handled as one row
ONE, MULTI, LONG = 0, 1, 2
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    n = len(h) - size + 1
    g = h[:n].copy()
    for j in range(1, size):
        g *= _P
        g += h[j:j + n]
    return _mix(g)


class Chunk:
    """Documents of a chunk in a fixed order, their records, and the distinct anchors they have.

    All words lie in one list; a record is windows ``first`` to ``last`` of it, which have the same
    anchor. Windows that reach into the next document are none.
    """

    def __init__(self, docs: pa.Table, window: int, gram: int):
        ids = docs.column("doc_id").to_pylist()
        texts = docs.column("text").to_pylist()
        # rows arrive in any order; equal rows are alike
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids = np.array([NO_ID if ids[i] is None else ids[i] for i in self.order], np.int64)
        self.words: list[bytes] = []
        ends = []
        for i in self.order:
            self.words += texts[i].split()
            ends.append(len(self.words))
        self.ends, self.window = np.array(ends, np.int64), window
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        n = max(0, len(self.words) - window + 1)
        h = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        if n:
            g = _grams(h, gram)
            low, at = g[:n].copy(), np.zeros(n, np.int8)
            for j in range(1, window - gram + 1):
                less = g[j:j + n] < low
                np.copyto(low, g[j:j + n], where=less)
                at[less] = j
            self.doc = np.repeat(np.arange(len(ends)), self.ends - self.starts)
            inside = np.flatnonzero(np.arange(window, n + window) <= self.ends[self.doc[:n]])
            place = inside + at[inside]
            new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(inside) else inside
            self.first = inside[new]
            self.last = inside[np.append(new[1:] - 1, len(inside) - 1)] if len(inside) else inside
            anchor = low[self.first]
            self.windows = _grams(h, window)
        else:
            self.doc = self.first = self.last = np.zeros(0, np.int64)
            anchor = self.windows = np.zeros(0, np.uint64)
        self.anchors, self.place = np.unique(anchor, return_inverse=True)
        self.record_doc = self.doc[self.first]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Per anchor: whether two ids have it here; how many distinct records."""
        n = len(self.anchors)
        owner = self.ids[self.record_doc]
        low, high = np.full(n, NO_ID), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, self.place, owner)
        np.maximum.at(high, self.place, owner)
        content = self.windows[self.first] * _P + self.windows[self.last] * np.uint64(3) + (self.last - self.first).astype(np.uint64)
        order = np.lexsort((content, self.place))
        p, c = self.place[order], content[order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (c[1:] != c[:-1])
        return low < high, np.bincount(p[new], minlength=n).astype("<u4")

    def chosen(self, codes: np.ndarray):
        """Distinct records to send, in order of their first place: lists of key, text, windows and
        smallest id; and arrays of all places they come from: first window, windows, record."""
        code = codes[self.place]
        some = np.flatnonzero(code == MULTI)
        keys, firsts, lasts = self.anchors[self.place[some]], self.first[some], self.last[some]
        long = np.flatnonzero(code == LONG)
        if len(long):  # each window by its own words
            width = self.last[long] - self.first[long] + 1
            single = np.repeat(self.first[long], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            keys, firsts, lasts = (np.concatenate(x) for x in ((keys, self.windows[single]), (firsts, single), (lasts, single)))
        words, reach, index = self.words, self.window, {}
        which = np.empty(len(keys), np.int64)
        texts, head = [], []
        for i, (key, s, e) in enumerate(zip(keys.tolist(), firsts.tolist(), lasts.tolist())):
            text = b" ".join(words[s:e + reach])
            k = index.setdefault((key, text), len(texts))
            if k == len(texts):
                texts.append(text), head.append(i)
            which[i] = k
        low = np.full(len(texts), NO_ID)
        np.minimum.at(low, which, self.ids[self.doc[firsts]])
        width = lasts - firsts + 1
        return keys[head], texts, width[head], low, (firsts, width, which)


def runs(sorted_keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """The ranges of hash values the keys fall in, a range being all that share their first
    ``bits`` bits: number, start and end of each that has keys."""
    part = sorted_keys >> np.uint64(64 - bits) if bits else np.zeros(len(sorted_keys), np.uint64)
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    return list(zip(part[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(part)]))


def planes(x: np.ndarray) -> bytes:
    """Bytes of 64-bit numbers by significance: sorted numbers share the high ones."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)


def _scan(window: int, gram: int, bits: int):
    """Step 1 in a chunk: its anchors, by range."""

    def run(docs: pa.Table) -> pa.Table:
        chunk = Chunk(docs, window, gram)
        shared, count = chunk.counts()
        rows = {"bucket": [], "chunk": [], "anchors": [], "shared": [], "records": []}
        no = docs.column("chunk")[0].as_py()
        for b, lo, hi in runs(chunk.anchors, bits):
            for k, v in zip(rows, (b, no, planes(chunk.anchors[lo:hi]), shared[lo:hi].tobytes(), count[lo:hi].tobytes())):
                rows[k].append(v)
        return pa.table(rows, pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("anchors", pa.binary()),
                                         ("shared", pa.binary()), ("records", pa.binary())]))

    return run


def _decide(limit: int):
    """Step 1 in a range: which anchors more than one document has, and which have many records."""

    def run(sent: pa.Table) -> pa.Table:
        chunks, anchors = sent.column("chunk").to_pylist(), [unplanes(b) for b in sent.column("anchors").to_pylist()]
        every, place = np.unique(np.concatenate(anchors), return_inverse=True)
        shared = np.frombuffer(b"".join(sent.column("shared").to_pylist()), np.bool_)
        records = np.frombuffer(b"".join(sent.column("records").to_pylist()), "<u4")
        chunks_with = np.bincount(place, minlength=len(every))
        several = (chunks_with > 1) | (np.bincount(place, weights=shared, minlength=len(every)) > 0)
        many = np.bincount(place, weights=records, minlength=len(every)) > limit
        code = np.where(several, np.where(many, LONG, MULTI), ONE).astype(np.uint8)[place]
        ends = np.cumsum([len(a) for a in anchors])[:-1]
        return pa.table({"chunk": pa.array(chunks, pa.int32()), "bucket": sent.column("bucket").combine_chunks(),
                         "kind": pa.array([0] * len(chunks), pa.int32()), "data": pa.array([c.tobytes() for c in np.split(code, ends)], pa.binary())})

    return run


def _codes(answers: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: d for k, b, d in zip(answers.column("kind").to_pylist(), answers.column("bucket").to_pylist(),
                                    answers.column("data").to_pylist()) if k == kind}


def _chosen(docs: pa.Table, answers: pa.Table, window: int, gram: int):
    chunk = Chunk(docs, window, gram)
    by_bucket = _codes(answers, 0)
    codes = np.frombuffer(b"".join(by_bucket[b] for b in sorted(by_bucket)), np.uint8)
    return chunk, chunk.chosen(codes)


def _send(window: int, gram: int, bits: int):
    """Step 2: the distinct records of a chunk, by the range of their key."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        rows = {"bucket": [], "chunk": [], "keys": [], "texts": [], "width": [], "low": []}
        schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("texts", pa.binary()),
                            ("width", pa.binary()), ("low", pa.binary())])
        if docs.num_rows and answers.num_rows:
            _, (keys, texts, width, low, _) = _chosen(docs, answers, window, gram)
            order = np.argsort(keys, kind="stable")
            width = width.astype(np.uint8)
            no = docs.column("chunk")[0].as_py()
            for b, lo, hi in runs(keys[order], bits):
                some = order[lo:hi]
                for k, v in zip(rows, (b, no, planes(keys[some]), b"\n".join([texts[i] for i in some.tolist()]),
                                       width[some].tobytes(), low[some].tobytes())):
                    rows[k].append(v)
        return pa.table(rows, schema)

    return run


def _rank(names: np.ndarray, step: int) -> np.ndarray:
    """Names of twice the depth: pairs of the name here and the name ``step`` words on."""
    top = int(names.max(initial=0)) + 2
    pairs = names * top
    pairs[:-step] += names[step:] + 1
    order = np.argsort(pairs)
    pairs = pairs[order]
    pairs[1:] = np.cumsum(pairs[1:] != pairs[:-1])
    pairs[0] = 0
    names[order] = pairs
    return names


def node_minima(words: np.ndarray, starts: np.ndarray, low: np.ndarray, window: int) -> np.ndarray:
    """``words``: ids of all records in a row; ``starts``: where windows begin; ``low``: the id of
    each. Returns for each the smallest id under its inner node at the depth of the window."""
    names, depth = words, 1
    while depth < window:
        step = min(depth, window - depth)
        names = _rank(names, step) if len(names) > step else names
        depth += step
    leaf = names[starts]
    order = np.argsort(leaf, kind="stable")
    node = np.concatenate([[True], leaf[order][1:] != leaf[order][:-1]])
    least = np.minimum.reduceat(low[order], np.flatnonzero(node))
    out = np.empty(len(starts), np.int64)
    out[order] = least[np.cumsum(node) - 1]
    return out


def _trees(window: int):
    """Step 3 in a group of prefixes."""

    def run(sent: pa.Table) -> pa.Table:
        ids: dict[bytes, int] = {}
        words, starts, low, owner, at = [], [], [], [], 0
        for row in range(sent.num_rows):
            width = np.frombuffer(sent.column("width")[row].as_py(), np.uint8).astype(np.int64)
            lows = np.frombuffer(sent.column("low")[row].as_py(), np.int64)
            flat = sent.column("texts")[row].as_py().split()
            words.append(np.fromiter((ids.setdefault(w, len(ids)) for w in flat), np.int64, len(flat)))
            first = at + np.concatenate([[0], np.cumsum(width + window - 1)[:-1]])
            inner = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            starts.append(np.repeat(first, width) + inner)
            low.append(np.repeat(lows, width))
            owner.append(int(width.sum()))
            at += len(flat)
        least = node_minima(np.concatenate(words), np.concatenate(starts), np.concatenate(low), window)
        parts = np.split(least, np.cumsum(owner)[:-1])
        return pa.table({"chunk": sent.column("chunk").combine_chunks(), "bucket": sent.column("bucket").combine_chunks(),
                         "kind": pa.array([1] * len(parts), pa.int32()), "data": pa.array([p.tobytes() for p in parts], pa.binary())})

    return run


def _mark(window: int, gram: int, schema: pa.Schema):
    """Step 3 in a chunk: words that lie in a window some smaller id has too."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        chunk, (keys, _, width, _, (first, count, which)) = _chosen(docs, answers, window, gram)
        order = np.argsort(keys, kind="stable")
        begin = np.zeros(len(order), np.int64)
        begin[order] = np.cumsum(width[order]) - width[order]
        got = _codes(answers, 1)
        least = np.frombuffer(b"".join(got[b] for b in sorted(got)), np.int64)
        # every window that was sent, and the smallest id that has it
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(first, count) + inner
        hit = at[least[np.repeat(begin[which], count) + inner] < chunk.ids[chunk.doc[at]]]
        gone = np.zeros(len(chunk.words) + window + 1, np.int32)
        gone[hit] += 1  # a window is in one record, so no place comes twice
        gone[hit + window] -= 1
        cover = np.cumsum(gone)[:len(chunk.words)] > 0
        total = np.concatenate([[0], np.cumsum(cover)])
        texts, n_words, n_removed, spans = [], [], [], []
        for a, b in zip(chunk.starts.tolist(), chunk.ends.tolist()):
            removed = int(total[b] - total[a])
            words = chunk.words[a:b]
            n_words.append(b - a), n_removed.append(removed)
            if removed:
                mine = cover[a:b]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]]))).tolist()
                spans.append([{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2])])
                words = list(compress(words, (~mine).tolist()))
            else:
                spans.append([])
            texts.append(b" ".join(words))
        out = [docs.column("row").combine_chunks().take(pa.array(chunk.order, pa.int64())).cast(schema.field("row").type), pa.array(texts, pa.binary()),
               pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, schema.field("spans").type)]
        return pa.Table.from_arrays(out, ["row", "kept", "n_words", "n_removed", "spans"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES,
                   group_records: int = GROUP_RECORDS) -> DataFrame:
    """Every row of ``docs`` (doc_id integer, text; other columns stay) without repeated passages.

    A word goes if it lies in a run of ``window`` words that also starts in a document with a
    smaller doc_id. Returns row (struct of the input without text), n_words, n_removed, kept
    (words left, joined by one space), spans (removed runs of words, end exclusive).

    Null and short texts lose nothing. A null id is larger than every other and no smaller than
    another null. Rows that repeat an id do not remove each other's words. Repeats inside
    one document stay. A text of any length is one row. An empty table gives no rows.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    ids = whole_ids(docs).schema["doc_id"].dataType
    base = docs.select(F.col("doc_id").cast(ids).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
                       F.struct(*others).alias("row"))
    key = F.xxhash64("doc_id", "text").alias("key")
    hot = written(base.select(key).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > COPIES).select("key"), "hot")
    if hot.isEmpty():
        return _removed(base, window, gram, chunk_bytes, group_records)
    # Rows of one id and text lose the same words: one of them goes through, the others follow it.
    keyed, hot = base.withColumn("key", key), broadcast_if_small(hot)
    copies = keyed.join(hot, "key", "left_semi").drop("key")
    one = copies.groupBy("doc_id", "text").agg(F.first("row").alias("row"))
    whole = F.struct("row", "doc_id", F.sha2("text", 256).alias("sha"))
    both = keyed.join(hot, "key", "left_anti").drop("key").withColumn("row", F.struct("row", F.lit(None).cast(ids).alias("doc_id"), F.lit(None).cast(
        "string").alias("sha"))).unionByName(one.withColumn("row", whole))
    marked = written(_removed(written(both, "distinct"), window, gram, chunk_bytes, group_records), "marked")
    facts = ["n_words", "n_removed", "kept", "spans"]
    found = broadcast_if_small(marked.filter("row.sha is not null").select("row.doc_id", "row.sha", *facts))
    follow = copies.select("row", "doc_id", F.sha2("text", 256).alias("sha"))
    same = follow["doc_id"].eqNullSafe(found["doc_id"]) & (follow["sha"] == found["sha"])
    columns = ["row", "kept", "n_words", "n_removed", "spans"]
    return marked.filter("row.sha is null").withColumn("row", F.col("row.row")).select(*columns).unionByName(
        follow.join(found, same).select(*columns))


def _removed(base: DataFrame, window: int, gram: int, chunk_bytes: int, group_records: int) -> DataFrame:
    """The three steps over all rows (doc_id, text, row); ``row`` is handed on."""
    chunks = parts_for(base, chunk_bytes)
    bits = (chunks - 1).bit_length()
    dealt = base.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).repartition(chunks, "chunk")
    # All three passes read the same columns, so the text is shuffled once and its files read again.
    sent = dealt.groupBy("chunk").applyInArrow(
        _scan(window, gram, bits), "bucket int, chunk int, anchors binary, shared binary, records binary")
    answer = "chunk int, bucket int, kind int, data binary"
    codes = sent.groupBy("bucket").applyInArrow(_decide(group_records), answer)
    records = dealt.groupBy("chunk").cogroup(codes.groupBy("chunk")).applyInArrow(
        _send(window, gram, bits), "bucket int, chunk int, keys binary, texts binary, width binary, low binary")
    minima = records.groupBy("bucket").applyInArrow(_trees(window), answer)
    answers = codes.unionByName(minima)
    row = dealt.schema["row"].dataType.simpleString()
    out = f"row {row}, kept binary, n_words long, n_removed long, spans array<struct<start:int,end:int>>"
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(base.sparkSession.createDataFrame([], out).schema)
    marked = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_mark(window, gram, schema), out)
    return marked.withColumn("kept", F.col("kept").cast("string"))


def repeat_counts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """As the contract asks: doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeats(docs.select("doc_id", "text"), window).select(
        "row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def keep_first(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents with repeated passages taken out and all columns in place. A text that lost nothing
    is as it was, one that lost all its words goes; ``n_chars`` follows the text."""
    # the row as it was is one struct, so no name of it can clash
    marked = remove_repeats(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")), window)
    rest = marked.filter((F.col("n_removed") == 0) | (F.col("kept") != "")).select("n_removed", "kept", "row.whole")
    same = F.col("n_removed") == 0
    new = {"text": F.col("kept"), "n_chars": F.length("kept")}
    return rest.select(*[
        (F.when(same, F.col(f"whole.`{c}`")).otherwise(new[c].cast(docs.schema[c].dataType)) if c in new else F.col(f"whole.`{c}`")).alias(c)
        for c in docs.columns])
