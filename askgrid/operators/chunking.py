"""Two-level chunking of documents and the tree operators on the resulting nodes."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from askgrid.functions.text import BETWEEN_TERMS_IN_WORDS, split_words
from askgrid.operators.dense import term_buckets
from askgrid.operators.lexical import SEGMENT
from askgrid.operators.sizing import BLOCK_BYTES, blocks

# Chunk sizes and overlap, in words.
PARENT_SIZE = 4000
CHILD_SIZE = 256
OVERLAP = 100
# Words of nodes whose terms a task counts at a time, into one row.
BLOCK_WORDS = 1 << 19
# What bytes are in terms: small letters for large ones. The other signs below 128 lie between terms.
SMALL = bytes(ord(chr(b).lower()) if b < 128 else b for b in range(256))
SIGNS = bytes(b for b in range(128) if not chr(b).isalnum() and b != 95)
IN_TERM = bytes(b not in SIGNS for b in range(256))
# Latin letters beyond ASCII, whose small forms and kinds are the same in Python and Java; texts with others are cleaned by Spark.
LATIN = range(0x80, 0x180)
LATIN_SIGNS = re.compile("[" + "".join(chr(c) for c in LATIN if unicodedata.category(chr(c))[0] not in "LN") + "]+")
BEYOND_LATIN = r"[^\x00-\u012f\u0131-\u017f]"


def _windows(path: str | None, n: int, sizes: Sequence[int], overlap: int, level: int = 0, start: int = 0) -> Iterator[tuple]:
    """Windows of ``sizes[level]`` of ``n`` words that each share ``overlap`` with the last one, each followed
    by its own: (path, level, parent's path, place, windows, first word, end). There is always one window; the
    last one ends with the last word."""
    stride = sizes[level] - overlap
    count = max(1, -((overlap - n) // stride))
    for i in range(count):
        first, size = start + i * stride, min(sizes[level], n - i * stride)
        name = f"{i}" if path is None else f"{path}/{i}"
        yield name, level, path if level else None, i, count, first, first + size
        if level + 1 < len(sizes):
            yield from _windows(name, size, sizes, overlap, level + 1, first)


def _word_starts(texts: bytes) -> np.ndarray:
    """Where the words of texts begin that lie one blank, or between texts one line end, apart. A text
    without words counts as one empty word; the last place is that of the word after the end."""
    signs = np.frombuffer(texts, np.uint8)
    return np.concatenate(([0], np.flatnonzero((signs == 32) | (signs == 10)) + 1, [len(signs) + 1]))


def _terms(texts: bytes, left_out: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where the terms of texts begin, which they are, and the distinct ones. Bytes beyond ASCII belong to a
    term; texts with others of them come cleaned."""
    inside = np.frombuffer(b"\0" + texts.translate(IN_TERM) + b"\0", bool)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(texts.translate(SMALL, SIGNS))]
    coded = pa.Array.from_buffers(pa.string(), len(starts), buffers).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    some = ~pc.is_in(coded.dictionary, value_set=left_out).to_numpy(zero_copy_only=False)[codes]
    return starts[some], codes[some], coded.dictionary


def _cleaned(text: bytes | None, clean: str | None) -> bytes:
    """A text in the form whose terms can be told by their bytes."""
    if clean is not None:
        return " ".join(clean.split()).encode()
    return (text or b"") if text is None or text.isascii() else LATIN_SIGNS.sub("\x01", text.decode().lower()).encode()


def _segment(found: tuple, words: np.ndarray, first: np.ndarray, end: np.ndarray, dim: int | None, columns: dict) -> dict:
    """The row of the term table for a run of windows (``lexical.SEGMENT``)."""
    starts, codes, terms = found
    lo, hi = np.searchsorted(starts, words[first]), np.searchsorted(starts, words[end])
    dl = hi - lo
    row = np.repeat(np.arange(len(first)), dl)
    codes = codes[np.arange(len(row)) + np.repeat(lo - (np.cumsum(dl) - dl), dl)]
    keys, tf = np.unique(row * max(len(terms), 1) + codes, return_counts=True)
    row, codes = np.divmod(keys, max(len(terms), 1))
    used = np.bincount(codes, minlength=len(terms)) > 0  # of the block's terms, those of this run
    terms, codes = terms.filter(pa.array(used)), (np.cumsum(used) - 1)[codes]
    held = np.flatnonzero(dl)
    return {"terms": " ".join(terms.to_numpy(zero_copy_only=False)), "codes": codes.astype(np.int32).tobytes(),
            "tfs": tf.astype(np.int32).tobytes(), "n": np.bincount(row, minlength=len(first))[held], "dl": dl[held],
            "buckets": None if dim is None else term_buckets(terms, dim).astype(np.int32).tobytes(),
            **{c: [values[i] for i in held] for c, values in columns.items()}}


def chunk_hierarchical(docs: DataFrame, sizes: Sequence[int] = (PARENT_SIZE, CHILD_SIZE),
                       overlap: int = OVERLAP, keep: Sequence[str] = (), stop_words: Iterable[str] | None = None,
                       dim: int | None = None) -> DataFrame:
    """Nodes (node_id, doc_id, level, parent_id, seq, n_siblings, text) of all levels.

    One pass over the documents and no shuffle: every level is cut from the words of the
    level above inside the row. Node ids spell the path in the tree, and each node knows
    how many children its parent has, so no later join has to count them. Words lie between
    white space as Python's split takes it, which is that of ``split_words``.

    With ``stop_words`` the first of each run of nodes also has the rows of the term table for all of them
    (``segment``), and with ``dim`` the bucket of each term in as many. A term lies inside one word, so
    the terms of a document are found once for all its nodes.
    """
    if any(s <= overlap for s in sizes):
        raise ValueError("every chunk size must exceed the overlap")
    carry, sizes, counted = list(keep), list(sizes), stop_words is not None
    # a doubled separator inside an id cannot be taken for that of a path
    path = F.replace(F.col("doc_id").cast("string"), F.lit("/"), F.lit("//"))
    # lower-cased, with one sign for all that is in no term
    other = (F.octet_length("text") != F.char_length("text")) & F.col("text").rlike(BEYOND_LATIN)
    clean = [F.when(other, F.regexp_replace(F.lower("text"), BETWEEN_TERMS_IN_WORDS, "\x01")).alias("_clean")] if counted else []
    rows = docs.select(F.col("doc_id").alias("_doc"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(carry)],
                       path.alias("_path"), F.col("text").alias("_text"), *clean)
    kinds = [T.StructField("node_id", T.StringType()), T.StructField("doc_id", rows.schema["_doc"].dataType),
             T.StructField("level", T.IntegerType()), T.StructField("parent_id", T.StringType()),
             T.StructField("seq", T.IntegerType()), T.StructField("n_siblings", T.IntegerType()),
             T.StructField("text", T.StringType()),
             *[T.StructField(c, rows.schema[f"_{i}"].dataType) for i, c in enumerate(carry)]]
    if counted:
        kinds.append(T.StructField("segment", SEGMENT))
        left_out, segment = pa.array(sorted(set(stop_words)), pa.string()), to_arrow_type(SEGMENT)
    own = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False)
            for begin, stop in blocks(lengths, BLOCK_BYTES // 2):  # a block's nodes and counts take several times its bytes
                part = batch.slice(begin, stop - begin)
                texts = [None if t is None else " ".join(t.split()).encode() for t in part.column("_text").to_pylist()]
                joined = b"\n".join(t or b"" for t in texts)
                nodes, row, before = [], [], 0
                for i, (name, t) in enumerate(zip(part.column("_path").to_pylist(), texts)):
                    n = t.count(b" ") + 1 if t else 0
                    below = [*_windows(name, n, sizes, overlap, 0, before)]
                    nodes += below
                    row += [i] * len(below)
                    before += max(n, 1)
                ids, level, parents, seq, count, first, end = (pa.array(c, kind) for c, kind in zip(zip(*nodes), own))
                first, end = first.to_numpy(), end.to_numpy()
                words = _word_starts(joined)
                cut_texts = pa.array([None if texts[i] is None else joined[a:max(a, b - 1)] for i, a, b in zip(
                    row, words[first].tolist(), words[end].tolist())], pa.binary()).cast(pa.string())
                at = pa.array(row, pa.int64())
                whole = [ids, part.column("_doc").take(at), level, parents, seq, count, cut_texts,
                         *[part.column(f"_{i}").take(at) for i in range(len(carry))]]
                if counted:
                    cleaned = b"\n".join(map(_cleaned, texts, part.column("_clean").to_pylist()))
                    words, found = _word_starts(cleaned), _terms(cleaned, left_out)
                for a, b in blocks(end - first, BLOCK_WORDS):
                    out = [c.slice(a, b - a) for c in whole]
                    if counted:
                        tree = {c: [node[j] for node in nodes[a:b]] for c, j in (("node_id", 0), ("level", 1), ("parent_id", 2), ("n_siblings", 4))}
                        held = _segment(found, words, first[a:b], end[a:b], dim, tree)
                        out.append(pa.array([held, *[None] * (b - a - 1)], segment))
                    yield pa.RecordBatch.from_arrays(out, [k.name for k in kinds])

    return rows.mapInArrow(cut, T.StructType(kinds))


def leaf_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes without children."""
    parents = (
        nodes.filter(F.col("parent_id").isNotNull())
        .select(F.col("parent_id").alias("node_id")).distinct()
    )
    return nodes.join(parents, "node_id", "left_anti")


def root_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes without a parent."""
    return nodes.filter(F.col("parent_id").isNull())


def attach_metadata(nodes: DataFrame) -> DataFrame:
    """Add length columns to nodes; source columns come along through ``keep``."""
    return nodes.withColumns({
        "n_chars": F.length("text"),
        "n_tokens": F.size(split_words("text")),
        "is_root": F.col("parent_id").isNull(),
    })
