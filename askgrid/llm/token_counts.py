"""Token counts that follow edits.

A document keeps a tree over its pre-tokens: a leaf stands for a few dozen of them and holds their
characters and tokens, an inner node the sums of its two children. An edit finds its leaf by
the sums of characters, reads the text anew from the start of a leaf that begins before all
pre-tokens the edit can change, and stops where a new pre-token starts on the border of an
old leaf behind the edit. Only the leaves between are counted again and only their ancestors
are summed again.

Why that is right: the pattern matches from the start of a pre-token on and looks at most one
sign beyond its end. So a pre-token is unchanged if it ends more than one sign before the edit, and
from any common start behind the edit the old and the new text split alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 32  # pre-tokens of a leaf of a new tree
MEMO = 500_000
LOOK = 2  # signs before an edit whose pre-token may change
TREE = "struct<chars:array<int>,tokens:array<int>>"


class Counter:
    """Tokens of a pre-token, by memo."""

    def __init__(self, pattern: str, count: Callable[[str], int], memo: int = MEMO):
        self.pattern, self.count, self.limit, self.memo = regex.compile(pattern), count, memo, _Memo(self)

    def tokens(self, pieces: list[str]) -> int:
        return sum(map(self.memo.__getitem__, pieces))


class _Memo(dict):
    def __init__(self, owner: Counter):
        super().__init__()
        self.owner = owner

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.owner.limit:
            self.clear()
        got = self.owner.count(piece)
        if len(piece) <= 64:
            self[piece] = got
        return got


class Tree:
    """Sums over the leaves as a heap: node i has children 2i and 2i + 1, the root is 1."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens = chars, tokens

    @classmethod
    def of_leaves(cls, leaves: list[tuple[int, int]]) -> "Tree":
        size = 1
        while size < len(leaves):
            size *= 2
        chars, tokens = np.zeros(2 * size, np.int64), np.zeros(2 * size, np.int64)
        for i, (c, t) in enumerate(leaves):
            chars[size + i], tokens[size + i] = c, t
        while size > 1:
            half = size // 2
            chars[half:size] = chars[size:2 * size:2] + chars[size + 1:2 * size:2]
            tokens[half:size] = tokens[size:2 * size:2] + tokens[size + 1:2 * size:2]
            size = half
        return cls(chars, tokens)

    @classmethod
    def of_text(cls, text: str, counter: Counter) -> "Tree":
        pieces = counter.pattern.findall(text)
        count, leaves = counter.memo.__getitem__, []
        for at in range(0, len(pieces), LEAF):
            some = pieces[at:at + LEAF]
            leaves.append((sum(map(len, some)), sum(map(count, some))))
        return cls.of_leaves(leaves)

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1]) if len(self.tokens) > 1 else 0

    @property
    def size(self) -> int:
        return len(self.chars) // 2

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if char - start >= self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node - self.size, start

    def set_leaves(self, first: int, leaves: list[tuple[int, int]]) -> None:
        lo, hi = first + self.size, first + self.size + len(leaves) - 1
        for i, (c, t) in enumerate(leaves):
            self.chars[lo + i], self.tokens[lo + i] = c, t
        while lo > 1:
            lo, hi = lo // 2, hi // 2
            a, b = slice(2 * lo, 2 * hi + 2, 2), slice(2 * lo + 1, 2 * hi + 2, 2)
            self.chars[lo:hi + 1] = self.chars[a] + self.chars[b]
            self.tokens[lo:hi + 1] = self.tokens[a] + self.tokens[b]

    def edit(self, text: str, start: int, length: int, new: str, counter: Counter) -> tuple["Tree", str, int]:
        """Tree and text after ``length`` characters from ``start`` on became ``new``; and how many
        tokens were counted again."""
        start = max(0, min(start, len(text)))
        length = max(0, min(length, len(text) - start))
        changed = text[:start] + new + text[start + length:]
        shift = len(new) - length
        total = int(self.chars[1]) if len(self.chars) > 1 else 0
        if not total or not changed:
            tree = Tree.of_text(changed, counter)
            return tree, changed, tree.n_tokens
        first, begin = self.leaf_at(min(max(0, start - LOOK), total - 1))
        last, end = first, begin  # leaves first..last-1 are replaced; they end at ``end``
        pieces, at, size = [], begin, self.size
        while True:
            while last < size and (end < start + length or end + shift < at or last == first):
                end += int(self.chars[size + last])
                last += 1
            if last >= size:
                end = total
            while at < end + shift:
                found = counter.pattern.match(changed, at)
                pieces.append(found.group())
                at = found.end()
            if at == end + shift:
                break
        width = last - first
        counts = list(map(counter.memo.__getitem__, pieces))
        if len(pieces) > 4 * LEAF * width:  # far more text than before: leaves of usual size
            old = [(int(c), int(t)) for c, t in zip(self.chars[size:], self.tokens[size:])]
            added = [(sum(map(len, pieces[i:i + LEAF])), sum(counts[i:i + LEAF])) for i in range(0, len(pieces), LEAF)]
            tree = Tree.of_leaves([x for x in old[:first] + added + old[last:] if x[0]])
            return tree, changed, sum(counts)
        cuts = [len(pieces) * i // width for i in range(width + 1)]
        self.set_leaves(first, [(sum(map(len, pieces[a:b])), sum(counts[a:b])) for a, b in zip(cuts, cuts[1:])])
        return self, changed, sum(counts)


_held: dict = {}


def _counter(make: Callable[[], Counter]) -> Counter:
    key = getattr(make, "key", make)
    if key not in _held:
        _held[key] = make()
    return _held[key]


class TiktokenCounter:
    """Makes the counter of a rank file and its pattern, once per worker."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern, self.key = path, pattern, (path, pattern)

    def __call__(self) -> Counter:
        import base64

        import tiktoken

        with open(self.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return Counter(self.pattern, lambda piece: len(encoding.encode_ordinary(piece)))


def build_trees(docs: DataFrame, make: Callable[[], Counter]) -> DataFrame:
    """doc_id, text, tree, n_tokens of every row of ``docs`` (doc_id, text; an array column
    ``edits`` is kept, more columns are ignored). Null text counts as empty; an empty text has
    an empty tree. A text of any length is one row. An empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(make)
        for batch in batches:
            trees = [Tree.of_text(t or "", counter) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, _trees(trees), pa.array([t.n_tokens for t in trees], pa.int64())], [*batch.schema.names, "tree", "n_tokens"])

    kept = docs.select("doc_id", "text", *(["edits"] if "edits" in docs.columns else []))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{schema}, tree {TREE}, n_tokens bigint")


def _trees(trees: list[Tree]) -> pa.Array:
    ends = pa.array(np.concatenate([[0], np.cumsum([len(t.chars) for t in trees])]).astype(np.int32))
    flat = lambda xs: pa.array(np.concatenate(xs) if xs else np.zeros(0), pa.int32())
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(ends, flat([getattr(t, k) for t in trees]).cast(pa.int32())) for k in ("chars", "tokens")], ["chars", "tokens"])


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text or trees) with their ``edits``: rows (doc_id, edit_no, start, length,
    replacement) gathered per document in order of edit_no. A null id matches a null id."""
    gathered = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(
        "edit_no", "start", "length", "replacement"))).alias("edits")).withColumnRenamed("doc_id", "e_id")
    return docs.join(gathered, docs["doc_id"].eqNullSafe(gathered["e_id"]), "left").drop("e_id")


def apply_edits(trees: DataFrame, make: Callable[[], Counter]) -> DataFrame:
    """Trees after their ``edits`` (array of edit_no, start, length, replacement; later ones see the
    text the earlier left). Returns doc_id, text, tree, n_tokens, n_recounted (tokens counted again).

    Places beyond the text count as its end; null places count as 0, a null replacement as empty;
    null or no edits leave all as it was.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(make)
        for batch in batches:
            texts, out, again = [], [], []
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("text", "tree", "edits")]
            chars, tokens = columns[1].field("chars"), columns[1].field("tokens")
            for i in range(batch.num_rows):
                text = columns[0][i].as_py() or ""
                tree = Tree(chars[i].values.to_numpy().astype(np.int64), tokens[i].values.to_numpy().astype(np.int64))
                recounted = 0
                for e in sorted(columns[2][i].as_py() or [], key=lambda e: (e["edit_no"] is not None, e["edit_no"] or 0)):
                    tree, text, n = tree.edit(text, e["start"] or 0, e["length"] or 0, e["replacement"] or "", counter)
                    recounted += n
                texts.append(text), out.append(tree), again.append(recounted)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(texts, pa.string()), _trees(out),
                 pa.array([t.n_tokens for t in out], pa.int64()), pa.array(again, pa.int64())],
                ["doc_id", "text", "tree", "n_tokens", "n_recounted"])

    kind = trees.schema["doc_id"].dataType.simpleString()
    return trees.select("doc_id", "text", "tree", "edits").mapInArrow(
        run, f"doc_id {kind}, text string, tree {TREE}, n_tokens bigint, n_recounted bigint")
