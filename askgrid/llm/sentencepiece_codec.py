"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a chunk once. At each position its output links
name every piece that ends there; each relaxes the best score of the position from the one where
the piece begins. For a unigram model that is plain Viterbi. A BPE model merges in a fixed
order; there a piece may follow another only if merging the two alone would leave them
so, which leaves one way to every position, and that way is the model's own segmentation.

Where no piece holds a blank behind another sign, segmentations never cross the start of a blank,
and chunks between blanks are looked up in a memo.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from operator import add

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

# What the memos of a worker may hold: bytes of looked-up chunks, and pairs of pieces of some 90 bytes each.
MEMO = 112 << 20
PAIRS = 250_000
SLICE_BYTES = 4 << 20  # text or ids a worker has in hand at a time beside its batch
BLANK = "▁"
NOTHING = -1
UNKNOWN_PENALTY = 10.0


def _model(path: str):
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    return spec


def _bytes_of(texts: list[str], by_byte: dict[int, int]) -> list[bytes]:
    """What each piece stands for in a decoded text."""
    data = [t.replace(BLANK, " ").encode() for t in texts]
    for byte, i in by_byte.items():
        data[i] = bytes([byte])
    return data


def _byte_pieces(spec) -> dict[int, int]:
    return {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == 6}


class Decoder:
    """The bytes of every piece; no automaton, no scores, no memo."""

    def __init__(self, data: list[bytes], prefix: bool):
        self.data, self.prefix = data, prefix

    @classmethod
    def of_model(cls, path: str) -> "Decoder":
        spec = _model(path)
        return cls(_bytes_of([p.piece for p in spec.pieces], _byte_pieces(spec)), spec.normalizer_spec.add_dummy_prefix)

    def decode(self, ids) -> str:
        text = b"".join(map(self.data.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


class Codec:
    def __init__(self, path: str, memo: int = MEMO):
        spec = _model(path)
        self.bpe = spec.trainer_spec.model_type == 2
        if spec.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models have scored pieces")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        norm = spec.normalizer_spec
        self.prefix = norm.add_dummy_prefix
        self.plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        kinds = [p.type for p in spec.pieces]
        texts, scores = [p.piece for p in spec.pieces], [p.score for p in spec.pieces]
        usable = [i for i, k in enumerate(kinds) if k in (1, 4)]
        self.setup(texts, scores, usable, _byte_pieces(spec), next((i for i, k in enumerate(kinds) if k == 2), 0), memo)

    @classmethod
    def of_pieces(cls, pieces: list[tuple[str, float]], bpe: bool = False, memo: int = MEMO) -> "Codec":
        """A codec over given (piece, score) pairs; id 0 stands for what no piece covers."""
        own = cls.__new__(cls)
        own.bpe, own.prefix, own.plain, own.library = bpe, True, True, None
        own.setup(["<unk>", *[p for p, _ in pieces]], [0.0, *[s for _, s in pieces]], list(range(1, len(pieces) + 1)), {}, 0, memo)
        return own

    def setup(self, texts, scores, usable, by_byte, unknown, memo) -> None:
        self.texts, self.scores, self.by_byte, self.unknown = texts, scores, by_byte, unknown
        self.lengths = [len(t) for t in texts]
        self.id_of = {texts[i]: i for i in usable}
        order = sorted(usable, key=lambda i: (-scores[i], i))
        self.rank = {i: r for r, i in enumerate(order)}
        self.automaton = ahocorasick.Automaton()
        for i in usable:
            self.automaton.add_word(texts[i], i)
        self.automaton.make_automaton()
        # Runs of blanks share one lowest score: the library joins them last, from the left.
        self.runs = sorted((len(t) for t in self.id_of if t.strip(BLANK) == "" and len(t) > 1), reverse=True)
        self.separable = not any(BLANK in t.lstrip(BLANK) for t in self.id_of)
        self.worst = min((scores[i] for i in usable), default=0.0) - UNKNOWN_PENALTY
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}  # by left * pieces + right
        self.pieces = len(texts)
        self.chunks = _Chunks(self.whole, memo)
        self.chunk_at = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.decode = Decoder(_bytes_of(texts, by_byte), self.prefix).decode
        self.signs = {t for t in self.id_of if len(t) == 1}
        self.inner = {a + b for t in self.id_of for a, b in zip(t, t[1:])}
        self.inner |= {BLANK + BLANK}  # runs of blanks are joined last, so they stay with their word

    # -- order of merges -------------------------------------------------------------------
    def half(self, piece: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes this one; None for a single sign."""
        if piece not in self.halves:
            parts = [self.id_of.get(c) for c in self.texts[piece]]
            if len(parts) < 2 or None in parts:
                self.halves[piece] = None
            else:
                while len(parts) > 2:
                    options = [(self.rank[m], i, m) for i in range(len(parts) - 1)
                               if (m := self.id_of.get(self.texts[parts[i]] + self.texts[parts[i + 1]])) is not None and m != piece]
                    if not options:
                        break
                    _, i, merged = min(options)
                    parts[i:i + 2] = [merged]
                self.halves[piece] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[piece]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the text of both alone ends in these two pieces.

        Both are undone, the later merge first; a piece that spans the border and comes
        before what is undone would have been taken in their place.
        """
        key = left * self.pieces + right
        if key not in self.pairs:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = self._may_follow(left, right)
        return self.pairs[key]

    def _may_follow(self, left: int, right: int) -> bool:
        bound = len(self.rank)
        while True:
            merged = self.id_of.get(self.texts[left] + self.texts[right])
            if merged is not None and self.rank[merged] < bound:
                return False
            a, b = self.half(left), self.half(right)
            if a is None and b is None:
                return True
            # of two equal merges the left one comes first, so the right one is undone first
            if b is None or (a is not None and self.rank[left] > self.rank[right]):
                bound, left = self.rank[left], a[1]
            else:
                bound, right = self.rank[right] + 1, b[0]

    # -- encoding --------------------------------------------------------------------------
    def viterbi(self, chunk: str) -> list[int]:
        """Ids of a chunk: one pass of the automaton, best score at each position."""
        gaps = not self.signs.issuperset(chunk)
        if self.bpe and not gaps:
            return self.one_way(chunk)
        n = len(chunk)
        best, last, came = [None] * (n + 1), [NOTHING] * (n + 1), [0] * (n + 1)
        best[0], done = 0.0, 0
        bpe, follows, worst, lengths, scores = self.bpe, self.may_follow, self.worst, self.lengths, self.scores
        for end, piece in self.automaton.iter(chunk):
            at, start = end + 1, end + 1 - lengths[piece]
            while gaps and done < end:  # a sign in no piece stands alone
                done += 1
                if best[done] is None:
                    best[done], came[done] = best[done - 1] + worst, done - 1
            if bpe and (last[at] >= 0 or last[start] >= 0 and not follows(last[start], piece)):
                continue
            reached = best[start] + scores[piece]
            if best[at] is None or reached > best[at]:
                best[at], last[at], came[at] = reached, piece, start
        while gaps and done < n:
            done += 1
            if best[done] is None:
                best[done], came[done] = best[done - 1] + worst, done - 1
        out, at = [], n
        while at:
            if last[at] != NOTHING:
                out.append(last[at])
            elif self.by_byte:
                out += [self.by_byte[b] for b in reversed(chunk[came[at]:at].encode())]
            else:
                out.append(self.unknown)
            at = came[at]
        return out[::-1]

    def one_way(self, chunk: str) -> list[int]:
        """As viterbi, for a merge model and signs that are all pieces: there is one way to each
        position, so the first piece that may end there is the best and no score is needed."""
        last, pairs, pieces, lengths = [NOTHING] * (len(chunk) + 1), self.pairs, self.pieces, self.lengths
        for end, piece in self.automaton.iter(chunk):
            if last[end + 1] >= 0:
                continue
            start = end + 1 - lengths[piece]
            if start:
                ok = pairs.get(last[start] * pieces + piece)
                if not (self.may_follow(last[start], piece) if ok is None else ok):
                    continue
            last[end + 1] = piece
        out, at = [], len(chunk)
        while at:
            out.append(last[at])
            at -= lengths[last[at]]
        return out[::-1]

    def parts(self, chunk: str) -> list[str]:
        """The chunk, cut where no piece holds the two signs side by side."""
        inner, at, out = self.inner, 0, []
        for i, two in enumerate(map(add, chunk, chunk[1:]), 1):
            if two not in inner:
                out.append(chunk[at:i])
                at = i
        out.append(chunk[at:])
        return out

    def whole(self, chunk: str) -> bytes:
        parts = self.parts(chunk)
        if len(parts) == 1:
            return array("i", self.chunk(chunk)).tobytes()
        return b"".join(map(self.chunks.__getitem__, parts))

    def chunk(self, chunk: str) -> list[int]:
        if not (self.bpe and self.runs and chunk.startswith(BLANK * 2)):
            return self.viterbi(chunk)
        word = chunk.lstrip(BLANK)
        blanks = len(chunk) - len(word)
        ids = self.viterbi(BLANK + word) if word else []
        if not ids or ids[0] != self.id_of.get(BLANK):
            blanks -= bool(ids)
        else:
            ids = ids[1:]
        head = []
        while blanks:
            size = next((r for r in self.runs if r <= blanks), 1)
            head.append(self.id_of[BLANK * size])
            blanks -= size
        return head + ids

    def normal(self, text: str) -> str:
        if not self.plain:
            return self.library.normalize(text)
        return (BLANK if self.prefix and text else "") + text.replace(" ", BLANK)

    def encode(self, text: str) -> np.ndarray:
        shown = self.normal(text)
        chunks = self.chunk_at.findall(shown) if self.separable else [shown] if shown else []
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, chunks)), "<i4")


class _Chunks(dict):
    """Ids of chunks, emptied when they take about ``limit`` bytes."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.size = make, limit, 0

    def __missing__(self, chunk: str) -> bytes:
        got = self.make(chunk)
        if len(chunk) <= 64:
            size = 200 + 2 * len(chunk) + len(got)  # two objects and their place in the table
            if self.size + size > self.limit:
                self.clear()
                self.size = 0
            self[chunk] = got
            self.size += size
        return got


_held: dict[tuple, object] = {}


def _once(make, path: str):
    """One codec or decoder per worker and model."""
    if (make, path) not in _held:
        _held[make, path] = make(path)
    return _held[make, path]


def _slices(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about SLICE_BYTES."""
    part = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def encode(docs: DataFrame, path: str, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, ids (array<int>) and the columns ``keep`` names, of every row of ``docs`` (doc_id, text).

    Null and empty text: no ids. Texts of any length are read in chunks. Repeated rows are encoded
    each, null ids carried; other columns are ignored. An empty table gives no rows.
    """
    names = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _once(Codec, path)
        for whole in batches:
            for batch in _slices(whole, pc.fill_null(pc.binary_length(whole.column(0)), 0).to_numpy(zero_copy_only=False)):
                ids = [c.encode(t.as_py() or "") for t in batch.column(0)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists], [*names, "ids"])

    return docs.select("text", *names).mapInArrow(run, f"{_schema(docs, names)}, ids array<int>")


def decode(encoded: DataFrame, path: str, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns ``keep`` names, ids and text of every row of ``encoded`` (doc_id, ids).
    Null or no ids: empty text."""
    names = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _once(Decoder.of_model, path)
        for whole in batches:
            for batch in _slices(whole, 4 * pc.fill_null(pc.list_value_length(whole.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)):
                lists = batch.column(0)
                values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy().tolist()
                texts = [c.decode(values[a:b].tolist()) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists, pa.array(texts, pa.string())], [*names, "ids", "text"])

    return encoded.select("ids", *names).mapInArrow(run, f"{_schema(encoded, names)}, ids array<int>, text string")


def _schema(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)
