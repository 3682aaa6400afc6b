"""Ids of a word-end BPE tokenizer, word by word.

The tokenizer drops white space and treats what stands between blanks apart from the rest. A text
of Latin letters is lower-cased and split into pre-tokens here, and only those not in a memo go
through the model. Any other text is the ids of its blank-separated chunks in a row; they
have a memo of their own, and those that are not Latin go through the whole tokenizer.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

MEMO = 400_000  # pre-tokens
CHUNKS = 100_000
# Letters and signs that Unicode normalisation leaves as they are, and blanks.
PLAIN = re.compile("[\\t-\\r\\x20-\\x7e¡-ſ]*")


def _class(kind: str) -> str:
    """The plain signs of a Unicode category, as the inside of a character class."""
    return "".join(re.escape(chr(i)) for i in range(ord("ſ") + 1) if unicodedata.category(chr(i))[0] == kind)


class WordBpe:
    def __init__(self, path: str, memo: int = MEMO, chunks: int = CHUNKS):
        self.tokenizer = Tokenizer.from_file(path)
        setup = json.loads(self.tokenizer.to_str())
        self.special = tuple(t["content"] for t in setup["added_tokens"])
        splits = [p["pattern"]["Regex"] for p in setup["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        steps = [n["type"] for n in setup["normalizer"]["normalizers"]]
        # The short way needs exactly these steps; another tokenizer goes the long way.
        self.short = steps == ["NFC", "Replace", "Lowercase"] and len(splits) == 1
        # in plain text the letters and digits of the pattern are known signs
        self.split = re.compile(splits[0].replace(r"\p{L}", _class("L")).replace(r"\p{N}", _class("N"))) if self.short else None
        signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = {}
        for i in range(256):  # the sign that stands for each byte
            if i < 128:
                self.table[i] = signs.pre_tokenize_str(chr(i))[0][0]
        for i in range(0x80, 0x800):
            for byte, sign in zip(chr(i).encode(), signs.pre_tokenize_str(chr(i))[0][0]):
                self.table[byte] = sign
        self.model = self.tokenizer.model
        self.tokens, self.chunks = _Memo(self.token, memo), _Memo(self.chunk, chunks)

    def token(self, token: str) -> bytes:
        shown = token if token.isascii() else token.encode().decode("latin-1").translate(self.table)
        return np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()

    def is_plain(self, text: str) -> bool:
        return self.short and PLAIN.fullmatch(text) is not None and not ("<|" in text and any(s in text for s in self.special))

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.tokens.__getitem__, self.split.findall(text.lower())))

    def chunk(self, raw: bytes) -> bytes:
        text = raw.decode()
        if self.is_plain(text):
            return self.plain(text)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a UTF-8 text."""
        shown = text.decode()
        if self.is_plain(shown):
            return self.plain(shown)
        return b"".join(map(self.chunks.__getitem__, text.split()))


class _Memo(dict):
    """Results of a function by argument; emptied when it holds ``limit`` of them."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        got = self[key] = self.make(key)
        return got
