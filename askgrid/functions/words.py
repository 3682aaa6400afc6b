"""Words of lower-cased texts as 64-bit hashes, cut with numpy inside tasks."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa

from askgrid.functions.text import WHITESPACE

# The bytes of each white space character above ASCII, and what a byte may be:
# 1 white space, 2 the first byte of such a character.
WIDE_SPACES = tuple(c.encode() for c in map(chr, range(0x80, 0x3001)) if re.fullmatch(WHITESPACE, c))
KINDS = np.zeros(256, np.uint8)
KINDS[[b for b in range(128) if re.fullmatch(WHITESPACE, chr(b))]] = 1
KINDS[[w[0] for w in WIDE_SPACES]] = 2
# The lowest bytes of a number, by how many.
LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
# Longer words are hashed one by one.
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to white space."""
    kinds = KINDS[data]
    space, at = kinds == 1, np.flatnonzero(kinds == 2)
    if len(at):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        three = sum(padded[at + k].astype(np.uint32) << np.uint32(8 * k) for k in range(3))
        for wide in WIDE_SPACES:
            found = at[three & np.uint32(LOWEST[len(wide)]) == int.from_bytes(wide, "little")]
            for k in range(len(wide)):
                space[found + k] = True
    return space


def distinct_word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the distinct words between white space of each text, sorted, one text after the
    other, and where each text's begin and the last ones end. A null has none."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    space, border = _spaces(data), np.zeros(len(data) + 1, bool)
    border[ends] = True
    before, after = border.copy(), border
    before[1:] |= space
    after[:-1] |= space
    first = np.flatnonzero(~space & before[:-1])
    size = np.flatnonzero(~space & after[1:]) + 1 - first
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    hashes = mix((eight[first] & LOWEST[np.minimum(size, 8)]) + mix(size.astype(np.uint64)))
    more, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(more):
        left = size[more] - done
        part = mix((eight[first[more] + done] & LOWEST[np.minimum(left, 8)]) + np.uint64(done))
        hashes[more] = mix(hashes[more] * np.uint64(0x9E3779B97F4A7C15) ^ part)
        done += 8
        more = more[left > 8]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        word = data[first[i]:first[i] + size[i]].tobytes()
        hashes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    begins = np.searchsorted(first, ends)
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
        hashes[a:b].sort()
    distinct = np.ones(len(hashes), bool)
    distinct[1:] = hashes[1:] != hashes[:-1]
    distinct[begins[begins < len(hashes)]] = True
    return hashes[distinct], np.concatenate([[0], np.cumsum(distinct)])[begins]
