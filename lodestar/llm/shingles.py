"""Vectorised word shingles: every document of an Arrow batch becomes a sorted set of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from lodestar.llm.common import mix, text_chunks

_RNG = np.random.Generator(np.random.PCG64(20240229))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Tells a block's place in its word, and a word's length.
_STEP, _LONG = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SEATS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Text bytes handled at once; a longer document is handled alone.
CHUNK = 1 << 20


def word_hashes(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, first word's index by document).

    A word is hashed by blocks of eight bytes, each scrambled with its place.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    b = np.frombuffer(raw.translate(_LOWER), np.uint8)
    solid = ~_SPACE[b]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False  # a document's first byte starts a word
    starts = np.flatnonzero(solid & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero(solid)
    first = np.searchsorted(at, starts)  # each word's first byte among the words' bytes
    length = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, length)
    blocks = np.flatnonzero(place & 7 == 0)
    value = np.add.reduceat(b[at].astype(np.uint64) << (8 * (place & 7)).astype(np.uint64), blocks)
    # scrambled with its place before it is added: sums of powers would be equal for words that anyone can build
    value = mix(mix(value) ^ (place[blocks] >> 3).astype(np.uint64) * _STEP)
    h = mix(np.add.reduceat(value, np.searchsorted(blocks, first)) + length.astype(np.uint64) * _LONG)
    return h, np.searchsorted(starts, offsets)


def shingle_sets(raw: bytes, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, offsets by document, words by document): each document's distinct shingles in ascending order.

    A document with fewer words than the width has its whole word sequence as one shingle, without words none.
    """
    docs = len(offsets) - 1
    w, at = word_hashes(raw, offsets)
    words = np.diff(at)
    short = (words > 0) & (words < width)
    full = np.where(words >= width, words - width + 1, 0)
    m = len(w) - width + 1
    sets: list[np.ndarray] = [np.zeros(0, np.uint64)]
    size = np.zeros(docs, np.int64)
    if m > 0:
        g = w[:m] * _SEATS[0]
        for k in range(1, width):
            g += w[k : m + k] * _SEATS[k]
        g = mix(g)
    for d in np.flatnonzero((full > 0) | short):
        if short[d]:
            seq = w[at[d] : at[d + 1]]
            s = mix(np.sum(seq * _SEATS[8 : 8 + len(seq)], keepdims=True) + _SEATS[40 + len(seq) : 41 + len(seq)])
        else:
            s = np.sort(g[at[d] : at[d] + full[d]])
            if len(s) > 1 and (same := s[1:] == s[:-1]).any():
                s = s[np.concatenate(([True], ~same))]
        size[d] = len(s)
        sets.append(s)
    return np.concatenate(sets), np.concatenate(([0], np.cumsum(size))), words


def batch_sets(column, width: int):
    """shingle_sets over a column of texts, chunk by chunk: yields (first row, hashes, offsets)."""
    for lo, raw, offsets in text_chunks(column, CHUNK):
        hashes, at, _ = shingle_sets(raw, offsets, width)
        yield lo, hashes, at
