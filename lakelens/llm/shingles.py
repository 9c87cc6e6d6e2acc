"""Word shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1  # odd, so that it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX_A
    x ^= x >> np.uint64(27)
    x *= _MIX_B
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
#: A random 64-bit number for each byte, after A-Z are lowered.
_BYTE = mix(_LOWER.astype(np.uint64) * _GOLDEN + _GOLDEN)


class _Powers:
    """Powers of the base and of its inverse, as long as the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        if len(self.up) <= n:
            size = 1 << int(n).bit_length()
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and n + 1 offsets; null is empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and the n + 1 offsets of the texts' words.

    Words are maximal runs of bytes other than space and 0x09-0x0D; A-Z count
    as a-z. A text's end also ends a word.
    """
    word = ~_SPACE[raw]
    before = np.empty(len(raw) + 1, bool)
    before[0], before[1:] = False, word
    cuts = offsets[:-1][offsets[:-1] < len(raw)]
    before_start = before[:-1].copy()
    before_start[cuts] = False
    starts = np.flatnonzero(word & ~before_start)
    after = np.empty(len(raw), bool)
    if len(raw):
        after[:-1], after[-1] = word[1:], False
        inner = cuts[cuts > 0]
        after[inner - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    up, down = powers.upto(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[raw] * up[:len(raw)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def shingle_sets(column: pa.Array, size: int, powers: _Powers | None = None) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text of fewer words than ``size`` has one shingle of all its words; one
    without words, or null, has none.
    """
    raw, offsets = text_bytes(column)
    with np.errstate(over="ignore"):
        words, at = word_hashes(raw, offsets, powers or _Powers())
        return [distinct_shingles(words[a:b], size) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def distinct_shingles(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(n, size)
    out = words[:n - k + 1].copy()
    for i in range(1, k):
        out *= _GOLDEN
        out += words[i:n - k + 1 + i]
    return np.unique(mix(out + np.uint64(k)))


Powers = _Powers
