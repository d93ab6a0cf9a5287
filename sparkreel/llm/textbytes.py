"""Vectorised word hashing over the UTF-8 bytes of many texts at once.

A block of texts is one byte array.  Words are maximal runs of bytes outside
``[\\x20\\x09-\\x0D]`` (or another set); A-Z are lower-cased.  A word's hash is the polynomial
hash of its bytes modulo 2**64, taken from one running sum, then mixed: no
Python loop touches a word or a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers modulo 2**64 (any odd value gives an invertible base).
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes of text handled at once; bounds the temporary arrays (about 60 times this).
BLOCK_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes between words: the contract's white space, or every ASCII byte that is no letter or digit.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
PUNCTUATED = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants): every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """BASE**i and BASE**-i for i below n; kept for the largest n seen, rounded up, but not sent along with functions that use it."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, U64)

    def __reduce__(self):
        return _Powers, ()

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            up, down = np.ones(size, U64), np.ones(size, U64)
            with np.errstate(over="ignore"):
                up[1:] = U64(BASE)
                down[1:] = U64(BASE_INV)
                self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


_POWERS = _Powers()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, bytes, offsets) over runs of texts of about ``size`` bytes; a longer text is alone."""
    data, offsets = text_bytes(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _pieces(data: np.ndarray, between: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of about BLOCK_BYTES that end between words."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + BLOCK_BYTES)
        if end < n:
            gaps = np.flatnonzero(between[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # a word longer than a piece goes on to its end
                more = np.flatnonzero(between[data[end:]])
                end = end + int(more[0]) if len(more) else n
        yield data[at:end]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first word of each text and the total) of the words of a block."""
    n = len(data)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    if len(offsets) == 2 and n > 2 * BLOCK_BYTES:
        found = np.concatenate([_words(piece, np.array([0, len(piece)]), between)[0] for piece in _pieces(data, between)])
        return found, np.array([0, len(found)])
    return _words(data, offsets, between)


def _words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    up, down = _POWERS.get(n)
    space = between[data]
    solid = ~space
    fresh = np.ones(n, bool)
    fresh[1:] = space[:-1]
    inner = offsets[1:-1]
    fresh[inner[inner < n]] = True  # a text starts a word of its own
    starts = np.flatnonzero(solid & fresh)
    last = np.ones(n, bool)
    last[:-1] = space[1:]
    last[inner[(inner > 0)] - 1] = True
    ends = np.flatnonzero(solid & last)
    sums = np.zeros(n + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum((_LOWER[data].astype(U64) + U64(1)) * up[:n], out=sums[1:])
        hashes = mix((sums[ends + 1] - sums[starts]) * down[starts])
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two words in order."""
    with np.errstate(over="ignore"):
        return mix(a * U64(0xD6E8FEB86659FD93) + (b ^ (b >> U64(29))) * U64(0xA0761D6478BD642F))


def shingle_sets(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingles of each text, sorted within it, and where each text's begin.

    A text of fewer words, but at least one, has its whole sequence as one shingle; one of none is empty.
    """
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    value = hashes.copy()
    with np.errstate(over="ignore"):
        for k in range(1, width):
            m = max(0, len(hashes) - k)
            ahead = np.zeros(len(hashes), U64)
            ahead[:m] = hashes[k:]
            # the running fold of a short text stops at its end, so it covers all its words
            inside = np.zeros(len(hashes), bool)
            inside[:m] = owner[k:] == owner[:m]
            value = np.where(inside, pair_hash(value, ahead), value)
    at = np.arange(len(hashes)) - first[owner]
    keep = (at + width <= counts[owner]) | ((at == 0) & (counts[owner] < width))
    value, owner = value[keep], owner[keep]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(counts) + 1)).astype(np.int64)
