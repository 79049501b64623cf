"""Array-at-a-time tokenising of UTF-8 text: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.

A batch of texts is one byte array with document offsets. Words are found by table look-up and
hashed eight bytes at a time, so no Python object is made per word. Every step mixes the next eight
bytes into the hash so far by a bijection that is not linear, so what two structured words have in
common does not carry over into their hashes; two different words collide with probability about
2**-64 per pair. Where that is not enough ``same`` compares the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK = 500_000  # bytes handled at once; one longer text is still handled whole
LONG = 256  # bytes of a range from which on it is hashed by itself
STEPS = 16  # neighbours tried before a hash is searched for

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each text; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offs - offs[0]


def chunks(offs: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes, one document at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each document the index of its first word (one more at the end)."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offs), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True  # a document begins or ends here
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offs)


def lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[data]


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; beyond the end zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))


def _blocks(view: np.ndarray, s: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from each ``s`` on, those beyond ``left`` as zeros."""
    cut = (np.uint64(8) - np.minimum(left, 8).astype(np.uint64)) * np.uint64(8)
    return view[s] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> cut)


def span_hash(data: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the bytes of each range from ``s`` to ``e``; an empty range has one too."""
    size = (e - s).astype(np.int64)
    with np.errstate(over="ignore"):
        out = mix(size.astype(np.uint64) * _STEP + np.uint64(seed + 1))
    if not len(data):
        return out
    view = eights(data)
    some = np.flatnonzero((size > 0) & (size <= LONG))
    at = 0
    while len(some):
        out[some] = mix(out[some] ^ _blocks(view, s[some] + at, size[some] - at))
        at += 8
        some = some[size[some] > at]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[s[i] : e[i]].tobytes(), seed)
    return out


def same(data: np.ndarray, s: np.ndarray, e: np.ndarray, other: np.ndarray, s2: np.ndarray, e2: np.ndarray) -> np.ndarray:
    """Whether each range of ``data`` holds the bytes of its range of ``other``."""
    size = e - s
    out = size == e2 - s2
    if not len(data) or not len(other):
        return out
    view, view2 = eights(data), eights(other)
    some = np.flatnonzero(out & (size > 0) & (size <= LONG))
    at = 0
    while len(some):
        left = size[some] - at
        like = _blocks(view, s[some] + at, left) == _blocks(view2, s2[some] + at, left)
        out[some[~like]] = False
        at += 8
        some = some[like]
        some = some[size[some] > at]
    for i in np.flatnonzero(out & (size > LONG)).tolist():
        out[i] = bool((data[s[i] : e[i]] == other[s2[i] : e2[i]]).all())
    return out


class Places:
    """Finds hashes in a sorted array by their leading bits, which are as good as random. A copy sent to a task is indexed there."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = len(keys).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        n = np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits)
        self.first = np.minimum(np.cumsum(n) - n, max(len(keys) - 1, 0)).astype(np.int32)

    def __reduce__(self):
        return Places, (self.keys,)

    def find(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(hashed), np.int64), np.zeros(len(hashed), bool)
        at = self.first[(hashed >> self.shift).astype(np.int64)].astype(np.int64)
        found = self.keys[at]
        there = found == hashed
        some = np.flatnonzero(found < hashed)
        for _ in range(STEPS):
            if not len(some):
                return at, there
            at[some] = np.minimum(at[some] + 1, len(self.keys) - 1)
            found = self.keys[at[some]]
            there[some] = found == hashed[some]
            some = some[(found < hashed[some]) & (at[some] < len(self.keys) - 1)]
        at[some] = np.minimum(np.searchsorted(self.keys, hashed[some]), len(self.keys) - 1)
        there[some] = self.keys[at[some]] == hashed[some]
        return at, there


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each lower-cased word, and the index of each document's first word."""
    s, e, first = spans(data, offs)
    return span_hash(lower(data), s, e), first


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of one document's k-word shingles; fewer words make one shingle, none make none."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(k, n)
    total = np.full(n - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            total = total * np.uint64(0xD1342543DE82EF95) + hashes[i : n - width + 1 + i]
    return np.unique(mix(total))
