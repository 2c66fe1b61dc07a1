"""Flat numpy views of Arrow string columns, shared by the text operators.

Every function works on one Arrow batch inside a Spark task; nothing here knows about Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


#: A random-looking 64-bit value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
#: ASCII white space: blank and the characters 9 to 13.
IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of the first i values, each times its power of the base, for every i; for span_hashes()."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=total[1:])
    return total


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of values[s:e] for every span, by one prefix sum over the whole array (`total`, where it is known)."""
    if not len(starts):
        return np.empty(0, np.uint64)
    total = prefix_sums(values) if total is None else total
    return mix((total[ends] - total[starts]) * powers(len(values) + 1)[1][starts])


def spread(values: np.ndarray, offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[offsets[p]:offsets[p + 1]] of every pick after one another, and where each begins (one more at the end)."""
    sizes = (offsets[1:] - offsets[:-1])[picks]
    out = np.zeros(len(picks) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    at = np.repeat(offsets[:-1][picks] - out[:-1], sizes)
    at += np.arange(out[-1])
    return values[at], out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 row offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = 2_000_000):
    """(first row, rows) of consecutive slices of about `most` bytes; a longer row is a slice of its own."""
    if not len(column):
        return
    _, offsets = utf8(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last - first
        first = last


class Words:
    """The words (runs of other bytes than ASCII white space) of a batch of texts.

    starts, ends: byte positions in raw; hashes: one 64-bit value a word; rows: the n + 1 word offsets of the
    texts. Letters A-Z count as lower case when `lower` is set. `part` may name other bytes that words consist of.
    """

    def __init__(self, column: pa.Array, lower: bool = True, part: np.ndarray | None = None):
        self.raw, self.offsets = utf8(column)
        data = _LOWER[self.raw] if lower else self.raw
        solid = ~IS_SPACE[data] if part is None else part[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.offsets] = True
        before = np.empty(len(data), bool)
        after = np.empty(len(data), bool)
        if len(data):
            before[0], after[-1] = False, False
            before[1:], after[:-1] = solid[:-1], solid[1:]
        self.starts = np.flatnonzero(solid & (~before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.values = BYTE_VALUE[data]
        self.total = prefix_sums(self.values)
        self.hashes = span_hashes(self.values, self.starts, self.ends, self.total)
        self.rows = np.searchsorted(self.starts, self.offsets)


def text_hash(text: str) -> int:
    """The hash that Words gives a word with these bytes."""
    data = np.frombuffer(text.encode(), np.uint8)
    return int(span_hashes(BYTE_VALUE[data], np.array([0]), np.array([len(data)]))[0])


class Lookup:
    """Which of many 64-bit hashes are keys of a small table: a bit map first, binary search for what passes it."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys.astype(np.uint64))
        self.map = np.zeros(1 << 20, bool)
        self.map[self.keys >> np.uint64(44)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in hashes, positions in keys) of the hits."""
        at = np.flatnonzero(self.map[hashes >> np.uint64(44)])
        if not len(self.keys):
            return at, at
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        hit = self.keys[key] == hashes[at]
        return at[hit], key[hit]


def shingles(hashes: np.ndarray, rows: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-word shingles of each text, ascending in it, and the text offsets.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    counts = rows[1:] - rows[:-1]
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    owner = np.repeat(np.arange(len(counts)), sizes)
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(sizes, out=first[1:])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - rows[:-1], sizes)
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    last = rows[1:][owner]
    value = np.zeros(len(at), np.uint64)
    short = (counts < n)[owner]
    for k in range(n):
        part = padded[np.minimum(at + k, len(padded) - 1)]
        if short.any():
            part = np.where(at + k < last, part, np.uint64(0))
        value = value * _BASE + part
        value ^= value >> np.uint64(32)
    value = mix(value)
    order = np.lexsort((value, owner)) if len(counts) > 1 else np.argsort(value)
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    if len(value):
        fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(np.bincount(owner[fresh], minlength=len(counts)), out=out[1:])
    return value[fresh], out
