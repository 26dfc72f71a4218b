"""Vectorised words of whole texts, on the UTF-8 bytes of Arrow columns.

Nulls are empty texts. Words never cross texts. Memory is a small multiple of a block of texts (BLOCK_BYTES, or one
longer text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE_CODES = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
#: Separators of plain words: space and 0x09-0x0D. Of folded words: all ASCII but letters and digits.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse mod 2**64 for i < n."""
    if len(_powers["up"]) < n:
        m = max(n, BLOCK_BYTES + (1 << 16))
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(m, base, U)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Sums S with S[0] = 0; span_hash reads the hash of any span from them."""
    up, _ = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, U)
    np.cumsum(codes * up[:-1], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return (sums[end] - sums[start]) * down[start]


@dataclass
class Words:
    """Words of a block of texts: hashes, byte spans, and the text that each is in."""

    raw: np.ndarray
    offsets: np.ndarray
    sums: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), self.counts)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text and first word of each k-word window; a text of 1 to k-1 words is one shorter window."""
        n, counts = len(self.hashes), self.counts
        mixed = mix(self.hashes)
        padded = np.concatenate([mixed, np.zeros(k, U)])
        text = self.text_of
        left = self.first[1:][text] - np.arange(n)
        total = np.zeros(n, U)
        for j in range(k):
            total = total * U(0xFF51AFD7ED558CCD) + np.where(left > j, padded[j : j + n], U(j))
        keep = (left >= k) | ((counts[text] < k) & (np.arange(n) == self.first[:-1][text]))
        at = np.flatnonzero(keep)
        return mix(total[at]), text[at], at


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of a column, not copied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column


def filled(column: pa.Array) -> pa.Array:
    """As large_string without nulls."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large_string column and the offsets of its texts in them."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Filled slices of about size bytes, with the number of the first row of each. Only a slice is copied at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + size, "right")))
        yield at, filled(column.slice(at, to - at))
        at = to


def words(column: pa.Array, separators: np.ndarray = SPACES, fold: str = "") -> Words:
    """fold: '' keeps case, 'ascii' lowers A-Z, 'full' lowers all letters."""
    if fold == "full":
        column = pc.utf8_lower(column)
    raw, offsets = raw_bytes(column)
    if fold == "ascii":
        table = np.arange(256, dtype=np.uint8)
        table[65:91] += 32
        raw = table[raw]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~separators[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    now, before = inside[1:].astype(bool), inside[:-1].astype(bool)
    start = np.flatnonzero(now & (edge | ~before))
    end = np.flatnonzero(before & (edge | ~now))
    sums = prefix_hashes(_BYTE_CODES[raw])
    return Words(raw, offsets, sums, start, end, span_hash(sums, start, end), np.searchsorted(start, offsets))
