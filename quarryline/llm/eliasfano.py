"""Elias-Fano sequences with vectorised access and search, and files of arrays that can be memory-mapped."""

from __future__ import annotations

import json
import mmap

import numpy as np

from .text import U

#: Place of the k-th set bit of a byte, at byte * 8 + k.
_PLACE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.int64).ravel()
_EACH, _HIGH = U(0x0101010101010101), U(0x8080808080808080)


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray, ones: bool) -> np.ndarray:
    """Place of the k-th (from 0) bit that is set (or unset); before: how many such bits come before each word.

    A word's eight bytes are counted and compared side by side in one 64-bit number.
    """
    word = np.searchsorted(before, k, "right") - 1
    left = (k - before[word]).astype(U)
    bits = words[word] if ones else ~words[word]
    count = bits - ((bits >> U(1)) & U(0x5555555555555555))
    count = (count & U(0x3333333333333333)) + ((count >> U(2)) & U(0x3333333333333333))
    upto = ((count + (count >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * _EACH
    # the high bit of each byte whose sum so far is no more than left
    passed = ((left * _EACH | _HIGH) - upto) & _HIGH
    shift = ((passed >> U(7)) * _EACH >> U(56)) * U(8)
    inside = left - ((upto << U(8) >> shift) & U(0xFF))
    at = ((bits >> shift) & U(0xFF)) * U(8) + inside
    return word.astype(np.int64) * 64 + shift.astype(np.int64) + _PLACE[at.astype(np.int64)]


class EliasFano:
    """A non-decreasing sequence of n numbers below universe, in about n (2 + log2(universe / n)) bits."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones, self.zeros = n, low_bits, low, high, ones, zeros

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        n, values = len(values), np.asarray(values, U)
        low_bits = max(0, (universe // max(1, n)).bit_length() - 1)
        high_at = (values >> U(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(((n + (universe >> low_bits) + 2) // 64 + 1) * 64, np.uint8)
        bits[high_at] = 1
        high = np.packbits(bits, bitorder="little").view(U)
        low = np.zeros((n * low_bits) // 64 + 2, U)
        if low_bits:
            at = np.arange(n, dtype=np.int64) * low_bits
            part = values & U((1 << low_bits) - 1)
            word, shift = at >> 6, (at & 63).astype(U)
            np.bitwise_or.at(low, word, part << shift)
            over = np.flatnonzero(shift + U(low_bits) > U(64))
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U(64) - shift[over]))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        zeros = np.arange(len(high), dtype=np.int64) * 64 - ones[:-1]
        return {"shape": np.array([n, low_bits], np.int64), "low": low, "high": high, "ones": ones, "zeros": zeros}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, low_bits = (int(x) for x in arrays[f"{name}.shape"])
        return cls(n, low_bits, *(arrays[f"{name}.{part}"] for part in ("low", "high", "ones", "zeros")))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(U)
        first = self.low[word] >> shift
        second = np.where(shift > U(0), self.low[word + 1] << ((U(64) - shift) & U(63)), U(0))
        return (first | second) & U((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        high = _select(self.high, self.ones, i, True) - i
        return (high.astype(U) << U(self.low_bits)) | self._low(i)

    def find(self, target: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> np.ndarray:
        """Place of each target in [begin, end), or -1: the successor search runs over the few values with its high part."""
        target = np.asarray(target, U)
        high = (target >> U(self.low_bits)).astype(np.int64)
        out = np.full(len(target), -1, np.int64)
        ok = np.flatnonzero(high < len(self.high) * 64 - self.ones[-1] - 1) if self.n else np.zeros(0, np.int64)
        if not len(ok):
            return out
        high = high[ok]
        low = np.where(high > 0, _select(self.high, self.zeros, np.maximum(high - 1, 0), False) - (high - 1), 0)
        top = _select(self.high, self.zeros, high, False) - high
        low = np.maximum(low, begin if np.isscalar(begin) else begin[ok])
        top = np.minimum(top, self.n if end is None else end if np.isscalar(end) else end[ok])
        want = target[ok] & U((1 << self.low_bits) - 1)
        last = top.copy()
        while len(open_ := np.flatnonzero(low < top)):
            mid = (low[open_] + top[open_]) // 2
            less = self._low(mid) < want[open_]
            low[open_[less]] = mid[less] + 1
            top[open_[~less]] = mid[~less]
        there = np.flatnonzero(low < last)
        hit = there[self._low(low[there]) == want[there]]
        out[ok[hit]] = low[hit]
        return out


def quantise(values: np.ndarray) -> dict[str, np.ndarray]:
    """8-bit codes of positive numbers, by equal-count bins of their order, and the bins' geometric means."""
    if not len(values):
        return {"codes": np.zeros(0, np.uint8), "book": np.zeros(256)}
    logs = np.log10(values)
    edges = np.unique(np.quantile(logs, np.linspace(0, 1, 257)[1:-1]))
    codes = np.searchsorted(edges, logs, "left").astype(np.uint8)
    n = np.bincount(codes, minlength=256)
    book = 10 ** (np.bincount(codes, logs, 256) / np.maximum(n, 1))
    return {"codes": codes, "book": book}


def save(uri: str, arrays: dict[str, np.ndarray], attempt: str) -> None:
    """Written to a temporary name and moved, so that a repeated task replaces the same file."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    index, at = {}, 0
    for name, a in arrays.items():
        index[name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(index).encode()
    head += b" " * (-(len(head) + 8) % 64)
    with where.open_output_stream(f"{path}.{attempt}") as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 64))
    where.move(f"{path}.{attempt}", path)


class Arrays(dict):
    """Arrays of a file by name."""

    mapped: mmap.mmap | None = None

    def release(self) -> None:
        """Gives the pages read so far back; what is read again comes from the system's cache."""
        if self.mapped is not None:
            self.mapped.madvise(mmap.MADV_DONTNEED)


def load(uri: str) -> Arrays:
    """Memory-mapped where the folder is a file system of this machine, read whole otherwise."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    if isinstance(where, fs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r")
    else:
        with where.open_input_file(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    index = json.loads(raw[8 : 8 + size].tobytes())
    body = raw[8 + size :]
    out = Arrays({name: np.asarray(body[at : at + n * np.dtype(kind).itemsize]).view(kind) for name, (kind, n, at) in index.items()})
    out.mapped = getattr(raw, "_mmap", None)
    return out
