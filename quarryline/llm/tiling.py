"""Benchmark decontamination by greedy string tiling (running Karp-Rabin).

Words are maximal runs of ASCII letters, digits and all other non-ASCII characters, in small letters. A document and a
benchmark item that share seeds of LEAST words are tiled: the longest unmarked common run is marked in both, again and
again, down to LEAST words. The item leaks if its tiles cover COVERAGE of its words, in whatever order they come.

Only pairs whose shared seeds could reach that coverage are tiled: a tile consists of seeds, so this loses nothing. The
benchmark is dealt to blocks of about BLOCK_CHARS characters in the shared folder. The documents are scanned once a block, and each
task reads that block there, so neither the driver nor a task holds more of the benchmark than a block (or one longer item).

Defined results: items with null text or fewer than LEAST words are never found; null documents are empty and clean;
rows with the same doc_id or item_id each count by themselves; ties between runs of equal length go to the earlier place
in the item, then in the document; empty tables give no rows. Documents are read whole, a long one as a block of its own. Only
doc_id, item_id and the texts are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, row_key, tidy
from .text import MARKS, U, Words, blocks, filled, mix, strings, words

LEAST, COVERAGE = 5, 0.5
FIRST_RUN = 20
BLOCK_CHARS = 8_000_000
SCHEMA = "doc_id long, item_id long, item_words long, covered_words long, coverage double, longest_tile long, tiles array<struct<item_start:int,doc_start:int,length:int>>"
_MODULUS, _FACTOR = (1 << 61) - 1, 0x5BD1E995


def _runs(s: list[int], marked: bytearray, size: int) -> Iterator[tuple[int, int]]:
    """Start and rolling hash of each window of size unmarked words; -1 is a gap."""
    top, h, n = pow(_FACTOR, size - 1, _MODULUS), 0, 0
    for at, word in enumerate(s):
        if word < 0 or marked[at]:
            h = n = 0
            continue
        if n == size:
            h = (h - s[at - size] * top) % _MODULUS
            n -= 1
        h = (h * _FACTOR + word) % _MODULUS
        n += 1
        if n == size:
            yield at - size + 1, h


def tile(item: list[int], text: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (item start, text start, length) of two word lists, longest first. -1 in text matches nothing."""
    done_item, done_text = bytearray(len(item)), bytearray(len(text))
    tiles: list[tuple[int, int, int]] = []

    def free(p: int, t: int) -> int:
        n = 0
        while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] >= 0 and not done_item[p + n] and not done_text[t + n]:
            n += 1
        return n

    size = max(least, FIRST_RUN)
    while True:
        where: dict[int, list[int]] = {}
        for t, h in _runs(text, done_text, size):
            where.setdefault(h, []).append(t)
        found = [(n, p, t) for p, h in _runs(item, done_item, size) for t in where.get(h, ()) if (n := free(p, t)) >= size]
        longest = max(found, default=(0,))[0]
        if longest > 2 * size:
            size = longest
            continue
        while found:
            found.sort(key=lambda x: (-x[0], x[1], x[2]))
            later = []
            for n, p, t in found:
                now = free(p, t)
                if now == n:
                    tiles.append((p, t, n))
                    done_item[p : p + n] = done_text[t : t + n] = b"\1" * n
                elif now >= size:
                    later.append((now, p, t))
            found = later
        if size <= least:
            return sorted(tiles, key=lambda x: (-x[2], x[0], x[1]))
        size = max(least, size // 2)


class Items:
    """Words and seeds of a block of the benchmark."""

    def __init__(self, ids: list, texts: list[str | None], least: int, coverage: float):
        w = words(filled(pa.array(texts, pa.string())), MARKS, "full")
        self.ids, self.least, self.coverage = ids, least, coverage
        self.hashes = [w.hashes[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        seed, self.item, self.place = _seeds(w, least)
        self.place = self.place - w.first[self.item]
        order = np.argsort(seed, kind="stable")
        self.seeds, self.item, self.place = seed[order], self.item[order], self.place[order]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self.seeds >> U(42)] = True

    def leaks(self, w: Words) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """Text, item and tiles of each leak."""
        seed, text, at = _seeds(w, self.least)
        some = np.flatnonzero(self.filter[seed >> U(42)])
        low, high = np.searchsorted(self.seeds, seed[some], "left"), np.searchsorted(self.seeds, seed[some], "right")
        n = high - low
        some, low, n = some[n > 0], low[n > 0], n[n > 0]
        if not len(some):
            return
        hit = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        where = np.repeat(some, n)
        pair = text[where].astype(np.int64) * len(self.ids) + self.item[hit]
        order = np.argsort(pair, kind="stable")
        pair, hit, at = pair[order], hit[order], at[where[order]]
        bounds = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1], [True]]))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            doc, item = divmod(int(pair[a]), len(self.ids))
            mine = self.hashes[item]
            covered = np.zeros(len(mine), bool)
            for j in range(self.least):
                covered[self.place[hit[a:b]] + j] = True
            if covered.sum() < self.coverage * len(mine):
                continue
            tiles = self._tile(mine, w.hashes, np.unique(at[a:b]))
            if sum(x[2] for x in tiles) >= self.coverage * len(mine):
                yield doc, item, [(p, t - int(w.first[doc]), k) for p, t, k in tiles]

    def _tile(self, mine: np.ndarray, every: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
        """Tiles against the runs of the text that the seeds cover.

        Equal runs are as good as each other and no more than len / least tiles fit, so no more copies of a run are kept.
        """
        cut = np.flatnonzero(np.diff(at) > self.least - 1) + 1
        names = {int(h): k for k, h in enumerate(dict.fromkeys(mine.tolist()))}
        text: list[int] = []
        back: list[int] = []
        copies: dict[tuple, int] = {}
        for run in np.split(at, cut):
            a, b = int(run[0]), int(run[-1]) + self.least
            one = tuple(names.get(h, -1) for h in every[a:b].tolist())
            copies[one] = copies.get(one, 0) + 1
            if copies[one] <= len(mine) // self.least:
                text += [*one, -1]
                back += range(a, b + 1)
        return [(p, back[t], n) for p, t, n in tile([names[int(h)] for h in mine.tolist()], text, self.least)]


def _seeds(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of each k-word window."""
    left = np.repeat(w.first[1:], w.counts) - np.arange(len(w.hashes))
    at = np.flatnonzero(left >= k)
    mixed, total = mix(w.hashes), np.zeros(len(at), U)
    for j in range(k):
        total = total * U(0xFF51AFD7ED558CCD) + mixed[at + j]
    return mix(total), w.text_of[at], at


@lru_cache(1)
def _items(uri: str, least: int, coverage: float) -> Items:
    """The block of the benchmark in a folder; none is made for a block without items."""
    from pyarrow import dataset, fs

    where, folder = fs.FileSystem.from_uri(uri)
    if where.get_file_info(folder).type != fs.FileType.Directory:
        return Items([], [], least, coverage)
    rows = dataset.dataset(folder, format="parquet", filesystem=where).to_table(columns=["item_id", "text"]).sort_by([("item_id", "ascending"), ("text", "ascending")])
    return Items(rows["item_id"].to_pylist(), rows["text"].to_pylist(), least, coverage)


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, with_row: bool = False, work: Workspace | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """SCHEMA: a row for each document and each item that leaks into it. with_row: and row, the document's row_key."""
    work = work or Workspace(docs.sparkSession, "tiling")
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-chars // block_chars) or 1
    dealt = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int").alias("block"))
    dealt.repartition(min(parts, 1000), "block").write.partitionBy("block").parquet(work.path("benchmark"))
    out = None
    for k in range(parts):

        def run(batches: Iterator[pa.RecordBatch], uri=f"{work.path('benchmark')}/block={k}") -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()), ("covered_words", pa.int64()), ("coverage", pa.float64()), ("longest_tile", pa.int64()), ("tiles", pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())])))])
            items = _items(uri, least, coverage)
            for batch in batches:
                ids, found = batch.column(0), []
                keys = {"row": batch.column(2)} if with_row else {}
                for at, block in blocks(strings(batch.column(1))):
                    for doc, item, tiles in items.leaks(words(block, MARKS, "full")):
                        n, covered = len(items.hashes[item]), sum(x[2] for x in tiles)
                        found.append({"doc_id": ids[at + doc].as_py(), "item_id": items.ids[item], "item_words": n, "covered_words": covered, "coverage": covered / n, "longest_tile": tiles[0][2], "tiles": [{"item_start": p, "doc_start": t, "length": k} for p, t, k in tiles]} | {n: c[at + doc].as_py() for n, c in keys.items()})
                if found:
                    yield pa.RecordBatch.from_pylist(found, pa.schema([*schema, ("row", pa.int64())]) if with_row else schema)

        part = docs.select("doc_id", "text", *[row_key().alias("row")] * with_row).mapInArrow(tidy(run), SCHEMA + ", row long" * with_row)
        out = part if out is None else out.unionByName(part)
    return out
