"""Scores of passages from their tokens, a batch of passages at a time.

All that a passage's score needs is in its row and in what the queries ask for, so tokens and scores are never shuffled: a task
holds a batch of passages, and hands on no more than the best of each query.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as P

#: Cells of a dense table of scores (queries by passages of a batch); larger ones are sorted.
CELLS = 8_000_000
#: Scores nearer than this may be equal once they are rounded.
NEAR = 2e-9

HELD = P.StructType([P.StructField("passage_id", P.LongType()), P.StructField("path", P.StringType()), P.StructField("ordinal", P.IntegerType()), P.StructField("length", P.LongType()), P.StructField("units", P.ArrayType(P.IntegerType())), P.StructField("fs", P.ArrayType(P.DoubleType()))])


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that come counts times each: the row and its how many-th copy."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _csr(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return counts, np.cumsum(counts) - counts, np.fromiter((x for v in lists for x in v), np.int64, int(counts.sum()))


def matcher(units: list[list[list[str]]], weights: dict[str, float], least: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over passage_id, path, ordinal, length and an array of tokens a field: units and fs (weighted frequencies) of each passage.

    units: the phrases that each unit is made of. least: Latin words of so many letters are met by all tokens that begin with them; 0 for none.
    """
    single, starts, heads, phrases = defaultdict(list), defaultdict(list), defaultdict(list), []
    for n, unit in enumerate(units):
        for phrase in unit:
            word = phrase[0]
            if len(phrase) > 1:
                heads[word].append(len(phrases))
                phrases.append((n, phrase))
            elif least and len(word) >= least and all(x in "abcdefghijklmnopqrstuvwxyz0123456789_" for x in word):
                starts[word].append(n)
            else:
                single[word].append(n)
    longest = max((len(p) for _, p in phrases), default=0)
    most = max(map(len, starts), default=0)
    sizes, owner = np.array([len(p) for _, p in phrases], np.int64), np.array([n for n, _ in phrases], np.int64)

    def of(token: str) -> list[int]:
        found = single.get(token, [])
        return found + [n for k in range(least, min(len(token), most) + 1) for n in starts.get(token[:k], ())] if starts else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cells, amounts = batch.num_rows, [], []
            for name, weight in weights.items():
                column = batch.column(name)
                size = np.asarray(column.value_lengths().fill_null(0))
                tokens = column.flatten().dictionary_encode()
                ids, vocabulary = np.asarray(tokens.indices), tokens.dictionary.to_pylist()
                row = np.repeat(np.arange(n), size)
                counts, at, to = _csr([of(t) for t in vocabulary])
                each = counts[ids] if len(ids) else np.zeros(0, np.int64)
                token, k = _spread(each)
                cells.append(row[token] * len(units) + to[at[ids[token]] + k])
                amounts.append(np.full(len(token), weight))
                if not phrases:
                    continue
                known = {t: i for i, t in enumerate(vocabulary)}
                words = np.full((len(phrases), longest), -1, np.int64)
                for i, (_, phrase) in enumerate(phrases):
                    words[i, : len(phrase)] = [known.get(w, -2) for w in phrase]
                counts, at, to = _csr([heads.get(t, []) for t in vocabulary])
                place, k = _spread(counts[ids] if len(ids) else np.zeros(0, np.int64))
                which = to[at[ids[place]] + k]
                end = np.cumsum(size)[row[place]]
                for j in range(1, longest):
                    more = sizes[which] > j
                    inside = place + j < end
                    ok = ~more | (inside & (ids[np.minimum(place + j, len(ids) - 1)] == words[which, j]))
                    place, which, end = place[ok], which[ok], end[ok]
                cells.append(row[place] * len(units) + owner[which])
                amounts.append(np.full(len(place), weight))
            cell, inverse = np.unique(np.concatenate(cells), return_inverse=True)
            f = np.bincount(inverse, np.concatenate(amounts), len(cell))
            ends = np.searchsorted(cell, np.arange(n + 1) * len(units)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((cell % len(units)).astype(np.int32), f)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("passage_id", "path", "ordinal", "length")), *lists], ["passage_id", "path", "ordinal", "length", "units", "fs"])

    return run


def ranker(asked: list[list[int]], wanted: np.ndarray | None, idf: np.ndarray, average: float, k1: float, b: float, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over the passages of matcher: passage_id, path, ordinal, score and q (a query's number), the best of each query.

    asked: the queries that ask for each unit, once for each of their groups. wanted: groups that a passage must have, by query. All that
    may be among the first limit of a query by rounded score, path and ordinal is handed on.
    """
    counts, at, to = _csr(asked)
    queries = int(to.max()) + 1 if len(to) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bar = np.full(queries, -np.inf)
        for batch in batches:
            n = batch.num_rows
            size = np.asarray(batch.column("units").value_lengths())
            unit, f, row = np.asarray(batch.column("units").flatten()), np.asarray(batch.column("fs").flatten()), np.repeat(np.arange(n), size)
            norm = k1 * (1 - b + b * np.asarray(batch.column("length")) / average)
            part = idf[unit] * f * (k1 + 1) / (f + norm[row])
            posting, k = _spread(counts[unit])
            q = to[at[unit[posting]] + k]
            cell, amount = q * n + row[posting], part[posting]
            if queries * n <= CELLS:
                groups = np.bincount(cell, minlength=queries * n)
                score = np.bincount(cell, amount, queries * n)
                cell = np.flatnonzero(groups)
                groups, score = groups[cell], score[cell]
            else:
                cell, inverse = np.unique(cell, return_inverse=True)
                groups, score = np.bincount(inverse, minlength=len(cell)), np.bincount(inverse, amount, len(cell))
            q, row = cell // n if n else cell, cell % n if n else cell
            keep = score >= bar[q] - NEAR
            if wanted is not None:
                keep &= groups == wanted[q]
            q, row, score = q[keep], row[keep], score[keep]
            if not len(q):
                continue
            paths, ordinals = batch.column("path").to_pylist(), batch.column("ordinal").to_pylist()
            rank = np.empty(n, np.int64)
            rank[sorted(range(n), key=lambda i: (paths[i] is not None, paths[i] or "", ordinals[i] is not None, ordinals[i] or 0))] = np.arange(n)
            order = np.lexsort((rank[row], -score, q))
            q, row, score = q[order], row[order], score[order]
            place = np.arange(len(q))
            new = np.concatenate([[True], q[1:] != q[:-1]])
            first = np.maximum.accumulate(np.where(new, place, 0))
            last = np.flatnonzero(new) + limit - 1
            full = (last < len(q)) & (q[np.minimum(last, len(q) - 1)] == q[new])
            bar[q[new][full]] = np.maximum(bar[q[new][full]], score[last[full]])
            run_ = np.maximum.accumulate(np.where(new | np.concatenate([[True], score[1:] != score[:-1]]), place, 0))
            keep = (place - first < limit) | ((score >= bar[q] - NEAR) & (place - run_ < limit))
            q, row, score = q[keep], pa.array(row[keep]), score[keep]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in ("passage_id", "path", "ordinal")), pa.array(score), pa.array(q.astype(np.int32))], ["passage_id", "path", "ordinal", "score", "q"])

    return run


def overlapper(asked: dict[str, list[int]], queries: int, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over path and words (an array), in order of path: q, path and overlap, the first limit of each query by overlap and path.

    asked: the queries that ask for each word. Rows of one path count together; a task has all rows of a path, but not of the
    null one, whose counts are handed on whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple[int, int, str]]] = [[] for _ in range(queries)]
        bar, nulls, seen = np.zeros(queries, np.int64), np.zeros(queries, np.int64), 0
        last: str | None = None
        held = np.zeros(queries, np.int64)  # counts of the path that may go on in the next rows

        def offer(path: str, q: np.ndarray, overlap: np.ndarray) -> None:
            nonlocal seen
            seen += 1
            better = (overlap > bar[q]) & (limit > 0)  # of equal ones the earlier path comes first
            for n, x in zip(q[better].tolist(), overlap[better].tolist(), strict=True):
                heap = heaps[n]
                (heapq.heappush if len(heap) < limit else heapq.heappushpop)(heap, (x, -seen, path))
                if len(heap) == limit:
                    bar[n] = heap[0][0]

        def close() -> None:
            if last is not None:
                q = np.flatnonzero(held)
                offer(last, q, held[q])
                held[q] = 0

        for batch in batches:
            column = batch.column("words")
            size = np.asarray(column.value_lengths().fill_null(0))
            words = column.flatten().dictionary_encode()
            ids = np.asarray(words.indices)
            counts, at, to = _csr([asked.get(w, []) for w in words.dictionary.to_pylist()])
            each = counts[ids] if len(ids) else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(each)])[np.cumsum(size)] if len(size) else np.zeros(0, np.int64)
            first, word = 0, 0
            paths = batch.column("path").to_pylist()
            while first < len(paths):
                # so many rows that what they share with queries fits a table
                before = ends[first - 1] if first else 0
                stop = max(first + 1, int(np.searchsorted(ends, before + CELLS, "right")))
                stop = min(stop, max(first + 1, first + CELLS // max(1, queries)))
                n_words = int(size[first:stop].sum())
                token, k = _spread(each[word : word + n_words])
                row = np.repeat(np.arange(stop - first), size[first:stop])[token]
                cell, overlap = np.unique(row * queries + to[at[ids[word + token]] + k], return_counts=True)
                row, q = cell // max(1, queries), cell % max(1, queries)
                start = np.searchsorted(row, np.arange(stop - first + 1))
                for i, path in enumerate(paths[first:stop]):
                    a, b = start[i], start[i + 1]
                    if path is None:
                        nulls[q[a:b]] += overlap[a:b]
                        continue
                    if path != last:
                        close()
                        last = path
                    held[q[a:b]] += overlap[a:b]
                first, word = stop, word + n_words
        close()
        found = [(n, path, x) for n, heap in enumerate(heaps) for x, _, path in heap] + [(n, None, x) for n, x in enumerate(nulls.tolist()) if x]
        for k in range(0, len(found), 10_000):
            q, path, overlap = zip(*found[k : k + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(path, pa.string()), pa.array(overlap, pa.int64())], ["q", "path", "overlap"])

    return run
