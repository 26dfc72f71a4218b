"""Quality rules on repetition inside a text: suffix arrays over words and their longest common prefixes.

For each text the suffixes that start with a repeated window of MIN_WORDS words are sorted (prefix doubling, in the
order of word hashes); two neighbours' longest common prefix comes from prefix hashes. An interval of neighbours whose common
prefixes are at least L long is a repeated run of L words, and no longer run of the same occurrences exists to the right; a word
is covered if it lies in an occurrence of such a run. The union over all intervals is the union over suffixes of the
longer of the two prefixes shared with their neighbours, so that is what is added up.

A text is kept unless a base rule fails, more than MAX_COVERED of its words are covered, or its longest repeat has over
MAX_LONGEST words or over MAX_LONGEST_SHARE of the text. The first of these binds in long texts, where little need be covered.

Defined results: null is the empty text; texts without words have zeros everywhere and fail the base rule; repeated rows
give repeated results; any other columns are not read. Texts are read whole; memory grows with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import short_batches
from .text import SPACES, U, Words, blocks, mix, prefix_hashes, span_hash, strings, words

MIN_WORDS = 5
MAX_COVERED = 0.4
MAX_LONGEST, MAX_LONGEST_SHARE = 100, 0.3
#: Symbols of the base rule, and its limits. Fixed values.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEAT_PERCENT, REPEAT_WINDOW = 50, 50, 3
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, covered_words long, longest_repeat long, kept boolean"


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _covered(n: int, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Which of n places lie in a span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _repeated(w: Words, k: int) -> np.ndarray:
    """First words of the k-word windows that are in their text twice or more."""
    left = np.repeat(w.first[1:], w.counts) - np.arange(len(w.hashes))
    at = np.flatnonzero(left >= k)
    mixed, total = mix(w.hashes), np.zeros(len(at), U)
    for j in range(k):
        total = total * U(0xFF51AFD7ED558CCD) + mixed[at + j]
    key = mix(total ^ mix(w.text_of[at].astype(U) + U(1)))
    order = np.argsort(key)
    key = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    return np.sort(at[order[same[1:] | same[:-1]]])


def _lcp(sums: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes at a and b, in words, at most most."""
    found = np.zeros(len(a), np.int64)
    step = 1 << int(most.max(initial=0)).bit_length()
    while step:
        longer = found + step
        fits = np.flatnonzero(longer <= most)
        same = span_hash(sums, a[fits] + found[fits], a[fits] + longer[fits]) == span_hash(sums, b[fits] + found[fits], b[fits] + longer[fits])
        found[fits[same]] += step
        step >>= 1
    return found


def repeats(w: Words, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each suffix's longest repeat, of least words or more, by place."""
    active = _repeated(w, least)
    n = len(w.hashes)
    if not len(active):
        return active, active
    text_end = np.repeat(w.first[1:], w.counts)
    text = w.text_of
    inside = active + least < text_end[active]
    every = np.union1d(active, active[inside] + least)
    ids = mix(w.hashes) >> U(1)
    ids = np.concatenate([ids + U(1), np.zeros(least, U)])
    keys = [np.where(every + j < text_end[every], ids[every + j], U(0)) for j in range(least)]
    order = np.lexsort([*keys[::-1], text[every]])
    differs = np.ones(len(every), bool)
    differs[1:] = text[every[order[1:]]] != text[every[order[:-1]]]
    for key in keys:
        differs[1:] |= key[order[1:]] != key[order[:-1]]
    suffixes = every[order]
    rank = np.full(n + 1, -1, np.int64)
    starts = np.flatnonzero(differs)
    group = starts[np.cumsum(differs) - 1]  # the place of a group's first suffix is its rank
    rank[suffixes] = group
    h = least
    while True:
        size = np.diff(np.append(np.flatnonzero(differs), len(suffixes)))
        open_ = np.flatnonzero(np.repeat(size, size) > 1)
        if not len(open_):
            break
        at = suffixes[open_]
        behind = np.where(at + h < text_end[at], rank[np.minimum(at + h, n)], -1)
        by = np.lexsort([behind, group[open_]])
        suffixes[open_] = at[by]
        behind = behind[by]
        new = np.ones(len(open_), bool)
        new[1:] = (group[open_][1:] != group[open_][:-1]) | (behind[1:] != behind[:-1])
        differs[open_] = new
        group = np.flatnonzero(differs)[np.cumsum(differs) - 1]
        rank[suffixes] = group
        h *= 2
    sums = prefix_hashes(mix(w.hashes))
    a, b = suffixes[:-1], suffixes[1:]
    most = np.where(text[a] == text[b], np.minimum(text_end[a] - a, text_end[b] - b), 0)
    shared = np.concatenate([[0], _lcp(sums, a, b, most), [0]])
    longest = np.maximum(shared[:-1], shared[1:])
    keep = longest >= least
    place = np.argsort(suffixes[keep], kind="stable")
    return suffixes[keep][place], longest[keep][place]


def _block(column: pa.Array) -> dict[str, np.ndarray]:
    w = words(column)
    n, raw, offsets = len(w.hashes), w.raw, w.offsets
    inside = ~SPACES[raw]
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    out = {"n_words": w.counts, "word_chars": _per_text(inside & ((raw & 0xC0) != 0x80), offsets), "n_symbols": _per_text(symbol[raw], offsets)}
    # lines: each text's first, and one after each line feed
    feeds = np.flatnonzero(raw == 10)
    begin = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    owner = np.concatenate([np.arange(w.texts), np.searchsorted(offsets, feeds, "right") - 1])
    owner = np.sort(owner, kind="stable")
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    finish = np.where(last, offsets[owner + 1], np.append(begin[1:] - 1, 0)[: len(begin)])
    marks = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(inside, out=marks[1:])
    worded = np.flatnonzero(marks[finish] > marks[begin])
    key = span_hash(w.sums, begin[worded], finish[worded]) + mix((finish - begin)[worded].astype(U))
    order = np.lexsort([key, owner[worded]])
    again = np.zeros(len(worded), bool)
    again[1:] = (key[order[1:]] == key[order[:-1]]) & (owner[worded][order[1:]] == owner[worded][order[:-1]])
    out["n_dup_lines"] = np.bincount(owner[worded][order[again]], minlength=w.texts)
    out["n_repeat_words"] = _per_text(_covered(n, _repeated(w, REPEAT_WINDOW), REPEAT_WINDOW), w.first)
    at, length = repeats(w)
    out["covered_words"] = _per_text(_covered(n, at, length), w.first)
    longest = np.zeros(w.texts, np.int64)
    np.maximum.at(longest, w.text_of[at], length)
    out["longest_repeat"] = longest
    counts = w.counts
    out["base_failed"] = (counts < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEAT_PERCENT * counts)
    bad = (out["covered_words"] > MAX_COVERED * counts) | (longest > MAX_LONGEST) | (longest > MAX_LONGEST_SHARE * counts)
    out["kept"] = ~out["base_failed"] & ~bad
    return out


def judge(docs: DataFrame) -> DataFrame:
    """The columns of SCHEMA for each document."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, whole = batch.column(0), strings(batch.column(1))
            for at, block in blocks(whole):
                got = _block(block)
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(block))] + [pa.array(got[c]) for c in names[1:]], names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
