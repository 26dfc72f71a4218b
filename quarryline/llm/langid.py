"""Language identification by rank-order profiles of letter n-grams (out-of-place distance).

A profile is the PROFILE most frequent 1- to 3-grams of a language. A document's own most frequent n-grams are ranked
the same way; the distance to a language adds up how far each is out of place there, or the worst place if it is absent.

Defined results: null text, text without a letter and an empty set of profiles give ``und`` with score 0. Ties between
languages go to the smaller name, ties between n-grams to the smaller hash. Rows without a language are not learned
from. Repeated rows count repeatedly; an empty table gives no rows. Texts are read whole, a long one as a block of its own. Other
columns of the input pass through untouched; a column that has the name of a result column is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import short_batches, tidy
from .text import U, blocks, mix, strings

PROFILE = 400
MIN_SCORE = 0.05
#: Counts of n-grams that a task holds before it hands them on.
HELD = 2_000_000


@lru_cache(1)
def _letters() -> np.ndarray:
    """Each code point's small letter; 0 if it is none."""
    small = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            small[c] = ord(low) if len(low := ch.lower()) == 1 else c
    return small


def _grams(block: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash (40 bits) and count of each n-gram in each text of a block, ordered by text and hash."""
    codes, lengths = [], []
    for text in block.to_pylist():
        codes.append(f" {text} ")
        lengths.append(len(text) + 2)
    letters = _letters()[np.frombuffer("".join(codes).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(U)
    text = np.repeat(np.arange(len(lengths), dtype=U), lengths)
    before, after = np.zeros_like(letters), np.zeros_like(letters)
    before[1:], after[:-1] = letters[:-1], letters[1:]
    here = letters > 0
    # 0 stands for the edge of a word; 21 bits hold a code point
    pairs = here | (before > 0)
    keys = [letters[here], (before << U(21) | letters)[pairs] | U(1 << 63), (before << U(42) | letters << U(21) | after)[here] | U(1 << 63)]
    owner = [text[here], text[pairs], text[here]]
    keys[1] ^= U(1 << 62)
    keys[2] = keys[2] * U(3)
    both = np.sort((np.concatenate(owner) << U(40)) | (mix(np.concatenate(keys)) >> U(24)))
    new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    both, counts = both[new], np.diff(np.append(new, len(both)))
    return (both >> U(40)).astype(np.int64), (both & U((1 << 40) - 1)).astype(np.int64), counts


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(back, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

    for batch in batches:
        texts, langs = strings(batch.column(0)), np.array(batch.column(1).to_pylist(), object)
        for at, block in blocks(texts):
            text, gram, count = _grams(block)
            of = langs[at : at + len(block)]
            for lang in dict.fromkeys(of):
                mine = (of == lang)[text]
                grams, back = np.unique(gram[mine], return_inverse=True)
                held.setdefault(lang, []).append((grams, np.bincount(back, count[mine], len(grams)).astype(np.int64)))
                size += len(grams)
            if size > HELD:
                yield from out()
                held, size = {}, 0
    yield from out()


def learn(rows: DataFrame, text: Column | str = "text", lang: Column | str = "lang", size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles from all rows with a language: the n-grams (hashes) of each, most frequent first.

    Counts are added up in the tasks before they are shuffled. Only size rows a language come to the driver.
    """
    text, lang = (F.col(x) if isinstance(x, str) else x for x in (text, lang))
    short_batches(rows.sparkSession)
    counts = rows.select(text.alias("text"), lang.alias("lang")).where("lang is not null").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Spark cuts each task's n-grams to the first of a language before they meet in one
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= size)
    out: dict[str, list[int]] = {}
    for r in sorted(best.collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(grams, np.int64) for lang, grams in out.items()}


def _predict(profiles: dict[str, np.ndarray], size: int, block: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of the best profile (-1: none) and score of each text."""
    n = len(block)
    best, score = np.full(n, -1), np.zeros(n)
    text, gram, count = _grams(block)
    if not profiles or not len(text):
        return best, score
    order = np.argsort((text << 32) - np.minimum(count, (1 << 31) - 1), kind="stable")
    text, gram = text[order], gram[order]
    first = np.searchsorted(text, np.arange(n))
    rank = np.arange(len(text)) - first[text]
    keep = rank < size
    text, gram, rank = text[keep], gram[keep], rank[keep]
    used = np.bincount(text, minlength=n)
    far = []
    for profile in profiles.values():
        by = np.argsort(profile, kind="stable")
        at = np.minimum(np.searchsorted(profile[by], gram), len(profile) - 1)
        place = np.where(profile[by][at] == gram, by[at], -1) if len(profile) else np.full(len(gram), -1)
        far.append(np.bincount(text, np.where(place < 0, size, np.abs(place - rank)), n))
    far = np.array(far)
    there = used > 0
    best[there] = far.argmin(0)[there]
    score[there] = 1 - far.min(0)[there] / (used[there] * float(size))
    return best, np.clip(score, 0, 1)


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", size: int = PROFILE, keep_text: bool = False, result: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs (without the text, unless it is kept) with lang_pred and score (1: every n-gram in its place; 0: none known), or as result names them."""
    short_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text, *result)]
    kept = [*rest, text] if keep_text else rest
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(result[0], T.StringType()), T.StructField(result[1], T.DoubleType())])
    names = np.array([*profiles, "und"], object)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = strings(batch.column(len(rest)))
            found = [_predict(profiles, size, block) for _, block in blocks(whole)] or [(np.zeros(0, int), np.zeros(0))]
            lang = names[np.concatenate([f[0] for f in found])]
            columns = [batch.column(k) for k in range(len(kept))] + [pa.array(lang, pa.string()), pa.array(np.concatenate([f[1] for f in found]))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *result])

    return docs.select(*rest, text).mapInArrow(run, schema)


def fold(id_column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5, F.lit(0))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document, learned from the documents whose fold is not 0."""
    train = docs.where(fold() != 0)
    return predict(docs.select("doc_id", (fold() == 0).alias("held_out"), "text"), learn(train)).select("doc_id", "held_out", "lang_pred", "score")
