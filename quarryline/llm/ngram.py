"""Language-model scoring with a trigram trie in Elias-Fano levels.

Tokens are words of a text with A-Z in small letters, and one end. The model interpolates with absolute discounting:

    P1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))
    P2(w | v) = (c(v w) - D) / c(v) + g(v) P1(w)          g(v) = 1 - sum over kept w of (c(v w) - D) / c(v)
    P3(w | u v) = (c(u v w) - D) / c(u v) + g(u v) P2(w | v)

All n-grams are kept (a caller may ask for those seen `least` times only; the mass of others is in g), so every
distribution sums to 1 before quantisation. A start mark is a context only.

Files in the shared folder: the vocabulary in ranges of word hashes (a word's id is its rank), and the trie in shards of
(first word, second word) hashes, so that no frequent context is one shard's alone. In a shard the levels hold first words, second words under
them and third words under those; keys are parent x V + word, monotone over the level; pointers, monotone as well, bound
the search to a parent's children; the discounted shares and g are 8-bit codes. All are searched where they lie
(memory-mapped). Counting sends sorted, delta-coded, compressed blocks of trigrams to the shards; shards and ranges grow in number, not in
size. Nothing of the model is collected by the driver but sizes.

A shared folder that is a file system on every machine (a mount) is mapped; of another one files are read whole, so the model should
then fit in a worker's memory.

Defined results: null text is empty: one end token; an empty training set has N = V = 0 and P1 = 1; rows with a null id are
trained on; repeated rows count repeatedly; texts are read whole, a long one as a block of its own, so memory grows with the
longest text; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .eliasfano import EliasFano, load, quantise, save
from .langid import fold
from .shared import Workspace
from .text import U, Words, blocks, mix, strings, words

DISCOUNT, LEAST_COUNT = 0.75, 1
#: Shards that a worker holds open.
OPEN_SHARDS = 512
#: A block of texts looks into every shard, so it is larger than elsewhere.
SCORE_BYTES = 4 << 20
#: Words of a range, tokens of a shard, counts and trigrams that a task holds: a worker needs about 100 bytes for each.
RANGE_WORDS, SHARD_TOKENS, HELD, HELD_TRIGRAMS = 500_000, 1_500_000, 2_000_000, 2_500_000
END = np.uint64(1)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _tokens(block: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, hashes of all tokens with the ends, and where each text's tokens begin."""
    w = words(block, fold="ascii")
    first = w.first + np.arange(w.texts + 1)
    hashes = np.full(first[-1], END, U)
    hashes[np.arange(len(w.hashes)) + w.text_of] = mix(w.hashes)
    return w, hashes, first


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts, size = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)

    def out() -> pa.RecordBatch:
        key, count = merged()
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], ["word", "n"])

    for batch in batches:
        for _, block in blocks(strings(batch.column(0))):
            key, n = np.unique(_tokens(block)[1], return_counts=True)
            keys.append(key)
            counts.append(n)
            size += len(key)
            if size > HELD:
                key, n = merged()
                keys, counts, size = [key], [n], len(key)
                if size > HELD // 2:
                    yield out()
                    keys, counts, size = [], [], 0
    if keys:
        yield out()


def _gather(batches: Iterator[pa.RecordBatch], columns: int) -> list[np.ndarray]:
    parts: list[list] = [[] for _ in range(columns)]
    for batch in batches:
        for k in range(columns):
            parts[k].append(batch.column(k).to_numpy(zero_copy_only=False))
    return [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]


class Vocabulary:
    """Ids, counts and g of words, over all ranges."""

    def __init__(self, root: str, bases: list[int], with_backoff: bool = True):
        files = [load(f"{root}/words-{r:05d}") for r in range(len(bases) - 1)]
        self.bases = np.array(bases)
        self.size = bases[-1]
        self.files = files
        self.words = [EliasFano.of(f, "word") for f in files]
        self.counts = [f["n"] for f in files]
        self.backoff = [load(f"{root}/backoff-{r:05d}") for r in range(len(bases))] if with_backoff else []

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and count of each word; -1 and 0 where it is unknown."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        where = range_of(hashes, len(self.words))
        for r in np.unique(where):
            mine = np.flatnonzero(where == r)
            at = self.words[r].find(hashes[mine])
            known = mine[at >= 0]
            ids[known] = self.bases[r] + at[at >= 0]
            counts[known] = self.counts[r][at[at >= 0]]
            self.files[r].release()
        return ids, counts

    def g(self, ids: np.ndarray) -> np.ndarray:
        """g of context words (the start mark's id is size); 1 for -1."""
        out = np.ones(len(ids))
        where = np.searchsorted(self.bases, ids, "right") - 1
        for r in np.unique(where[ids >= 0]):
            mine = np.flatnonzero((where == r) & (ids >= 0))
            codes = self.backoff[r]["codes"][ids[mine] - self.bases[r]]
            out[mine] = self.backoff[r]["book"][codes]
        return out


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(max(1, ranges)) >> U(32)).astype(np.int64)


def shard_of(first: np.ndarray, second: np.ndarray, shards: int) -> np.ndarray:
    pair = mix(mix(first.astype(U)) + second.astype(U))
    return ((pair >> U(32)) * U(shards) >> U(32)).astype(np.int64)


class Shard:
    """Level of first words, of second words under them, and of third words under those."""

    def __init__(self, uri: str):
        self.file = f = load(uri)
        self.v = int(f["v"][0])
        self.first, self.second, self.third = (EliasFano.of(f, x) for x in ("first", "second", "third"))
        self.to_second, self.to_third = EliasFano.of(f, "to_second"), EliasFano.of(f, "to_third")
        self.p2, self.book2, self.p3, self.book3, self.g, self.book_g = (f[x] for x in ("p2.codes", "p2.book", "p3.codes", "p3.book", "g.codes", "g.book"))

    def look(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Share of v after u, g of (u, v), share of w after (u, v). w: -1 for none."""
        n = len(u)
        p2, g, p3 = np.zeros(n), np.ones(n), np.zeros(n)
        a = self.first.find(np.maximum(u, 0))
        some = np.flatnonzero((a >= 0) & (u >= 0) & (v >= 0))
        a = a[some]
        b = self.second.find(a * self.v + v[some], self.to_second.access(a).astype(np.int64), self.to_second.access(a + 1).astype(np.int64))
        some, b = some[b >= 0], b[b >= 0]
        p2[some] = self.book2[self.p2[b]]
        g[some] = self.book_g[self.g[b]]
        some, b = some[w[some] >= 0], b[w[some] >= 0]
        c = self.third.find(b * self.v + w[some], self.to_third.access(b).astype(np.int64), self.to_third.access(b + 1).astype(np.int64))
        p3[some[c >= 0]] = self.book3[self.p3[c[c >= 0]]]
        # so a worker holds the pages of one shard at a time
        self.file.release()
        return p2, g, p3


def build_shard(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray, size: int, context: np.ndarray, none: int, least: int = LEAST_COUNT) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Arrays of a shard from distinct trigrams with counts, ordered; and the discounted sums of first words.

    context: c(u) of each trigram's first word. none: the third word that stands for the end of a text.
    """
    pair = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])) if len(u) else np.zeros(0, np.int64)
    total = np.add.reduceat(n, pair) if len(pair) else n
    of = np.repeat(np.arange(len(pair)), np.diff(np.append(pair, len(u))))
    kept = total >= least
    share2 = (total - DISCOUNT) / np.maximum(context[pair], 1)
    # all occurrences of a pair but those before the end of a text are followed by a word
    after = np.bincount(of, np.where(w == none, 0, n), len(pair))
    third = (n >= least) & (w != none) & kept[of]
    share3 = ((n - DISCOUNT) / np.maximum(after[of], 1))[third]
    g = np.maximum(1 - np.bincount(of[third], share3, len(pair)), 1e-9)[kept]
    new = np.cumsum(kept) - 1
    pu, pv = u[pair][kept], v[pair][kept]
    firsts, local = np.unique(pu, return_inverse=True)
    owner = new[of[third]]
    out: dict[str, np.ndarray] = {"v": np.array([size], np.int64)}
    levels = {
        "first": (firsts, size),
        "second": (local * size + pv, max(1, len(firsts)) * size),
        "third": (owner * size + w[third], max(1, len(pu)) * size),
        "to_second": (np.searchsorted(local, np.arange(len(firsts) + 1)), len(pu) + 1),
        "to_third": (np.searchsorted(owner, np.arange(len(pu) + 1)), len(owner) + 1),
    }
    for name, (values, universe) in levels.items():
        out |= {f"{name}.{k}": a for k, a in EliasFano.encode(values, int(universe)).items()}
    for name, values in (("p2", share2[kept]), ("p3", share3), ("g", g)):
        out |= {f"{name}.{k}": a for k, a in quantise(values).items()}
    return out, firsts, np.bincount(local, total[kept] - DISCOUNT, len(firsts))


class Model:
    """Where a trained model lies, and its sizes. Small; goes to the tasks with their code."""

    def __init__(self, root: str, bases: list[int], tokens: int, texts: int, shards: int):
        self.root, self.bases, self.tokens, self.texts, self.shards = root, bases, tokens, texts, shards

    @property
    def ids(self) -> int:
        """Words, the start mark, and the mark for nothing."""
        return self.bases[-1] + 2


def _sequences(w: Words, first: np.ndarray, ids: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with a start mark before each text, and where each token of the text went."""
    owner = np.repeat(np.arange(w.texts), np.diff(first))
    at = np.arange(len(ids)) + owner + 1
    out = np.full(len(ids) + w.texts, start, np.int64)
    out[at] = ids
    return out, at


def train(docs: DataFrame, work: Workspace, least: int = LEAST_COUNT) -> Model:
    """docs: the texts to learn from. least: occurrences of an n-gram that is kept."""
    counts = docs.select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = work.table(counts, "counts")
    size, tokens, texts = counts.agg(F.count("*"), F.sum("n"), F.sum(F.when(F.col("word") == int(END), F.col("n")))).first()
    root, ranges = work.mkdirs("model"), max(1, -(-size // RANGE_WORDS))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).view(U)
            yield pa.RecordBatch.from_arrays([pa.array(range_of(hashes, ranges)), *batch.columns], ["r", "word", "n"])

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, word, n = _gather(batches, 3)
        if not len(r):
            return
        order = np.argsort(word.view(U))
        arrays = {f"word.{k}": a for k, a in EliasFano.encode(word.view(U)[order], 1 << 64).items()}
        save(f"{root}/words-{r[0]:05d}", arrays | {"n": n[order]}, str(TaskContext.get().taskAttemptId()))
        yield pa.RecordBatch.from_arrays([pa.array(r[:1]), pa.array([len(r)])], ["r", "n"])

    tagged = counts.mapInArrow(tag, "r long, word long, n long").repartitionById(ranges, F.col("r").cast("int"))
    sizes = {r["r"]: r["n"] for r in work.table(tagged.mapInArrow(write_words, "r long, n long"), "ranges").collect()}
    for r in range(ranges):
        if r not in sizes:
            save(f"{root}/words-{r:05d}", {f"word.{k}": a for k, a in EliasFano.encode(np.zeros(0, U), 1 << 64).items()} | {"n": np.zeros(0, np.int64)}, "driver")
    bases = np.cumsum([0, *(sizes.get(r, 0) for r in range(ranges))]).tolist()
    model = Model(root, bases, tokens or 0, texts or 0, max(1, -(-(tokens or 0) // SHARD_TOKENS)))
    start, none, n_ids, shards = size, size + 1, size + 2, model.shards

    def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, pack = Vocabulary(root, bases, False), zstandard.ZstdCompressor(level=1)
        held: list[tuple[np.ndarray, ...]] = []
        n_held = 0

        def out() -> pa.RecordBatch:
            u, v, w = (np.concatenate(x) for x in zip(*held, strict=True))
            shard, pair = shard_of(u, v, shards).astype(np.uint32), u * n_ids + v
            order = np.lexsort([w, pair, shard])
            shard, pair, w = shard[order], pair[order], w[order]
            new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (w[1:] != w[:-1])]))
            n = np.diff(np.append(new, len(pair)))
            shard, pair, w = shard[new], pair[new], w[new]
            cuts = np.append(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), len(shard))
            data = [pack.compress(_packed(pair[a:b], w[a:b], n[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]].astype(np.int32)), pa.array(data, pa.binary())], ["shard", "data"])

        for batch in batches:
            for _, block in blocks(strings(batch.column(0))):
                w, hashes, first = _tokens(block)
                distinct, back = np.unique(hashes, return_inverse=True)
                seq, _ = _sequences(w, first, vocabulary.ids(distinct)[0][back], start)
                seq = np.append(seq, start)
                # a pair in each place but a text's last; its third word is none before the next start
                at = np.flatnonzero(seq[1:] != start)
                third = seq[np.minimum(at + 2, len(seq) - 1)]
                held.append((seq[at], seq[at + 1], np.where(third == start, none, third)))
                n_held += len(at)
                if n_held > HELD_TRIGRAMS:
                    yield out()
                    n_held = 0
        if held:
            yield out()

    def write_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, parts, shard = zstandard.ZstdDecompressor(), [], None
        for batch in batches:
            for s, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = s
                parts.append(_unpacked(unpack.decompress(data)))
        if not parts:
            return
        pair, w, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.lexsort([w, pair])
        pair, w, n = pair[order], w[order].astype(np.int64), n[order].astype(np.int64)
        del order
        new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (w[1:] != w[:-1])]))
        n, pair, w = np.add.reduceat(n, new), pair[new], w[new]
        u, v = pair // n_ids, pair % n_ids
        vocabulary = Vocabulary(root, bases, False)
        context = np.full(len(u), model.texts, np.int64)
        for r in range(len(bases) - 1):
            mine = (u >= bases[r]) & (u < bases[r + 1])
            context[mine] = vocabulary.counts[r][u[mine] - bases[r]]
        arrays, firsts, sums = build_shard(u, v, w, n, n_ids, context, none, least)
        save(f"{root}/shard-{shard:05d}", arrays, str(TaskContext.get().taskAttemptId()))
        yield pa.RecordBatch.from_arrays([pa.array(firsts), pa.array(sums)], ["u", "kept"])

    blobs = docs.select("text").mapInArrow(count_trigrams, "shard int, data binary").repartitionById(shards, F.col("shard"))
    kept = work.table(blobs.mapInArrow(write_shard, "u long, kept double"), "kept")
    sums = kept.groupBy("u").agg(F.sum("kept").alias("kept"))

    def write_backoff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, u, s = _gather(batches, 3)
        if not len(r):
            return
        k = int(r[0])
        counts = load(f"{root}/words-{k:05d}")["n"] if k < len(bases) - 1 else np.array([model.texts])
        g = np.ones(len(counts))
        mine = u >= 0
        g[u[mine] - bases[k]] = np.maximum(1 - s[mine] / np.maximum(counts[u[mine] - bases[k]], 1), 1e-9)
        save(f"{root}/backoff-{k:05d}", quantise(g), str(TaskContext.get().taskAttemptId()))
        yield pa.RecordBatch.from_arrays([pa.array([k])], ["r"])

    spark = docs.sparkSession
    # a row of each range, so that each gets its file
    every = spark.range(len(bases)).select(F.col("id").alias("r"), F.lit(-1).cast("long").alias("u"), F.lit(0.0).alias("kept"))
    place = F.size(F.filter(F.array(*[F.lit(b) for b in bases]), lambda b: b <= F.col("u"))) - 1
    rows = sums.select(place.cast("long").alias("r"), "u", "kept").unionByName(every).repartitionById(len(bases), F.col("r").cast("int"))
    work.table(rows.mapInArrow(write_backoff, "r long"), "backoffs")
    work.drop("counts", "kept")
    return model


def _packed(pair: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """Deltas of ordered pairs, third words and counts, byte by byte of equal weight."""
    step = np.diff(pair, prepend=0).astype("<u8")
    head = np.array([len(pair)], "<u8").tobytes()
    return head + step.view(np.uint8).reshape(-1, 8).T.tobytes() + w.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() + n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(data, np.uint8)[8:]
    step = np.ascontiguousarray(raw[: 8 * k].reshape(8, k).T).view("<u8").ravel()
    w = np.ascontiguousarray(raw[8 * k : 12 * k].reshape(4, k).T).view("<u4").ravel()
    n = np.ascontiguousarray(raw[12 * k :].reshape(4, k).T).view("<u4").ravel()
    return np.cumsum(step).astype(np.int64), w, n


@lru_cache(2)
def _words(root: str, bases: tuple[int, ...]) -> Vocabulary:
    return Vocabulary(root, list(bases))


@lru_cache(OPEN_SHARDS)
def _shard(uri: str) -> Shard | None:
    """None: no trigram has come to this shard."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    return Shard(uri) if where.get_file_info(path).type == fs.FileType.File else None


def _score(model: Model, block: pa.Array) -> list[np.ndarray]:
    vocabulary, size = _words(model.root, tuple(model.bases)), model.bases[-1]
    w, hashes, first = _tokens(block)
    distinct, back = np.unique(hashes, return_inverse=True)
    ids, counts = (x[back] for x in vocabulary.ids(distinct))
    p1 = (counts + 0.5) / (model.tokens + 0.5 * (size + 1))
    seq, at = _sequences(w, first, ids, size)
    u, v = seq[at - 1], seq[at]
    after = np.append(seq, size)[at + 1]
    after = np.where(after == size, -1, after)
    known = np.flatnonzero((u >= 0) & (v >= 0))
    p2, g2, p3 = np.zeros(len(at)), np.ones(len(at)), np.zeros(len(at))
    shard = shard_of(u[known], v[known], model.shards)
    # in the order of the levels, so that neighbouring searches read neighbouring bits
    order = np.argsort(u[known] * size + v[known])
    order = order[np.argsort(shard[order].astype(np.uint16 if model.shards < 1 << 16 else np.int64), kind="stable")]
    cuts = np.searchsorted(shard[order], np.arange(model.shards + 1))
    for s in range(model.shards):
        if cuts[s + 1] > cuts[s] and (one := _shard(f"{model.root}/shard-{s:05d}")) is not None:
            mine = known[order[cuts[s] : cuts[s + 1]]]
            p2[mine], g2[mine], p3[mine] = one.look(u[mine], v[mine], after[mine])
    g1 = vocabulary.g(u)
    # the pair before a token is the context of its trigram
    begins = np.zeros(len(at), bool)
    begins[first[:-1]] = True
    g12, share3 = np.ones(len(at)), np.zeros(len(at))
    g12[1:], share3[1:] = g2[:-1], p3[:-1]
    g12[begins], share3[begins] = 1, 0
    p = share3 + g12 * (p2 + g1 * p1)
    text = np.repeat(np.arange(w.texts), np.diff(first))
    return [np.diff(first), np.bincount(text, counts > 0, w.texts).astype(np.int64), np.bincount(text, np.log10(p1), w.texts), np.bincount(text, np.log10(p), w.texts)]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """SCHEMA for docs (doc_id, held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in blocks(strings(batch.column(2)), SCORE_BYTES):
                n, known, base, best = _score(model, block)
                columns = [batch.column(0).slice(at, len(block)), batch.column(1).slice(at, len(block)), pa.array(n), pa.array(known), pa.array([model.tokens] * len(block), pa.int64()), pa.array(base), pa.array(best)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, SCHEMA)


def score_documents(docs: DataFrame, work: Workspace | None = None, least: int = LEAST_COUNT) -> DataFrame:
    """SCHEMA for all documents, by a model of those whose fold is not 1."""
    work = work or Workspace(docs.sparkSession, "ngram")
    model = train(docs.where(fold() != 1), work, least)
    return score(docs.select("doc_id", (fold() == 1).alias("held_out"), "text"), model)
