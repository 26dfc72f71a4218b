"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text is its set of five-word shingles, weighted 1 + ln(occurrences). Each shingle sends a Poisson process of arrivals
at a rate that is its weight; an arrival takes a register if it is the earliest there, and a shingle stops once it is later
than every register. Two registers hold the same shingle with the texts' probability Jaccard similarity. A second set of
registers takes every weight as 1, and agrees with the texts' plain Jaccard similarity; it is kept only where a shingle
occurs twice or more, as both sets are equal elsewhere.

1. Equal word sequences are one node. Registers make BANDS bands of ROWS in each set; nodes that agree on a band meet in its bucket.
2. Each bucket's most central member (most meetings over all bands) is compared with the others; confirmed pairs are links.
3. What is left: pairs of a bucket that are in different components of these links. They are compared, in the first bucket
   that they share, block by block, so a bucket of any size is worked off by many tasks, and no pair that agrees on a band of a
   set goes untested unless its nodes are in one class already. The members of a bucket's largest component go only to
   blocks of others, so a large group with a few strays costs its size, not its square.
4. A pair is tested on all registers first (one byte each), and dropped if the estimates of both sets are under CUT, 4.5 standard errors
   below the threshold; then on the whole shingle sets: plain Jaccard or exact probability Jaccard must reach SIMILARITY.

Words are runs of ASCII letters, digits and non-ASCII characters in small letters. Defined results: a text of 1 to 4
words is one shingle; null texts and texts without words are in a class of their own each; repeated rows are in one
class; a class is named by its smallest doc_id, or null if all its ids are null; an empty table gives no rows. A similarity of
exactly SIMILARITY links. Texts are read whole: memory grows with the longest one, which is a block of its own. Only doc_id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Workspace, row_key, small, tidy
from .text import MARKS, U, Words, blocks, mix, prefix_hashes, span_hash, strings, words

SHINGLE, SIMILARITY = 5, 0.8
ROWS, BANDS = 7, 40
REGISTERS = ROWS * BANDS
CUT = SIMILARITY - 4.5 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5
BUCKET_BLOCK = 256
PAIRS_AT_ONCE = 500


def weighted(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, 48-bit hash and weight of each distinct shingle of each text."""
    h, text, _ = w.shingles(k)
    key = np.sort((text.astype(U) << U(48)) | (h >> U(16)))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> U(48)).astype(np.int64), key & U((1 << 48) - 1), 1 + np.log(counts)


def registers(texts: int, text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """texts x m shingles (0 where a text has none)."""
    first = np.full(texts * m, np.inf)
    holder = np.zeros(texts * m, U)
    latest = np.full(texts, np.inf)
    seed, time, step = mix(shingle + U(1)), np.zeros(len(shingle)), 0
    while len(shingle):
        step += 1
        draw = mix(seed + U(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        time = time - np.log1p(-(draw >> U(11)).astype(np.float64) * 2.0**-53) / weight
        live = np.flatnonzero(time < latest[text])
        text, shingle, weight, seed, time, draw = text[live], shingle[live], weight[live], seed[live], time[live], draw[live]
        place = text * m + ((mix(draw) >> U(32)) * U(m) >> U(32)).astype(np.int64)
        np.minimum.at(first, place, time)
        won = first[place] == time
        holder[place[won]] = shingle[won]
        if step % 4 == 0 or step < 4:
            latest = first.reshape(texts, m).max(1) if texts else latest
    return holder.reshape(texts, m)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> tuple[float, float]:
    """Plain and probability Jaccard of two weighted sets (sorted shingles)."""
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    plain = len(ia) / max(1, len(a) + len(b) - len(ia))
    if not len(ia) or (wa.max() == wa.min() and wb.max() == wb.min() and len(a) == len(b)):
        return plain, plain
    x, y = wa[ia], wb[ib]
    # sum over all j of max(a_j / a_i, b_j / b_i): where a_j / b_j is at least a_i / b_i, the first is larger
    order = np.argsort(x / y)
    x, y = x[order], y[order]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    above = x.sum() - np.cumsum(x) + x + only_a
    below = np.cumsum(y) - y + only_b
    return plain, float((1 / (above / x + below / y)).sum())


def _keys(reg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands of registers, and a byte of each register."""
    key = np.zeros((len(reg), BANDS), U)
    by = mix(reg).reshape(len(reg), BANDS, ROWS)
    for j in range(ROWS):
        key = key * U(0xFF51AFD7ED558CCD) + by[:, :, j]
    key = mix(key + np.arange(1, BANDS + 1, dtype=U) * U(0xD1342543DE82EF95)).view(np.int64)
    return key, (mix(reg + U(7)) >> U(56)).astype(np.uint8)


@tidy
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "row", "node", "bands", "sketch"]
    for batch in batches:
        for at, block in blocks(strings(batch.column(2))):
            w = words(block, MARKS, "full")
            sums = prefix_hashes(mix(w.hashes))
            node = mix(span_hash(sums, w.first[:-1], w.first[1:]) + U(0x51) * w.counts.astype(U)).view(np.int64)
            none = w.counts == 0
            text, shingle, weight = weighted(w)
            key, bytes_ = _keys(registers(w.texts, text, shingle, weight))
            # the same with equal weights, of texts with a shingle that occurs again
            again = np.bincount(text, weight > 1, w.texts) > 0
            mine, new = again[text], np.cumsum(again) - 1
            plain_key, plain_bytes = _keys(registers(int(again.sum()), new[text[mine]], shingle[mine], np.ones(int(mine.sum()))))
            size = np.where(again, 2 * BANDS, BANDS)
            first = np.concatenate([[0], np.cumsum(size)])
            flat = np.zeros(first[-1], np.int64)
            flat[(first[:-1, None] + np.arange(BANDS)).ravel()] = key.ravel()
            flat[(first[:-1][again][:, None] + BANDS + np.arange(BANDS)).ravel()] = plain_key.ravel()
            bands = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat))
            sketch = pa.array([x.tobytes() + (plain_bytes[new[i]].tobytes() if again[i] else b"") for i, x in enumerate(bytes_)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), batch.column(1).slice(at, len(block)), pa.array(node, mask=none), bands, sketch], names)


def _estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The larger of the similarities by weighted and by plain registers."""
    return ((a == b).mean(-1).max(-1) - 1 / 256) / (1 - 1 / 256)


def _sketches(column: pa.Array) -> np.ndarray:
    """Weighted and plain registers of each row, equal where only one set is kept."""
    whole = b"".join(x if len(x) > REGISTERS else x + x for x in column.to_pylist())
    return np.frombuffer(whole, np.uint8).reshape(len(column), 2, REGISTERS)


def _bands(column: pa.ListArray) -> np.ndarray:
    """Weighted and plain keys of each row, in one line."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    first = np.cumsum(size) - size
    at = first[:, None] + np.arange(2 * BANDS) % np.where(size > BANDS, 2 * BANDS, BANDS)[:, None]
    return column.flatten().to_numpy(zero_copy_only=False)[at]


@tidy
def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = _estimate(_sketches(batch.column("sa")), _sketches(batch.column("sb"))) >= CUT
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _sets(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for _, block in blocks(texts):
        of, shingle, weight = weighted(words(block, MARKS, "full"))
        bounds = np.searchsorted(of, np.arange(len(block) + 1))
        out += [(shingle[i:j], weight[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


@tidy
def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between different components among the members of each cell of a bucket.

    A pair that shares several buckets is tested in the first of them; a pair that links found in this cell have joined is not tested.
    """
    for batch in batches:
        for key, members in zip(batch.column("key").to_pylist(), batch.column("members"), strict=True):
            rows = members.values
            node, root, side = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("node", "root", "side"))
            sketch = _sketches(rows.field("sketch"))
            bands = _bands(rows.field("bands"))
            sets, joined = None, {int(r): int(r) for r in root}

            def find(r: int, joined: dict[int, int] = joined) -> int:
                while joined[r] != r:
                    joined[r] = r = joined[joined[r]]
                return r

            found: list[tuple[int, int, float]] = []
            for i in range(len(rows)):
                if side[i] == 1:
                    continue
                other = np.flatnonzero((root > root[i]) if side[i] == 2 else (root != root[i]) & (side == 1))
                other = other[_estimate(sketch[other], sketch[i]) >= CUT]
                other = other[bands[i][(bands[other] == bands[i]).argmax(1)] == key]
                for j in other.tolist():
                    if find(int(root[i])) == find(int(root[j])):
                        continue
                    sets = sets or _sets(rows.field("text"))
                    score = max(similarity(*sets[i], *sets[j]))
                    if score >= SIMILARITY - 1e-12:
                        joined[find(int(root[i]))] = find(int(root[j]))
                        found.append((*sorted((int(node[i]), int(node[j]))), score))
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["a", "b", "similarity"])


@tidy
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, PAIRS_AT_ONCE):
            batch = whole.slice(start, PAIRS_AT_ONCE)
            both = pa.chunked_array([batch.column("ta"), batch.column("tb")]).combine_chunks().dictionary_encode()
            sets = _sets(both.dictionary)
            place, n = both.indices.to_numpy(), batch.num_rows
            score = np.array([max(similarity(*sets[x], *sets[y])) for x, y in zip(place[:n], place[n:], strict=True)])
            keep = score >= SIMILARITY - 1e-12
            yield batch.select(["a", "b"]).append_column("similarity", pa.array(score, pa.float64())).filter(pa.array(keep, pa.bool_()))


class NearDuplicates:
    """One run over documents; classes() is its result, links() the confirmed pairs of nodes."""

    def __init__(self, docs: DataFrame, work: Workspace | None = None):
        self.work = work or Workspace(docs.sparkSession, "neardup")
        self.docs = docs.select("doc_id", "text", row_key().alias("row"))
        signed = self.docs.select("doc_id", "row", "text").mapInArrow(_sign, "doc_id long, row long, node long, bands array<long>, sketch binary")
        self.signed = self.work.table(signed, "signed")

    def classes(self) -> DataFrame:
        """doc_id, class_id, node, row of every row, and first: whether it is its class's row with the smallest doc_id (equal rows all are)."""
        work, signed = self.work, self.signed
        nodes = signed.where("node is not null").groupBy("node").agg(F.min("row").alias("row"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        nodes = work.table(nodes, "nodes")
        rows = nodes.select("node", F.explode(F.array_distinct("bands")).alias("key"))
        buckets = work.table(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
        members = work.table(rows.join(small(buckets, buckets.count()), "key"), "members")
        central = members.groupBy("node").agg(F.sum("n").alias("meetings"))
        central = work.table(central, "central")
        known = central.count()
        ranked = members.select("key", "node").join(small(central, known), "node")
        heads = work.table(ranked.groupBy("key").agg(F.max(F.struct("meetings", "node"))["node"].alias("head")), "heads")
        pairs = members.join(small(heads, heads.count()), "key").where("node <> head").select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
        # whole texts only of nodes that met another, one row of each
        wanted = central.select("node").join(nodes, "node").select("row", "node", "sketch", "bands")
        wanted = work.table(wanted, "wanted")
        texts = self.docs.select("row", "text").join(small(wanted.select("row", "node"), known), "row").select("node", "text").dropDuplicates(["node"])
        self._texts, self._wanted = work.table(texts, "texts"), wanted
        links = self._confirmed(self._likely_pairs(pairs), "first")
        roots = work.table(components(links, work, "near"), "roots-1")
        more = self._across(members, roots)
        self._links = links.unionByName(more)
        if more.isEmpty():
            final = roots
        else:
            final = work.table(components(self._links.select("a", "b"), work, "all"), "roots-2")
        return self._named(final)

    def links(self) -> DataFrame:
        """a, b, similarity of the confirmed pairs of nodes; after classes()."""
        return self._links

    def _likely_pairs(self, pairs: DataFrame) -> DataFrame:
        side = self._wanted.select("node", "sketch")
        a, b = (side.withColumnsRenamed({"node": n, "sketch": f"s{n}"}) for n in "ab")
        likely = pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(_likely, "a long, b long")
        return self.work.table(likely, "likely")

    def _confirmed(self, pairs: DataFrame, name: str) -> DataFrame:
        a, b = (self._texts.withColumnsRenamed({"node": n, "text": f"t{n}"}) for n in "ab")
        tested = pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long, similarity double")
        return self.work.table(tested, f"links-{name}")

    def _across(self, members: DataFrame, roots: DataFrame) -> DataFrame:
        """Links between members of a bucket that are not in one component."""
        n = roots.count()
        placed = members.select("key", "node").join(small(roots, n), "node", "left").withColumn("root", F.coalesce("root", "node"))
        shares = placed.groupBy("key", "root").agg(F.count("*").alias("m"))
        mixed = shares.groupBy("key").agg(F.max(F.struct("m", "root")).alias("most"), F.sum("m").alias("n"), F.count("*").alias("roots")).where("roots > 1")
        blocks_of = lambda n: F.ceil(n / BUCKET_BLOCK).cast("int")
        # parts 0 to inner - 1: the largest component; from inner on: the others
        mixed = mixed.select("key", F.col("most.root").alias("major"), blocks_of(F.col("most.m")).alias("inner"), blocks_of(F.col("n") - F.col("most.m")).alias("outer"))
        mixed = self.work.table(mixed, "mixed")
        open_ = placed.join(small(mixed, mixed.count()), "key").join(self._wanted.select("node", "sketch", "bands"), "node").join(self._texts, "node")
        of_major, place = F.col("root") == F.col("major"), F.xxhash64("node")
        part = F.when(of_major, F.pmod(place, F.col("inner"))).otherwise(F.col("inner") + F.pmod(place, F.col("outer"))).cast("int")
        least = F.when(of_major, F.col("inner")).otherwise(0)
        cells = open_.withColumn("part", part).withColumn("other", F.explode(F.sequence(least, F.col("inner") + F.col("outer") - 1)))
        # in the cell of two parts, side 0 is the smaller part and 1 the other; 2: a part with itself
        side = F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1)
        cells = cells.groupBy("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).agg(F.collect_list(F.struct("node", "root", "sketch", "bands", "text", side.alias("side"))).alias("members"))
        return self.work.table(cells.select("key", "members").mapInArrow(_within, "a long, b long, similarity double"), "links-second")

    def _named(self, roots: DataFrame) -> DataFrame:
        n = roots.count()
        placed = self.signed.select("doc_id", "row", "node").join(small(roots, n), "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = self.work.table(placed, "placed")
        names = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("least")).where("n > 1").select("root", "class_id", "least", F.lit(True).alias("shared"))
        names = self.work.table(names, "names")
        named = placed.join(small(names, names.count()), "root", "left")
        return named.select("doc_id", F.when(F.col("shared"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), "node", "row", (F.col("shared").isNull() | (F.col("row") == F.col("least"))).alias("first"))


def duplicates(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """doc_id, class_id of every document."""
    return NearDuplicates(docs, work).classes().select("doc_id", "class_id")
