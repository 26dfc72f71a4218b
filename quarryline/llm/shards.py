"""Training-order materialisation: token sequences at keyed, permuted slots in fixed-stride binary shards.

Documents are tokenised once, each followed by the end token, and laid end to end in scan order (partition, row) into
sequences of SEQUENCE tokens; the last is filled up with end tokens. Sequence i of n goes to slot P(i), where P is a Feistel
network keyed by a seed on the smallest even number of bits that holds n, walked until it falls below n. Shard s holds the slots
from s x SHARD_SEQUENCES on, each at a fixed stride, so slot k is read with one seek and training resumes at any slot.

Token blocks are a compressed table in the shared folder, so sizes are known before slots are dealt and nothing is tokenised
twice. Fragments of sequences are sent to the task of their shard and written in slot order, to a temporary name and
then moved: a repeated task writes the same bytes again.

Scan order is that of Spark's splits of the input, so the same files under the same split sizes give the same shards.

Defined results: null and empty texts are one end token; an empty table makes no shard and no row; repeated rows are
repeated documents, each in its place, so there are no ties; strings like those of special tokens are ordinary text. A text is
encoded whole, so memory grows with the longest one. Only doc_id and text are read, so other columns may have any name. Tokens
are little-endian uint16, or uint32 for vocabularies of more than 65,536.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, tidy
from .text import U, filled, mix

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Split pattern of the vocabulary. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEQUENCE, SHARD_SEQUENCES = 2048, 8192
BLOCK_TOKENS = 1 << 16
#: Of compression; 6 makes blocks a tenth smaller than 3, for little time beside that of tokenising.
LEVEL = 6
#: Tasks that write shards; beyond this number of shards a task writes several, one after the other.
WRITERS = 20_000
ROUNDS = 6
RESULT = "slot long, sequence long, shard long, byte_offset long, n_tokens int, doc_ids array<long>, sha256 string"


class Feistel:
    """A keyed permutation of 0..n-1."""

    def __init__(self, n: int, seed: int = 0):
        self.n = n
        self.half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
        self.keys = [int.from_bytes(hashlib.sha256(f"{seed}:{n}:{r}".encode()).digest()[:8], "little") for r in range(ROUNDS)]

    def _once(self, x: np.ndarray, keys: list[int], back: bool) -> np.ndarray:
        low = U((1 << self.half) - 1)
        left, right = x >> U(self.half), x & low
        for key in keys:
            if back:
                left, right = right ^ (mix(left + U(key)) & low), left
            else:
                left, right = right, left ^ (mix(right + U(key)) & low)
        return left << U(self.half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        keys = self.keys[::-1] if back else self.keys
        out = self._once(np.asarray(x, U), keys, back)
        while len(over := np.flatnonzero(out >= U(self.n))):
            out[over] = self._once(out[over], keys, back)
        return out.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, False)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


@lru_cache(4)
def _encoder(ranks: bytes):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def _blocks(ids: Iterator[tuple[int | None, np.ndarray]]) -> Iterator[tuple[np.ndarray, list, list]]:
    """Tokens of whole blocks with the documents in them and their first tokens there."""
    parts, docs, starts, size = [], [], [], 0
    for doc, tokens in ids:
        while True:
            docs.append(doc)
            starts.append(size)
            room = BLOCK_TOKENS - size
            parts.append(tokens[:room])
            size += len(parts[-1])
            if size == BLOCK_TOKENS:
                yield np.concatenate(parts), docs, starts
                parts, docs, starts, size = [], [], [], 0
            tokens = tokens[room:]
            if not len(tokens):
                break
    if size:
        yield np.concatenate(parts), docs, starts


def tokenise(docs: DataFrame, work: Workspace, vocabulary: str = VOCABULARY) -> tuple[DataFrame, np.dtype, int]:
    """The table of token blocks (part, first token in it, n, data, doc_ids, starts), the token type, the end token."""
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    end = len(ranks.splitlines())
    kind = np.dtype("<u2" if end <= 0xFFFF else "<u4")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, first = _encoder(shared.value).encode_ordinary, TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=LEVEL)

        def tokens() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), filled(batch.column(1)).to_pylist(), strict=True):
                    yield doc, np.array([*encode(text), end], kind)

        for block, ids, starts in _blocks(tokens()):
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([first]), pa.array([len(block)]), pa.array([pack.compress(block.tobytes())]), pa.array([ids], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int64()))], ["part", "first", "n", "data", "doc_ids", "starts"])
            first += len(block)

    rows = docs.select("doc_id", "text").mapInArrow(run, "part long, first long, n long, data binary, doc_ids array<long>, starts array<long>")
    return work.table(rows, "tokens"), kind, end


def materialise(docs: DataFrame, work: Workspace | None = None, seed: int = 0, vocabulary: str = VOCABULARY, sequence: int = SEQUENCE, per_shard: int = SHARD_SEQUENCES) -> DataFrame:
    """RESULT: a row for each sequence written. The shards are work.path("shards")/shard-00000.bin and so on."""
    work = work or Workspace(docs.sparkSession, "shards")
    spark = docs.sparkSession
    blocks, kind, end = tokenise(docs, work, vocabulary)
    base, total = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a number for each scan task
        base[r["part"]] = total
        total += r["n"]
    n = -(-total // sequence)
    if not n:
        return spark.createDataFrame([], RESULT)
    feistel, n_shards = Feistel(n, seed), -(-n // per_shard)

    @tidy
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                tokens, at = np.frombuffer(unpack.decompress(row["data"]), kind), base[row["part"]] + row["first"]
                seqs = np.arange(at // sequence, (at + len(tokens) - 1) // sequence + 1)
                slots, starts = feistel.slot(seqs), np.array(row["starts"])
                out: list[list] = [[], [], [], [], [], []]
                for s, slot in zip(seqs.tolist(), slots.tolist(), strict=True):
                    a, b = max(s * sequence - at, 0), min((s + 1) * sequence - at, len(tokens))
                    i, j = int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b, "left"))
                    for column, x in zip(out, (slot // per_shard, slot, s, at + a - s * sequence, pack.compress(tokens[a:b].tobytes()), row["doc_ids"][i:j]), strict=True):
                        column.append(x)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["shard", "slot", "sequence", "offset", "data", "doc_ids"])

    root, stride = work.mkdirs("shards"), sequence * kind.itemsize

    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        unpack = zstandard.ZstdDecompressor()
        where, folder = fs.FileSystem.from_uri(root)
        shard, out, rows, held, ids = -1, None, [], None, []

        def name(s: int) -> str:
            return f"{folder}/shard-{s:05d}.bin"

        def flush() -> None:
            nonlocal held, ids
            if held is not None:
                slot, seq, buffer, used = held
                out.write(buffer.tobytes())
                rows.append((slot, seq, slot // per_shard, slot % per_shard * stride, used, list(dict.fromkeys(ids)), hashlib.sha256(buffer.tobytes()).hexdigest()))
                held, ids = None, []

        def close() -> None:
            if out is not None:
                flush()
                out.close()
                where.move(f"{name(shard)}.{attempt}", name(shard))

        def batch_of() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.string()]
            got = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [x.split()[0] for x in RESULT.split(", ")])
            rows.clear()
            return got

        attempt = f"tmp-{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    close()
                    shard, out = row["shard"], where.open_output_stream(f"{name(row['shard'])}.{attempt}")
                if held is None or held[0] != row["slot"]:
                    flush()
                    held = [row["slot"], row["sequence"], np.full(sequence, end, kind), 0]
                tokens = np.frombuffer(unpack.decompress(row["data"]), kind)
                held[2][row["offset"] : row["offset"] + len(tokens)] = tokens
                held[3] += len(tokens)
                ids += row["doc_ids"]
            if len(rows) > 4096:
                yield batch_of()
        close()
        yield batch_of()

    placed = blocks.select("part", "first", "n", "data", "doc_ids", "starts").mapInArrow(place, "shard long, slot long, sequence long, offset long, data binary, doc_ids array<long>")
    writers = min(n_shards, WRITERS)
    dealt = placed.repartitionById(writers, F.floor(F.col("shard") * writers / n_shards).cast("int")).sortWithinPartitions("shard", "slot", "offset")
    done = work.table(dealt.mapInArrow(write, RESULT), "index")
    work.drop("tokens")
    return done


def read_slots(root: str, slot: int, count: int, kind: np.dtype, sequence: int = SEQUENCE, per_shard: int = SHARD_SEQUENCES) -> Iterator[np.ndarray]:
    """Sequences from a slot on, sequentially. root: the folder of the shards."""
    from pyarrow import fs

    where, folder = fs.FileSystem.from_uri(root)
    stride = sequence * kind.itemsize
    while count > 0:
        shard, at = divmod(slot, per_shard)
        with where.open_input_file(f"{folder}/shard-{shard:05d}.bin") as f:
            f.seek(at * stride)
            for _ in range(min(count, per_shard - at)):
                data = f.read(stride)
                if len(data) < stride:
                    return
                yield np.frombuffer(data, kind)
                slot, count = slot + 1, count - 1
