"""Near copies whose repeated lines differ, by plain Jaccard."""

import random

import pyarrow as pa
import pytest

pytest.importorskip("quarryline.llm")

from quarryline.llm import probminhash


def test_copies_with_other_repeated_lines(spark):
    rng = random.Random(13)
    rows = []
    for k in range(12):
        lines = [" ".join(f"p{k}l{n}w{j}" for j in range(rng.randrange(6, 9))) for n in range(40)]
        # one text has eight of its lines many times in a row
        again = [x for n, x in enumerate(lines) for _ in range(60 if n % 5 == 2 else 1)]
        rows += [(2 * k, "\n".join(lines)), (2 * k + 1, "\n".join(again))]
    sets = probminhash._sets(pa.array([t for _, t in rows]))
    for a, b in zip(sets[::2], sets[1::2], strict=True):
        plain, weighted = probminhash.similarity(*a, *b)
        assert plain >= probminhash.SIMILARITY > probminhash.CUT > weighted
    got = {r.doc_id: r.class_id for r in probminhash.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_members_of_a_bucket_meet_by_plain_bands():
    """A pair that only plain bands join, one text of it without a repeated shingle, is tested in the cell of the first band."""
    lines = [" ".join(f"l{n}w{j}" for j in range(7)) for n in range(40)]
    again = [x for n, x in enumerate(lines) for _ in range(60 if n % 5 == 2 else 1)]
    texts = ["\n".join(lines), "\n".join(again)]
    signed = next(probminhash._sign([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([1, 2]), pa.array(texts)], ["doc_id", "row", "text"])]))
    bands = probminhash._bands(signed.column("bands"))
    shared = set(bands[0].tolist()) & set(bands[1].tolist())
    members = [{"node": i, "root": i, "sketch": signed.column("sketch")[i].as_py(), "bands": signed.column("bands")[i].as_py(), "text": texts[i], "side": 2} for i in range(2)]
    cells = pa.RecordBatch.from_arrays([pa.array(sorted(shared)), pa.array([members] * len(shared))], ["key", "members"])
    links = [r for batch in probminhash._within([cells]) for r in batch.to_pylist()]
    assert shared and [(r["a"], r["b"]) for r in links] == [(0, 1)]
