"""Stages remove rows, not every row that has the same id."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_a_bad_row_takes_no_clean_row_of_its_id(spark, tmp_path):
    rng = random.Random(14)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(80))
    copied, leaked, a, b, c, d = (text() for _ in range(6))
    spark.createDataFrame([(1, leaked)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    got = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    clean = [(None, a), (None, b), (7, c), (8, d)]
    near = [(1, copied), (None, copied + " end"), (7, copied + " more"), (7, copied), (8, d)]
    assert got(pipeline.near_dedup(spark, frame(clean + near), str(tmp_path))) == sorted([*clean, (1, copied)], key=str)
    leaks = [(None, leaked), (7, "x " + leaked)]
    assert got(pipeline.decontaminate(spark, frame(clean + leaks), str(tmp_path))) == sorted(clean, key=str)


def test_a_tidy_task_gives_all_its_batches():
    import pyarrow as pa

    from quarryline.llm.shared import tidy

    batches = [pa.RecordBatch.from_pydict({"n": [k]}) for k in range(3)]
    assert list(tidy(lambda rows: (b for b in rows))(iter(batches))) == batches
    assert list(tidy(iter)(iter([]))) == []
    with pytest.raises(ZeroDivisionError):
        list(tidy(lambda rows: (1 // 0 for _ in rows))(iter(batches)))
