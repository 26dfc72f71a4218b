"""The longest repeat as a limit of its own."""

import pyarrow as pa
import pytest

pytest.importorskip("quarryline.llm")

from quarryline.llm import repetition, text


def test_long_text_with_one_long_repeat():
    words = [f"w{i}" for i in range(33_000)]
    passage, little = words[1000:8000], words[1000:1100]
    texts = [words + passage, words + little, words]
    got = repetition._block(text.filled(pa.array([" ".join(t) for t in texts])))
    assert got["longest_repeat"].tolist() == [7000, 100, 0]
    assert (got["covered_words"] <= repetition.MAX_COVERED * got["n_words"]).all() and not got["base_failed"].any()
    assert got["kept"].tolist() == [False, True, True]
