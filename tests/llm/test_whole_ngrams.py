"""The language model with every n-gram against counts."""

import collections
import math
import random
import zlib

import pytest

pytest.importorskip("quarryline.llm")

from quarryline.llm import ngram
from quarryline.llm.queries import op2_ngram_score


def test_query_keeps_ngrams_seen_once(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 40)))) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op2_ngram_score(spark, str(tmp_path)).collect()}
    c1, c2, c3, n2, n3, follow, n_docs = *(collections.Counter() for _ in range(6)), 0
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            s = ["<s>", *t.split(), "</s>"]
            n_docs += 1
            c1.update(s[1:])
            c2.update(zip(s, s[1:], strict=False))
            c3.update(zip(s, s[1:], s[2:], strict=False))
    assert 1 in c2.values() and 1 in c3.values()
    for a, _ in c2:
        n2[a] += 1
    for (a, b, _), k in c3.items():
        follow[a, b] += k
        n3[a, b] += 1
    n, v, d = sum(c1.values()), len(c1), ngram.DISCOUNT

    def p(u, a, w):
        context = n_docs if a == "<s>" else c1[a]
        one = (c1[w] + 0.5) / (n + 0.5 * (v + 1))
        two = max(c2[a, w] - d, 0) / context + d * n2[a] / context * one if context else one
        if u is None or not follow[u, a]:
            return two
        return max(c3[u, a, w] - d, 0) / follow[u, a] + d * n3[u, a] / follow[u, a] * two

    for i, t in rows:
        s = ["<s>", *t.split(), "</s>"]
        want = sum(math.log10(p(s[j - 2] if j > 1 else None, s[j - 1], s[j])) for j in range(1, len(s)))
        assert got[i].score == pytest.approx(want, abs=0.03 * len(s))  # 8-bit codes
