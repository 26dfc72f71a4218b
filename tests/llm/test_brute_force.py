"""Operators that SQL cannot say, against plain versions; these share constants, the tokenizer and labelled samples, but no logic."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("quarryline.llm")

from quarryline.llm import langid, mixing, probminhash, secrets, shards, tiling, warc
from quarryline.llm.shared import Workspace

WORDS = [f"w{i}" for i in range(300)]
MASK = (1 << 64) - 1


def mix64(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = ((x ^ (x >> shift)) * factor) & MASK
    return x


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# ---- op1


def shingles(t):
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_many_blocks_of_a_bucket(spark, monkeypatch):
    """Small blocks, a large group of copies with strays around the threshold, against all pairs."""
    monkeypatch.setattr(probminhash, "BUCKET_BLOCK", 3)
    rng = random.Random(21)
    base = [rng.choice(WORDS) for _ in range(90)]
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(0 if i < 30 else rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((i, " ".join(words + ([f"end{i}"] if i % 2 else []))))
    got = {r.doc_id: r.class_id for r in probminhash.duplicates(table(spark, rows)).collect()}
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: find(i) for i in sets} and len(set(got.values())) > 1


# ---- op3


def greedy_tiles(item, text, least):
    """The longest common unmarked run, earliest in the item, then in the text; again and again."""
    free_i, free_t, out = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and free_i[p + n] and free_t[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < least:
            return out
        out.append((p, t, n))
        free_i[p : p + n] = free_t[t : t + n] = [False] * n


def test_decontamination_against_greedy_tiling(spark):
    rng = random.Random(22)
    items = [(k, [rng.choice(WORDS) for _ in range(rng.randrange(6, 70))]) for k in range(6)]
    rows = []
    for i in range(60):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(0, 60))]
        item = items[i % 6][1]
        cuts = sorted(rng.sample(range(len(item)), 3))
        pieces = [item[a:b] for a, b in zip([0, *cuts], [*cuts, len(item)], strict=True)]
        rng.shuffle(pieces)
        for piece in pieces[: rng.randrange(0, 5)]:
            at = rng.randrange(0, len(words) + 1)
            words[at:at] = piece
        rows.append((i, " ".join(words)))
    found = tiling.leaks(table(spark, rows), table(spark, [(k, " ".join(w)) for k, w in items], "item_id long, text string"), block_chars=300).collect()
    got = {(r.doc_id, r.item_id): (r.item_words, r.covered_words, r.longest_tile, sorted((t.item_start, t.doc_start, t.length) for t in r.tiles)) for r in found}
    want = {}
    for i, text in rows:
        for k, item in items:
            tiles = greedy_tiles(item, text.split(), tiling.LEAST)
            covered = sum(n for _, _, n in tiles)
            if covered >= tiling.COVERAGE * len(item):
                want[i, k] = (len(item), covered, tiles[0][2], sorted(tiles))
    assert got == want and 10 < len(want) < 60


# ---- op4


def plain_slot(x, n, seed=0):
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    keys = [int.from_bytes(hashlib.sha256(f"{seed}:{n}:{r}".encode()).digest()[:8], "little") for r in range(shards.ROUNDS)]
    while True:
        left, right = x >> half, x & ((1 << half) - 1)
        for key in keys:
            left, right = right, left ^ (mix64((right + key) & MASK) & ((1 << half) - 1))
        x = left << half | right
        if x < n:
            return x


def test_shards_against_a_plain_layout(spark):
    rng = random.Random(23)
    rows = [(i if i % 5 else None, None if i == 7 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 120)))) for i in range(50)]
    work = Workspace(spark, "plain-shards")
    index = {r.slot: r for r in shards.materialise(table(spark, rows).coalesce(1), work, sequence=64, per_shard=7).collect()}
    with open(shards.VOCABULARY, "rb") as f:
        ranks = f.read()
    end, encode = len(ranks.splitlines()), shards._encoder(ranks).encode_ordinary
    stream, owner = [], []
    for i, t in rows:
        tokens = [*encode(t or ""), end]
        stream += tokens
        owner += [i] * len(tokens)
    n = -(-len(stream) // 64)
    assert sorted(index) == list(range(n))
    for s in range(n):
        part, of = stream[64 * s : 64 * s + 64], owner[64 * s : 64 * s + 64]
        slot = plain_slot(s, n)
        data = np.array(part + [end] * (64 - len(part)), "<u2").tobytes()
        r = index[slot]
        assert (r.sequence, r.shard, r.byte_offset, r.n_tokens, r.doc_ids, r.sha256) == (s, slot // 7, slot % 7 * 128, len(part), list(dict.fromkeys(of)), hashlib.sha256(data).hexdigest())
        assert next(shards.read_slots(work.path("shards"), slot, 1, np.dtype("<u2"), 64, 7)).tobytes() == data


# ---- op7


def test_captures_with_one_page_and_payload(spark):
    big = "<p>" + "é" * 100
    rows = [(1, "http://a/x", big), (1, "http://b/y", big), (2, "http://c/z", big), (None, "http://d/w", big), (3, "http://e/v", "other " * 40), (3, "http://e/v", "other " * 40)]
    frame = spark.createDataFrame([(*r, "x", 9) for r in rows], "page_id long, url string, html string, record_id string, payload_bytes int")
    got = warc.captures(frame.repartition(3)).collect()
    assert collections.Counter((r.page_id, r.uri, r.request.uri) for r in got) == collections.Counter((i, u, u) for i, u, _ in rows)
    assert {(r.page_id, r.uri): (r.type, r.refers_to_page, r.payload_bytes) for r in got if r.digest == hashlib.sha256(big.encode()).hexdigest()} == {
        (1, "http://a/x"): ("response", None, 203), (1, "http://b/y"): ("response", None, 203), (2, "http://c/z"): ("revisit", 1, 203), (None, "http://d/w"): ("revisit", 1, 203),
    }


def test_a_record_larger_than_a_piece(tmp_path):
    payload = bytes(random.Random(24).randrange(256) for _ in range(3)) * 1_200_000
    path = tmp_path / "a.warc.gz"
    path.write_bytes(warc.capture(1, "http://a/x", payload, "d", None, None, False) * 2)
    with path.open("rb") as f:
        found = list(warc.records(f))
    assert [h["warc-type"] for h, _ in found] == ["request", "response", "metadata"] * 2
    assert all(b.endswith(payload) for h, b in found if h["warc-type"] == "response")


# ---- op8


def test_mix_of_copies_without_ids(spark):
    """A third of the rows are one text without an id: their copies are taken in part, the same number on any layout."""
    rng = random.Random(25)
    rows = [(None, "the very same text " * 3, "a")] * 500 + [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 30))), rng.choice("abc")) for i in range(1000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counts = [collections.Counter((r.doc_id, r.size, r.source, r.taken) for r in mixing.mix(frame.repartition(n)).collect()) for n in (1, 7)]
    assert counts[0] == counts[1] and sum(counts[0].values()) == len(rows)
    taken = collections.Counter()
    for (_, size, source, n), k in counts[0].items():
        assert n <= 2 * size
        taken[source] += n * k
    goal = {r.source: r.target for r in mixing.mix(frame).select("source", "target").distinct().collect()}
    assert all(abs(taken[s] - t) <= 30 for s, t in goal.items())
    work = Workspace(spark, "repeated")
    out = mixing.repeated(frame, mixing.mix(frame), work).groupBy("source").count().collect()
    mixed = mixing.mix(frame).groupBy("source").sum("epochs").collect()
    assert {r[0]: r[1] for r in out} == {r[0]: r[1] for r in mixed}


# ---- op9


def plain_model(texts):
    order = "^" + secrets.SYMBOLS
    ordinary = collections.Counter()
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""")
    for t in texts:
        clean = re.sub("[0-9a-f]{24,}", " ", re.sub("AKIA[A-Z0-9]{16,}", " ", assign.sub(" ", t or "")))
        for run in re.findall("[A-Za-z0-9+/_.=-]{2,}", clean):
            if not (re.search("[0-9]", run) and len(run) >= secrets.CANDIDATE_CHARS):
                ordinary.update(zip("^" + run, run, strict=False))
    return order, ordinary


def test_markov_spans_against_a_plain_chain(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = frame.collect()
    assert len(rows) <= secrets.SAMPLE_DOCS
    order, ordinary = plain_model([r.text for r in rows])
    random_ = collections.Counter()
    for r in secrets.random_strings(spark).collect():
        random_.update(zip("^" + r.value, r.value, strict=False))

    def logp(counts, a, b):
        total = sum(counts[a, x] for x in secrets.SYMBOLS) + secrets.ALPHA * len(secrets.SYMBOLS)
        return math.log((counts[a, b] + secrets.ALPHA) / total)

    model = {a + b: logp(random_, a, b) - logp(ordinary, a, b) for a in order for b in secrets.SYMBOLS}
    assert secrets.train(frame) == pytest.approx(model)
    rng = random.Random(26)
    planted = [hashlib.sha256(str(i).encode()).hexdigest()[:20] + "Zq" for i in range(20)] + ["ordinary_identifier_2", "some/path/to/file-v1.txt", "ScriptModuleLoader2"]
    texts = [(i, " ".join(rng.choice([*planted, *WORDS]) for _ in range(30))) for i in range(60)] + [(1000 + r.doc_id, r.text) for r in rows]
    texts.append((999, " ".join(f"k{i}_{hashlib.sha256(str(i).encode()).hexdigest()[:22]}" for i in range(700))))
    found = 0
    for r in secrets.report(table(spark, texts), model).collect():
        text = dict(texts)[r.doc_id] or ""
        want = []
        for m in re.finditer(secrets.RUN, text):
            steps = list(zip("^" + m[0], m[0], strict=False))
            mean = sum(model[a + b] for a, b in steps) / len(steps)
            if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and mean >= secrets.THRESHOLD:
                want.append(f"markov:{m.start()}:{m.end()}")
        assert [s for s in r.spans.split(",") if s.startswith("markov")] == want
        found += len(want)
    assert found > 700


def test_markov_chain_on_strings_it_has_not_seen(spark, sf):
    model = secrets.train(spark.read.parquet(f"{sf}/documents.parquet"))
    rng = random.Random(27)
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    strings = [(i, "".join(rng.choice(digits) for _ in range(rng.randrange(20, 44)))) for i in range(400)]
    strings = [(i, s) for i, s in strings if re.search("[0-9]", s)]
    plain = [(i, f"{rng.choice(['the', 'open', 'table'])}_{rng.choice(['counter', 'session', 'gateway'])}_{rng.choice(['value', 'index', 'limits'])}_{rng.randrange(9)}") for i in range(400)]
    hit = lambda rows: sum("markov" in r.spans for r in secrets.report(table(spark, rows), model).collect()) / len(rows)
    assert hit(strings) >= 0.9 and hit(plain) <= 0.05


# ---- op10


def grams(text):
    """Counts by the operator's hash of each n-gram."""
    letters = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0 for c in f" {text} "]
    counts = collections.Counter()
    for i, c in enumerate(letters):
        before, after = letters[i - 1] if i else 0, letters[i + 1] if i + 1 < len(letters) else 0
        if c:
            counts[mix64(c) >> 24] += 1
            counts[mix64(((before << 42 | c << 21 | after | 1 << 63) * 3) & MASK) >> 24] += 1
        if c or before:
            counts[mix64((before << 21 | c | 1 << 63) ^ 1 << 62) >> 24] += 1
    return counts


def ranked(counts, size):
    return {g: k for k, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size])}


def test_languages_against_plain_profiles(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    learned = collections.defaultdict(collections.Counter)
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None and r.text is not None:
            learned[r.lang].update(grams(r.text))
    profiles = {lang: ranked(c, langid.PROFILE) for lang, c in sorted(learned.items())}
    for r in langid.identify(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        text = next(x.text for x in rows if x.doc_id == r.doc_id)
        mine = ranked(grams(text or ""), langid.PROFILE) if text else {}
        if not mine:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        far = {lang: sum(abs(p[g] - k) if g in p else langid.PROFILE for g, k in mine.items()) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 - far[best] / (len(mine) * langid.PROFILE))
