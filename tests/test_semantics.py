"""Literal cases of what operators decide."""

import re

import pytest
from pyspark.sql import functions as F

from quarryline.functions import identifiers, markdown
from quarryline.functions import text as T
from quarryline.operators import catalog, context, discovery, evidence, filters, lexical, quality, recovery, state
from quarryline.sources import datasets
from quarryline.sources import pages as source_pages
from quarryline.sources import vectors as vector_store
from quarryline.streaming import jobs


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- identifiers


def test_spellings_of_an_identifier():
    forms = ("N/auth", "N auth", "Nauth", "N-auth", "N_auth", "n/AUTH")
    assert {identifiers.parse(f).canonical for f in forms} == {"n/auth"}
    assert {"N/auth", "N auth", "Nauth", "N-auth", "N_auth"} <= set(identifiers.parse("N/auth").aliases)
    assert identifiers.parse("FooBar").canonical == "foo/bar" and identifiers.parse("`a.b/c/d`").segments == ["a", "b", "c", "d"]
    for bad in ("a b c d", "ab", "", "x!y"):
        with pytest.raises(ValueError):
            identifiers.parse(bad)


@pytest.mark.parametrize(
    ("text", "want"),
    [("DataSuite", []), ("Nauth", ["n/auth"]), ("Gatelet script", []), ("N/ui/serverWidget", ["n/ui/serverwidget"]), ("use N/record and N/search, N/record", ["n/record", "n/search"]),
     ("N/crypto/certificate模块", ["n/crypto/certificate"]), ("List/Record, plug-in", ["list/record", "plug/in"]), ("N search for Nauth", ["n/search"])],
)
def test_identifiers_of_a_text(text, want):
    assert [x.canonical for x in identifiers.extract(text)] == want


def test_plan_of_a_question(spark):
    rows = [("N/record 模块 of the Suite",), ("list N / * and foo/*",), ("nauth",)]
    got = [r.p for r in frame(spark, rows, "q string").select(identifiers.query_plan("q").alias("p"), identifiers.identifiers("q").alias("i")).collect()]
    assert got[0].latin_terms == ["n", "record", "suite"] and got[0].cjk_terms == ["模块"] and [x.canonical for x in got[0].qualified_identifiers] == ["n/record"]
    assert got[1].namespace_wildcards == ["n", "foo"] and got[1].discovery_intent and not got[0].discovery_intent
    assert got[2].qualified_identifiers == []
    asked = frame(spark, rows, "q string").select(identifiers.identifiers("q").alias("i")).collect()
    assert [x.canonical for x in asked[2].i] == ["n/auth"]


def test_search_for_identifiers(spark):
    body = [(1, "a.md", 0, "X", "call n record here"), (2, "b.md", 0, "X", "n then other then record"), (3, "c.md", 0, "X", "nrecord is short"), (4, "d.md", 0, "X", "record only"), (5, "e.md", 0, "X", "search n search"), (6, "f.md", 0, "Y", "nothing to see"), (7, "g.md", 0, "Y", "nothing else to see")]
    corpus = lexical.Corpus(frame(spark, body, "passage_id int, path string, ordinal int, title string, body string"))
    asked = frame(spark, [(1, "what is N/record"), (2, "N/record and N/search"), (3, "plain words")], "query_id int, question string")
    got = lexical.search(asked, corpus, "qualified").collect()
    assert {(r.query_id, r.passage_id) for r in got} == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (2, 5)}
    score = {(r.query_id, r.passage_id): r.score for r in got}
    assert score[1, 1] > score[1, 2]
    each = lexical.search_identifiers(asked, corpus, 1).collect()
    assert {(r.query_id, r.canonical) for r in each} == {(1, "n/record"), (2, "n/record"), (2, "n/search")} and len(each) == 3
    first = lexical.stage_one(asked, corpus)
    assert {r.passage_id for r in first.where("query_id = 1").collect()} == {1, 2, 3}
    assert lexical.stage_one(asked, corpus, scope="history").where("query_id = 2").count() == 0


def test_stored_postings_answer_alike(spark, tmp_path):
    body = [(i, f"p{i}.md", 0, f"title {i % 3}", " ".join(f"w{(i * k) % 17}" for k in range(1, 30))) for i in range(40)]
    corpus = lexical.Corpus(frame(spark, body, "passage_id int, path string, ordinal int, title string, body string"))
    corpus.save(str(tmp_path / "index"), 8)
    stored = lexical.StoredCorpus(corpus.passages, corpus.weights, root=str(tmp_path / "index"))
    asked = frame(spark, [(1, "w3 title w5"), (2, "w16 w2")], "query_id int, question string")
    for mode in ("strict", "relaxed", "prefix"):
        a, b = (sorted(map(tuple, lexical.search(asked, c, mode, 10).collect())) for c in (corpus, stored))
        assert a == b and a
    plan = stored.tokens(["w3"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_phrase_groups_of_spellings(spark):
    body = [(1, "a.md", 0, "X", "the chatbot connector"), (2, "b.md", 0, "X", "the chatbox connector"), (3, "c.md", 0, "X", "connector")]
    corpus = lexical.Corpus(frame(spark, body, "passage_id int, path string, ordinal int, title string, body string"))
    asked = frame(spark, [(1, "chatbox connector", {"chatbox": ["chatbot"]})], "query_id int, question string, variants map<string,array<string>>")
    found = lexical.bm25(lexical.phrase_terms(asked, variants="variants"), corpus).collect()
    assert {r.passage_id for r in found} == {1, 2}


# ---- intents and budgets


@pytest.mark.parametrize(
    ("question", "want"),
    [("what did we discuss last time", "history"), ("N/record模块有哪些方法？", "exact_evidence"), ("compare a and b", "comparison"), ("deep dive on queues", "research"), ("how to install it", "concept"), ("invoice approval", "exact_entity"), ("纯中文问题", "concept"),
     ("配置gateway系统内ai connector的mcp工具的完整步骤是什么", "concept"), ("a b", "concept")],
)
def test_intents(spark, question, want):
    assert frame(spark, [(question,)], "q string").select(T.intent("q")).first()[0] == want


def test_budgets(spark):
    rows = [(x,) for x in ("exact_entity", "concept", "comparison", "research", "history", "exact_evidence", "other")]
    got = frame(spark, rows, "i string").select(context.budget(F.col("i"), 3), context.budget(F.col("i"), 20, 5000), context.budget(F.col("i"), 30)).collect()
    assert [r[0] for r in got] == [2000, 4000, 8000, 16000, 4000, 4000, 4000] and all(r[1] == 5000 for r in got) and [r[2] for r in got] == [12000] * 3 + [16000] + [12000] * 3


# ---- markdown


def test_blocks_of_a_page():
    text = "# A\nline one\nline two\n\n- x\n1. y\n\n| a | b |\n|---|---|\n| c | d |\nafter\n```py\n# no heading\n```\n## B ##\n#tag\n####### x\n~~~\nopen"
    assert list(markdown.blocks(text)) == [
        ("heading", 1, "A"), ("paragraph", 0, "line one\nline two"), ("list", 0, "- x\n1. y"), ("table", 0, "| a | b |\n|---|---|\n| c | d |"), ("paragraph", 0, "after"),
        ("fence", 0, "```py\n# no heading\n```"), ("heading", 2, "B"), ("paragraph", 0, "#tag\n####### x"), ("fence", 0, "~~~\nopen"),
    ]
    assert [s for s in markdown.sections(text)][:2] == [(("A",), "line one\nline two\n\n- x\n1. y\n\n| a | b |\n|---|---|\n| c | d |\n\nafter\n\n```py\n# no heading\n```"), (("A", "B"), "#tag\n####### x\n\n~~~\nopen")]


def test_sections_are_split_at_their_units():
    words = lambda a, n: " ".join(f"w{i}" for i in range(a, a + n))
    parts = markdown.split_section("\n\n".join([words(0, 30), words(30, 20), words(50, 40), words(90, 130), words(220, 5)]), 60, 100, 10)
    assert parts[0] == f"{words(0, 30)}\n\n{words(30, 20)}" and parts[1] == f"{words(40, 10)}\n\n{words(50, 40)}"
    assert parts[2:] == [words(90, 100), words(180, 40), words(220, 5)]
    one = markdown.split_section("\n\n".join([words(0, 50), words(50, 58)]), 60, 100, 10)
    assert one == [words(0, 50), f"{words(40, 10)}\n\n{words(50, 58)}"]


# ---- context


def test_window_around_a_match():
    costs = [60] + [400] * 20
    costs[12] = 0
    got = context.window_of(costs, [12])
    assert got == sorted(got) and got[0] == 0 and {11, 12, 13} <= set(got) and not {1, 20} & set(got)
    assert sum(costs[i] for i in got) <= 2400 and max(got) - 12 >= 12 - min(i for i in got if i)
    assert context.window_of([100] * 3, [2]) == [0, 1, 2] and context.window_of([5000] * 3, []) == [0, 1, 2]


def test_pages_are_filled_best_hits_first(spark):
    text = lambda n: " ".join(["x"] * n)
    passages = [("a.md", f"a{i}", i, text(300)) for i in range(20)] + [("b.md", f"b{i}", i, text(10)) for i in range(8)] + [("c.md", "c0", 0, text(4))]
    hits = [(1, "a.md", "a12", 10.0), (1, "a.md", "a3", 1.0), (1, "c.md", "c0", 6.0), *((1, "b.md", f"b{i}", 5.9 - i) for i in range(5))]
    pages = frame(spark, [(1, "a.md", 1), (1, "c.md", 2), (1, "b.md", 3)], "query_id int, path string, rank int")
    got = context.fill_pages(pages, frame(spark, passages, "path string, passage_id string, ordinal int, text string"), frame(spark, hits, "query_id int, path string, passage_id string, score double")).orderBy("priority").collect()
    names = [r.passage_id for r in got]
    assert names[:3] == ["a12", "c0", "b0"] and names[-2:] == ["b1", "b2"]
    deep = names[3:-2]
    assert deep == sorted(deep, key=lambda x: int(x[1:])) and deep[0] == "a0" and {"a11", "a13"} <= set(deep) and sum(300 for _ in deep) <= 2400
    stats = {r.path: (r.peak, r.strong) for r in context.page_stats(frame(spark, [(1, "x", -1.0), (1, "y", -2.0)], "query_id int, path string, score double")).collect()}
    assert stats == {"x": (0.0, True), "y": (0.0, True)}


def packed(spark, rows, budget):
    passages = frame(spark, [(1, n, p, f"{p}{n}", o, t) for n, (p, o, t) in enumerate(rows)], "query_id int, priority int, path string, passage_id string, ordinal int, text string")
    return context.pack(passages, frame(spark, [(1, budget)], "query_id int, budget int")).orderBy("place").collect()


def test_context_is_packed_once(spark):
    got = packed(spark, [("a", -1, "alpha beta gamma"), ("a", -1, "gamma delta")], 4)
    assert [r.content for r in got] == ["alpha beta gamma\n\ndelta"]
    got = packed(spark, [("a", -1, "alpha beta"), ("b", -1, "gamma delta"), ("a", -1, "epsilon zeta"), ("a", -1, "alpha beta")], 10)
    assert [(r.path, r.content, r.tokens) for r in got] == [("a", "alpha beta\n\nepsilon zeta", 4), ("b", "gamma delta", 2)]
    got = packed(spark, [("a", -1, "alpha beta"), ("a", -1, "beta gamma")], 10)
    assert (got[0].tokens, got[0].omitted) == (3, 1)


def test_chunks_are_stitched_without_their_overlap(spark):
    body = "# A\n\n## Setup\n\n" + "\n\n".join(" ".join(f"p{i}w{w}, value." for w in range(12)) for i in range(8))
    chunks = markdown.chunk("wiki/a.md", body, 50, 60, 16)
    assert len(chunks) >= 3
    order = [chunks[1], chunks[0], *chunks[2:]]
    got = packed(spark, [("wiki/a.md", c["ordinal"], c["text"]) for c in order], 10_000)
    for i in range(8):
        for w in range(12):
            assert len(re.findall(rf"\bp{i}w{w}\b", got[0].content)) == 1


def test_repeated_paragraphs_are_packed_once_but_no_page_is_lost(spark):
    note = "A long paragraph about retry budgets and quotas that pages repeat word by word in their texts."
    got = packed(spark, [("a", 0, f"{note}\n\nown a"), ("b", 0, f"{note}\n\nown b"), ("c", 0, note)], 1000)
    assert [(r.path, r.content) for r in got] == [("a", f"{note}\n\nown a"), ("b", "own b"), ("c", note)]
    assert packed(spark, [("a", 0, "one two three"), ("b", 0, "four"), ("c", 0, "five six")], 3)[0].used == [0]
    assert [r.path for r in packed(spark, [("a", 0, "one two three four"), ("b", 0, "four"), ("c", 0, "five six")], 3)] == ["b", "c"]


def test_parents_under_another_heading_stay_out(spark):
    around = frame(spark, [("a", 0, "before", ["X"]), ("a", 1, "mid", ["Y"]), ("a", 2, "behind", ["Y"])], "path string, ordinal int, text string, heading_path array<string>")
    hits = around.where("ordinal = 1").select(F.lit(1).alias("query_id"), F.lit(1).alias("rank"), "path", "ordinal", "text", "heading_path")
    assert context.expand_parents(hits, around).first().text == "mid\n\nbehind"


def test_envelope_and_citations(spark):
    q = frame(spark, [(1, "x"), (2, " "), (3, "y")], "query_id int, question string")
    results = frame(spark, [(1, "a", "p1", 2.0, 1), (1, "b", "p2", 1.0, 2)], "query_id int, path string, passage_id string, score double, rank int")
    body = frame(spark, [(1, 1, "a", "text of a", 3, 7)], "query_id int, place int, path string, content string, tokens int, omitted int")
    got = {r.query_id: r for r in context.envelope(q, results, 1, body, frame(spark, [(1, "raw", ["wiki_zero_results"])], "query_id int, level string, reasons array<string>")).collect()}
    assert (got[1].code, got[2].code, got[3].code, got[2].ok) == ("ok", "missing_question", "no_results", False)
    assert got[1].counters.asDict() == {"results": 1, "additional": 1, "pages": 1, "tokens": 3, "omitted": 7} and got[1].warnings == ["context_omitted", "raw_fallback"]
    assert {r.path: r.cited for r in context.citations(results, body).collect()} == {"a": True, "b": False}


# ---- hops


def test_hits_are_judged_in_the_light_of_the_pool(spark):
    q = frame(spark, [(1, "carrier gateway rates")], "query_id int, question string")
    body = frame(spark, [(1, "a.md", "", "carrier gateway"), (2, "b.md", "", "rates of parcels")], "passage_id int, path string, title string, text string")
    first = frame(spark, [(1, 1, 2.0), (1, 2, 1.0)], "query_id int, passage_id int, score double")
    pool, _ = evidence.hop(q, first, body, lambda x: x.select("query_id", F.lit(1).alias("passage_id"), F.lit(1).alias("rank"), F.lit(1.0).alias("score")).limit(0), 1)
    got = {r.passage_id: r.evidence for r in pool.collect()}
    # all three words are in the pool, so each hit gains the whole of what context gives
    assert got[1] == pytest.approx(2 / 3 + 0.15 + 0.1) and got[2] == pytest.approx(1 / 3 + 0.1)


# ---- recovery


def test_next_step_of_the_ladder(spark):
    rows = [
        (True, True, "knowledge", False, "unknown", False, False, "coverage"), (True, True, "history", False, "yes", False, False, None), (False, False, "knowledge", False, "no", False, True, "wiki_relaxed"),
        (False, True, "all", False, "yes", True, True, "all_coverage"), (True, False, "knowledge", False, "yes", False, False, "raw_zero"), (True, False, "knowledge", True, "yes", False, False, None),
        (False, False, "all", False, "unknown", False, False, "raw_zero"), (True, False, "knowledge", False, "no", False, False, None),
    ]
    df = frame(spark, rows, "primary boolean, uncovered boolean, scope string, strong boolean, raw string, answered boolean, relaxed boolean, want string")
    got = df.select("want", "primary", recovery.plan_fallback(*[F.col(c) for c in ("primary", "uncovered", "scope", "strong", "raw", "answered", "relaxed")]).alias("p")).collect()
    assert [r.p.branch if r.p else None for r in got] == [r.want for r in got]
    assert got[4].p.reason == "wiki_weak_primary" and got[6].p.reason == "wiki_zero_results" and got[2].p.level == "none"


def test_strong_hits(spark):
    rows = [
        ("carrier gateway", "Carrier Gateway", "wiki/x.md", "", True, True), ("what is the rate", "Rate", "wiki/x.md", "", True, True), ("ai connector 怎么", "Other", "wiki/x.md", "the AI Connector", True, False),
        ("use N/record", "Other", "wiki/x.md", "n record", True, False), ("network chatbox", "ChatBot Notes", "wiki/x.md", "", True, True), ("field types", "Other Record Field", "wiki/x.md", "", True, False), ("plain words", "Other", "wiki/x.md", "plain and words", False, False), ("", "T", "p", "", False, False),
    ]
    df = frame(spark, rows, "question string, title string, path string, text string, relaxed boolean, primary boolean")
    aliases = F.flatten(F.transform(identifiers.identifiers("question"), lambda x: x["aliases"]))
    df = df.withColumn("aliases", aliases)
    args = ("question", "title", "path", "text", F.col("aliases"))
    for r in df.select("question", "relaxed", "primary", recovery.is_strong(*args).alias("a"), recovery.is_strong(*args, body_evidence=False).alias("b")).collect():
        assert (r.a, r.b) == (r.relaxed, r.primary), r.question


# ---- quality


def candidate(**k):
    base = {"query_id": 1, "path": "wiki/a.md", "passage_id": "p", "score": 1.0, "source_kind": "wiki"}
    return base | k


def test_score_families(spark):
    kinds = "branch string, fusion_score double, graph_score double, fts_rank int, title_rank int, vector_rank int, vector_score double, source_kind string, fallback_level string"
    rows = [("coverage", None, 0.0, 1, None, None, 0.0, "wiki", None, "coverage_fusion"), ("relaxed", None, 0.0, 1, None, None, 0.0, "wiki", None, "wiki_relaxed"), ("raw_zero", None, 0.0, 1, None, None, 0.0, "raw", None, "raw_recovery"), (None, 1.5, 0.0, 1, None, None, 0.0, "wiki", None, "coverage_fusion"),
            (None, None, 0.4, None, None, None, None, "wiki", None, "graph_extension"), (None, None, 0.4, 2, None, None, None, "wiki", None, "main_rrf"), (None, None, 0.0, 1, None, None, None, "raw", None, "raw_recovery"), (None, None, None, 1, 2, 3, 0.9, "wiki", None, "main_rrf")]
    df = frame(spark, rows, kinds + ", want string")
    assert all(r.f == r.want for r in df.withColumn("f", quality.score_family(df)).collect())


def test_thresholds_and_reasons(spark):
    kinds = "query_id int, path string, passage_id string, score double, source_kind string, family string, exact boolean, identifier_signal boolean, phrase_signal boolean, coverage double, n_signals int, margin double, top1_rescue boolean, bucket string, min_ratio double, min_margin double, min_coverage double, fail_open string, scope string, language string, mode string, want string"
    row = lambda want, score=1.0, family="main_rrf", exact=False, ident=False, phrase=False, coverage=0.0, n=0, margin=None, top=False, fail=None, kind="wiki": (1, want, want, score, kind, family, exact, ident, phrase, coverage, n, margin, top, None if fail else "b", 0.5, 0.2, 0.4, fail, "s", "l", "m", want)
    rows = [
        row("gate_keep_top1_rescue", 10.0, top=True), row("gate_keep_exact_identifier", 0.1, exact=True), row("gate_keep_phrase", 0.1, phrase=True), row("gate_reject_score_floor", 4.0, coverage=1.0), row("gate_reject_score_cliff", 6.0, margin=0.1, coverage=1.0),
        row("gate_reject_low_confidence", 6.0, coverage=0.1, n=1), row("gate_keep_term_coverage", 6.0, coverage=0.1, n=2), row("gate_keep_multi_signal", 6.0, n=2), row("gate_fail_open_low_sample", 0.1, fail="gate_fail_open_low_sample"),
        row("gate_keep_raw_coverage", 6.0, family="coverage_fusion", coverage=0.9, kind="raw"),
    ]
    got = quality.decide(frame(spark, rows, kinds)).collect()
    assert [r.reason for r in got] == [r.want for r in got]
    assert all(r.reason in quality.REASONS and r.accepted == (not r.reason.startswith("gate_reject")) for r in got)


def test_buckets_and_ways_to_them(spark):
    kinds = "query_id string, score double, accepted boolean, margin double, coverage double, family string, scope string, language string, mode string, source_kind string"
    o = frame(spark, [(f"q{i % 4}", float(i + 1), True, 0.5, 1.0, "main_rrf", "knowledge", "latin", "lexical", "wiki") for i in range(40)] + [("q", 1.0, True, 0.1, 0.2, "wiki_relaxed", "all", "cjk", "lexical", "raw")], kinds)
    table = quality.buckets(o)
    asked = frame(spark, [("main_rrf", "knowledge", "latin", "lexical", "wiki"), ("main_rrf", "knowledge", "cjk", "lexical", "wiki"), ("main_rrf", "all", "cjk", "hybrid", "raw"), ("wiki_relaxed", "all", "cjk", "lexical", "raw")], "family string, scope string, language string, mode string, source_kind string")
    got = [(r.bucket, r.selection) for r in quality.resolve(asked, table).orderBy("family", "scope", "language", F.col("mode").desc()).collect()]
    assert got == [("main_rrf|*|*|*|*", "backoff"), ("main_rrf|knowledge|*|lexical|wiki", "backoff"), ("main_rrf|knowledge|latin|lexical|wiki", "exact"), ("global", "backoff")]
    told = quality.resolve(asked, table, {"wiki_relaxed|all|cjk|lexical|raw": "main_rrf|knowledge|latin|lexical|wiki"}).where("family = 'wiki_relaxed'").first()
    assert told.bucket == "main_rrf|knowledge|latin|lexical|wiki"
    few = table.where("level < 9 and key like 'wiki%'")
    assert quality.resolve(asked, few).where("family = 'wiki_relaxed'").first().fail_open == "gate_fail_open_low_sample"
    assert quality.resolve(asked, few).where("family = 'main_rrf'").first().fail_open == "gate_fail_open_policy_missing"


def test_features_rank_within_a_family(spark):
    rows = [(1, "wiki/b.md", "2", 5.0, "wiki", 1, None), (1, "wiki/a.md", "1", 5.0, "wiki", 2, 0.5), (1, "wiki/c.md", "3", 3.0, "wiki", None, None)]
    got = {r.path: r for r in quality.features(frame(spark, rows, "query_id int, path string, passage_id string, score double, source_kind string, fts_rank int, coverage_ratio double")).collect()}
    assert (got["wiki/a.md"].rank, got["wiki/b.md"].rank, got["wiki/c.md"].margin, got["wiki/b.md"].margin) == (1, 2, None, 2.0)
    assert got["wiki/a.md"].signals == ["fts", "coverage"] and got["wiki/c.md"].n_signals == 0 and got["wiki/a.md"].top1_rescue


# ---- pages, filters, archive


@pytest.mark.parametrize(
    ("generated", "fresh", "life", "keep", "sources", "want"),
    [(None, None, None, None, None, ("fresh", "active", "manual")), (True, None, None, None, None, ("fresh", "active", "auto")), (True, "stale", "stale", "manual", None, ("stale", "stale", "manual")), (None, None, None, "custom", None, ("fresh", "active", "custom")),
     (None, "x", "y", None, {"a": "h"}, ("review_required", "review_required", "manual")), (None, None, None, None, {}, ("review_required", "active", "manual")), (None, "", "", "", {"a": "h"}, ("fresh", "active", "manual"))],
)
def test_page_policy(spark, generated, fresh, life, keep, sources, want):
    df = frame(spark, [(generated, fresh, life, keep, sources)], "g boolean, f string, l string, m string, s map<string,string>")
    got = df.select(catalog.policy(*[F.col(c) for c in "gflms"]).alias("p")).first().p
    assert (got.freshness, got.lifecycle, got.maintenance) == want


def test_eligible_pages(spark):
    rows = [
        ("wiki/a.md", "active", "note", "active", "knowledge", "wiki"), ("wiki/sources/b.md", "active", "note", "active", "knowledge", "wiki"), ("wiki/c.md", "active", "note", "deprecated", "knowledge", "wiki"), ("wiki/d.md", "active", "source_summary", None, "knowledge", "wiki"),
        ("raw/sources/e.md", "raw", "", None, "knowledge", "raw"), ("raw/sources/chat/f.md", "raw", "", None, "history", "raw_chat"), ("raw/g.md", "raw", "", None, "knowledge", "raw"), ("wiki/h.md", "active", "chat", "stale", "history", "wiki"), ("archives/i.md", "archive", "note", "archived", "knowledge", "wiki"),
        ("wiki/x/sources/index.md", "active", "note", None, "knowledge", "wiki"), ("wiki/x/sources/capsules/index.md", "active", "note", None, "knowledge", "wiki"),
    ]
    df = frame(spark, rows, "path string, store string, page_type string, lifecycle_status string, corpus string, source_kind string")
    names = lambda s: {r.path.split("/", 1)[1] for r in df.where(filters.eligible(s)).collect()}
    assert names("knowledge") == {"a.md", "x/sources/capsules/index.md"} and names("history") == {"h.md"} and names("raw") == {"sources/e.md"} and names("archive") == {"i.md"}
    assert names("all") == {"a.md", "h.md", "x/sources/capsules/index.md", "sources/e.md", "sources/chat/f.md", "g.md"}


def test_filters_refuse_what_they_do_not_know():
    assert filters.normalise_filters({"pathPrefix": "/wiki/a/", "lifecycle": " active ", "corpus": ""}) == {"path_prefix": "wiki/a", "lifecycle": "active"}
    for bad in ({"tags": "x"}, {"tags": [1]}, {"project": 3}, {"pathPrefix": "a", "path_prefix": "b"}, {"x": "y"}, {"path_prefix": "a/../b"}):
        with pytest.raises(ValueError):
            filters.normalise_filters(bad)


def test_archive_blockers(spark):
    pages = frame(spark, [("wiki/gen.md", True, "superseded", "wiki/new.md"), ("wiki/gen2.md", True, "superseded", ""), ("wiki/live.md", True, "active", None), ("wiki/hand.md", False, "active", None), ("wiki/stale.md", True, "stale", None), ("raw/fed.md", None, None, None), ("raw/free.md", None, None, None), ("wiki/log.md", True, "deprecated", None)], "path string, generated boolean, lifecycle_status string, replaced_by string")
    asked = frame(spark, [("wiki/gen.md",), ("wiki/gen2.md",), ("wiki/live.md",), ("wiki/hand.md",), ("wiki/stale.md",), ("raw/fed.md",), ("raw/free.md",), ("wiki/none.md",), ("wiki/log.md",), ("other/x.md",)], "path string")
    edges = frame(spark, [("raw/fed.md", "wiki/live.md"), ("raw/fed.md", "wiki/dep.md"), ("wiki/gen.md", "wiki/live.md")], "source_path string, page_path string")
    got = {r.path: r.blocker for r in state.archive_plan(asked, pages, edges).collect()}
    assert got == {"wiki/gen.md": None, "wiki/gen2.md": "replaced_by_required", "wiki/live.md": "archive_lifecycle_ineligible", "wiki/hand.md": "manual_page_protected", "wiki/stale.md": "archive_lifecycle_ineligible", "raw/fed.md": "archive_dependency_blocked", "raw/free.md": None, "wiki/none.md": "archive_target_missing", "wiki/log.md": "structural_page_protected", "other/x.md": "invalid_archive_target"}
    both = {(r.path, r.role): r.blocker for r in state.archive_plan(asked.where("path = 'raw/fed.md'"), pages, edges, cascade=True, explicit=True).collect()}
    assert both == {("raw/fed.md", "target"): None, ("wiki/live.md", "dependent"): "archive_lifecycle_ineligible", ("wiki/dep.md", "dependent"): "archive_target_missing"}
    assert state.archive_plan(asked.where("path = 'wiki/hand.md'"), pages, edges, namespace="wiki/hand.md").first().blocker is None


def test_purges(spark):
    archives, items = frame(spark, [("x",), ("y",)], "archive_id string"), frame(spark, [("x", "wiki/a.md"), ("y", "raw/b.md")], "archive_id string, path string")
    asked = frame(spark, [("x", False, "old"), ("y", False, "old"), ("z", True, "old")], "archive_id string, forget boolean, reason string")
    refused, done = state.purge(archives, asked, frame(spark, [("raw/b.md",)], "source_path string"), items)
    assert {r.archive_id: r.why for r in refused.collect()} == {"y": "purge_active_reference", "z": "archive_not_found"}
    assert [(r.archive_id, len(r.path_hashes)) for r in done.collect()] == [("x", 1)]


def test_chats(spark):
    rows = [("## User\nhi\n## Assistant:\nyo", True), ("# assistant \nhi", True), ("#user:\nhi", True), ("## System\nx", False), ("hello", False), ("## User\nhi\n### Tool:\nx", False), ("## User\n# My notes\n", False), ("## User\na: b\n", True), ("  ", False)]
    df = frame(spark, rows, "c string, want boolean")
    assert all(r.got == r.want for r in df.select("want", jobs.valid_chat("c").alias("got")).collect())


def test_signals_of_an_entity(spark):
    df = frame(spark, [(["N/auth"], 1.0, "N auth module", "", "wiki/n-auth.md", "see nauthor"), (["log"], 0.5, "Catalogue", "", "x", "a log"), (["zzz"], -1.0, "a", "b", "c", "d")], "aliases array<string>, score double, title string, heading string, path string, body string")
    got = [r.s for r in df.select(discovery.match_signals(F.col("aliases"), F.col("score"), "title", "heading", "path", "body").alias("s")).collect()]
    assert (got[0].score, got[0].exact, got[0].body) == (1.0 + 3.0 + 1.5, True, False) and got[1].score == 0.5 + 3.0 + 1.0 and (got[2].score, got[2].exact) == (0.0, False)


def test_mentions(spark):
    pages = frame(spark, [("wiki/gateway.md", "Gateway", None), ("wiki/carrier-gateway.md", "Carrier Gateway", ["The Carrier"]), ("wiki/a.md", "Twice", None), ("wiki/b.md", "Twice", None), ("wiki/linked.md", "Linked", None), ("wiki/cn.md", "路由 规则", ["网关规则"]), ("wiki/p.md", "Own Page", None)], "path string, title string, aliases array<string>")
    pages = pages.withColumns({"page_type": F.lit("note"), "lifecycle_status": F.lit("active")})
    body = "A carrier gateway, `Gateway`, a gateway and Gateway.\nTwice [[linked]] Linked. 这是网关规则。 See [Gateway](http://x/Gateway) Own Page."
    got = catalog.link_suggestions(frame(spark, [("wiki/p.md", body)], "path string, body string"), pages).orderBy("offset").collect()
    assert [(r.target, r.mention, r.line) for r in got] == [("wiki/carrier-gateway.md", "carrier gateway", 1), ("wiki/gateway.md", "Gateway", 1), ("wiki/cn.md", "网关规则", 2)]
    assert got[0].link == "[[carrier-gateway|carrier gateway]]"


def test_mentions_meet_on_two_words(spark):
    pages = frame(spark, [("wiki/rb.md", "Retry Budget", None), ("wiki/x.md", "-x-ray", None), ("wiki/cn.md", "预算表", None), ("wiki/one.md", "Spend", None), ("wiki/long.md", "Budget is spent", None)], "path string, title string, aliases array<string>")
    pages = pages.withColumns({"page_type": F.lit("note"), "lifecycle_status": F.lit("active")})
    body = "Budget retry, retry the budget, my-x-ray.\nThe budget is spent: 这是预算表 Spend RETRY BUDGET"
    got = catalog.link_suggestions(frame(spark, [("wiki/p.md", body), ("wiki/e.md", ""), ("wiki/n.md", None)], "path string, body string"), pages).orderBy("offset").collect()
    assert [(r.target, r.mention) for r in got] == [("wiki/x.md", "-x-ray"), ("wiki/long.md", "budget is spent"), ("wiki/cn.md", "预算表"), ("wiki/one.md", "Spend"), ("wiki/rb.md", "RETRY BUDGET")]
    keys = frame(spark, [("a b a b",), ("one",), ("",), (None,)], "t string").select(catalog.body_keys(F.col("t")).alias("k")).collect()
    assert [r.k and sorted(r.k) for r in keys] == [["a", "a b", "b", "b a"], ["one"], [], None]


def test_questions_for_lists(spark):
    rows = [("list all modules", True), ("N/record", False), ("N/*", True), ("explain N/*", False), ("available N/record methods", False), ("N/record and N/search types", True), ("有哪些脚本", True), ("how do rates work", False), ("what is N/*", False)]
    df = frame(spark, rows, "question string, want boolean")
    assert all(r.got == r.want for r in df.select("question", "want", discovery.requested("question").alias("got")).collect())
    got = frame(spark, [("list N/* modules of the Gateway, 脚本 清单",)], "q string").select(discovery.anchors("q").alias("a"), discovery.focus("q").alias("f")).first()
    assert got.a == ["gateway"] and set(got.f) == {"gateway", "script", "scripts", "catalog", "directory", "list"}


def test_pages_that_are_catalogues(spark):
    pages = frame(spark, [("wiki/a.md", "Gateway Modules"), ("wiki/b.md", "Gateway API reference"), ("wiki/c.md", "Gateway"), ("wiki/n-modules.md", "Suite Modules"), ("wiki/e.md", "Types"), ("wiki/f.md", "Other"), ("wiki/g.md", "Else"), ("wiki/h.md", "More")], "path string, title string")
    asked = frame(spark, [(1, "list gateway modules"), (2, "all members of N/*"), (3, "zebra list")], "query_id int, question string")
    passages = frame(spark, [("wiki/n-modules.md", 0, "N/record, N / search and n/log; N/a"), ("wiki/e.md", 0, "N/record only")], "path string, ordinal int, text string")
    hits = frame(spark, [(3, "wiki/f.md", 1), (1, "wiki/f.md", 1)], "query_id int, path string, rank int")
    got = [tuple(r) for r in discovery.source_pages(asked, pages, passages, hits).orderBy("query_id", "source_rank").collect()]
    assert got == [(1, "wiki/a.md", 8, 1), (2, "wiki/n-modules.md", 6, 1), (3, "wiki/f.md", 0, 1)]


# ---- sources and shared specifications


def test_paths_of_each_store(spark):
    paths = ["wiki/concepts/a.md", "wiki/concepts/Index.md", "wiki/other/b.md", "wiki/sources/c.md", "raw/sources/chat/d.md", "raw/sources/chat/legacy/e.md", "raw/sources/web/p/f.md", "raw/sources/assets/g.md", "raw/h.md", "archives/bundles/x/i.md", "wiki/archives/j.md"]
    df = frame(spark, [(p,) for p in paths], "path string")
    got = {s: {r.path for r in df.where(source_pages.eligible_path(F.col("path"), s)).collect()} for s in ("active", "raw", "archive")}
    assert got == {"active": {"wiki/concepts/a.md", "raw/sources/chat/d.md"}, "raw": {"raw/sources/web/p/f.md"}, "archive": {"archives/bundles/x/i.md"}}


def test_what_a_page_is_by_its_path(spark):
    rows = [("wiki/projects/pay/x.md", "# Heading\ntext"), ("raw/sources/chat/2026/s1.md", "hi"), ("raw/sources/web/pay/doc.md", "---\ntitle: T\n---\nx"), ("raw/sources/file/Vendor/doc.md", "x"), ("wiki/concepts/c.md", "---\ntype: concept\nlifecycle: stale\n---\nx")]
    got = {r.path: (r.title, r.project, r.corpus, r.authority, r.source_kind, r.page_type, r.lifecycle_status) for r in source_pages.pages(frame(spark, rows, "path string, text string")).collect()}
    assert got == {
        "wiki/projects/pay/x.md": ("x", "pay", "knowledge", "high", "wiki", "", "active"), "raw/sources/chat/2026/s1.md": ("s1", "unknown", "history", "low", "raw_chat", "", "active"), "raw/sources/web/pay/doc.md": ("T", "pay", "raw", "low", "raw", "raw", "active"),
        "raw/sources/file/Vendor/doc.md": ("doc", "", "raw", "low", "raw", "raw", "active"), "wiki/concepts/c.md": ("c", "", "knowledge", "high", "concept", "concept", "stale"),
    }


def test_archives_and_stale_builds(spark, tmp_path):
    body = bytearray(b"---\ntitle: Old\n---\nx")
    files = frame(spark, [("archives/bundles/1/a.md", body)], "path string, content binary")
    good = files.select("path", F.sha2("content", 256).alias("sha256"))
    assert [(r.title, r.store, r.lifecycle_status) for r in source_pages.archive_pages(files, good).collect()] == [("Old", "archive", "archived")]
    with pytest.raises(ValueError):
        source_pages.archive_pages(files, good.withColumn("sha256", F.lit("0" * 64)))
    with pytest.raises(ValueError):
        source_pages.reconcile(files, files, "archive")
    root = str(tmp_path / "index")
    source_pages.save(source_pages.build(source_pages.pages(frame(spark, [("wiki/concepts/a.md", "x")], "path string, text string"))), root, "2026-01-01T00:00:00")
    assert not source_pages.is_stale(spark, root)
    source_pages.mark_stale(spark, root, "2026-01-02T00:00:00")
    assert source_pages.is_stale(spark, root)


def test_manifest_and_vectors(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text('{"schema_version": 2, "dataset_id": "d", "revision": "r", "abstention_threshold": 0.2}')
    assert datasets.manifest(spark, str(path)) == {"schema_version": 2, "dataset_id": "d", "revision": "r", "abstention_threshold": 0.2, "status": "reviewed"}
    path.write_text('{"dataset_id": "d", "revision": "", "abstention_threshold": 0.2}')
    with pytest.raises(ValueError):
        datasets.manifest(spark, str(path))
    store = frame(spark, [("p", "a.md", "h", "wiki", [1.0, 0.0])], "passage_id string, page_path string, content_hash string, source_kind string, vector array<float>")
    vector_store.save(store, str(tmp_path / "v"), "hashing-2", "2026-01-01")
    vector_store.save(store.withColumn("content_hash", F.lit("h2")), str(tmp_path / "v"), "hashing-2", "2026-01-02")
    assert [r.content_hash for r in vector_store.load(spark, str(tmp_path / "v"), "hashing-2").collect()] == ["h2"]
    with pytest.raises(ValueError):
        vector_store.load(spark, str(tmp_path / "v"), "other")
    pages = frame(spark, [("a.md", True, "navigation")], "path string, generated boolean, page_type string")
    assert vector_store.prune(store, pages).count() == 0


def test_shared_specs(spark):
    origin = [("pay", "wiki/projects/pay/specs/a.md", "rule 1")]
    base = "wiki/entities/shared-specs/"
    rows = [
        (1, "upsert", base + "x.md", "X", "b", {"languages": ["py"]}, origin), (2, "delete", base + "none.md", None, None, None, None), (3, "move", base + "x.md", "X", "b", None, origin), (4, "upsert", "wiki/x.md", "X", "b", None, origin),
        (5, "upsert", base + "y.md", " ", "b", None, origin), (6, "upsert", base + "y.md", "Y", "b", None, []), (7, "upsert", base + "y.md", "Y", "b", {"cars": ["x"]}, origin), (8, "delete", base + "old.md", None, None, None, None), (9, "upsert", base + "old.md", "O", "b", None, origin),
        (10, "upsert", base + "y.md", "Y", "b", None, [("log", "wiki/projects/pay/specs/a.md", "r")]),
    ]
    asked = frame(spark, rows, "request_id int, operation string, page_path string, title string, body string, applies_to map<string,array<string>>, derived_from array<struct<project:string,path:string,rule:string>>").withColumn("conditions", F.lit(""))
    got = {r.request_id: r for r in state.shared_spec_plan(asked, frame(spark, [(base + "old.md", "h")], "path string, content_hash string")).collect()}
    assert {k: r.action or r.code for k, r in got.items()} == {1: "create", 2: "page_not_found", 3: "invalid_operation", 4: "invalid_page_path", 5: "invalid_shared_spec", 6: "invalid_derived_from", 7: "invalid_applies_to", 8: "delete", 9: "update", 10: "invalid_derived_from"}
    assert got[1].missing == ["wiki/projects/pay/specs/a.md"]


def test_hashed_vectors(spark):
    """Against counts by XXH64 with Spark's seed."""
    import xxhash

    from quarryline.functions import vectors

    texts = ["carrier gateway of the rates gateway", "", "路由 规则 N/record", "one"]
    for r in vectors.Hashing(8).embed(frame(spark, [(x,) for x in texts], "t string"), "t").withColumn("w", T.tokens("t")).collect():
        want = [0.0] * 8
        for w in r.w:
            h = xxhash.xxh64(w.encode(), seed=42).intdigest()
            want[(h - (1 << 64) if h >> 63 else h) % 8] += 1
        norm = sum(x * x for x in want) ** 0.5
        assert r.vector == pytest.approx([x / norm if norm else x for x in want])
