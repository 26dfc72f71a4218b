import math

import pytest
from pyspark.sql import functions as F

from quarryline.operators import catalog, context, discovery, evaluation, evidence, filters, fusion, graph, lexical, quality, recovery, state
from quarryline.plans.engine import Engine
from quarryline.sources import datasets
from quarryline.sources import pages as source_pages
from quarryline.streaming import jobs


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_bm25_formula(spark):
    rows = [(1, "a.md", 0, "Gateway", "carrier gateway routes"), (2, "b.md", 0, "Rates", "gateway field_id other"), (3, "c.md", 0, "Other", "field other id"), (4, "d.md", 0, "X", "nothing here")]
    corpus = lexical.Corpus(frame(spark, rows, "passage_id int, path string, ordinal int, title string, body string"))
    asked = frame(spark, [(1, "gateway"), (2, "field_id"), (3, "gateway routes"), (4, "gateway gateway"), (5, "gatew rout")], "query_id int, question string")
    got = {(r.query_id, r.passage_id): r.score for r in lexical.search(asked, corpus, "strict").collect()}
    d = {1: 4, 2: 5, 3: 4, 4: 3}
    average, idf = sum(d.values()) / 4, math.log((4 - 2 + 0.5) / (2 + 0.5)) or 1e-6

    def part(f, n, i):
        return i * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / average))

    assert got[1, 1] == pytest.approx(part(5, 4, 1e-6), abs=1e-8) and set(got) == {(1, 1), (1, 2), (2, 2), (3, 1), (4, 1), (4, 2)}
    assert got[4, 2] == pytest.approx(2 * got[1, 2], abs=2e-9) and idf == 1e-6
    assert {(r.query_id, r.passage_id) for r in lexical.search(asked, corpus, "prefix").collect()} >= {(5, 1)}
    relaxed = lexical.search(asked.where("query_id = 3"), corpus, "relaxed", 1, F.col("path") != "a.md").collect()
    assert [r.passage_id for r in relaxed] == [2]


def test_ladders(spark):
    a = frame(spark, [(1, 1, 0.5), (1, 2, 0.9)], "query_id int, passage_id int, score double")
    b = frame(spark, [(1, 1, 0.7), (2, 5, 0.1)], "query_id int, passage_id int, score double")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(lexical.ladder([a, b])) == [(1, 1, 0.7), (1, 2, 0.9), (2, 5, 0.1)]
    assert rows(lexical.ladder([a, b], "replace_if_nonempty")) == [(1, 1, 0.7), (2, 5, 0.1)]
    assert rows(lexical.ladder([a, b], "descend_if_empty")) == [(1, 1, 0.5), (1, 2, 0.9), (2, 5, 0.1)]


def test_filters(spark):
    rows = [("wiki/a/x.md", "Alpha", "note", "wiki", ["t", "u"]), ("wiki/ab/y.md", "", "", "note", ["t"]), ("wiki/a.md", "beta", "note", "wiki", None)]
    df = frame(spark, rows, "path string, project string, page_type string, source_kind string, tags array<string>")
    count = lambda f, **k: df.where(filters.matches(filters.normalise_filters(f), **k)).count()
    assert count({"project": "ALPHA"}) == 2 and count({"project": "ALPHA"}, strict_case=True) == 1
    assert count({"type": "note"}) == 3 and count({"tags": ["t", "t", " u "]}) == 1 and count({"pathPrefix": "wiki/a"}) == 1
    for bad in ({"x": 1}, {"path_prefix": "../up"}, {"path_prefix": "c:/etc"}):
        with pytest.raises(ValueError):
            filters.normalise_filters(bad)
    assert filters.fingerprint({"a": 1, "b": 2}) == filters.fingerprint({"b": 2, "a": 1})


def test_cuts(spark):
    df = frame(spark, [(1, "p%02d" % i, i, s) for i, s in enumerate([10.0, 9.5, 9.0, 8.8, 5.0, 0.9])], "query_id int, path string, passage_id int, score double")
    assert [r.rank for r in fusion.adaptive_expand(df, 2).collect()] == [1, 2, 3, 4]
    assert fusion.plateau(df).count() == 4
    assert fusion.best_per_page(df.unionByName(df.withColumn("passage_id", F.col("passage_id") + 100))).count() == 6
    with pytest.raises(ValueError):
        fusion.Weights(fts=11)


def test_judge_and_hop(spark):
    q = frame(spark, [(1, "carrier gateway rates")], "query_id int, question string")
    body = frame(spark, [(1, "a.md", "Gateway", "the carrier gateway feeds rate engine"), (2, "b.md", "Engine", "rate engine limits quotas"), (3, "c.md", "Quotas", "limits quotas only"), (4, "d.md", "Z", "unrelated")], "passage_id int, path string, title string, text string")
    got = body.crossJoin(q).select("passage_id", evidence.judge("question", "text", "title", "path").alias("e")).orderBy("passage_id").collect()
    assert got[0].e == pytest.approx(2 / 3 + 0.15 + 0.25 / 3) and got[3].e == 0
    corpus = lexical.Corpus(body.withColumn("ordinal", F.lit(0)).withColumn("body", F.col("text")))
    find = lambda x: lexical.search(x, corpus, "strict", 20)
    pool, stop = evidence.hop(q, frame(spark, [(1, 1, 1.0)], "query_id int, passage_id int, score double"), body, find)
    assert {r.passage_id: r.hop for r in pool.collect()} == {1: 0, 2: 1, 3: 2} and stop.first()["stop_reason"] == "max_hops"


def test_graph(spark):
    adjacent = graph.neighbours(frame(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "x")], "src string, dst string"))
    seeds = frame(spark, [(1, "a", 2.0)], "query_id int, path string, score double")
    reached = graph.two_hops(seeds, adjacent)
    assert {(r.target, r.hop) for r in reached.collect()} == {("b", 1), ("x", 1), ("c", 2)}
    assert {(r.target, r.hop) for r in graph.two_hops(seeds, adjacent, most=2).collect()} == {("b", 1), ("x", 1)}
    sources = frame(spark, [("a", "s"), ("c", "s")], "path string, source string")
    types = frame(spark, [("a", "t"), ("b", "t"), ("c", "u")], "path string, page_type string")
    e = graph.evidence(reached, adjacent, frame(spark, [("b", "derived_from", "a")], "src string, kind string, dst string"), sources, types)
    got = {(r.seed, r.target): r.evidence for r in e.collect()}
    assert got["a", "b"] == 7.0 and got["a", "c"] == pytest.approx(4 + 1.5 / math.log(3)) and got["a", "x"] == 3.0
    out = {r.path: (r.graph_score, r.graph_only) for r in graph.expand(seeds, reached, e, frame(spark, [(1, "b", 1.0)], "query_id int, path string, score double")).collect()}
    assert out["b"] == (0.15, False) and out["x"] == (pytest.approx(0.7 * 2 * 3 / 6), True)


def test_metrics(spark):
    ranked = frame(spark, [(1, "a", 1), (1, "b", 2), (1, "a", 3), (1, "c", 4)], "query_id int, path string, rank int")
    gold = frame(spark, [(1, "b", 3), (1, "c", 1), (1, "z", 2)], "query_id int, path string, grade int")
    cases = frame(spark, [(1,), (2,)], "query_id int")
    got = {r.query_id: r for r in evaluation.ranking_metrics(ranked, gold, cases, 3).collect()}
    ideal = 7 + 3 / math.log2(3) + 1 / 2
    assert (got[1].recall, got[1].precision, got[1].mrr) == (pytest.approx(2 / 3), pytest.approx(2 / 3), 0.5)
    assert got[1].ndcg == pytest.approx((7 / math.log2(3) + 1 / 2) / ideal) and got[2].recall is None
    assert evaluation.diagnose(cases, ranked.where("path = 'a'"), gold, frame(spark, [("b",)], "path string")).collect()[0].diagnosis == "not_retrieved"


def test_quality():
    quality.check_artifact({"a": {"backoff": "b"}, "b": {}})
    with pytest.raises(ValueError):
        quality.check_artifact({"a": {"backoff": "b"}, "b": {"backoff": "a"}})
    with pytest.raises(ValueError):
        quality.check_artifact({"a": {"backoff": "b"}})


def test_context():
    assert context.window_of([10, 10], [0], 100) == [0, 1]
    assert context.window_of([50] * 6, [3], 160) == [2, 3, 4, 5]
    assert context.window_of([900, 10, 10, 10, 900], [2], 100) == [1, 2, 3]


def test_pack_and_parents(spark):
    rows = [(1, 1, "a", f"p{i}", i, f"passage {i} has a few words") for i in range(4)] + [(1, 2, "b", "p0", 0, "again")]
    got = context.pack(frame(spark, rows, "query_id int, priority int, path string, passage_id string, ordinal int, text string"), frame(spark, [(1, 13)], "query_id int, budget int")).collect()
    assert [(r.path, r.tokens, r.used) for r in got] == [("a", 12, [0, 1]), ("b", 1, [0])]
    hits = frame(spark, [(1, 1, "a", 1, "mid")], "query_id int, rank int, path string, ordinal int, text string")
    around = frame(spark, [("a", 0, "before"), ("a", 1, "mid"), ("a", 2, "behind")], "path string, ordinal int, text string")
    r = context.expand_parents(hits, around).first()
    assert r.text == "before\n\nmid\n\nbehind" and r.neighbour_ordinals == [0, 2]


def test_recovery(spark):
    q = frame(spark, [(1, "gateway quota limits")], "query_id int, question string")
    wiki = frame(spark, [(1, "w", "1", "Gateway", "gateway", 2.0)], "query_id int, path string, passage_id string, title string, text string, score double")
    raw = frame(spark, [(1, "r", "2", "x", "quota limits", 1.0), (1, "s", "3", "y", "none", 5.0)], "query_id int, path string, passage_id string, title string, text string, score double")
    missing = recovery.uncovered(q, wiki)
    assert missing.first()["terms"] == ["limits", "quota"]
    got = {r.path: r.fusion_score for r in recovery.coverage_merge(wiki, raw, missing).collect()}
    assert set(got) == {"w", "r"} and got["r"] == pytest.approx(1 + 1 + 0.35)


def test_catalogue(spark):
    pages = frame(spark, [(f"wiki/{i}.md", f"h{i}", "b" * 30 + "é", f"T{i}") for i in range(5)], "path string, redacted_hash string, body string, title string")
    first, cursor = catalog.list_items(pages, {}, 2)
    second, more = catalog.list_items(pages, {}, 3, cursor)
    assert [r["path"] for r in first + second] == [f"wiki/{i}.md" for i in range(5)] and more is None
    with pytest.raises(ValueError):
        catalog.list_items(pages, {}, 2, cursor, snapshot="new")
    from quarryline.functions.codecs import encode

    ref = encode("content", {"vault": "v", "scope": "a", "kind": "page", "identity": "wiki/1.md"})
    a = catalog.get_item(pages, ref, 31)
    b = catalog.get_item(pages, ref, 31, a["cursor"])
    assert a["body"] + b["body"] == "b" * 30 + "é" and b["cursor"] is None
    pairs = catalog.similar_pairs(frame(spark, [(1, list("abcde")), (2, list("abcdf")), (3, list("xyz"))], "id int, grams array<string>"), 0.6).collect()
    assert [(r.a, r.b, round(r.jaccard, 3)) for r in pairs] == [(1, 2, 0.667)]


def test_state(spark):
    pages = frame(spark, [("a", "h1", "active"), ("b", "h2", "archived")], "path string, content_hash string, lifecycle_status string")
    r = state.commit(frame(spark, [("1", "a", "h1", "n"), ("2", "a", "h1", "m"), ("3", "b", "x", "y"), ("4", "c", None, "z")], "operation_id string, path string, expected_hash string, new_hash string"), pages)
    assert {x.operation_id: x.outcome for x in r.collect()} == {"1": "committed", "2": "conflict", "3": "conflict", "4": "committed"}
    moves = frame(spark, [("1", "planned", "staged"), ("2", "planned", "committed")], "operation_id string, old_state string, new_state string")
    assert [x.operation_id for x in state.invalid_transitions(moves).collect()] == ["2"]
    n = state.notes(frame(spark, [("T", ["a", " A", "t", ""], ["q" * 301])], "title string, aliases array<string>, questions array<string>")).first()
    assert n.aliases == ["a"] and n.errors == ["question_too_long"]


def test_streams(spark, tmp_path):
    saves = frame(spark, [("s", 1, "a"), ("s", 2, "a"), ("s", 3, "a\nb"), ("s", 4, "c")], "session_id string, saved_at int, body string")
    assert [(r.revision, r.append_only, r.delta_line) for r in jobs.revisions(saves).orderBy("saved_at").collect()] == [("revision-000001", False, None), ("revision-000002", True, 1), ("revision-000003", False, None)]
    write = jobs.appender(f"{tmp_path}/log")
    batch = frame(spark, [("1", "x"), ("1", "x"), ("2", "y")], "operation_id string, text string")
    write(batch, 0)
    write(batch, 0)
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    chats = frame(spark, [("## User\nhi\n## Assistant\nyo",), ("## System\nx",), ("hello",)], "c string")
    assert [r[0] for r in chats.select(jobs.valid_chat("c")).collect()] == [True, False, False]
    assert jobs.Runner(spark).run(lambda: spark.range(5).count(), "t1", 30) == 5


def test_vault_to_answers(spark, tmp_path):
    vault = {
        "wiki/entities/gateway.md": "---\ntitle: Carrier Gateway\ntags: [net]\nsources: [raw/s.md]\n---\n# Carrier Gateway\nRoutes parcels. See [[rate-engine]].\n",
        "wiki/entities/rate-engine.md": "---\ntitle: Rate Engine\nsources: [raw/s.md]\n---\nComputes prices of parcels.\n",
        "wiki/index.md": "# Index\n",
    }
    for path, body in vault.items():
        f = tmp_path / "vault" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(body)
    engine = Engine.from_vault(spark, str(tmp_path / "vault"))
    assert engine.status().first()["pages"] == 2
    asked = spark.createDataFrame([(1, "which routes do parcels take"), (2, "zebra")], "query_id int, question string")
    results, why = engine.ask(asked, k=5)
    got = results.where("query_id = 1").orderBy("rank").collect()
    assert got[0].path == "wiki/entities/gateway.md" and {r.path for r in got} == {"wiki/entities/gateway.md", "wiki/entities/rate-engine.md"}
    assert {r.query_id: r.kind for r in why.collect()}[2] == "empty"
    assert "Routes parcels" in engine.packed(results, asked).orderBy("query_id").first()["content"]
    old = {t: df.cache() for t, df in engine.tables.items()}
    edited = old["pages"].withColumn("body", F.when(F.col("title") == "Rate Engine", "New text.").otherwise(F.col("body"))).withColumn("redacted_hash", F.sha2("body", 256))
    old = source_pages.build(old["pages"].withColumn("redacted_hash", F.sha2("body", 256)))
    step, full = source_pages.reconcile(old, edited), source_pages.build(edited)
    for t in ("pages", "passages", "links"):
        assert sorted(map(str, step[t].collect())) == sorted(map(str, full[t].select(*step[t].columns).collect()))
    source_pages.save(full, str(tmp_path / "index"), "2026-01-01T00:00:00")
    assert Engine.load(spark, str(tmp_path / "index")).status().first()["passages"] == 2


def test_cases(spark, tmp_path):
    good = '{"schema_version":1,"id":"a","query":"q","relevant":[{"path":"p","grade":2}],"answerable":true,"language":"en"}'
    f = tmp_path / "c.jsonl"
    f.write_text(good + "\n")
    assert datasets.gold(datasets.cases(spark, str(f))).first()["grade"] == 2
    for bad in (good.replace("true", "false"), good.replace(":2}", ":5}"), "{", good + "\n" + good):
        f.write_text(bad + "\n")
        with pytest.raises(ValueError):
            datasets.cases(spark, str(f))
    with pytest.raises(ValueError):
        datasets.write_trace(spark.createDataFrame([("x",)], "body string"), str(tmp_path / "t"))


def test_discovery(spark):
    q = spark.createDataFrame([(1, "list all modules"), (2, "N/record"), (3, "N/*"), (4, "explain N/*")], "query_id int, question string")
    assert [r.query_id for r in q.where(discovery.requested("question")).orderBy("query_id").collect()] == [1, 3]
    pages = spark.createDataFrame([("p", "# Modules\n- N/a: x\n- N/b\n\n| M | u |\n|---|---|\n| N/c | 1 |\n| N/d | 2 |\n\n# Other\n- single\n")], "path string, body string")
    assert sorted(r.label for r in discovery.mine(pages).collect()) == ["N/c", "N/d"]
