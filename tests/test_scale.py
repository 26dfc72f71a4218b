"""Literal cases of steps that must not grow faster than their input."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as P

from quarryline.functions import markdown
from quarryline.operators import catalog, cut, discovery, fusion, graph, lexical, postings, state
from quarryline.sources import pages as source_pages


def rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_pairs_of_a_group_meet_in_what_they_share(spark):
    edges = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "x"), ("a", "y"), ("b", "y"), ("c", "z"), ("a", "b"), ("a", "x")], "src string, dst string")
    members = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2), ("e", 1)], "node string, grp int")
    sources = spark.createDataFrame([("a", "s"), ("b", "s"), ("b", "s"), ("c", "t"), ("d", "s"), ("a", "u"), ("b", "u")], "path string, source string")
    types = spark.createDataFrame([("a", "n"), ("b", "n"), ("c", "n"), ("d", "n"), ("e", "")], "path string, page_type string")
    pairs = spark.createDataFrame([(a, b) for a in "abce" for b in "abce" if a < b], "seed string, target string")
    adjacent = graph.neighbours(edges)
    assert rows(graph.common_neighbours_within(adjacent, members)) == rows(graph.common_neighbours(adjacent, pairs))
    assert rows(graph.shared_sources_within(sources, members)) == rows(graph.shared_sources(sources, pairs)) == [("a", "b", 2, 8.0)]
    assert rows(graph.evidence_within(adjacent, sources, types, members)) == rows(graph.evidence(pairs, adjacent, None, sources, types))


def test_members_without_anything_in_common_make_no_pairs(spark):
    n = 20_000
    members = spark.range(n).select(F.col("id").cast("string").alias("node"), F.lit(1).alias("grp"))
    sources = spark.range(n).select(F.col("id").cast("string").alias("path"), F.floor(F.col("id") / 2).cast("string").alias("source"))
    assert graph.shared_sources_within(sources, members).count() == n // 2


@pytest.mark.parametrize("mode", ["strict", "relaxed", "prefix", "phrase"])
def test_scores_of_batches_are_those_of_joins(spark, monkeypatch, mode):
    words = "alpha alphabet beta gamma_ray gamma ray delta".split()
    texts = [(i, f"p{i % 37:02d}/{i}", i % 3, words[i % 7], " ".join(words[(i * k) % 7] for k in range(1, 2 + i % 5))) for i in range(600)] + [(600, None, 0, None, "beta beta"), (601, "q", 0, "", None)]
    passages = spark.createDataFrame(texts, "passage_id long, path string, ordinal int, title string, body string").repartition(3)
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "gamma_ray"), (3, "delta delta gamma ray"), (4, "nowhere"), (5, "beta")], "query_id int, question string")
    find = lambda where: rows(lexical.search(queries, lexical.Corpus(passages), mode, 7, where).select("query_id", "passage_id", "score", "rank"))
    quick = [find(None), find(F.col("ordinal") == 1)]
    assert len(quick[0]) > 6
    monkeypatch.setattr(lexical, "SCORED_TERMS", 0)
    assert quick == [find(None), find(F.col("ordinal") == 1)]


def test_a_search_shuffles_no_scores(spark):
    passages = spark.range(5000).selectExpr("id AS passage_id", "concat('p', id) AS path", "0 AS ordinal", "'alpha' AS title", "'alpha beta' AS body")
    queries = spark.createDataFrame([(n, "alpha beta") for n in range(20)], "query_id int, question string")
    found = lexical.search(queries, lexical.Corpus(passages), "relaxed", 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "HashAggregate" not in plan and found.count() == 60


def test_nearest_vectors_of_copies_and_odd_rows(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 8))
    base[100:200] = base[5]
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(300, None), (301, [1.0, 2.0]), (302, [0.0] * 8)]
    v = spark.createDataFrame(vectors, "passage_id long, vector array<float>").repartition(4)
    q = v.where("passage_id % 20 = 0 or passage_id = 301").select(F.col("passage_id").alias("query_id"), F.col("vector").alias("query_vector"))
    got = fusion.vector_hits(q, v, 0.0, 10)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    arrays = {i: np.asarray(np.float32(x), np.float64) for i, x in vectors if x is not None}
    want = []
    for i, x in arrays.items():
        if i % 20 == 0 or i == 301:
            scored = [(-round(sum(float(a) * float(b) for a, b in zip(x, y)), 12), j) for j, y in arrays.items() if len(y) == len(x)]
            want += [(i, j, round(-s, 9), n + 1) for n, (s, j) in enumerate(sorted(t for t in scored if t[0] <= 0)[:10])]
    assert rows(got.select("query_id", "passage_id", "vector_score", "vector_rank")) == sorted(want)


def _notes(spark, n):
    names = [("Twice Told", n), ("Retry Budget", 1), ("Own Page", 1), ("spend", 1), ("ſpend Kelvin", 1)]
    paths = [(f"wiki/{title.replace(' ', '')}{i}.md", title, [f"alias {title}"]) for title, many in names for i in range(many)]
    pages = spark.createDataFrame(paths, "path string, title string, aliases array<string>").withColumns({"page_type": F.lit("note"), "lifecycle_status": F.lit("active")})
    body = "Twice Told and retry budget, RETRY BUDGET; own page, spend and Spend. Alias spend, a ſpend kelvin. "
    bodies = [("wiki/OwnPage0.md", body), ("wiki/q.md", body * 3), ("wiki/q.md", "retry budget"), ("wiki/e.md", ""), ("wiki/n.md", None), (None, body)]
    return spark.createDataFrame(bodies, "path string, body string"), pages


def test_mentions_are_looked_for_where_bodies_are_scanned(spark, monkeypatch):
    bodies, pages = _notes(spark, 300)
    found = catalog.link_suggestions(bodies, pages)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    got = rows(found)
    assert {(r[0], r[1]) for r in got} == {("wiki/OwnPage0.md", "wiki/RetryBudget0.md"), ("wiki/OwnPage0.md", "wiki/spend0.md"), ("wiki/OwnPage0.md", "wiki/ſpendKelvin0.md")} | {("wiki/q.md", f"wiki/{x}0.md") for x in ("RetryBudget", "spend", "ſpendKelvin", "OwnPage")}
    monkeypatch.setattr(catalog, "HELD_TERMS", 0)
    assert got == rows(catalog.link_suggestions(bodies, pages))


def test_a_term_of_many_pages_is_one_term(spark):
    terms = {r.term: r.target for r in catalog._claims(_notes(spark, 300)[1]).collect() if not r.term.startswith("alias")}
    assert terms["Twice Told"] is None and terms["Own Page"] == "wiki/OwnPage0.md" and len(terms) == 5


def test_places_of_terms_are_those_of_patterns():
    words = ["Ab", "ab", "b a", "a-b", "-b", "ab-", "a_b c", "ſ a", "k b", "é a", "+"]
    draw = np.random.default_rng(3)
    for letters in ("abAB -_+", "aAbkKKſ -", "aé bÉiİ "):
        for _ in range(300):
            body = "".join(draw.choice(list(letters), 30))
            low = None if catalog._FOLDS_TO_ASCII.search(body) else body.lower()
            for term in words:
                whole = re.fullmatch("[A-Za-z0-9_]+", term)
                left, right = (r"(?<![A-Za-z0-9_])" if re.match("[A-Za-z0-9_]", term) else ""), (r"(?![A-Za-z0-9_])" if re.search("[A-Za-z0-9_]$", term) else "")
                want = [m.span() for m in re.finditer(left + re.escape(term) + right, body, 0 if whole else re.I)]
                assert list(catalog._places(body, low, term)) == want, (body, term)


def test_rows_of_pages_are_handed_on_in_pieces(spark):
    def of_page(path, body):
        class Row(dict):
            alive = 0

            def __init__(self):
                Row.alive += 1
                super().__init__(n=Row.alive)

            def __del__(self):
                Row.alive -= 1

        return (Row() for _ in range(20_000))

    pages = spark.createDataFrame([("a", "x")], "path string, body string")
    got = markdown._rows(pages, ["path", "body"], P.StructType([P.StructField("n", P.IntegerType())]), of_page)
    assert got.count() == 20_000 and got.agg(F.max("n")).first()[0] <= 2 * markdown.PIECE
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_parts_of_plans_and_statuses_stay_small(spark, monkeypatch):
    most = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    pages = spark.range(4000).selectExpr("concat(if(id < 40, 'raw/s', 'wiki/o'), id) AS path", "true AS generated", "'deprecated' AS lifecycle_status", "null AS replaced_by")
    edges = spark.range(20_000).selectExpr("concat('raw/s', if(id % 2 = 0, 7, id % 50)) AS source_path", "concat('wiki/o', id % 3000) AS page_path")
    found = spark.range(8000).selectExpr("id % 1500 AS entity_id", "id AS path", "id AS passage_id", "cast(id % 5 AS double) AS score", "'w' AS source_kind")
    entities = spark.range(2000).selectExpr("id AS entity_id")
    wide = rows(state.archive_plan(pages.select("path"), pages, edges).select("path", "role", F.coalesce("blocker", F.lit("")), "dependents")), rows(discovery.statuses(entities, found).fillna("").fillna(-1))
    assert {r[0]: r[3] for r in wide[0]}["raw/s7"] == edges.where("source_path = 'raw/s7'").select("page_path").distinct().count()
    monkeypatch.setattr(cut, "PART_ROWS", 200)
    plan, statuses = state.archive_plan(pages.select("path"), pages, edges), discovery.statuses(entities, found)
    assert rows(plan.select("path", "role", F.coalesce("blocker", F.lit("")), "dependents")) == wide[0] and rows(statuses.fillna("").fillna(-1)) == wide[1]
    assert most(plan) < 150 and most(statuses) < 150


def test_links_are_read_off_pages_once(spark):
    texts = [("wiki/concepts/a.md", "---\ntitle: A\nsources: [raw/s.md]\n---\n[[b]]"), ("wiki/concepts/b.md", "﻿---\ntitle: B\n---\n[[a]] [[none]]"), ("wiki/concepts/c.md", "﻿plain [[a]]"), ("wiki/concepts/d.md", "--- no mapping"), ("wiki/concepts/e.md", None), ("wiki/concepts/f.md", "---\nopen")]
    vault = source_pages.pages(spark.createDataFrame(texts, "path string, text string"))
    want = {p: markdown.split_frontmatter(t or "") for p, t in texts}
    assert {r.path: (json.loads(r.frontmatter), r.body) for r in vault.select("path", "frontmatter", "body").collect()} == want
    found = graph.resolve(markdown.links(vault), vault).select("src", "kind", "dst", "target")
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.fillna("").collect())) == [("wiki/concepts/a.md", "source", "raw/s.md", ""), ("wiki/concepts/a.md", "wikilink", "b", "wiki/concepts/b.md"), ("wiki/concepts/b.md", "wikilink", "a", "wiki/concepts/a.md"), ("wiki/concepts/b.md", "wikilink", "none", ""), ("wiki/concepts/c.md", "wikilink", "a", "wiki/concepts/a.md")]


@pytest.mark.parametrize("cells", [8_000_000, 40])
def test_titles_meet_questions_where_they_are_scanned(spark, monkeypatch, cells):
    words = "alpha beta gamma delta rate budget".split()
    titles = [(f"w/{i % 400:03d}.md", " ".join(words[(i * k) % 6] for k in range(1, 2 + i % 5))) for i in range(900)]
    titles += [(None, f"{words[i % 6]} zeta") for i in range(300)] + [("w/none.md", None), ("w/empty.md", ""), ("w/wide.md", " ".join(words))]
    vault = spark.createDataFrame(titles, "path string, title string").repartition(3)
    asked = spark.createDataFrame([(1, "alpha beta gamma"), (2, "rate"), (3, "nowhere"), (4, "md"), (4, "md w/ 001 delta"), (5, "zeta delta"), (6, None)], "query_id int, question string")
    monkeypatch.setattr(postings, "CELLS", cells)
    found = lexical.title_candidates(asked, vault, 7)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = [list(map(tuple, f.orderBy("query_id", "title_rank").collect())) for f in (found, lexical.title_candidates(asked.limit(0), vault), lexical.title_candidates(asked, vault.limit(0)), lexical.title_candidates(asked, vault, 0))]
    monkeypatch.setattr(lexical, "SCORED_TERMS", 0)
    assert got == [list(map(tuple, lexical.title_candidates(asked, vault, 7).orderBy("query_id", "title_rank").collect())), [], [], []]
    assert (5, None, 350, 1) in got[0] and len(got[0]) == 28


def test_a_long_page_is_held_as_its_text():
    import tracemalloc

    words = [" ".join(f"w{i}x{k}" for k in range(9)) for i in range(20_000)]
    for body in (" ".join(words), "\n".join(words), "\n\n".join(words), "ab\n\n" * 300_000, "\r\n".join(words), "\n# a\n".join(words)):
        tracemalloc.start()
        n = sum(1 for _ in markdown.page_passages("a", body))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n > 300 and peak < 5 * len(body) + (4 << 20), (body[:20], peak / len(body))


def test_passages_of_a_long_paragraph_are_those_of_listed_units(monkeypatch):
    body = "# A\n\none two\n\n" + " ".join(f"w{i}, 中文" for i in range(900)) + "\n\nthree\r\nfour\n\n" + "x " * 500 + "\n\n" + "y " * 40
    listed = markdown.chunk("a", body)
    words = markdown.units(body.split("\n\n")[2])
    assert [c["text"] for c in listed if c["text"].startswith("w")][0] == " ".join(words[:600])
    assert [c["token_count"] for c in listed] == [2, 600, 600, 600, 600, 600, 600, 384, 2, 502, 104]
    monkeypatch.setattr(markdown, "SHORT", 0)
    assert markdown.chunk("a", body) == listed


def test_pieces_end_where_their_texts_are_long():
    rows = [{"text": "x" * (1 << 20), "path": ["y" * (1 << 20)]} for _ in range(20)]
    assert [len(p) for p in markdown._pieces(rows)] == [8, 8, 4]
    assert [len(p) for p in markdown._pieces({"n": i, "path": None} for i in range(2500))] == [1000, 1000, 500]
