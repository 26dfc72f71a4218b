import datetime

import pytest
from pyspark.sql import functions as F

from quarryline.functions import codecs, markdown
from quarryline.functions import text as T
from quarryline.functions.vectors import Hashing


def one(spark, column, text=None, **more):
    df = spark.createDataFrame([(text, *more.values())], "text string" + "".join(f", {k} string" for k in more))
    return df.select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, T.tokens("text"), "The N/record of 网关路由 in a field_id, réunion N/* Straße 路") == ["n", "record", "field_id", "r", "union", "strasse", "网关", "关路", "路由", "路"]
    assert one(spark, T.tokens("text")) == [] and one(spark, T.normalised("text"), "A  cat") == "cat"
    assert one(spark, T.passage_units("text"), "ab_1 网关, x") == ["ab_1", "网", "关", ",", "x"]
    assert one(spark, T.namespace_wildcards("text"), "list N/* and n / * or foo.bar/*") == ["n", "foo.bar"]


@pytest.mark.parametrize(("question", "want"), [("what did we discuss last time", "history"), ("exact field id", "exact_evidence"), ("compare a and b", "comparison"), ("deep dive on queues", "research"), ("how to install it on linux", "concept"), ("Rate Engine", "exact_entity"), ("为什么队列变长", "concept")])
def test_intent(spark, question, want):
    assert one(spark, T.intent("text"), question) == want


def test_redaction(spark):
    text = "call 13812345678, mail a.b@example.com, id 11010519491231002X, card 4111 1111 1111 1111\nAuthorization: Bearer abc\nCookie: a=b; c=d\nsession_id = 99, sk-abcdefghijklmnop password: hunter2"
    got = one(spark, T.redact("text"), text)
    assert got == "call [REDACTED_PHONE], mail [REDACTED_EMAIL], id [REDACTED_ID_CARD], card [REDACTED_BANK_CARD]\nAuthorization: [REDACTED_SECRET]\nCookie: [REDACTED_SECRET]\nsession_id=[REDACTED_SECRET], [REDACTED_SECRET] password=[REDACTED_SECRET]"
    counts = T.redaction_counts(F.col("text"), T.redact("text"))
    assert {k: one(spark, c, text) for k, c in counts.items()} == {"phone": 1, "email": 1, "id_card": 1, "bank_card": 1, "secret": 5}


def test_scores(spark):
    day = F.lit(datetime.date(2026, 3, 1))
    assert one(spark, T.freshness_bonus("text", day), "2026-02-14T00:00") == 10.0 and one(spark, T.freshness_bonus("text", day), "soon") == 0.0
    assert one(spark, T.title_overlap_bonus("text", "title"), "rate engine limits", title="RateEngine") == 2.0
    assert one(spark, T.title_overlap_bonus("text", "title"), "rate engine", title="the engine") == pytest.approx(0.075)
    assert one(spark, T.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(0.5)))) == 4.0
    assert one(spark, T.unit(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8] and one(spark, T.unit(F.array(F.lit(0.0)))) == [0.0]
    assert one(spark, T.bigrams(T.alias_key("text")), "Ab-c") == ["ab", "bc"]
    assert one(spark, T.slug("text"), " Rate  Engine! ") == "rate-engine" and one(spark, T.slug("text"), "!!") == "page"
    assert one(spark, T.embedding_text(F.lit("A"), F.array(F.lit("A"), F.lit("b")), F.lit("c"))) == "A\nb\nc"


PAGE = "intro line\n\n# One\ntext a\n\n- item 1\n- item 2\n```\n# not a heading\n[[no]]\n```\n## Two\n| a | b |\n| --- | --- |\n| c | d |\nafter [[x|y]] and [[p/q]] \\[[esc]] `[[code]]`\n"


def test_chunks():
    got = markdown.chunk("wiki/a.md", PAGE)
    assert [(c["heading_path"], c["heading_anchor"], c["ordinal"]) for c in got] == [([], "document", 0), (["One"], "one", 1), (["One", "Two"], "one-two", 2)]
    assert "# not a heading" in got[1]["text"] and len({c["passage_id"] for c in got}) == 3
    long = markdown.split_section(" ".join(map(str, range(1300))))
    assert [len(markdown.units(x)) for x in long] == [600, 600, 228] and long[1].split()[:64] == long[0].split()[-64:]
    small = markdown.split_section("\n\n".join(" ".join(["w"] * 200) for _ in range(4)))
    assert [len(markdown.units(x)) for x in small] == [400, 264, 264]
    assert markdown.overlap_length(list("abcdefghij"), list("cdefghijxx")) == 8 and markdown.overlap_length(list("abc"), list("bcd")) == 0


def test_wikilinks():
    assert [(x["target"], x["label"]) for x in markdown.wikilinks(PAGE)] == [("x", "y"), ("p/q", None)]
    assert markdown.rewrite_wikilinks("a [[x\\|y]] b [[z]]", lambda t: t + "1") == "a [[x1\\|y]] b [[z1]]"
    assert markdown.format_wikilink("a", "b", True) == "[[a\\|b]]"
    assert markdown.path_candidates("wiki/c/p.md", "../e/x#s") == ["wiki/e/x.md", "e/x.md"]
    meta, body = markdown.split_frontmatter("﻿---\ntitle: A\ntags: [x, y]\n---\nbody")
    assert meta == {"title": "A", "tags": ["x", "y"]} and body == "body"
    assert markdown.split_frontmatter("no") == ({}, "no")
    assert "".join(markdown.split_utf8("é" * 50 + "\n" + "ü" * 30, 64)) == "é" * 50 + "\n" + "ü" * 30


def test_codecs(spark):
    ref = codecs.encode("content", {"vault": "v", "scope": "active", "kind": "page", "identity": "wiki/é.md"})
    assert codecs.decode("content", ref)["identity"] == "wiki/é.md"
    assert one(spark, codecs.content_ref("v", F.lit("active"), F.lit("page"), F.col("text")), "wiki/é.md") == ref
    for bad in ("cr1_%%%", "cc1_e30", "cr1_W10"):
        with pytest.raises(ValueError):
            codecs.decode("content", bad)
    shown = codecs.public(spark.createDataFrame([("/etc/x", "h", "t")], "path string, sha256 string, title string"))
    assert shown.columns == ["path", "title"] and shown.first()["path"] is None


def test_vectors(spark):
    v = Hashing(8).embed(spark.createDataFrame([("a b c",), ("",)], "text string"), "text").collect()
    assert sum(x * x for x in v[0].vector) == pytest.approx(0.0) or sum(x * x for x in v[0].vector) == pytest.approx(1.0)
    assert v[1].vector == [0.0] * 8
