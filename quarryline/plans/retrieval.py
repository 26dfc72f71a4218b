"""Queries of lexical retrieval, fusion and ranking, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.identifiers import query_plan
from ..operators import evaluation, evidence, fusion, lexical, recovery
from .tables import benchmark_queries, document_corpus, document_pages, table

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def _tok(c: str) -> str:
    return f"[x for x in regexp_extract_all(replace(lower({c}), 'ß', 'ss'), '[a-z0-9_]+') if x not in ({_STOP})]"


def _sub(c: str) -> str:
    return f"[y for y in flatten([string_split(t, '_') for t in {_tok(c)}]) if y <> '']"


def tokens_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens("text")).alias("term"))
    return words.groupBy("term", "doc_id").agg(F.count("*").alias("k")).groupBy("term").agg(F.sum("k").alias("tf"), F.count("*").alias("df"))


TOKENS_SQL = f"""
SELECT term, sum(k)::BIGINT AS tf, count(*) AS df FROM (
  SELECT doc_id, term, count(*) AS k FROM (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term
"""

_PAGES = f"""
pages_ AS (SELECT doc_id AS passage_id, 'wiki/concepts/' || source || '/' || doc_id || '.md' AS path, lang, source, {_sub("split_part(text, '.', 1)")} AS title, {_sub('text')} AS body FROM documents),
len_ AS (SELECT passage_id, (len(title) + len(body))::DOUBLE AS d FROM pages_),
avg_ AS (SELECT count(*)::DOUBLE AS n, avg(d) AS a FROM len_),
tok_ AS (SELECT passage_id, 4.0 AS w, unnest(title) AS term FROM pages_ UNION ALL SELECT passage_id, 1.0 AS w, unnest(body) AS term FROM pages_),
terms_ AS (SELECT item_id AS query_id, grp, toks[grp] AS term FROM (SELECT item_id, toks, unnest(range(1, len(toks) + 1)) AS grp FROM (SELECT item_id, {_tok('text')} AS toks FROM benchmark)))
"""


def _bm25_sql(having: str, match: str = "term = want", where: str = "true", limit: int = 10) -> str:
    return f"""
WITH {_PAGES},
want_ AS (SELECT DISTINCT term AS want FROM terms_),
f_ AS (SELECT want, passage_id, sum(w) AS f FROM want_ JOIN tok_ ON {match} GROUP BY ALL),
idf_ AS (SELECT want, CASE WHEN ln((n - k + 0.5) / (k + 0.5)) > 0 THEN ln((n - k + 0.5) / (k + 0.5)) ELSE 1e-6 END AS idf FROM (SELECT want, count(*) AS k FROM f_ GROUP BY want), avg_),
s_ AS (
  SELECT query_id, f_.passage_id, sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / a))) AS score, count(*) AS g
  FROM terms_ JOIN f_ ON terms_.term = f_.want JOIN idf_ ON idf_.want = f_.want JOIN len_ ON len_.passage_id = f_.passage_id, avg_ GROUP BY ALL),
n_ AS (SELECT query_id, count(*) AS wanted FROM terms_ GROUP BY query_id),
r_ AS (
  SELECT query_id, s_.passage_id, path, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path) AS rank
  FROM s_ JOIN n_ USING (query_id) JOIN pages_ USING (passage_id) WHERE {having} AND {where})
SELECT query_id, passage_id, path, score, rank FROM r_ WHERE rank <= {limit}
"""


def _search(mode: str, where=None, limit: int = 10):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = lexical.search(benchmark_queries(spark, sf_dir), document_corpus(spark, sf_dir), mode, limit, where() if where else None)
        return hits.select("query_id", "passage_id", "path", "score", "rank")
    return run


def _identifier_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about an identifier made of the first two long words of each benchmark item."""
    words = F.filter(T.tokens("text"), lambda w: (F.length(w) >= 3) & F.rlike(w, F.lit("^[a-z]+$")))
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("w")).where(F.size("w") >= 2)
    return rows.select("query_id", F.concat(F.col("w")[0], F.lit("/"), F.col("w")[1]).alias("question"))


def qualified_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lexical.search(_identifier_questions(spark, sf_dir), document_corpus(spark, sf_dir), "qualified", 10)
    return hits.select("query_id", "passage_id", "path", "score", "rank")


_QUALIFIED = f"""
{_PAGES},
id_ AS (SELECT item_id AS query_id, [x for x in {_tok("text")} if length(x) >= 3 and regexp_full_match(x, '[a-z]+')] AS w FROM benchmark),
want_ AS (SELECT query_id, w[1] AS a, w[2] AS b FROM id_ WHERE len(w) >= 2),
grp_ AS (SELECT query_id, unnest(['a', 'b', 'p', 'c']) AS grp, unnest([a, b, a || ' ' || b, a || b]) AS term FROM want_),
one_ AS (SELECT grp_.query_id, grp, passage_id, sum(w) AS f FROM grp_ JOIN tok_ USING (term) WHERE grp <> 'p' GROUP BY ALL),
pair_ AS (
  SELECT passage_id, 4.0 AS w, title[i] || ' ' || title[i + 1] AS term FROM (SELECT passage_id, title, unnest(range(1, len(title))) AS i FROM pages_)
  UNION ALL SELECT passage_id, 1.0, body[i] || ' ' || body[i + 1] FROM (SELECT passage_id, body, unnest(range(1, len(body))) AS i FROM pages_)),
f_ AS (SELECT * FROM one_ UNION ALL SELECT grp_.query_id, grp, passage_id, sum(w) FROM grp_ JOIN pair_ USING (term) WHERE grp = 'p' GROUP BY ALL),
idf_ AS (SELECT query_id, grp, CASE WHEN ln((n - k + 0.5) / (k + 0.5)) > 0 THEN ln((n - k + 0.5) / (k + 0.5)) ELSE 1e-6 END AS idf FROM (SELECT query_id, grp, count(*) AS k FROM f_ GROUP BY ALL), avg_),
s_ AS (
  SELECT query_id, passage_id, sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / a))) AS score, count(*) FILTER (WHERE grp IN ('a', 'b')) AS parts, count(*) FILTER (WHERE grp = 'c') AS whole
  FROM f_ JOIN idf_ USING (query_id, grp) JOIN len_ USING (passage_id), avg_ GROUP BY ALL)
"""
QUALIFIED_SQL = f"""
WITH {_QUALIFIED}
SELECT query_id, passage_id, path, score, rank FROM (
  SELECT query_id, passage_id, path, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path) AS rank FROM s_ JOIN pages_ USING (passage_id) WHERE parts = 2 OR whole > 0) WHERE rank <= 10
"""


def query_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of the benchmark's questions: Latin terms, and identifiers, of which their words have none but with a blank behind one letter."""
    plan = query_plan("question")
    rows = _identifier_questions(spark, sf_dir).select("query_id", plan.alias("p"))
    return rows.select("query_id", F.array_join("p.latin_terms", " ").alias("latin"), F.array_join("p.qualified_identifiers.canonical", " ").alias("identifiers"), "p.discovery_intent")


PLANS_SQL = f"""
WITH w AS (SELECT item_id AS query_id, [x for x in {_tok("text")} if length(x) >= 3 and regexp_full_match(x, '[a-z]+')] AS w FROM benchmark)
SELECT query_id, w[1] || ' ' || w[2] AS latin, w[1] || '/' || w[2] AS identifiers, false AS discovery_intent FROM w WHERE len(w) >= 2
"""


def title_overlap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.title_candidates(benchmark_queries(spark, sf_dir), document_pages(spark, sf_dir))


def _words(c: str) -> str:
    return f"list_distinct([x for x in regexp_extract_all(replace(lower({c}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+') if length(x) > 1])"


_TITLES = f"""
asked_ AS (SELECT item_id AS query_id, unnest({_words('text')}) AS word FROM benchmark),
title_ AS (SELECT path, unnest(list_distinct(list_concat({_words('title')}, {_words('path')}))) AS word FROM (SELECT 'wiki/concepts/' || source || '/' || doc_id || '.md' AS path, split_part(text, '.', 1) AS title FROM documents)),
over_ AS (SELECT query_id, path, count(*) AS overlap FROM asked_ JOIN title_ USING (word) GROUP BY ALL),
titles_ AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, path) AS title_rank FROM over_)
"""
TITLE_SQL = f"WITH {_TITLES} SELECT query_id, path, overlap, title_rank FROM titles_ WHERE title_rank <= 10"


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("passage_id"), F.col("embedding").alias("vector"))
    queries = v.where("passage_id % 20 = 0").select(F.col("passage_id").alias("query_id"), F.col("vector").alias("query_vector"))
    return fusion.vector_hits(queries, v, 0.0, 10).select("query_id", "passage_id", F.round("vector_score", 6).alias("vector_score"), "vector_rank")


VECTOR_SQL = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS passage_id, round(list_dot_product(q, embedding::DOUBLE[]), 12) AS s FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, passage_id) AS vector_rank FROM s WHERE s >= 0)
SELECT query_id, passage_id, round(s, 6) AS vector_score, vector_rank FROM r WHERE vector_rank <= 10
"""


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, corpus = benchmark_queries(spark, sf_dir), document_corpus(spark, sf_dir)
    fts = lexical.search(queries, corpus, "relaxed", 50).select("query_id", "path", F.col("rank").alias("fts_rank"))
    title = lexical.title_candidates(queries, corpus.passages).select("query_id", "path", "title_rank")
    both = fts.join(title, ["query_id", "path"], "full_outer")
    return both.withColumn("rrf", F.round(T.rrf(F.col("fts_rank")) + T.rrf(F.col("title_rank")), 12)).select("query_id", "path", "fts_rank", "title_rank", "rrf")


RRF_SQL = f"""
WITH fts_ AS ({_bm25_sql('true', limit=50)}), {_TITLES},
t_ AS (SELECT query_id, path, title_rank FROM titles_ WHERE title_rank <= 10)
SELECT query_id, path, fts_.rank AS fts_rank, title_rank,
  round(coalesce(1.0::DOUBLE / (60 + fts_.rank), 0) + coalesce(1.0::DOUBLE / (60 + title_rank), 0), 12) AS rrf
FROM fts_ FULL OUTER JOIN t_ USING (query_id, path)
"""


def fused_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical, title and vector ranks fused with authority, titles and evidence, best passage a page, adaptively cut.

    A document's vector is the embedding of its number, and so is a question's.
    """
    queries, corpus = benchmark_queries(spark, sf_dir), document_corpus(spark, sf_dir)
    fts = lexical.search(queries, corpus, "relaxed", 50)
    pages = corpus.passages
    title = lexical.title_candidates(queries, pages).join(pages.select("path", "passage_id"), "path")
    embedded = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("passage_id"), F.col("embedding").alias("vector"))
    asked = embedded.select(F.col("passage_id").alias("query_id"), F.col("vector").alias("query_vector")).join(queries.select("query_id"), "query_id")
    found = fusion.candidates(fts, title, fusion.vector_hits(asked, embedded)).join(pages, "passage_id").join(queries.withColumn("intent", T.intent("question")), "query_id")
    found = found.withColumn("evidence", evidence.judge("question", "text", "title", "path"))
    scored = fusion.best_per_page(fusion.fuse(found).withColumn("score", F.round("score", 9)))
    return fusion.adaptive_expand(scored, 10).select("query_id", "path", "score", "rank")


def best_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("role").alias("query_id"), F.col("conv_id").alias("path"), F.col("turn").alias("passage_id"), F.length("text").cast("long").alias("score"))
    return fusion.best_per_page(c)


BEST_SQL = """
SELECT query_id, path, passage_id, score FROM (
  SELECT role AS query_id, conv_id AS path, turn AS passage_id, length(text)::BIGINT AS score, row_number() OVER (PARTITION BY role, conv_id ORDER BY length(text) DESC, turn) AS k FROM conversations) WHERE k = 1
"""


def first_n_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.first_per_page(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), 3, "conv_id", "turn")


FIRST_SQL = 'SELECT * FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS "row" FROM conversations) WHERE "row" <= 3'


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("passage_id"), F.col("p_retailprice").alias("score"))


def adaptive_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.adaptive_expand(_parts(spark, sf_dir), 5, key=("passage_id",))


def plateau_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.plateau(_parts(spark, sf_dir), key=("passage_id",))


_RANKED = "r AS (SELECT p_brand AS query_id, p_partkey AS passage_id, p_retailprice AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)"
ADAPTIVE_SQL = f"""
WITH {_RANKED}, e AS (SELECT query_id, max(CASE WHEN rank = 5 THEN score END) AS edge, max(CASE WHEN rank = 1 THEN score END) AS first FROM r GROUP BY query_id),
f AS (SELECT r.*, CASE WHEN rank <= 5 OR (edge > 0 AND score >= greatest(0.9::DOUBLE * edge, 0.7::DOUBLE * first)) THEN 1 ELSE 0 END AS ok FROM r JOIN e USING (query_id) WHERE rank <= 40)
SELECT query_id, passage_id, score, rank FROM (SELECT *, min(ok) OVER (PARTITION BY query_id ORDER BY rank) AS run FROM f) WHERE run = 1
"""
PLATEAU_SQL = f"""
WITH {_RANKED}, f AS (SELECT *, CASE WHEN score >= greatest(0.05::DOUBLE, 0.82::DOUBLE * max(score) OVER (PARTITION BY query_id)) THEN 1 ELSE 0 END AS ok FROM r WHERE rank <= 12)
SELECT query_id, passage_id, score, rank FROM (SELECT *, min(ok) OVER (PARTITION BY query_id ORDER BY rank) AS run FROM f) WHERE run = 1
"""


def branch_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", F.col("n_chars").alias("score"))
    return fusion.branch_margin(d, ["source", "lang"], "doc_id")


MARGIN_SQL = """
SELECT source, lang, doc_id, n_chars AS score, row_number() OVER w AS rank, n_chars - lead(n_chars) OVER w AS margin, row_number() OVER w = 1 AS top1
FROM documents WINDOW w AS (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id)
"""


def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.expansions(benchmark_queries(spark, sf_dir), document_pages(spark, sf_dir))


EXPAND_SQL = f"""
WITH w AS (SELECT DISTINCT word FROM (SELECT unnest({_tok("split_part(text, '.', 1)")}) AS word FROM documents) WHERE length(word) >= 4),
u AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({_tok('text')}) AS term FROM benchmark) WHERE length(term) >= 2)
SELECT DISTINCT query_id, term, word FROM u JOIN w ON abs(length(term) - length(word)) <= 1 AND term <> word AND (
  (length(term) = length(word) AND len([i for i in range(1, length(term) + 1) if substr(term, i, 1) <> substr(word, i, 1)]) = 1)
  OR (length(term) = length(word) + 1 AND list_contains([substr(term, 1, i - 1) || substr(term, i + 1) for i in range(1, length(term) + 1)], word))
  OR (length(word) = length(term) + 1 AND list_contains([substr(word, 1, i - 1) || substr(word, i + 1) for i in range(1, length(word) + 1)], term)))
"""


def query_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, pages = benchmark_queries(spark, sf_dir), document_pages(spark, sf_dir)
    return lexical.suggestions(queries, pages, lexical.expansions(queries, pages))


SUGGEST_SQL = f"""
WITH e AS ({EXPAND_SQL}), t AS (SELECT DISTINCT unnest({_tok("split_part(text, '.', 1)")}) AS term FROM documents),
u AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({_tok('text')}) AS term FROM benchmark) WHERE length(term) >= 2)
SELECT query_id, term FROM u WHERE term NOT IN (SELECT term FROM t) AND (query_id, term) NOT IN (SELECT query_id, term FROM e)
"""


def intent_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(T.intent("text").alias("intent"), T.language_bucket("text").alias("bucket")).groupBy("intent", "bucket").agg(F.count("*").alias("n"))


INTENT_SQL = """
SELECT CASE """ + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in T.INTENTS) + r"""
  WHEN regexp_matches(text, '(^|[^\p{L}\p{N}_])[A-Za-z][\p{L}\p{N}_.:-]+[\p{L}\p{N}_]') THEN 'exact_entity' ELSE 'concept' END AS intent,
  CASE WHEN regexp_matches(text, '[\x{4e00}-\x{9fff}]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '[\x{4e00}-\x{9fff}]') THEN 'cjk' WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin' ELSE 'unknown' END AS bucket,
  count(*) AS n FROM documents GROUP BY ALL
"""


def evidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judge's score of each hit of the relaxed search."""
    queries, corpus = benchmark_queries(spark, sf_dir), document_corpus(spark, sf_dir)
    hits = lexical.search(queries, corpus, "relaxed", 20).select("query_id", "passage_id")
    full = hits.join(corpus.passages.select("passage_id", "text", "title", "path"), "passage_id").join(queries, "query_id")
    return full.select("query_id", "passage_id", F.round(evidence.judge("question", "text", "title", "path"), 9).alias("evidence"))


_JSTOP = ", ".join(f"'{w}'" for w in T.JUDGE_STOPWORDS)


def _jtok(c: str) -> str:
    return f"list_distinct([x for x in regexp_extract_all(replace(lower({c}), 'ß', 'ss'), '[a-z0-9_]+|[\\x{{4e00}}-\\x{{9fff}}]+') if length(x) > 1 and x not in ({_JSTOP})])"


#: Evidence of rows with question, text, title, path. Identifiers are words with a capital inside, an underscore or a digit behind letters.
_EVIDENCE = f"""
q_ AS (SELECT *, {_jtok("question")} AS q, {_jtok("text")} AS t, list_distinct(list_concat({_jtok("title")}, {_jtok("replace(replace(replace(path, '/', ' '), '-', ' '), '_', ' ')")}, {_jtok("regexp_extract(path, '([^/]*)[.]md$', 1)")})) AS names,
  regexp_extract_all(question, '\\b[A-Za-z][a-z0-9]*(?:[A-Z][a-z0-9]+)+\\b|\\b[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+\\b|\\b[A-Za-z]+[0-9][A-Za-z0-9_]*\\b') AS ids, lower(title || chr(10) || path || chr(10) || text) AS hay FROM rows_),
j_ AS (
  SELECT *, CASE WHEN len(q) = 0 AND len(ids) = 0 THEN 0 ELSE greatest(0, least(1, (CASE WHEN len(q) > 0 THEN len(list_intersect(q, t))::DOUBLE / len(q) ELSE 0 END)
    + CASE WHEN len(q) >= 2 AND len([x for x in q if contains(replace(lower(text), 'ß', 'ss'), x)]) >= 2 THEN 0.15::DOUBLE ELSE 0 END + (CASE WHEN len(q) > 0 THEN 0.25::DOUBLE * len(list_intersect(q, names)) / len(q) ELSE 0 END)
    + CASE WHEN len([x for x in ids if length(x) > 1 and contains(hay, lower(x))]) > 0 THEN 0.15::DOUBLE ELSE 0 END)) END AS evidence FROM q_)
"""
_TEXTS = "SELECT doc_id AS passage_id, coalesce(text, '') AS text, split_part(coalesce(text, ''), '.', 1) AS title FROM documents"
EVIDENCE_SQL = f"""
WITH h_ AS ({_bm25_sql('true', limit=20)}),
rows_ AS (SELECT h_.query_id, h_.passage_id, h_.path, d.text, d.title, b.text AS question FROM h_ JOIN ({_TEXTS}) d USING (passage_id) JOIN benchmark b ON b.item_id = h_.query_id),
{_EVIDENCE}
SELECT query_id, passage_id, round(evidence, 9) AS evidence FROM j_
"""


def hop_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, corpus = benchmark_queries(spark, sf_dir), document_corpus(spark, sf_dir)
    find = lambda q: lexical.search(q, corpus, "strict", evidence.PER_TERM)
    pool, _ = evidence.hop(queries, lexical.search(queries, corpus, "relaxed", 20), corpus.passages, find)
    return pool.select("query_id", "passage_id", "hop", F.round("evidence", 9).alias("evidence"))


def coverage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, corpus = benchmark_queries(spark, sf_dir), document_corpus(spark, sf_dir)
    full = lambda h: h.select("query_id", "passage_id", "score").join(corpus.passages.select("passage_id", "path", "title", "text"), "passage_id")
    wiki, raw = full(lexical.search(queries, corpus, "strict", 10)), full(lexical.search(queries, corpus, "relaxed", 20))
    missing = recovery.uncovered(queries, wiki)
    return recovery.coverage_merge(wiki, raw, missing).select("query_id", "passage_id", "from_raw", "source_rank", "fusion_score")


def raw_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, corpus = benchmark_queries(spark, sf_dir), document_corpus(spark, sf_dir)
    wiki = lexical.search(queries, corpus, "strict", 10).join(corpus.passages.select("passage_id", "text", "title"), "passage_id").join(queries, "query_id").withColumn("evidence", evidence.judge("question", "text", "title", "path"))
    raw = lexical.search(queries, corpus, "relaxed", 30)
    kinds = recovery.pool_kind(queries, wiki)
    cols = ["query_id", "path", "passage_id", "score"]
    return recovery.raw_merge(wiki.select(cols), raw.select(cols), kinds).select("query_id", "passage_id", "from_raw", "source_rank", "fusion_score")


FUSED_SQL = f"""
WITH fts_ AS ({_bm25_sql('true', limit=50)}), {_TITLES},
t_ AS (SELECT query_id, path, title_rank, regexp_extract(path, '([0-9]+)[.]md$', 1)::BIGINT AS passage_id FROM titles_ WHERE title_rank <= 10),
a_ AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings JOIN benchmark ON item_id = vec_id),
s_ AS (SELECT query_id, vec_id AS passage_id, round(list_dot_product(q, embedding::DOUBLE[]), 12) AS s FROM a_, embeddings),
v_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, passage_id) AS vector_rank FROM s_ WHERE s >= 0.5) WHERE vector_rank <= 50),
c_ AS (SELECT query_id, passage_id, max(f) AS fr, max(t) AS tr, max(v) AS vr FROM (SELECT query_id, passage_id, rank AS f, NULL AS t, NULL AS v FROM fts_ UNION ALL SELECT query_id, passage_id, NULL, title_rank, NULL FROM t_ UNION ALL SELECT query_id, passage_id, NULL, NULL, vector_rank FROM v_) GROUP BY ALL),
rows_ AS (
  SELECT c_.*, 'wiki/concepts/' || source || '/' || doc_id || '.md' AS path, coalesce(d.text, '') AS text, split_part(coalesce(d.text, ''), '.', 1) AS title, b.text AS question
  FROM c_ JOIN documents d ON doc_id = passage_id JOIN benchmark b ON item_id = query_id),
{_EVIDENCE},
w_ AS (SELECT *, {_words("question")} AS qw, {_words("title")} AS tw, regexp_extract_all(replace(lower(question), 'ß', 'ss'), '[a-z0-9_]+') AS seq, regexp_replace(replace(lower(title), 'ß', 'ss'), '[^a-z0-9_]+', '', 'g') AS compact FROM j_),
x_ AS (
  SELECT query_id, path, round(round((coalesce(1.0::DOUBLE / (60 + fr), 0) + coalesce(1.0::DOUBLE / (60 + tr), 0) + coalesce(1.0::DOUBLE / (60 + vr), 0)) * 61 + 0.35::DOUBLE + CASE WHEN len(qw) > 0 AND len(tw) > 0 THEN 0.15::DOUBLE * len(list_intersect(qw, tw)) / len(qw) ELSE 0 END
    + CASE WHEN len([i for i in range(1, len(seq)) if length(seq[i] || seq[i + 1]) >= 5 and contains(compact, seq[i] || seq[i + 1])]) > 0 THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN lower(question) IN (lower(title), path) THEN 0.5::DOUBLE ELSE 0 END, 12) + evidence, 9) AS score FROM w_),
k_ AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path)::INT AS rank FROM x_),
e_ AS (SELECT query_id, max(CASE WHEN rank = 10 THEN score END) AS edge, max(CASE WHEN rank = 1 THEN score END) AS first FROM k_ GROUP BY query_id),
g_ AS (SELECT k_.*, CASE WHEN rank <= 10 OR (edge > 0 AND score >= greatest(0.9::DOUBLE * edge, 0.7::DOUBLE * first)) THEN 1 ELSE 0 END AS ok FROM k_ JOIN e_ USING (query_id) WHERE rank <= 40)
SELECT query_id, path, score, rank FROM (SELECT *, min(ok) OVER (PARTITION BY query_id ORDER BY rank) AS run FROM g_) WHERE run = 1
"""
_LATIN = f"[x for x in regexp_extract_all(replace(lower({{c}}), 'ß', 'ss'), '[a-z0-9_]+') if x not in ({_STOP})]"
COVERAGE_SQL = f"""
WITH w_ AS ({_bm25_sql('g = wanted', limit=10)}), r_ AS ({_bm25_sql('true', limit=20)}),
d_ AS (SELECT doc_id AS passage_id, list_distinct({_LATIN.format(c="split_part(coalesce(text, ''), '.', 1) || chr(10) || coalesce(text, '')")}) AS words FROM documents),
q_ AS (SELECT item_id AS query_id, [x for x in list_distinct({_LATIN.format(c="text")}) if length(x) >= 3] AS asked FROM benchmark),
seen_ AS (SELECT query_id, flatten(list(words)) AS words FROM w_ JOIN d_ USING (passage_id) GROUP BY query_id),
u_ AS (SELECT query_id, [x for x in asked if not list_contains(coalesce(words, []), x)] AS terms FROM q_ LEFT JOIN seen_ USING (query_id)),
b_ AS (SELECT query_id, passage_id, path, score, false AS from_raw FROM w_ UNION ALL SELECT query_id, passage_id, path, score, true FROM r_),
c_ AS (SELECT b_.*, CASE WHEN len(terms) > 0 THEN len(list_intersect(terms, flat))::DOUBLE / len(terms) ELSE 0 END AS ratio
  FROM b_ JOIN u_ USING (query_id) JOIN (SELECT query_id, path, flatten(list(words)) AS flat FROM b_ JOIN d_ USING (passage_id) GROUP BY ALL) p USING (query_id, path)),
k_ AS (SELECT *, row_number() OVER (PARTITION BY query_id, from_raw ORDER BY score DESC, path, passage_id)::INT AS source_rank FROM c_ WHERE NOT from_raw OR ratio > 0),
f_ AS (SELECT *, round(ratio + 61.0::DOUBLE / (60 + source_rank) + CASE WHEN from_raw THEN 0.35::DOUBLE * ratio ELSE least(score / 100.0::DOUBLE, 0.35::DOUBLE) END, 12) AS fusion_score FROM k_)
SELECT query_id, passage_id, from_raw, source_rank, fusion_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, passage_id ORDER BY fusion_score DESC) AS k FROM f_) WHERE k = 1
"""
RAW_SQL = f"""
WITH w_ AS ({_bm25_sql('g = wanted', limit=10)}), r_ AS ({_bm25_sql('true', limit=30)}),
rows_ AS (SELECT w_.query_id, w_.passage_id, w_.path, d.text, d.title, b.text AS question FROM w_ JOIN ({_TEXTS}) d USING (passage_id) JOIN benchmark b ON b.item_id = w_.query_id),
{_EVIDENCE},
kind_ AS (SELECT item_id AS query_id, CASE WHEN e IS NULL THEN 'empty' WHEN e < 0.15 THEN 'weak' ELSE 'strong' END AS kind FROM benchmark LEFT JOIN (SELECT query_id, max(evidence) AS e FROM j_ GROUP BY query_id) ON query_id = item_id),
b_ AS (SELECT query_id, passage_id, path, score, false AS from_raw FROM w_ UNION ALL SELECT query_id, passage_id, path, score, true FROM r_ JOIN kind_ USING (query_id) WHERE kind <> 'strong'),
k_ AS (SELECT *, row_number() OVER (PARTITION BY query_id, from_raw ORDER BY score DESC, path, passage_id)::INT AS source_rank FROM b_)
SELECT query_id, passage_id, from_raw, source_rank, round(61.0::DOUBLE / (60 + source_rank), 12) AS fusion_score FROM k_ WHERE NOT from_raw OR source_rank <= 20
"""


def strong_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each hit of the relaxed search is more than words in common, with and without its body."""
    queries, corpus = benchmark_queries(spark, sf_dir), document_corpus(spark, sf_dir)
    hits = lexical.search(queries, corpus, "relaxed", 20).select("query_id", "passage_id").join(corpus.passages.select("passage_id", "text", "title", "path"), "passage_id").join(queries, "query_id")
    return hits.select("query_id", "passage_id", recovery.is_strong("question", "title", "path", "text").alias("relaxed"), recovery.is_strong("question", "title", "path", "text", body_evidence=False).alias("primary_"))


STRONG_SQL = f"""
WITH h_ AS ({_bm25_sql('true', limit=20)}),
r_ AS (SELECT h_.query_id, h_.passage_id, replace(lower(trim(b.text)), 'ß', 'ss') AS q, replace(lower(d.title), 'ß', 'ss') AS name, h_.path AS place, replace(lower(d.text), 'ß', 'ss') AS body, {_tok("b.text")} AS words, {_tok("d.title")} AS mine,
  [replace(lower(x), 'ß', 'ss') for x in regexp_extract_all(b.text, '(?i)[a-z0-9_]+(?:\\s+[a-z0-9_]+)+')] AS phrases
  FROM h_ JOIN ({_TEXTS}) d USING (passage_id) JOIN benchmark b ON b.item_id = h_.query_id),
m_ AS (SELECT *, list_distinct(list_intersect(mine, words)) AS met, list_distinct([m for m in mine if length(m) >= 4 and len([w for w in words if w <> m and length(w) >= 4 and abs(length(w) - length(m)) <= 1 and levenshtein(w, m) = 1]) > 0]) AS near FROM r_),
n_ AS (SELECT *, list_distinct(list_concat(met, near)) AS either, (name <> '' AND (contains(q, name) OR contains(name, q))) OR (length(q) >= 4 AND q IN (name, place)) AS said FROM m_)
SELECT query_id, passage_id, said OR len([p for p in phrases if contains(name || chr(10) || place || chr(10) || body, p)]) > 0 OR len(met) > 0 OR len(near) > 0 AS relaxed,
  said OR len([p for p in phrases if contains(name || chr(10) || place, p)]) > 0 OR len([x for x in met if x NOT IN ({", ".join(f"'{w}'" for w in T.GENERIC_TITLE_TOKENS)})]) >= 1 OR len(met) >= 2
    OR (len(near) > 0 AND (len([x for x in either if x NOT IN ({", ".join(f"'{w}'" for w in T.GENERIC_TITLE_TOKENS)})]) >= 1 OR len(either) >= 2)) AS primary_ FROM n_
"""


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    ranked = lexical.top(d.select(F.col("source").alias("query_id"), F.col("doc_id").alias("path"), "n_chars"), 40, [F.col("n_chars").desc(), F.col("path")])
    gold = d.join(table(spark, sf_dir, "labels"), "doc_id").where("quality = 1").select(F.col("source").alias("query_id"), F.col("doc_id").alias("path"), (2 - F.col("toxic")).alias("grade"))
    return ranked, gold, d.select(F.col("source").alias("query_id")).distinct()


def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.ranking_metrics(*_judged(spark, sf_dir)))


def _rounded(df: DataFrame) -> DataFrame:
    out = df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    return out.withColumns({c: F.col(c).cast("long") for c in ("hits", "relevant_total") if c in out.columns})


def metrics_by_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.metrics_by_k(*_judged(spark, sf_dir)))


_GOLD = """
d AS (SELECT source AS query_id, doc_id AS path, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS pos FROM documents),
g AS (SELECT query_id, path, max(grade) AS grade FROM (SELECT source AS query_id, doc_id AS path, 2 - toxic AS grade FROM documents JOIN labels USING (doc_id) WHERE quality = 1) GROUP BY ALL),
gr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, path) AS pos FROM g)
"""
_METRICS = """
SELECT c.query_id{extra}, round(hits::DOUBLE / total, 9) AS recall, round(CASE WHEN total > 0 THEN hits::DOUBLE / {k} END, 9) AS precision,
  round(CASE WHEN total > 0 THEN coalesce(1.0::DOUBLE / first, 0) END, 9) AS mrr, round(CASE WHEN total > 0 THEN coalesce(dcg / ideal, 0) END, 9) AS ndcg,
  CASE WHEN total > 0 THEN hits ELSE 0 END AS hits, coalesce(total, 0) AS relevant_total
FROM (SELECT DISTINCT source AS query_id FROM documents) c
LEFT JOIN (SELECT query_id, count(*) AS total, sum(CASE WHEN pos <= {k} THEN (2.0::DOUBLE ** grade - 1) / log2(pos + 1) END) AS ideal FROM gr GROUP BY query_id) i USING (query_id)
LEFT JOIN (
  SELECT q.query_id, count(g.path) AS hits, min(CASE WHEN g.path IS NOT NULL THEN d.pos END) AS first, sum(CASE WHEN g.path IS NOT NULL THEN (2.0::DOUBLE ** grade - 1) / log2(d.pos + 1) END) AS dcg
  FROM (SELECT DISTINCT source AS query_id FROM documents) q LEFT JOIN d ON d.query_id = q.query_id AND d.pos <= {k} LEFT JOIN g ON g.query_id = d.query_id AND g.path = d.path GROUP BY q.query_id) h USING (query_id)
"""
METRICS_SQL = f"WITH {_GOLD} {_METRICS.format(k=10, extra='')}"
BY_K_SQL = f"WITH {_GOLD} " + " UNION ALL ".join(f"({_METRICS.format(k=k, extra=f', {k} AS k')})" for k in (1, 3, 5, 10))


def slice_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("lang").alias("language"), F.array("source").alias("tags"), F.col("quality").cast("double"), F.col("toxic").cast("double"))
    return _rounded(evaluation.slices(d, ["quality", "toxic"]))


SLICE_SQL = """
SELECT slice, count(*) AS n, round(avg(quality), 9) AS quality, round(avg(toxic), 9) AS toxic
FROM (SELECT unnest(['all', 'language:' || lang, 'tag:' || source]) AS slice, quality, toxic FROM documents JOIN labels USING (doc_id)) GROUP BY slice
"""


def p95_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(evaluation.p95("value").alias("p95"), F.round(F.median("value"), 9).alias("median"), F.round(F.avg("value"), 6).alias("mean"))


P95_SQL = "SELECT event_type, quantile_disc(value, 0.95) AS p95, round(median(value), 9) AS median, round(avg(value), 6) AS mean FROM events GROUP BY event_type"

QUERIES = {
    "tokens_terms": tokens_terms,
    "bm25_strict_topk": _search("strict"),
    "bm25_relaxed_topk": _search("relaxed"),
    "bm25_prefix_topk": _search("prefix"),
    "bm25_filtered_topk": _search("relaxed", lambda: (F.col("page_type") == "en") & F.array_contains("tags", "src1")),
    "qualified_topk": qualified_topk,
    "query_plans": query_plans,
    "title_overlap_candidates": title_overlap_candidates,
    "vector_topk": vector_topk,
    "rrf_fusion": rrf_fusion,
    "fused_search": fused_search,
    "best_per_page": best_per_page,
    "first_n_per_page": first_n_per_page,
    "adaptive_expand": adaptive_expand,
    "plateau_select": plateau_select,
    "branch_margin": branch_margin,
    "levenshtein_join": query_expansion,
    "query_suggestions": query_suggestions,
    "intent_classes": intent_classes,
    "evidence_scores": evidence_scores,
    "hop_expansion": hop_expansion,
    "coverage_merge": coverage_merge,
    "raw_merge": raw_merge,
    "strong_hits": strong_hits,
    "ranking_metrics": ranking_metrics,
    "metrics_by_k": metrics_by_k,
    "slice_metrics": slice_metrics,
    "p95_nearest_rank": p95_nearest_rank,
}
ORACLE_SQL = {
    "tokens_terms": TOKENS_SQL,
    "bm25_strict_topk": _bm25_sql("g = wanted"),
    "bm25_relaxed_topk": _bm25_sql("true"),
    "bm25_prefix_topk": _bm25_sql("g = wanted", "(length(want) >= 3 AND starts_with(term, want)) OR term = want"),
    "bm25_filtered_topk": _bm25_sql("true", where="lang = 'en' AND source = 'src1'"),
    "qualified_topk": QUALIFIED_SQL,
    "query_plans": PLANS_SQL,
    "evidence_scores": EVIDENCE_SQL,
    "fused_search": FUSED_SQL,
    "strong_hits": STRONG_SQL,
    "coverage_merge": COVERAGE_SQL,
    "raw_merge": RAW_SQL,
    "title_overlap_candidates": TITLE_SQL,
    "vector_topk": VECTOR_SQL,
    "rrf_fusion": RRF_SQL,
    "best_per_page": BEST_SQL,
    "first_n_per_page": FIRST_SQL,
    "adaptive_expand": ADAPTIVE_SQL,
    "plateau_select": PLATEAU_SQL,
    "branch_margin": MARGIN_SQL,
    "levenshtein_join": EXPAND_SQL,
    "query_suggestions": SUGGEST_SQL,
    "intent_classes": INTENT_SQL,
    "ranking_metrics": METRICS_SQL,
    "metrics_by_k": BY_K_SQL,
    "slice_metrics": SLICE_SQL,
    "p95_nearest_rank": P95_SQL,
}
