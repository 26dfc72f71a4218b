"""Evidence judge and multi-hop expansion over batches of questions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .cut import cut

# Weights of the judge and bounds of the hops.
PHRASE, CONTEXT, TITLE, CJK_EACH, CJK_MOST, IDENTIFIER = 0.15, 0.1, 0.25, 0.1, 0.2, 0.15
CAMEL = r"\b[A-Za-z][a-z0-9]*(?:[A-Z][a-z0-9]+)+\b"
LOOSE = r"\b[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+\b|\b[A-Za-z]+[0-9][A-Za-z0-9_]*\b"
POOL, SEEDS, TERMS, HOPS, JUDGED, PER_TERM = 100, 10, 20, 2, 400, 20


def _judge_tokens(c: Column) -> Column:
    return T.judge_tokens(c)


def judge(question: Column | str, text: Column | str, title: Column | str, path: Column | str, context: Column | None = None, words: Column | None = None) -> Column:
    """From 0 to 1: covered question words, phrase, context, title and path, CJK spans, identifiers.

    words: the judge's tokens of text, where they are known already.
    """
    text, title, path = T.text_of(text), T.text_of(title), T.text_of(path)
    question = T.text_of(question)
    pieces = F.concat(F.split(path, r"[/_\\-]+"), F.array(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")))
    names = F.array_union(T.judge_tokens(title), F.array_distinct(F.flatten(F.transform(pieces, _judge_tokens))))
    hay = F.concat_ws("\n", title, path, text)
    spans = F.array_distinct(F.regexp_extract_all(question, F.lit("[\\u4e00-\\u9fff]{2,}"), F.lit(0)))
    ids = F.transform(F.filter(F.concat(F.regexp_extract_all(question, F.lit(CAMEL), F.lit(0)), F.regexp_extract_all(question, F.lit(LOOSE), F.lit(0))), lambda w: F.length(w) > 1), lambda w: T.casefold(w))
    around = F.array().cast("array<string>") if context is None else F.array_distinct(F.flatten(F.transform(context, _judge_tokens)))

    def total(q: Column) -> Column:
        n = F.size(q)

        def share(values: Column) -> Column:
            return F.when(n > 0, F.size(F.array_intersect(q, values)) / n).otherwise(0.0)

        in_text = T.bind(T.casefold(text), lambda low: F.size(F.filter(q, lambda w: F.contains(low, w))))
        phrase = F.when((n >= 2) & (in_text >= 2), PHRASE).otherwise(0.0)
        cjk = F.least(F.lit(CJK_MOST), CJK_EACH * T.bind(hay, lambda h: F.size(F.filter(spans, lambda s: F.contains(h, s)))))
        named = F.when(F.size(ids) > 0, F.when(T.bind(T.casefold(hay), lambda h: F.exists(ids, lambda w: F.contains(h, w))), IDENTIFIER)).otherwise(0.0)
        found = share(T.judge_tokens(text) if words is None else words) + phrase + CONTEXT * share(around) + TITLE * share(names) + cjk + F.coalesce(named, F.lit(0.0))
        nothing = (n == 0) & (F.size(spans) == 0) & (F.size(ids) == 0)
        return F.when(nothing, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), found)))

    return T.bind(T.judge_tokens(question), total)


def scored_with(scorer: Callable[[Column, Column], Column], question: Column, text: Column, fallback: Column) -> Column:
    """A scorer of the caller's (a pandas UDF or a Column function); NaN counts as 0, null falls back."""
    got = scorer(question, text)
    return F.coalesce(F.when(F.isnan(got), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), got))), fallback)


def seed_terms(seeds: DataFrame, limit: int = TERMS) -> DataFrame:
    """query_id, seed_rank, term, weight, term_rank: the best words and neighbouring pairs of each seed (query_id, seed_rank, question, text, evidence).

    Words of the question count only within pairs. Without document frequencies every term is as rare as the next.
    """
    asked = F.array_distinct(F.filter(F.regexp_extract_all(T.casefold("question"), F.lit("[a-z0-9_]+|[\\u4e00-\\u9fff]+"), F.lit(0)), lambda w: ~w.isin(*T.HOP_STOPWORDS)))
    words = seeds.select("query_id", "seed_rank", "evidence", asked.alias("asked"), F.posexplode(T.judge_sequence("text", T.HOP_STOPWORDS)).alias("at", "word"))
    follow = F.lead("word").over(Window.partitionBy("query_id", "seed_rank").orderBy("at"))
    both = words.withColumn("pair", F.concat_ws(" ", "word", follow)).withColumn("single", ~F.array_contains("asked", F.col("word"))).withColumn("paired", follow.isNotNull())
    terms = both.select("query_id", "seed_rank", "evidence", "asked", F.explode(F.array(F.when(F.col("single"), F.col("word")), F.when(F.col("paired"), F.col("pair")))).alias("term")).where("term is not null")
    counts = terms.groupBy("query_id", "seed_rank", "term").agg(F.count("*").alias("n"), F.first("evidence").alias("evidence"), F.first("asked").alias("asked"))
    link = 1.0 + 0.25 * F.size(F.array_intersect(F.array_distinct(F.split("term", " ")), "asked"))
    weight = F.col("n") * math.log(2.0) * link * (0.2 + 0.8 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("evidence"))))
    ranked = counts.withColumn("weight", weight).withColumn("term_rank", F.row_number().over(Window.partitionBy("query_id", "seed_rank").orderBy(F.col("weight").desc(), "term")))
    return ranked.where(F.col("term_rank") <= limit).select("query_id", "seed_rank", "term", "weight", "term_rank")


def hop(questions: DataFrame, initial: DataFrame, passages: DataFrame, find: Callable[[DataFrame], DataFrame], hops: int = HOPS) -> tuple[DataFrame, DataFrame]:
    """Pools of all questions, and why each stopped.

    initial: query_id, passage_id, score (best first). find maps (query_id, question) to hits (query_id, passage_id, rank);
    here a query is a term of a question. A term is used by the first seed that has it; a passage keeps its first score;
    at most JUDGED passages a question are judged, in the order they were found. Each round is written out
    (checkpoint) where the session has a folder for it.
    """
    body = passages.select("passage_id", "text", "title", "path")
    asked = questions.select("query_id", "question")

    def judged(found: DataFrame, said: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """found with evidence, and the question's words that the texts of found or of the pool before it (said) have.

        A passage's tokens are made once for all questions that it was found for; of the texts only the question's words are gathered.
        """
        told = cut(found.select("passage_id").distinct().join(body, "passage_id").withColumn("words", T.judge_tokens("text")))
        wanted = asked.select("query_id", T.judge_tokens("question").alias("wanted"))
        new = found.select("query_id", "passage_id").join(told.select("passage_id", "words"), "passage_id").join(wanted, "query_id")
        new = new.select("query_id", F.explode(F.array_intersect("wanted", "words")).alias("word"))
        said = cut((new if said is None else new.union(said)).distinct())
        around = said.groupBy("query_id").agg(F.collect_set("word").alias("around"))
        full = found.join(told, "passage_id").join(asked, "query_id").join(around, "query_id", "left").withColumn("around", F.coalesce("around", F.array().cast("array<string>")))
        return cut(full.withColumn("evidence", judge("question", "text", "title", "path", F.col("around"), F.col("words"))).drop("around", "words")), said

    first = initial.withColumn("order", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "passage_id"))).where(F.col("order") <= POOL)
    first = first.select("query_id", "passage_id", "score", F.col("order").cast("long").alias("order"), F.lit(0).alias("hop"))
    pool, said = judged(cut(first))
    used, spent, stops = None, None, None
    for step in range(1, hops + 1):
        best = Window.partitionBy("query_id").orderBy(F.col("evidence").desc(), "passage_id")
        open_ = pool if spent is None else pool.join(spent, ["query_id", "passage_id"], "left_anti")
        seeds = cut(open_.withColumn("seed_rank", F.row_number().over(best)).where(F.col("seed_rank") <= SEEDS))
        spent = seeds.select("query_id", "passage_id") if spent is None else spent.union(seeds.select("query_id", "passage_id"))
        terms = seed_terms(seeds).groupBy("query_id", "term").agg(F.min(F.struct("seed_rank", "term_rank")).alias("at"))
        if used is not None:
            terms = terms.join(used, ["query_id", "term"], "left_anti")
        terms = cut(terms)
        used = terms.select("query_id", "term") if used is None else used.union(terms.select("query_id", "term"))
        asked_terms = terms.select(F.struct("query_id", "term").alias("query_id"), F.col("term").alias("question"))
        hits = find(asked_terms).where(F.col("rank") <= PER_TERM).select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.term").alias("term"), "passage_id", "rank", "score")
        hits = hits.join(terms, ["query_id", "term"]).groupBy("query_id", "passage_id").agg(F.min(F.struct("at", "rank")).alias("at"), F.max("score").alias("score"))
        new = hits.join(pool.select("query_id", "passage_id"), ["query_id", "passage_id"], "left_anti")
        have = pool.groupBy("query_id").agg(F.max("order").alias("have"))
        new = new.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "passage_id"))).join(have, "query_id", "left")
        new = new.withColumn("order", F.col("k") + F.coalesce("have", F.lit(0))).where(F.col("order") <= JUDGED)
        new = new.select("query_id", "passage_id", "score", F.col("order").cast("long").alias("order"), F.lit(step).alias("hop"))
        found, said = judged(cut(new), said)
        counts = asked.select("query_id").join(terms.groupBy("query_id").agg(F.count("*").alias("n_terms")), "query_id", "left").join(found.groupBy("query_id").agg(F.count("*").alias("n_new"), F.max("order").alias("last")), "query_id", "left")
        why = F.when(F.col("n_terms").isNull(), "no_expansion_terms").when(F.col("n_new").isNull(), "no_new_candidates").when(F.col("last") >= JUDGED, "judge_budget").otherwise("max_hops" if step == hops else None)
        now = counts.select("query_id", why.alias("stop"), F.lit(step).alias("step"))
        stops = now if stops is None else stops.union(now)
        pool = cut(pool.unionByName(found))
    reason = asked.select("query_id").join(stops.where("stop is not null").groupBy("query_id").agg(F.min_by("stop", "step").alias("stop_reason")), "query_id", "left")
    return pool, reason.withColumn("stop_reason", F.coalesce("stop_reason", F.lit("completed")))
