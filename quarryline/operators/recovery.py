"""Recovery of weak results: coverage merge, relaxed and raw single shots, and the opt-in ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .fusion import RRF_K

WEAK = 0.15
RELAXED_LIMIT, RAW_LIMIT, RAW_CAP = 40, 20, 0.35
PER_TITLE_TERM, PER_HEADING_TERM, TERM_MOST = 4.0, 2.0, 3
PHRASE_TITLE, PHRASE_HEADING, QUESTION_BODY, PHRASE_EXACT, PHRASE_VARIANT = 5.0, 2.0, 1.5, 20.0, 10.0


def uncovered_terms(question: Column | str, selected_text: Column) -> Column:
    """Latin terms of three or more characters that the selection's titles and texts lack."""
    asked = F.array_distinct(F.filter(T.latin_tokens(question), lambda w: F.length(w) >= 3))
    return F.array_except(asked, T.latin_tokens(selected_text))


def uncovered(questions: DataFrame, selected: DataFrame) -> DataFrame:
    """query_id, question, terms: what no selected passage of a question holds."""
    words = selected.select("query_id", F.explode(T.latin_tokens(F.concat_ws("\n", "title", "text"))).alias("term")).distinct()
    asked = questions.select("query_id", F.explode(F.array_distinct(T.latin_tokens("question"))).alias("term")).where(F.length("term") >= 3)
    left = asked.join(words, ["query_id", "term"], "left_anti").groupBy("query_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    return questions.select("query_id", "question").join(left, "query_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def page_coverage(items: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, path, covered (terms), ratio: a page covers what any of its passages covers."""
    words = items.select("query_id", "path", F.explode(T.latin_tokens(F.concat_ws("\n", "title", "text"))).alias("term")).distinct()
    asked = terms.select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    return words.join(asked, ["query_id", "term"]).groupBy("query_id", "path").agg(F.array_sort(F.collect_set("term")).alias("covered"), (F.count("*") / F.max("n")).alias("ratio"))


def coverage_merge(wiki: DataFrame, raw: DataFrame, terms: DataFrame, k: int = RRF_K) -> DataFrame:
    """wiki and those raw items whose page covers a missing term, by coverage + (k+1)/(k+rank) + authority.

    Items: query_id, path, passage_id, title, text, score. Authority is 0.35 x coverage for raw items and
    min(score / 100, 0.35) for others.
    """
    both = wiki.withColumn("from_raw", F.lit(False)).unionByName(raw.withColumn("from_raw", F.lit(True)), allowMissingColumns=True)
    placed = both.join(page_coverage(both, terms), ["query_id", "path"], "left").withColumn("ratio", F.coalesce("ratio", F.lit(0.0))).where(~F.col("from_raw") | (F.col("ratio") > 0))
    rank = F.row_number().over(Window.partitionBy("query_id", "from_raw").orderBy(F.col("score").desc(), "path", "passage_id"))
    authority = F.when(F.col("from_raw"), RAW_CAP * F.col("ratio")).otherwise(F.least(F.col("score") / 100.0, F.lit(RAW_CAP)))
    fused = placed.withColumn("source_rank", rank).withColumn("fusion_score", F.bround(F.col("ratio") + (k + 1) / (k + F.col("source_rank")) + authority, 12))
    w = Window.partitionBy("query_id", "passage_id").orderBy(F.col("fusion_score").desc())
    return fused.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def pool_kind(questions: DataFrame, scored: DataFrame) -> DataFrame:
    """query_id, kind: empty, weak (best evidence under 0.15) or strong."""
    best = scored.groupBy("query_id").agg(F.max("evidence").alias("best"), F.count("*").alias("n"))
    kind = F.when(F.col("n").isNull(), "empty").when(F.coalesce("best", F.lit(0.0)) < WEAK, "weak").otherwise("strong")
    return questions.select("query_id").join(best, "query_id", "left").select("query_id", kind.alias("kind"))


def wants_relaxed(kind: Column, question: Column, scope: Column) -> Column:
    return (kind != "strong") & question.rlike("[\\u4e00-\\u9fff]") & ~scope.isin("raw", "archive")


def relaxed_scores(hits: DataFrame, as_of: Column, scope: str = "knowledge") -> DataFrame:
    """Relaxed hits scored with title, authority, freshness and steps, at most 40 a question."""
    authority = T.authority_bonus(F.col("path"), F.col("corpus"), F.col("source_kind"), F.col("intent"), F.lit(scope), F.col("freshness"))
    score = F.bround((RRF_K + 1) * T.rrf(F.col("rank")) + authority + T.title_overlap_bonus("question", "title") + T.freshness_bonus("updated_at", as_of) + T.step_bonus(F.col("steps")), 12)
    return hits.where(F.col("rank") <= RELAXED_LIMIT).withColumn("score", score)


def is_strong(question: Column | str, title: Column | str, path: Column | str, text: Column | str, aliases: Column | None = None, extra: Column | None = None, body_evidence: bool = True) -> Column:
    """Whether a hit is more than words in common: the title, a phrase, an identifier or a title word tells.

    aliases: spellings of the question's identifiers; extra: expansion terms. Without body_evidence the body tells nothing, and of
    title words one that is not generic, or two, must meet.
    """
    none = F.array().cast("array<string>")
    q, name, where = F.trim(T.casefold(question)), T.casefold(title), T.casefold(path)
    place = F.concat_ws("\n", name, where)
    hay = F.concat_ws("\n", place, T.casefold(text)) if body_evidence else place
    aliases, extra = (none if c is None else F.transform(F.coalesce(c, none), lambda x: T.casefold(x)) for c in (aliases, extra))
    phrases = F.transform(T.multiword_runs(question), lambda r: T.casefold(r))

    def said(terms: Column, text: Column) -> Column:
        return T.bind(text, lambda t: F.exists(terms, lambda x: (x != "") & F.contains(t, x)))

    words, mine = F.array_distinct(T.tokens(question)), F.array_distinct(T.tokens(title))
    met = F.array_intersect(mine, F.array_union(words, extra))
    near = T.bind(words, lambda ws: F.filter(mine, lambda m: (F.length(m) >= 4) & F.exists(ws, lambda w: (w != m) & (F.length(w) >= 4) & (F.levenshtein(w, m, 1) == 1))))

    def enough(overlap: Column) -> Column:
        if body_evidence:
            return F.size(overlap) > 0
        return (F.size(F.array_except(overlap, T.strings(T.GENERIC_TITLE_TOKENS))) >= 1) | (F.size(overlap) >= 2)

    named = (name != "") & (F.contains(q, name) | F.contains(name, q))
    whole = (F.length(q) >= 4) & ((q == name) | (q == where))
    tells = named | whole | said(phrases, hay) | said(aliases, hay) | said(extra, place) | enough(met) | ((F.size(near) > 0) & enough(F.array_union(met, near)))
    return (q != "") & F.coalesce(tells, F.lit(False))


def raw_scores(hits: DataFrame, variant: bool = False) -> DataFrame:
    """score of raw hits (question, title, heading, text, fts_score): terms in title and heading, phrases, and the question in the body."""
    asked = F.array_distinct(T.tokens("question"))
    in_title = F.least(F.size(F.array_intersect(asked, T.tokens("title"))), F.lit(TERM_MOST))
    in_heading = F.least(F.size(F.array_intersect(asked, T.tokens("heading"))), F.lit(TERM_MOST))
    phrases = F.transform(T.multiword_runs("question"), lambda r: T.casefold(r))
    title, heading, body = T.casefold("title"), T.casefold("heading"), T.casefold("text")
    def has(c: Column) -> Column:
        return T.bind(c, lambda x: F.exists(phrases, lambda p: F.contains(x, p)))
    score = (
        F.coalesce("fts_score", F.lit(0.0)) + PER_TITLE_TERM * in_title + PER_HEADING_TERM * in_heading
        + F.when(has(title), PHRASE_TITLE).when(has(heading), PHRASE_HEADING).otherwise(0.0)
        + F.when((T.casefold("question") != "") & F.contains(body, T.casefold("question")), QUESTION_BODY).otherwise(0.0)
        + F.when(has(F.concat_ws("\n", title, heading, body)), PHRASE_VARIANT if variant else PHRASE_EXACT).otherwise(0.0)
    )
    return hits.withColumn("score", F.bround(score, 12))


def raw_merge(wiki: DataFrame, raw: DataFrame, kinds: DataFrame, k: int = RRF_K, cap: int = RAW_LIMIT) -> DataFrame:
    """Raw items replace an empty pool, join a weak one by reciprocal ranks (wiki items all stay), and leave a strong one alone."""
    some = raw.join(kinds.where("kind <> 'strong'"), "query_id", "left_semi")
    both = wiki.withColumn("from_raw", F.lit(False)).unionByName(some.withColumn("from_raw", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy("query_id", "from_raw").orderBy(F.col("score").desc(), "path", "passage_id")
    ranked = both.withColumn("source_rank", F.row_number().over(w)).where(~F.col("from_raw") | (F.col("source_rank") <= cap))
    return ranked.withColumn("fusion_score", F.bround((k + 1) / (k + F.col("source_rank")), 12))


# The branches of the opt-in ladder with what each writes into the envelope. level, reason, lexical mode.
FALLBACKS = {
    "coverage": ("raw", "wiki_primary_missing_latin_coverage", None), "all_coverage": ("raw", "wiki_primary_missing_latin_coverage", None),
    "wiki_relaxed": ("none", None, "relaxed"), "raw_zero_weak": ("raw", "wiki_weak_primary", "raw"), "raw_zero_empty": ("raw", "wiki_zero_results", "raw"),
}


def plan_fallback(primary: Column, uncovered: Column, scope: Column, strong: Column, raw_available: Column, relaxed_answered: Column, relaxed_available: Column) -> Column:
    """branch, level, reason, mode of the next step of the opt-in ladder; null where there is none.

    primary: the first stage found something; strong: what it found is; uncovered: Latin words of the question are missing in
    it; raw_available: yes, no or unknown.
    """
    wide, raw = scope.isin("knowledge", "all"), raw_available.isin("unknown", "yes")
    branch = (
        F.when(primary & uncovered & wide, "coverage").when(~primary & (scope == "all") & relaxed_answered & uncovered & raw, "all_coverage")
        .when(~primary & wide & relaxed_available, "wiki_relaxed").when(~strong & wide & raw, F.when(primary, "raw_zero_weak").otherwise("raw_zero_empty"))
    )
    table = F.create_map(*[x for name, (level, reason, mode) in FALLBACKS.items() for x in (F.lit(name), F.struct(F.lit(level).alias("level"), F.lit(reason).cast("string").alias("reason"), F.lit(mode).cast("string").alias("mode")))])
    got = F.get(F.array(table[branch]), F.lit(0))
    name = F.regexp_replace(branch, "_(weak|empty)$", "")
    return F.when(branch.isNotNull(), F.struct(name.alias("branch"), got["level"].alias("level"), got["reason"].alias("reason"), got["mode"].alias("mode")))


def wants_raw(kind: Column, scope: Column) -> Column:
    """Whether one strict search of the raw pages follows an empty or weak pool."""
    return (kind != "strong") & scope.isin("knowledge", "all")


def envelope(level: str, reasons: list[str], paths: list[str]) -> Column:
    return F.struct(F.lit(level).alias("level"), T.strings(reasons).alias("reasons"), T.strings(paths).alias("allowed_source_paths"))
