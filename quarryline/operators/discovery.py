"""Discovery of enumerated entities, and batches of queries for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.identifiers import query_plan
from ..functions.markdown import fragments
from . import fusion
from .cut import cut, dealt, parts_for

# Words that ask for a list, words that ask for an explanation, words that are no anchors, and what Chinese words stand for.
ASKS = r"(?i)(?:\blist\b|\ball\b|\beach\b|\bevery\b|\bvarious\b|\bdifferent\b|\btypes?\b|\bavailable\b|\bmodules?\b|\bcatalog\b|\bdirectory\b|\boverview\b|列出|有哪些|各|每|分别|类型|目录|模块|清单|列表)"
EXPLAINS = r"(?i)(?:\bwhat\s+is\b|\bexplain\b|\bdescribe\b|\bmeaning\b|是什么|何为|含义|解释|说明|介绍)"
NO_ANCHORS = ["all", "available", "catalog", "directory", "list", "module", "modules", "overview", "reference", "show", "which"]
CJK_ALIASES = {
    "模块": ["module", "modules"], "脚本": ["script", "scripts"], "类型": ["type", "types"], "目录": ["catalog", "directory", "overview", "list"], "清单": ["catalog", "directory", "list"],
    "列表": ["list", "listing"],
}
# Names of catalogues, names that speak against one, and what each adds to a page's likeness.
CATALOG = r"(?i)catalog|directory|overview|modules?|types?|reference|list|目录|模块|类型|清单|列表"
PLURAL = r"(?i)\b(?:modules|types|catalogs|directories|lists|listings)\b"
NOISY = r"(?i)sample|reference|difference|tutorial|code|entry points?|api|file"
EXPLICIT = r"(?i)catalog|directory|overview|index|contents|list(?:ing)?|目录|模块|类型|清单|列表"
NO_NAMES = ["a", "na", "none", "null"]
PROBED, PROBED_PAGES, LISTED_PAGES = 20, 240, 32
SOURCE_PAGES, ENTITIES_SHOWN, BATCH, PER_ENTITY = 8, 40, 40, 80
PUBLIC_BYTES = 128 * 1024
TITLE, HEADING, PATH, BODY = 3.0, 2.0, 1.5, 1.0
AMBIGUOUS = 0.93


def requested(question: Column | str) -> Column:
    """Whether a question asks for a list: a wildcard that is not to be explained, or a word for lists unless one identifier is named."""
    text = T.text_of(question)
    plan = query_plan(question)
    named = F.size(F.filter(plan["qualified_identifiers"], lambda x: F.rlike(x["aliases"][0], F.lit(r"[/\s_-]"))))
    return F.when(plan["discovery_intent"], ~text.rlike(EXPLAINS)).otherwise((named != 1) & text.rlike(ASKS))


def anchors(question: Column | str) -> Column:
    """Latin words of a question, without one-letter ones, wildcards' prefixes and words of asking."""
    plan = query_plan(question)
    prefixes = F.flatten(F.transform(plan["namespace_wildcards"], lambda w: F.split(w, r"\.")))
    words = F.filter(plan["latin_terms"], lambda w: (F.length(w) > 1) & ~w.isin(*NO_ANCHORS))
    return F.array_distinct(F.array_except(words, prefixes))


def focus(question: Column | str) -> Column:
    """Latin words of a question, and what its Chinese words of listing stand for."""
    words = F.filter(query_plan(question)["latin_terms"], lambda w: (F.length(w) > 1) & ~w.isin(*NO_ANCHORS))
    none = F.array().cast("array<string>")
    more = [F.when(F.contains(T.text_of(question), F.lit(k)), T.strings(v)).otherwise(none) for k, v in CJK_ALIASES.items()]
    return F.array_distinct(F.concat(words, *more))


def _frequencies(terms: DataFrame, pages: DataFrame) -> DataFrame:
    """term, df: pages whose title or path has a term anywhere. Terms meet runs of letters on their first two characters."""
    runs = pages.select("path", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "title", "path")), F.lit("[a-z0-9_]{2,}"), F.lit(0)))).alias("run"))
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("run") - 1), lambda i: F.substring(F.col("run"), i, F.lit(2))))
    known = runs.select("run").distinct().withColumn("two", F.explode(pairs))
    met = known.join(terms.select("term", F.substring("term", 1, 2).alias("two")).distinct(), "two").where(F.contains("run", "term")).select("run", "term").distinct()
    return runs.join(met, "run").groupBy("term").agg(F.countDistinct("path").alias("df"))


def source_pages(questions: DataFrame, pages: DataFrame, passages: DataFrame | None = None, hits: DataFrame | None = None, most: int = SOURCE_PAGES) -> DataFrame:
    """query_id, path, likeness, source_rank: the pages that read most like the catalogue asked for.

    pages: those that may answer (path, title). Words of the question in title and path count, unless more than half of the
    pages have them, and so do names of catalogues. passages (path, ordinal, text) tell for a wildcard which pages name members of its
    namespace; hits (query_id, path, rank) of a search for the anchors stand in where no page is found.
    """
    n = pages.count()
    asked = cut(questions.select("query_id", anchors("question").alias("anchors"), focus("question").alias("focus"), T.namespace_wildcards("question").alias("wild")))
    terms = asked.select("query_id", F.explode("anchors").alias("term"), F.lit(True).alias("anchor"), F.lit(False).alias("is_focus")).unionByName(asked.select("query_id", F.explode("focus").alias("term"), F.lit(False).alias("anchor"), F.lit(True).alias("is_focus")))
    terms = terms.groupBy("query_id", "term").agg(F.max("anchor").alias("anchor"), F.max("is_focus").alias("is_focus"))
    rare = terms.join(_frequencies(terms.where("anchor"), pages), "term", "left").where(~F.col("anchor") | (F.coalesce("df", F.lit(0)) <= max(1, n // 2)))
    name = lambda c: F.lower(T.text_of(c))
    words = pages.select("path", name("title").alias("t"), name("path").alias("p"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "title", "path")), F.lit("[a-z0-9]+"), F.lit(0)))).alias("first"))
    met = words.join(rare.withColumn("first", F.regexp_extract("term", "[a-z0-9]+", 0)), "first")
    inside = lambda c: F.rlike(F.col(c), F.concat(F.lit("(?<![a-z0-9])"), F.col("term"), F.lit("(?![a-z0-9])")))
    told = met.groupBy("query_id", "path").agg(
        F.count_if(F.col("anchor") & (inside("t") | inside("p"))).alias("overlap"), F.count_if(F.col("is_focus") & inside("t")).alias("title_focus"), F.count_if(F.col("is_focus") & inside("p")).alias("path_focus")
    )
    title, path = T.text_of("title"), F.col("path")
    kinds = pages.select("path", title.rlike(CATALOG).alias("ct"), path.rlike(CATALOG).alias("cp"), title.rlike(PLURAL).alias("plural"), title.rlike(NOISY).alias("noisy"), (title.rlike(PLURAL) | title.rlike(EXPLICIT)).alias("strong"))
    wild = asked.where(F.size("wild") > 0).select("query_id")
    every = told.select("query_id", "path").union(wild.withColumn("k", F.lit(1)).join(kinds.where("ct or cp").select("path", F.lit(1).alias("k")), "k").select("query_id", "path")).distinct()
    both = every.join(told, ["query_id", "path"], "left").fillna(0, ["overlap", "title_focus", "path_focus"]).join(kinds, "path").join(asked.select("query_id", (F.size("wild") > 0).alias("is_wild"), F.size("focus").alias("n_focus")), "query_id")
    both = both.where((F.col("overlap") > 0) | (F.col("title_focus") > 0) | (F.col("is_wild") & (F.col("ct") | F.col("cp"))))
    likeness = F.col("overlap") + F.col("title_focus") * 2 + F.col("path_focus") + F.when(F.col("ct"), 3).otherwise(0) + F.when(F.col("cp"), 1).otherwise(0) + F.when(F.col("plural"), 2).otherwise(0) - F.when(F.col("noisy"), 5).otherwise(0)
    scored = cut(both.withColumn("likeness", likeness.cast("long")))
    q = Window.partitionBy("query_id")
    best = scored.withColumn("place", F.row_number().over(q.orderBy(F.col("likeness").desc(), "path")))
    names = _named(asked, best.where(F.col("is_wild") & (F.col("place") <= PROBED_PAGES)), passages)
    best = best.join(names, ["query_id", "path"], "left").withColumn("names", F.coalesce("names", F.lit(0)))
    enough = F.greatest(F.lit(2), F.floor(F.max("names").over(q) / 10))
    best = best.withColumn("full", F.col("names") >= enough).withColumn("some", F.max((F.col("names") >= enough).cast("int")).over(q) == 1)
    best = best.where(~F.col("is_wild") | ~F.col("some") | F.col("full"))
    grade = F.when(F.col("strong") & ~F.col("noisy"), 2).when(F.col("strong"), 1).otherwise(0)
    best = best.withColumn("grade", grade).withColumn("top_grade", F.max(grade).over(q))
    plain = ~F.col("is_wild") & (F.col("n_focus") > 0)
    best = best.where(~plain | (F.col("grade") == F.col("top_grade")))
    best = best.withColumn("top", F.max("likeness").over(q)).where(~plain | (F.col("likeness") >= F.col("top") - 1))
    rank = F.row_number().over(q.orderBy(F.when(F.col("is_wild"), -F.col("names")).otherwise(0), F.col("likeness").desc(), "path"))
    found = best.withColumn("source_rank", rank).where(F.col("source_rank") <= F.when(F.col("is_wild") | plain, most).otherwise(LISTED_PAGES)).select("query_id", "path", "likeness", "source_rank")
    if hits is None:
        return found
    found = cut(found)
    first = hits.groupBy("query_id", "path").agg(F.min("rank").alias("rank")).join(found.select("query_id").distinct(), "query_id", "left_anti")
    rest = first.withColumn("source_rank", F.row_number().over(q.orderBy("rank", "path"))).where(F.col("source_rank") <= LISTED_PAGES)
    return found.unionByName(rest.select("query_id", "path", F.lit(0).cast("long").alias("likeness"), "source_rank"))


def _named(asked: DataFrame, candidates: DataFrame, passages: DataFrame | None) -> DataFrame:
    """query_id, path, names: how many members of a wildcard's namespace a page's first passages name."""
    if passages is None:
        return candidates.select("query_id", "path", F.lit(0).alias("names"))
    first = F.row_number().over(Window.partitionBy("query_id", "path").orderBy("ordinal")) <= PROBED
    rows = candidates.select("query_id", "path").join(passages.select("path", "ordinal", "text"), "path").withColumn("first", first).where("first").join(asked.select("query_id", "wild"), "query_id")
    rows = rows.select("query_id", "path", "text", F.explode("wild").alias("w"))
    prefix = F.array_join(F.split("w", r"\."), r"\s*\.\s*")
    pattern = F.concat(F.lit("(?i)(?<![a-z0-9])"), prefix, F.lit(r"\s*/\s*([a-z][a-z0-9_-]*(?:\s*/\s*[a-z][a-z0-9_-]*)*)(?![a-z0-9_/])"))
    each = rows.select("query_id", "path", "w", F.explode(F.regexp_extract_all("text", pattern, F.lit(1))).alias("name"))
    each = each.withColumn("name", T.casefold(F.regexp_replace("name", r"\s*/\s*", "/"))).where(~F.col("name").isin(*NO_NAMES))
    return each.groupBy("query_id", "path").agg(F.countDistinct("w", "name").cast("int").alias("names"))


def mine(pages: DataFrame) -> DataFrame:
    """path, kind, grp, label, ordinal: members of lists and tables with two members or more; where a group has a table, its lists give way."""
    from ..functions.markdown import _rows

    schema = "path string, kind string, grp string, label string, ordinal int"
    from pyspark.sql import types as P

    made = P.StructType([P.StructField(n, P.IntegerType() if t == "int" else P.StringType()) for n, t in (x.split() for x in schema.split(", "))])
    rows = _rows(pages, ["path", "body"], made, lambda path, body: ({"path": path, "kind": k, "grp": g, "label": label, "ordinal": n} for n, (k, g, label) in enumerate(fragments(body or ""))))
    rows = rows.where("kind <> 'heading' and label <> ''").dropDuplicates(["path", "kind", "grp", "label"])
    group = Window.partitionBy("path", "kind", "grp")
    full = rows.withColumn("n", F.count("*").over(group)).where("n >= 2").drop("n")
    tables = F.max((F.col("kind") == "table").cast("int")).over(Window.partitionBy("path", F.split("grp", "#")[0]))
    return full.withColumn("__t", tables).where("__t = 0 or kind = 'table'").drop("__t")


def constrain(entities: DataFrame, question: Column | str) -> DataFrame:
    """Entities of the namespaces a question names; all if it names none."""
    names = T.namespace_wildcards(question)
    inside = T.bind(T.casefold("label"), lambda own: F.exists(names, lambda p: F.startswith(own, F.concat(p, F.lit("/"))) | F.startswith(own, F.concat(p, F.lit(".")))))
    return entities.where((F.size(names) == 0) | inside)


def public(entities: DataFrame, most: int = ENTITIES_SHOWN, budget: int = PUBLIC_BYTES) -> DataFrame:
    """The first entities of a question within a count and a budget of bytes."""
    w = Window.partitionBy("query_id").orderBy("ordinal", "label")
    sized = entities.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    size = F.sum(F.octet_length(F.to_json(F.struct("label", "path")))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("__b", size).where(F.col("__b") <= budget).drop("__b", "k")


def entity_queries(entities: DataFrame, questions: DataFrame) -> DataFrame:
    """entity_id, question: an entity's name and the question without any entity's words."""
    every = entities.groupBy("query_id").agg(F.flatten(F.collect_set(T.tokens("label"))).alias("names"))
    base = questions.join(every, "query_id").select("query_id", F.array_join(F.array_except(T.tokens("question"), F.col("names")), " ").alias("rest"))
    return entities.join(base, "query_id").select("query_id", F.concat_ws("\0", F.col("query_id").cast("string"), "label").alias("entity_id"), "label", F.trim(F.concat_ws(" ", "label", "rest")).alias("question"))


def alias_pattern(alias: Column) -> Column:
    """A pattern for an alias whose parts may be joined by slash, blank, underscore or hyphen; empty for one without parts."""
    parts = F.filter(F.split(T.casefold(alias), r"[/\s_-]+"), lambda p: p != "")
    quoted = F.transform(parts, lambda p: F.regexp_replace(p, r"([^\p{L}\p{N}_])", r"\\$1"))
    return F.when(F.size(parts) > 0, F.concat(F.lit("(?<![a-z0-9_])"), F.array_join(quoted, r"[/\s_-]+"), F.lit("(?![a-z0-9_])"))).otherwise("")


def match_signals(aliases: Column, score: Column, title: Column | str, heading: Column | str, path: Column | str, body: Column | str) -> Column:
    """score with points added for the places that name an alias (title 3, heading 2, path 1.5, body 1), exact, and which places do."""
    known = F.filter(aliases, lambda a: F.trim(a) != "")

    def named(c: Column | str) -> Column:
        return T.bind(T.casefold(c), lambda text: F.exists(known, lambda a: F.contains(text, T.casefold(a)) | ((alias_pattern(a) != "") & F.rlike(text, alias_pattern(a)))))

    places = {"title": (named(title), TITLE), "heading": (named(heading), HEADING), "path": (named(path), PATH), "body": (named(body), BODY)}
    points = sum((F.when(at, w).otherwise(0.0) for at, w in places.values()), F.lit(0.0))
    any_ = places["title"][0] | places["heading"][0] | places["path"][0] | places["body"][0]
    return F.struct(F.bround(F.greatest(score, F.lit(0.0)) + points, 12).alias("score"), any_.alias("exact"), *[at.alias(name) for name, (at, _) in places.items()])


def entity_ladder(entities: DataFrame, corpus, where: Column | None = None, limit: int = PER_ENTITY) -> DataFrame:
    """query_id (the entity's), passage_id, path, ordinal, score, rank: each entity by its identifier or name, else strictly by its
    question, else by any of its words.

    entities: entity_id, label, question. All entities go down the ladder together.
    """
    from . import lexical

    name = entities.select(F.col("entity_id").alias("query_id"), F.col("label").alias("question"))
    asked = entities.select(F.col("entity_id").alias("query_id"), "question")
    known = name.withColumn("n", F.size(lexical.identifiers("question")))
    first = lexical.search(known.where("n > 0").drop("n"), corpus, "qualified", limit, where).unionByName(lexical.search(known.where("n = 0").drop("n"), corpus, "strict", limit, where))
    steps = [first, lexical.search(asked, corpus, "strict", limit, where), lexical.search(asked, corpus, "relaxed", limit, where)]
    return lexical.ladder(steps, "descend_if_empty")


def entity_pages(hits: DataFrame) -> DataFrame:
    """The best passage of each page of an entity: hits (entity_id, path, passage_id, signal struct of match_signals)."""
    w = Window.partitionBy("entity_id", "path").orderBy(F.col("signal.score").desc(), F.col("passage_id").desc())
    return hits.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def statuses(entities: DataFrame, found: DataFrame) -> DataFrame:
    """entity_id, status, confidence, path, n_pages, reason of entities, by their pages (entity_id, path, passage_id, score, source_kind).

    Of an entity's pages those count that come near the best. Two nearly equal ones, or pages of different kinds, are ambiguous;
    none, or none that is relevant at all, is unresolved.
    """
    parts = parts_for(entities, found)
    entities, found = dealt(entities, parts, "entity_id"), dealt(found, parts, "entity_id")
    near = fusion.plateau(found, by="entity_id")
    two = near.groupBy("entity_id").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("score", "path"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"), F.countDistinct("source_kind").alias("kinds"), F.count("*").cast("long").alias("n_pages")
    )
    some = found.select("entity_id", F.lit(True).alias("some")).distinct()
    rows = entities.select("entity_id").join(two, "entity_id", "left").join(some, "entity_id", "left")
    open_ = F.coalesce((F.col("n_pages") > 1) & ((F.col("b") >= AMBIGUOUS * F.col("a.score")) | (F.col("kinds") > 1)), F.lit(False))
    share = F.when(F.col("n_pages") == 1, 1.0).otherwise(F.col("a.score") / F.greatest(F.col("a.score") + F.col("b"), F.lit(1e-9)))
    status = F.when(F.col("a").isNull(), "unresolved").when(open_, "ambiguous").otherwise("ok")
    confidence = F.when(F.col("a").isNull(), 0.0).when(open_, F.least(share, F.lit(0.55))).otherwise(share)
    reason = F.when(F.col("a").isNull(), F.when(F.col("some"), "unresolved:below_minimum_relevance").otherwise("unresolved:no_eligible_candidates"))
    return rows.select("entity_id", status.alias("status"), F.bround(confidence, 4).alias("confidence"), F.col("a.path").alias("path"), F.coalesce("n_pages", F.lit(0).cast("long")).alias("n_pages"), reason.alias("reason"))


def overall_status(states: DataFrame) -> DataFrame:
    """query_id, status of a question's entities together: ok, partial or unresolved. states: query_id, status."""
    n = states.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "unresolved").alias("lost"))
    return n.select("query_id", F.when(F.col("ok") == F.col("n"), "ok").when(F.col("lost") == F.col("n"), "unresolved").otherwise("partial").alias("status"))


def batch(entities: DataFrame, offset: int = 0, size: int = BATCH) -> DataFrame:
    """A batch of a question's entities from an offset on; more says whether there are others."""
    w = Window.partitionBy("query_id").orderBy("ordinal", "label")
    ranked = entities.withColumn("k", F.row_number().over(w)).withColumn("more", F.count("*").over(Window.partitionBy("query_id")) > offset + size)
    return ranked.where((F.col("k") > offset) & (F.col("k") <= offset + size)).drop("k")


def shared_pages(results: DataFrame) -> DataFrame:
    """results with shared: whether a page answers for several entities."""
    n = F.size(F.collect_set("entity_id").over(Window.partitionBy("query_id", "path")))
    return results.withColumn("shared", n > 1)


def discover(questions: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Entities of the first level (selection, active store, raw store; each query_id, label, ...) that has any for a question."""
    from .lexical import ladder

    asked = questions.where(requested("question")).select("query_id")
    return ladder([level.join(asked, "query_id", "left_semi") for level in levels], "descend_if_empty")
