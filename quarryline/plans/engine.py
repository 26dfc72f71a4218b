"""The public surface: build an index from a vault, ask batches of questions, list and read, evaluate."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.codecs import read_batch_token
from ..operators import catalog, context, evaluation, evidence, filters, fusion, graph, lexical, quality, recovery, state
from ..operators.cut import cut
from ..sources import pages as source_pages

#: What ask() accepts besides questions.
MAX_K = 40


@dataclass
class Engine:
    """Tables of one build. passages, pages and links as sources.pages makes them; vectors if there are any."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    vectors: DataFrame | None = None
    snapshot: str = ""
    gate_mode: str = "off"
    weights: fusion.Weights = field(default_factory=fusion.Weights)

    @classmethod
    def from_vault(cls, spark: SparkSession, root: str, scope: str = "active") -> Engine:
        rows = source_pages.pages(source_pages.scan(spark, root, scope), scope)
        return cls(spark, source_pages.build(rows))

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Engine:
        return cls(spark, source_pages.load(spark, root))

    @cached_property
    def corpus(self) -> lexical.Corpus:
        """The passages with their fields; tokens are made once for all searches of this engine."""
        pages, passages = self.tables["pages"], self.tables["passages"].withColumnRenamed("page_path", "path")
        fields = lexical.index_fields(pages, passages)
        more = pages.drop("title", "aliases", "body", "tags").withColumnRenamed("frontmatter", "__f").drop("__f")
        return lexical.Corpus(cut(fields.join(more, "path")), lexical.WEIGHTS)

    def ask(self, questions: DataFrame, scope: str = "auto", filter_map: Mapping | None = None, k: int = 10, hops: int = evidence.HOPS, expand_graph: bool = True) -> tuple[DataFrame, DataFrame]:
        """results and diagnostics of questions (query_id, question, and terms: further terms, if any), both by query_id.

        With scope auto a question about what was said before is answered from history, others from knowledge. Diagnostics: kind
        of the first pool, stop_reason of the hops, intent, scope, and level and reasons of the recovery.
        """
        if not 1 <= k <= MAX_K or scope not in filters.SCOPES:
            raise ValueError("invalid_top_k" if scope in filters.SCOPES else "invalid_scope")
        asked = cut(questions.withColumn("intent", T.intent("question")).withColumn("scope", filters.effective_scope(F.lit(scope), F.col("intent"))))
        scopes = [r["scope"] for r in asked.select("scope").distinct().collect()] or ["knowledge"]  # two at most
        parts = [self._ask(asked.where(F.col("scope") == s), s, filters.normalise_filters(filter_map), k, hops, expand_graph) for s in sorted(scopes)]
        results, about = parts[0]
        for more, other in parts[1:]:
            results, about = results.unionByName(more), about.unionByName(other)
        return results, about

    def _ask(self, asked: DataFrame, scope: str, wanted: dict, k: int, hops: int, expand_graph: bool) -> tuple[DataFrame, DataFrame]:
        corpus = self.corpus
        where = filters.eligible(scope) & filters.matches(wanted)
        relaxed = lexical.search(asked, corpus, "relaxed", recovery.RELAXED_LIMIT, where, "terms" if "terms" in asked.columns else None)
        first = cut(lexical.ladder([lexical.stage_one(asked, corpus, where, scope), relaxed], "descend_if_empty"))
        find = lambda q: lexical.search(q, corpus, "strict", evidence.PER_TERM, where)
        pool, stops = evidence.hop(asked.select("query_id", "question"), first, corpus.passages.withColumn("text", F.col("body")), find, hops)
        ranked = lexical.top(pool.select("query_id", "passage_id", "path", "evidence"), evidence.JUDGED, [F.col("evidence").desc(), F.col("path"), F.col("passage_id")])
        title = lexical.title_candidates(asked, self.tables["pages"].where(where)).join(fusion.first_per_page(corpus.passages, 1).select("path", "passage_id"), "path")
        found = fusion.candidates(ranked, title, self._vector_hits(asked, scope)).join(corpus.passages.where(where), "passage_id").join(asked, "query_id")
        found = found.join(pool.select("query_id", "passage_id", "evidence"), ["query_id", "passage_id"], "left")
        columns = ["query_id", "path", "passage_id", "score", "evidence", "rrf", "exact", "fts_rank", "title_rank", "vector_rank", "vector_score", "source_kind", "question"]
        scored = cut(fusion.best_per_page(fusion.fuse(found, weights=self.weights, scope=scope)).select(columns))
        kinds = cut(recovery.pool_kind(asked, pool))
        scored, fallback = self._recovered(asked, scored, kinds, scope, wanted, k)
        if expand_graph:
            scored = cut(self._expand(scored, where, k))
        results = fusion.split_results(fusion.adaptive_expand(scored, k), k)
        about = kinds.join(stops, "query_id").join(asked.select("query_id", "intent", "scope"), "query_id").join(fallback, "query_id", "left")
        return results, about.withColumn("level", F.coalesce("level", F.lit("none"))).withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))

    def _vector_hits(self, asked: DataFrame, scope: str) -> DataFrame:
        if self.vectors is not None and "query_vector" in asked.columns and scope not in ("raw", "archive"):
            return fusion.vector_hits(asked, self.vectors)
        return asked.sparkSession.createDataFrame([], f"query_id {asked.schema['query_id'].dataType.simpleString()}, passage_id string, vector_rank int, vector_score double")

    def _recovered(self, asked: DataFrame, scored: DataFrame, kinds: DataFrame, scope: str, wanted: dict, k: int) -> tuple[DataFrame, DataFrame]:
        """scored with what recovery adds to it, and query_id, level, reasons of the questions that it answered from raw pages.

        A pool that is not strong is filled by one relaxed search where the question is Chinese, then by one search of the raw pages
        (an empty pool is replaced, a weak one joined); a strong one that lacks words of the question gains raw pages that hold them.
        """
        corpus, state_of = self.corpus, asked.join(kinds, "query_id")
        none = asked.sparkSession.createDataFrame([], f"query_id {asked.schema['query_id'].dataType.simpleString()}, level string, reasons array<string>")
        if scope not in ("knowledge", "all"):
            return scored, none
        texts = corpus.passages.select("passage_id", F.col("body").alias("text"), "title", "path", "heading", "source_kind")
        base = scored.columns
        here = filters.eligible(scope) & filters.matches(wanted)
        chinese = state_of.where(recovery.wants_relaxed(F.col("kind"), F.col("question"), F.lit(scope)))
        more = lexical.search(chinese, corpus, "relaxed", recovery.RELAXED_LIMIT, here).join(corpus.passages.drop("path", "ordinal"), "passage_id").join(asked.select("query_id", "question", "intent"), "query_id")
        updated = F.col("updated_at") if "updated_at" in more.columns else F.lit(None).cast("string")
        more = recovery.relaxed_scores(more.withColumn("updated_at", updated).withColumn("steps", T.step_count("text")), F.current_date(), scope)
        more = more.where(recovery.is_strong("question", "title", "path", "text")).join(scored.select("query_id", "path"), ["query_id", "path"], "left_anti")
        scored = scored.unionByName(fusion.best_per_page(more).select("query_id", "path", "passage_id", "score", "source_kind", "question"), allowMissingColumns=True)
        raw_where = filters.eligible("raw") & filters.matches(wanted)
        missing = recovery.uncovered(asked, lexical.top(scored, k, fusion.ranked_order()).select("query_id", "passage_id").join(texts, "passage_id"))
        open_ = cut(state_of.select("query_id", "question", "kind").join(missing.select("query_id", "terms"), "query_id").where((F.col("kind") != "strong") | (F.size("terms") > 0)))
        steps = [lexical.search(open_, corpus, mode, recovery.RAW_LIMIT, raw_where) for mode in ("strict", "qualified", "phrase", "prefix", "relaxed")]
        raw = lexical.ladder([lexical.merge_by_passage(steps[0], steps[1]), *steps[2:]], "descend_if_empty")
        raw = raw.select("query_id", "passage_id", F.col("score").alias("fts_score")).join(texts, "passage_id").join(open_, "query_id")
        raw = cut(fusion.best_per_page(recovery.raw_scores(raw)).select("query_id", "path", "passage_id", "score", "title", "text", "source_kind", "question", "kind", "terms"))
        weak = recovery.raw_merge(scored.join(kinds.where("kind <> 'strong'"), "query_id", "left_semi"), raw.where("kind <> 'strong'").drop("title", "text", "kind", "terms"), kinds)
        lacking = raw.where("kind = 'strong'").select("query_id").distinct()
        strong = scored.join(lacking, "query_id", "left_semi")
        covered = recovery.coverage_merge(strong.join(texts.select("passage_id", "title", "text"), "passage_id"), raw.where("kind = 'strong'").drop("kind", "terms"), missing)
        merged = weak.unionByName(covered, allowMissingColumns=True)
        gained = merged.where("from_raw").select("query_id").distinct().join(state_of.select("query_id", "kind"), "query_id")
        reason = F.when(F.col("kind") == "empty", "wiki_zero_results").when(F.col("kind") == "weak", "wiki_weak_primary").otherwise("wiki_primary_missing_latin_coverage")
        fallback = cut(gained.select("query_id", F.lit("raw").alias("level"), F.array(reason).alias("reasons")))
        # questions that gained nothing keep their scores
        changed = merged.join(fallback.select("query_id"), "query_id", "left_semi").withColumn("score", F.col("fusion_score")).select(base)
        return cut(scored.join(fallback.select("query_id"), "query_id", "left_anti").select(base).unionByName(changed)), fallback

    def _expand(self, scored: DataFrame, where: Column, k: int) -> DataFrame:
        pages = self.tables["pages"]
        links = graph.resolve(graph.stored_edges(self.tables["links"], pages), pages).where("target is not null")
        edges = links.where(F.col("kind").isin("wikilink", *graph.RELATIONS)).select("src", F.col("target").alias("dst"))
        adjacent = cut(graph.neighbours(edges))
        seeds = lexical.top(scored, max(k, 10), [F.coalesce("evidence", F.lit(0.0)).desc(), F.col("score").desc(), F.col("path")], rank="seed").select("query_id", "path", "score")
        reached = cut(graph.two_hops(seeds, adjacent, pages.where(where).select("path")))
        sources = pages.select("path", F.explode("sources").alias("source"))
        weighed = graph.evidence(reached.select("seed", "target"), adjacent, graph.typed_edges(links), sources, pages.select("path", "page_type"))
        gained = graph.expand(seeds, reached, weighed, scored.select("query_id", "path", "score"))
        return graph.merge_scores(scored, gained, self.tables["passages"].withColumnRenamed("page_path", "path"))

    def packed(self, results: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
        """Context of each question from its results, within its intent's budget."""
        passages = self.tables["passages"].withColumnRenamed("page_path", "path")
        filled = context.fill_pages(results.select("query_id", "path", "rank"), passages, results.select("query_id", "path", "passage_id", "score"))
        return context.pack(filled, questions.select("query_id", context.budget(T.intent("question"), k).alias("budget")))

    def answer(self, questions: DataFrame, scope: str = "auto", filter_map: Mapping | None = None, k: int = 10) -> DataFrame:
        """The envelope of each question: results, context, counters, warnings."""
        results, about = self.ask(questions, scope, filter_map, k)
        results = cut(results)
        return context.envelope(questions, results, k, cut(self.packed(results, questions, k)), about)

    def gated(self, results: DataFrame, thresholds: DataFrame, scope: str = "knowledge") -> DataFrame:
        texts = self.tables["passages"].select("passage_id", "text")
        titles = self.tables["pages"].select("path", "title")
        rows = quality.features(results.join(texts, "passage_id").join(titles, "path")).withColumns({"scope": F.lit(scope), "mode": F.lit("lexical")})
        return quality.gate(quality.decide(quality.resolve(rows, thresholds)), self.gate_mode)

    def status(self) -> DataFrame:
        return source_pages.status(self.tables)

    def list(self, filter_map: Mapping | None = None, size: int = 50, cursor: str | None = None) -> tuple[list[dict], str | None]:
        return catalog.list_items(self.tables["pages"], filters.normalise_filters(filter_map), min(size, 100), cursor, self.snapshot)

    def get(self, ref: str, most: int = 16 * 1024, cursor: str | None = None) -> dict:
        return catalog.get_item(self.tables["pages"], ref, min(most, 256 * 1024), cursor)

    def write_notes(self, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """outcomes and hints of notes (operation_id, path, title, aliases, questions, body, expected_hash).

        A note with errors is refused; others are committed if the page is still what the writer saw. Hints: names that other pages
        have already, and mentions in the body that could be links.
        """
        checked = state.notes(notes.withColumn("new_hash", F.sha2("body", 256)))
        have = self.tables["pages"].select("path", F.col("redacted_hash").alias("content_hash"))
        done = state.commit(checked.where(F.size("errors") == 0).select("operation_id", "path", "expected_hash", "new_hash"), have)
        refused = checked.where(F.size("errors") > 0).select("operation_id", "path", "expected_hash", "new_hash", F.array_join("errors", ",").alias("outcome"))
        others = self.tables["pages"]
        twice = catalog.duplicate_titles(checked.select(F.col("path").alias("page_path"), "title", "aliases"), others).select("page_path", F.lit("duplicate").alias("hint"), F.col("path").alias("target"), "reason")
        links = catalog.link_suggestions(checked.select("path", "body"), others).select("page_path", F.lit("mention").alias("hint"), "target", F.col("mention").alias("reason"))
        return done.unionByName(refused), twice.unionByName(links)

    def evaluate(self, cases: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
        results, _ = self.ask(cases.select(F.col("id").alias("query_id"), F.col("query").alias("question")), k=k)
        return evaluation.metrics_by_k(results.select("query_id", "path", "rank"), gold, cases.select(F.col("id").alias("query_id")), k)

    @staticmethod
    def resume(token: str, question: str, scope: str) -> int:
        return read_batch_token(token, question, scope)
