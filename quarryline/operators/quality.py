"""Quality gate: score families, candidate features, threshold decisions and their calibration."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Families of scores, the branches that name one, and the reasons of decisions.
FAMILIES = ("main_rrf", "wiki_relaxed", "raw_recovery", "coverage_fusion", "graph_extension")
BRANCHES = {
    "coverage": "coverage_fusion", "all_coverage": "coverage_fusion", "coverage_fusion": "coverage_fusion", "wiki_relaxed": "wiki_relaxed", "relaxed": "wiki_relaxed",
    "active_relaxed": "wiki_relaxed", "raw": "raw_recovery", "raw_zero": "raw_recovery", "raw_recovery": "raw_recovery", "raw_only": "raw_recovery",
}
KEEP = ("exact_identifier", "phrase", "term_coverage", "multi_signal", "raw_coverage", "graph_supported", "top1_rescue", "default")
REJECT = ("score_floor", "score_cliff", "no_independent_signal", "raw_no_coverage", "graph_only_weak", "low_confidence")
FAIL_OPEN = ("low_sample", "policy_missing", "error")
REASONS = (*(f"gate_keep_{x}" for x in KEEP), *(f"gate_reject_{x}" for x in REJECT), *(f"gate_fail_open_{x}" for x in FAIL_OPEN), "gate_would_suppress_all")
# The parts of a bucket's key, and of each structural backoff the parts that are kept, in order.
KEYS = ("family", "scope", "language", "mode", "source_kind")
BACKOFF = [
    ("family", "scope", "language", "mode", "source_kind"), ("family", "scope", "mode", "source_kind"), ("family", "scope", "language", "mode"), ("family", "scope", "mode"),
    ("family", "language", "mode", "source_kind"), ("family", "mode", "source_kind"), ("family", "language", "mode"), ("family", "mode"), ("family",),
]
GLOBAL = "global"
SAMPLES = 10
WIDE, LATIN = "[\\u3400-\\u9fff\\u3040-\\u30ff\\uff00-\\uffef]", "[A-Za-z]"


def _own(rows: DataFrame, name: str, kind: str) -> Column:
    """A column of rows, or null if they have none of that name."""
    return F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)


def _positive(c: Column) -> Column:
    return F.coalesce(c > 0, F.lit(False))


def score_family(rows: DataFrame) -> Column:
    """The family of a candidate's score: by its branch, else by its fusion, graph and source fields."""
    branch = F.lower(F.coalesce(_own(rows, "branch", "string"), F.lit("")))
    named = F.create_map(*[F.lit(x) for kv in BRANCHES.items() for x in kv])[branch]
    found = [_positive(_own(rows, c, "double")) for c in ("fts_rank", "title_rank", "vector_rank")]
    vector = found[2] | F.coalesce(_own(rows, "vector_score", "double") != 0, F.lit(False))
    raw = (F.lower(T.text_of(_own(rows, "source_kind", "string"))) == "raw") | (F.lower(T.text_of(_own(rows, "fallback_level", "string"))) == "raw")
    graph = _positive(_own(rows, "graph_score", "double")) & ~found[0] & ~vector & ~found[1]
    derived = F.when(_own(rows, "fusion_score", "double").isNotNull(), "coverage_fusion").when(graph, "graph_extension").when(raw, "raw_recovery").otherwise("main_rrf")
    return F.coalesce(_own(rows, "score_family", "string"), named, derived)


def features(candidates: DataFrame) -> DataFrame:
    """candidates with family, rank, margin, top1_rescue, coverage, signals and their number n_signals, language.

    Ranks and margins are those within a question's family, ties by path.
    """
    yes = lambda c: F.coalesce(_own(candidates, c, "boolean"), F.lit(False))
    rows = candidates.withColumn("family", score_family(candidates))
    w = Window.partitionBy("query_id", "family").orderBy(F.col("score").desc(), F.replace("path", F.lit("\\"), F.lit("/")), "passage_id")
    coverage = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(_own(candidates, "coverage_ratio", "double"), F.lit(0.0))))
    vector = _positive(_own(candidates, "vector_rank", "double")) | F.coalesce(_own(candidates, "vector_score", "double") != 0, F.lit(False))
    told = {
        "fts": _positive(_own(candidates, "fts_rank", "double")), "title": yes("title_signal") | _positive(_own(candidates, "title_rank", "double")), "vector": vector, "exact": yes("exact"),
        "identifier": yes("identifier_signal"), "phrase": yes("phrase_signal"), "coverage": coverage > 0, "graph": _positive(_own(candidates, "graph_score", "double")),
    }
    words = F.concat_ws(" ", _own(candidates, "title", "string"), _own(candidates, "text", "string"))
    language = F.when(words.rlike(WIDE) & words.rlike(LATIN), "mixed").when(words.rlike(WIDE), "cjk").when(words.rlike(LATIN), "latin").otherwise("unknown")
    kept = {c: yes(c) for c in ("exact", "identifier_signal", "phrase_signal")}
    out = rows.withColumns(kept | {"rank": F.row_number().over(w), "margin": F.col("score") - F.lead("score").over(w), "coverage": coverage})
    out = out.withColumn("signals", F.array_compact(F.array(*[F.when(c, name) for name, c in told.items()]))).withColumn("n_signals", F.size("signals"))
    return out.withColumn("top1_rescue", F.col("rank") == 1).withColumn("language", F.coalesce(_own(candidates, "language", "string"), language))


def keep_reason() -> Column:
    raw = (F.col("family") == "coverage_fusion") & (F.col("source_kind") == "raw")
    return (
        F.when(F.col("exact") | F.col("identifier_signal"), "gate_keep_exact_identifier").when(F.col("phrase_signal"), "gate_keep_phrase")
        .when(F.col("coverage") > 0, F.when(raw, "gate_keep_raw_coverage").otherwise("gate_keep_term_coverage")).when(F.col("family") == "graph_extension", "gate_keep_graph_supported")
        .when(F.col("n_signals") >= 2, "gate_keep_multi_signal").when(F.col("top1_rescue"), "gate_keep_top1_rescue").otherwise("gate_keep_default")
    )


def decide(rows: DataFrame) -> DataFrame:
    """rows (features, and of resolve: bucket, min_ratio, min_margin, min_coverage, fail_open) with accepted and reason.

    Exact hits, identifiers, phrases and each family's first are safe. Others fall under a ratio to the peak of their bucket, under
    a margin to the next, or under a coverage with less than two signals.
    """
    group = F.coalesce("bucket", F.concat_ws("|", *KEYS))
    peak = F.max("score").over(Window.partitionBy("query_id", group))
    safe = F.col("exact") | F.col("identifier_signal") | F.col("phrase_signal") | F.col("top1_rescue")
    floor = F.col("min_ratio").isNotNull() & (peak > 0) & (F.col("score") / peak < F.col("min_ratio"))
    cliff = F.col("min_margin").isNotNull() & F.col("margin").isNotNull() & (F.col("margin") < F.col("min_margin"))
    bare = F.col("min_coverage").isNotNull() & (F.col("coverage") < F.col("min_coverage")) & (F.col("n_signals") < 2)
    raw = F.col("min_coverage").isNotNull() & (F.col("family") == "raw_recovery") & (F.col("coverage") <= 0) & (F.col("n_signals") == 0)
    reason = (
        F.when(F.col("fail_open").isNotNull(), F.col("fail_open")).when(safe, keep_reason()).when(floor, "gate_reject_score_floor").when(cliff, "gate_reject_score_cliff")
        .when(bare, "gate_reject_low_confidence").when(raw, "gate_reject_raw_no_coverage").when((F.col("family") == "graph_extension") & (F.col("n_signals") == 0), "gate_keep_graph_supported").otherwise(keep_reason())
    )
    return rows.withColumn("reason", reason).withColumn("accepted", ~F.startswith("reason", F.lit("gate_reject_")))


def bucket_key(parts: tuple[str, ...]) -> Column:
    """A bucket's name from its kept parts; a star stands for any value."""
    return F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) if p in parts else F.lit("*") for p in KEYS])


def _levels() -> Column:
    every = [F.struct(F.lit(n).alias("level"), bucket_key(parts).alias("key")) for n, parts in enumerate(BACKOFF)]
    return F.array(*every, F.struct(F.lit(len(BACKOFF)).alias("level"), F.lit(GLOBAL).alias("key")))


def buckets(observations: DataFrame, least: int = SAMPLES) -> DataFrame:
    """Buckets of every backoff level: key, level, samples, min_ratio, min_margin, min_coverage, status."""
    peak = F.max("score").over(Window.partitionBy("query_id"))
    each = observations.withColumn("ratio", F.when(peak > 0, F.col("score") / peak).otherwise(0.0))
    out = each.withColumn("b", F.explode(_levels())).groupBy("b.key", "b.level").agg(
        F.count("*").alias("samples"), F.min(F.when(F.col("accepted"), F.col("ratio"))).alias("min_ratio"), F.min(F.when(F.col("accepted"), F.col("margin"))).alias("min_margin"), F.min(F.when(F.col("accepted"), F.col("coverage"))).alias("min_coverage")
    )
    return out.withColumn("status", F.when((F.col("samples") >= least) & F.col("min_ratio").isNotNull(), "calibrated").otherwise("insufficient"))


def chains(declared: Mapping[str, str | None]) -> list[tuple[str, int, str]]:
    """key, depth, backoff of all that a key leads to. ValueError for circles."""
    out = []
    for start in declared:
        seen, at = [start], declared[start]
        while at is not None:
            if at in seen:
                raise ValueError(f"backoffs form a circle at {at}")
            out.append((start, len(seen), at))
            seen.append(at)
            at = declared.get(at)
    return out


def resolve(rows: DataFrame, table: DataFrame, declared: Mapping[str, str | None] | None = None) -> DataFrame:
    """rows with bucket, its thresholds and selection (exact, backoff, fail_open), or fail_open: why there are none.

    The way goes from the exact key over its declared backoffs (key -> key, of the artifact) and the structural ones to global;
    the first calibrated bucket on it is taken. If buckets are there but of too few samples, that is the reason.
    """
    keyed = rows.withColumn("__row", F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in KEYS])), 256))
    ways = keyed.select("__row", *KEYS).dropDuplicates(["__row"]).select("__row", F.explode(_levels()).alias("t"))
    ways = ways.select("__row", F.when(F.col("t.level") == 0, 0).otherwise(F.col("t.level") + 1_000_000).alias("priority"), F.col("t.key").alias("key"))
    if declared and (steps := chains(declared)):
        known = rows.sparkSession.createDataFrame(steps, "key string, depth int, to string")
        ways = ways.unionByName(ways.where("priority = 0").join(known, "key").select("__row", F.col("depth").alias("priority"), F.col("to").alias("key")))
    met = ways.join(table.select("key", "min_ratio", "min_margin", "min_coverage", "status"), "key")
    good = F.min_by(F.struct("key", "min_ratio", "min_margin", "min_coverage", "priority"), F.when(F.col("status") == "calibrated", F.col("priority")))
    best = met.groupBy("__row").agg(good.alias("v"), F.max((F.col("status") == "calibrated").cast("int")).alias("some"))
    out = keyed.join(best, "__row", "left").withColumn("v", F.when(F.col("some") == 1, F.col("v")))
    why = F.when(F.col("v").isNotNull(), None).when(F.col("some").isNotNull(), "gate_fail_open_low_sample").otherwise("gate_fail_open_policy_missing")
    selection = F.when(F.col("v").isNull(), "fail_open").when(F.col("v.priority") == 0, "exact").otherwise("backoff")
    return out.select(*rows.columns, F.col("v.key").alias("bucket"), "v.min_ratio", "v.min_margin", "v.min_coverage", selection.alias("selection"), why.alias("fail_open"))


def gate(decided: DataFrame, mode: str = "off") -> DataFrame:
    """off and shadow keep all rows (shadow with the decisions); enforce drops rejected rows, but never the last of a question."""
    if mode == "off":
        return decided.drop("accepted", "reason")
    if mode == "shadow":
        return decided
    if mode != "enforce":
        raise ValueError(f"unknown gate mode: {mode}")
    some = F.max(F.col("accepted").cast("int")).over(Window.partitionBy("query_id")) == 1
    return decided.withColumn("__some", some).where(F.col("accepted") | ~F.col("__some")).drop("__some")


def reasons(decided: DataFrame) -> DataFrame:
    """family, reason, n; and gate_would_suppress_all for the questions of which nothing is accepted."""
    counts = decided.groupBy("family", "reason").agg(F.count("*").alias("n"))
    lost = decided.groupBy("query_id").agg(F.max(F.col("accepted").cast("int")).alias("some")).where("some = 0").agg(F.count("*").alias("n"))
    return counts.unionByName(lost.where("n > 0").select(F.lit("").alias("family"), F.lit("gate_would_suppress_all").alias("reason"), "n"))


def check_artifact(table: dict) -> None:
    """ValueError if a declared backoff is missing or leads back to itself. table: key -> {'backoff': key or None}."""
    declared = {key: bucket.get("backoff") for key, bucket in table.items()}
    if unknown := {x for x in declared.values() if x is not None} - set(table):
        raise ValueError(f"unknown bucket: {min(unknown)}")
    chains(declared)
