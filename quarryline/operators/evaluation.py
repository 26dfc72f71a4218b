"""Ranking metrics, slices, gates and samples for evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AT = (1, 3, 5, 10)


def ranking_metrics(ranked: DataFrame, gold: DataFrame, cases: DataFrame, k: int = 10) -> DataFrame:
    """query_id, recall, precision, mrr, ndcg, hits, relevant_total of every case; null where it has no gold.

    ranked: query_id, path, rank (a path counts at its first rank); gold: query_id, path, grade.
    """
    first = ranked.groupBy("query_id", "path").agg(F.min("rank").alias("rank"))
    first = first.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("at") <= k)
    gold = gold.groupBy("query_id", "path").agg(F.max("grade").alias("grade"))
    found = first.join(gold, ["query_id", "path"]).groupBy("query_id").agg(F.count("*").alias("hits"), F.min("at").alias("first"), F.sum((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("at") + 1.0)).alias("dcg"))
    best = gold.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "path")))
    ideal = best.groupBy("query_id").agg(F.count("*").alias("relevant_total"), F.sum(F.when(F.col("at") <= k, (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("at") + 1.0))).alias("ideal"))
    both = cases.select("query_id").join(ideal, "query_id", "left").join(found, "query_id", "left")
    hits, some = F.coalesce("hits", F.lit(0)), F.col("relevant_total") > 0
    return both.select(
        "query_id",
        F.when(some, hits / F.col("relevant_total")).alias("recall"),
        F.when(some, hits / F.lit(k)).alias("precision"),
        F.when(some, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.when(some, F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0))).alias("ndcg"),
        F.when(some, hits).otherwise(0).alias("hits"),
        F.coalesce("relevant_total", F.lit(0)).alias("relevant_total"),
    )


def metrics_by_k(ranked: DataFrame, gold: DataFrame, cases: DataFrame, k: int = 10) -> DataFrame:
    """ranking_metrics at 1, 3, 5, 10 and k."""
    out = None
    for n in sorted({*AT, k}):
        one = ranking_metrics(ranked, gold, cases, n).withColumn("k", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


def slices(cases: DataFrame, values: list[str]) -> DataFrame:
    """slice, n, mean of each value over overlapping groups: all, language, tag, scope, fallback. Nulls don't count."""
    def keys(name: str, c: Column) -> Column:
        return F.when(c.isNotNull() & (c != ""), F.array(F.concat(F.lit(f"{name}:"), c))).otherwise(F.array().cast("array<string>"))
    have = set(cases.columns)
    parts = [F.array(F.lit("all"))] + [keys(n, F.col(n)) for n in ("language", "scope", "fallback") if n in have]
    if "tags" in have:
        parts.append(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("tag:"), t)))
    each = cases.withColumn("slice", F.explode(F.array_distinct(F.concat(*parts))))
    return each.groupBy("slice").agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values])


def p95(value: Column | str) -> Column:
    """Nearest rank."""
    return F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})")


def macro_micro(cases: DataFrame) -> DataFrame:
    """Mean of recalls and recall of sums."""
    return cases.agg(F.avg("recall").alias("macro_recall"), (F.sum("hits") / F.nullif(F.sum("relevant_total"), F.lit(0))).alias("micro_recall"))


def no_answer_rate(cases: DataFrame, threshold: float) -> DataFrame:
    """Share of unanswerable cases with a top score at the threshold or above."""
    return cases.where("not answerable").agg(F.count("*").alias("n"), F.avg((F.coalesce("top_score", F.lit(0.0)) >= threshold).cast("double")).alias("false_positive_rate"))


def gate(candidate: DataFrame, baseline: DataFrame, regression: float = 0.02, growth: float = 0.10, false_positive: float = 0.05) -> DataFrame:
    """One row of verdicts from two one-row frames with dataset_id, recall, ndcg, p95, false_positive_rate."""
    c, b = (x.select(F.struct("*").alias(n)) for x, n in ((candidate, "c"), (baseline, "b")))
    both = c.join(b, F.lit(True))
    checks = {
        "identity": F.col("c.dataset_id").eqNullSafe(F.col("b.dataset_id")),
        "recall": F.col("c.recall") >= F.col("b.recall") - regression - 1e-12,
        "ndcg": F.col("c.ndcg") >= F.col("b.ndcg") - regression - 1e-12,
        "latency": F.col("c.p95") <= F.col("b.p95") * (1 + growth),
        "no_answer": F.coalesce(F.col("c.false_positive_rate"), F.lit(0.0)) <= false_positive,
    }
    rows = both.select(*[F.coalesce(x, F.lit(False)).alias(n) for n, x in checks.items()])
    return rows.withColumn("passed", F.forall(F.array(*checks), lambda x: x))


def diagnose(cases: DataFrame, ranked: DataFrame, gold: DataFrame, pages: DataFrame, k: int = 10) -> DataFrame:
    """query_id, diagnosis of cases without a hit in the first k: not_indexed, ranked_low or not_retrieved. ranked goes to 40."""
    hit = ranked.join(gold, ["query_id", "path"]).groupBy("query_id").agg(F.min("rank").alias("best"))
    held = gold.join(pages.select("path"), "path", "left_semi").select("query_id").distinct().withColumn("held", F.lit(True))
    have = gold.select("query_id").distinct()
    both = cases.select("query_id").join(have, "query_id", "left_semi").join(hit, "query_id", "left").join(held, "query_id", "left")
    return both.where((F.col("best") > k) | F.col("best").isNull()).select("query_id", F.when(F.col("held").isNull(), "not_indexed").when(F.col("best").isNotNull(), "ranked_low").otherwise("not_retrieved").alias("diagnosis"))


def repeatable(runs: DataFrame) -> DataFrame:
    """query_id, same: whether every run (run, query_id, path, rank) ranked the same paths."""
    lists = runs.groupBy("query_id", "run").agg(F.sort_array(F.collect_list(F.struct("rank", "path"))).alias("ranking"))
    return lists.groupBy("query_id").agg((F.countDistinct("ranking") == 1).alias("same"))


def filters_hold(results: DataFrame, condition: Column) -> DataFrame:
    return results.groupBy("query_id").agg(F.min(F.coalesce(condition, F.lit(False)).cast("int")).cast("boolean").alias("filters_hold"))


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One SHA-256 over rows in the order of their own hashes; the hashes are combined bin by bin, so no task sees all."""
    each = rows.select(F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in columns]), 256).alias("h"))
    bins = each.groupBy(F.substring("h", 1, 3).alias("bin")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return bins.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bin", "h"))), lambda x: x["h"]), ""), 256).alias("fingerprint"))


def stratified_sample(rows: DataFrame, key: str, stratum: str, quota: int, count: int, seed: str = "0") -> DataFrame:
    """quota rows of each stratum, then others, in the order of SHA-256 of seed and key, count in all."""
    order = F.sha2(F.concat(F.lit(seed), F.lit("\0"), F.col(key).cast("string")), 256)
    ranked = rows.withColumn("__h", order).withColumn("__k", F.row_number().over(Window.partitionBy(stratum).orderBy("__h", key))).where(F.col("__k") <= count)
    return ranked.orderBy((F.col("__k") > quota).cast("int"), "__h", key).limit(count).drop("__h", "__k")


def latest(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """The latest row of each key; of equal times, the largest row."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max(F.struct(at, *[c for c in rest if c != at])).alias("row")).select(*by, *[F.col(f"row.{c}").alias(c) for c in rest])


def calibration_buckets(observations: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """Thresholds of each bucket from accepted observations: least ratio to the query's peak, least margin, least coverage; open if there are few."""
    peak = F.max("score").over(Window.partitionBy("query_id"))
    each = observations.withColumn("ratio", F.when(peak > 0, F.col("score") / peak).otherwise(0.0))
    ok = F.col("accepted")
    out = each.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.count_if(ok).alias("accepted_samples"), F.min(F.when(ok, F.col("ratio"))).alias("min_ratio"),
        F.min(F.when(ok, F.col("margin"))).alias("min_margin"), F.min(F.when(ok, F.col("coverage"))).alias("min_coverage"),
        F.expr("percentile(ratio, 0.5)").alias("ratio_median"),
    )
    return out.withColumn("status", F.when(F.col("samples") >= least, "calibrated").otherwise("insufficient"))


def gate_metrics(cases: DataFrame) -> DataFrame:
    """Rates of the quality gate. cases: before, after (arrays of paths), relevant (array), answerable."""
    lost = F.size(F.array_intersect(F.array_except("before", "after"), "relevant"))
    union = F.size(F.array_union("before", "after"))
    return cases.agg(
        F.avg(F.when(F.col("answerable"), (lost > 0).cast("double"))).alias("false_suppression_rate"),
        F.avg(F.when(~F.col("answerable"), (F.size("after") > 0).cast("double"))).alias("would_accept_rate"),
        F.avg((~F.get("before", F.lit(0)).eqNullSafe(F.get("after", F.lit(0)))).cast("double")).alias("top1_flip_rate"),
        F.avg(F.when(union > 0, F.size(F.array_intersect("before", "after")) / union).otherwise(1.0)).alias("mean_jaccard"),
    )


def side_effects(before: dict[str, str], after: dict[str, str]) -> list[str]:
    """Names of tables whose fingerprint an evaluation changed, or that came or went; none if it left all as it was."""
    return sorted(name for name in before.keys() | after.keys() if before.get(name) != after.get(name))
