"""Evaluation sets, observations, reports, traces and telemetry as sources and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = "schema_version int, id string, query string, scope string, relevant array<struct<path string, grade int>>, filters struct<project string, filter_type string, filter_tags array<string>, path_prefix string>, answerable boolean, language string, tags array<string>, notes string"
OBSERVATION = "query_id string, case_id string, id string, score double, margin double, coverage double, family string, scope string, language string, accepted boolean, relevant boolean, label boolean, answerable boolean"
SCOPES = ("auto", "knowledge", "history", "all", "archive", "raw")
BODY_KEYS = ("body", "text", "content", "passage_text", "markdown")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSONL file, valid or ValueError: ids unique, queries there, grades 1 to 3, gold exactly if answerable."""
    rows = spark.read.schema(CASE + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn("scope", F.coalesce("scope", F.lit("knowledge")))
    relevant = F.coalesce("relevant", F.array().cast("array<struct<path string, grade int>>"))
    bad = (
        F.col("_corrupt_record").isNotNull() | ~F.coalesce(F.col("schema_version").isin(1, 2), F.lit(False)) | (F.trim(F.coalesce("id", F.lit(""))) == "") | (F.trim(F.coalesce("query", F.lit(""))) == "")
        | ~F.col("scope").isin(*SCOPES) | F.col("answerable").isNull() | F.col("language").isNull()
        | F.exists(relevant, lambda r: ~F.coalesce(r["grade"].between(1, 3), F.lit(False)))
        | (F.size(F.array_distinct(F.transform(relevant, lambda r: r["path"]))) < F.size(relevant)) | ((F.size(relevant) == 0) == F.col("answerable"))
    )
    rows = rows.withColumn("relevant", relevant).withColumn("__bad", F.coalesce(bad, F.lit(True)))
    wrong = rows.where("__bad").count()
    twice = rows.groupBy("id").count().where("count > 1").limit(1).count()
    if wrong or twice:
        raise ValueError(f"{wrong} invalid cases, ids {'not ' if twice else ''}unique")
    return rows.drop("__bad", "_corrupt_record")


def manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of a set: dataset_id, revision, abstention_threshold, status, schema_version; ValueError if it is no valid one."""
    row = spark.read.option("multiLine", True).schema("schema_version int, dataset_id string, revision string, abstention_threshold double, status string").json(path).first()
    found = {"schema_version": 1, "status": "reviewed"} | {k: v for k, v in (row.asDict() if row else {}).items() if v is not None}
    names = [k for k in ("dataset_id", "revision", "status") if not str(found.get(k) or "").strip()]
    if names or found["schema_version"] not in (1, 2) or not found.get("abstention_threshold", -1) >= 0:
        raise ValueError(f"manifest_invalid: {names or found}")
    return found | {"status": found["status"].strip()}


def gold(case_rows: DataFrame) -> DataFrame:
    return case_rows.select(F.col("id").alias("query_id"), F.explode("relevant").alias("r")).select("query_id", "r.path", "r.grade")


def observations(spark: SparkSession, path: str) -> DataFrame:
    """Calibration observations; broken lines are left out, accepted and query_id may have any of their names."""
    rows = spark.read.schema(OBSERVATION + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    rows = rows.where("_corrupt_record is null")
    return rows.select(F.coalesce("query_id", "case_id", "id").alias("query_id"), F.coalesce("accepted", "relevant", "label", F.lit(False)).alias("accepted"), "score", "margin", "coverage", "family", "scope", "language", "answerable")


def report(metrics: DataFrame, slices: DataFrame) -> tuple[str, str]:
    """A report of a few rows as JSON and as a Markdown table."""
    one, many = metrics.first().asDict(), [r.asDict() for r in slices.orderBy("slice").collect()]
    body = json.dumps({"metrics": one, "slices": many}, sort_keys=True, default=str, indent=2)
    names = list(many[0]) if many else []
    lines = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)] + ["| " + " | ".join(str(r[n]) for n in names) + " |" for r in many]
    return body, "\n".join([f"- {k}: {v}" for k, v in one.items()] + [""] + (lines if names else [])) + "\n"


def write_trace(trace: DataFrame, path: str) -> None:
    """Citation traces as JSON lines; a column or field that could hold a body is refused."""
    found = [name for name in BODY_KEYS if f'"name":"{name}"' in trace.schema.json()]
    if found:
        raise ValueError(f"a trace must not hold {found}")
    trace.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def completed(telemetry: DataFrame) -> DataFrame:
    return telemetry.where("outcome = 'completed'")
