"""Tables of a data folder in the engine's shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lexical import Corpus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages of one passage each."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("wiki/concepts/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select(
        F.col("doc_id").alias("passage_id"), path.alias("path"), F.lit(0).alias("ordinal"), F.split_part("text", F.lit("."), F.lit(1)).alias("title"), F.col("text").alias("body"), F.col("text"),
        F.col("lang").alias("page_type"), F.col("source").alias("project"), F.array("lang", "source").alias("tags"), F.lit("active").alias("store"), F.lit("knowledge").alias("corpus"),
        F.lit("wiki").alias("source_kind"), F.lit("active").alias("lifecycle_status"), F.lit("fresh").alias("freshness"), F.array().cast("array<string>").alias("aliases"), F.sha2("text", 256).alias("redacted_hash"),
    )


def document_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(document_pages(spark, sf_dir))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
