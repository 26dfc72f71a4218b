"""A store of vectors: Parquet beside the identity of the provider that made them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("passage_id", "page_path", "content_hash", "source_kind", "vector")


def save(vectors: DataFrame, root: str, identity: str, created_at: str) -> str:
    """Writes a version of the store and returns its name; load() takes the latest. A version is complete once its row is in the list."""
    version = uuid.uuid4().hex
    vectors.select(*COLUMNS).write.parquet(f"{root}/versions/{version}")
    size = F.max(F.size("vector"))
    about = vectors.agg(F.count("*").alias("n"), size.alias("dimension"), F.min(F.size("vector")).alias("least")).first()
    if about["n"] and about["dimension"] != about["least"]:
        raise ValueError("vectors of different sizes")
    row = [(version, identity, created_at, about["n"], about["dimension"])]
    vectors.sparkSession.createDataFrame(row, "version string, identity string, created_at string, n long, dimension int").coalesce(1).write.mode("append").parquet(f"{root}/list")
    return version


def load(spark: SparkSession, root: str, identity: str | None = None) -> DataFrame:
    """COLUMNS of the latest version; ValueError if another provider made it."""
    latest = spark.read.parquet(f"{root}/list").orderBy(F.col("created_at").desc(), F.col("version").desc()).first()
    if latest is None or identity is not None and latest["identity"] != identity:
        raise ValueError("no vectors of this provider")
    return spark.read.parquet(f"{root}/versions/{latest['version']}")


def prune(vectors: DataFrame, pages: DataFrame) -> DataFrame:
    """vectors without generated navigation pages, which are never answers. pages: path, generated, page_type."""
    away = pages.where(F.coalesce("generated", F.lit(False)) & (F.col("page_type") == "navigation")).select(F.col("path").alias("page_path"))
    return vectors.join(away, "page_path", "left_anti")
