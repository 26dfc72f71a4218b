"""Line deduplication by overlapping windows of three lines. DataFrame functions only.

Texts are cut at ``\\n``. A window is three consecutive lines, not all without a word, known by two 64-bit hashes. The
occurrence with the smallest (doc_id, line, hash of the text) is kept; the lines that any later occurrence covers are
removed, overlapping occurrences merged.

Defined results: null text stays null and has no lines; a text of one or two lines has no window and stays as it is; an
empty table gives an empty table; null ids sort first; rows with the same id are told apart by the hash of the text, and
equal rows with equal ids are one document, so both lose or keep the same lines. Ties cannot occur between different
occurrences. Texts are cut whole: work and memory grow in proportion to the longest one. Other columns pass through; columns
named like a result column (text, n_lines, n_removed) or covered are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, small

WINDOW = 3


def _lines() -> Column:
    return F.split("text", "\n")


def _windows(docs: DataFrame, columns: list[str]) -> DataFrame:
    """columns, line: number of the window's first line, h1, h2, of each window."""
    parts = docs.where(F.instr("text", "\n") > 0).select(*columns, _lines().alias("lines")).where(F.size("lines") >= WINDOW)
    each = parts.select(*columns, "lines", F.explode(F.sequence(F.lit(1), F.size("lines") - (WINDOW - 1))).alias("at"))
    window = [F.element_at("lines", F.col("at") + k) for k in range(WINDOW)]
    worded = F.rlike(F.concat(*window), F.lit(r"[^\x20\x09-\x0D]"))
    return each.where(worded).select(*columns, (F.col("at") - 1).alias("line"), F.xxhash64(*window).alias("h1"), F.xxhash64(F.lit("second"), *reversed(window)).alias("h2"))


def repeated_lines(docs: DataFrame, work: Workspace) -> DataFrame:
    """doc_id, text_hash, covered: the starts of windows that occurred before, in documents that have such."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    windows = work.table(_windows(keyed, ["doc_id", "text_hash"]), "windows")
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line", "text_hash")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    first = work.table(first, "first")
    later = windows.join(small(first, first.count()), ["h1", "h2"]).where(~F.struct("doc_id", "line", "text_hash").eqNullSafe(F.col("first")))
    return work.table(later.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("covered")), "covered")


def dedup_lines(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """docs with text after removal, n_lines and n_removed."""
    work = work or Workspace(docs.sparkSession, "lines")
    covered = repeated_lines(docs, work).withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed", "covered")]
    joined = docs.select(*rest, "text").join(covered.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left")
    gone = F.array_distinct(F.flatten(F.transform("covered", lambda w: F.sequence(w, w + (WINDOW - 1)))))

    def rest_of(lines: Column) -> Column:
        # array_except is a hash set's work, so long texts are not searched once a line
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(kept, lambda at: F.get(lines, at)), "\n")

    # in an array of one, so that the text is cut once
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.get(F.transform(F.array(_lines()), rest_of), F.lit(0)))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines())).cast("long")
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return joined.withColumn("gone", gone).select(*rest, text.alias("text"), n_lines.alias("n_lines"), n_removed.alias("n_removed"))
