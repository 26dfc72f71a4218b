"""The operators with production parameters over whole tables, and SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, lines, mixing, ngram, probminhash, repetition, secrets, shards, tiling, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its near-duplicates and copies) of every document."""
    return probminhash.duplicates(_table(spark, sf_dir, "documents"))


def op2_ngram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document, by a model of all n-grams."""
    return ngram.score_documents(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, item_words, covered_words, coverage, n_tiles, longest_tile of each leak of a benchmark item."""
    found = tiling.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "covered_words", "coverage", F.size("tiles").cast("long").alias("n_tiles"), "longest_tile")


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slot, sequence, shard, byte_offset, n_tokens, doc_ids, sha256 of each sequence written."""
    return shards.materialise(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, n_lines, n_removed of every document."""
    return lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP5_SQL = r"""
WITH cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
win AS (
  SELECT doc_id, i - 1 AS line, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS w
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM cut WHERE len(l) >= 3)),
ranked AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY w ORDER BY doc_id, line) AS k
  FROM win WHERE regexp_matches(w, '[^\x20\x09-\x0D]')),
gone AS (SELECT DISTINCT doc_id, line + unnest([0, 1, 2]) AS line FROM ranked WHERE k > 1),
each_line AS (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS line FROM cut),
kept AS (
  SELECT e.doc_id, string_agg(s, chr(10) ORDER BY e.line) FILTER (WHERE g.line IS NULL) AS kept, count(*) AS n_lines, count(g.line) AS n_removed
  FROM each_line e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.line = g.line GROUP BY e.doc_id)
SELECT c.doc_id, CASE WHEN c.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS text,
  coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM cut c LEFT JOIN kept k USING (doc_id)
"""


def op6_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns, covered_words, longest_repeat and kept of every document."""
    return repetition.judge(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from the archives."""
    rows = warc.captures(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.when(F.col("type") == "revisit", F.col("refers_to_page")).alias("refers_to"))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes < 100 OR page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes < 100 OR page_id = first_page THEN NULL ELSE first_page END AS refers_to
FROM f
"""


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    weights = mixing.quality(_table(spark, sf_dir, "labels"))
    return mixing.mix(_table(spark, sf_dir, "documents"), weights).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, text FROM documents),
label AS (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
keyed AS (
  SELECT s.doc_id, s.source, s.size, s.text,
    -ln((('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '') || ':' || coalesce(md5(s.text), '')), 1, 13))::BIGINT::DOUBLE + 1.0) / 4503599627370496.0)
      / CASE WHEN q >= 1 THEN 2.0::DOUBLE WHEN q IS NOT NULL THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM sized s LEFT JOIN label USING (doc_id)),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE * 2.0 AS most,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS share
  FROM keyed GROUP BY source),
fill AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5
      - coalesce(sum(most) OVER (ORDER BY most / share, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(share) OVER (ORDER BY most / share, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per),
goal AS (
  SELECT source, source_size, least(most, (max(level) FILTER (WHERE level * share <= most) OVER ()) * share) AS target FROM fill),
run AS (
  SELECT k.doc_id, k.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS whole,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM keyed k JOIN goal g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN target - whole * source_size > 0 AND upto - size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    return secrets.report(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    return langid.identify(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_ngram_score": op2_ngram_score,
    "op3_decontamination": op3_decontamination,
    "op4_token_shards": op4_token_shards,
    "op7_warc": op7_warc,
    "op6_repetition": op6_repetition,
    "op5_line_dedup": op5_line_dedup,
    "op8_mix": op8_mix,
    "op9_secret_scan": op9_secret_scan,
    "op10_language_id": op10_language_id,
}
ORACLE_SQL: dict[str, str] = {"op5_line_dedup": OP5_SQL, "op7_warc": OP7_SQL, "op8_mix": OP8_SQL}
