"""From documents to training shards in five stages.

STAGES are (name, function of (spark, docs, sf_dir) -> DataFrame). Each works on all its predecessor kept; all but the last
return the columns that docs has, whatever others it has beside those of documents, and whatever their names.

Defined results of every stage: an empty table passes through as an empty table. Rows are kept or dropped one by one: a null or
repeated doc_id is no reason for either. Texts are taken whole, whatever their length; memory grows with the longest one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import langid, mixing, probminhash, shards, tiling
from quarryline.llm.shared import Workspace, drop_rows, free_name, row_key, small


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, empty, no letters), or so far from every profile that hardly an n-gram is known, go.

    Where no row has a language to learn from, all go. Equal rows have equal results; ties go to the language with the smaller name.
    """
    profiles = langid.learn(docs.where(langid.fold() != 0))
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = langid.predict(docs, profiles, keep_text=True, result=(lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) >= langid.MIN_SCORE)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the smallest doc_id, null last (ties: the smallest hash of id and text).

    Of rows with equal id and text one stays. A null text, or one without a word, is a class of its own, so it stays.
    """
    work = Workspace(spark, "pipeline-dedup")
    named = probminhash.NearDuplicates(docs, work).classes()
    # a class of one row is left alone; of the others one row stays
    gone = work.table(named.where(~F.col("first")).select("doc_id", "row").distinct(), "gone")
    work.keep("gone")
    kept = drop_rows(docs, gone, gone.count())
    # equal rows: one of them stays
    twice = work.table(docs.groupBy("doc_id", row_key().alias("row")).agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "row"), "twice")
    n = twice.count()
    if not n:
        return kept
    again = kept.join(small(twice, n), kept["doc_id"].eqNullSafe(twice["doc_id"]) & (row_key(kept) == twice["row"]), "left_semi").dropDuplicates(["doc_id", "text"])
    return drop_rows(kept, twice, n).unionByName(again)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark item leaks into go. A null or empty text stays; so do all if the benchmark is empty."""
    work = Workspace(spark, "pipeline-leaks")
    leaks = tiling.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_row=True, work=work)
    gone = work.table(leaks.select("doc_id", "row").distinct(), "gone")
    return drop_rows(docs, gone, gone.count())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Equal rows are taken as often as they are together.

    A null source is a source. A document without words has no size: it comes in whole epochs, and once more if its key falls
    within the rest.
    """
    work = Workspace(spark, "pipeline-mix")
    mixed = mixing.mix(docs, mixing.quality(spark.read.parquet(f"{sf_dir}/labels.parquet")), work=work)
    out = mixing.repeated(docs, mixed, work)
    work.keep("epochs")
    return out


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the shards: slot, sequence, shard, byte_offset, n_tokens, doc_ids, sha256.

    A null or empty text is one end token; repeated rows are repeated documents.
    """
    return shards.materialise(docs)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("source_mix", mix_sources),
    ("token_shards", token_shards),
]

#: The stages of profiles, sketches and tokens cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; each result is written and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.table(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            work.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
