"""Structured Streaming jobs, and their batch forms over whole tables."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T

ENTRIES_MOST, ENTRIES_KEPT, LOG_BYTES = 200, 100, 180_000


def stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_now(df: DataFrame, checkpoint: str, sink: str, mode: str = "append") -> StreamingQuery:
    """Everything there is, then stop. sink is a folder of Parquet files."""
    return df.writeStream.trigger(availableNow=True).outputMode(mode).option("checkpointLocation", checkpoint).format("parquet").start(sink)


def once_per_request(events: DataFrame, key: str = "request_id", at: str = "at", delay: str = "1 hour") -> DataFrame:
    """The first terminal event of each request; state is dropped once the watermark has passed."""
    if events.isStreaming:
        return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def telemetry(questions: DataFrame, days: int, at: str = "at") -> DataFrame:
    """Rows to record: the question's hash and redacted text, and when it expires."""
    asked = F.col("question")
    return questions.withColumn("query_hash", F.sha2(T.casefold(asked), 256)).withColumn("query_redacted", T.redact(asked)).withColumn("expires_at", F.timestamp_add("DAY", F.lit(days), F.col(at))).drop("question")


def unexpired(rows: DataFrame, now: Column, at: str = "expires_at") -> DataFrame:
    return rows.where(F.col(at) > now)


def windowed(events: DataFrame, size: str, slide: str | None = None, at: str = "ts", delay: str = "10 minutes", by: list[str] = ()) -> DataFrame:
    """Counts and sums in tumbling or sliding windows."""
    rows = events.withWatermark(at, delay) if events.isStreaming else events
    return rows.groupBy(F.window(at, size, slide) if slide else F.window(at, size), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", at: str = "ts", delay: str = "10 minutes", by: str = "user_id") -> DataFrame:
    rows = events.withWatermark(at, delay) if events.isStreaming else events
    return rows.groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n"))


def appender(path: str, key: str = "operation_id") -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that adds each key once, also when a batch is repeated."""
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
        new.write.mode("append").parquet(path)
    return write


def upsert(path: str, key: str, version: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer of a change feed: each epoch has a folder, read_latest() takes the newest row of a key."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), version).alias("r")).select("r.*").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return write


def read_latest(spark: SparkSession, path: str, key: str, version: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != "epoch"]), F.struct(version, "epoch")).alias("r")).select("r.*")


def rotate(entries: DataFrame, most: int = ENTRIES_MOST, kept: int = ENTRIES_KEPT, budget: int = LOG_BYTES, log: str = "log", at: str = "at", key: str = "entry_id") -> DataFrame:
    """entries with volume: null for those that stay in the log, else year-month of the volume they go to.

    A log of over most entries keeps the newest kept; of these, only as many of the newest as fit the budget of bytes stay.
    """
    newest = Window.partitionBy(log).orderBy(F.col(at).desc(), F.col(key).desc())
    rows = entries.withColumn("__k", F.row_number().over(newest)).withColumn("__n", F.count("*").over(Window.partitionBy(log)))
    bytes_ = F.sum(F.octet_length("text")).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    stays = ((F.col("__n") <= most) | (F.col("__k") <= kept)) & (bytes_ <= budget)
    return rows.withColumn("volume", F.when(stays, None).otherwise(F.date_format(at, "yyyy-MM"))).drop("__k", "__n")


def revisions(saves: DataFrame) -> DataFrame:
    """session_id, revision, parent, append_only, delta_line of saved bodies (session_id, saved_at, body); a save of the same body makes none."""
    w = Window.partitionBy("session_id").orderBy("saved_at")
    changed = saves.withColumn("__before", F.lag("body").over(w)).where(F.col("__before").isNull() | (F.col("__before") != F.col("body")))
    rows = changed.withColumn("__n", F.row_number().over(w)).withColumn("append_only", F.when(F.col("__before").isNull(), False).otherwise(F.startswith("body", "__before")))
    name = lambda n: F.format_string("revision-%06d", n)
    delta = F.when(F.col("append_only"), F.regexp_count("__before", F.lit("\n")) + 1)
    return rows.select("session_id", name(F.col("__n")).alias("revision"), F.when(F.col("__n") > 1, name(F.col("__n") - 1)).alias("parent"), "append_only", delta.alias("delta_line"), "saved_at")


# Headings of roles, and any heading on a line of its own.
ROLE = r"(?im)^#{1,6}[ \t]*(?:user|assistant)[ \t]*:?[ \t]*$"
HEADING = r"(?m)^#{1,6}[ \t]*([^\n:]+)[ \t]*:?[ \t]*$"


def valid_chat(content: Column | str) -> Column:
    """Whether a transcript begins with a role and has no other headings than user and assistant."""
    text = F.trim(F.regexp_replace(T.text_of(content), r"^\s+|\s+$", ""))
    names = F.transform(F.regexp_extract_all(text, F.lit(HEADING), F.lit(1)), lambda r: F.lower(F.trim(F.regexp_replace(r, r"^\s+|\s+$", ""))))
    first = text.rlike(r"^(?i)#{1,6}[ \t]*(?:user|assistant)[ \t]*:?[ \t]*(?:\n|$)")
    return first & F.forall(names, lambda r: r.isin("user", "assistant"))


def message_count(content: Column | str) -> Column:
    return F.regexp_count(T.text_of(content), F.lit(ROLE))


class Runner:
    """Runs actions with a deadline and a bound on how many run at once; late ones are interrupted by their tag."""

    def __init__(self, spark: SparkSession, most: int = 4, grace: float = 0.25):
        self.spark, self.grace, self.slots = spark, grace, threading.BoundedSemaphore(most)

    def run(self, action: Callable[[], object], tag: str, seconds: float):
        if not self.slots.acquire(timeout=self.grace):
            raise RuntimeError("capacity")
        late = threading.Event()

        def stop() -> None:
            late.set()
            self.spark.sparkContext.cancelJobsWithTag(tag)

        timer = threading.Timer(seconds, stop)
        self.spark.sparkContext.addJobTag(tag)
        timer.start()
        try:
            return action()
        except Exception as e:
            if late.is_set():
                raise TimeoutError(tag) from e
            raise
        finally:
            timer.cancel()
            self.spark.sparkContext.removeJobTag(tag)
            self.slots.release()
