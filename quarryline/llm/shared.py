"""Folders that every machine sees, and the cuts of lineage that are kept there."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of a join up to this many rows (a few longs each, so under 32 MB) are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set, a temporary one in local mode and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarryline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Rows and bytes of a batch handed to Python. Whole texts and groups of texts are long, so batches are short; a row longer
#: than BATCH_BYTES is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def short_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches for operators over whole texts."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if not 0 < int(spark.conf.get(size).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(size, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Freed memory of a Python worker goes back to the system: a worker that waits for its next task should hold little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over Arrow batches that gives its memory back when it ends."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


class Workspace:
    """Tables of one run of an operator, as Parquet in the shared folder. A lost executor costs a reread, not a recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        short_batches(spark)
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *names: str) -> None:
        """Deletes all tables but those named."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for entry in fs.listStatus(root) if fs.exists(root) else ():
            if entry.getPath().getName() not in names:
                fs.delete(entry.getPath(), True)

    def mkdirs(self, name: str) -> str:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)
        return self.path(name)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def row_key(docs: DataFrame | None = None) -> Column:
    """Equal for rows with the same doc_id and text."""
    return F.xxhash64(*("doc_id", "text") if docs is None else (docs["doc_id"], docs["text"]))


def drop_rows(docs: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """docs without the n rows (doc_id, row: their row_key); a null doc_id is a value like others."""
    gone = small(rows.select(F.col("doc_id").alias("__gone"), F.col("row").alias("__row")), n)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]) & (row_key(docs) == gone["__row"]), "left_anti")
