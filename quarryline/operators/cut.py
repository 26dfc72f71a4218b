"""Cuts of lineage between the steps of long plans, and parts that stay small however large the input is."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a part that is dealt out by key.
PART_ROWS = 250_000


def cut(df: DataFrame) -> DataFrame:
    """Written to the session's checkpoint folder where there is one, else kept in memory and on disk."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def parts_for(*tables: DataFrame) -> int:
    """So many parts that none has more than about PART_ROWS rows of the tables together."""
    return max(1, -(-sum(t.count() for t in tables) // PART_ROWS))


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """df by key in parts of a given number. Without a number small bytes are put together again, and a task sorts and counts as many rows as fit them."""
    return df.repartition(parts, *keys)
