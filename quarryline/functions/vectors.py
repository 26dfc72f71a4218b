"""Vector providers: the protocol, and a deterministic one made of Columns."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T


class Provider(Protocol):
    def identity(self) -> str: ...

    def embed(self, rows: DataFrame, text: str) -> DataFrame:
        """rows with a column vector."""
        ...


class Hashing:
    """Hashed token counts of length 1: no model, the same on every machine."""

    def __init__(self, size: int = 64):
        self.size = size

    def identity(self) -> str:
        return f"hashing-{self.size}"

    def column(self, text: Column | str) -> Column:
        words = T.tokens(text)
        counts = F.transform(F.sequence(F.lit(0), F.lit(self.size - 1)), lambda i: F.size(F.filter(words, lambda w: F.pmod(F.xxhash64(w), F.lit(self.size)) == i)).cast("double"))
        return T.unit(counts)

    def embed(self, rows: DataFrame, text: str) -> DataFrame:
        return rows.withColumn("vector", self.column(text))
