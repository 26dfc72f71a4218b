"""Connected components of links, by alternating large and small stars. No link leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace


def components(links: DataFrame, work: Workspace, name: str = "stars") -> DataFrame:
    """node, root of every node in links (long columns a, b); root is the smallest node of its component.

    Each round joins links with the least neighbour of each node; its result is a table in the shared folder, so a lost
    executor costs one round. Self-links and repeated links do no harm.
    """
    now = work.table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    seen, step = None, 0
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen, step = state, step + 1
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-{step}-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = work.table(large, f"{name}-{step}-large")
        least = work.table(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{step}-small")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        joined = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        before = step - 1
        now = work.table(joined, f"{name}-{step}")
        work.drop(f"{name}-{before}", f"{name}-{step}-large", f"{name}-{step}-small", f"{name}-{step}-least")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
