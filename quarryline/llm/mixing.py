"""Mixing sources to target weights with Efraimidis-Spirakis sampling. DataFrame functions only.

Every source gets a word budget by water-filling. A budget of e whole epochs and a fraction takes each document e times,
and the fraction from the documents in the order of exponential keys -ln(u) / quality weight, smallest first, until their
prefix sum comes as near to it as it can. The order is never made in one task: keys are dealt to bins, bin sizes are
prefix-summed, and only the bin where the budget ends is looked into, by finer bins, REFINE times over; what is left then
is sorted.

Defined results: null or empty text has size 0 and takes 0; a null source is a source of its own, after all others; an
empty table gives an empty mix; ties in the key are broken by id, size and a hash of the text; equal rows (id and text)
are one entry: so many of them are taken as bring the sum nearest. A null, NaN or non-positive quality weight counts as 1. Texts are
read whole, to be counted. Only doc_id, source and text are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Workspace, free_name, small

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST_EPOCHS = 1.5, 2.0
BINS, REFINE = 1024, 2
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: str = "") -> Column:
    """In (0, 1], from the MD5 of the id and the text (52 bits), so that rows with a null or repeated id have keys of their own."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5("text"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1.0) / 4503599627370496.0


def quality(labels: DataFrame) -> DataFrame:
    """doc_id, weight: 2 for quality 1, 0.5 for quality 0, of the best label a document has."""
    best = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return best.select("doc_id", F.when(F.col("quality") >= 1, 2.0).otherwise(0.5).alias("weight"))


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target of each source. Its windows are over sources, not rows.

    With T to hand out, a source gets min(2 size, level x weight). In the order of 2 size / weight, those before the
    level are full, and the level is what the others share.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, WEIGHTS))
    per = per.withColumn("share", F.element_at(weights, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("share"), F.col("source").asc_nulls_last())
    per = per.withColumn("most", F.col("source_size") * MOST_EPOCHS).withColumn("total", F.sum("source_size").over(every) * SHARE)
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("share").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.col("total") - before) / rest)
    # the first in that order that the level doesn't fill; behind it levels only sink
    level = F.max(F.when(F.col("level") * F.col("share") <= F.col("most"), F.col("level"))).over(every)
    return per.withColumn("target", F.least(F.col("most"), F.coalesce(level, F.lit(float("inf"))) * F.col("share"))).select("source", "source_size", "target")


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: str = "", work: Workspace | None = None) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, epochs (times taken) and taken (words) of each row of docs."""
    spark: SparkSession = docs.sparkSession
    work = work or Workspace(spark, "mixing")
    sized = docs.select("doc_id", "source", size_of().alias("size"), F.xxhash64("text").alias("text_hash"), uniform(seed).alias("u"))
    if weights is not None:
        rows = weights.count()
        sized = sized.join(small(weights.select("doc_id", "weight"), rows), "doc_id", "left")
    else:
        sized = sized.withColumn("weight", F.lit(1.0))
    weight = F.when((F.col("weight") > 0) & ~F.isnan("weight"), F.col("weight")).otherwise(1.0)
    # 1 - exp(-key) keeps the order of the keys and is uniform at weight 1
    sized = sized.withColumn("key", -F.log("u") / weight).withColumn("place", 1 - F.exp(-F.col("key"))).drop("u", "weight")
    # tie: equal for equal rows; part: the task that wrote a row
    sized = sized.withColumn("tie", F.xxhash64("source", "doc_id", "text_hash")).withColumn("part", F.spark_partition_id())
    sized = work.table(sized, "sized")
    goal = targets(sized).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = work.table(goal.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("low", F.lit(0.0)).withColumn("width", F.lit(1.0)), "goal")
    n = goal.count()

    def of(rows: DataFrame, source: DataFrame) -> DataFrame:
        source = source.withColumnRenamed("source", "__source")
        return rows.join(small(source, n), rows["source"].eqNullSafe(source["__source"])).drop("__source")

    def bin_of(low: Column, width: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("place") - low) / width * BINS)))

    inside = (F.col("place") >= F.col("low")) & ((F.col("place") < F.col("low") + F.col("width")) | (F.col("low") + F.col("width") >= 1))
    for step in range(REFINE):
        # the first bin whose prefix sum reaches the need; the need shrinks by the bins before it
        bins = of(sized, goal).where(inside & (F.col("need") > 0)).groupBy("source", bin_of(F.col("low"), F.col("width")).alias("bin")).agg(F.sum("size").alias("bin_size"))
        sums = bins.withColumn("upto", F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin")))
        last = of(sums, goal.select("source", "need")).where(F.col("upto") >= F.col("need")).groupBy("source").agg(F.min(F.struct("bin", "upto", "bin_size")).alias("last"))
        last = last.withColumnRenamed("source", "__source")
        next_goal = goal.join(small(last, n), goal["source"].eqNullSafe(last["__source"]), "left").drop("__source")
        # none reached: all of the interval is needed, which leaves nothing above it
        goal = work.table(next_goal.select(
            "source", "source_size", "target", "whole",
            F.when(F.col("last").isNotNull(), F.col("need") - (F.col("last.upto") - F.col("last.bin_size"))).otherwise(F.col("need")).alias("need"),
            F.when(F.col("last").isNotNull(), F.col("low") + F.col("width") * F.col("last.bin") / BINS).otherwise(F.col("low")).alias("low"),
            F.when(F.col("last").isNotNull(), F.col("width") / BINS).otherwise(F.col("width")).alias("width"),
        ), f"goal-{step}")
    placed = of(sized, goal)
    edge = _edge(work.table(placed.where(inside & (F.col("need") > 0)), "edge"), work)
    rest = placed.where(~(inside & (F.col("need") > 0))).withColumn("extra", ((F.col("place") < F.col("low")) & (F.col("low") > 0)).cast("long"))
    done = edge.unionByName(rest, allowMissingColumns=True).withColumn("epochs", F.col("whole") + F.col("extra"))
    return done.select("doc_id", "text_hash", "source", "size", "source_size", "target", "epochs", (F.col("size") * F.col("epochs")).alias("taken"))


def _edge(rows: DataFrame, work: Workspace) -> DataFrame:
    """rows of the bins where budgets end, with extra: 1 if a row is taken once more.

    Equal rows are one entry with a number of copies in the running sum. Which copies are taken is settled by counts of each
    task's copies and numbers within a task, so that no group of copies is gathered.
    """
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    one = rows.groupBy("source", "key", "doc_id", "size", "text_hash", "tie").agg(F.count("*").alias("n"), F.first("need").alias("edge_need"))
    left = F.col("edge_need") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(order), F.lit(0))
    # a copy is taken if that brings the sum nearer to the need
    fit = F.when(F.col("size") > 0, F.floor(left / F.col("size") + 0.5)).when(left >= 0, F.col("n")).otherwise(0)
    copies = work.table(one.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("n"), fit))).select("tie", "n", "copies"), "copies")
    known = rows.join(small(copies, copies.count()), "tie")
    split = (F.col("copies") > 0) & (F.col("copies") < F.col("n"))
    parts = known.where(split).groupBy("tie", "part").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("tie").orderBy("part")) - F.col("m")
    number = F.row_number().over(Window.partitionBy("tie", "part").orderBy("size"))
    some = known.where(split).join(parts.withColumn("before", before), ["tie", "part"]).withColumn("extra", (F.col("before") + number <= F.col("copies")).cast("long"))
    return known.where(~split).withColumn("extra", (F.col("copies") > 0).cast("long")).unionByName(some.drop("m", "before"))


def repeated(docs: DataFrame, mixed: DataFrame, work: Workspace) -> DataFrame:
    """docs, each row as often as the mix takes it. mixed: mix(docs)."""
    each = mixed.groupBy("doc_id", "source", "text_hash").agg(F.sum("epochs").alias("sum"), F.count("*").alias("n"))
    epochs, more = F.floor(F.col("sum") / F.col("n")).cast("int"), (F.col("sum") % F.col("n")).cast("int")
    mark = free_name(docs, "mix")
    taken = work.table(each.select(F.struct("doc_id", "source", "text_hash", epochs.alias("epochs"), more.alias("more")).alias(mark)), "epochs")
    of = lambda name: F.col(f"{mark}.{name}")
    same = docs["doc_id"].eqNullSafe(of("doc_id")) & docs["source"].eqNullSafe(of("source")) & (F.xxhash64(docs["text"]) == of("text_hash"))

    def exploded(rows: DataFrame, numbers: Column) -> DataFrame:
        return rows.select(*docs.columns, F.explode(numbers).alias(mark)).select(docs.columns)

    out = exploded(docs.join(taken.where(of("epochs") > 0).hint("merge"), same), F.sequence(F.lit(1), of("epochs")))
    uneven = taken.where(of("more") > 0)
    if not (n := uneven.count()):
        return out
    # copies of equal rows that do not come out even: from one of the rows, in blocks
    start = free_name(docs, "mix_from")
    one = docs.join(small(uneven, n), same).dropDuplicates(["doc_id", "source", "text"])
    blocks = one.select("*", F.explode(F.sequence(F.lit(1), of("more"), F.lit(1000))).alias(start)).repartition(of("text_hash"), F.col(start))
    return out.unionByName(exploded(blocks, F.sequence(F.col(start), F.least(F.col(start) + 999, of("more")))))
