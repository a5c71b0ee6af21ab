"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's size is its number of words. Sources, ordered by code point with null last, weigh 5, 2, 1, 5, ... and
share all words by weight; a target stops at CAP times its source's size, and what is over is shared again by weight
among the others (one water level, found from running sums over the sorted sources). A source's target is taken as
complete epochs of all its documents, then a fraction: documents get exponential keys -ln(u) / quality, u a hash of
the document and the seed, and the smallest keys are taken until their sizes reach what is left. Quality is the share
of characters that are no digits or symbols, squared, so clean texts come first more often.

Running sums need no source in one task: keys fall into bins by source, the bins' sums are cumulated, and only
the bin in which the rest runs out is cumulated document by document. Bins are OCTAVE steps of the key's binary
logarithm: keys of any quality spread over some octaves, so a bin holds about a thousandth of its source at most. The last document is taken if that
brings the sum nearer to the rest. The same input and seed give the same mix.

A null text has size 0 and is never taken. Repeated rows are documents of their own; of rows alike in doc_id and text
the fraction takes all or none that fit together, in any order. Empty tables give none. Only DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import stored

WEIGHTS, CAP, OCTAVE, SEED = (5, 2, 1), 3, 2048, "mix-1"
MADE = ("size", "source_size", "target", "taken")


def _sized(docs: DataFrame, seed: str, keep: bool = True) -> DataFrame:
    """doc_id, source, size and key of each row, its bin (in the order of keys), and its columns as `row`."""
    odd = "0123456789#*$%&|<>!=_{}[]^~@/+\\\\"
    share = f"length(translate(t, '{odd}', '')) / greatest(length(t), 1)"
    u = f"(cast(conv(substr(md5(concat('{seed}', ':', coalesce(cast(doc_id as string), ''), ':', md5(t))), 1, 12), 16, 10) as double) + 0.5D) / 281474976710656D"
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] * keep
    rows = docs.select(*row, F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("size", F.expr("cast(size(array_remove(split(t, '[\\\\x20\\\\x09-\\\\x0D]+'), '')) as long)"))
    rows = rows.withColumn("quality", F.expr(f"greatest(0.05D, {share} * {share})")).withColumn("key", F.expr(f"-ln({u}) / quality"))
    return rows.withColumn("bin", F.expr(f"cast(floor({OCTAVE} * log2(key)) as int)")).drop("t", "quality")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from one row a source (source, source_size)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1))
    # sources reach their cap in the order of size by weight; the level of the rest follows from those before
    by = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows, before = Window.partitionBy(), by.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("total", F.sum("source_size").over(all_rows)).withColumn("weights", F.sum("weight").over(all_rows))
    w = w.withColumn("level", F.expr("total") - CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    w = w.withColumn("level", F.col("level") / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    # the level rises while capped sources leave and falls afterwards: its largest fitting value is the one that holds
    w = w.withColumn("level", F.max(F.when(CAP * F.col("source_size") >= F.col("level") * F.col("weight"), F.col("level"))).over(all_rows))
    target = F.least(F.lit(float(CAP)) * F.col("source_size"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"))
    return w.select("source", "source_size", target.alias("target"))


def mixed(spark: SparkSession, docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target (both of the source) and taken (words, repeats counted).

    Sizes and keys are worked out once, into a table; columns of docs with the new names give way.
    """
    found = _allotted(stored(spark, _sized(docs, seed), "sized"))
    return found.select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in MADE), *MADE)


def shares(spark: SparkSession, docs: DataFrame, seed: str = SEED) -> DataFrame:
    """What mixed() gives, without the texts: (doc_id, source, size, source_size, target, taken)."""
    return _allotted(stored(spark, _sized(docs, seed, keep=False), "sized")).select("doc_id", "source", *MADE)


def _allotted(rows: DataFrame) -> DataFrame:
    """rows with source_size, target and taken."""
    light = rows.select("source", "size", "bin")
    bins = light.groupBy("source", "bin").agg(F.sum("size").alias("size"))
    goal = targets(bins.groupBy("source").agg(F.sum("size").alias("source_size")))
    goal = goal.withColumn("epochs", F.expr("CASE WHEN source_size > 0 THEN cast(floor(target / source_size + 1e-9) as long) ELSE 0L END"))
    goal = goal.withColumn("rest", F.expr("target - epochs * source_size"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("bin"))
    full = bins.withColumn("upto", upto).withColumnsRenamed({"source": "s", "bin": "b", "size": "bin_size"})
    at = full.join(goal, F.col("s").eqNullSafe(F.col("source"))).where("rest > 0.5 and upto >= rest")
    edge = at.groupBy("source").agg(F.min("b").alias("edge"), F.expr("min_by(upto - bin_size, b)").alias("below"))
    goal = goal.join(edge.withColumnRenamed("source", "e"), F.col("source").eqNullSafe(F.col("e")), "left").drop("e").withColumnRenamed("source", "s")
    goal = stored(rows.sparkSession, goal, "goals")  # a table, so that the join may split a hot source
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    # documents of the bin where the rest runs out, one after the other
    inner = rows.where("bin = edge")
    order = Window.partitionBy("source").orderBy("key", "doc_id")
    inner = inner.withColumn("before", F.col("below") + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = inner.withColumn("extra", F.expr("CASE WHEN before < rest AND 2 * (rest - before) >= size THEN 1 ELSE 0 END")).drop("before")
    outer = rows.where("edge is null or bin <> edge").withColumn("extra", F.expr("CASE WHEN bin < edge THEN 1 ELSE 0 END"))
    taken = F.expr("size * (epochs + extra)").cast("long")
    return inner.unionByName(outer).withColumn("taken", taken)


def drawn(spark: SparkSession, docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix as rows: each document of docs as often as it is taken, with its columns; those not taken go, and with them texts without words."""
    found = _allotted(stored(spark, _sized(docs, seed), "sized"))
    times = F.expr("cast(taken div size as int)")
    each = found.where("taken > 0").select("row", F.explode(F.array_repeat(F.lit(1), times)))
    return each.select(*(F.col(f"row.`{c}`") for c in docs.columns))
