"""Points in intervals and overlaps of intervals by dyadic time nodes: an interval is a few nodes however long it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import seconds

FAN, TOP = 4, 3  # a node holds FAN of the level below; levels are 0 to TOP


def time_nodes(start: Column, end: Column, unit_seconds: int) -> Column:
    """array<struct<level, node>>: the fewest nodes that cover the cells of [start, end], those of the top level side by side.

    Cells last unit_seconds; with days a year is at most 24 nodes, and an interval within a day one.
    """
    first, past = F.floor(seconds(start) / unit_seconds).cast("long"), F.floor(seconds(end) / unit_seconds).cast("long") + 1
    low = [F.ceil(first / F.lit(FAN**k)).cast("long") for k in range(TOP + 1)]
    high = [F.floor(past / F.lit(FAN**k)).cast("long") for k in range(TOP + 1)]
    none = F.array().cast("array<bigint>")
    span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
    at_level = lambda k: lambda i: F.struct(F.lit(k).alias("level"), i.alias("node"))
    parts = []
    for k in range(TOP + 1):
        here = span(low[k], high[k])
        if k < TOP:  # what the level above covers stays out
            here = F.when(low[k + 1] < high[k + 1], F.concat(span(low[k], FAN * low[k + 1]), span(FAN * high[k + 1], high[k]))).otherwise(here)
        parts.append(F.transform(here, at_level(k)))
    return F.concat(*parts)


def points_in(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, unit_seconds: int = 86_400) -> DataFrame:
    """All pairs of a point and an interval of the same `by` that holds it, ends included.

    The join is an equality on `by` and node with the exact test behind it. A point becomes a row for each level that
    intervals of its `by` use, one where none is longer than a few cells. Columns other than `by` must differ by name.
    """
    cut = intervals.where(F.col(end) >= F.col(start)).withColumn("_n", F.explode(time_nodes(F.col(start), F.col(end), unit_seconds))).withColumns({"_level": F.col("_n.level"), "_node": F.col("_n.node")}).drop("_n")
    used = cut.groupBy(*by).agg(F.collect_set("_level").alias("_levels"))
    cell = F.floor(seconds(F.col(at)) / unit_seconds)
    dealt = points.join(used, by).withColumn("_level", F.explode("_levels")).withColumn("_node", F.floor(cell / F.pow(F.lit(float(FAN)), F.col("_level"))).cast("long")).drop("_levels")
    return dealt.join(cut, [*by, "_level", "_node"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_level", "_node")
