"""Exact medians and quantiles from counts of values: no list of a group's values, no task with all of a column's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces of the number line to each doubling.
STEPS = 4096


def with_ranks(counts: DataFrame, by: list[str], v: str, n: str) -> DataFrame:
    """counts (by, v, n) with upto, how many of the group's values are at most v, and total; null values count in neither.

    For groups of an entity or day: a group's distinct values stream sorted through one task.
    """
    there = F.when(F.col(v).isNotNull(), F.col(n)).otherwise(0)
    group = Window.partitionBy(*by)
    return counts.withColumn("upto", F.sum(there).over(group.orderBy(F.col(v).asc_nulls_first()))).withColumn("total", F.sum(there).over(group))


def nearest_index(total: Column, q: float) -> Column:
    """The place, from 0, of the nearest-rank quantile: round-half-even(q (total - 1))."""
    return F.bround(F.lit(q) * (total - 1))


def _piece(v: Column) -> Column:
    """A number's piece of the number line, in order: STEPS to each doubling of its size, so pieces follow values of any scale."""
    size = F.floor(STEPS * (F.log2(F.abs(v)) + 1100)).cast("long")
    return F.when(F.isnan(v), F.lit((1 << 63) - 1)).when(v == 0, 0).when(v > 0, size).otherwise(-size)


def _dealt(counts: DataFrame, by: list[str], v: str, n: str) -> tuple[DataFrame, DataFrame]:
    """counts with the _piece of each value, and the pieces (by, _piece, _m, _upto, _total) with their sizes and running sums."""
    dealt = counts.where(F.col(v).isNotNull()).select(*by, v, n, _piece(F.col(v).cast("double")).alias("_piece"))
    pieces, group = dealt.groupBy(*by, "_piece").agg(F.sum(n).alias("_m")), Window.partitionBy(*by)
    return dealt, pieces.withColumn("_upto", F.sum("_m").over(group.orderBy("_piece"))).withColumn("_total", F.sum("_m").over(group))


def average_ranks(counts: DataFrame, by: list[str], v: str, n: str) -> DataFrame:
    """(by, v, rank): the average rank of each distinct value in its group, from counts (by, v, n)."""
    dealt, pieces = _dealt(counts, by, v, n)
    before = F.coalesce(F.sum(n).over(Window.partitionBy(*by, "_piece").orderBy(v).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = pieces.select(*by, "_piece", (F.col("_upto") - F.col("_m")).alias("_below"))
    return dealt.withColumn("_before", before).join(base, [*by, "_piece"]).select(*by, v, (F.col("_below") + F.col("_before") + (F.col(n) + 1) / 2).alias("rank"))


def group_quantiles(counts: DataFrame, by: list[str], v: str, n: str, qs: tuple[float, ...]) -> DataFrame:
    """What quantiles() gives, for groups of an entity each: one window, as in with_ranks()."""
    ranked = with_ranks(counts.where(F.col(v).isNotNull()).select(*by, v, n), by, v, n)
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(v)))

    def between(q: float) -> Column:
        place = F.lit(q) * (F.col("total") - 1)
        low, high, share = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        return F.when(share == 0, low).otherwise((1 - share) * low + share * high)

    return ranked.groupBy(*by).agg(F.array(*map(between, qs)).alias("q"))


def quantiles(counts: DataFrame, by: list[str], v: str, n: str, qs: tuple[float, ...]) -> DataFrame:
    """(by, q): the interpolated quantiles of each group, exact, from counts (by, v, n) of its distinct values.

    Values are dealt to pieces of the number line; pieces' counts are summed, and only the pieces that hold a wanted
    place are ranked inside. So a column of any number of values takes no task of its own.
    """
    dealt, pieces = _dealt(counts, by, v, n)
    places = [(i, end) for i in range(len(qs)) for end in ("floor", "ceil")]
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(end).alias("end"), getattr(F, end)(F.lit(qs[i]) * (F.col("_total") - 1)).alias("at")) for i, end in places))
    asked = pieces.select(*by, "_piece", (F.col("_upto") - F.col("_m")).alias("_below"), "_upto", F.explode(wanted).alias("w")).where("w.at >= _below and w.at < _upto")
    held = asked.select(*by, "_piece", "_below").distinct()
    inner = dealt.join(held, [*by, "_piece"])
    inner = inner.withColumn("_at", F.col("_below") + F.sum(n).over(Window.partitionBy(*by, "_piece").orderBy(v))).select(*by, "_piece", v, "_at")
    found = inner.join(asked.select(*by, "_piece", "w"), [*by, "_piece"]).where("_at > w.at").groupBy(*by, "w.i", "w.end").agg(F.min(v).alias("x"))
    pick = lambda i, end: F.max(F.when((F.col("i") == i) & (F.col("end") == end), F.col("x")))
    ends = found.groupBy(*by).agg(*(pick(i, end).alias(f"_{i}{end}") for i, end in places)).join(pieces.groupBy(*by).agg(F.max("_total").alias("_total")), by)

    def between(i: int) -> Column:
        at = F.lit(qs[i]) * (F.col("_total") - 1)
        low, high, share = F.col(f"_{i}floor"), F.col(f"_{i}ceil"), at - F.floor(at)
        return F.when(share == 0, low).otherwise((1 - share) * low + share * high)

    return ends.select(*by, F.array(*(between(i) for i in range(len(qs)))).alias("q"))
