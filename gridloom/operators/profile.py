"""Column profiles, duplicates and logical keys of a table of text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ranks import quantiles

OBSERVED, EXAMPLES, TOP, NUMERIC_SHARE = 50, 5, 200, 0.95


def long_form(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value): each cell as text."""
    columns = columns or df.columns
    return df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, n) of the values that are there; one shuffle, combined before it."""
    return long_form(df, columns).where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, k: int = TOP) -> DataFrame:
    """The k most frequent values of a column; ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def frequent_values(df: DataFrame, columns: list[str], k: int = EXAMPLES) -> DataFrame:
    """(column, value, n, rank): the k most frequent values of each column."""
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return value_counts(df, columns).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def column_profile(df: DataFrame, columns: list[str] | None = None, sentinels: tuple[float, ...] = ()) -> DataFrame:
    """One row a column: nulls, distinct values, variability, number statistics where it is numeric, text bounds elsewhere."""
    columns = columns or df.columns
    rows = long_form(df, columns)
    n = F.col("n")
    v = F.expr("try_cast(value as double)")
    # counts of each value first: the profile of a column with few values reads few rows
    counts = rows.groupBy("column", "value").agg(F.count("*").alias("n")).withColumn("v", v)
    there = F.col("value").isNotNull()
    ok = F.col("v").isNotNull()
    mean = F.sum(F.when(ok, n * F.col("v"))) / F.sum(F.when(ok, n))
    agg = counts.groupBy("column").agg(
        F.sum(n).alias("rows"), F.coalesce(F.sum(F.when(there, n)), F.lit(0)).alias("non_null"), F.count_if(there).alias("unique"),
        F.coalesce(F.sum(F.when(ok, n)), F.lit(0)).alias("numeric"), F.min(F.when(ok, F.col("v"))).alias("lo"), F.max(F.when(ok, F.col("v"))).alias("hi"),
        mean.alias("mean"), F.sum(F.when(ok, n * F.col("v") * F.col("v"))).alias("sq"),
        F.min("value").alias("text_min"), F.max("value").alias("text_max"),
        F.coalesce(F.sum(F.when(F.col("v").isin([float(s) for s in sentinels]), n)), F.lit(0)).alias("sentinel_hits"),
    )
    numeric = (F.col("non_null") > 0) & (F.col("numeric") >= NUMERIC_SHARE * F.col("non_null"))
    kind = F.when(F.col("unique") == 0, "ALL_NULL").when(F.col("unique") == 1, "CONSTANT").otherwise("VARIABLE")
    return agg.select(
        "column", "rows", "non_null", (F.col("rows") - F.col("non_null")).alias("nulls"), F.col("unique").alias("unique_count"), kind.alias("variability"), numeric.alias("is_numeric"),
        F.when(numeric, F.col("lo")).alias("num_min"), F.when(numeric, F.col("hi")).alias("num_max"), F.when(numeric, F.round("mean", 4)).alias("num_mean"),
        F.when(~numeric, F.col("text_min")).alias("text_min"), F.when(~numeric, F.col("text_max")).alias("text_max"), "sentinel_hits",
    )


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Median and sample deviation beside the bounds of number columns: (column, n, min, max, mean, median, std).

    A column is one of numbers if NUMERIC_SHARE of the values that are there are numbers; others have no row.
    """
    rows = long_form(df, columns).selectExpr("column", "value", "try_cast(value as double) v").where("value is not null")
    agg = rows.groupBy("column").agg(F.count("*").alias("_there"), F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_samp("v"), 4).alias("std"))
    counts = rows.where("v is not null").groupBy("column", "v").agg(F.count("*").alias("c"))
    agg = agg.where(F.col("n") >= NUMERIC_SHARE * F.col("_there")).join(quantiles(counts, ["column"], "v", "c", (0.5,)), "column")
    return agg.select("column", "n", "min", "max", "mean", F.round(F.col("q")[0], 4).alias("median"), "std")


def observed_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, observed, examples): all values by frequency where they are at most OBSERVED, and the EXAMPLES most frequent.

    Only the first values of each column by (frequency, value) are gathered, after their counts are known.
    """
    counts = value_counts(df, columns)
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    first = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= OBSERVED + 1)
    listed = first.groupBy("column").agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("_v"))
    values = F.transform("_v", lambda x: x["value"])
    return listed.select("column", F.when(F.col("_n") <= OBSERVED, values).alias("observed"), F.slice(values, 1, EXAMPLES).alias("examples"))


def exact_duplicates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(rows, distinct_rows, duplicate_rows, participating_rows): nulls equal each other."""
    groups = df.groupBy(columns or df.columns).agg(F.count("*").alias("_n"))
    return groups.agg(F.sum("_n").alias("rows"), F.count("*").alias("distinct_rows"), F.sum(F.col("_n") - 1).alias("duplicate_rows"), F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("participating_rows"))


def logical_collisions(df: DataFrame, keys: list[str]) -> DataFrame:
    """(groups, collisions, conflicting, max_rows) of logical keys; conflicting groups hold different rows.

    Repetition is classified here, never dropped.
    """
    rest = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys, *rest).agg(F.count("*").alias("_n"))
    groups = rows.groupBy(keys).agg(F.sum("_n").alias("_n"), F.count("*").alias("_kinds"))
    return groups.agg(F.count("*").alias("groups"), F.count_if(F.col("_n") > 1).alias("collisions"), F.count_if(F.col("_kinds") > 1).alias("conflicting"), F.max("_n").alias("max_rows"))


def frame_size_histogram(df: DataFrame, key: str) -> DataFrame:
    """(rows_per_key, keys): how many keys have how many rows."""
    return df.groupBy(key).agg(F.count("*").alias("rows_per_key")).groupBy("rows_per_key").agg(F.count("*").alias("keys"))


def modal_frame_size(df: DataFrame, key: str) -> DataFrame:
    """(modal_size, larger_keys): the most common number of rows a key (ties: the smaller) and the keys above it."""
    histogram = frame_size_histogram(df, key)
    modal = histogram.agg(F.expr("max_by(rows_per_key, struct(keys, -rows_per_key))")).scalar()
    return histogram.withColumn("modal_size", modal).groupBy("modal_size").agg(F.coalesce(F.sum(F.when(F.col("rows_per_key") > F.col("modal_size"), F.col("keys"))), F.lit(0)).alias("larger_keys"))


def dominant(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """The most frequent value of column in each group; ties: the greatest value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    return counts.groupBy(by).agg(F.expr(f"max_by(`{column}`, struct(_n, `{column}`))").alias("dominant"), F.max("_n").alias("n"))
