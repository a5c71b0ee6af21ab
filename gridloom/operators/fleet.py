"""The fleet by day: expected against received devices, daily metrics, filters and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ranks import nearest_index, with_ranks

INACTIVE = ("DECOMMISSIONED", "TEMPORARILY_INACTIVE", "TEST")


def expected_fleet(registry: DataFrame, day: Column) -> DataFrame:
    """Devices that should report on a day: expected, in service, inside their window (open ends count)."""
    inside = (F.col("telemetry_start_date").isNull() | (F.col("telemetry_start_date") <= day)) & (F.col("telemetry_end_date").isNull() | (F.col("telemetry_end_date") >= day))
    return registry.where(F.col("telemetry_expected") & ~F.col("lifecycle_status").isin(list(INACTIVE)) & inside)


def reconcile(expected: DataFrame, received: DataFrame, key: str, late: str | None = None) -> DataFrame:
    """Both sides by one full outer join: RECEIVED or LATE, UNEXPECTED, MISSING."""
    e, r = expected.select(F.col(key), F.lit(True).alias("_e")), received.withColumn("_r", F.lit(True))
    got = F.when(F.col(late), "LATE").otherwise("RECEIVED") if late else F.lit("RECEIVED")
    arrival = F.when(F.col("_e").isNull(), "UNEXPECTED").when(F.col("_r").isNull(), "MISSING").otherwise(got)
    return e.join(r, key, "full_outer").withColumn("arrival", arrival).drop("_e", "_r")


def last_before(rows: DataFrame, key: str, day: str, at: Column) -> DataFrame:
    """Each key's latest row before a day, without a self-join."""
    return rows.where(F.col(day) < at).groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.col(day)).alias("_x")).select(key, "_x.*")


def daily_metrics(days: DataFrame, day: str, value: str) -> DataFrame:
    """Rows, mean, greatest and nearest-rank p50 and p95 of a value by day, from counts of each day's values."""
    counts = days.groupBy(day, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ranked = with_ranks(counts, [day], "v", "n")
    at = lambda q: F.round(F.min(F.when(F.col("upto") > nearest_index(F.col("total"), q), F.col("v"))), 3)
    mean = F.round(F.sum(F.col("v") * F.col("n")) / F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), 3)
    return ranked.groupBy(day).agg(F.sum("n").alias("rows"), mean.alias("mean"), F.max("v").alias("max"), at(0.5).alias("p50"), at(0.95).alias("p95"))


def of_sites(rows: DataFrame, registry: DataFrame, key: str, sites: Column) -> DataFrame:
    """rows of the registry's devices that the condition on their sites holds for."""
    return rows.join(registry.where(sites).select(key).distinct(), key, "left_semi")


def on_days_with(rows: DataFrame, others: DataFrame, *keys: str) -> DataFrame:
    """rows of entities and days on which `others` has a row of the same ones."""
    return rows.join(others.select(*keys), list(keys), "left_semi")


# States of a file whose stamps count, from validated on, whatever came after.
USABLE_STATES = ("READY_FOR_NORMALIZATION", "FRAME_RECONSTRUCTION", "FRAMES_RECONSTRUCTED", "NORMALIZING", "NORMALIZED", "NORMALIZED_WITH_WARNINGS", "COMPLETED", "PARTIAL")


def usable(files: DataFrame, state: str = "state", states: tuple[str, ...] = USABLE_STATES) -> DataFrame:
    """Files in a state that contributes to coverage."""
    return files.where(F.col(state).isin(list(states)))


def summary(reconciled: DataFrame, day: str) -> DataFrame:
    """Tallies of a reconciled day: arrivals, classes, sums, coverage and delivery over expected devices only."""
    count = lambda c, v: F.count_if(F.col(c) == v).alias(f"n_{v.lower()}")
    expected = F.col("arrival") != "UNEXPECTED"
    return reconciled.groupBy(day).agg(
        *(count("arrival", v) for v in ("RECEIVED", "LATE", "MISSING", "UNEXPECTED")),
        *(count("completeness", v) for v in ("COMPLETE", "PARTIAL", "SEVERELY_INCOMPLETE", "NO_DATA")),
        F.sum("unique_timestamps").alias("unique_timestamps"), F.sum("gap_count").alias("gaps"),
        F.round(F.avg(F.when(expected, F.coalesce("sample_pct", F.lit(0.0)))), 3).alias("fleet_coverage_pct"),
        F.round(F.count_if(F.col("arrival").isin("RECEIVED", "LATE")) * 100.0 / F.nullif(F.count_if(expected), F.lit(0)), 3).alias("delivery_pct"),
    )


def filtered(df: DataFrame, **wanted) -> DataFrame:
    """Equality (or membership) on each column given; None asks for nothing."""
    tests = [F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v for c, v in wanted.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def searched(df: DataFrame, text: str | None, *columns: str) -> DataFrame:
    """Rows with text in any of the columns, whatever the case."""
    if not text:
        return df
    return df.where(reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(text.lower())) for c in columns]))


def time_range(df: DataFrame, start=None, end=None, column: str = "event_time") -> DataFrame:
    """Both ends inclusive; a missing one is open."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start))
    return df if end is None else df.where(F.col(column) <= F.lit(end))


def keyset_page(df: DataFrame, size: int, after: tuple | None = None, time: str = "event_time", seq: str = "frame_sequence") -> DataFrame:
    """The `size` rows after a position in (time, sequence) order, and whether more follow, as has_more.

    Plans as a bounded top-k: no full sort.
    """
    if after:
        t, s = F.lit(after[0]), F.lit(after[1])
        df = df.where((F.col(time) > t) | ((F.col(time) == t) & (F.col(seq) > s)))
    one_more = df.orderBy(time, seq).limit(size + 1)
    w = Window.orderBy(time, seq)
    return one_more.withColumn("_r", F.row_number().over(w)).withColumn("has_more", F.max("_r").over(Window.partitionBy()) > size).where(F.col("_r") <= size).drop("_r")


def offset_page(df: DataFrame, page: int, size: int, *order: Column) -> tuple[DataFrame, dict]:
    """A page of an ordered table and its metadata."""
    total = df.count()
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
    return rows, {"total": total, "page": page, "page_size": size, "pages": -(-total // size)}


def worst_first(days: DataFrame, pct: str, key: str) -> DataFrame:
    return days.orderBy(F.col(pct).asc_nulls_first(), key)


def latest_per_entity(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Each key's row of the greatest (time, tie)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("_x")).select(key, "_x.*")


def zero_filled_counts(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Counts of each value of a closed domain, those that don't occur included."""
    spark = df.sparkSession
    every = spark.createDataFrame([(v,) for v in domain], f"{column} string")
    return every.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))
