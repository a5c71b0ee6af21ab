"""Coverage of entities and business days, gaps and cadence, from distinct event times; nothing is interpolated."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import business_date, cases, nearest_rank, seconds
from gridloom.operators.ranks import nearest_index, with_ranks


@dataclass(frozen=True)
class CoverageRules:
    """Thresholds of a day's coverage."""

    interval_seconds: int = 120
    day_seconds: int = 86_400
    gap_factor: float = 3.0
    moderate_seconds: int = 1800
    major_seconds: int = 7200
    critical_seconds: int = 21_600
    complete_pct: float = 95.0
    partial_pct: float = 50.0
    grace_hours: int = 24
    cadence_tolerance: float = 0.5
    zone: str = "Asia/Kolkata"

    @property
    def expected(self) -> int:
        return max(1, self.day_seconds // self.interval_seconds)

    @property
    def gap_seconds(self) -> float:
        return self.interval_seconds * self.gap_factor


def severity(duration: Column, r: CoverageRules) -> Column:
    return cases([(duration >= r.critical_seconds, "CRITICAL"), (duration >= r.major_seconds, "MAJOR"), (duration >= r.moderate_seconds, "MODERATE")], "MINOR")


def completeness(pct: Column, unique: Column, r: CoverageRules) -> Column:
    return cases([(F.coalesce(unique, F.lit(0)) == 0, "NO_DATA"), (pct >= r.complete_pct, "COMPLETE"), (pct >= r.partial_pct, "PARTIAL")], "SEVERELY_INCOMPLETE")


def distinct_times(events: DataFrame, r: CoverageRules) -> DataFrame:
    """(charger_id, business_date, event_time, files): each distinct stamp and the number of files that have it.

    Input: charger_id, event_time and, where known, file_id. The day is the local one.
    """
    day = events.withColumn("business_date", business_date(F.col("event_time"), r.zone))
    files = F.count_distinct("file_id") if "file_id" in events.columns else F.lit(1).cast("long")
    return day.where("event_time is not null").groupBy("charger_id", "business_date", "event_time").agg(files.alias("files") if "file_id" in events.columns else F.max(F.lit(1)).cast("long").alias("files"))


def _steps(times: DataFrame) -> DataFrame:
    w = Window.partitionBy("charger_id", "business_date").orderBy("event_time")
    after = F.lead("event_time").over(w)
    return times.withColumn("gap_end", after).withColumn("step", seconds(after) - seconds(F.col("event_time")))


def day_gaps(events: DataFrame, r: CoverageRules | None = None) -> DataFrame:
    """Steps between consecutive stamps of a day over the threshold, with severity and the samples missing in them."""
    r = r or CoverageRules()
    steps = _steps(distinct_times(events, r)).where(F.col("step") > r.gap_seconds)
    missing = F.greatest(F.lit(0), F.floor(F.col("step") / r.interval_seconds) - 1).cast("long")
    return steps.select("charger_id", "business_date", F.col("event_time").alias("gap_start"), "gap_end", F.col("step").alias("duration_seconds"), missing.alias("missing_samples"), severity(F.col("step"), r).alias("severity"))


def day_coverage(events: DataFrame, r: CoverageRules | None = None) -> DataFrame:
    """One row a charger and day: distinct stamps, percentages, leading and trailing seconds, cadence and class."""
    r = r or CoverageRules()
    steps = _steps(distinct_times(events, r))
    agg = steps.groupBy("charger_id", "business_date").agg(
        F.count("*").alias("unique_timestamps"), F.count_if(F.col("files") > 1).alias("overlap_timestamps"),
        F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"),
        F.sort_array(F.collect_list("step")).alias("steps"),
        F.count_if(F.col("step") > r.gap_seconds).alias("gap_count"),
        F.coalesce(F.sum(F.when(F.col("step") > r.gap_seconds, F.col("step"))), F.lit(0.0)).alias("gap_seconds"),
        F.coalesce(F.max(F.when(F.col("step") > r.gap_seconds, F.col("step"))), F.lit(0.0)).alias("largest_gap_seconds"),
    )
    start = seconds(F.to_utc_timestamp(F.col("business_date").cast("timestamp"), r.zone))
    pct = lambda x: F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), x)), 3)
    span = seconds(F.col("last_event")) - seconds(F.col("first_event"))
    sample = F.col("unique_timestamps") * 100.0 / r.expected
    n = F.size("steps")
    median = F.when(n > 0, (F.element_at("steps", F.floor((n + 1) / 2).cast("int")) + F.element_at("steps", (F.floor(n / 2) + 1).cast("int"))) / 2)
    out = agg.withColumn("median_interval", F.round(median, 3)).withColumn("p95_interval", F.when(n > 0, nearest_rank(F.col("steps"), 0.95)))
    return out.select(
        "charger_id", "business_date", "unique_timestamps", "overlap_timestamps", F.lit(r.expected).alias("expected_timestamps"),
        pct(sample).alias("sample_pct"), pct(span * 100.0 / r.day_seconds).alias("span_pct"), pct((span - F.col("gap_seconds")) * 100.0 / r.day_seconds).alias("gap_adjusted_pct"),
        "gap_count", F.round("largest_gap_seconds", 3).alias("largest_gap_seconds"),
        F.floor(seconds(F.col("first_event")) - start).cast("long").alias("leading_seconds"),
        F.floor(start + r.day_seconds - seconds(F.col("last_event"))).cast("long").alias("trailing_seconds"),
        "median_interval", F.round("p95_interval", 3).alias("p95_interval"),
        F.coalesce(F.abs(F.col("median_interval") - r.interval_seconds) > r.cadence_tolerance * r.interval_seconds, F.lit(False)).alias("cadence_abnormal"),
        completeness(sample, F.col("unique_timestamps"), r).alias("completeness"),
    )


def file_days(rows: DataFrame, r: CoverageRules | None = None) -> DataFrame:
    """(file_id, charger_id, business_date, offsets, unique_timestamps, row_count): a file's stamps by local day; with
    connector_no or smr_no in the rows also the connectors or smrs seen.

    Rows are apportioned by the day's share of the file's distinct stamps.
    """
    r = r or CoverageRules()
    day = rows.withColumn("business_date", business_date(F.col("event_time"), r.zone))
    start = seconds(F.to_utc_timestamp(F.col("business_date").cast("timestamp"), r.zone))
    day = day.withColumn("offset", F.floor(seconds(F.col("event_time")) - start).cast("int"))
    parts = [F.array_sort(F.collect_set(c)).alias(f"{name}s") for c, name in (("connector_no", "connector"), ("smr_no", "smr")) if c in rows.columns]
    days = day.where("event_time is not null").groupBy("file_id", "charger_id", "business_date").agg(F.array_sort(F.collect_set("offset")).alias("offsets"), *parts)
    whole = Window.partitionBy("file_id")
    counts = rows.groupBy("file_id").agg(F.count("*").alias("rows"))
    days = days.withColumn("unique_timestamps", F.size("offsets").cast("long")).withColumn("all", F.sum("unique_timestamps").over(whole))
    return days.join(counts, "file_id").select("file_id", "charger_id", "business_date", "offsets", "unique_timestamps", F.bround(F.col("rows") * F.col("unique_timestamps") / F.col("all")).cast("long").alias("row_count"), *(c for c in ("connectors", "smrs") if c in days.columns))


def expand_offsets(days: DataFrame, r: CoverageRules | None = None) -> DataFrame:
    """The stamps (file_id, charger_id, event_time) of file_days(): a late file needs no rereading of others."""
    r = r or CoverageRules()
    start = F.unix_seconds(F.to_utc_timestamp(F.col("business_date").cast("timestamp"), r.zone))
    each = days.select("file_id", "charger_id", start.alias("_start"), F.explode("offsets").alias("_offset"))
    return each.select("file_id", "charger_id", F.timestamp_seconds(F.col("_start") + F.col("_offset")).alias("event_time"))


def day_attributes(days: DataFrame) -> DataFrame:
    """(charger_id, business_date, files, connectors, smrs, quality_score, first_received) from file_days() with, where
    known, connectors, smrs, quality_score and received_at of each file: unions, the mean score and the first receipt."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))) if c in days.columns else F.lit(None).cast("array<string>")
    score = F.round(F.avg("quality_score"), 2) if "quality_score" in days.columns else F.lit(None).cast("double")
    first = F.min("received_at") if "received_at" in days.columns else F.lit(None).cast("timestamp")
    return days.groupBy("charger_id", "business_date").agg(F.count_distinct("file_id").alias("files"), union("connectors").alias("connectors"), union("smrs").alias("smrs"), score.alias("quality_score"), first.alias("first_received"))


def primary_file(days: DataFrame) -> DataFrame:
    """The file with most distinct stamps of each charger and day; the first received wins ties."""
    return days.groupBy("charger_id", "business_date").agg(F.expr("max_by(file_id, struct(unique_timestamps, -unix_micros(received_at)))").alias("primary_file"), F.count("*").alias("files"))


def lateness(received: Column, day: Column, r: CoverageRules) -> Column:
    """struct(is_late, late_seconds): received after the local day's end and the grace time."""
    end = seconds(F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), r.zone)) + r.grace_hours * 3600
    late = seconds(received) - end
    return F.struct(F.coalesce(late > 0, F.lit(False)).alias("is_late"), F.when(received.isNull(), F.lit(None).cast("long")).otherwise(F.greatest(F.lit(0), F.floor(late))).cast("long").alias("late_seconds"))


def file_intervals(rows: DataFrame) -> DataFrame:
    """Median, nearest-rank p95, least and greatest step between a file's distinct stamps, from counts of steps."""
    w = Window.partitionBy("file_id").orderBy("event_time")
    step = seconds(F.col("event_time")) - seconds(F.lag("event_time").over(w))
    steps = rows.where("event_time is not null").select("file_id", "event_time").distinct().withColumn("step", step).where("step > 0")
    ranked = with_ranks(steps.groupBy("file_id", "step").agg(F.count("*").alias("n")), ["file_id"], "step", "n")
    at, total = lambda k: F.min(F.when(F.col("upto") > k, F.col("step"))), F.col("total")
    median = (at(F.floor((total - 1) / 2)) + at(F.floor(total / 2))) / 2
    return ranked.groupBy("file_id").agg(F.sum("n").alias("intervals"), F.round(median, 3).alias("median_interval"), F.round(F.min("step"), 3).alias("min_interval"), F.round(F.max("step"), 3).alias("max_interval"), F.round(at(nearest_index(total, 0.95)), 3).alias("p95_interval"))


def date_span(rows: DataFrame, r: CoverageRules | None = None) -> DataFrame:
    """Distinct stamps by local date of each file, its dominant date (ties: the earliest) and the kind of span."""
    r = r or CoverageRules()
    days = rows.withColumn("day", business_date(F.col("event_time"), r.zone)).groupBy("file_id", "day").agg(F.count_distinct("event_time").alias("n")).where("day is not null")
    kinds = cases([(F.col("days") == 1, "SINGLE_DAY"), ((F.col("days") == 2) & (F.datediff("last", "first") == 1), "CROSS_MIDNIGHT"), (F.col("days") > 1, "MULTI_DAY")], "UNKNOWN")
    return days.groupBy("file_id").agg(F.count("*").alias("days"), F.min("day").alias("first"), F.max("day").alias("last"), F.expr("max_by(day, struct(n, -unix_date(day)))").alias("dominant_date")).withColumn("span", kinds)
