"""Historical analytics: cadence, gaps, counters, component presence, signal matrix, eligibility."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import cases, seconds
from gridloom.operators.ranks import nearest_index, with_ranks

GAP_FACTOR, GAP_LEAST, GAP_FALLBACK = 2.5, 180.0, 300.0
STEADY_LEAST, STEADY_BAND, STEADY_SHARE = 5, 0.15, 0.40
RESET_ABOVE, RESET_SHARE = 10.0, 0.5


def ordered(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy("event_time", "frame_sequence")


def _deltas(rows: DataFrame, by: str) -> DataFrame:
    before = F.lag("event_time").over(ordered(by))
    return rows.withColumn("prev_time", before).withColumn("delta", seconds(F.col("event_time")) - seconds(before))


def step_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, delta, n): how often each step between observations of an entity (the first of by) is found; null for its first one.

    Counts of parts of a history, such as days, add up to those of all of it.
    """
    return _deltas(rows, by[0]).groupBy(*by, "delta").agg(F.count("*").alias("n"))


def sampling_profile(rows: DataFrame, by: str = "charger_id") -> DataFrame:
    """Each entity's steps between observations and, where they are steady, the interval expected.

    Steps are counted by their length, so an entity's history is no list; all of it stays in the partitions of the
    window that finds the steps.
    """
    return profile_of_steps(step_counts(rows, [by]), by)


def profile_of_steps(steps: DataFrame, by: str = "charger_id") -> DataFrame:
    """sampling_profile() of step_counts(), which may come in several parts of an entity's history."""
    steps = steps.groupBy(by, "delta").agg(F.sum("n").alias("n"))
    steps = with_ranks(steps.withColumn("d", F.when(F.col("delta") > 0, F.col("delta"))), [by], "d", "n")
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("d")))
    total, group = F.col("total"), Window.partitionBy(by)
    steps = steps.withColumn("median", (at(F.floor((total - 1) / 2)).over(group) + at(F.floor(total / 2)).over(group)) / 2)
    agg = steps.groupBy(by).agg(
        F.sum("n").alias("observations"), F.coalesce(F.sum(F.when(F.col("delta") == 0, F.col("n"))), F.lit(0)).alias("same_second"), F.max("total").alias("deltas"), F.max("median").alias("median"),
        F.round(at(nearest_index(total, 0.05)), 2).alias("p05_interval"), F.round(at(nearest_index(total, 0.95)), 2).alias("p95_interval"),
        F.coalesce(F.sum(F.when(F.abs(F.col("d") - F.col("median")) <= STEADY_BAND * F.col("median"), F.col("n"))), F.lit(0)).alias("near"),
    )
    steady = (F.col("deltas") >= STEADY_LEAST) & (F.col("near") >= STEADY_SHARE * F.col("deltas"))
    return agg.select(by, "observations", "same_second", "deltas", F.round("median", 2).alias("median_interval"), "p05_interval", "p95_interval", F.when(steady, F.round("median", 1)).alias("expected_interval"))


def history_gaps(rows: DataFrame, by: str = "charger_id", profile: DataFrame | None = None) -> DataFrame:
    """Steps over max(180 s, 2.5 times the interval): the expected one, of unsteady entities the median, and over 300 s where there is none."""
    profile = profile if profile is not None else sampling_profile(rows, by)
    return gaps_of_steps(_deltas(rows, by).select(by, F.col("prev_time").alias("start_time"), F.col("event_time").alias("end_time"), "delta"), profile, by)


def gaps_of_steps(steps: DataFrame, profile: DataFrame, by: str = "charger_id") -> DataFrame:
    """history_gaps() of steps (by, start_time, end_time, delta); those of GAP_LEAST or less needn't be there."""
    usual = F.coalesce(*(c for c in ("expected_interval", "median_interval") if c in profile.columns))
    d = steps.join(profile.select(by, F.when(usual > 0, usual).alias("usual")), by, "left")
    threshold = F.when(F.col("usual").isNull(), GAP_FALLBACK).otherwise(F.greatest(F.lit(GAP_LEAST), F.col("usual") * GAP_FACTOR))
    return d.where(F.col("delta") > threshold).select(by, "start_time", "end_time", F.col("delta").alias("duration_seconds"), F.round(F.col("delta") / F.col("usual"), 2).alias("multiple"))


def counter_transitions(rows: DataFrame, value: str, by: str = "charger_id") -> DataFrame:
    """Each reading of a counter against the one before: INITIAL, INCREASED, UNCHANGED, DECREASED or RESET_CANDIDATE."""
    rows = rows.withColumn("v", F.col(value).try_cast("double")).where("v is not null and not isnan(v)")
    w = ordered(by)
    prev, top = F.lag("v").over(w), F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("prev", prev).withColumn("top", top)
    kind = cases(
        [
            (F.col("prev").isNull(), "INITIAL"),
            (F.col("v") > F.col("prev"), "INCREASED"),
            (F.col("v") == F.col("prev"), "UNCHANGED"),
            ((F.col("top") > RESET_ABOVE) & (F.col("v") < RESET_SHARE * F.col("top")), "RESET_CANDIDATE"),
        ],
        "DECREASED",
    )
    return rows.select(by, "event_time", "frame_sequence", "v", "prev", F.round(F.col("v") - F.col("prev"), 3).alias("delta"), kind.alias("transition"))


def counter_report(transitions: DataFrame, by: str = "charger_id") -> DataFrame:
    """Counts of transitions; resets are decreases too."""
    is_ = lambda *k: F.count_if(F.col("transition").isin(*k))
    return transitions.groupBy(by).agg(F.count("*").alias("readings"), is_("INCREASED").alias("increases"), is_("DECREASED", "RESET_CANDIDATE").alias("decreases"), is_("UNCHANGED").alias("unchanged"), is_("RESET_CANDIDATE").alias("resets"))


def component_presence(rows: DataFrame, kind: str, component: str, by: str = "charger_id") -> DataFrame:
    """When each component was first and last seen, how often, on how many UTC dates."""
    return rows.where(F.col(component).isNotNull()).groupBy(by, F.col(kind).alias("component_type"), F.col(component).alias("component_id")).agg(F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"), F.count("*").alias("observations"), F.count_distinct(F.to_date("event_time")).alias("dates"))


def signal_matrix(rows: DataFrame, signals: list[str], by: str = "charger_id") -> DataFrame:
    """Which signals each entity ever has. A name that isn't a column is an error and not a silent null."""
    unknown = [s for s in signals if s not in rows.columns]
    if unknown:
        raise ValueError(f"unknown signals: {', '.join(unknown)}")
    return rows.groupBy(by).agg(*(F.bool_or(F.col(s).isNotNull()).alias(s) for s in signals))


def whitelisted(rows: DataFrame, allowed: list[str], wanted: list[str] | None = None) -> DataFrame:
    """Time, sequence and the wanted columns that are allowed and there; all allowed ones by default."""
    return rows.select("charger_id", "event_time", "frame_sequence", *[c for c in (wanted or allowed) if c in allowed and c in rows.columns])


def eligibility(stats: DataFrame, days: int = 7, observations: int = 100, gap_ratio: float = 0.35) -> DataFrame:
    """stats (.., observations, days, gap_ratio) with eligible and the reasons against."""
    single = F.col("observations") <= 1
    reasons: list[Column] = [
        F.when(single, "Only a single observation exists"),
        F.when(~single & (F.col("days") < days), F.format_string(f"Fewer than {days} days of history (%d)", F.col("days"))),
        F.when(~single & (F.col("observations") < observations), F.format_string(f"Fewer than {observations} observations (%d)", F.col("observations"))),
        F.when(~single & (F.col("gap_ratio") > gap_ratio), "Gap ratio too high"),
    ]
    text = F.concat_ws("; ", *reasons)
    return stats.withColumn("eligible", text == "").withColumn("reason", F.when(text != "", F.concat(text, F.lit("."))))


def continuity(rows: DataFrame, by: str = "charger_id", components: dict[str, str] | None = None, config: str | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Observations, span, days, cadence, gaps, gap ratio, depth and eligibility for research of each entity.

    `components` gives names to columns of component ids, whose distinct values are listed in order; `config` is a column
    of configuration hashes, whose distinct values are counted; `entities` adds those without a row, of depth NO_DATA.
    """
    profile = sampling_profile(rows, by)
    gaps = history_gaps(rows, by, profile).groupBy(by).agg(F.count("*").alias("gaps"), F.sum("duration_seconds").alias("gap_seconds"), F.max("duration_seconds").alias("largest_gap"))
    parts = [F.sort_array(F.collect_set(c)).alias(name) for name, c in (components or {}).items()] + ([F.count_distinct(config).alias("configurations")] if config else [])
    span = rows.groupBy(by).agg(F.min("event_time").alias("first"), F.max("event_time").alias("last"), F.count_distinct(F.to_date("event_time")).alias("days"), F.count_distinct("event_time").alias("distinct_timestamps"), *parts)
    out = profile.join(span, by).join(gaps, by, "left")
    if entities is not None:
        out = entities.select(by).distinct().join(out, by, "left")
    out = out.fillna(0, ["observations", "same_second", "deltas", "days", "distinct_timestamps", "gaps", "gap_seconds", "largest_gap", *(["configurations"] if config else [])])
    length = seconds(F.col("last")) - seconds(F.col("first"))
    depth = cases([(F.col("observations") == 0, "NO_DATA"), (F.col("observations") == 1, "SINGLE_OBSERVATION")], "MULTI_OBSERVATION")
    return eligibility(out.withColumn("gap_ratio", F.round(F.coalesce(F.try_divide("gap_seconds", length), F.lit(0.0)), 4)).withColumn("depth", depth))


def shared_axis(rows: DataFrame, signals: list[str], by: str = "charger_id") -> DataFrame:
    """All signals on one time axis, unaligned: (charger, time, sequence, values); a signal absent at a stamp has no key."""
    parts = [rows.where(F.col(s).isNotNull()).select(by, "event_time", "frame_sequence", F.lit(s).alias("k"), F.col(s).cast("double").alias("v")) for s in signals]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(by, "event_time", "frame_sequence").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("values"))
