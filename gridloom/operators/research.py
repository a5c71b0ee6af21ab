"""Research outputs: signal statistics, correlations, datasets, pattern candidates, telemetry with events."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import RESEARCH_SENTINELS, cases, is_sentinel, rounded, seconds
from gridloom.operators.intervals import points_in
from gridloom.operators.moments import PAIRS_AS_COLUMNS, block_correlations
from gridloom.operators.ranks import average_ranks, group_quantiles, quantiles

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def valid(c: Column, sentinels: tuple[float, ...] = RESEARCH_SENTINELS) -> Column:
    """The number, null for other texts, non-finite values and sentinels."""
    v = c.try_cast("double") if isinstance(c, Column) else c
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))) & ~is_sentinel(v, sentinels, 1e-12), v)


def signal_statistics(rows: DataFrame, signals: list[str], by: list[str] | None = None) -> DataFrame:
    """One row a group and signal: counts of nulls, sentinels, zeros, distinct values; moments and quantiles of valid values.

    The deviation is the sample's; skewness divides the population's third moment by its cube, excess kurtosis the
    fourth by its fourth power.
    """
    by = by or []
    rows = rows.select(*by, *(F.col(s).cast("double").alias(s) for s in signals)).unpivot(by, signals, "signal", "raw")
    finite = ~F.isnan("raw") & (F.abs("raw") < F.lit(float("inf")))
    rows = rows.withColumn("v", valid(F.col("raw")))
    raw, v = F.col("raw"), F.col("v")
    there = F.coalesce(raw.isNotNull() & finite, F.lit(False))
    keys = [*by, "signal"]
    agg = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("v").alias("valid"), F.count_if(~there).alias("nulls"), F.count_if(there & v.isNull()).alias("sentinels"),
        F.count_if(v == 0).alias("zeros"), F.count_if(v < 0).alias("negatives"),
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.stddev_pop("v").alias("pop"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.skewness("v").alias("g1"), F.kurtosis("v").alias("g2"),
    )
    # counts of each value: how many there are, and where the quantiles lie
    counts = rows.groupBy(*keys, "raw").agg(F.count("*").alias("c")).withColumn("v", valid(F.col("raw")))
    agg = agg.join(counts.groupBy(*keys).agg(F.count("*").alias("distinct")), keys).join((group_quantiles if by else quantiles)(counts, keys, "v", "c", QUANTILES), keys, "left")
    n, some = F.col("valid"), (F.col("valid") > 1) & (F.col("pop") > 0)
    share = (n - 1) / n
    return agg.select(
        *by, "signal", "n", "valid", "nulls", "sentinels", "zeros", "negatives", "distinct", F.round("mean", 6).alias("mean"),
        F.round(F.when(n == 1, 0.0).otherwise(F.col("std")), 6).alias("std"), "min", "max", *(F.round(F.col("q")[i], 6).alias(f"p{int(100 * q):02d}") for i, q in enumerate(QUANTILES)),
        F.round(F.when(some & (n >= 3), F.col("g1") * F.pow(share, 1.5)), 6).alias("skew"),
        F.round(F.when(some & (n >= 4), (F.col("g2") + 3) * share * share - 3), 6).alias("kurtosis"),
        F.round((F.col("nulls") + F.col("sentinels")) / F.col("n"), 6).alias("missing_rate"),
    )


def _pearson(a: Column, b: Column) -> Column:
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.when((F.count(a) >= 3) & (F.stddev_pop(a) > 1e-12) & (F.stddev_pop(b) > 1e-12), F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b)))


def correlation_matrix(rows: DataFrame, signals: list[str], sentinels: tuple[float, ...] = RESEARCH_SENTINELS, digits: int = 6) -> DataFrame:
    """(a, b, pairs, r) of each pair of signals in sorted order, in one pass: a few sums a pair, however many rows.

    `sentinels` are the numbers that stand for no value, none of them where all numbers are measured. A few pairs are columns of one aggregate; hundreds of signals go through matrices, see moments.block_correlations().
    """
    pairs = list(combinations(sorted(signals), 2))
    cols = {s: valid(F.col(f"`{s}`").cast("double"), sentinels) for s in signals}
    rows = rows.select(*(c.alias(s) for s, c in cols.items()))
    if len(pairs) > PAIRS_AS_COLUMNS:
        return block_correlations(rows, signals, digits)
    agg = rows.agg(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()).alias("pairs"), rounded(_pearson(F.col(f"`{a}`"), F.col(f"`{b}`")), digits).alias("r")).alias(f"{a}|{b}") for a, b in pairs))
    return agg.select(F.explode(F.array(*(F.col(f"`{a}|{b}`") for a, b in pairs))).alias("x")).select("x.*")


def spearman(rows: DataFrame, a: str, b: str, sentinels: tuple[float, ...] = RESEARCH_SENTINELS, digits: int = 6) -> DataFrame:
    """(pairs, rho): Pearson of average ranks among rows where both are valid.

    Ranks come from counts of distinct values and running sums over pieces of their range, so no window holds all rows.
    """
    rows = rows.select(valid(F.col(a).cast("double"), sentinels).alias("a"), valid(F.col(b).cast("double"), sentinels).alias("b")).where("a is not null and b is not null")
    ra, rb = _average_ranks(rows, "a"), _average_ranks(rows, "b")
    ranked = rows.join(ra, "a").join(rb, "b")
    return ranked.agg(F.count("*").alias("pairs"), rounded(_pearson(F.col("rank_a"), F.col("rank_b")), digits).alias("rho"))


def _average_ranks(rows: DataFrame, c: str) -> DataFrame:
    """(c, rank_c): each distinct value's average rank."""
    counts = rows.groupBy(c).agg(F.count("*").alias("n")).withColumn("_all", F.lit(1))
    return average_ranks(counts, ["_all"], c, "n").select(c, F.col("rank").alias(f"rank_{c}"))


def charger_profile(rows: DataFrame, signals: list[str], by: str = "charger_id") -> DataFrame:
    """Observations, distinct stamps, first and last, and each signal's share of values that are there."""
    return rows.groupBy(by).agg(F.count("*").alias("observations"), F.count_distinct("event_time").alias("timestamps"), F.min("event_time").alias("first"), F.max("event_time").alias("last"), *(F.round(F.count(s) / F.count("*"), 6).alias(f"{s}_coverage") for s in signals))


def fleet_profile(profiles: DataFrame, signals: list[str]) -> DataFrame:
    """Totals over charger_profile() and the true missing rate of the fleet."""
    n = F.sum("observations")
    there = sum((F.sum(F.floor(F.col(f"{s}_coverage") * F.col("observations"))) for s in signals), F.lit(0))
    return profiles.agg(F.count("*").alias("chargers"), n.alias("observations"), F.min("first").alias("first"), F.max("last").alias("last"), F.round(1 - there / (n * len(signals)), 6).alias("missing_rate"))


def telemetry_with_events(points: DataFrame, sessions: DataFrame, alarms: DataFrame, faults: DataFrame | None = None, bucket_seconds: int = 86_400, by: str = "charger_id") -> DataFrame:
    """points with session_id (of the first session that holds them), active_alarms and active_faults.

    Ends are inclusive, open ends last up to the charger's last point. An interval is a few time nodes however long it
    is, see intervals.points_in(); with buckets of a day a year-long one is at most 24 rows.
    """
    last = points.groupBy(by).agg(F.max("event_time").alias("_last"))
    keys = points.select(by, "event_time", "frame_sequence")

    def active(events: DataFrame, what: Column, name: str) -> DataFrame:
        e = events.join(last, by).select(by, "start_time", F.coalesce("end_time", "_last").alias("_end"), what.alias("_x"))
        hit = points_in(keys, e, [by], "event_time", "start_time", "_end", bucket_seconds)
        return hit.groupBy(by, "event_time", "frame_sequence").agg((F.min(F.struct("start_time", "_x"))["_x"] if name == "session_id" else F.array_sort(F.collect_set("_x"))).alias(name))

    out = points.join(active(sessions, F.col("session_id"), "session_id"), [by, "event_time", "frame_sequence"], "left")
    out = out.join(active(alarms, F.col("code"), "active_alarms"), [by, "event_time", "frame_sequence"], "left")
    if faults is not None:
        out = out.join(active(faults, F.col("code"), "active_faults"), [by, "event_time", "frame_sequence"], "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("active_alarms", "active_faults") if c in out.columns})


def _level(moderate: Column, weak: Column) -> Column:
    return cases([(moderate, "MODERATE"), (weak, "WEAK")], "OBSERVATION")


def voltage_anomalies(stats: DataFrame, fleet: DataFrame) -> DataFrame:
    """Statistics (charger_id, signal, valid, min, max, mean) against absolute limits and the fleet's median (signal, p50)."""
    lowest = F.col("min") < 200
    highest = F.col("max") > 260
    apart = F.abs(F.col("mean") - F.col("fleet_p50")) / F.greatest(F.col("fleet_p50"), F.lit(1e-6)) > 0.1
    k = sum((F.coalesce(c, F.lit(False)).cast("int") for c in (lowest, highest, apart)), F.lit(0))
    rows = stats.where(F.contains(F.lower("signal"), F.lit("voltage")) & ~F.lower("signal").rlike("line_?to_?line|l[123]_?l[123]")).join(fleet.select("signal", F.col("p50").alias("fleet_p50")), "signal", "left")
    rows = rows.withColumn("evidence", k).where("evidence > 0")
    return rows.select("charger_id", "signal", F.lit("VOLTAGE_ANOMALY").alias("category"), "evidence", _level((F.col("evidence") >= 2) & (F.col("valid") >= 100), F.col("evidence") >= 2).alias("level"), F.round(F.least(F.lit(0.8), 0.3 + 0.1 * F.col("evidence")), 4).alias("confidence"))


def current_imbalance(stats: DataFrame) -> DataFrame:
    """Input currents of a charger whose means are over 20 % from their average."""
    rows = stats.where(F.contains(F.lower("signal"), F.lit("input_current")) & F.col("mean").isNotNull())
    agg = rows.groupBy("charger_id").agg(F.count("*").alias("n"), F.avg("mean").alias("avg"), F.collect_list("mean").alias("m")).where("n >= 2 and avg >= 0.01")
    agg = agg.withColumn("deviation", F.array_max(F.transform("m", lambda x: F.abs(x - F.col("avg")) / F.col("avg")))).where("deviation > 0.2")
    return agg.select("charger_id", F.lit("CURRENT_IMBALANCE").alias("category"), F.round("deviation", 6).alias("deviation"), _level(F.col("deviation") > 0.5, F.col("deviation") > 0.3).alias("level"), F.round(F.least(F.lit(0.9), 0.3 + F.col("deviation")), 4).alias("confidence"))


def thermal_drift(stats: DataFrame, fleet: DataFrame) -> DataFrame:
    """Temperatures far over their own mean or over the fleet's p95."""
    rows = stats.where(F.contains(F.lower("signal"), F.lit("temp"))).join(fleet.select("signal", F.col("p95").alias("fleet_p95")), "signal", "left")
    rise = (F.col("std") > 0) & (F.col("max") - F.col("mean") > 5)
    over = F.col("max") > F.col("fleet_p95")
    k = sum((F.coalesce(c, F.lit(False)).cast("int") for c in (rise, over)), F.lit(0))
    rows = rows.withColumn("evidence", k).where("evidence > 0")
    return rows.select("charger_id", "signal", F.lit("THERMAL_DRIFT").alias("category"), "evidence", F.when(F.col("evidence") >= 2, "WEAK").otherwise("OBSERVATION").alias("level"), F.round(F.least(F.lit(0.75), 0.3 + 0.15 * F.col("evidence")), 4).alias("confidence"))


def session_degradation(sessions: DataFrame) -> DataFrame:
    """Chargers with many failed or energyless sessions."""
    failed = F.col("termination_class").isNotNull() & ~F.col("termination_class").isin("NORMAL", "USER_STOPPED", "REMOTE_STOPPED")
    agg = sessions.groupBy("charger_id").agg(F.count("*").alias("sessions"), F.avg(failed.cast("double")).alias("failed_rate"), F.avg((F.coalesce(F.col("energy_delivered_kwh") <= 0.01, F.lit(False))).cast("double")).alias("empty_rate")).where("sessions >= 2")
    k = (F.col("failed_rate") > 0.3).cast("int") + (F.col("empty_rate") > 0.2).cast("int")
    agg = agg.withColumn("evidence", k).where("evidence > 0")
    return agg.select("charger_id", F.lit("SESSION_DEGRADATION").alias("category"), "sessions", F.round("failed_rate", 4).alias("failed_rate"), F.round("empty_rate", 4).alias("empty_rate"), F.round(F.least(F.lit(0.7), 0.3 + 0.2 * F.col("evidence")), 4).alias("confidence"))


def alarm_clusters(alarms: DataFrame, window_seconds: int = 3600, least: int = 3, by: str = "charger_id") -> DataFrame:
    """Greedy clusters of alarm starts: from an alarm all within the window; three or more are a cluster, and the next begins after it.

    Sorted alarms of a charger stream through one task with one window's alarms in memory.
    """

    def walk(frames):
        held, key = [], None

        def settle(out, until=None):
            while held and (until is None or (until - held[0][0]).total_seconds() > window_seconds):
                n = sum((t - held[0][0]).total_seconds() <= window_seconds for t, _ in held)
                if n >= least:
                    out.append((key, held[0][0], held[n - 1][0], n, len({c for _, c in held[:n]})))
                    del held[:n]
                else:
                    del held[0]

        for frame in frames:
            out = []
            for k, t, code in frame.itertuples(index=False):
                if k != key:
                    settle(out)
                    key = k
                settle(out, t)
                held.append((t, code))
            yield pd.DataFrame(out, columns=["k", "start_time", "end_time", "alarms", "codes"])
        out = []
        settle(out)
        yield pd.DataFrame(out, columns=["k", "start_time", "end_time", "alarms", "codes"])

    rows = alarms.select(F.col(by).cast("string").alias("k"), "start_time", F.col("code").cast("string").alias("code"))
    found = rows.repartition("k").sortWithinPartitions("k", "start_time", "code").mapInPandas(walk, "k string, start_time timestamp, end_time timestamp, alarms long, codes long")
    return found.select(F.col("k").alias(by), "start_time", "end_time", "alarms", "codes", _level(F.col("codes") >= 3, F.col("alarms") >= 2 * least).alias("level"), F.round(F.least(F.lit(0.8), 0.2 + 0.1 * F.col("alarms")), 4).alias("confidence"))


def dataset_charger_time(stats: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """One feature map a charger from its signals' statistics, and its gaps."""
    names = ("mean", "std", "min", "max", "p50", "missing_rate")
    pairs = F.flatten(F.collect_list(F.array(*(F.struct(F.concat("signal", F.lit(f"_{n}")).alias("k"), F.col(n).cast("double").alias("v")) for n in names))))
    out = stats.groupBy("charger_id").agg(F.map_from_entries(F.array_sort(pairs)).alias("features"))
    if gaps is None:
        return out.withColumn("gap_count", F.lit(0).cast("long"))
    return out.join(gaps.groupBy("charger_id").agg(F.count("*").alias("gap_count")), "charger_id", "left").fillna(0, ["gap_count"])


def dataset_session(sessions: DataFrame) -> DataFrame:
    """Features of each session: duration, energy, state of charge gained, energy a minute, quality by confidence and gap."""
    minutes = F.col("duration_seconds") / 60
    quality = cases([(F.col("has_gap"), 0.4), (F.col("confidence") == "HIGH", 1.0), (F.col("confidence") == "MEDIUM", 0.7)], 0.5)
    return sessions.select("charger_id", "connector_id", "session_id", "start_time", F.col("duration_seconds"), "energy_delivered_kwh", (F.col("end_soc") - F.col("start_soc")).alias("soc_delta"), F.round(F.try_divide("energy_delivered_kwh", minutes), 6).alias("kwh_per_minute"), quality.alias("quality"))


def dataset_event_centered(events: DataFrame, rows: DataFrame, signal: str, before: int = 3600, after: int = 3600, by: str = "charger_id") -> DataFrame:
    """Mean, least and greatest value of a signal around each event; events are dealt to the time buckets that they reach."""
    size = before + after
    cell = lambda c: F.floor(c / size)
    t = seconds(F.col("event_time"))
    e = events.select(by, F.col("event_time").alias("at"), seconds(F.col("event_time")).alias("_t")).withColumn("_b", F.explode(F.sequence(cell(F.col("_t") - before), cell(F.col("_t") + after))))
    p = rows.select(by, t.alias("_s"), F.col(signal).cast("double").alias("_v")).withColumn("_b", cell(F.col("_s")))
    hit = e.join(p, [by, "_b"]).where((F.col("_s") >= F.col("_t") - before) & (F.col("_s") <= F.col("_t") + after))
    return hit.groupBy(by, "at").agg(F.count("_v").alias("context"), F.round(F.avg("_v"), 6).alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"))


def readiness(summary: DataFrame) -> DataFrame:
    """summary (first, last, sessions, ..) with span_days, depth by the span, the blockers and READY, PARTIAL or NOT_READY."""
    span = F.coalesce((seconds(F.col("last")) - seconds(F.col("first"))) / 86_400, F.lit(0.0))
    summary = summary.withColumn("span_days", span)
    depth = cases([(F.col("span_days") > 30, "LONGITUDINAL"), (F.col("span_days") > 7, "MULTI_DAY")], "SINGLE_SNAPSHOT")
    summary = summary.withColumn("depth", depth)
    blockers = F.array_compact(F.array(F.when(F.col("depth") == "SINGLE_SNAPSHOT", "single snapshot"), F.when(F.col("sessions") == 0, "no sessions")))
    return summary.withColumn("blockers", blockers).withColumn("status", cases([(F.size("blockers") == 0, "READY"), (F.size("blockers") == 1, "PARTIAL")], "NOT_READY"))


def top_patterns(patterns: DataFrame, least: float = 0.0, k: int = 200) -> DataFrame:
    return patterns.where(F.col("confidence") >= least).orderBy(F.desc("confidence"), "charger_id", "category").limit(k)
