"""Read functions over the stored tables: filters in, a DataFrame out; names not asked for are not read.

`tables` maps a name to a DataFrame, to the path of a Parquet table, or to a path and its schema (a table that may
still be empty): observations, registry, coverage,
gaps, findings, files, frames, frame_rows, silver_<component>, sessions, alarms, faults, transitions, config_changes,
patterns, schema_fields, batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import events, fleet, frames, history, quality, research

# Which component's table has a signal, by the beginning of its name.
SIGNAL_TABLES = (("smr_", "smr"), ("rectifier_", "rectifier"), ("gun_", "connector"), ("connector_", "connector"), ("rsrp", "communication"), ("rssi", "communication"), ("snr", "communication"), ("session_", "session"), ("total_", "counters"), ("ems_", "counters"), ("alarm_", "alarm"), ("config_", "configuration"))


class Tables:
    """The stored tables of a deployment."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | str | tuple[str, str]]):
        self.spark, self._tables = spark, tables

    def __getitem__(self, name: str) -> DataFrame:
        found = self._tables[name]
        if isinstance(found, tuple):
            return self.spark.read.schema(found[1]).parquet(found[0])
        return self.spark.read.parquet(found) if isinstance(found, str) else found


def _of(t: Tables, name: str, start=None, end=None, time: str = "event_time", **wanted) -> DataFrame:
    return fleet.time_range(fleet.filtered(t[name], **wanted), start, end, time)


# history


def signal_table(signal: str, component: str | None = None) -> str:
    """The table that holds a signal."""
    return component or next((name for start, name in SIGNAL_TABLES if signal.startswith(start)), "charger")


def charger_history(t: Tables, charger_id: str, metrics: list[str] | None = None, start=None, end=None, after=None, size: int = 500) -> DataFrame:
    rows = _of(t, "observations", start, end, charger_id=charger_id)
    return fleet.keyset_page(history.whitelisted(rows, [c for c in rows.columns if c not in ("charger_id", "event_time", "frame_sequence")], metrics), size, after)


def component_history(t: Tables, component: str, charger_id: str, component_id=None, start=None, end=None, after=None, size: int = 500) -> DataFrame:
    return fleet.keyset_page(_of(t, f"silver_{component}", start, end, charger_id=charger_id, scope_id=component_id), size, after)


def signal_history(t: Tables, signal: str, charger_id: str, component: str | None = None, start=None, end=None) -> DataFrame:
    """(event_time, frame_sequence, value) of one signal; an unknown signal is an error."""
    rows = _of(t, f"silver_{signal_table(signal, component)}", start, end, charger_id=charger_id)
    if signal not in rows.columns:
        raise ValueError(f"unknown signal: {signal}")
    return rows.select("event_time", "frame_sequence", F.col(signal).alias("value")).orderBy("event_time", "frame_sequence")


def provenance_of(t: Tables, name: str, frame_ids: DataFrame) -> DataFrame:
    """The provenance of a field in some frames, by frame and component."""
    return t["provenance"].where(F.col("name") == name).join(frame_ids.select("frame_id"), "frame_id", "left_semi")


def history_summary(t: Tables, **wanted) -> DataFrame:
    return history.continuity(fleet.filtered(t["observations"], **wanted))


def history_gaps(t: Tables, **wanted) -> DataFrame:
    return history.history_gaps(fleet.filtered(t["observations"], **wanted)).orderBy("charger_id", "start_time")


def config_history(t: Tables, charger_id: str) -> DataFrame:
    return fleet.filtered(t["config_changes"], charger_id=charger_id).orderBy("event_time", "frame_sequence")


def signal_matrix(t: Tables, signals: list[str], **wanted) -> DataFrame:
    return history.signal_matrix(fleet.filtered(t["observations"], **wanted), signals)


def eligibility(t: Tables, **wanted) -> DataFrame:
    return history.continuity(fleet.filtered(t["observations"], **wanted))


# coverage and daily operations


def coverage(t: Tables, **wanted) -> DataFrame:
    """Days of coverage (charger_id, business_date, completeness, arrival), the worst first."""
    return fleet.worst_first(fleet.filtered(t["coverage"], **wanted), "sample_pct", "charger_id")


def coverage_of_site(t: Tables, site_code: str, **wanted) -> DataFrame:
    site = fleet.filtered(t["registry"], site_code=site_code).select("charger_id")
    return fleet.filtered(t["coverage"], **wanted).join(site, "charger_id", "left_semi")


def day_gaps(t: Tables, **wanted) -> DataFrame:
    """Gaps of days, the newest date and the longest first."""
    return fleet.filtered(t["gaps"], **wanted).orderBy(F.desc("business_date"), F.desc("duration_seconds"))


def expected_on(t: Tables, day) -> DataFrame:
    return fleet.expected_fleet(t["registry"], F.lit(day).cast("date"))


def reconciliation(t: Tables, day) -> DataFrame:
    """Expected and received chargers of a day with their coverage; days missing altogether are there with nothing."""
    got = t["coverage"].where(F.col("business_date") == F.lit(day).cast("date")).drop("arrival")
    zero = {c: 0 for c in ("unique_timestamps", "gap_count", "sample_pct") if c in got.columns}
    both = fleet.reconcile(expected_on(t, day), got, "charger_id", late="is_late" if "is_late" in got.columns else None)
    return both.fillna(zero).fillna({"completeness": "NO_DATA"}).withColumn("business_date", F.lit(day).cast("date"))


def daily_summary(t: Tables, day) -> DataFrame:
    return fleet.summary(reconciliation(t, day), "business_date")


def daily_metrics(t: Tables, value: str = "sample_pct") -> DataFrame:
    return fleet.daily_metrics(t["coverage"], "business_date", value)


def last_delivery(t: Tables, day) -> DataFrame:
    """Each charger's latest day with data before a day."""
    return fleet.last_before(t["coverage"].where("unique_timestamps > 0"), "charger_id", "business_date", F.lit(day).cast("date"))


def files(t: Tables, **wanted) -> DataFrame:
    return fleet.filtered(t["files"], **wanted).orderBy(F.desc("received_at"), "name")


def file_states(t: Tables) -> DataFrame:
    return t["files"].groupBy("state").agg(F.count("*").alias("n"))


def findings(t: Tables, page: int = 1, size: int = 100, **wanted) -> tuple[DataFrame, dict]:
    """Findings, the most severe first."""
    return fleet.offset_page(fleet.filtered(t["findings"], **wanted), page, size, quality.rank(F.col("severity")).desc(), F.col("code"), F.col("issue_hash"))


def finding_counts(t: Tables, by: str = "severity") -> DataFrame:
    if by == "severity":
        return fleet.zero_filled_counts(t["findings"], "severity", list(quality.SEVERITIES))
    return t["findings"].groupBy(by).agg(F.count("*").alias("n"))


def batch_outcomes(t: Tables) -> DataFrame:
    """Each upload batch's files by outcome (batch_id, outcome, state): every file in exactly one bucket, and the batch's status."""
    b = t["batches"]
    done = F.col("state").isin("COMPLETED", "DUPLICATE")
    agg = b.groupBy("batch_id").agg(
        F.count("*").alias("files"), F.count_if(F.col("outcome").startswith("REJECTED")).alias("rejected"), F.count_if(F.col("outcome").contains("DUPLICATE")).alias("duplicates"),
        F.count_if((F.col("outcome") == "REGISTERED") & done).alias("completed"), F.count_if((F.col("outcome") == "REGISTERED") & F.col("state").isin("FAILED", "QUARANTINED")).alias("failed"),
    )
    agg = agg.withColumn("pending", F.greatest(F.lit(0), F.col("files") - F.col("rejected") - F.col("duplicates") - F.col("completed") - F.col("failed")))
    status = F.when(F.col("pending") > 0, "PROCESSING").when(F.col("failed") + F.col("rejected") == 0, "COMPLETED").when(F.col("completed") + F.col("duplicates") == 0, "FAILED").otherwise("COMPLETED_WITH_ERRORS")
    return agg.withColumn("status", status)


def schema_fields(t: Tables, text: str | None = None, **wanted) -> DataFrame:
    return fleet.searched(fleet.filtered(t["schema_fields"], **wanted), text, "canonical_name", "source_name").orderBy("canonical_name")


def schema_breakdown(t: Tables, *columns: str) -> DataFrame:
    return quality.schema_breakdown(t["schema_fields"], *columns)


# frames


def frame_summary(t: Tables, *by: str, **wanted) -> DataFrame:
    return frames.summary(fleet.filtered(t["frames"], **wanted), *by)


def frame_collisions(t: Tables, **wanted) -> DataFrame:
    return frames.collisions(fleet.filtered(t["frames"], **wanted))


def frame_page(t: Tables, size: int = 100, after=None, **wanted) -> DataFrame:
    return fleet.keyset_page(fleet.filtered(t["frames"], **wanted), size, after)


def frame_diff(t: Tables, left: str, right: str) -> DataFrame:
    rows = t["frame_rows"]
    return frames.diff(rows.where(F.col("frame_id") == left), rows.where(F.col("frame_id") == right))


def latest_silver(t: Tables, component: str, **wanted) -> DataFrame:
    """The latest record of each charger's component."""
    return fleet.latest_per_entity(fleet.filtered(t[f"silver_{component}"], **wanted), "charger_id", "event_time", "frame_sequence")


# events


def sessions(t: Tables, start=None, end=None, **wanted) -> DataFrame:
    return _of(t, "sessions", start, end, "start_time", **wanted).orderBy("start_time")


def alarms(t: Tables, start=None, end=None, **wanted) -> DataFrame:
    return _of(t, "alarms", start, end, "start_time", **wanted).orderBy("start_time")


def open_alarms(t: Tables, **wanted) -> DataFrame:
    return fleet.filtered(t["alarms"], **wanted).where("end_time is null")


def transitions(t: Tables, start=None, end=None, **wanted) -> DataFrame:
    return _of(t, "transitions", start, end, **wanted).orderBy("event_time", "frame_sequence")


def timeline(t: Tables, charger_id: str, start=None, end=None, limit: int = 100) -> DataFrame:
    """Sessions, alarms, faults and configuration changes of a charger by time."""
    kinds = {}
    for name, time, title in (("sessions", "start_time", F.concat(F.lit("Session "), F.coalesce("session_id", F.lit("without id")))), ("alarms", "start_time", F.concat(F.lit("Alarm "), "code")), ("faults", "start_time", F.concat(F.lit("Fault "), "code")), ("config_changes", "event_time", F.lit("Configuration changed"))):
        rows = _of(t, name, start, end, time, charger_id=charger_id)
        kinds[name] = rows.select(F.col(time).alias("event_time"), title.alias("title"))
    return events.timeline(limit, **kinds)


# research


def signal_statistics(t: Tables, signals: list[str], by_charger: bool = False, limit: int | None = None, **wanted) -> DataFrame:
    rows = fleet.filtered(t["observations"], **wanted)
    if limit:
        rows = rows.orderBy("event_time", "frame_sequence").limit(limit)
    return research.signal_statistics(rows, signals, ["charger_id"] if by_charger else None)


def correlations(t: Tables, signals: list[str], **wanted) -> DataFrame:
    return research.correlation_matrix(fleet.filtered(t["observations"], **wanted), signals)


def telemetry_with_events(t: Tables, signals: list[str], start=None, end=None, **wanted) -> DataFrame:
    points = _of(t, "observations", start, end, **wanted).select("charger_id", "event_time", "frame_sequence", *signals)
    return research.telemetry_with_events(points, t["sessions"], t["alarms"], t["faults"])


def patterns(t: Tables, least: float = 0.0, k: int = 200, **wanted) -> DataFrame:
    return research.top_patterns(fleet.filtered(t["patterns"], **wanted), least, k)


def pattern_breakdown(t: Tables) -> DataFrame:
    return t["patterns"].groupBy("category", "level").agg(F.count("*").alias("n"))


def readiness(t: Tables) -> DataFrame:
    span = t["observations"].agg(F.min("event_time").alias("first"), F.max("event_time").alias("last"), F.count_distinct("charger_id").alias("chargers"))
    return research.readiness(span.withColumn("sessions", F.lit(t["sessions"].count())))
