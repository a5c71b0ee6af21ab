"""Discrete events from observations: state transitions, configuration changes, alarm and fault intervals, sessions, timeline."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import NO_SESSION, alarm_active, cases, is_active_state, map_state, seconds, termination
from gridloom.operators import history
from gridloom.operators.intervals import points_in

SESSION_SCHEMA = (
    "charger_id string, connector_id string, session_id string, start_time timestamp, charging_start_time timestamp, charging_end_time timestamp, end_time timestamp, "
    "duration_seconds double, energy_delivered_kwh double, start_soc double, end_soc double, stop_reason string, last_status string, start_meter double, end_meter double, "
    "max_energy double, reported_seconds double, observations long"
)


def _window(by: list[str]):
    return Window.partitionBy(*by).orderBy("event_time", "frame_sequence")


def state_transitions(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Changes of a trimmed state to a value that is there; a null in between counts as a state of its own."""
    w = _window(by)
    rows = rows.withColumn("to_state", F.trim(F.col(value).cast("string")))
    rows = rows.withColumn("from_state", F.lag("to_state").over(w)).withColumn("_n", F.row_number().over(w))
    return rows.where((F.col("_n") > 1) & F.col("to_state").isNotNull() & ~F.col("to_state").eqNullSafe(F.col("from_state"))).select(*by, "event_time", "frame_sequence", "from_state", "to_state")


def config_changes(rows: DataFrame, config: str, by: list[str]) -> DataFrame:
    """Snapshots (a map column) that differ from the one before: changes is a map of key to struct(old, new)."""
    w = _window(by)
    rows = rows.withColumn("_old", F.lag(config).over(w)).withColumn("_n", F.row_number().over(w)).where("_n > 1")
    both = F.map_zip_with("_old", config, lambda k, a, b: F.struct(a.alias("old"), b.alias("new")))
    changed = F.map_filter(both, lambda k, v: ~v.old.eqNullSafe(v.new))
    return rows.withColumn("changes", changed).where(F.size("changes") > 0).select(*by, "event_time", "frame_sequence", "changes")


def config_hash(config) -> object:
    """SHA-256 of a map's pairs in the order of keys, nulls left out."""
    pairs = F.array_sort(F.map_entries(F.map_filter(config, lambda k, v: v.isNotNull())))
    return F.sha2(F.to_json(pairs), 256)


def active_intervals(rows: DataFrame, active: str, by: list[str], debounce_seconds: float = 0.0, gaps: DataFrame | None = None, gap_by: list[str] | None = None, state: str | None = None) -> DataFrame:
    """Runs of active rows: from the first to the next inactive row; open (end null, lasting to the last active row) without one.

    `state` is a column whose values at both ends become start_state and end_state (of open runs that of the last active
    row); first_sequence and last_sequence are the frames at the ends.

    Closed runs that are at most debounce_seconds apart become one. `gaps` (gap_by or by columns, gap_start, gap_end)
    lowers the confidence of intervals that they overlap; of an open one the part up to its last active row counts.
    """
    return flagged_intervals(active_runs(rows, active, by, debounce_seconds, state), gaps, gap_by or by)


def active_runs(rows: DataFrame, active: str, by: list[str], debounce_seconds: float = 0.0, state: str | None = None) -> DataFrame:
    """active_intervals() without what gaps say about them."""
    w = _window(by)
    on = F.coalesce(F.col(active), F.lit(False))
    rows = rows.select(*by, "event_time", "frame_sequence", on.alias("on"), (F.col(state) if state else F.lit(None)).cast("string").alias("_state"))
    rows = rows.withColumn("_change", (F.col("on") != F.coalesce(F.lag("on").over(w), ~F.col("on"))).cast("int"))
    rows = rows.withColumn("_island", F.sum("_change").over(w)).withColumn("_next", F.lead("event_time").over(w))
    at, own = "struct(event_time, frame_sequence)", []
    if state:
        rows = rows.withColumn("_after", F.lead(F.struct("_state", "frame_sequence")).over(w))
        ends = "max_by(coalesce(_after, struct(_state, frame_sequence)), struct(event_time, frame_sequence))"
        own = [F.expr(f"min_by(_state, {at})").alias("start_state"), F.expr(f"{ends}._state").alias("end_state"), F.expr(f"min_by(frame_sequence, {at})").alias("first_sequence"), F.expr(f"{ends}.frame_sequence").alias("last_sequence")]
    runs = rows.where("on").groupBy(*by, "_island").agg(F.min("event_time").alias("start_time"), F.max("event_time").alias("last_active"), F.count("*").alias("observations"), F.expr(f"max_by(_next, {at})").alias("end_time"), *own)
    if debounce_seconds > 0:
        u = Window.partitionBy(*by).orderBy("start_time", "_island")
        apart = seconds(F.col("start_time")) - seconds(F.lag("end_time").over(u))
        runs = runs.withColumn("_new", F.coalesce((apart > debounce_seconds).cast("int"), F.lit(1))).withColumn("_g", F.sum("_new").over(u))
        runs = runs.groupBy(*by, "_g").agg(F.min("start_time").alias("start_time"), F.max("last_active").alias("last_active"), F.sum("observations").alias("observations"), F.expr("max_by(end_time, _island)").alias("end_time"), *(F.expr(f"{'min_by' if c in ('start_state', 'first_sequence') else 'max_by'}({c}, _island)").alias(c) for c in ("start_state", "end_state", "first_sequence", "last_sequence") if state))
    return runs.withColumn("duration_seconds", seconds(F.coalesce("end_time", "last_active")) - seconds(F.col("start_time"))).drop("_island", "_g")


def flagged_intervals(runs: DataFrame, gaps: DataFrame | None, by: list[str]) -> DataFrame:
    """active_runs() with has_gap, confidence and quality flags; without gaps none is met."""
    if gaps is not None:
        lasting = with_gap_flag(runs.withColumn("_end", F.col("end_time")).withColumn("end_time", F.coalesce("end_time", "last_active")), gaps, by)
        runs = lasting.withColumn("end_time", F.col("_end")).drop("_end")
    else:
        runs = runs.withColumn("has_gap", F.lit(False))
    flags = F.array_compact(F.array(F.when(F.col("end_time").isNull(), "ALARM_OPEN_ENDED"), F.when(F.col("has_gap"), "EVENT_HAS_GAP")))
    return runs.withColumn("confidence", F.when(F.col("end_time").isNull() | F.col("has_gap"), "MEDIUM").otherwise("HIGH")).withColumn("quality_flags", flags)


def fault_intervals(rows: DataFrame, active: str, by: list[str], gaps: DataFrame | None = None, gap_by: list[str] | None = None, state: str | None = None) -> DataFrame:
    """Active intervals of faults, all critical."""
    return active_intervals(rows, active, by, 0.0, gaps, gap_by, state).withColumn("severity", F.lit("CRITICAL"))


def with_gap_flag(intervals: DataFrame, gaps: DataFrame, by: list[str], bucket_seconds: int = 21_600) -> DataFrame:
    """intervals (start_time, end_time or null) with has_gap: some gap overlaps them strictly; open ones meet any gap that ends later.

    Two intervals overlap where one holds the other's start: two joins by time nodes, see intervals.points_in().
    """
    rows = intervals.withColumn("_id", F.xxhash64(*by, "start_time", F.coalesce(F.col("end_time"), F.lit(0).cast("timestamp"))))
    last = gaps.groupBy(*by).agg(F.max("gap_end").alias("_last"))
    rows = rows.join(last, by, "left").withColumn("_to", F.greatest("start_time", F.coalesce("end_time", "_last", "start_time")))
    own, g = rows.select(*by, "_id", "start_time", "end_time", "_to").distinct(), gaps.select(*by, "gap_start", "gap_end").distinct()
    starts_in_gap = points_in(own, g, by, "start_time", "gap_start", "gap_end", bucket_seconds)
    gap_starts_in = points_in(g, own, by, "gap_start", "start_time", "_to", bucket_seconds)
    meets = (F.col("end_time").isNull() & (F.col("gap_end") >= F.col("start_time"))) | (F.col("end_time").isNotNull() & ~((F.col("gap_end") <= F.col("start_time")) | (F.col("gap_start") >= F.col("end_time"))))
    hit = starts_in_gap.unionByName(gap_starts_in).where(meets).select(*by, "_id").distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, [*by, "_id"], "left").withColumn("has_gap", F.coalesce("_hit", F.lit(False))).drop("_id", "_hit", "_last", "_to")


class _Session:
    """What is known of the session in progress; one at a time is held while sorted rows stream by."""

    def __init__(self, r):
        self.id, self.n = r.sid, 0
        self.start = r.begin_time if pd.notna(r.begin_time) else r.event_time
        self.first = self.last = None
        self.soc = self.soc_end = self.energy = self.meter = self.meter_end = self.reason = self.reported = None
        self.see(r)
        if not self.soc_end:  # 0 counts as not reported on the opening row
            self.soc_end = self.soc

    def see(self, r):
        self.n += 1
        self.id = self.id or r.sid
        if r.charging:
            self.first = self.first if self.first is not None else r.event_time
            self.last = r.event_time
        self.soc = _known(self.soc, r.start_soc)
        self.soc_end = _known(r.stop_soc, self.soc_end)
        if pd.notna(r.session_consumed_energy):
            self.energy = r.session_consumed_energy if self.energy is None else max(self.energy, r.session_consumed_energy)
        self.meter = _known(self.meter, r.meter_energy)
        self.meter_end = _known(r.meter_energy, self.meter_end)
        self.reason = r.stop_reason if isinstance(r.stop_reason, str) else self.reason
        self.reported = _known(r.reported_charging_time, self.reported)

    def closed(self, r) -> tuple:
        delta = None if self.meter is None or self.meter_end is None else self.meter_end - self.meter
        energy = self.energy if self.energy is not None else delta if delta is not None and delta >= 0 else None
        return (r.charger_id, r.connector_id, self.id, self.start, self.first, self.last, r.event_time, max((r.event_time - self.start).total_seconds(), 0.0), energy, self.soc, self.soc_end, self.reason, r.connector_status, self.meter, self.meter_end, self.energy, self.reported, self.n)


def _known(a, b):
    return a if a is not None and not pd.isna(a) else None if b is None or pd.isna(b) else float(b)


def session_step(now: _Session | None, r) -> tuple[_Session | None, list[tuple]]:
    """The session in progress after a row of a connector, and the sessions that the row closes."""
    out = []
    if now and r.sid and now.id and r.sid != now.id:
        out.append(now.closed(r))
        now = None
    if now is None:
        if r.active or r.sid or r.delivering:
            now = _Session(r)
    else:
        now.see(r)
        if r.state in ("IDLE", "COMPLETED") or (now.reason and not r.active and not r.delivering):
            out.append(now.closed(r))
            now = None
    return now, out


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in SESSION_SCHEMA.split(", ")]
    now, before = None, None
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            if before is not None and (r.charger_id, r.connector_id) != (before.charger_id, before.connector_id):
                if now:
                    out.append(now.closed(before))
                now = None
            now, done = session_step(now, r)
            out += done
            before = r
        yield pd.DataFrame(out, columns=names)
    if now:
        yield pd.DataFrame([now.closed(before)], columns=names)


def session_rows(rows: DataFrame) -> DataFrame:
    """Observations with what the session machine reads, columns that aren't there as nulls; see sessions()."""
    optional = {"begin_time": "timestamp", "session_consumed_energy": "double", "session_output_current": "double", "start_soc": "double", "stop_soc": "double", "stop_reason": "string", "reported_charging_time": "double", "meter_energy": "double"}
    for c, kind in optional.items():
        rows = rows.withColumn(c, F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind))
    sid = F.trim(F.col("session_id").cast("string"))
    rows = rows.withColumn("state", map_state(F.col("connector_status"))).withColumn("sid", F.when(~sid.isin(list(NO_SESSION)) & (sid != ""), sid))
    rows = rows.withColumn("active", is_active_state(F.col("state"))).withColumn("delivering", F.coalesce(F.col("session_output_current") > 0.5, F.lit(False)))
    rows = rows.withColumn("charging", (F.col("state") == "CHARGING") | F.col("delivering"))
    keep = ["charger_id", "connector_id", "event_time", "frame_sequence", "connector_status", "state", "sid", "active", "delivering", "charging", *optional]
    return rows.withColumns({"charger_id": F.col("charger_id").cast("string"), "connector_id": F.col("connector_id").cast("string")}).select(keep)


def sessions(rows: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """Charging sessions of each connector, from observations in time order.

    The rows of a connector stream through one task sorted, with one session in memory; classification, flags and
    confidence are columns. rows: charger_id, connector_id, event_time, frame_sequence, connector_status, session_id
    and, where known, begin_time, session_consumed_energy, session_output_current, start_soc, stop_soc, stop_reason,
    reported_charging_time, meter_energy.
    """
    return flagged_sessions(walked_sessions(rows), gaps)


def walked_sessions(rows: DataFrame) -> DataFrame:
    """sessions() as the machine leaves them, without what gaps say and without their class."""
    placed = session_rows(rows).repartition("charger_id", "connector_id").sortWithinPartitions("charger_id", "connector_id", "event_time", "frame_sequence")
    return placed.mapInPandas(_walk, SESSION_SCHEMA)


def flagged_sessions(found: DataFrame, gaps: DataFrame | None) -> DataFrame:
    """walked_sessions() with has_gap and their class, flags and confidence; without gaps none is met."""
    return graded_sessions(with_gap_flag(found, gaps, ["charger_id"]) if gaps is not None else found.withColumn("has_gap", F.lit(False)))


def graded_sessions(found: DataFrame) -> DataFrame:
    """Sessions as they were walked, with has_gap, and their termination, flags and confidence."""
    missing = F.col("session_id").isNull()
    inferred = F.col("stop_reason").isNull() | (F.col("stop_reason") == "")
    delta = F.col("end_meter") - F.col("start_meter")
    flags = [
        (F.col("has_gap"), "EVENT_HAS_GAP"), (missing, "SESSION_ID_MISSING"), (inferred, "SESSION_BOUNDARY_INFERRED"),
        (F.abs(delta - F.col("max_energy")) > 0.5, "SESSION_ENERGY_MISMATCH"), (F.abs(F.col("duration_seconds") - F.col("reported_seconds")) > 60, "SESSION_DURATION_MISMATCH"),
    ]
    high = ~F.col("has_gap") & ~missing & ~inferred & F.col("charging_start_time").isNotNull()
    return (
        found.withColumn("termination_class", termination(F.col("stop_reason"), map_state(F.col("last_status"))))
        .withColumn("quality_flags", F.array_compact(F.array(*(F.when(c, f) for c, f in flags))))
        .withColumn("confidence", cases([(high, "HIGH"), (F.col("has_gap") | missing, "LOW")], "MEDIUM"))
    )


def with_session_fields(connectors: DataFrame, sessions: DataFrame) -> DataFrame:
    """Connector observations with the session record of the same charger, connector, stamp and sequence, where there is one."""
    keys = ["charger_id", "connector_id", "event_time", "frame_sequence"]
    own = [c for c in sessions.columns if c not in keys and c not in connectors.columns]
    return connectors.join(sessions.select(*keys, *own), keys, "left")


def timeline(limit: int, **events: DataFrame) -> DataFrame:
    """The first rows by time of several kinds of events: (event_time, kind, title, details); ties in the order given."""
    parts = [df.select(F.col("event_time"), F.lit(k).alias("kind"), F.lit(i).alias("_r"), F.col("title").cast("string").alias("title")).orderBy("event_time", "title").limit(limit) for i, (k, df) in enumerate(events.items())]
    return reduce(DataFrame.unionByName, parts).orderBy("event_time", "_r", "title").limit(limit).drop("_r")


def timeline_gaps(rows: DataFrame, by: str = "charger_id") -> DataFrame:
    """(charger_id, gap_start, gap_end): where each charger's timeline has a gap, over all its observations."""
    found = history.history_gaps(rows.select(by, "event_time", "frame_sequence").where("event_time is not null"), by)
    return found.select(by, F.col("start_time").alias("gap_start"), F.col("end_time").alias("gap_end"))


def reconstruct(rows: DataFrame, alarms: list[str] | dict[str, str], faults: list[str], gaps: DataFrame | None = None, config: str | None = None) -> dict[str, DataFrame]:
    """All event tables of a set of chargers from one table of observations.

    Gaps of the chargers' timelines, found in the observations where none are given, mark the events that they overlap.
    `config` names a map column of settings, whose changes become a table too. `alarms` may give each code its severity.
    """
    gaps = timeline_gaps(rows) if gaps is None else gaps
    return flagged_events(found_events(rows, list(alarms), faults, config), gaps, alarms)


def found_events(rows: DataFrame, alarms: list[str], faults: list[str], config: str | None = None) -> dict[str, DataFrame]:
    """reconstruct() without what gaps say about the events, so that the rows of a stretch of time give its events."""

    def long(fields: list[str]) -> DataFrame:
        some = [f for f in fields if f in rows.columns]
        if not some:
            return rows.where("false").select("charger_id", "event_time", "frame_sequence", F.lit("").alias("code"), F.lit("").alias("raw"), F.lit(False).alias("active"))
        wide = rows.select("charger_id", "event_time", "frame_sequence", *(F.col(f).cast("string").alias(f) for f in some))
        return wide.unpivot(["charger_id", "event_time", "frame_sequence"], some, "code", "raw").withColumn("active", alarm_active(F.col("raw")))

    by = ["charger_id", "code"]
    return {
        "sessions": walked_sessions(rows),
        "alarms": active_runs(long(alarms), "active", by, 0.0, "raw"),
        "faults": active_runs(long(faults), "active", by, 0.0, "raw"),
        "transitions": state_transitions(rows.where("trim(connector_status) <> ''"), "connector_status", ["charger_id", "connector_id"]),
    } | ({"config_changes": config_changes(rows.where(F.size(config) > 0), config, ["charger_id"])} if config else {})


def flagged_events(found: dict[str, DataFrame], gaps: DataFrame, alarms: list[str] | dict[str, str]) -> dict[str, DataFrame]:
    """found_events() with what the chargers' gaps (charger_id, gap_start, gap_end) say about them, and severities."""
    by = ["charger_id"]
    severity = cases([(F.col("code") == c, s) for c, s in alarms.items()], "MAJOR") if isinstance(alarms, dict) else F.lit("MAJOR")
    return found | {
        "sessions": flagged_sessions(found["sessions"], gaps),
        "alarms": flagged_intervals(found["alarms"], gaps, by).withColumn("severity", severity),
        "faults": flagged_intervals(found["faults"], gaps, by).withColumn("severity", F.lit("CRITICAL")),
    }
