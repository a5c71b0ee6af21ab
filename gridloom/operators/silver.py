"""Typed records from raw frames: one value a field and scope, conflicts, sentinels and provenance kept."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import cases, coerce_boolean, coerce_float, coerce_integer, coerce_string, coerce_timestamp, is_missing, is_sentinel
from gridloom.operators.events import config_hash
from gridloom.session import dealt, tasks_for

# Sentinels masked by field family, words of an active alarm.
MASKS = {"gun": (999.0,), "rectifier": (-50.0,), "smr": (-150.0,)}
ACTIVE_WORDS = ("alarm", "trip", "active", "1", "true")
RECORDED_CONFLICTS = ("charger", "communication", "alarm", "connector", "rectifier", "smr", "session", "contactor")
TIME_FORMATS = ("dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy HH:mm:ss")


@dataclass(frozen=True)
class FieldSpec:
    """A field of the dictionary: its column, type, scope (whole frame or a component's id column) and sentinels."""

    name: str
    kind: str = "STRING"
    scope: str | None = None
    family: str = "charger"
    sentinels: tuple[float, ...] = field(default=())


def coerced(c: Column, kind: str, zone: str = "Asia/Kolkata") -> Column:
    """A raw cell as its type; null where it doesn't fit."""
    if kind == "FLOAT":
        return coerce_float(c)
    if kind in ("INTEGER", "DURATION"):
        return coerce_integer(c)
    if kind == "BOOLEAN":
        return coerce_boolean(c)
    if kind == "DATETIME":
        return coerce_timestamp(c, TIME_FORMATS, zone)
    return coerce_string(c)


def resolved_long(rows: DataFrame, specs: list[FieldSpec], frame: str = "frame_id") -> DataFrame:
    """(frame, scope_id, name, raw_value, distinct_values, has_conflict, is_sentinel, conflict_values): provenance, one row a field and scope.

    No value is null; one is the value; more are a conflict, whose raw value is the least and whose result is null.
    A missing component id counts as component 1.
    """
    scopes = {s.scope for s in specs}
    parts = []
    for scope in sorted(scopes, key=str):
        own = [s for s in specs if s.scope == scope]
        sid = F.lit(None).cast("string") if scope is None else F.when(is_missing(F.col(scope).cast("string")) | (F.col(scope).cast("string").try_cast("double") == 0), F.lit("1")).otherwise(F.regexp_replace(F.trim(F.col(scope).cast("string")), r"\.0$", ""))
        wide = rows.select(frame, sid.alias("scope_id"), *(F.col(s.name).cast("string").alias(s.name) for s in own))
        parts.append(wide.unpivot([frame, "scope_id"], [s.name for s in own], "name", "raw"))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    # a frame's cells are few; dealt once they are cells, so that the aggregates from here to silver_table() stay where they are
    long = dealt(long, tasks_for(rows.sparkSession, rows.count() * len(specs)), frame)
    text = F.when(~is_missing(F.col("raw")), F.trim("raw"))
    long = long.withColumn("raw", text)
    once = long.groupBy(frame, "scope_id", "name", "raw").agg(F.lit(1).alias("_"))
    agg = once.groupBy(frame, "scope_id", "name").agg(F.array_sort(F.collect_list("raw")).alias("v"))
    masks = {s.name: s.sentinels or MASKS.get(s.family, ()) for s in specs}
    sentinel = F.lit(False)
    for name, own in masks.items():
        if own:
            sentinel = sentinel | ((F.col("name") == name) & F.coalesce(is_sentinel(F.get("v", F.lit(0)).try_cast("double"), own), F.lit(False)))
    n = F.size("v")
    return agg.select(frame, "scope_id", "name", F.get("v", F.lit(0)).alias("raw_value"), n.cast("long").alias("distinct_values"), (n > 1).alias("has_conflict"), ((n == 1) & sentinel).alias("is_sentinel"), F.when(n > 1, F.array_join("v", "|")).alias("conflict_values"))


def silver_table(provenance: DataFrame, specs: list[FieldSpec], frame: str = "frame_id", zone: str = "Asia/Kolkata", raw: bool = False) -> DataFrame:
    """One typed row a frame and scope: each field's value, and NAME_masked where a sentinel was taken out; with `raw`
    also NAME_raw, the number that was there.

    One aggregation over the long form; a field is a conditional maximum, so no row is shuffled twice.
    """
    good = ~F.col("has_conflict") & ~F.col("is_sentinel")
    cols = []
    for s in specs:
        value = F.max(F.when((F.col("name") == s.name) & good, F.col("raw_value")))
        cols.append(coerced(value, s.kind, zone).alias(s.name))
        if s.sentinels or s.family in MASKS:
            if raw:
                cols.append(F.max(F.when(F.col("name") == s.name, F.col("raw_value"))).try_cast("double").alias(f"{s.name}_raw"))
            cols.append(F.coalesce(F.bool_or((F.col("name") == s.name) & F.col("is_sentinel")), F.lit(False)).alias(f"{s.name}_masked"))
    return provenance.where(F.col("name").isin([s.name for s in specs])).groupBy(frame, "scope_id").agg(*cols)


#: Tables by field family, and the column that names the component of those that have one row a component.
TABLES = {
    "site": "site_metadata", "charger": "charger_telemetry", "connector": "connector_telemetry", "rectifier": "rectifier_telemetry", "smr": "smr_telemetry", "contactor": "contactor_observation",
    "alarm": "alarm_observation", "session": "session_observation", "lifecycle": "lifecycle_counter_observation", "communication": "communication_observation", "configuration": "configuration_snapshot",
}
SCOPES = {"connector": "connector_no", "session": "connector_no", "rectifier": "rectifier_number", "smr": "smr_no"}
STOP_REASONS = ("last_charge_session_stop_reason", "last_charge_session_stop_reason_secondary")


#: Tables that others are made of: the head of each frame, and the provenance.
KEPT = ("frame_heads", "observation_provenance")


def build_tables(rows: DataFrame, specs: list[FieldSpec], zone: str = "Asia/Kolkata", kept=lambda table, name: table) -> dict[str, DataFrame]:
    """The eleven typed tables by name, `observation_provenance` and `quality_findings`, from rows of frames.

    rows: frame_id, charger_id, event_time, frame_sequence, the scopes' columns and those of the specs. A table has a row
    for each frame (or component in it); alarms have the codes that are active, sessions their stop reason, and a
    configuration its hash and all its settings. `kept` may write the tables of KEPT when they are made, so that the
    cells are taken apart once and not for each table.
    """
    heads = rows.groupBy("frame_id").agg(*(F.first(c).alias(c) for c in ("charger_id", "event_time", "frame_sequence")))
    provenance = resolved_long(rows, specs).withColumn("family", cases([(F.col("name") == s.name, s.family) for s in specs], "charger"))
    provenance = provenance.withColumn("table_name", cases([(F.col("family") == f, t) for f, t in TABLES.items()], "charger_telemetry"))
    heads, provenance = kept(heads, KEPT[0]), kept(provenance, KEPT[1])
    out = {}
    for family, name in TABLES.items():
        own = [s for s in specs if (s.family if s.family in TABLES else "charger") == family]
        some = provenance.where(F.col("table_name") == name)
        table = heads if not own else heads.join(silver_table(some, own, "frame_id", zone, raw=True), "frame_id", "left")
        if own and family not in SCOPES:
            table = table.drop("scope_id")
        if family == "alarm":
            codes = some.where(F.lower("raw_value").isin(list(ACTIVE_WORDS))).groupBy("frame_id").agg(F.array_sort(F.collect_set("name")).alias("active_alarm_codes"))
            table = table.join(codes, "frame_id", "left").withColumn("active_alarms_count", F.coalesce(F.size("active_alarm_codes"), F.lit(0)))
        if family == "session":
            there = [F.col(c).cast("string") for c in reversed(STOP_REASONS) if c in table.columns]
            table = table.withColumn("stop_reason", F.coalesce(*there) if there else F.lit(None).cast("string"))
        if family == "configuration":
            settings = F.create_map(*(x for s in own for x in (F.lit(s.name), F.col(s.name).cast("string")))) if own else F.create_map().cast("map<string,string>")
            table = table.withColumn("config_hash", config_hash(settings)).withColumn("raw_config", settings)
        out[name] = table
    return out | {"observation_provenance": provenance.drop("family"), "quality_findings": findings(provenance)}


def findings(provenance: DataFrame, frame: str = "frame_id") -> DataFrame:
    """A finding for each conflict and sentinel, named by a hash of rule and place."""
    code = F.when(F.col("has_conflict"), "CONFLICTING_VALUES").when(F.col("is_sentinel"), "SENTINEL_MASKED")
    rows = provenance.withColumn("code", code).where("code is not null")
    return rows.select("code", frame, "scope_id", "name", F.sha2(F.concat_ws("\x1f", "code", F.col(frame).cast("string"), F.coalesce("scope_id", F.lit("")), "name"), 256).alias("issue_hash"), F.coalesce("conflict_values", "raw_value").alias("details"))


def active_alarms(rows: DataFrame, fields: list[str], frame: str = "frame_id") -> DataFrame:
    """(frame, active_alarms): names of the alarm columns that are active."""
    names = F.array_compact(F.array(*(F.when(F.lower(F.trim(F.col(f).cast("string"))).isin(list(ACTIVE_WORDS)), F.lit(f)) for f in fields)))
    return rows.select(frame, F.array_sort(names).alias("active_alarms"))


def aggregate_by_dictionary(rows: DataFrame, strategies: dict[str, str], by: list[str], time: str = "event_time", seq: str = "frame_sequence") -> DataFrame:
    """One row a group: each field by the strategy that the dictionary gives it."""
    at = F.struct(time, seq)

    def one(name: str, how: str) -> Column:
        c = F.col(name)
        v = c.cast("double")
        there = F.when(c.isNotNull(), at)
        return {
            "FIRST": lambda: F.min_by(c, there), "LAST": lambda: F.max_by(c, there), "MIN": lambda: F.min(c), "MAX": lambda: F.max(c), "MEAN": lambda: F.avg(v), "MEDIAN": lambda: F.median(v),
            "SUM": lambda: F.sum(v), "MODE": lambda: F.mode(c, True), "ANY_TRUE": lambda: F.bool_or(c.cast("boolean")), "COUNT_DISTINCT": lambda: F.count_distinct(c),
        }[how]().alias(name)

    return rows.groupBy(*by).agg(*(one(n, how) for n, how in strategies.items() if how != "NONE"))
