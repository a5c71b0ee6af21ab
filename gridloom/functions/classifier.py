"""Definitions for header fields that no dictionary knows, inferred from their names alone, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import cases

# Fixed values of the data contract: words of a lower-cased name and what they tell; the first line that fits counts.
ENTITIES = (
    ("ALARM", ("alarm", "fault", "trip", "error code")),
    ("SMR", ("smr", "rectifier")),
    ("SESSION", ("session", "transaction", "charge session")),
    ("CONNECTOR", ("connector", "gun", "plug", "socket")),
    ("SITE", ("site", "station")),
    ("CONFIGURATION", ("config", "setting", "parameter", "threshold", "limit")),
    ("CHARGER", ("charger", "cabinet", "grid", "meter", "contactor", "fan", "cooling")),
)
CATEGORIES = (
    ("INSULATION", ("insulation", "isolation")),
    ("THERMAL", ("temp", "thermal")),
    ("OCPP", ("ocpp",)),
    ("CCS", ("ccs",)),
    ("CCU", ("ccu",)),
    ("PLC", ("plc",)),
    ("CAN", ("can bus", "canbus", "can ")),
    ("ALARM", ("alarm",)),
    ("FAULT", ("fault", "trip", "error")),
    ("CONTACTOR", ("contactor", "relay")),
    ("FAN", ("fan",)),
    ("COOLING", ("cooling", "coolant", "pump")),
    ("METER", ("meter",)),
    ("BATTERY", ("battery", "soc", "vehicle")),
    ("GUN", ("gun", "plug", "socket")),
    ("FIRMWARE", ("firmware", "software version")),
    ("HARDWARE", ("hardware", "board", "pcb")),
    ("COUNTER", ("counter", "total", "cumulative", "lifetime")),
    ("SESSION", ("session", "transaction")),
    ("SMR", ("smr", "rectifier", "module")),
    ("CONNECTOR", ("connector",)),
    ("ELECTRICAL_INPUT", ("grid", "input", "mains", "supply")),
    ("ELECTRICAL_OUTPUT", ("output", "dc ")),
    ("COMMUNICATION", ("signal", "network", "modem", "sim", "gsm")),
    ("STATE_MACHINE", ("state", "status", "mode")),
    ("IDENTITY", ("id", "serial", "identity")),
)
CLASSES = (
    ("ALARM_FLAG", ("alarm",)),
    ("FAULT_CODE", ("fault code", "error code", "reason code")),
    ("TIMESTAMP", ("time", "date", "timestamp")),
    ("COUNTER", ("counter", "total", "cumulative", "lifetime", "uptime")),
    ("STATE", ("status", "state", "mode", "flag")),
    ("IDENTIFIER", ("id", "serial", "identity")),
    ("CONFIGURATION", ("config", "setting", "parameter", "threshold", "limit")),
    ("CONTINUOUS_TELEMETRY", ("temp", "voltage", "current", "power", "energy", "frequency", "resistance", "speed")),
)
UNITS = (
    (("°C", "FLOAT"), ("temperature", "temp")),
    (("V", "FLOAT"), ("voltage", "volt")),
    (("A", "FLOAT"), ("current", "ampere", "amp")),
    (("Hz", "FLOAT"), ("frequency",)),
    (("kWh", "FLOAT"), ("energy", "kwh")),
    (("kW", "FLOAT"), ("power",)),
    (("kOhm", "FLOAT"), ("resistance", "insulation")),
    (("percent", "FLOAT"), ("percentage", "percent", "soc")),
    (("seconds", "DURATION"), ("duration", "elapsed", "uptime", "seconds")),
    (("rpm", "INTEGER"), ("speed", "rpm")),
    (("count", "INTEGER"), ("counter", "count")),
)
TYPES = {"TIMESTAMP": "DATETIME", "IDENTIFIER": "IDENTIFIER", "STATE": "ENUM", "ALARM_FLAG": "ENUM"}
AGGREGATIONS = {"CONTINUOUS_TELEMETRY": "MEAN", "COUNTER": "MAX", "STATE": "LAST", "ALARM_FLAG": "ANY_TRUE", "IDENTIFIER": "FIRST", "TIMESTAMP": "FIRST", "CONFIGURATION": "LAST", "FAULT_CODE": "LAST"}
STORAGE = {"CHARGER": "CHARGER_TELEMETRY", "CONNECTOR": "CONNECTOR_TELEMETRY", "SMR": "SMR_TELEMETRY", "SESSION": "SESSION_OBSERVATION", "ALARM": "ALARM_EVENT", "CONFIGURATION": "CONFIGURATION_SNAPSHOT", "SITE": "MASTER_DATA"}
UNITLESS = ("STATE", "IDENTIFIER", "ALARM_FLAG")
RANGELESS = (*UNITLESS, "TIMESTAMP")
LEARNABLE = ("CONTINUOUS_TELEMETRY", "COUNTER", "ALARM_FLAG")


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _first(text: Column, rules, pick=lambda x: x, default: str | None = "UNKNOWN") -> Column:
    return cases([(_has(text, words), pick(result)) for result, words in rules], default)


def classified(fields: DataFrame, name: str = "source_name", units: tuple[str, ...] | None = None) -> DataFrame:
    """fields with entity, field_class, category, kind, unit, storage, aggregation, range_status, ml_candidate and review_status.

    A unit that isn't among `units` (where these are given) is dropped; states, identifiers and alarms have none. What
    isn't named stays UNKNOWN: no description and no range is ever made up.
    """
    text = F.lower(F.col(name))
    found = fields.withColumns({"entity": _first(text, ENTITIES), "field_class": _first(text, CLASSES), "category": _first(text, CATEGORIES), "_unit": _first(text, UNITS, lambda u: u[0], None), "_kind": _first(text, UNITS, lambda u: u[1], None)})
    entity, kind = F.col("entity"), F.col("field_class")
    known = F.col("_unit") if units is None else F.when(F.col("_unit").isin(list(units)), F.col("_unit"))
    out = {
        "kind": F.coalesce(F.col("_kind"), cases([(kind == c, t) for c, t in TYPES.items()], "UNKNOWN")),
        "unit": F.when(~kind.isin(list(UNITLESS)), known),
        "storage": cases([(entity == e, s) for e, s in STORAGE.items()], "RAW_ONLY"),
        "aggregation": cases([(kind == c, a) for c, a in AGGREGATIONS.items()], "UNKNOWN"),
        "range_status": F.when(kind.isin(list(RANGELESS)), "NOT_APPLICABLE").otherwise("UNVERIFIED"),
        "ml_candidate": F.when(kind.isin(list(LEARNABLE)), "YES").otherwise("UNKNOWN"),
        "review_status": F.when((entity != "UNKNOWN") & (kind != "UNKNOWN"), "AUTO_CLASSIFIED").otherwise("DOMAIN_REVIEW_REQUIRED"),
    }
    return found.withColumns(out).drop("_unit", "_kind")
