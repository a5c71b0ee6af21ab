"""Scalar rules of the telemetry model as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data contract.
MISSING_TOKENS = ("", "N/A", "NA", "-", "--", "null", "Unknown", "Not Available")
NUMERIC_NULLS = ("null", "none", "nan", "na", "-", "")
STRING_NULLS = ("null", "none", "nan", "na", "")
TRUE_WORDS = ("1", "true", "yes", "alarm", "trip", "active", "closed")
FALSE_WORDS = ("0", "false", "no", "not alarm", "normal", "inactive", "open")
CANONICAL_TRUE = ("1", "true", "t", "yes", "y", "on")
CANONICAL_FALSE = ("0", "false", "f", "no", "n", "off")
ALARM_WORDS = ("1", "true", "yes", "alarm", "trip", "active", "fail", "failed", "abnormal", "open")
NO_SESSION = ("0", "0.0", "None", "nan")
STATE_WORDS = {
    "IDLE": ("available", "idle", "standby", "ready_for_use"),
    "PLUGGED": ("plugged", "connected"),
    "PREPARING": ("preparing", "authenticating"),
    "AUTHORIZED": ("authorized", "ready"),
    "CHARGING": ("charging", "in_use", "delivering_energy"),
    "SUSPENDED": ("suspended", "paused", "ev_suspended", "evse_suspended"),
    "FINISHING": ("finishing", "stopping"),
    "COMPLETED": ("completed", "charge finished", "stopped", "finished"),
    "FAULTED": ("faulted", "error", "unavailable", "emergency"),
}
ACTIVE_STATES = ("PREPARING", "AUTHORIZED", "CHARGING", "SUSPENDED", "FINISHING")
TERMINATIONS = (
    ("REMOTE_STOPPED", ("remote",)),
    ("EMERGENCY_STOPPED", ("emergency", "e-stop", "estop")),
    ("USER_STOPPED", ("local", "user", "stop", "evdisconnected", "card", "app")),
    ("FAULT_STOPPED", ("fault", "error", "overcurrent", "overvoltage", "ground", "insulation")),
    ("COMMUNICATION_LOST", ("commlost", "communication", "reboot", "timeout")),
)
RESEARCH_SENTINELS = (-1.0, -9999.0, 9999.0, 65535.0, 99999.0, -99999.0, 255.0)

#: sign, digits before and after the point, exponent
NUMBER = r"^([+-]?)(?=[0-9]|\.[0-9])([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]{1,4}))?$"
PLAIN = r"^[+-]?(?=[0-9]|\.[0-9])[0-9]*\.?[0-9]*$"
NULL_LITERAL, FIELD_SEPARATOR, ROW_SEPARATOR = "\x00NULL", "\x1f", "\x1e"


def cases(pairs: list[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def is_missing(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin([t.lower() for t in MISSING_TOKENS])


def canonical_name(c: Column, position: Column | None = None) -> Column:
    """A header cell as an identifier: words split at case changes and other characters, lower case, no leading digit.

    A cell of no such character is named by its position in the header.
    """
    split = F.regexp_replace(F.trim(c), r"([a-z0-9])([A-Z])", "$1_$2")
    split = F.regexp_replace(split, r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    plain = F.lower(F.regexp_replace(F.regexp_replace(split, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""))
    named = F.when(plain.rlike("^[0-9]"), F.concat(F.lit("f_"), plain)).otherwise(plain)
    return named if position is None else F.when(plain == "", F.concat(F.lit("unnamed_field_"), position.cast("string"))).otherwise(named)


def coerce_float(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    value = text.try_cast("double")
    return F.when(~F.lower(text).isin(list(NUMERIC_NULLS)) & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def coerce_integer(c: Column) -> Column:
    value = coerce_float(c)
    return F.when(value == F.floor(value), value.cast("long"))


def coerce_boolean(c: Column) -> Column:
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(list(TRUE_WORDS)), True).when(word.isin(list(FALSE_WORDS)), False)


def coerce_string(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    return F.when(~F.lower(text).isin(list(STRING_NULLS)), text)


def coerce_timestamp(c: Column, formats: tuple[str, ...], zone: str) -> Column:
    """The first format that fits each value; times without a zone are local to `zone`."""
    parsed = F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats))
    return F.coalesce(F.to_utc_timestamp(parsed, zone), F.trim(c).try_cast("timestamp"))


def is_sentinel(v: Column, sentinels, tolerance: float = 0.001) -> Column:
    return reduce(lambda a, b: a | b, [F.abs(v - F.lit(float(s))) < tolerance for s in sentinels], F.lit(False))


def map_state(c: Column) -> Column:
    word = F.lower(F.trim(c))
    return cases([(word.isin(list(words)), state) for state, words in STATE_WORDS.items()], "UNKNOWN")


def is_active_state(state: Column) -> Column:
    return state.isin(list(ACTIVE_STATES))


def termination(reason: Column, state: Column) -> Column:
    """Class of a session's end: the first group of words found in the reason, else by the last state."""
    text = F.lower(reason)
    by_word = [(reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]), name) for name, words in TERMINATIONS]
    by_state = cases([(state.isin("IDLE", "COMPLETED"), "NORMAL"), (state == "FAULTED", "FAULT_STOPPED")], "UNKNOWN")
    return F.when(reason.isNull() | (F.trim(reason) == ""), by_state).otherwise(cases(by_word, "NORMAL"))


def alarm_active(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(list(ALARM_WORDS)), F.lit(False))


def canonical_number(c: Column) -> Column:
    """One spelling for equal numbers: no sign on zero, no exponent, no closing zeros; null for other texts.

    Works on the digits as text, so numbers of any length and scale keep all of them. An exponent beyond 9999 is no
    number here.
    """
    text = F.trim(c)
    spelt = F.when(text.rlike(PLAIN), text).when(text.rlike(NUMBER), _without_exponent(text))
    # each step once over the one before: sign, leading zeros, closing zeros, points at either end, the sign of zero
    for pattern, new in ((r"^\+", ""), (r"^(-?)0+(?=[0-9])", "$1"), (r"(\.[0-9]*?)0+$", "$1"), (r"\.$", ""), (r"^(-?)(?=\.)", "$10"), (r"^-0$", "0")):
        spelt = F.regexp_replace(spelt, pattern, new)
    return spelt


def _without_exponent(text: Column) -> Column:
    """A number with an exponent written out."""
    part = lambda k: F.regexp_extract(text, NUMBER, k)

    def moved(x: Column) -> Column:
        point = x["point"]  # digits before the point
        whole = F.when(point <= 0, F.lit("0")).otherwise(F.rpad(F.substring(x["digits"], F.lit(1), point), point, "0"))
        rest = F.when(point <= 0, F.concat(F.repeat(F.lit("0"), -point), x["digits"])).otherwise(F.substring(x["digits"], point + 1, F.length(x["digits"])))
        return F.concat(x["sign"], whole, F.lit("."), rest)

    parts = F.struct(part(1).alias("sign"), F.concat(part(2), part(3)).alias("digits"), (F.length(part(2)) + F.coalesce(part(4).try_cast("int"), F.lit(0))).alias("point"))
    return F.element_at(F.transform(F.array(parts), moved), 1)  # a lambda, so that each part is worked out once


def canonical_value(c: Column, kind: str) -> Column:
    """The spelling of a cell that fingerprints use, by its declared type."""
    text = F.trim(c)
    if kind in ("INTEGER", "FLOAT"):
        value = F.coalesce(canonical_number(c), text)
    elif kind == "BOOLEAN":
        word = F.lower(text)
        value = F.when(word.isin(list(CANONICAL_TRUE)), "true").when(word.isin(list(CANONICAL_FALSE)), "false").otherwise(text)
    else:
        value = text
    return F.when(is_missing(c), F.lit(NULL_LITERAL)).otherwise(value)


def row_fingerprint(columns: dict[str, str]) -> Column:
    """SHA-256 of the row's name=value cells; columns are names and types."""
    cells = [F.concat(F.lit(f"{name}="), canonical_value(F.col(name).cast("string"), kind)) for name, kind in sorted(columns.items())]
    return F.sha2(F.concat_ws(FIELD_SEPARATOR, *cells), 256)


def frame_fingerprint(position: Column, fingerprint: Column) -> Column:
    """Aggregate: SHA-256 of a frame's position=fingerprint pairs by position."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", position, fingerprint))), ROW_SEPARATOR), 256)


def identity(c: Column) -> Column:
    """A component's id: trimmed, 1.0 is 1, missing is null."""
    return F.when(~is_missing(c.cast("string")), F.regexp_replace(F.trim(c.cast("string")), r"^(-*\d+)\.0$", "$1"))


def nearest_rank(values: Column, q: float) -> Column:
    """The element of a sorted array at index round-half-even(q (n - 1))."""
    return F.element_at(values, F.bround(F.lit(q) * (F.size(values) - 1)).cast("int") + 1)


def business_date(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def issue_hash(rule: Column, *locators: Column) -> Column:
    return F.sha2(F.concat_ws(FIELD_SEPARATOR, rule, *(F.coalesce(x.cast("string"), F.lit("")) for x in locators)), 256)


def file_date(name: Column) -> Column:
    """The date in a file's name: year first, day first, or eight digits; the first that is a date."""
    a, b, c = r"(20\d\d)[-_.](\d{1,2})[-_.](\d{1,2})", r"(\d{1,2})[-_.](\d{1,2})[-_.](20\d\d)", r"(20\d\d)(\d\d)(\d\d)"

    def of(pattern: str, year: int, month: int, day: int) -> Column:
        parts = [F.regexp_extract(name, pattern, k) for k in (year, month, day)]
        return F.try_to_date(F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")), "yyyy-MM-dd")

    return F.coalesce(of(a, 1, 2, 3), of(b, 3, 2, 1), of(c, 1, 2, 3))


def rounded(c: Column, digits: int) -> Column:
    """A number rounded once; one that rounds to nothing keeps its sign, as SQL's round() does elsewhere."""
    return F.signum(c) * F.round(F.abs(c), digits)


def seconds(ts: Column) -> Column:
    """A timestamp as seconds since the epoch, fractions kept."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)
