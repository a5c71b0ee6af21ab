"""Findings and scores: rules over file profiles and over days, schema comparison, dictionary coverage, state changes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import cases, issue_hash

# Severities in order, weights of the score, legal changes of a file's state.
SEVERITIES = ("INFO", "WARNING", "ERROR", "CRITICAL")
WEIGHTS = {"schema": 0.30, "completeness": 0.20, "validity": 0.20, "duplicate": 0.15, "timestamp": 0.15}
DAILY_SEVERITY = {"MISSING_CHARGER_DATA": "ERROR", "SEVERELY_INCOMPLETE_DAY": "ERROR", "MULTIPLE_FILES_SAME_CHARGER_DAY": "INFO", "OVERLAPPING_FILE_COVERAGE": "INFO"}


def rank(severity: Column) -> Column:
    """A severity's place from the mildest; the order of its name says nothing."""
    return cases([(severity == s, i) for i, s in enumerate(SEVERITIES)], -1)


def _finding(code: str, severity: Column | str, rows: DataFrame, column: str = "column", count: str | Column = "n") -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    count = F.col(count) if isinstance(count, str) else count
    where = F.col(column).cast("string") if column in rows.columns else F.lit(None).cast("string")
    return rows.select("file_id", F.lit(code).alias("code"), severity.alias("severity"), where.alias("field"), count.cast("long").alias("count"))


class RuleRegistry:
    """Rules are functions of the profiles giving findings; a rule that fails to plan gives a finding of its own."""

    def __init__(self) -> None:
        self.rules: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]] = []

    def register(self, code: str, rule: Callable[[dict[str, DataFrame]], DataFrame]) -> None:
        self.rules.append((code, rule))

    def evaluate(self, spark: SparkSession, profiles: dict[str, DataFrame]) -> DataFrame:
        """All findings with their hashes, by code, field and hash."""
        parts = []
        for code, rule in self.rules:
            try:
                parts.append(rule(profiles))
            except Exception as e:  # contained: one broken rule doesn't hide the others
                parts.append(spark.createDataFrame([(None, f"RULE_FAILED_{code}", "ERROR", str(e)[:256], 1)], "file_id string, code string, severity string, field string, count long"))
        found = reduce(lambda a, b: a.unionByName(b), parts)
        return found.withColumn("issue_hash", issue_hash(F.col("code"), F.col("file_id"), F.col("field"))).orderBy("code", "field", "issue_hash")


def file_rules() -> RuleRegistry:
    """The rules of a file, over `fields` (file_id, column, rows, non_null, nulls, is_numeric, num_min, num_max, sentinel_hits,
    required, known, kind, low, high, invalid_enum) and `files` (file_id, rows, duplicate_rows, collisions, conflicting,
    unparsed, largest_step, median_step, dominant_date, file_date, connectors, smrs, expected_connectors, expected_smrs, duplicate_headers)."""
    r = RuleRegistry()
    fields = lambda p: p["fields"]
    files = lambda p: p["files"]
    r.register("MISSING_REQUIRED_FIELD", lambda p: _finding("MISSING_REQUIRED_FIELD", "CRITICAL", fields(p).where("required and rows is null"), count=F.lit(1)))
    r.register("MISSING_FIELD", lambda p: _finding("MISSING_FIELD", "WARNING", fields(p).where("not required and known and rows is null"), count=F.lit(1)))
    r.register("UNKNOWN_FIELD", lambda p: _finding("UNKNOWN_FIELD", "INFO", fields(p).where("not known and rows is not null"), count=F.lit(1)))
    r.register("ALL_NULL_FIELD", lambda p: _finding("ALL_NULL_FIELD", "INFO", fields(p).where("rows > 0 and non_null = 0"), count="rows"))
    r.register("SENTINEL_VALUE", lambda p: _finding("SENTINEL_VALUE", "WARNING", fields(p).where("sentinel_hits > 0"), count="sentinel_hits"))
    r.register("OUT_OF_RANGE", lambda p: _finding("OUT_OF_RANGE", "ERROR", fields(p).where("num_min < low or num_max > high"), count=F.lit(1)))
    r.register("INVALID_TYPE", lambda p: _finding("INVALID_TYPE", "ERROR", fields(p).where("kind in ('INTEGER', 'FLOAT') and non_null > 0 and not is_numeric"), count="non_null"))
    r.register("UNKNOWN_ENUM_VALUE", lambda p: _finding("UNKNOWN_ENUM_VALUE", "WARNING", fields(p).where("invalid_enum > 0"), count="invalid_enum"))
    r.register("DUPLICATE_HEADER", lambda p: _finding("DUPLICATE_HEADER", "WARNING", files(p).where("duplicate_headers > 0"), count="duplicate_headers"))
    r.register("INVALID_TIMESTAMP", lambda p: _finding("INVALID_TIMESTAMP", F.when(F.col("unparsed") > 0.02 * F.col("rows"), "CRITICAL").otherwise("WARNING"), files(p).where("unparsed > 0"), count="unparsed"))
    r.register("TELEMETRY_GAP", lambda p: _finding("TELEMETRY_GAP", "WARNING", files(p).where("largest_step > 5 * median_step"), count=F.lit(1)))
    r.register("EVENT_DATE_FILENAME_MISMATCH", lambda p: _finding("EVENT_DATE_FILENAME_MISMATCH", "INFO", files(p).where("dominant_date <> file_date"), count=F.lit(1)))
    r.register("EXACT_DUPLICATE", lambda p: _finding("EXACT_DUPLICATE", "WARNING", files(p).where("duplicate_rows > 0"), count="duplicate_rows"))
    r.register("LOGICAL_KEY_COLLISION", lambda p: _finding("LOGICAL_KEY_COLLISION", F.when(F.col("conflicting") > 0, "ERROR").otherwise("WARNING"), files(p).where("collisions > 0"), count="collisions"))
    r.register("UNEXPECTED_CONNECTOR_CARDINALITY", lambda p: _finding("UNEXPECTED_CONNECTOR_CARDINALITY", "WARNING", files(p).where("connectors <> expected_connectors"), count="connectors"))
    r.register("UNEXPECTED_SMR_CARDINALITY", lambda p: _finding("UNEXPECTED_SMR_CARDINALITY", "WARNING", files(p).where("smrs <> expected_smrs"), count="smrs"))
    return r


def score(files: DataFrame, legacy_collapse: bool = False) -> DataFrame:
    """files (file_id, fields, missing_required, duplicate_headers, drifted, unknown_schema, completeness, violations, values,
    exact_share, conflict_share, parsed_share, largest_step, threshold) with a score a dimension and the overall one.

    legacy_collapse counts only one weight among dimensions of equal score, as an older scoring did.
    """
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    schema = 100 - F.when(F.col("missing_required") > 0, 30.0).otherwise(0.0) - F.least(F.lit(10.0), 2.0 * F.col("duplicate_headers")) - F.least(F.lit(40.0), F.coalesce(F.try_divide(F.col("drifted") * 100.0, F.col("fields")), F.lit(0.0))) - F.when(F.col("unknown_schema"), 10.0).otherwise(0.0)
    steps = F.coalesce(F.try_divide("largest_step", "threshold"), F.lit(0.0))
    parts = {
        "schema": schema,
        "completeness": 100.0 * F.col("completeness"),
        "validity": 100.0 * (1 - F.coalesce(F.try_divide("violations", "values"), F.lit(0.0))),
        "duplicate": 100 - 100.0 * F.col("exact_share") - 100.0 * F.col("conflict_share"),
        "timestamp": 100.0 * F.col("parsed_share") - F.when(steps > 1, F.least(F.lit(30.0), 10.0 * (steps - 1))).otherwise(0.0),
    }
    out = files
    for name, c in parts.items():
        out = out.withColumn(f"{name}_score", F.round(clamp(c), 2))
    names = list(WEIGHTS)
    if legacy_collapse:
        weight = lambda i: F.when(reduce(lambda a, b: a | b, [F.col(f"{names[j]}_score") == F.col(f"{names[i]}_score") for j in range(i + 1, len(names))], F.lit(False)), 0.0).otherwise(WEIGHTS[names[i]])
    else:
        weight = lambda i: F.lit(WEIGHTS[names[i]])
    total = sum((weight(i) * F.col(f"{n}_score") for i, n in enumerate(names)), F.lit(0.0))
    weights = sum((weight(i) for i in range(len(names))), F.lit(0.0))
    return out.withColumn("overall_score", F.round(total / weights, 2))


def daily_findings(days: DataFrame, gap_floor: str = "MODERATE", severities: dict[str, str] | None = None) -> DataFrame:
    """Findings of reconciled days: (charger_id, business_date, code, severity, issue_hash). Components are missed only on days with data.

    days: arrival, completeness, is_late, largest_gap_severity, cadence_abnormal, connectors, expected_connectors, smrs,
    expected_smrs, files, overlap_timestamps, dominant_date, file_date.
    """
    severities = DAILY_SEVERITY | (severities or {})
    has_data = (F.col("arrival") != "MISSING") & F.coalesce(F.col("completeness") != "NO_DATA", F.lit(True))
    bands = ("MINOR", "MODERATE", "MAJOR", "CRITICAL")
    over = F.col("largest_gap_severity").isin(list(bands[bands.index(gap_floor) :]))
    rules = {
        "MISSING_CHARGER_DATA": F.col("arrival") == "MISSING",
        "LATE_FILE": F.col("is_late"),
        "PARTIAL_DAY": F.col("completeness") == "PARTIAL",
        "SEVERELY_INCOMPLETE_DAY": F.col("completeness") == "SEVERELY_INCOMPLETE",
        "TELEMETRY_GAP": over,
        "ABNORMAL_SAMPLING_INTERVAL": F.col("cadence_abnormal"),
        "MISSING_EXPECTED_CONNECTOR": has_data & (F.col("connectors") < F.col("expected_connectors")),
        "MISSING_EXPECTED_SMR": has_data & (F.col("smrs") < F.col("expected_smrs")),
        "MULTIPLE_FILES_SAME_CHARGER_DAY": F.col("files") > 1,
        "OVERLAPPING_FILE_COVERAGE": F.col("overlap_timestamps") > 0,
        "EVENT_DATE_FILENAME_MISMATCH": F.col("dominant_date") != F.col("file_date"),
    }
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(code).alias("code"), F.lit(severities.get(code, "WARNING")).alias("severity"))) for code, c in rules.items())))
    rows = days.select("charger_id", "business_date", F.explode(found).alias("f")).select("charger_id", "business_date", "f.code", "f.severity")
    return rows.withColumn("issue_hash", issue_hash(F.col("code"), F.col("charger_id"), F.col("business_date")))


def compare_schemas(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, occurrence, change): identities of two schemas (name, occurrence, kind, position, required) by one full outer join."""
    a = old.select("name", "occurrence", F.col("kind").alias("old_kind"), F.col("position").alias("old_position"), F.col("required").alias("_r"), F.lit(True).alias("_a"))
    b = new.select("name", "occurrence", F.col("kind").alias("new_kind"), F.col("position").alias("new_position"), F.lit(True).alias("_b"))
    both = a.join(b, ["name", "occurrence"], "full_outer")
    change = cases(
        [
            (F.col("_b").isNull() & F.col("_r"), "MISSING_REQUIRED"), (F.col("_b").isNull(), "MISSING_OPTIONAL"), (F.col("_a").isNull(), "ADDITION"),
            (F.col("old_kind") != F.col("new_kind"), "TYPE_CHANGE"), (F.col("old_position") != F.col("new_position"), "REORDER"),
        ],
        "SAME",
    )
    return both.select("name", "occurrence", "old_kind", "new_kind", change.alias("change"))


def compatibility(changes: DataFrame) -> DataFrame:
    """(outcome): the most serious change names the outcome; a reordering counts as an addition."""
    has = lambda c: F.bool_or(F.col("change") == c)
    outcome = cases([(has("MISSING_REQUIRED"), "MISSING_REQUIRED"), (has("TYPE_CHANGE"), "TYPE_CHANGE"), (has("MISSING_OPTIONAL"), "MISSING_OPTIONAL"), (has("ADDITION") | has("REORDER"), "ADDITION")], "EXACT")
    return changes.agg(outcome.alias("outcome"))


def dictionary_coverage(resolved: DataFrame) -> DataFrame:
    """(fields, mapped, unmapped, in_review, status) of resolved header fields (name, canonical or null, review)."""
    return resolved.agg(F.count("*").alias("fields"), F.count("canonical").alias("mapped"), (F.count("*") - F.count("canonical")).alias("unmapped"), F.count_if("review").alias("in_review")).withColumn("status", F.when(F.col("unmapped") == 0, "COMPLETE").otherwise("INCOMPLETE"))


def illegal_moves(moves: DataFrame, allowed: DataFrame) -> DataFrame:
    """Moves (from_state, to_state, ..) that the table of allowed pairs doesn't have."""
    return moves.join(allowed, ["from_state", "to_state"], "left_anti")


def schema_breakdown(fields: DataFrame, *columns: str) -> DataFrame:
    """Counts by each of several columns in one pass: (dimension, value, n)."""
    sets = fields.groupingSets([[c] for c in columns], *columns).agg(F.count("*").alias("n"), *(F.grouping(c).alias(f"_{c}") for c in columns))
    name = cases([(F.col(f"_{c}") == 0, c) for c in columns])
    value = cases([(F.col(f"_{c}") == 0, F.col(c).cast("string")) for c in columns])
    return sets.select(name.alias("dimension"), value.alias("value"), "n")


def schema_versions(known: DataFrame, headers: DataFrame) -> DataFrame:
    """(fingerprint, version, first_file, is_new): headers (file_id, fingerprint, received_at) against known (fingerprint, version).

    New fingerprints are numbered on from the last version in the order in which they came.
    """
    first = headers.groupBy("fingerprint").agg(F.min(F.struct("received_at", "file_id")).alias("_f"))
    both = first.join(known, "fingerprint", "left")
    top = F.coalesce(known.agg(F.max("version")).scalar(), F.lit(0))
    order = Window.partitionBy(F.col("version").isNull()).orderBy("_f")
    number = F.when(F.col("version").isNull(), top + F.row_number().over(order)).otherwise(F.col("version"))
    return both.select("fingerprint", number.cast("int").alias("version"), F.col("_f.file_id").alias("first_file"), F.col("version").isNull().alias("is_new"))
