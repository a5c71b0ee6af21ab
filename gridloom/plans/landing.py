"""What is found in files as they land: profiles of their fields and rows from two passes, rules, scores and schema versions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalars import file_date, is_missing
from gridloom.operators import coverage, quality
from gridloom.session import shared_dir
from gridloom.sources.dictionary import Definition

GAP_FACTOR = 5.0


def row_hash(cells: Column) -> Column:
    """A row's cells as one digest; null and empty cells are alike."""
    return F.sha2(F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit("\x00"))), "\x1f"), 256)


def definitions_table(spark: SparkSession, definitions: list[Definition]) -> DataFrame:
    """(column, kind, required, low, high, sentinels, allowed): a row a definition."""
    bound = lambda x: None if x is None else float(x)
    rows = [(f.canonical_name, f.kind, f.required, bound(f.low), bound(f.high), [float(s) for s in f.sentinels], list(f.allowed)) for f in definitions]
    return spark.createDataFrame(rows, "column string, kind string, required boolean, low double, high double, sentinels array<double>, allowed array<string>")


def field_profiles(cells: DataFrame, definitions: DataFrame, names: list[str]) -> DataFrame:
    """The `fields` that quality.file_rules() takes, with `violations`, from cells (file_id, column, value) in one aggregation.

    `names` are the columns of definitions; those that a file doesn't have are rows without counts. Without any
    definition every field is known. Definitions go to the cells' tasks: by column, all cells would meet in as many tasks as there are columns.
    """
    definitions = F.broadcast(definitions)
    own = cells.join(definitions, "column", "left").withColumn("_value", F.when(~is_missing(F.col("value")), F.trim("value")))
    value, number, fit, marked = (F.col(f"_{c}") for c in ("value", "number", "fit", "marked"))
    # each step is a column, so that a cell is parsed once; texts that can't begin a number aren't tried, as each failure is an exception
    own = own.withColumn("_number", F.when((value < ":") | F.lower(F.left(value, F.lit(1))).isin("i", "n"), value.try_cast("double")))
    own = own.withColumn("_number", F.when(~F.isnan(number), number))
    own = own.withColumn("_marked", F.when((F.size("sentinels") > 0) & number.isNotNull(), F.exists("sentinels", lambda s: F.abs(s - number) < 1e-3)))
    own = own.withColumn("_fit", F.when(~F.coalesce(marked, F.lit(False)), number))  # sentinels are not out of range
    outside = (fit < F.col("low")) | (fit > F.col("high"))
    odd = (F.size("allowed") > 0) & value.isNotNull() & ~F.array_contains("allowed", value)
    wrong = F.col("kind").isin("INTEGER", "FLOAT") & value.isNotNull() & number.isNull()
    found = own.groupBy("file_id", "column").agg(
        F.count("*").alias("rows"), F.count(value).alias("non_null"), (F.count("*") - F.count(value)).alias("nulls"), ((F.count(value) > 0) & (F.count(number) == F.count(value))).alias("is_numeric"),
        F.min(fit).alias("num_min"), F.max(fit).alias("num_max"), F.count_if(marked).alias("sentinel_hits"), F.count_if(odd).alias("invalid_enum"), F.count_if(outside | odd | wrong).alias("violations"),
    )
    # a file's columns, and those that it doesn't have, in a row: the cells are read once
    absent = F.array_except(F.array(*map(F.lit, names)).cast("array<string>"), F.collect_set("column"))
    counts = found.columns[2:]
    bare = F.transform(absent, lambda c: F.struct(c.alias("column"), *(F.lit(None).cast(found.schema[n].dataType).alias(n) for n in counts)))
    own = found.groupBy("file_id").agg(F.concat(F.collect_list(F.struct("column", *counts)), bare).alias("c"))
    every = own.select("file_id", F.explode("c").alias("c")).select("file_id", "c.*").join(definitions.select("column", "kind", "required", "low", "high"), "column", "left")
    known = F.col("kind").isNotNull() if names else F.lit(True)
    return every.withColumn("known", known).withColumn("required", F.coalesce("required", F.lit(False)))


def row_profiles(rows: DataFrame, rules: coverage.CoverageRules) -> DataFrame:
    """What rows (file_id, charger_id, event_time, connector_no, smr_no, row_hash) say of each file: repetition, collisions of logical keys, steps, dates, components."""
    same = rows.groupBy("file_id", "charger_id", "event_time", "connector_no", "smr_no", "row_hash").agg(F.count("*").alias("n"))
    keys = same.groupBy("file_id", "charger_id", "event_time", "connector_no", "smr_no").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    repeated = same.groupBy("file_id").agg(F.sum(F.col("n") - 1).alias("duplicate_rows"))
    there = F.col("charger_id").isNotNull() & F.col("event_time").isNotNull()
    collided = keys.groupBy("file_id").agg(F.count_if(there & (F.col("n") > 1)).alias("collisions"), F.count_if(there & (F.col("kinds") > 1)).alias("conflicting"), F.sum(F.when(there & (F.col("kinds") > 1), F.col("n"))).alias("conflicting_rows"), F.count_distinct("connector_no").alias("connectors"), F.count_distinct("smr_no").alias("smrs"))
    steps = coverage.file_intervals(rows).selectExpr("file_id", "max_interval largest_step", "median_interval median_step")
    dates = coverage.date_span(rows, rules).select("file_id", "dominant_date")
    return repeated.join(collided, "file_id", "left").join(steps, "file_id", "left").join(dates, "file_id", "left")


def judged(spark: SparkSession, cells: DataFrame, rows: DataFrame, files: DataFrame, definitions: list[Definition], rules: coverage.CoverageRules) -> tuple[DataFrame, DataFrame]:
    """(findings, scores) of files (file_id, name, rows, unparsed, duplicate_headers, drifted, unknown_schema, expected_connectors, expected_smrs).

    cells and rows are each aggregated once, into tables of a few rows a file in the shared folder; rules and scores read these.
    """

    def kept(profile: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        profile.write.parquet(path)
        return spark.read.schema(profile.schema).parquet(path)

    fields = kept(field_profiles(cells, definitions_table(spark, definitions), [f.canonical_name for f in definitions]), "fields")
    profile = kept(files.withColumn("file_date", file_date(F.col("name"))).join(row_profiles(rows, rules), "file_id", "left"), "profiles")
    findings = quality.file_rules().evaluate(spark, {"fields": fields, "files": profile})
    filled = F.col("non_null") > 0
    sums = fields.groupBy("file_id").agg(F.count("rows").alias("fields"), F.sum(F.when(filled, F.col("rows"))).alias("slots"), F.sum("non_null").alias("values"), F.coalesce(F.sum("violations"), F.lit(0)).alias("violations"), F.count_if(F.col("required") & F.col("rows").isNull()).alias("missing_required"))
    n = F.nullif(F.col("rows"), F.lit(0))
    share = lambda c: F.coalesce(F.col(c) / n, F.lit(0.0))
    inputs = profile.join(sums, "file_id", "left").withColumns({
        "completeness": F.coalesce(F.try_divide("values", "slots"), F.lit(0.0)), "exact_share": share("duplicate_rows"), "conflict_share": share("conflicting_rows"),
        "parsed_share": 1 - share("unparsed"), "threshold": F.col("median_step") * GAP_FACTOR, "missing_required": F.coalesce("missing_required", F.lit(0)),
    })
    scores = quality.score(inputs).select("file_id", *(f"{p}_score" for p in (*quality.WEIGHTS, "overall")))
    return findings, scores


def drift(heads: DataFrame, versions: DataFrame) -> DataFrame:
    """(file_id, drifted, unknown_schema, duplicate_headers) of headers (file_id, source_name, occurrence, fingerprint) against
    versions (fingerprint, version, names): how many names the latest version and a file of another header don't share."""
    own = heads.groupBy("file_id", "fingerprint").agg(F.collect_set("source_name").alias("own"), F.count_distinct(F.when(F.col("occurrence") > 1, F.col("source_name"))).alias("duplicate_headers"))
    latest = versions.agg(F.max_by("names", "version").alias("latest")).select("latest")
    known = versions.select("fingerprint", F.lit(True).alias("known"))
    both = own.join(known, "fingerprint", "left").withColumn("latest", latest.scalar())
    moved = F.size(F.array_except("own", "latest")) + F.size(F.array_except("latest", "own"))
    unknown = F.col("known").isNull()
    return both.select("file_id", F.when(unknown & F.col("latest").isNotNull(), moved).otherwise(0).alias("drifted"), unknown.alias("unknown_schema"), "duplicate_headers")


def new_versions(heads: DataFrame, received: DataFrame, versions: DataFrame) -> DataFrame:
    """Rows that versions (fingerprint, version, names, first_file) gets from files' headers."""
    names = heads.groupBy("fingerprint").agg(F.collect_set("source_name").alias("names"))
    files = heads.select("file_id", "fingerprint").distinct().join(received, "file_id")
    found = quality.schema_versions(versions.select("fingerprint", "version"), files.select("file_id", "fingerprint", "received_at"))
    return found.where("is_new").join(names, "fingerprint").select("fingerprint", "version", "names", "first_file")


def states(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(file_id, critical, state): a file with a critical finding is quarantined, the others are ready."""
    critical = findings.where("severity = 'CRITICAL'").groupBy("file_id").agg(F.count("*").alias("critical"))
    both = files.select("file_id").join(critical, "file_id", "left").fillna(0, ["critical"])
    return both.withColumn("state", F.when(F.col("critical") > 0, "QUARANTINED").otherwise("READY_FOR_NORMALIZATION"))
