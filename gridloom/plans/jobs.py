"""Batch jobs for spark-submit: run-daily, reconcile, reconstruct, resume, process-uploads, build-silver. Exit 0: done, 1: failed, 2: bad call, 3: nothing to do."""

from __future__ import annotations

import argparse
import hashlib
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.functions import classifier
from gridloom.functions.scalars import business_date, identity
from gridloom.operators import coverage, events, frames, silver
from gridloom.plans import landing, resumed
from gridloom.plans.api import Tables, daily_summary
from gridloom.sources import csv_files, scan, staging, store
from gridloom.sources.dictionary import Definition, Dictionary
from gridloom.sources.protocols import FolderSource

FORMATS = ("dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
# Fields of alarms with their severity, and of faults.
ALARMS = {"smoke_alarm": "CRITICAL", "emergency_stop_active": "CRITICAL", "grid_fail": "MAJOR", "door_open": "MINOR"}
FAULTS = ("short_circuit", "ground_fault_alarm", "input_rcbo_tripped", "mccb_tripped", "mdl_fault", "fan_fault")

#: Columns of rows that say where they come from and are no payload of a frame.
KEYS = ("file_id", "row_hash", "charger_id", "event_time", "source_row_number", "position", "connector_no", "smr_no")


def by_file(spark: SparkSession, files, out: str, zone: str = "Asia/Kolkata"):
    """(rows, verdicts, facts) of files (path, sha256, length), which are staged under `out` if they aren't yet: the rows of
    those that fit, with charger_id, event_time (an instant) and position, other columns as text; (path, reason) of all,
    reason null for those that fit; and what is known of each before its rows are judged.

    Columns of roles are chosen for each header, the time format for each file. A file fits if its header has all
    required roles, some stamp parses or it has no row, and csv_files.admitted() finds nothing against it.
    """
    folder = f"{out}/staged"
    staging.stage(spark, files, folder)
    own = files.selectExpr("path", "sha256", "length")
    heads = staging.headers(spark, folder).join(own.selectExpr("sha256 file_id").distinct(), "file_id", "left_semi")
    layout = staging.layouts(heads)
    roles = {h: r for h, n in layout.items() if not set(csv_files.REQUIRED_ROLES) - set(r := csv_files.roles(n))}
    if not roles:
        raise ValueError(f"no file has a column for each of {', '.join(csv_files.REQUIRED_ROLES)}")
    layout = {h: n for h, n in layout.items() if h in roles}
    raw = staging.rows(spark, folder, own).where(F.col("header").isin(list(roles))).withColumnRenamed("file_id", "sha256").join(own.select("sha256", F.col("path").alias("file_id")), "sha256")
    cell = lambda c: staging.column(layout, c).alias(c)
    raw = raw.select("file_id", "source_row_number", "cells", F.col("header").alias("_header"), *(cell(c) for c in staging.columns(layout)))

    def column(role):
        owners: dict[str, list[str]] = {}
        for h, r in roles.items():
            owners.setdefault(r[role], []).append(h)
        return F.coalesce(*(F.when(F.col("_header").isin(h), F.col(c)) for c, h in owners.items()))

    stamps = [F.try_to_timestamp(column("EVENT_TIME"), F.lit(f)) for f in FORMATS]
    forms = csv_files.time_formats(raw, column("EVENT_TIME"), FORMATS).withColumnRenamed("form", "_form")
    # one number a file, whose list the driver holds anyway; a cached plan would be taken for that of a later inbox
    forms = spark.createDataFrame([tuple(r) for r in forms.collect()], "file_id string, _form int")
    rows = raw.join(forms.where("_form >= 0"), "file_id")
    local = F.coalesce(*(F.when(F.col("_form") == i, s) for i, s in enumerate(stamps)))
    rows = rows.withColumns({"event_time": F.to_utc_timestamp(local, zone), "charger_id": identity(column("CHARGER_ID")), "connector_no": column("CONNECTOR"), "smr_no": column("SMR")})
    counts = rows.groupBy("file_id").agg(F.count("*").alias("rows"), F.count_if(F.col("event_time").isNull()).alias("unparsed"))
    facts = own.join(staging.contents(spark, folder).selectExpr("file_id sha256", "columns", "header _header"), "sha256", "left").drop("sha256").withColumnRenamed("path", "file_id")
    facts = facts.join(forms, "file_id", "left").join(counts, "file_id", "left")
    every = csv_files.admitted(facts.withColumn("critical", F.lit(0)))
    own = F.when(F.col("length") > csv_files.FILE_LIMIT, F.col("reason")).when(F.col("_header").isNull() | ~F.col("_header").isin(list(roles)), "no column for a required role").when(F.col("_form") < 0, "no time format fits")
    verdicts = every.select(F.col("file_id").alias("path"), F.coalesce(own, F.col("reason")).alias("reason"))
    verdicts = spark.createDataFrame([tuple(r) for r in verdicts.collect()], "path string, reason string")
    fit = verdicts.where("reason is null").select(F.col("path").alias("file_id"))
    rows = rows.withColumn("row_hash", landing.row_hash(F.col("cells")))
    return frames.with_position(rows.join(fit, "file_id", "left_semi").drop("_header", "_form", "cells")), verdicts, facts


def _listed(spark: SparkSession, inbox: str, out: str):
    """(path, name, sha256, length, received_at) of an inbox's files, as the driver's own list has them, hashed once; and of
    what has landed and left the inbox since, whose rows are staged."""
    found = store.staged(spark, inbox).select("path", "name", "sha256", "length", "received_at")
    landed = staging.table(spark, f"{out}/files", "sha256 string, name string, length long, received_at timestamp").join(found.select("sha256"), "sha256", "left_anti")
    found = found.unionByName(landed.dropDuplicates(["sha256"]).withColumn("path", F.concat(F.lit("landed:"), "sha256")))
    return spark.createDataFrame([tuple(r) for r in found.collect()], "path string, name string, sha256 string, length long, received_at timestamp")


def quarantined(spark: SparkSession, files, verdicts, out: str) -> bool:
    """Note the files (path, name, sha256) that fit nothing in the quarantine table, each once; whether one is new."""
    bad = files.select("path", "name", "sha256").join(verdicts.where("reason is not null"), "path")
    try:
        bad = bad.join(spark.read.parquet(f"{out}/quarantine").select("sha256", "name").distinct(), ["sha256", "name"], "left_anti")
    except AnalysisException:  # no table yet
        pass
    bad = spark.createDataFrame(bad.select("path", "name", "sha256", "reason").collect(), "path string, name string, sha256 string, reason string")
    if bad.isEmpty():
        return False
    store.quarantine(bad, f"{out}/quarantine")
    return True


def _known(spark: SparkSession, out: str):
    try:
        return spark.read.parquet(f"{out}/files").select("sha256", "name")
    except AnalysisException:  # no table yet
        return spark.createDataFrame([], "sha256 string, name string")


def run_daily(spark: SparkSession, inbox: str, out: str, rules: coverage.CoverageRules, archive: str | None = None, definitions: list[Definition] | None = None) -> int:
    """Land files once, compute coverage and gaps of the days they touch, and replace those days.

    Their bytes are kept under bronze/, their findings, scores and schema versions are written. Files that fit no header
    or time format, aren't admitted or have a critical finding go to the quarantine table and aren't registered, so a
    later run tries them again. A content is parsed once, whatever jobs read it. Where an archive is given, landed files
    move there at the end.
    """
    files = store.staged(spark, inbox).where("outcome = 'STAGED'")
    fresh = store.registered(files, _known(spark, out)).where("outcome = 'REGISTERED'")
    landed = _land(spark, fresh, out, rules, definitions)
    if landed is None:
        return 3
    FolderSource(inbox, archive).acknowledge(landed[1], ok=True)
    return 0


def _judge(spark: SparkSession, rows, verdicts, facts, fresh, out: str, rules: coverage.CoverageRules, definitions: list[Definition]):
    """verdicts with those of files that have a critical finding; findings, scores and new schema versions of all that fit are written."""
    folder = f"{out}/staged"
    fit = fresh.join(verdicts.where("reason is null").select("path"), "path", "left_semi")
    heads = staging.headers(spark, folder).withColumnRenamed("file_id", "sha256").join(fit.select("sha256", F.col("path").alias("file_id")), "sha256").drop("sha256", "batch")
    names = spark.createDataFrame([(h, i, c) for h, n in staging.layouts(heads).items() for i, c in enumerate(n)], "header string, pos int, column string")
    cells = staging.rows(spark, folder, fit).select("file_id", "header", F.posexplode("cells").alias("pos", "value")).join(names, ["header", "pos"]).withColumnRenamed("file_id", "sha256")
    cells = cells.join(fit.select("sha256", F.col("path").alias("file_id")), "sha256").select("file_id", "column", "value")
    versions = staging.table(spark, f"{out}/schemas", "fingerprint string, version int, names array<string>, first_file string")
    files = fit.selectExpr("path file_id", "name").join(facts.select("file_id", "rows", "unparsed"), "file_id", "left").fillna(0, ["rows", "unparsed"]).join(landing.drift(heads, versions), "file_id")
    files = files.withColumns({"expected_connectors": F.lit(None).cast("long"), "expected_smrs": F.lit(None).cast("long")})
    findings, scores = landing.judged(spark, cells, rows, files, definitions, rules)
    batch = hashlib.sha256("".join(sorted(r.sha256 for r in fit.select("sha256").collect())).encode()).hexdigest()[:16]
    store.replace_partitions(findings.withColumn("batch", F.lit(batch)), f"{out}/findings", "batch")
    store.replace_partitions(scores.withColumn("batch", F.lit(batch)), f"{out}/scores", "batch")
    found = landing.new_versions(heads, fit.selectExpr("path file_id", "received_at"), versions).collect()  # a row a new header
    if found:
        spark.createDataFrame([tuple(r) for r in found], versions.schema).write.mode("append").parquet(f"{out}/schemas")
    findings = spark.read.parquet(f"{out}/findings").where(F.col("batch") == batch)
    bad = landing.states(files, findings).where("state = 'QUARANTINED'").select(F.col("file_id").alias("path"), F.lit(True).alias("_bad"))
    verdicts = verdicts.join(bad, "path", "left").select("path", F.coalesce("reason", F.when(F.col("_bad"), "critical findings")).alias("reason"))
    return spark.createDataFrame([tuple(r) for r in verdicts.collect()], "path string, reason string")


def _land(spark: SparkSession, fresh, out: str, rules: coverage.CoverageRules, definitions: list[Definition] | None = None):
    """(rows, paths) of new files that fit, after their days are landed; None where no file is new.

    A run that ended before it registered its files lands them again: file days are read once a file, charger and day.
    """
    fresh = spark.createDataFrame([tuple(r) for r in fresh.select("path", "name", "sha256", "length", "received_at").collect()], "path string, name string, sha256 string, length long, received_at timestamp")
    paths = [r.path for r in fresh.select("path").collect()]
    if not paths:
        return None
    store.keep_bytes(spark, fresh, f"{out}/bronze")
    rows, verdicts, facts = by_file(spark, fresh, out, rules.zone)
    if not verdicts.where("reason is null").isEmpty():
        verdicts = _judge(spark, rows, verdicts, facts, fresh, out, rules, definitions or [])
        rows = rows.join(verdicts.where("reason is null").select(F.col("path").alias("file_id")), "file_id", "left_semi")
    new = quarantined(spark, fresh, verdicts, out)
    fresh = fresh.join(verdicts.where("reason is null").select("path"), "path", "left_semi")
    if fresh.isEmpty():
        if new:
            raise ValueError("no new file fits; reasons are in the quarantine table")
        return None
    parts = {c: identity(F.col(c)) for c in ("connector_no", "smr_no")}
    days = coverage.file_days(rows.where("charger_id is not null").withColumns(parts), rules)
    days = days.join(fresh.selectExpr("path file_id", "received_at"), "file_id")
    days.write.mode("append").partitionBy("business_date").parquet(f"{out}/file_days")
    touched = [d.business_date for d in days.select("business_date").distinct().collect()]
    known = spark.read.parquet(f"{out}/file_days").where(F.col("business_date").isin(touched)).dropDuplicates(["file_id", "charger_id", "business_date"])
    stamps = coverage.expand_offsets(known, rules)
    covered = coverage.day_coverage(stamps, rules).join(coverage.day_attributes(known), ["charger_id", "business_date"], "left")
    store.replace_partitions(covered, f"{out}/coverage", "business_date", touched=touched)
    store.replace_partitions(coverage.day_gaps(stamps, rules), f"{out}/gaps", "business_date", touched=touched)
    fresh.select("sha256", "name", "length", "received_at").write.mode("append").parquet(f"{out}/files")
    return rows, [r.path for r in fresh.select("path").collect()]


def process_uploads(spark: SparkSession, inbox: str, out: str, rules: coverage.CoverageRules) -> int:
    """One batch of uploads: outcomes of all new files, coverage of the days that the staged ones touch, then their frames.

    A file that is rejected, a copy or doesn't fit keeps no other from being landed; files over a batch's limits wait for
    the next call. Frames are held against those of earlier batches and kept by day and batch: a batch reads the days of
    its own stamps, and a repeated one leaves out and replaces its own.
    """
    files = store.staged(spark, inbox).drop("outcome")
    batch = store.outcomes(files.join(_known(spark, out), ["sha256", "name"], "left_anti"))
    seen = [tuple(r) for r in batch.select("path", "name", "sha256", "length", "received_at", "outcome").collect()]
    if not seen:
        return 3
    batch = spark.createDataFrame(seen, "path string, name string, sha256 string, length long, received_at timestamp, outcome string")
    key = hashlib.sha256("".join(sorted(r[2] for r in seen)).encode()).hexdigest()[:16]
    store.replace_partitions(batch.withColumn("batch", F.lit(key)), f"{out}/uploads", "batch")
    landed = _land(spark, batch.where("outcome = 'STAGED'"), out, rules)
    if landed is None:
        return 3
    found = sliced(landed[0]).join(batch.selectExpr("path file_id", "received_at"), "file_id").withColumn("batch", F.lit(key))
    store.replace_partitions(stored_frames(spark, found, f"{out}/upload_frames", landed[0].count()), f"{out}/upload_frames", "day", "batch")
    return 0


def stored_frames(spark: SparkSession, found, target: str, rows: int):
    """Classified frames of a batch of so many rows (also received_at, batch) held against the frames under target, of which only the days
    of the batch's stamps and other batches are read."""
    found = found.withColumn("day", F.to_date("event_time"))
    days = [r.day for r in found.select("day").distinct().collect()]
    key = found.select("batch").first().batch if days else ""
    try:
        stored = spark.read.parquet(target).where(F.col("day").isin(days) & (F.col("batch").cast("string") != key) & ~F.col("is_source"))
        stored = stored.select(*(c.split()[0] for c in frames.STORED.split(", ")))
    except AnalysisException:  # no table yet
        stored = spark.createDataFrame([], frames.STORED)
    return frames.against_stored(found, stored, rows + stored.count())  # frames are no more than rows


def sliced(rows):
    """Classified frames of rows of text columns, fingerprinted by all their columns but keys."""
    payload = [c for c in rows.columns if c not in KEYS]
    fp = F.sha2(F.concat_ws("\x1f", *(F.concat(F.lit(f"{c}="), F.coalesce(F.trim(F.col(c)), F.lit("\x00NULL"))) for c in sorted(payload))), 256)
    rows = rows.withColumn("row_fp", fp)
    return frames.classify_replays(frames.slice_frames(rows, frames.observed_topology(rows)))


def reconstruct(spark: SparkSession, inbox: str, out: str, rules: coverage.CoverageRules, day: str | None = None) -> int:
    """Frames and events of an inbox (or of one local day of it, then under days/), as tables, with the chargers' gaps
    and changes of configuration; files that don't fit go to the quarantine table."""
    files = _listed(spark, inbox, out)
    rows, verdicts, _ = by_file(spark, files, out, rules.zone)
    quarantined(spark, files, verdicts, out)
    if day:
        rows = rows.where(business_date(F.col("event_time"), rules.zone) == F.lit(day).cast("date"))
        out = f"{out}/days/{day}"
    sliced(rows).write.mode("overwrite").parquet(f"{out}/frames")
    seen = observed(rows)
    found = events.reconstruct(seen, ALARMS, list(FAULTS), config="settings")
    for name, table in (found | {"timeline_gaps": events.timeline_gaps(seen)}).items():
        table.write.mode("overwrite").parquet(f"{out}/{name}")
    return 0


def observed(rows):
    """Rows of files as observations that events are made of."""
    settings = [c for c in rows.columns if c.startswith("config")]
    seen = rows.withColumn("connector_id", identity(F.col("connector_no"))).withColumn("frame_sequence", F.col("source_row_number"))
    seen = seen.withColumn("settings", F.create_map(*(x for c in settings for x in (F.lit(c), F.col(c)))) if settings else F.create_map().cast("map<string,string>"))
    for c in ("connector_status", "session_id"):
        if c not in seen.columns:
            seen = seen.withColumn(c, F.lit(None).cast("string"))
    return seen


def resume(spark: SparkSession, inbox: str, out: str, rules: coverage.CoverageRules) -> int:
    """Bring the events under resumed/ up to date with an inbox's files that they don't know yet: of each charger only the
    days from the last quiet one before its new rows to the first one that they leave as it was; see plans.resumed."""
    store_of = f"{out}/resumed"
    files = _listed(spark, inbox, out)
    files = files.join(resumed.known_files(spark, store_of), "sha256", "left_anti").dropDuplicates(["sha256"])
    files = spark.createDataFrame([tuple(r) for r in files.select("path", "name", "sha256", "length", "received_at").collect()], "path string, name string, sha256 string, length long, received_at timestamp")
    if files.isEmpty():
        return 3
    rows, verdicts, _ = by_file(spark, files, out, rules.zone)
    quarantined(spark, files, verdicts, out)
    fit = [r.sha256 for r in files.join(verdicts.where("reason is null"), "path").select("sha256").collect()]
    if not fit:
        return 3
    resumed.add(spark, observed(rows), store_of, list(ALARMS), list(FAULTS), rules.zone, fit)
    return 0


def silver_specs(spark: SparkSession, files, out: str) -> list[silver.FieldSpec]:
    """What each column of files (sha256) staged under `out` is, by its name: its type, and the table and component that its values belong to."""
    heads = staging.headers(spark, f"{out}/staged").join(files.selectExpr("sha256 file_id").distinct(), "file_id", "left_semi").groupBy("canonical_name").agg(F.min("source_name").alias("source_name"))
    keys = ("charger_id", "connector_no", "connector_id", "smr_no", "rectifier_number", "event_time", "logged_at_time")
    specs = []
    for r in classifier.classified(heads).orderBy("canonical_name").collect():
        family = {"COUNTER": "lifecycle", "COMMUNICATION": "communication", "CONTACTOR": "contactor"}.get(r.category) or ("rectifier" if "rectifier" in r.canonical_name else r.entity.lower() if r.entity != "UNKNOWN" else "charger")
        masked = next((m for part, m in silver.MASKS.items() if part in r.canonical_name and "temp" in r.canonical_name), ())
        if r.canonical_name not in keys:
            specs.append(silver.FieldSpec(r.canonical_name, {"DATETIME": "DATETIME", "FLOAT": "FLOAT", "INTEGER": "INTEGER", "DURATION": "DURATION"}.get(r.kind, "STRING"), silver.SCOPES.get(family), family, masked))
    return specs


def build_silver(spark: SparkSession, inbox: str, out: str, rules: coverage.CoverageRules) -> int:
    """Typed tables of an inbox's frames, their provenance and findings, as tables under silver/."""
    files = _listed(spark, inbox, out)
    rows, verdicts, _ = by_file(spark, files, out, rules.zone)
    quarantined(spark, files, verdicts, out)
    rows = frames.occurrence_index(rows.where("position is not null and event_time is not null"), ["file_id", "charger_id", "event_time", "position"], ["source_row_number"])
    rows = rows.withColumnRenamed("occurrence", "frame_sequence").withColumn("frame_id", F.sha2(F.concat_ws("\x1f", "file_id", "charger_id", F.col("event_time").cast("string"), F.col("frame_sequence").cast("string")), 256))
    rows = rows.withColumn("rectifier_number", F.col("rectifier_number") if "rectifier_number" in rows.columns else F.col("smr_no"))
    def kept(table, name):
        """A table of which others are made, written first and read back."""
        table.write.mode("overwrite").parquet(f"{out}/silver/{name}")
        return spark.read.schema(table.schema).parquet(f"{out}/silver/{name}")

    for name, table in silver.build_tables(rows, silver_specs(spark, files, out), rules.zone, kept).items():
        if name not in silver.KEPT:
            table.write.mode("overwrite").parquet(f"{out}/silver/{name}")
    return 0


def dictionary(spark: SparkSession, root: str) -> Dictionary:
    """The field dictionary of a root file and those in its folder."""
    folder = root.rpartition("/")[0] or "."
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder).select(F.col("_metadata.file_path").alias("p"), "value").collect()
    documents = {scan.plain(r.p): r.value for r in texts}
    name = root.rpartition("/")[2]
    at = next(p for p in sorted(documents, key=len) if p.endswith(f"/{name}"))
    return Dictionary.load(documents, at)


REGISTRY = "charger_id string, telemetry_expected boolean, lifecycle_status string, telemetry_start_date date, telemetry_end_date date, site_code string"


def registered_fleet(spark: SparkSession, source: str, out: str) -> None:
    """Keep a CSV of the expected fleet as the registry that `reconcile` reads."""
    spark.read.csv(source, header=True, schema=REGISTRY).write.mode("overwrite").parquet(f"{out}/registry")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridloom")
    parser.add_argument("job", choices=("run-daily", "process-uploads", "reconcile", "reconstruct", "resume", "build-silver"))
    parser.add_argument("--inbox")
    parser.add_argument("--out", required=True)
    parser.add_argument("--archive")
    parser.add_argument("--day")
    parser.add_argument("--dictionary", help="the root file of the field dictionary; files beside it may be included")
    parser.add_argument("--registry", help="a CSV of the expected fleet, kept under the output folder")
    parser.add_argument("--zone", default="Asia/Kolkata")
    parser.add_argument("--interval", type=int, default=120)
    try:
        args = parser.parse_args(argv)
    except SystemExit:
        return 2
    spark = SparkSession.builder.appName("gridloom").getOrCreate()
    rules = coverage.CoverageRules(interval_seconds=args.interval, zone=args.zone)
    try:
        if args.registry:
            registered_fleet(spark, args.registry, args.out)
        if args.job == "reconcile":
            tables = Tables(spark, {"coverage": f"{args.out}/coverage", "registry": f"{args.out}/registry"})
            daily_summary(tables, args.day).show(truncate=False)
            return 0
        if args.job == "reconstruct":
            return reconstruct(spark, args.inbox, args.out, rules, args.day)
        if args.job == "resume":
            return resume(spark, args.inbox, args.out, rules)
        if args.job == "build-silver":
            return build_silver(spark, args.inbox, args.out, rules)
        if args.job == "process-uploads":
            return process_uploads(spark, args.inbox, args.out, rules)
        return run_daily(spark, args.inbox, args.out, rules, args.archive, dictionary(spark, args.dictionary).fields if args.dictionary else None)
    except Exception as e:
        print(f"{args.job}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
