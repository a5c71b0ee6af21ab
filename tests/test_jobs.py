"""The jobs over a small inbox, and the read functions over their tables."""

import datetime as dt
import os

from gridloom.operators.coverage import CoverageRules
from gridloom.plans import api, jobs
from gridloom.sources.dictionary import Definition


def inbox(folder, name, day, hours):
    lines = ["Charger ID,Event Time,Connector No,SMR No,Connector Status,Session ID,Grid Fail"]
    for h in range(hours):
        for c, s in ((1, 1), (2, 2)):
            lines.append(f"A,{day}-03-2026 {h:02d}:00:00,{c},{s},{'Charging' if h == 1 else 'Available'},,{'Alarm' if h == 2 else 'Not alarm'}")
    (folder / name).write_text("\n".join(lines) + "\n")


def test_daily_run_twice(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    inbox(source, "a.csv", "01", 12)
    rules = CoverageRules(interval_seconds=3600, zone="Asia/Kolkata")
    assert jobs.run_daily(spark, str(source), out, rules) == 0
    assert jobs.run_daily(spark, str(source), out, rules) == 3
    inbox(source, "b.csv", "01", 24)  # a late file of the same day
    assert jobs.run_daily(spark, str(source), out, rules) == 0
    registry = spark.createDataFrame([("A", True, "ACTIVE", None, None, "S"), ("B", True, "ACTIVE", None, None, "S")], "charger_id string, telemetry_expected boolean, lifecycle_status string, telemetry_start_date date, telemetry_end_date date, site_code string")
    t = api.Tables(spark, {"coverage": f"{out}/coverage", "gaps": (f"{out}/gaps", "charger_id string, duration_seconds double, business_date date"), "registry": registry})
    days = api.coverage(t).collect()
    assert [(r.charger_id, str(r.business_date), r.unique_timestamps, r.sample_pct) for r in days] == [("A", "2026-03-01", 24, 100.0)]
    assert api.day_gaps(t).count() == 0
    both = {r.charger_id: (r.arrival, r.completeness) for r in api.reconciliation(t, "2026-03-01").collect()}
    assert both == {"A": ("RECEIVED", "COMPLETE"), "B": ("MISSING", "NO_DATA")}
    summary = api.daily_summary(t, "2026-03-01").first()
    assert (summary.n_received, summary.n_missing, summary.fleet_coverage_pct, summary.delivery_pct) == (1, 1, 50.0, 50.0)
    assert api.coverage_of_site(t, "S").count() == 1 and api.last_delivery(t, "2026-03-02").first().charger_id == "A"


def test_reconstruct(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    inbox(source, "a.csv", "01", 4)
    assert jobs.reconstruct(spark, str(source), out, CoverageRules(zone="UTC")) == 0
    t = api.Tables(spark, {n: f"{out}/{n}" for n in ("frames", "sessions", "alarms", "faults", "transitions")})
    assert api.frame_summary(t, "charger_id").first().timestamps == 4
    assert {(r.connector_id, r.duration_seconds) for r in api.sessions(t).collect()} == {("1", 3600.0), ("2", 3600.0)}
    alarm = api.alarms(t).collect()
    assert [(r.code, r.start_time, r.end_time) for r in alarm] == [("grid_fail", dt.datetime(2026, 3, 1, 2), dt.datetime(2026, 3, 1, 3))]
    assert {(r.from_state, r.to_state) for r in api.transitions(t, connector_id="1").collect()} == {("Available", "Charging"), ("Charging", "Available")}


def test_mixed_exports(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    inbox(source, "a.csv", "01", 24)
    text = (source / "a.csv").read_text()
    other = text.replace("\nA,01-03-2026", "\nB,2026-03-01").replace("Charger ID,Event Time", "Charger No,Logged At Time")
    (source / "b.csv").write_text("\n".join(other.split("\n")[:25]) + "\n")
    (source / "c.csv").write_text(text.replace("01-03-2026", "March 1st").replace("\nA", "\nC"))
    (source / "d.csv").write_text(text.replace("Charger ID", "Owner"))
    rules = CoverageRules(interval_seconds=3600, zone="Asia/Kolkata")
    assert jobs.run_daily(spark, str(source), out, rules) == 0
    days = {(r.charger_id, str(r.business_date)): r.unique_timestamps for r in spark.read.parquet(f"{out}/coverage").collect()}
    assert days == {("A", "2026-03-01"): 24, ("B", "2026-03-01"): 12}
    assert {r.name for r in spark.read.parquet(f"{out}/files").collect()} == {"a.csv", "b.csv"}
    assert jobs.run_daily(spark, str(source), out, rules) == 3
    bad = {r.name: r.reason for r in spark.read.parquet(f"{out}/quarantine").collect()}
    assert bad == {"c.csv": "no time format fits", "d.csv": "no column for a required role"}
    assert spark.read.parquet(f"{out}/quarantine").count() == 2
    assert jobs.reconstruct(spark, str(source), out, rules) == 0
    found = spark.read.parquet(f"{out}/frames")
    assert {r.charger_id for r in found.select("charger_id").distinct().collect()} == {"A", "B"} and found.where("event_time is null").count() == 0


def test_a_content_is_parsed_once_for_all_jobs(spark, tmp_path):
    """Jobs share the staged table; what has landed is read after its file has left the inbox."""
    source, out, archive = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "old")
    source.mkdir()
    inbox(source, "a.csv", "01", 12)
    rules = CoverageRules(interval_seconds=3600, zone="UTC")
    assert jobs.run_daily(spark, str(source), out, rules, archive) == 0
    assert not (source / "a.csv").exists()
    batches = lambda: sorted(os.listdir(f"{out}/staged/rows"))
    once = batches()
    assert jobs.reconstruct(spark, str(source), out, rules) == 0 and jobs.build_silver(spark, str(source), out, rules) == 0
    assert batches() == once and len(once) == 1
    assert spark.read.parquet(f"{out}/frames").select("event_time").distinct().count() == 12
    assert spark.read.parquet(f"{out}/silver/charger_telemetry").count() > 0
    bronze = spark.read.parquet(f"{out}/bronze").collect()
    assert [(r.name, bytes(r.content).startswith(b"Charger ID")) for r in bronze] == [("a.csv", True)]


def test_critical_findings_quarantine(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    inbox(source, "a.csv", "01", 24)
    inbox(source, "b.csv", "02", 24)
    text = (source / "b.csv").read_text().replace("Grid Fail", "Grid State")
    (source / "b.csv").write_text(text + text.split("\n")[1] + "\n")
    defs = [Definition("grid_fail", required=True, allowed=("Alarm",)), Definition("connector_no", kind="INTEGER", low=1, high=1)]
    rules = CoverageRules(interval_seconds=3600, zone="UTC")
    assert jobs.run_daily(spark, str(source), out, rules, definitions=defs) == 0
    assert [(r.name, r.reason) for r in spark.read.parquet(f"{out}/quarantine").collect()] == [("b.csv", "critical findings")]
    assert [r.name for r in spark.read.parquet(f"{out}/files").collect()] == ["a.csv"]
    assert {str(r.business_date) for r in spark.read.parquet(f"{out}/coverage").collect()} == {"2026-03-01"}
    found = {(r.file_id[-5:], r.code, r.severity, r.field, r["count"]) for r in spark.read.parquet(f"{out}/findings").collect() if r.code not in ("UNKNOWN_FIELD", "ALL_NULL_FIELD")}
    assert found == {
        ("a.csv", "UNKNOWN_ENUM_VALUE", "WARNING", "grid_fail", 46), ("a.csv", "OUT_OF_RANGE", "ERROR", "connector_no", 1), ("b.csv", "MISSING_REQUIRED_FIELD", "CRITICAL", "grid_fail", 1),
        ("b.csv", "OUT_OF_RANGE", "ERROR", "connector_no", 1), ("b.csv", "EXACT_DUPLICATE", "WARNING", None, 1), ("b.csv", "LOGICAL_KEY_COLLISION", "WARNING", None, 1),
    }
    scores = {r.file_id[-5:]: r for r in spark.read.parquet(f"{out}/scores").collect()}
    assert scores["a.csv"].schema_score == 90.0 and scores["b.csv"].schema_score == 60.0 and scores["a.csv"].overall_score > scores["b.csv"].overall_score
    assert sorted(r.version for r in spark.read.parquet(f"{out}/schemas").collect()) == [1, 2]


def test_reconcile_reads_a_registry_that_a_job_writes(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    inbox(source, "a.csv", "01", 24)
    (tmp_path / "fleet.csv").write_text("charger_id,telemetry_expected,lifecycle_status,telemetry_start_date,telemetry_end_date,site_code\nA,true,ACTIVE,,,S\nB,true,ACTIVE,,,S\n")
    assert jobs.run_daily(spark, str(source), out, CoverageRules(interval_seconds=3600, zone="UTC")) == 0
    jobs.registered_fleet(spark, str(tmp_path / "fleet.csv"), out)
    t = api.Tables(spark, {"coverage": f"{out}/coverage", "registry": f"{out}/registry"})
    summary = api.daily_summary(t, "2026-03-01").first()
    assert (summary.n_received, summary.n_missing) == (1, 1)


def test_frames_of_later_uploads_are_held_against_stored_ones(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    rules = CoverageRules(interval_seconds=3600, zone="UTC")
    inbox(source, "a.csv", "01", 4)
    assert jobs.process_uploads(spark, str(source), out, rules) == 0
    inbox(source, "b.csv", "01", 6)  # four stamps as before, two new
    changed = (source / "b.csv").read_text().replace("00:00:00,1,1,Available", "00:00:00,1,1,Faulted", 1)
    (source / "b.csv").write_text(changed)
    assert jobs.process_uploads(spark, str(source), out, rules) == 0
    found = spark.read.parquet(f"{out}/upload_frames").orderBy("event_time", "file_id").collect()
    got = [(r.event_time.hour, r.file_id[-5:], r.is_source, r.first_file[-5:], r.stored_sequence) for r in found]
    assert got[:4] == [(0, "a.csv", False, "a.csv", 0), (0, "b.csv", False, "b.csv", 1), (1, "a.csv", False, "a.csv", 0), (1, "b.csv", True, "a.csv", None)]
    assert got[8:] == [(4, "b.csv", False, "b.csv", 0), (5, "b.csv", False, "b.csv", 0)]
