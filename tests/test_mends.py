"""Late files, mixed batches, odd numbers and large files: what used to be lost without a word."""

import datetime as dt

from pyspark.sql import functions as F

from gridloom.functions import classifier
from gridloom.functions import scalars as S
from gridloom.operators import events
from gridloom.operators.coverage import CoverageRules
from gridloom.plans import jobs
from gridloom.sources import csv_files, store

from .test_jobs import inbox

HEADER = "Charger ID,Event Time,Connector No,SMR No"


def test_a_late_file_closes_a_days_only_gap(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    rules = CoverageRules(interval_seconds=3600, gap_factor=2.0, zone="UTC")
    stamp = lambda h: f"A,01-03-2026 {h:02d}:00:00,1,1"
    (source / "a.csv").write_text("\n".join([HEADER, *map(stamp, (0, 1, 2, 8, 9))]) + "\n")
    assert jobs.run_daily(spark, str(source), out, rules) == 0
    gaps = lambda: spark.read.schema("charger_id string, duration_seconds double, business_date date").parquet(f"{out}/gaps")
    assert [r.duration_seconds for r in gaps().collect()] == [6 * 3600.0]
    (source / "b.csv").write_text("\n".join([HEADER, *map(stamp, range(3, 8))]) + "\n")
    assert jobs.run_daily(spark, str(source), out, rules) == 0
    assert spark.read.parquet(f"{out}/coverage").first().gap_count == 0 and gaps().count() == 0


def test_rejected_files_take_nobodys_place(spark):
    rows = [("1/a.txt", "a.txt", 5, "x"), ("2/b.csv", "b.csv", 5, "x"), ("3/c.csv", "c.csv", 5, "x"), ("4/d.csv", "d.csv", 0, "e"), ("5/e.csv", "e.csv", 900, "y"), ("6/f.csv", "f.csv", 7, "z"), ("7/g.csv", "g.csv", 7, "q")]
    files = spark.createDataFrame(rows, "path string, name string, length long, sha256 string")
    got = {r.name: r.outcome for r in store.outcomes(files, file_bytes=500, batch_files=2).collect()}
    assert got == {"a.txt": "REJECTED_TYPE", "b.csv": "STAGED", "c.csv": "DUPLICATE_IN_BATCH", "d.csv": "REJECTED_EMPTY", "e.csv": "REJECTED_SIZE", "f.csv": "STAGED", "g.csv": "DEFERRED"}
    got = {r.name: r.outcome for r in store.outcomes(files, file_bytes=500, batch_bytes=11).collect()}
    assert got["b.csv"] == "STAGED" and got["f.csv"] == "DEFERRED"


def test_numbers_of_any_length(spark):
    cells = {
        "1": "1", "1.0": "1", "+1": "1", "-0": "0", "-0.00": "0", "007": "7", "1e3": "1000", "1.25E-2": "0.0125", ".5": "0.5", "5.": "5", "-1.50": "-1.5", "0e5": "0",
        "0.00000000000000000011": "0.00000000000000000011", "0.00000000000000000012": "0.00000000000000000012", "9" * 50 + ".10": "9" * 50 + ".1", "1e40": "1" + "0" * 40,
        "nan": None, "inf": None, "x": None, "": None, ".": None, "1e99999": None, "1 2": None, " 3 ": "3", None: None,
    }
    df = spark.createDataFrame([(k,) for k in cells], "c string")
    assert {r.c: r.n for r in df.select("c", S.canonical_number(F.col("c")).alias("n")).collect()} == cells


def test_large_files_are_named(spark, tmp_path, monkeypatch):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    inbox(source, "a.csv", "01", 3)
    inbox(source, "b.csv", "01", 24)
    monkeypatch.setattr(csv_files, "FILE_LIMIT", 1000)
    monkeypatch.setattr(csv_files.admitted, "__defaults__", (1000, *csv_files.admitted.__defaults__[1:]))
    assert jobs.run_daily(spark, str(source), out, CoverageRules(interval_seconds=3600)) == 0
    assert {(r.name, r.reason) for r in spark.read.parquet(f"{out}/quarantine").collect()} == {("b.csv", "too large")}
    assert [r.name for r in spark.read.parquet(f"{out}/files").collect()] == ["a.csv"]


def test_mostly_unparsed_stamps_are_not_admitted(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    inbox(source, "a.csv", "01", 24)
    text = (source / "a.csv").read_text().split("\n")
    (source / "b.csv").write_text("\n".join([text[0], *(x.replace("01-03-2026", "soon") if i % 5 == 0 else x.replace("A,", "B,") for i, x in enumerate(text[1:-1]))]) + "\n")
    assert jobs.run_daily(spark, str(source), out, CoverageRules(interval_seconds=3600)) == 0
    assert {(r.name, r.reason) for r in spark.read.parquet(f"{out}/quarantine").collect()} == {("b.csv", "timestamps don't parse")}


def test_headers_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"Charger\nID",Note\nA,x\n')
    assert [r.canonical_name for r in csv_files.headers(spark, str(tmp_path)).orderBy("position").collect()] == ["charger_id", "note"]
    row = csv_files.table(spark, str(tmp_path)).first()
    assert (row.charger_id, row.note, row.source_row_number) == ("A", "x", 0)


def test_a_batch_of_uploads(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    inbox(source, "a.csv", "01", 6)
    (source / "b.csv").write_bytes((source / "a.csv").read_bytes())
    (source / "c.csv").write_text("Owner,When\nx,y\n")
    (source / "d.txt").write_text("notes")
    rules = CoverageRules(interval_seconds=3600)
    assert jobs.process_uploads(spark, str(source), out, rules) == 0
    got = {r.name: r.outcome for r in spark.read.parquet(f"{out}/uploads").collect()}
    assert got == {"a.csv": "STAGED", "b.csv": "DUPLICATE_IN_BATCH", "c.csv": "STAGED", "d.txt": "REJECTED_TYPE"}
    assert {r.name for r in spark.read.parquet(f"{out}/quarantine").collect()} == {"c.csv"}
    assert spark.read.parquet(f"{out}/coverage").first().unique_timestamps == 6
    frames = spark.read.parquet(f"{out}/upload_frames")
    assert frames.count() == 6 and frames.select("batch").distinct().count() == 1


def test_events_with_gaps_and_settings(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    lines = [HEADER + ",Connector Status,Session ID,Grid Fail,Config Parameter 1"]
    for i, (h, m) in enumerate([(0, 0), (0, 5), (0, 10), (0, 15), (0, 20), (0, 25), (0, 30), (3, 0), (3, 5), (3, 10)]):
        lines.append(f"A,01-03-2026 {h:02d}:{m:02d}:00,1,1,{'Charging' if 2 <= i <= 7 else 'Available'},{'S1' if 2 <= i <= 7 else ''},{'Alarm' if 6 <= i <= 7 else 'ok'},{1 if i < 5 else 2}")
    lines.append("A,02-03-2026 00:00:00,1,1,Available,,ok,3")
    (source / "a.csv").write_text("\n".join(lines) + "\n")
    assert jobs.reconstruct(spark, str(source), out, CoverageRules(zone="UTC")) == 0
    session = spark.read.parquet(f"{out}/sessions").first()
    assert (session.session_id, session.confidence, session.has_gap) == ("S1", "LOW", True) and "EVENT_HAS_GAP" in session.quality_flags
    alarm = spark.read.parquet(f"{out}/alarms").where("code = 'grid_fail'").first()
    assert alarm.has_gap and alarm.confidence == "MEDIUM" and alarm.quality_flags == ["EVENT_HAS_GAP"]
    changes = [(r.event_time, r.changes["config_parameter_1"].new) for r in spark.read.parquet(f"{out}/config_changes").orderBy("event_time").collect()]
    assert changes == [(dt.datetime(2026, 3, 1, 0, 25), "2"), (dt.datetime(2026, 3, 2), "3")]
    assert jobs.reconstruct(spark, str(source), out, CoverageRules(zone="UTC"), "2026-03-02") == 0
    assert spark.read.parquet(f"{out}/days/2026-03-02/frames").count() == 1


def test_gaps_flag_intervals_of_several_codes(spark):
    t = lambda h: dt.datetime(2026, 1, 1, h)
    rows = [("A", c, t(h), h, h < 4) for c in ("x", "y") for h in range(6)]
    gaps = spark.createDataFrame([("A", t(1), t(2))], "charger_id string, gap_start timestamp, gap_end timestamp")
    df = spark.createDataFrame(rows, "charger_id string, code string, event_time timestamp, frame_sequence int, on boolean")
    got = events.active_intervals(df, "on", ["charger_id", "code"], 0.0, gaps, ["charger_id"]).collect()
    assert len(got) == 2 and all(r.has_gap for r in got)


def test_classifier(spark):
    names = ["Gun Temp DC+", "SMR Output Voltage", "Alarm Smoke", "Charger ID", "Event Time", "Reserved Spare 3", "Fan Speed", "Session Stop Reason Code"]
    df = spark.createDataFrame([(n,) for n in names], "source_name string")
    got = {r.source_name: (r.entity, r.field_class, r.category, r.kind, r.unit, r.aggregation, r.review_status) for r in classifier.classified(df).collect()}
    assert got["Gun Temp DC+"] == ("CONNECTOR", "CONTINUOUS_TELEMETRY", "THERMAL", "FLOAT", "°C", "MEAN", "AUTO_CLASSIFIED")
    assert got["SMR Output Voltage"][:2] == ("SMR", "CONTINUOUS_TELEMETRY") and got["SMR Output Voltage"][4] == "V"
    assert got["Alarm Smoke"] == ("ALARM", "ALARM_FLAG", "ALARM", "ENUM", None, "ANY_TRUE", "AUTO_CLASSIFIED")
    assert got["Charger ID"][3] == "IDENTIFIER" and got["Event Time"][3] == "DATETIME" and got["Event Time"][6] == "DOMAIN_REVIEW_REQUIRED"
    assert got["Reserved Spare 3"][0] == got["Reserved Spare 3"][1] == "UNKNOWN" and got["Reserved Spare 3"][5] == "UNKNOWN"
    assert got["Fan Speed"][4] == "rpm" and got["Session Stop Reason Code"][1] == "FAULT_CODE"
    assert {r.unit for r in classifier.classified(df, units=("V",)).collect()} == {None, "V"}


def test_landed_files_move_to_the_archive(spark, tmp_path):
    source, out, archive = tmp_path / "in", str(tmp_path / "out"), tmp_path / "done"
    source.mkdir()
    inbox(source, "a.csv", "01", 3)
    (source / "b.csv").write_text("Owner,When\nx,y\n")
    assert jobs.run_daily(spark, str(source), out, CoverageRules(interval_seconds=3600), str(archive)) == 0
    assert [p.name for p in source.iterdir()] == ["b.csv"] and [p.name for p in archive.iterdir()] == ["a.csv"]
