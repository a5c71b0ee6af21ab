"""CSV sources, stores, the dictionary and the streaming twins on small folders."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gridloom.operators.coverage import CoverageRules, day_coverage
from gridloom.sources import csv_files, store
from gridloom.sources.dictionary import Dictionary
from gridloom.streaming import live


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Charger ID,Event Time,Event Time,SMR No\nA,01-02-2026 00:00:01,x,1\nA,\"two\nlines\",,2\n".encode())
    (tmp_path / "b.csv").write_bytes("Charger ID,Note\nB,caf\xe9\n".encode("latin-1"))
    return str(tmp_path)


def test_headers_and_rows(spark, folder):
    assert [r.path.rsplit("/", 1)[1] for r in csv_files.discover(spark, folder).collect()] == ["a.csv", "b.csv"]
    heads = csv_files.headers(spark, folder).where("file_id like '%a.csv'").orderBy("position").collect()
    assert [(r.canonical_name, r.occurrence, r.requires_review) for r in heads] == [("charger_id", 1, False), ("event_time", 1, False), ("event_time_occurrence_2", 2, True), ("smr_no", 1, False)]
    rows = csv_files.table(spark, folder).orderBy("file_id", "source_row_number").collect()
    assert [(r.charger_id, r.source_row_number) for r in rows] == [("A", 0), ("A", 1), ("B", 0)]
    assert rows[1].event_time == "two\nlines" and rows[1].event_time_occurrence_2 is None and rows[2].note == "café"


def test_roles_and_formats(spark):
    assert csv_files.roles(["charger_id", "event_time", "connector_no", "smr_no"]) == {"EVENT_TIME": "event_time", "CHARGER_ID": "charger_id", "CONNECTOR": "connector_no", "SMR": "smr_no"}
    df = spark.createDataFrame([("31-12-2026",), ("01-02-2026",)], "t string")
    assert csv_files.best_time_format(df, "t", ("yyyy-MM-dd", "dd-MM-yyyy", "MM-dd-yyyy")) == "dd-MM-yyyy"


def test_registration_is_idempotent(spark):
    now = dt.datetime(2026, 1, 1)
    files = spark.createDataFrame([("s1", "a", now), ("s1", "b", now), ("s2", "c", now)], "sha256 string, name string, received_at timestamp")
    none = spark.createDataFrame([], "sha256 string, name string")
    first = {r.name: (r.outcome, r.original) for r in store.registered(files, none).collect()}
    assert first == {"a": ("REGISTERED", None), "b": ("DUPLICATE", "a"), "c": ("REGISTERED", None)}
    again = store.registered(files, files.select("sha256", "name"))
    assert {r.outcome for r in again.collect()} == {"SKIPPED"}


def test_staging_and_partitions(spark, folder, tmp_path):
    outcomes = {r.name: r.outcome for r in store.staged(spark, folder).collect()}
    assert outcomes == {"a.csv": "STAGED", "b.csv": "STAGED"}
    target = str(tmp_path / "t")
    one = spark.createDataFrame([("d1", 1), ("d2", 2)], "day string, n int")
    store.replace_partitions(one, target, "day")
    store.replace_partitions(spark.createDataFrame([("d2", 5)], "day string, n int"), target, "day")
    assert {(r.day, r.n) for r in spark.read.parquet(target).collect()} == {("d1", 1), ("d2", 5)}
    assert {(r.day, r.n) for r in store.upserted(one, spark.createDataFrame([("d1", 9)], "day string, n int"), "day").collect()} == {("d1", 9), ("d2", 2)}


def test_dictionary():
    root = json.dumps({"include": ["b.json"], "units": ["V"], "fields": [{"canonical_name": "volts", "source_name": "Grid Volts", "kind": "FLOAT", "unit": "V"}]})
    more = json.dumps({"fields": [{"canonical_name": "config", "pattern": "Config Parameter \\d+"}]})
    d = Dictionary.load({"x/a.json": root, "x/b.json": more}, "x/a.json")
    assert d.resolve("Grid Volts").canonical_name == d.resolve(" grid  volts").canonical_name == "volts"
    assert d.resolve("Config Parameter 7").canonical_name == "config" and d.resolve("else") is None
    with pytest.raises(ValueError, match="unknown units"):
        Dictionary.load({"a.json": json.dumps({"units": ["A"], "fields": [{"canonical_name": "v", "unit": "V"}]})}, "a.json")


def test_stream_equals_batch(spark, tmp_path):
    rules = CoverageRules(interval_seconds=600, zone="UTC")
    rows = [("A", dt.datetime(2026, 1, d, h, m)) for d in (1, 2) for h in range(4) for m in (0, 10, 10, 50)]
    df = spark.createDataFrame(rows, "charger_id string, event_time timestamp")
    source = str(tmp_path / "in")
    df.where(F.dayofmonth("event_time") == 2).write.parquet(source)
    df.where(F.dayofmonth("event_time") == 1).write.mode("append").parquet(source)  # late
    stream = live.observations(spark, source, "charger_id string, event_time timestamp", files_per_trigger=1)
    live.keep_days_current(stream, str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "cp"), rules).start().awaitTermination()
    columns = ["charger_id", "business_date", "unique_timestamps", "gap_count", "sample_pct"]
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out/coverage")).select(columns).collect()}
    assert got == {tuple(r) for r in day_coverage(df, rules).select(columns).collect()}
    counts = live.stamp_counts(spark.readStream.schema("charger_id string, event_time timestamp").parquet(source), "1 day").select("charger_id", "unique_timestamps")
    q = counts.writeStream.format("memory").queryName("stamps").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert all(r.unique_timestamps == 12 for r in spark.sql("select * from stamps").collect())
