"""Sources and stores by their protocols; alarm runs of a stream against those of a batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridloom.operators import events
from gridloom.sources.protocols import FolderSource, Source, StagedSource, Storage, TableStorage
from gridloom.streaming import live


def test_folder_source(spark, tmp_path):
    folder, archive = tmp_path / "in", tmp_path / "done"
    folder.mkdir(), archive.mkdir()
    (folder / "a.csv").write_text("x\n1\n"), (folder / "b.csv").write_text("y" * 100), (folder / "c.txt").write_text("no")
    (archive / "a.csv").write_text("older")
    source = FolderSource(str(folder), str(archive), max_bytes=50)
    assert isinstance(source, Source)
    assert [r.name for r in source.discover(spark).collect()] == ["a.csv", "b.csv"]
    got = {r.path.rsplit("/", 1)[1]: (r.content and bytes(r.content), r.reason) for r in source.fetch(spark).collect()}
    assert got == {"a.csv": (b"x\n1\n", None), "b.csv": (None, "too large")}
    path = f"file:{folder}/a.csv"
    assert source.acknowledge([path], ok=False) == [path]
    (moved,) = source.acknowledge([path], ok=True)
    assert moved != str(archive / "a.csv") and open(moved).read() == "x\n1\n" and not (folder / "a.csv").exists()
    with pytest.raises(ValueError, match="outside"):
        source.acknowledge([str(tmp_path / "else.csv")], ok=True)


def test_staged_source(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text(name)
    (tmp_path / "link.csv").symlink_to(tmp_path / "a.csv")
    source = StagedSource(str(tmp_path), ["a.csv"])
    assert [r.name for r in source.discover(spark).collect()] == ["a.csv"]
    assert source.acknowledge([str(tmp_path / "a.csv")], ok=True) == [] and not (tmp_path / "a.csv").exists()
    for odd in ("link.csv", "../x.csv"):
        with pytest.raises(ValueError, match="plain file"):
            StagedSource(str(tmp_path), [odd])
    with pytest.raises(ValueError, match="no member"):
        source.acknowledge([str(tmp_path / "b.csv")], ok=True)


def test_table_storage(spark, tmp_path):
    kept = TableStorage(spark, str(tmp_path / "bronze"))
    assert isinstance(kept, Storage) and not kept.exists("0")
    files = spark.createDataFrame([("in/a.csv", bytearray(b"one")), ("in/b.csv", bytearray(b"one")), ("in/c.csv", bytearray(b"two"))], "path string, content binary")
    assert kept.store(files, "2026-01-01") == 2 and kept.store(files, "2026-01-02") == 0
    sha = "7692c3ad3540bb803c020b3aee66cd8887123234ea0c6e7143c0add73ff431ed"
    assert kept.exists(sha) and kept.open(sha) == b"one"
    with pytest.raises(KeyError):
        kept.open("0")
    kept.quarantine(spark.createDataFrame([("p", "n", "s", "odd"), ("q", "m", "t", None)], "path string, name string, sha256 string, reason string"))
    assert spark.read.parquet(str(tmp_path / "bronze/quarantine")).count() == 1


def test_alarm_runs_of_a_stream(spark, tmp_path):
    t = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
    on = {"x": (2, 3, 4, 9, 10, 20), "y": (0, 1)}
    rows = [("A", c, t(m), m in on[c]) for c in on for m in range(25)]
    schema = "charger_id string, code string, event_time timestamp, active boolean"
    df = spark.createDataFrame(rows, schema)
    source = str(tmp_path / "in")
    df.where(F.minute("event_time") % 3 != 0).coalesce(1).write.parquet(source)
    df.where(F.minute("event_time") % 3 == 0).coalesce(1).write.mode("append").parquet(source)  # late, within the watermark
    for minute in (300, 400, 500):
        spark.createDataFrame([("B", "z", t(minute), False)], schema).coalesce(1).write.mode("append").parquet(source)
    stream = live.observations(spark, source, schema, files_per_trigger=1)
    q = live.alarm_runs(stream, late="1 hour").writeStream.format("memory").queryName("alarm_runs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    columns = ["charger_id", "code", "start_time", "last_active", "end_time", "observations"]
    got = {tuple(r) for r in spark.table("alarm_runs").select(columns).collect()}
    batch = events.active_intervals(df.withColumn("frame_sequence", F.lit(0)), "active", ["charger_id", "code"])
    assert got == {tuple(r) for r in batch.select(columns).collect()} and len(got) == 4
