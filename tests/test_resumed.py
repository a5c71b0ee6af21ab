"""Events kept up run by run equal those of all rows at once, whatever comes late."""

import datetime as dt
import random

from pyspark.sql import functions as F

from gridloom.operators import events, history
from gridloom.operators.coverage import CoverageRules
from gridloom.plans import jobs, resumed

from .test_jobs import inbox

ALARMS, FAULTS = {"grid_fail": "MAJOR", "door_open": "MINOR"}, ["fan_fault"]
SCHEMA = "charger_id string, connector_id string, event_time timestamp, frame_sequence long, connector_status string, session_id string, stop_reason string, start_soc double, meter_energy double, grid_fail string, door_open string, fan_fault string, settings map<string,string>"


def made(seed, days=9, chargers=3):
    """Observations with sessions, alarms and settings that may last over midnights, and hours without any."""
    rnd, rows, at = random.Random(seed), [], dt.datetime(2026, 3, 1, 0, 7)
    for c in range(chargers):
        status, alarm, setting = {}, "ok", "a"
        for step in range(days * 12):
            now = at + dt.timedelta(hours=2 * step, minutes=c)
            if rnd.random() < 0.25:
                continue
            k = rnd.choice(["1", "2", None])
            quiet = step % 12 > 8
            status[k] = rnd.choice(["Available"] * 3 if quiet else ["Available", "Preparing", "Charging", "Charging", "Faulted", "", None])
            alarm = "ok" if quiet else rnd.choice(["ok", "ok", "Alarm", alarm])
            setting = rnd.choice([setting] * 6 + ["a", "b"])
            busy = status[k] == "Charging"
            sid = f"s{step // 5}" if busy and rnd.random() < 0.5 else rnd.choice([None, None, "0"])
            settings = {"x": setting} if rnd.random() < 0.9 else {}
            rows.append((f"c{c}", k, now, step, status[k], sid, rnd.choice([None, None, "Local"]) if busy else None, float(step), float(2 * step), alarm, "Alarm" if busy and rnd.random() < 0.3 else None, rnd.choice(["ok", "Alarm"]) if not quiet else "ok", settings))
    return rows


def plain(df):
    names = sorted(df.columns)
    cells = [F.to_json(F.struct(c)).alias(c) for c in names]
    return names, sorted(tuple(r) for r in df.select(*cells).collect())


def test_equals_all_rows_at_once(spark, tmp_path):
    rows, out = made(1), str(tmp_path / "out")
    rnd = random.Random(1)
    late = {i for i, r in enumerate(rows) if (r[2].day in (3, 4) and r[0] != "c0") or rnd.random() < 0.02}
    parts = [[r for i, r in enumerate(rows) if i not in late], [rows[i] for i in late if rows[i][0] != "c2"], [rows[i] for i in late if rows[i][0] == "c2"]]
    for part in parts:
        resumed.add(spark, spark.createDataFrame(part, SCHEMA), out, list(ALARMS), FAULTS, "UTC")
    got = resumed.tables(spark, out, ALARMS)
    every = spark.createDataFrame(rows, SCHEMA)
    want = events.reconstruct(every, ALARMS, FAULTS, config="settings") | {"timeline_gaps": events.timeline_gaps(every)}
    assert set(got) == set(want)
    for name in want:
        assert plain(got[name]) == plain(want[name]), name
        assert want[name].count() > 0, name


def test_a_late_day_touches_few_others(spark, tmp_path):
    """A day that comes late is recomputed with the one after it, whose first step it changes; a run that didn't end is ignored."""
    out, at = str(tmp_path / "out"), dt.datetime(2026, 3, 1)

    def day(d, alarm="ok"):
        rows = [("c", "1", at + dt.timedelta(days=d, hours=h), h, "Charging" if h == 5 else "Available", None, None, None, None, alarm if h == 3 else "ok", None, None, {"x": "1"}) for h in range(24)]
        return spark.createDataFrame(rows, SCHEMA)

    def add(rows):
        resumed.add(spark, rows, out, list(ALARMS), FAULTS, "UTC")
        return spark.read.parquet(f"{out}/points")

    first = day(0)
    for d in (*range(1, 10), *range(11, 40)):
        first = first.union(day(d))
    assert add(first).groupBy("run").count().count() == 1
    points = add(day(10, "Alarm"))
    last = points.agg(F.max("run")).first()[0]
    assert [str(r.day) for r in points.where(F.col("run") == last).orderBy("day").collect()] == ["2026-03-11", "2026-03-12"]
    day(11, "Alarm").withColumns({"day": F.to_date("event_time"), "run": F.lit("000000003-lost")}).write.mode("append").partitionBy("day", "run").parquet(f"{out}/observations")
    got = resumed.tables(spark, out, ALARMS)
    assert [(str(r.start_time), r.severity, r.has_gap) for r in got["alarms"].collect()] == [("2026-03-11 03:00:00", "MAJOR", False)]
    assert got["sessions"].count() == 40 and got["timeline_gaps"].count() == 0
    add(day(50))
    assert resumed.tables(spark, out, ALARMS)["timeline_gaps"].count() == 1


def test_profiles_of_parts_add_up(spark):
    rows = spark.createDataFrame(made(3), SCHEMA)
    steps = history.step_counts(rows.withColumn("day", F.to_date("event_time")), ["charger_id", "day"])
    assert plain(history.profile_of_steps(steps)) == plain(history.sampling_profile(rows))


def test_resume_job(spark, tmp_path):
    source, out, rules = tmp_path / "in", str(tmp_path / "out"), CoverageRules(zone="UTC")
    source.mkdir()
    for n, d in (("a", "01"), ("c", "03")):
        inbox(source, f"{n}.csv", d, 24)
    assert jobs.resume(spark, str(source), out, rules) == 0
    assert jobs.resume(spark, str(source), out, rules) == 3
    inbox(source, "b.csv", "02", 24)
    assert jobs.resume(spark, str(source), out, rules) == 0
    assert jobs.reconstruct(spark, str(source), f"{out}/all", rules) == 0
    got = resumed.tables(spark, f"{out}/resumed", jobs.ALARMS)
    assert got["alarms"].count() == 3
    for name in ("sessions", "alarms", "transitions", "timeline_gaps"):
        assert plain(got[name]) == plain(spark.read.parquet(f"{out}/all/{name}")), name
