"""Quantiles and ranks from counts against plain Python, on values of many shapes; Silver tables of a small inbox."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import profile, ranks
from gridloom.operators.coverage import CoverageRules
from gridloom.plans import jobs


@pytest.mark.parametrize("shape", ["even", "one outlier", "ties", "single", "two"])
def test_quantiles(spark, shape):
    rng = random.Random(1)
    values = {"even": [rng.random() for _ in range(3000)], "one outlier": [rng.random() for _ in range(999)] + [1e15], "ties": [float(rng.randrange(5)) for _ in range(2000)], "single": [4.5], "two": [1.0, 2.0]}[shape]
    rows = [("a", v) for v in values] + [("b", v * 3) for v in values[: len(values) // 2 + 1]] + [("a", None)]
    counts = spark.createDataFrame(rows, "g string, v double").groupBy("g", "v").agg(F.count("*").alias("n"))
    every = [{r.g: r.q for r in f(counts, ["g"], "v", "n", (0.0, 0.05, 0.5, 0.95, 1.0)).collect()} for f in (ranks.quantiles, ranks.group_quantiles)]
    for g, got in ((g, got) for g in "ab" for got in every):
        own = [v for k, v in rows if k == g and v is not None]
        assert got[g] == pytest.approx(list(np.quantile(own, (0.0, 0.05, 0.5, 0.95, 1.0))), rel=1e-12)
    own = sorted(v for k, v in rows if k == "a" and v is not None)
    ranked = {r.v: r["rank"] for r in ranks.average_ranks(counts.where("g = 'a'"), ["g"], "v", "n").collect()}
    assert ranked == {v: own.index(v) + (own.count(v) + 1) / 2 for v in set(own)}


def test_ranks_of_groups(spark):
    rows = [("a", 3.0, 2), ("a", 1.0, 1), ("a", None, 4), ("b", None, 1)]
    got = {(r.g, r.v): (r.upto, r.total) for r in ranks.with_ranks(spark.createDataFrame(rows, "g string, v double, n long"), ["g"], "v", "n").collect()}
    assert got == {("a", None): (0, 3), ("a", 1.0): (1, 3), ("a", 3.0): (3, 3), ("b", None): (0, 0)}


def test_only_number_columns_have_a_median(spark):
    rows = [(str(i), "x" if i % 10 == 0 else str(i), None) for i in range(50)]
    got = profile.numeric_profile(spark.createDataFrame(rows, "a string, b string, c string"), ["a", "b", "c"]).collect()
    assert [(r["column"], r.n, r.median, r["std"]) for r in got] == [("a", 50, 24.5, round(statistics.stdev(range(50)), 4))]
    seen = {r["column"]: (r.observed, r.examples) for r in profile.observed_values(spark.createDataFrame([(str(i % 60), "k") for i in range(61)], "a string, b string")).collect()}
    assert seen["b"] == (["k"], ["k"]) and seen["a"][0] is None and seen["a"][1][0] == "0" and len(seen["a"][1]) == 5


def test_silver_tables_of_an_inbox(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    head = "Charger ID,Event Time,Connector No,SMR No,Gun Temp DC+,SMR DcDc Temperature,Alarm Smoke,Config Parameter 1,Last Charge Session Stop Reason,Grid Voltage R,Modem RSRP Signal,Site Name"
    (source / "a.csv").write_text(head + "\nA,01-03-2026 00:00:00,1,1,45,-150,Alarm,7,Local,230,-80,Hyd\nA,01-03-2026 00:00:00,2,2,999,41,Alarm,7,,231,-80,Hyd\n")
    assert jobs.build_silver(spark, str(source), out, CoverageRules(zone="UTC")) == 0
    table = lambda n: spark.read.parquet(f"{out}/silver/{n}")
    gun = {r.scope_id: (r.gun_temp_dc, r.gun_temp_dc_raw, r.gun_temp_dc_masked) for r in table("connector_telemetry").collect()}
    assert gun == {"1": (45.0, 45.0, False), "2": (None, 999.0, True)}
    smr = {r.scope_id: r.smr_dc_dc_temperature for r in table("smr_telemetry").collect()}
    assert smr == {"1": None, "2": 41.0}
    alarm = table("alarm_observation").first()
    assert (alarm.active_alarm_codes, alarm.active_alarms_count) == (["alarm_smoke"], 1)
    config = table("configuration_snapshot").first()
    assert config.raw_config == {"config_parameter_1": "7"} and len(config.config_hash) == 64
    assert {r.stop_reason for r in table("session_observation").collect()} == {"Local", None}
    codes = {(r.code, r["name"]) for r in table("quality_findings").collect()}
    assert {("CONFLICTING_VALUES", "grid_voltage_r"), ("SENTINEL_MASKED", "gun_temp_dc"), ("SENTINEL_MASKED", "smr_dc_dc_temperature")} <= codes
    assert table("observation_provenance").where("name = 'grid_voltage_r'").first().conflict_values == "230|231"
    assert {r.site_name for r in table("site_metadata").collect()} == {"Hyd"} and table("lifecycle_counter_observation").count() == 1
