"""Goldens of the telemetry operators on small fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.operators import coverage, events, fleet, frames, history, quality, research, silver

T0 = dt.datetime(2026, 8, 10, 10, 0, 0)


def at(minutes, seconds=0):
    return T0 + dt.timedelta(minutes=minutes, seconds=seconds)


def test_full_day_is_complete(spark):
    start = dt.datetime(2026, 8, 9, 18, 30)  # local midnight at +05:30
    rows = spark.createDataFrame([("A", start + dt.timedelta(seconds=120 * i)) for i in range(720)], "charger_id string, event_time timestamp")
    day = coverage.day_coverage(rows).collect()
    assert len(day) == 1 and day[0].sample_pct == 100.0 and day[0].completeness == "COMPLETE" and day[0].gap_count == 0 and str(day[0].business_date) == "2026-08-10"
    assert coverage.day_gaps(rows).count() == 0


def test_repeated_rows_change_no_coverage(spark):
    rows = spark.createDataFrame([("A", "f", at(0)), ("A", "g", at(0)), ("A", "f", at(60))], "charger_id string, file_id string, event_time timestamp")
    day = coverage.day_coverage(rows).first()
    assert day.unique_timestamps == 2 and day.overlap_timestamps == 1
    gap = coverage.day_gaps(rows).first()
    assert (gap.duration_seconds, gap.missing_samples, gap.severity) == (3600.0, 29, "MODERATE")


def test_offsets_round_trip(spark):
    rows = spark.createDataFrame([("f", "A", at(0)), ("f", "A", at(2)), ("f", "A", at(2))], "file_id string, charger_id string, event_time timestamp")
    days = coverage.file_days(rows)
    assert days.first().row_count == 3
    assert {r.event_time for r in coverage.expand_offsets(days).collect()} == {at(0), at(2)}


def _rows(spark, cells):
    return spark.createDataFrame([("f", "A", at(0), p, fp, i) for i, (p, fp) in enumerate(cells)], "file_id string, charger_id string, event_time timestamp, position string, row_fp string, source_row_number int")


EIGHT = [f"C{c}/S{s}" for c in (1, 2) for s in (1, 2, 3, 4)]


def _classes(spark, cells):
    topology = spark.createDataFrame([("A", EIGHT)], "charger_id string, expected array<string>")
    found = frames.classify_replays(frames.slice_frames(_rows(spark, cells), topology)).orderBy("frame_sequence").collect()
    return [(r.status, r.duplicate_class, r.replay_of) for r in found]


def test_frames(spark):
    one = [(p, "x" + p) for p in EIGHT]
    other = [(p, "y" + p) for p in EIGHT]
    assert _classes(spark, one) == [("COMPLETE", "UNIQUE", None)]
    assert _classes(spark, one + one) == [("COMPLETE", "UNIQUE", None), ("COMPLETE", "FULL_FRAME_REPLAY", 0)]
    assert _classes(spark, one + other + other)[1:] == [("COMPLETE", "SAME_TIMESTAMP_DISTINCT_FRAME", None), ("COMPLETE", "FULL_FRAME_REPLAY", 1)]
    # equal fragments are partial replays of frame 0 each, never of each other
    assert _classes(spark, one + one[:4] + one[:4])[1:] == [("PARTIAL", "PARTIAL_REPLAY", 0), ("PARTIAL", "PARTIAL_REPLAY", 0)]
    assert _classes(spark, one[:3])[0][0] == "SEVERELY_INCOMPLETE"
    assert _classes(spark, [*one, ("C9/S1", "z")])[0][0] == "MALFORMED"


def test_too_many_frames_become_one(spark):
    assert _classes(spark, [("C1/S1", str(i)) for i in range(65)]) == [("AMBIGUOUS", "UNIQUE", None)]


def test_position(spark):
    rows = spark.createDataFrame([("1.0", " 3"), (None, "1"), ("2", "N/A")], "connector_no string, smr_no string")
    assert [r.position for r in frames.with_position(rows).collect()] == ["C1/S3", None, None]


def test_counter(spark):
    rows = spark.createDataFrame([("A", at(i), 0, v) for i, v in enumerate([100, 105, 111, 118, 3, 8])], "charger_id string, event_time timestamp, frame_sequence int, v int")
    moves = history.counter_transitions(rows, "v")
    assert [r.transition for r in moves.orderBy("event_time").collect()] == ["INITIAL", "INCREASED", "INCREASED", "INCREASED", "RESET_CANDIDATE", "INCREASED"]
    report = history.counter_report(moves).first()
    assert (report.increases, report.decreases, report.resets) == (4, 1, 1)


def test_history_gap(spark):
    rows = spark.createDataFrame([("A", at(m), 0) for m in (0, 2, 4, 6, 40)], "charger_id string, event_time timestamp, frame_sequence int")
    profile = spark.createDataFrame([("A", 120.0)], "charger_id string, expected_interval double")
    gap = history.history_gaps(rows, profile=profile).collect()
    assert len(gap) == 1 and (gap[0].duration_seconds, gap[0].multiple) == (2040.0, 17.0)


def test_alarm_runs(spark):
    on = [0, 1, 1, 0, 0, 1, 0, 1]
    rows = spark.createDataFrame([("A", at(i), 0, bool(v)) for i, v in enumerate(on)], "charger_id string, event_time timestamp, frame_sequence int, on boolean")
    runs = events.active_intervals(rows, "on", ["charger_id"]).orderBy("start_time").collect()
    assert [(r.start_time, r.end_time, r.duration_seconds, r.confidence) for r in runs] == [(at(1), at(3), 120.0, "HIGH"), (at(5), at(6), 60.0, "HIGH"), (at(7), None, 0.0, "MEDIUM")]
    merged = events.active_intervals(rows, "on", ["charger_id"], debounce_seconds=120).orderBy("start_time").collect()
    assert [(r.start_time, r.end_time) for r in merged] == [(at(1), None)]
    gaps = spark.createDataFrame([("A", at(2), at(3))], "charger_id string, gap_start timestamp, gap_end timestamp")
    flagged = events.active_intervals(rows, "on", ["charger_id"], gaps=gaps).orderBy("start_time").collect()
    assert [r.has_gap for r in flagged] == [True, False, False]


SESSION = "charger_id string, connector_id string, event_time timestamp, frame_sequence int, connector_status string, session_id string, session_output_current double, session_consumed_energy double, start_soc double, stop_soc double, stop_reason string"


def test_session(spark):
    rows = [
        ("A", "1", at(0), 0, "Available", None, None, None, None, None, None),
        ("A", "1", at(1), 0, "Preparing", "SESS_1001", None, None, 20.0, None, None),
        ("A", "1", at(2), 0, "Charging", "SESS_1001", 85.0, 2.5, None, 25.0, None),
        ("A", "1", at(15), 0, "Charging", "SESS_1001", 80.0, 22.4, None, 80.0, None),
        ("A", "1", at(16), 0, "Finishing", "SESS_1001", None, None, None, None, "Local"),
        ("A", "1", at(17), 0, "Available", None, None, None, None, None, None),
    ]
    s = events.sessions(spark.createDataFrame(rows, SESSION)).collect()
    assert len(s) == 1
    s = s[0]
    assert (s.start_time, s.end_time, s.duration_seconds, s.energy_delivered_kwh, s.termination_class, s.confidence) == (at(1), at(17), 960.0, 22.4, "USER_STOPPED", "HIGH")
    assert (s.start_soc, s.end_soc, s.session_id) == (20.0, 80.0, "SESS_1001")


def test_session_id_change_restarts_on_the_row(spark):
    none = (None,) * 5
    rows = [("A", "1", at(0), 0, "Charging", "a", *none), ("A", "1", at(1), 0, "Charging", "b", *none), ("B", "1", at(0), 0, "Charging", None, *none)]
    s = events.sessions(spark.createDataFrame(rows, SESSION)).orderBy("charger_id", "start_time").collect()
    assert [(r.charger_id, r.session_id, r.start_time, r.end_time) for r in s] == [("A", "a", at(0), at(1)), ("A", "b", at(1), at(1)), ("B", None, at(0), at(0))]
    assert s[2].confidence == "LOW" and "SESSION_ID_MISSING" in s[2].quality_flags


def test_termination_order(spark):
    words = spark.createDataFrame([("FaultStop",), ("Remote",), ("EmergencyPressed",), ("GroundFault",), ("Reboot",), ("Done",), (None,)], "r string")
    got = [r[0] for r in words.select(S.termination(F.col("r"), F.lit("FAULTED"))).collect()]
    assert got == ["USER_STOPPED", "REMOTE_STOPPED", "EMERGENCY_STOPPED", "FAULT_STOPPED", "COMMUNICATION_LOST", "NORMAL", "FAULT_STOPPED"]


def test_transitions_and_config(spark):
    rows = spark.createDataFrame([("A", at(i), 0, v) for i, v in enumerate(["x", "x ", None, "x", "y"])], "charger_id string, event_time timestamp, frame_sequence int, s string")
    got = [(r.from_state, r.to_state) for r in events.state_transitions(rows, "s", ["charger_id"]).orderBy("event_time").collect()]
    assert got == [(None, "x"), ("x", "y")]
    maps = spark.createDataFrame([("A", at(0), 0, {"a": "1", "b": "2"}), ("A", at(1), 0, {"a": "1", "b": "2"}), ("A", at(2), 0, {"a": "3", "c": "4"})], "charger_id string, event_time timestamp, frame_sequence int, c map<string,string>")
    changed = events.config_changes(maps, "c", ["charger_id"]).collect()
    assert len(changed) == 1 and {k: (v.old, v.new) for k, v in changed[0].changes.items()} == {"a": ("1", "3"), "b": ("2", None), "c": (None, "4")}


def test_statistics(spark):
    rows = spark.createDataFrame([(float(v), float(v)) for v in [230, 232, 228, -1, -9999, 65535]], "v double, w double")
    s = research.signal_statistics(rows, ["v"]).first()
    assert (s.n, s.valid, s.sentinels, s.mean, s.missing_rate) == (6, 3, 3, 230.0, 0.5)
    five = research.signal_statistics(spark.createDataFrame([(float(v),) for v in (10, 20, 30, 40, 55)], "v double"), ["v"]).first()
    assert abs(five.skew - 0.149) < 1e-3 and abs(five.kurtosis + 1.823) < 1e-3


def test_correlations(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (None, 6.0), (4.0, 8.0), (5.0, 10.0), (-1.0, 12.0)], "a double, b double")
    r = research.correlation_matrix(rows, ["a", "b"]).first()
    assert (r.pairs, r.r) == (4, 1.0)
    flat = spark.createDataFrame([(1.0, 2.0)] * 4, "a double, b double")
    assert research.correlation_matrix(flat, ["a", "b"]).first().r is None
    assert research.spearman(rows, "a", "b").first().rho == 1.0


def test_patterns(spark):
    stats = spark.createDataFrame([("A", "grid_voltage_r", 4, 185.0, 190.0, 187.5)], "charger_id string, signal string, valid long, min double, max double, mean double")
    found = research.voltage_anomalies(stats, spark.createDataFrame([("grid_voltage_r", 230.0)], "signal string, p50 double")).first()
    assert (found.category, found.evidence, found.level) == ("VOLTAGE_ANOMALY", 2, "WEAK")
    means = spark.createDataFrame([("A", f"line_{i}_input_current", m) for i, m in enumerate((50.0, 52.0, 20.0))], "charger_id string, signal string, mean double")
    assert research.current_imbalance(means).first().level == "MODERATE"


def test_clusters(spark):
    alarms = spark.createDataFrame([("A", at(m), c) for m, c in ((0, "x"), (10, "y"), (59, "z"), (61, "x"), (200, "x"), (210, "x"))] + [("B", at(0), "x")], "charger_id string, start_time timestamp, code string")
    got = [(r.charger_id, r.start_time, r.end_time, r.alarms, r.level) for r in research.alarm_clusters(alarms).collect()]
    assert got == [("A", at(0), at(59), 3, "MODERATE")]


def test_silver(spark):
    rows = spark.createDataFrame([("f", "1", "Idle", "12.5", "999"), ("f", "1", "Busy", "12.5", "999"), ("f", "2", "Idle", "N/A", "40")], "frame_id string, connector_no string, status string, volts string, gun string")
    specs = [silver.FieldSpec("status", scope="connector_no", family="connector"), silver.FieldSpec("volts", "FLOAT", "connector_no", "connector"), silver.FieldSpec("gun", "FLOAT", "connector_no", "gun")]
    provenance = silver.resolved_long(rows, specs)
    got = {r.scope_id: r for r in silver.silver_table(provenance, specs).collect()}
    assert got["1"].status is None and got["1"].volts == 12.5 and got["1"].gun is None and got["1"].gun_masked
    assert got["2"].status == "Idle" and got["2"].volts is None and got["2"].gun == 40.0 and not got["2"].gun_masked
    assert {r.code for r in silver.findings(provenance).collect()} == {"CONFLICTING_VALUES", "SENTINEL_MASKED"}


def test_canonical_numbers(spark):
    rows = spark.createDataFrame([(v,) for v in ("1", "1.0", "+1", "-0", "0.50", "1e3", "abc", "100")], "v string")
    assert [r[0] for r in rows.select(S.canonical_number(F.col("v"))).collect()] == ["1", "1", "1", "0", "0.5", "1000", None, "100"]


def test_scores(spark):
    base = dict(file_id="f", fields=10, missing_required=0, duplicate_headers=0, drifted=0, unknown_schema=False, completeness=0.5, violations=0, values=10, exact_share=0.0, conflict_share=0.0, parsed_share=1.0, largest_step=1.0, threshold=10.0)
    f = spark.createDataFrame([base])
    assert quality.score(f).first().overall_score == 90.0
    assert quality.score(f, legacy_collapse=True).first().overall_score < 90.0


def test_rules_contain_failures(spark):
    r = quality.RuleRegistry()
    r.register("BROKEN", lambda p: 1 / 0)
    assert r.evaluate(spark, {}).first().code == "RULE_FAILED_BROKEN"


def test_pages_and_fleet(spark):
    rows = spark.createDataFrame([("A", at(i), 0) for i in range(5)], "charger_id string, event_time timestamp, frame_sequence int")
    page = fleet.keyset_page(rows, 2).collect()
    assert [r.event_time for r in page] == [at(0), at(1)] and page[0].has_more
    rest = fleet.keyset_page(rows, 5, (at(2), 0)).collect()
    assert [r.event_time for r in rest] == [at(3), at(4)] and not rest[0].has_more
    both = fleet.reconcile(spark.createDataFrame([("A",), ("B",)], "k string"), spark.createDataFrame([("B", 1), ("C", 2)], "k string, n int"), "k")
    assert {r.k: r.arrival for r in both.collect()} == {"A": "MISSING", "B": "RECEIVED", "C": "UNEXPECTED"}


def test_points_in_intervals(spark):
    points = spark.createDataFrame([("A", at(m), 0) for m in (0, 5, 10, 15)], "charger_id string, event_time timestamp, frame_sequence int")
    visits = spark.createDataFrame([("A", at(5), at(10), "s1"), ("A", at(6), None, "s2")], "charger_id string, start_time timestamp, end_time timestamp, session_id string")
    alarms = spark.createDataFrame([("A", at(10), at(10), "x")], "charger_id string, start_time timestamp, end_time timestamp, code string")
    got = {r.event_time: (r.session_id, r.active_alarms) for r in research.telemetry_with_events(points, visits, alarms).collect()}
    assert got == {at(0): (None, []), at(5): ("s1", []), at(10): ("s1", ["x"]), at(15): ("s2", [])}
