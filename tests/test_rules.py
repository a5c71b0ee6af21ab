"""Rules where a reading of their short description goes wrong: unsteady chargers, open alarms, days without data, depth."""

import datetime as dt

from gridloom.operators import events, fleet, history, quality, research

T0 = dt.datetime(2026, 3, 1)


def at(*minutes):
    return [("A", T0 + dt.timedelta(minutes=m), i) for i, m in enumerate(minutes)]


ROWS = "charger_id string, event_time timestamp, frame_sequence int"


def test_gaps_of_an_unsteady_charger_go_by_its_median(spark):
    rows = spark.createDataFrame(at(0, 10, 70, 270, 300, 700, 720), ROWS)  # steps of 10, 60, 200, 30, 400, 20
    got = [(r.duration_seconds, r.multiple) for r in history.history_gaps(rows).orderBy("start_time").collect()]
    assert got == [(12_000.0, 4.44), (24_000.0, 8.89)]
    assert [r.multiple for r in history.history_gaps(spark.createDataFrame(at(0, 6), ROWS)).collect()] == []


def test_an_open_alarm_meets_gaps_up_to_its_last_active_row(spark):
    rows = spark.createDataFrame([(c, t, i, True, "on") for c, t, i in at(0, 10, 20)], ROWS + ", active boolean, state string")
    gap = lambda a, b: spark.createDataFrame([("A", T0 + dt.timedelta(minutes=a), T0 + dt.timedelta(minutes=b))], "charger_id string, gap_start timestamp, gap_end timestamp")
    found = lambda a, b: events.active_intervals(rows, "active", ["charger_id"], gaps=gap(a, b), state="state").first()
    assert not found(30, 60).has_gap and found(15, 60).has_gap
    one = found(30, 60)
    assert (one.end_time, one.last_active, one.start_state, one.end_state, one.first_sequence, one.last_sequence) == (None, T0 + dt.timedelta(minutes=20), "on", "on", 0, 2)


def test_a_closed_alarm_has_the_states_at_its_ends(spark):
    rows = spark.createDataFrame([("A", T0 + dt.timedelta(minutes=m), m, s != "ok", s) for m, s in ((0, "ok"), (1, "trip"), (2, "alarm"), (3, "ok"))], ROWS + ", active boolean, state string")
    one = events.active_intervals(rows, "active", ["charger_id"], state="state").first()
    assert (one.start_state, one.end_state, one.first_sequence, one.last_sequence) == ("trip", "ok", 1, 3)


def test_states_that_count_by_default(spark):
    files = spark.createDataFrame([(s,) for s in ("READY_FOR_NORMALIZATION", "FRAMES_RECONSTRUCTED", "PARTIAL", "COMPLETED", "VALIDATED", "QUARANTINED", "ARCHIVED")], "state string")
    assert [r.state for r in fleet.usable(files).collect()] == ["READY_FOR_NORMALIZATION", "FRAMES_RECONSTRUCTED", "PARTIAL", "COMPLETED"]


def test_missing_fields_cost_once(spark):
    kind = "file_id string, missing_required int, duplicate_headers int, drifted int, fields int, unknown_schema boolean, completeness double, violations int, `values` int, exact_share double, conflict_share double, parsed_share double, largest_step double, threshold double"
    rows = spark.createDataFrame([(str(m), m, 0, 0, 10, False, 1.0, 0, 10, 0.0, 0.0, 1.0, 1.0, 10.0) for m in (0, 1, 2)], kind)
    assert [r.schema_score for r in quality.score(rows).orderBy("file_id").collect()] == [100.0, 70.0, 70.0]


def test_a_missing_day_misses_no_components(spark):
    kind = "charger_id string, business_date date, arrival string, completeness string, is_late boolean, largest_gap_severity string, cadence_abnormal boolean, connectors int, expected_connectors int, smrs int, expected_smrs int, files int, overlap_timestamps int, dominant_date date, file_date date"
    day = T0.date()
    rows = spark.createDataFrame([("A", day, "MISSING", "NO_DATA", False, None, False, 0, 2, 0, 4, 0, 0, None, None), ("B", day, "RECEIVED", "COMPLETE", False, None, False, 1, 2, 4, 4, 1, 0, day, day)], kind)
    assert {(r.charger_id, r.code) for r in quality.daily_findings(rows).collect()} == {("A", "MISSING_CHARGER_DATA"), ("B", "MISSING_EXPECTED_CONNECTOR")}


def test_depth_goes_by_the_span(spark):
    rows = [(str(d), T0, T0 + dt.timedelta(days=d), 1) for d in (3, 8, 31)] + [("none", None, None, 0)]
    got = {r.k: (r.depth, r.status) for r in research.readiness(spark.createDataFrame(rows, "k string, first timestamp, last timestamp, sessions int")).collect()}
    assert got == {"3": ("SINGLE_SNAPSHOT", "PARTIAL"), "8": ("MULTI_DAY", "READY"), "31": ("LONGITUDINAL", "READY"), "none": ("SINGLE_SNAPSHOT", "NOT_READY")}


def test_continuity_of_none_one_and_many(spark):
    rows = spark.createDataFrame([*((*r, "1", "h") for r in at(0, 2, 4)), ("B", T0, 0, "2", "h")], ROWS + ", connector string, hash string")
    known = spark.createDataFrame([("A",), ("B",), ("C",)], "charger_id string")
    got = {r.charger_id: r for r in history.continuity(rows, components={"connectors": "connector"}, config="hash", entities=known).collect()}
    assert {k: r.depth for k, r in got.items()} == {"A": "MULTI_OBSERVATION", "B": "SINGLE_OBSERVATION", "C": "NO_DATA"}
    assert (got["A"].connectors, got["A"].configurations, got["C"].configurations, got["B"].eligible, got["B"].reason) == (["1"], 1, 0, False, "Only a single observation exists.")
