"""The session machine on a stream against the batch operator: shuffled, late and restarted."""

import datetime as dt
import random

from pyspark.sql import functions as F

from gridloom.operators import events
from gridloom.streaming import live

SCHEMA = "charger_id string, connector_id string, event_time timestamp, frame_sequence int, connector_status string, session_id string, session_output_current double, meter_energy double, stop_reason string"
T0 = dt.datetime(2026, 1, 1)


def observed(seed: int) -> list[tuple]:
    rng, out = random.Random(seed), []
    for charger in "AB":
        for connector in "12":
            meter, sid = 0.0, 0
            for i in range(80):
                status = rng.choice(["Available", "Charging", "Charging", "Charging", "Finishing", "Faulted"])
                sid += rng.random() < 0.1
                meter += rng.random()
                named = f"S{charger}{connector}{sid}" if status == "Charging" and rng.random() < 0.7 else None
                out.append((charger, connector, T0 + dt.timedelta(minutes=2 * i), i % 2, status, named, float(rng.choice([0, 30])), meter, rng.choice([None, None, "Remote"])))
    return out


def test_sessions_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    own, rows = live.with_state(spark), observed(4)
    random.Random(1).shuffle(rows)
    rows.append(("Z", "9", T0 + dt.timedelta(days=30), 0, "Available", None, 0.0, 0.0, None))  # moves the watermark past all
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    thirds = [rows[:100], rows[100:220], rows[220:]]  # all connectors and times in each
    for part in thirds:  # each run starts again from the checkpoint
        own.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        found = live.charging_sessions(live.observations(own, source, SCHEMA), idle_seconds=86_400)
        query = found.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        query.awaitTermination()
    columns = [c for c in events.sessions(own.createDataFrame(rows, SCHEMA)).columns]
    table = events.sessions(own.createDataFrame(rows, SCHEMA)).where(F.col("charger_id") != "Z")
    want, got = ([tuple(r) for r in df.select(columns).orderBy("charger_id", "connector_id", "start_time", "end_time", "session_id").collect()] for df in (table, own.read.parquet(out)))
    assert len(want) > 20 and got == want
