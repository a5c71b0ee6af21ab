"""Streaming twins of the batch operators: late-tolerant day coverage, inactivity sessions, files registered once."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState

from gridloom.functions.scalars import business_date
from gridloom.operators.coverage import CoverageRules, day_coverage, day_gaps
from gridloom.operators.events import SESSION_SCHEMA, graded_sessions, session_rows, session_step
from gridloom.sources.store import replace_partitions

LATE = "24 hours"
SESSION_NAMES = [f.split()[0] for f in SESSION_SCHEMA.split(", ")]


def observations(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of observations from a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def arriving_files(spark: SparkSession, folder: str, archive: str | None = None, pattern: str = "*.csv") -> DataFrame:
    """A stream of new files with their bytes; with `archive` a file moves there once its batch is done, else it stays."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder)


def stamp_counts(events: DataFrame, window: str = "1 hour", late: str = LATE) -> DataFrame:
    """Distinct stamps of each charger and window, settled once the watermark has passed."""
    once = events.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["charger_id", "event_time"])
    return once.groupBy("charger_id", F.window("event_time", window)).agg(F.count("*").alias("unique_timestamps"), F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"))


def inactivity_sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Runs of observations no further apart than gap: the gaps between them are outages."""
    return events.withWatermark("event_time", late).groupBy("charger_id", F.session_window("event_time", gap)).agg(F.count("*").alias("observations"))


def files_once(files: DataFrame, late: str = "7 days") -> DataFrame:
    """New files of a binaryFile stream; contents seen before within the watermark don't come again."""
    return files.withColumn("sha256", F.sha2("content", 256)).withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["sha256"])


def alarm_runs(events: DataFrame, by: tuple[str, ...] = ("charger_id", "code"), late: str = LATE, idle_seconds: int = 3600) -> DataFrame:
    """A stream of runs of active rows (by, event_time, active), as operators.events.active_intervals() has them: each
    is given out once its first inactive row is settled.

    Rows wait until the watermark has passed them and are then walked in order, so late ones within it find their place;
    an entity's state is the open run and the rows that wait. A run whose entity stays silent for idle_seconds of event
    time is given out open (end_time null).
    """
    names = [*by, "start_time", "last_active", "end_time", "observations"]
    kinds = dict(events.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "start_time timestamp, last_active timestamp, end_time timestamp, observations long"])
    at = lambda us: None if us is None else pd.Timestamp(us, unit="us")

    def walk(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, n, times, ons = state.get if state.exists else (None, None, 0, [], [])
        rows = list(zip(times, ons, strict=True))
        for f in frames:
            rows += zip((f["event_time"].astype("datetime64[us]").astype("int64")).tolist(), f["active"].fillna(False).astype(bool).tolist(), strict=True)
        mark, out = state.getCurrentWatermarkMs() * 1000, []
        rows.sort()
        for t, on in rows:
            if t > mark:
                break
            if on:
                start, last, n = (t if start is None else start), t, n + 1
            elif start is not None:
                out.append((*key, at(start), at(last), at(t), n))
                start, last, n = None, None, 0
        rest = [r for r in rows if r[0] > mark]
        if start is not None and not rest and mark - last > idle_seconds * 1_000_000:
            out.append((*key, at(start), at(last), None, n))
            start, last, n = None, None, 0
        if start is None and not rest:
            state.remove()
        else:
            state.update((start, last, n, [r[0] for r in rest], [r[1] for r in rest]))
            due = min([r[0] for r in rest] + ([last + idle_seconds * 1_000_000] if start is not None else []))
            state.setTimeoutTimestamp(max(due // 1000 + 1, mark // 1000 + 1))
        yield pd.DataFrame(out, columns=names)

    rows = events.select(*by, "event_time", F.coalesce("active", F.lit(False)).alias("active")).withWatermark("event_time", late)
    return rows.groupBy(*by).applyInPandasWithState(walk, schema, "start long, last long, n long, times array<long>, ons array<boolean>", "append", "EventTimeTimeout")


class SessionMachine(StatefulProcessor):
    """A connector's session in progress, its last settled row, and the rows that the watermark hasn't passed yet.

    Rows wait in a map by stamp and sequence, so a batch writes its own rows only; a timer at each stamp settles them in
    order. Silence of idle_seconds after the last settled row closes an open session there.
    """

    def __init__(self, idle_seconds: int):
        self.idle_ms = idle_seconds * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long", "rows binary")
        self.open = handle.getValueState("open", "session binary")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        fresh: dict[int, list] = {}
        for f in rows:
            for r in f.to_dict("records"):
                fresh.setdefault(int(r["event_time"].value // 1_000_000) + 1, []).append(r)
        for ms, new in fresh.items():
            old = pickle.loads(self.waiting.getValue((ms,))[0]) if self.waiting.containsKey((ms,)) else []
            self.waiting.updateValue((ms,), (pickle.dumps(old + new),))
            self.handle.registerTimer(ms)
        yield pd.DataFrame(columns=SESSION_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        now, before = pickle.loads(self.open.get()[0]) if self.open.exists() else (None, None)
        # timers of one batch come in no stated order: each settles all rows up to it, a later one finds none left
        due = sorted(k[0] for k in self.waiting.keys() if k[0] <= mark)
        for ms in due:
            rows = [SimpleNamespace(**r) for r in pickle.loads(self.waiting.getValue((ms,))[0])]
            for r in sorted(rows, key=lambda r: (r.event_time, r.frame_sequence)):
                if now and (r.event_time - before.event_time).total_seconds() * 1000 > self.idle_ms:
                    out.append(now.closed(before))
                    now = None
                now, done = session_step(now, r)
                out += done
                before = r
            self.waiting.removeKey((ms,))
        until = None if before is None else int(before.event_time.value // 1_000_000) + self.idle_ms
        if now and mark >= until:  # what comes is later still
            out.append(now.closed(before))
            now = None
        if now is None:
            self.open.clear()
        elif due:
            self.open.update((pickle.dumps((now, before)),))
            self.handle.registerTimer(until)
        yield pd.DataFrame(out, columns=SESSION_NAMES)

    def close(self) -> None:
        pass


def charging_sessions(events: DataFrame, late: str = LATE, idle_seconds: int = 86_400) -> DataFrame:
    """A stream of charging sessions, as operators.events.sessions() has them: each is given out once the row that closes
    it is settled, or its connector has been silent for idle_seconds of event time (then it ends at its last row).

    Rows are walked once the watermark has passed them, so late ones within it find their place. has_gap is false: gaps
    are known by day, not yet on the stream. Needs the RocksDB state store, see with_state().
    """
    rows = session_rows(events).where("event_time is not null").withWatermark("event_time", late)
    found = rows.groupBy("charger_id", "connector_id").transformWithStateInPandas(SessionMachine(idle_seconds), SESSION_SCHEMA, "append", "eventTime")
    return graded_sessions(found.withColumn("has_gap", F.lit(False)))


def with_state(spark: SparkSession) -> SparkSession:
    """A session of its own settings whose streams keep state in RocksDB, which charging_sessions() needs."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def keep_days_current(events: DataFrame, raw: str, target: str, checkpoint: str, rules: CoverageRules | None = None):
    """Keep coverage and gaps by day exact, however late rows come: each batch adds its rows, then recomputes the days it touched.

    Rows are kept by day, so a batch reads the touched days only, and replaces their partitions. A batch that is run
    again adds its rows again, which changes nothing: coverage counts distinct stamps.
    """
    r = rules or CoverageRules()

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        df = df.withColumn("business_date", business_date(F.col("event_time"), r.zone))
        df.write.mode("append").partitionBy("business_date").parquet(raw)
        days = [d.business_date for d in df.select("business_date").distinct().collect()]
        if days:
            touched = spark.read.parquet(raw).where(F.col("business_date").isin(days)).drop("business_date")
            replace_partitions(day_coverage(touched, r), f"{target}/coverage", "business_date", touched=days)
            replace_partitions(day_gaps(touched, r), f"{target}/gaps", "business_date", touched=days)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)
