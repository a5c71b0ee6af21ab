"""Events that are kept up as rows come in: late rows recompute a charger from its last quiet day before them to the first
one after them at which nothing has changed, and all else stays as it was written.

A charger's day has a point: what later rows can see of all rows up to its end. It is quiet if no session can be open and
no alarm is active, so that the rows after it give the same events whatever came before, but for each connector's last
state, the last settings and the last stamp; these are carried. Tables under a folder are only appended to, by day and run.
A run's rows count once its line in `runs` is written, which is the last thing that it does; of a charger's day the latest
run that has a point of it counts. Gaps follow from counts of steps by day, and flag events when they are read.

Rows without charger or stamp are left out. Rows that tie in stamp and frame_sequence have no order of their own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import alarm_active, business_date, is_active_state
from gridloom.operators import events, history
from gridloom.sources import staging

KEYS = ("charger_id", "connector_id")
TEXTS = ("connector_status", "session_id", "begin_time", "session_consumed_energy", "session_output_current", "start_soc", "stop_soc", "stop_reason", "reported_charging_time", "meter_energy")
LAST = "array<struct<connector_id:string, event_time:timestamp, frame_sequence:long, connector_status:string, settings:map<string,string>>>"
POINTS = f"charger_id string, quiet boolean, seen string, last {LAST}, day date, run string"
RUNS = "run string, files array<string>"
STEPS = "charger_id string, delta double, n long, day date, run string"
GAPS = "charger_id string, start_time timestamp, end_time timestamp, delta double, day date, run string"
#: The column whose day an event belongs to: a stamp of a row of its charger.
ENDS = {"sessions": "end_time", "alarms": "last_active", "faults": "last_active", "transitions": "event_time", "config_changes": "event_time"}


def observations(rows: DataFrame, signals: list[str]) -> DataFrame:
    """rows with the columns that events are made of, all as text but the stamp, the sequence and the settings."""
    text = lambda c: (F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c)
    settings = (F.col("settings") if "settings" in rows.columns else F.lit(None)).cast("map<string,string>")
    return rows.where("charger_id is not null and event_time is not null").select(
        *(text(c) for c in KEYS), F.col("event_time").cast("timestamp").alias("event_time"), F.col("frame_sequence").cast("long").alias("frame_sequence"),
        *(text(c) for c in TEXTS), *(text(c) for c in signals), F.coalesce(settings, F.create_map().cast("map<string,string>")).alias("settings"),
    )


def points(rows: DataFrame, signals: list[str], zone: str) -> DataFrame:
    """(charger_id, day, quiet, seen, last) at the end of each day of observations (also day): see above; seen is equal where
    later rows see the same."""
    s = events.session_rows(rows)
    at, blank = "struct(event_time, frame_sequence)", "trim(connector_status) = '' or connector_status is null"
    opens = s.active | F.coalesce(s.sid.isNotNull(), F.lit(False)) | s.delivering
    marks = s.select(*KEYS, business_date(s.event_time, zone).alias("day"), "event_time", "frame_sequence", opens.alias("opens"), (s.state.isin("IDLE", "COMPLETED") & ~opens).alias("closes"))
    alarming = F.array_contains(F.array(*(alarm_active(F.col(c)) for c in signals)), True) if signals else F.lit(False)
    plain = rows.select(*KEYS, "day", "event_time", "frame_sequence", "connector_status", "settings", alarming.alias("alarming"))
    marks = marks.where("opens or closes").groupBy(*KEYS, "day").agg(F.expr(f"max_by(opens, {at})").alias("opened"))
    of_day = plain.groupBy(*KEYS, "day").agg(
        F.expr(f"max({at})").alias("at"), F.expr(f"max_by(alarming, {at})").alias("alarming"),
        F.expr(f"max_by(connector_status, {at}) filter (where not ({blank}))").alias("status"), F.expr(f"max_by(struct(event_time, frame_sequence, settings), {at}) filter (where size(settings) > 0)").alias("set"),
    )
    key = F.coalesce(F.concat(F.lit("="), "connector_id"), F.lit("")).alias("_key")
    of_day, marks = of_day.select("*", key).drop("connector_id"), marks.select("charger_id", "day", key, "opened")
    grid = of_day.select("charger_id", "day").distinct().join(of_day.select("charger_id", "_key").distinct(), "charger_id")
    w = Window.partitionBy("charger_id", "_key").orderBy("day")
    upto = grid.join(of_day, ["charger_id", "day", "_key"], "left").join(marks, ["charger_id", "day", "_key"], "left")
    upto = upto.select("charger_id", "day", "_key", *(F.last(c, True).over(w).alias(c) for c in ("at", "alarming", "status", "set", "opened"))).where("at is not null")
    name, none = "case when _key <> '' then substr(_key, 2) end", "cast(map() as map<string,string>)"
    one = f"struct({name} as connector_id, at.event_time as event_time, at.frame_sequence as frame_sequence, status as connector_status, {none} as settings)"
    # the last settings are a row of their own: a connector's last row may have none
    own = f"struct({name} as connector_id, set.event_time as event_time, set.frame_sequence as frame_sequence, cast(null as string) as connector_status, set.settings as settings)"
    out = upto.groupBy("charger_id", "day").agg(
        F.expr("max_by(alarming, at)").alias("_alarming"), F.expr("bool_or(coalesce(opened, false))").alias("_open"), F.expr("max(at.event_time)").alias("_time"),
        F.expr(f"max_by({own}, struct(set.event_time, set.frame_sequence)) filter (where set is not null)").alias("_set"),
        F.expr("array_sort(collect_list(struct(_key, status)))").alias("_states"), F.expr(f"collect_list({one})").alias("_each"),
    )
    out = out.withColumn("last", F.when(F.col("_set").isNull(), F.col("_each")).otherwise(F.concat("_each", F.array("_set"))))
    seen = F.sha2(F.concat_ws("\x1f", F.unix_micros("_time").cast("string"), F.to_json("_states"), F.coalesce(events.config_hash(F.col("_set.settings")), F.lit(""))), 256)
    return out.select("charger_id", "day", (~F.col("_alarming") & ~F.col("_open")).alias("quiet"), seen.alias("seen"), "last")


def _runs(spark: SparkSession, out: str) -> DataFrame:
    return staging.table(spark, f"{out}/runs", RUNS)


def known_files(spark: SparkSession, out: str) -> DataFrame:
    """(sha256) of the files whose rows were taken in."""
    return _runs(spark, out).select(F.explode("files").alias("sha256"))


def _current(spark: SparkSession, out: str) -> DataFrame:
    """The points that count, one a charger and day."""
    found = staging.table(spark, f"{out}/points", POINTS).join(F.broadcast(_runs(spark, out).select("run")), "run", "left_semi")
    latest = Window.partitionBy("charger_id", "day").orderBy(F.desc("run"))
    return found.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def _append(table: DataFrame, out: str, name: str, run: str) -> None:
    # a day's rows come together in a few files, large days in several
    table.withColumn("run", F.lit(run)).hint("rebalance", "day").write.mode("append").partitionBy("day", "run").parquet(f"{out}/{name}")


def _written(table: DataFrame, out: str, run: str, name: str) -> DataFrame:
    """A small table of a run at work, written and read back."""
    table.write.mode("overwrite").parquet(f"{out}/work/{run}/{name}")
    return table.sparkSession.read.schema(table.schema).parquet(f"{out}/work/{run}/{name}")


def _stretches(spark: SparkSession, out: str, run: str, signals: list[str], zone: str) -> DataFrame:
    """(charger_id, after, until, last) for each charger with rows of the run: the quiet day that it is recomputed from and
    the one where what follows stays as it is; null: from its first row, to its last.

    An end is tried at the first quiet day after the charger's new rows, then at the 2nd, 4th and so on, for those that
    it doesn't hold for; only points are computed for that.
    """
    old = _current(spark, out).where("quiet")
    touched = _observed(spark, out, run, signals).where(F.col("run") == run).groupBy("charger_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    before = old.join(touched, "charger_id").where("day < first_day").groupBy("charger_id").agg(F.max("day").alias("after"), F.expr("max_by(last, day)").alias("last"))
    left = _written(touched.join(before, "charger_id", "left"), out, run, "touched")
    done, k = None, 1
    while True:
        order = Window.partitionBy("charger_id").orderBy("day")
        ends = old.select("charger_id", "day", "seen").join(left.select("charger_id", "last_day"), "charger_id").where("day > last_day").withColumn("_k", F.row_number().over(order)).where(F.col("_k") == k)
        asked = left.join(ends.select("charger_id", F.col("day").alias("until"), F.col("seen").alias("_seen")), "charger_id", "left")
        asked = _written(asked, out, run, f"asked-{k}")
        new = points(_within(spark, out, run, asked.where("until is not null"), signals, zone), signals, zone).where("quiet").select("charger_id", F.col("day").alias("until"), F.col("seen").alias("_new"))
        asked = asked.join(new, ["charger_id", "until"], "left").withColumn("_holds", F.col("until").isNull() | F.coalesce(F.col("_new") == F.col("_seen"), F.lit(False)))
        asked = _written(asked, out, run, f"answered-{k}")
        held = asked.where("_holds").select("charger_id", "after", "until", "last")
        done = held if done is None else done.unionByName(held)
        left = asked.where("not _holds").select(*left.columns)
        if left.isEmpty():
            return done
        k *= 2


def _observed(spark: SparkSession, out: str, run: str, signals: list[str]) -> DataFrame:
    """The observations of all runs that count and of the one at work."""
    texts = ", ".join(f"{c} string" for c in (*TEXTS, *signals))
    found = staging.table(spark, f"{out}/observations", f"charger_id string, connector_id string, event_time timestamp, frame_sequence long, {texts}, settings map<string,string>, day date, run string")
    runs = _runs(spark, out).select("run").union(spark.createDataFrame([(run,)], "run string"))
    return found.join(F.broadcast(runs), "run", "left_semi")


def _within(spark: SparkSession, out: str, run: str, stretches: DataFrame, signals: list[str], zone: str) -> DataFrame:
    """Observations of the stretches, and of each connector a row that stands for what it was before. Of the days only those
    between the first begin and the last end are read, where all stretches have one."""
    rows = _observed(spark, out, run, signals)
    low, high, no_low, no_high = stretches.agg(F.min("after"), F.max("until"), F.bool_or(F.col("after").isNull()), F.bool_or(F.col("until").isNull())).first()
    if low and not no_low:
        rows = rows.where(F.col("day") > F.lit(low))
    if high and not no_high:
        rows = rows.where(F.col("day") <= F.lit(high))
    ends = stretches.select("charger_id", "after", "until")
    rows = rows.join(ends, "charger_id").where("(after is null or day > after) and (until is null or day <= until)").drop("after", "until", "run")
    carried = stretches.where("after is not null").select("charger_id", F.inline("last"))
    carried = observations(carried, signals).withColumn("day", business_date(F.col("event_time"), zone))
    return rows.unionByName(carried)


def add(spark: SparkSession, rows: DataFrame, out: str, alarms: list[str], faults: list[str], zone: str, files: list[str] | None = None) -> None:
    """Take in rows (those of a charger in any order and however late) and bring the tables under out up to date.

    rows are what events.reconstruct() takes, with a map column settings where there is one; `files` are noted with the run.
    """
    signals = sorted({*alarms, *faults})
    last = _runs(spark, out).agg(F.max("run")).first()[0]
    run = f"{int(last.split('-')[0]) + 1 if last else 1:09d}-{uuid.uuid4().hex[:8]}"
    _append(observations(rows, signals).withColumn("day", business_date(F.col("event_time"), zone)), out, "observations", run)
    stretches = _written(_stretches(spark, out, run, signals, zone), out, run, "stretches")
    seen = _within(spark, out, run, stretches, signals, zone)
    after = stretches.select("charger_id", "after")

    def new(table: DataFrame) -> DataFrame:
        """What belongs to a day of the stretch, not to a row that stands for earlier ones."""
        return table.join(after, "charger_id").where("after is null or day > after").drop("after")

    for name, table in events.found_events(seen, alarms, faults, "settings").items():
        _append(new(table.withColumn("day", business_date(F.col(ENDS[name]), zone))), out, name, run)
    _append(new(history.step_counts(seen, ["charger_id", "day"])), out, "steps", run)
    steps = history._deltas(seen, "charger_id").where(F.col("delta") > history.GAP_LEAST)
    _append(new(steps.select("charger_id", F.col("prev_time").alias("start_time"), F.col("event_time").alias("end_time"), "delta", "day")), out, "gap_steps", run)
    _append(new(points(seen, signals, zone)), out, "points", run)
    spark.createDataFrame([(run, files or [])], RUNS).coalesce(1).write.mode("append").parquet(f"{out}/runs")


def tables(spark: SparkSession, out: str, alarms: list[str] | dict[str, str]) -> dict[str, DataFrame]:
    """The events of all rows that were taken in, as events.reconstruct() gives them, and timeline_gaps."""
    valid = _current(spark, out).select("charger_id", "day", "run")

    def of(name: str, schema) -> DataFrame:
        return staging.table(spark, f"{out}/{name}", schema).join(valid, ["charger_id", "day", "run"], "left_semi").drop("day", "run")

    none = events.found_events(observations(spark.createDataFrame([], "charger_id string, event_time timestamp, frame_sequence long"), []), [], [], "settings")
    found = {name: of(name, none[name].withColumns({"day": F.current_date(), "run": F.lit("")}).schema) for name in ENDS}
    profile = history.profile_of_steps(of("steps", STEPS))
    gaps = history.gaps_of_steps(of("gap_steps", GAPS), profile).select("charger_id", F.col("start_time").alias("gap_start"), F.col("end_time").alias("gap_end"))
    return events.flagged_events(found, gaps, alarms) | {"timeline_gaps": gaps}
