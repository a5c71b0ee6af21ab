"""Further queries over the driver's tables: files and batches, findings, attributes, Silver tables, reconstruction."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.functions import classifier
from gridloom.functions import scalars as S
from gridloom.operators import coverage, events, fleet, history, profile, quality, silver
from gridloom.plans import api, jobs, landing, resumed
from gridloom.plans.catalogue import _PROFILE, _RUNS, _STEPS, _T, RULES, _plain, intervals, query, read, telemetry
from gridloom.session import shared_dir
from gridloom.sources import csv_files, store
from gridloom.sources.dictionary import Definition

# files


@query("time_format_by_file", """
SELECT o_orderkey % 4 file_id, CAST(CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE -1 END AS INT) form FROM orders GROUP BY ALL""")
def time_format_by_file(spark, d):
    o = read(spark, d, "orders")
    forms = [F.date_format("o_orderdate", f) for f in jobs.FORMATS[:3]]
    n = o.o_orderkey % 4
    stamp = F.when(n == 0, forms[0]).when(n == 1, forms[1]).when(n == 2, F.when(o.o_orderkey % 9 == 0, "soon").otherwise(forms[2])).otherwise("March 1st")
    return csv_files.time_formats(o.select(n.alias("file_id"), stamp.alias("stamp")), F.col("stamp"), jobs.FORMATS)


@query("staged_batch", """
WITH f AS (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 9, '0') path, p_size - 1 length, p_brand || CAST(p_size AS VARCHAR) sha, p_partkey % 7 = 0 other FROM part),
a AS (SELECT *, CASE WHEN length = 0 THEN 'REJECTED_EMPTY' WHEN length > 45 THEN 'REJECTED_SIZE' WHEN other THEN 'REJECTED_TYPE' END alone FROM f),
b AS (SELECT *, coalesce(alone, CASE WHEN row_number() OVER (PARTITION BY sha ORDER BY alone IS NOT NULL, path) > 1 THEN 'DUPLICATE_IN_BATCH' END) o FROM a),
c AS (SELECT *, row_number() OVER w n, sum(length) OVER w s FROM b WINDOW w AS (PARTITION BY o IS NULL ORDER BY path))
SELECT p_partkey, coalesce(o, CASE WHEN n > 200 OR s > 3000 THEN 'DEFERRED' ELSE 'STAGED' END) outcome FROM c""")
def staged_batch(spark, d):
    p = read(spark, d, "part")
    ext = F.when(p.p_partkey % 7 == 0, ".txt").otherwise(".csv")
    files = p.select("p_partkey", F.lpad(p.p_partkey.cast("string"), 9, "0").alias("path"), F.concat(p.p_partkey.cast("string"), ext).alias("name"), (p.p_size - 1).alias("length"), F.concat("p_brand", p.p_size.cast("string")).alias("sha256"))
    return store.outcomes(files, file_bytes=45, batch_files=200, batch_bytes=3000).select("p_partkey", "outcome")


@query("late_file_gaps", f"""
WITH {_STEPS} SELECT charger_id, CAST(day AS VARCHAR) business_date, event_time gap_start, nxt gap_end FROM s WHERE step > 64800""")
def late_file_gaps(spark, d):
    """Gaps by day after two files, and after a third one that comes late and closes some of them."""
    target = f"{shared_dir(spark)}/gaps-{uuid.uuid4().hex}"
    rows = telemetry(spark, d)
    for seen in (rows.where("file_id <> 2"), rows):
        days = [r.day for r in seen.select(S.business_date(F.col("event_time"), RULES.zone).alias("day")).distinct().collect()]
        store.replace_partitions(coverage.day_gaps(seen, RULES), target, "business_date", touched=days)
    schema = "charger_id long, gap_start timestamp, gap_end timestamp, business_date date"
    return _plain(spark.read.schema(schema).parquet(target)).withColumn("business_date", F.col("business_date").cast("string"))


@query("canonical_numbers", """
SELECT cell, number FROM (VALUES ('1.0', '1'), ('+007', '7'), ('-0.00', '0'), ('1.25e-2', '0.0125'), ('1E3', '1000'), ('.5', '0.5'), ('0.00000000000000000011', '0.00000000000000000011'),
  ('0.00000000000000000012', '0.00000000000000000012'), ('12345678901234567890123456789012345678901234567890.10', '12345678901234567890123456789012345678901234567890.1'), ('nan', NULL), ('x', NULL)) v(cell, number)""")
def canonical_numbers(spark, d):
    cells = ("1.0", "+007", "-0.00", "1.25e-2", "1E3", ".5", "0.00000000000000000011", "0.00000000000000000012", "12345678901234567890123456789012345678901234567890.10", "nan", "x")
    return spark.createDataFrame([(c,) for c in cells], "cell string").select("cell", S.canonical_number(F.col("cell")).alias("number"))


@query("field_classes", """
SELECT * FROM (VALUES ('Gun Temp DC+', 'CONNECTOR', 'CONTINUOUS_TELEMETRY', 'THERMAL', 'FLOAT', '°C', 'MEAN', 'AUTO_CLASSIFIED'), ('Alarm Smoke', 'ALARM', 'ALARM_FLAG', 'ALARM', 'ENUM', NULL, 'ANY_TRUE', 'AUTO_CLASSIFIED'),
  ('SMR Output Voltage', 'SMR', 'CONTINUOUS_TELEMETRY', 'SMR', 'FLOAT', 'V', 'MEAN', 'AUTO_CLASSIFIED'), ('Event Time', 'UNKNOWN', 'TIMESTAMP', 'UNKNOWN', 'DATETIME', NULL, 'FIRST', 'DOMAIN_REVIEW_REQUIRED'),
  ('Config Parameter 7', 'CONFIGURATION', 'CONFIGURATION', 'METER', 'UNKNOWN', NULL, 'LAST', 'AUTO_CLASSIFIED'), ('Reserved Spare 3', 'UNKNOWN', 'UNKNOWN', 'UNKNOWN', 'UNKNOWN', NULL, 'UNKNOWN', 'DOMAIN_REVIEW_REQUIRED'),
  ('Cumulative Energy', 'UNKNOWN', 'COUNTER', 'COUNTER', 'FLOAT', 'kWh', 'MAX', 'DOMAIN_REVIEW_REQUIRED')) v(source_name, entity, field_class, category, kind, unit, aggregation, review_status)""")
def field_classes(spark, d):
    names = ("Gun Temp DC+", "Alarm Smoke", "SMR Output Voltage", "Event Time", "Config Parameter 7", "Reserved Spare 3", "Cumulative Energy")
    found = classifier.classified(spark.createDataFrame([(n,) for n in names], "source_name string"))
    return found.select("source_name", "entity", "field_class", "category", "kind", "unit", "aggregation", "review_status")


# quality

_FIELDS = {
    "file_id": "p_brand", "column": "p_type", "rows": "nullif(count(*), 2)", "non_null": "count(*) - 1", "nulls": "1", "is_numeric": "min(p_size) > 3", "num_min": "min(p_size)", "num_max": "max(p_size)",
    "sentinel_hits": "sum(CASE WHEN p_size = 7 THEN 1 ELSE 0 END)", "required": "max(p_size) > 40", "known": "min(p_size) < 30", "kind": "CASE WHEN max(p_size) > 20 THEN 'FLOAT' ELSE 'ENUM' END", "low": "2", "high": "48", "invalid_enum": "sum(CASE WHEN p_size = 11 THEN 1 ELSE 0 END)",
}
_FILES = {
    "file_id": "CAST(c_nationkey AS {text})", "rows": "count(*)", "duplicate_rows": "sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END)", "collisions": "count(*) % 3", "conflicting": "count(*) % 2", "unparsed": "sum(CASE WHEN c_acctbal < -900 THEN 1 ELSE 0 END)",
    "largest_step": "max(c_acctbal)", "median_step": "avg(c_acctbal) / 2.4", "dominant_date": "max(c_custkey) % 2", "file_date": "0", "connectors": "count(*) % 5", "smrs": "count(*) % 4", "expected_connectors": "2", "expected_smrs": "1", "duplicate_headers": "min(c_custkey) % 3",
}
_RULES = (
    ("MISSING_REQUIRED_FIELD", "'CRITICAL'", "fields", "required AND \"rows\" IS NULL", "1"), ("MISSING_FIELD", "'WARNING'", "fields", "NOT required AND known AND \"rows\" IS NULL", "1"), ("UNKNOWN_FIELD", "'INFO'", "fields", "NOT known AND \"rows\" IS NOT NULL", "1"),
    ("ALL_NULL_FIELD", "'INFO'", "fields", "\"rows\" > 0 AND non_null = 0", "\"rows\""), ("SENTINEL_VALUE", "'WARNING'", "fields", "sentinel_hits > 0", "sentinel_hits"), ("OUT_OF_RANGE", "'ERROR'", "fields", "num_min < low OR num_max > high", "1"),
    ("INVALID_TYPE", "'ERROR'", "fields", "kind IN ('INTEGER', 'FLOAT') AND non_null > 0 AND NOT is_numeric", "non_null"), ("UNKNOWN_ENUM_VALUE", "'WARNING'", "fields", "invalid_enum > 0", "invalid_enum"), ("DUPLICATE_HEADER", "'WARNING'", "files", "duplicate_headers > 0", "duplicate_headers"),
    ("INVALID_TIMESTAMP", "CASE WHEN unparsed > 0.02 * \"rows\" THEN 'CRITICAL' ELSE 'WARNING' END", "files", "unparsed > 0", "unparsed"), ("TELEMETRY_GAP", "'WARNING'", "files", "largest_step > 5 * median_step", "1"),
    ("EVENT_DATE_FILENAME_MISMATCH", "'INFO'", "files", "dominant_date <> file_date", "1"), ("EXACT_DUPLICATE", "'WARNING'", "files", "duplicate_rows > 0", "duplicate_rows"), ("LOGICAL_KEY_COLLISION", "CASE WHEN conflicting > 0 THEN 'ERROR' ELSE 'WARNING' END", "files", "collisions > 0", "collisions"),
    ("UNEXPECTED_CONNECTOR_CARDINALITY", "'WARNING'", "files", "connectors <> expected_connectors", "connectors"), ("UNEXPECTED_SMR_CARDINALITY", "'WARNING'", "files", "smrs <> expected_smrs", "smrs"),
)


def _select(columns: dict[str, str], quote: str, text: str) -> str:
    return ", ".join(f"{e.format(text=text)} AS {quote}{n}{quote}" for n, e in columns.items())


@query("file_rule_findings", f"""
WITH fields AS (SELECT {_select(_FIELDS, '"', "VARCHAR")} FROM part GROUP BY p_brand, p_type), files AS (SELECT {_select(_FILES, '"', "VARCHAR")} FROM customer GROUP BY c_nationkey),
u AS ({" UNION ALL ".join(f"SELECT file_id, '{code}' code, {severity} severity, {n} n FROM {table} WHERE {test}" for code, severity, table, test, n in _RULES)})
SELECT file_id, code, severity, count(*) findings, CAST(sum(n) AS BIGINT) hits FROM u GROUP BY ALL""")
def file_rule_findings(spark, d):
    text = lambda c: {k: v.format(text="STRING") for k, v in c.items()}
    group = lambda df, c, *by: df.groupBy(*by).agg(*(F.expr(v).alias(k) for k, v in text(c).items()))
    fields = group(read(spark, d, "part"), {k: v for k, v in _FIELDS.items() if k not in ("file_id", "column")}, F.col("p_brand").alias("file_id"), F.col("p_type").alias("column"))
    files = group(read(spark, d, "customer"), {k: v for k, v in _FILES.items() if k != "file_id"}, F.col("c_nationkey").cast("string").alias("file_id"))
    found = quality.file_rules().evaluate(spark, {"fields": fields, "files": files})
    return found.groupBy("file_id", "code", "severity").agg(F.count("*").alias("findings"), F.sum("count").alias("hits"))


@query("dictionary_coverage", """
SELECT count(*) fields, count(*) FILTER (p_size % 5 <> 0) mapped, count(*) FILTER (p_size % 5 = 0) unmapped, count(*) FILTER (p_size % 3 = 0) in_review, CASE WHEN count(*) FILTER (p_size % 5 = 0) = 0 THEN 'COMPLETE' ELSE 'INCOMPLETE' END status FROM part""")
def dictionary_coverage(spark, d):
    p = read(spark, d, "part")
    return quality.dictionary_coverage(p.select(F.col("p_name").alias("name"), F.when(p.p_size % 5 != 0, p.p_type).alias("canonical"), (p.p_size % 3 == 0).alias("review")))


@query("observed_values", """
WITH u AS (SELECT 'o_orderpriority' col, o_orderpriority v FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders),
c AS (SELECT col, v, count(*) n FROM u WHERE v IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) k, count(*) OVER (PARTITION BY col) kinds FROM c)
SELECT col "column", CASE WHEN any_value(kinds) <= 50 THEN string_agg(v, '|' ORDER BY k) END observed, string_agg(v, '|' ORDER BY k) FILTER (k <= 5) examples FROM r GROUP BY col""")
def observed_values(spark, d):
    found = profile.observed_values(read(spark, d, "orders"), ["o_orderpriority", "o_orderstatus", "o_custkey"])
    return found.select("column", F.array_join("observed", "|").alias("observed"), F.array_join("examples", "|").alias("examples"))


# fleet, pages


@query("offset_page", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
def offset_page(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", "c_acctbal")
    return fleet.offset_page(rows, 3, 25, F.desc("c_acctbal"), F.col("c_custkey"))[0]


@query("newest_gaps", f"""
WITH {_STEPS} SELECT charger_id, CAST(day AS VARCHAR) business_date, round(step, 3) duration_seconds FROM s WHERE step > 64800 ORDER BY day DESC, step DESC LIMIT 60""")
def newest_gaps(spark, d):
    t = api.Tables(spark, {"gaps": coverage.day_gaps(telemetry(spark, d), RULES)})
    return api.day_gaps(t).limit(60).select("charger_id", F.col("business_date").cast("string").alias("business_date"), F.round("duration_seconds", 3).alias("duration_seconds"))


@query("bounded_history", f"""
WITH {_T}, f AS (SELECT value v FROM t ORDER BY event_time, frame_sequence LIMIT 1000), s AS (SELECT CASE WHEN v IN (-1, -9999, 9999, 65535, 99999, -99999, 255) THEN NULL ELSE v END v FROM f)
SELECT 'value' signal, count(*) n, count(v) "valid", round(avg(v), 4) mean, min(v) min, max(v) max, round(quantile_cont(v, 0.5), 6) p50 FROM s""")
def bounded_history(spark, d):
    found = api.signal_statistics(api.Tables(spark, {"observations": telemetry(spark, d)}), ["value"], limit=1000)
    return found.select("signal", "n", "valid", F.round("mean", 4).alias("mean"), "min", "max", "p50")


@query("fleet_summary", f"""
WITH {_STEPS}, r AS (SELECT charger_id, count(*) n, count(*) FILTER (step > 64800) gap_count FROM s WHERE day = DATE '2024-01-10' GROUP BY 1), e AS (SELECT DISTINCT user_id charger_id FROM events WHERE user_id % 2 = 0),
b AS (SELECT CASE WHEN e.charger_id IS NULL THEN 'UNEXPECTED' WHEN r.charger_id IS NULL THEN 'MISSING' ELSE 'RECEIVED' END arrival, n, gap_count, CASE WHEN n IS NULL THEN 'NO_DATA' WHEN n * 25.0 >= 95 THEN 'COMPLETE' WHEN n * 25.0 >= 50 THEN 'PARTIAL' ELSE 'SEVERELY_INCOMPLETE' END completeness, CASE WHEN n IS NOT NULL THEN least(100.0, n * 25.0) END pct FROM e FULL JOIN r USING (charger_id))
SELECT '2024-01-10' AS day, count(*) FILTER (arrival = 'RECEIVED') n_received, CAST(0 AS BIGINT) n_late, count(*) FILTER (arrival = 'MISSING') n_missing, count(*) FILTER (arrival = 'UNEXPECTED') n_unexpected,
  count(*) FILTER (completeness = 'COMPLETE') n_complete, count(*) FILTER (completeness = 'PARTIAL') n_partial, count(*) FILTER (completeness = 'SEVERELY_INCOMPLETE') n_severely_incomplete, count(*) FILTER (completeness = 'NO_DATA') n_no_data,
  CAST(sum(n) AS BIGINT) unique_timestamps, CAST(sum(gap_count) AS BIGINT) gaps, round(avg(coalesce(pct, 0)) FILTER (arrival <> 'UNEXPECTED'), 3) fleet_coverage_pct,
  round(count(*) FILTER (arrival = 'RECEIVED') * 100.0 / count(*) FILTER (arrival <> 'UNEXPECTED'), 3) delivery_pct FROM b""")
def fleet_summary(spark, d):
    rows = telemetry(spark, d)
    received = coverage.day_coverage(rows, RULES).where("business_date = date'2024-01-10'").select("charger_id", "completeness", "unique_timestamps", "gap_count", "sample_pct")
    expected = rows.where("charger_id % 2 = 0").select("charger_id").distinct()
    both = fleet.reconcile(expected, received, "charger_id").withColumn("day", F.lit("2024-01-10")).fillna("NO_DATA", ["completeness"])
    return fleet.summary(both, "day")


@query("day_attributes", f"""
WITH {_T}, f AS (SELECT file_id, charger_id, CAST(event_time AS DATE) AS day, floor(max(value)) score, min(event_time) received FROM t GROUP BY ALL), k AS (SELECT charger_id, CAST(event_time AS DATE) AS day, string_agg(DISTINCT k, ',' ORDER BY k) ks FROM t GROUP BY ALL)
SELECT f.charger_id, CAST(f.day AS VARCHAR) business_date, count(*) files, any_value(ks) connectors, round(avg(score), 2) quality_score, min(received) first_received FROM f JOIN k ON k.charger_id = f.charger_id AND k.day = f.day GROUP BY ALL""")
def day_attributes(spark, d):
    rows = telemetry(spark, d).withColumn("business_date", F.to_date("event_time"))
    days = rows.groupBy("file_id", "charger_id", "business_date").agg(F.collect_set("k").alias("connectors"), F.floor(F.max("value")).alias("quality_score"), F.min("event_time").alias("received_at"))
    found = coverage.day_attributes(days).select("charger_id", F.col("business_date").cast("string").alias("business_date"), "files", F.array_join("connectors", ",").alias("connectors"), "quality_score", "first_received")
    return _plain(found)


# Silver


def _silver(spark, d):
    x = read(spark, d, "lineitem")
    flag = lambda c: F.when(c, "Alarm").otherwise("ok")
    rows = x.select(
        F.col("l_orderkey").alias("frame_id"), F.lit("A").alias("charger_id"), F.col("l_orderkey").alias("event_time"), F.lit(0).alias("frame_sequence"), (x.l_suppkey % 2 + 1).alias("smr_no"),
        flag(x.l_quantity > 20).alias("smoke"), flag(x.l_discount > 0.03).alias("door"), F.when(x.l_linenumber == 3, -150).otherwise(x.l_linenumber).cast("string").alias("smr_temp"), x.l_returnflag.alias("config_a"), x.l_linestatus.alias("config_b"),
    )
    specs = [silver.FieldSpec("smoke", family="alarm"), silver.FieldSpec("door", family="alarm"), silver.FieldSpec("smr_temp", "FLOAT", "smr_no", "smr"), silver.FieldSpec("config_a", family="configuration"), silver.FieldSpec("config_b", family="configuration")]
    return silver.build_tables(rows, specs)


@query("silver_alarms", """
WITH a AS (SELECT l_orderkey frame_id, min(CASE WHEN l_discount > 0.03 THEN 'Alarm' ELSE 'ok' END) door, min(CASE WHEN l_quantity > 20 THEN 'Alarm' ELSE 'ok' END) smoke FROM lineitem GROUP BY 1)
SELECT frame_id, nullif(concat_ws(',', CASE WHEN door = 'Alarm' THEN 'door' END, CASE WHEN smoke = 'Alarm' THEN 'smoke' END), '') codes, CAST((door = 'Alarm')::INT + (smoke = 'Alarm')::INT AS INT) active_alarms_count FROM a""")
def silver_alarms(spark, d):
    return _silver(spark, d)["alarm_observation"].select("frame_id", F.array_join("active_alarm_codes", ",").alias("codes"), "active_alarms_count")


@query("silver_components", """
WITH a AS (SELECT l_orderkey frame_id, CAST(l_suppkey % 2 + 1 AS VARCHAR) scope_id, count(DISTINCT l_linenumber) kinds, CASE WHEN count(DISTINCT l_linenumber) = 1 THEN min(CASE WHEN l_linenumber = 3 THEN -150 ELSE l_linenumber END) END one, min(CAST(CASE WHEN l_linenumber = 3 THEN -150 ELSE l_linenumber END AS VARCHAR)) least FROM lineitem GROUP BY ALL)
SELECT frame_id, scope_id, CAST(CASE WHEN one <> -150 THEN one END AS DOUBLE) smr_temp, CAST(least AS DOUBLE) smr_temp_raw, coalesce(one = -150, false) smr_temp_masked FROM a""")
def silver_components(spark, d):
    return _silver(spark, d)["smr_telemetry"].select("frame_id", "scope_id", "smr_temp", "smr_temp_raw", "smr_temp_masked")


@query("silver_configuration", """
WITH a AS (SELECT l_orderkey frame_id, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END a, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END b FROM lineitem GROUP BY 1)
SELECT count(*) n, a config_a, b config_b, count(DISTINCT coalesce(a, '') || coalesce(b, '')) hashes FROM a GROUP BY ALL""")
def silver_configuration(spark, d):
    rows = _silver(spark, d)["configuration_snapshot"]
    return rows.groupBy(F.col("raw_config")["config_a"].alias("config_a"), F.col("raw_config")["config_b"].alias("config_b")).agg(F.count("*").alias("n"), F.count_distinct("config_hash").alias("hashes"))


# events


def _day_gaps(rows):
    after = F.lead("event_time").over(events._window(["charger_id"]))
    gaps = rows.withColumn("gap_end", after).where(S.seconds(F.col("gap_end")) - S.seconds(F.col("event_time")) > 86_400)
    return gaps.select("charger_id", F.col("event_time").alias("gap_start"), "gap_end")


def _reconstructed(spark, d):
    names = {"signup": "preparing", "purchase": "charging", "error": "faulted", "view": "finishing", "click": "available"}
    pairs = F.create_map(*(F.lit(x) for p in names.items() for x in p))
    rows = telemetry(spark, d).withColumn("connector_id", F.lit("1")).withColumn("connector_status", pairs[F.col("state")]).withColumn("session_id", F.lit(None).cast("string"))
    rows = rows.withColumn("grid_fail", F.when(F.col("state") == "error", "Alarm").otherwise("ok")).withColumn("settings", F.create_map(F.lit("k"), F.col("k")))
    return events.reconstruct(rows, {"grid_fail": "MAJOR"}, ["grid_fail"], _day_gaps(rows), config="settings")


_GAPS = "p AS (SELECT charger_id, event_time, lead(event_time) OVER (PARTITION BY charger_id ORDER BY event_time, frame_sequence) nxt FROM t), gaps AS (SELECT charger_id, event_time gs, nxt ge FROM p WHERE epoch_us(nxt) - epoch_us(event_time) > 86400000000)"


@query("reconstructed_alarms", f"""
WITH {_RUNS}, {_GAPS}, f AS (SELECT *, EXISTS (SELECT 1 FROM gaps g WHERE g.charger_id = runs.charger_id AND NOT (ge <= start_time OR gs >= coalesce(end_time, last_active))) has_gap FROM runs)
SELECT charger_id, 'grid_fail' code, 'MAJOR' severity, 'Alarm' start_state, CASE WHEN end_time IS NULL THEN 'Alarm' ELSE 'ok' END end_state, start_time, end_time, has_gap, CASE WHEN end_time IS NULL OR has_gap THEN 'MEDIUM' ELSE 'HIGH' END confidence, nullif(concat_ws(',', CASE WHEN end_time IS NULL THEN 'ALARM_OPEN_ENDED' END, CASE WHEN has_gap THEN 'EVENT_HAS_GAP' END), '') flags FROM f""")
def reconstructed_alarms(spark, d):
    found = _reconstructed(spark, d)["alarms"]
    return _plain(found.select("charger_id", "code", "severity", "start_state", "end_state", "start_time", "end_time", "has_gap", "confidence", F.nullif(F.array_join("quality_flags", ","), F.lit("")).alias("flags")))


@query("reconstructed_settings", f"""
WITH {_T}, c AS (SELECT *, lag(k) OVER w old, row_number() OVER w n FROM t WINDOW w AS (PARTITION BY charger_id ORDER BY event_time, frame_sequence)) SELECT charger_id, count(*) changes, max(event_time) last_change FROM c WHERE n > 1 AND k IS DISTINCT FROM old GROUP BY 1""")
def reconstructed_settings(spark, d):
    return _plain(_reconstructed(spark, d)["config_changes"].groupBy("charger_id").agg(F.count("*").alias("changes"), F.max("event_time").alias("last_change")))


@query("resumed_alarms", f"""
WITH {_PROFILE}, u AS (SELECT charger_id, coalesce(expected, round(med, 2)) usual FROM f), gaps AS (SELECT charger_id, prev gs, event_time ge FROM p JOIN u USING (charger_id) WHERE delta > CASE WHEN usual > 0 THEN greatest(180, usual * 2.5) ELSE 300 END),
{_RUNS.removeprefix(f"{_T}, ")}, h AS (SELECT *, EXISTS (SELECT 1 FROM gaps g WHERE g.charger_id = runs.charger_id AND NOT (ge <= start_time OR gs >= coalesce(end_time, last_active))) has_gap FROM runs)
SELECT CAST(charger_id AS VARCHAR) charger_id, start_time, last_active, end_time, observations, has_gap, CASE WHEN end_time IS NULL OR has_gap THEN 'MEDIUM' ELSE 'HIGH' END confidence FROM h""")
def resumed_alarms(spark, d):
    """Alarms after a first run, and after a second one whose rows come late and lie all over the first one's days."""
    target = f"{shared_dir(spark)}/resumed-{uuid.uuid4().hex}"
    rows = telemetry(spark, d).withColumn("connector_id", F.lit("1")).withColumn("grid_fail", F.when(F.col("state") == "error", "Alarm").otherwise("ok"))
    late = (F.col("charger_id") % 4 == 0) & (F.dayofmonth("event_time") == 11)
    for part in (rows.where(~late), rows.where(late)):
        resumed.add(spark, part, target, ["grid_fail"], [], "UTC")
    found = resumed.tables(spark, target, ["grid_fail"])["alarms"]
    return _plain(found.select("charger_id", "start_time", "last_active", "end_time", "observations", "has_gap", "confidence"))


@query("profile_of_days", f"""
WITH {_PROFILE} SELECT charger_id, observations, deltas, round(med, 2) median_interval, expected expected_interval FROM f""")
def profile_of_days(spark, d):
    """Each charger's cadence from counts of steps by day, which are a table that later days are added to."""
    steps = history.step_counts(telemetry(spark, d).withColumn("day", F.to_date("event_time")), ["charger_id", "day"])
    return history.profile_of_steps(steps).select("charger_id", "observations", "deltas", "median_interval", "expected_interval")


@query("sessions_with_ids", f"""
WITH {_T}, {_GAPS}, r AS (SELECT charger_id, CAST(CAST(event_time AS DATE) AS VARCHAR) sid, min(event_time) s, max(event_time) l, arg_min(value, event_time) soc0, arg_max(value, event_time) soc1, count(*) observations FROM t GROUP BY ALL),
f AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY charger_id ORDER BY s), l) e FROM r)
SELECT CAST(charger_id AS VARCHAR) charger_id, sid session_id, s start_time, e end_time, soc0 start_soc, soc1 end_soc, observations, h has_gap, CASE WHEN h THEN 'LOW' ELSE 'MEDIUM' END confidence,
  CASE WHEN h THEN 'EVENT_HAS_GAP,' ELSE '' END || 'SESSION_BOUNDARY_INFERRED' flags FROM (SELECT *, EXISTS (SELECT 1 FROM gaps g WHERE g.charger_id = f.charger_id AND NOT (ge <= s OR gs >= e)) h FROM f)""")
def sessions_with_ids(spark, d):
    """Each charger's local day is a session of its own id, its value a state of charge."""
    rows = telemetry(spark, d).withColumn("connector_id", F.lit("1")).withColumn("connector_status", F.lit(None).cast("string"))
    gaps = _day_gaps(rows).withColumn("charger_id", F.col("charger_id").cast("string"))
    rows = rows.withColumns({"session_id": F.to_date("event_time").cast("string"), "start_soc": F.col("value"), "stop_soc": F.col("value")})
    found = events.sessions(rows, gaps)
    return _plain(found.select("charger_id", "session_id", "start_time", "end_time", "start_soc", "end_soc", "observations", "has_gap", "confidence", F.array_join("quality_flags", ",").alias("flags")))


@query("session_outcomes", """
SELECT word, state, ended FROM (VALUES ('Available', 'IDLE', 'NORMAL'), ('plugged', 'PLUGGED', 'NORMAL'), ('Preparing', 'PREPARING', 'NORMAL'), ('Authorized', 'AUTHORIZED', 'NORMAL'), ('Charging', 'CHARGING', 'NORMAL'), ('ev_suspended', 'SUSPENDED', 'NORMAL'), ('stopping', 'FINISHING', 'USER_STOPPED'),
  ('completed', 'COMPLETED', 'NORMAL'), ('emergency', 'FAULTED', 'EMERGENCY_STOPPED'), ('remote stop', 'UNKNOWN', 'REMOTE_STOPPED'), ('ground fault', 'UNKNOWN', 'FAULT_STOPPED'), ('CommLost', 'UNKNOWN', 'COMMUNICATION_LOST')) v(word, state, ended)""")
def session_outcomes(spark, d):
    words = ("Available", "plugged", "Preparing", "Authorized", "Charging", "ev_suspended", "stopping", "completed", "emergency", "remote stop", "ground fault", "CommLost")
    rows = spark.createDataFrame([(w,) for w in words], "word string").withColumn("state", S.map_state(F.col("word")))
    return rows.withColumn("ended", S.termination(F.col("word"), F.col("state")))


@query("timeline_of_four", f"""
WITH {_RUNS}, m AS (SELECT *, lag(k) OVER w old, lag(state) OVER w was, row_number() OVER w n FROM t WINDOW w AS (PARTITION BY charger_id ORDER BY event_time, frame_sequence)),
u AS (SELECT event_time, 'session' kind, CAST(charger_id AS VARCHAR) title, 0 r FROM t WHERE state = 'signup' UNION ALL SELECT start_time, 'alarm', CAST(charger_id AS VARCHAR), 1 FROM runs
UNION ALL SELECT event_time, 'transition', state, 2 FROM m WHERE n > 1 AND state IS DISTINCT FROM was UNION ALL SELECT event_time, 'configuration', k, 3 FROM m WHERE n > 1 AND k IS DISTINCT FROM old)
SELECT event_time, kind, title FROM u ORDER BY event_time, r, title LIMIT 300""")
def timeline_of_four(spark, d):
    rows = telemetry(spark, d)
    changed = events.config_changes(rows.withColumn("config", F.create_map(F.lit("k"), F.col("k"))), "config", ["charger_id"])
    moved = events.state_transitions(rows, "state", ["charger_id"])
    return _plain(events.timeline(
        300, session=rows.where("state = 'signup'").select("event_time", F.col("charger_id").alias("title")), alarm=intervals(spark, d).select(F.col("start_time").alias("event_time"), F.col("charger_id").alias("title")),
        transition=moved.select("event_time", F.col("to_state").alias("title")), configuration=changed.select("event_time", F.col("changes")["k"]["new"].alias("title")),
    ))


# landing


def _landed(spark, d):
    """Devices by twenties play files of three columns; some files lack a required one, values play stamps that don't parse."""
    rows = telemetry(spark, d).withColumn("file_id", (F.col("charger_id") % 20).cast("string"))
    columns = ["state", "value", "k"]
    cells = rows.select("file_id", *(F.col(c).cast("string").alias(c) for c in columns)).unpivot("file_id", columns, "column", "value").where("not (column = 'k' and file_id % 7 = 3)")
    files = rows.groupBy("file_id").agg(F.count("*").alias("rows"), F.count_if(F.col("k").isNull() | (F.col("value") < 0.5)).alias("unparsed"))
    files = files.withColumns({"name": F.concat(F.lit("d_2024-01-"), F.lpad((F.col("file_id").cast("int") + 1).cast("string"), 2, "0"), F.lit(".csv")), "duplicate_headers": F.col("file_id").cast("int") % 3, "drifted": F.lit(0), "unknown_schema": F.col("file_id").cast("int") % 2 == 0, "expected_connectors": F.lit(None).cast("long"), "expected_smrs": F.lit(5)})
    rows = rows.withColumns({"charger_id": F.col("charger_id").cast("string"), "connector_no": F.lit("1"), "smr_no": F.col("state"), "event_time": F.to_timestamp(F.to_date("event_time")), "row_hash": landing.row_hash(F.array("state", "k"))})
    definitions = [Definition("state", allowed=("click", "view", "purchase", "signup")), Definition("value", kind="FLOAT", low=2.0, high=60.0), Definition("k", kind="INTEGER", required=True)]
    return files, landing.judged(spark, cells, rows, files, definitions, RULES)


_LANDED = f"""{_T}, e AS (SELECT charger_id, state, value, k, CAST(charger_id % 20 AS VARCHAR) file_id, CAST(event_time AS DATE) AS day FROM t),
fl AS (SELECT file_id, count(*) n, count(*) FILTER (k IS NULL OR value < 0.5) unparsed, CAST(file_id AS INT) i FROM e GROUP BY file_id),
sm AS (SELECT file_id, charger_id, day, state, k, count(*) n FROM e GROUP BY ALL),
ky AS (SELECT file_id, charger_id, day, state, sum(n) n, count(*) kinds FROM sm GROUP BY ALL),
rp AS (SELECT file_id, CAST(sum(n - 1) AS BIGINT) dup FROM sm GROUP BY 1), co AS (SELECT file_id, count(*) FILTER (n > 1) coll, count(*) FILTER (kinds > 1) conf, coalesce(sum(n) FILTER (kinds > 1), 0) conf_rows, count(DISTINCT state) smrs FROM ky GROUP BY 1),
st AS (SELECT file_id, datediff('day', lag(day) OVER (PARTITION BY file_id ORDER BY day), day) * 86400.0::DOUBLE step FROM (SELECT DISTINCT file_id, day FROM e)), sp AS (SELECT file_id, max(step) lg, median(step) md FROM st WHERE step > 0 GROUP BY 1),
dm AS (SELECT file_id, min(day) dom FROM e GROUP BY 1),
v AS (SELECT file_id, count(*) n, count(*) FILTER (state NOT IN ('click', 'view', 'purchase', 'signup')) odd, min(value) lo, max(value) hi, count(*) FILTER (value < 2 OR value > 60) wide, count(value) nv, count(k) nk FROM e GROUP BY 1),
a AS (SELECT fl.*, dup, coll, conf, conf_rows, smrs, lg, md, dom, odd, lo, hi, wide, nv, nk, i % 7 = 3 lacks FROM fl JOIN rp USING (file_id) JOIN co USING (file_id) LEFT JOIN sp USING (file_id) JOIN dm USING (file_id) JOIN v USING (file_id))"""


@query("landed_findings", f"""
WITH {_LANDED}, u AS (
  SELECT file_id, 'MISSING_REQUIRED_FIELD' code, 'CRITICAL' severity, 'k' field, 1 "count" FROM a WHERE lacks UNION ALL SELECT file_id, 'ALL_NULL_FIELD', 'INFO', 'k', n FROM a WHERE NOT lacks AND nk = 0
  UNION ALL SELECT file_id, 'OUT_OF_RANGE', 'ERROR', 'value', 1 FROM a WHERE lo < 2 OR hi > 60 UNION ALL SELECT file_id, 'UNKNOWN_ENUM_VALUE', 'WARNING', 'state', odd FROM a WHERE odd > 0
  UNION ALL SELECT file_id, 'DUPLICATE_HEADER', 'WARNING', NULL, i % 3 FROM a WHERE i % 3 > 0 UNION ALL SELECT file_id, 'INVALID_TIMESTAMP', CASE WHEN unparsed > 0.02 * n THEN 'CRITICAL' ELSE 'WARNING' END, NULL, unparsed FROM a WHERE unparsed > 0
  UNION ALL SELECT file_id, 'TELEMETRY_GAP', 'WARNING', NULL, 1 FROM a WHERE lg > 5 * md UNION ALL SELECT file_id, 'EXACT_DUPLICATE', 'WARNING', NULL, dup FROM a WHERE dup > 0
  UNION ALL SELECT file_id, 'LOGICAL_KEY_COLLISION', CASE WHEN conf > 0 THEN 'ERROR' ELSE 'WARNING' END, NULL, coll FROM a WHERE coll > 0 UNION ALL SELECT file_id, 'UNEXPECTED_SMR_CARDINALITY', 'WARNING', NULL, smrs FROM a WHERE smrs <> 5
  UNION ALL SELECT file_id, 'EVENT_DATE_FILENAME_MISMATCH', 'INFO', NULL, 1 FROM a WHERE dom <> DATE '2024-01-01' + CAST(i AS INT))
SELECT file_id, code, severity, field, CAST("count" AS BIGINT) "count" FROM u""")
def landed_findings(spark, d):
    return _landed(spark, d)[1][0].select("file_id", "code", "severity", "field", "count")


@query("landed_states", f"""
WITH {_LANDED}, s AS (SELECT *, 2 * n + CASE WHEN lacks OR nk = 0 THEN 0 ELSE n END slots, n + nv + CASE WHEN lacks THEN 0 ELSE nk END vals FROM a),
g AS (SELECT file_id, round(100.0::DOUBLE - CASE WHEN lacks THEN 30 ELSE 0 END - least(10, 2.0 * (i % 3)) - CASE WHEN i % 2 = 0 THEN 10 ELSE 0 END, 2)::DOUBLE schema_score, round(100.0::DOUBLE * vals / slots, 2) completeness_score, round(100.0::DOUBLE * (1 - (odd + wide)::DOUBLE / vals), 2) validity_score,
  round(greatest(0, 100.0::DOUBLE - 100.0::DOUBLE * (dup / n) - 100.0::DOUBLE * (conf_rows / n)), 2) duplicate_score, round(100.0::DOUBLE * (1 - unparsed / n) - CASE WHEN lg > 5 * md THEN least(30, 10.0::DOUBLE * (lg / (5 * md) - 1)) ELSE 0 END, 2) timestamp_score,
  CASE WHEN lacks THEN 1 ELSE 0 END + CASE WHEN unparsed > 0.02 * n THEN 1 ELSE 0 END critical FROM s)
SELECT *, round(0.3::DOUBLE * schema_score + 0.2::DOUBLE * completeness_score + 0.2::DOUBLE * validity_score + 0.15::DOUBLE * duplicate_score + 0.15::DOUBLE * timestamp_score, 2) overall_score, CASE WHEN critical > 0 THEN 'QUARANTINED' ELSE 'READY_FOR_NORMALIZATION' END state FROM g""")
def landed_states(spark, d):
    files, (findings, scores) = _landed(spark, d)
    return scores.join(landing.states(files, findings), "file_id")
