"""Mended findings of round 3, each on a table that is wrong without the mend."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as entry
from gridloom import session
from gridloom.operators import frames
from gridloom.plans import catalogue

DATA = "/root/testdata/sf0.001"


def same(spark, name, folder, *tables):
    """The query's rows over folder's tables equal its SQL's, by their spelling (0.0 isn't -0.0)."""
    duck = duckdb.connect()
    duck.sql("SET TimeZone='UTC'")
    for t in tables:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = duck.sql(entry.oracle_sql()[name])
    got = sorted(str(tuple(r)) for r in entry.queries()[name](spark, str(folder)).select(*found.columns).collect())
    assert got == sorted(map(str, found.fetchall()))


@pytest.fixture(scope="module")
def prices(tmp_path_factory):
    """Items of which some cost what research takes as no value, and measures that hardly hang together."""
    folder = tmp_path_factory.mktemp("prices")
    duckdb.sql(f"""COPY (SELECT i l_orderkey, CAST(hash(i, 1) % 50 AS DOUBLE) l_quantity, CASE WHEN i % 50 = 0 THEN [-1.0, 255.0, 9999.0, 65535.0, 99999.0][1 + i // 50 % 5] ELSE CAST(900 + hash(i, 2) % 100000 AS DOUBLE) END l_extendedprice,
      CAST(hash(i, 3) % 11 AS DOUBLE) / 100 l_discount, CAST(hash(i, 4) % 9 AS DOUBLE) / 100 l_tax, TIMESTAMP '2024-01-01' + INTERVAL (i % 360) DAY l_shipdate FROM range(4000) t(i)) TO '{folder}/lineitem.parquet'""")
    return folder


def test_correlation_matrix_of_prices(spark, prices):
    same(spark, "correlation_matrix", prices, "lineitem")


def test_spearman_of_prices(spark, prices):
    same(spark, "spearman", prices, "lineitem")


def test_wide_correlations_of_prices(spark, prices):
    same(spark, "wide_correlations", prices, "lineitem")


def test_rounded_once_with_its_sign(spark):
    from pyspark.sql import functions as F

    from gridloom.functions.scalars import rounded

    row = spark.createDataFrame([(-0.00001, 0.0000449996, None)], "a double, b double, c double").select(*(rounded(F.col(c), 5 if c == "b" else 4).alias(c) for c in "abc")).first()
    assert row.a == 0 and math.copysign(1, row.a) == -1 and row.b == 0.00004 and row.c is None


@pytest.fixture
def few_rows_a_task(spark, monkeypatch):
    """A hundred rows to a task, and no table sent whole: what millions of rows meet."""
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_batches_of_frames_take_tasks_by_their_rows(spark, few_rows_a_task):
    rows = [(str(i), dt.datetime(2026, 1, 1), "x", "f", i, 0) for i in range(6000)]
    found = spark.createDataFrame(rows, "charger_id string, event_time timestamp, fingerprint string, file_id string, frame_sequence long, received_at int")
    assert frames.against_stored(found, spark.createDataFrame([], frames.STORED)).rdd.getNumPartitions() >= 60
    same(spark, "frames_in_batches", DATA, "lineitem")


def test_slices_take_tasks_by_their_rows(spark, few_rows_a_task):
    assert catalogue._frames(spark, DATA).rdd.getNumPartitions() >= 60
    for name in ("frame_slices", "replay_class", "frame_summary", "frame_collisions"):
        same(spark, name, DATA, "lineitem")


def test_silver_cells_take_tasks_by_their_number(spark, few_rows_a_task):
    assert entry.queries()["silver_values"](spark, DATA).rdd.getNumPartitions() >= 60
    same(spark, "silver_values", DATA, "lineitem")
