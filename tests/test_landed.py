"""Profiles of landing files: where their cells meet, and which cells are numbers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom.plans import landing
from gridloom.sources.dictionary import Definition
from tests.test_findings_r03 import DATA, same

NUMBERS = ("7", " 7 ", "\t7", "+7", "-.5", ".5e3", "1d", "0x1p3", "Infinity", "-inf", "iNf", "NaN", "nan")
WORDS = ("click", "seven", "x7", "E5", "--", "1,5", ":7", "٧", "é", "inn", "nil", "n/a", "")


def profiles(spark, cells, *definitions):
    return landing.field_profiles(spark.createDataFrame(cells, "file_id string, column string, value string"), landing.definitions_table(spark, list(definitions)), [d.canonical_name for d in definitions])


def test_cells_do_not_meet_by_column_alone(spark):
    """Definitions go to the cells: dealt by column, the cells of all files are as many tasks as there are columns."""
    plan = profiles(spark, [("f", "k", "1")], Definition("k", kind="INTEGER"), Definition("gone"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(file_id" in plan and "hashpartitioning(column" not in plan
    assert plan.count("Scan ExistingRDD[file_id") == 1  # cells are read once


def test_columns_that_a_file_lacks(spark):
    found = profiles(spark, [("f", "k", "1"), ("f", "more", "x"), ("g", "gone", None)], Definition("k", kind="INTEGER", required=True), Definition("gone"))
    rows = {(r.file_id, r.column): (r.rows, r.non_null, r.required, r.known) for r in found.collect()}
    assert rows == {("f", "k"): (1, 1, True, True), ("f", "gone"): (None, None, False, True), ("f", "more"): (1, 1, False, False), ("g", "gone"): (1, 0, False, True), ("g", "k"): (None, None, True, True)}
    assert [(r.rows, r.known) for r in profiles(spark, [("f", "k", "1")]).collect()] == [(1, True)]  # no definition at all
    assert profiles(spark, [], Definition("k")).count() == 0


def test_what_is_a_number(spark):
    """A cell alone in its file counts as a number exactly where a cast of its trimmed text gives one."""
    cells = spark.createDataFrame([(str(i), "k", v) for i, v in enumerate(NUMBERS + WORDS)], "file_id string, column string, value string")
    v = F.when(~landing.is_missing(F.col("value")), F.trim("value"))
    n = v.try_cast("double")
    wanted = {r.file_id: (r.w, r.n) for r in cells.select("file_id", (v.isNotNull() & n.isNotNull() & ~F.isnan(n)).alias("w"), F.when(~F.isnan(n), n).alias("n")).collect()}
    found = landing.field_profiles(cells, landing.definitions_table(spark, [Definition("k", kind="FLOAT")]), ["k"])
    assert {r.file_id: (r.is_numeric, r.num_min) for r in found.collect()} == wanted
    assert {i for i, (w, _) in wanted.items() if w} >= {str(i) for i in range(7)}


def test_sentinels_are_no_values(spark):
    rows = profiles(spark, [("f", "k", v) for v in ("255", "255.0005", "3", "x", None, "")], Definition("k", kind="FLOAT", low=0.0, high=10.0, sentinels=(255.0,))).collect()
    assert [(r.rows, r.non_null, r.num_min, r.num_max, r.sentinel_hits, r.violations) for r in rows] == [(6, 4, 3.0, 3.0, 2, 1)]


@pytest.mark.parametrize("name", ["landed_findings", "landed_states"])
def test_landed(spark, name):
    same(spark, name, DATA, "events")


def test_landed_findings_read_cells_once(spark, monkeypatch):
    """The query's own cells: one reading of the table, and none dealt by column, which put all cells of a column into one task."""
    plans, profiles_of = [], landing.field_profiles

    def seen(*given):
        found = profiles_of(*given)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(landing, "field_profiles", seen)
    entry.queries()["landed_findings"](spark, DATA)
    (plan,) = plans
    assert "hashpartitioning(column" not in plan
    assert plan.count("FileScan parquet") == 1
