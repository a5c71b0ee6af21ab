"""Time nodes and matrices of co-moments against plain forms."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import events, intervals, moments, research

T0 = dt.datetime(2026, 1, 1)
at = lambda hours: T0 + dt.timedelta(hours=hours)


def test_nodes_cover_each_cell_once(spark):
    rng = random.Random(3)
    spans = [(a, a + rng.randrange(1500)) for a in (rng.randrange(3000) for _ in range(60))] + [(0, 0), (0, 365), (5, 5 + 4096)]
    df = spark.createDataFrame([(i, T0 + dt.timedelta(days=a), T0 + dt.timedelta(days=b)) for i, (a, b) in enumerate(spans)], "i int, s timestamp, e timestamp")
    df = df.withColumn("first", F.floor(F.unix_timestamp("s") / 86_400)).withColumn("past", F.floor(F.unix_timestamp("e") / 86_400) + 1)
    for r in df.withColumn("n", intervals.time_nodes(F.col("s"), F.col("e"), 86_400)).collect():
        cells = sorted(c for n in r.n for c in range(n.node * 4**n.level, (n.node + 1) * 4**n.level))
        assert cells == list(range(r.first, r.past))
        assert len(r.n) <= 24 or r.past - r.first > 366


def test_points_in_intervals_and_overlaps_by_brute_force(spark):
    rng = random.Random(5)
    points = [(rng.choice("AB"), at(rng.randrange(20_000)), i) for i in range(300)]
    spans = [(rng.choice("ABC"), (s := rng.randrange(20_000)), s + rng.choice([0, 1, 30, 900, 9000]), i) for i in range(60)]
    p = spark.createDataFrame(points, "k string, t timestamp, p int")
    v = spark.createDataFrame([(k, at(a), at(b), i) for k, a, b, i in spans], "k string, s timestamp, e timestamp, v int")
    got = sorted((r.p, r.v) for r in intervals.points_in(p, v, ["k"], "t", "s", "e").collect())
    assert got == sorted((i, j) for k, t, i in points for q, a, b, j in spans if k == q and at(a) <= t <= at(b))
    gaps = [(rng.choice("AB"), (s := rng.randrange(20_000)), s + rng.choice([1, 30, 900])) for _ in range(12)]
    g = spark.createDataFrame([(k, at(a), at(b)) for k, a, b in gaps], "k string, gap_start timestamp, gap_end timestamp")
    open_ = {i for *_, i in spans if i % 7 == 0}
    rows = spark.createDataFrame([(k, at(a), None if i in open_ else at(b), i) for k, a, b, i in spans], "k string, start_time timestamp, end_time timestamp, v int")
    got = {r.v: r.has_gap for r in events.with_gap_flag(rows, g, ["k"]).collect()}
    want = {i: any(q == k and (y >= a if i in open_ else not (y <= a or x >= b)) for q, x, y in gaps) for k, a, b, i in spans}
    assert got == want


def test_a_year_long_open_session_is_few_rows(spark):
    df = spark.createDataFrame([(at(0), at(365 * 24))], "s timestamp, e timestamp")
    assert df.select(F.size(intervals.time_nodes(F.col("s"), F.col("e"), 86_400)).alias("n")).first().n < 40


def test_hundreds_of_signals_in_one_pass(spark):
    rng, k = np.random.default_rng(1), 449
    x = rng.normal(1e6, 1, (400, k)).cumsum(axis=1) / np.arange(1, k + 1)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 7], x[:, 8], x[10:, 9] = 0.1, np.nan, np.nan
    names = [f"s{i}" for i in range(k)]
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3).select(*(F.nanvl(F.col("x")[i], F.lit(None).cast("double")).alias(s) for i, s in enumerate(names)))
    got = {(r.a, r.b): r for r in research.correlation_matrix(rows, names).collect()}
    assert len(got) == k * (k - 1) // 2 and got["s7", "s9"].r is None and got["s10", "s8"].pairs == 0
    for a, b in [("s0", "s1"), ("s100", "s448"), ("s447", "s448"), ("s200", "s64")]:
        both = ~np.isnan(x[:, int(a[1:])]) & ~np.isnan(x[:, int(b[1:])])
        want = np.corrcoef(x[both, int(a[1:])], x[both, int(b[1:])])[0, 1]
        assert got[a, b].pairs == both.sum() and abs(got[a, b].r - want) < 2e-6


def test_matrices_equal_columns(spark, monkeypatch):
    rows = spark.createDataFrame([(float(i % 7), float(i * i % 11), None if i % 3 else float(i), 5.0) for i in range(90)], "a double, b double, c double, `d.e` double").repartition(5)
    plain = research.correlation_matrix(rows, ["c", "a", "b", "d.e"]).collect()
    monkeypatch.setattr(research, "PAIRS_AS_COLUMNS", 0)
    assert sorted(research.correlation_matrix(rows, ["c", "a", "b", "d.e"]).collect()) == sorted(plain)
    empty = research.correlation_matrix(rows.where("a > 99"), ["a", "b", "c"]).collect()
    assert [(r.a, r.b, r.pairs, r.r) for r in sorted(empty)] == [("a", "b", 0, None), ("a", "c", 0, None), ("b", "c", 0, None)]
    assert moments.merged(*[moments._batch(np.array([[1.0, 2.0]]))] * 2)[0].tolist() == [[2, 2], [2, 2]]
