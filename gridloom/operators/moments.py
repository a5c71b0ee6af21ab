"""Co-moments of hundreds of columns as matrices: partial matrices of tasks, merged block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import rounded

PAIRS_AS_COLUMNS = 120  # pairs up to which one aggregate of expressions is planned
BLOCK, FIRST_MERGES = 64, 64


def _batch(x: np.ndarray) -> np.ndarray:
    """(n, mean of i, mean of j, moment of i, moment of j, co-moment) over the rows where both columns i and j are there.

    Values are taken about a value of their column (a median of some rows), so constants give exact zeros; a spread under a
    millionth of the distance from that value counts as none within the batch.
    """
    some = x[:: max(1, len(x) // 256)]
    empty = np.isnan(some).all(axis=0)
    shift = np.zeros(x.shape[1])
    shift[~empty] = np.nanpercentile(some[:, ~empty], 50, axis=0, method="lower")
    for c in np.flatnonzero(empty):
        there = x[~np.isnan(x[:, c]), c]
        shift[c] = there[0] if len(there) else 0.0
    there = (~np.isnan(x)).astype(np.float64)
    d = np.nan_to_num(x - shift)
    n, sums, squares, products = there.T @ there, d.T @ there, (d * d).T @ there, d.T @ d
    k = np.maximum(n, 1)
    spread = squares - sums * sums / k
    spread[spread <= 1e-12 * squares] = 0.0
    mean = sums / k + shift[:, None] * (n > 0)
    return np.stack([n, mean, mean.T, spread, spread.T, products - sums * sums.T / k])


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Co-moments of the rows of both."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    dx, dy = b[1] - a[1], b[2] - a[2]
    w = a[0] * share
    return np.stack([n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w, a[5] + b[5] + dx * dy * w])


def block_correlations(rows: DataFrame, signals: list[str], digits: int = 6) -> DataFrame:
    """(a, b, pairs, r) of each pair of columns, all doubles with null for what isn't valid, in one pass over the rows.

    A task holds one matrix of co-moments, each pair over the rows where both are there, and gives it out in blocks of
    64 columns; blocks are merged in two steps, so what a task merges is bounded by the root of the number of tasks.
    r is null under three pairs or where a column doesn't vary among them.
    """
    names = sorted(signals)
    blocks = range(0, len(names), BLOCK)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = None, 0
        for f in frames:
            if len(f):
                m, seen = _batch(f.to_numpy(dtype=np.float64, na_value=np.nan)), seen + len(f)
                total = m if total is None else merged(total, m)
        if total is not None:
            # which of the first merges takes the task's part follows from what it counted; any spread is right
            part = int(hash((seen, float(total[1].sum())))) % FIRST_MERGES
            for i in blocks:
                for j in blocks:
                    if i <= j:
                        yield pd.DataFrame({"i": [i], "j": [j], "part": [part], "m": [np.ascontiguousarray(total[:, i : i + BLOCK, j : j + BLOCK]).tobytes()]})

    def added(frame: pd.DataFrame) -> np.ndarray:
        i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        shape = (6, min(BLOCK, len(names) - i), min(BLOCK, len(names) - j))
        total = np.zeros(shape)
        for m in sorted(frame["m"]):  # in one order, so reruns agree
            total = merged(total, np.frombuffer(m).reshape(shape))
        return total

    def first(frame: pd.DataFrame) -> pd.DataFrame:
        return frame[["i", "j"]].iloc[:1].assign(m=[added(frame).tobytes()])

    def last(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        n, mx, my, cx, cy, cxy = added(frame)
        sx, sy = np.sqrt(np.maximum(cx, 0) / np.maximum(n, 1)), np.sqrt(np.maximum(cy, 0) / np.maximum(n, 1))
        varies = (n >= 3) & (sx > np.maximum(1e-12, 4e-15 * np.abs(mx))) & (sy > np.maximum(1e-12, 4e-15 * np.abs(my)))
        r = np.where(varies, cxy / np.where(varies, n * sx * sy, 1.0), np.nan)
        p, q = np.nonzero((np.arange(n.shape[0]) + i)[:, None] < (np.arange(n.shape[1]) + j)[None, :])
        r = pd.Series(r[p, q].astype(object))
        return pd.DataFrame({"a": pd.Series([names[i + x] for x in p], dtype=object), "b": pd.Series([names[j + y] for y in q], dtype=object), "pairs": n[p, q].astype("int64"), "r": r.where(r.notna(), None)})

    parts = rows.select(*(F.col(f"`{s}`").alias(f"c{n}") for n, s in enumerate(names))).mapInPandas(partial, "i int, j int, part int, m binary")
    halves = parts.groupBy("i", "j", "part").applyInPandas(first, "i int, j int, m binary")
    found = halves.groupBy("i", "j").applyInPandas(last, "a string, b string, pairs long, r double")
    every = rows.sparkSession.range(1).select(F.posexplode(F.lit(names)).alias("x", "a"))
    every = every.select("a", F.explode(F.slice(F.lit(names), F.col("x") + 2, F.lit(len(names)))).alias("b"))
    return every.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("pairs", F.lit(0)).alias("pairs"), rounded(F.col("r"), digits).alias("r"))
