"""What the operators share: tables in the shared folder, Arrow slices, fixed-size sketches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds at once; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only on a single machine whose session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = tempfile.mkdtemp(prefix="gridloom-")
    return shared_dir.own


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that go to a Python worker at once, so that a batch of long texts fits into its memory.
BATCH_ROWS = 500


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents; the session then hands rows to Python in batches of at most BATCH_ROWS."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` text bytes: (rows, their UTF-8 bytes, row offsets into these); null counts as empty."""
    at = batch.schema.get_field_index(column)
    text = batch.column(at)
    if pa.types.is_large_string(text.type):
        kind, wide = np.int64, 8
    else:
        kind, wide = np.int32, 4
    if text.null_count:
        text = text.fill_null("")
    rows = len(text)
    if not rows:
        return
    _, offsets, data = text.buffers()
    offs = np.frombuffer(offsets, kind, rows + 1, text.offset * wide).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    begin = 0
    while begin < rows:
        end = int(np.searchsorted(offs, offs[begin] + limit, side="right")) - 1
        end = min(rows, max(end, begin + 1))
        yield batch.slice(begin, end - begin), whole[offs[begin] : offs[end]], offs[begin : end + 1] - offs[begin]
        begin = end


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of each value."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1024)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] (times base**-i) the polynomial hash of data[i:j]."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the ranges [begin, end), the length included."""
    _, down = powers(len(sums))
    h = (sums[end] - sums[begin]) * down[begin]
    return mix(h + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def merged_sketch(rows: DataFrame, combine: str, dtype: str, length: int) -> np.ndarray:
    """One array of a fixed length from rows (block int, part int, cells binary), added or or-ed block by block.

    A sum that the cells can't hold stays at their largest value. Its size is a constant of the program and not of the data, so the driver may hold and broadcast it.
    """
    most = np.iinfo(dtype).max
    op = {"add": lambda a, b: np.minimum(a.astype(np.uint64) + b, most).astype(dtype), "or": np.bitwise_or}[combine]

    def merge(pdf):
        total = np.zeros(0, dtype)
        for cells in pdf["cells"]:
            x = np.frombuffer(cells, dtype)
            total = op(total, x) if len(total) else x.copy()
        return pdf.iloc[:1].assign(cells=[total.tobytes()], part=[int(pdf["part"].iloc[0]) % 16])

    schema = "block int, part int, cells binary"
    some = rows.withColumn("part", F.col("part") % 16).groupBy("block", "part").applyInPandas(merge, schema)
    out = np.zeros(length, dtype)
    for row in some.groupBy("block").applyInPandas(merge, schema).collect():
        cells = np.frombuffer(row.cells, dtype)
        out[row.block * len(cells) : row.block * len(cells) + len(cells)] = cells
    return out


def sketch_rows(cells: np.ndarray, part: int, blocks: int = 16) -> pa.RecordBatch:
    """The rows that merged_sketch() takes, for one task's array."""
    pieces = [x.tobytes() for x in np.split(cells, blocks)]
    return pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([part] * blocks, pa.int32()), pa.array(pieces, pa.binary())], ["block", "part", "cells"])


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a long, b long): root is the smallest node that links lead to.

    Large-star and small-star steps by turns; each result is a written table, and only two numbers a round reach the driver.
    For graphs without nodes of very many edges: stars come to star_components() first.
    """
    edges = edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct()
    state = None
    while True:
        edges = stored(spark, edges, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
        both = edges.union(edges.selectExpr("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) m")
        large = both.join(least, "a").where("b > a").selectExpr("b a", "m b").where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = large.join(least, "a").selectExpr("b a", "m b").union(least.selectExpr("a", "m")).where("a <> b").distinct()
    return edges.selectExpr("a node", "b root").union(edges.selectExpr("b node", "b root")).distinct()


def star_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root) for each node of links, a stored table (a long, b long) in which each a names one b, its leader.

    Only leaders that name a leader themselves are searched for components; any other node takes its leader's, by a join
    of two tables, which Spark may split where very many name one leader.
    """
    leaders = links.select("b").distinct()
    found = stored(spark, components(spark, links.join(leaders.selectExpr("b a"), "a", "left_semi")), "leaders")
    named = links.union(leaders.selectExpr("b", "b")).join(found.selectExpr("node b", "root"), "b", "left")
    return stored(spark, named.selectExpr("a node", "coalesce(root, b) root").distinct(), "components")
