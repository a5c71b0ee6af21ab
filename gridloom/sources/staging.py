"""Staged files: each content is parsed once, on first sight, into tables that all jobs share.

Under a folder: `rows` (records as cells, see scan), `headers` (a row a column) and `files` (a row a content), each batch
a partition of its own. A content's row in `files` is written last and makes it count, so a batch that broke off leaves
nothing that is read; the next one parses its files again. A staged file may leave its inbox.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources import csv_files, scan

FILES = "file_id string, records long, columns int, header string, batch string"
HEADERS = "file_id string, position int, source_name string, occurrence int, canonical_name string, requires_review boolean, fingerprint string, batch string"


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, empty where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # no table yet
        return spark.createDataFrame([], schema)


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, records, columns, header, batch) of each content that is staged; file_id is its SHA-256."""
    return table(spark, f"{folder}/files", FILES)


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """A row a column of each staged content, as csv_files.headers() gives them."""
    return table(spark, f"{folder}/headers", HEADERS)


def stage(spark: SparkSession, files: DataFrame, folder: str) -> int:
    """Parse the contents among files (path, sha256, length) that aren't staged yet and aren't too large; how many these are."""
    known = contents(spark, folder).select(F.col("file_id").alias("sha256"))
    new = files.where(F.col("length") <= csv_files.FILE_LIMIT).join(known, "sha256", "left_anti").groupBy("sha256").agg(F.min("path").alias("path")).collect()
    if not new:
        return 0
    names, batch = {r.path: r.sha256 for r in new}, uuid.uuid4().hex
    at = f"{folder}/rows/batch={batch}"
    scan.scanned(spark, sorted(names), names).write.option("compression", "zstd").parquet(at)
    pieces = spark.read.schema(scan.PIECES).parquet(at)

    def head(frames):
        for frame in frames:
            for name, cells in zip(frame["file_id"], frame["cells"], strict=True):
                found = csv_files.header_fields([c or "" for c in cells])
                yield pd.DataFrame(found, columns=["position", "source_name", "occurrence", "canonical_name", "requires_review"]).assign(file_id=name, fingerprint=csv_files.fingerprint([r["source_name"] for r in found]))

    fields = HEADERS.rpartition(",")[0]
    first = scan.stitched(pieces.where("record = 0")).select("file_id", "cells").mapInPandas(head, fields)
    first.write.parquet(f"{folder}/headers/batch={batch}")
    heads = spark.read.schema(fields).parquet(f"{folder}/headers/batch={batch}")
    heads = heads.groupBy("file_id").agg(F.count("*").cast("int").alias("columns"), F.first("fingerprint").alias("header"))
    counts = pieces.groupBy("file_id").agg(F.max("record").alias("records"))  # without the header
    every = spark.createDataFrame([(s,) for s in names.values()], "file_id string").join(counts, "file_id", "left").join(heads, "file_id", "left")
    every.selectExpr("file_id", "coalesce(records, 0) records", "coalesce(columns, 0) columns", "header").write.parquet(f"{folder}/files/batch={batch}")
    return len(new)


def rows(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(file_id, source_row_number, cells, header) of the staged contents that files (sha256) name; rows are numbered from 0."""
    some = contents(spark, folder).join(files.selectExpr("sha256 file_id").distinct(), "file_id", "left_semi").select("file_id", "header", "batch")
    batches = [r.batch for r in some.select("batch").distinct().collect()]
    try:
        pieces = spark.read.schema(f"{scan.PIECES}, batch string").parquet(f"{folder}/rows")
    except AnalysisException:
        pieces = spark.createDataFrame([], f"{scan.PIECES}, batch string")
    pieces = pieces.where(F.col("batch").isin(batches)).join(some.drop("batch"), "file_id")
    kept = scan.stitched(pieces.where("record > 0")).join(some.drop("batch"), "file_id")
    return kept.select("file_id", (F.col("record") - 1).alias("source_row_number"), "cells", "header")


def layouts(heads: DataFrame) -> dict[str, list[str]]:
    """Column names by header fingerprint; a header a row and column reaches the driver, however many files share it."""
    names: dict[str, list[str]] = {}
    for r in heads.select("fingerprint", "position", "canonical_name").distinct().orderBy("fingerprint", "position").collect():
        names.setdefault(r.fingerprint, []).append(r.canonical_name)
    return names


def column(layout: dict[str, list[str]], name: str) -> Column:
    """The cell of a column in rows of any of these headers."""
    at: dict[int, list[str]] = {}
    for header, names in layout.items():
        if name in names:
            at.setdefault(names.index(name), []).append(header)
    cells = [(h, F.get("cells", F.lit(i))) for i, h in sorted(at.items())]
    if len(cells) == 1 and len(cells[0][0]) == len(layout):
        return cells[0][1]
    return F.coalesce(*(F.when(F.col("header").isin(h), c) for h, c in cells)) if cells else F.lit(None).cast("string")


def columns(layout: dict[str, list[str]]) -> list[str]:
    """All names, by their first place."""
    first: dict[str, int] = {}
    for names in layout.values():
        for i, n in enumerate(names):
            first[n] = min(first.get(n, i), i)
    return sorted(first, key=lambda n: (first[n], n))
