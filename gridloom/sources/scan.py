"""CSV files read in byte ranges: records, their numbers and their cells, wherever Spark cuts a file.

Spark's text reader deals ranges of a file to tasks and gives each its lines. Whether a line begins a record depends on
whether a quoted field is open before it, so on all lines before; but at a line's begin there are only two states. One
pass works out, for each range and each of both states, the state after it and how many records begin in it. Composed
over a file's ranges in order, these tell the state and the number of records before each range, and a second pass cuts
records and numbers them. A record that crosses ranges is given in pieces, which stitched() puts together; there is one
a range at most. No task holds a file, and a range's rows stay in the task that reads them.

Records, cells and numbers are those of Python's csv reader over the whole file: a quote opens a field only at its begin,
doubled quotes are quotes, line breaks in quotes belong to their cell, any of \\n, \\r\\n and \\r ends a record, blank lines
are records without cells. A file is UTF-8, with or without a mark, or Latin-1 if some line isn't UTF-8.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = b"\xef\xbb\xbf"
PIECES = "file_id string, record long, block long, at long, raw binary, utf8 boolean, cells array<string>"


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_id, block, line): the lines of each range in order, without the \\n at their ends."""
    rows = spark.read.option("lineSep", "\n").text(paths)
    return rows.select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def parts(line: bytes) -> list[bytes]:
    """A line as what \\r ends, each with its end."""
    line += b"\n"
    if b"\r" not in line:
        return [line]
    out, at = [], 0
    while (end := line.find(b"\r", at)) >= 0 and end < len(line) - 2:
        out.append(line[at : end + 1])
        at = end + 1
    return [*out, line[at:]]


def open_after(part: bytes, quoted: bool) -> bool:
    """Whether a quoted field is open after a part of a record, if one was or wasn't before it."""
    if b'"' not in part:
        return quoted
    at = 0
    while True:
        if quoted:
            at = part.find(b'"', at)
            if at < 0:
                return True
            if part[at + 1 : at + 2] == b'"':
                at += 2
                continue
            quoted, at = False, part.find(b",", at)
        elif part[at : at + 1] == b'"':
            quoted, at = True, at + 1
            continue
        else:
            at = part.find(b",", at)
        if at < 0:
            return False
        at += 1


def plain(path: str) -> str:
    """A path as one spelling: local files come with one or three slashes after their scheme."""
    return re.sub(r"^file:/+", "/", path)


def _ranges(batches) -> Iterator[tuple[tuple[str, int], list[bytes]]]:
    """Runs of lines of one range."""
    for batch in batches:
        files, blocks, held = batch.column("file_id"), batch.column("block").to_pylist(), batch.column("line").to_pylist()
        files = files.to_pylist()
        at = 0
        for i in range(1, len(blocks) + 1):
            if i == len(blocks) or blocks[i] != blocks[at] or files[i] != files[at]:
                yield (files[at], blocks[at]), held[at:i]
                at = i


def _summaries(batches):
    """(file_id, block, open0, open1, n0, n1, utf8) of each range: what follows from either state before it."""

    def row(key, states, counts, fine):
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), *(pa.array([s]) for s in states), *(pa.array([n], pa.int64()) for n in counts), pa.array([fine])], ["file_id", "block", "open0", "open1", "n0", "n1", "utf8"])

    now, states, counts, fine = None, [False, True], [0, 0], True
    for key, own in _ranges(batches):
        if key != now:
            if now:
                yield row(now, states, counts, fine)
            now, states, counts, fine = key, [False, True], [0, 0], True
        for line in own:
            if fine and not line.isascii():
                try:
                    line.decode()
                except UnicodeDecodeError:
                    fine = False
            for part in parts(line):
                for k in (0, 1):
                    counts[k] += not states[k]
                    states[k] = open_after(part, states[k])
    if now:
        yield row(now, states, counts, fine)


def _composed(pdf: pd.DataFrame) -> pd.DataFrame:
    """(file_id, block, quoted, base, utf8) of a file's ranges: the state and the number of records before each."""
    pdf = pdf.sort_values("block")
    quoted, base, out = False, 0, []
    for r in pdf.itertuples(index=False):
        out.append((r.file_id, r.block, quoted, base, bool(pdf["utf8"].all())))
        quoted, base = (r.open1, base + r.n1) if quoted else (r.open0, base + r.n0)
    return pd.DataFrame(out, columns=["file_id", "block", "quoted", "base", "utf8"])


def cells_of(raw: bytes, utf8: bool) -> list[str | None]:
    """The cells of one record; empty ones are null."""
    text = raw.decode("utf-8" if utf8 else "latin-1")
    return [c or None for c in next(csv.reader(io.StringIO(text, newline="")), [])]


def _pieces(starts, limit: int = 5000):
    def run(batches):
        known = starts.value
        names = [f.split()[0] for f in PIECES.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.list_(pa.string())]
        out: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        now, name, held, quoted, record, utf8, whole, at = None, None, [], False, 0, True, True, 0
        for key, own in _ranges(batches):
            if key != now:
                if held:  # the record goes on in the next range
                    out.append((name, record, now[1], at, b"".join(held), utf8, None))
                now, held, at = key, [], 0
                quoted, base, utf8, name = known[key]
                record, whole = base - 1, not quoted
            for line in own:
                if now[1] == 0 and at == 0 and utf8 and line.startswith(MARK):
                    line = line[3:]
                for part in parts(line):
                    if not quoted:
                        record, whole = record + 1, True
                    held.append(part)
                    at += 1
                    quoted = open_after(part, quoted)
                    if not quoted:
                        raw = b"".join(held)
                        out.append((name, record, now[1], at, None if whole else raw, utf8, cells_of(raw, utf8) if whole else None))
                        held = []
                if len(out) >= limit:
                    yield flush()
                    out.clear()
        if held:
            out.append((name, record, now[1], at, b"".join(held), utf8, None))
        if out:
            yield flush()

    return run


def scanned(spark: SparkSession, paths: list[str], names: dict[str, str] | None = None) -> DataFrame:
    """Records and pieces of records (PIECES) of files; record 0 is the header. `names` gives paths the file_id to have."""
    names = {plain(p): n for p, n in (names or {}).items()}
    summary = lines(spark, paths).mapInArrow(_summaries, "file_id string, block long, open0 boolean, open1 boolean, n0 long, n1 long, utf8 boolean")
    begins = summary.groupBy("file_id").applyInPandas(_composed, "file_id string, block long, quoted boolean, base long, utf8 boolean")
    # a row a range, as the driver's own list of ranges has
    starts = spark.sparkContext.broadcast({(r.file_id, r.block): (r.quoted, r.base, r.utf8, names.get(plain(r.file_id), r.file_id)) for r in begins.collect()})
    return lines(spark, paths).mapInArrow(_pieces(starts), PIECES)


def stitched(pieces: DataFrame) -> DataFrame:
    """(file_id, record, cells) of scanned() rows, records in pieces put together."""

    def run(batches):
        for batch in batches:
            cells = [cells_of(b"".join(raw), utf8) for raw, utf8 in zip(batch.column("raws").to_pylist(), batch.column("utf8").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("record"), pa.array(cells, pa.list_(pa.string()))], ["file_id", "record", "cells"])

    cut = pieces.where("raw is not null").groupBy("file_id", "record").agg(F.array_sort(F.collect_list(F.struct("block", "at", "raw"))).alias("p"), F.first("utf8").alias("utf8"))
    cut = cut.select("file_id", "record", F.transform("p", lambda x: x["raw"]).alias("raws"), "utf8").mapInArrow(run, "file_id string, record long, cells array<string>")
    return pieces.where("raw is null").select("file_id", "record", "cells").unionByName(cut)
