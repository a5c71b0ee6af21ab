"""Wide untrusted CSV exports: discovery, headers, and rows as text with stable row numbers."""

from __future__ import annotations

import csv
import hashlib
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What one value can hold while a file is hashed; parsing needs no limit.
FILE_LIMIT = (1 << 31) - (1 << 20)

# Column roles by exact canonical names, then by pattern; required ones are marked in REQUIRED_ROLES.
ROLES = {
    "EVENT_TIME": (("event_time", "logged_at_time"), r"^(event|logged|time)_?(at)?_?(time|stamp)$"),
    "CHARGER_ID": (("charger_id",), r"^charger_?(id|no)$"),
    "OCPP_ID": (("ocpp_id",), r"^ocpp_?id$"),
    "CONNECTOR": (("connector_no", "connector_id"), r"^connector_?(no|id|number)?$"),
    "SMR": (("smr_no", "smr_id"), r"^smr_?(no|id|number)?$"),
    "RECTIFIER": (("rectifier_number",), r"^rectifier_?(no|id|number)$"),
    "SESSION_ID": (("session_id",), r"^session_?id$"),
}
REQUIRED_ROLES = ("EVENT_TIME", "CHARGER_ID", "CONNECTOR", "SMR")


def _listed(spark: SparkSession, folder: str | list[str], pattern: str) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return reader.option("pathGlobFilter", pattern).load(folder) if isinstance(folder, str) else reader.load(folder)


def discover(spark: SparkSession, folder: str | list[str], pattern: str = "*.csv") -> DataFrame:
    """(path, length, modificationTime) of the folder's files (or of a list of files), by path; contents aren't read."""
    return _listed(spark, folder, pattern).select("path", "length", "modificationTime").orderBy("path")


def canonical(name: str, position: int) -> str:
    """A header cell as an identifier (functions.scalars.canonical_name is the column form)."""
    words = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip()))
    plain = re.sub(r"[^A-Za-z0-9]+", "_", words).strip("_").lower()
    if not plain:
        return f"unnamed_field_{position}"
    return f"f_{plain}" if plain[0].isdigit() else plain


def header_fields(cells: list[str]) -> list[dict]:
    """position, source_name, occurrence, canonical_name and requires_review of a header's cells.

    The k-th cell of one name gets _occurrence_k; another name that comes out alike gets _2, _3, ...
    """
    seen: dict[str, int] = {}
    owners: dict[str, str] = {}
    clashes: dict[str, int] = {}
    out = []
    for i, cell in enumerate(cells):
        name = cell.strip().lstrip("﻿").strip() if i == 0 else cell.strip()
        seen[name] = seen.get(name, 0) + 1
        base, review = canonical(name, i), False
        if not name:
            final = base
        elif seen[name] > 1:
            final, review = f"{owners_name(owners, name, base)}_occurrence_{seen[name]}", True
        elif base in owners and owners[base] != name:
            clashes[base] = clashes.get(base, 1) + 1
            final, review = f"{base}_{clashes[base]}", True
        else:
            final = base
        owners.setdefault(final, name)
        out.append({"position": i, "source_name": name, "occurrence": seen[name], "canonical_name": final, "requires_review": review})
    return out


def owners_name(owners: dict[str, str], name: str, base: str) -> str:
    """The identifier that the first cell of a name got."""
    return next((k for k, v in owners.items() if v == name), base)


def fingerprint(names: list[str]) -> str:
    """Of the names in order, repeated ones included."""
    return hashlib.sha256("\x1f".join(names).encode()).hexdigest()


def decoded(content: bytes) -> str:
    """UTF-8 with or without a mark, else Latin-1."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def parsed(content: bytes) -> Iterator[list[str]]:
    """The records of a file, its header first: one reader for both, so that quoted line breaks and the encoding agree."""
    return csv.reader(io.StringIO(decoded(bytes(content)), newline=""))


def _contents(spark: SparkSession, folder: str | list[str], pattern: str) -> DataFrame:
    """(path, content) of the files that are small enough; larger ones are for discover() and admitted() to name."""
    return _listed(spark, folder, pattern).where(F.col("length") <= FILE_LIMIT).select("path", "content")


def headers(spark: SparkSession, folder: str | list[str], pattern: str = "*.csv") -> DataFrame:
    """(file_id, position, source_name, occurrence, canonical_name, requires_review, fingerprint) of each file's header.

    `folder` may be a list of files.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                cells = next(parsed(content), [])
                rows = header_fields(cells)
                yield pd.DataFrame(rows, columns=["position", "source_name", "occurrence", "canonical_name", "requires_review"]).assign(file_id=path, fingerprint=fingerprint([r["source_name"] for r in rows]))

    return _contents(spark, folder, pattern).mapInPandas(run, "position int, source_name string, occurrence int, canonical_name string, requires_review boolean, file_id string, fingerprint string")


def rows(spark: SparkSession, folder: str | list[str], pattern: str = "*.csv") -> DataFrame:
    """(file_id, source_row_number, cells array<string>): rows as text, numbered from 0 once, here; empty cells are null.

    A file is parsed whole by one task, so quoted line breaks and row numbers hold; files are small and many.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                held, at = [], 0
                reader = parsed(content)
                next(reader, None)
                for cells in reader:
                    held.append([c or None for c in cells])
                    if len(held) == 5000:
                        yield pd.DataFrame({"file_id": path, "source_row_number": range(at, at + len(held)), "cells": held})
                        at, held = at + len(held), []
                if held:
                    yield pd.DataFrame({"file_id": path, "source_row_number": range(at, at + len(held)), "cells": held})

    return _contents(spark, folder, pattern).mapInPandas(run, "file_id string, source_row_number long, cells array<string>")


def table(spark: SparkSession, folder: str | list[str], pattern: str = "*.csv") -> DataFrame:
    """All files as one table of text columns by canonical name; files are parsed once, whatever the number of headers."""
    heads = headers(spark, folder, pattern)
    names = heads.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "canonical_name"))), lambda x: x["canonical_name"]).alias("_names"))
    columns = [r.canonical_name for r in heads.groupBy("canonical_name").agg(F.min(F.struct("position", "fingerprint")).alias("at")).orderBy("at", "canonical_name").collect()]
    # cells beyond the header have no name, names beyond the cells no value
    both = F.filter(F.arrays_zip("_names", "cells"), lambda x: x["_names"].isNotNull())
    named = rows(spark, folder, pattern).join(names, "file_id").select("file_id", "source_row_number", F.map_from_entries(both).alias("_cells"))
    return named.select("file_id", "source_row_number", *(F.element_at("_cells", F.lit(c)).alias(c) for c in columns))


def time_formats(rows: DataFrame, stamp, formats: tuple[str, ...], by: str = "file_id") -> DataFrame:
    """(file_id, form): of each file the number of the format that most of its stamps fit, the first on ties; -1 where none fits."""
    counts = rows.groupBy(by).agg(F.array(*(F.count(F.try_to_timestamp(stamp, F.lit(f))) for f in formats)).alias("n"))
    return counts.selectExpr(by, "if(array_max(n) > 0, int(array_position(n, array_max(n))) - 1, -1) form")


def roles(names: list[str]) -> dict[str, str]:
    """Column of each role: an exact name first, then the pattern; the earliest column wins."""
    out = {}
    for role, (exact, pattern) in ROLES.items():
        found = next((n for e in exact for n in names if n == e), None) or next((n for n in names if re.match(pattern, n)), None)
        if found:
            out[role] = found
    return out


def best_time_format(df: DataFrame, column: str, formats: tuple[str, ...]) -> str:
    """The format that most of a file's stamps fit; the first wins ties. One pass for all formats."""
    counts = df.agg(*(F.count(F.try_to_timestamp(F.col(column), F.lit(f))).alias(str(i)) for i, f in enumerate(formats))).first()
    return formats[max(range(len(formats)), key=lambda i: (counts[i], -i))]


def admitted(files: DataFrame, max_bytes: int = FILE_LIMIT, max_columns: int = 2000, max_rows: int = 5_000_000, unparsed: float = 0.02) -> DataFrame:
    """files (length, columns, rows, unparsed, critical) with `state` VALIDATED or QUARANTINED and the reason."""
    reason = F.concat_ws("; ", F.when(F.col("length") > max_bytes, "too large"), F.when(F.col("columns") > max_columns, "too many columns"), F.when(F.col("rows") > max_rows, "too many rows"), F.when(F.col("unparsed") > unparsed * F.col("rows"), "timestamps don't parse"), F.when(F.col("critical") > 0, "critical findings"))
    return files.withColumn("reason", F.nullif(reason, F.lit(""))).withColumn("state", F.when(F.col("reason").isNull(), "VALIDATED").otherwise("QUARANTINED"))
