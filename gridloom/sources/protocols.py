"""Where files come from and where their bytes are kept: protocols that jobs may be given, and an implementation of each."""

from __future__ import annotations

import datetime as dt
from pathlib import Path
from typing import Protocol, runtime_checkable
from urllib.parse import unquote, urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources import csv_files, store


@runtime_checkable
class Source(Protocol):
    """Files to land: what there is, their bytes, and what becomes of them."""

    def discover(self, spark: SparkSession) -> DataFrame:
        """(path, name, length, received_at) of the files, by path."""

    def fetch(self, spark: SparkSession) -> DataFrame:
        """(path, content, reason): the bytes of each file, or the reason why they aren't read."""

    def acknowledge(self, paths: list[str], ok: bool) -> list[str]:
        """Told that files were landed or not; the places where they lie afterwards."""


@runtime_checkable
class Storage(Protocol):
    """Immutable bytes by their hash."""

    def store(self, files: DataFrame, receipt_date: str) -> int:
        """Keep (path, content) that aren't kept yet; how many were new."""

    def exists(self, sha256: str) -> bool: ...

    def open(self, sha256: str) -> bytes: ...

    def quarantine(self, files: DataFrame) -> None:
        """Note (path, name, sha256, reason)."""


def _local(path: str) -> Path:
    """A path of the driver's file system; moving files elsewhere is for the store that holds them."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"files of {url.scheme}: are not moved from here")
    return Path(unquote(url.path))


class FolderSource:
    """A folder's CSV files. Landed ones move to the archive, where one is given, under another name if theirs is taken;
    others stay for another try."""

    def __init__(self, folder: str, archive: str | None = None, pattern: str = "*.csv", max_bytes: int = csv_files.FILE_LIMIT):
        self.folder, self.archive, self.pattern, self.max_bytes = folder, archive, pattern, max_bytes

    def _files(self, spark: SparkSession) -> DataFrame:
        return spark.read.format("binaryFile").option("pathGlobFilter", self.pattern).load(self.folder)

    def discover(self, spark: SparkSession) -> DataFrame:
        files = self._files(spark)
        return files.select("path", store.safe_name(F.col("path")).alias("name"), "length", F.col("modificationTime").alias("received_at")).orderBy("path")

    def fetch(self, spark: SparkSession) -> DataFrame:
        small = F.col("length") <= self.max_bytes
        read = self._files(spark).where(small).select("path", "content", F.lit(None).cast("string").alias("reason"))
        return read.unionByName(self._files(spark).where(~small).select("path", F.lit(None).cast("binary").alias("content"), F.lit("too large").alias("reason")))

    def acknowledge(self, paths: list[str], ok: bool) -> list[str]:
        if not ok or not self.archive:
            return list(paths)
        inside, out = _local(self.folder).resolve(), []
        target = _local(self.archive)
        target.mkdir(parents=True, exist_ok=True)
        for path in map(_local, paths):
            if not path.resolve().is_relative_to(inside):
                raise ValueError(f"{path} is outside the folder")
            to = target / path.name
            if to.exists():
                to = target / f"{path.stem}.{dt.datetime.now(dt.UTC):%Y%m%dT%H%M%S%f}{path.suffix}"
            out.append(str(path.rename(to)))
        return out


class StagedSource(FolderSource):
    """A fixed list of files of a staging folder: links are refused, landed files go, others stay."""

    def __init__(self, folder: str, members: list[str], **options):
        super().__init__(folder, **options)
        self.members = members
        for name in members:
            path = _local(folder) / name
            if Path(name).name != name or path.is_symlink():
                raise ValueError(f"{name} is no plain file of the staging folder")

    def _files(self, spark: SparkSession) -> DataFrame:
        return spark.read.format("binaryFile").load([f"{self.folder.rstrip('/')}/{name}" for name in self.members])

    def acknowledge(self, paths: list[str], ok: bool) -> list[str]:
        if not ok:
            return list(paths)
        for path in map(_local, paths):
            if path.name not in self.members or not path.resolve().is_relative_to(_local(self.folder).resolve()):
                raise ValueError(f"{path} is no member")
            path.unlink(missing_ok=True)
        return []


class TableStorage:
    """Bytes in a Parquet table by receipt date, each content once; what is quarantined in a table beside it."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target.rstrip("/")

    def _kept(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.target}/bytes")
        except AnalysisException:  # nothing kept yet
            return None

    def store(self, files: DataFrame, receipt_date: str) -> int:
        new = files.select(F.sha2("content", 256).alias("sha256"), store.safe_name(F.col("path")).alias("name"), F.length("content").cast("long").alias("length"), "content").dropDuplicates(["sha256"])
        if (kept := self._kept()) is not None:
            new = new.join(kept.select("sha256").distinct(), "sha256", "left_anti")
        before = 0 if kept is None else kept.count()
        new.withColumn("receipt_date", F.lit(receipt_date).cast("date")).write.mode("append").partitionBy("receipt_date").parquet(f"{self.target}/bytes")
        return (self._kept().count() if self._kept() is not None else 0) - before

    def exists(self, sha256: str) -> bool:
        kept = self._kept()
        return kept is not None and not kept.where(F.col("sha256") == sha256).isEmpty()

    def open(self, sha256: str) -> bytes:
        kept = self._kept()
        row = kept and kept.where(F.col("sha256") == sha256).select("content").first()
        if not row:
            raise KeyError(sha256)
        return bytes(row.content)

    def quarantine(self, files: DataFrame) -> None:
        store.quarantine(files, f"{self.target}/quarantine")
