"""Stores and sinks: immutable bytes by receipt date, registration once, quarantine, replacement of partitions."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.session import shared_dir


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that what reads it twice doesn't make it twice."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def safe_name(name: Column) -> Column:
    """A file's base name with other characters than letters, digits, dot, dash and underscore replaced; 128 at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"[^A-Za-z0-9._-]", "_"), 1, 128)


BATCH_FILES, FILE_BYTES, BATCH_BYTES = 200, 256 << 20, 5 << 30


def outcomes(files: DataFrame, file_bytes: int = FILE_BYTES, batch_files: int | None = BATCH_FILES, batch_bytes: int | None = BATCH_BYTES, suffix: str = ".csv") -> DataFrame:
    """files (path, name, length, sha256) with their outcome, in the order of path.

    A file is judged by itself first (empty, too large, another type); of equal contents among the rest the first counts;
    of what is left so many are staged as a batch's count and bytes allow (None: all), the rest wait for the next one.
    """
    alone = F.when(F.col("length") == 0, "REJECTED_EMPTY").when(F.col("length") > file_bytes, "REJECTED_SIZE").when(~F.lower("name").endswith(suffix), "REJECTED_TYPE")
    files = files.withColumn("_alone", alone)
    same = Window.partitionBy("sha256").orderBy(F.col("_alone").isNotNull(), "path")
    files = files.withColumn("outcome", F.coalesce("_alone", F.when(F.row_number().over(same) > 1, "DUPLICATE_IN_BATCH"))).drop("_alone")
    if batch_files is None and batch_bytes is None:
        return files.withColumn("outcome", F.coalesce("outcome", F.lit("STAGED")))
    # one row a file, as many as a folder lists
    order = Window.partitionBy(F.col("outcome").isNull()).orderBy("path")
    over = (F.row_number().over(order) > (batch_files or 1 << 62)) | (F.sum("length").over(order) > (batch_bytes or 1 << 62))
    return files.withColumn("outcome", F.coalesce("outcome", F.when(over, "DEFERRED").otherwise("STAGED")))


def staged(spark: SparkSession, folder: str, limit: int = FILE_BYTES, members: DataFrame | None = None) -> DataFrame:
    """(path, name, length, sha256, received_at, outcome) of a folder's files, see outcomes(); their number isn't limited.

    `members` (name) limits the batch to a fixed list.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", safe_name(F.col("path")).alias("name"), "length", F.col("modificationTime").alias("received_at"), F.sha2("content", 256).alias("sha256"))
    if members is not None:
        files = files.join(members.select("name"), "name", "left_semi")
    return outcomes(files, limit, None, None)


def registered(files: DataFrame, known: DataFrame) -> DataFrame:
    """files (sha256, name, received_at) against known (sha256, name): SKIPPED, DUPLICATE (of original) or REGISTERED.

    Running it again over what it registered skips everything.
    """
    same = known.select("sha256", "name", F.lit(True).alias("_same")).distinct()
    by_sha = known.groupBy("sha256").agg(F.min("name").alias("_known"))
    w = Window.partitionBy("sha256").orderBy("received_at", "name")
    out = files.join(same, ["sha256", "name"], "left").join(by_sha, "sha256", "left").withColumn("_first", F.first("name").over(w)).withColumn("_n", F.row_number().over(w))
    outcome = F.when(F.col("_same"), "SKIPPED").when(F.col("_known").isNotNull() | (F.col("_n") > 1), "DUPLICATE").otherwise("REGISTERED")
    return out.withColumn("outcome", outcome).withColumn("original", F.when(F.col("outcome") == "DUPLICATE", F.coalesce("_known", "_first"))).drop("_same", "_known", "_first", "_n")


def keep_bytes(spark: SparkSession, files: str | DataFrame, target: str, receipt_date: str | None = None) -> None:
    """Append files, a folder's or those of a table (path, sha256), to the store of bytes under their receipt date (by
    default the day they were changed); committed whole or not at all. Contents of the table that are there stay out."""
    if isinstance(files, DataFrame):
        try:
            files = files.join(spark.read.parquet(target).select("sha256").distinct(), "sha256", "left_anti")
        except AnalysisException:  # no table yet
            pass
        paths = [r.path for r in files.groupBy("sha256").agg(F.min("path").alias("path")).select("path").collect()]
        if not paths:
            return
        files = paths
    files = spark.read.format("binaryFile").load(files)
    date = F.to_date("modificationTime") if receipt_date is None else F.lit(receipt_date).cast("date")
    files.select(F.sha2("content", 256).alias("sha256"), safe_name(F.col("path")).alias("name"), "length", "content", date.alias("receipt_date")).write.mode("append").partitionBy("receipt_date").parquet(target)


def quarantine(files: DataFrame, target: str) -> None:
    """Append rows with a reason to the quarantine table."""
    files.where("reason is not null").write.mode("append").parquet(target)


def replace_partitions(df: DataFrame, target: str, *by: str, touched: list | None = None) -> None:
    """Replace the partitions that df has rows of; others stay. Running it again changes nothing.

    `touched` are values of the one column `by` that df stands for: those of them that it has no row of become empty.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(target)
    if touched:
        (column,) = by
        spark = df.sparkSession
        there = {r[0] for r in spark.read.schema(df.schema).parquet(target).where(F.col(column).isin(touched)).select(column).distinct().collect()}
        fresh = {r[0] for r in df.where(F.col(column).isin(touched)).select(column).distinct().collect()} if there else set()
        for value in sorted(there - fresh):
            df.drop(column).limit(0).write.mode("overwrite").parquet(f"{target}/{column}={value}")


def upserted(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old with the rows of new in place of those of the same keys."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def unshared(owned: DataFrame, deleted: DataFrame, key: str = "frame_id") -> DataFrame:
    """Rows of owned (frame, file) whose frame no file but the deleted ones has: what a deletion may take."""
    rest = owned.join(deleted.select("file_id"), "file_id", "left_anti").select(key)
    return owned.join(deleted.select("file_id"), "file_id", "left_semi").join(rest, key, "left_anti")
