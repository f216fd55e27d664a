"""Sinks: guarded and partitioned writes, previews, record files, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, force: bool = False, by: Sequence[str] = (), codec: str = "zstd", dry_run: bool = False) -> str | None:
    """Parquet; an existing path is refused unless forced. A dry run returns the plan and writes nothing."""
    if dry_run:
        return df._jdf.queryExecution().toString()
    writer = df.write.mode("overwrite" if force else "error").option("compression", codec)
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return None


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def bucketed(df: DataFrame, table: str, key: str, buckets: int = 64) -> None:
    """A table that later joins on the key read without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)


def export(df: DataFrame, path: str) -> None:
    """CSV, JSON lines or Parquet, by the path's suffix."""
    kind = path.rsplit(".", 1)[-1].lower()
    writer = df.write.mode("overwrite")
    {"csv": lambda: writer.option("header", True).csv(path), "json": lambda: writer.json(path), "jsonl": lambda: writer.json(path)}.get(kind, lambda: writer.parquet(path))()


def documents(records: DataFrame, path: str, key: str = "key", compress: bool = True) -> DataFrame:
    """One text line a record under its key's folder, and an index: key, bytes."""
    records.select(key, F.col("record").alias("value")).write.mode("overwrite").option("compression", "gzip" if compress else "none").partitionBy(key).text(path)
    return records.select(key, F.octet_length("record").alias("bytes"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def verified(expected: DataFrame, found: DataFrame) -> DataFrame:
    """path, status (pass, fail, missing, extra) of a manifest against another."""
    x = expected.select("path", F.col("sha256").alias("want")).join(found.select("path", F.col("sha256").alias("have")), "path", "full")
    status = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") == F.col("have"), "pass").otherwise("fail")
    return x.select("path", status.alias("status"))
