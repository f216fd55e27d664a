"""Readers: databases, delimited files, record files of several formats, archives, marked-up tables, settings."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def jdbc(spark: SparkSession, url: str, sql: str, split_on: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, fetch: int = 5000, **options: str) -> DataFrame:
    """A query of a relational database, in ``parts`` ranges of ``split_on`` if given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"({sql}) q", fetchsize=str(fetch), **options)
    if split_on and bounds:
        reader = reader.options(partitionColumn=split_on, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def only_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the ids: one semi join in place of lists of literals."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def parquet(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One path, several, or a glob; the named columns alone."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(*columns) if columns else df


def csv_text(spark: SparkSession, paths: str | Sequence[str], casts: dict[str, str] | None = None) -> DataFrame:
    """Delimited files with a header, every column text; ``casts`` are tried, what does not parse is null."""
    df = spark.read.csv(paths if isinstance(paths, str) else list(paths), header=True, inferSchema=False)
    return df.withColumns({c: F.col(c).try_cast(kind) for c, kind in (casts or {}).items()})


def by_suffix(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, CSV, JSON or JSON lines, by the path's suffix."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv"):
        return spark.read.csv(path, header=True, sep="\t" if kind == "tsv" else ",")
    if kind in ("jsonl", "ndjson"):
        return spark.read.json(path)
    return records(spark, path) if kind == "json" else spark.read.parquet(path)


def records(spark: SparkSession, path: str, under: Sequence[str] = ("records", "data", "firms", "results")) -> DataFrame:
    """A JSON document: an array of rows, or an object that holds them under one of the names."""
    df = spark.read.json(path, multiLine=True)
    name = next((c for c in under if c in df.columns and df.schema[c].dataType.typeName() == "array"), None)
    return df.select(F.explode(name).alias("r")).select("r.*") if name else df


def zipped_csv(spark: SparkSession, path: str, member: str) -> DataFrame:
    """Rows of one CSV member of zip archives. An archive cannot be split: each is read by one task, line by line."""
    import csv
    import io
    import zipfile

    def lines(batches):
        import pyarrow as pa

        for batch in batches:
            for raw in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(raw.as_py())) as z, z.open(member) as f:
                    held = []
                    for row in csv.DictReader(io.TextIOWrapper(f, "utf-8")):
                        held.append(json.dumps(row))
                        if len(held) == 10_000:
                            yield pa.record_batch([pa.array(held)], names=["row"])
                            held = []
                    if held:
                        yield pa.record_batch([pa.array(held)], names=["row"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, "row string")
    return rows.select(F.from_json("row", "map<string,string>").alias("row"))


def marked_up_rows(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Rows of a typeset table: cells between ampersands, an end mark of two backslashes, escapes and commands removed."""
    text = spark.read.text(path).where(F.col("value").contains("&"))
    plain = F.regexp_replace(F.regexp_replace("value", r"\\\\.*$", ""), r"\\[a-zA-Z]+\{([^}]*)\}", "$1")
    cells = F.transform(F.split(plain, r"\s*(?<!\\)&\s*"), lambda x: F.trim(F.regexp_replace(x, r"\\([&%#_$])", "$1")))
    return text.select(*[F.get(cells, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def settings(spark: SparkSession, path: str) -> dict:
    """One JSON object, as a dictionary of the driver."""
    row = spark.read.json(path, multiLine=True).first()
    return row.asDict(recursive=True) if row else {}


def edges_and_degrees(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """An edge table and its nodes' degrees."""
    e = spark.read.parquet(path).select("src", "dst")
    both = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    return e, both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
