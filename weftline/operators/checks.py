"""Validation checks and their report: rows (name, status), and one verdict over all."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(df: DataFrame, **tests: Column) -> DataFrame:
    """name, status of tests over all rows of df, in one pass. Each test is an aggregate that is true where all is well; null fails."""
    one = df.agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in tests.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.when(F.col(n), "PASS").otherwise("FAIL").alias("status")) for n in tests])).alias("x")).select("x.*")


def empty(df: DataFrame, name: str, level: str = "FAIL") -> DataFrame:
    """PASS where df has no row, else the level."""
    return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.when(F.col("n") == 0, "PASS").otherwise(level).alias("status"))


def report(checks: Sequence[DataFrame]) -> DataFrame:
    """All checks, and the row 'overall': FAIL if any failed. Warnings do not fail it."""
    rows = reduce(DataFrame.unionByName, checks)
    verdict = rows.agg(F.count_if(F.col("status") == "FAIL").alias("n")).select(F.lit("overall").alias("name"), F.when(F.col("n") == 0, "PASS").otherwise("FAIL").alias("status"))
    return rows.unionByName(verdict)


def contiguous(ids: DataFrame, column: str) -> dict[str, Column]:
    """Tests: ids are unique, and run from 0 without a gap."""
    c = F.col(column)
    return {"unique": F.countDistinct(c) == F.count("*"), "contiguous": (F.min(c) == 0) & (F.max(c) == F.countDistinct(c) - 1)}


def monotone_share(views: Sequence[DataFrame], key: str, metrics: Sequence[str]) -> DataFrame:
    """metric, n, share: of the keys that all views have, the share whose metric never falls from view to view."""
    x = None
    for i, v in enumerate(views):
        part = v.select(key, *[F.col(m).alias(f"{m}__{i}") for m in metrics])
        x = part if x is None else x.join(part, key)
    rises = [reduce(lambda a, b: a & b, [F.col(f"{m}__{i}") >= F.col(f"{m}__{i - 1}") for i in range(1, len(views))]) for m in metrics]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), ok.alias("ok")) for m, ok in zip(metrics, rises, strict=True)])
    return x.select(F.explode(rows).alias("r")).groupBy("r.metric").agg(F.count("*").alias("n"), F.avg(F.col("r.ok").cast("double")).alias("share"))
