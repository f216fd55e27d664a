"""Relational operators: layering, merging, keep-latest, roll-ups, lookups, summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .events import first_of_each


def layers(*frames: DataFrame) -> DataFrame:
    """Union of all rows by name; a column that a layer lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def like_first(*frames: DataFrame) -> DataFrame:
    """Union of all rows in the first frame's columns and types."""
    schema = frames[0].schema
    return reduce(DataFrame.unionByName, [f.select(*[F.col(x.name).cast(x.dataType) for x in schema]) for f in frames])


def merge(df: DataFrame, keys: Sequence[str], greatest: Sequence[str] = (), least: Sequence[str] = (), total: Sequence[str] = (), first: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """One row a key: flags and attributes by max, min or sum; ``first``: the first non-null value by ``order``."""
    firsts = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in first]
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in greatest], *[F.min(c).alias(c) for c in least], *[F.sum(c).alias(c) for c in total], *firsts)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each key by a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep).drop("__n")


def latest_until(df: DataFrame, keys: Sequence[str], period: str, until: Column) -> DataFrame:
    """All rows of each key's last period that is not after ``until``; ties stay."""
    w = Window.partitionBy(*keys).orderBy(F.desc(period))
    return df.where(F.col(period) <= until).withColumn("__r", F.rank().over(w)).where("__r = 1").drop("__r")


def rollup_parents(edges: DataFrame, parents: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Both ends replaced by their parents where they have one. parents: child, parent."""
    for end in (src, dst):
        p = parents.select(F.col("child").alias("__c"), F.col("parent").alias("__p"))
        edges = edges.join(p, F.col(end) == F.col("__c"), "left").withColumn(end, F.coalesce("__p", end)).drop("__c", "__p")
    return edges


def either_end_in(edges: DataFrame, keys: DataFrame, key: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges with an end among the keys: two left joins to the distinct keys, one filter."""
    k = keys.select(key).distinct()
    out = edges.join(k.select(F.col(key).alias("__a")), F.col(src) == F.col("__a"), "left").join(k.select(F.col(key).alias("__b")), F.col(dst) == F.col("__b"), "left")
    return out.where(F.col("__a").isNotNull() | F.col("__b").isNotNull()).drop("__a", "__b")


def joined_scores(base: DataFrame, others: dict[str, DataFrame], keys: Sequence[str], value: str, default: float | None = None, how: str = "left") -> DataFrame:
    """A column for each named score table; of a key's repeated rows the largest score counts."""
    for name, df in others.items():
        base = base.join(df.groupBy(*keys).agg(F.max(value).alias(name)), list(keys), how)
    return base if default is None else base.fillna(default, subset=list(others))


def unique_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact lookup; a key with several values is left null and marked for review."""
    found = right.groupBy(*keys).agg(F.countDistinct(value).alias("n_values"), F.min(value).alias(value))
    out = left.join(found, list(keys), "left")
    return out.withColumn("status", F.when(F.col("n_values").isNull(), "none").when(F.col("n_values") == 1, "match").otherwise("review")).withColumn(value, F.when(F.col("n_values") == 1, F.col(value))).drop("n_values")


def overlap_categories(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows by the exact set of flags that are on."""
    label = F.concat_ws("+", *[F.when(F.col(f) == 1, f) for f in flags])
    return df.where(reduce(lambda a, b: a | b, [F.col(f) == 1 for f in flags])).groupBy(label.alias("category")).agg(F.count("*").alias("n"))


def mode(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent non-blank value of each key, ties to the smallest, with its count and share."""
    n = df.where(F.col(value).isNotNull() & (F.trim(F.col(value).cast("string")) != "")).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    ranked = n.withColumn("of", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), value)))
    return ranked.where("r = 1").select(*keys, value, "n", (F.col("n") / F.col("of")).alias("share"))


def concentration(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Herfindahl index and Shannon entropy of each key's value distribution."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return n.withColumn("p", p).groupBy(*keys).agg(F.sum(F.col("p") * F.col("p")).alias("hhi"), (-F.sum(F.col("p") * F.log("p"))).alias("entropy"))


def spread(df: DataFrame, value: str, keys: Sequence[str] = (), quantiles: Sequence[float] = (0.05, 0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Exact quantiles (linear), mean, maximum and the share above zero."""
    q = [F.percentile(value, F.lit(p)).alias(f"p{round(100 * p):02d}") for p in quantiles]
    return df.groupBy(*keys).agg(*q, F.avg(value).alias("mean"), F.max(value).alias("max"), F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("nonzero_share"))


def confidence(df: DataFrame, value: str, keys: Sequence[str], z: float = 1.96) -> DataFrame:
    """n, mean, sample deviation and the normal 95 % interval of each key."""
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = z * F.coalesce("sd", F.lit(0.0)) / F.sqrt("n")
    return out.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)


def hash_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a seeded hash of their keys: the same rows in every run. A sampling operator."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def curve_sample(df: DataFrame, x: str, n: int) -> DataFrame:
    """One row for each x (the least by the other columns), about n of them by hash, the first and the last always, in order of x."""
    one = first_of_each(df, [x])
    ends = one.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    picked = one.join(F.broadcast(ends))  # one row
    inner = picked.where((F.col(x) > F.col("__lo")) & (F.col(x) < F.col("__hi"))).drop("__lo", "__hi").orderBy(F.xxhash64(x), x).limit(max(0, n - 2))
    return inner.unionByName(picked.where((F.col(x) == F.col("__lo")) | (F.col(x) == F.col("__hi"))).drop("__lo", "__hi")).orderBy(x)


def train_codes(df: DataFrame, column: str, train: Column, code: str) -> DataFrame:
    """A code for each category, fitted on training rows in ascending order from 1; unseen and null are 0."""
    fitted = df.where(train & F.col(column).isNotNull()).select(F.col(column).alias("__v")).distinct()
    fitted = fitted.withColumn(code, F.row_number().over(Window.orderBy("__v")))  # a category's few values
    return df.join(fitted, F.col(column) == F.col("__v"), "left").drop("__v").fillna(0, subset=[code])


def train_minmax(df: DataFrame, column: str, train: Column, out: str) -> DataFrame:
    """Scaled by the training rows' range; a range of nothing gives 0."""
    fit = df.where(train).agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    width = F.col("__hi") - F.col("__lo")
    return df.join(F.broadcast(fit)).withColumn(out, F.when(width > 0, (F.col(column) - F.col("__lo")) / width).otherwise(0.0)).drop("__lo", "__hi")  # one row


def zscore(df: DataFrame, column: str, out: str) -> DataFrame:
    """By the population deviation; 0 where that is 0."""
    fit = df.agg(F.avg(column).alias("__m"), F.stddev_pop(column).alias("__s"))
    return df.join(F.broadcast(fit)).withColumn(out, F.when(F.col("__s") > 0, (F.col(column) - F.col("__m")) / F.col("__s")).otherwise(0.0)).drop("__m", "__s")  # one row


def sum_by_all(df: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("n"))


def profile(df: DataFrame, keys: Sequence[str], amount: str, day: str, sets: Sequence[str]) -> DataFrame:
    """Total, count, first and last day, and the sorted distinct members of each set column."""
    members = [F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), "|").alias(c) for c in sets]
    return df.groupBy(*keys).agg(F.sum(amount).alias("total"), F.count("*").alias("n"), F.min(day).alias("first"), F.max(day).alias("last"), *members)


def coverage(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """field, n, filled, distinct: how far each column is filled, and the key's repeats."""
    aggs = [x for c in columns for x in (F.count(c).alias(f"f_{c}"), F.countDistinct(c).alias(f"d_{c}"))]
    one = df.agg(F.count("*").alias("n"), *aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col("n"), F.col(f"f_{c}").alias("filled"), F.col(f"d_{c}").alias("distinct_values")) for c in columns])).alias("x")).select("x.*")
