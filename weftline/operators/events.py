"""Relationship episodes: cleaning, overlap dedup, entity index, temporal splits and snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .order import numbered


def normalise(raw: DataFrame, required: Sequence[str], dates: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Checks the required columns, parses dates (bad: null), makes ids strings."""
    if missing := [c for c in required if c not in raw.columns]:
        raise ValueError(f"missing columns: {missing}")
    return raw.withColumns({c: X.to_date(F.col(c).cast("string")) for c in dates} | {c: F.col(c).cast("string") for c in ids})


def clean(rel: DataFrame, earliest: date, run_date: date, src: str = "src", dst: str = "dst") -> DataFrame:
    """Self-loops, null or early starts and negative durations go; duration_days and is_active are added."""
    end = F.coalesce(F.col("end_date"), F.lit(run_date))
    out = rel.where((F.col(src) != F.col(dst)) & F.col("start_date").isNotNull() & (F.col("start_date") >= F.lit(earliest)))
    out = out.withColumn("duration_days", F.datediff(end, F.col("start_date"))).withColumn("is_active", F.col("end_date").isNull())
    return out.where("duration_days >= 0")


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row for each combination of keys (nulls are equal): the least by ``order``, then by all other columns; nulls come first.

    An aggregate, so copies are dropped before the shuffle.
    """
    rest = [*order, *[c for c in df.columns if c not in keys and c not in order]]
    if not rest:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__row")).select(*keys, "__row.*").select(*df.columns)


def time_columns(df: DataFrame, start: str = "start_date") -> DataFrame:
    """year, month, quarter, ts (epoch days) and the days since the earliest start."""
    first = df.agg(F.min(start).alias("__first"))
    out = df.withColumns({"year": F.year(start), "month": F.month(start), "quarter": F.quarter(start), "ts": F.unix_date(F.col(start))})
    return out.join(F.broadcast(first)).withColumn("timestamp", F.datediff(F.col(start), F.col("__first"))).drop("__first")  # one row


def overlap_dedup(df: DataFrame, keys: Sequence[str], start: str, end: Column, tie: str, share: float = 0.5) -> DataFrame:
    """Greedy by start: an episode stays unless it overlaps one that stayed by more than ``share`` of the shorter (a day at least).

    The fold runs over the sorted episodes of a key within one row; a key's episodes are its
    own history, and only their three fields are gathered.
    """
    episode = F.struct(F.unix_date(F.col(start)).alias("s"), F.unix_date(end).alias("e"), F.col(tie).alias("id"))
    gathered = df.groupBy(*keys).agg(F.sort_array(F.collect_list(episode)).alias("all"))

    def fold(kept: Column, x: Column) -> Column:
        def clashes(k: Column) -> Column:
            shorter = F.greatest(F.lit(1), F.least(k.e - k.s, x.e - x.s))
            return F.least(k.e, x.e) - F.greatest(k.s, x.s) > shorter * share

        return F.when(F.exists(kept, clashes), kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate("all", F.slice("all", 1, 0), fold)
    return gathered.select(*keys, F.explode(kept).alias("__k")).select(*keys, F.col("__k.id").alias(tie), F.date_from_unix_date("__k.s").alias(start), F.col("__k.e").alias("end_day"))


def entity_index(ids: DataFrame, raw: str = "raw_id") -> DataFrame:
    """node_id 0 .. N-1 in ascending order of id; ranges are sorted in parallel."""
    return numbered(ids.select(raw).distinct(), [raw], "node_id")


def map_both(edges: DataFrame, index: DataFrame, raw: str = "raw_id", src: str = "src", dst: str = "dst") -> DataFrame:
    """src_id and dst_id by two lookups; an id that is missing stays null (count them with ``unmapped``)."""
    a = index.select(F.col(raw).alias(src), F.col("node_id").alias("src_id"))
    b = index.select(F.col(raw).alias(dst), F.col("node_id").alias("dst_id"))
    return edges.join(a, src, "left").join(b, dst, "left")


def unmapped(mapped: DataFrame) -> DataFrame:
    return mapped.agg(F.count_if(F.col("src_id").isNull() | F.col("dst_id").isNull()).alias("unmapped"))


def split_column(day: str | Column, train_end: date, val: tuple[date, date], test: tuple[date, date]) -> Column:
    """train, val, test by closed ranges of days, gap for what lies between."""
    d = X.col(day)
    return F.when(d <= F.lit(train_end), "train").when(d.between(F.lit(val[0]), F.lit(val[1])), "val").when(d.between(F.lit(test[0]), F.lit(test[1])), "test").otherwise("gap")


def snapshots(edges: DataFrame, day: str, step: int, least: int = 10) -> DataFrame:
    """window: tumbling windows of ``step`` days from the first day; windows of fewer than ``least`` edges go."""
    first = F.broadcast(edges.agg(F.min(day).alias("__first")))
    windowed = edges.join(first).withColumn("window", F.floor(F.datediff(F.col(day), F.col("__first")) / step)).drop("__first")
    enough = windowed.groupBy("window").count().where(F.col("count") >= least).select("window")
    return windowed.join(enough, "window")


def new_edges(windowed: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """The window in which each edge is first seen."""
    return windowed.groupBy(src, dst).agg(F.min("window").alias("first_window"))
