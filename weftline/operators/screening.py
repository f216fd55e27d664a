"""Candidate pools by rank-normalised signals, two-stage screening, cohorts, strata, additive curves, guardrails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import decisions as D
from .order import competition


def rank_falling(df: DataFrame, column: str, out: str) -> DataFrame:
    """Competition ranks (least of ties) by falling value."""
    return competition(df, F.desc(column), column, out)


def signal_pool(nodes: DataFrame, signals: Sequence[str], top_each: int, size: int, key: str = "node") -> DataFrame:
    """The nodes that lead a signal, refilled to ``size`` by the sum of normalised ranks; cut to it where they are more.

    Columns: key, the signals, selected, score, candidate_rank. A signal's norm is 1 for its first, 0 for its last rank.
    """
    last = max(nodes.count() - 1, 1)
    out = nodes.select(key, *signals)
    for s in signals:
        out = rank_falling(out, s, f"__r_{s}")
    leads = None
    for s in signals:
        top = nodes.select(key, s).orderBy(F.desc(s), key).limit(top_each).select(key)
        leads = top if leads is None else leads.unionByName(top)
    leads = F.broadcast(leads.distinct().withColumn("selected", F.lit(True)))  # top_each rows a signal at most
    score = F.round(sum((1 - (F.col(f"__r_{s}") - 1) / last for s in signals), F.lit(0.0)), 9)
    out = out.withColumn("score", score).join(leads, key, "left").fillna(False, subset=["selected"])
    pool = out.orderBy(F.desc("selected"), F.desc("score"), key).limit(size)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), key))  # size rows
    return pool.withColumn("candidate_rank", rank.cast("long")).select(key, *signals, "selected", "score", "candidate_rank")


def single_removals(pool: DataFrame) -> DataFrame:
    """A scenario for each node of the pool."""
    return pool.select(F.col("node").cast("string").alias("scenario"), "node")


def two_stage(edges: DataFrame, pool: DataFrame, sources: DataFrame, targets: DataFrame, deep: int, cap: int = 6) -> DataFrame:
    """Each node of the pool is removed alone; the ``deep`` of most weight lost get all metrics and a rank."""
    one = single_removals(pool)
    first = D.impact(edges, one, sources, targets, cap).select("scenario", F.round("weight_lost", 9).alias("lost"))
    top = first.orderBy(F.desc("lost"), F.col("scenario").cast("long")).limit(deep).select("scenario")
    full = D.impact(edges, one.join(F.broadcast(top), "scenario", "left_semi"), sources, targets, cap)
    rank = F.row_number().over(Window.orderBy(F.desc(F.round("weight_lost", 9)), F.col("scenario").cast("long")))  # ``deep`` rows
    return full.withColumn("rank", rank.cast("long"))


def prefixes(ranked: DataFrame, steps: int, value: str = "value") -> DataFrame:
    """scenario (a step's number), node: the first nodes by value, one more at each step. For a cohort, filter before."""
    top = ranked.orderBy(F.desc(value), "node").limit(steps)
    top = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc(value), "node")))  # ``steps`` rows
    return top.select(F.explode(F.expr(f"sequence(r, {steps})")).alias("step"), "node").select(F.col("step").cast("string").alias("scenario"), "node")


def stratum(near: Column, corridor: Column, upstream: Column) -> Column:
    """A node's stratum: next to a target, on a corridor, upstream of a source, or other."""
    return F.when(near, "near_target").when(corridor, "corridor").when(upstream, "upstream").otherwise("other")


def composition(df: DataFrame, score: str, groups: Sequence[str], tops: Sequence[int], key: str = "node") -> DataFrame:
    """scope, group_type, group_value, n, share: what the top rows by score are made of."""
    w = Window.orderBy(F.desc(score), key)
    top = df.orderBy(F.desc(score), key).limit(max(tops)).withColumn("r", F.row_number().over(w))  # a top list
    scopes = F.array_compact(F.array(*[F.when(F.col("r") <= n, F.lit(n)) for n in tops]))
    kinds = F.array(*[F.struct(F.lit(g).alias("group_type"), F.col(g).cast("string").alias("group_value")) for g in groups])
    x = top.select(F.explode(scopes).alias("top"), kinds.alias("k")).select("top", F.explode("k").alias("g"))
    n = x.groupBy("top", "g.group_type", "g.group_value").agg(F.count("*").alias("n"))
    return n.select(F.concat(F.lit("top_"), F.col("top").cast("string")).alias("scope"), "group_type", "group_value", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("top", "group_type"))).alias("share"))


def additive_curve(df: DataFrame, group: str, score: str, ks: Sequence[int], key: str = "node") -> DataFrame:
    """group, k, total, capped: the sum of the k largest scores of each group (all, where it has fewer), and the same up to 1."""
    w = Window.partitionBy(group).orderBy(F.desc(score), key)
    x = df.where(F.col(group).isNotNull()).withColumn("r", F.row_number().over(w)).where(F.col("r") <= max(ks))
    points = F.array_compact(F.array(*[F.when(F.col("r") <= k, F.lit(k)) for k in ks]))
    out = x.select(group, F.coalesce(score, F.lit(0.0)).alias("v"), F.explode(points).alias("asked")).groupBy(group, "asked").agg(F.count("*").alias("k"), F.sum("v").alias("total"))
    return out.select(group, F.col("asked").cast("long").alias("asked"), "k", "total", F.least("total", F.lit(1.0)).alias("capped"))


def guardrails(pool: DataFrame, score: str, deep: int, draws: int, key: str = "node") -> DataFrame:
    """draw, best, p95 of ``draws`` random picks of ``deep`` nodes, and the same of the pool's best by score (draw 0). Picks are by MD5 of key and draw."""
    dealt = pool.select(key, score, F.explode(F.sequence(F.lit(0), F.lit(draws))).alias("draw"))
    random = F.md5(F.concat(F.col(key).cast("string"), F.lit(":"), F.col("draw").cast("string")))
    w = Window.partitionBy("draw").orderBy(F.when(F.col("draw") == 0, -F.col(score)), random, key)
    first = Window.partitionBy("draw").orderBy(F.desc(score), key)
    r = F.when(F.col("draw") == 0, F.row_number().over(first)).otherwise(F.row_number().over(w))
    x = dealt.withColumn("r", r).where(F.col("r") <= deep)
    return x.groupBy("draw").agg(F.max(score).alias("best"), F.percentile(score, F.lit(0.95)).alias("p95"))


def pool_stability(pool: DataFrame, score: str, sizes: Sequence[int], top: int, key: str = "node", rank: str = "candidate_rank") -> DataFrame:
    """size, overlap, jaccard: the top nodes by score within each pool size, against those of the largest."""
    dealt = pool.select(key, score, F.explode(F.array_compact(F.array(*[F.when(F.col(rank) <= n, F.lit(n)) for n in sizes]))).alias("size"))
    best = dealt.withColumn("r", F.row_number().over(Window.partitionBy("size").orderBy(F.desc(score), key))).where(F.col("r") <= top)
    most = best.where(F.col("size") == max(sizes)).select(key).withColumn("__ref", F.lit(1))
    n = most.count()
    x = best.join(F.broadcast(most), key, "left").groupBy("size").agg(F.count("*").alias("n"), F.count("__ref").alias("overlap"))
    return x.select(F.col("size").cast("long").alias("size"), "overlap", (F.col("overlap") / (F.col("n") + n - F.col("overlap"))).alias("jaccard"))
