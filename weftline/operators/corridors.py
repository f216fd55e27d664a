"""Corridor scores between sources and targets, their bottlenecks, and the redundancy of targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored
from . import graph as G


def corridor_scores(nodes: DataFrame, edges: DataFrame, sources: DataFrame, targets: DataFrame, cap: int | None = None) -> DataFrame:
    """node, source_reach, target_reach, score (their product), is_corridor, is_intermediary, from_source, to_target (hops, -1: none).

    Reach has no limit; with a cap, hops beyond it count as none.
    """
    e = stored(edges.select("src", "dst"))
    down, up = stored(G.reach_pairs(e, sources)), stored(G.reach_pairs(G.flipped(e), targets))
    a = down.groupBy("node").agg(F.count("*").alias("source_reach"), F.min("dist").alias("from_source"))
    b = up.groupBy("node").agg(F.count("*").alias("target_reach"), F.min("dist").alias("to_target"))
    if cap is not None:
        a = a.withColumn("from_source", F.when(F.col("from_source") <= cap, F.col("from_source")))
        b = b.withColumn("to_target", F.when(F.col("to_target") <= cap, F.col("to_target")))
    ends = sources.select("node").union(targets.select("node")).distinct().withColumn("__end", F.lit(True))
    x = nodes.select("node").join(a, "node", "left").join(b, "node", "left").join(ends, "node", "left")
    x = x.fillna(0, subset=["source_reach", "target_reach"]).fillna(-1, subset=["from_source", "to_target"])
    on = (F.col("source_reach") > 0) & (F.col("target_reach") > 0)
    x = x.withColumn("score", F.col("source_reach") * F.col("target_reach")).withColumn("is_corridor", on)
    return x.withColumn("is_intermediary", on & F.col("__end").isNull()).drop("__end")


def bottlenecks(edges: DataFrame, corridor: DataFrame, strong: DataFrame) -> DataFrame:
    """node, component_size, gate, lanes_in, lanes_out, bottleneck of every node.

    bottleneck = score / component size * (1 + ln(1 + gate)) / max(lanes_in * lanes_out, 1) / (1 + hops from source and to
    target), 0 off the corridor; hops of -1 enter as they are, and a divisor of 0 gives infinity. gate: the component's edges in times out; lanes: edges on shortest ways from a source
    into the node, and from the node on to a target.
    """
    sizes = strong.groupBy("component").agg(F.count("*").alias("component_size"))
    gates = G.boundary(edges, strong).select("component", "gate")
    reached = corridor.where("from_source >= 0").select("node", F.col("from_source").alias("dist"))
    ahead = corridor.where("to_target >= 0").select("node", F.col("to_target").alias("dist"))
    lanes_in = G.lanes(edges, reached, F.lit(1)).select("node", "lanes_in")
    lanes_out = G.lanes(G.flipped(edges), ahead, F.lit(1)).select("node", F.col("lanes_in").alias("lanes_out"))
    x = corridor.join(strong, "node").join(sizes, "component").join(gates, "component", "left").join(lanes_in, "node", "left").join(lanes_out, "node", "left")
    x = x.fillna(0, subset=["gate", "lanes_in", "lanes_out"])
    value = F.col("score") / F.col("component_size") * (1 + F.log1p(F.col("gate").cast("double"))) / F.greatest(F.col("lanes_in") * F.col("lanes_out"), F.lit(1))
    hops = 1 + F.col("from_source") + F.col("to_target")
    value = F.when(hops == 0, F.lit(float("inf"))).otherwise(value / F.nullif(hops, F.lit(0)))
    return x.select("node", "component_size", "gate", "lanes_in", "lanes_out", F.when(F.col("is_corridor"), value).otherwise(0.0).alias("bottleneck"))


def redundancy(edges: DataFrame, targets: DataFrame, corridor: DataFrame, strong: DataFrame) -> DataFrame:
    """node, support, branches, components, geodesics, redundancy (their least), is_single_point of every target.

    An entry is an edge from a corridor node into the target; it is a geodesic entry where it ends a shortest way.
    """
    entry = corridor.where("is_corridor").join(strong, "node").select(F.col("node").alias("src"), "component", F.col("from_source").alias("d"))
    own = targets.select("node").join(corridor.select("node", F.col("source_reach").alias("support"), "from_source"), "node")
    into = own.join(edges.select("src", "dst"), F.col("node") == F.col("dst"), "left").join(entry, "src", "left")
    geodesic = F.col("component").isNotNull() & (F.col("from_source") >= 0) & (F.col("d") >= 0) & (F.col("d") + 1 == F.col("from_source"))
    x = into.groupBy("node", "support").agg(F.count("component").alias("branches"), F.countDistinct("component").alias("components"), F.count_if(geodesic).alias("geodesics"))
    x = x.withColumn("redundancy", F.least("support", "branches", "components", "geodesics"))
    return x.withColumn("is_single_point", (F.col("support") > 0) & (F.col("redundancy") <= 1))
