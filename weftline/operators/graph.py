"""Graph operators as loops of joins and aggregates over an edge table (src, dst). Each round's result is stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored
from .order import numbered
from .sweeps import dependencies, hop_sums


def simple_edges(edges: DataFrame, view: Column | None = None, flags: Sequence[str] = ()) -> DataFrame:
    """The edges of a view: no self-loops, one row a pair, flags by maximum."""
    out = edges.where("src <> dst")
    out = out if view is None else out.where(view)
    return out.groupBy("src", "dst").agg(*[F.max(f).alias(f) for f in flags]) if flags else out.select("src", "dst").distinct()


def flipped(edges: DataFrame) -> DataFrame:
    other = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *other)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes."""
    n = nodes.select("node").distinct()
    return edges.join(n, edges.src == n.node, "left_semi").join(n, F.col("dst") == F.col("node"), "left_semi")


# --- traversal ----------------------------------------------------------------------------------------------


def distances(edges: DataFrame, sources: DataFrame, cap: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """node, dist (and the keys): hops from the nearest source of each key. sources: node and the keys."""
    keys = list(keys)
    edges = stored(edges.select("src", "dst"))  # each round reads them again
    front = stored(sources.select(*keys, "node").distinct().withColumn("dist", F.lit(0)))
    seen, step = front, 0
    while (cap is None or step < cap) and not front.isEmpty():
        step += 1
        reached = front.join(edges, F.col("node") == F.col("src")).select(*keys, F.col("dst").alias("node")).distinct()
        front = stored(reached.join(seen.select(*keys, "node"), [*keys, "node"], "left_anti").withColumn("dist", F.lit(step)))
        seen = stored(seen.unionByName(front)) if step % 8 == 0 else seen.unionByName(front)
    return seen


def all_distances(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Every node, -1 where it is not reached."""
    return nodes.select("node").join(found, "node", "left").fillna(-1, subset=["dist"])


def tiers(edges: DataFrame, seeds: DataFrame, depth: int | None) -> DataFrame:
    """node, tier: seeds are tier 1, a supplier (src) of a tier is of the next."""
    return distances(flipped(edges), seeds, None if depth is None else depth - 1).select("node", (F.col("dist") + 1).alias("tier"))


def expand_until(edges: DataFrame, seeds: DataFrame, least: int) -> DataFrame:
    """Undirected tiers, until a tier brings fewer than ``least`` nodes."""
    both, step = undirected(edges), 1
    front = stored(seeds.select("node").distinct().withColumn("tier", F.lit(1)))
    seen = front
    while True:
        step += 1
        reached = front.join(both, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = stored(reached.join(seen, "node", "left_anti").withColumn("tier", F.lit(step)))
        n = front.count()
        if n:
            seen = stored(seen.unionByName(front))
        if n < max(least, 1):
            return seen


def two_hop(edges: DataFrame, k: int | None = None) -> DataFrame:
    """src, dst at exactly two undirected hops; with k, the k smallest dst of each src.

    With k, a node offers each neighbour no more than its first k + 1 + (the neighbour's degree) neighbours: of these,
    all but k may be the neighbour itself or next to it. So a hub does not pair all its neighbours, and nothing is lost.
    """
    both = stored(undirected(edges))
    near, offers = both, both.withColumn("place", F.lit(0))
    on = F.col("a.dst") == F.col("b.src")
    if k is not None:
        near = both.join(both.groupBy("src").agg(F.count("*").alias("degree")), "src")
        offers = both.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("dst")))
        on = on & (F.col("b.place") <= F.col("a.degree") + k + 1)
    far = near.alias("a").join(offers.alias("b"), on).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst")).where("src <> dst").distinct()
    far = far.join(both, ["src", "dst"], "left_anti")
    if k is None:
        return far
    return far.withColumn("__n", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("__n") <= k).drop("__n")


def two_hop_flags(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The pairs with is_two_hop: dst ends an undirected walk of two steps from src (it may be src itself, or one step away too)."""
    both = stored(undirected(edges))
    left = pairs.select("src", "dst").distinct().join(both.select("src", F.col("dst").alias("mid")), "src")
    walks = left.join(both.select(F.col("src").alias("mid"), F.col("dst")), ["mid", "dst"], "left_semi").select("src", "dst").distinct()
    return pairs.join(walks.withColumn("__w", F.lit(True)), ["src", "dst"], "left").withColumn("is_two_hop", F.col("__w").isNotNull()).drop("__w")


def shortest(edges: DataFrame, sources: DataFrame, cost: str = "cost", cap: float | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """node, dist: the least cost from any source of each key. Bellman-Ford: only improved nodes go on."""
    keys = list(keys)
    edges = stored(edges.select("src", "dst", cost))
    best = stored(sources.select(*keys, "node").distinct().withColumn("dist", F.lit(0.0)))
    front = best
    while not front.isEmpty():
        offered = front.join(edges.select("src", "dst", cost), F.col("node") == F.col("src")).groupBy(*keys, F.col("dst").alias("node")).agg(F.min(F.col("dist") + F.col(cost)).alias("new"))
        offered = offered if cap is None else offered.where(F.col("new") <= cap)
        both = stored(best.join(offered, [*keys, "node"], "full").withColumn("better", F.col("new").isNotNull() & (F.col("dist").isNull() | (F.col("new") < F.col("dist")))))
        best = both.select(*keys, "node", F.least("dist", "new").alias("dist"))
        front = both.where("better").select(*keys, "node", F.col("new").alias("dist"))
    return best


def reach_pairs(edges: DataFrame, anchors: DataFrame, cap: int | None = None) -> DataFrame:
    """anchor, node, dist of every node that each anchor reaches (itself at 0)."""
    return distances(edges, anchors.select(F.col("node").alias("anchor"), "node"), cap, ["anchor"])


def support(pairs: DataFrame, caps: Sequence[int]) -> DataFrame:
    """For every node the number of anchors within each cap."""
    return pairs.groupBy("node").agg(*[F.count_if(F.col("dist") <= c).alias(f"within_{c}") for c in caps])


def reach_counts(nodes: DataFrame, edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """node, n, n_others: how many anchors each node reaches along the edges, itself included or not.

    Strong components are condensed; 62 anchors travel as the bits of one number, so there is a row for each
    component and number, not one for each node and anchor. Only new bits go on.
    """
    label = stored(strong_components(nodes, edges))
    a, b = label.withColumnsRenamed({"node": "src", "component": "ca"}), label.withColumnsRenamed({"node": "dst", "component": "cb"})
    steps = stored(edges.select("src", "dst").join(a, "src").join(b, "dst").where("ca <> cb").select(F.col("cb").alias("component"), F.col("ca").alias("to")).distinct())
    place = numbered(anchors.select("node").distinct(), ["node"], "place").withColumn("word", F.floor(F.col("place") / 62))
    bit = F.expr("shiftleft(1L, CAST(place % 62 AS INT))")
    seen = stored(place.join(label, "node").groupBy("component", "word").agg(F.bit_or(bit).alias("bits")))
    front = seen
    while not front.isEmpty():
        offered = front.join(steps, "component").groupBy(F.col("to").alias("component"), "word").agg(F.bit_or("bits").alias("more"))
        both = seen.join(offered, ["component", "word"], "full").fillna(0, subset=["bits", "more"])
        both = stored(both.withColumn("new", F.col("more").bitwiseAND(F.bitwise_not("bits"))))
        seen = both.select("component", "word", F.col("bits").bitwiseOR(F.col("more")).alias("bits"))
        front = both.where("new <> 0").select("component", "word", F.col("new").alias("bits"))
    counts = seen.groupBy("component").agg(F.sum(F.bit_count("bits")).alias("n"))
    own = anchors.select("node").distinct().withColumn("own", F.lit(1))
    x = label.join(counts, "component").join(own, "node", "left")
    return x.select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n_others"))


def support_summary(found: DataFrame, targets: DataFrame, caps: Sequence[float], kind: str) -> DataFrame:
    """kind, cap, and over all targets: how many are supported within the cap (by two or more sources), their share and
    share of weight, and mean, median and 90 % quantile of the number of sources. found: anchor, node, dist; targets: node, weight."""
    counts = found.groupBy("node").agg(*[F.count_if(F.col("dist") <= c).alias(f"c{i}") for i, c in enumerate(caps)])
    each = F.array(*[F.struct(F.lit(float(c)).alias("cap"), F.coalesce(f"c{i}", F.lit(0)).alias("n")) for i, c in enumerate(caps)])
    x = targets.select("node", "weight").join(counts, "node", "left").select("weight", F.explode(each).alias("x")).select("weight", "x.*")
    some = F.col("n") > 0
    return x.groupBy(F.lit(kind).alias("kind"), "cap").agg(
        F.count_if(some).alias("n_supported"),
        F.count_if(F.col("n") >= 2).alias("n_by_two"),
        F.avg(some.cast("double")).alias("share"),
        F.avg("n").alias("mean"),
        F.percentile("n", F.lit(0.5)).alias("median"),
        F.percentile("n", F.lit(0.9)).alias("p90"),
        (F.sum(F.when(some, F.col("weight")).otherwise(0.0)) / F.greatest(F.sum("weight"), F.lit(1e-12))).alias("weight_share"),
    )


def simple_paths(edges: DataFrame, start: DataFrame, end: DataFrame, longest: int, k: int) -> DataFrame:
    """The k shortest simple paths of at most ``longest`` edges from start to end nodes (ties by the path itself)."""
    e = stored(edges.select("src", "dst"))
    paths = start.select(F.array("node").alias("path"), F.col("node").alias("at"))
    goal = end.select(F.col("node").alias("goal"))
    found = paths.join(goal, F.col("at") == F.col("goal"), "left_semi").select("path")
    for _ in range(longest):
        paths = stored(paths.join(e, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at")))
        found = found.unionByName(paths.join(goal, F.col("at") == F.col("goal"), "left_semi").select("path"))
    return found.withColumn("hops", F.size("path") - 1).orderBy("hops", "path").limit(k)


def certificate(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """Nodes at a positive distance without a predecessor one hop nearer: none, if the distances are right."""
    near = dist.select(F.col("node").alias("src"), F.col("dist").alias("d"))
    ok = edges.join(near, "src").join(dist.where("dist > 0"), F.col("dst") == F.col("node")).where("d = dist - 1").select("node").distinct()
    return dist.where("dist > 0").join(ok, "node", "left_anti")


# --- components ---------------------------------------------------------------------------------------------


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (its smallest node): least labels travel, and labels jump to their labels' labels."""
    both = stored(undirected(edges))
    label = stored(nodes.select("node", F.col("node").alias("component")))
    while True:
        offered = both.join(label, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("other"))
        new = label.join(offered, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "other").alias("c"))
        jump = label.select(F.col("node").alias("c"), F.col("component").alias("further"))
        new = stored(new.join(jump, "c", "left").select("node", "old", F.least("c", "further").alias("component")))
        if new.where("old <> component").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (its smallest node). Nodes without a way in or out are trimmed; then colours spread
    forward (least label) and, within a colour, backward from its root."""
    left = stored(nodes.select("node").distinct())
    e = stored(edges.select("src", "dst"))
    done = None
    while not left.isEmpty():
        while True:  # trim
            core = left.join(e.select(F.col("src").alias("node")).distinct(), "node", "left_semi").join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
            core = stored(core)
            loose = stored(left.join(core, "node", "left_anti").select("node", F.col("node").alias("component")))
            if loose.isEmpty():
                break
            done = loose if done is None else done.unionByName(loose)
            left, e = core, stored(within(e, core))
        if left.isEmpty():
            break
        colour = stored(left.select("node", F.col("node").alias("colour")))
        while True:
            offered = e.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("other"))
            new = stored(colour.join(offered, "node", "left").select("node", F.col("colour").alias("old"), F.least("colour", "other").alias("colour")))
            colour = new.select("node", "colour")
            if new.where("old <> colour").isEmpty():
                break
        same = e.join(colour.withColumnsRenamed({"node": "src", "colour": "a"}), "src").join(colour.withColumnsRenamed({"node": "dst", "colour": "b"}), "dst").where("a = b").select("src", "dst")
        found = distances(flipped(stored(same)), colour.where("node = colour").select("colour", "node"), keys=["colour"])
        found = stored(found.select("node", F.col("colour").alias("component")))
        done = found if done is None else done.unionByName(found)
        left = stored(left.join(found, "node", "left_anti"))
        e = stored(within(e, left))
    return done if done is not None else nodes.select("node", F.col("node").alias("component"))


def core_numbers(edges: DataFrame) -> DataFrame:
    """node, core: each node's value falls to the h-index of its neighbours' values, until nothing changes."""
    both = stored(undirected(edges))
    value = stored(both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("core")))
    w = Window.partitionBy("src").orderBy(F.desc("core"))  # one row for each value among the neighbours
    while True:
        held = both.join(value, F.col("dst") == F.col("node")).groupBy("src", "core").agg(F.count("*").alias("n")).withColumn("r", F.sum("n").over(w))
        h = held.groupBy(F.col("src").alias("node")).agg(F.max(F.least("r", "core")).cast("long").alias("h"))
        new = stored(value.join(h, "node").select("node", F.col("core").alias("old"), F.least("core", "h").alias("core")))
        value = new.select("node", "core")
        if new.where("old <> core").isEmpty():
            return value


def collapsed(edges: DataFrame, same_as: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Identity collapse: members (node, entity), and the edges between entities, self-loops gone. same_as: src, dst."""
    members = weak_components(nodes_of(edges.select("src", "dst").unionByName(same_as.select("src", "dst"))), same_as).withColumnRenamed("component", "entity")
    members = stored(members)
    kept = edges.join(same_as.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    flags = [c for c in edges.columns if c not in ("src", "dst")]
    out = kept.join(members.withColumnsRenamed({"node": "src", "entity": "a"}), "src").join(members.withColumnsRenamed({"node": "dst", "entity": "b"}), "dst").where("a <> b")
    return members, out.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("n"), *[F.max(f).alias(f) for f in flags])


# --- centrality ---------------------------------------------------------------------------------------------


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    in_ = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    x = nodes.select("node").join(out, "node", "left").join(in_, "node", "left").fillna(0)
    return x.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, weight: str | None = None) -> DataFrame:
    """node, rank: dangling mass is spread evenly; stops when the total change is under the tolerance; sums to one."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    e = edges.select("src", "dst", w.alias("w"))
    share = stored(e.join(e.groupBy("src").agg(F.sum("w").alias("t")), "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p")))
    n = nodes.count()
    rank = stored(nodes.select("node", F.lit(1.0 / max(n, 1)).alias("rank")))
    ends = share.select(F.col("src").alias("node")).distinct().withColumn("__e", F.lit(True))
    rank = stored(rank.join(ends, "node", "left").select("node", "rank", F.col("__e").isNull().alias("dangles")))
    dangling = rank.agg(F.sum(F.when(F.col("dangles"), F.col("rank")))).first()[0] or 0.0
    for _ in range(rounds):
        flow = share.join(rank, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("rank") * F.col("p")).alias("flow"))
        new = rank.join(flow, F.col("node") == F.col("to"), "left").select("node", "dangles", F.col("rank").alias("old"), (alpha * (F.coalesce("flow", F.lit(0.0)) + dangling / n) + (1 - alpha) / n).alias("rank"))
        new = stored(new)
        change, dangling = (x or 0.0 for x in new.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), F.sum(F.when(F.col("dangles"), F.col("rank")))).first())
        rank = new.select("node", "rank", "dangles")
        if change < tolerance:
            break
    rank = rank.select("node", "rank")
    total = rank.agg(F.sum("rank")).first()[0] or 1.0
    return rank.select("node", (F.col("rank") / total).alias("rank"))


def _spread(values: DataFrame, edges: DataFrame, by: str, to: str) -> DataFrame:
    return edges.join(values, F.col(by) == F.col("node")).groupBy(F.col(to).alias("to")).agg(F.sum("v").alias("s"))


def _unit(df: DataFrame) -> DataFrame:
    """Stored, and brought to length one."""
    df = stored(df)
    norm = (df.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0) ** 0.5
    return df.withColumn("v", F.col("v") / norm) if norm else df


def _far(new: DataFrame, old: DataFrame | None) -> float:
    """The total change of v."""
    if old is None:
        return float("inf")
    return new.join(old.withColumnRenamed("v", "u"), "node").agg(F.sum(F.abs(F.col("v") - F.col("u")))).first()[0] or 0.0


def hits(nodes: DataFrame, edges: DataFrame, rounds: int = 100, tolerance: float = 1e-6, stride: int = 4) -> DataFrame:
    """node, authority, hub, each of length one; until ``stride`` rounds change the authorities by less than the tolerance.

    Scores are brought to length one after every stride: a length does not change a direction.
    """
    nodes, edges = stored(nodes.select("node")), stored(edges.select("src", "dst"))
    spread = lambda v, by, to: nodes.join(_spread(v, edges, by, to), F.col("node") == F.col("to"), "left").select("node", F.coalesce("s", F.lit(0.0)).alias("v"))
    hub, before = nodes.withColumn("v", F.lit(1.0)), None
    for done in range(0, rounds, stride):
        for _ in range(min(stride, rounds - done)):
            authority = spread(hub, "src", "dst")
            hub = spread(authority, "dst", "src")
        hub = _unit(hub)
        authority = _unit(spread(hub, "src", "dst"))
        if _far(authority, before) < tolerance:
            break
        before = authority
    return authority.withColumnRenamed("v", "authority").join(hub.withColumnRenamed("v", "hub"), "node")


def eigenvector(nodes: DataFrame, edges: DataFrame, rounds: int = 200, tolerance: float = 1e-10, stride: int = 8) -> DataFrame:
    """node, v: power iteration on the symmetrised edges, in strides as ``hits``, until two strides in a row agree.

    A bipartite part makes the plain iteration swing between two vectors; each round adds the vector itself, which
    leaves the limit where it is and ends the swing.
    """
    both = stored(edges.select("src", "dst").union(edges.select("dst", "src")))
    x, before = stored(nodes.select("node", F.lit(1.0).alias("v"))), None
    for done in range(0, rounds, stride):
        for _ in range(min(stride, rounds - done)):
            x = x.join(_spread(x.withColumnRenamed("node", "n2").select(F.col("n2").alias("node"), "v"), both, "src", "dst"), F.col("node") == F.col("to"), "left").select("node", (F.col("v") + F.coalesce("s", F.lit(0.0))).alias("v"))
        x = _unit(x)
        if _far(x, before) < tolerance:
            break
        before = x
    return x


def betweenness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """node, score: Brandes over the given sources, for every node that a source other than itself reaches."""
    return dependencies(edges, sources)


def triangles(edges: DataFrame) -> DataFrame:
    """node, triangles, clustering of the undirected graph: each edge goes from lower to higher degree, so hubs do not explode."""
    both = stored(undirected(edges))
    deg = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
    e = both.join(deg.withColumnsRenamed({"node": "src", "d": "da"}), "src").join(deg.withColumnsRenamed({"node": "dst", "d": "db"}), "dst")
    e = stored(e.where((F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("src") < F.col("dst")))).select("src", "dst"))
    wedge = e.alias("a").join(e.alias("b"), F.col("a.src") == F.col("b.src")).where("a.dst < b.dst").select(F.col("a.src").alias("x"), F.col("a.dst").alias("y"), F.col("b.dst").alias("z"))
    closed = wedge.join(both, (F.col("y") == F.col("src")) & (F.col("z") == F.col("dst")), "left_semi")
    per = closed.select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    return deg.join(per, "node", "left").fillna(0, subset=["triangles"]).select("node", "triangles", F.when(F.col("d") > 1, 2.0 * F.col("triangles") / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("clustering"))


def normalised_adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, w of D^-1/2 (A + I) D^-1/2, A symmetrised."""
    a = undirected(edges).union(nodes.select("node", "node"))
    d = a.groupBy("src").agg(F.count("*").alias("d"))
    return a.join(d, "src").join(d.withColumnsRenamed({"src": "dst", "d": "e"}), "dst").select("src", "dst", (1 / F.sqrt(F.col("d") * F.col("e"))).alias("w"))


def closeness(nodes: DataFrame, edges: DataFrame, sample: DataFrame, cap: int | None = None) -> DataFrame:
    """node, closeness, in_centrality, out_centrality of the sampled nodes. Closeness: by the distances of those that reach
    the node (within ``cap`` hops), scaled by their share of all nodes."""
    n = nodes.count()
    x = hop_sums(flipped(edges.select("src", "dst")), sample, cap)
    x = x.select("node", F.when((F.col("total") > 0) & F.lit(n > 1), F.col("reached") / F.col("total") * F.col("reached") / max(n - 1, 1)).otherwise(0.0).alias("closeness"))
    share = [(F.col(f"{s}_degree") / max(n - 1, 1)).alias(f"{s}_centrality") for s in ("in", "out")]
    return x.join(degrees(nodes, edges).select("node", *share), "node")


def criticality(nodes: DataFrame, edges: DataFrame, sample: DataFrame) -> DataFrame:
    """node and score of the sampled nodes: .4 betweenness + .3 closeness + .15 in- and .15 out-degree centrality.

    Betweenness is that of shortest paths from the sampled nodes, scaled to all sources and to (n - 1)(n - 2) pairs.
    """
    n, k = nodes.count(), max(sample.select("node").distinct().count(), 1)
    scale = n / k / max((n - 1) * (n - 2), 1)
    between = betweenness(edges, sample).select("node", (F.col("score") * scale).alias("between"))
    x = closeness(nodes, edges, sample).join(between, "node", "left").fillna(0.0, subset=["between"])
    score = 0.4 * F.col("between") + 0.3 * F.col("closeness") + 0.15 * F.col("in_centrality") + 0.15 * F.col("out_centrality")
    return x.select("node", F.col("between").alias("betweenness"), "closeness", "in_centrality", "out_centrality", score.alias("criticality"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, directed density, components and the largest one's share (weak, strong), core numbers (nodes
    without edges: 0), degree means, quantiles and maxima."""
    nodes, edges = stored(nodes.select("node")), stored(edges.select("src", "dst"))
    n, m = nodes.count(), edges.count()
    sized = lambda label, name: label.groupBy("component").agg(F.count("*").alias("c")).agg(F.count("*").alias(f"n_{name}"), (F.max("c") / max(n, 1)).alias(f"{name}_share"))
    core = nodes.join(core_numbers(edges), "node", "left").fillna(0, subset=["core"])
    spread = lambda c: [F.avg(c).alias(f"{c}_mean"), F.percentile(c, F.lit(0.5)).alias(f"{c}_median"), F.percentile(c, F.lit(0.9)).alias(f"{c}_p90"), F.max(c).alias(f"{c}_max")]
    parts = [sized(weak_components(nodes, edges), "weak"), sized(strong_components(nodes, edges), "strong"), core.agg(*spread("core")), degrees(nodes, edges).agg(*spread("in_degree"), *spread("out_degree"))]
    out = nodes.sparkSession.range(1).select(F.lit(n).cast("long").alias("nodes"), F.lit(m).cast("long").alias("edges"), F.lit(m / max(n * (n - 1), 1)).alias("density"))
    for p in parts:
        out = out.join(F.broadcast(p))  # one row each
    return out


# --- corridors ----------------------------------------------------------------------------------------------


def boundary(edges: DataFrame, label: DataFrame) -> DataFrame:
    """component, edges in, edges out, gate (their product) of every component with an edge across."""
    a, b = (label.select(F.col("node").alias(x), F.col("component").alias(y)) for x, y in (("src", "ca"), ("dst", "cb")))
    across = edges.join(a, "src").join(b, "dst").where("ca <> cb")
    both = across.select(F.col("ca").alias("component"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(across.select("cb", F.lit(1), F.lit(0)))
    return both.groupBy("component").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out")).withColumn("gate", F.col("n_in") * F.col("n_out"))


def lanes(edges: DataFrame, dist: DataFrame, cost: Column, tolerance: float = 1e-9) -> DataFrame:
    """node, lanes_in, lanes_out: edges that lie on a shortest path."""
    x = edges.join(dist.select(F.col("node").alias("src"), F.col("dist").alias("a")), "src").join(dist.select(F.col("node").alias("dst"), F.col("dist").alias("b")), "dst")
    on = x.where(F.abs(F.col("a") + cost - F.col("b")) <= tolerance)
    both = on.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(on.select("src", F.lit(0), F.lit(1)))
    return both.groupBy("node").agg(F.sum("i").alias("lanes_in"), F.sum("o").alias("lanes_out"))
