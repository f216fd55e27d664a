"""Disruption scenarios, rank stability, action matrix, rule decisions and record assembly."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored
from . import graph as G
from .order import running

# --- scenarios: rows (scenario, node) of removed nodes --------------------------------------------------------


SCENARIOS = 500  # scenarios that are evaluated together


def _scenarios(removed: DataFrame) -> DataFrame:
    """The scenarios' names, for a broadcast: tables of sources or targets are dealt to each, so there may not be many."""
    s = removed.select("scenario").distinct()
    if s.limit(2 * SCENARIOS + 2).count() > 2 * SCENARIOS:
        raise ValueError(f"over {2 * SCENARIOS} scenarios at once; impact() evaluates them in groups")
    return F.broadcast(s)


def scenario_reach(edges: DataFrame, removed: DataFrame, sources: DataFrame, cap: int) -> DataFrame:
    """scenario, node, dist within ``cap`` hops of the sources that a scenario leaves with a link, and the same for 'baseline'.

    The edges stay one table: fronts carry the scenario, and what a scenario removes is taken from them. edges should be stored.
    """
    gone = removed.select("scenario", "node").where(F.col("node").isNotNull()).distinct()
    names = _scenarios(removed.select("scenario").union(sources.sparkSession.range(1).select(F.lit("baseline"))))
    left = lambda x: x.join(gone, ["scenario", "node"], "left_anti")
    links = G.undirected(edges).join(sources.select(F.col("node").alias("src")).distinct(), "src", "left_semi").join(names)
    links = left(links.select("scenario", "src", F.col("dst").alias("node"))).select("scenario", F.col("src").alias("node")).distinct()
    front = stored(left(links).withColumn("dist", F.lit(0)))
    seen = front
    for d in range(1, cap + 1):
        nxt = left(front.join(edges, F.col("node") == F.col("src")).select("scenario", F.col("dst").alias("node")).distinct())
        front = stored(nxt.join(seen.select("scenario", "node"), ["scenario", "node"], "left_anti").withColumn("dist", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def without_pairs(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """As ``without`` for removed pairs (scenario, src, dst), both directions."""
    s = _scenarios(removed)
    both = removed.select("scenario", "src", "dst").union(removed.select("scenario", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select("src", "dst").join(s).join(both.distinct(), ["scenario", "src", "dst"], "left_anti")


def scenario_distances(edges: DataFrame, sources: DataFrame, cap: int) -> DataFrame:
    """scenario, node, dist within ``cap`` hops of the scenario's surviving sources. edges: scenario, src, dst."""
    front = stored(edges.select("scenario").distinct().join(sources.select("node").distinct()).withColumn("dist", F.lit(0)))  # sources of each scenario
    alive = edges.select("scenario", F.col("src").alias("node")).union(edges.select("scenario", "dst")).distinct()
    front = stored(front.join(alive, ["scenario", "node"], "left_semi"))
    seen = front
    for d in range(1, cap + 1):
        nxt = front.join(edges.withColumnRenamed("src", "node"), ["scenario", "node"]).select("scenario", F.col("dst").alias("node")).distinct()
        front = stored(nxt.join(seen.select("scenario", "node"), ["scenario", "node"], "left_anti").withColumn("dist", F.lit(d)))
        if front.isEmpty():
            break
        seen = stored(seen.unionByName(front))
    return seen


def impact(edges: DataFrame, removed: DataFrame, sources: DataFrame, targets: DataFrame, cap: int = 6) -> DataFrame:
    """For each scenario: the share of reached targets' weight that is lost, how many are cut off, the mean path growth of
    those still reached, and the entries (in-neighbours that a source reaches) that targets lose. targets: node, weight."""
    removed = stored(removed.select("scenario", "node"))
    n = removed.select("scenario").distinct().count()
    if n > SCENARIOS:
        groups = -(-n // (SCENARIOS // 2))  # by hash, so of uneven size
        of = F.pmod(F.xxhash64("scenario"), F.lit(groups))
        return reduce(DataFrame.unionByName, [stored(impact(edges, removed.where(of == g), sources, targets, cap)) for g in range(groups)])
    edges = stored(edges.select("src", "dst"))
    dist = scenario_reach(edges, removed, sources, cap)
    into = edges.join(targets.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")
    entry = dist.select("scenario", F.col("node").alias("src")).join(into, "src").groupBy("scenario", F.col("dst").alias("node")).agg(F.count("*").alias("entries"))
    x = stored(dist.join(targets, "node").join(entry, ["scenario", "node"], "left").fillna(0, subset=["entries"]))
    base = x.where("scenario = 'baseline'").select("node", "weight", F.col("dist").alias("d0"), F.col("entries").alias("e0"))
    grid = base.join(_scenarios(removed))
    y = grid.join(x.where("scenario <> 'baseline'").select("scenario", "node", "dist", "entries"), ["scenario", "node"], "left")
    lost = F.col("dist").isNull()
    return y.groupBy("scenario").agg(
        F.count("*").alias("n_targets"),
        F.count_if(lost).alias("n_lost"),
        (F.sum(F.when(lost, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("weight_lost"),
        F.avg(F.when(~lost, F.col("dist") - F.col("d0"))).alias("path_growth"),
        F.avg(F.when(F.col("e0") > 0, 1 - F.coalesce("entries", F.lit(0)) / F.col("e0"))).alias("entry_loss"),
    )


def target_profiles(edges: DataFrame, removed: DataFrame, sources: DataFrame, targets: DataFrame, cap: int = 6) -> DataFrame:
    """For each target: in how many scenarios it is reached, cut off, or reached by a longer way."""
    found = scenario_reach(stored(edges.select("src", "dst")), removed, sources, cap)
    x = stored(found.join(targets.select("node"), "node", "left_semi"))
    base = x.where("scenario = 'baseline'").select("node", F.col("dist").alias("d0"))
    n = removed.select("scenario").distinct().count()
    y = base.join(x.where("scenario <> 'baseline'"), "node", "left").groupBy("node").agg(F.count("scenario").alias("reached"), F.count_if(F.col("dist") > F.col("d0")).alias("longer"))
    return y.withColumn("lost", F.lit(n) - F.col("reached"))


def robustness_scenarios(ranked: DataFrame, nodes: DataFrame, sizes: Sequence[int], repeats: int, seed: int = 0) -> DataFrame:
    """scenario, node: the top ``size`` by value (ties: larger node first), and as many by hash for each repeat."""
    top = ranked.orderBy(F.desc("value"), F.desc("node")).limit(max(sizes))
    top = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("value"), F.desc("node"))))  # the largest size's rows
    out = [top.where(F.col("r") <= k).select(F.lit(f"targeted:{k}").alias("scenario"), "node") for k in sizes]
    for i in range(repeats):
        pick = nodes.select("node").orderBy(F.xxhash64("node", F.lit(seed + i)), "node").limit(max(sizes))
        pick = pick.withColumn("r", F.row_number().over(Window.orderBy(F.xxhash64("node", F.lit(seed + i)), "node")))
        out += [pick.where(F.col("r") <= k).select(F.lit(f"random{i}:{k}").alias("scenario"), "node") for k in sizes]
    return reduce(DataFrame.unionByName, out)


def robustness_ratio(results: DataFrame, metric: str) -> DataFrame:
    """size, targeted, random (mean of repeats), ratio (null where random is 0 or less)."""
    x = results.withColumn("size", F.element_at(F.split("scenario", ":"), -1).cast("long")).withColumn("targeted", F.col("scenario").startswith("targeted"))
    y = x.groupBy("size").agg(F.max(F.when(F.col("targeted"), F.col(metric))).alias("targeted"), F.avg(F.when(~F.col("targeted"), F.col(metric))).alias("random"))
    return y.withColumn("ratio", F.when(F.col("random") > 0, F.col("targeted") / F.col("random")))


def curve_summary(results: DataFrame, metric: str) -> DataFrame:
    """strategy, size, n_runs, and mean, 5 % and 95 % quantiles of a metric over the runs. Scenarios are named strategy[run]:size."""
    x = results.select(F.regexp_extract("scenario", "^([a-z_]+)", 1).alias("strategy"), F.element_at(F.split("scenario", ":"), -1).cast("long").alias("size"), F.col(metric).alias("v"))
    return x.groupBy("strategy", "size").agg(F.count("*").alias("n_runs"), F.avg("v").alias("mean"), F.percentile("v", F.lit(0.05)).alias("p05"), F.percentile("v", F.lit(0.95)).alias("p95"))


def best_paths(edges: DataFrame, removed: DataFrame, sources: DataFrame, targets: DataFrame, cap: int | None = None) -> DataFrame:
    """node, before, after: hops from the nearest source with all nodes and without the removed ones; null where there is no way."""
    gone = removed.select("node").distinct()
    left = edges.select("src", "dst").join(gone, F.col("src") == F.col("node"), "left_anti").join(gone, F.col("dst") == F.col("node"), "left_anti")
    x = targets.select("node").distinct().join(G.distances(edges, sources, cap).select("node", F.col("dist").alias("before")), "node", "left")
    after = G.distances(left, sources.join(gone, "node", "left_anti"), cap).join(gone, "node", "left_anti")
    return x.join(after.select("node", F.col("dist").alias("after")), "node", "left")


def pruned(ranked: DataFrame, protected: DataFrame, most: int, order: Sequence[Column]) -> DataFrame:
    """At most ``most`` of the nodes: the protected ones (all of them, if they are more), then the best by the order."""
    x = ranked.join(protected.select("node").distinct().withColumn("__p", F.lit(1)), "node", "left").withColumn("is_protected", F.col("__p").isNotNull()).drop("__p")
    kept = x.where("is_protected")
    room = max(most - kept.count(), 0)
    return kept.unionByName(x.where("NOT is_protected").orderBy(*order).limit(room))


def weights(nodes: DataFrame, amounts: DataFrame, key: str, amount: str) -> DataFrame:
    """node, raw, weight, logged: the summed amounts of the node's key; weight is not below 0, logged is log(1 + weight). Keys without amounts: 0."""
    total = amounts.groupBy(key).agg(F.sum(amount).cast("double").alias("raw"))
    x = nodes.select("node", key).join(total, key, "left").fillna(0.0, subset=["raw"]).withColumn("weight", F.greatest("raw", F.lit(0.0)))
    return x.select("node", "raw", "weight", F.log1p("weight").alias("logged"))


def code_universe(membership: DataFrame, names: dict[str, str], tops: Sequence[str]) -> DataFrame:
    """code, code_name, n_nodes, and for each flag of ``tops`` the number of flagged nodes and their share of the code's nodes.

    membership: node, code, name and the flags. A code's name is its most frequent one that is not empty (ties: the
    first in order), unless ``names`` overrides it.
    """
    x = membership.dropDuplicates(["node", "code", "name"])
    mode = x.where(F.trim("name") != "").groupBy("code", "name").agg(F.count("*").alias("n")).groupBy("code").agg(F.min(F.struct((-F.col("n")).alias("n"), "name")).alias("m"))
    out = x.groupBy("code").agg(F.countDistinct("node").alias("n_nodes"), *[F.countDistinct(F.when(F.col(t), F.col("node"))).alias(t) for t in tops]).join(mode.select("code", F.col("m.name").alias("mode")), "code", "left")
    fixed = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])[F.col("code")] if names else F.lit(None).cast("string")
    return out.select("code", F.coalesce(fixed, "mode", F.lit("")).alias("code_name"), "n_nodes", *[c for t in tops for c in (F.col(t).alias(f"{t}_count"), (F.col(t) / F.col("n_nodes")).alias(f"{t}_share"))])


def greedy(edges: DataFrame, shortlist: list[int], sources: DataFrame, targets: DataFrame, k: int, objective: str = "weight_lost", cap: int = 6) -> list[tuple[int, float]]:
    """k rounds: each evaluates every shortlisted node on top of those chosen, in one pass, and takes the first best."""
    spark, chosen = edges.sparkSession, []
    for _ in range(k):
        rows = [(str(c), n) for c in shortlist if c not in [x for x, _ in chosen] for n in [c, *[x for x, _ in chosen]]]
        if not rows:
            break
        found = impact(edges, spark.createDataFrame(rows, "scenario string, node long"), sources, targets, cap).select("scenario", objective).collect()
        best = max(found, key=lambda r: (r[objective] or 0.0, -int(r.scenario)))
        chosen.append((int(best.scenario), float(best[objective] or 0.0)))
    return chosen


# --- ranks ----------------------------------------------------------------------------------------------------


def _mid_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Mean ranks from the distinct values' counts."""
    n = df.groupBy(column).agg(F.count("*").alias("__n"))
    n = running(n, [column], {"__upto": "__n"})
    return df.join(n.select(column, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(out)), column)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    x = _mid_rank(_mid_rank(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, "__ra"), b, "__rb")
    return x.agg(F.corr("__ra", "__rb").alias("spearman"))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """tau-b over a top list: each pair once. For lists of bounded length (a top-N report), not for whole tables."""
    x = df.select(F.col(a).alias("a"), F.col(b).alias("b"), F.row_number().over(Window.orderBy(a, b)).alias("i"))
    y = x.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("i").alias("j"))
    p = x.join(y, F.col("i") < F.col("j"))
    da, db = F.signum(F.col("a2") - F.col("a")), F.signum(F.col("b2") - F.col("b"))
    s = p.agg(F.sum(da * db).alias("s"), F.count_if(da != 0).alias("na"), F.count_if(db != 0).alias("nb"))
    return s.select((F.col("s") / F.sqrt(F.col("na") * F.col("nb"))).alias("kendall"))


def imputed_ranks(a: DataFrame, b: DataFrame, key: str, rank: str) -> DataFrame:
    """key, rank_a, rank_b over the union of two top lists; who is missing from a list ranks one past its end."""
    na, nb = a.count(), b.count()
    x = a.select(key, F.col(rank).alias("rank_a")).join(b.select(key, F.col(rank).alias("rank_b")), key, "full")
    return x.fillna(na + 1, subset=["rank_a"]).fillna(nb + 1, subset=["rank_b"])


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """n_both, n_any and Jaccard of two key sets."""
    x = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    both = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    return x.agg(both.alias("n_both"), F.count("*").alias("n_any"), (both / F.count("*")).alias("jaccard"))


def action_matrix(views: DataFrame, key: str, view: str, metric: str, names: Sequence[str], high: float, confident: int) -> DataFrame:
    """One row a key: the number of views it is in, its least rank, its largest metric, each view's metric, bucket and text."""
    one = views.groupBy(key).agg(F.countDistinct(view).alias("n_views"), F.min("rank").alias("least_rank"), F.max(metric).alias("metric"))
    wide = views.groupBy(key).pivot(view, list(names)).agg(F.max(metric))
    strong, sure = F.col("metric") >= high, F.col("n_views") >= confident
    bucket = F.when(strong & sure, "act").when(strong, "verify").when(sure, "monitor").otherwise("watch")
    return one.join(wide, key).withColumn("bucket", bucket)


def rule_decisions(items: DataFrame, rules: DataFrame, key: str = "item", code: str = "code") -> DataFrame:
    """key, system, decision: rules match by code; a gated rule needs its gate (an unknown gate fails); of the systems that
    match, the one of lowest priority decides; include and exclude together are a conflict.

    rules: code, system, priority, action (include/exclude), gate (null: none); items: key, code, gates (array).
    """
    open_ = F.col("gate").isNull() | F.coalesce(F.array_contains("gates", F.col("gate")), F.lit(False))
    hit = items.join(F.broadcast(rules) if rules.count() <= 100_000 else rules, code).where(open_)
    hit = hit.withColumn("lead", F.min("priority").over(Window.partitionBy(key))).where("priority = lead")
    by = hit.groupBy(key).agg(F.min("system").alias("system"), F.max(F.col("action") == "include").alias("i"), F.max(F.col("action") == "exclude").alias("e"))
    out = items.select(key).distinct().join(by, key, "left")
    return out.select(key, "system", F.when(F.col("i") & F.col("e"), "conflict").when(F.col("i"), "include").when(F.col("e"), "exclude").otherwise("none").alias("decision"))


def rule_coverage(items: DataFrame, rules: DataFrame, key: str = "item", code: str = "code", flags: Sequence[str] = ()) -> DataFrame:
    """Distinct items that each rule matches, and how many of them have each flag."""
    per_flag = [F.countDistinct(F.when(F.col(f), F.col(key))).alias(f"n_{f}") for f in flags]
    return rules.join(items, code, "left").groupBy(code, "system").agg(F.countDistinct(key).alias("n_items"), *per_flag)


# --- records --------------------------------------------------------------------------------------------------


def issues(df: DataFrame, key: str, required: Sequence[str], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """key, level, issue: missing fields, values out of range, repeated and unsafe keys, in one pass."""
    df, n = df.withColumn("__n", F.count("*").over(Window.partitionBy(key))), F.col("__n")

    def issue(when: Column, level: str, text: str) -> Column:
        return F.when(when, F.struct(F.lit(level).alias("level"), F.lit(text).alias("issue")))

    found = [issue(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), "error", f"missing {c}") for c in required]
    found += [issue(~F.col(c).between(lo, hi), "warning", f"{c} out of range") for c, (lo, hi) in ranges.items()]
    found += [issue(n > 1, "error", "repeated key"), issue(~F.col(key).cast("string").rlike("^[A-Za-z0-9_.-]+$"), "error", "unsafe key")]
    return df.select(F.col(key), F.explode(F.array_compact(F.array(*found))).alias("x")).select(key, "x.*")


def records(df: DataFrame, key: str, rank: Column, name: str) -> DataFrame:
    """key, record (JSON of all columns): one document a row, ordered by rank, then name."""
    return df.orderBy(rank, name).select(key, F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias("record"))


def dependencies(edges: DataFrame) -> DataFrame:
    """node, direction, n, neighbours: both directions' distinct neighbours; a list is one node's own neighbourhood."""
    both = edges.select(F.col("src").alias("node"), F.lit("out").alias("direction"), F.col("dst").alias("other")).union(edges.select("dst", F.lit("in"), "src")).distinct()
    return both.groupBy("node", "direction").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("other")), lambda x: x.cast("string")), "|").alias("neighbours"))


def fragmentation(nodes: DataFrame, edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Weak components and the largest one's share, before and after a removal (our own definition of the shipped records' metric)."""
    out = None
    for name, n, e in (("before", nodes, edges), ("after", nodes.join(removed, "node", "left_anti"), edges.join(removed.withColumnRenamed("node", "src"), "src", "left_anti").join(removed.withColumnRenamed("node", "dst"), "dst", "left_anti"))):
        c = G.weak_components(n, e).groupBy("component").agg(F.count("*").alias("n"))
        x = c.agg(F.lit(name).alias("state"), F.count("*").alias("components"), (F.max("n") / F.sum("n")).alias("largest_share"))
        out = x if out is None else out.unionByName(x)
    return out
