"""Queries: reach by condensation, support under caps, graph and metric summaries, weights, codes, focal subgraphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decisions as D
from ..operators import graph as G
from ..operators import ranking as R
from ..operators import resolve as V
from .decisions import METRICS, RULES, RULES_SQL, _removed, _targets, metrics, reach_sql
from .fixtures import Tables
from .graphs import COST
from .registry import query

# --- reach and support ----------------------------------------------------------------------------------------


@query("G8 G9", "WITH r(anchor, node) AS (SELECT node, node FROM anchors UNION SELECT anchor, src FROM r JOIN edges ON dst = r.node) SELECT node, count(*) AS n, count(*) FILTER (anchor <> node) AS n_others FROM r GROUP BY node")
def anchor_reach_counts(t: Tables) -> DataFrame:
    return G.reach_counts(t.nodes, t.pairs, t.anchors)


SUPPORT = f"""WITH k(anchor, node, d) AS (SELECT node, node, 0 FROM seeds UNION SELECT anchor, dst, d + 1 FROM k JOIN edges ON src = k.node WHERE d < 6),
w(anchor, node, d) AS (SELECT node, node, 0 FROM seeds UNION SELECT anchor, dst, d + {COST} FROM w JOIN edges ON src = w.node WHERE d < 12),
p AS (SELECT 'hops' AS kind, anchor, node, min(d) AS d FROM k GROUP BY 2, 3 UNION ALL SELECT 'cost', anchor, node, min(d) FROM w GROUP BY 2, 3),
c(kind, cap) AS (VALUES ('hops', 2), ('hops', 4), ('hops', 6), ('cost', 4), ('cost', 8), ('cost', 12)),
tg AS (SELECT a.node, greatest(balance, 0) AS weight FROM anchors a JOIN nodes n ON a.node = n.node),
s AS (SELECT c.kind, c.cap, tg.node, any_value(weight) AS weight, count(p.anchor) AS n FROM c CROSS JOIN tg LEFT JOIN p ON p.kind = c.kind AND p.node = tg.node AND p.d <= c.cap GROUP BY 1, 2, 3)
SELECT kind, cap::DOUBLE AS cap, count(*) FILTER (n > 0) AS n_supported, count(*) FILTER (n >= 2) AS n_by_two, round(avg((n > 0)::INT), 6) AS share, round(avg(n), 6) AS mean, quantile_cont(n, 0.5) AS median, round(quantile_cont(n, 0.9), 6) AS p90,
round(sum(CASE WHEN n > 0 THEN weight ELSE 0 END) / sum(weight), 6) AS weight_share FROM s GROUP BY 1, 2"""


@query("G12 G13 G14", SUPPORT)
def support_under_caps(t: Tables) -> DataFrame:
    sources = t.seeds.select(F.col("node").alias("anchor"), "node")
    costs = G.shortest(t.edges.withColumn("cost", F.expr(COST).cast("double")), sources, cap=12.0, keys=["anchor"])
    x = G.support_summary(G.reach_pairs(t.pairs, t.seeds, 6), _targets(t), [2, 4, 6], "hops").unionByName(G.support_summary(costs, _targets(t), [4, 8, 12], "cost"))
    return x.select("kind", "cap", "n_supported", "n_by_two", "median", *[F.round(c, 6).alias(c) for c in ("share", "mean", "p90", "weight_share")])


GONE = "gone AS (SELECT node FROM (SELECT node, coalesce(o.n, 0) + coalesce(i.n, 0) AS degree FROM nodes LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY 1) o ON node = o.src LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY 1) i ON node = i.dst) ORDER BY degree DESC, node LIMIT 20)"


def _hubs(t: Tables, n: int = 20) -> DataFrame:
    return G.degrees(t.nodes, t.pairs).orderBy(F.desc("degree"), "node").limit(n).select("node")


@query("D24", f"""WITH {GONE}, a(node, d) AS (SELECT node, 0 FROM seeds UNION SELECT dst, d + 1 FROM a JOIN edges ON src = a.node WHERE d < 8), b(node, d) AS (SELECT node, 0 FROM seeds WHERE node NOT IN (SELECT node FROM gone) UNION SELECT dst, d + 1 FROM b JOIN edges ON src = b.node WHERE d < 8 AND dst NOT IN (SELECT node FROM gone)),
x AS (SELECT node, min(d) AS d FROM a GROUP BY node), y AS (SELECT node, min(d) AS d FROM b GROUP BY node) SELECT t.node, x.d::BIGINT AS before, y.d::BIGINT AS after FROM anchors t LEFT JOIN x ON x.node = t.node LEFT JOIN y ON y.node = t.node""")
def best_paths(t: Tables) -> DataFrame:
    return D.best_paths(t.pairs, _hubs(t), t.seeds, t.anchors, 8).select("node", F.col("before").cast("long").alias("before"), F.col("after").cast("long").alias("after"))


@query("D24", """WITH u AS (SELECT dst AS focal, src AS node FROM edges WHERE dst IN (SELECT node FROM seeds) UNION SELECT src, dst FROM edges WHERE src IN (SELECT node FROM seeds)), n AS (SELECT node, count(*) AS links FROM u GROUP BY node), z AS (SELECT x.node, coalesce(links, 0) AS links, balance, x.node IN (SELECT node FROM seeds) AS is_protected FROM nodes x LEFT JOIN n ON n.node = x.node WHERE links > 0 OR x.node IN (SELECT node FROM seeds)),
r AS (SELECT *, row_number() OVER (PARTITION BY is_protected ORDER BY links DESC, balance DESC, node) AS r, count(*) FILTER (is_protected) OVER () AS p FROM z) SELECT node, links, is_protected FROM r WHERE is_protected OR r <= 30 - p""")
def focal_subgraph(t: Tables) -> DataFrame:
    """The seeds and their best neighbours, 30 nodes at most."""
    a = t.pairs.join(t.seeds, F.col("dst") == F.col("node"), "left_semi").select(F.col("dst").alias("focal"), F.col("src").alias("node"))
    b = t.pairs.join(t.seeds, F.col("src") == F.col("node"), "left_semi").select("src", "dst")
    links = a.union(b).distinct().groupBy("node").agg(F.count("*").alias("links"))
    ranked = t.nodes.select("node", "balance").join(links.join(t.seeds, "node", "full"), "node").fillna(0, subset=["links"])
    return D.pruned(ranked, t.seeds, 30, [F.desc("links"), F.desc("balance"), F.asc("node")]).select("node", "links", "is_protected")


REVERSED = reach_sql().replace("SELECT scenario, src, dst FROM edges, sc", "SELECT scenario, dst AS src, src AS dst FROM edges, sc").replace("FROM seeds, sc", "FROM anchors, sc").replace("FROM anchors a JOIN nodes n", "FROM seeds a JOIN nodes n")


@query("D8", f"{REVERSED} {METRICS}")
def scenario_impact_reversed(t: Tables) -> DataFrame:
    """What removals cost the seeds, seen from the anchors, against the direction of the edges."""
    goals = t.seeds.join(t.nodes, "node").select("node", F.greatest("balance", F.lit(0.0)).alias("weight"))
    return metrics(D.impact(G.flipped(t.pairs), _removed(t), t.anchors, goals))


@query("D5 D6")
def robustness_summary(t: Tables) -> DataFrame:
    """Removals by degree, by balance and at random: mean, 5 % and 95 % quantiles of the lost weight."""
    degree = G.degrees(t.nodes, t.pairs).select("node", F.col("degree").alias("value"))
    balance = t.nodes.select("node", F.col("balance").alias("value"))
    named = [("degree", degree, 0), ("balance", balance, 0), ("random", degree, 4)]
    parts = []
    for name, ranked, repeats in named:
        s = D.robustness_scenarios(ranked, t.nodes, [10, 40], repeats)
        parts.append(s.where(F.col("scenario").startswith("random")) if repeats else s.withColumn("scenario", F.regexp_replace("scenario", "^targeted", name)))
    return D.curve_summary(D.impact(t.pairs, reduce(DataFrame.unionByName, parts), t.seeds, _targets(t)), "weight_lost").select("strategy", "size", "n_runs", *[F.round(c, 6).alias(c) for c in ("mean", "p05", "p95")])


# --- summaries of graphs and lists ----------------------------------------------------------------------------


@query("C5", """WITH e AS (SELECT src, dst FROM edges WHERE is_disclosed = 1), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), wr(node, x) AS (SELECT node, node FROM nodes UNION SELECT b.dst, x FROM wr JOIN b ON b.src = wr.node AND x < b.dst), w AS (SELECT count(*) AS c FROM (SELECT node, min(x) AS m FROM wr GROUP BY node) GROUP BY m),
r(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM r JOIN e ON b = src), s0 AS (SELECT x.a, min(x.b) AS m FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a), s AS (SELECT count(*) AS c FROM (SELECT node, coalesce(least(m, node), node) AS m FROM nodes LEFT JOIN s0 ON node = a) GROUP BY m),
d AS (SELECT node, coalesce(i.n, 0) AS i, coalesce(o.n, 0) AS o FROM nodes LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY 1) i ON node = i.dst LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY 1) o ON node = o.src), n AS (SELECT count(*) AS n FROM nodes), m AS (SELECT count(*) AS m FROM e)
SELECT n AS nodes, m AS edges, round(m / (n * (n - 1.0)), 9) AS density, (SELECT count(*) FROM w) AS n_weak, round((SELECT max(c) FROM w) / n, 6) AS weak_share, (SELECT count(*) FROM s) AS n_strong, round((SELECT max(c) FROM s) / n, 6) AS strong_share,
(SELECT round(avg(i), 6) FROM d) AS in_degree_mean, (SELECT quantile_cont(i, 0.5) FROM d) AS in_degree_median, (SELECT round(quantile_cont(i, 0.9), 6) FROM d) AS in_degree_p90, (SELECT max(i) FROM d) AS in_degree_max, (SELECT max(o) FROM d) AS out_degree_max FROM n, m""")
def graph_summary(t: Tables) -> DataFrame:
    s = G.summary(t.nodes, t.edges.where("is_disclosed = 1"))
    return s.select("nodes", "edges", F.round("density", 9).alias("density"), "n_weak", "n_strong", "in_degree_median", "in_degree_max", "out_degree_max", *[F.round(c, 6).alias(c) for c in ("weak_share", "strong_share", "in_degree_mean", "in_degree_p90")])


@query("C11", """WITH k(anchor, node, d) AS (SELECT node, node, 0 FROM seeds UNION SELECT anchor, src, d + 1 FROM k JOIN edges ON dst = k.node WHERE d < 30), p AS (SELECT anchor, node, min(d) AS d FROM k GROUP BY 1, 2), c AS (SELECT anchor, count(*) - 1 AS r, sum(d) AS total FROM p GROUP BY anchor), n AS (SELECT count(*) AS n FROM nodes)
SELECT anchor AS node, round(CASE WHEN total > 0 THEN r / total * r / (n - 1) ELSE 0 END, 8) AS closeness, round((SELECT count(*) FROM edges WHERE dst = anchor) / (n - 1), 8) AS in_centrality, round((SELECT count(*) FROM edges WHERE src = anchor) / (n - 1), 8) AS out_centrality FROM c, n""")
def closeness_scores(t: Tables) -> DataFrame:
    return G.closeness(t.nodes, t.pairs, t.seeds, 30).select("node", *[F.round(c, 8).alias(c) for c in ("closeness", "in_centrality", "out_centrality")])


@query("C10 C11")
def criticality_scores(t: Tables) -> DataFrame:
    x = G.criticality(t.nodes, t.pairs, t.seeds)
    return x.select("node", *[F.round(c, 8).alias(c) for c in x.columns if c != "node"])


@query("R1 R2", """WITH r AS (SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY points DESC, dst) AS rank, sum(label) OVER (PARTITION BY src) AS total FROM scores), k(k) AS (VALUES (5), (10), (20)), m AS (SELECT k, src, any_value(total) AS total, count(*) FILTER (label = 1 AND rank <= k) AS tp FROM r, k WHERE total > 0 GROUP BY 1, 2)
SELECT k::BIGINT AS k, round(avg(tp / k), 6) AS macro_precision, round(avg(tp / total), 6) AS macro_recall, round(avg((tp > 0)::INT), 6) AS hit, round(sum(tp) / (k * count(*)), 6) AS micro_precision, round(sum(tp) / sum(total), 6) AS micro_recall FROM m GROUP BY k""")
def pooled_metrics(t: Tables) -> DataFrame:
    x = R.pooled_metrics(R.list_metrics(t.scores, (5, 10, 20), score="points"), (5, 10, 20))
    return x.select("k", *[F.round(c, 6).alias(c) for c in x.columns if c != "k"])


@query("R8", "WITH x AS (SELECT (points + 1) / 10009.0 AS p, label AS y FROM scores) SELECT count(*) AS n, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(p), 6) AS positive_rate FROM x")
def probability_losses(t: Tables) -> DataFrame:
    x = R.probability_losses(t.scores.withColumn("p", (F.col("points") + 1) / 10009.0), "p")
    return x.select("n", *[F.round(c, 6).alias(c) for c in ("log_loss", "brier", "positive_rate")])


@query("R7 R8 R9")
def stacked_losses(t: Tables) -> DataFrame:
    """Losses of a regression on the score, the number of lines and the class of the pair."""
    rows = t.scores.select("label", (F.col("points") / 10007.0).alias("s"), F.log1p(F.col("n_lines").cast("double")).alias("lines"), (F.col("src") % 2).cast("double").alias("even"))
    _, _, x = R.stacked(rows, ["s", "lines", "even"])
    return R.probability_losses(x, "probability").select("n", *[F.round(c, 4).alias(c) for c in ("log_loss", "brier", "positive_rate")])


@query("H5", """WITH d AS (SELECT node, coalesce(n, 0) AS d FROM nodes LEFT JOIN (SELECT src, count(*) AS n FROM edges WHERE is_disclosed = 1 GROUP BY 1) o ON node = o.src), q AS (SELECT quantile_cont(d, [0.25, 0.5, 0.75]) AS q FROM d)
SELECT node, (1 + (d > q[1])::INT + (d > q[2])::INT + (d > q[3])::INT)::BIGINT AS quartile FROM d, q""")
def source_quartiles(t: Tables) -> DataFrame:
    return R.source_quartiles(t.nodes, t.edges.where("is_disclosed = 1").select("src", "dst"))


@query("A11", "SELECT supplier_id AS src, customer_id AS dst, count(*) AS n, round(avg(score), 6) AS score FROM (SELECT supplier_id, customer_id, part_id % 3 AS seed, sum(cents)::DOUBLE AS score FROM rel GROUP BY 1, 2, 3) GROUP BY 1, 2")
def seed_means(t: Tables) -> DataFrame:
    by_seed = t.rel.groupBy(F.col("supplier_id").alias("src"), F.col("customer_id").alias("dst"), (F.col("part_id") % 3).alias("seed")).agg(F.sum("cents").cast("double").alias("score"))
    return by_seed.groupBy("src", "dst").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score"))


# --- weights, codes, lookups ----------------------------------------------------------------------------------


@query("D16", "WITH v AS (SELECT s_nationkey AS nation, sum(s_acctbal) AS raw FROM supplier WHERE s_nationkey < 20 GROUP BY 1) SELECT a.node, round(coalesce(raw, 0), 4) AS raw, round(greatest(coalesce(raw, 0), 0), 4) AS weight, round(ln(1 + greatest(coalesce(raw, 0), 0)), 6) AS logged FROM nodes a LEFT JOIN v ON v.nation = a.nation")
def node_weights(t: Tables) -> DataFrame:
    amounts = t.supplier.where("s_nationkey < 20").select(F.col("s_nationkey").alias("nation"), "s_acctbal")
    return D.weights(t.nodes, amounts, "nation", "s_acctbal").select("node", F.round("raw", 4).alias("raw"), F.round("weight", 4).alias("weight"), F.round("logged", 6).alias("logged"))


@query("D19 A16", """WITH g AS (SELECT part_id, sum(cents) AS c, count(*) AS n FROM rel GROUP BY 1), a AS (SELECT part_id FROM g ORDER BY c DESC, part_id LIMIT 100), b AS (SELECT part_id FROM g ORDER BY n DESC, part_id LIMIT 100),
m AS (SELECT p_partkey AS node, p_type AS code, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END AS name, p_partkey IN (SELECT part_id FROM a) AS ta, p_partkey IN (SELECT part_id FROM b) AS tb FROM part), o AS (SELECT code, name, row_number() OVER (PARTITION BY code ORDER BY count(*) DESC, name) AS r FROM m WHERE name <> '' GROUP BY 1, 2)
SELECT m.code, CASE m.code WHEN 'ECONOMY' THEN 'Economy line' ELSE any_value(coalesce(o.name, '')) END AS code_name, count(*) AS n_nodes, count(*) FILTER (ta) AS by_value_count, round(count(*) FILTER (ta) / count(*), 6) AS by_value_share, count(*) FILTER (tb) AS by_lines_count, round(count(*) FILTER (tb) / count(*), 6) AS by_lines_share FROM m LEFT JOIN o ON o.code = m.code AND r = 1 GROUP BY m.code""")
def code_universe(t: Tables) -> DataFrame:
    g = t.rel.groupBy("part_id").agg(F.sum("cents").alias("c"), F.count("*").alias("n"))
    m = t.part.select(F.col("p_partkey").alias("node"), F.col("p_type").alias("code"), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_brand")).alias("name"))
    for name, by in (("by_value", "c"), ("by_lines", "n")):
        top = g.orderBy(F.desc(by), "part_id").limit(100).select(F.col("part_id").alias("node"), F.lit(True).alias(name))
        m = m.join(top, "node", "left").fillna(False, subset=[name])
    x = D.code_universe(m, {"ECONOMY": "Economy line"}, ["by_value", "by_lines"])
    return x.select("code", "code_name", "n_nodes", "by_value_count", "by_lines_count", *[F.round(c, 6).alias(c) for c in ("by_value_share", "by_lines_share")])


@query("D18 A17", f"WITH {RULES_SQL}, i AS (SELECT p_partkey AS item, p_type AS code, p_size > 25 AS big FROM part) SELECT r.code, r.system, count(DISTINCT item) AS n_items, count(DISTINCT CASE WHEN big THEN item END) AS n_big FROM r LEFT JOIN i ON i.code = r.code GROUP BY 1, 2")
def rule_coverage(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame(RULES, "code string, system string, priority int, action string, gate string")
    return D.rule_coverage(t.part.select(F.col("p_partkey").alias("item"), F.col("p_type").alias("code"), (F.col("p_size") > 25).alias("big")), rules, flags=["big"])


@query("J11", """WITH par AS (SELECT n_nationkey AS id, n_nationkey // 2 * 2 AS canonical, n_name FROM nation), lk AS (SELECT DISTINCT key, n_name FROM (SELECT canonical AS key, n_name FROM par WHERE id = canonical UNION ALL SELECT p.id, q.n_name FROM par p JOIN par q ON q.id = p.canonical) )
SELECT s_suppkey, n_name AS entity FROM supplier LEFT JOIN lk ON lk.key = s_nationkey""")
def union_lookup(t: Tables) -> DataFrame:
    """Suppliers to entities by a lookup of canonical and raw ids; repeated keys go before the join, so no row is doubled."""
    p = t.nation.select(F.col("n_nationkey").alias("id"), F.expr("n_nationkey div 2 * 2").alias("canonical"), "n_name")
    heads = p.where("id = canonical").select(F.col("canonical").alias("key"), F.col("n_name").alias("entity"))
    lookup = heads.unionByName(p.join(heads, F.col("canonical") == F.col("key")).select(F.col("id").alias("key"), "entity"))
    return t.supplier.join(lookup.dropDuplicates(["key"]), F.col("s_nationkey") == F.col("key"), "left").select("s_suppkey", "entity")


@query("D26", f"""WITH {GONE}, b AS (SELECT src, dst FROM edges WHERE is_disclosed = 1 UNION SELECT dst, src FROM edges WHERE is_disclosed = 1), l AS (SELECT src, dst FROM b WHERE src NOT IN (SELECT node FROM gone) AND dst NOT IN (SELECT node FROM gone)),
x(node, m) AS (SELECT node, node FROM nodes UNION SELECT b.dst, m FROM x JOIN b ON b.src = x.node AND m < b.dst), y(node, m) AS (SELECT node, node FROM nodes WHERE node NOT IN (SELECT node FROM gone) UNION SELECT l.dst, m FROM y JOIN l ON l.src = y.node AND m < l.dst),
s AS (SELECT 'before' AS state, count(*) AS n FROM (SELECT node, min(m) AS c FROM x GROUP BY node) GROUP BY c UNION ALL SELECT 'after', count(*) FROM (SELECT node, min(m) AS c FROM y GROUP BY node) GROUP BY c) SELECT state, count(*) AS components, round(max(n) / sum(n), 6) AS largest_share FROM s GROUP BY state""")
def fragmentation_of_disclosed(t: Tables) -> DataFrame:
    x = D.fragmentation(t.nodes.select("node"), t.edges.where("is_disclosed = 1").select("src", "dst"), _hubs(t))
    return x.withColumn("largest_share", F.round("largest_share", 6))


@query("U1 J19", "WITH n AS (SELECT n_name, count(*) AS c FROM nation GROUP BY 1), x AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'NATION_' || s_nationkey ELSE s_name END AS a, CASE WHEN s_suppkey % 2 = 0 THEN 'NATION_' || ((s_nationkey + 1) % 25) END AS b FROM supplier) SELECT s_suppkey, coalesce(p.n_name, q.n_name) AS nation, CASE WHEN p.n_name IS NOT NULL THEN 'a' WHEN q.n_name IS NOT NULL THEN 'b' END AS matched_by FROM x LEFT JOIN n p ON p.n_name = a AND p.c = 1 LEFT JOIN n q ON q.n_name = b AND q.c = 1")
def cascade_with_gaps(t: Tables) -> DataFrame:
    """Some suppliers match by the first key, some by the second, some not at all."""
    code = lambda k: F.concat(F.lit("NATION_"), k.cast("string"))
    left = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, code(F.col("s_nationkey"))).otherwise(F.col("s_name")).alias("a"), F.when(F.col("s_suppkey") % 2 == 0, code((F.col("s_nationkey") + 1) % 25)).alias("b"))
    return V.exact_cascade(left, t.nation.select(F.col("n_name").alias("name"), F.col("n_name").alias("nation")), ["a", "b"], "nation").select("s_suppkey", "nation", "matched_by")


@query("G19", f"""WITH bfs(node, d) AS (SELECT node, 0 FROM seeds UNION SELECT dst, d + 1 FROM bfs JOIN edges ON src = node WHERE d < 30), m AS (SELECT node, min(d) AS d FROM bfs GROUP BY node), w AS (SELECT node, CASE WHEN node % 7 = 0 AND d > 0 THEN d + 1 ELSE d END AS d FROM m)
SELECT node, d::BIGINT AS dist FROM w WHERE d > 0 AND NOT EXISTS (SELECT 1 FROM edges e JOIN w p ON p.node = e.src WHERE e.dst = w.node AND p.d = w.d - 1)""")
def certificate_of_wrong_distances(t: Tables) -> DataFrame:
    """The certificate over distances of which some are one too long: the nodes that it finds."""
    d = G.distances(t.pairs, t.seeds, 30)
    wrong = d.withColumn("dist", F.when((F.col("node") % 7 == 0) & (F.col("dist") > 0), F.col("dist") + 1).otherwise(F.col("dist")))
    return G.certificate(t.pairs, wrong).select("node", F.col("dist").cast("long").alias("dist"))
