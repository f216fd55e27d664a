"""Queries: disruption, stability, decisions, entity resolution, records, snapshots of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import cuts as K
from ..operators import decisions as D
from ..operators import graph as G
from ..operators import resolve as V
from .fixtures import Tables
from .registry import query


def _targets(t: Tables) -> DataFrame:
    return t.anchors.join(t.nodes, "node").select("node", F.greatest("balance", F.lit(0.0)).alias("weight"))


def _removed(t: Tables) -> DataFrame:
    """Scenario s<k>: the nodes of nation k + 2 with a balance over 9000."""
    return t.nodes.where("nation BETWEEN 2 AND 6 AND balance > 9000").select(F.concat(F.lit("s"), (F.col("nation") - 2).cast("string")).alias("scenario"), "node")


REACH = """, rm AS (RM), sc AS (SELECT DISTINCT scenario FROM rm UNION ALL SELECT 'baseline'),
al AS (SELECT scenario, src, dst FROM edges, sc WHERE NOT EXISTS (SELECT 1 FROM rm WHERE rm.scenario = sc.scenario AND rm.node IN (src, dst))),
k(scenario, node, d) AS (SELECT scenario, node, 0 FROM seeds, sc WHERE EXISTS (SELECT 1 FROM al WHERE al.scenario = sc.scenario AND node IN (src, dst)) UNION SELECT k.scenario, dst, d + 1 FROM k JOIN al ON al.scenario = k.scenario AND src = k.node WHERE d < 6),
p AS (SELECT scenario, node, min(d) AS d FROM k GROUP BY 1, 2), tg AS (SELECT a.node, greatest(balance, 0) AS weight FROM anchors a JOIN nodes n ON a.node = n.node),
en AS (SELECT al.scenario, al.dst AS node, count(*) AS n FROM al JOIN p ON p.scenario = al.scenario AND p.node = al.src GROUP BY 1, 2), t0 AS (SELECT p.scenario, p.node, weight, d, coalesce(n, 0) AS e FROM p JOIN tg ON tg.node = p.node LEFT JOIN en ON en.scenario = p.scenario AND en.node = p.node),
b AS (SELECT node, weight, d AS d0, e AS e0 FROM t0 WHERE scenario = 'baseline'), y AS (SELECT s.scenario, b.*, t0.d, coalesce(t0.e, 0) AS e FROM b CROSS JOIN (SELECT DISTINCT scenario FROM rm) s LEFT JOIN t0 ON t0.scenario = s.scenario AND t0.node = b.node)"""
METRICS = "SELECT scenario, count(*) AS n_targets, count(*) FILTER (d IS NULL) AS n_lost, round(sum(CASE WHEN d IS NULL THEN weight ELSE 0 END) / sum(weight), 6) AS weight_lost, round(coalesce(avg(d - d0), 0), 6) AS path_growth, round(coalesce(avg(CASE WHEN e0 > 0 THEN 1 - e::DOUBLE / e0 END), 0), 6) AS entry_loss FROM y GROUP BY scenario"


def reach_sql(removed: str = "SELECT 's' || (nation - 2) AS scenario, node FROM nodes WHERE nation BETWEEN 2 AND 6 AND balance > 9000", before: str = "z AS (SELECT 1)") -> str:
    """WITH clauses up to y: each scenario's targets with weight, hops and entries, before (d0, e0) and after (d, e)."""
    return f"WITH {before}{REACH.replace('RM', removed)}"


def metrics(x: DataFrame) -> DataFrame:
    return x.select("scenario", "n_targets", "n_lost", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("weight_lost", "path_growth", "entry_loss")])


@query("D1 D9 T15", f"{reach_sql()} {METRICS}")
def scenario_impact(t: Tables) -> DataFrame:
    return metrics(D.impact(t.pairs, _removed(t), t.seeds, _targets(t)))


@query("D10", f"{reach_sql()} SELECT node, count(d) AS reached, count(*) FILTER (d > d0) AS longer, count(*) FILTER (d IS NULL) AS lost FROM y GROUP BY node")
def target_profiles(t: Tables) -> DataFrame:
    return D.target_profiles(t.pairs, _removed(t), t.seeds, _targets(t))


@query("D2 D25", """WITH rm AS (SELECT src, dst FROM edges WHERE is_predicted = 1 AND is_disclosed = 0), e AS (SELECT src, dst FROM edges x WHERE NOT EXISTS (SELECT 1 FROM rm WHERE (rm.src = x.src AND rm.dst = x.dst) OR (rm.src = x.dst AND rm.dst = x.src))), k(node, d) AS (SELECT node, 0 FROM seeds WHERE node IN (SELECT src FROM e UNION SELECT dst FROM e) UNION SELECT dst, d + 1 FROM k JOIN e ON src = k.node WHERE d < 6) SELECT node, min(d)::BIGINT AS dist FROM k GROUP BY node""")
def edge_removal_reach(t: Tables) -> DataFrame:
    gone = t.edges.where("is_predicted = 1 AND is_disclosed = 0").select(F.lit("x").alias("scenario"), "src", "dst")
    return D.scenario_distances(D.without_pairs(t.pairs, gone), t.seeds, 6).select("node", F.col("dist").cast("long").alias("dist"))


@query("D5 D6 T17")
def robustness_curve(t: Tables) -> DataFrame:
    ranked = G.degrees(t.nodes, t.pairs).select("node", F.col("degree").alias("value"))
    x = D.impact(t.pairs, D.robustness_scenarios(ranked, t.nodes, [10, 40], 2), t.seeds, _targets(t))
    return D.robustness_ratio(x, "n_lost")


@query("D7")
def greedy_interdiction(t: Tables) -> DataFrame:
    """Two rounds over the eight nodes that most nodes lead to."""
    short = [r.node for r in G.degrees(t.nodes, t.pairs).orderBy(F.desc("in_degree"), "node").limit(8).collect()]
    found = D.greedy(t.pairs, short, t.seeds, _targets(t), 2, cap=5)
    return t.spark.createDataFrame([(i + 1, n, round(v, 6)) for i, (n, v) in enumerate(found)], "round long, node long, weight_lost double")


@query("D14 A24", """WITH a AS (SELECT part_id, row_number() OVER (ORDER BY sum(cents) DESC, part_id) AS rank FROM rel GROUP BY 1 QUALIFY rank <= 50), b AS (SELECT part_id, row_number() OVER (ORDER BY count(*) DESC, part_id) AS rank FROM rel GROUP BY 1 QUALIFY rank <= 50)
SELECT coalesce(a.part_id, b.part_id) AS part_id, coalesce(a.rank, 51)::BIGINT AS rank_a, coalesce(b.rank, 51)::BIGINT AS rank_b FROM a FULL JOIN b ON a.part_id = b.part_id""")
def imputed_ranks(t: Tables) -> DataFrame:
    g = t.rel.groupBy("part_id").agg(F.sum("cents").alias("cents"), F.count("*").alias("n"))
    tops = []
    for c in ("cents", "n"):
        top = g.orderBy(F.desc(c), "part_id").limit(50)
        tops.append(top.select("part_id", F.row_number().over(Window.orderBy(F.desc(c), "part_id")).cast("long").alias("rank")))
    return D.imputed_ranks(*tops, "part_id", "rank")


@query("D14 A25", """WITH a AS (SELECT part_id, row_number() OVER (ORDER BY sum(cents) DESC, part_id) AS rank FROM rel GROUP BY 1 QUALIFY rank <= 50), b AS (SELECT part_id, row_number() OVER (ORDER BY count(*) DESC, part_id) AS rank FROM rel GROUP BY 1 QUALIFY rank <= 50),
i AS (SELECT coalesce(a.rank, 51) AS a, coalesce(b.rank, 51) AS b, row_number() OVER (ORDER BY coalesce(a.rank, 51), coalesce(b.rank, 51), coalesce(a.part_id, b.part_id)) AS n FROM a FULL JOIN b ON a.part_id = b.part_id), p AS (SELECT sign(y.a - x.a) AS da, sign(y.b - x.b) AS db FROM i x JOIN i y ON x.n < y.n)
SELECT round(sum(da * db) / sqrt(count(*) FILTER (da <> 0) * count(*) FILTER (db <> 0)), 6) AS kendall FROM p""")
def kendall_of_top_lists(t: Tables) -> DataFrame:
    return D.kendall(imputed_ranks(t), "rank_a", "rank_b").select(F.round("kendall", 6).alias("kendall"))


@query("D15 A27 P35", """WITH v AS (SELECT supplier_id, flag AS view, sum(cents)::BIGINT AS metric FROM rel GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY metric DESC, supplier_id) AS rank FROM v), k AS (SELECT * FROM r WHERE rank <= 40)
SELECT supplier_id, count(DISTINCT view) AS n_views, min(rank) AS least_rank, max(metric) AS metric, max(metric) FILTER (view = 'A') AS "A", max(metric) FILTER (view = 'N') AS "N", max(metric) FILTER (view = 'R') AS "R", CASE WHEN max(metric) >= 900000000 AND count(DISTINCT view) >= 2 THEN 'act' WHEN max(metric) >= 900000000 THEN 'verify' WHEN count(DISTINCT view) >= 2 THEN 'monitor' ELSE 'watch' END AS bucket FROM k GROUP BY supplier_id""")
def action_matrix(t: Tables) -> DataFrame:
    v = t.rel.groupBy("supplier_id", F.col("flag").alias("view")).agg(F.sum("cents").alias("metric"))
    k = v.withColumn("rank", F.row_number().over(Window.partitionBy("view").orderBy(F.desc("metric"), "supplier_id")).cast("long")).where("rank <= 40")
    return D.action_matrix(k, "supplier_id", "view", "metric", ["A", "N", "R"], 900000000, 2)


RULES = [("ECONOMY", "s1", 1, "include", None), ("STANDARD", "s2", 2, "include", "big"), ("STANDARD", "s2", 2, "exclude", "small"), ("PROMO", "s1", 1, "exclude", None), ("PROMO", "s1", 1, "include", "big"), ("LARGE", "s2", 2, "exclude", "unknown_gate")]
RULES_SQL = "r(code, system, priority, action, gate) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in RULES) + ")"


@query("D17 D18 A17", f"""WITH {RULES_SQL}, i AS (SELECT p_partkey AS item, p_type AS code, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS g FROM part), h AS (SELECT item, r.*, min(priority) OVER (PARTITION BY item) AS lead FROM i JOIN r ON i.code = r.code WHERE gate IS NULL OR gate = g),
b AS (SELECT item, min(system) AS system, bool_or(action = 'include') AS inc, bool_or(action = 'exclude') AS exc FROM h WHERE priority = lead GROUP BY item)
SELECT i.item, system, CASE WHEN inc AND exc THEN 'conflict' WHEN inc THEN 'include' WHEN exc THEN 'exclude' ELSE 'none' END AS decision FROM i LEFT JOIN b ON i.item = b.item""")
def rule_decisions(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame(RULES, "code string, system string, priority int, action string, gate string")
    items = t.part.select(F.col("p_partkey").alias("item"), F.col("p_type").alias("code"), F.array(F.when(F.col("p_size") > 25, "big").otherwise("small")).alias("gates"))
    return D.rule_decisions(items, rules)


@query("D21 A30 V6", "SELECT p_partkey AS key, 'warning' AS level, 'p_size out of range' AS issue FROM part WHERE p_size NOT BETWEEN 5 AND 45 UNION ALL SELECT p_partkey, 'warning', 'p_retailprice out of range' FROM part WHERE p_retailprice NOT BETWEEN 901 AND 1090")
def record_issues(t: Tables) -> DataFrame:
    return D.issues(t.part.withColumnRenamed("p_partkey", "key"), "key", ["p_name", "p_brand"], {"p_size": (5, 45), "p_retailprice": (901, 1090)})


@query("D22 K9")
def record_documents(t: Tables) -> DataFrame:
    return D.records(t.supplier, "s_suppkey", F.desc("s_acctbal"), "s_name")


@query("D23", "WITH u AS (SELECT src AS node, 'out' AS direction, dst AS other FROM edges UNION SELECT dst, 'in', src FROM edges) SELECT node, direction, count(*) AS n, string_agg(other::VARCHAR, '|' ORDER BY other) AS neighbours FROM u GROUP BY 1, 2")
def dependency_index(t: Tables) -> DataFrame:
    return D.dependencies(t.pairs)


@query("D24", "WITH o AS (SELECT src, count(*) AS n FROM edges GROUP BY 1), i AS (SELECT dst, count(*) AS n FROM edges GROUP BY 1), g AS (SELECT node, coalesce(o.n, 0) + coalesce(i.n, 0) AS degree FROM nodes LEFT JOIN o ON node = o.src LEFT JOIN i ON node = i.dst) SELECT e.dst, e.src, row_number() OVER (PARTITION BY e.dst ORDER BY degree DESC, e.src)::BIGINT AS rank FROM edges e JOIN g ON e.src = g.node WHERE e.dst IN (SELECT node FROM seeds) QUALIFY rank <= 10")
def focal_neighbours(t: Tables) -> DataFrame:
    """The ten best-ranked upstream neighbours of each seed."""
    d = G.degrees(t.nodes, t.pairs)
    x = t.pairs.join(t.seeds, F.col("dst") == F.col("node"), "left_semi").join(d, F.col("src") == F.col("node"))
    w = Window.partitionBy("dst").orderBy(F.desc("degree"), "src")
    return x.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("dst", "src", F.col("rank").cast("long").alias("rank"))


@query("D26")
def fragmentation(t: Tables) -> DataFrame:
    top = G.degrees(t.nodes, t.pairs).orderBy(F.desc("degree"), "node").limit(20).select("node")
    return D.fragmentation(t.nodes.select("node"), t.pairs, top)


@query("D25 C13")
def seam_harm(t: Tables) -> DataFrame:
    """What the loss of the five cut nodes that split most off the shipped edges does over all edges."""
    e = t.edges.where("is_shipping = 1 AND is_disclosed = 0").select("src", "dst")
    s = K.seams(e, G.weak_components(t.nodes, e)).where("kind = 'node'").orderBy(F.desc("second"), "a").limit(5)
    return D.impact(t.pairs, s.select(F.concat(F.lit("n"), F.col("a").cast("string")).alias("scenario"), F.col("a").alias("node")), t.seeds, _targets(t)).select("scenario", "n_targets", "n_lost")


# --- resolution -----------------------------------------------------------------------------------------------


@query("J17 U2 U3 U5 U6")
def fuzzy_matches(t: Tables) -> DataFrame:
    left = t.part.select("p_partkey", "p_brand", F.upper("p_name").alias("name"))
    right = t.part.select("p_brand", F.upper("p_name").alias("name")).distinct()
    x = V.blocked_pairs(left, right, ["p_brand"], 3).withColumn("score", F.round(V.ratio("name", "other_name"), 6))
    return V.accepted(x, "p_partkey", "score", "other_name", 0.8).select("p_partkey", "other_name", "score", "status")


@query("J18")
def token_candidates(t: Tables) -> DataFrame:
    left = t.part.select(F.col("p_name").alias("name")).distinct()
    return V.token_pairs(left, left)


@query("U1", "SELECT s_suppkey, n_name AS nation, 'second' AS matched_by FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def exact_cascade(t: Tables) -> DataFrame:
    left = t.supplier.select("s_suppkey", F.col("s_name").alias("first"), F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("second"))
    right = t.nation.select(F.col("n_name").alias("name"), F.col("n_name").alias("nation"))
    return V.exact_cascade(left, right, ["first", "second"], "nation").select("s_suppkey", "nation", "matched_by")


@query("V10", "SELECT 'all' AS stage, count(*) AS n FROM rel UNION ALL SELECT 'closed', count(*) FILTER (end_date IS NOT NULL) FROM rel UNION ALL SELECT 'forward', count(*) FILTER (end_date >= start_date) FROM rel")
def cleaning_funnel(t: Tables) -> DataFrame:
    stages = F.array_compact(F.array(F.lit("all"), F.when(F.col("end_date").isNotNull(), "closed"), F.when(F.col("end_date") >= F.col("start_date"), "forward")))
    return t.rel.select(F.explode(stages).alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))


@query("U10", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 100 GROUP BY 1")
def named_parameters(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT c_mktsegment, count(*) AS n FROM {customer} WHERE c_acctbal > :least GROUP BY 1", args={"least": 100}, customer=t.customer)


