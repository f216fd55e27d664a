"""Queries: ranking evaluation, calibration, selection, heuristics, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import embeddings as M
from ..operators import graph as G
from ..operators import ranking as R
from ..sources.readers import only_ids, parquet
from .fixtures import Tables
from .registry import query


@query("W3 J16 O6 A27", """WITH known AS (SELECT DISTINCT src, dst FROM scores WHERE label = 1), r AS (SELECT src, dst, points, row_number() OVER (PARTITION BY src ORDER BY points DESC, dst) AS rank FROM scores)
SELECT r.src, r.dst, points, rank, k.src IS NOT NULL AS is_known FROM r LEFT JOIN known k ON r.src = k.src AND r.dst = k.dst WHERE rank <= 5""")
def topk_new_links(t: Tables) -> DataFrame:
    x = R.top_k(t.scores, 5, score="points")  # what is known is in the row: no second pass over the scores
    return x.select("src", "dst", "points", F.col("rank").cast("long").alias("rank"), (F.col("label") == 1).alias("is_known"))


@query("W4 R11", """WITH f AS (SELECT * FROM scores WHERE points >= 2000), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY points DESC, dst) AS rs, row_number() OVER (PARTITION BY dst ORDER BY points DESC, src) AS rd FROM f) SELECT src, dst, points FROM r WHERE rs <= 5 AND rd <= 60""")
def topk_double_capped(t: Tables) -> DataFrame:
    return R.top_k_capped(t.scores, 5, 60, F.col("points") >= 2000, "points").select("src", "dst", "points")


@query("R11 O11", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY points DESC, dst) AS rs FROM scores), p(k, floor) AS (VALUES (1, 0), (5, 0), (10, 0), (5, 5000), (10, 5000))
SELECT k::BIGINT AS k, floor::BIGINT AS floor, count(*) AS selected, sum(label)::BIGINT AS tp, round(sum(label) / count(*)::DOUBLE, 6) AS precision FROM r JOIN p ON rs <= k AND points >= floor GROUP BY 1, 2""")
def policy_grid(t: Tables) -> DataFrame:
    """Ranked once; every policy is a filter on the same rows."""
    x = R.ranked(t.scores, "points")
    policies = [(1, 0), (5, 0), (10, 0), (5, 5000), (10, 5000)]
    hits = F.array_compact(F.array(*[F.when((F.col("rank") <= k) & (F.col("points") >= f), F.struct(F.lit(k).cast("long").alias("k"), F.lit(f).cast("long").alias("floor"))) for k, f in policies]))
    x = x.select("label", F.explode(hits).alias("p")).groupBy("p.k", "p.floor").agg(F.count("*").alias("selected"), F.sum("label").cast("long").alias("tp"))
    return x.withColumn("precision", F.round(F.col("tp") / F.col("selected"), 6))


@query("W5 R10", """WITH n AS (SELECT points, count(*) AS n, sum(label) AS pos FROM scores GROUP BY points), c AS (SELECT points, sum(pos) OVER w / sum(n) OVER w AS precision FROM n WINDOW w AS (ORDER BY points DESC ROWS UNBOUNDED PRECEDING)) SELECT coalesce(min(points) FILTER (precision >= 0.4), max(points)) AS threshold FROM c""")
def precision_threshold(t: Tables) -> DataFrame:
    return R.threshold_for(R.precision_thresholds(t.scores, "points"), 0.4, "points")


@query("W6 R1 R2 R3 T4 T6", """WITH r AS (SELECT src, dst, label, row_number() OVER o AS rank, sum(label) OVER (PARTITION BY src) AS total, sum(label) OVER (o ROWS UNBOUNDED PRECEDING) AS upto FROM scores WINDOW o AS (PARTITION BY src ORDER BY points DESC, dst)),
m AS (SELECT src, any_value(total) AS total, max(1.0 / rank) FILTER (label = 1) AS rr, coalesce(sum(upto / rank) FILTER (label = 1 AND rank <= 100), 0) AS ap, coalesce(sum(1 / log2(rank + 1)) FILTER (label = 1 AND rank <= 100), 0) AS dcg, count(*) FILTER (label = 1 AND rank <= 10) AS tp10 FROM r WHERE total > 0 GROUP BY src)
SELECT src, round(rr, 6) AS rr, round(ap / least(total, 100), 6) AS ap, round(dcg / list_sum(list_transform(range(1, least(total, 100)::BIGINT + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg, round(tp10 / 10.0, 6) AS p10, round(tp10 / total, 6) AS r10, CASE WHEN tp10 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit10 FROM m""")
def list_metrics(t: Tables) -> DataFrame:
    return R.list_metrics(t.scores, (10,), score="points").select("src", *[F.round(c, 6).alias(c) for c in ("rr", "ap", "ndcg", "p10", "r10")], "hit10")


@query("R1", """WITH r AS (SELECT src, label, n_lines = 1 AS one, row_number() OVER (PARTITION BY src ORDER BY points DESC, dst) AS rank, sum(label) OVER (PARTITION BY src) AS total FROM scores), m AS (SELECT src, max(1.0 / rank) FILTER (label = 1) AS rr FROM r WHERE total > 0 GROUP BY src) SELECT count(*) AS n, round(avg(rr), 6) AS mrr FROM m""")
def mean_reciprocal_rank(t: Tables) -> DataFrame:
    return R.list_metrics(t.scores, (10,), score="points").agg(F.count("*").alias("n"), F.round(F.avg("rr"), 6).alias("mrr"))


@query("W7 R13", "WITH d AS (SELECT *, ntile(10) OVER (ORDER BY points DESC, src, dst) AS tile FROM scores) SELECT tile, count(*) AS n, sum(label)::BIGINT AS positives, min(points) AS low, max(points) AS high FROM d GROUP BY tile")
def deciles(t: Tables) -> DataFrame:
    return R.deciles(t.scores, "points", ["src", "dst"]).groupBy("tile").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("positives"), F.min("points").alias("low"), F.max("points").alias("high"))


@query("W8", """WITH n AS (SELECT points, count(*) AS n, sum(label) AS pos FROM scores GROUP BY points), c AS (SELECT points, sum(pos) OVER w AS tp, sum(pos) OVER w / sum(n) OVER w AS precision FROM n WINDOW w AS (ORDER BY points DESC ROWS UNBOUNDED PRECEDING)), x AS (SELECT *, tp / max(tp) OVER () AS recall FROM c)
SELECT least(floor(recall * 20), 19)::BIGINT AS bucket, round(max(precision), 6) AS precision, round(arg_max(recall, (precision, points)), 6) AS recall FROM x GROUP BY 1""")
def precision_recall_curve(t: Tables) -> DataFrame:
    x = R.pr_curve(R.precision_thresholds(t.scores, "points"), 20, "points")
    return x.select(F.col("bucket").cast("long").alias("bucket"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("R8", "WITH n AS (SELECT points, count(*) AS n, sum(label) AS pos FROM scores GROUP BY points), x AS (SELECT pos * (coalesce(sum(n - pos) OVER (ORDER BY points ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n - pos) / 2.0) AS won, pos, n FROM n) SELECT round(sum(won) / (sum(pos) * sum(n - pos)), 6) AS auc FROM x")
def rank_sum_auc(t: Tables) -> DataFrame:
    return R.auc(t.scores, "points").select(F.round("auc", 6).alias("auc"))


@query("R5 R6 R7 P32")
def calibrated_by_fold(t: Tables) -> DataFrame:
    """Two folds by source: each is calibrated with the parameters of the other."""
    s = t.scores.withColumn("s", F.col("points") / 10007.0).withColumn("fold", F.pmod("src", F.lit(2)))
    out = None
    for f in (0, 1):
        a, b = R.platt_fit(s.where(F.col("fold") != f), "s")
        part = s.where(F.col("fold") == f).select("src", "dst", "label", F.round(X.platt("s", a, b), 6).alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


@query("R12", "WITH ship AS (SELECT DISTINCT customer_id AS src, supplier_id AS dst FROM rel WHERE flag = 'A'), r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY points DESC, dst) AS n FROM scores) SELECT count(*) AS selected, count(s.src) AS corroborated, round(count(s.src) / count(*)::DOUBLE, 6) AS share FROM r LEFT JOIN ship s ON r.src = s.src AND r.dst = s.dst WHERE n <= 5")
def corroboration(t: Tables) -> DataFrame:
    ship = t.rel.where("flag = 'A'").select(F.col("customer_id").alias("src"), F.col("supplier_id").alias("dst"))
    x = R.top_k(t.scores.select("src", "dst", "points"), 5, score="points", known=ship)
    return x.agg(F.count("*").alias("selected"), F.count_if("is_known").alias("corroborated"), F.round(F.avg(F.col("is_known").cast("double")), 6).alias("share"))


# --- heuristics ---------------------------------------------------------------------------------------------


@query("H1", """WITH b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), p AS (SELECT DISTINCT x.src AS u, y.dst AS v FROM b x JOIN b y ON x.dst = y.src WHERE x.src <> y.dst AND NOT EXISTS (SELECT 1 FROM b z WHERE z.src = x.src AND z.dst = y.dst)),
o AS (SELECT src AS n, count(*) AS d FROM edges GROUP BY 1), i AS (SELECT dst AS n, count(*) AS d FROM edges GROUP BY 1),
c AS (SELECT u, v, count(*) AS common, sum(1 / ln(greatest(i.d, 2))) AS aa, sum(1.0 / greatest(i.d, 1)) AS ra FROM p JOIN edges x ON x.src = u JOIN edges y ON y.src = v AND y.dst = x.dst JOIN i ON i.n = x.dst GROUP BY u, v)
SELECT p.u AS src, p.v AS dst, coalesce(common, 0)::BIGINT AS common, round(coalesce(aa, 0), 6) AS adamic_adar, round(coalesce(ra, 0), 6) AS allocation, round(CASE WHEN coalesce(a.d, 0) + coalesce(b2.d, 0) - coalesce(common, 0) > 0 THEN coalesce(common, 0) / (coalesce(a.d, 0) + coalesce(b2.d, 0) - coalesce(common, 0)) ELSE 0 END, 6) AS jaccard,
round(CASE WHEN coalesce(a.d, 0) > 0 AND coalesce(b2.d, 0) > 0 THEN coalesce(common, 0) / sqrt(a.d * b2.d) ELSE 0 END, 6) AS cosine, (coalesce(a.d, 0) * coalesce(i2.d, 0))::BIGINT AS attachment
FROM p LEFT JOIN c ON p.u = c.u AND p.v = c.v LEFT JOIN o a ON a.n = p.u LEFT JOIN o b2 ON b2.n = p.v LEFT JOIN i i2 ON i2.n = p.v""")
def pair_heuristics(t: Tables) -> DataFrame:
    x = R.pair_scores(G.two_hop(t.pairs), t.pairs)
    return x.select("src", "dst", "common", *[F.round(c, 6).alias(c) for c in ("adamic_adar", "allocation", "jaccard", "cosine")], "attachment")


@query("H2", "WITH w1 AS (SELECT node AS s, dst AS pos, 1.0::DOUBLE AS n FROM seeds JOIN edges ON src = node), w2 AS (SELECT s, dst AS pos, sum(n) AS n FROM w1 JOIN edges ON src = pos GROUP BY 1, 2), w3 AS (SELECT s, dst AS pos, sum(n) AS n FROM w2 JOIN edges ON src = pos GROUP BY 1, 2), u AS (SELECT s, pos, n * 1e-2 AS k FROM w1 UNION ALL SELECT s, pos, n * 1e-4 FROM w2 UNION ALL SELECT s, pos, n * 1e-6 FROM w3) SELECT s AS src, pos AS dst, round(sum(k)::DOUBLE, 9) AS katz FROM u GROUP BY 1, 2")
def katz_scores(t: Tables) -> DataFrame:
    return R.katz(t.pairs, t.seeds).withColumn("katz", F.round("katz", 9))


@query("H3 C6", None)
def pagerank_pair_features(t: Tables) -> DataFrame:
    r = G.pagerank(t.nodes, t.pairs)
    x = t.pairs.join(r.withColumnsRenamed({"node": "src", "rank": "a"}), "src").join(r.withColumnsRenamed({"node": "dst", "rank": "b"}), "dst")
    return x.select("src", "dst", F.round(F.col("a") * F.col("b"), 10).alias("product"), F.round(F.col("a") + F.col("b"), 8).alias("total"), F.round(F.abs(F.col("a") - F.col("b")), 8).alias("difference"))


@query("H5", "WITH b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), d AS (SELECT src, count(*) AS d FROM b GROUP BY src) SELECT CASE WHEN x.d >= 4 AND y.d >= 4 THEN 'warm' WHEN x.d < 4 AND y.d < 4 THEN 'cold' ELSE 'mixed' END AS pair_class, count(*) AS n FROM edges JOIN d x ON edges.src = x.src JOIN d y ON edges.dst = y.src GROUP BY 1")
def warm_and_cold(t: Tables) -> DataFrame:
    return R.pair_class(t.pairs, t.pairs, 4).groupBy("pair_class").agg(F.count("*").alias("n"))


@query("H6 V5 T8")
def candidate_pools(t: Tables) -> DataFrame:
    return R.candidate_pool(t.pairs, G.two_hop(t.pairs), t.nodes, t.pairs, 20)


@query("H8", """WITH z AS (SELECT node, nation, segment, balance, row_number() OVER (PARTITION BY segment, nation ORDER BY balance DESC, node) AS r1 FROM nodes), n AS (SELECT nation, count(*) AS n FROM nodes GROUP BY 1),
l AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY balance DESC, node) AS rn, row_number() OVER (ORDER BY balance DESC, node) AS ra FROM nodes),
c AS (SELECT s.node, x.node AS dst, x.rn AS r, 0 AS level FROM seeds s JOIN nodes m ON s.node = m.node JOIN n ON m.nation = n.nation AND n.n >= 55 JOIN l x ON x.nation = m.nation AND x.node <> s.node AND x.rn <= 6 UNION ALL SELECT s.node, x.node, x.ra, 1 FROM seeds s JOIN l x ON x.ra <= 6 AND x.node <> s.node),
b AS (SELECT *, min(level) OVER (PARTITION BY node) AS best FROM c), q AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY r) AS rank FROM b WHERE level = best) SELECT node, dst, level::BIGINT AS level, rank FROM q WHERE rank <= 5""")
def cascade_candidates(t: Tables) -> DataFrame:
    s = t.seeds.join(t.nodes, "node")
    return R.cascade_pool(s, t.nodes, ["nation"], 55, 5, "balance").select("node", "dst", F.col("level").cast("long").alias("level"), F.col("rank").cast("long").alias("rank"))


@query("H9 S16")
def degree_sample(t: Tables) -> DataFrame:
    return R.weighted_sample(G.degrees(t.nodes, t.pairs), F.pow(F.col("degree").cast("double"), F.lit(0.75)), 200, ["node"])


@query("H10", "SELECT DISTINCT segment AS attribute, node FROM nodes WHERE segment IS NOT NULL")
def attribute_index(t: Tables) -> DataFrame:
    return R.attribute_index(t.nodes, "segment")


@query("S18", "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS norm2 FROM embeddings")
def embedding_norms(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(F.aggregate(F.zip_with("embedding", "embedding", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, v: a + v), 5).alias("norm2"))


@query("A24 A25 D14 W9", """WITH a AS (SELECT dst, sum(points) AS v FROM scores GROUP BY 1), b AS (SELECT dst, count(*) AS v FROM scores GROUP BY 1), r AS (SELECT a.dst, rank() OVER (ORDER BY a.v) + (count(*) OVER (PARTITION BY a.v) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b.v) + (count(*) OVER (PARTITION BY b.v) - 1) / 2.0 AS rb FROM a JOIN b ON a.dst = b.dst) SELECT round(corr(ra, rb), 6) AS spearman FROM r""")
def rank_correlation(t: Tables) -> DataFrame:
    from ..operators.decisions import spearman

    x = t.scores.groupBy("dst").agg(F.sum("points").alias("a"), F.count("*").alias("b"))
    return spearman(x, "a", "b").select(F.round("spearman", 6).alias("spearman"))



@query("H14")
def embedding_axes(t: Tables) -> DataFrame:
    return M.principal(t.embeddings, "embedding", 2).select("vec_id", *[F.round(F.get("projected", F.lit(i)), 5).alias(f"axis{i + 1}") for i in (0, 1)])


@query("C24 O3", """WITH n AS (SELECT label, points, count(*) AS n FROM scores GROUP BY 1, 2) SELECT label::BIGINT AS label, count(*) AS distinct_scores, count(*) FILTER (n > 1) AS tied_scores, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS tied_rows, max(n) AS largest_tie FROM n GROUP BY label""")
def tie_blocks(t: Tables) -> DataFrame:
    n = t.scores.groupBy("label", "points").agg(F.count("*").alias("n"))
    tied = F.col("n") > 1
    return n.groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("distinct_scores"), F.count_if(tied).alias("tied_scores"), F.coalesce(F.sum(F.when(tied, F.col("n"))), F.lit(0)).alias("tied_rows"), F.max("n").alias("largest_tie"))


@query("S3 S14", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def lines_of_finished_orders(t: Tables) -> DataFrame:
    ids = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return only_ids(t.lineitem, ids, "l_orderkey").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@query("S4 S5", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def pruned_scan(t: Tables) -> DataFrame:
    return parquet(t.spark, f"{t.sf_dir}/orders.parquet", ["o_orderstatus", "o_orderpriority"]).groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
