"""Views that the registered queries share, over whole driver tables: one SQL text for Spark and for DuckDB."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: Relationship episodes: one for each order line, supplier to customer; every third line is open.
REL = """
SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS rel_id, l_suppkey AS supplier_id, o_custkey AS customer_id,
       CAST(o_orderdate AS DATE) AS start_date, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS end_date,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_partkey AS part_id, l_returnflag AS flag
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""
#: A sparse directed graph of customers, two links from each, with evidence flags.
EDGES = """
SELECT src, dst, max(is_disclosed) AS is_disclosed, max(is_shipping) AS is_shipping, max(is_predicted) AS is_predicted
FROM (SELECT c_custkey AS src, CAST(floor(abs(c_acctbal) * 7) AS BIGINT) % n AS dst,
             CASE WHEN c_nationkey % 3 <> 1 THEN 1 ELSE 0 END AS is_disclosed,
             CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 0 END AS is_shipping, 0 AS is_predicted
      FROM {customer}, (SELECT count(*) AS n FROM {customer}) AS t
      UNION ALL
      SELECT c_custkey, (c_custkey * 31 + 17) % n, CASE WHEN c_nationkey % 5 = 0 THEN 1 ELSE 0 END, 0,
             CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE 1 END
      FROM {customer}, (SELECT count(*) AS n FROM {customer}) AS t) AS u
WHERE src <> dst GROUP BY src, dst
"""
#: Scored candidate pairs, customer to supplier; integer scores, so both engines rank alike.
SCORES = """
SELECT o_custkey AS src, l_suppkey AS dst, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label,
       CAST(sum(CAST(round(l_discount * 100) AS BIGINT) * 997 + l_partkey % 991) % 10007 AS BIGINT) AS points,
       CAST(count(*) AS BIGINT) AS n_lines
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey
"""
SEEDS = "SELECT c_custkey AS node FROM {customer} WHERE c_nationkey = 0 AND c_mktsegment = 'HOUSEHOLD'"
ANCHORS = "SELECT c_custkey AS node FROM {customer} WHERE c_nationkey = 1 AND c_mktsegment = 'BUILDING'"
NODES = "SELECT c_custkey AS node, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM {customer}"
VIEWS = {"rel": REL, "edges": EDGES, "scores": SCORES, "seeds": SEEDS, "anchors": ANCHORS, "nodes": NODES}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"]


class Tables:
    """The driver's tables and the shared views of one folder, as DataFrames that are read when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in VIEWS:
            used = {t: getattr(self, t) for t in TABLES if f"{{{t}}}" in VIEWS[name]}
            df = self.spark.sql(VIEWS[name], **used)
        else:
            raise AttributeError(name)
        setattr(self, name, df)
        return df

    @cached_property
    def pairs(self) -> DataFrame:
        return self.edges.select("src", "dst")


def oracle(body: str) -> str:
    """The SQL of a query behind the views that it names."""
    body = body.strip()
    used = [f"{v} AS ({VIEWS[v].format(**{t: t for t in TABLES}).strip()})" for v in VIEWS if f" {v} " in f" {body} ".replace("\n", " ").replace(",", " ").replace(")", " ").replace("(", " ").replace(".", " . ")]
    if not used:
        return "WITH RECURSIVE " + body[5:] if body.startswith("WITH ") else body
    return "WITH RECURSIVE " + ",\n".join(used) + (",\n" + body[5:] if body.startswith("WITH ") else "\n" + body)
