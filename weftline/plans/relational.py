"""Queries: events, projections, joins, aggregates, windows, set operations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import events as E
from ..operators import tables as O
from ..operators.order import competition
from .fixtures import Tables
from .registry import query

RUN, EARLY = date(2002, 1, 1), date(1993, 1, 1)


def _clean(t: Tables) -> DataFrame:
    rel = t.rel.withColumnsRenamed({"supplier_id": "src", "customer_id": "dst"})
    return E.clean(rel, EARLY, RUN)


CLEAN = """clean AS (SELECT rel_id, supplier_id AS src, customer_id AS dst, start_date, end_date, cents, part_id, flag,
  date_diff('day', start_date, coalesce(end_date, DATE '2002-01-01')) AS duration_days FROM rel
  WHERE supplier_id <> customer_id AND start_date >= DATE '1993-01-01' AND coalesce(end_date, DATE '2002-01-01') >= start_date)"""


@query("P1 P2 P3 P4", f"WITH {CLEAN} SELECT rel_id, src, dst, start_date, CAST(duration_days AS BIGINT) AS duration_days, CAST(year(start_date) AS BIGINT) AS y, CAST(month(start_date) AS BIGINT) AS m, CAST(quarter(start_date) AS BIGINT) AS q, CAST(date_diff('day', DATE '1970-01-01', start_date) AS BIGINT) AS ts, CAST(date_diff('day', (SELECT min(start_date) FROM clean), start_date) AS BIGINT) AS since FROM clean")
def event_times(t: Tables) -> DataFrame:
    x = E.time_columns(_clean(t))
    return x.select("rel_id", "src", "dst", "start_date", *[F.col(a).cast("long").alias(b) for a, b in (("duration_days", "duration_days"), ("year", "y"), ("month", "m"), ("quarter", "q"), ("ts", "ts"), ("timestamp", "since"))])


@query("O9", f"WITH {CLEAN}, r AS (SELECT *, row_number() OVER (PARTITION BY src, dst, start_date, end_date ORDER BY rel_id, cents, part_id, flag) AS n FROM clean) SELECT rel_id, src, dst, start_date, end_date, cents FROM r WHERE n = 1")
def episode_dedup(t: Tables) -> DataFrame:
    x = _clean(t).select("rel_id", "src", "dst", "start_date", "end_date", "cents", "part_id", "flag")
    return E.first_of_each(x, ["src", "dst", "start_date", "end_date"], ["rel_id"]).select("rel_id", "src", "dst", "start_date", "end_date", "cents")


@query("P5", "SELECT rel_id, substr(sha1(supplier_id::VARCHAR || '|' || customer_id || '|' || strftime(start_date, '%Y-%m-%dT%H:%M:%S') || '|' || coalesce(strftime(end_date, '%Y-%m-%dT%H:%M:%S'), '')), 1, 16) AS event_id FROM rel")
def event_hash_ids(t: Tables) -> DataFrame:
    return t.rel.select("rel_id", X.short_hash("supplier_id", "customer_id", F.date_format("start_date", "yyyy-MM-dd'T'HH:mm:ss"), F.coalesce(F.date_format("end_date", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))).alias("event_id"))


@query("P6 V2 O8", f"WITH {CLEAN} SELECT CASE WHEN start_date <= DATE '1997-12-31' THEN 'train' WHEN start_date BETWEEN DATE '1998-04-01' AND DATE '1998-12-31' THEN 'val' WHEN start_date BETWEEN DATE '1999-04-01' AND DATE '2001-12-31' THEN 'test' ELSE 'gap' END AS split, count(*) AS n, min(start_date) AS first, max(start_date) AS last, count(DISTINCT rel_id) AS ids FROM clean GROUP BY 1")
def temporal_splits(t: Tables) -> DataFrame:
    split = E.split_column("start_date", date(1997, 12, 31), (date(1998, 4, 1), date(1998, 12, 31)), (date(1999, 4, 1), date(2001, 12, 31)))
    return _clean(t).groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.min("start_date").alias("first"), F.max("start_date").alias("last"), F.countDistinct("rel_id").alias("ids"))


@query("P7 P8 T9", "SELECT supplier_id, count(*) FILTER (start_date <= DATE '1997-06-30' AND (end_date IS NULL OR end_date > DATE '1997-06-30')) AS half_open, count(*) FILTER (start_date <= DATE '1997-06-30' AND (end_date IS NULL OR end_date >= DATE '1997-06-30')) AS closed FROM rel GROUP BY supplier_id")
def active_as_of(t: Tables) -> DataFrame:
    at = F.lit(date(1997, 6, 30))
    x = t.rel.withColumn("days", F.datediff("end_date", "start_date"))
    return x.groupBy("supplier_id").agg(F.count_if(X.active_half_open("start_date", "end_date", at)).alias("half_open"), F.count_if(X.active_closed("start_date", "days", at)).alias("closed"))


@query("P9 P10 A9", "SELECT supplier_id AS src, customer_id AS dst, count(*) AS shipments, min(start_date) AS first, max(start_date) AS last FROM rel WHERE start_date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' AND flag IN ('A', 'R') GROUP BY 1, 2")
def shipping_edges(t: Tables) -> DataFrame:
    x = t.rel.where(F.col("start_date").between(F.lit(date(1995, 1, 1)), F.lit(date(1998, 12, 31))) & F.col("flag").isin("A", "R"))
    return x.groupBy(F.col("supplier_id").alias("src"), F.col("customer_id").alias("dst")).agg(F.count("*").alias("shipments"), F.min("start_date").alias("first"), F.max("start_date").alias("last"))


@query("P11 P12", "SELECT p_brand, count(*) FILTER (lower(p_name) LIKE '%red%' OR lower(p_name) LIKE '%blue%') AS named, count(*) FILTER (regexp_matches(p_name, '(?i)widget|ring') OR regexp_matches(p_type, '(?i)eco')) AS keyword FROM part GROUP BY p_brand")
def name_filters(t: Tables) -> DataFrame:
    like = F.lower("p_name").like("%red%") | F.lower("p_name").like("%blue%")
    return t.part.groupBy("p_brand").agg(F.count_if(like).alias("named"), F.count_if(X.any_of([F.col("p_name").rlike("(?i)widget|ring"), F.col("p_type").rlike("(?i)eco")])).alias("keyword"))


@query("P13 P14", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE c_mktsegment END, ''), nullif(CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE 'n' || c_nationkey END, ''), c_name) AS id_key, coalesce(nullif(trim(CASE WHEN c_nationkey % 3 = 0 THEN '  ' ELSE c_mktsegment END), ''), c_name) AS first_filled FROM customer")
def identity_keys(t: Tables) -> DataFrame:
    a = F.when(F.col("c_nationkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    b = F.when(F.col("c_nationkey") % 2 == 0, "").otherwise(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    blank = F.when(F.col("c_nationkey") % 3 == 0, "  ").otherwise(F.col("c_mktsegment"))
    return t.customer.select("c_custkey", X.identity_key(a, b, "c_name").alias("id_key"), X.first_filled(blank, "c_name").alias("first_filled"))


@query("P15 P16 P23 P24", "SELECT c_custkey, 'ent:' || c_custkey AS uid, regexp_replace('ent:' || c_custkey, '^[a-z]+:', '') AS id, lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '_', 'g')) AS slug, trim(string_split('A > B > ' || c_mktsegment, '>')[-1]) AS leaf, regexp_replace(c_nationkey || '.0', '\\.0$', '') AS code FROM customer")
def names_and_keys(t: Tables) -> DataFrame:
    u = X.uid("ent", "c_custkey")
    return t.customer.select("c_custkey", u.alias("uid"), X.uid_key(u).alias("id"), X.slug("c_name").alias("slug"), X.last_of_path(F.concat(F.lit("A > B > "), "c_mktsegment")).alias("leaf"), X.code_value(F.concat(F.col("c_nationkey").cast("string"), F.lit(".0"))).alias("code"))


NAMES = "names AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name || ', Inc.' WHEN 1 THEN s_name || ' Limited Inc' WHEN 2 THEN 'The ' || s_name || ' L.L.C. Co' ELSE s_name || ' Holding GmbH' END AS name FROM supplier)"
ENDS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(upper(name)), ' INC$', ''), ' CORP$', ''), ' CORPORATION$', ''), ' LLC$', ''), ' LP$', ''), ' CO$', ''), ' COMPANY$', ''), ' LTD$', ''), ' LIMITED$', '')"


@query("P17 P18 P19 P20 T1", rf"""WITH {NAMES}, v AS (SELECT *, trim(regexp_replace(regexp_replace({ENDS}, '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS v2 FROM names)
SELECT s_suppkey, trim(regexp_replace(regexp_replace(regexp_replace(upper(name), '[^A-Z0-9 ]+', ' ', 'g'), '\b(INCORPORATED|INC|LLC|L.L.C|CORPORATION|CORP|CO|COMPANY|LTD|LIMITED|SA|AG|BV|GMBH|SPA|S.P.A|PLC)\b', ' ', 'g'), '\s+', ' ', 'g')) AS v1, v2,
  array_to_string(list_filter(string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '' AND x NOT IN ('co', 'gmbh', 'holding', 'inc')), ' ') AS v3,
  array_to_string(list_filter(string_split(v2, ' '), lambda x: x <> 'THE' AND len(x) > 2), ' ') AS words FROM v""")
def company_names(t: Tables) -> DataFrame:
    n = F.expr("CASE s_suppkey % 4 WHEN 0 THEN s_name || ', Inc.' WHEN 1 THEN s_name || ' Limited Inc' WHEN 2 THEN 'The ' || s_name || ' L.L.C. Co' ELSE s_name || ' Holding GmbH' END")
    end = X.company_name_end(n)
    return t.supplier.select("s_suppkey", X.company_name(n).alias("v1"), end.alias("v2"), F.array_join(X.name_tokens(n), " ").alias("v3"), F.array_join(X.keywords(end), " ").alias("words"))


@query("P21 P22", "SELECT n_nationkey, coalesce(CASE r_name WHEN 'AFRICA' THEN 'AF' WHEN 'AMERICA' THEN 'AM' END, substr(r_name, 1, 2)) AS code, coalesce(CASE r_name WHEN 'AFRICA' THEN 'South' WHEN 'EUROPE' THEN 'North' END, 'Unknown') AS half FROM nation JOIN region ON n_regionkey = r_regionkey")
def country_recode(t: Tables) -> DataFrame:
    x = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.select("n_nationkey", X.recode("r_name", {"AFRICA": "AF", "AMERICA": "AM"}, F.substring("r_name", 1, 2)).alias("code"), X.recode("r_name", {"AFRICA": "South", "EUROPE": "North"}, F.lit("Unknown")).alias("half"))


@query("P25", "SELECT p_partkey, lpad(CAST(CAST(round_even((p_size - 1) / 49.0 * 9899 + 100, 0) AS INTEGER) AS VARCHAR), 4, '0') AS sic FROM part")
def padded_codes(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.padded_code((F.col("p_size") - 1) / F.lit(49.0)).alias("sic"))


@query("P26 P27 U8", "WITH l AS (SELECT o_custkey, string_split(o_orderstatus || '|' || o_orderpriority, '|') AS parts FROM orders), x AS (SELECT DISTINCT o_custkey, trim(unnest(parts)) AS part FROM l) SELECT o_custkey, string_agg(part, '|' ORDER BY part) AS parts, count(*) AS n FROM x WHERE part <> '' GROUP BY o_custkey")
def pipe_lists(t: Tables) -> DataFrame:
    x = t.orders.withColumn("list", F.concat_ws("|", "o_orderstatus", "o_orderpriority"))
    return x.groupBy("o_custkey").agg(X.pipe_union("list").alias("parts")).withColumn("n", F.size(F.split("parts", r"\|")).cast("long"))


@query("P28 P29 T5", "WITH tr AS (SELECT * FROM customer WHERE c_nationkey < 20), codes AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) AS code FROM (SELECT DISTINCT c_mktsegment FROM tr)), mm AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM tr) SELECT c_custkey, coalesce(code, 0)::BIGINT AS code, round((c_acctbal - lo) / (hi - lo), 6) AS scaled FROM customer LEFT JOIN codes USING (c_mktsegment), mm")
def train_encoding(t: Tables) -> DataFrame:
    train = F.col("c_nationkey") < 20
    x = O.train_minmax(O.train_codes(t.customer, "c_mktsegment", train, "code"), "c_acctbal", train, "scaled")
    return x.select("c_custkey", F.col("code").cast("long").alias("code"), F.round("scaled", 6).alias("scaled"))


@query("P30 P31", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 5) AS z, round(ln(1 + greatest(c_acctbal, 0)), 6) AS logged FROM customer")
def standardised(t: Tables) -> DataFrame:
    return O.zscore(t.customer, "c_acctbal", "z").select("c_custkey", F.round("z", 5).alias("z"), F.round(F.log1p(F.greatest("c_acctbal", F.lit(0.0))), 6).alias("logged"))


@query("P32 P33 R9", "SELECT src, dst, round(CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END, 6) AS p FROM (SELECT src, dst, points / 10007.0 * 4.5 + n_lines * -0.25 - 1.5 AS z FROM scores)")
def meta_probability(t: Tables) -> DataFrame:
    x = t.scores.withColumn("s", F.col("points") / 10007.0)
    return x.select("src", "dst", F.round(X.sigmoid(X.linear_logit(-1.5, {"s": 4.5, "n_lines": -0.25})), 6).alias("p"))


@query("P34 P35", "WITH d AS (SELECT supplier_id, CASE WHEN x IS NULL OR x < 0 THEN 0 WHEN x < 31 THEN 1 WHEN x < 91 THEN 2 WHEN x < 182 THEN 3 WHEN x < 365 THEN 4 WHEN x < 730 THEN 5 WHEN x < 1095 THEN 6 WHEN x < 1825 THEN 7 ELSE 8 END AS h, CASE WHEN cents >= 5000000 THEN 'high' WHEN cents >= 2000000 THEN 'medium' ELSE 'low' END AS band FROM (SELECT supplier_id, cents, date_diff('day', start_date, end_date) AS x FROM rel)) SELECT h::BIGINT AS h, band, count(*) AS n FROM d GROUP BY h, band")
def horizons_and_bands(t: Tables) -> DataFrame:
    h, band = X.horizon(F.datediff("end_date", "start_date")), X.banded("cents", [(5000000, "high"), (2000000, "medium")], "low")
    return t.rel.groupBy(h.cast("long").alias("h"), band.alias("band")).agg(F.count("*").alias("n"))


@query("P36 P37 P38", "SELECT src, dst, CASE WHEN is_predicted = 1 AND is_disclosed = 0 AND is_shipping = 0 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS cost, greatest(0.0::DOUBLE, CASE WHEN is_disclosed = 1 THEN 1.0::DOUBLE ELSE 0 END, CASE WHEN is_shipping = 1 THEN 0.8::DOUBLE ELSE 0 END, CASE WHEN is_predicted = 1 THEN 0.5::DOUBLE ELSE 0 END) AS weight FROM edges")
def edge_weights(t: Tables) -> DataFrame:
    only = (F.col("is_predicted") == 1) & (F.col("is_disclosed") == 0) & (F.col("is_shipping") == 0)
    return t.edges.select("src", "dst", F.when(only, 3.0).otherwise(1.0).alias("cost"), X.evidence_weight({"is_disclosed": 1.0, "is_shipping": 0.8, "is_predicted": 0.5}).alias("weight"))


@query("P39 P40 P44", "WITH x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '1,' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') WHEN 1 THEN p_size || '%' WHEN 2 THEN 'bad' ELSE p_size::VARCHAR END AS s, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '; ' || p_type ELSE p_brand || ',' || p_type || ',' END AS l FROM part) SELECT p_partkey, round(CASE WHEN s LIKE '%\\%' ESCAPE '\\' THEN TRY_CAST(replace(s, '%', '') AS DOUBLE) / 100 ELSE TRY_CAST(replace(s, ',', '') AS DOUBLE) END, 6) AS v, array_to_string(list_filter(list_transform(string_split(l, CASE WHEN l LIKE '%;%' THEN ';' ELSE ',' END), lambda e: trim(e)), lambda e: e <> ''), '|') AS items FROM x")
def parsed_fields(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    size = F.col("p_size").cast("string")
    s = F.when(k == 0, F.concat(F.lit("1,"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"))).when(k == 1, F.concat(size, F.lit("%"))).when(k == 2, "bad").otherwise(size)
    lists = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("; ", "p_brand", "p_type")).otherwise(F.concat(F.concat_ws(",", "p_brand", "p_type"), F.lit(",")))
    return t.part.select("p_partkey", F.round(X.number(s), 6).alias("v"), F.array_join(X.items(lists), "|").alias("items"))


@query("P41 P43 P45 P46", "SELECT dst AS src, src AS dst, coalesce(is_disclosed, 0)::BIGINT AS disclosed, 0::BIGINT AS slice, 'candidate' AS source FROM edges")
def flipped_candidates(t: Tables) -> DataFrame:
    x = t.edges.withColumnRenamed("is_disclosed", "IsDisclosed")
    flag = F.coalesce(X.column_of(x, ["disclosed", "isdisclosed"]), F.lit(0))
    return x.select(F.col("dst").alias("src"), F.col("src").alias("dst"), flag.cast("long").alias("disclosed"), F.lit(0).cast("long").alias("slice"), F.lit("candidate").alias("source"))


@query("P42")
def stable_hashes(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", X.fnv1a("n_name").alias("h"))


# --- joins --------------------------------------------------------------------------------------------------


@query("J1 V3", "WITH ids AS (SELECT supplier_id AS id FROM rel UNION SELECT customer_id FROM rel), ix AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS node_id FROM ids) SELECT rel_id, a.node_id AS src_id, b.node_id AS dst_id FROM rel LEFT JOIN ix a ON supplier_id = a.id LEFT JOIN ix b ON customer_id = b.id")
def indexed_edges(t: Tables) -> DataFrame:
    ids = t.rel.select(F.col("supplier_id").alias("raw_id")).union(t.rel.select("customer_id"))
    x = t.rel.select("rel_id", F.col("supplier_id").alias("src"), F.col("customer_id").alias("dst"))
    return E.map_both(x, E.entity_index(ids)).select("rel_id", "src_id", "dst_id")


@query("J2 J9 J20", "SELECT l_orderkey, l_linenumber, s_name, c_name, l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_acctbal > 5000 AND c_acctbal > 5000")
def covered_lines(t: Tables) -> DataFrame:
    x = t.lineitem.join(t.supplier.where("s_acctbal > 5000"), F.col("l_suppkey") == F.col("s_suppkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.join(t.customer.where("c_acctbal > 5000"), F.col("o_custkey") == F.col("c_custkey")).select("l_orderkey", "l_linenumber", "s_name", "c_name", "l_partkey")


@query("J3 J4 J5 A11", "WITH a AS (SELECT src, dst, max(points) AS a FROM scores GROUP BY 1, 2), b AS (SELECT o_custkey AS src, l_suppkey AS dst, round(avg(l_quantity), 4) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A' GROUP BY 1, 2) SELECT a.src, a.dst, a.a::DOUBLE AS a, coalesce(b, 0.0) AS b FROM a LEFT JOIN b ON a.src = b.src AND a.dst = b.dst")
def score_tables_joined(t: Tables) -> DataFrame:
    b = t.lineitem.where("l_returnflag = 'A'").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.round(F.avg("l_quantity"), 4).alias("v"))
    return O.joined_scores(t.scores.select("src", "dst"), {"a": t.scores.select("src", "dst", F.col("points").cast("double").alias("v")), "b": b}, ["src", "dst"], "v", 0.0)


@query("J6 J8 T10", "SELECT src, dst FROM edges WHERE src IN (SELECT node FROM seeds) OR dst IN (SELECT node FROM seeds)")
def anchored_edges(t: Tables) -> DataFrame:
    return O.either_end_in(t.pairs, t.seeds, "node")


@query("J7 J8 S11", "SELECT s_suppkey, s_name FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 49)")
def anti_join(t: Tables) -> DataFrame:
    return t.supplier.join(t.lineitem.where("l_returnflag = 'R' AND l_quantity > 49"), F.col("s_suppkey") == F.col("l_suppkey"), "left_anti").select("s_suppkey", "s_name")


@query("J10 J11", "WITH par AS (SELECT node AS child, node // 10 * 10 AS parent FROM nodes WHERE nation < 12) SELECT coalesce(a.parent, src) AS src, coalesce(b.parent, dst) AS dst, count(*) AS n FROM edges LEFT JOIN par a ON src = a.child LEFT JOIN par b ON dst = b.child GROUP BY 1, 2")
def parent_rollup(t: Tables) -> DataFrame:
    parents = t.nodes.where("nation < 12").select(F.col("node").alias("child"), F.expr("node div 10 * 10").alias("parent"))
    return O.rollup_parents(t.pairs, parents).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("J12 D20", "WITH a AS (SELECT p_partkey FROM part WHERE p_size > 30), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount > 0.08) SELECT coalesce(p_partkey, l_partkey) AS part, p_partkey IS NOT NULL AS by_size, l_partkey IS NOT NULL AS by_discount, CASE WHEN p_partkey IS NOT NULL AND l_partkey IS NOT NULL THEN 'both' WHEN p_partkey IS NOT NULL THEN 'size' ELSE 'discount' END AS source FROM a FULL JOIN b ON p_partkey = l_partkey")
def catalogs_merged(t: Tables) -> DataFrame:
    a = t.part.where("p_size > 30").select(F.col("p_partkey").alias("part"), F.lit(True).alias("by_size"))
    b = t.lineitem.where("l_discount > 0.08").select(F.col("l_partkey").alias("part"), F.lit(True).alias("by_discount")).distinct()
    x = a.join(b, "part", "full").fillna(False, subset=["by_size", "by_discount"])
    return x.withColumn("source", F.when(F.col("by_size") & F.col("by_discount"), "both").when(F.col("by_size"), "size").otherwise("discount"))


@query("J13 R13 O6", "WITH known AS (SELECT DISTINCT src, dst FROM scores WHERE label = 1) SELECT count(*) AS pairs, sum(label)::BIGINT AS hits, round(sum(label) / count(*)::DOUBLE, 6) AS base_rate, round((sum(label) FILTER (points >= 9000) / (count(*) FILTER (points >= 9000))::DOUBLE) / (sum(label) / count(*)::DOUBLE), 6) AS lift FROM scores")
def base_rate_and_lift(t: Tables) -> DataFrame:
    x = t.scores.agg(F.count("*").alias("pairs"), F.sum("label").cast("long").alias("hits"), F.count_if(F.col("points") >= 9000).alias("top"), F.sum(F.when(F.col("points") >= 9000, F.col("label"))).alias("top_hits"))
    rate = F.col("hits") / F.col("pairs")
    return x.select("pairs", "hits", F.round(rate, 6).alias("base_rate"), F.round(F.col("top_hits") / F.col("top") / rate, 6).alias("lift"))


@query("J14 T22", "WITH x AS (SELECT o_custkey, o_orderdate, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30') SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderkey FROM x WHERE r = 1")
def latest_report_until(t: Tables) -> DataFrame:
    x = t.orders.select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderkey")
    return O.latest_until(x, ["o_custkey"], "day", F.lit(date(1998, 6, 30)))


@query("J15 W11 W13", "WITH x AS (SELECT o_custkey, o_orderkey, o_totalprice, year(o_orderdate) AS y, max(year(o_orderdate)) OVER (PARTITION BY o_custkey) AS last FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM x WHERE y = last) SELECT o_custkey, o_orderkey, y::BIGINT AS y, round(o_totalprice, 2) AS price FROM r WHERE n = 1")
def latest_period_top(t: Tables) -> DataFrame:
    x = t.orders.withColumn("y", F.year("o_orderdate")).withColumn("last", F.max("y").over(Window.partitionBy("o_custkey"))).where("y = last")
    return O.latest(x, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", F.col("y").cast("long").alias("y"), F.round("o_totalprice", 2).alias("price"))


@query("J19 U1", "WITH f AS (SELECT p_name, p_size, count(DISTINCT p_brand) AS n, min(p_brand) AS brand FROM part GROUP BY 1, 2) SELECT DISTINCT p.p_name, p.p_size::BIGINT AS p_size, CASE WHEN n = 1 THEN brand END AS brand, CASE WHEN n = 1 THEN 'match' ELSE 'review' END AS status FROM part p JOIN f ON p.p_name = f.p_name AND p.p_size = f.p_size")
def unique_lookups(t: Tables) -> DataFrame:
    left = t.part.select("p_name", "p_size").distinct()
    x = O.unique_lookup(left, t.part.select("p_name", "p_size", F.col("p_brand").alias("brand")), ["p_name", "p_size"], "brand")
    return x.select("p_name", F.col("p_size").cast("long").alias("p_size"), "brand", "status")


# --- aggregates ---------------------------------------------------------------------------------------------


@query("A1", "SELECT rel_id, count(*) OVER (PARTITION BY supplier_id, customer_id) AS frequency FROM rel")
def pair_frequency(t: Tables) -> DataFrame:
    return t.rel.select("rel_id", F.count("*").over(Window.partitionBy("supplier_id", "customer_id")).alias("frequency"))


@query("A2 A3 T20 D16", "SELECT l_suppkey, l_returnflag, l_linestatus, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cents, sum(CAST(l_quantity AS BIGINT))::BIGINT AS qty, count(*) AS n FROM lineitem GROUP BY ALL")
def group_by_all(t: Tables) -> DataFrame:
    x = t.lineitem.withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("long")).withColumn("qty", F.col("l_quantity").cast("long"))
    return O.sum_by_all(x, ["l_suppkey", "l_returnflag", "l_linestatus"], ["cents", "qty"])


@query("A4 A3", "SELECT count(*) AS n, count(DISTINCT supplier_id) AS suppliers, count(DISTINCT customer_id) AS customers, min(start_date) AS first, max(start_date) AS last, sum(cents)::BIGINT AS cents FROM rel")
def global_summary(t: Tables) -> DataFrame:
    return t.rel.agg(F.count("*").alias("n"), F.countDistinct("supplier_id").alias("suppliers"), F.countDistinct("customer_id").alias("customers"), F.min("start_date").alias("first"), F.max("start_date").alias("last"), F.sum("cents").alias("cents"))


@query("A5 A7 A8 A10 O5 T11", "WITH u AS (SELECT src, dst, is_disclosed, 0 AS is_shipping, CAST(NULL AS BIGINT) AS score FROM edges UNION ALL SELECT src, dst, 0, is_shipping, CAST(NULL AS BIGINT) FROM edges UNION ALL SELECT src, dst % 1500, 0, 0, points FROM scores) SELECT src, dst, max(is_disclosed)::BIGINT AS is_disclosed, max(is_shipping)::BIGINT AS is_shipping, max(score) AS score FROM u GROUP BY src, dst")
def multiplex_merge(t: Tables) -> DataFrame:
    a, b = t.edges.select("src", "dst", "is_disclosed"), t.edges.select("src", "dst", "is_shipping")
    c = t.scores.select("src", (F.col("dst") % 1500).alias("dst"), F.col("points").alias("score"), F.lit(0).alias("is_disclosed"))
    x = O.merge(O.layers(a, b, c).fillna(0, subset=["is_disclosed", "is_shipping"]), ["src", "dst"], greatest=["is_disclosed", "is_shipping", "score"])
    return x.select("src", "dst", F.col("is_disclosed").cast("long").alias("is_disclosed"), F.col("is_shipping").cast("long").alias("is_shipping"), "score")


@query("A6 A32", "SELECT l_suppkey, count(*) AS n, min(p_name) AS example, max(p_size)::BIGINT AS size, max(p_type) AS kind FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey")
def node_merge(t: Tables) -> DataFrame:
    x = t.lineitem.select("l_suppkey", "l_partkey").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.min("p_name").alias("example"), F.max("p_size").cast("long").alias("size"), F.max("p_type").alias("kind"))


@query("A12 A13 R10 R4", "WITH s AS (SELECT *, n_lines = 1 AS one, src % 2 = 0 AS even FROM scores) SELECT slice, count(*) AS total, count(*) FILTER (points >= 8000) AS predicted, count(*) FILTER (points >= 8000 AND label = 1) AS tp, sum(label)::BIGINT AS positives FROM (SELECT 'all' AS slice, * FROM s UNION ALL SELECT 'one', * FROM s WHERE one UNION ALL SELECT 'even', * FROM s WHERE even) GROUP BY slice")
def threshold_counts_by_slice(t: Tables) -> DataFrame:
    slices = F.array_compact(F.array(F.lit("all"), F.when(F.col("n_lines") == 1, "one"), F.when(F.col("src") % 2 == 0, "even")))
    x = t.scores.withColumn("slice", F.explode(slices))
    hit = F.col("points") >= 8000
    return x.groupBy("slice").agg(F.count("*").alias("total"), F.count_if(hit).alias("predicted"), F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.sum("label").cast("long").alias("positives"))


@query("A14 A26", "SELECT points // 500 * 500 AS low, count(*) AS n, sum(label)::BIGINT AS positives FROM scores GROUP BY 1")
def histogram(t: Tables) -> DataFrame:
    return t.scores.groupBy(F.expr("points div 500 * 500").alias("low")).agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("positives"))


@query("A15", "WITH x AS (SELECT (points + 1) / 10009.0 AS p, label AS y FROM scores) SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 5) AS log_loss FROM x GROUP BY 1")
def calibration_bins(t: Tables) -> DataFrame:
    x = t.scores.select(((F.col("points") + 1) / F.lit(10009.0)).alias("p"), F.col("label").alias("y"))
    p, y = F.col("p"), F.col("y")
    return x.groupBy(F.least(F.floor(p * 10), F.lit(9)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(y), 6).alias("mean_y"), F.round(F.avg((p - y) * (p - y)), 6).alias("brier"), F.round(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))), 5).alias("log_loss"))


@query("A16 A31 A33 D19", "WITH n AS (SELECT l_suppkey, p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY l_suppkey) AS t, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, p_type) AS r FROM n) SELECT l_suppkey, p_type, n, round(n / t, 6) AS share FROM r WHERE r = 1")
def most_common(t: Tables) -> DataFrame:
    x = t.lineitem.select("l_suppkey", "l_partkey").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return O.mode(x, ["l_suppkey"], "p_type").withColumn("share", F.round("share", 6))


@query("A18 A29 G13", "WITH d AS (SELECT a, count(DISTINCT b) AS deg FROM (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges) GROUP BY a) SELECT round(quantile_cont(deg, 0.05), 6) AS p05, round(quantile_cont(deg, 0.5), 6) AS p50, round(quantile_cont(deg, 0.9), 6) AS p90, round(quantile_cont(deg, 0.95), 6) AS p95, round(quantile_cont(deg, 0.99), 6) AS p99, round(avg(deg), 6) AS mean, max(deg) AS max, round(avg(CASE WHEN deg > 0 THEN 1.0 ELSE 0 END), 6) AS nonzero_share FROM d")
def degree_quantiles(t: Tables) -> DataFrame:
    both = t.pairs.union(t.pairs.select("dst", "src")).distinct().groupBy("src").agg(F.count("*").alias("deg"))
    x = O.spread(both, "deg")
    return x.select(*[F.round(c, 6).alias(c) if c != "max" else F.col(c) for c in x.columns])


@query("A19 R14", "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 3) AS mean, round(stddev_samp(c_acctbal), 3) AS sd, round(avg(c_acctbal) - 1.96 * stddev_samp(c_acctbal) / sqrt(count(*)), 3) AS low, round(avg(c_acctbal) + 1.96 * stddev_samp(c_acctbal) / sqrt(count(*)), 3) AS high FROM customer GROUP BY 1")
def mean_intervals(t: Tables) -> DataFrame:
    return O.confidence(t.customer, "c_acctbal", ["c_mktsegment"]).select("c_mktsegment", "n", *[F.round(c, 3).alias(c) for c in ("mean", "sd", "low", "high")])


@query("A20", "WITH n AS (SELECT supplier_id, flag, count(*) AS n FROM rel GROUP BY 1, 2), p AS (SELECT supplier_id, n / sum(n) OVER (PARTITION BY supplier_id) AS p FROM n) SELECT supplier_id, round(sum(p * p), 6) AS hhi, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY 1")
def flag_concentration(t: Tables) -> DataFrame:
    return O.concentration(t.rel, ["supplier_id"], "flag").select("supplier_id", F.round("hhi", 6).alias("hhi"), F.round("entropy", 6).alias("entropy"))


@query("A21 V9", "SELECT concat_ws('+', CASE WHEN is_disclosed = 1 THEN 'is_disclosed' END, CASE WHEN is_shipping = 1 THEN 'is_shipping' END, CASE WHEN is_predicted = 1 THEN 'is_predicted' END) AS category, count(*) AS n FROM edges WHERE is_disclosed = 1 OR is_shipping = 1 OR is_predicted = 1 GROUP BY 1")
def evidence_overlap(t: Tables) -> DataFrame:
    return O.overlap_categories(t.edges, ["is_disclosed", "is_shipping", "is_predicted"])


@query("A22 O11", "SELECT supplier_id, count(*) FILTER (flag = 'A') AS \"A\", count(*) FILTER (flag = 'N') AS \"N\", count(*) FILTER (flag = 'R') AS \"R\" FROM rel GROUP BY 1")
def crosstab(t: Tables) -> DataFrame:
    return t.rel.groupBy("supplier_id").pivot("flag", ["A", "N", "R"]).agg(F.count(F.lit(1))).fillna(0)


@query("A23 A28", "SELECT customer_id, sum(cents)::BIGINT AS total, count(*) AS n, min(start_date) AS first, max(start_date) AS last, string_agg(DISTINCT flag, '|' ORDER BY flag) AS flag FROM rel GROUP BY 1")
def contractor_profiles(t: Tables) -> DataFrame:
    return O.profile(t.rel, ["customer_id"], "cents", "start_date", ["flag"])


@query("A30 V1 V6", "SELECT 'end_date' AS field, count(*) AS n, count(end_date) AS filled, count(DISTINCT end_date) AS distinct_values FROM rel UNION ALL SELECT 'rel_id', count(*), count(rel_id), count(DISTINCT rel_id) FROM rel")
def field_coverage(t: Tables) -> DataFrame:
    return O.coverage(t.rel, "rel_id", ["rel_id", "end_date"])


# --- windows, sorts, sets -----------------------------------------------------------------------------------


@query("W1 W2 T7", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY supplier_id, customer_id ORDER BY end_date DESC NULLS LAST, start_date DESC NULLS LAST, rel_id DESC) AS n FROM rel) SELECT rel_id, supplier_id, customer_id, end_date FROM r WHERE n = 1")
def keep_latest(t: Tables) -> DataFrame:
    x = O.latest(t.rel, ["supplier_id", "customer_id"], [F.desc_nulls_last("end_date"), F.desc_nulls_last("start_date"), F.desc("rel_id")])
    return x.select("rel_id", "supplier_id", "customer_id", "end_date")


@query("W12 T11", "SELECT customer_id, arg_min(end_date, rel_id) FILTER (end_date IS NOT NULL) AS end_date, min(rel_id) AS rel_id FROM rel GROUP BY 1")
def first_non_null(t: Tables) -> DataFrame:
    x = t.rel.withColumn("o", F.col("rel_id"))
    return O.merge(x, ["customer_id"], least=["rel_id"], first=["end_date"], order=["o"]).select("customer_id", "end_date", "rel_id")


@query("W9 W10", "SELECT c_custkey, rank() OVER (ORDER BY CAST(floor(c_acctbal / 100) AS BIGINT) DESC) AS competition FROM customer")
def competition_rank(t: Tables) -> DataFrame:
    x = t.customer.select("c_custkey", F.floor(F.col("c_acctbal") / 100).alias("v"))
    return competition(x, F.desc("v"), "v", "competition").select("c_custkey", "competition")


@query("W15 H11 H12", f"WITH {CLEAN}, w AS (SELECT src, dst, CAST(floor(date_diff('day', (SELECT min(start_date) FROM clean), start_date) / 91.0) AS BIGINT) AS window_no FROM clean), ok AS (SELECT window_no FROM w GROUP BY 1 HAVING count(*) >= 10) SELECT src, dst, min(window_no) AS first_window FROM w JOIN ok USING (window_no) GROUP BY 1, 2")
def first_seen_windows(t: Tables) -> DataFrame:
    return E.new_edges(E.snapshots(_clean(t), "start_date", 91))


@query("T2 T3")
def overlap_dedup(t: Tables) -> DataFrame:
    x = _clean(t)
    return E.overlap_dedup(x, ["src", "dst"], "start_date", F.coalesce("end_date", F.lit(RUN)), "rel_id").select("rel_id", "src", "dst", "start_date", F.col("end_day").cast("long").alias("end_day"))


@query("O1 O2 O4", "SELECT part_id, sum(cents)::BIGINT AS cents FROM rel GROUP BY 1 ORDER BY cents DESC, part_id LIMIT 25")
def top_parts(t: Tables) -> DataFrame:
    return t.rel.groupBy("part_id").agg(F.sum("cents").alias("cents")).orderBy(F.desc("cents"), "part_id").limit(25)


@query("O5 O10", "SELECT s_suppkey::BIGINT AS id, s_name AS name, s_acctbal AS balance FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer")
def combined_parties(t: Tables) -> DataFrame:
    a = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return O.like_first(a, t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")))


@query("O6 O7 A24", "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.05), i AS (SELECT k FROM a INTERSECT SELECT k FROM b), u AS (SELECT k FROM a UNION SELECT k FROM b), d AS (SELECT k FROM a EXCEPT SELECT k FROM b) SELECT (SELECT count(*) FROM i) AS both, (SELECT count(*) FROM u) AS any, (SELECT count(*) FROM d) AS only_a, round((SELECT count(*) FROM i) / (SELECT count(*) FROM u)::DOUBLE, 6) AS jaccard")
def set_overlap(t: Tables) -> DataFrame:
    x = t.lineitem.groupBy(F.col("l_partkey").alias("k")).agg(F.max(F.col("l_returnflag") == "R").alias("a"), F.max(F.col("l_discount") > 0.05).alias("b"))
    both, either = F.count_if(F.col("a") & F.col("b")), F.count_if(F.col("a") | F.col("b"))
    return x.agg(both.alias("both"), either.alias("any"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.round(both / either, 6).alias("jaccard"))


@query("S16 S15 S19")
def curve_sample(t: Tables) -> DataFrame:
    return O.curve_sample(t.scores.groupBy("points").agg(F.count("*").alias("n")), "points", 200)
