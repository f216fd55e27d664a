"""Operators that SQL cannot express, against plain Python."""

import io
import random
import zipfile
from collections import Counter
from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.functions import exprs as X
from weftline.operators import cuts, decisions, embeddings, events, graph, order, ranking, resolve, tables
from weftline.plans import registry
from weftline.sources import readers, sinks
from weftline.streaming import incremental


def random_graph(rng, n, m):
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)} - {(i, i) for i in range(n)})


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def reach(near, start, gone=()):
    seen, todo = set(start) - set(gone), list(set(start) - set(gone))
    while todo:
        for v in near.get(todo.pop(), ()):
            if v not in seen and v not in gone:
                seen.add(v)
                todo.append(v)
    return seen


def parts(nodes, near, gone=()):
    left, out = set(nodes) - set(gone), []
    while left:
        c = reach(near, [min(left)], gone) & left
        out.append(len(c))
        left -= c
    return sorted(out, reverse=True)


def test_cut_nodes_and_bridges(spark):
    rng = random.Random(2)
    e = random_graph(rng, 40, 44)
    near = {}
    for a, b in e:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    nodes = spark.createDataFrame([(n,) for n in near], "node long")
    got = {(r.kind, r.a, r.b): (r.parts, r.largest, r.second) for r in cuts.seams(frame(spark, e), graph.weak_components(nodes, frame(spark, e))).collect()}
    want = {}
    for u in near:
        own = reach(near, [u])
        if len(p := parts(own, near, [u])) > 1:
            want["node", u, u] = (len(p), p[0], p[1])
    for a, b in {tuple(sorted(x)) for x in e}:
        cut = {k: v - ({b} if k == a else {a} if k == b else set()) for k, v in near.items()}
        if len(p := parts(reach(near, [a]), cut)) > 1:
            want["bridge", a, b] = (2, p[0], p[1])
    assert got == want


def test_dominators_and_min_cuts(spark):
    rng = random.Random(3)
    e = random_graph(rng, 25, 45)
    out = {}
    for a, b in e:
        out.setdefault(a, set()).add(b)
    nodes = spark.createDataFrame([(n,) for n in {x for p in e for x in p}], "node long")
    sources = [0, 1]
    comp = graph.weak_components(nodes, frame(spark, e))
    s = spark.createDataFrame([(x,) for x in sources], "node long")
    idom = {r.node: r.dominator for r in cuts.dominators(frame(spark, e), s, comp).collect()}
    alive = reach(out, sources)
    assert set(idom) == alive
    for v in alive:
        doms = {u for u in alive - {v} if v not in reach(out, [x for x in sources if x != u], [u])}
        chain, at = set(), idom[v]
        while at != -1:
            chain.add(at)
            at = idom[at]
        assert chain == doms - {v} or (v in sources and chain == set())
    targets = spark.createDataFrame([(20,), (21,), (22,)], "node long")
    for r in cuts.min_cuts(frame(spark, e), s, targets, comp).collect():
        k = 0
        import itertools

        while not any(r.node not in reach({a: {b for b in bs if (a, b) not in gone} for a, bs in out.items()}, sources) for gone in itertools.combinations(e, k)):
            k += 1
            if k > 2:
                break
        assert r.cut == k or (k > 2 and r.cut > 2)


def test_core_betweenness_strong(spark):
    rng = random.Random(4)
    e = random_graph(rng, 30, 70)
    near = {}
    for a, b in e:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    core, left, k = {}, {u: set(v) for u, v in near.items()}, 0
    while left:
        k = max(k, min(map(len, left.values())))
        u = min(left, key=lambda x: (len(left[x]), x))
        core[u] = k
        for v in left.pop(u):
            left[v].discard(u)
    assert {r.node: r.core for r in graph.core_numbers(frame(spark, e)).collect()} == core
    out = {}
    for a, b in e:
        out.setdefault(a, []).append(b)
    want = Counter()
    for s in (0, 1, 2):
        dist, sigma, order = {s: 0}, Counter({s: 1}), [s]
        for u in order:
            for v in out.get(u, []):
                if v not in dist:
                    dist[v] = dist[u] + 1
                    order.append(v)
                if dist[v] == dist[u] + 1:
                    sigma[v] += sigma[u]
        delta = Counter()
        for u in reversed(order):
            for v in out.get(u, []):
                if dist[v] == dist[u] + 1:
                    delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
            if u != s:
                want[u] += delta[u]
    got = {r.node: r.score for r in graph.betweenness(frame(spark, e), spark.createDataFrame([(0,), (1,), (2,)], "node long")).collect()}
    assert {k: pytest.approx(v) for k, v in want.items() if v} == {k: v for k, v in got.items() if v}
    comp = {r.node: r.component for r in graph.strong_components(spark.createDataFrame([(n,) for n in near], "node long"), frame(spark, e)).collect()}
    for u in near:
        assert comp[u] == min(v for v in reach(out, [u]) if u in reach(out, [v]))


def test_power_scores_converge(spark):
    import numpy as np

    rng = random.Random(8)
    n = 30
    e = sorted({*random_graph(rng, n, 110), *((i, (i + 1) % n) for i in range(n))})
    a = np.zeros((n, n))
    for s, t in e:
        a[s, t] = 1
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node long")
    first = lambda m: np.abs(np.linalg.eigh(m)[1][:, -1])
    got = {r.node: r for r in graph.hits(nodes, frame(spark, e)).collect()}
    assert np.allclose([got[i].authority for i in range(n)], first(a.T @ a), atol=1e-4) and np.allclose([got[i].hub for i in range(n)], first(a @ a.T), atol=1e-4)
    v = {r.node: r.v for r in graph.eigenvector(nodes, frame(spark, e)).collect()}
    assert np.allclose([v[i] for i in range(n)], first(a + a.T), atol=1e-6)
    p = a / a.sum(axis=1, keepdims=True)
    want = np.full(n, 1 / n)
    for _ in range(300):
        want = 0.85 * want @ p + 0.15 / n
    rank = {r.node: r.rank for r in graph.pagerank(nodes, frame(spark, e)).collect()}
    assert np.allclose([rank[i] for i in range(n)], want, atol=1e-5)


def test_star_swings_no_more(spark):
    e = [(0, i) for i in range(1, 6)]
    v = {r.node: r.v for r in graph.eigenvector(spark.createDataFrame([(i,) for i in range(6)], "node long"), frame(spark, e)).collect()}
    assert v[0] == pytest.approx(2**-0.5, abs=1e-6) and v[1] == pytest.approx(0.1**0.5, abs=1e-6)


def test_names(spark):
    rows = [(1, "Acme Limited Inc"), (2, "ACME, INC."), (3, "The Acme Holding GmbH"), (4, "Inc"), (5, None)]
    df = spark.createDataFrame(rows, "id long, name string")
    got = {r.id: r for r in df.select("id", X.company_name("name").alias("a"), X.company_name("name", compat=True).alias("c"), X.company_name_end("name").alias("e"), F.array_join(X.name_tokens("name"), " ").alias("t")).collect()}
    assert (got[1].a, got[1].c, got[1].e, got[1].t) == ("ACME", "ACME LIMITED INC", "ACME", "acme limited")
    assert (got[2].a, got[2].e, got[2].t) == ("ACME", "ACME INC", "acme")
    assert (got[3].a, got[3].e, got[3].t) == ("THE ACME HOLDING", "THE ACME HOLDING GMBH", "the acme")
    assert got[4].a is None and got[4].e == "INC" and got[5].a is None and got[5].e == ""


def test_blended_similarity(spark):
    import difflib

    assert resolve.blended_score("acme steel", "Acme Steel") == pytest.approx(100) and resolve.tier("ACME STEEL", "ACME STEEL") == 100
    a, b = "steel acme", "acme steel"
    plain = 100 * difflib.SequenceMatcher(None, a, b).ratio()
    assert resolve.blended_score(a, b) == pytest.approx(0.5 * plain + 20 + 20 + 10)
    assert resolve._partial("acme", "the acme works") == 100 and resolve._token_set("acme steel", "acme steel works") == 100
    assert resolve.tier("ACME STEEL", "ZEBRA") == 0 and resolve.tier("", "") == 0
    df = spark.createDataFrame([("acme steel", "acme steel"), ("acme", None), (None, None)], "a string, b string")
    rows = [r.b for r in df.select(resolve.blended("a", "b").alias("b")).collect()]
    assert (rows[0].score, rows[0].tier, rows[0].final) == (pytest.approx(100), 100, pytest.approx(100)) and rows[1].final == 0 and rows[2].final == 0


def test_prefixes_of_names(spark):
    left = spark.createDataFrame([("acme",), ("acme steel works",), ("zeb",), ("",), ("q",)], "key string")
    right = spark.createDataFrame([("acme steel",), ("acme",), ("zebra",), ("",)], "name string")
    got = {r.key: r.name for r in resolve.prefix_matches(left, right).collect()}
    assert got == {"acme": "acme", "acme steel works": "acme", "zeb": "zebra"}


def test_many_scenarios_are_evaluated_in_groups(spark, monkeypatch):
    e = frame(spark, [(0, 1), (1, 2), (0, 3), (3, 2), (2, 4)])
    src, goal = spark.createDataFrame([(0,)], "node long"), spark.createDataFrame([(2, 1.0), (4, 3.0)], "node long, weight double")
    gone = spark.createDataFrame([(f"s{i}", i) for i in range(1, 5)], "scenario string, node long")
    whole = sorted(tuple(r) for r in decisions.impact(e, gone, src, goal).collect())
    monkeypatch.setattr(decisions, "SCENARIOS", 2)
    assert sorted(tuple(r) for r in decisions.impact(e, gone, src, goal).collect()) == whole and len(whole) == 4


def test_overlap_fold(spark):
    rows = [(1, "a", date(2020, 1, 1), date(2020, 3, 1)), (2, "a", date(2020, 2, 1), date(2020, 3, 1)), (3, "a", date(2020, 2, 25), date(2020, 6, 1)), (4, "b", date(2020, 1, 1), date(2020, 1, 1)), (5, "b", date(2020, 1, 1), date(2020, 1, 1))]
    df = spark.createDataFrame(rows, "id long, k string, s date, e date")
    assert sorted(r.id for r in events.overlap_dedup(df, ["k"], "s", F.col("e"), "id").collect()) == [1, 3, 4, 5]


def test_first_of_each_key(spark):
    rows = [(3, "a", None, 1.0), (1, "a", None, 2.0), (2, "a", 5, 0.5), (2, "a", 5, 0.5), (9, None, None, 0.1), (7, None, None, None), (7, None, None, 0.2)]
    df = spark.createDataFrame(rows, "id long, k string, e long, v double")
    assert sorted((tuple(r) for r in events.first_of_each(df, ["k", "e"], ["id"]).collect()), key=repr) == [(1, "a", None, 2.0), (2, "a", 5, 0.5), (7, None, None, None)]
    assert sorted(r.k or "" for r in events.first_of_each(df.select("k"), ["k"]).collect()) == ["", "a"]
    assert events.first_of_each(df.limit(0), ["k"], ["id"]).columns == df.columns


def test_repeated_scores_count_once(spark):
    base, scores = frame(spark, [(1, 2), (3, 4)]), spark.createDataFrame([(1, 2, 0.3), (1, 2, 0.7)], "src long, dst long, v double")
    assert sorted(tuple(r) for r in tables.joined_scores(base, {"a": scores}, ["src", "dst"], "v", 0.0).collect()) == [(1, 2, 0.7), (3, 4, 0.0)]


def test_dense_index_and_fold(spark):
    df = spark.createDataFrame([(x,) for x in [5, 3, 9, 3, 100]], "raw_id long")
    assert sorted((r.raw_id, r.node_id) for r in events.entity_index(df).collect()) == [(3, 0), (5, 1), (9, 2), (100, 3)]


def test_tiles_of_a_sampled_table_are_even(spark):
    """So many rows that ranges come from a sample, and a column that only some readers of the ranges want."""
    df = spark.range(600_000, numPartitions=8).select("id", (F.xxhash64("id") % 100_003).alias("score"), F.rand(1).alias("z"))
    tiles = ranking.deciles(df, "score", ["id"]).groupBy("tile").agg(F.count("*").alias("n"), F.sum("z"), F.min("score").alias("low"), F.max("score").alias("high")).orderBy("tile").collect()
    assert [r.n for r in tiles] == [60_000] * 10 and all(a.low >= b.high for a, b in zip(tiles, tiles[1:]))


@pytest.mark.parametrize("one_task", [0, 1000])
def test_positions_and_running_sums(spark, monkeypatch, one_task):
    monkeypatch.setattr(order, "ONE_TASK", one_task)
    rng = random.Random(6)
    values = [(i, rng.choice([None, *range(40)]), rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(values, "id long, v long, w long").repartition(7)
    first = sorted(values, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    got = order.numbered(df, ["v", "id"], "at", "n").collect()
    assert {r.id: (r.at, r.n) for r in got} == {r[0]: (i, 500) for i, r in enumerate(first)}
    upto, want = 0, {}
    for i, _, w in first:
        upto += w
        want[i] = upto
    assert {r.id: r.s for r in order.running(df, ["v", "id"], {"s": "w"}).collect()} == want
    assert order.numbered(df.limit(0), ["v"]).count() == 0 and order.running(df.limit(0), ["v"], {"s": "w"}).columns == ["id", "v", "w", "s"]


def test_reach_counts_and_two_hops(spark):
    rng = random.Random(9)
    e = random_graph(rng, 90, 130)
    near, both = {}, {}
    for a, b in e:
        near.setdefault(a, set()).add(b)
        both.setdefault(a, set()).add(b)
        both.setdefault(b, set()).add(a)
    nodes, anchors = spark.range(90).withColumnRenamed("id", "node"), spark.range(70).withColumnRenamed("id", "node")
    got = {r.node: (r.n, r.n_others) for r in graph.reach_counts(nodes, frame(spark, e), anchors).collect()}
    want = {u: sum(v < 70 for v in reach(near, [u])) for u in range(90)}
    assert got == {u: (n, n - (u < 70)) for u, n in want.items() if n}
    hub = sorted({*e, *((0, i) for i in range(1, 80))})
    for pairs in (e, hub):
        both = {}
        for a, b in pairs:
            both.setdefault(a, set()).add(b)
            both.setdefault(b, set()).add(a)
        far = {u: sorted({w for v in vs for w in both[v]} - vs - {u})[:5] for u, vs in both.items()}
        assert sorted((r.src, r.dst) for r in graph.two_hop(frame(spark, pairs), 5).collect()) == sorted((u, w) for u, ws in far.items() for w in ws)


def test_summary_and_criticality(spark):
    e = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4)]
    nodes = spark.range(6).withColumnRenamed("id", "node")
    s = graph.summary(nodes, frame(spark, e)).first()
    assert (s.nodes, s.edges, s.n_weak, s.n_strong, s.core_max, s.core_median, s.in_degree_max) == (6, 5, 2, 4, 2, 1.5, 1)
    assert s.density == pytest.approx(5 / 30) and s.weak_share == pytest.approx(5 / 6) and s.strong_share == pytest.approx(0.5)
    got = {r.node: r for r in graph.criticality(nodes, frame(spark, e), nodes).collect()}
    assert got[3].closeness == pytest.approx(3 / (1 + 2 + 3) * 3 / 5) and got[5].criticality == 0
    assert got[2].betweenness == pytest.approx(5 / 20) and got[2].criticality == pytest.approx(0.4 * 5 / 20 + 0.3 * got[2].closeness + 0.15 * 1 / 5 + 0.15 * 2 / 5)


def test_curves_paths_and_pruning(spark):
    runs = spark.createDataFrame([("targeted:5", 3.0), ("random0:5", 1.0), ("random1:5", 2.0), ("random2:5", 4.0)], "scenario string, v double")
    got = {r.strategy: (r.size, r.n_runs, r.mean, r.p05, r.p95) for r in decisions.curve_summary(runs, "v").collect()}
    assert got["targeted"] == (5, 1, 3.0, 3.0, 3.0) and got["random"][:2] == (5, 3) and got["random"][2:] == pytest.approx((7 / 3, 1.1, 3.8))
    one = lambda *ns: spark.createDataFrame([(n,) for n in ns], "node long")
    e = frame(spark, [(0, 1), (1, 2), (0, 3), (3, 4), (4, 2), (1, 5)])
    assert {r.node: (r.before, r.after) for r in decisions.best_paths(e, one(1), one(0), one(2, 5, 9)).collect()} == {2: (2, 3), 5: (2, None), 9: (None, None)}
    ranked = spark.createDataFrame([(i, 10 - i) for i in range(6)], "node long, v long")
    assert sorted(r.node for r in decisions.pruned(ranked, one(5, 4), 3, [F.desc("v")]).collect()) == [0, 4, 5]
    assert sorted(r.node for r in decisions.pruned(ranked, one(5, 4), 1, [F.desc("v")]).collect()) == [4, 5]


def test_top_lists_flag_known_pairs(spark):
    scores = spark.createDataFrame([(1, 2, 5.0), (1, 3, 5.0), (1, 4, 7.0), (2, 1, 1.0)], "src long, dst long, score double")
    got = sorted((r.src, r.dst, r["rank"], r.is_known) for r in ranking.top_k(scores, 2, known=frame(spark, [(1, 2), (1, 2), (9, 9)])).collect())
    assert got == [(1, 2, 2, True), (1, 4, 1, False), (2, 1, 1, False)]


def test_stacked_regression(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(1.2 * x[:, 0] - 0.7 * x[:, 1] + 0.3)))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, label int")
    w, b, scored = ranking.stacked(df, ["a", "b"])
    z, v = np.c_[x, np.ones(400)], np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ v))
        v -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag([1.0, 1.0, 0.0]), z.T @ (p - y) + np.array([v[0], v[1], 0.0]))
    assert np.allclose([*w, b], v, atol=1e-3)
    r = ranking.probability_losses(scored, "probability").first()
    p = 1 / (1 + np.exp(-z @ v))
    assert r.n == 400 and r.log_loss == pytest.approx(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean(), abs=1e-4) and r.brier == pytest.approx(((p - y) ** 2).mean(), abs=1e-4)


def test_hash_numbers_and_lists(spark):
    df = spark.createDataFrame([("", "1,250", '["a", "b "]'), ("foobar", "12%", "x; y;"), ("é", "bad", "p,q")], "s string, n string, l string")
    rows = df.select(X.fnv1a("s").alias("h"), X.number("n").alias("n"), X.items("l").alias("l")).collect()

    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = (h ^ b) * 16777619 % 2**32
        return h

    assert [r.h for r in rows] == [fnv(""), fnv("foobar"), fnv("é")]
    assert [r.n for r in rows] == [1250.0, 0.12, None]
    assert [r.l for r in rows] == [["a", "b"], ["x", "y"], ["p", "q"]]


def test_platt_recovers_its_parameters(spark):
    rng = random.Random(1)
    import math

    rows = [(s := rng.uniform(-3, 3), int(rng.random() < 1 / (1 + math.exp(-(1.5 * s - 0.4))))) for _ in range(4000)]
    a, b = ranking.platt_fit(spark.createDataFrame(rows, "score double, label int"))
    assert abs(a - 1.5) < 0.2 and abs(b + 0.4) < 0.2


def test_resolution(spark):
    df = spark.createDataFrame([(1, "ACME STEEL"), (2, "ZZZ")], "id long, name string")
    other = spark.createDataFrame([("ACME STEEL CO",), ("ACME STELL",)], "name string")
    x = resolve.token_pairs(df, other).withColumn("score", resolve.ratio("name", "other_name"))
    r = resolve.accepted(x, "id", "score", "other_name", 0.8).collect()
    assert [(v.id, v.other_name, v.status) for v in r] == [(1, "ACME STELL", "match")]
    near = spark.createDataFrame([("ACME STEEL CO",), ("ACME STEEL AG",)], "name string")
    y = resolve.token_pairs(df, near).withColumn("score", resolve.ratio("name", "other_name"))
    accepted = resolve.accepted(y, "id", "score", "other_name", 0.8)
    assert [(v.id, v.other_name, v.status) for v in accepted.collect()] == [(1, "ACME STEEL AG", "ambiguous")]
    counts, review = resolve.match_summary(accepted)
    assert [tuple(v) for v in counts.collect()] == [("ambiguous", 1)] and review.count() == 1


def test_sources_and_sinks(spark, tmp_path):
    df = spark.range(20).select(F.col("id").alias("key"), (F.col("id") % 3).alias("g"), F.lit("v").alias("s"))
    sinks.write(df, f"{tmp_path}/p", by=["g"])
    with pytest.raises(Exception, match="already exists"):
        sinks.write(df, f"{tmp_path}/p")
    before = sorted(str(x) for x in (tmp_path / "p").rglob("*"))
    plan = sinks.write(df, f"{tmp_path}/q", dry_run=True)
    assert "Range" in plan and not (tmp_path / "q").exists() and sorted(str(x) for x in (tmp_path / "p").rglob("*")) == before
    assert readers.parquet(spark, f"{tmp_path}/p", ["key", "g"]).count() == 20
    sinks.export(df, f"{tmp_path}/x.csv")
    back = readers.csv_text(spark, f"{tmp_path}/x.csv", {"key": "long", "s": "int"})
    assert back.agg(F.sum("key"), F.count("s")).first()[:] == (190, 0)
    (tmp_path / "r.json").write_text('{"records": [{"a": 1}, {"a": 2}]}')
    assert [r.a for r in readers.by_suffix(spark, f"{tmp_path}/r.json").collect()] == [1, 2]
    (tmp_path / "t.tex").write_text("\\hline\nA \\& B & \\textbf{3} & 5\\% \\\\\n")
    assert readers.marked_up_rows(spark, f"{tmp_path}/t.tex", ["n", "x", "p"]).first()[:] == ("A & B", "3", "5%")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("n.csv", "a,b\n1,2\n3,4\n")
    (tmp_path / "z.zip").write_bytes(buffer.getvalue())
    assert [r.row["b"] for r in readers.zipped_csv(spark, f"{tmp_path}/z.zip", "n.csv").collect()] == ["2", "4"]
    m = sinks.manifest(spark, f"{tmp_path}/x.csv")
    assert {r.status for r in sinks.verified(m, m).collect()} == {"pass"}
    docs = sinks.documents(decisions.records(df.limit(3), "key", F.col("key"), "s"), f"{tmp_path}/docs")
    assert docs.count() == 3
    both = tables.curve_sample(spark.range(100).withColumnRenamed("id", "x"), "x", 10).collect()
    assert len(both) == 10 and both[0].x == 0 and both[-1].x == 99


def test_axes_and_alignment(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) * [3, 2, 1, 0.5] + 1
    q, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    df = spark.createDataFrame([(i, a.tolist(), (a @ q).tolist()) for i, a in enumerate(x)], "id long, a array<double>, b array<double>")
    got = np.array([r.aligned for r in embeddings.aligned(df, "a", "b").orderBy("id").collect()])
    assert np.allclose(got, x @ q)
    p = np.array([r.projected for r in embeddings.principal(df, "a", 2).orderBy("id").collect()])
    u, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(p), np.abs((u * s)[:, :2]))


def test_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    (tmp_path / "in").mkdir()
    batch.write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    incremental.run_to_end(incremental.windows(stream, "ts", "event_type", "value"), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.start, r.event_type): r.n for r in batch.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) >= 0.8 * len(want)


def test_every_query_has_a_place():
    assert set(registry.IDS) == set(registry.QUERIES) and set(registry.ORACLES) <= set(registry.QUERIES)
    assert duckdb is not None
