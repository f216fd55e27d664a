"""Graph queries on tables that grow: deep graphs against the SQL, and the kernels that hold a graph once a task."""

import random
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from weftline.operators import corridors, cuts, graph, ranking, sweeps
from weftline.plans import registry


def frame(spark, e):
    return spark.createDataFrame(e, "src long, dst long")


def nodes(spark, n):
    return spark.createDataFrame([(x,) for x in n], "node long")


@pytest.fixture(scope="module")
def deep(spark, tmp_path_factory):
    """A folder whose edges are one cycle of 60, from the seed 0 on to the anchor 27; the anchor's edge isn't disclosed."""
    path = str(tmp_path_factory.mktemp("deep"))
    nation = {0: (0, "HOUSEHOLD"), 27: (1, "BUILDING")}
    rows = [(k, f"c{k}", nation.get(k, (10, ""))[0], (k + 0.5) / 7, nation.get(k, (10, "OTHER"))[1]) for k in range(61)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{path}/customer.parquet")
    return path


def equals_sql(spark, path, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW customer AS SELECT * FROM '{path}/customer.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, path)
    cols = sorted(df.columns)
    got = sorted((tuple(x) for x in df.select(*cols).collect()), key=repr)
    want = sorted(c.sql(registry.ORACLES[name]).select(*cols).fetchall(), key=repr)
    assert got == want and got
    return [dict(zip(cols, x)) for x in got]


def test_closeness_of_a_deep_graph(spark, deep):
    equals_sql(spark, deep, "closeness_scores")


def test_hop_sums_equal_a_search_from_each_source(spark):
    rng = random.Random(11)
    e = sorted({(rng.randrange(400), rng.randrange(400)) for _ in range(700)})
    out = {}
    for a, b in e:
        out.setdefault(a, []).append(b)
    sources = [*range(0, 400), 900]
    for cap in (None, 3):
        want = {}
        for s in sources:
            dist, order = {s: 0}, [s]
            for u in order:
                for v in out.get(u, []) if cap is None or dist[u] < cap else []:
                    if v not in dist:
                        dist[v] = dist[u] + 1
                        order.append(v)
            want[s] = (len(dist) - 1, sum(dist.values()))
        got = {r.node: (r.reached, r.total) for r in sweeps.hop_sums(frame(spark, e), nodes(spark, sources + sources[:5]), cap).collect()}
        assert got == want
    assert sweeps.hop_sums(frame(spark, e), nodes(spark, []), None).count() == 0
    assert [(r.reached, r.total) for r in sweeps.hop_sums(frame(spark, []), nodes(spark, [1]), None).collect()] == [(0, 0)]


def test_betweenness_has_every_reached_node(spark):
    e = [(i, i + 1) for i in range(60)] + [(100, 30), (30, 200), (200, 31)]
    got = {r.node: r.score for r in graph.betweenness(frame(spark, e), nodes(spark, [0, 100])).collect()}
    assert got.keys() == {*range(1, 61), 200} and got[60] == 0 and got[59] == 2 and got[30] == 31 + 31


def test_cuts_of_many_targets_search_near_them():
    n, looked = 3000, Counter()
    e = [(i, i + 1) for i in range(n)] + [(i, i + 2) for i in range(n)]
    back = cuts._Backward(e, set(range(0, n, 10)))
    into = back.into

    class Counted(dict):
        def get(self, key, other=None):
            looked["n"] += 1
            return into.get(key, other)

    back.into = Counted()
    targets = [t for t in range(2, n) if t % 10]
    assert {back.flow(t) for t in targets} == {2}
    assert looked["n"] < 40 * len(targets)


def test_cuts_of_a_target_with_many_arcs_take_few_searches():
    wide, long = 60, 40
    e = [(k * long + i, k * long + i + 1) for k in range(wide) for i in range(long - 1)] + [(k * long + long - 1, 9999) for k in range(wide)]
    back, looked = cuts._Backward(e, {k * long for k in range(wide)}), Counter()
    into = back.into

    class Counted:
        def get(self, key, other=None):
            looked["n"] += 1
            return into.get(key, other)

    back.into = Counted()
    assert back.flow(9999) == wide
    assert looked["n"] < 2 * wide * long  # one search: a search for each path looks at about wide * wide * long / 2


def test_min_cuts_need_no_components(spark):
    rng = random.Random(21)
    e = [(a, b) for a, b in ((rng.randrange(150), rng.randrange(150)) for _ in range(700)) if a != b]  # some arcs twice
    e += [(200 + a, 200 + b) for a, b in e[:300]] + [(400, 401)]
    sources, targets = [*range(0, 12), 205, 206, 210], [*range(5, 150), *range(200, 340), 401, 900]

    def flow(t):
        room, n = Counter(e), 0
        while t not in sources:
            after, order = {t: None}, [t]
            for v in order:
                order += [u for u in near[v] if u not in after and room[u, v] and not after.update({u: v})]
            ends = [s for s in sources if s in after]
            if not ends:
                break
            u, n = ends[0], n + 1
            while (v := after[u]) is not None:
                room[u, v] -= 1
                room[v, u] += 1
                u = v
        return n

    near = {v: set() for v in [*targets, *sources]}
    for a, b in e:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    got = {r.node: r.cut for r in cuts.min_cuts(frame(spark, e), nodes(spark, sources * 2), nodes(spark, targets * 2)).collect()}
    assert got == {t: flow(t) for t in targets} and len(set(got.values())) > 5
    assert cuts.min_cuts(frame(spark, e), nodes(spark, sources), nodes(spark, [])).count() == 0
    assert [r.cut for r in cuts.min_cuts(frame(spark, []), nodes(spark, [1]), nodes(spark, [2])).collect()] == [0]


def test_priority_pool_with_long_lists(spark):
    rng = random.Random(12)
    n = 12_000
    degree = {v: rng.randrange(50) for v in range(n)}
    lists = [range(0, 30), range(0, n, 2), range(1, n, 2), range(0)]
    near = [(s, v, rng.randint(0, 2)) for s in (1, 2, 3) for v in sorted(rng.sample(range(n + 5), 3000 if s == 1 else 20))]
    p = {}
    for k, part in zip((0, 1, 2, 5), lists):
        for v in part:
            p.setdefault(v, k)
    want = []
    for s in (1, 2, 3):
        own = {v: d for x, v, d in near if x == s}
        ranked = sorted((0 if p.get(v) == 0 else own.get(v, p.get(v)), -degree[v], v) for v in {*own, *p} if v in degree)
        want += [(s, v, k, own.get(v)) for k, _, v in ranked[:40]]
    x = ranking.priority_pool(spark.createDataFrame(near, "src long, dst long, dist int"), *[nodes(spark, v) for v in lists], spark.createDataFrame(list(degree.items()), "node long, degree long"), 40)
    assert sorted(map(tuple, x.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name, column", [("source_distances", "dist"), ("evidence_tiers", "disclosed_tier"), ("geodesic_lanes", "bottleneck")])
def test_hops_of_a_deep_graph(spark, deep, name, column):
    rows = equals_sql(spark, deep, name)
    assert len(rows) >= 30 and column in rows[0]


def test_corridors_with_hops_beyond_the_cap(spark):
    e = frame(spark, [(i, i + 1) for i in range(6)])
    all_nodes = nodes(spark, range(8))
    x = corridors.corridor_scores(all_nodes, e, nodes(spark, [0]), nodes(spark, [6]), 2)
    x = spark.createDataFrame(x.collect(), x.schema)
    got = {r.node: (r.source_reach, r.target_reach, r.from_source, r.to_target, r.is_corridor) for r in x.collect()}
    assert got == {i: (1, 1, i if i <= 2 else -1, 6 - i if i >= 4 else -1, True) for i in range(7)} | {7: (0, 0, -1, -1, False)}
    strong = all_nodes.selectExpr("node", "node AS component")
    worth = {r.node: r.bottleneck for r in corridors.bottlenecks(e, x, strong).collect()}
    assert worth[6] == worth[0] == float("inf") and worth[3] < 0 and worth[1] > 0 and worth[7] == 0
