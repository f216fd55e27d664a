import numpy as np
import pytest

from weftline.llm import nearest


def brute(ids, x, k=20):
    out = {}
    for i, q in zip(ids, x):
        if i % 20 == 0:
            s = nearest.products(q[None].astype(float), x.astype(float))[0]
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_recall_scores_and_order(spark, scale, monkeypatch):
    monkeypatch.setattr(nearest, "LEAF_ROWS", 60)
    monkeypatch.setattr(nearest, "CELL_ROWS", 32)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    if scale:
        x *= rng.uniform(0.2, 3, size=(1500, 1)).astype(np.float32)
    x[700:800] = x[700]
    ids = np.arange(1500)
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, score int")
    rows = nearest.search(df).collect()
    want, got = brute(ids, x), {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    found = sum(len(set(a for a, _ in got[q]) & set(a for a, _ in want[q])) for q in want) / sum(map(len, want.values()))
    assert found >= 0.9
    for q, pairs in got.items():
        exact = {j: s for j, s in zip(ids.tolist(), nearest.products(x[q][None].astype(float), x.astype(float))[0])}
        assert all(s == exact[j] for j, s in pairs)
        assert pairs == sorted(pairs, key=lambda p: (-p[1], p[0])) and len(pairs) == 20


def test_what_takes_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest.search(df).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 0.5)]
    assert nearest.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_a_third_of_all_rows_equal(spark, kind, monkeypatch):
    monkeypatch.setattr(nearest, "LEAF_ROWS", 60)
    monkeypatch.setattr(nearest, "CELL_ROWS", 50)
    monkeypatch.setattr(nearest, "CELL_QUERIES", 7)
    x = np.random.default_rng(6).normal(size=(900, 8))
    x = x.astype(np.float32) if kind == "float" else x
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    want, got = brute(np.arange(900), x), {}
    for r in sorted(nearest.search(df).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    for q in range(0, 900, 60):  # the copies among the queries have the copies of smallest vec_id
        assert got[q] == want[q]
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 20 * len(want)


def test_best_is_brute_force_whatever_the_blocks():
    rng = np.random.default_rng(7)
    x, q, ids = rng.integers(-2, 3, (60, 3)).astype(float), rng.integers(-2, 3, (9, 3)).astype(float), rng.permutation(60)
    rough = nearest.without_own(q @ x.T, np.arange(9) * 10, ids)
    r, c, score = nearest.best(rough, q, x, ids, 5)
    for i in range(9):
        s = nearest.products(q[i][None], x)[0]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i * 10][:5]
        assert c[r == i].tolist() == order and score[r == i].tolist() == s[order].tolist()
    kept = nearest.few_copies(ids, np.repeat(x[:2], 30, axis=0), 5)
    assert sorted(ids[kept]) == sorted([*sorted(ids[:30])[:6], *sorted(ids[30:])[:6]])
