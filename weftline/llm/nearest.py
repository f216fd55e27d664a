"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

Fit: at most ``SAMPLE`` vectors (those of least hashed id) are split by k-means, level
by level, into ``BRANCH`` children until a node stands for about ``LEAF_ROWS`` rows of
the table. For inner products every vector x gets one more component, the square root of
(M squared - |x| squared), M being the largest norm of the table, and a query a zero: nearest
by distance is then largest by product.

Index: every row goes down the tree to its leaf. Search: a priority queue of nodes
by distance gives each query the order in which it visits leaves; the number of
visits is widened until ``CALIBRATION`` queries, compared with brute force over the
whole table, reach ``RECALL``. Neighbouring leaves form parts of at most ``CELL_ROWS``
rows, and a query has a row for each part with the leaves that it visits there. Parts meet
their queries in cells of about ``CELL_ROWS`` rows by ``CELL_QUERIES`` queries; a leaf that
is larger, as with many copies of a vector, is dealt into slices.

Scores are sums in double precision, component after component. Vectors stay floats if they
are, and are read as doubles otherwise.

Defined results: vectors that are null, zero, hold null or non-finite components,
or differ in length from the most common length (the larger of equals) take no part; rows
of one vec_id count once (the smallest vector); a null vec_id takes no part; fewer than
k candidates give fewer rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window

from .common import F, arrow_schema, materialise

K = 20
SAMPLE = 20_000
BRANCH = 8
LEAF_ROWS = 400
CALIBRATION = 200
RECALL = 0.97
CELL_ROWS = 8192
CELL_QUERIES = 1024
FIRST = 8  # leaves whose k-th best score bounds the search of the others


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, x of every vector that takes part."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite & F.exists("x", lambda v: v != 0))
    rows = materialise(rows.groupBy("vec_id").agg(F.min("x").alias("x")), "vectors")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == (sizes[0].d if sizes else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = [x[rng.integers(len(x))]]
    far = np.full(len(x), np.inf)
    for _ in range(1, k):
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
        centres.append(x[rng.choice(len(x), p=far / far.sum())] if far.sum() > 0 else x[rng.integers(len(x))])
    c = np.array(centres)
    for _ in range(rounds):
        label = _closest(x, c)
        c = np.array([x[label == i].mean(axis=0) if (label == i).any() else c[i] for i in range(len(c))])
    return c


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)


class Tree:
    """Nodes as arrays: each inner node's children have centres; leaves are numbered."""

    def __init__(self, sample: np.ndarray, most: float, leaf_sample: float, seed: int = 8) -> None:
        self.most = most
        rng = np.random.default_rng(seed)
        self.children: list[list[int]] = [[]]
        self.centres: list[np.ndarray] = [np.zeros((0, sample.shape[1] + 1))]
        todo = [(0, self.raised(sample))]
        while todo:
            node, x = todo.pop()
            if len(x) <= max(leaf_sample, 2 * BRANCH) or len(c := _kmeans(x, BRANCH, rng)) < 2:
                continue
            label = _closest(x, c)
            for i in range(len(c)):
                self.children.append([])
                self.centres.append(np.zeros((0, x.shape[1])))
                self.children[node].append(len(self.children) - 1)
                todo.append((len(self.children) - 1, x[label == i]))
            self.centres[node] = c
        self.leaf = {node: n for n, node in enumerate(i for i, c in enumerate(self.children) if not c)}

    def raised(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.most**2 - (x * x).sum(axis=1), 0))[:, None]], axis=1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        y, at = self.raised(x), np.zeros(len(x), np.int64)
        todo = [0] if len(x) else []
        while todo:
            node = todo.pop()
            if self.children[node]:
                rows = np.flatnonzero(at == node)
                if len(rows):
                    at[rows] = np.array(self.children[node])[_closest(y[rows], self.centres[node])]
                    todo += self.children[node]
        return np.array([self.leaf[n] for n in at.tolist()], np.int64)

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """Up to ``most`` leaves, best bin first."""
        y = np.concatenate([q, [0.0]])
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(self.leaf[node])
                continue
            d = ((self.centres[node] - y) ** 2).sum(axis=1)
            for dist, child in zip(d.tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (dist, child))
        return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, summed component after component, so equal vectors have equal scores wherever they stand."""
    out = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        out += q[:, j, None] * x[None, :, j]
    return out


def pair_products(q: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of q[r] with x[c], in the order of summation of ``products``."""
    out = np.zeros(len(r))
    for at in range(0, len(r), 1 << 16):
        a, b = q[r[at : at + (1 << 16)]], x[c[at : at + (1 << 16)]]
        for j in range(q.shape[1]):
            out[at : at + len(a)] += a[:, j] * b[:, j]
    return out


def best(rough: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query places, row places and scores of the k largest scores of each query that reach its bound, ties to the smaller id.

    ``rough`` are scores in any order of summation, minus infinity where a row is not for a query; whatever could
    be among the k by them is scored exactly. Results are in order of query, then nearest first.
    """
    n = rough.shape[1]
    least = np.full(len(q), -np.inf) if bound is None else bound
    if n > k:
        least = np.maximum(least, np.partition(rough, n - k, axis=1)[:, n - k])
    slack = 1e-9 * (1 + np.abs(q).sum(axis=1) * np.abs(x).max(initial=0))
    r, c = np.nonzero((rough >= (least - slack)[:, None]) & (rough > -np.inf))
    score = pair_products(q, x, r, c)
    if bound is not None:
        r, c, score = (v[score >= bound[r]] for v in (r, c, score))
    order = np.lexsort((ids[c], -score, r))
    r, c, score = r[order], c[order], score[order]
    among = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[among], c[among], score[among]


def without_own(rough: np.ndarray, asked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """rough with minus infinity where a query meets its own row."""
    order = np.argsort(ids)
    at = np.minimum(np.searchsorted(ids, asked, sorter=order), len(ids) - 1)
    own = ids[order[at]] == asked
    rough[np.flatnonzero(own), order[at[own]]] = -np.inf
    return rough


def few_copies(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Places of all rows but those with more than k equal vectors of smaller id, which no query can have among its k."""
    _, kind = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)
    order = np.lexsort((ids, kind))
    return order[np.arange(len(ids)) - np.searchsorted(kind[order], kind[order]) <= k]


def fit(rows: DataFrame, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS) -> Tree | None:
    n, most = rows.agg(F.count("*"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v))).first()
    if not n:
        return None
    taken = matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("x").toArrow().column(0))
    return Tree(taken, float(np.sqrt(most)), leaf_rows * len(taken) / n)


def calibrated_visits(rows: DataFrame, tree: Tree, k: int = K, queries: int = CALIBRATION, recall: float = RECALL) -> int:
    """The fewest leaf visits at which the calibration queries find ``recall`` of their true neighbours."""
    taken = rows.orderBy(F.xxhash64("vec_id", F.lit("calibration")), "vec_id").limit(queries).toArrow()
    ids, q = taken.column("vec_id").to_numpy(), matrix(taken.column("x"))
    held = rows.sparkSession.sparkContext.broadcast((tree, ids, q))
    ddl = "query int, vec_id long, score double, leaf long"
    schema = arrow_schema(ddl)

    def run(batches):
        tree, ids, q = held.value
        for batch in batches:
            if batch.num_rows:
                own, x = batch.column(0).to_numpy(), matrix(batch.column(1))
                leaf = tree.assign(x)
                query, at, score = best(without_own(q @ x.T, ids, own), q, x, own, k)
                yield pa.record_batch([pa.array(query, pa.int32()), pa.array(own[at]), pa.array(score), pa.array(leaf[at])], schema=schema)

    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    true = rows.select("vec_id", "x").mapInArrow(run, ddl).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query", "leaf").collect()
    order = [{leaf: i for i, leaf in enumerate(tree.visits(v, len(tree.leaf)))} for v in q]
    needed = sorted(order[r.query][r.leaf] + 1 for r in true)
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 1


def parts_of(tree: Tree, rows: dict[int, int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each leaf, and the slices of each part: neighbouring leaves share a part of at most ``most`` rows; a larger leaf is a part of its own, dealt into slices."""
    part, filled = np.zeros(len(tree.leaf), np.int64), []
    todo = [0]
    while todo:
        node = todo.pop()
        todo += tree.children[node]
        if not tree.children[node]:
            n = rows.get(tree.leaf[node], 0)
            if not filled or filled[-1] + n > most:
                filled.append(0)
            filled[-1] += n
            part[tree.leaf[node]] = len(filled) - 1
    return part, np.maximum(1, -(-np.array(filled, np.int64) // most))


def _met(index: DataFrame, asked: DataFrame, slices: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score: for every query and part of its leaves, the k best rows of these leaves that reach the query's bound."""
    n_queries = {r.part: r["count"] for r in asked.groupBy("part").count().collect()}
    # a row for each part, and there are no more parts than leaves of the tree: a table of bounded size
    sizes = [(int(p), int(slices[p]), -(-n // CELL_QUERIES)) for p, n in n_queries.items()]
    sizes = F.broadcast(index.sparkSession.createDataFrame(sizes, "part long, nx int, nq int"))

    def dealt(side: DataFrame, own: str, other: str, a: str, b: str, *more: str) -> DataFrame:
        side = side.join(sizes, "part").withColumn(a, F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int"))
        return side.select("part", a, F.explode(F.expr(f"sequence(0, {other} - 1)")).alias(b), "vec_id", "x", *more)

    keys = ["part", "cx", "cq"]
    x_side, q_side = dealt(index, "nx", "nq", "cx", "cq", "leaf"), dealt(asked, "nq", "nx", "cq", "cx", "leaves", "bound")
    schema = arrow_schema("query_id long, vec_id long, score double")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids, x, leaf = left.column("vec_id").to_numpy(), matrix(left.column("x")), left.column("leaf").to_numpy()
        at = few_copies(ids, x, k)
        at = at[np.argsort(leaf[at], kind="stable")]
        ids, x = ids[at], x[at]
        here, starts = np.unique(leaf[at], return_index=True)
        ends = [*starts[1:], len(ids)]
        asked_ids, q, bound = right.column("vec_id").to_numpy(), matrix(right.column("x")), right.column("bound").to_numpy()
        lists = right.column("leaves").combine_chunks()
        query, visited = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        place = np.minimum(np.searchsorted(here, visited), len(here) - 1)
        visits = np.zeros((len(q), len(here)), bool)
        visits[query[here[place] == visited], place[here[place] == visited]] = True
        out = []
        for at in range(0, len(q), 128):
            block = slice(at, at + 128)
            rough = np.full((len(q[block]), len(ids)), -np.inf)
            for n, (a, b) in enumerate(zip(starts, ends, strict=True)):
                who = np.flatnonzero(visits[block, n])
                rough[who, a:b] = q[block][who] @ x[a:b].T
            r, c, score = best(without_own(rough, asked_ids[block], ids), q[block], x, ids, k, bound[block])
            out.append((asked_ids[block][r], ids[c], score))
        return pa.table([pa.array(np.concatenate(v)) for v in zip(*out, strict=True)], schema=schema)

    return x_side.groupBy(*keys).cogroup(q_side.groupBy(*keys)).applyInArrow(cell, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the neighbours of each row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    out = "query_id long, rank int, vec_id long, score double"
    if (tree := fit(rows)) is None:
        return spark.createDataFrame([], out)
    visits = calibrated_visits(rows, tree, k)
    held = spark.sparkContext.broadcast(tree)
    kind = rows.schema["x"].dataType.simpleString()

    def to_leaf(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(held.value.assign(matrix(batch.column(1))))], names=["vec_id", "x", "leaf"])

    index = materialise(rows.select("vec_id", "x").mapInArrow(to_leaf, f"vec_id long, x {kind}, leaf long"), "index")
    part, slices = parts_of(tree, {r.leaf: r["count"] for r in index.groupBy("leaf").count().collect()}, CELL_ROWS)

    def to_parts(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                block = batch.slice(at, 500)
                row, to, early, leaves = [], [], [], []
                for i, v in enumerate(matrix(block.column(1))):
                    order = np.array(held.value.visits(v, visits), np.int64)
                    for is_early, taken in ((True, order[:FIRST]), (False, order[FIRST:])):
                        for p in np.unique(part[taken]).tolist():
                            row.append(i)
                            to.append(p)
                            early.append(is_early)
                            leaves.append(taken[part[taken] == p])
                take = pa.array(row, pa.int64())
                yield pa.record_batch([block.column(0).take(take), block.column(1).take(take), pa.array(to, pa.int64()), pa.array(early, pa.bool_()), pa.array(leaves, pa.list_(pa.int64()))], names=["vec_id", "x", "part", "early", "leaves"])

    # spread first: the queries of a few scan tasks visit many leaves each
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "x").repartition("vec_id")
    asked = materialise(asked.mapInArrow(to_parts, f"vec_id long, x {kind}, part long, early boolean, leaves array<long>"), "visits")
    index = index.join(F.broadcast(spark.createDataFrame([(n, int(p)) for n, p in enumerate(part)], "leaf long, part long")), "leaf")
    # the first leaves of a query bound what the others have to return
    first = materialise(_met(index, asked.where("early").withColumn("bound", F.lit(float("-inf"))), slices, k), "first")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bounds = first.withColumn("r", F.row_number().over(w)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    rest = asked.where(~F.col("early")).join(bounds, "vec_id", "left").fillna(float("-inf"), subset=["bound"])
    pairs = first.unionByName(_met(index, rest, slices, k))
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
