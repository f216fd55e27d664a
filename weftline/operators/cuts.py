"""Sequential graph kernels: cut nodes, bridges, dominators (one task for each weak component) and minimum cuts.

The first three are linear (cuts) or near-linear in a component's edges and hold the component in memory; the number
of components, not the size of the largest, is what scales out. Minimum cuts are dealt by targets: each task holds the graph.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored

TASK_TARGETS = 64  #: targets of minimum cuts that are worth a task


def _seams(pdf: pd.DataFrame) -> pd.DataFrame:
    """Cut nodes and bridges with the parts that remain: low-link search without recursion."""
    near: dict[int, set[int]] = {}
    for a, b in zip(pdf["src"], pdf["dst"], strict=True):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    root, n = min(near), len(near)
    order, low, size = {root: 0}, {root: 0}, {}
    cut: dict[int, list[int]] = {}
    rows = []
    stack = [(root, None, iter(sorted(near[root])))]
    while stack:
        u, parent, it = stack[-1]
        for v in it:
            if v not in order:
                order[v] = low[v] = len(order)
                stack.append((v, u, iter(sorted(near[v]))))
                break
            if v != parent:
                low[u] = min(low[u], order[v])
        else:
            stack.pop()
            size[u] = size.get(u, 0) + 1
            if parent is not None:
                size[parent] = size.get(parent, 0) + size[u]
                low[parent] = min(low[parent], low[u])
                if low[u] >= order[parent]:
                    cut.setdefault(parent, []).append(size[u])
                if low[u] > order[parent]:
                    a, b = sorted((size[u], n - size[u]), reverse=True)
                    rows.append(("bridge", min(u, parent), max(u, parent), n, 2, a, b))
    for u, parts in cut.items():
        rest = n - 1 - sum(parts)
        parts = sorted(parts + [rest] * (rest > 0), reverse=True)
        if len(parts) > 1:
            rows.append(("node", u, u, n, len(parts), parts[0], parts[1]))
    return pd.DataFrame(rows, columns=["kind", "a", "b", "n", "parts", "largest", "second"])


def seams(edges: DataFrame, component: DataFrame) -> DataFrame:
    """kind, a, b, n, parts, largest, second: every cut node and bridge of the undirected graph, exactly."""
    own = edges.join(component, F.col("src") == F.col("node")).select("component", "src", "dst")
    return own.groupBy("component").applyInPandas(_seams, "kind string, a long, b long, n long, parts long, largest long, second long")


def _dominators(edges: list[tuple[int, int]], sources: list[int]) -> dict[int, int]:
    """Immediate dominators from a super-source (-1): the iterative intersection of paths in reverse postorder."""
    out: dict[int, list[int]] = {-1: sorted(sources)}
    back: dict[int, list[int]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    seen, post, stack = {-1}, [], [(-1, iter(out[-1]))]
    while stack:
        u, it = stack[-1]
        for v in it:
            if v not in seen:
                seen.add(v)
                stack.append((v, iter(sorted(out.get(v, [])))))
                break
        else:
            post.append(u)
            stack.pop()
    for u in seen:
        for v in out.get(u, []):
            back.setdefault(v, []).append(u)
    number = {u: i for i, u in enumerate(post)}
    idom, changed = {-1: -1}, True
    while changed:
        changed = False
        for v in reversed(post[:-1]):
            new = None
            for p in back[v]:
                if p in idom:
                    if new is None:
                        new = p
                    a, b = new, p
                    while a != b:
                        while number[a] < number[b]:
                            a = idom[a]
                        while number[b] < number[a]:
                            b = idom[b]
                    new = a
            if idom.get(v) != new:
                idom[v], changed = new, True
    return idom


def dominators(edges: DataFrame, sources: DataFrame, component: DataFrame) -> DataFrame:
    """node, dominator (-1: only the super-source): who stands on every path from the sources."""
    own = edges.join(component, F.col("src") == F.col("node")).select("component", "src", "dst", F.lit(False).alias("source"))
    start = sources.join(component, "node").select("component", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(True).alias("source"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf[pdf["source"]]["src"].tolist()
        e = pdf[~pdf["source"]]
        found = _dominators(list(zip(e["src"], e["dst"], strict=True)), s) if s else {}
        return pd.DataFrame([(k, v) for k, v in found.items() if k != -1], columns=["node", "dominator"])

    return own.union(start).groupBy("component").applyInPandas(kernel, "node long, dominator long")


class _Into:
    """The arcs into each node, as ranges of arcs that are sorted by their heads."""

    def __init__(self, head: np.ndarray, n: int) -> None:
        self.first = memoryview(np.searchsorted(head, np.arange(n + 1)))

    def get(self, v: int, other: Sequence[int] = ()) -> Sequence[int]:
        return range(self.first[v], self.first[v + 1])


class _Backward:
    """Incoming arcs of each node, and searches from a target back to the nearest sources with room.

    A branch of a search (one for each free arc into the target) ends at its first source, so it stays near the target
    while sources are not far, and one search serves all branches: their paths share no node, so each of them counts. Arcs
    from nodes that no source reaches are left out: they carry no flow. The graph is held as arrays, nodes by their places.
    """

    def __init__(self, edges: Sequence[tuple[int, int]] | np.ndarray, sources: Iterable[int]) -> None:
        e, own = np.asarray(edges, np.int64).reshape(-1, 2), np.array(sorted(sources), np.int64)
        node = np.unique(np.concatenate((e[:, 0], e[:, 1], own)))
        tail, head = np.searchsorted(node, e[:, 0]), np.searchsorted(node, e[:, 1])
        self.node, self.source, n = memoryview(node), bytearray(len(node)), len(node)
        queue = np.unique(np.searchsorted(node, own)).tolist()
        for u in queue:
            self.source[u] = 1
        order = np.argsort(tail, kind="stable")
        first, after = memoryview(np.searchsorted(tail[order], np.arange(n + 1))), memoryview(head[order])
        seen = bytearray(self.source)
        while queue:
            u = queue.pop()
            for v in after[first[u] : first[u + 1]]:
                if not seen[v]:
                    seen[v] = 1
                    queue.append(v)
        keep = np.frombuffer(seen, np.uint8)[tail] > 0
        tail, head = tail[keep], head[keep]
        order = np.argsort(head, kind="stable")
        self.tail, self.head = memoryview(tail[order]), memoryview(head[order])
        self.into = _Into(head[order], n)

    def _paths(self, target: int, used: set[int], leaving: dict[int, set[int]]) -> list[list[tuple[int, bool]]]:
        """Augmenting paths without a common node, none only if there is no path; of each path the arcs and whether each is taken (or given back)."""
        after: dict[int, tuple[int, int, bool, int] | None] = {target: None}  # the next node, the arc there, whether taken, the branch
        queue, ended, found = deque([target]), set(), []
        while queue:
            v = queue.popleft()
            branch = -1 if v == target else after[v][3]
            if branch in ended:
                continue
            for i in self.into.get(v, ()):  # an unused arc into v
                if i in used:
                    continue
                u = self.tail[i]
                if self.source[u]:
                    path, at = [(i, True)], v
                    while (step := after[at]) is not None:
                        path.append(step[1:3])
                        at = step[0]
                    found.append(path)
                    if v != target:
                        ended.add(branch)
                        break
                elif u not in after:
                    after[u] = (v, i, True, i if v == target else branch)
                    queue.append(u)
            else:
                for i in leaving.get(v, ()):  # a used arc out of v, given back
                    u = self.head[i]
                    if u not in after:
                        after[u] = (v, i, False, branch)
                        queue.append(u)
        return found

    def flow(self, target: int, most: int = 1 << 30) -> int:
        """Edge-disjoint paths from the sources to the target, ``most`` at most: unit augmenting paths, breadth first."""
        at = bisect_left(self.node, target)
        if at == len(self.node) or self.node[at] != target or self.source[at]:
            return 0
        used: set[int] = set()
        leaving: dict[int, set[int]] = {}
        flow = 0
        most = min(most, len(self.into.get(at, ())))
        while flow < most and (paths := self._paths(at, used, leaving)):
            for i, taken in chain.from_iterable(paths):
                if taken:
                    used.add(i)
                    leaving.setdefault(self.tail[i], set()).add(i)
                else:
                    used.discard(i)
                    leaving[self.tail[i]].discard(i)
            flow += len(paths)
        return min(flow, most)


def min_cuts(edges: DataFrame, sources: DataFrame, targets: DataFrame, component: DataFrame | None = None) -> DataFrame:
    """node, cut: edges to remove so that no source reaches the target (unit capacities), for each target.

    Each task holds the graph once, as arrays, and takes its share of the targets, so a single component
    is spread too. ``component`` (column node), if given, says which nodes count.
    """
    if component is not None:
        edges = edges.join(component.select(F.col("node").alias("src")), "src", "left_semi")
        sources, targets = (x.join(component.select("node"), "node", "left_semi") for x in (sources, targets))
    goals = stored(targets.select(F.col("node").cast("long").alias("node")).where("node IS NOT NULL").distinct())
    spark = goals.sparkSession
    tasks = max(1, min(2 * spark.sparkContext.defaultParallelism, -(-goals.count() // TASK_TARGETS)))
    graph = edges.select("src", "dst", F.lit(0).alias("kind")).union(sources.select("node", "node", F.lit(1))).where("src IS NOT NULL AND dst IS NOT NULL")
    graph = stored(graph.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "kind"))
    graph = graph.crossJoin(F.broadcast(spark.range(tasks).select(F.col("id").cast("int").alias("task")))).select("task", "src", "dst", "kind")
    own = goals.select(F.pmod(F.xxhash64("node"), F.lit(tasks)).cast("int").alias("task"), "node", "node", F.lit(2).alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list[np.ndarray]] = [[], [], []]
        for batch in batches:
            pairs = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)], axis=1)
            kind = batch.column(3).to_numpy(zero_copy_only=False)
            for k in range(3):
                rows[k].append(pairs[kind == k])
        if any(map(len, rows[2])):
            e, s, t = map(np.concatenate, rows)
            rows.clear()
            back = _Backward(e, s[:, 0])
            goals = np.sort(t[:, 0]).tolist()
            yield pa.record_batch([pa.array(goals, pa.int64()), pa.array([back.flow(t) for t in goals], pa.int64())], names=["node", "cut"])

    return graph.union(own).repartitionById(tasks, F.col("task")).mapInArrow(run, "node long, cut long")
