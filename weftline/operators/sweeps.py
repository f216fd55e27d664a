"""Searches from many sources: each task holds the graph once, as arrays, and takes its share of the sources.

A table of (source, node) rows has sources times nodes of them; here a task's state is a few arrays of the
graph's nodes, and only sums leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored

TASK_SOURCES = 64  #: sources that are worth a task
BLOCK = 256  #: sources whose bits travel together, a multiple of 64
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)  #: of each byte


class Arcs:
    """Outgoing arcs of nodes 0..n-1 by their tails; node holds the nodes' own numbers, start the places of the sources.

    Places follow a search from the first source: what is met together lies together, so searches stay in the cache.
    """

    def __init__(self, src: np.ndarray, dst: np.ndarray, sources: np.ndarray) -> None:
        self.node = np.unique(np.concatenate((src, dst, sources)))
        self.n = len(self.node)
        tail, head, self.start = (np.searchsorted(self.node, x) for x in (src, dst, sources))
        self._set(tail, head)
        place = self._search(self.start[0])
        self.node = self.node[np.argsort(place)]
        self.start = place[self.start]
        self._set(place[tail], place[head])

    def _set(self, tail: np.ndarray, head: np.ndarray) -> None:
        order = np.argsort(tail, kind="stable")
        self.tail, self.head = tail[order], head[order]
        self.count = np.bincount(tail, minlength=self.n)
        self.first = np.cumsum(self.count) - self.count

    def _search(self, source: int) -> np.ndarray:
        """Each node's place in a breadth-first search; what it doesn't reach follows."""
        place, done, front = np.full(self.n, -1), 0, np.array([source])
        while len(front):
            place[front] = np.arange(done, done + len(front))
            done += len(front)
            head = self.after(front)[1]
            head = head[place[head] < 0]
            at = np.arange(len(head))
            place[head] = -2 - at
            front = head[place[head] == -2 - at]
        left = place < 0
        place[left] = np.arange(done, self.n)
        return place

    def by_head(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The arcs' tails in the order of their heads, each head's first place among them, and these heads."""
        order = np.argsort(self.head, kind="stable")
        head = self.head[order]
        first = np.flatnonzero(np.diff(head, prepend=-1))
        return self.tail[order], first, head[first]

    def after(self, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tails and heads of the arcs that leave the front."""
        count = self.count.take(front)
        ends = count.cumsum()
        at = np.repeat(self.first.take(front) - ends + count, count)
        at += np.arange(len(at))
        return np.repeat(front, count), self.head.take(at)


def swept(edges: DataFrame, sources: DataFrame, kernel: Callable[[Arcs, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What the kernel returns for the graph and each task's share of the sources."""
    edges = stored(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")))
    sources = stored(sources.select(F.col("node").cast("long").alias("node")).distinct())
    spark = edges.sparkSession
    tasks = max(1, min(2 * spark.sparkContext.defaultParallelism, -(-sources.count() // TASK_SOURCES)))
    graph = edges.crossJoin(F.broadcast(spark.range(tasks).select(F.col("id").cast("int").alias("task")))).select("task", "src", "dst")
    own = sources.select(F.pmod(F.xxhash64("node"), F.lit(tasks)).cast("int").alias("task"), F.col("node").alias("src"), F.lit(None).cast("long").alias("dst"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst, start = [], [], []
        for batch in batches:
            a, b = batch.column(1), batch.column(2)
            edge = b.is_valid()
            src.append(a.filter(edge).to_numpy(zero_copy_only=False))
            dst.append(b.filter(edge).to_numpy(zero_copy_only=False))
            start.append(a.filter(b.is_null()).to_numpy(zero_copy_only=False))
        if any(map(len, start)):
            start = np.sort(np.concatenate(start))
            arcs = Arcs(np.concatenate(src), np.concatenate(dst), start)
            src, dst = [], []
            yield kernel(arcs, arcs.start)

    return graph.unionByName(own).repartitionById(tasks, F.col("task")).mapInArrow(run, schema)


def _hop_sums(arcs: Arcs, start: np.ndarray, cap: int | None) -> tuple[np.ndarray, np.ndarray]:
    """For each source the number of other nodes it reaches within the cap, and the sum of their distances: 64 sources
    are the bits of a word, and of a block's words only new bits go on."""
    reached, total = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    tails, firsts, heads = arcs.by_head()
    for at in range(0, len(start), BLOCK):
        own = start[at : at + BLOCK]
        words = -(-len(own) // 64)
        seen, step = np.zeros((arcs.n, words), np.uint64), 0
        i = np.arange(len(own))
        np.bitwise_or.at(seen, (own, i // 64), np.uint64(1) << (i % 64).astype(np.uint64))
        front, now = np.unique(own), seen.copy()  # now: the front's bits, 0 elsewhere
        while len(front) and (cap is None or step < cap):
            step += 1
            if 8 * arcs.count[front].sum() > len(tails):
                to, new = heads, np.bitwise_or.reduceat(now.take(tails, axis=0), firsts, axis=0) if len(firsts) else now[:0]
            else:
                tail, head = arcs.after(front)
                order = np.argsort(head, kind="stable")
                head = head[order]
                first = np.flatnonzero(np.diff(head, prepend=-1))
                to, new = head[first], np.bitwise_or.reduceat(now.take(tail[order], axis=0), first, axis=0) if len(first) else now[:0]
            new &= ~seen.take(to, axis=0)
            on = np.flatnonzero(new.any(axis=1))
            now[front] = 0
            front, bits = to[on], new[on]
            now[front] = bits
            seen[front] |= bits
            octets = bits.astype("<u8", copy=False).view(np.uint8)
            for j in range(-(-len(own) // 8)):
                found = (np.bincount(octets[:, j], minlength=256) @ BITS)[: len(own) - 8 * j]
                part = slice(at + 8 * j, at + 8 * j + len(found))
                reached[part] += found
                total[part] += step * found
    return reached, total


def hop_sums(edges: DataFrame, sources: DataFrame, cap: int | None = None) -> DataFrame:
    """node, reached, total: how many other nodes each source reaches within ``cap`` hops, and the sum of their distances."""

    def kernel(arcs: Arcs, start: np.ndarray) -> pa.RecordBatch:
        reached, total = _hop_sums(arcs, start, cap)
        return pa.record_batch([pa.array(arcs.node[start]), pa.array(reached), pa.array(total)], names=["node", "reached", "total"])

    return swept(edges, sources, kernel, "node long, reached long, total long")


def _dependencies(arcs: Arcs, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node's sum of Brandes' dependencies over the sources, and which nodes another source reaches."""
    total, met = np.zeros(arcs.n), np.zeros(arcs.n, bool)
    fresh, place = np.ones(arcs.n, bool), np.zeros(arcs.n, np.int32)
    sigma, delta = np.zeros(arcs.n), np.zeros(arcs.n)
    for s in start:
        front, levels, fronts = np.array([s]), [], []
        fresh[s], sigma[s] = False, 1.0
        while True:
            fronts.append(front)
            tail, head = arcs.after(front)
            on = np.flatnonzero(fresh.take(head))
            if not len(on):
                break
            tail, head = tail.take(on), head.take(on)
            np.add.at(sigma, head, sigma.take(tail))
            row = np.arange(len(head), dtype=np.int32)
            place[head] = row
            front = head[place.take(head) == row]  # each node once
            fresh[front] = False
            levels.append((tail, head))
        for tail, head in reversed(levels):
            np.add.at(delta, tail, sigma.take(tail) / sigma.take(head) * (1 + delta.take(head)))
        seen = np.concatenate(fronts)
        others = seen[1:]
        met[others] = True
        total[others] += delta.take(others)
        fresh[seen], sigma[seen], delta[seen] = True, 0.0, 0.0
    return total, met


def dependencies(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """node, score of every node that a source other than itself reaches: the sum of Brandes' dependencies over the sources."""

    def kernel(arcs: Arcs, start: np.ndarray) -> pa.RecordBatch:
        total, met = _dependencies(arcs, start)
        return pa.record_batch([pa.array(arcs.node[met]), pa.array(total[met])], names=["node", "score"])

    return swept(edges, sources, kernel, "node long, score double").groupBy("node").agg(F.sum("score").alias("score"))
