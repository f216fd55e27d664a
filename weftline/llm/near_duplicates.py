"""SimHash near-duplicates by a segment-popcount embedding.

``fingerprints`` gives every document a 64-bit SimHash of its word shingles.
``components`` links fingerprints that differ in at most ``distance`` bits:

1. copies: only distinct fingerprints go on, each with its smallest document;
2. embedding: 64 bits are 32 segments of two; a fingerprint becomes the
   vector of its segments' bit counts. The Manhattan distance of two such vectors
   never exceeds the Hamming distance of the fingerprints;
3. grid range-join: vectors at Manhattan distance d differ in at most d segments, so of
   d + 3 blocks of segments at least three are equal. A cell is the
   counts of three chosen blocks; fingerprints meet where a cell is equal;
4. within a cell the Manhattan bound goes first, then the exact
   Hamming distance decides. Only a spanning forest of the links leaves the task.
   Cells over ``cell_rows`` are dealt into chunks, and each two chunks meet in a
   task of their own, so no task holds an unbounded cell;
5. components by alternating large-star and small-star rounds, each stored
   in the shared folder.

``similar`` is for stages without a fingerprint contract: it links texts whose sets of
five-word shingles have a Jaccard similarity of ``SIMILAR`` or more. Its candidates are first the
components of fingerprints by steps 1 to 5 (of five-word shingles), where all texts of a component meet.
Fingerprints of texts at the limit differ in about 10 bits, beyond any grid that would still
tell texts apart, so MinHash bands (25 of 5 rows: a pair at the limit shares none once
in 20,000) add the other candidates; of components and bands that bring the same texts together
one goes on, a component first; the exact similarity decides, in chunks as above.

Defined results: null or empty texts (no words) have fingerprint zero and link like
any other; repeated rows keep one row each; a null doc_id stays null and
never becomes a component's id unless the component has no other; an empty
table gives no rows; extra columns are ignored, whatever their names; a very long text is read
whole, its shingles in blocks of 100,000.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame

from .common import F, arrow_schema, doc_columns, materialise, mix, spare, text_key, tidy

SEED = 42
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
CELL_ROWS = 1024
SIMILAR, WORDS = 0.8, 5
BANDS, BAND_ROWS = 25, 5
CELL_TEXTS = 512
SEEN_KEYS = 200_000  # keys of texts that a task remembers
BROADCAST_KEYS = 1_000_000  # keys or ids of eight bytes that a broadcast may hold


def simhash(text: str | None, words_per_shingle: int = 3) -> int:
    """Signed 64-bit fingerprint of one text."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        h = xxhash.xxh64_intdigest(b" ".join(words), SEED)
        return h - (1 << 64) if h >> 63 else h
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = words_per_shingle - 1
    digest = xxhash.xxh64_digest
    votes = np.zeros(64, np.int64)
    s, e = starts[: len(words) - k].tolist(), ends[k:].tolist()
    for at in range(0, len(s), 100_000):
        h = b"".join([digest(whole[i:j], SEED) for i, j in zip(s[at : at + 100_000], e[at : at + 100_000], strict=True)])
        votes += np.unpackbits(np.frombuffer(h, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(s)).view(">i8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every document."""
    schema = arrow_schema("doc_id long, fp long")

    def run(batches):
        for batch in batches:
            fps = [simhash(t.as_py(), words_per_shingle) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], schema=schema)

    return doc_columns(docs).mapInArrow(run, "doc_id long, fp long")


def _embedding(fp: Column) -> Column:
    """32 segments' bit counts, two bits each, in one long."""
    one = fp.bitwiseXOR(F.shiftrightunsigned(fp, 1)).bitwiseAND(F.lit(0x5555555555555555))
    two = fp.bitwiseAND(F.shiftleft(fp, 1)).bitwiseAND(F.lit(-0x5555555555555556))
    return one.bitwiseOR(two)


def _masks(distance: int) -> list[int]:
    """For each choice of three of distance + 3 blocks, the bits of their segments (as a signed long)."""
    blocks = distance + 3
    edges = [2 * (32 * i // blocks) for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [a | b | c for a, b, c in combinations(parts, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n rows reaches over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _near(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    """Manhattan distance of the embeddings first, then the exact Hamming distance."""
    odd = np.uint64(0x5555555555555555)
    u, v = x - ((x >> np.uint64(1)) & odd), y - ((y >> np.uint64(1)) & odd)
    d = u ^ v  # equal segments are 0; of two counts 0..2 the difference is 2 only for 0 and 2, i.e. pattern 10 from 00 and 10
    one, two = d & odd, (d >> np.uint64(1)) & odd & ~(d & odd)
    bound = np.bitwise_count(one).astype(np.int16) + 2 * np.bitwise_count(two).astype(np.int16)
    return (bound <= distance) & (np.bitwise_count(x ^ y) <= distance)


def _cell_links(distance: int):
    schema = arrow_schema("a long, b long")

    def links(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        """cell: an ascending number for each row's cell."""
        edges = np.flatnonzero(np.diff(cell)) + 1
        starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(cell)]))
        sizes = np.repeat(ends - starts, ends - starts)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(1, int(min(32, sizes.max(initial=0)))):
            i = np.flatnonzero((cell[k:] == cell[:-k]) & (sizes[:-k] <= 32))
            i = i[_near(fp[i], fp[i + k], distance)]
            a.append(i)
            b.append(i + k)
        label = _forest(len(cell), np.concatenate(a), np.concatenate(b))
        for s, e in zip(starts, ends, strict=True):
            if e - s > 32:
                own, found = fp[s:e], ([], [])
                for at in range(0, e - s, 256):
                    i, j = np.nonzero(_near(own[at : at + 256, None], own[None, :], distance))
                    found[0].append(i + at)
                    found[1].append(j)
                label[s:e] = s + _forest(e - s, np.concatenate(found[0]), np.concatenate(found[1]))
        x, y = fp.view(np.int64), fp.view(np.int64)[label]
        on = x != y
        return pa.record_batch([pa.array(x[on]), pa.array(y[on])], schema=schema)

    def run(batches):
        kept: list[np.ndarray] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]))
            size += batch.num_rows
            if size < 20_000:
                continue
            rows = np.concatenate(kept, axis=1)
            last = np.flatnonzero((rows[:4] != rows[:4, -1:]).any(axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield links(_numbers(rows[:4, :cut]), rows[4, :cut].view(np.uint64))
            kept, size = [rows[:, cut:]], rows.shape[1] - cut
        if size:
            rows = np.concatenate(kept, axis=1)
            yield links(_numbers(rows[:4]), np.ascontiguousarray(rows[4]).view(np.uint64))

    return run


def _numbers(keys: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))))


def links(distinct: DataFrame, distance: int = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that span each cell's connected parts."""
    cells = F.array(*[_embedding(F.col("fp")).bitwiseAND(F.lit(m)) for m in _masks(distance)])
    keyed = distinct.select("fp", F.posexplode(cells).alias("choice", "cell"))
    sizes = keyed.groupBy("choice", "cell").count().where("count > 1")
    met = keyed.join(sizes, ["choice", "cell"]).withColumn("chunks", F.ceil(F.col("count") / cell_rows).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    met = met.withColumn("own", own).select("choice", "cell", "fp", "own", F.explode(F.expr("sequence(0, chunks - 1)")).alias("other"))
    met = met.select("choice", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    met = met.repartition("choice", "cell", "i", "j").sortWithinPartitions("choice", "cell", "i", "j", "fp")
    return met.mapInArrow(_cell_links(distance), "a long, b long")


def stars(edges: DataFrame) -> DataFrame:
    """node, root for every node of the links a-b: root is the component's smallest node.

    Rounds go on until none changes a link: labels only fall, so there is an end, and no cap could cut it short.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    edges = materialise(edges, "links")
    before, rows = None, edges.count()  # a round never adds links
    while True:
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select("v", "m").where("v <> m").distinct()
        # small star: each node's smaller neighbours, and the node, go to the smallest of them
        lower = large.groupBy("v").agg(F.min("m").alias("r"))
        small = large.join(lower, "v").select(F.col("m").alias("hi"), F.col("r").alias("lo")).where("hi <> lo")
        edges = materialise(small.union(lower.select(F.col("v").alias("hi"), F.col("r").alias("lo"))).select("lo", "hi").distinct(), "stars", rows)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy("hi").agg(F.min("lo").alias("root")).withColumnRenamed("hi", "node")


def components(docs: DataFrame, distance: int = 2) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable) of every row."""
    fps = materialise(fingerprints(docs), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = materialise(distinct, "distinct")
    roots = stars(links(distinct.select("fp"), distance))
    tidy(docs.sparkSession)
    labelled = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = labelled.join(smallest, "root").select("fp", "component_id")
    return fps.join(labelled, "fp").select("doc_id", "fp", "component_id")


def shingles(text: str | None, words_per_shingle: int = WORDS) -> np.ndarray:
    """Ascending 64-bit hashes of a text's shingles; a shorter text is one shingle."""
    words = (text or "").encode().translate(LOWER).split()
    k = words_per_shingle
    parts = {b" ".join(words[i : i + k]) for i in range(max(len(words) - k, 0) + 1)}
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64, len(parts)))


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(x) + len(y) - len(np.union1d(x, y))
    return both / (len(x) + len(y) - both)


def _bands(x: np.ndarray) -> np.ndarray:
    """One hash for each band: of the least of its shingles in BAND_ROWS orders."""
    orders = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64))
    least = np.full(len(orders), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), 1000):
        least = np.minimum(least, mix(x[None, at : at + 1000] ^ orders[:, None]).min(axis=1))
    out = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        out = mix(out ^ row) + row
    return out.view(np.int64)


def _band_rows(bands: int):
    """Each text's fingerprint (as band -1) and its buckets; a copy in the same task mostly goes with the first."""
    schema = arrow_schema("key long, band int, bucket long")

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keys, buckets = [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    if key not in seen:
                        seen.add(key)
                        keys.append(key)
                        buckets.append([simhash(text.as_py(), WORDS)])
                        if bands:
                            buckets.append(_bands(shingles(text.as_py()))[:bands])
                if len(seen) > SEEN_KEYS:
                    seen.clear()
                if keys:
                    band = np.tile(np.arange(-1, bands, dtype=np.int32), len(keys))
                    yield pa.record_batch([pa.array(np.repeat(np.array(keys, np.int64), bands + 1)), pa.array(band), pa.array(np.concatenate(buckets).astype(np.int64))], schema=schema)

    return run


def _similar_links(batches):
    """Rows come sorted by cell; links of each cell's similar texts that span its connected parts."""
    schema = arrow_schema("a long, b long")
    cell, keys, sets = None, [], []

    def links() -> pa.RecordBatch:
        root = list(range(len(keys)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        a, b = [], []
        for i in range(len(keys)):
            for j in range(i):
                x, y = find(i), find(j)
                small, large = sorted((len(sets[i]), len(sets[j])))
                if x != y and small >= SIMILAR * large and _jaccard(sets[i], sets[j]) >= SIMILAR:
                    root[x] = y
                    a.append(keys[i])
                    b.append(keys[j])
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:4] != cell:
                if len(keys) > 1:
                    yield links()
                cell, keys, sets = row[:4], [], []
            keys.append(row[4])
            sets.append(shingles(row[5]))
    if len(keys) > 1:
        yield links()


def _few(keys: DataFrame) -> DataFrame:
    """A stored table of keys, for a broadcast while it is small; beyond, the join shuffles."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def similar(docs: DataFrame, cell_texts: int = CELL_TEXTS, bands: int = BANDS) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable over texts of similarity SIMILAR) of every row. bands: of MinHash, beside the fingerprints."""
    keyed = doc_columns(docs).select("doc_id", text_key().alias("key"), "text")
    members = materialise(keyed.select("key", "text").mapInArrow(_band_rows(bands), "key long, band int, bucket long").distinct(), "bands")
    rows = members.count()
    texts_most = rows // (bands + 1)
    prints = members.where("band = -1").select("key", F.col("bucket").alias("fp"))
    near = stars(links(materialise(prints.select("fp").distinct(), "distinct", texts_most)))
    near = prints.join(near, prints.fp == near.node, "left").select("key", F.lit(-1).alias("band"), F.coalesce("root", "fp").alias("bucket")).repartition("key")
    members = members.where("band >= 0").unionByName(materialise(near, "components", texts_most))
    tidy(docs.sparkSession)
    sizes = members.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("same")).where("n > 1")
    cells = sizes.groupBy("n", "same").agg(F.min(F.struct("band", "bucket")).alias("cell")).select("cell.*", "n")
    met = materialise(members.join(cells, ["band", "bucket"]), "met", rows)
    texts = keyed.join(_few(materialise(met.select("key").distinct(), "keys", texts_most)), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    met = met.withColumn("chunks", F.ceil(F.col("n") / cell_texts).cast("int")).withColumn("own", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    met = met.select("band", "bucket", "key", "own", F.explode(F.expr("sequence(0, chunks - 1)")).alias("other"))
    met = met.select("band", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key").join(texts, "key")
    met = met.select("band", "bucket", "i", "j", "key", "text").repartition("band", "bucket", "i", "j").sortWithinPartitions("band", "bucket", "i", "j", "key")
    roots = stars(met.mapInArrow(_similar_links, "a long, b long"))
    tidy(docs.sparkSession)
    least = keyed.groupBy("key").agg(F.min("doc_id").alias("least"))
    labelled = materialise(least.join(roots, least.key == roots.node, "left").select("key", "least", F.coalesce("root", "key").alias("root")), "labelled", texts_most)
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return keyed.select("doc_id", "key").join(labelled.join(smallest, "root").select("key", "component_id"), "key").select("doc_id", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    found = components(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """docs with one row of each component (of ``components``, or those given): of its smallest doc_id, one row (of equal ids the smallest text, then the row that is the smallest as JSON)."""
    found = materialise((components(docs) if found is None else found).groupBy("doc_id", "component_id").agg(F.count("*").alias("n")), "groups")
    own = spare(docs, "__id")
    gone = found.groupBy("doc_id").agg(F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")).where("NOT stays").select(F.col("doc_id").alias(own))
    rows = docs.join(_few(materialise(gone, "gone")), docs.doc_id.cast("long").eqNullSafe(F.col(own)), "left_anti")
    # a doc_id is a key; where rows repeat one, a single row of it stays
    again = found.groupBy("doc_id").agg(F.sum("n").alias("n")).where("n > 1").limit(1).count()
    if not again:
        return rows
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    least = rows.groupBy(F.col("doc_id").alias(own)).agg(F.min_by(row, F.struct(F.col("text"), F.to_json(row))).alias("__row"))
    return least.select("__row.*").select(*[F.col(f"`{c}`") for c in names])
