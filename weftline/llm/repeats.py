"""Substring dedup by recompression: words that stand in a repeated window of words go.

A document is a string of words, each named by a 64-bit hash of its bytes. Rounds of
recompression shorten the string: first every run a a .. a is named by (a, length),
then, round by round, every pair a b in which a hash of a's name says "left" and that of
b's says "right" is named by (a, b). A name is a hash of what it stands for, so
every task gives equal substrings the same names without asking any other.
A pair depends on nothing but its two symbols. Hence in a window the symbols of
each round are known from the window's words alone, but for those at its two
ends that something outside could join: the core of the window.

``anchors``: each window of ``window`` words chooses the symbol of its core, at the highest
round that leaves one, that spans the most words (then by hash). Equal windows
choose equal symbols at equal offsets. Neighbouring windows mostly choose the
same occurrence, so a document has about one anchor for 17 words; an anchor has
its context: the words of all windows that chose it.

Spark then counts symbols: one that occurs once ends there. Of the others, contexts are
counted; equal contexts verify all their windows at once. Where one symbol has several
contexts, the windows of one representative of each are counted one by one.
Equality is that of two 64-bit hashes together (symbol and context, or a window's hash of all words in order
and one of its first, middle and last word), over 64-bit hashes of the words: among n different windows a
false repeat is expected about n * n / 2 ** 129 times, among w different words w * w / 2 ** 65 times.

Defined results: null and empty texts have no words; a text shorter than a window has
no window and keeps every word; repeated rows are
separate documents (all their windows are repeated) and each gets its row; an empty
table gives no rows; extra columns are ignored; texts of any length are read whole, in
slices that share ``window`` - 1 words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import F, U64, arrow_schema, discard, doc_columns, materialise, mix, text_key, tidy

WINDOW = 35
ROUNDS = 3  # of pairs, after the round of runs
SLICE = 200_000
_B = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_B ** i and its inverse modulo 2 ** 64, for i < n at least."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        inverse = U64(pow(_B, -1, 1 << 64))
        size = max(n, 1024)
        for name, base in (("up", U64(_B)), ("down", inverse)):
            x = np.full(size, base, U64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def digests(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(U64)


class Hashes:
    """Hashes of any stretch of words, from prefix sums."""

    def __init__(self, d: np.ndarray) -> None:
        up, self.down = _powers(len(d) + 1)
        self.sums = np.concatenate((np.zeros(1, U64), np.cumsum(d * up[: len(d)], dtype=U64)))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def _leftmost_best(score: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of each range lo..hi (inclusive) the first place of the largest score: a sparse table of places."""
    width = hi - lo + 1
    depth = int(width.max()).bit_length()
    places = [np.arange(len(score), dtype=np.int32)]
    for j in range(1, depth):
        half = 1 << (j - 1)
        a, b = places[-1][: len(places[-1]) - half], places[-1][half:]
        places.append(np.where(score[a] >= score[b], a, b))
    out = np.empty(len(lo), np.int32)
    level = np.frexp(width.astype(np.float32))[1] - 1
    for j in range(depth):
        at = np.flatnonzero(level == j)
        if len(at):
            a, b = places[j][lo[at]], places[j][hi[at] - (1 << j) + 1]
            out[at] = np.where(score[a] >= score[b], a, b)
    return out


def chosen(d: np.ndarray, part: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Anchors of the windows of several texts, one after another. d: words' names; part: the text of each word, ascending.

    Returns, for each anchor: the first window's start, the number of windows, the symbol, the context's hash, and
    the weight (2 where the anchor's windows are equal to one another and there is more than one).
    """
    n = len(d)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64)
    if n < window:
        return none
    p = np.flatnonzero(part[: n - window + 1] == part[window - 1 :])
    if not len(p):
        return none
    of = Hashes(d)
    # runs
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (part[1:] != part[:-1])))
    run = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    length = np.diff(np.concatenate((start, [n])))
    names = mix(d[start] + mix(length.astype(U64)))
    text = part[start]
    lo, hi = run[p] + 1, run[p + window - 1] - 1
    anchor_start, anchor_name = p.copy(), np.zeros(len(p), U64)
    one = run[p] == run[p + window - 1]
    two = ~one & (lo > hi)
    anchor_start[one] = start[run[p[one]]]
    anchor_name[one | two] = of(p[one | two], p[one | two] + window)
    open_ = np.flatnonzero(lo <= hi)
    lo, hi = lo[open_], hi[open_]

    def settle(which: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """The windows ``which`` choose among symbols a..b of the present round."""
        if len(which):
            score = (np.minimum(length, 255).astype(U64) << U64(56)) | (mix(names ^ U64(_B)) >> U64(8))
            first = int(a.min())
            at = _leftmost_best(score[first : int(b.max()) + 1], a - first, b - first) + first
            anchor_start[which], anchor_name[which] = start[at], names[at]

    for r in range(rounds):
        left = (mix(names + U64((r + 1) * _B % (1 << 64))) >> U64(63)).astype(bool)
        a, b = lo + ~left[lo], hi - left[hi]
        gone = a > b
        settle(open_[gone], lo[gone], hi[gone])
        open_, a, b = open_[~gone], a[~gone], b[~gone]
        first = np.zeros(len(names), bool)
        first[:-1] = left[:-1] & ~left[1:] & (text[1:] == text[:-1])
        keep = np.concatenate(([True], ~first[:-1]))
        to = np.cumsum(keep) - 1
        joined = np.flatnonzero(first)
        names, length = names.copy(), length.copy()
        names[joined] = mix(mix(names[joined]) + names[joined + 1] * U64(0xC2B2AE3D27D4EB4F))
        length[joined] += length[joined + 1]
        names, length, start, text = names[keep], length[keep], start[keep], text[keep]
        lo, hi = to[a], to[b]
    settle(open_, lo, hi)
    # windows next to one another with the same anchor; those in two runs stand alone
    alone = np.zeros(len(p), bool)
    alone[two] = True
    change = np.concatenate(([True], (np.diff(p) != 1) | (anchor_start[1:] != anchor_start[:-1]) | (anchor_name[1:] != anchor_name[:-1]) | alone[1:] | alone[:-1]))
    g = np.flatnonzero(change)
    count = np.diff(np.concatenate((g, [len(p)])))
    a = p[g]
    same = one[g]
    end = np.where(same, a + window, a + count - 1 + window)
    offset = np.where(same, 0, anchor_start[g] - a).astype(U64)
    context = mix(of(a, end) + offset * U64(_B))
    symbol = np.where(same | alone[g], mix(anchor_name[g]), anchor_name[g])
    return a, count, symbol, context, np.where(same & (count > 1), 2, 1)


def _texts(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[list[tuple[int, int, int]], list[bytes]]]:
    """Slices (doc_id, key, first word) and their words one after another, about SLICE words at a time."""
    rows: list[tuple] = []
    words: list[bytes] = []
    for batch in batches:
        for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            own = (text.as_py() or "").encode().split()
            for at in range(0, max(1, len(own) - window + 1), SLICE):
                part = own[at : at + SLICE + window - 1]
                if len(part) < window:
                    continue
                if words and len(words) + len(part) > SLICE:
                    yield rows, words
                    rows, words = [], []
                rows.append((doc_id, key, at, len(part)))
                words += part
    if rows:
        yield rows, words


def anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key, a (first window), n (windows), symbol, context, weight. docs: doc_id, key, text."""
    ddl = "doc_id long, key long, a int, n int, symbol long, context long, weight int"
    schema = arrow_schema(ddl)

    def run(batches):
        for rows, words in _texts(batches, window):
            sizes = np.array([r[3] for r in rows])
            part = np.repeat(np.arange(len(rows)), sizes)
            a, n, symbol, context, weight = chosen(digests(words), part, window)
            of = part[a]
            base = np.cumsum(sizes) - sizes
            at = a - base[of] + np.array([r[2] for r in rows])[of]
            ids, keys = pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())
            take = pa.array(of)
            yield pa.record_batch([ids.take(take), keys.take(take), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(symbol.view(np.int64)), pa.array(context.view(np.int64)), pa.array(weight, pa.int32())], schema=schema)

    return docs.mapInArrow(run, ddl)


def _windows(asked: DataFrame, window: int) -> DataFrame:
    """doc_id, key, a, h, check, weight: each window asked for, with its hash and one of three of its words. asked: doc_id, key, text, want (a, n, weight)."""
    ddl = "doc_id long, key long, a int, h long, check long, weight long"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for doc_id, key, text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                d = digests(text.as_py().encode().split())
                of = Hashes(d)
                n = np.array([w["n"] for w in want])
                first = np.repeat(np.array([w["a"] for w in want]), n)
                a = first + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
                h = of(a, a + window)
                check = mix(d[a] ^ mix(d[a + window // 2] ^ mix(d[a + window - 1])))
                m = len(a)
                yield pa.record_batch([pa.array([doc_id] * m, pa.int64()), pa.array([key] * m, pa.int64()), pa.array(a, pa.int32()), pa.array(h.view(np.int64)), pa.array(check.view(np.int64)), pa.array(np.repeat(np.array([w["weight"] for w in want]), n), pa.int64())], schema=schema)

    return asked.mapInArrow(run, ddl)


def _same_row(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Joined by doc_id (null equals null) and key; the right side's two columns go."""
    right = right.withColumnRenamed("doc_id", "__d").withColumnRenamed("key", "__k")
    return left.join(right, (F.col("key") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__d")), how).drop("__d", "__k")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key, a, n: stretches of n windows from a that occur elsewhere too (stored). docs: doc_id, key, text.

    What is stored on the way goes as soon as its successor is stored, else its bytes would add up to the input's.
    """
    every = materialise(anchors(docs, window), "anchors")
    rows = every.count()
    # stored, so that a symbol that is very common can be split between tasks where it is joined
    often = materialise(every.groupBy("symbol").agg(F.sum("weight").alias("w")).where("w > 1").select("symbol"), "symbols", rows // 2)
    found = materialise(every.join(often, "symbol"), "often")
    discard(every, often)
    tidy(docs.sparkSession)
    contexts = found.groupBy("symbol", "context").agg(F.sum("weight").alias("weight"), F.min(F.struct("doc_id", "key", "a", "n")).alias("one"))
    contexts = materialise(contexts, "contexts")
    whole = contexts.where("weight > 1").select("symbol", "context")
    whole = found.join(whole, ["symbol", "context"]).select("doc_id", "key", "a", "n")
    several = materialise(contexts.groupBy("symbol").count().where("count > 1").select("symbol"), "several", rows // 2)
    mixed = contexts.join(several, "symbol").select("one.*", "weight")
    mixed = mixed.groupBy("doc_id", "key").agg(F.collect_list(F.struct("a", "n", "weight")).alias("want"))
    tidy(docs.sparkSession)
    windows = materialise(_windows(_same_row(docs, mixed, "inner").select("doc_id", "key", "text", "want"), window), "windows")
    discard(several)
    tidy(docs.sparkSession)
    twice = materialise(windows.groupBy("h", "check").agg(F.sum("weight").alias("w")).where("w > 1").select("h", "check"), "twice")
    tidy(docs.sparkSession)
    single = windows.where("weight = 1").join(twice, ["h", "check"]).select("doc_id", "key", "a", F.lit(1).alias("n"))
    spans = materialise(whole.union(single).distinct(), "spans")
    discard(found, contexts, windows, twice)
    del whole, single, mixed
    tidy(docs.sparkSession)
    return spans


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) of every document."""
    keyed = doc_columns(docs).select("doc_id", text_key().alias("key"), "text")
    spans = repeated_spans(keyed, window).groupBy("doc_id", "key").agg(F.collect_list(F.struct("a", "n")).alias("spans"))
    rows = _same_row(keyed, spans, "left").select("doc_id", "text", "spans")
    ddl = "doc_id long, n_words long, n_removed long, kept string"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, gone, kept = [], [], []
                for text, spans in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                    words = (text.as_py() or "").encode().split()
                    n.append(len(words))
                    if spans:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, [s["a"] for s in spans], 1)
                        np.add.at(edge, [s["a"] + s["n"] + window - 1 for s in spans], -1)
                        out = np.cumsum(edge[:-1]) > 0
                        words = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
                    gone.append(n[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], schema=schema)

    return rows.mapInArrow(run, ddl)


def removed_repeats(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
