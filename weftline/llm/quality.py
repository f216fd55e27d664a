"""Quality rules: word statistics, and bands of n-gram perplexity for each language.

The language model is a character 5-gram model with modified Kneser-Ney smoothing.
Spark counts the highest order over all documents (each task sends its distinct
n-grams with their counts) and derives the lower orders' continuation counts,
the three discounts of each order and the interpolated probabilities with
aggregates and joins. As every scored n-gram was counted, a score needs
the highest order alone. Its log-probabilities go to the executors as sorted arrays of
hashes, in blocks of about ``block_grams`` n-grams (12 bytes each): a model over
that size is scored in as many passes as it has blocks, so what is
broadcast never exceeds one block.

A document's perplexity is taken per word (log2: bits per word). For every
language the bands are the median less ``low`` and plus ``high`` robust
deviations (1.4826 times the median absolute deviation, and never less than 2 % of
the median), over the distinct texts that pass the base rules.

Defined results: null or empty texts have no words and fail the base rules; a null
language is the empty language (both are one); repeated rows each get their row, with
equal results; an empty table gives no rows; extra columns are ignored, whatever their
names; a very long text is scored whole, in arrays of about ten times its size, with no n-gram lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window

from .common import F, U64, arrow_schema, materialise, mix, spare, text_key, tidy

ORDER = 5
BROADCAST_FAILED = 500_000  # keys of failed texts (about 30 bytes each) that a broadcast may hold
BROADCAST_LANGUAGES = 10_000  # rows of one language each that a broadcast may hold
LOW, HIGH = 9.0, 6.0
BLOCK_GRAMS = 4_000_000
HELD_GRAMS = 1_500_000  # n-grams of all languages (28 bytes each) that a task holds before it merges or sends them
SYMBOLS = "#*$%&|<>"
START = 2  # stands before a text's first character
_BITS = 60 // ORDER
_K = U64(0x9E3779B97F4A7C15)


# --- base rules ---------------------------------------------------------------------------------------------


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    joined = b"".join(words)
    chars = len(joined) if len(joined) == len(words) or text.isascii() else len(joined.decode())
    seen: set[bytes] = set()
    dup = 0
    if b"\n" in raw:
        for line in raw.split(b"\n"):
            if line in seen:
                dup += 1
            elif line and line.split(None, 1):
                seen.add(line)
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    d = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(U64)
    h = mix(mix(mix(d[:-2]) + d[1:-1]) + d[2:])
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    hit = twice[at] == h
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(h) + k] |= hit
    return int(covered.sum())


# --- n-grams as arrays --------------------------------------------------------------------------------------


def _codes(text: str) -> np.ndarray:
    """Code points behind ORDER - 1 start marks; white space becomes a space, a digit becomes 0."""
    c = np.frombuffer(("\x02" * (ORDER - 1) + text).encode("utf-32-le", "replace"), np.uint32)
    c = np.where((c >= 48) & (c <= 57), np.uint32(48), c)
    return np.where((c >= 9) & (c <= 13), np.uint32(32), c)


def _chunks(batches: Iterator[pa.RecordBatch], size: int = 250_000) -> Iterator[tuple[list[tuple], np.ndarray]]:
    """Rows, and their texts' code points one after another, about ``size`` at a time."""
    rows: list[tuple] = []
    parts: list[np.ndarray] = []
    held = 0
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() for c in columns)
            parts.append(_codes(row[-1] or ""))
            rows.append(row)
            held += len(parts[-1])
            if held >= size:
                yield rows, np.concatenate(parts)
                rows, parts, held = [], [], 0
    if rows:
        yield rows, np.concatenate(parts)


def _pack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Every n-gram as one number, and the alphabet that the number's digits index; None if the alphabet is too large."""
    used = np.zeros(int(codes.max(initial=0)) + 1, bool)
    used[codes] = True
    alphabet = np.flatnonzero(used).astype(np.uint32)
    if len(alphabet) > 1 << _BITS:
        return None
    index = np.zeros(len(used), U64)
    index[alphabet] = np.arange(len(alphabet), dtype=U64)
    c = index[codes]
    n = len(codes) - ORDER + 1
    packed = np.zeros(n, U64)
    for k in range(ORDER):
        packed = (packed << U64(_BITS)) | c[k : k + n]
    return packed[codes[ORDER - 1 :] != START], alphabet


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (rows of code points) and their counts."""
    if (got := _pack(codes)) is not None:
        packed, alphabet = got
        packed.sort()
        first = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1]))) if len(packed) else np.zeros(0, np.int64)
        counts = np.diff(np.concatenate((first, [len(packed)])))
        keys = packed[first]
        digits = [(keys >> U64(_BITS * (ORDER - 1 - k))) & U64((1 << _BITS) - 1) for k in range(ORDER)]
        return np.stack([alphabet[d.astype(np.int64)] for d in digits], axis=1) if len(keys) else np.zeros((0, ORDER), np.uint32), counts
    windows = np.lib.stride_tricks.sliding_window_view(codes, ORDER)
    return np.unique(windows[windows[:, -1] != START], axis=0, return_counts=True)


def _hashes(windows: np.ndarray, salt: np.ndarray | np.uint64) -> np.ndarray:
    """windows: ORDER columns of code points (a tuple of arrays)."""
    h = np.zeros(len(windows[0]), U64) + salt
    for c in windows:
        h = h * _K + c
    return mix(h)


def _salt(lang: str) -> np.uint64:
    return U64(xxhash.xxh64_intdigest(lang.encode(), 7))


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, c over all documents: the highest order's counts."""
    schema = arrow_schema("lang string, gram string, c long")

    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = lambda lang: sum(len(p[0]) for p in held[lang])

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            parts = held[lang]
            if len(parts) > 1:
                rows, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                parts.clear()
                h = _hashes(tuple(rows[:, k].astype(U64) for k in range(ORDER)), U64(1))
                order = np.argsort(h)
                h = h[order]
                first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                parts.append((rows[order[first]], np.add.reduceat(counts[order], first)))
            return parts[0]

        def out(lang: str):
            rows, counts = merged(lang)
            for at in range(0, len(rows), 50_000):
                text = np.ascontiguousarray(rows[at : at + 50_000].astype("<u4")).tobytes().decode("utf-32-le", "replace")
                yield pa.record_batch([pa.array([lang] * (len(text) // ORDER)), pa.array([text[i : i + ORDER] for i in range(0, len(text), ORDER)]), pa.array(counts[at : at + 50_000], pa.int64())], schema=schema)

        for rows, codes in _chunks(batches, 500_000):
            lengths = [len(r[1] or "") + ORDER - 1 for r in rows]
            ends = np.cumsum(lengths)
            by: dict[str, list[np.ndarray]] = {}
            for (lang, _), end, n in zip(rows, ends, lengths, strict=True):
                by.setdefault(lang, []).append(codes[end - n : end])
            for lang, parts in by.items():
                got = _counted(np.concatenate(parts))
                if len(got[0]):
                    held.setdefault(lang, []).append(got)
            if sum(map(size, held)) > HELD_GRAMS:
                for lang in held:
                    merged(lang)
                while sum(map(size, held)) > HELD_GRAMS // 2:  # bounded memory: what this task sends may hold an n-gram twice
                    most = max(held, key=size)
                    yield from out(most)
                    del held[most]
        for lang in list(held):
            yield from out(lang)
            del held[lang]

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, logp (log2) of every n-gram of the highest order: modified Kneser-Ney, interpolated."""
    levels, rows = {order: counts}, counts.count()  # no level has more rows than the highest order
    for n in range(order - 1, 0, -1):
        levels[n] = materialise(levels[n + 1].groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("c")), f"level{n}", rows)
    below = None
    for n in range(1, order + 1):
        at = levels[n].withColumn("ctx", F.substring("gram", 1, n - 1)).withColumn("low", F.substring("gram", 2, n - 1))
        n1, n2, n3, n4 = (F.count_if(F.col("c") == k) for k in (1, 2, 3, 4))
        of = at.groupBy("lang").agg(n1.alias("n1"), n2.alias("n2"), n3.alias("n3"), n4.alias("n4"), F.count("*").alias("types"))
        y = F.expr("IF(n1 > 0 AND n2 > 0, n1 / (n1 + 2.0 * n2), 0.5D)")
        good = F.expr("n1 > 0 AND n2 > 0 AND n3 > 0 AND n4 > 0")
        # where counts of counts are too few, the usual fixed discounts
        of = of.withColumn("y", y.cast("double"))
        for k, (a, b) in enumerate((("n1", "n2"), ("n2", "n3"), ("n3", "n4")), 1):
            d = F.lit(float(k)) - (k + 1.0) * F.col("y") * F.col(b) / F.greatest(F.col(a), F.lit(1))
            of = of.withColumn(f"d{k}", F.when(good & (d > 0) & (d < k), d).otherwise(F.lit(0.5 * k)))
        of = of.select("lang", "d1", "d2", "d3", "types")
        ctx = at.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.count_if(F.col("c") == 1).alias("m1"), F.count_if(F.col("c") == 2).alias("m2"), F.count_if(F.col("c") > 2).alias("m3"))
        ctx = ctx.join(of, "lang").withColumn("gamma", F.expr("(d1 * m1 + d2 * m2 + d3 * m3) / total"))
        p = at.join(ctx, ["lang", "ctx"])
        main = F.expr("greatest(c - CASE WHEN c = 1 THEN d1 WHEN c = 2 THEN d2 ELSE d3 END, 0D) / total")
        if below is None:
            p = p.withColumn("p", main + F.col("gamma") / F.col("types"))
        else:
            p = p.join(below, ["lang", "low"]).withColumn("p", main + F.col("gamma") * F.col("q"))
        below = materialise(p.select("lang", F.col("gram").alias("low"), F.col("p").alias("q")), f"p{n}", rows)
        tidy(counts.sparkSession)
    return below.select("lang", F.col("low").alias("gram"), F.log2("q").alias("logp"))


def hashed(model: DataFrame) -> DataFrame:
    """h, logp: the n-grams as the hashes that a text's windows get, computed on the executors."""
    schema = pa.schema([("h", pa.int64()), ("logp", pa.float32())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                codes = np.frombuffer("".join(batch.column(1).to_pylist()).encode("utf-32-le", "replace"), np.uint32).reshape(-1, ORDER).astype(U64)
                langs = batch.column(0).to_pylist()
                salts = {x: _salt(x) for x in set(langs)}
                h = _hashes(tuple(codes[:, k] for k in range(ORDER)), np.array([salts[x] for x in langs], U64))
                yield pa.record_batch([pa.array(h.view(np.int64)), batch.column(2).cast(pa.float32())], schema=schema)

    return model.select("lang", "gram", "logp").mapInArrow(run, "h long, logp float")


class Model:
    """One block of the model: hashes in ascending order, the log-probability of each, and where each prefix of hash bits starts."""

    def __init__(self, table: pa.Table) -> None:
        h = table.column("h").to_numpy().view(U64)
        order = np.argsort(h)
        self.hashes, self.logp = h[order], table.column("logp").to_numpy()[order]
        self.shift = max(1, 64 - max(1, int(len(h)).bit_length()))
        starts = np.searchsorted(self.hashes >> U64(self.shift), np.arange((1 << (64 - self.shift)) + 1, dtype=U64))
        self.starts = starts.astype(np.int32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """log2 p of each hash; 0 for what this block does not hold."""
        out = np.zeros(len(h), np.float32)
        if not len(self.hashes):
            return out
        at = self.starts[(h >> U64(self.shift)).astype(np.int64)]
        rest, want, last = np.arange(len(h)), h, len(self.hashes) - 1
        while len(rest):
            here = self.hashes[np.minimum(at, last)]
            hit = here == want
            out[rest[hit]] = self.logp[at[hit]]
            go = (here < want) & (at < last)
            rest, want, at = rest[go], want[go], at[go] + 1
        return out


def scores(docs: DataFrame, model: DataFrame, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """doc_id, key, lang, the base counts, and bits (minus log2 of the text's probability) of every document."""
    spark = docs.sparkSession
    n = model.count()
    blocks = max(1, -(-n // block_grams))
    base = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    ddl = f"doc_id long, key long, lang string, {base}, bits double"
    schema = arrow_schema(ddl)
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))

    def scored(block: int) -> DataFrame:
        part = model if blocks == 1 else model.where(F.pmod(F.xxhash64("lang", "gram"), F.lit(blocks)) == block)
        held = spark.sparkContext.broadcast(Model(hashed(part).toArrow()))

        def run(batches):
            score = held.value
            for rows, codes in _chunks(batches):
                lengths = np.array([len(r[3] or "") + ORDER - 1 for r in rows])
                ends = np.cumsum(lengths)
                salts = {x: _salt(x) for x in {r[2] for r in rows}}
                m = len(codes) - ORDER + 1
                salt = np.repeat(np.array([salts[r[2]] for r in rows], U64), lengths)[:m] if len(salts) > 1 else next(iter(salts.values()))
                if m > 0:
                    c = codes.astype(U64)
                    logp = score(_hashes(tuple(c[k : k + m] for k in range(ORDER)), salt))
                    logp[codes[ORDER - 1 :] == START] = 0  # of the windows over two texts, those of the next text's marks
                else:
                    logp = np.zeros(0, np.float32)
                sums = np.concatenate(([0.0], np.cumsum(logp, dtype=np.float64)))
                first, last = ends - lengths, np.maximum(ends - ORDER + 1, 0)
                bits = sums[np.minimum(first, m if m > 0 else 0)] - sums[np.minimum(last, m if m > 0 else 0)]
                counts = [base_counts(r[3]) if block == 0 else (0,) * 5 for r in rows]
                columns = [*[list(x) for x in list(zip(*rows, strict=True))[:3]], *map(list, zip(*counts, strict=True)), np.round(bits, 6)]
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

        return rows_in.mapInArrow(run, ddl)

    out = scored(0)
    if blocks > 1:
        parts = out.select("key", "lang", "bits")
        for b in range(1, blocks):
            parts = parts.union(scored(b).select("key", "lang", "bits"))
        whole = parts.groupBy("key", "lang").agg((F.avg("bits") * blocks).alias("bits"))
        out = out.drop("bits").join(whole, ["key", "lang"])
    return out


def by_language(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with the columns of a stored table of one row a language: a broadcast behind a count, so no language's rows meet in one task."""
    few = table.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    return rows.join(F.broadcast(table) if few else table, "lang", "left")


def bands(scored: DataFrame, low: float = LOW, high: float = HIGH, step: float = 0.01) -> DataFrame:
    """lang, lower, upper: bits per word outside of which a text of the language is rejected. Medians are of steps of ``step``."""
    once = scored.where(~F.col("base_failed")).groupBy("lang", "key").agg(F.first("bits_per_word").alias("x"))

    def median(df: DataFrame, value: str, name: str) -> DataFrame:
        binned = df.groupBy("lang", F.floor(F.col(value) / step).alias("b")).agg(F.count("*").alias("n"))
        w = Window.partitionBy("lang")
        run = binned.withColumn("upto", F.sum("n").over(w.orderBy("b"))).withColumn("all", F.sum("n").over(w))
        return run.where(F.col("upto") * 2 >= F.col("all")).groupBy("lang").agg((F.min("b") * step + step / 2).alias(name))

    mid = median(once, "x", "mid")
    mid = materialise(mid, "mid", BROADCAST_LANGUAGES)
    off = median(by_language(once, mid).withColumn("off", F.abs(F.col("x") - F.col("mid"))), "off", "mad")
    wide = F.greatest(1.4826 * F.col("mad"), 0.02 * F.col("mid"))
    return mid.join(off, "lang").select("lang", (F.col("mid") - low * wide).alias("lower"), (F.col("mid") + high * wide).alias("upper"))


def assess(docs: DataFrame, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """The base counts, base_failed, bits_per_word and kept of every document, with its text key."""
    grams = materialise(count_grams(docs), "grams")
    tidy(docs.sparkSession)
    model = kneser_ney(grams)
    rows = scores(docs, model, block_grams)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("bits_per_word", F.col("bits") / F.greatest("n_words", F.lit(1)))
    rows = materialise(rows, "scores")
    inside = F.col("bits_per_word").between(F.col("lower"), F.col("upper"))
    return by_language(rows, materialise(bands(rows), "bands", BROADCAST_LANGUAGES)).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def quality(docs: DataFrame) -> DataFrame:
    return assess(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("bits_per_word", 4).alias("bits_per_word"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns.

    Texts that fail go by their key. While these are few, they are broadcast and no text is shuffled.
    """
    key, lang = spare(docs, "__key"), spare(docs, "__lang")
    failed = assess(docs).where(~F.col("kept")).select(F.col("key").alias(key), F.col("lang").alias(lang)).distinct()
    failed = materialise(failed, "failed")
    failed = F.broadcast(failed) if failed.count() <= BROADCAST_FAILED else failed
    keyed = docs.withColumn(key, text_key()).withColumn(lang, F.coalesce(F.col("lang").cast("string"), F.lit("")))
    return keyed.join(failed, [key, lang], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
