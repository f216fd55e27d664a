"""Line dedup by site-relative frequency, in DataFrame functions.

The pages of each host are counted, and for every line the host's pages that
contain it; a line on at least ``MIN_PAGES`` pages and at least ``RATIO`` of
the host's pages is boilerplate there and goes from all its pages. Exact copies of a page
within a host are one page (else a page copied often would lose all its lines).

A host's boilerplate lines are few by definition: a page of n lines adds n to the counts,
so a host has at most (mean lines a page) / RATIO of them. The whole set is
broadcast while it has at most ``BROADCAST_LINES`` lines; beyond, pages and sets are joined
by host, and the skew join of adaptive execution splits a hot host.

Defined results: a null text stays null (no lines); an empty text is one blank line; lines
without a visible character are never boilerplate; a null host is a host of its own;
repeated rows each keep their row; an empty table gives no rows; other columns, whatever their
names, stay as they are; a very long text's lines are all counted and searched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from .common import F, materialise, spare, text_key, with_text

RATIO = (1, 10)
MIN_PAGES = 10
BROADCAST_LINES = 100_000


def _lines(text: str | Column) -> Column:
    return F.split(text, "\n")


def boilerplate(docs: DataFrame, site: str = "source", ratio: tuple[int, int] = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """__site, lines (hashes of the host's boilerplate lines, ascending). Line hashes have 64 bits."""
    seen = F.array_distinct(F.transform(F.filter(_lines("text"), lambda x: x.rlike(r"[^\s]")), lambda x: F.xxhash64(x)))
    pages = docs.where("text IS NOT NULL").select(F.col(site).cast("string").alias("__site"), text_key().alias("key"), seen.alias("lines"))
    pages = materialise(pages.groupBy("__site", "key").agg(F.first("lines").alias("lines")), "pages")
    totals = pages.groupBy("__site").agg(F.count("*").alias("pages"))
    counts = pages.select("__site", F.explode("lines").alias("line")).groupBy("__site", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = totals.withColumnRenamed("__site", "s")
    common = counts.join(totals, F.col("__site").eqNullSafe(F.col("s"))).where(F.col("n") * ratio[1] >= F.col("pages") * ratio[0])
    return common.groupBy("__site").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def with_boilerplate(docs: DataFrame, site: str = "source", ratio: tuple[int, int] = RATIO, min_pages: int = MIN_PAGES) -> tuple[DataFrame, str]:
    """docs with one more column, and its name: the boilerplate hashes of the row's host, or null."""
    own, lines = spare(docs, "__site"), spare(docs, "__lines")
    sets = materialise(boilerplate(docs, site, ratio, min_pages), "boilerplate").select(F.col("__site").alias(own), F.col("lines").alias(lines))
    small = (sets.agg(F.sum(F.size(lines))).first()[0] or 0) <= BROADCAST_LINES
    sets = F.broadcast(sets) if small else sets
    return docs.join(sets, F.col(f"`{site}`").cast("string").eqNullSafe(F.col(own)), "left").drop(own), lines


def _kept(lines: str) -> Column:
    kept = F.filter(_lines("text"), lambda x: ~F.array_contains(lines, F.xxhash64(x)) | ~x.rlike(r"[^\s]"))
    return F.when(F.col(lines).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))


def deduplicated(docs: DataFrame, site: str = "source", min_pages: int = MIN_PAGES) -> DataFrame:
    """docs without their hosts' boilerplate lines; n_chars follows, other columns stay."""
    names = docs.columns
    rows, lines = with_boilerplate(docs, site, min_pages=min_pages)
    return with_text(rows, _kept(lines)).select(*[F.col(f"`{c}`") for c in names])


def host(url: str | Column = "url") -> Column:
    """The host of a web address, lower-case, without a leading www.; null where there is none. For tables of pages."""
    return F.regexp_replace(F.lower(F.try_parse_url(F.col(url) if isinstance(url, str) else url, F.lit("HOST"))), r"^www\.", "")


def line_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row."""
    slim = docs.select("doc_id", "source", "text")
    out, lines = with_boilerplate(slim)
    out = out.withColumn("kept", _kept(lines))
    dropped = F.when(F.col(lines).isNull() | F.col("text").isNull(), 0).otherwise(F.size(F.filter(_lines("text"), lambda x: F.array_contains(lines, F.xxhash64(x)) & x.rlike(r"[^\s]"))))
    return out.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines("text"))).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH p AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
t AS (SELECT source, count(*) AS pages FROM p GROUP BY source),
l AS (SELECT source, line, count(*) AS n FROM (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM p) GROUP BY source, line),
b AS (SELECT l.source, list(line) AS lines FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source
      WHERE n >= 10 AND n * 10 >= pages AND regexp_matches(line, '[^\s]') GROUP BY l.source),
d AS (SELECT doc_id, string_split(text, chr(10)) AS own, coalesce(b.lines, []) AS lines FROM documents x LEFT JOIN b ON x.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, coalesce(len(own), 0)::BIGINT AS n_lines, coalesce(len(list_filter(own, lambda x: list_contains(lines, x))), 0)::BIGINT AS n_dropped,
       sha256(coalesce(array_to_string(list_filter(own, lambda x: NOT list_contains(lines, x)), chr(10)), '')) AS kept_sha256
FROM d
"""
