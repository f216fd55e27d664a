"""Entity resolution: exact cascade, blocking, similarity, acceptance."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def exact_cascade(left: DataFrame, right: DataFrame, names: Sequence[str], key: str) -> DataFrame:
    """The first of several left columns whose value is one unambiguous right name. right: name, key."""
    unique = right.groupBy("name").agg(F.countDistinct(key).alias("n"), F.min(key).alias(key)).where("n = 1").select("name", key)
    out = left
    for i, c in enumerate(names):
        out = out.join(unique.select(F.col("name").alias(f"__n{i}"), F.col(key).alias(f"__k{i}")), F.col(c) == F.col(f"__n{i}"), "left")
    how = F.coalesce(*[F.when(F.col(f"__k{i}").isNotNull(), c) for i, c in enumerate(names)])
    return out.withColumn(key, F.coalesce(*[F.col(f"__k{i}") for i in range(len(names))])).withColumn("matched_by", how).drop(*[f"__{x}{i}" for i in range(len(names)) for x in "nk"])


def blocked_pairs(left: DataFrame, right: DataFrame, block: Sequence[str], prefix: int = 6, name: str = "name") -> DataFrame:
    """Pairs that share the block columns and the first characters of the name."""
    a = left.withColumn("__p", F.substring(name, 1, prefix))
    b = right.withColumn("__p", F.substring(name, 1, prefix)).withColumnRenamed(name, "other_name")
    return a.join(b, [*block, "__p"]).drop("__p")


def token_pairs(left: DataFrame, right: DataFrame, band: int = 5, name: str = "name") -> DataFrame:
    """Pairs that share a word and whose lengths differ by ``band`` at most."""
    a = left.withColumn("__t", F.explode(F.array_distinct(F.split(name, " ")))).withColumn("__l", F.length(name))
    b = right.withColumnRenamed(name, "other_name").withColumn("__t", F.explode(F.array_distinct(F.split("other_name", " "))))
    return a.join(b, "__t").where(F.abs(F.col("__l") - F.length("other_name")) <= band).drop("__t", "__l").distinct()


def accepted(pairs: DataFrame, key: str, score: str, other: str, least: float, margin: float = 0.02) -> DataFrame:
    """The best pair of each key, if it scores ``least`` and leads the second by ``margin``."""
    w = Window.partitionBy(key).orderBy(F.desc(score), other)
    x = pairs.withColumn("__r", F.row_number().over(w)).withColumn("__second", F.lead(score).over(w)).where("__r = 1")
    lead = F.col(score) - F.coalesce("__second", F.lit(0.0)) >= margin
    return x.withColumn("status", F.when((F.col(score) >= least) & lead, "match").when(F.col(score) >= least, "ambiguous").otherwise("none")).drop("__r", "__second")


# --- blended similarity ---------------------------------------------------------------------------------------


def _percent(a: str, b: str) -> float:
    """0 .. 100; an empty text is like nothing."""
    return 0.0 if not a or not b else 100 * difflib.SequenceMatcher(None, a, b).ratio()


def _partial(a: str, b: str) -> float:
    """The best ratio of the shorter text with an equally long stretch of the longer."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    return max(_percent(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1))


def _token_sort(a: str, b: str) -> float:
    return _percent(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _token_set(a: str, b: str) -> float:
    """The best ratio among the common words, and these with either side's own words."""
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    one, other = ((both + " " + " ".join(sorted(z))).strip() for z in (x - y, y - x))
    return max(_percent(both, one) if both else 0.0, _percent(both, other) if both else 0.0, _percent(one, other))


def blended_score(a: str, b: str) -> float:
    """0 .. 100: .3 ratio, .2 partial, .2 sorted words, .2 word sets, .1 Jaccard of the keywords."""
    x, y = (a or "").lower(), (b or "").lower()
    p, q = (({w for w in z.upper().split() if w not in X.STOP_WORDS and len(w) > 2}) for z in (x, y))
    keywords = 100 * len(p & q) / len(p | q) if p and q else 0.0
    return 0.3 * _percent(x, y) + 0.2 * _partial(x, y) + 0.2 * _token_sort(x, y) + 0.2 * _token_set(x, y) + 0.1 * keywords


#: Tiers: least length, first-word and character similarity, and the tier's value.
TIERS = ((70, 80, 60, 100), (60, 70, 50, 80), (50, 60, 40, 60))


def tier(a: str, b: str) -> int:
    """100, 80, 60 or 0: how many of the plain checks on length, first word and characters a pair passes."""
    longest = max(len(a), len(b))
    length = 100 * (longest - abs(len(a) - len(b))) / longest if longest else 0.0
    first = _percent(a.split()[0], b.split()[0]) if a.split() and b.split() else 0.0
    p, q = set(a.lower().replace(" ", "")), set(b.lower().replace(" ", ""))
    chars = 100 * len(p & q) / len(p | q) if p and q else 0.0
    return next((value for least, word, char, value in TIERS if length >= least and first >= word and chars >= char), 0)


@F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("tier", T.IntegerType()), T.StructField("final", T.DoubleType())]))
def blended(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """score (blended), tier, and final = .7 score + .3 tier. For candidate pairs that blocking has thinned."""
    rows = [(blended_score(x or "", y or ""), tier(x or "", y or "")) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame([(s, t, 0.7 * s + 0.3 * t) for s, t in rows], columns=["score", "tier", "final"])


def match_summary(accepted_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """status and n; and the rows to review: those without a match or with an ambiguous one."""
    return accepted_.groupBy("status").agg(F.count("*").alias("n")), accepted_.where("status <> 'match'")


def prefix_matches(left: DataFrame, right: DataFrame, key: str = "key", name: str = "name") -> DataFrame:
    """key, name of the first right name (in order) that starts with the left key, or that the left key starts with.

    Both ways are equi-joins on exploded prefixes, so a row meets none but its matches.
    """
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, F.lit(1), i))
    keys = left.where(F.col(key) != "").select(key).distinct()
    names = right.where(F.col(name) != "").select(name).distinct()
    a = keys.join(names.withColumn("__p", F.explode(prefixes(F.col(name)))), F.col(key) == F.col("__p")).select(key, name)
    b = keys.withColumn("__p", F.explode(prefixes(F.col(key)))).join(names, F.col(name) == F.col("__p")).select(key, name)
    return a.unionByName(b).groupBy(key).agg(F.min(name).alias(name))
