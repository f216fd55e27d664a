"""Column builders: casts, names, keys, buckets, calibration and scalar scores. All stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


# --- casts and parsing --------------------------------------------------------------------------------------


def to_date(c: str | Column) -> Column:
    """A bad date becomes null."""
    return F.try_to_timestamp(col(c)).cast("date")


def number(c: str | Column, score: bool = False) -> Column:
    """Thousands separators go; a percentage is divided by 100 unless the field is a score; not finite or bad: null."""
    text = F.trim(F.regexp_replace(col(c).cast("string"), ",", ""))
    percent = text.endswith("%")
    value = F.regexp_replace(text, "%$", "").try_cast("double")
    value = F.when(percent & F.lit(not score), value / 100).otherwise(value)
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def items(c: str | Column) -> Column:
    """A list from JSON, or from text cut at semicolons or commas; blanks go."""
    text = F.trim(col(c))
    parsed = F.from_json(text, "array<string>")
    cut = F.split(text, F.when(F.contains(text, F.lit(";")), F.lit(";")).otherwise(F.lit(",")))
    chosen = F.when(text.startswith("["), parsed).otherwise(cut)
    return F.filter(F.transform(chosen, lambda x: F.trim(x)), lambda x: x != "")


def first_filled(*columns: str | Column) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(col(c)), F.lit("")) for c in columns])


def identity_key(*columns: str | Column) -> Column:
    """As ``first_filled``, without trimming, the last column taken as it is."""
    *most, last = columns
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in most], col(last))


def column_of(df: DataFrame, aliases: Sequence[str]) -> Column:
    """The first alias that df has, whatever its case; a null column if none."""
    have = {c.lower(): c for c in df.columns}
    return next((F.col(have[a.lower()]) for a in aliases if a.lower() in have), F.lit(None).cast("string"))


# --- names and keys -----------------------------------------------------------------------------------------

# The legal forms of the three name normalisers, each in its own order.
FORMS_ANYWHERE = ["INCORPORATED", "INC", "LLC", "L.L.C", "CORPORATION", "CORP", "CO", "COMPANY", "LTD", "LIMITED", "SA", "AG", "BV", "GMBH", "SPA", "S.P.A", "PLC"]
FORMS_AT_END = [" INC", " CORP", " CORPORATION", " LLC", " LP", " CO", " COMPANY", " LTD", " LIMITED"]
FORM_TOKENS = ["ag", "asa", "co", "company", "corp", "corporation", "gmbh", "group", "holding", "holdings", "inc", "incorporated", "international", "ltd", "llc", "lp", "plc", "sa", "sas", "se", "spa"]
# Words that are no keywords of a name.
STOP_WORDS = frozenset("THE AND OF FOR WITH IN ON AT TO FROM BY AS OR BUT SO IF THEN ELSE WHEN WHERE WHY HOW WHAT WHO WHICH THAT THIS THESE THOSE A AN".split())


def slug(c: str | Column) -> Column:
    return F.lower(F.regexp_replace(col(c), "[^A-Za-z0-9]+", "_"))


def uid(space: str, c: str | Column) -> Column:
    return F.concat(F.lit(f"{space}:"), col(c).cast("string"))


def uid_key(c: str | Column) -> Column:
    return F.regexp_replace(col(c), "^[a-z]+:", "")


def short_hash(*columns: str | Column, length: int = 16) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *[col(c).cast("string") for c in columns])), 1, length)


def company_name(c: str | Column, compat: bool = False) -> Column:
    """Upper case, punctuation to spaces, legal forms away, spaces squeezed; blank becomes null. compat leaves forms and spaces."""
    name = F.regexp_replace(F.upper(col(c)), "[^A-Z0-9 ]+", " ")
    if not compat:
        name = F.regexp_replace(F.regexp_replace(name, rf"\b({'|'.join(FORMS_ANYWHERE)})\b", " "), r"\s+", " ")
    return F.nullif(F.trim(name), F.lit(""))


def company_name_end(c: str | Column) -> Column:
    """Upper case; each legal form goes once, in list order, if the name ends with it; then punctuation to spaces, squeezed."""
    name = F.trim(F.upper(col(c)))
    for form in FORMS_AT_END:
        name = F.regexp_replace(name, rf"{form}\z", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\w\s]", " "), r"\s+", " "))


def name_tokens(c: str | Column, drop: Sequence[str] = tuple(FORM_TOKENS), longer_than: int = 0) -> Column:
    """Lower-case alphanumeric tokens without those to drop, of more than ``longer_than`` characters."""
    parts = F.split(F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " ")), " ")
    return F.filter(parts, lambda x: (x != "") & ~x.isin(*drop) & (F.length(x) > longer_than))


def keywords(c: str | Column) -> Column:
    """The words of a cleaned name of more than two letters that are no stop words."""
    return F.filter(F.split(col(c), " "), lambda x: ~x.isin(*sorted(STOP_WORDS)) & (F.length(x) > 2))


def last_of_path(c: str | Column, sep: str = ">") -> Column:
    return F.trim(F.element_at(F.split(col(c), sep), -1))


def code_value(c: str | Column) -> Column:
    return F.regexp_replace(F.trim(col(c).cast("string")), r"\.0$", "")


def padded_code(scaled: str | Column, low: int = 100, high: int = 9999) -> Column:
    """A four-digit code from its min-max scaled value."""
    return F.lpad(F.bround(col(scaled) * (high - low) + low).cast("int").cast("string"), 4, "0")


def recode(c: str | Column, table: dict[str, str], default: Column) -> Column:
    """A lookup in a fixed table, else the default."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, col(c)), default)


def pipe_union(c: str | Column) -> Column:
    """Aggregate: the distinct members of pipe-separated lists, ascending, joined by pipes."""
    members = F.flatten(F.collect_set(F.split(col(c), r"\|")))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(members, lambda x: F.trim(x)), lambda x: x != ""))), "|")


def fnv1a(c: str | Column) -> Column:
    """FNV-1a, 32 bits, of the UTF-8 bytes."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(col(c))), lambda i: F.conv(F.hex(F.substring(F.encode(col(c), "UTF-8"), i, F.lit(1))), 16, 10).cast("long"))
    step = lambda h, b: F.pmod(h.bitwiseXOR(b) * F.lit(16777619), F.lit(1 << 32))
    return F.when(F.length(col(c)) == 0, F.lit(2166136261)).otherwise(F.aggregate(codes, F.lit(2166136261).cast("long"), step))


# --- time ---------------------------------------------------------------------------------------------------


def active_half_open(start: str, end: str, at: Column) -> Column:
    return (F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at))


def active_closed(start: str, days: str, at: Column) -> Column:
    return (F.col(start) <= at) & (F.col(days).isNull() | (F.date_add(F.col(start), F.col(days).cast("int")) >= at))


#: Fixed bounds in days: horizon k holds days in [bound k-1, bound k).
HORIZONS = [0, 31, 91, 182, 365, 730, 1095, 1825]


def horizon(days: str | Column) -> Column:
    """1 .. 8 by half-open ranges of days, 0 for null or negative."""
    out = F.lit(0)
    for k, low in enumerate(HORIZONS, 1):
        out = F.when(col(days) >= low, F.lit(k)).otherwise(out)
    return F.when(col(days).isNull(), F.lit(0)).otherwise(out)


# --- scores -------------------------------------------------------------------------------------------------


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def platt(score: str | Column, a: float | Column, b: float | Column) -> Column:
    return sigmoid(col(score) * a + b)


def linear_logit(intercept: float, weights: dict[str, float]) -> Column:
    return reduce(lambda acc, kv: acc + F.col(kv[0]) * kv[1], weights.items(), F.lit(intercept))


def banded(c: str | Column, bands: Sequence[tuple[float, str]], default: str) -> Column:
    """The label of the first bound that the value reaches; bounds in falling order."""
    out = F.lit(default)
    for low, label in reversed(bands):
        out = F.when(col(c) >= low, label).otherwise(out)
    return out


def quadrant(x: str | Column, y: str | Column, cut_x: float, cut_y: float) -> Column:
    return F.concat(F.when(col(x) >= cut_x, "high").otherwise("low"), F.lit("_"), F.when(col(y) >= cut_y, "high").otherwise("low"))


def evidence_weight(weights: dict[str, float]) -> Column:
    """The largest weight among the layers that are present."""
    return F.greatest(F.lit(0.0), *[F.when(F.col(c) == 1, w).otherwise(0.0) for c, w in weights.items()])


def near(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return F.abs(a - b) <= tolerance
