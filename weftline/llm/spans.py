"""Spans of code points in whole texts, from a finder of one text."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_schema, doc_columns

#: kind, start, end (exclusive)
Span = tuple[str, int, int]


class Taken:
    """The code points that spans cover, as ascending stretches: asked in logarithmic, joined in linear time."""

    def __init__(self, spans: Iterable[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, s, e in sorted(spans, key=lambda x: x[1:]):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        """Whether a code point of start .. end (exclusive) is covered."""
        at = bisect_left(self.starts, end) - 1
        return at >= 0 and self.ends[at] > start


def written(spans: list[Span], kinds: list[str]) -> str:
    """kind:start:end by start, then by the kinds' order, comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], rank[x[0]], x[2])))


def span_rows(docs: DataFrame, find: Callable[[str], tuple[list[Span], list[Span]]], kinds: list[str], counted: list[str]) -> DataFrame:
    """doc_id, a count of each base kind, base_sha256, spans. ``find`` gives a text's base spans and the method's own."""
    ddl = ", ".join(["doc_id long", *[f"n_{k} long" for k in counted], "base_sha256 string", "spans string"])
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in schema]
            for text in batch.column(1):
                base, more = find(text.as_py() or "")
                n = dict.fromkeys(counted, 0)
                for k, _, _ in base:
                    n[k] += 1
                values = [*n.values(), hashlib.sha256(written(base, kinds).encode()).hexdigest(), written(base + more, kinds)]
                for c, v in zip(columns[1:], values, strict=True):
                    c.append(v)
            yield pa.record_batch([batch.column(0), *[pa.array(c, f.type) for c, f in zip(columns[1:], list(schema)[1:], strict=True)]], schema=schema)

    return doc_columns(docs).mapInArrow(run, ddl)


def replaced(docs: DataFrame, find: Callable[[str], tuple[list[Span], list[Span]]], mark: str) -> DataFrame:
    """docs with every span of the text (overlapping ones joined) replaced by ``mark``; n_chars follows, other columns stay."""
    names = docs.columns
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in batches:
            texts = []
            for t in batch.column(at):
                text = t.as_py()
                if text:
                    base, more = find(text)
                    out, end = [], 0
                    for _, s, e in sorted(base + more, key=lambda x: x[1:]):
                        if s >= end:
                            out += [text[end:s], mark]
                        end = max(end, e)
                    text = "".join([*out, text[end:]]) if out else text
                texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if chars is not None:
                columns[chars] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(chars).type)
            yield pa.record_batch(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
