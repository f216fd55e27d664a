"""Byte-level BPE through a sentencepiece model that is written directly from a rank file.

Each of the vocabulary's byte strings becomes a piece: its bytes mapped to printable
characters one to one, scored by its negative rank, so the highest-scoring merge is
the one of lowest rank. The model file (a protocol buffer) is put together
here: BPE type, identity normalisation, no dummy prefix, no white-space rules; ids are
ranks, and one unknown piece that no text can reach follows them.

Texts are cut by the vocabulary's pattern; each pre-token is encoded alone. As the
library that defines the ranks, a pre-token that is in the vocabulary is one id.
Decoding maps ids to pieces and characters back to bytes.

Defined results: a null text is an empty text (no ids; the hash of nothing);
repeated rows each get their row; an empty table gives no rows; extra columns are
ignored; ids that decode to invalid UTF-8 stay bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import F, Remembered, arrow_schema, doc_columns, slices

CODED = "doc_id long, ids binary, decoded binary"
#: A space between white space and white space or the end: the pattern may join it with what stands before it.
INNER_SPACE = regex.compile(r" (?!\S)(?<=\s )")
#: A line break beside other white space, three in a row, or two at the end: the pattern may join these.
INNER_BREAK = regex.compile(r"\n(?:(?<=[^\S\n]\n)|[^\S\n]|\n(?:\n|\Z))")


#: Marks that are a pre-token of their own between a letter and the end of a stretch.
MARKS = tuple(",.;:!?")


def byte_characters() -> list[str]:
    """A printable character for each byte, itself where it is printable."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes, a number as a varint, or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3 | 5) + struct.pack("<f", value) if isinstance(value, float) else _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model; a piece's id is its rank."""
    chars = byte_characters()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0 .. n-1")
    pieces = [_field(1, _field(1, "".join(chars[b] for b in piece).encode()) + _field(2, -float(rank)) + _field(3, 1)) for piece, rank in by_rank]
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(2, _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, len(by_rank)) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1))
    normaliser = _field(3, _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return b"".join(pieces) + unknown + trainer + normaliser


def joined(coded: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    """Several coded parts as one."""
    return b" ".join([x[0] for x in coded]), b"".join([x[1] for x in coded])


def packed_ids(coded: list[tuple[bytes, bytes]]) -> bytes:
    """The ids as little-endian uint32."""
    return array("I", [int(n) for x in coded for n in x[0].split()]).tobytes()


class ByteBpe:
    """Encodes whole texts; remembers the pre-tokens and space-led stretches met lately, ``remember`` bytes of either."""

    #: Stretches that are looked up at once: bounds what a very long text adds to the memory.
    AT_ONCE = 400_000

    def __init__(self, path: str, pattern: str, remember: int = 140_000_000) -> None:
        import sentencepiece

        ranks = read_ranks(path)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.split = regex.compile(pattern).findall
        self.chars = {b: c for b, c in enumerate(byte_characters())}
        self.ranks = {raw.decode("latin1").translate(self.chars): rank for raw, rank in ranks.items()}
        back = {c: b for b, c in self.chars.items()}
        self.pieces = [bytes(back[c] for c in self.processor.id_to_piece(i)) for i in range(len(self.ranks))]
        self.numbers = [b"%d" % i for i in range(len(self.ranks))]
        self.parts = Remembered(self._parts, remember, each=330, by_char=5)
        self.stretches = Remembered(self._stretches, remember // 2, each=150, by_char=2)  # most share their value with a part

    def _parts(self, parts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Of each pre-token: its ids as decimal numbers joined by spaces, and the bytes they decode to."""
        mapped = [p.replace(" ", self.chars[32]) if p.isascii() and p.isprintable() else p.encode().decode("latin1").translate(self.chars) for p in parts]
        ranks = [self.ranks.get(m) for m in mapped]
        rest = [m for m, rank in zip(mapped, ranks, strict=True) if rank is None]
        coded = iter(self.processor.encode(rest, out_type=int, num_threads=1) if rest else [])
        for rank in ranks:
            if rank is None:
                ids = next(coded)
                yield b" ".join([self.numbers[i] for i in ids]), self.decode(ids)
            else:
                yield self.numbers[rank], self.pieces[rank]

    def _stretches(self, stretches: list[str]) -> list[tuple[bytes, bytes]]:
        # a stretch that a line break or a space leads stands as it is; before any other there was a space.
        # A run of letters, alone or before one mark, needs no pattern.
        cut = [
            [" " + s] if s.isalpha() else [" " + s[:-1], s[-1]] if s[-1:] in MARKS and s[:-1].isalpha() else self.split(s if s[:1] in ("\n", " ") else " " + s)
            for s in stretches
        ]
        known = self.parts.holding(chain.from_iterable(cut))
        return [known[parts[0]] if len(parts) == 1 else joined([known[p] for p in parts]) for parts in cut]

    def _cut(self, text: str) -> tuple[list[str], list[str]]:
        """A text as pre-tokens, then stretches."""
        if INNER_SPACE.search(text):  # a run of white space is cut by what follows it, so such a text is cut whole
            return self.split(text), []
        # before any other space the pattern always cuts: it follows a visible character, or a visible one follows
        # it; likewise at a line break between visible characters, or at two such
        lines = "\n" in text
        whole = lines and INNER_BREAK.search(text)
        first, *stretches = (text.replace("\n", " \n") if lines and not whole else text).split(" ")
        return self.split(first), [" " + s if s[:1] == "\n" else s for s in stretches] if whole else stretches

    def many(self, texts: list[str]) -> Iterator[list[tuple[bytes, bytes]]]:
        """Of each text what ``_parts`` gives, of consecutive parts of it. Stretches of several texts are looked up together."""
        cut = [self._cut(t) for t in texts]
        at_once = sum(len(s) for _, s in cut) <= self.AT_ONCE
        known = self.stretches.holding(chain.from_iterable(s for _, s in cut)) if at_once else {}
        for head, stretches in cut:
            out = []
            for at in range(0, len(head), self.AT_ONCE):
                parts = head[at : at + self.AT_ONCE]
                of = self.parts.holding(parts)
                out.append(joined([of[p] for p in parts]))
            for at in range(0, len(stretches), self.AT_ONCE):
                part = stretches[at : at + self.AT_ONCE]
                out += map((known if at_once else self.stretches.holding(part)).__getitem__, part)
            yield out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian uint32."""
        return packed_ids(next(self.many([text])))

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text the number of ids, and the SHA-256 of their decimal numbers joined by spaces and of the bytes they decode to."""
        for parts in self.many(texts):
            numbers, raw = joined(parts)
            yield numbers.count(b" ") + bool(numbers), hashlib.sha256(numbers).hexdigest(), hashlib.sha256(raw).hexdigest()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.pieces[i] for i in ids])


@lru_cache(maxsize=2)
def _bpe(path: str, pattern: str) -> ByteBpe:
    """One for each Python worker, kept between tasks."""
    return ByteBpe(path, pattern)


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian uint32) and the bytes they decode to."""
    schema = arrow_schema(CODED)

    def run(batches):
        bpe = _bpe(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                coded = list(bpe.many([t or "" for t in part.column(1).to_pylist()]))
                ids, decoded = [packed_ids(parts) for parts in coded], [joined(parts)[1] for parts in coded]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], schema=schema)

    return doc_columns(docs).mapInArrow(run, CODED)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256. The digests are taken where the ids are, which never leave the task."""
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema = arrow_schema(ddl)

    def run(batches):
        bpe = _bpe(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                rows = zip(*bpe.digests([t or "" for t in part.column(1).to_pylist()]), strict=True)
                yield pa.record_batch([part.column(0), *[pa.array(c, f.type) for c, f in zip(rows, list(schema)[1:], strict=True)]], schema=schema)

    return doc_columns(docs).mapInArrow(run, ddl)


def decoded_texts(coded: DataFrame) -> DataFrame:
    """doc_id and text again, from ``encoded``."""
    return coded.select("doc_id", F.decode("decoded", "UTF-8").alias("text"))
