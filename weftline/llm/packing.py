"""Packing of tokenised documents into fixed windows by best-fit decreasing.

``tokenise`` turns documents into pieces: every document's ids (closed by an end
id) are cut into full windows and one remainder. ``pack`` places the pieces: a full
piece is a window of its own; remainders go, longest first, to the open window
with the least room that still holds them. A segment tree over the
remaining capacities finds that window in O(log window).

At scale the pieces are dealt into groups of about ``windows_per_group`` windows,
each packed in one task: memory is bounded, and only the last few windows of
a group can have padding (a few in ``windows_per_group``).

Ids are those of the library's plain call without special tokens added; a text that
itself holds the string of an added token gets that token's id there, as from the library.

Defined results: a null text is an empty text, i.e. the end id alone; repeated
rows are separate documents, packed separately (their pieces are equal but lie at
different places); an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import F, Remembered, arrow_schema, doc_columns, materialise, slices

WINDOW = 4096
END_ID = 2
WINDOWS_PER_GROUP = 2048
REMEMBER = 80_000_000  # bytes of words, and as many of letter runs, that a worker remembers
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordEncoder:
    """Ids of the lower-casing word BPE as little-endian uint32 bytes, word by word.

    The vocabulary's normaliser and splitter never join characters across white
    space, so a text's ids are the ids of its space-separated words in
    order. Words repeat, so both words and the letter runs within them are
    remembered, about ``remember`` bytes of either. What is not plain Latin goes through the
    library's own normaliser and splitter, and so does the whole of a text that holds a control character or the
    string of one of the vocabulary's added tokens.
    """

    #: The splitter of the vocabulary file for lower-case Latin letters, digits and the rest (fixed by the file).
    SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºÀ-ÖØ-öø-ɏ]+|[0-9²³¹¼-¾]|[^\sa-z0-9ªµº²³¹¼-¾À-ÖØ-öø-ɏ]+")
    #: What ``SPLIT`` does not know, before or after lower-casing; white space that cuts words aside.
    BEYOND = re.compile(r"[^ \t\n\r\x0b\x0c!-~¡-ɏ]|[­İ]")
    CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
    #: Words that are looked up at once: bounds what a very long text adds to the memory.
    AT_ONCE = 200_000

    def __init__(self, path: str, remember: int = REMEMBER) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.mapped = {b: b for b in printable} | {b: 256 + n for n, b in enumerate(others)}
        self.words = Remembered(self._words, remember, each=150, by_char=1)  # most share their key and value with a run
        self.parts = Remembered(self._parts, remember)

    def _library(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _beyond(self, word: str) -> bool:
        return bool(self.BEYOND.search(word) or self.BEYOND.search(word.lower()))

    def _parts(self, parts: list[str]) -> list[bytes]:
        mapped = [p if p.isascii() else p.encode().decode("latin1").translate(self.mapped) for p in parts]
        return [array("I", [t.id for t in self.model.tokenize(p)]).tobytes() for p in mapped]

    def _words(self, words: list[str]) -> list[bytes]:
        """Of each lower-case word, or of one that ``SPLIT`` does not know."""
        # a run of ASCII letters, alone or before one mark, needs no splitter
        cut = [
            [w] if (plain := w.isascii()) and w.isalpha() else [w[:-1], w[-1]] if plain and w[:-1].isalpha() and w[-1] in ",.;:!?" else None if not plain and self._beyond(w) else self.SPLIT.findall(w)
            for w in words
        ]
        known = self.parts.holding(chain.from_iterable(filter(None, cut)))
        return [self._library(w) if parts is None else known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts]) for w, parts in zip(words, cut, strict=True)]

    def _cut(self, text: str) -> list[str] | None:
        """The words as ``_words`` takes them; None for a text that the library has to take whole."""
        if self.CONTROL.search(text) or "<|" in text and any(a in text for a in self.added):
            return None
        if text.isascii():
            return text.lower().split()
        text = unicodedata.normalize("NFC", text)
        low = text.lower()
        for blank in "\t\n\r\x0b\x0c":
            low, text = low.replace(blank, " "), text.replace(blank, " ")
        words = low.split(" ")
        if self.BEYOND.search(text) or self.BEYOND.search(low):  # such words go as they are
            words = [w if not w.isascii() and self._beyond(w) else w.lower() for w in text.split(" ")]
        return words

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of several texts; their words are looked up together."""
        cut = [self._cut(t) for t in texts]
        out = []
        if sum(len(c) for c in cut if c) <= self.AT_ONCE:
            known = self.words.holding(chain.from_iterable(filter(None, cut)))
            return [self._library(t) if c is None else b"".join(map(known.__getitem__, c)) for t, c in zip(texts, cut, strict=True)]
        for t, c in zip(texts, cut, strict=True):
            parts = [] if c is None else [c[at : at + self.AT_ONCE] for at in range(0, len(c), self.AT_ONCE)]
            out.append(self._library(t) if c is None else b"".join([b"".join(map(self.words.holding(p).__getitem__, p)) for p in parts]))
        return out


@lru_cache(maxsize=2)
def _encoder(path: str, remember: int) -> WordEncoder:
    """One for each Python worker, kept between tasks."""
    return WordEncoder(path, remember)


def tokenise(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, remember: int = REMEMBER) -> DataFrame:
    """Pieces of every document: doc_id, start, length, doc_tokens, ids (little-endian uint32)."""
    schema = arrow_schema(PIECES)
    end, step = array("I", [end_id]).tobytes(), 4 * window

    def run(batches):
        encode = _encoder(tokenizer_path, remember)
        for batch in batches:
            for part in slices(batch, 1):
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encode.many([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    total = len(ids) // 4
                    for at in range(0, len(ids), step):
                        rows.append((doc_id, at // 4, min(step, len(ids) - at) // 4, total, ids[at : at + step]))
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return doc_columns(docs).mapInArrow(run, PIECES)


class RoomTree:
    """Open windows by remaining capacity: a segment tree of 'some window has this much room'."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, window: int) -> None:
        if room:
            self.open[room].append(window)
            at = self.leaves + room
            while at and not self.some[at]:
                self.some[at] = 1
                at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``need``, and that room."""
        at = self.leaves + need
        some = self.some
        if not some[at]:
            while at > 1 and (at & 1 or not some[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if some[2 * at] else 2 * at + 1
        room = at - self.leaves
        window = self.open[room].pop()
        if not self.open[room]:
            some[at] = 0
            at >>= 1
            while at and not (some[2 * at] or some[2 * at + 1]):
                some[at] = 0
                at >>= 1
        return window, room


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(window number, offset) of each piece; lengths must be in decreasing order and at most ``window``."""
    tree, n, out = RoomTree(window), 0, []
    for length in lengths:
        if length == window or (found := tree.take(length)) is None:
            found, n = (n, window), n + 1
        out.append((found[0], window - found[1]))
        tree.add(found[1] - length, found[0])
    return out


def pack(pieces: DataFrame, window: int = WINDOW, windows_per_group: int = WINDOWS_PER_GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a length; every other column stays.

    ``pieces`` is read twice (its total length sets the number of groups), so
    it should be a stored table.
    """
    names = pieces.columns
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // (window * windows_per_group)))
    at = names.index("length")

    def run(batches):
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        table = table.sort_by([("length", "descending"), *[(n, "ascending") for n in ("doc_id", "start") if n in names]])
        places = best_fit_decreasing(table.column(at).to_pylist(), window)
        first = TaskContext.get().partitionId() << 40
        table = table.append_column("sequence_id", pa.array([first + w for w, _ in places], pa.int64())).append_column("offset", pa.array([o for _, o in places], pa.int64()))
        yield from table.to_batches()

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id bigint, offset bigint"
    return pieces.repartition(groups).mapInArrow(run, ddl)


def sequences(packed: DataFrame) -> DataFrame:
    """The windows themselves: sequence_id, length, ids (little-endian uint32, pieces in order of offset)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p")).select("sequence_id", "length", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))


def packed_documents(docs: DataFrame, tokenizer_path: str, remember: int = REMEMBER) -> DataFrame:
    """One row for each piece, with a checksum in place of its ids."""
    slim = tokenise(docs, tokenizer_path, remember=remember).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(materialise(slim, "pieces"))
