import random
import zlib
from array import array

import public_tokenizers
import pytest

from weftline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, "Hello, World!  it's   we'll 123 ½ ² don't", "ΟΔΟΣ ΣΑΣ Σ", "İstanbul DŽ ǅ", "é e ́x", "a b c​d", "日本語 テスト 12三", "x\x0by\x0cz\x1cw\x1fv\x85u",
    "<|startoftext|> <|endoftext|>", "ß straße ÀÉ Ñandú", "A" * 9000 + " b", "😀👍🏽 🇩🇪 ok", "\n\n\t \r\n", "­ soft­hyphen", "½¼¾ ²³¹ ªº µ", "#*$%&|<>", "ͅᾳ Å K", "a'sb 's'S 'LL", "\x00 nul\x00x",
]


def brute(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return t.encode(text or "", add_special_tokens=False).ids + [2]


def test_words_equal_whole_text():
    encode = packing.WordEncoder(PATH, remember=1000)
    for text in ODD:
        assert list(array("I", encode(text or "") if text else b"")) + [2] == brute(text), repr(text)[:80]
    rng = random.Random(1)
    alphabet = "abAB 'sSΣéÉßıİ½1²\ń 日,.-_" 
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(40))
        assert list(array("I", encode(text))) + [2] == brute(text), repr(text)


def test_every_code_point():
    from tokenizers import Tokenizer

    library, encode = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    for c in range(1, 0x110000):
        if not 0xD800 <= c <= 0xDFFF and (c < 0x3000 or c % 97 == 0):
            text = f"a{chr(c)}b1{chr(c)} {chr(c)} {chr(c)}{chr(c)}'S x"
            assert list(array("I", encode(text))) == library.encode(text, add_special_tokens=False).ids, hex(c)


def test_strings_of_added_tokens_are_the_library_s():
    encode = packing.WordEncoder(PATH)
    assert list(array("I", encode("a <|endoftext|> b"))) == [320, 49407, 321]
    assert list(array("I", encode("<|endoftext|> yes"))) == [49407, 1958]


def test_best_fit_is_the_tightest_window():
    rng = random.Random(3)
    for window in (8, 37, 64):
        lengths = sorted((rng.randint(1, window) for _ in range(200)), reverse=True)
        rooms, want = [], []
        for n in lengths:
            best = min((r for r in rooms if r >= n), default=None)
            if best is None:
                rooms.append(window - n)
                want.append(window)
            else:
                rooms[rooms.index(best)] -= n
                want.append(best)
        got = packing.best_fit_decreasing(lengths, window)
        assert [window - o for _, o in got] == want


@pytest.mark.parametrize("group", [1, 2048])
def test_pieces_cover_every_id_once(spark, group):
    texts = [*ODD, "word " * 10_000, "same text", "same text"]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, length int, ids string")
    pieces = packing.materialise(packing.tokenise(docs, PATH), "t")
    rows = packing.pack(pieces, windows_per_group=group).collect()
    for i, text in enumerate(texts):
        ids = brute(text)
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in own for x in array("I", bytes(r.ids))] == ids
        assert [r.start for r in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        assert all(r.doc_tokens == len(ids) for r in own)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= 4096
    whole = packing.sequences(packing.pack(pieces)).collect()
    assert all(len(r.ids) == 4 * r.length for r in whole)


def test_query_columns_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = packing.packed_documents(docs, PATH).collect()
    ids = array("I", brute("a b")).tobytes()
    assert [(x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens, x.offset) for x in r] == [(1, 0, 3, zlib.crc32(ids), 3, 0)]
    assert packing.packed_documents(docs.limit(0), PATH).count() == 0
