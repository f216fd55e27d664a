import hashlib
import random
import sys

import public_tokenizers as P
import tiktoken

from weftline.llm import bytes_bpe

PATH = P.path("byte_bpe_50k.tiktoken")
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytes_bpe.read_ranks(PATH), special_tokens={})
BPE = bytes_bpe.ByteBpe(PATH, P.PATTERN, remember=20_000)
ODD = ["", "a  b", "a   b", " a", "a ", "  ", "a\n b", "a \nb", "a\n\n  b", "\t x", "it's  we'll 'S", "é ñ ß", "日本語 テスト", "  b", "a  b", "x\x1cy \x85z", "1234 56", "<|endoftext|>", "a" * 3000, "#" * 500 + " ##", "a\nb\n\nc d\n", "\na\n\n", "a\n\n\nb", "a \n b", "x \ny", " \n", "\n", "\n\n", "\n\n\n"]


def ids(text):
    return memoryview(BPE.encode(text)).cast("I").tolist()


def test_ids_equal_the_library():
    for text in ODD:
        assert ids(text) == ENC.encode_ordinary(text), repr(text)
        assert BPE.decode(ids(text)) == text.encode()
    rng = random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice("ab '\n\t.,12éß  stTheing日 #") for _ in range(30))
        assert ids(text) == ENC.encode_ordinary(text), repr(text)


def test_spaces_among_other_white_space():
    assert ids("Name: \xa0 \xa0 \xa0 value") == [5376, 25, 11504, 5624, 1988]
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice("  \xa0\xa0\n\r\t\u3000\u2003a1.") for _ in range(rng.randint(1, 14)))
        assert ids(text) == ENC.encode_ordinary(text), repr(text)


def test_line_breaks():
    rng = random.Random(4)
    for _ in range(8000):
        text = "".join(rng.choice("ab1.' \n\n\n\r\xa0") for _ in range(rng.randint(1, 14)))
        assert ids(text) == ENC.encode_ordinary(text), repr(text)


def test_very_long_text_is_whole(monkeypatch):
    monkeypatch.setattr(bytes_bpe.ByteBpe, "AT_ONCE", 7)
    text = "".join(random.Random(5).choice(["word ", "Other", "\n", " 12", ", "]) for _ in range(20_000))
    want = ENC.encode_ordinary(text)
    assert ids(text) == want
    assert next(BPE.digests([text])) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_every_code_point():
    for c in range(0, sys.maxunicode + 1):
        if not 0xD800 <= c <= 0xDFFF and (c < 0x3000 or c % 97 == 0):
            text = f"a{chr(c)}b1{chr(c)} {chr(c)} x"
            assert ids(text) == ENC.encode_ordinary(text), hex(c)


def test_query(spark):
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate([*ODD, None])], "doc_id long, text string, ids int")
    rows = {r.doc_id: r for r in bytes_bpe.digests(docs, PATH, P.PATTERN).collect()}
    for i, t in enumerate([*ODD, ""]):
        want = ENC.encode_ordinary(t)
        assert rows[i].n_tokens == len(want)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    back = bytes_bpe.decoded_texts(bytes_bpe.encoded(docs, PATH, P.PATTERN)).collect()
    assert {r.doc_id: r.text for r in back} == dict(enumerate([*ODD, ""]))
    assert bytes_bpe.digests(docs.limit(0), PATH, P.PATTERN).count() == 0
