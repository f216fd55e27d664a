import math
import random
from collections import Counter, defaultdict

import pytest

from weftline.llm import quality


def brute_base(text):
    for c in "\t\n\x0b\x0c\r":
        if c != "\n":
            text = text.replace(c, " ")
    words = [w for w in text.replace("\n", " ").split(" ") if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" "):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def brute_bits(texts, order=5):
    """The whole model in plain dictionaries."""
    norm = ["\x02" * (order - 1) + "".join("0" if c in "0123456789" else " " if c in "\t\n\x0b\x0c\r" else c for c in t) for t in texts]
    counts = {order: Counter(t[i : i + order] for t in norm for i in range(len(t) - order + 1))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    below = None
    for n in range(1, order + 1):
        c = counts[n]
        cc = Counter(c.values())
        n1, n2, n3, n4 = (cc[k] for k in (1, 2, 3, 4))
        d = [0.5, 1.0, 1.5]
        if n1 and n2 and n3 and n4:
            y = n1 / (n1 + 2 * n2)
            for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
                v = k - (k + 1) * y * b / a
                d[k - 1] = v if 0 < v < k else 0.5 * k
        total, gamma = Counter(), defaultdict(float)
        for g, v in c.items():
            total[g[:-1]] += v
            gamma[g[:-1]] += d[min(v, 3) - 1]
        p = {}
        for g, v in c.items():
            low = 1 / len(c) if below is None else below[g[1:]]
            p[g] = max(v - d[min(v, 3) - 1], 0) / total[g[:-1]] + gamma[g[:-1]] / total[g[:-1]] * low
        below = p
    return [-sum(math.log2(below[t[i : i + order]]) for i in range(len(t) - order + 1)) for t in norm]


TEXTS = ["", "a b c", "Über dem See " * 20, "x | y # z\nx | y # z\n\nx | y # z", "tab\tand\x0bfeed 12345 words 日本語"]


def test_base_counts():
    for t in TEXTS:
        assert quality.base_counts(t) == brute_base(t), t
    assert quality.base_counts(None) == (0, 0, 0, 0, 0)


@pytest.mark.parametrize("block", [4_000_000, 50])
def test_scores_equal_brute_force(spark, block):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice(["the", "thing", "oth", "é1", "Zw"]) for _ in range(rng.randint(1, 90))) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(99, None, None, "s", 1)], "doc_id long, text string, lang string, source string, key int")
    model = quality.kneser_ney(quality.count_grams(docs))
    rows = {r.doc_id: r for r in quality.scores(docs, quality.materialise(model, "m"), block).collect()}
    for i, want in enumerate(brute_bits(texts)):
        assert rows[i].bits == pytest.approx(want, rel=1e-4, abs=1e-3)
        if block > 50:
            assert tuple(rows[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_base(texts[i])
    assert rows[99].bits == 0


def test_large_alphabet_counts_alike():
    import numpy as np

    text = "".join(chr(0x4E00 + i * 7 % 6000) for i in range(9000))
    codes = quality._codes(text)
    assert quality._pack(codes) is None
    rows, counts = quality._counted(codes)
    assert counts.sum() == len(text) and len(rows) == len(np.unique(rows, axis=0))


def test_junk_goes_and_clean_text_stays(spark):
    rng = random.Random(3)
    syllables = ["tion", "ing", "the", "re", "an", "st", "ed", "er"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    clean = [" ".join(word() for _ in range(120)) for _ in range(150)]
    junk = [" ".join(word() + "%%%" + rng.choice("#$&*") for _ in range(120)) for _ in range(6)]
    same = ["Shti " * 300, "too short"]
    docs = spark.createDataFrame([(i, t, "en", 5) for i, t in enumerate([*clean, *junk, *same, clean[0]])], "doc_id long, text string, lang string, kept int")
    rows = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert all(rows[i].kept for i in range(150)) and rows[158].kept
    assert not any(rows[i].kept for i in range(150, 158))
    assert [rows[i].base_failed for i in (0, 150, 156, 157)] == [False, False, True, True]
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(150), 158]
    assert quality.quality(docs.limit(0)).count() == 0
