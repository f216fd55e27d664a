import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from weftline.llm import common, repeats


def brute(texts, window):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def corpus(rng, n, vocabulary):
    word = lambda: rng.choice(vocabulary)
    passage = [word() for _ in range(60)]
    texts = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(0, 200))]
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            cut = rng.randint(0, 20)
            w[at:at] = passage[cut : 60 - rng.randint(0, 20)]
        if i % 7 == 0:
            w += [word()] * rng.randint(20, 120) + [word() for _ in range(10)]
        if i % 5 == 0 and texts:
            other = texts[rng.randrange(len(texts))].split()
            if other:
                other[rng.randrange(len(other))] = word()
            w = other
        texts.append(" ".join(w))
    return texts


def test_equal_windows_choose_equal_anchors():
    rng = random.Random(4)
    for vocabulary in ("ab", "abcdef", [f"w{i}" for i in range(500)]):
        shared = [rng.choice(vocabulary) for _ in range(35)]
        found = []
        for _ in range(40):
            w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))] + shared + [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
            at = next(i for i in range(len(w)) if w[i : i + 35] == shared)
            d = repeats.digests([x.encode() for x in w])
            a, n, symbol, _, _ = repeats.chosen(d, np.zeros(len(w), int))
            k = np.flatnonzero((a <= at) & (at < a + n))
            assert len(k) == 1
            found.append(int(symbol[k[0]]))
        assert len(set(found)) == 1


@pytest.mark.parametrize(("window", "slice_"), [(35, 200_000), (35, 100)])
def test_equal_to_brute_force(spark, window, slice_, monkeypatch):
    rng = random.Random(window + slice_)
    texts = [None, "", "one", "For " * 35, "For " * 36, "For " * 34, "x\x1cy " * 40, *corpus(rng, 60, "abc"), *corpus(rng, 80, [f"wörd{i}" for i in range(300)]), *corpus(rng, 40, "abcdefgh")]
    texts += texts[-3:] + ["a b " * 300]
    if slice_ < 1000:
        # slices as a worker would cut them, without Spark
        monkeypatch.setattr(repeats, "SLICE", slice_)
        import pyarrow as pa

        batch = pa.record_batch([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "key", "text"])
        seen = Counter()
        for rows, words in repeats._texts(iter([batch]), window):
            for doc_id, _, at, n in rows:
                seen.update((doc_id, i) for i in range(at, at + n - window + 1))
        assert seen == Counter((i, k) for i, t in enumerate(texts) for k in range(len((t or "").encode().split()) - window + 1))
        return
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, key int")
    rows = {r.doc_id: r for r in repeats.without_repeats(docs, window).collect()}
    for i, want in enumerate(brute(texts, window)):
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept) == want, i
    assert len(rows) == len(texts)


def test_query_nulls_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(None, text), (1, text), (1, text), (2, "short"), (3, text.replace("w20", "zz"))], "doc_id long, text string")
    rows = repeats.removed_repeats(docs).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256 == empty) for r in rows) == [(0, 50, 50, True), (1, 50, 50, True), (1, 50, 50, True), (2, 1, 0, False), (3, 50, 0, False)]
    assert repeats.removed_repeats(docs.limit(0)).count() == 0


def test_stored_steps_go_once_their_successor_is_stored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda session: f"file://{tmp_path}")
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [f"a{i} {passage} b{i}" for i in range(20)] + [passage, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = repeats.without_repeats(docs)
    assert [p.name.split("-")[1] for p in tmp_path.glob("weftline-*")] == ["spans"]
    assert {r.doc_id: r.n_removed for r in found.collect()} == {i: 0 if i > 20 else 60 for i in range(len(texts))}
