import random

import corpus_pipeline
from weftline.llm import near_duplicates as nd


def brute(texts, ids):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 5, 0) + 1)})
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return [min(ids[k] for k in range(len(ids)) if label[k] == label[i]) for i in range(len(ids))]


def test_stage_links_similar_texts(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    texts = [None, "", "One two", "one  TWO", "one three"]
    for n in (150, 250, 400):
        for replaced in (1, 2, 3, 5, 8, 12, 20):
            a = [word() for _ in range(n)]
            b = list(a)
            for _ in range(replaced):
                b[rng.randrange(n)] = word()
            texts += [" ".join(a), " ".join(b)]
    base = [word() for _ in range(200)]
    for i in range(40):  # a group larger than a chunk, each within reach of the next
        base[rng.randrange(200)] = word()
        texts.append(" ".join(base))
    ids = [1000 - i for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in zip(ids, texts)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    want = dict(zip(ids, brute(texts, ids)))
    for rows in (16, 512):
        found = nd.similar(docs, rows).collect()
        assert len(found) == len(docs.collect()) and {r.doc_id: r.component_id for r in found} == want
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert nd.similar(docs.limit(0)).count() == 0


def test_fingerprints_and_grid_join_name_candidates(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    texts = [None, " "] + [" ".join(["a"] * 300 + [word() for _ in range(12)]) for _ in range(2)]  # one fingerprint, few common shingles
    for _ in range(12):
        a = [word() for _ in range(400)]
        texts += [" ".join(a), " ".join(a[:-1] + ["changed"])]
    bits = lambda x, y: ((nd.simhash(x, 5) ^ nd.simhash(y, 5)) & (2**64 - 1)).bit_count()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert bits(texts[2], texts[3]) <= 2
    near = [i for i in range(4, len(texts), 2) if bits(texts[i], texts[i + 1]) <= 2]
    assert len(near) > 6
    found = {r.doc_id: r.component_id for r in nd.similar(docs, bands=0).collect()}  # without MinHash
    assert found == {i: 0 if i == 1 else i - 1 if i - 1 in near else i for i in range(len(texts))}
    assert {r.doc_id: r.component_id for r in nd.similar(docs).collect()} == dict(enumerate(brute(texts, range(len(texts)))))
