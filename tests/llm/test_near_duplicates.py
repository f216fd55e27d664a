import random

import xxhash

from weftline.llm import near_duplicates as nd


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for w in "\t\n\x0b\x0c\r":
        low = low.replace(w, " ")
    words = [w for w in low.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, distance=2):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return [min(ids[k] for k in range(len(ids)) if label[k] == label[i]) for i in range(len(ids))]


TEXTS = [None, "", " \n", "One", "one two", "ONE two", "A b C d e f", "x\x1cy z w é É q", "a " * 500, "The quick brown fox jumps over", "The quick brown fox jumps over"]


def test_fingerprint_of_one_text():
    for t in TEXTS:
        assert nd.simhash(t) & (1 << 64) - 1 == brute_fingerprint(t), t


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(60)) for _ in range(30)]
    texts = TEXTS + base + [b.replace("a", "z", 1) for b in base] + base[:4] * 3
    docs = spark.createDataFrame([(1000 - i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(fps, [1000 - i for i in range(len(texts))])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in nd.near_duplicates(docs).collect()}
    assert got == {1000 - i: (f"{fps[i]:016x}", want[i]) for i in range(len(texts))}
    assert nd.near_duplicates(docs.limit(0)).count() == 0


def test_links_in_crowded_cells(spark):
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 400:
        x = centre
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = brute_components(fps, list(range(len(fps))))
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for rows in (16, 1024):
        roots = {r.node: r.root for r in nd.stars(nd.links(df, cell_rows=rows)).collect()}
        part = [roots.get(x, x) for x in signed]
        assert len(set(zip(part, want))) == len(set(part)) == len(set(want))


def test_repeated_rows_and_nulls(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "zz yy xx")], "doc_id long, text string")
    rows = nd.near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (-1, 5), (5, 5), (5, 5)]
