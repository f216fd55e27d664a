import random
from array import array

import public_tokenizers

import corpus_pipeline
from weftline.llm import common, near_duplicates, packing, queries, quality, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark, tmp_path):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["tion", "ing", "the", "re", "an", "st", "ed", "er", "ou", "wh"]) for _ in range(rng.randint(1, 3)))
    texts = [" ".join(word() for _ in range(rng.randint(80, 160))) for _ in range(120)]
    texts = [f"site menu line\n{t}" if i % 2 else t for i, t in enumerate(texts)]
    texts[5] += ' token = "0123456789abcdef0123456789abcdef01234567" end'
    texts += [texts[7], texts[7], texts[9] + " st", " ".join(word() + "%%%" for _ in range(100)), "too short", None, ""]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet"), texts


def test_stages(spark, tmp_path):
    docs, texts = documents(spark, tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "secret_scan", "packing"]
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.materialise(stage(spark, docs, str(tmp_path)), name)
        out.append(docs)
        assert k == 4 or docs.columns == COLUMNS
    kept = {r.doc_id for r in out[0].collect()}
    assert kept == {r.doc_id for r in quality.quality(common.read(spark, str(tmp_path), "documents")).where("kept").collect()}
    assert kept >= set(range(120)) and not kept & {123, 124, 125, 126}
    lined = {r.doc_id: r for r in out[1].collect()}
    assert all(lined[i].text == texts[i].replace("site menu line\n", "") and lined[i].n_chars == len(lined[i].text) for i in range(120))
    groups = {}
    for i, r in lined.items():
        groups.setdefault(near_duplicates.simhash(r.text), []).append(i)
    component = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(out[1]).collect()}
    alone = {r.doc_id for r in out[2].collect()}
    assert alone == {i for i in lined if component[i] == i} and len(alone) == out[2].count() and not alone & {120, 121}
    safe = {r.doc_id: r.text for r in out[3].collect()}
    assert set(safe) == alone and all(secrets.find(t) == ([], []) for t in safe.values()) and secrets.MARK in safe[5]
    encode = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id: r.doc_tokens for r in out[4].collect()} == {i: len(array("I", encode(t))) + 1 for i, t in safe.items()}


def test_empty_and_repeated_documents(spark, tmp_path):
    docs, _ = documents(spark, tmp_path)
    again = docs.union(docs)
    one = near_duplicates.one_of_each(again)
    assert one.columns == COLUMNS and one.count() == near_duplicates.one_of_each(docs).count()
    empty = docs.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
