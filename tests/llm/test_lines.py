import hashlib

import corpus_pipeline
from weftline.llm import lines


def brute(rows):
    pages = {}
    for _, s, t in rows:
        if t is not None:
            pages.setdefault(s, set()).add(t)
    out = []
    for i, s, t in rows:
        own = [] if t is None else t.split("\n")
        drop = {x for x in set(own) if x.strip() and (n := sum(x in p.split("\n") for p in pages[s])) >= 10 and 10 * n >= len(pages[s])}
        kept = "\n".join(x for x in own if x not in drop)
        out.append((i, len(own), sum(x in drop for x in own), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] or -1, r[1:]))


def test_equal_to_brute_force(spark, monkeypatch):
    rows = [(i, "a", f"menu\n\nbody {i}\nmenu\nfoot") for i in range(15)] + [(100 + i, None, f"menu\nx{i}") for i in range(12)]
    rows += [(200 + i, "b", "copied page\nline") for i in range(40)] + [(300 + i, "b", f"own {i}") for i in range(12)] + [(400, "c", "menu"), (401, "c", ""), (402, "c", None), (None, "a", "menu\nz")] + [(403, "c", "menu")] * 2
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, source string, text string, n_chars int")
    for limit in (100_000, 0):
        monkeypatch.setattr(lines, "BROADCAST_LINES", limit)
        got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.line_counts(docs).collect()), key=lambda r: (r[0] or -1, r[1:]))
        assert got == brute(rows)
    kept = lines.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    by = {r.doc_id: r for r in kept.collect()}
    assert by[0].text == "\nbody 0" and by[0].n_chars == 7 and by[402].text is None and by[402].n_chars is None and by[200].text == "copied page\nline"
    assert lines.line_counts(docs.limit(0)).count() == 0


def test_stage_serves_small_hosts(spark):
    rows = [(i, "four", f"menu\nbody {i}") for i in range(4)] + [(10 + i, "two", f"menu\nbody {i}") for i in range(2)]
    rows += [(100 + i, "forty", f"{'menu' if i < 4 else 'seldom' if i < 7 else 'x'}\nbody {i}") for i in range(40)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, source string, text string, n_chars int")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert all(got[i] == f"body {i}" for i in range(4)) and got[10] == "menu\nbody 0"
    assert got[100] == "body 0" and got[104] == "seldom\nbody 4" and got[110] == "body 10"
