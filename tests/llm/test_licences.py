import random

from weftline.llm import licences


def test_held_out_accuracy():
    rng = random.Random(4)
    plain = [" ".join(rng.choice(["the", "tion", "ing", "of", "er", "was"]) for _ in range(12)) for _ in range(60)]
    model = licences.Classifier(licences.labelled(plain, 1))
    model.calibrate(licences.labelled(plain, 2))
    test = licences.labelled(plain, 9)
    right = [(model.predict(t)[0], y) for t, y in test]
    known = [(p, y) for p, y in right if y != licences.UNKNOWN]
    assert sum(p == y for p, y in known) / len(known) > 0.95
    assert sum(p != licences.UNKNOWN for p, y in right if y == licences.UNKNOWN) / sum(y == licences.UNKNOWN for _, y in right) < 0.03


def test_columns_equal_the_classifier(spark):
    texts = [None, "", "plain prose\nof two lines", "x\nReleased under the MIT License.", "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", *licences.HARD]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, families string")
    model = licences.fit(docs)
    rows = {r.doc_id: r for r in licences.scanned(docs, model).collect()}
    for i, t in enumerate(texts):
        want = []
        for k, line in enumerate((t or "").split("\n")):
            if any(c in line.lower() for c in licences.CUES):
                family, p = model.predict(line)
                if family != licences.UNKNOWN and licences.confirmed(family, line):
                    want.append((k, family, round(p, 4)))
        assert [(f.paragraph, f.family) for f in rows[i].found] == [w[:2] for w in want]
        assert all(abs(f.probability - w[2]) < 2e-3 for f, w in zip(rows[i].found, want))
    out = {r.doc_id: r for r in licences.licences(docs).collect()}
    assert [out[i].families for i in range(6)] == ["", "", "", "mit", "apache,gpl", "cc-by-nc"]
    assert [out[i].n_paragraphs for i in range(4)] == [0, 0, 2, 2]
    assert licences.licences(docs.limit(0)).count() == 0


def test_what_has_no_cue_is_never_confirmed():
    cues = set(licences.CUES)
    for templates in licences.TEMPLATES.values():
        for t in templates:
            pairs = {g for g in licences.grams(t) if " " in g}
            assert sum(not set(g.split()) & cues for g in pairs) < licences.COVERED * len(pairs), t


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this",
    "cc-by": "This photo is available under CC BY 4.0.",
    "cc-by-nc": "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.",
}


def test_wrapped_notices_repeated_rows_and_long_texts(spark):
    rng = random.Random(5)
    line = lambda: " ".join(rng.choice(["the", "tion", "ing", "of", "er", "was"]) for _ in range(12))
    texts = {f: "\n".join([line() for _ in range(6)] + [t] + [line() for _ in range(6)]) for f, t in WRAPPED.items()}
    texts["mit,mpl"] = "\n".join([line() for _ in range(4000)] + [WRAPPED["mit"]] + [line() for _ in range(4000)] + [WRAPPED["mpl"]])
    texts["mit "] = "word " * 200_000 + "Released under the MIT License."
    rows = [(i, t, f) for i, (f, t) in enumerate(texts.items())] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, cued string")
    got = licences.licences(docs).collect()
    assert len(got) == len(rows)
    want = {i: f.strip() for i, f in enumerate(texts)}
    want[len(texts) - 1] = ""  # a notice within one paragraph of a million characters: too thin to be told
    assert {r.doc_id: r.families for r in got if r.doc_id != len(texts) - 1} == {i: f for i, f in want.items() if i != len(texts) - 1}
    assert all(r.n_notices == len(want[r.doc_id].split(",")) for r in got if r.doc_id != len(texts) - 1)


def test_wordings_of_no_fit_and_no_calibration(spark):
    notices = [
        ("mit", "Code samples are available under the MIT license."), ("apache", "All files are licensed under the Apache License, Version 2.0, unless noted."), ("gpl", "This tool is released under the GNU General Public License, version 3."),
        ("cc-by", "Maps are licensed under CC BY 4.0."), ("lgpl", "This binding is licensed under the GNU Lesser General Public License, version 2.1."), ("agpl", "The site runs code licensed under the GNU Affero General Public License, version 3."),
    ]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(notices)], "doc_id long, text string")
    got = {r.doc_id: r.families for r in licences.licences(docs).collect()}
    assert [got[i] for i in range(len(notices))] == [f for f, _ in notices]
