"""Licence scan: a sparse word n-gram logistic regression over paragraphs, in SQL functions only.

A paragraph is a line, or, where a notice is wrapped, lines joined: three, four and eight lines
around each line that holds a cue. Its features are the lower-case words and word pairs, hashed
into ``FEATURES`` buckets by xxHash64. A multinomial logistic regression, fitted in the
driver on a bounded labelled sample (notices of each family in several wordings, and at
most ``ORDINARY`` paragraphs of the corpus next to written hard negatives), gives each
family and the class ``unknown`` a probability. The temperature of the softmax and the
least probability of a known family are calibrated on notices in wordings that the fit has not
seen (``HELD_OUT``). A prediction
counts only if a template of the family confirms it: at least ``COVERED`` of a
template's word pairs stand in the paragraph.

On the executors everything is a Column expression over one row: the weights are
an array literal of fixed size, so there is no join, no shuffle and no Python. Only lines with
one of ``CUES`` are scored. These words are derived from the templates so that what has
none of them cannot be confirmed (see ``cue_words``): nothing is lost.

Defined results: null and empty texts have no paragraphs; repeated rows each get
their row; an empty table gives no rows; extra columns are ignored; a very long text is scanned whole; families are
listed once, in alphabetical order; a wrapped notice is named by a line with a cue; where notices
overlap, the one that holds most word pairs of a template stands (ties: that of fewest lines).
"""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter
from functools import lru_cache, reduce

import xxhash
from pyspark.sql import Column, DataFrame

from .common import F, doc_columns

FEATURES = 4096
ORDINARY = 400
COVERED = 0.6
WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"

#: Public licence notices of each family: templates for the comparison and seeds of the labelled sample.
TEMPLATES = {
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Use of this source code is governed by a BSD-style license.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3", "SPDX-License-Identifier: LGPL-2.1-only"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"],
}
#: Written paragraphs that hold cue words but no licence notice.
HARD = [
    "The driver showed a licence to the officer at the gate.", "You need a fishing license to fish in this lake.", "Copyright 2019 The Authors. All rights reserved.",
    "The warranty of this product ends after two years.", "Permission to enter the building was granted by the owner.", "The license plate of the car was covered with mud.",
    "She asked for permission before she left the room.", "The court issued a warrant for the arrest.", "All rights reserved. No part of this publication may be reproduced.",
    "A licensed doctor must sign the form.", "The redistribution of wealth is a matter of debate.", "His general remarks on the public use of the park were noted.",
    "Contact us to obtain a commercial license for this product.", "The software is provided under a proprietary license agreement.", "Version 2.0 of the manual was published in January 2004.",
]
UNKNOWN = "unknown"
#: Other wordings, for calibration alone.
HELD_OUT = {
    "agpl": ["This server is distributed under the GNU Affero General Public License version 3 or later."],
    "apache": ["Distributed under the Apache License 2.0.", "You may use this package under the terms of the Apache License, Version 2.0."],
    "bsd": ["This project is available under the BSD 3-Clause License.", "Redistribution and use in source and binary forms are permitted provided that the conditions are met."],
    "cc-by": ["This photo is available under CC BY 4.0.", "The text of this page is licensed under a Creative Commons Attribution 4.0 licence."],
    "cc-by-nc": ["Pictures are available under CC BY-NC 4.0.", "Shared under a Creative Commons Attribution-NonCommercial 4.0 International licence."],
    "gpl": ["This package is distributed under the terms of the GNU General Public License version 2.", "You can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation."],
    "lgpl": ["The library may be used under the GNU Lesser General Public License, version 3."],
    "mit": ["This project is available under the MIT license.", "Permission is hereby granted, free of charge, to any person who obtains a copy of this software."],
    "mpl": ["The code is subject to the terms of the Mozilla Public License 2.0."],
}
#: Words that are cues only where no other serves: common in licences and elsewhere, then common everywhere.
COMMON = frozenset("associated can charge code copy deal documentation except file files free governed modify obtaining person program provided published restriction software source terms version work".split())
FREQUENT = frozenset("a an and any are as by following for forms form in is it may not of or that the this to under use with without you your".split())
#: Lines joined for wrapped notices: lines before the one with the cue, and lines in all.
JOINED = ((1, 3), (0, 4), (3, 8), (0, 8))


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams(text: str) -> list[str]:
    w = words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def bucket(gram: str) -> int:
    h = xxhash.xxh64_intdigest(gram.encode(), 42)
    return h % FEATURES


def price(word: str) -> int:
    """What a cue costs: short and common words stand in many lines that are no notices."""
    return 100 if word in FREQUENT else 30 if len(word) < 3 else 20 if word in COMMON else 8 if word.isalpha() and len(word) < 6 else 1


def cue_words() -> tuple[str, ...]:
    """Words of which every confirmed paragraph has one.

    For each template words are taken until the pairs that hold none of them are fewer than ``COVERED`` of its pairs.
    """
    cues: list[str] = []
    for templates in TEMPLATES.values():
        for t in templates:
            pairs = {g for g in grams(t) if " " in g}
            free = {g for g in pairs if not set(g.split()) & set(cues)}
            while len(free) >= COVERED * len(pairs):
                often = Counter(w for g in free for w in set(g.split()))
                cue = min(often, key=lambda w: (price(w) / often[w], w))
                cues.append(cue)
                free = {g for g in free if cue not in g.split()}
    return tuple(sorted(set(cues)))


def labelled(ordinary: list[str], seed: int, notices: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    """Notices with words dropped and words around them; hard negatives and ordinary paragraphs as unknown."""
    rng = random.Random(seed)
    filler = [w for t in [*HARD, *ordinary[:50]] for w in t.split()] or ["text"]
    around = lambda: " ".join(rng.choice(filler) for _ in range(rng.randint(0, 6)))
    out = []
    for family, templates in (notices or TEMPLATES).items():
        for t in templates:
            for _ in range(12):
                kept = " ".join(w for w in t.split() if rng.random() > 0.06)
                out.append((f"{around()} {kept} {around()}", family))
    for t in HARD * 10 + ordinary:
        out.append((" ".join(w for w in t.split() if rng.random() > 0.1) + " " + around(), UNKNOWN))
    rng.shuffle(out)
    return out


CUES = cue_words()


class Classifier:
    """Multinomial logistic regression on hashed n-grams, fitted by AdaGrad with L2."""

    def __init__(self, sample: list[tuple[str, str]], epochs: int = 12, rate: float = 0.5, decay: float = 1e-4) -> None:
        self.classes = [*sorted(TEMPLATES), UNKNOWN]
        c = len(self.classes)
        self.weights = [[0.0] * c for _ in range(FEATURES)]
        self.bias = [0.0] * c
        seen = [[1e-6] * c for _ in range(FEATURES)]
        rows = [(self.features(t), self.classes.index(y)) for t, y in sample]
        for _ in range(epochs):
            for x, y in rows:
                p = self.softmax(self.logits(x))
                for k in range(c):
                    g = p[k] - (k == y)
                    if abs(g) < 1e-3:
                        continue
                    self.bias[k] -= 0.01 * g
                    for i, v in x.items():
                        d = g * v + decay * self.weights[i][k]
                        seen[i][k] += d * d
                        self.weights[i][k] -= rate * d / math.sqrt(seen[i][k])
        self.weights = [[round(w, 3) for w in row] for row in self.weights]
        self.bias = [round(b, 3) for b in self.bias]
        self.temperature, self.least = 1.0, 0.5

    @staticmethod
    def features(text: str) -> dict[int, float]:
        """Each feature once, scaled so that a paragraph has length one."""
        on = {bucket(g) for g in grams(text)}
        return {i: 1 / math.sqrt(len(on)) for i in on}

    def logits(self, x: dict[int, float]) -> list[float]:
        out = list(self.bias)
        for i, v in x.items():
            for k, w in enumerate(self.weights[i]):
                out[k] += v * w
        return out

    @staticmethod
    def softmax(z: list[float], temperature: float = 1.0) -> list[float]:
        top = max(z)
        e = [math.exp((v - top) / temperature) for v in z]
        return [v / sum(e) for v in e]

    def calibrate(self, held_out: list[tuple[str, str]]) -> None:
        """The temperature of least log loss; then the least probability that lets at most 1 % of the unknown pass."""
        rows = [(self.logits(self.features(t)), self.classes.index(y)) for t, y in held_out]
        loss = lambda t: -sum(math.log(max(self.softmax(z, t)[y], 1e-12)) for z, y in rows)
        self.temperature = min((0.25 * 1.25**i for i in range(16)), key=loss)
        unknown = len(self.classes) - 1
        wrong = sorted((max(self.softmax(z, self.temperature)[:unknown]) for z, y in rows if y == unknown), reverse=True)
        self.least = round(min(0.95, max(0.5, wrong[len(wrong) // 100] if wrong else 0.5)), 4)

    def predict(self, text: str) -> tuple[str, float]:
        p = self.softmax(self.logits(self.features(text)), self.temperature)
        k = p.index(max(p))
        return (self.classes[k], p[k]) if self.classes[k] != UNKNOWN and p[k] >= self.least else (UNKNOWN, p[k])


def confirmed(family: str, text: str) -> bool:
    """Whether the paragraph has COVERED of a template's word pairs."""
    have = set(grams(text)) - set(words(text))
    return any(len(t & have) >= COVERED * len(t) for t in pairs_of(family))


@lru_cache(maxsize=64)
def pairs_of(family: str) -> tuple[frozenset[str], ...]:
    return tuple(frozenset(g for g in grams(t) if " " in g) for t in TEMPLATES[family])


def fit(docs: DataFrame, ordinary: int = ORDINARY) -> Classifier:
    """Fits on the notices and on ``ordinary`` paragraphs at most: those of least hash in as many documents of least hash."""
    rows = doc_columns(docs).where("text <> ''")
    few = rows.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(ordinary).select(F.col("doc_id").alias("id")).distinct()
    few = rows.join(F.broadcast(few), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")  # ``ordinary`` ids at most
    lines = few.select(F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"[^\s]") & ~_cued(F.lower("line"))).distinct()
    lines = [r.line for r in lines.orderBy(F.xxhash64("line"), "line").limit(ordinary).collect()]
    model = Classifier(labelled(lines, seed=1))
    model.calibrate(labelled(lines, 2, HELD_OUT))
    return model


# --- Column expressions -------------------------------------------------------------------------------------


def _literal(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


def _cued(low: Column) -> Column:
    """Whether a lower-case text holds one of CUES."""
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(c)) for c in CUES])


def _pairs(w: Column) -> Column:
    return F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def scanned(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, n_paragraphs, and found: (paragraph, family, probability) of every confirmed notice, in order."""
    c = len(model.classes)
    rows = doc_columns(docs).withColumn("lines", F.split("text", "\n"))
    low = F.lower("text")
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    rows = rows.withColumn("cued", F.when(_cued(low), F.filter(numbered, lambda x: _cued(F.lower(x.line)))))

    def joined(at: Column, before: int, n: int) -> Column:
        first = F.greatest(at - before, F.lit(0))
        return F.struct(F.struct(F.lit(n).alias("n"), at.alias("at"), first.alias("first")).alias("place"), F.array_join(F.slice("lines", first + 1, F.lit(n)), " ").alias("text"))

    def units(x: Column) -> Column:
        alone = F.struct(F.struct(F.lit(1).alias("n"), x.at.alias("at"), x.at.alias("first")).alias("place"), x.line.alias("text"))
        return F.array(alone, *[joined(x.at, before, n) for before, n in JOINED])

    rows = rows.withColumn("cued", F.flatten(F.transform("cued", units)))
    rows = rows.withColumn("cued", F.transform("cued", lambda x: F.struct(x.place.alias("place"), F.regexp_extract_all(F.lower(x.text), F.lit(f"({WORD})"), F.lit(1)).alias("w"))))
    rows = rows.withColumn("cued", F.transform("cued", lambda x: F.struct(x.place.alias("place"), x.w.alias("w"), F.array_distinct(_pairs(x.w)).alias("pairs"))))
    on = lambda x: F.array_distinct(F.transform(F.concat(x.w, x.pairs), lambda g: _bucket(g)))
    rows = rows.withColumn("cued", F.transform("cued", lambda x: F.struct(x.place.alias("place"), x.pairs.alias("pairs"), on(x).alias("on"))))
    table = _literal(model.weights, "array<array<double>>")
    zero = _literal([0.0] * c, "array<double>")
    summed = lambda x: F.aggregate(x.on, zero, lambda a, i: F.zip_with(a, F.get(table, i), lambda u, v: u + v))
    bias = _literal(model.bias, "array<double>")
    logits = lambda x: F.zip_with(summed(x), bias, lambda s, b: (s / F.sqrt(F.greatest(F.size(x.on), F.lit(1))) + b) / model.temperature)
    rows = rows.withColumn("cued", F.transform("cued", lambda x: F.struct(x.place.alias("place"), x.pairs.alias("pairs"), logits(x).alias("z"))))
    total = lambda x: F.aggregate(x.z, F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max(x.z)))
    names = _literal(model.classes, "array<string>")
    rows = rows.withColumn("cued", F.transform("cued", lambda x: F.struct(x.place.alias("place"), x.pairs.alias("pairs"), F.element_at(names, F.array_position(x.z, F.array_max(x.z)).cast("int")).alias("family"), (1.0 / total(x)).alias("p"))))
    rows = rows.withColumn("cued", F.filter("cued", lambda x: (x.family != UNKNOWN) & (x.p >= model.least)))
    templates = _literal([[sorted(t) for t in pairs_of(f)] for f in sorted(TEMPLATES)], "array<array<array<string>>>")
    of = lambda x: F.element_at(templates, F.array_position(names, x.family).cast("int"))
    held = lambda x, t: F.size(F.array_intersect(t, x.pairs))
    pairs = lambda x: F.array_max(F.transform(of(x), lambda t: F.when(held(x, t) >= COVERED * F.size(t), held(x, t)).otherwise(0)))
    rows = rows.withColumn("cued", F.transform("cued", lambda x: F.struct((-pairs(x)).alias("rank"), x.place.alias("place"), x.family.alias("family"), x.p.alias("p"))))
    # where lines overlap, the notice with most pairs of a template stands, of equal ones that of fewest lines
    ranked = F.array_sort(F.filter("cued", lambda x: x.rank < 0))
    meets = lambda a, b: (a.place.first < b.place.first + b.place.n) & (b.place.first < a.place.first + a.place.n)
    kept = F.aggregate(ranked, F.slice(ranked, 1, 0), lambda seen, x: F.when(F.exists(seen, lambda y: meets(x, y)), seen).otherwise(F.concat(seen, F.array(x))))
    notices = F.array_sort(F.transform(kept, lambda x: F.struct(x.place.at.alias("paragraph"), x.family.alias("family"), F.round(x.p, 4).alias("probability"))))
    found = F.coalesce(notices, F.array().cast("array<struct<paragraph:int,family:string,probability:double>>"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter("lines", lambda x: x.rlike(r"[^\s]"))))
    return rows.select("doc_id", n.cast("long").alias("n_paragraphs"), found.alias("found"))


def _bucket(gram: Column) -> Column:
    """The unsigned hash modulo FEATURES, a power of two: its low bits."""
    return F.xxhash64(gram).bitwiseAND(F.lit(FEATURES - 1)).cast("int")


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_notices, families and the notices themselves, of every document."""
    rows = scanned(docs, fit(docs))
    listed = F.array_join(F.array_sort(F.array_distinct(F.col("found.family"))), ",")
    notices = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x.paragraph.cast("string"), x.family)), ",")
    return rows.select("doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_notices"), listed.alias("families"), notices.alias("notices"))
