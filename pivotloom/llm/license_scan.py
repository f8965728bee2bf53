"""Licence scans: a trained paragraph classifier, confirmed against templates.

A paragraph is a line of a text, or a run of lines joined by spaces. Its features are the
word uni- and bigrams of the training vocabulary that occur in it; a softmax regression
gives each licence family and the class `unknown` a score, scores are calibrated by a
temperature fitted on variants of held-out templates, and a family is predicted where its probability
beats all others, including unknown's. A prediction is confirmed if at least `CONFIRM` of
the bigrams of one of the family's templates occur in the paragraph, and one of them is in
no other family's templates (half of a GPL notice is close to an LGPL one).

Every line is classified. Notices are mostly wrapped, so runs of lines are too, where the
first and the last line add a bigram of a template (others can't begin or end a notice) and
the lines between hold at most `BETWEEN` words, which no notice exceeds that could be
confirmed by its own words. Marks of comments are no words, and lines without a word are
passed over. A run counts if it is confirmed, and no line or shorter run within it is so
confirmed for the same family.

Training runs on the driver over variants that a fixed rule makes of `TEMPLATES` and
`OTHER_TEXT` (a few thousand rows, whatever the data). Scanning is one expression over
constant arrays: a map without a join, a shuffle or Python.

Results for odd rows: a null or empty text has no paragraph and no licence; very long
texts are scanned whole; repeated rows get the same result; ties of probability go to the
family named first; an empty table gives no row. Only the key and the text are read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pivotloom.llm.common import longs

SEED = 42
CONFIRM = 0.7
SHORTEST_UNIGRAM = 4
#: A paragraph with fewer features is unknown.
LEAST_FEATURES = 2

# Notices and first sentences of public licences, by family.
TEMPLATES = {
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC0": [
        "Dedicated to the public domain under CC0 1.0.", "This work has been marked as dedicated to the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GPL version 2.",
    ],
    "ISC": [
        "Released under the ISC License.", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ],
}
#: Most words between the first and the last line of a notice: those of the longest template, and one for each bigram that it may miss.
BETWEEN = math.ceil((2 - CONFIRM) * max(len(re.findall("[a-z0-9]+", t.lower())) for ts in TEMPLATES.values() for t in ts))
UNKNOWN = "unknown"
# Function words; they, and pairs of them, are no features.
STOP = set("a an and are as at be for from in is it may not of on or that the this to with you your".split())
# Text that shares words with licences and is none.
OTHER_TEXT = [
    "The driver lost the license after the second accident on the road.", "Fishing without a license is not permitted on this river.",
    "The museum reserved all rooms on the upper floor for the exhibition.", "Version 2.0 of the program is faster than the first one.",
    "The general public was invited to the opening of the library.", "Apache helicopters were seen over the valley that morning.",
    "Students at MIT released a new study of ocean currents.", "This work is part of a series on the history of software.",
    "Creative people and the commons they share with others.", "The foundation published a free map of the public gardens.",
    "You may use the side door except on Sundays.", "Permission to enter the park is granted to any person with a ticket.",
    "The terms of the treaty were agreed to in writing by both sides.", "All the rights and duties of a citizen are set out in the law.",
    "The conditions are met by everyone who has paid the fee.", "The source of the river lies in the northern hills.",
    "He kept a copy of the documentation files in a box.", "Free of charge, the bus takes visitors to the lake.",
]


def words_of(paragraph: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", paragraph.lower()) if w]


def hashed(*words: str) -> int:
    """The signed hash of one or two words, as Spark's xxhash64 gives it."""
    h = SEED
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def bigrams_of(paragraph: str) -> set[int]:
    w = words_of(paragraph)
    return {hashed(a, b) for a, b in zip(w, w[1:]) if a not in STOP or b not in STOP}


def grams_of(paragraph: str) -> set[int]:
    return {hashed(x) for x in words_of(paragraph) if len(x) >= SHORTEST_UNIGRAM and x not in STOP} | bigrams_of(paragraph)


def bigrams_of_one_family(family: str) -> set[int]:
    """Bigrams of a family's templates that are in no other family's."""
    other = {h for f, ts in TEMPLATES.items() if f != family for t in ts for h in bigrams_of(t)}
    return {h for t in TEMPLATES[family] for h in bigrams_of(t)} - other


def vocabulary_of_templates() -> list[int]:
    """Only grams of templates are features; other words count for nothing."""
    return sorted({h for ts in TEMPLATES.values() for t in ts for h in grams_of(t)})


def variants() -> list[tuple[str, str, int]]:
    """(family, paragraph, source): whole templates, with words before and behind, cut and thinned.

    Rows made of one template or text have one source number.
    """
    rng = np.random.default_rng(11)
    words = sorted({w for ts in TEMPLATES.values() for t in ts for w in t.split()} | {w for t in OTHER_TEXT for w in t.split()})
    rows, source = [], 0
    for family, t in [(f, t) for f, ts in TEMPLATES.items() for t in ts]:
        w = t.split()
        rows += [(family, t, source)] * 4
        for n in range(16):
            extra = list(rng.choice(words, size=rng.integers(0, 6)))
            kept = [x for x in w if rng.random() > 0.06]
            rows.append((family, " ".join(extra + kept if n % 2 else kept + extra), source))
        rows += [(UNKNOWN, " ".join(w[: max(1, len(w) // 4)]), source), (UNKNOWN, " ".join(rng.permutation(w)), source)]
        source += 1
    for t in OTHER_TEXT:
        rows += [(UNKNOWN, t, source)] * 4
        source += 1
    for n in range(1200):
        rows.append((UNKNOWN, " ".join(rng.choice(words, size=rng.integers(1, 25))), source + n))
    return rows + [(UNKNOWN, "", source + 1200)] * 50


@dataclass
class LicenceModel:
    classes: list[str]
    vocabulary: list[int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, paragraph: str) -> np.ndarray:
        g = grams_of(paragraph) & set(self.vocabulary)
        if len(g) < LEAST_FEATURES:
            return np.eye(len(self.classes))[-1]
        z = (self.bias + sum((self.weights[i] for i, h in enumerate(self.vocabulary) if h in g), np.zeros(len(self.classes)))) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, paragraph: str) -> tuple[str, float, bool]:
        p = self.probabilities(paragraph)
        family, own = self.classes[int(p.argmax())], bigrams_of(paragraph)
        shares = [len(own & b) / len(b) for t in TEMPLATES.get(family, []) if (b := bigrams_of(t))]
        return family, float(p.max()), max(shares, default=0.0) >= CONFIRM and bool(own & bigrams_of_one_family(family))


def train(rounds: int = 400, penalty: float = 1e-3) -> LicenceModel:
    """Weights are fitted on four of five sources, the temperature on the fifth; then the weights on all."""
    rows = variants()
    grams = [grams_of(p) for _, p, _ in rows]
    vocabulary = vocabulary_of_templates()
    at = {h: i for i, h in enumerate(vocabulary)}
    classes = [*TEMPLATES, UNKNOWN]
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for r, g in enumerate(grams):
        x[r, [at[h] for h in g if h in at]] = 1
    y = np.eye(len(classes), dtype=np.float32)[[classes.index(c) for c, _, _ in rows]]
    held = np.array([source for _, _, source in rows]) % 5 == 4

    def fit(xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b = np.zeros((len(vocabulary), len(classes)), np.float32), np.zeros(len(classes), np.float32)
        for _ in range(rounds):
            z = xs @ w + b
            e = np.exp(z - z.max(1, keepdims=True))
            g = e / e.sum(1, keepdims=True) - ys
            w -= 0.5 * (xs.T @ g / len(xs) * 4 + penalty * w)
            b -= 0.5 * g.mean(0)
        return w, b

    w, b = fit(x[~held], y[~held])
    z = x[held] @ w + b

    def loss(t: float) -> float:
        s = z / t
        top = s.max(1, keepdims=True)
        return float((np.log(np.exp(s - top).sum(1)) + top[:, 0] - (s * y[held]).sum(1)).mean())

    grid = np.exp(np.linspace(-1.5, 1.5, 61))
    w, b = fit(x, y)
    return LicenceModel(classes, vocabulary, np.round(w.astype(float), 6), np.round(b.astype(float), 6), round(float(min(grid, key=loss)), 6))


def numbers(values: list[float]) -> Column:
    return F.expr(f"cast(split('{','.join(map(repr, values))}', ',') as array<double>)")


def perfect_table(hashes: list[int]) -> tuple[int, list[int]]:
    """A number of slots at which no two hashes meet, and each slot's place in the list, or 0."""
    slots = 64 * len(hashes) | 1
    while len({h % slots for h in hashes}) < len(hashes):
        slots += 2
    out = [0] * slots
    for i, h in enumerate(hashes):
        out[h % slots] = i + 1
    return slots, out


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def words_column(paragraph: Column) -> Column:
    return F.filter(F.split(F.lower(paragraph), "[^a-z0-9]+"), lambda x: x != "")


def feature_column(model: LicenceModel):
    """A column function: the place of a hash in the vocabulary, or 0."""
    slots, places = perfect_table(model.vocabulary)
    table, hashes = longs(places), longs(model.vocabulary)

    def feature(h: Column) -> Column:
        at = F.element_at(table, (F.pmod(h, F.lit(slots)) + 1).cast("int"))
        return F.when((at > 0) & (F.get(hashes, (at - 1).cast("int")) == h), at).otherwise(F.lit(0))

    return feature


def line_column(line: Column, number: Column, model: LicenceModel) -> Column:
    """struct<i, n, first, last, hits, paired>: words, distinct features, and whether a bigram is among them."""
    feature = feature_column(model)

    def after_words(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: feature(F.xxhash64(a, b)))
        return let(F.filter(pairs, lambda f: f > 0), lambda found: after_pairs(w, found))

    def after_pairs(w: Column, found: Column) -> Column:
        single = F.filter(F.transform(w, lambda x: feature(F.xxhash64(x))), lambda f: f > 0)
        return F.struct(
            number.alias("i"), F.size(w).alias("n"), F.get(w, F.lit(0)).alias("first"), F.get(w, F.size(w) - 1).alias("last"),
            F.array_distinct(F.concat(single, found)).alias("hits"), (F.size(found) > 0).alias("paired"),
        )

    return let(words_column(line), after_words)


def hits_result(hits: Column, model: LicenceModel) -> Column:
    """struct<family, probability, confirmed> of a line or run with these features; null for too few."""
    place = {h: i + 1 for i, h in enumerate(model.vocabulary)}
    weights = [numbers([0.0, *model.weights[:, c].tolist()]) for c in range(len(model.classes))]
    names = F.expr("array({})".format(", ".join(f"'{c}'" for c in model.classes)))
    shapes = {f: [sorted(b) for t in ts if (b := bigrams_of(t))] for f, ts in TEMPLATES.items()}

    def after_hits(hits: Column) -> Column:
        z = F.array(*[_sum(hits, weights[c], float(model.bias[c])) for c in range(len(model.classes))])
        return F.when(F.size(hits) >= LEAST_FEATURES, let(F.transform(z, lambda v: v / model.temperature), lambda s: after_scores(s, hits)))

    def _sum(hits: Column, weight: Column, bias: float) -> Column:
        return F.aggregate(hits, F.lit(bias), lambda s, f: s + F.element_at(weight, (f + 1).cast("int")))

    def after_scores(s: Column, hits: Column) -> Column:
        best = F.array_position(s, F.array_max(s)).cast("int")
        family = F.element_at(names, best)
        probability = 1 / F.aggregate(s, F.lit(0.0), lambda t, v: t + F.exp(v - F.array_max(s)))
        confirmed = F.lit(False)
        for f, templates in shapes.items():
            own = [F.size(F.array_intersect(hits, longs([place[h] for h in t]))) / len(t) >= CONFIRM for t in templates]
            fits = own[0]
            for o in own[1:]:
                fits = fits | o
            fits = fits & F.arrays_overlap(hits, longs([place[h] for h in sorted(bigrams_of_one_family(f))]))
            confirmed = F.when(family == f, fits).otherwise(confirmed)
        return F.struct(family.alias("family"), probability.alias("probability"), confirmed.alias("confirmed"))

    return let(hits, after_hits)


def run_ends(lines: Column, cross: Column, a: Column) -> Column:
    """Last places in `lines` (with words) of the runs from place a that could be a notice, at most `BETWEEN` + 1 of them.

    `cross` has, for each line but the last, the feature of its last and the next line's first word, or 0.
    """
    def ends(k: Column) -> Column:
        return lines[k]["paired"] | (cross[k - 1] > 0)

    def between(b: Column) -> Column:
        return F.aggregate(F.slice(lines, a + 2, b - a - 1), F.lit(0), lambda s, x: s + x["n"])

    last = F.sequence(a + 1, F.least(a + 1 + BETWEEN, F.size(lines) - 1))
    begins = (a + 1 < F.size(lines)) & (lines[a]["paired"] | (F.get(cross, a) > 0))
    return F.when(begins, F.filter(last, lambda b: ends(b) & (between(b) <= BETWEEN))).otherwise(F.expr("cast(array() as array<int>)"))


def scan(docs: DataFrame, model: LicenceModel | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_paragraphs (lines) and found: the licensed lines and runs of lines of every row.

    Of `found`, `paragraph` is the first line's number and `last` the last one's. Confirmed
    runs stand by the line they begin with, so that each is compared with those within its
    own lines alone, which are bounded.
    """
    model = model or train()
    feature = feature_column(model)
    paragraphs = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[\r\n]+"), lambda p: p != "")
    rows = docs.select(F.col(key), paragraphs.alias("_p"))
    rows = rows.select(key, F.size("_p").alias("n_paragraphs"), F.transform("_p", lambda p, i: line_column(p, i, model)).alias("_lines"))

    def entry(a: Column, b: Column, r: Column) -> Column:
        return F.struct(a.alias("paragraph"), b.alias("last"), r["family"].alias("family"), r["probability"].alias("probability"), r["confirmed"].alias("confirmed"))

    def judged(x: Column) -> Column:
        own = let(hits_result(x["hits"], model), lambda r: F.when(F.coalesce(r["family"] != UNKNOWN, F.lit(False)), entry(x["i"], x["i"], r)))
        return F.struct(*[x[c].alias(c) for c in ("i", "n", "first", "last", "hits", "paired")], own.alias("own"))

    rows = rows.select(key, "n_paragraphs", F.transform("_lines", judged).alias("_lines"))

    def joined(lines: Column) -> Column:
        m = F.greatest(F.size(lines) - 1, F.lit(0))
        cross = F.zip_with(F.slice(lines, F.lit(1), m), F.slice(lines, F.lit(2), m), lambda x, y: feature(F.xxhash64(x["last"], y["first"])))
        return let(cross, lambda c: F.transform(lines, lambda _, a: from_line(lines, c, a)))

    def from_line(lines: Column, cross: Column, a: Column) -> Column:
        runs = F.transform(run_ends(lines, cross, a), lambda b: of_run(lines, cross, a, b))
        return F.filter(runs, lambda x: F.coalesce(x["run"]["confirmed"], F.lit(False)))

    def of_run(lines: Column, cross: Column, a: Column, b: Column) -> Column:
        own = F.flatten(F.transform(F.slice(lines, a + 1, b - a + 1), lambda x: x["hits"]))
        hits = F.array_distinct(F.concat(own, F.filter(F.slice(cross, a + 1, b - a), lambda f: f > 0)))
        return F.struct(b.alias("b"), let(hits_result(hits, model), lambda x: entry(lines[a]["i"], lines[b]["i"], x)).alias("run"))

    words = F.filter("_lines", lambda x: x["n"] > 0)
    rows = rows.select(key, "n_paragraphs", F.filter(F.transform("_lines", lambda x: x["own"]), lambda x: x.isNotNull()).alias("_alone"), words.alias("_words"))
    rows = rows.withColumn("_runs", joined(F.col("_words")))

    def within(x: Column, y: Column) -> Column:
        return F.coalesce(y["confirmed"] & (y["family"] == x["family"]) & (y["last"] <= x["last"]) & (y["last"] - y["paragraph"] < x["last"] - x["paragraph"]), F.lit(False))

    def least(own: Column, a: Column) -> Column:
        lines, runs = F.col("_words"), F.col("_runs")
        inner = lambda x, k: within(x["run"], lines[k]["own"]) | F.exists(runs[k], lambda y: within(x["run"], y["run"]))
        kept = F.filter(own, lambda x: ~F.exists(F.sequence(a, x["b"]), lambda k: inner(x, k)))
        return F.transform(kept, lambda x: x["run"])

    return rows.select(key, "n_paragraphs", F.concat("_alone", F.flatten(F.transform("_runs", least))).alias("found"))
