"""The trained text operators against plain re-counts, and at odd places."""

import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pivotloom.llm import language_id, license_scan, toxicity, url_filter

SF = "/root/testdata/sf0.01"
M = 0xFFFFFFFF


def plain_language_grams(text):
    c = [0, *(ord(x) if x.isalpha() else 0 for x in text.lower()), 0]
    pair = [(a * 0x9E3779B1 & M) ^ (b * 0x85EBCA77 & M) for a, b in zip(c, c[1:])]
    out = Counter()
    for i in range(len(c)):
        if c[i]:
            out[(c[i] * 0x165667B1 & M) >> 18] += 1
        if i + 1 < len(c) and (c[i] or c[i + 1]):
            out[(pair[i] * 0x2545F491 & M) >> 18] += 1
        if i + 2 < len(c) and c[i + 1]:
            out[(((pair[i] * 0xC2B2AE3D & M) ^ (c[i + 2] * 0x27D4EB2F & M)) * 0x68E31DA4 & M) >> 18] += 1
    return out


def smallest(rows, n):
    """Rows of the n smallest hashed ids, as Spark's xxhash64 has them."""
    place = lambda k: xxhash.xxh64_intdigest(struct.pack("<q", k), 42) % (1 << 40)
    return sorted(rows, key=lambda r: (place(r["doc_id"]), r["doc_id"]))[:n]


def fold(k):
    return zlib.crc32(str(k).encode()) % 5


def test_language_vectors_and_cosines_by_plain_counts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model, docs = language_id.train(rows), rows.collect()
    chosen = [r for l in {r["lang"] for r in docs if r["lang"]} for r in smallest([r for r in docs if r["lang"] == l and fold(r["doc_id"])], language_id.TRAIN_ROWS)]
    fit = [r for r in chosen if r["text"] and zlib.crc32(r["text"].encode()) % 5 and any(x.isalpha() for x in r["text"])]
    df = Counter(h for r in fit for h in plain_language_grams(r["text"]))
    idf = [math.log((len(fit) + 1) / (df[h] + 1)) + 1 for h in range(1 << language_id.BITS)]
    assert np.allclose(model.idf, idf, rtol=1e-5)
    assert np.allclose(np.linalg.norm(model.centroids, axis=0), 1, atol=1e-5) and Counter(model.languages) == {l: 3 for l in set(model.languages)}
    for r in docs[:150]:
        counts = plain_language_grams(r["text"] or "")
        value = {h: (1 + math.log(n)) * idf[h] for h, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in value.values()))
        cosines = [sum(v / norm * float(model.centroids[h, j]) for h, v in value.items()) for j in range(len(model.languages))]
        lang, score, _ = model.predict(r["text"])
        assert abs(max(cosines) - score) < 1e-4
        assert any(model.languages[j] == lang for j, x in enumerate(cosines) if x > max(cosines) - 1e-6)


def test_centroids_are_means_of_their_nearest():
    rng = np.random.default_rng(1)
    centres = np.eye(6)[:3]
    x = np.concatenate([c + 0.05 * rng.normal(size=(40, 6)) for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = language_id.cluster(x, 3)
    near = (x @ c.T).argmax(1)
    for j in range(3):
        mean = x[near == j].mean(0)
        assert np.allclose(c[j], mean / np.linalg.norm(mean))
    assert sorted(Counter(near.tolist()).values()) == [40, 40, 40]


def test_a_tie_of_languages_goes_to_the_first_name():
    model = language_id.LanguageModel(np.ones(1 << language_id.BITS, np.float32), np.ones((1 << language_id.BITS, 2), np.float32), ["a", "b"], [])
    assert model.predict("word")[0] == "a"


def plain_toxicity_grams(text):
    c, out = [0], set()
    for x in text.lower():
        p = ord(x) if x.isalpha() else 0
        if p or c[-1]:
            c.append(p)
    if c[-1]:
        c.append(0)
    h = [p * 0x9E3779B1 & M for p in c]
    for n in range(2, 6):
        if len(c) < n:
            break
        h = [(((v ^ (v >> 15)) * 0x85EBCA77) + c[i + n - 1] * 0xC2B2AE3D) & M for i, v in enumerate(h[: len(c) - n + 1])]
        if n >= 3:
            out |= {(v * 0x27D4EB2F & M) >> (32 - toxicity.BITS) for v in h}
    return out


def test_toxicity_features_ratios_and_fit_by_plain_counts(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    seen = {}
    own = toxicity.fit_logistic
    monkeypatch.setattr(toxicity, "fit_logistic", lambda x, y, *a: seen.update(x=x, y=y, fit=own(x, y, *a)) or seen["fit"])
    model = toxicity.train(docs, labels)
    text = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    marked = [r for r in labels.collect() if r["toxic"] in (0, 1) and fold(r["doc_id"]) and r["doc_id"] in text]
    assert len(marked) < toxicity.TRAIN_ROWS
    sets = {r["doc_id"]: plain_toxicity_grams(text[r["doc_id"]]) for r in marked}
    count = [Counter(h for r in marked if r["toxic"] == y for h in sets[r["doc_id"]]) for y in (0, 1)]
    rows = [sum(r["toxic"] == y for r in marked) for y in (0, 1)]
    kept = np.flatnonzero(model.slot)
    p = np.array([[(count[y][h] + 1) / (rows[y] + 2) for h in kept] for y in (0, 1)])
    ratio = np.log(p[1] / p[0])
    x = np.array([[h in sets[r["doc_id"]] for h in kept] for r in sorted(marked, key=lambda r: (r["doc_id"], r["toxic"]))], float) * ratio
    assert np.allclose(seen["x"], x, atol=1e-4)
    w, b = seen["fit"]
    y = seen["y"]
    assert np.allclose(model.weights[1:], w * ratio, atol=1e-4)
    gradient = x.T @ (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y) + 2e-4 * w
    assert np.abs(gradient).max() < 2e-2
    for d in list(text)[:120]:
        z = model.intercept + sum(model.weights[model.slot[h]] for h in plain_toxicity_grams(text[d]) if model.slot[h])
        assert abs(1 / (1 + math.exp(-z)) - model.score(text[d])) < 1e-5


# Notices in other words than the templates', and relatives of no learned family.
OTHER_NOTICES = {
    "AGPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    "CC-BY-SA-4.0": "This document is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person who obtains a copy of this software and associated documentation files (the Software), to deal in it.",
    "GPL": "This file is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
}
NO_LICENCE = [
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under the European Union Public Licence, version 1.2 only.",
    "The terms of the public licence were read aloud by the clerk of the town.", "Redistribution of the seats took place before the vote, with or without a delay.",
]


def test_licences_in_other_words_and_their_relatives():
    model = license_scan.train()
    for family, notice in OTHER_NOTICES.items():
        assert model.predict(notice)[::2] == (family, True), (family, model.predict(notice))
    for text in NO_LICENCE:
        assert not model.predict(text)[2], (text, model.predict(text))


def test_long_urls_and_clashing_columns(spark):
    long = "http://a.example.com/" + "x" * 200_000
    df = spark.createDataFrame([(1, long, "h", "p", "r", "v", 0.5)], "page_id long, url string, host string, path string, rule string, verdict string, probability double")
    r = url_filter.judge(df).first()
    assert (r["host"], len(r["path"])) == ("a.example.com", 200_001)


def test_url_words_that_training_has_not_seen():
    """Trained without rows that share a host word with the row that is judged."""
    words = lambda host: set(re.split("[.-]", host)) - {"example", "com", "net", "org", "www", "m", "blog"}
    right = {0: [], 1: []}
    for y, host, path in url_filter.LABELLED:
        model = url_filter.train([r for r in url_filter.LABELLED if not words(r[1]) & words(host)], rounds=300)
        right[y].append((model.probability(host, path) >= 0.5) == bool(y))
    print("unseen host words: kept", np.mean(right[0]), "blocked", np.mean(right[1]))
    assert np.mean(right[0]) >= 0.8 and np.mean(right[1]) >= 0.35
