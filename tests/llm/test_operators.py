"""Each operator on odd rows, and against brute force, a round trip or held-out labels."""

import base64
import hashlib
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pivotloom.llm import chat_format, imatch, language_id, license_scan, multi_index, packing, sentencepiece_unigram, simhash_dedup, toxicity, url_filter
from pivotloom.llm.common import connected_components, ensure_checkpoint_dir, fold_of, per_class_sample
from pivotloom.llm.queries import TOKENIZERS

SF = "/root/testdata/sf0.01"
#: Columns that clash with names the operators make.
CLASH = "lang string, source string, n_chars long, score double, fp long, key string, v string, fingerprint string, rank int, g int, p int, found string"
LONG = "the quick brown fox jumps over it " * 12_000


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " \t\n ", "12 34 !!", "Hello", LONG, "same words here again", "same words here again", "naïve café 日本語 😀 \u2581 x", "line\n\nAll rights reserved.\nend", "a\\b ### <x> </turn>"]
    rows = [(i, t, *[None] * 12) for i, t in enumerate(texts)]
    rows += [rows[6], (None, "no id", *[None] * 12), (None, None, *[None] * 12)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


def test_odd_rows_keep_their_number(spark, odd, empty):
    model = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"))
    toxic = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    runs = [
        lambda d: license_scan.scan(d),
        lambda d: sentencepiece_unigram.round_trip(d, TOKENIZERS("piece_bpe_32k.model")),
        lambda d: language_id.identify(d, model),
        lambda d: toxicity.score_documents(d, toxic),
        lambda d: simhash_dedup.near_duplicates(d),
        lambda d: imatch.compare_edited(d),
    ]
    n = odd.count()
    for run in runs:
        assert run(odd).count() == n
        assert run(empty).count() == 0
    assert packing.pack_documents(empty, TOKENIZERS("word_bpe_49k.json")).count() == 0


def test_training_without_rows(spark, empty):
    model = language_id.train(empty)
    assert model.predict("some words") == ("und", 0.0, True)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(empty, labels).score("x") < 1e-9


def test_filters_return_the_columns_of_documents(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    kept = language_id.keep_identified(odd, model)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} >= {4, 5, 6}
    toxic = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert toxicity.drop_toxic(odd, toxic).columns == odd.columns
    one = simhash_dedup.keep_one(odd)
    assert one.columns == odd.columns
    ids = [r["doc_id"] for r in one.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 3, 4, 5, 6, 8, 9, 10] and ids.count(None) == 2


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language_id.identify(docs, language_id.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter(fold_of(F.col("doc_id")) == 0)
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    assert found.filter("rejected").count() <= 2


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = toxicity.score_documents(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter(fold_of(F.col("doc_id")) == 0)
    wrong = {r["toxic"]: r["n"] for r in found.filter("predicted <> toxic").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counts = {r["toxic"]: r["n"] for r in found.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    assert wrong.get(0, 0) <= 0.01 * counts[0] and wrong.get(1, 0) <= 0.2 * counts[1]


def test_licence_expression_equals_plain_python(spark, odd):
    model = license_scan.train()
    lines = [t for ts in license_scan.TEMPLATES.values() for t in ts] + license_scan.OTHER_TEXT + ["x", "Foo Licensed under CC BY-NC 4.0. bar"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    for r in license_scan.scan(df, model).collect():
        family, p, sure = model.predict(lines[r["doc_id"]])
        got = r["found"]
        if family == license_scan.UNKNOWN:
            assert not got
        else:
            assert (got[0]["family"], got[0]["confirmed"]) == (family, sure) and abs(got[0]["probability"] - p) < 1e-9
    right = [model.predict(t)[0] == f for f, ts in license_scan.TEMPLATES.items() for t in ts]
    assert sum(right) >= 0.9 * len(right)
    assert not any(model.predict(t)[2] for t in license_scan.OTHER_TEXT)
    assert {r["doc_id"]: [x["family"] for x in r["found"]] for r in license_scan.scan(odd, model).collect()}[9] == ["proprietary"]


WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,""",
    "GPL": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "LGPL": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at""",
}


def test_wrapped_notices_are_confirmed(spark):
    model = license_scan.train()
    rows = []
    for family, notice in WRAPPED.items():
        for width in (None, 40, 25):
            for mark in ("", "# ", " * ", "// "):
                lines = notice.split("\n") if width is None else textwrap.wrap(notice, width)
                rows.append((family, "\r\n".join(f"{mark}{x}" for x in ["Copyright 2020 Some One", "", *lines, "", "int main() { return 0; }"])))
    both = f"{WRAPPED['MIT']}\n{WRAPPED['GPL']}\n{WRAPPED['BSD']}"
    rows += [("BSD,GPL,MIT", both), ("", "the driver lost the license\nafter the second accident\non the road")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    for r in license_scan.scan(df, model).collect():
        found = [x for x in r["found"] if x["confirmed"]]
        assert ",".join(sorted({x["family"] for x in found})) == rows[r["doc_id"]][0], rows[r["doc_id"]]


def test_runs_equal_all_runs_by_brute_force(spark):
    model = license_scan.train()
    texts = [f"x y\n# {a}\n --\n{b}\nend" for a in WRAPPED.values() for b in WRAPPED.values()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in license_scan.scan(df, model).collect():
        lines = [x for x in re.split("[\r\n]+", texts[r["doc_id"]]) if x]
        worded = [i for i, x in enumerate(lines) if license_scan.words_of(x)]
        runs = {(i, j): " ".join(lines[i : j + 1]) for i in worded for j in worded if i <= j}
        sure = {(i, j): f for (i, j), p in runs.items() for f, _, c in [model.predict(p)] if c and (i == j or license_scan.bigrams_of(p) & license_scan.bigrams_of_one_family(f))}
        want = {(i, j, f) for (i, j), f in sure.items() if not any(g == f and i <= a <= b <= j and b - a < j - i for (a, b), g in sure.items())}
        assert {(x["paragraph"], x["last"], x["family"]) for x in r["found"] if x["confirmed"]} == want


def test_unigram_cut_equals_brute_force_and_reads_back():
    c = sentencepiece_unigram.codec(TOKENIZERS("piece_bpe_32k.model"))
    ids_of = {p: i for i, p in enumerate(b.decode("utf-8", "replace").replace(" ", "▁") for b in c.bytes_of) if np.isfinite(c.score[i])}

    def brute(word):
        best = [(0.0, [])] + [(-1e18, None)] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - 20), j):
                p = word[i:j]
                own = (best[i][0] + c.score[ids_of[p]], [ids_of[p]]) if p in ids_of else (best[i][0] + c.fallback, c._bytes(p)) if j - i == 1 else None
                if own and own[0] > best[j][0]:
                    best[j] = (own[0], best[i][1] + own[1])
        return best[-1][1]

    words = ["▁" + w for w in "The thandin ofthe ereneaed naïve x*** idiot" .split()] + ["▁日本語テキスト", "▁" + "ab" * 40, "▁😀z", "\n", "▁a\ud800b"]
    assert c.cut(words * 4) == [brute(w) for w in words] * 4
    assert [c._cut_one(w) for w in words] == [brute(w) for w in words]
    for t in ["▁ literal", "  two  spaces ", "\n\nline\n", " ", "", "tab\tx\r\n", "日本語 😀", LONG]:
        assert c.decode(c.encode([t])[0]) == t


def test_nearest_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 8)).astype(np.float32)
    x[600:1000] = x[600]  # one vector for a third of the rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] * 8), (2004, [1.0]), (None, [1.0] * 8)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = multi_index.search(df, cells=8, share=0.5, least=50, chunk=64).toPandas()
    hit = total = 0
    for q in range(0, 1200, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1200), d))[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 10 and list(mine["rank"]) == list(range(1, 11))
        assert np.allclose(d[mine.vec_id], mine.score, rtol=1e-12, atol=0)
        hit, total = hit + len(set(want) & set(mine.vec_id)), total + 10
    assert hit / total >= 0.9
    assert list(got[got.query_id == 600].sort_values("rank").vec_id) == list(range(601, 611))
    assert multi_index.search(df.filter("false")).count() == 0
    full = multi_index.search(df.filter("vec_id < 6 or vec_id = 100"), every=100).toPandas()
    assert len(full[full.query_id == 0]) == 6


@pytest.mark.parametrize("norm", [1e5, 1e160, 1e-170])
def test_nearest_neighbours_are_exact_at_any_norm(spark, norm):
    rng = np.random.default_rng(6)
    near = rng.normal(size=8) + 1e-4 * rng.normal(size=(300, 8))
    x = norm * np.concatenate([near / np.linalg.norm(near, axis=1, keepdims=True), rng.normal(size=(50, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = multi_index.search(df, cells=4, share=1.0).toPandas()
    for q in range(0, 350, 100):
        d = np.sqrt((((x - x[q]) / norm) ** 2).sum(1))
        d[q] = np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine.vec_id) == list(np.lexsort((np.arange(350), d))[:10]) and np.allclose(mine.score / norm, np.sort(d)[:10], rtol=1e-9)


def test_nearest_neighbours_by_default_on_the_given_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    clash = e.selectExpr("*", "1 as id", "'x' as v", "2 as rep", "3 as g", "4 as q", "5 as i", "6 as score", "7 as rank")
    got = {q: set(v.vec_id) for q, v in multi_index.search(clash).toPandas().groupby("query_id")}
    d = e.toPandas().sort_values("vec_id")
    ids, x = d.vec_id.to_numpy(), np.array(d.embedding.tolist(), float)
    hit = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((x - x[i]) ** 2).sum(1))
        far[i] = np.inf
        want = set(ids[np.lexsort((ids, far))[:10]])
        hit, total = hit + len(want & got[ids[i]]), total + 10
    assert hit >= 0.9 * total


def test_an_id_with_two_vectors_stands_for_the_smaller(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [5.0, 0.0]), (2, [2.0, 0.0]), (100, [3.0, 0.0]), (100, [0.5, 0.0])]
    got = multi_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert got[got.query_id == 0].sort_values("rank").vec_id.tolist() == [1, 100, 2]
    assert got[got.query_id == 100].sort_values("rank").vec_id.tolist() == [0, 1, 2]


def test_url_parts_rules_and_classifier(spark):
    urls = [None, "no scheme", "HTTP://A.Ads-Track.Example.COM:80?x", "x://H.net/de/8#a/b", "a://", "https://m.example.net/de/81?u", "s://example.com/en/7", "s://notexample.com/en/7"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    model = url_filter.train()
    got = {r["page_id"]: r for r in url_filter.judge(df, model).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(8)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("a.ads-track.example.com:80", "", None, "block"), ("h.net", "/de/8", "net/de/", "allow"), ("", "", None, "allow"),
        ("m.example.net", "/de/81", "example.net/de/8", "block"), ("example.com", "/en/7", "example.com/en/7", "allow"), ("notexample.com", "/en/7", "com/en/", "block")]
    for r in got.values():
        assert abs(r["probability"] - model.probability(r["host"], r["path"])) < 1e-12
    assert all((model.probability(h, p) >= 0.5) == bool(y) for y, h, p in url_filter.LABELLED)
    assert url_filter.judge(df.filter("false"), model).count() == 0


@pytest.mark.parametrize("crowd", [256, 6])
def test_simhash_classes_equal_brute_force(spark, crowd):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63 - 1, size=60, dtype=np.int64)
    fps = [int(b) for b in base] + [int(base[5])] * 30 + [0, 0]
    for b, n in [(base[0], 40), *((b, 2) for b in base[1:20])]:
        for _ in range(n):
            x = int(b) & (2**64 - 1)
            for i in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(i)
            fps.append(simhash_dedup._signed(x))
    marks = spark.createDataFrame(list(enumerate(fps)), "key long, fp long")
    u = np.array(fps, np.int64).view(np.uint64)
    near, label = np.bitwise_count(u[:, None] ^ u[None, :]) <= 3, np.arange(len(u))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    got = {r["key"]: r["component"] for r in simhash_dedup.classes(marks, crowd).collect()}
    assert [got[i] for i in range(len(u))] == label.tolist()


def test_simhash_fingerprint_is_the_majority_of_spark_hashes(spark):
    text = "The Cat sat ON the mat  the cat\tsat on"
    w = text.lower().split()
    h = [r[0] for r in spark.createDataFrame([(" ".join(w[i : i + 3]),) for i in range(len(w) - 2)], "s string").select(F.xxhash64("s")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash_dedup.fingerprint(text) & (2**64 - 1) == want
    assert simhash_dedup.fingerprint("Two WORDS") == simhash_dedup._signed(int(simhash_dedup.xxhash.xxh64_intdigest(b"two words", 42)))
    assert simhash_dedup.fingerprint(LONG) == simhash_dedup.fingerprint(LONG.upper())


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 160)}}


def test_class_sample_is_bounded(spark):
    df = spark.range(5000).selectExpr("id as k", "if(id % 10 = 0, 1, 0) as y")
    assert {r["y"]: r["count"] for r in per_class_sample(df, "y", "k", 50).groupBy("y").count().collect()} == {0: 50, 1: 50}
    same = df.unionByName(spark.range(600).selectExpr("3L as k", "0 as y"))
    assert per_class_sample(same, "y", "k", 50).groupBy("k").count().agg(F.max("count")).first()[0] == 1


def test_packing_is_whole_and_equal_to_direct_encoding(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZERS("word_bpe_49k.json"))
    more = spark.createDataFrame([(100, "don't It's ΣΑΣ. İx ﬁne. <|endoftext|>y z\u00a0w ÉCOLE!!! o'clock'll")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    got = packing.pack_documents(docs, TOKENIZERS("word_bpe_49k.json"), group_rows=5).toPandas()
    for r in docs.filter("doc_id is not null").distinct().collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        own = got[got.doc_id == r["doc_id"]].drop_duplicates(["doc_id", "start"]).sort_values("start")
        assert own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        for p in own.itertuples():
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    placed = got.sort_values(["sequence_id", "offset"])
    assert ((placed.groupby("sequence_id").length.cumsum() - placed.length) == placed.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 2048


def test_word_encoder_equals_whole_texts(spark):
    coder = packing.WordEncoder(TOKENIZERS("word_bpe_49k.json"))
    assert coder.by_words and not packing.WordEncoder(TOKENIZERS("byte_bpe_50k.json")).by_words
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = np.random.default_rng(2)
    places = list("aB é'.,!#\u0301²٣Ⅷ_<|— \n日ß9sÀ…´`^")
    texts += ["".join(rng.choice(places, rng.integers(1, 9))) for _ in range(5000)] + ["a<|endoftext|>B", "<|ENDOFTEXT|>", "x" * 300_000]
    assert all(np.array_equal(a, b) for a, b in zip(coder.encode(texts), coder.whole(texts)))


def test_word_tables_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 20_000)
    coder = packing.WordEncoder(TOKENIZERS("word_bpe_49k.json"))
    for i in range(30):
        texts = [" ".join(f"w{chr(97 + (i * j) % 26)}{j}" for j in range(50)), "y" * 5000]
        assert all(np.array_equal(a, b) for a, b in zip(coder.encode(texts), coder.whole(texts)))
        assert coder.held <= 20_000 + 2 * 5000 + 52 * 300


def test_packing_deals_equal_rows_to_many_groups(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two").alias("text"))
    got = packing.pack_documents(docs, TOKENIZERS("word_bpe_49k.json"), group_rows=100).toPandas()
    assert len(got) == 3000 and (got.sequence_id // (1 << 32)).value_counts().max() < 200


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(5)
    lengths = np.sort(rng.integers(1, 65, 400))[::-1]
    number, offset = packing.best_fit(lengths, 64)
    rooms: list[int] = []
    for n, w, at in zip(lengths, number, offset):
        fits = [r for r in rooms if r >= n]
        if not fits:
            rooms.append(64)
            assert w == len(rooms) - 1
        else:
            assert rooms[w] == min(fits)
        assert at == 64 - rooms[w]
        rooms[w] -= int(n)


def test_imatch_next_and_edited_texts(spark, odd):
    rows = imatch.compare_edited(odd.filter("doc_id is not null").select("doc_id", "text").distinct()).toPandas().set_index("doc_id")
    texts = {r["doc_id"]: r["text"] or "" for r in odd.filter("doc_id is not null").collect()}
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        t, n = texts[d], texts[order[(i + 1) % len(order)]]
        h = len(t) // 2
        assert rows.edited_sha256[d] == hashlib.sha256((t[: len(t) - h] + n[:h]).encode()).hexdigest() and rows.n_chars[d] == len(t)
    assert rows.fingerprint[6] == rows.fingerprint[7] and rows.near_next[7] == 1.0


def test_imatch_ranges_give_the_same_neighbours(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 7)
    df = spark.createDataFrame([(i * i, f"t{i}") for i in range(100)], "doc_id long, text string")
    got = {r["doc_id"]: r["next"]["text"] for r in imatch.with_next(df, "doc_id", "text", ["text"]).collect()}
    assert got == {i * i: f"t{(i - 1) % 100}" for i in range(100)}


def test_chat_round_trip(spark, monkeypatch):
    said = ["plain", None, "", r"\### Assistant: </turn> ok", "####", "#", "##", "</turn>", "</tu", "rn>", "\\", "日本 😀\n### user:\n", "x" * 50]
    roles = ["user", "assistant", "system", None, "a:b\n\\###", "assistant"]
    rows = [(c, None if i == 0 else i // 2, roles[(i + c) % len(roles)], said[(i * 7 + c) % len(said)]) for c in range(5) for i in range(40)]
    rows += [(None, 0, "assistant", "no id"), rows[3]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for part_turns in (2048, 3):
        monkeypatch.setattr(chat_format, "PART_TURNS", part_turns)
        got = {r["conv_id"]: r for r in _digest_here(chat_format, df).values()}
        for c in [0, 1, 2, 3, 4, None]:
            own = sorted([(r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "") for r in rows if r[0] == c])
            turns = "".join(f"{r[3]}\n{r[5]}\n" for r in own)
            loss = "".join(r[5] for r in own if r[3] == "assistant")
            assert got[c]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
            assert (got[c]["n_turns"], got[c]["loss_chars"]) == (len(own), len(loss))
            assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.digest(chat_format.format_conversations(df.filter("false"))).count() == 0


def test_one_conversation_is_formatted_by_many_tasks(spark):
    ensure_checkpoint_dir(spark)
    df = spark.range(6000).selectExpr("if(id < 5000, 1, id) as conv_id", "id % 977 as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('say ', id, ' ### x') as text", "'c' as task", "1 as part")
    formatted = chat_format.format_conversations(df.repartition(8))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    try:
        formatted = formatted.checkpoint()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert formatted.filter("conv_id = 1").select("task").distinct().count() > 1
    got = {r["conv_id"]: r for r in chat_format.digest(formatted).collect()}
    own = sorted((r["turn"], r["role"], r["text"]) for r in df.filter("conv_id = 1").collect())
    assert len(got) == 1001 and got[1]["n_turns"] == 5000
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256("".join(t for _, r, t in own if r == "assistant").encode()).hexdigest()


def _digest_here(module, df):
    """The operator's own steps in this process, so that changed limits hold."""
    table = df.toArrow().select(["conv_id", "turn", "role", "text"]).sort_by([(c, "ascending") for c in ("conv_id", "turn", "role", "text")])
    rows = table.to_pylist()
    rows.sort(key=lambda r: tuple((r[c] is not None, r[c] if r[c] is not None else 0) for c in ("conv_id", "turn")) + tuple((r[c] is not None, r[c] or "") for c in ("role", "text")))
    import pyarrow as pa

    ordered = pa.Table.from_pylist(rows, schema=table.schema).drop(["turn"])
    out = [r for b in module.digest_stream(module.format_stream(iter(ordered.to_batches(max_chunksize=17)))) for r in b.to_pylist()]
    return {r["conv_id"]: r for r in out}


def test_language_rejects_what_it_has_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language_id.train(docs)
    held = [r["text"] for r in docs.filter((fold_of(F.col("doc_id")) == 0) & (F.length("text") >= 20)).select("text").collect()]
    rng = np.random.default_rng(3)
    letters = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), 600)) for _ in range(200)]
    coded = [base64.b64encode(rng.bytes(450)).decode() for _ in range(200)]
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa."
    turkish = "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler."
    share = lambda texts: sum(model.predict(t)[2] for t in texts) / len(texts)
    print("rejected: held out", share(held), len(held), "letters", share(letters), "base64", share(coded), model.predict(polish), model.predict(turkish), model.limits)
    assert share(held) <= 0.005
    assert share(letters) >= 0.95 and share(coded) >= 0.95
    assert model.predict(polish)[2] and model.predict(turkish)[2]
