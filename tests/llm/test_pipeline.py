"""The pipeline's stages on whole small tables, and on odd rows."""

import time

import numpy as np
import pytest

import corpus_pipeline
from pivotloom.llm import language_id, shingle_links, simhash_dedup, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_against_their_operators(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "toxicity", "near_duplicates", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs)
        assert name == "packing" or docs.columns == columns
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").distinct().collect()}

    before, after = kept["language"]
    model = language_id.train(before)
    assert ids(after) == {r["doc_id"] for r in before.collect() if not model.predict(r["text"])[2]}

    before, after = kept["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == {r["doc_id"] for r in before.collect() if model.score(r["text"]) < 0.5}

    before, after = kept["near_duplicates"]
    rows = sorted((r["doc_id"], simhash_dedup.fingerprint(r["text"]), shingle_links.shingles(r["text"])) for r in before.collect())
    root = {d: d for d, _, _ in rows}
    near = [(a, b) for i, (a, fa, sa) in enumerate(rows) for b, fb, sb in rows[i + 1 :]
            if ((fa ^ fb) & (2**64 - 1)).bit_count() <= 3 or len(sa) and len(sb) and shingle_links.jaccard(sa, sb) >= 0.8]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert ids(after) == {d for d in root if root[d] == d}

    before, after = kept["packing"]
    assert ids(after) == ids(before)


def test_run_gives_pieces(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_near_copies_by_five_words_are_dropped(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = {r["doc_id"]: set(shingle_links.shingles(r["text"]).tolist()) for r in rows}
    holders = {}
    for d, own in sets.items():
        for g in own:
            holders.setdefault(g, []).append(d)
    met = {(a, b) for v in holders.values() for a in v for b in v if a < b}
    near = [(a, b) for a, b in met if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, None).select("doc_id").collect()}
    assert near and not any(a in kept and b in kept for a, b in near)


def test_large_group_of_near_copies_leaves_one(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join([*words[: 7 * i], f"x{i}", *words[7 * i + 1 :]]) for i in range(57)]
    texts += ["", "a b", None, *(" ".join(f"o{i}x{j}" for j in range(60)) for i in range(5))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, None).collect()}
    assert kept == {0, 57, 58, *range(60, 65)}


CLASH = "doc_id long, text string, key string, fp string, root long, id int, band int, low int, _key_ int, p string, score double, lang string, k int, l string, t string, y int"


@pytest.fixture(scope="module")
def odd(spark):
    clean = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(60).collect()
    own = [" ".join(f"{w}{i}" for w in "one two three four five six seven eight nine ten".split()) for i in range(4)]
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in clean]
    rows += [(None, None, None), (None, "no id", "en"), (7001, None, None), (7002, "", None), (7003, " \t\n", None), (7004, "x", None), (7005, "the word " * 60_000, None)]
    rows += [(8001, own[0], None), (8002, own[0], None), (8002, own[1], None), (8003, own[2], None), (8003, own[2], None), (8004, own[3], None)]
    return spark.createDataFrame([(i, t, *["x", "y", 1, 2, 3, 4, 5, "z", 0.5], lang, 6, "q", "r", 7) for i, t, lang in rows], CLASH)


def texts(df):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in df.select("doc_id", "text").collect())


def test_stages_on_odd_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert stage(spark, odd.filter("false"), SF).count() == 0
        if name != "packing":
            assert out.columns == odd.columns
            assert not set(texts(out)) - set(texts(odd))
    packed = corpus_pipeline.packing_stage(spark, odd, SF)
    assert packed.filter("start = 0").count() == odd.count()


def test_language_stage_drops_what_it_has_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(4)
    alien = ["Все люди рождаются свободными и равными в своем достоинстве и правах. " * 5, "すべての人間は、生まれながらにして自由であり、" * 10, "1234 !!", None]
    alien += ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz   "), 800)) for _ in range(20)]
    more = spark.createDataFrame([(90_000 + i, t) for i, t in enumerate(alien)], "doc_id long, text string")
    both = docs.unionByName(more, allowMissingColumns=True)
    kept = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, both, None).select("doc_id").collect()}
    assert not any(i >= 90_000 for i in kept)
    short = docs.filter("length(text) >= 20 and lang is not null")
    assert short.filter(~short["doc_id"].isin(list(kept))).count() <= 0.005 * short.count()


def test_near_duplicate_stage_judges_rows_by_their_own_text(spark, odd):
    kept = [(k, t) for some, k, t in texts(corpus_pipeline.near_duplicate_stage(spark, odd, SF)) if some and k >= 7000]
    own = [" ".join(f"{w}{i}" for w in "one two three four five six seven eight nine ten".split()) for i in range(4)]
    assert [x for x in kept if x[0] >= 8000] == [(8001, own[0]), (8002, own[1]), (8003, own[2]), (8004, own[3])]
    assert {k for k, _ in kept if k < 8000} == {7001, 7004, 7005}


def test_keep_one_keeps_a_unique_text_whose_id_repeats(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "quite other words stand here now", "third text of its own making here")
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, c), (3, c), (None, a)], "doc_id long, text string")
    assert texts(simhash_dedup.keep_one(docs)) == [(False, 0, a), (True, 1, a), (True, 2, b), (True, 3, c)]


def test_crowded_bands_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(shingle_links, "MEET", 1)  # parts only spare work, so their size changes no result
    rng = np.random.default_rng(3)
    texts = []
    for g in range(6):
        for i in range(122):
            words = [f"w{g}x{k}" for k in range(150)]
            for at in rng.choice(30, 4 if i > 1 else 1 + i, replace=False):
                words[5 * at + 2] = f"e{g}x{i}x{at}"
            texts.append(" ".join(words))
    sets = [shingle_links.shingles(t) for t in texts]
    bands = [shingle_links.band_hashes(s) for s in sets]
    fps = [simhash_dedup.fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    near = [(a, b) for a in root for b in range(a + 1, len(texts))
            if ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 3 or (bands[a] == bands[b]).any() and shingle_links.jaccard(sets[a], sets[b]) >= 0.8]
    for _ in root:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, None).select("doc_id").collect()}
    assert near and kept == {d for d, r in enumerate(root) if d == r}


def test_bitmaps_bound_the_difference_of_sets():
    rng = np.random.default_rng(5)
    for n in (1, 31, 32, 33, 300, 40_000):
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: n * 9 // 10], rng.integers(0, 1 << 64, n // 4, dtype=np.uint64))))
        x, y = sorted((shingle_links.bitmap(a), shingle_links.bitmap(b)), key=len)
        y = y if len(x) == len(y) else y[: len(x)] ^ y[len(x) :]
        assert len(x) == len(y) and len(x) <= shingle_links.MOST_LONGS
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def test_near_duplicate_stage_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: disk.getAllFiles().mkString("\n").count("/shuffle_")
    rows = [(i, " ".join(f"a{i // 2}b{j}" for j in range(40)) + f" {i}") for i in range(40)]
    before = shuffled()
    out = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), None)
    assert out.count() == 20
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.2)
    assert shuffled() <= before
