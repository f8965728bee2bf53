"""Ids beyond 2^53 beside null ids, texts full of notices, hot ids: results of each stay whole."""

import re
import textwrap

import pytest
from pyspark.sql import functions as F

from pivotloom.llm import imatch, language_id, license_scan, line_dedup, packing, sentencepiece_unigram, simhash_dedup, spelling_groups, toxicity, url_filter
from pivotloom.llm.queries import TOKENIZERS

BIG = (1 << 60) + 1
IDS = [BIG, None, BIG + 2, None, -BIG]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def big(spark):
    """One partition, so that null and large ids share every batch and group."""
    return spark.createDataFrame([(i, f"some words of text number {n}, enough of them") for n, i in enumerate(IDS)], "doc_id long, text string").coalesce(1)


def ids(df, name="doc_id"):
    return sorted((r[name] for r in df.select(name).collect()), key=repr)


def test_large_ids_beside_null_ids_keep_their_digits(spark, big):
    want = sorted(IDS, key=repr)
    pieces = TOKENIZERS("piece_bpe_32k.model")
    assert ids(sentencepiece_unigram.round_trip(big, pieces)) == want
    assert ids(packing.pack_documents(big, TOKENIZERS("word_bpe_49k.json"))) == want
    assert ids(imatch.compare_edited(big)) == want
    assert ids(line_dedup.dedup(big, line_dedup.build(big))) == want
    assert ids(license_scan.scan(big)) == want
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert ids(language_id.identify(big, language_id.train(docs))) == want
    assert ids(toxicity.score_documents(big, toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet")))) == want
    assert ids(simhash_dedup.near_duplicates(big).withColumnRenamed("key", "doc_id")) == want
    assert ids(url_filter.judge(big.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b/c").alias("url"))), "page_id") == want
    assert {r["word"]: r["n"] for r in spelling_groups.words(big).collect()} == {}


def test_packed_ids_stand_beside_their_own_pieces(spark):
    rows = [(i, f"word {n} " * (n + 1)) for n, i in enumerate([BIG, None, BIG + 2, None, 3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    path = TOKENIZERS("word_bpe_49k.json")
    want = {r["doc_id"]: r["ids_crc32"] for r in packing.cut(docs, path).collect() if r["doc_id"] is not None}
    got = {r["doc_id"]: r["ids_crc32"] for r in packing.pack_documents(docs, path).collect() if r["doc_id"] is not None}
    assert got == want and set(got) == {BIG, BIG + 2, 3}


def test_a_text_of_very_many_notices(spark):
    """Every wrapped notice of twenty thousand lines is found once, in time that follows their number."""
    notice = max(license_scan.TEMPLATES["Apache-2.0"], key=len)
    lines = textwrap.wrap(notice, 60)
    n = 20_000 // len(lines)
    docs = spark.createDataFrame([(1, "\n".join(lines * n))], "doc_id long, text string")
    found = license_scan.scan(docs).first()["found"]
    sure = {(x["paragraph"], x["last"]) for x in found if x["confirmed"]}
    few = license_scan.scan(spark.createDataFrame([(1, "\n".join(lines * 3))], "doc_id long, text string")).first()["found"]
    own = {(x["paragraph"] % len(lines), x["last"] - x["paragraph"]) for x in few if x["confirmed"]}
    assert {(a % len(lines), b - a) for a, b in sure} == own
    assert len(sure) >= n


@pytest.mark.parametrize("rows", [7, 10_000])
def test_neighbours_of_hot_ids_and_copies(spark, monkeypatch, rows):
    """A third of all rows share an id, another the whole row; each has the next row of one order."""
    monkeypatch.setattr(imatch, "RANGE_ROWS", rows)
    data = [(5, f"shared id {i}") for i in range(30)] + [(9, "a copy")] * 30 + [(i, f"own {i}") for i in range(100, 130)] + [(None, f"null {i}") for i in range(9)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = [(r["doc_id"], r["text"], r["next"]["text"]) for r in imatch.with_next(docs, "doc_id", "text", ["text"]).collect()]
    h = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(data, key=lambda r: (-(1 << 63) if r[0] is None else r[0], h[r[1]]), reverse=True)
    want = [(*r, order[(i + 1) % len(order)][1]) for i, r in enumerate(order)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_given_hosts_are_no_training_rows(spark):
    urls = [r["url"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url").collect() if r["url"]]
    hosts = {re.sub(r"^[^:]*://(?:www\.|m\.|blog\.)?([^/?#]*).*", r"\1", u).lower() for u in urls}
    trained = {re.sub(r"^(?:www|m|blog)\.", "", host) for _, host, _ in url_filter.LABELLED}
    assert not hosts & trained
    assert url_filter.train().intercept < 0
