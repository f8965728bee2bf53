"""Results whose pairs or copies are many: right, and without sending every pair."""

import hashlib
import os
import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pivotloom.functions import timeops as T
from pivotloom.operators import bindings as B
from pivotloom.operators import containment as K
from pivotloom.operators import results as R
from pivotloom.plans import catalogue
from pivotloom.sources import exports as X
from pivotloom.sources import shared

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def sent(spark, action, what="Records"):
    """What an action gives, and how many rows (or Bytes) its shuffles wrote."""
    sc = spark.sparkContext
    jvm, none = spark._jvm, sc._gateway.new_array(spark._jvm.double, 0)
    empty = jvm.java.util.ArrayList()

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(empty, False, False, none, empty)
        return {(s.stageId(), s.attemptId()): getattr(s, f"shuffleWrite{what}")() for s in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    out = action()
    return out, sum(n for k, n in written().items() if k not in before)


def test_profiles_of_equal_entities_are_not_sent_in_pairs(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 100, raising=False)
    values = spark.range(2000).repartition(4).select(F.col("id").alias("k"), F.explode(F.array(F.struct(F.lit("n").alias("field"), F.lit("5").alias("value")), F.struct(F.lit("c").alias("field"), F.when(F.col("id") % 2 == 0, "red").otherwise("blue").alias("value")))).alias("v")).select("k", "v.*")
    criteria = spark.range(300).select(F.col("id").alias("profile"), F.lit("n").alias("field"), F.lit("range").alias("kind"), F.array().cast("array<string>").alias("allowed"), F.lit(0.0).alias("low"), (F.col("id") % 2 * 9).cast("double").alias("high"))
    got, rows = sent(spark, lambda: K.matching_profiles(values, criteria, "k").agg(F.count(F.lit(1)), F.min("k"), F.max("k"), F.sum(F.col("profile") % 2)).first())
    assert tuple(got) == (300_000, 0, 1999, 300_000)
    assert rows < 50_000  # 15,000 blocks of pairs and the rows; pairs sent at each step were over a million


def test_profiles_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 3, raising=False)
    rng = random.Random(3)
    values = [(k, f, v) for k in range(120) for f in ("n", "c", "other") for v in rng.choices(["1", "2.5", "4", "red", "blue", None], k=rng.choice([0, 1, 1, 1, 2]))] + [(7, None, "red"), (8, "c", "x"), (8, "c", "x")]
    rules = [(p, f, kind, allowed, low, low and low + 2.0) for p in range(25) for f, kind, allowed, low in rng.sample([("n", "range", None, float(rng.randint(0, 4))), ("c", "text", rng.sample(["red", "blue", "4"], 2), None), ("other", "text", ["1", "1", "red"], None)], rng.randint(1, 3))]
    own = defaultdict(lambda: defaultdict(set))
    for k, f, v in values:
        own[k][f].add(v)

    def fits(kind, allowed, low, high, v):
        if kind == "text":
            return v in allowed
        try:
            return low <= float(v) <= high
        except (TypeError, ValueError):
            return False

    by = defaultdict(list)
    for p, *rule in rules:
        by[p].append(rule)
    want = sorted((k, p) for k in own for p in by if all(own[k].get(f) and all(fits(*r, v) for v in own[k][f]) for f, *r in by[p]))
    got = K.matching_profiles(spark.createDataFrame(values, "k int, field string, value string"), spark.createDataFrame(rules, "profile int, field string, kind string, allowed array<string>, low double, high double"), "k")
    assert want and sorted(tuple(r) for r in got.collect()) == want


ODD_NODES = [("a", "A"), ("b", "B"), ("b", "B2"), ("c", "C"), ("c", "C"), ("gone", "G"), ("gone", "H"), ("alone", "X"), ("alone", "Y"), ("p|q", "P"), (None, "N")]
ODD_EDGES = [("a", "b", "r", None, "s"), ("a", "b", "r", None, "s"), ("a", "c", "r", "2020-01-01", "s"), ("a", "c", "r", "2020-01-01", "s"), ("a", "gone", "r", None, "s"), ("a", "none", "r", None, "s"), ("a", "c", None, None, "s"),
             ("a", "c", "r", None, None), ("a", "c", "r|", None, None), ("a|c", "p", "r", None, "s"), ("a", "c|p", "r", None, "s"), ("a", "c", "p|r", None, "s"), (None, "c", "r", None, "s"), ("a", "p|q", "r", None, "s"), ("c", "a", "r", None, "x|y")]


def odd_graph(spark):
    edges = spark.createDataFrame(ODD_EDGES, "src string, dst string, relation string, seen string, source string")
    return spark.createDataFrame(ODD_NODES, "id string, label string"), edges.withColumn("seen", F.col("seen").cast("date"))


def test_faults_of_an_export_equal_those_of_its_objects(spark):
    nodes, edges = odd_graph(spark)
    for lost in ([], ["gone"], ["a", "b", "nowhere"]):
        missing = spark.createDataFrame([(x,) for x in lost], "id string")
        kept = X.to_stix(nodes, edges).join(missing.select(X.stix_id("file", F.col("id")).alias("id")), "id", "left_anti")
        want = sorted(tuple(r) for r in R.identity_faults(kept).collect())
        assert want and sorted(tuple(r) for r in X.stix_faults(nodes, edges, missing).collect()) == want


def test_closure_sends_no_objects(spark):
    got, rows = sent(spark, lambda: catalogue.QUERIES["stix_closure"](spark, SF).collect())
    assert len(got) == 2 and rows < 60_000  # it was 183,566


def test_objects_of_edges_are_made_without_sending_the_edges(spark):
    nodes = spark.createDataFrame([("a", "A")], "id string, label string")
    wide = spark.range(4000).repartition(4).select(F.lit("a").alias("src"), F.lit("a").alias("dst"), F.lit("r").alias("relation"), F.lit(None).cast("date").alias("seen"), F.concat(*[F.sha2(F.concat("id", F.lit(str(i))), 512) for i in range(8)]).alias("source"))
    wide = wide.localCheckpoint()
    wide = wide.unionByName(wide.limit(3))
    n, size = sent(spark, lambda: X.to_stix(nodes, wide).filter(F.length("json") > 0).count(), "Bytes")
    assert n == 1 + 3 * 4000 + 1 and size < 400_000  # their sources alone have 4 MB


@pytest.mark.parametrize("most", [0, 2, 100])
def test_distinct_rows(spark, monkeypatch, most):
    monkeypatch.setattr(shared, "NEAR", most)
    rows = spark.createDataFrame([(i % 7, None if i % 3 else "x") for i in range(40)] + [(99, "y"), (None, "x"), (None, None)], "a int, b string")
    assert sorted(shared.distinct_rows(rows).collect(), key=str) == sorted(rows.distinct().collect(), key=str)
    alone = rows.filter("a = 99")
    assert shared.distinct_rows(alone).collect() == alone.collect()


@pytest.mark.parametrize("own, equal, block", [(128, 64, 4096), (4, 2, 3), (0, 3, 1)])
def test_contained_sets_with_classes_and_rare_members(spark, monkeypatch, own, equal, block):
    for name, n in (("OWN_BITS", own or 1), ("EQUAL", equal), ("BLOCK", block)):
        monkeypatch.setattr(K, name, n, raising=False)
    rng = random.Random(own)
    rows = [(s, rng.choice("abcdefghij") if s % 2 else f"m{rng.randint(0, 25)}") for s in range(150) for _ in range(rng.randint(1, 6))] + [(200, "z"), (201, None), (None, "a"), (202, "z")] + [(s, m) for s in range(300, 320) for m in "xyz"]
    sets = defaultdict(set)
    for s, m in rows:
        if s is not None and m is not None:
            sets[s].add(m)
    want = sorted((a, b, len(sets[a])) for a in sets for b in sets if a != b and sets[a] <= sets[b])
    assert sorted(tuple(r) for r in K.contained_sets(spark.createDataFrame(rows, "s long, m string"), "s", "m").collect()) == want


def test_pairs_of_equal_sets_are_not_sent(spark):
    rows = spark.range(2000).repartition(4).select(F.col("id").alias("s"), F.explode(F.array(*[F.lit(x) for x in "abc"])).alias("m"))
    n, sent_rows = sent(spark, lambda: K.contained_sets(rows, "s", "m").count())
    assert n == 2000 * 1999 and sent_rows < 60_000  # nearly four million pairs


def creatives(spark, refs):
    """Findings of references (capture, input, uri, role, establishment, lo, hi) alone, each capture's own input being its text."""
    refs = spark.createDataFrame(refs, "capture long, input string, uri string, role string, establishment long, lo decimal(20,6), hi decimal(20,6)").repartition(4)
    refs = refs.withColumn("x", T.interval(F.col("lo"), F.col("hi"), True, True)).drop("lo", "hi").localCheckpoint()
    inputs = refs.select("capture", "input").distinct().localCheckpoint()
    none = spark.createDataFrame([], "capture long, input string, request long, establishment long, uri string, stage string, traced boolean, host string, list string, says string").withColumn("x", T.interval(F.lit(0), F.lit(0)))
    requests = none.select("request", "capture", "uri", "stage", "traced")
    links = none.select("capture", "input", "request", "establishment", "x")
    return B.creative_findings(inputs, inputs.limit(0), refs, requests, links, none.select("host", "list", "says"), ["l"], T.query_period("1997-01-01", "1997-12-31"))


def test_findings_of_creatives_are_sent_once(spark):
    refs = [(i, str(i), f"https://h{i}.example.net/", "navigation", i, Decimal(i), Decimal(i)) for i in range(3000)]
    found, size = sent(spark, lambda: creatives(spark, refs).groupBy("status", "control").agg(F.count("finding"), F.min("earliest"), F.sum(F.length("host"))).collect(), "Bytes")
    assert [(r["status"], r["control"], r["count(finding)"]) for r in found] == [("resolved", "unresolved", 3000)]
    assert size < 700_000


def test_earliest_of_creatives(spark):
    wide, far = Decimal("20000000000000.5"), Decimal("30000000000000.5")  # more than 18 digits
    rows = {"one": [(1, 5, 9)], "tie": [(4, 3, 3), (2, 3, 3)], "later": [(1, 0, 4), (2, 4, 6)], "over": [(1, 0, 5), (2, 4, 6)], "open": [(1, 0, None), (2, 5, 6)], "low": [(1, None, 3), (2, 4, 5)], "same": [(1, 0, 3), (1, 0, 9)], "wide": [(1, wide, wide), (2, wide, far)], "none": [(1, None, None)]}
    refs = [(7, name, "urn:x", "navigation", e, *[None if v is None else Decimal(v) for v in ends]) for name, own in rows.items() for e, *ends in own]
    got = {r["input"]: (r["earliest"], r["status"], r["novel"]) for r in creatives(spark, refs).collect()}
    past, un = "no_match", (None, "unresolved", "unresolved")
    assert got == {"one": (1, "resolved", past), "tie": (2, "resolved", past), "later": (1, "resolved", past), "over": un, "open": un, "low": un, "same": (1, "resolved", past), "wide": (1, "resolved", past), "none": un}


def plain_reencoding_faults(ids, rows):
    again = X.evidence_edges(X.decode_evidence(ids, rows))
    columns = ["src", "type", "ordinal", "dst", "payload", "sha256"]
    both = rows.select(*columns, F.lit(1).alias("n")).unionByName(again.select(*columns, F.lit(-1).alias("n"))).groupBy(*columns).agg(F.sum("n").alias("n")).filter("n <> 0")
    return both.select("src", "type", "ordinal", F.when(F.col("n") > 0, "lost").otherwise("added").alias("fault")).distinct()


def test_odd_edges_encoded_again(spark):
    said, time, sha = '{"source_id":"s","field":"f"}', '{"role":"r","object":"o","occurrence":"c"}', lambda t: hashlib.sha256(t.encode()).hexdigest()
    own, whole = '{"id":"x"}', []
    for k, rows in {
        "good": [("SUBJECT", 0, "x", own), ("EVIDENCE", 0, "s", said)], "twice": [("EVIDENCE", 0, "s", said), ("EVIDENCE", 0, "s", said), ("OBJECT", 0, "x", own)], "gap": [("EVIDENCE", 1, "s", said)], "two": [("SUBJECT", 0, "b", own), ("SUBJECT", 0, "a", own)],
        "times": [("TIME_OBJECT", 0, "o", time), ("TIME_OCCURRENCE", 0, "c", time)], "half": [("TIME_OBJECT", 0, "o", time)], "torn": [("EVIDENCE", 0, "s", '{"source_id":'), ("EVIDENCE", 1, "s", said)], "null": [("SUBJECT", 0, None, None), ("EVIDENCE", 0, None, None)],
        "spaced": [("EVIDENCE", 0, "s", said.replace(":", ": "))], "kind": [("OTHER", 0, "x", own), (None, None, "x", own)], "unknown": [("SUBJECT", 0, "x", own)], None: [("SUBJECT", 0, "x", own)],
    }.items():
        whole += [(k, *r, r[3] and sha(r[3])) for r in rows]
    whole += [("digest", "SUBJECT", 0, "x", own, "no"), ("bare", "SUBJECT", 0, "x", own, None)]
    rows = spark.createDataFrame(whole, "src string, type string, ordinal int, dst string, payload string, sha256 string")
    ids = spark.createDataFrame([(k,) for k in {r[0] for r in whole} - {"unknown"} | {"empty"}], "id string")
    want = sorted(plain_reencoding_faults(ids, rows).collect(), key=str)
    assert len(want) > 15 and sorted(X.reencoding_faults(ids, rows).collect(), key=str) == want


def test_edges_encoded_again_are_sent_once(spark):
    said = spark.range(500).repartition(4).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("subject"), F.lit("y").alias("object"), F.expr("transform(sequence(1, 20), i -> named_struct('source_id', string(i * id), 'field', string(i)))").alias("evidence"), F.expr("cast(array() as array<struct<role: string, object: string, occurrence: string>>)").alias("times")).localCheckpoint()
    rows = X.evidence_edges(said).localCheckpoint()
    n, size = sent(spark, lambda: X.reencoding_faults(said.select("id"), rows).count(), "Bytes")
    assert n == 0 and size < 500_000
