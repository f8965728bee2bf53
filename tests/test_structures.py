"""Interval nodes, cycles, segmented scans, digest trees, containment, blocks: against brute force, with hot keys."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pivotloom.functions import dyadic as N
from pivotloom.functions import status as S
from pivotloom.functions import timeops as T
from pivotloom.operators import claims as G
from pivotloom.operators import containment as K
from pivotloom.operators import cycles as C
from pivotloom.operators import documents as D
from pivotloom.operators import evidence as E
from pivotloom.operators import inquiries as Q
from pivotloom.operators import merkle as M
from pivotloom.operators import pivot as P
from pivotloom.operators import results as R
from pivotloom.sources import exports as X

SF = "/root/testdata/sf0.001"


def test_ranges_stand_in_few_nodes(spark):
    rng = random.Random(5)
    ranges = [(0, 0), (-1, 0), (-5, 9), (7, 7), (3, 2), (None, 1)] + [(a, a + rng.randrange(200)) for a in (rng.randrange(-300, 300) for _ in range(60))] + [(-(1 << 40), (1 << 40) + 3)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ranges)], "i int, lo long, hi long")
    nodes = defaultdict(list)
    for r in N.with_nodes(df, F.col("lo"), F.col("hi")).collect():
        nodes[r["i"]].append((r["node"] << r["level"], (r["node"] + 1 << r["level"]) - 1))
    for i, (lo, hi) in enumerate(ranges):
        held = sorted(nodes.get(i, []))
        assert bool(held) == (lo is not None and lo <= hi) and len(held) <= 4
        if held:
            assert held[0][0] <= lo and held[-1][1] >= hi and all(x[1] + 1 == y[0] for x, y in zip(held, held[1:]))
    points = N.with_ancestors(df.filter("i = 2"), F.col("lo"), [0, 3]).select("level", "node").collect()
    assert sorted(tuple(r) for r in points) == [(0, -5), (3, -1)]
    assert N.with_ancestors(df, F.col("lo"), []).count() == 0


def test_very_long_intervals_beside_short_ones(spark):
    """Two hundred years in leaves of a second, beside seconds; ends in and out; a key with a third of all rows."""
    rng = random.Random(2)
    rows = []
    for i in range(400):
        lo, n = rng.randrange(0, 3000), rng.choice([0, 1, 1, 5, 200 * 366 * 86_400])
        rows.append((rng.choice(["hot", "a", "b"]), i, lo, lo + n, rng.random() < 0.5 or n == 0, rng.random() < 0.5 or n == 0))
    df = spark.createDataFrame(rows + [("hot", 999, None, 5, True, True)], "k string, i long, a long, b long, c boolean, d boolean")
    got = sorted((r["k"], r["a"], r["b"]) for r in T.overlaps(df.select("k", "i", T.interval(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("x")), "k", "i", "x", 1).collect())
    apart = lambda x, y: x[3] < y[2] or (x[3] == y[2] and not (x[5] and y[4]))
    assert got == sorted((x[0], x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and not apart(x, y) and not apart(y, x))


def plain_cycles(links):
    after = defaultdict(set)
    for g, u, v in links:
        if u is not None and v is not None:
            after[g, u].add(v)

    def reach(g, u):
        seen, todo = set(), list(after.get((g, u), ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get((g, x), ())
        return seen

    far = {(g, u): reach(g, u) for g, u in after}
    return {(g, u): frozenset(v for v in far[g, u] if u in far.get((g, v), ())) for g, u in far if u in far[g, u]}


def cycles_of(df):
    members = defaultdict(set)
    rows = df.collect()
    for r in rows:
        members[r["g"], r["cycle"]].add(r["node"])
    return {(r["g"], r["node"]): frozenset(members[r["g"], r["cycle"]]) for r in rows}


def test_cycle_members_equal_brute_force(spark):
    rng = random.Random(8)
    links = [("ring", i, (i + 1) % 9) for i in range(9)] + [("open", i, i + 1) for i in range(9)] + [("self", 1, 1), ("tail", 1, 2), ("tail", 2, 3), ("tail", 3, 2), ("tail", 3, 4), ("none", 1, None)]
    links += [("two", 1, 2), ("two", 2, 1), ("two", 2, 3), ("two", 3, 4), ("two", 4, 3), ("loop", 4, 1), ("loop", 4, 2), ("loop", 4, 4), ("loop", 5, 2), ("loop", 5, 7), ("loop", 2, 1), ("loop", 2, 4), ("loop", 7, 5)]
    links += [(f"r{g}", rng.randrange(12), rng.randrange(12)) for g in range(40) for _ in range(rng.randrange(4, 22))] * 2
    df = spark.createDataFrame(links, "g string, a long, b long")
    assert cycles_of(C.cycle_members(df, "g", "a", "b")) == plain_cycles(links)
    assert C.cycle_members(df.filter("false"), "g", "a", "b").count() == 0


def test_a_chain_of_100000_takes_few_rounds(spark, monkeypatch):
    rounds, own = [], C.written
    monkeypatch.setattr(C, "written", lambda df: rounds.append(1) or own(df))
    n = 100_000
    chain = spark.range(n).select(F.lit("c").alias("g"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert C.cycle_members(chain, "g", "a", "b").count() == 0
    # one round a doubling, and a few to begin and to end
    assert len(rounds) <= 17 + 3 + 8
    ring = chain.select("g", "a", F.when(F.col("b") == n, 0).otherwise(F.col("b")).alias("b"))
    found = C.cycle_members(ring, "g", "a", "b")
    assert found.count() == n and found.select("cycle").distinct().count() == 1


@pytest.mark.parametrize("stretches", [1, 7, 128])
def test_sequences_over_stretches(spark, stretches):
    rng = random.Random(stretches)
    rows = [(i, "hot" if i % 3 else f"k{i % 5}", rng.randrange(0, 4000)) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id long, k string, s long").select("event_id", "k", F.timestamp_seconds("s").alias("at"))
    want = []
    for k in {r[1] for r in rows}:
        runs = []
        for t in sorted(r[2] for r in rows if r[1] == k):
            if runs and t - runs[-1][-1] <= 6:
                runs[-1].append(t)
            else:
                runs.append([t])
        want += [(k, i + 1, len(x), x[0] * 10**6, x[-1] * 10**6) for i, x in enumerate(runs) if len(x) >= 2]
    got = P.sequences(df, "k", "at", 6, 2, stretches)
    assert sorted(tuple(r) for r in got.select("k", "run", "n", "first", "last").collect()) == sorted(want)


def test_a_hot_key_is_scanned_by_many_groups(spark):
    df = spark.range(40_000).select(F.col("id").alias("event_id"), F.lit("one").alias("k"), F.timestamp_seconds(F.col("id") * 10).alias("at"))
    us = F.unix_micros("at")
    parts = df.groupBy(P.stretch_of(df, us).alias("p")).count().collect()
    assert len(parts) > 100 and max(r["count"] for r in parts) < 1000
    assert P.sequences(df, "k", "at", 10, 2).select("n").first()["n"] == 40_000


@pytest.mark.parametrize("block", [1, 3, 512])
def test_meetings_at_a_hot_place(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice("abcde"), "hot" if i % 3 else "p", rng.randrange(0, 120)) for i in range(300)] + [(None, "hot", 1), ("a", None, 1)]
    df = spark.createDataFrame(rows, "k string, p string, s long").select("k", "p", F.timestamp_seconds("s").alias("at"))
    want = Counter()
    good = [r for r in rows if r[0] and r[1]]
    for i, x in enumerate(good):
        for y in good[i + 1 :]:
            if x[1] == y[1] and x[0] != y[0] and abs(x[2] - y[2]) <= 10:
                want[min(x[0], y[0]), max(x[0], y[0])] += 1
    got = {(r["a"], r["b"]): r["meetings"] for r in P.co_occurrences(df, "k", "p", "at", 10, block).collect()}
    assert got == want


def plain_root(hashes):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    level = {p: sha("leaf;" + "".join(sorted(h for h in hashes if h[: M.LEAF] == p))) for p in {h[: M.LEAF] for h in hashes}}
    for digits in M.ABOVE:
        level = {q: sha("node;" + "".join(sorted(f"{p}:{h}" for p, h in level.items() if p[:digits] == q))) for q in {p[:digits] for p in level}}
    return level[""]


def test_digest_trees_follow_from_their_own_set(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    sets = {"a": [sha(str(i)) for i in range(3)], "b": [sha(str(i)) for i in range(70)], "c": [sha(str(i)) for i in range(900)], "d": [sha("x")] * 40}
    df = spark.createDataFrame([(k, h) for k, hs in sets.items() for h in hs], "k string, h string")
    assert {r["k"]: (r["n"], r["digest"]) for r in M.roots(df, "k").collect()} == {k: (len(hs), plain_root(hs)) for k, hs in sets.items()}


def test_members_with_nulls_and_separators_stay_apart(spark):
    rows = [("1", "a", None), ("2", None, "a"), ("3", "a", ""), ("4", "", "a"), ("5", "a;1:b", "c"), ("6", "a", "1:b;1:c"), ("7", "a\x1fb", "c"), ("8", "a", "b\x1fc"), ("9", None, None), ("10", "-", "-")]
    sets = M.set_digests(spark.createDataFrame(rows, "k string, x string, y string"), "k", ["x", "y"])
    assert sets.select("digest").distinct().count() == len(rows)
    edges = spark.createDataFrame([("a", None, "r"), (None, "a", "r")], "src string, dst string, relation string").select("*", F.lit(None).cast("date").alias("seen"), F.lit("s").alias("source"))
    assert X.graph_digest(edges.filter("src = 'a'"), "relation").first()["digest"] != X.graph_digest(edges.filter("dst = 'a'"), "relation").first()["digest"]


def test_differences_and_inventories(spark):
    rng = random.Random(6)
    base = {f"f{i}": i for i in range(300)}
    other = {**base, "f7": -7, "new": 1}
    del other["f9"], other["f200"]
    sets = {"x": base, "y": other, "z": dict(base), "e": {"f1": 1}}
    rows = [(k, p, c) for k, own in sets.items() for p, c in own.items()]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows + [("x", "f1", 1), ("n", None, None)], "s string, path string, content int")
    pairs = spark.createDataFrame([("x", "y"), ("x", "z"), ("e", "gone"), ("y", "y")], "a string, b string")
    got = {(r["a"], r["b"], r["path"], r["fault"]) for r in M.differences(df, pairs, "s", "path", ["content"]).collect()}
    assert got == {("x", "y", "f7", "changed"), ("x", "y", "new", "extra"), ("x", "y", "f9", "missing"), ("x", "y", "f200", "missing"), ("e", "gone", "f1", "missing")}
    declared = df.filter("s in ('x', 'e')").withColumn("content", F.when(F.col("path") == "f5", 0).otherwise(F.col("content"))).filter("path <> 'f6'")
    faults = {(r["s"], r["path"], r["fault"]) for r in M.inventory_faults(declared, df.filter("s in ('x', 'e')"), "s", "path", ["content"]).collect()}
    assert faults == {("x", "f5", "changed"), ("x", "f6", "extra")}


def test_contained_sets_equal_brute_force(spark):
    l = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", (F.col("l_partkey") % 13).alias("m"), "l_quantity").filter("l_quantity > 44 or l_suppkey = 1")
    rows = [("hot", f"h{i}") for i in range(50)] + [(f"s{i}", "h1") for i in range(60)] + [("one", "h2"), ("two", "h1"), ("two", "h3"), ("null", None)]
    made = l.select(F.col("l_suppkey").cast("string").alias("s"), F.col("m").cast("string").alias("m")).unionByName(spark.createDataFrame(rows, "s string, m string"))
    sets = defaultdict(set)
    for r in made.dropna().collect():
        sets[r["s"]].add(r["m"])
    want = sorted((a, b, len(sets[a])) for a in sets for b in sets if a != b and sets[a] <= sets[b])
    assert sorted(tuple(r) for r in K.contained_sets(made, "s", "m").collect()) == want


def test_profiles_by_an_inverted_index(spark):
    """A hundred thousand profiles meet few values each; several values of a field must all fit."""
    values = spark.createDataFrame([(1, "n", "500.5"), (1, "c", "red"), (2, "n", "7"), (2, "n", "8"), (3, "n", "7"), (3, "n", "9000"), (4, "c", "blue"), (5, "n", "x")], "k int, field string, value string")
    many = spark.range(100_000).select(F.col("id").alias("profile"), F.lit("n").alias("field"), F.lit("range").alias("kind"), F.array().cast("array<string>").alias("allowed"), F.col("id").cast("double").alias("low"), (F.col("id") + 1.5).alias("high"))
    also = many.filter("id % 2 = 0".replace("id", "profile")).select("profile", F.lit("c").alias("field"), F.lit("text").alias("kind"), F.array(F.lit("red"), F.lit("green")).alias("allowed"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    got = sorted((r["k"], r["profile"]) for r in K.matching_profiles(values, many.unionByName(also), "k").collect())
    assert got == [(1, 499), (1, 500), (2, 7)]
    few = spark.createDataFrame([("p", "n", "range", None, 0.0, 10.0), ("q", "c", "text", ["red"], None, None)], "profile string, field string, kind string, allowed array<string>, low double, high double")
    entities = spark.createDataFrame([(i,) for i in range(1, 7)], "k int")
    status = {(r["k"], r["profile"]): r["status"] for r in E.profile_matches(entities, "k", values, few).collect()}
    assert [status[k, "p"] for k in range(1, 7)] == [S.NO, S.YES, S.UNRESOLVED, S.UNRESOLVED, S.UNRESOLVED, S.UNRESOLVED]
    assert [status[k, "q"] for k in (1, 2, 4)] == [S.YES, S.UNRESOLVED, S.NO]


def test_null_statuses_are_unresolved(spark):
    row = spark.sql("select cast(null as string) as n, 'match' as m, 'no_match' as x")
    n, m, x = F.col("n"), F.col("m"), F.col("x")
    got = row.select(S.all_of(m, n).alias("a"), S.all_of(x, n).alias("b"), S.any_of(m, n).alias("c"), S.any_of(x, n).alias("d"), S.negate(n).alias("e")).first()
    assert tuple(got) == (S.UNRESOLVED, S.NO, S.YES, S.UNRESOLVED, S.UNRESOLVED)
    rows = spark.createDataFrame([("p", None), ("p", "match"), ("q", "match")], "k string, s string").groupBy("k").agg(S.group_all(F.col("s")).alias("all"), S.group_any(F.col("s")).alias("any"))
    assert {r["k"]: (r["all"], r["any"]) for r in rows.collect()} == {"p": (S.UNRESOLVED, S.YES), "q": (S.YES, S.YES)}


def test_policies_that_do_not_apply_clear_nothing(spark):
    rows = [("a", "s", "p", True, "match", "match", "no_match", "no_match"), ("b", "s", "p", True, "no_match", "no_match", "match", "no_match"), ("c", None, "p", True, "match", "match", "no_match", "no_match"), ("d", None, "q", True, "match", "no_match", "match", "no_match"), ("e", "t", "p", True, "no_match", "match", "no_match", "match")]
    df = spark.createDataFrame(rows, "n string, s string, part_key string, enabled boolean, applies string, `when` string, allow string, conflict string")
    got = {r["n"]: r["decision"] for r in G.resolve_policies(G.policy_statuses(df), "part_key", "s").collect()}
    assert got == {"a": "suppressed", "b": "suppressed", "c": "suppressed", "d": "suppressed", "e": "kept"}


def test_earliest_with_tied_bounds(spark):
    rows = [("tie", 1, 0, 9), ("tie", 2, 0, 0), ("same", 5, 3, 3), ("same", 4, 3, 3), ("open", 1, 0, None), ("open", 2, 5, 6), ("low", 1, None, 3), ("low", 2, 4, 5), ("one", 1, 0, 1), ("alone", 1, 0, None)]
    got = {r["k"]: (r["earliest"], r["status"]) for r in G.earliest(spark.createDataFrame(rows, "k string, i long, lo long, hi long"), "k", "lo", "hi", "i").collect()}
    un = (None, "unresolved")
    assert got == {"tie": (2, "resolved"), "same": (4, "resolved"), "open": un, "low": un, "one": (1, "resolved"), "alone": un}


def test_amendments_of_unknown_claims_and_false_supersessions(spark):
    rows = [("a1", "c", None), ("a2", "c", "a1"), ("a3", "c", "b1"), ("b1", "d", None), ("x", "gone", None), ("s", "c", "s"), ("n", "c", "none")]
    am = spark.createDataFrame(rows, "id string, claim string, supersedes string").withColumns({"operation": F.lit("withdraw"), "issuer_linked": F.lit(True), "publisher": F.lit("p"), "namespace": F.lit("n"), "replacement": F.lit(None).cast("string"), "issued": F.when(F.col("id") == "a1", 9).otherwise(10)})
    claims = spark.createDataFrame([("c", "p", "n"), ("d", "p", "n")], "claim string, publisher string, namespace string")
    got = {r["id"]: r["status"] for r in G.supported_amendments(am, claims, "claim").collect()}
    assert got == {"a1": "match", "a2": "match", "a3": "unresolved", "b1": "match", "x": "invalid", "s": "unresolved", "n": "unresolved"}
    cyclic = C.cycle_members(am, "claim", "id", "supersedes").select("claim")
    assert {r["id"]: r["status"] for r in G.supported_amendments(am, claims, "claim", cyclic).collect()}["a1"] == "invalid"


def test_rules_of_repeated_names_and_empty_sets(spark):
    rows = spark.createDataFrame([("a", "mode", ["x"]), ("a", "mode", ["y"]), ("b", "other", ["x"])], "k string, name string, items array<string>")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    got = sorted((r["k"], r["name"], r["fault"]) for r in R.rule_faults(rows, "k", {"mode": {"required": True, "enum": ["x"]}}, keys).collect())
    assert got == [("a", "mode", "enum"), ("a", "mode", "given_twice"), ("b", "mode", "missing"), ("b", "other", "unknown"), ("c", "mode", "missing")]


def test_certificates_are_counted_once(spark):
    c = spark.createDataFrame([(i, f"h{i}.a.example") for i in range(4)], "id int, host string")
    profiles = spark.createDataFrame([(i, p, "match") for i in range(4) for p in ("p", "q")], "id int, profile string, status string")
    got = sorted((r["id"], r["profile"], r["candidates"], r["partial"]) for r in Q.expanded_certificates(c, spark.createDataFrame([("a.example",)], "scope string"), profiles, "id", "host", 3).collect())
    assert got == [(i, p, 4, True) for i in range(3) for p in ("p", "q")]


def test_declarations_and_histories_of_broken_documents(spark):
    bytes_ = spark.createDataFrame([("s", bytearray(b"not json"))], "source_id string, content binary")
    sources = bytes_.select("source_id", F.lit("d").alias("document"), F.lit("r").alias("revision"), F.lit("c").alias("collection"), F.lit(D.EXACT).alias("scope"), F.sha2("content", 256).alias("sha256"))
    records = spark.createDataFrame([], "record_id string, history string, sha256 string, at date")
    h = spark.createDataFrame([("h", "s", True), ("n", None, True)], "history string, source_id string, linked boolean")
    got = {r["history"]: (r["status"], r["reason"]) for r in D.preserved_histories(h, sources, bytes_, records, "/m", "c", "q", ("x", "1")).collect()}
    assert got == {"h": ("invalid", "manifest_shape"), "n": (S.UNRESOLVED, "source_unknown")}
