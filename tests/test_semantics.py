"""Boundaries of pivots, time, identities and claims on small tables of our own."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pivotloom.functions import identity as I
from pivotloom.functions import scans as C
from pivotloom.functions import status as S
from pivotloom.functions import timeops as T
from pivotloom.operators import claims as G
from pivotloom.operators import merkle as M
from pivotloom.operators import evidence as E
from pivotloom.operators import pivot as P
from pivotloom.sources import exports

AS_OF = "2024-06-30"


@pytest.fixture(scope="module")
def graph(spark):
    day = lambda n: dt.date(2024, 6, 30) - dt.timedelta(days=n)
    nodes = spark.createDataFrame(
        [("key:1", "key", "k", []), ("ip:1", "ip", "a", []), ("ip:2", "ip", "b", ["cdn"]), ("ip:3", "ip", "c", ["parked"]), ("ip:4", "ip", "d", []), ("ip:5", "ip", "e", []), ("name:1", "name", "n", ["cdn"]), ("key:2", "key", "k2", [])],
        "id string, form string, label string, negative_lists array<string>")
    edges = spark.createDataFrame(
        [("key:1", "ip:1", "SEEN_AT", day(0), "s1"), ("key:1", "ip:1", "SEEN_AT", day(0), "s1"), ("key:1", "ip:2", "SEEN_AT", day(30), "s1"), ("key:1", "ip:3", "SEEN_AT", day(5), "s2"),
         ("key:1", "ip:4", "SEEN_AT", day(31), "s1"), ("key:1", "ip:5", "OTHER", day(1), "s1"), ("ip:5", "key:1", "SEEN_AT", day(1), "s1"), ("key:1", "name:1", "SEEN_AT", day(2), "s3"), ("key:1", "ip:5", "SEEN_AT", None, "s1"), ("key:2", "ip:1", "SEEN_AT", day(3), "s1")],
        "src string, dst string, relation string, seen date, source string")
    return nodes, edges


def run(graph, spec, seed="key:1"):
    nodes, edges = graph
    return sorted((r["target"], r["included"]) for r in P.pivot(nodes.filter(F.col("id") == seed), nodes, edges, spec, AS_OF).collect())


def test_window_ends_multiplicity_direction_and_scoped_lists(graph):
    lists = (("ip", "cdn"), ("name", "parked"))
    spec = P.PivotSpec("key", (P.Hop("SEEN_AT", "out", "ip|name"),), 30, lists)
    assert run(graph, spec) == [("ip:1", True), ("ip:1", True), ("ip:2", False), ("ip:3", True), ("ip:4", False), ("name:1", True)]
    assert run(graph, P.PivotSpec("key", (P.Hop("SEEN_AT", "in", "ip"),), 30)) == [("ip:5", True)]
    assert run(graph, P.PivotSpec("key", (P.Hop("OTHER|NONE", "out", "ip"),), 30)) == [("ip:5", True)]
    assert run(graph, P.PivotSpec("ip", (P.Hop("SEEN_AT", "out", "ip"),), 30)) == []
    assert run(graph, spec, "key:9") == []


def test_two_hops_leave_the_seed_out_and_caps_cut(graph):
    two = P.PivotSpec("key", (P.Hop("SEEN_AT", "out", "ip"), P.Hop("SEEN_AT", "in", "key")), 30)
    assert run(graph, two) == [("key:2", True), ("key:2", True)]
    capped = P.PivotSpec("key", (P.Hop("SEEN_AT", "out", "ip", cap=3),), 30)
    assert run(graph, capped) == [] and run(graph, capped, "key:2") == [("ip:1", True)]


def test_forms_come_from_nodes_and_both_ends_may_be_listed(spark, tmp_path):
    made = {
        "nodes": [{"id": "k1", "form": "key"}, {"id": "ip:9", "form": "key", "negative_node_list": "shared"}, *({"id": f"n{i}", "form": "ip"} for i in range(4)), {"id": "n9", "form": "ip", "negative_node_list": "cdn"}, {"id": "x", "form": "name"}],
        "relationships": [{"from": a, "to": b, "type": "SEEN_AT", "properties": {"seen": day, "source": "s"}} for a, b, day in [
            ("k1", "n0", "2024-06-30"), ("k1", "n1", "2024-05-31"), ("k1", "n1", "2024-06-01"), ("k1", "n2", "2024-05-30"), ("k1", "n3", "2024-07-01"), ("k1", "n9", "2024-06-20"), ("k1", "x", "2024-06-20"), ("ip:9", "n0", "2024-06-20"), ("k1", "gone", "2024-06-20"), ("k1", "n0", "20240620")]],
    }
    (tmp_path / "g.json").write_text(json.dumps(made))
    found = exports.read_pivot_graph(spark, str(tmp_path / "g.json"))
    spec = P.PivotSpec("key", (P.Hop("SEEN_AT", "out", "ip"),), 30, (("ip", "cdn"), ("key", "shared")))
    nodes, edges = found
    sets = {r["seed"]: (r["included"], r["suppressed"]) for r in P.target_sets(P.pivot(nodes.select("id"), nodes, edges, spec, AS_OF)).collect()}
    assert sets == {"k1": (["n0", "n1"], ["n2", "n3", "n9"]), "ip:9": ([], ["n0"])}
    cut = P.cut_starts(nodes, edges, P.Hop("SEEN_AT", "out", "ip", cap=2), AS_OF, 30).collect()
    assert [(r["at"], r["degree"]) for r in cut] == [("k1", 4)]


def test_wide_fan_out(spark):
    edges = spark.range(50_001).select(F.lit("key:1").alias("src"), F.concat(F.lit("ip:"), "id").alias("dst"), F.lit("SEEN_AT").alias("relation"), F.lit("2024-06-01").cast("date").alias("seen"), F.lit("s").alias("source"))
    nodes = edges.select(F.col("dst").alias("id"), F.lit("ip").alias("form"), F.lit("x").alias("label"), F.array().cast("array<string>").alias("negative_lists")).union(spark.sql("select 'key:1', 'key', 'k', cast(array() as array<string>)"))
    found = P.pivot(nodes.filter("form = 'key'"), nodes, edges, P.PivotSpec("key", (P.Hop("SEEN_AT", "out", "ip"),), 60), AS_OF)
    assert found.count() == 50_001


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, F.lit(v))
    return row.select(column.alias("x")).first()["x"]


def test_merge_orders_differ(spark):
    no, un, us, yes = (F.lit(x) for x in (S.NO, S.UNRESOLVED, S.UNSUPPORTED, S.YES))
    assert one(spark, S.all_of(yes, un, us)) == S.UNSUPPORTED and one(spark, S.all_of(us, no)) == S.NO
    assert one(spark, S.any_of(no, un, us)) == S.UNSUPPORTED and one(spark, S.any_of(us, yes)) == S.YES
    assert one(spark, S.any_of(no, un)) == S.UNRESOLVED and one(spark, S.negate(un)) == S.UNRESOLVED
    assert one(spark, S.all_in(F.array().cast("array<string>"), F.array(F.lit("a")))) == S.UNRESOLVED


def test_coarse_times(spark):
    at = lambda s, p: T.bounds(F.lit(s).cast("timestamp"), F.lit(p))
    day, next_day, noon = at("2024-02-29 13:00:00", "day"), at("2024-03-01 00:00:00", "day"), at("2024-02-29 12:00:00", "instant")
    assert one(spark, T.compare(day, next_day, "lt")) == S.YES
    assert one(spark, T.compare(day, noon, "lt")) == S.UNRESOLVED
    assert one(spark, T.compare(noon, noon, "eq")) == S.YES and one(spark, T.compare(noon, noon, "lt")) == S.NO
    period = T.query_period("2024-02-29", "2024-02-29")
    assert one(spark, T.within(day, period, "contained")) == S.YES
    assert one(spark, T.within(at("2024-02-01 00:00:00", "month"), period, "contained")) == S.UNRESOLVED
    assert one(spark, T.within(day, period, "some")) == S.UNSUPPORTED
    assert one(spark, T.bounds(F.lit("2024-01-01").cast("timestamp"), F.lit("century"))) is None


def test_identities(spark):
    for text, want in [("1.2.3.4", 16909060), ("01.2.3.4", None), ("1.2.3.256", None), ("1.2.3", None), ("255.255.255.255", 2**32 - 1)]:
        assert one(spark, I.ipv4(F.lit(text))) == want
    for text, want in [("Example.COM.", "example.com"), ("a..b", None), ("-a.b", None), ("1.2.3.4", None), ("", None)]:
        assert one(spark, I.dns_name(F.lit(text))) == want
    for text, want in [("10.0.0.0/8", (167772160, 184549375)), ("10.0.0.1/8", None), ("10.0.0.0", None), ("0.0.0.0/0", (0, 2**32 - 1))]:
        got = one(spark, I.cidr(F.lit(text)))
        assert (None if got is None else tuple(got)) == want
    u = one(spark, I.uri_parts(F.lit("http://u@h.example:8/p?#")))
    assert tuple(u) == ("http", "u@h.example:8", "/p", "", "")
    assert tuple(one(spark, I.uri_parts(F.lit("mailto:x")))) == ("mailto", None, "x", None, None)
    for authority, want in [("[::1]:80", "ipv6"), ("[v1.x]", "ipvfuture"), ("u@1.2.3.4:5", "ipv4"), ("h.example", "dns"), ("", "none"), ("a%41b", "reg_name")]:
        assert one(spark, I.host_kind(F.lit(authority))) == want
    assert one(spark, C.placeholder_hex(F.lit("abababab"))) and one(spark, C.placeholder_hex(F.lit("aaaabbbbcccc"))) and not one(spark, C.placeholder_hex(F.lit("a1b2c3d4e5")))
    assert one(spark, C.offset_timestamp(F.lit("2024-02-29T01:02:03Z"))) and not one(spark, C.offset_timestamp(F.lit("2023-02-29T01:02:03Z"))) and not one(spark, C.offset_timestamp(F.lit("2024-02-29T01:02:03")))


def test_incomparable_establishments_stay_open(spark):
    rows = spark.createDataFrame([("a", 1, 0, 5), ("a", 2, 5, 9), ("b", 1, 0, 6), ("b", 2, 5, 9), ("c", 1, 0, 1)], "k string, id long, lo long, hi long")
    got = {r["k"]: (r["earliest"], r["status"]) for r in G.earliest(rows, "k", "lo", "hi", "id").collect()}
    assert got == {"a": (1, "resolved"), "b": (None, "unresolved"), "c": (1, "resolved")}


def test_one_suppressing_group_removes_its_whole_scope(spark):
    rows = spark.createDataFrame([(1, "g1", "s", "match", "no_match", "no_match"), (2, "g2", "s", "no_match", "no_match", "no_match"), (3, "g3", "t", "match", "match", "no_match"), (4, "g4", "u", "unresolved", "no_match", "no_match")], "id long, g string, s string, when string, allow string, conflict string")
    assert {r["id"]: r["decision"] for r in G.resolve_policies(rows, "g", "s").collect()} == {1: "suppressed", 2: "suppressed", 3: "contested", 4: "unresolved"}


def test_pointer_cover_and_wide_prefixes(spark):
    assert one(spark, E.covers(F.lit("/a"), F.lit("/a/b"))) and not one(spark, E.covers(F.lit("/a"), F.lit("/ab")))
    ips = spark.createDataFrame([(1, 167772161), (2, 1), (3, 184549376)], "id long, v long")
    nets = spark.createDataFrame([("10.0.0.0/7",), ("10.0.0.0/8",), ("bad",), ("10.0.0.9/8",)], "p string")
    assert sorted((r["id"], r["p"]) for r in E.in_prefix(ips, "v", nets, "p").collect()) == [(1, "10.0.0.0/7"), (1, "10.0.0.0/8"), (3, "10.0.0.0/7")]


def test_graph_files_round_trip(spark, tmp_path):
    graph = {"nodes": [{"id": "k", "form": "key", "label": "x"}, {"id": "i", "form": "ip", "label": "y", "negative_node_list": "cdn"}],
             "relationships": [{"from": "k", "to": "i", "type": "SEEN_AT", "properties": {"seen": "2024-01-05", "source": "s"}}, {"from": "k", "to": "i", "type": "SEEN_AT", "properties": {"seen": "not a date", "source": "s"}}]}
    (tmp_path / "g.json").write_text(json.dumps(graph))
    nodes, edges = exports.read_pivot_graph(spark, str(tmp_path / "g.json"))
    assert {r["id"]: r["negative_lists"] for r in nodes.collect()} == {"k": [], "i": ["cdn"]}
    assert sorted(str(r["seen"]) for r in edges.collect()) == ["2024-01-05", "None"]
    coded = exports.encode_graph(edges)
    assert exports.decode_graph(coded).exceptAll(edges).count() == 0
    assert exports.decode_graph(coded.withColumn("sha256", F.lit("0"))).count() == 0
    digest = lambda e: exports.graph_digest(e, "relation").first()["digest"]
    assert digest(edges) == digest(edges.orderBy(F.desc("seen")).repartition(3))
    files = exports.read_source_bytes(spark, str(tmp_path / "g.json"))
    assert files.first()["bytes"] == len(json.dumps(graph))


def test_amendments_by_operation_support_and_supersession(spark):
    rows = [
        ("withdrawn", "a", "withdraw", None, "match", "match"), ("both", "b1", "withdraw", None, "match", "match"), ("both", "b2", "correct", None, "match", "match"),
        ("disputed", "c", "dispute", None, "match", "match"), ("back", "d1", "withdraw", None, "match", "match"), ("back", "d2", "reinstate", "d1", "match", "match"),
        ("beside", "e1", "withdraw", None, "match", "match"), ("beside", "e2", "reinstate", None, "match", "match"),
        ("open", "f1", "withdraw", None, "match", "match"), ("open", "f2", "reinstate", "f1", "unresolved", "match"),
        ("later", "g1", "withdraw", None, "match", "no_match"), ("held", "h1", "withdraw", None, "match", "match"), ("held", "h2", "reinstate", "h1", "match", "no_match"), ("unknown", "i", "correct", None, "match", "unsupported"),
    ]
    am = spark.createDataFrame(rows, "claim string, amendment_id string, operation string, supersedes string, support string, available string")
    claims = am.select("claim").distinct().union(spark.sql("select 'none'"))
    got = {r["claim"]: r["state"] for r in G.amendment_state(claims, am, "claim").collect()}
    gap = "unresolved_amendment_context"
    assert got == {"withdrawn": "withdrawn", "both": "corrected", "disputed": "contested", "back": "reported", "beside": "contested", "open": gap, "later": "reported", "held": "withdrawn", "unknown": gap, "none": "reported"}


def test_policies_that_are_off_or_cut_and_required_controls(spark):
    yes, no, un = S.YES, S.NO, S.UNRESOLVED
    rows = [
        ("gone", "s1", "p", True, yes, yes, no, no, True, False), ("off", "s2", "p", False, yes, yes, no, no, True, False), ("elsewhere", "s3", "p", True, no, yes, no, yes, True, False),
        ("unsure", "s4", "p", True, un, yes, no, no, True, False), ("cut", "s5", "p", True, yes, yes, no, no, False, True), ("both", "s6", "p", True, yes, yes, yes, no, False, False),
        ("no part", "s7", None, True, yes, yes, yes, no, True, False), ("clear", "s8", "p", True, yes, no, yes, no, True, False), ("uncleared", "s9", "p", True, yes, no, no, no, True, False),
    ]
    df = spark.createDataFrame(rows, "name string, scope_key string, part_key string, enabled boolean, applies string, `when` string, allow string, conflict string, required boolean, cut boolean")
    decided = G.required_controls(G.resolve_policies(G.policy_statuses(df), "part_key", "scope_key", "cut"))
    got = {r["name"]: (r["decision"], r["control"]) for r in decided.collect()}
    assert got == {
        "gone": ("suppressed", "suppressed"), "elsewhere": ("kept", "returned"), "unsure": ("unresolved", "unresolved"), "cut": ("unresolved", "returned"), "both": ("contested", "returned"),
        "no part": ("unresolved", "unresolved"), "clear": ("kept", "returned"), "uncleared": ("kept", "unresolved")}


def test_long_serials_and_pem(spark):
    for n in (0, 7, 255, 2**64, 2**64 - 1, 10**18, 2**159 + 12345, 2**160 - 1):
        assert one(spark, I.serial_hex(F.col("s"), 10), s=str(n)) == f"{n:x}"
        assert one(spark, I.serial_hex(F.col("s"), 16), s=f"00{n:X}") == f"{n:x}"
    assert one(spark, I.serial_hex(F.col("s"), 10), s="12a") is None and one(spark, I.serial_hex(F.col("s"), 16), s="xyz") is None
    pem = "-----BEGIN CERTIFICATE-----\nAAEC\nAwQ=\n-----END CERTIFICATE-----\n"
    assert bytes(one(spark, I.der_bytes(F.col("s")), s=pem)) == bytes(range(5))


def test_history_gate_compares_the_digest(spark):
    day = dt.date
    e = spark.createDataFrame([(k, i, day(2024, 1, i)) for k in ("good", "wrong", "short", "early", "open") for i in (2, 3)], "claim string, item int, at date")
    own = M.roots(e.select("claim", M.member_hash(["item", "at"]).alias("h")), "claim")
    told = {r["claim"]: r["digest"] for r in own.collect()}
    whole = "complete_declared_scope"
    m = spark.createDataFrame(
        [("good", 2, told["good"], whole, day(2024, 1, 1), day(2024, 2, 1)), ("wrong", 2, "0" * 64, whole, day(2024, 1, 1), day(2024, 2, 1)), ("short", 3, told["short"], whole, day(2024, 1, 1), day(2024, 2, 1)),
         ("early", 2, told["early"], whole, day(2024, 1, 3), day(2024, 2, 1)), ("open", 2, told["open"], "unknown", day(2024, 1, 1), day(2024, 2, 1)), ("none", 0, None, whole, day(2024, 1, 1), day(2024, 2, 1))],
        "claim string, declared int, declared_digest string, coverage string, origin date, through date")
    from pivotloom.operators import results as R

    assert {r["claim"]: r["status"] for r in R.history_gate(e, m, "claim").collect()} == {"good": S.YES, "wrong": "invalid", "short": S.UNRESOLVED, "early": S.NO, "open": S.UNRESOLVED, "none": S.UNRESOLVED}


def test_wildcards_and_prefix_lengths(spark):
    names = spark.createDataFrame([(1, "*.a.example"), (2, "b.a.example"), (3, "*.example")], "id int, name string")
    scopes = spark.createDataFrame([("a.example",), ("example",)], "scope string")
    got = sorted((r["id"], r["scope"], r["wildcard"]) for r in E.in_scope(names, "name", scopes, "scope").collect())
    assert got == [(1, "a.example", True), (1, "example", True), (2, "a.example", False), (2, "example", False), (3, "example", True)]
    ips = spark.createDataFrame([(1, 0), (2, 2**32 - 1), (3, 10 * 2**24 + 5)], "id int, v long")
    nets = spark.createDataFrame([("0.0.0.0/0",), ("10.0.0.0/8",), ("10.0.0.4/31",), ("255.255.255.255/32",), ("10.0.0.5/31",)], "prefix string")
    got = sorted((r["id"], r["prefix"]) for r in E.in_prefix(ips, "v", nets, "prefix").collect())
    assert got == [(1, "0.0.0.0/0"), (2, "0.0.0.0/0"), (2, "255.255.255.255/32"), (3, "0.0.0.0/0"), (3, "10.0.0.0/8"), (3, "10.0.0.4/31")]
    assert E.in_prefix(ips, "v", nets.filter("false"), "prefix").count() == 0


def test_encoded_evidence_is_checked(spark):
    records = spark.sql("select 'r1' id, 's' subject, cast(null as string) object, array(named_struct('source_id', 'x', 'field', '/a'), named_struct('source_id', 'y', 'field', '/b')) evidence, array(named_struct('role', 'published', 'object', cast(null as string), 'occurrence', 'r1')) times")
    rows = exports.evidence_edges(records)
    assert sorted((r["type"], r["ordinal"], r["dst"]) for r in rows.collect()) == [("EVIDENCE", 0, "x"), ("EVIDENCE", 1, "y"), ("SUBJECT", 0, "s"), ("TIME_OCCURRENCE", 0, "r1")]
    assert exports.encoding_faults(rows).count() == 0
    broken = rows.withColumn("payload", F.when(F.col("type") == "SUBJECT", "{}").otherwise(F.col("payload"))).filter("not (type = 'EVIDENCE' and ordinal = 0)")
    assert sorted((r["type"], r["fault"]) for r in exports.encoding_faults(broken).collect()) == [("EVIDENCE", "ordinal"), ("SUBJECT", "digest"), ("SUBJECT", "target")]


def test_bucketed_overlaps_come_once(spark):
    rows = [(1, i, lo, lo + n) for i, (lo, n) in enumerate([(0, 100), (5, 3), (50, 0), (99, 500), (100, 1), (-7, 3), (8, 2)])]
    df = spark.createDataFrame(rows, "k int, i int, lo int, hi int").select("k", "i", T.interval(F.col("lo"), F.col("hi"), True, True).alias("x"))
    got = sorted((r["a"], r["b"]) for r in T.overlaps(df, "k", "i", "x", 10).collect())
    assert got == sorted((a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[2] <= b[3] and b[2] <= a[3])


def test_a_run_is_written_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "seed string, n int")
    exports.write_run(str(tmp_path / "run"), rows, rows.filter("false"), rows)
    assert [spark.read.parquet(str(tmp_path / "run" / n)).count() for n in ("results", "diagnostics", "summary")] == [1, 0, 1]
    assert spark.read.json(str(tmp_path / "run" / "summary_json")).first()["seed"] == "a"


def test_uncertain_states_stay_open(spark):
    x = T.interval(F.lit(10), F.lit(20), True, True)
    late = T.interval(F.lit(22), F.lit(30), True, True)
    yes, no = F.lit(True), F.lit(False)
    assert one(spark, T.compare(T.widen(x, F.lit(1), no), late, "lt", no)) == S.YES
    assert one(spark, T.compare(T.widen(x, F.lit(3), no), late, "lt", no)) == S.UNRESOLVED
    assert one(spark, T.compare(T.widen(x, F.lit(1), yes), late, "lt", yes)) == S.UNRESOLVED
    assert one(spark, T.compare(T.widen(x, F.lit(0), yes), late, "lt", yes)) == S.UNSUPPORTED
