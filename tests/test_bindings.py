"""Inquiries that bind results to the subject asked about: each rule by a case that keeps it and one that breaks it."""

import pytest
from pyspark.sql import functions as F

from pivotloom.functions import status as S
from pivotloom.functions import timeops as T
from pivotloom.operators import bindings as B


def period():
    return T.query_period("1970-01-01", "1970-01-02")


def ival(lo, hi):
    return T.interval(F.col(lo), F.col(hi), True, True)


def test_one_side_alone_disposes(spark):
    rows = [("a", "yes"), ("a", "yes"), ("b", "no"), ("c", "yes"), ("c", "no"), ("d", "disputed"), ("d", "no"), ("e", None), ("f", None), ("f", "yes")]
    got = {r["k"]: r["control"] for r in B.disposed(spark.createDataFrame(rows, "k string, s string"), ["k"], "s", "yes", "no").collect()}
    assert got == {"a": "suppressed", "b": "kept", "c": S.UNRESOLVED, "d": S.UNRESOLVED, "e": S.UNRESOLVED, "f": S.UNRESOLVED}


def appointments(spark, services, exclusions=None):
    persons = spark.createDataFrame([("alice", "s1"), ("bob", "s1")], "person string, scope string")
    orgs = spark.createDataFrame([("A", "o"), ("B", "o"), ("C", "o")], "org string, scope string")
    rows = [("a1", "alice", "A", "director", "s1", "o"), ("a2", "alice", "B", "officer", "s1", "o"), ("a3", "alice", "C", "auditor", "s1", "o"), ("a4", "bob", "A", "director", "s2", "o"), ("a5", "alice", "C", "director", "s1", None)]
    made = spark.createDataFrame(rows, "appointment string, person string, org string, role string, person_scope string, org_scope string")
    s = spark.createDataFrame(services, "appointment string, service string, kind string, lo long, hi long, k long, active boolean")
    s = s.select("appointment", "service", F.when(F.col("kind") == "held", ival("lo", "hi")).alias("held"), F.when(F.col("kind") == "at", ival("lo", "hi")).alias("at"), F.when(F.col("k").isNotNull(), ival("k", "k")).alias("known"), "active")
    return {(r["appointment"], r["service"]): (r["org"], r["status"], r["control"]) for r in B.officer_appointments(persons, orgs, made, s, period(), exclusions).collect()}


def test_only_own_appointments_as_officer_or_director(spark):
    got = appointments(spark, [(f"a{i}", "s", "held", 0, 9, None, None) for i in range(1, 6)])
    assert got == {("a1", "s"): ("A", S.YES, "not_selected"), ("a2", "s"): ("B", S.YES, "not_selected")}


def test_a_missing_end_is_not_endless_and_a_status_not_known_before_it_was(spark):
    rows = [("a1", "open", "held", 0, None, None, None), ("a1", "old", "held", -9, -5, None, None), ("a1", "edge", "held", -9, 0, None, None), ("a2", "now", "at", 10, 10, 10, True), ("a2", "early", "at", 10, 10, 9, True), ("a2", "unknown", "at", 10, 10, None, True), ("a2", "ended", "at", 10, 10, 11, False), ("a2", "coarse", "at", -5, 5, 11, True)]
    got = {k: v[1] for k, v in appointments(spark, rows).items()}
    assert got == {("a1", "open"): S.UNRESOLVED, ("a1", "edge"): S.YES, ("a2", "now"): S.YES, ("a2", "unknown"): S.UNRESOLVED, ("a2", "coarse"): S.UNRESOLVED}


def test_exclusions_of_appointments(spark):
    x = spark.createDataFrame([("a1", "exclude", -9, 10**6), ("a2", "retain", -9, 10**6), ("a2", "retain", 5, 6)], "appointment string, disposition string, lo long, hi long").select("appointment", "disposition", ival("lo", "hi").alias("x"))
    rows = [("a1", "s", "held", 0, 9, None, None), ("a2", "s", "held", 0, 9, None, None)]
    assert {k[0]: v[2] for k, v in appointments(spark, rows, x).items()} == {"a1": "suppressed", "a2": "kept"}
    assert {v[2] for v in appointments(spark, rows, x.filter("false")).values()} == {S.UNRESOLVED}


def phases(spark, roles, how="request_trace", boundary=None, at=100, phase="start", traced=True):
    q = spark.createDataFrame([(1, "e", "GET", "t", "1", at)], "request int, endpoint string, method string, tenant string, version string, s long").select("*", ival("s", "s").alias("at"))
    p = spark.createDataFrame([(7, 1, phase, "in", how, boundary, traced)], "phase_id int, request int, phase string, input string, how string, b long, traced boolean").select("*", F.when(F.col("b").isNotNull(), ival("b", "b")).alias("boundary"))
    r = spark.createDataFrame([(*x, 0, 999) for x in roles], "role string, tenant string, phases array<string>, exclusive boolean, support string, input string, lo long, hi long")
    r = r.select("*", F.lit("e").alias("endpoint"), F.lit("GET").alias("method"), F.lit("1").alias("version"), ival("lo", "hi").alias("applicable"))
    found = B.phase_comparisons(q, p, r, period(), F.array(F.lit("start"), F.lit("end")))
    return {x["role"]: x["outcome"] for x in found.collect()}


def test_a_contrary_role_takes_a_mismatch_away(spark):
    other, same = ("other", "t", ["end"], True, S.YES, "x"), ("same", "t", ["start", "end"], False, S.YES, "y")
    assert phases(spark, [other]) == {"other": "mismatch"}
    assert phases(spark, [other, same]) == {"other": "contested", "same": "compatible"}
    assert phases(spark, [other, ("maybe", "t", ["start"], True, S.UNRESOLVED, "y")]) == {"other": S.UNRESOLVED}
    assert phases(spark, [other, ("elsewhere", "t2", ["start"], False, S.YES, "y")]) == {"other": "mismatch"}
    assert phases(spark, [("own", "t", ["end"], True, S.YES, "in"), ("vague", "t", ["end"], None, S.YES, "x"), ("strange", "t", ["end", "late"], True, S.YES, "x"), ("none", "t", [], True, S.YES, "x")]) == {"vague": S.UNRESOLVED, "none": S.UNRESOLVED}


@pytest.mark.parametrize("given,outcome", [
    ({"how": "page_start", "boundary": 90}, "mismatch"), ({"how": "page_start", "boundary": 100}, "mismatch"), ({"how": "page_complete", "boundary": 101}, None), ({"how": "page_start"}, S.UNRESOLVED),
    ({"how": "guess"}, S.UNRESOLVED), ({"at": 10**6}, None), ({"phase": "late"}, None), ({"phase": None}, S.UNRESOLVED), ({"traced": False}, None), ({"traced": None}, S.UNRESOLVED)])
def test_a_phase_holds_by_its_own_request(spark, given, outcome):
    got = phases(spark, [("other", "t", ["end"], True, S.YES, "x")], **given)
    assert got == ({"other": outcome} if outcome else {})


def creative(spark, uri="https://ads.example/p", capture="c1", traced=True, stage="responded", says=(("ads.example", "l1", "nonmember"), ("ads.example", "l2", "nonmember")), times=((1, 10, 10),)):
    captures = spark.createDataFrame([("c1", "d1"), ("c2", "d2")], "capture string, input string")
    scripts = spark.createDataFrame([("c1", "s"), ("c2", "s")], "capture string, input string")
    refs = spark.createDataFrame([("c1", "s", uri, "navigation", e, lo, hi) for e, lo, hi in times] + [("c1", "s", uri, "mention", 99, 0, 0), ("c1", "s", None, "navigation", 98, 0, 0), ("c1", "gone", uri, "navigation", 97, 0, 0)], "capture string, input string, uri string, role string, establishment int, lo long, hi long").select("*", ival("lo", "hi").alias("x"))
    requests = spark.createDataFrame([("r", capture, uri, stage, traced)], "request string, capture string, uri string, stage string, traced boolean")
    links = spark.createDataFrame([("c1", "d1", "r", 5, 7)], "capture string, input string, request string, establishment int, lo long").select("*", ival("lo", "lo").alias("x"))
    controls = spark.createDataFrame(list(says), "host string, list string, says string")
    return {r["kind"]: r for r in B.creative_findings(captures, scripts, refs, requests, links, controls, ["l1", "l2"], period()).collect()}


def test_a_shared_script_hands_no_request_on(spark):
    got = creative(spark)
    assert {k: (r["capture"], r["input"], r["direct"], r["form"], r["control"], r["novel"]) for k, r in got.items()} == {"reference": ("c1", "s", False, "url", "kept", S.YES), "request": ("c1", "d1", True, "url", "kept", S.YES)}
    for broken in ({"capture": "c2"}, {"traced": False}, {"traced": None}, {"stage": "cached"}):
        assert set(creative(spark, **broken)) == {"reference"}


def test_a_host_needs_positive_absence_and_nothing_evades_it(spark):
    for says in ([("ads.example", "l1", "nonmember")], [("other", "l1", "nonmember"), ("other", "l2", "nonmember")], [("ads.example", "l1", "nonmember"), ("ads.example", "l2", "nonmember"), ("ads.example", "l2", "disputed")]):
        r = creative(spark, says=says)["reference"]
        assert (r["form"], r["control"]) == ("url", S.UNRESOLVED)
    assert creative(spark, says=[("ads.example", "l1", "member")])["reference"]["control"] == "suppressed"
    forms = {u: (r["form"], r["host"], r["control"]) for u in ("https://192.0.2.7/x", "urn:a:b", "HTTPS://ADS.example:8/x", "/relative") for r in [creative(spark, uri=u)["reference"]]}
    assert forms == {"https://192.0.2.7/x": ("url", None, "not_applicable"), "urn:a:b": ("generic_uri", None, "not_applicable"), "HTTPS://ADS.example:8/x": ("url", "ads.example", "kept"), "/relative": ("generic_uri", None, "not_applicable")}


def test_the_earliest_establishment_makes_a_finding_new(spark):
    late = 10**7
    assert creative(spark, times=((1, late, late),))["reference"]["novel"] == S.NO
    r = creative(spark, times=((1, late, late), (2, 10, 10)))["reference"]
    assert (r["earliest"], r["status"], r["novel"]) == (2, "resolved", S.YES)
    r = creative(spark, times=((1, 0, 50), (2, 10, 60)))["reference"]
    assert (r["earliest"], r["status"], r["novel"]) == (None, "unresolved", S.UNRESOLVED)


def matches(spark, scope="collected_file_set", content="2", interpretations=()):
    reps = spark.createDataFrame([("seed", "l", scope, None), ("cand", "r", scope, None), ("seed", "la", "archive", "h"), ("zip", "ra", "archive", "h"), ("null", "rn", "archive", None), ("other", "ro", "declared_subset", None)], "kit string, representation string, scope string, sha256 string")
    members = spark.createDataFrame([(s, p, c) for s, x in (("l", "2"), ("r", content), ("ro", "2")) for p, c in (("a", "1"), ("b", x))], "representation string, path string, content string")
    i = spark.createDataFrame(list(interpretations), "left string, right string, qualification string, path string")
    seeds = spark.createDataFrame([("seed",)], "kit string")
    return {(r["candidate"], r["reason"], r["view"]) for r in B.kit_matches(seeds, reps, members, i).collect()}


def test_kits_by_archive_files_and_paths(spark):
    archive, good = ("zip", "archive", "hosting"), "supported_specific_shared_feature"
    assert matches(spark) == {archive, ("cand", "file_set", "hosting")}
    assert matches(spark, content="3") == {archive}
    assert matches(spark, "declared_subset") == {archive, ("cand", "file_set", "clue"), ("other", "file_set", "clue")}
    both = [("l", "r", good, "a"), ("l", "r", good, "b")]
    assert matches(spark, content="3", interpretations=both) == {archive, ("cand", "paths", "hosting")}
    assert matches(spark, content="3", interpretations=[*both, ("l", "r", good, "c")]) == {archive}
    assert matches(spark, interpretations=[("l", "r", "only_generic_default_paths", "a"), ("l", "r", good, None)]) == {archive, ("cand", "file_set", "hosting"), ("cand", "paths", "clue")}


SHOWN = {
    "occurrence": "o", "source_scope": "s", "origin": "g", "collection": "c", "location": "loc", "resource": "res", "linked": True, "stage": "served", "dated": True, "at": 5, "avail": 9,
    "evidence": "client_network_capture", "provenance": "actual_network_response", "form": "fqdn", "value": "Host.example", "uri": "https://host.example:8443/x", "role": "delivery_endpoint", "shown_location": "loc", "purpose_of": "o", "purposes": ["not_controlled"]}


def hosted(spark, cases, baseline=(), comparisons=(), include=False):
    """The view of every case's deployment, None where it isn't shown; each has a copy of its record and one of another occurrence."""
    rows = {n: {"deployment": n, "candidate": f"kit of {n}", **SHOWN, **c} for n, c in cases.items()}
    text = ["deployment", "candidate", "occurrence", "source_scope", "origin", "collection", "location", "resource", "stage"]
    made = lambda rows, *names: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names))
    pick = lambda *names: [tuple(r[c] for c in names) for r in rows.values()]
    own = [{**r, "deployment": r["deployment"] + x, "occurrence": "another" if x == "-apart" else r["occurrence"]} for r in rows.values() for x in ("", "-copy", "-apart")]
    d = spark.createDataFrame([tuple(r[c] for c in [*text, "linked", "dated", "at", "avail"]) for r in own], ", ".join(f"{c} string" for c in text) + ", linked boolean, dated boolean, at long, avail long")
    d = d.select("*", F.when(F.col("at").isNotNull(), ival("at", "at")).alias("x"), ival("avail", "avail").alias("known"))
    cor = made(pick("deployment", "candidate", "resource", "shown_location", "occurrence", "evidence", "provenance"), "deployment", "candidate", "resource", "location", "occurrence", "evidence", "provenance").withColumn("representation", F.lit("r"))
    delivered = ["deployment", "location", "occurrence", "form", "value", "uri", "role"]
    pur = made([(n, r["candidate"], "res", "loc", r["purpose_of"], s) for n, r in rows.items() for s in r["purposes"]], "deployment", "candidate", "resource", "location", "occurrence", "says")
    com = made(list(comparisons), "comparison", "deployment", "baseline", "says")
    found = B.kit_deployments(d, cor, made(pick(*delivered), *delivered), pur, made([(b,) for b in baseline], "deployment"), com, include).collect()
    assert len({r["deployment"] for r in found}) == len(found)
    return {n: next((r["view"] for r in found if r["deployment"] == n), None) for n in cases}


def test_what_shows_a_deployment(spark):
    out = [{"provenance": "client_cache"}, {"provenance": None}, {"stage": "archive_offered"}, {"stage": "installed_serving_context"}, {"evidence": "archive_download"}, {"shown_location": "near"}, {"linked": False}, {"role": "unbound_network_peer"},
           {"uri": "https://x.example/"}, {"uri": None}, {"form": "ipv4", "value": "10.0.0.999"}, {"at": 10}, {"origin": None, "linked": None}]
    shown = [{}, {"form": "ipv4", "value": "192.0.2.1"}, {"evidence": "server_resource_log", "provenance": None, "stage": "installed_serving_context"}, {"dated": False, "at": None}]
    cases = {str(c): c for c in [*out, *shown, {"at": None}]}
    assert hosted(spark, cases) == {**{str(c): None for c in out}, **{str(c): "discovery" for c in shown}, "{'at': None}": S.UNRESOLVED}


def test_purposes_of_deployments(spark):
    cases = {"c": {"purposes": ["controlled"]}, "none": {"purposes": []}, "both": {"purposes": ["controlled", "not_controlled"]}, "disputed": {"purposes": ["not_controlled", "contested"]}, "later": {"purpose_of": "later"}, "twice": {"purposes": ["not_controlled"] * 2}}
    assert hosted(spark, cases) == {**dict.fromkeys(cases, S.UNRESOLVED), "c": "suppressed", "twice": "discovery"}
    assert set(hosted(spark, cases, include=True).values()) == {"discovery"}


def test_known_deployments_are_references_and_others_must_be_told_apart(spark):
    names = ["own", "copied", "untold", "told", "half", "split", "disputed", "null"]
    other, yes = "told-apart", "distinct_occurrences"
    known = ["own", "copied-copy", other, "gone"]
    all_of = lambda comparison, name, says=yes: [(comparison, name, b, says) for b in known]
    told = all_of("p", "told") + all_of("p", "half")[:3] + all_of("p", "split")[:2] + all_of("q", "split")[2:] + all_of("p", "disputed") + [("q", "disputed", other, "same_occurrence")] + all_of("p", "null") + [("q", "null", other, None)] + all_of("p", "untold-copy")
    got = hosted(spark, {n: {} for n in names}, known, told)
    assert got == {**dict.fromkeys(names, S.UNRESOLVED), "own": "reference", "copied": "reference", "told": "discovery"}


def test_receipts_rank_and_take_nothing_away(spark):
    m = spark.createDataFrame([("s", k, "r", "r", "archive", "hosting") for k in "abc"] + [("s", "a", "r", "r", "paths", "clue")], "seed string, candidate string, left string, right string, reason string, view string")
    h = spark.createDataFrame([(k, "c", "r", k) for k in "abc"], "candidate string, collection string, representation string, deployment string")
    r = spark.createDataFrame([("a", "c", "2020-01-05"), ("a", "c", "2010-01-01"), ("b", "c", "2010-01-01"), ("c", "x", "2020-01-05")], "candidate string, collection string, d string").withColumn("received", F.to_date("d"))
    got = B.kit_hosting(m, h, r, F.lit("2020-01-31").cast("date"), 180).collect()
    assert sorted((x["candidate"], x["visit"]) for x in got) == [("a", 0), ("b", 1), ("c", 2)]
