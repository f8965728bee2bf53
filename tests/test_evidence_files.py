"""Bundles of our own rows: tables, and the rules they break."""

import json

from pivotloom.sources.evidence_files import read_evidence, violations


def test_bundle_tables_and_rules(spark, tmp_path):
    time = {"binding": {"occurrence": "o1"}, "field": "/t", "source_revision": "r1", "clock": {"id": "c", "reference": "UTC", "uncertainty_seconds": 0}, "timezone": "Z", "precision": "second", "interval_role": "occurrence", "value": "2024-01-01T00:00:00Z"}
    bundle = {
        "contract": "c", "version": "1", "collection_id": "x",
        "sources": [{"id": "s1", "publisher": "p", "document": "d", "revision": "r1", "collection": "x", "independent_origin": None}],
        "records": [
            {"id": "e1", "kind": "entity", "type": "host", "attributes": {"a": 1}, "times": {}, "evidence": [{"source_id": "s1", "field": "/a"}]},
            {"id": "o1", "kind": "occurrence", "type": "seen", "subject": "e1", "object": "gone", "attributes": {}, "times": {"at": time}, "evidence": [{"source_id": "s1", "field": "/b"}, {"source_id": "s9", "field": "/c"}]},
            {"id": "o2", "kind": "rumour", "type": " ", "attributes": {}, "times": {"at": {**time, "source_revision": "r7", "binding": {"object": "nobody"}}}, "evidence": []},
            {"id": "e1", "kind": "assertion", "type": "again", "attributes": {}, "times": {}, "evidence": []},
        ],
    }
    (tmp_path / "b.json").write_text(json.dumps(bundle))
    t = read_evidence(spark, str(tmp_path))
    assert {k: v.count() for k, v in t.items()} == {"sources": 1, "records": 4, "evidence_refs": 3, "times": 2}
    assert t["records"].selectExpr("variant_get(attributes, '$.a', 'int') as a").filter("a = 1").count() == 1
    assert sorted((r["table"], r["id"], r["rule"]) for r in violations(t).collect()) == [
        ("evidence_refs", "o1", "dangling_source_id"), ("records", "e1", "assertion_without_subject"), ("records", "e1", "repeated_id"), ("records", "o1", "dangling_object"),
        ("records", "o2", "blank_type"), ("records", "o2", "kind"), ("times", "o2", "dangling_bound_to"), ("times", "o2", "revision_mismatch")]
