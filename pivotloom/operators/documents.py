"""Preserved documents behind histories and declarations: bytes, digests, and what they say of records.

Documents are rows (source_id, content) as `sources.exports.read_source_bytes` gives them.
Their bytes are held against the digest a source declares, read as JSON (VARIANT), taken
apart, and their entries joined back to records by id and digest. Statuses are match, no_match,
unresolved, unsupported and invalid, with the first reason that applies; a document of many
entries is many rows, and no document meets another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pivotloom.functions import status as S
from pivotloom.operators.evidence import covers

INVALID = "invalid"
EXACT = "exact_source_bytes"
MANIFEST = (
    "struct<history_id: string, revision: string, contract: string, version: string, collection_id: string, qualification: string, coverage: string, "
    "origin_id: string, through_id: string, establishments: array<struct<record_id: string, sha256: string>>>"
)
SIDECAR = (
    "struct<pattern_id: string, pattern_version: string, package: struct<registry: string, name: string, version: string>, repository_uri: string, "
    "declaration: struct<kind: string, evidence: struct<sha256: string, revision: string, publisher: string, collection: string, uri: string, field: string>>>"
)


def first_of(*rules: tuple[Column, str, str]) -> Column:
    """struct<status, reason> of the first rule (test, status, reason) that holds, else match."""
    said = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    out = None
    for test, status, reason in rules:
        test = F.coalesce(test, F.lit(False))
        out = F.when(test, said(status, reason)) if out is None else out.when(test, said(status, reason))
    return out.otherwise(said(S.YES, "all_checks"))


def content_rules(content: Column, scope: Column, sha256: Column, name: str = "content") -> list[tuple[Column, str, str]]:
    """What preserved bytes must be: there, with an exact digest that is theirs."""
    return [
        (content.isNull(), S.UNRESOLVED, f"{name}_bytes_unavailable"), (sha256.isNull(), S.UNRESOLVED, f"{name}_without_digest"),
        (scope.isNull() | (scope != EXACT), S.UNSUPPORTED, f"{name}_digest_scope"), (F.sha2(content, 256) != sha256, INVALID, f"{name}_digest_mismatch"),
    ]


def read_json(content: Column, pointer: str, schema: str) -> Column:
    """The part of a JSON document at a pointer; null where it isn't JSON, or the part isn't of the schema."""
    path = "$" + "".join(f".{p}" for p in pointer.split("/")[1:])
    return F.try_variant_get(F.try_parse_json(content.cast("string")), path, schema)


def preserved_histories(histories: DataFrame, sources: DataFrame, preserved: DataFrame, records: DataFrame, pointer: str, collection: str, qualification: str, contract: tuple[str, str]) -> DataFrame:
    """history, status, reason and establishments of every declared history.

    histories has history, source_id and linked (is the manifest among its evidence); sources
    source_id, document, revision, collection, scope, sha256; records record_id, history, sha256
    and at. The manifest lists establishments by id and digest, and names the records where
    the collection's history begins and where it was last looked at.
    """
    j = histories.join(sources, "source_id", "left").join(preserved, "source_id", "left").withColumn("m", read_json(F.col("content"), pointer, MANIFEST))
    listed = j.select("history", F.explode("m.establishments").alias("e")).select("history", "e.record_id", F.col("e.sha256").alias("told")).distinct()
    known = records.select("record_id", F.col("sha256").alias("own"), F.lit(True).alias("there"))
    entries = listed.join(known, "record_id", "left").groupBy("history").agg(
        F.count(F.lit(1)).alias("establishments"), F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(F.col("told") != F.col("own")).alias("altered"))
    unlisted = records.filter("history is not null").select("history", "record_id").join(listed.select("history", "record_id"), ["history", "record_id"], "left_anti").groupBy("history").agg(F.count(F.lit(1)).alias("unlisted"))
    at = lambda name: records.select(F.col("record_id").alias(f"{name}_id"), F.col("at").alias(name))
    j = j.withColumns({"origin_id": F.col("m.origin_id"), "through_id": F.col("m.through_id")})
    j = j.join(entries, "history", "left").join(unlisted, "history", "left").join(at("origin"), "origin_id", "left").join(at("through"), "through_id", "left")
    many = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    rules = [
        (~F.coalesce("linked", F.lit(False)), S.UNRESOLVED, "manifest_not_linked"),
        (F.col("document").isNull() | F.col("revision").isNull() | F.col("collection").isNull(), S.UNRESOLVED, "source_unknown"),
        *content_rules(F.col("content"), F.col("scope"), F.col("sha256"), "manifest"),
        (F.col("m").isNull(), INVALID, "manifest_shape"),
        (~F.col("m.history_id").eqNullSafe(F.col("history").cast("string")) | ~F.col("m.revision").eqNullSafe(F.col("revision")), INVALID, "manifest_identity"),
        ((F.col("m.contract") != contract[0]) | (F.col("m.version") != contract[1]), S.UNSUPPORTED, "contract"),
        ((F.col("m.collection_id") != collection) | (F.col("collection") != collection), S.NO, "other_collection"),
        (F.col("m.qualification") != qualification, S.UNSUPPORTED, "qualification"),
        (many("unlisted"), S.UNRESOLVED, "unlisted_establishment"), (many("missing"), S.UNRESOLVED, "missing_record"), (many("altered"), INVALID, "record_digest"),
        (F.coalesce(F.col("m.coverage") != "complete_declared_scope", F.lit(True)), S.UNRESOLVED, "coverage"),
        (F.col("origin").isNull() | F.col("through").isNull(), S.UNRESOLVED, "endpoints"), (F.col("origin") > F.col("through"), INVALID, "endpoints_reversed"),
        (F.coalesce("establishments", F.lit(0)) == 0, S.UNRESOLVED, "no_establishment"),
    ]
    return j.select("history", first_of(*rules).alias("s"), F.coalesce("establishments", F.lit(0)).alias("establishments")).select("history", "s.status", "s.reason", "establishments")


def preserved_declarations(declared: DataFrame, packages: DataFrame, repositories: DataFrame, sidecars: DataFrame, metadata: DataFrame, pattern: tuple[str, str]) -> DataFrame:
    """declaration, status and reason of package to repository declarations, from their preserved documents.

    declared has declaration, package, repository, sidecar, metadata, source_id and field (its
    evidence); packages package and identity (registry, name, version); repositories repository
    and uri; sidecars sidecar, content, scope, sha256 and normalized (its JSON text as the record
    has it); metadata metadata, content, scope, sha256, source_id, document, revision, publisher
    and collection. A declaration holds if its sidecar says so of this package version and
    repository, and is anchored in just the registry document that is preserved.
    """
    side = sidecars.select("sidecar", F.col("content").alias("sc"), F.col("scope").alias("sc_scope"), F.col("sha256").alias("sc_sha"), "normalized")
    meta = metadata.select("metadata", F.col("content").alias("md"), F.col("scope").alias("md_scope"), F.col("sha256").alias("md_sha"), F.col("source_id").alias("md_source"), "document", "revision", "publisher", "collection")
    j = declared.join(packages, "package", "left").join(repositories, "repository", "left").join(side, "sidecar", "left").join(meta, "metadata", "left")
    j = j.withColumn("d", read_json(F.col("sc"), "", SIDECAR)).withColumn("n", read_json(F.col("normalized"), "", SIDECAR))
    own, anchor = F.col("identity"), F.col("d.declaration.evidence")
    parts = [own[c] for c in ("registry", "name", "version")]
    unknown, blank = F.lit(False), F.lit(False)
    for p in parts:
        unknown, blank = unknown | p.isNull(), blank | (F.trim(p) == "")
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    anchored = same(anchor["sha256"], F.sha2("md", 256)) & same(anchor["revision"], F.col("revision")) & same(anchor["publisher"], F.col("publisher")) & same(anchor["collection"], F.col("collection")) & same(anchor["uri"], F.col("document"))
    anchored = anchored & same(F.col("source_id"), F.col("md_source")) & F.coalesce(covers(F.col("field"), anchor["field"]), F.lit(False))
    rules = [
        (F.col("sidecar").isNull() | F.col("metadata").isNull() | F.col("package").isNull() | F.col("repository").isNull(), S.UNRESOLVED, "binding_absent"),
        *content_rules(F.col("sc"), F.col("sc_scope"), F.col("sc_sha"), "sidecar"), *content_rules(F.col("md"), F.col("md_scope"), F.col("md_sha"), "metadata"),
        (F.col("d").isNull(), INVALID, "sidecar_shape"), (F.col("normalized").isNull(), S.UNRESOLVED, "normalized_absent"), (~F.col("n").eqNullSafe(F.col("d")), S.NO, "normalized_differs"),
        (~same(F.col("d.pattern_id"), F.lit(pattern[0])) | ~same(F.col("d.pattern_version"), F.lit(pattern[1])), S.NO, "other_pattern"),
        (~same(F.col("d.declaration.kind"), F.lit("version_source_repository")), S.NO, "other_kind"),
        (own.isNull() | unknown, S.UNRESOLVED, "package_unknown"), (blank, INVALID, "package_blank"), (~F.col("d.package").eqNullSafe(own), S.NO, "other_package"),
        (F.col("uri").isNull(), S.UNRESOLVED, "repository_unknown"), (~same(F.col("uri"), F.col("d.repository_uri")), S.NO, "other_repository"),
        (F.col("document").isNull() | F.col("revision").isNull() | F.col("publisher").isNull() | F.col("collection").isNull(), S.UNRESOLVED, "registry_unknown"),
        (~anchored, S.NO, "other_anchor"),
    ]
    return j.select("declaration", first_of(*rules).alias("s")).select("declaration", "s.status", "s.reason")
