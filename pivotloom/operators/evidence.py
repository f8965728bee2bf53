"""Joins of evidence: bindings, optional bindings, support, ranges, suffixes, receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pivotloom.functions.identity import cidr, suffixes
from pivotloom.functions.status import NO, UNRESOLVED, YES


def bind(left: DataFrame, right: DataFrame, on: list[str], status: Column | None = None) -> DataFrame:
    """An ordered binding: equalities are join keys, other predicates a status column."""
    joined = left.join(right, on)
    return joined if status is None else joined.withColumn("status", status).filter(F.col("status") != NO)


def optional_binding(left: DataFrame, key: str, candidates: DataFrame, status: str = "status") -> DataFrame:
    """left with binding BOUND, UNRESOLVED or ABSENT, by its best candidate.

    Candidates are aggregated before the join, so a key with many of them stays one row.
    """
    best = candidates.groupBy(key).agg(F.count_if(F.col(status) == YES).alias("matches"), F.count_if(~F.col(status).isin(YES, NO)).alias("open"))
    joined = left.join(best, key, "left")
    state = F.when(F.col("matches") > 0, "BOUND").when(F.col("open") > 0, "UNRESOLVED").otherwise("ABSENT")
    return joined.withColumn("binding", state).withColumn("matches", F.coalesce("matches", F.lit(0))).drop("open")


def covers(parent: Column, field: Column) -> Column:
    """Whether a JSON pointer covers another."""
    return (parent == field) | F.startswith(field, F.concat(parent, F.lit("/")))


def with_context(records: DataFrame, bundles: DataFrame, key: str) -> DataFrame:
    """records with the collection_id of the bundle they came in, an operand like their own columns; null for an unknown bundle."""
    return records.join(bundles.select(key, "collection_id"), key, "left")


def source_supported(refs: DataFrame, record: str = "record_id", required: tuple[str, ...] = ("document", "revision", "collection")) -> DataFrame:
    """Per record whether it has references and all are fully named, with its sorted sources."""
    whole = F.lit(True)
    for c in required:
        whole = whole & F.col(c).isNotNull()
    return refs.groupBy(record).agg((F.count_if(~whole) == 0).alias("supported"), F.count(F.lit(1)).alias("refs"), F.array_join(F.sort_array(F.collect_set("source_id")), ",").alias("sources"))


def backed_value(values: DataFrame, links: DataFrame, record: str = "record_id") -> DataFrame:
    """match if exactly one linked source has the value's revision, none no_match, more unresolved."""
    hits = values.select(record, "revision").join(links, [record, "revision"], "left").groupBy(record, "revision").agg(F.count_distinct("source_id").alias("n"))
    return hits.withColumn("status", F.when(F.col("revision").isNull() | (F.col("n") > 1), UNRESOLVED).when(F.col("n") == 1, YES).otherwise(NO))


def in_prefix(addresses: DataFrame, ip: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Address rows with each prefix that holds them: an equi join on the masked address.

    An address stands once for each prefix length that occurs, of which there are at most 33.
    """
    p = prefixes.withColumn("_r", cidr(F.col(prefix))).filter("_r is not null")
    p = p.withColumn("_size", F.col("_r.last") - F.col("_r.first") + 1).withColumn("_base", F.col("_r.first")).drop("_r")
    sizes = [r["_size"] for r in p.select("_size").distinct().collect()]
    a = addresses.withColumn("_size", F.explode(F.array(*[F.lit(n) for n in sizes]).cast("array<bigint>"))) if sizes else addresses.withColumn("_size", F.lit(None).cast("long"))
    return a.withColumn("_base", F.col(ip) - F.pmod(F.col(ip), F.col("_size"))).join(p, ["_size", "_base"]).drop("_size", "_base")


def in_scope(names: DataFrame, name: str, scopes: DataFrame, scope: str) -> DataFrame:
    """Name rows with each scope they are or lie under: an equi join on parent names.

    A name whose leftmost label is `*` is a wildcard, kept apart in `wildcard`; its scopes are
    those of what stands behind the star.
    """
    star = F.startswith(F.col(name), F.lit("*."))
    bare = F.when(star, F.substring(F.col(name), F.lit(3), F.length(F.col(name)))).otherwise(F.col(name))
    return names.withColumn("wildcard", star).withColumn(scope, F.explode(suffixes(bare))).join(scopes, scope)


#: Profiles that give every entity a row.
PROFILES = 1000


def profile_matches(entities: DataFrame, key: str, values: DataFrame, criteria: DataFrame) -> DataFrame:
    """key, profile and status of every entity and profile: all criteria of the profile must match.

    values has key, field, value; criteria profile, field, kind (text: one of `allowed`;
    range: a number between low and high), each field once a profile. Values of one field
    are one criterion's status: match or no_match if all say so, unresolved if they differ, can't
    be read or aren't there. For very many profiles see `containment.matching_profiles`.
    """
    number = F.col("value").try_cast("double")
    test = F.when(F.col("kind") == "range", number.between(F.col("low"), F.col("high"))).otherwise(F.array_contains("allowed", F.col("value")))
    said = values.join(criteria, "field").withColumn("_t", test).groupBy(key, "profile", "field").agg(
        F.count_if(F.col("_t")).alias("_yes"), F.count_if(~F.col("_t")).alias("_no"), F.count_if(F.col("_t").isNull()).alias("_open"))
    open_ = (F.col("_open") > 0) | ((F.col("_yes") > 0) & (F.col("_no") > 0))
    said = said.withColumn("_s", F.when(open_, UNRESOLVED).when(F.col("_no") > 0, NO).otherwise(YES))
    met = said.groupBy(key, "profile").agg(F.count_if(F.col("_s") == NO).alias("_no"), F.count_if(F.col("_s") == YES).alias("_yes"))
    profiles = criteria.groupBy("profile").agg(F.count_distinct("field").alias("_wanted"))
    if profiles.count() > PROFILES:
        raise ValueError("too many profiles for a row of each; use containment.matching_profiles")
    each = entities.select(key).distinct().withColumn("profile", F.explode(F.array(*[F.lit(r["profile"]) for r in profiles.select("profile").collect()]).cast("array<string>")))
    j = each.join(profiles, "profile").join(met, [key, "profile"], "left")
    status = F.when(F.coalesce("_no", F.lit(0)) > 0, NO).when(F.coalesce("_yes", F.lit(0)) < F.col("_wanted"), UNRESOLVED).otherwise(YES)
    return j.select(key, "profile", status.alias("status"))


def received_claims(claims: DataFrame, receipts: DataFrame, key: str, cutoff: Column) -> DataFrame:
    """Claims with their first receipt between publication and the cutoff."""
    good = claims.join(receipts, key).filter((F.col("received") >= F.col("published")) & (F.col("received") <= cutoff))
    return good.groupBy(key, "published").agg(F.min("received").alias("received"))


def path_supported(supports: list[Column], evidence: Column) -> Column:
    """Whether every bound record of a path is supported and there is any evidence at all."""
    whole = evidence > 0
    for s in supports:
        whole = whole & F.coalesce(s, F.lit(False))
    return whole


def full_backing(witnesses: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Per witness match if one linked source has its revision, publisher and method, more unresolved."""
    on = [key, "revision", "publisher"]
    hits = witnesses.join(links.select(*on, "source_id", F.col("method").alias("_m")), on, "left")
    fits = F.col("source_id").isNotNull() & (F.col("_m").eqNullSafe(F.col("method")))
    n = hits.groupBy(*witnesses.columns).agg(F.count_distinct(F.when(fits, F.col("source_id"))).alias("sources"))
    return n.withColumn("status", F.when(F.col("sources") == 1, YES).when(F.col("sources") == 0, NO).otherwise(UNRESOLVED))
