"""Inquiries put together from the joins, times and claims of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pivotloom.functions import status as S
from pivotloom.functions import timeops as T
from pivotloom.operators import evidence as E
from pivotloom.operators.claims import amendment_state, ranked_results


def listed_counterparties(relations: DataFrame, listings: DataFrame, party: str, mode: str, period: Column, at: Column | None = None) -> DataFrame:
    """Relations to parties that are listed, by time.

    Relations carry an interval `state` or an instant `at`; listings an interval `listed`.
    Modes: retrospective (any time), historical_some and historical_all (the listing meets
    or covers the period), historical_at (the event lies in both). Open rows stay.
    """
    j = relations.join(listings, party)
    status = {
        "retrospective": lambda: F.lit(S.YES),
        "historical_some": lambda: T.within(F.col("listed"), period, "some", "state"),
        "historical_all": lambda: T.within(F.col("listed"), period, "all", "state"),
        "historical_at": lambda: T.within_at(T.interval(at, at, True, True), F.col("listed"), period),
    }[mode]()
    return j.withColumn("status", status).filter(F.col("status") != S.NO)


def listed_as_known(relations: DataFrame, listings: DataFrame, amendments: DataFrame, party: str, period: Column, at: Column, cutoffs: list[Column]) -> DataFrame:
    """Relations at an event with the listings as they were known at each of a few cutoffs.

    listings has the party, claim, `listed` and `known` (when it was received, null if that is
    unknown); amendments those of `claims.amendment_state`, by claim, with `received` in place
    of availability. A listing received later says nothing yet, one of unknown receipt leaves
    the relation open, as do contested and unresolved claims; a withdrawn or corrected one is
    no match. Open rows stay, those that don't match go.
    """
    each = F.explode(F.array(*cutoffs)).alias("cutoff")
    known = F.when(F.col("known").isNull(), S.UNRESOLVED).when(F.col("known") <= F.col("cutoff"), S.YES).otherwise(S.NO)
    seen = listings.select("*", each).withColumn("_known", known).filter(F.col("_known") != S.NO).withColumn("_c", F.struct("claim", "cutoff"))
    received = F.when(F.col("received").isNull(), S.UNSUPPORTED).when(F.col("received") <= F.col("cutoff"), S.YES).otherwise(S.NO)
    at_cutoff = lambda c: F.concat(F.col(c).cast("string"), F.lit("@"), F.col("cutoff").cast("string")).alias(c)
    told = amendments.select("*", each).select(at_cutoff("amendment_id"), at_cutoff("supersedes"), F.struct("claim", "cutoff").alias("_c"), "operation", "support", received.alias("available"))
    states = amendment_state(seen.select("_c").distinct(), told, "_c")
    standing = F.when(F.col("state").isin("unresolved_amendment_context", "contested"), S.UNRESOLVED).when(F.col("state").isin("withdrawn", "corrected"), S.NO).otherwise(S.YES)
    j = relations.join(seen.join(states, "_c"), party)
    status = S.all_of(T.within_at(T.interval(at, at, True, True), F.col("listed"), period), F.col("_known"), standing)
    return j.withColumn("status", status).filter(F.col("status") != S.NO).drop("_known", "_c")


def named_in_exchange(messages: DataFrame, names: DataFrame, exchange: list[str], at: str, seconds: int) -> DataFrame:
    """Messages with the names of the same exchange and leg, no further apart than so many seconds.

    An equi join on the exchange and a time bucket, so that a busy exchange is split.
    """
    width = seconds * 1_000_000
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    m = messages.withColumn("_m", us(at)).drop(at).withColumn("_bucket", F.floor(F.col("_m") / width))
    n = names.withColumn("_n", us(at)).drop(at).withColumn("_bucket", F.explode(F.array(*[F.floor(F.col("_n") / width) + i for i in (-1, 0, 1)])))
    return m.join(n, [*exchange, "_bucket"]).filter(F.abs(F.col("_m") - F.col("_n")) <= width).drop("_m", "_n", "_bucket")


def presentations(subjects: DataFrame, observations: DataFrame, key: str, period: Column) -> DataFrame:
    """Per subject and endpoint the observations in a period: first, last and count."""
    inside = observations.withColumn("_s", T.within(F.col("x"), period, "contained")).filter(F.col("_s") == S.YES)
    return subjects.join(inside, key).groupBy(key, "endpoint").agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"), F.count(F.lit(1)).alias("n"))


def first_complete_finding(parts: DataFrame, claim: str, required: int, as_of: Column, days: int) -> DataFrame:
    """Claims whose required distinct parts are all seen, with the day the last came, and novelty."""
    firsts = parts.groupBy(claim, "part").agg(F.min("seen").alias("seen"))
    whole = firsts.groupBy(claim).agg(F.count(F.lit(1)).alias("parts"), F.max("seen").alias("complete")).filter(F.col("parts") >= required)
    return whole.withColumn("novel", F.col("complete").between(F.date_sub(as_of, days), as_of))


def listing_assertions(addresses: DataFrame, prefixes: DataFrame, assertions: DataFrame) -> DataFrame:
    """Addresses to prefixes that hold them, to the assertions on these; publishers that speak only of single addresses don't apply."""
    held = E.in_prefix(addresses, "v", prefixes, "prefix")
    return held.join(assertions.filter("applies_to = 'all_addresses_in_prefix'"), "prefix_id")


def package_infrastructure(declared: DataFrame, used: DataFrame, key: str, as_of: Column, days: int) -> DataFrame:
    """Declarations that match with the infrastructure of their repository seen within the window.

    used has the repository, infrastructure and seen (date). Rows outside the window are kept
    apart by `inside`; a repository without any has one row without infrastructure.
    """
    found = declared.filter(F.col("status") == S.YES).join(used, key, "left")
    return found.withColumn("inside", F.coalesce(F.col("seen").between(F.date_sub(as_of, days), as_of), F.lit(False)))


def expanded_certificates(certificates: DataFrame, seeds: DataFrame, profiles: DataFrame, key: str, name: str, limit: int) -> DataFrame:
    """Certificates in a seed's scope whose profile matches, once for each seed: key, scope, wildcard, profile.

    Of each seed at most `limit` distinct certificates come, in order of their key, with the
    number there are; a certificate with several matching profiles has a row of each.
    """
    matching = profiles.filter(F.col("status") == S.YES).select(key, "profile")
    scoped = E.in_scope(certificates, name, seeds, "scope").select(key, "scope", "wildcard").distinct().join(matching.select(key).distinct(), key, "left_semi")
    return ranked_results(scoped, "scope", [F.col(key), F.col("wildcard")], limit).join(matching, key)


def signing_reports(files: DataFrame, signatures: DataFrame, key: str, at: Column) -> DataFrame:
    """Per file absent, present, reported or verified: the best of its signatures.

    A signature counts as present if its image digest is the file's by the same recipe, as
    reported if it names a signer, as verified if a report on it was valid at the time.
    """
    same = (F.col("image_recipe") == F.col("recipe")) & (F.col("image") == F.col("digest"))
    valid = F.col("signer").isNotNull() & F.coalesce((F.col("valid_from") <= at) & (at <= F.col("valid_to")), F.lit(False))
    rank = F.when(valid, 3).when(F.col("signer").isNotNull(), 2).otherwise(1)
    best = files.join(signatures, key).filter(same).groupBy(key).agg(F.max(rank).alias("rank"), F.count(F.lit(1)).alias("signatures"))
    j = files.select(key).join(best, key, "left")
    names = F.array(*[F.lit(x) for x in ("absent", "present", "reported", "verified")])
    return j.select(key, F.coalesce("signatures", F.lit(0)).alias("signatures"), F.element_at(names, F.coalesce("rank", F.lit(0)) + 1).alias("signing"))


def observed_once(observations: DataFrame, scope: list[str], endpoints: list[str]) -> DataFrame:
    """Per scope match if all observations agree on endpoints and time, each seen before it was available, else unresolved.

    observations has `x` and `available`. A copy without the first part of its scope, but with
    the others, may be one of any scope that has these, which leaves them open; it has no row.
    """
    first, rest = scope[0], scope[1:]
    late = F.count_if(F.col("available").isNull() | (F.col("x") > F.col("available")))
    same = observations.filter(F.col(first).isNotNull()).groupBy(*scope).agg(
        F.count_distinct(*endpoints).alias("endpoints"), F.count_distinct("x").alias("times"), F.count(F.lit(1)).alias("n"), late.alias("late"))
    copies = observations.filter(F.col(first).isNull()).select(*rest).distinct().withColumn("copied", F.lit(True))
    j = same.join(copies, rest, "left") if rest else same.withColumn("copied", F.lit(None).cast("boolean"))
    whole = (F.col("endpoints") == 1) & (F.col("times") == 1) & (F.col("late") == 0) & F.col("copied").isNull()
    return j.withColumn("status", F.when(whole, S.YES).otherwise(S.UNRESOLVED)).drop("late", "copied")


def shared_paths(members: DataFrame, key: str, chosen: DataFrame, field: str) -> DataFrame:
    """Sets that hold every chosen member."""
    n = chosen.select(field).distinct()
    have = members.join(n, field, "left_semi").groupBy(key).agg(F.count_distinct(field).alias("held"))
    return have.join(n.agg(F.count(F.lit(1)).alias("wanted")), F.col("held") == F.col("wanted")).select(key, "held")


def as_known(rows: DataFrame, key: str, known: str, cutoff: Column) -> DataFrame:
    """Per path match if all its knowledge times are by the cutoff, unsupported without any."""
    seen = rows.groupBy(key).agg(F.count(known).alias("declared"), F.max(known).alias("latest"))
    return seen.withColumn("status", F.when(F.col("declared") == 0, S.UNSUPPORTED).when(F.col("latest") <= cutoff, S.YES).otherwise(S.NO))
