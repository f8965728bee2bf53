"""Policies, amendments, findings and sets over groups of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def amendment_state(claims: DataFrame, amendments: DataFrame, key: str) -> DataFrame:
    """Per claim reported, withdrawn, corrected, contested or unresolved_amendment_context.

    amendments has amendment_id, the claim's key, operation (withdraw, correct, dispute or
    reinstate), supersedes (an amendment_id or null) and the statuses `support` and
    `available`. One counts if both match; one received later is no gap, any other open
    status is one. Those that a counting one supersedes fall away. A dispute contests a
    claim, as does a reinstatement beside a standing withdrawal or correction.
    """
    active = amendments.filter("support = 'match' and available = 'match'")
    gone = active.select(F.col("supersedes").alias("amendment_id")).filter("amendment_id is not null").distinct()
    has = lambda *ops: F.max(F.col("operation").isin(*ops))
    standing = active.join(gone, "amendment_id", "left_anti").groupBy(key).agg(
        has("dispute").alias("d"), has("reinstate").alias("r"), has("withdraw").alias("w"), has("correct").alias("c"))
    open_ = amendments.filter("support <> 'match' or support is null or available in ('unresolved', 'unsupported') or available is null").select(key).distinct()
    j = claims.join(standing, key, "left").join(open_.withColumn("u", F.lit(True)), key, "left")
    d, r, w, c = (F.coalesce(x, F.lit(False)) for x in "drwc")
    state = (
        F.when(F.col("u"), "unresolved_amendment_context").when(d | (r & (w | c)), "contested")
        .when(c, "corrected").when(w, "withdrawn").otherwise("reported")
    )
    return j.withColumn("state", state).drop("d", "r", "w", "c", "u")


OPEN_STATES, ENDED_STATES = ("unresolved_amendment_context", "contested"), ("corrected", "withdrawn")


def amendment_support(states: DataFrame, path: str) -> DataFrame:
    """Per path of several claims whether its support is unwithdrawn, and whether there are gaps."""
    gaps, ended = F.max(F.col("state").isin(*OPEN_STATES)), F.max(F.col("state").isin(*ENDED_STATES))
    out = states.groupBy(path).agg(gaps.alias("has_gaps"), ended.alias("_ended"))
    return out.select(path, "has_gaps", F.when(F.col("has_gaps"), "unresolved").when(F.col("_ended"), "no_match").otherwise("match").alias("support_status"))


def amendment_filter(rows: DataFrame, mode: str, enabled: Column, excluded: tuple[str, ...] = ENDED_STATES) -> DataFrame:
    """rows (state, support_status) with disposition and returned.

    Mode retain_reports keeps every report, require_unwithdrawn_in_scope only those whose
    support matches. Of what is kept, an enabled exclusion suppresses the excluded states and
    leaves open ones unresolved.
    """
    kept = F.lit(True) if mode == "retain_reports" else F.col("support_status") == "match"
    chosen = (
        F.when(~enabled, "not_selected").when(F.col("state").isin(*OPEN_STATES), "unresolved")
        .when(F.col("state").isin(*excluded), "suppressed").otherwise("retained_in_supplied_scope")
    )
    rows = rows.withColumn("disposition", F.when(kept, chosen).otherwise(F.col("support_status")))
    return rows.withColumn("returned", F.col("disposition").isin("not_selected", "retained_in_supplied_scope"))


def policy_statuses(rows: DataFrame) -> DataFrame:
    """rows with applied, when, allow and conflict as an enabled policy sees them.

    Rows of a disabled policy go. One that doesn't apply excludes nothing and clears nothing;
    an open application leaves when and allow open; an unknown partition leaves all open.
    """
    rows = rows.filter("enabled")
    no_part, applies = F.col("part_key").isNull(), F.col("applies")
    when = F.when(applies == "no_match", "no_match").when(no_part, "unresolved").when(applies != "match", applies).otherwise(F.col("when"))
    allow = F.when(applies == "no_match", "match").when(no_part, "unresolved").when(applies != "match", applies).otherwise(F.col("allow"))
    conflict = F.when(applies == "no_match", "no_match").when(no_part, "unresolved").otherwise(F.col("conflict"))
    return rows.withColumns({"when": when, "allow": allow, "conflict": conflict, "applied": applies != "no_match"})


def resolve_policies(rows: DataFrame, group: str, scope: str, partial: str | None = None) -> DataFrame:
    """rows with decision kept, suppressed, contested or unresolved.

    Columns when, allow and conflict hold statuses. A group is contested if both sides or a
    conflict match, and unresolved if its decision is open or a search for it was cut
    (`partial`). One suppressing group removes every row of its scope, in other groups too.
    A row whose policy isn't applicable (`applied` false) is a group of its own: it says
    nothing on others, but goes with its scope like them. An unknown scope is a scope too.
    """
    has = lambda c, *values: F.count_if(F.col(c).isin(*values)) > 0
    open_ = ("unresolved", "unsupported")
    cut = F.coalesce(F.max(partial), F.lit(False)) if partial else F.max(F.lit(False))
    applied = F.coalesce("applied", F.lit(True)) if "applied" in rows.columns else F.lit(True)
    groups = rows.filter(applied).groupBy(group, scope).agg(has("when", "match").alias("w"), has("allow", "match").alias("a"), has("conflict", "match").alias("x"), has("when", *open_).alias("u"), cut.alias("p"))
    verdict = F.when(F.col("x") | (F.col("w") & F.col("a")), "contested").when(F.col("p"), "unresolved").when(F.col("w"), "suppress").when(F.col("u"), "unresolved").otherwise("keep")
    groups = groups.withColumn("verdict", verdict)
    scopes = groups.groupBy(F.col(scope).alias("_s")).agg((F.count_if(F.expr("verdict = 'suppress'")) > 0).alias("gone"))
    same = groups.select(F.col(group).alias("_g"), F.col(scope).alias("_s"), "verdict")
    own = applied & F.col(group).eqNullSafe(F.col("_g")) & F.col(scope).eqNullSafe(F.col("_s"))
    decided = rows.join(same, own, "left").drop("_g", "_s").join(scopes, F.col(scope).eqNullSafe(F.col("_s")), "left").drop("_s")
    decision = F.when(F.col("gone"), "suppressed").when(F.coalesce("verdict", F.lit("keep")) == "keep", "kept").otherwise(F.col("verdict"))
    return decided.withColumn("decision", decision).drop("verdict", "gone")


def required_controls(decided: DataFrame) -> DataFrame:
    """decided rows with `control`: withheld (unsupported or unresolved) where a required policy isn't cleared.

    Cleared means that its decision is no match and its allowance a match; a contested or cut
    group has an open decision. Suppressed rows are out before that.
    """
    decision = F.when(F.col("decision").isin("contested", "unresolved"), "unresolved").otherwise(F.col("when"))
    whole = (decision == "no_match") & (F.col("allow") == "match")
    open_ = F.when((decision == "unsupported") | (F.col("allow") == "unsupported"), "unsupported").otherwise("unresolved")
    return decided.withColumn("control", F.when(F.col("decision") == "suppressed", "suppressed").when(~F.col("required") | whole, "returned").otherwise(open_))


def earliest(rows: DataFrame, key: str, lo: str, hi: str, order: str) -> DataFrame:
    """Per claim the establishment no later than every other, or a row marked unresolved.

    A row is earliest if its upper bound isn't above the lower bound of any other. Only the row
    of the smallest upper bound can be, or one that ties with it on both bounds, of which the
    smallest in `order` is taken; so two aggregates suffice, one of them without that row. A row
    without an upper bound isn't earliest, one without a lower bound leaves all open.
    """
    bounded = F.when(F.col(lo).isNotNull() & F.col(hi).isNotNull(), F.struct(hi, lo, order))
    firsts = rows.groupBy(key).agg(F.min(bounded).alias("m"), F.count(F.lit(1)).alias("n"))
    others = rows.join(firsts.select(key, "m"), key).filter(F.col(order) != F.col(f"m.{order}")).groupBy(key).agg(F.min(lo).alias("other_lo"), F.count_if(F.col(lo).isNull()).alias("open"))
    j = firsts.join(others, key, "left")
    ok = F.coalesce(F.col(f"m.{hi}") <= F.coalesce(F.col("other_lo"), F.col(f"m.{hi}")), F.lit(False))
    ok = ok & (F.coalesce("open", F.lit(0)) == 0)
    return j.select(key, F.when(ok, F.col(f"m.{order}")).alias("earliest"), F.when(ok, "resolved").otherwise("unresolved").alias("status"), "n")


def novelty(rows: DataFrame, key: str, at: str, start: Column, end: Column) -> DataFrame:
    """First and last seen per claim, and whether the first lies in the period."""
    seen = rows.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))
    return seen.withColumn("novel", F.col("first_seen").between(start, end))


def visit_priority(at: Column, start: Column, end: Column) -> Column:
    """0 for what lies in the focus, 1 outside it, 2 undated."""
    return F.when(at.isNull(), 2).when(at.between(start, end), 0).otherwise(1)


def ranked_results(rows: DataFrame, seed: str, order: list[Column], limit: int) -> DataFrame:
    """Candidates of a seed within its budget, with a mark on seeds that were cut."""
    w = Window.partitionBy(seed)
    total = rows.groupBy(seed).agg(F.count(F.lit(1)).alias("candidates"))
    kept = rows.withColumn("place", F.row_number().over(w.orderBy(*order))).filter(F.col("place") <= limit)
    return kept.join(total, seed).withColumn("partial", F.col("candidates") > limit)


def later_equivalents(chosen: DataFrame, open_rows: DataFrame, key: str) -> DataFrame:
    """chosen (key, hi) with match if every open equivalent (key, lo) is provably later, else unresolved."""
    first_open = open_rows.groupBy(key).agg(F.min("lo").alias("open_lo"))
    j = chosen.join(first_open, key, "left")
    return j.withColumn("status", F.when(F.col("open_lo").isNull() | (F.col("hi") < F.col("open_lo")), "match").otherwise("unresolved")).drop("open_lo")


def supported_amendments(amendments: DataFrame, claims: DataFrame, key: str, cyclic: DataFrame | None = None) -> DataFrame:
    """amendments with a status against their claims (key, publisher, namespace).

    amendments has an id, the claim's key, operation, issuer_linked, publisher, namespace,
    replacement (a claim's key), issued and supersedes (an id or null). An unknown claim or
    operation, a replacement beside another operation than correct, or a claim of `cyclic` is
    invalid. Open stays one whose issuer isn't linked, whose namespace is missing or another,
    whose publisher is (but for a dispute), whose correction has no other claim of the same
    publisher and namespace to put in place, or that supersedes what isn't another amendment of
    its claim by its publisher in its namespace, or what was issued after it.
    """
    of = lambda name, prefix: claims.select(F.col(key).alias(name), F.col("publisher").alias(f"{prefix}p"), F.col("namespace").alias(f"{prefix}n"), F.lit(True).alias(f"{prefix}there"))
    old = amendments.select(F.col("id").alias("supersedes"), F.col(key).alias("_oc"), F.col("publisher").alias("_op"), F.col("namespace").alias("_on"), F.col("issued").alias("_oi")).dropDuplicates(["supersedes"])
    bad = (cyclic if cyclic is not None else claims.limit(0)).select(key).distinct().withColumn("_cyclic", F.lit(True))
    j = amendments.join(of(key, "_"), key, "left").join(of("replacement", "_r"), "replacement", "left").join(old, "supersedes", "left").join(bad, key, "left")
    op, known = F.col("operation"), F.col("operation").isin("withdraw", "correct", "dispute", "reinstate")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    replaced = same("_rp", "publisher") & same("_rn", "namespace") & (F.col("replacement") != F.col(key))
    chronology = F.coalesce(F.col("_oi") <= F.col("issued"), F.lit(True))
    superseding = F.col("supersedes").isNull() | (same("_oc", key) & same("_op", "publisher") & same("_on", "namespace") & (F.col("supersedes") != F.col("id")) & chronology)
    whole = F.col("issuer_linked") & same("namespace", "_n") & ((op == "dispute") | same("publisher", "_p")) & ((op != "correct") | F.coalesce(replaced, F.lit(False))) & superseding
    invalid = F.col("_there").isNull() | F.col("_cyclic") | ~F.coalesce(known, F.lit(False)) | (F.col("replacement").isNotNull() & (op != "correct"))
    hidden = ["_p", "_n", "_there", "_rp", "_rn", "_rthere", "_oc", "_op", "_on", "_oi", "_cyclic"]
    return j.withColumn("status", F.when(invalid, "invalid").when(whole, "match").otherwise("unresolved")).drop(*hidden)
