"""Results of joins: constructed ids, parameter checks, reference closure, declarations, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pivotloom.functions import status as S
from pivotloom.operators.merkle import member_hash, member_text, roots
from pivotloom.operators.pivot import PivotSpec, alternatives


def construct(rows: DataFrame, prefix: str, form: str, identity: list[str]) -> DataFrame:
    """rows with a result_id from their identity; rows that lack a part of it go."""
    whole = F.lit(True)
    for c in identity:
        whole = whole & (F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) > 0)
    key = member_text([F.lit(form), *[F.col(c) for c in identity]])
    return rows.filter(whole).withColumn("result_id", F.concat(F.lit(prefix), F.sha2(key, 256)))


def parameter_faults(seeds: DataFrame, known: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """key and fault of seeds that are missing, of another kind, repeated or unknown."""
    faults = F.filter(F.array(F.when(F.col(key).isNull(), "missing"), F.when(~F.col("kind").isin(kinds), "kind")), lambda x: x.isNotNull())
    own = seeds.select(key, F.explode(faults).alias("fault"))
    repeated = seeds.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key, F.lit("repeated").alias("fault"))
    unknown = seeds.filter(F.col(key).isNotNull()).select(key).distinct().join(known, key, "left_anti").select(key, F.lit("unknown").alias("fault"))
    return own.unionByName(repeated).unionByName(unknown)


def rule_faults(parameters: DataFrame, key: str, rules: dict[str, dict], keys: DataFrame | None = None) -> DataFrame:
    """key, name and fault of sets of query parameters (key, name, items) that break their rules.

    A rule may say required, enum (allowed items), min_items, unique, requires_when and
    allowed_when (a pair of another parameter's name and an item it must hold). Parameters
    without a rule are `unknown`; one given twice is `given_twice`, and judged by all its items.
    `keys` names the sets, so that those without parameters are judged too. A set has few
    parameters, so they meet in one map.
    """
    each = parameters.groupBy(key, "name").agg(F.flatten(F.collect_list(F.coalesce("items", F.array().cast("array<string>")))).alias("items"), F.count(F.lit(1)).alias("times"))
    sets = each.filter("name is not null").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "items"))).alias("p"))
    if keys is not None:
        sets = keys.select(key).distinct().join(sets, key, "left").withColumn("p", F.coalesce("p", F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<array<string>>))")))
    items = lambda name: F.coalesce(F.try_element_at("p", F.lit(name)), F.array().cast("array<string>"))
    holds = lambda pair: F.array_contains(items(pair[0]), pair[1])
    found = []
    for name, rule in rules.items():
        own, there = items(name), F.size(items(name)) > 0
        broken = {}
        if rule.get("required"):
            broken["missing"] = ~there
        if "requires_when" in rule:
            broken["missing_here"] = holds(rule["requires_when"]) & ~there
        if "allowed_when" in rule:
            broken["not_allowed"] = there & ~holds(rule["allowed_when"])
        if "enum" in rule:
            broken["enum"] = F.size(F.array_except(own, F.array(*[F.lit(x) for x in rule["enum"]]))) > 0
        if "min_items" in rule:
            broken["too_few"] = there & (F.size(own) < rule["min_items"])
        if rule.get("unique"):
            broken["repeated"] = F.size(F.array_distinct(own)) < F.size(own)
        found += [F.when(test, F.struct(F.lit(name).alias("name"), F.lit(fault).alias("fault"))) for fault, test in broken.items()]
    own = sets.select(key, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f")).select(key, "f.name", "f.fault")
    stray = parameters.filter(~F.col("name").isin(*rules)).select(key, "name", F.lit("unknown").alias("fault"))
    twice = each.filter("times > 1").select(key, "name", F.lit("given_twice").alias("fault"))
    return own.unionByName(stray).unionByName(twice)


def run_outcome(rows: DataFrame, seed: str, limit: int) -> DataFrame:
    """Per seed the outcome of a run and its counters: examined, qualified, returned, truncated.

    rows has the seed, `qualified`, and the diagnostic `status` of what isn't, or null, with
    `optional` for context that isn't required. Gaps of optional context qualify a result; of
    a seed without results the gravest required status decides.
    """
    said = lambda *values: F.coalesce(F.max(F.col("status").isin(*values)), F.lit(False))
    needed = lambda value: F.coalesce(F.max((F.col("status") == value) & ~F.col("optional")), F.lit(False))
    grave = ("unsupported", "unresolved", "suppressed", "outside_scope")
    seen = rows.groupBy(seed).agg(
        F.count(F.lit(1)).alias("examined"), F.count_if("qualified").alias("qualified"), said("unresolved", "unsupported").alias("gaps"), *[needed(x).alias(x) for x in grave])
    outcome = F.when((F.col("qualified") > 0) & ~F.col("gaps"), "qualified_evidence").when(F.col("qualified") > 0, "qualified_evidence_with_gaps")
    for x in grave:
        outcome = outcome.when(F.col(x), x)
    return seen.select(seed, "examined", "qualified", F.least("qualified", F.lit(limit)).alias("returned"), (F.col("qualified") > limit).alias("truncated"), outcome.otherwise("no_qualifying_result").alias("outcome"))


def open_references(objects: DataFrame) -> DataFrame:
    """id and ref of references to objects that aren't there; `refs` is an array."""
    wanted = objects.select("id", F.explode("refs").alias("ref"))
    return wanted.join(objects.select(F.col("id").alias("ref")).distinct(), "ref", "left_anti").select("id", "ref")


def identity_faults(objects: DataFrame) -> DataFrame:
    """id and fault of exported objects: `repeated` ids with different content, and `open` references."""
    twice = objects.groupBy("id").agg((F.min(F.sha2("json", 256)) < F.max(F.sha2("json", 256))).alias("differ")).filter("differ").select("id", F.lit("repeated").alias("fault"))
    return twice.unionByName(open_references(objects).select("id", F.lit("open").alias("fault")).distinct())


IDENTITY = r"^identity--[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
INSTANT = r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d\.\d{3,}Z$"


def creator_faults(objects: DataFrame, key: str, own_prefix: str = "x_") -> DataFrame:
    """key and fault of exports whose creator isn't declared as it must be.

    objects has the export's key, `expected` (the declared creator's id), id, type and json.
    Faults: identities (not just one), ref_shape, ref_dangling, ref_type and ref_other of an
    extension's creator; creator_other, spec_version, name, class, evidence (extensions or own
    fields), created, modified and order of an identity.
    """
    field = lambda name: F.get_json_object("json", f"$.{name}")
    blank = lambda c: F.coalesce(F.length(F.trim(c)) == 0, F.lit(True))
    said = lambda tests: F.explode(F.filter(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(f)) for f, t in tests.items()]), lambda x: x.isNotNull())).alias("fault")
    counts = objects.groupBy(key).agg(F.count_if(F.col("type") == "identity").alias("n")).filter("n <> 1").select(key, F.lit("identities").alias("fault"))
    ids = objects.select(key, F.col("id").alias("ref"), F.col("type").alias("ref_type")).dropDuplicates([key, "ref"])
    ext = objects.filter("type = 'extension-definition'").select(key, "expected", field("created_by_ref").alias("ref")).join(ids, [key, "ref"], "left")
    good = F.coalesce(F.col("ref").rlike(IDENTITY), F.lit(False))
    of_ext = ext.select(key, said({"ref_shape": ~good, "ref_dangling": good & F.col("ref_type").isNull(), "ref_type": good & F.coalesce(F.col("ref_type") != "identity", F.lit(False)), "ref_other": ~F.col("ref").eqNullSafe(F.col("expected"))}))
    names = F.coalesce(F.json_object_keys("json"), F.array().cast("array<string>"))
    at = lambda c: F.when(field(c).rlike(INSTANT), F.try_to_timestamp(field(c)))
    of_identity = objects.filter("type = 'identity'").select(key, said({
        "creator_other": ~F.col("id").eqNullSafe(F.col("expected")), "spec_version": field("spec_version") != "2.1", "name": blank(field("name")), "class": field("identity_class") != "group",
        "evidence": F.exists(names, lambda n: (n == "extensions") | F.startswith(n, F.lit(own_prefix))), "created": at("created").isNull(), "modified": at("modified").isNull(),
        "order": F.coalesce(at("modified") < at("created"), F.lit(False))}))
    return counts.unionByName(of_ext).unionByName(of_identity)


#: Roles of an expected traversal whose candidates must be joined too.
JOINED_ROLES = ("weak_positive", "cautionary_positive", "high_cardinality")


def topology_faults(nodes: DataFrame, edges: DataFrame, expected: DataFrame, spec: PivotSpec) -> DataFrame:
    """start, target and fault of expected traversals (start, target, list, role) that the graph doesn't bear out.

    Lists are included, suppressed and candidate. Faults: start_form and target_form, no_hop
    (an included or suppressed target, or a candidate of a positive role, isn't joined),
    unexpected_hop (a candidate of the negative role is), lists_overlap (a target on two lists).
    """
    hop = spec.hops[0]
    ends = ("src", "dst") if hop.direction == "out" else ("dst", "src")
    hops = edges.filter(F.col("relation").isin(alternatives(hop.relation))).select(F.col(ends[0]).alias("start"), F.col(ends[1]).alias("target")).distinct().withColumn("hop", F.lit(True))
    good = lambda forms, name: nodes.filter(F.col("form").isin(alternatives(forms))).select(F.col("id").alias(name), F.lit(True).alias(f"{name}_ok"))
    j = expected.join(hops, ["start", "target"], "left").join(good(spec.source, "start"), "start", "left").join(good(hop.form, "target"), "target", "left")
    there = F.coalesce("hop", F.lit(False))
    needed = (F.col("list") != "candidate") | F.col("role").isin(*JOINED_ROLES)
    faults = F.filter(F.array(
        F.when(F.col("start_ok").isNull(), "start_form"), F.when(F.col("target_ok").isNull(), "target_form"), F.when(needed & ~there, "no_hop"),
        F.when(there & (F.col("list") == "candidate") & (F.col("role") == "negative"), "unexpected_hop"),
    ), lambda x: x.isNotNull())
    twice = expected.groupBy("start", "target").agg(F.count_distinct("list").alias("n")).filter("n > 1").select("start", "target", F.lit("lists_overlap").alias("fault"))
    return j.select("start", "target", F.explode(faults).alias("fault")).unionByName(twice)


def declarations(declared: DataFrame, packages: DataFrame, repositories: DataFrame) -> DataFrame:
    """Package to repository declarations with a status: the versions must agree, a missing one leaves it open."""
    j = declared.join(packages, "package").join(repositories, "repository")
    return j.withColumn("status", S.all_of(S.equal(F.col("declared_version"), F.col("version")), S.known(F.col("registry") == F.col("source_registry"), F.col("registry"), F.col("source_registry"))))


def history_gate(establishments: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Per claim whether its declared history is whole, with n and digest of its establishments.

    establishments has the claim, item and at; manifest one row a claim with coverage, the
    digest of its listed items, origin and through. `invalid`: the declared digest isn't that
    of the establishments, though their number is as declared, or the coverage ends before its
    origin; unresolved: no establishment is there, some are unlisted or missing, or the
    coverage isn't declared complete; no_match: one lies outside origin and through.
    """
    items = establishments.select(key, member_hash(["item", "at"]).alias("h"))
    times = establishments.groupBy(key).agg(F.min("at").alias("low"), F.max("at").alias("high"))
    j = manifest.join(roots(items, key), key, "left").join(times, key, "left")
    inside = (F.col("low") >= F.col("origin")) & (F.col("high") <= F.col("through"))
    status = (
        F.when(F.col("origin") > F.col("through"), "invalid").when(F.col("n").isNull() | (F.col("n") != F.col("declared")), S.UNRESOLVED)
        .when(F.col("digest") != F.col("declared_digest"), "invalid").when(F.col("coverage") != "complete_declared_scope", S.UNRESOLVED)
        .when(inside, S.YES).otherwise(S.NO)
    )
    return j.withColumn("status", status)


def establishment_supported(claims: DataFrame, support: DataFrame, qualified: DataFrame, key: str, item: str, at: Column) -> DataFrame:
    """Claims whose support is just the qualified set, and was all available by their establishment.

    Another set, or a support without a known availability, leaves it open.
    """
    both = support.select(key, item, "available", F.lit(1).alias("s")).join(qualified.select(key, item).distinct().withColumn("q", F.lit(1)), [key, item], "full").join(claims, key)
    seen = both.groupBy(key).agg(
        F.count("s").alias("support"), F.count_if(F.col("s").isNull() | F.col("q").isNull()).alias("differing"), F.count_if(F.col("s").isNotNull() & (F.col("available") > at)).alias("late"),
        F.count_if(F.col("s").isNotNull() & F.col("available").isNull()).alias("open"))
    return seen.withColumn("status", F.when((F.col("differing") > 0) | (F.col("open") > 0), S.UNRESOLVED).when(F.col("late") == 0, S.YES).otherwise(S.NO))


def snapshot_consistency(entries: DataFrame, key: str, path: str, declared: DataFrame) -> DataFrame:
    """Per snapshot whether its paths are unique and its commit and number agree with the declaration."""
    seen = entries.groupBy(key).agg(F.count(F.lit(1)).alias("entries"), F.count_distinct(path).alias("paths"), F.count_distinct("commit").alias("commits"), F.max("commit").alias("commit"))
    j = declared.join(seen, key, "left")
    same = (F.col("entries") == F.col("paths")) & (F.col("commits") == 1) & (F.col("commit") == F.col("declared_commit"))
    return j.withColumn("status", F.when(F.col("entries").isNull() | F.col("declared_commit").isNull(), S.UNRESOLVED).when(same, S.YES).otherwise(S.NO))
