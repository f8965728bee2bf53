"""Inquiries that bind a result to the very subject asked about: officers, requests, creatives, kits.

Every step is an equi join on the whole identity of what must be the same; what says something
on a subject (exclusions, controls, purposes, baselines) is reduced to one row a subject before
it is joined, so a subject with very many of them is added up before the shuffle. Rows that
can't match go, open ones stay and say so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pivotloom.functions import identity as I
from pivotloom.functions import status as S
from pivotloom.functions import timeops as T
from pivotloom.operators import claims as G
from pivotloom.operators import merkle as M
from pivotloom.sources.shared import near

# The roles, stages and kinds of evidence that qualify.
OFFICES = ("officer", "director")
REFERENCE_ROLES = ("delivery_endpoint", "impression_endpoint", "click_endpoint", "navigation", "campaign_identifier")
REQUEST_STAGES = ("initiated_attempt", "proxy_observed_request", "server_received", "responded", "completed_delivery")
SERVING_STAGES = ("served", "installed_serving_context")
SERVING_ROLES = ("delivery_endpoint", "installed_serving_endpoint")
SERVING_EVIDENCE = ("preserved_historical_report", "content_bearing_pcap", "server_resource_log", "client_network_capture")


def disposed(rows: DataFrame, key: list[str], says: str, against: str, clears: str) -> DataFrame:
    """Per key `control`: suppressed or kept where one side alone speaks, unresolved where both do or anything else does."""
    a, c = (F.count_if(F.col(says) == side) > 0 for side in (against, clears))
    other = F.count_if(F.coalesce(~F.col(says).isin(against, clears), F.lit(True))) > 0
    control = F.when(other | (a & c), S.UNRESOLVED).when(a, "suppressed").otherwise("kept")
    return rows.groupBy(*key).agg(control.alias("control"))


def _whole(x: Column) -> Column:
    """An interval with both ends; a missing end isn't taken for endless."""
    return F.when(x["lo"].isNotNull() & x["hi"].isNotNull(), x)


# appointments --------------------------------------------------------------------------


def officer_appointments(persons: DataFrame, organisations: DataFrame, appointments: DataFrame, services: DataFrame, period: Column, exclusions: DataFrame | None = None) -> DataFrame:
    """Organisations that persons were appointed to: person, org, appointment, service, status and control.

    persons and organisations have person or org and scope; appointments appointment, person,
    org, role, person_scope and org_scope; services appointment, service, `held` (an interval,
    null for a dated status), `at` and `known` (intervals) and `active`. Only a person's own
    appointments count, as officer or director, with the scopes that both sides have. Service is
    held in a part of the period, or an active status in it that was known no earlier than it
    was. exclusions (appointment, disposition, x) are an analyst's choice: they exclude or
    retain if they cover the period, or hold at the status; what none retains is unresolved.
    """
    own = appointments.filter(F.col("role").isin(*OFFICES)).join(persons.select("person", F.col("scope").alias("person_scope")), ["person", "person_scope"])
    own = own.join(organisations.select("org", F.col("scope").alias("org_scope")), ["org", "org_scope"]).select("person", "org", "appointment", "role")
    held, at = F.col("held"), F.col("at")
    dated = S.all_of(S.known(F.col("active"), F.col("active")), T.within(at, period, "contained"), T.compare(at, F.col("known"), "lte"))
    status = F.when(held.isNotNull(), T.within(_whole(held), period, "some", "state")).otherwise(dated)
    found = own.join(services, "appointment").withColumn("status", status).filter(F.col("status") != S.NO)
    if exclusions is None:
        return found.select("person", "org", "appointment", "role", "service", "status", F.lit("not_selected").alias("control"))
    said = found.select("appointment", "service", "held", "at").distinct().join(exclusions.select("appointment", "disposition", "x"), "appointment")
    x = _whole(F.col("x"))
    applies = F.when(held.isNotNull(), T.within(x, period, "all", "state")).otherwise(T.within_at(at, x, period))
    said = said.withColumn("_a", applies).filter(F.col("_a") != S.NO).withColumn("_d", F.when(F.col("_a") == S.YES, F.col("disposition")).otherwise(S.UNRESOLVED))
    control = disposed(said, ["appointment", "service"], "_d", "exclude", "retain")
    return found.join(control, ["appointment", "service"], "left").select("person", "org", "appointment", "role", "service", "status", F.coalesce("control", F.lit(S.UNRESOLVED)).alias("control"))


# requests and the phases of their endpoints ----------------------------------------------


def phase_comparisons(requests: DataFrame, phases: DataFrame, roles: DataFrame, period: Column, vocabulary: Column) -> DataFrame:
    """Requests' phases against the roles of their endpoint: phase_id, request, role, outcome, contrary.

    requests has request, at (an instant) and the scope endpoint, method, tenant, version;
    phases phase_id, request, phase, input, how (request_trace, page_start, page_complete),
    boundary (the page's start or end; null for a trace) and traced; roles role, the scope,
    phases, exclusive, applicable, input and support. A role that allows other phases alone is
    a mismatch if no role that names the phase applies, contested if one does, unresolved if one
    may; one that names the phase beside others is compatible with it. `contrary` counts the
    roles that name the phase. A role that rests on the phase's own input says nothing.
    """
    at, scope = F.col("at"), ["endpoint", "method", "tenant", "version"]
    boundary = F.when(F.col("how") == "request_trace", S.YES).when(F.col("how").isin("page_start", "page_complete"), T.compare(F.col("boundary"), at, "lte")).otherwise(S.UNSUPPORTED)
    own = S.all_of(T.within(at, period, "contained"), S.known(F.col("traced"), F.col("traced")), boundary, S.is_in(F.col("phase"), vocabulary))
    asked = requests.join(phases, "request").withColumn("_own", own).filter(F.col("_own") != S.NO)
    said = roles.select(*scope, "role", "exclusive", "applicable", F.col("phases").alias("_phases"), F.col("input").alias("_input"), "support")
    holds = F.array_contains("_phases", F.col("phase"))
    applies = S.all_of(T.within(at, _whole(F.col("applicable")), "contained"), F.col("support"))
    pairs = asked.join(said, scope).select("phase_id", "request", "role", "exclusive", "_own", holds.alias("_holds"), applies.alias("_applies"), S.unequal(F.col("_input"), F.col("input")).alias("_apart"), S.all_in(F.col("_phases"), vocabulary).alias("_finite"))
    pairs = pairs.filter(F.col("_applies") != S.NO)
    sure = F.count_if(F.col("_applies") == S.YES)
    contrary = pairs.filter("_holds").groupBy("phase_id").agg(sure.alias("sure"), (F.count(F.lit(1)) - sure).alias("unsure"))
    against, beside = F.col("exclusive") & ~F.col("_holds"), ~F.col("exclusive") & F.col("_holds")
    status = S.all_of(F.col("_own"), F.col("_applies"), F.col("_apart"), F.col("_finite"))
    j = pairs.withColumn("_s", status).filter(F.col("_s") != S.NO).filter(F.coalesce(against | beside, F.lit(True))).join(contrary, "phase_id", "left")
    sure, unsure = F.coalesce("sure", F.lit(0)), F.coalesce("unsure", F.lit(0))
    alone = S.binding_absent(sure, unsure, F.lit(True))
    outcome = (
        F.when((F.col("_s") != S.YES) | (against | beside).isNull(), S.UNRESOLVED).when(beside, "compatible")
        .when(alone == S.YES, "mismatch").when(alone == S.NO, "contested").otherwise(S.UNRESOLVED)
    )
    return j.select("phase_id", "request", "role", outcome.alias("outcome"), (sure + unsure).alias("contrary"))


# creatives -----------------------------------------------------------------------------


def creative_findings(captures: DataFrame, scripts: DataFrame, references: DataFrame, requests: DataFrame, correspondences: DataFrame, controls: DataFrame, lists: list[str], period: Column) -> DataFrame:
    """URIs that creatives refer to or ask for, one row a finding: its parts, form, control, earliest, status and novelty.

    captures has capture and input (the capture's own digest); scripts capture and input (the
    digest of a script that the capture embeds); references capture, input, uri, role,
    establishment and x; requests request, capture, uri, stage, traced; correspondences capture,
    input, request, establishment and x. What stands in a shared script belongs to a capture
    only by rows that name this capture. A finding is its kind, capture, input, URI and role, or
    request and stage; it is novel if its earliest establishment lies in the period. A finding's
    establishments meet in one task, and lie on disk there if they are very many. A host
    name needs a positive absence from each of `lists` (controls: host, list, says member or
    nonmember), an address none; a URI that is no address on the web is a generic reference.
    """
    inputs = captures.select("capture", "input", F.lit(True).alias("direct")).unionByName(scripts.select("capture", "input", F.lit(False).alias("direct"))).groupBy("capture", "input").agg(F.max("direct").alias("direct"))
    parts = ["kind", "capture", "input", "uri", "request", "what"]
    sent = [*parts[1:], "establishment", "lo", "hi", F.col("x.lo_inc").alias("lo_inc"), F.col("x.hi_inc").alias("hi_inc"), "wide"]
    said = references.filter(F.col("role").isin(*REFERENCE_ROLES)).withColumn("request", F.lit(None).cast("string")).withColumnRenamed("role", "what")
    asked = correspondences.join(requests.filter(F.col("stage").isin(*REQUEST_STAGES) & F.col("traced")), ["capture", "request"]).withColumnRenamed("stage", "what").withColumn("request", F.col("request").cast("string"))
    # bounds of 18 digits are sent as they fit in a word, others as they are
    word = {c: F.col(f"x.{c}").try_cast("decimal(18,6)") for c in ("lo", "hi")}
    narrow = {**word, "wide": F.when(F.col("x.lo").isNotNull() & word["lo"].isNull() | F.col("x.hi").isNotNull() & word["hi"].isNull(), F.col("x"))}
    # rows lie by capture and input from the join on, and are grouped where they are
    rows = said.withColumns(narrow).select(*sent).unionByName(asked.withColumns(narrow).select(*sent)).filter("uri is not null").join(inputs, ["capture", "input"])
    kind = F.when(F.col("request").isNull(), "reference").otherwise("request")
    rows = rows.withColumns({"kind": kind, "x": F.coalesce("wide", T.interval(F.col("lo"), F.col("hi"), F.col("lo_inc"), F.col("hi_inc")))})
    lo, hi, order = F.col("x.lo"), F.col("x.hi"), F.col("establishment")
    bounded = F.when(lo.isNotNull() & hi.isNotNull(), F.struct(hi.alias("hi"), lo.alias("lo"), order.alias("establishment")))
    firsts = rows.withColumn("m", F.min(bounded).over(Window.partitionBy(*parts)))
    other = order != F.col("m.establishment")
    each = firsts.groupBy(*parts).agg(
        F.max("direct").alias("direct"), F.first("m").alias("m"), F.min(F.when(other, lo)).alias("other_lo"), F.count_if(other & lo.isNull()).alias("open"), F.min(F.when(bounded == F.col("m"), F.col("x"))).alias("x"))
    ok = F.coalesce(F.col("m.hi") <= F.coalesce("other_lo", F.col("m.hi")), F.lit(False)) & (F.col("open") == 0)
    each = each.withColumns({"finding": M.member_hash(parts), "earliest": F.when(ok, F.col("m.establishment")), "status": F.when(ok, "resolved").otherwise("unresolved")})
    uri = I.uri_parts(F.col("uri"))
    host, kind = F.lower(I.authority_host(uri["authority"])), I.host_kind(uri["authority"])
    web = F.coalesce(F.lower(uri["scheme"]).isin("http", "https"), F.lit(False)) & kind.isin("dns", "ipv4", "ipv6")
    found = each.withColumns({"_web": web, "host": F.when(web & (kind == "dns"), I.dns_name(host))})
    one = disposed(controls.filter(F.col("list").isin(*lists)), ["host", "list"], "says", "member", "nonmember")
    listed, clear = F.count_if(F.expr("control = 'suppressed'")) > 0, F.count_if(F.expr("control = 'kept'")) == len(lists)
    per_host, _ = near(one.groupBy("host").agg(F.when(listed, "suppressed").when(clear, "kept").otherwise(S.UNRESOLVED).alias("control")))
    control = F.when(F.col("host").isNull(), "not_applicable").otherwise(F.coalesce("control", F.lit(S.UNRESOLVED)))
    novel = T.within(F.col("x"), period, "contained")
    return found.join(per_host, "host", "left").select(
        "finding", *parts, "direct", F.when(F.col("_web"), "url").otherwise("generic_uri").alias("form"), "host", control.alias("control"),
        "earliest", "status", F.when(F.col("status") == "resolved", novel).otherwise(S.UNRESOLVED).alias("novel"))


# kits ----------------------------------------------------------------------------------


def kit_matches(seeds: DataFrame, representations: DataFrame, members: DataFrame, interpretations: DataFrame) -> DataFrame:
    """seed, candidate, left, right, reason and view: representations of other kits that are a seed's, or share its chosen paths.

    seeds has kit; representations kit, representation, scope (archive, collected_file_set or
    declared_subset) and sha256 (of an archive's bytes); members representation, path, content;
    interpretations left, right, qualification and path. Archives are equal by bytes, sets of
    files by the digests of their trees under one scope. Chosen paths must all stand in both. A
    declared subset, or paths that are only generic, is a clue and no match for hosting.
    """
    trees = M.set_digests(members, "representation", ["path", "content"]).select("representation", "digest")
    same = F.when(F.col("scope") == "archive", F.col("sha256")).otherwise(F.col("digest"))
    r = representations.join(trees, "representation", "left").select("kit", "representation", "scope", same.alias("same"))
    left = r.join(seeds.select("kit").distinct(), "kit", "left_semi").select(F.col("kit").alias("seed"), F.col("representation").alias("left"), "scope", "same")
    right = r.select(F.col("kit").alias("candidate"), F.col("representation").alias("right"), "scope", "same")
    equal = left.join(right, ["scope", "same"]).filter((F.col("seed") != F.col("candidate")) & (F.col("left") != F.col("right")))
    reason = F.when(F.col("scope") == "archive", "archive").otherwise("file_set")
    equal = equal.select("seed", "candidate", "left", "right", reason.alias("reason"), F.when(F.col("scope") == "declared_subset", "clue").otherwise("hosting").alias("view"))
    side = lambda name: members.select(F.col("representation").alias(name), "path", F.lit(1).alias(f"in_{name}")).distinct()
    chosen = interpretations.filter("path is not null").select("left", "right", "qualification", "path").distinct()
    there = chosen.join(side("left"), ["left", "path"], "left").join(side("right"), ["right", "path"], "left").groupBy("left", "right", "qualification").agg(
        F.count_if(F.col("in_left").isNull() | F.col("in_right").isNull()).alias("lacking"))
    view = F.when(F.col("qualification") == "supported_specific_shared_feature", "hosting").when(F.col("qualification") == "only_generic_default_paths", "clue")
    paths = there.filter("lacking = 0").join(left.select("seed", "left"), "left").join(right.select("candidate", "right"), "right").filter(F.col("seed") != F.col("candidate"))
    paths = paths.select("seed", "candidate", "left", "right", F.lit("paths").alias("reason"), view.alias("view")).filter("view is not null")
    return equal.unionByName(paths).distinct()


#: What names one deployment; a copy of its record keeps all of it.
OCCURRENCE = ["candidate", "occurrence", "source_scope", "origin", "collection", "location", "resource"]


def kit_deployments(deployments: DataFrame, correspondences: DataFrame, deliveries: DataFrame, purposes: DataFrame, baseline: DataFrame, comparisons: DataFrame, include_controlled: bool = False) -> DataFrame:
    """Served deployments with what they were served by: deployment, candidate, representation, form, value, view, purpose and activity.

    deployments has deployment, what OCCURRENCE names, linked (the origin is a source of the
    record), stage, dated, x and known; correspondences deployment, candidate, representation,
    resource, location, occurrence, evidence, provenance; deliveries deployment, location,
    occurrence, form (fqdn or ipv4), value, uri, role; purposes deployment, candidate, resource,
    location, occurrence, says. A controlled purpose suppresses a deployment, an unknown or
    disputed one leaves it unresolved, unless controlled ones are asked for. baseline
    (deployment) names known ones: a deployment that is one of them by its whole occurrence is a
    reference, any other needs a comparison (comparison, deployment, baseline, says) that tells
    it from every one of them. A date after it was known is out, an open one is unresolved.
    """
    client = F.col("evidence") == "client_network_capture"
    fresh = ~client | (F.coalesce(F.col("provenance") == "actual_network_response", F.lit(False)) & (F.col("stage") == "served"))
    activity = T.compare_if_present(F.col("dated"), F.col("x"), F.col("known"), "lte")
    served = deployments.filter(F.col("linked") & F.col("stage").isin(*SERVING_STAGES)).withColumn("activity", activity).filter(F.col("activity") != S.NO)
    shown = served.join(correspondences.filter(F.col("evidence").isin(*SERVING_EVIDENCE)), ["deployment", "candidate", "resource", "location", "occurrence"]).filter(fresh)
    named = I.dns_name(I.authority_host(I.uri_parts(F.col("uri"))["authority"])) == F.lower("value")
    fits = F.when(F.col("form") == "fqdn", named).when(F.col("form") == "ipv4", I.ipv4(F.col("value")).isNotNull())
    at = deliveries.filter(F.col("role").isin(*SERVING_ROLES) & fits).select("deployment", "location", "occurrence", "form", "value")
    found = shown.join(at, ["deployment", "location", "occurrence"]).select("deployment", *OCCURRENCE, "representation", "form", "value", "activity").distinct()

    subject = ["deployment", "candidate", "resource", "location", "occurrence"]
    purpose = disposed(purposes, subject, "says", "controlled", "not_controlled").withColumnRenamed("control", "purpose")
    asked = baseline.select(F.col("deployment").alias("baseline")).distinct()
    known = deployments.filter("linked").join(asked, F.col("deployment") == F.col("baseline"), "left_semi").select(*OCCURRENCE).distinct().withColumn("_reference", F.lit(True))
    wanted = asked.agg(F.count(F.lit(1)).alias("_wanted"))
    told = comparisons.join(asked, "baseline", "left_semi").groupBy("deployment", "comparison").agg(
        F.count_distinct("baseline").alias("n"), F.max(~F.coalesce(F.col("says") == "distinct_occurrences", F.lit(False))).alias("disputed"))
    told = told.groupBy("deployment").agg(F.max(F.when(~F.col("disputed"), F.col("n"))).alias("_told"), F.max("disputed").alias("_disputed"))

    j = found.join(purpose, subject, "left").join(known, OCCURRENCE, "left").join(told, "deployment", "left").join(F.broadcast(wanted), F.lit(True))
    apart = (F.col("_wanted") == 0) | (~F.coalesce("_disputed", F.lit(False)) & F.coalesce(F.col("_told") == F.col("_wanted"), F.lit(False)))
    purpose = F.coalesce("purpose", F.lit(S.UNRESOLVED))
    view = F.when(F.col("_reference"), "reference").when(apart & (F.col("activity") == S.YES), "discovery").otherwise(S.UNRESOLVED)
    if not include_controlled:
        view = F.when(purpose != "kept", purpose).otherwise(view)
    return j.select("deployment", *OCCURRENCE, "representation", "form", "value", view.alias("view"), purpose.alias("purpose"), "activity")


def kit_hosting(matches: DataFrame, hosted: DataFrame, receipts: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Matches for hosting with their own candidate's deployments, and the visit (0 lately received, 1 before, 2 never).

    receipts has candidate, collection and received (a date). The visit is an order to look in
    and takes nothing away; clues are no hosting and stay out.
    """
    last = receipts.groupBy("candidate", "collection").agg(F.max("received").alias("received"))
    whole = matches.filter("view = 'hosting'").select("seed", "candidate", F.col("right").alias("representation"), "reason").distinct()
    j = whole.join(hosted, ["candidate", "representation"]).join(last, ["candidate", "collection"], "left")
    return j.withColumn("visit", G.visit_priority(F.col("received"), F.date_sub(as_of, days), as_of)).drop("received")
