"""Registered inquiries on officers, requests, creatives and kits over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pivotloom.functions import status as S
from pivotloom.functions import timeops as T
from pivotloom.operators import bindings as B
from pivotloom.sources.views import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _at(c):
    return T.interval(T.seconds(c), T.seconds(c), True, True)


def _between(a, b):
    return T.interval(T.seconds(a), T.seconds(b), True, True)


_FROM, _TO = "timestamp '1997-01-01'", "timestamp '1998-01-01'"


@query(f"""with a as (select o_orderkey as appointment, o_custkey as person, o_orderkey % 25 as org, case o_orderstatus when 'F' then 'officer' else 'director' end as role from orders
  where o_orderstatus in ('F', 'O') and o_orderkey % 19 <> 0 and o_orderkey % 23 <> 0 and o_custkey in (select c_custkey from customer) and o_orderkey % 25 in (select s_suppkey from supplier)),
s as (select l_orderkey as appointment, l_linenumber as service, l_linenumber % 2 = 1 as held, l_shipdate as a, case when l_quantity % 11 <> 0 then l_shipdate + to_days(cast(l_quantity as integer)) end as b,
  case when l_quantity % 17 <> 0 then l_shipdate + to_days(case when l_quantity % 13 = 0 then -1 else 2 end) end as known, case when l_quantity <> 21 then l_returnflag <> 'A' end as active from lineitem),
st as (select *, case when held then case when b is null then 'unresolved' when b < {_FROM} or a >= {_TO} then 'no_match' else 'match' end
  when not active or a < {_FROM} or a >= {_TO} or known < a then 'no_match' when active is null or known is null then 'unresolved' else 'match' end as status from s),
j as (select * from a join st using (appointment) where status <> 'no_match'),
x as (select o_orderkey as appointment, unnest(case o_orderkey % 8 when 0 then ['exclude', 'retain'] when 1 then ['retain'] when 2 then ['disputed'] when 4 then ['exclude'] when 5 then ['retain'] when 6 then ['retain', 'retain'] else [] end) as says,
  o_orderdate - to_days(500) as xa, o_orderdate + to_days(500) as xb from orders),
c as (select appointment, service, case when bool_or(says = 'disputed') or (bool_or(says = 'exclude') and bool_or(says = 'retain')) then 'unresolved' when bool_or(says = 'exclude') then 'suppressed' else 'kept' end as control
  from j join x using (appointment) where case when held then xa <= {_FROM} and xb >= {_TO} else a between xa and xb end group by all)
select person, org, j.appointment, role, j.service, status, coalesce(control, 'unresolved') as control from j left join c on c.appointment = j.appointment and c.service = j.service""")
def officer_appointments(spark, d):
    """Orders as appointments of customers by suppliers, their lines as terms of service or dated statuses."""
    key, q, day = F.col("o_orderkey"), F.col("l_quantity"), F.to_date("l_shipdate")
    o = table(spark, d, "orders")
    role = F.when(F.col("o_orderstatus") == "F", "officer").when(F.col("o_orderstatus") == "O", "director").otherwise("adviser")
    appointments = o.select(
        key.alias("appointment"), F.col("o_custkey").alias("person"), (key % 25).alias("org"), role.alias("role"),
        F.when(key % 19 != 0, F.col("o_custkey") % 3).otherwise(-1).alias("person_scope"), F.when(key % 23 != 0, key % 25 % 2).otherwise(-1).alias("org_scope"))
    persons = table(spark, d, "customer").select(F.col("c_custkey").alias("person"), (F.col("c_custkey") % 3).alias("scope"))
    orgs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("org"), (F.col("s_suppkey") % 2).alias("scope"))
    odd = F.col("l_linenumber") % 2 == 1
    end = F.when(q % 11 != 0, F.date_add(day, q.cast("int")))
    known = F.when(q % 17 != 0, F.date_add(day, F.when(q % 13 == 0, -1).otherwise(2)))
    services = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("appointment"), F.col("l_linenumber").alias("service"), F.when(odd, _between(day, end)).alias("held"),
        F.when(~odd, _at(day)).alias("at"), F.when(~odd, _at(known)).alias("known"), F.when(q != 21, F.col("l_returnflag") != "A").alias("active"))
    said = {0: ["exclude", "retain"], 1: ["retain"], 2: ["disputed"], 4: ["exclude"], 5: ["retain"], 6: ["retain", "retain"]}
    says = F.coalesce(*[F.when(key % 8 == k, F.array(*[F.lit(x) for x in v])) for k, v in said.items()])
    ordered = F.to_date("o_orderdate")
    exclusions = o.withColumn("disposition", F.explode(says)).select(key.alias("appointment"), "disposition", _between(F.date_sub(ordered, 500), F.date_add(ordered, 500)).alias("x"))
    return B.officer_appointments(persons, orgs, appointments, services, T.query_period("1997-01-01", "1997-12-31"), exclusions)


_TYPES = ("click", "error", "purchase", "signup", "view")


@query("""with p as (select event_id, user_id, event_id % 2 as method, ts, (['start', 'auction', 'render'])[cast(event_id % 3 as integer) + 1] as phase, event_id % 10 as input,
  case event_id % 4 when 0 then case when event_id % 7 = 0 then 'unresolved' else 'match' end when 1 then case when event_id % 7 = 0 then 'unresolved' when event_id % 3 = 2 then 'no_match' else 'match' end else 'match' end as own
  from events where event_id % 20 <> 0 and event_id % 11 <> 0 and ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-29'),
r as (select o_orderkey as role, o_custkey, o_orderkey % 2 as method, case o_orderkey % 3 when 0 then ['start'] when 1 then ['auction', 'render'] else ['start', 'auction', 'render'] end as phases,
  case o_orderstatus when 'F' then true when 'O' then false end as exclusive, timestamp '2024-01-01' + to_days(cast(o_orderkey % 30 as integer)) as lo, case when o_orderkey % 13 <> 0 then timestamp '2024-01-21' + to_days(cast(o_orderkey % 30 as integer)) end as hi,
  o_orderkey % 9 = 0 as open, o_orderkey % 10 as input from orders),
w as (select event_id, role, own, exclusive, list_contains(phases, phase) as holds, hi is null or open as unsure, p.input <> r.input as apart from p join r on o_custkey = user_id and r.method = p.method where own <> 'no_match' and (hi is null or (ts >= lo and ts < hi))),
c as (select event_id, count(*) filter (not unsure) as sure, count(*) filter (unsure) as maybe from w where holds group by 1)
select w.event_id as phase_id, w.event_id as request, role, coalesce(sure + maybe, 0) as contrary, case when own = 'unresolved' or unsure or exclusive is null then 'unresolved' when not exclusive then 'compatible' when sure > 0 then 'contested' when maybe > 0 then 'unresolved' else 'mismatch' end as outcome
from w left join c on c.event_id = w.event_id where apart and case when exclusive is null then true when exclusive then not holds else holds end""")
def phase_comparisons(spark, d):
    """Events as requests, in phases, against the roles that orders declare for a customer's endpoints."""
    k, ts = F.col("event_id"), F.col("ts")
    e = table(spark, d, "events")
    requests = e.select(k.alias("request"), F.col("event_type").alias("endpoint"), (k % 2).alias("method"), F.col("user_id").alias("tenant"), F.lit("1").alias("version"), _at(ts).alias("at"))
    vocabulary = F.array(*[F.lit(x) for x in ("start", "auction", "render")])
    how = F.when(k % 4 == 0, "page_start").when(k % 4 == 1, "page_complete").otherwise("request_trace")
    shift = F.when(k % 4 == 0, -5).when(k % 4 == 1, (k % 3 - 1) * 10).cast("int")
    boundary = F.when(k % 7 != 0, _at(F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) + shift * 1_000_000)))
    phase = F.when(k % 20 == 0, "other").otherwise(F.element_at(vocabulary, (k % 3 + 1).cast("int")))
    phases = e.select(k.alias("phase_id"), k.alias("request"), phase.alias("phase"), (k % 10).alias("input"), how.alias("how"), boundary.alias("boundary"), (k % 11 != 0).alias("traced"))
    o, start = F.col("o_orderkey"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 30).cast("int"))
    names = F.when(o % 3 == 0, F.array(F.lit("start"))).when(o % 3 == 1, F.array(F.lit("auction"), F.lit("render"))).otherwise(vocabulary)
    exclusive = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    end = F.when(o % 13 != 0, F.date_add(start, 20))
    # exploded in a step of its own: beside a generator, structs lose the names of their fields
    roles = table(spark, d, "orders").withColumn("endpoint", F.explode(F.array(*[F.lit(t) for t in _TYPES]))).select(
        o.alias("role"), "endpoint", (o % 2).alias("method"), F.col("o_custkey").alias("tenant"), F.lit("1").alias("version"), names.alias("phases"),
        exclusive.alias("exclusive"), T.interval(T.seconds(start), T.seconds(end)).alias("applicable"), (o % 10).alias("input"), F.when(o % 9 == 0, S.UNRESOLVED).otherwise(S.YES).alias("support"))
    return B.phase_comparisons(requests, phases, roles, T.query_period("2024-01-03", "2024-01-28"), vocabulary)


_LISTS = ["pixels", "assets"]


@query(f"""with g as (select l_orderkey, l_linenumber, min(l_partkey) as part, min(l_suppkey) as sup, min(l_quantity) as q, min(l_shipdate) as day from lineitem group by all),
b as (select *, l_orderkey * 10 + l_linenumber as establishment, case when l_linenumber % 2 = 1 then 'c' || l_orderkey else 's' || part end as input, day as lo, case when q <> 17 then day + to_days(case when q % 2 = 0 then 1 else 0 end) end as hi from g),
inputs as (select o_orderkey as capture, 'c' || o_orderkey as input, true as direct from orders union select l_orderkey, 's' || l_partkey, false from lineitem),
refs as (select 'reference' as kind, l_orderkey as capture, input, case part % 6 when 0 then 'https://p' || part % 50 || '.example.net/x' when 1 then 'https://192.0.2.' || part % 20 || '/p' when 2 then 'urn:example:' || part % 9 when 3 then 'http://P' || part % 50 || '.example.net:80/x' when 4 then 'ftp://p1.example.net/' end as uri,
  cast(null as varchar) as request, (['{"', '".join(B.REFERENCE_ROLES)}'])[cast(sup % 5 as integer) + 1] as what, establishment, lo, hi from b where q <> 50),
reqs as (select 'request', l_orderkey, input, 'https://r' || part % 50 || '.example.net/', cast(establishment as varchar), (['{"', '".join(B.REQUEST_STAGES)}'])[cast(sup % 5 as integer) + 1], establishment, lo, hi from b where l_linenumber % 3 = 0 and q not in (11, 23, 29)),
a as (select * from refs where uri is not null union all select * from reqs),
f as (select a.*, direct from a join inputs using (capture, input)),
e as (select f.*, (select min(y.lo) from a y where y.kind = f.kind and y.capture = f.capture and y.input = f.input and y.uri = f.uri and y.request is not distinct from f.request and y.what = f.what and y.establishment <> f.establishment) as other from f),
z as (select kind, capture, input, uri, request, what, bool_or(direct) as direct, min(establishment) filter (hi <= coalesce(other, hi)) as earliest from e group by all),
h as (select *, case when starts_with(uri, 'http') and uri not like 'https://192%' then lower(regexp_extract(uri, '//([^/:]*)', 1)) end as host from z),
k as (select distinct p_partkey % 50 as k from part), c as (select 'p' || k || '.example.net' as host, k % 7 = 0 or k % 13 = 0 as m1, k % 7 <> 0 or k % 13 = 0 as n1, k % 11 <> 0 as n2 from k union all select 'r' || k || '.example.net', false, true, true from k where k % 2 = 0),
v as (select host, case when m1 and not n1 then 'suppressed' when n1 and not m1 and n2 then 'kept' else 'unresolved' end as control from c)
select h.kind, h.capture, h.input, h.uri, h.request, h.what, h.direct, case when starts_with(uri, 'http') then 'url' else 'generic_uri' end as form, h.host, case when h.host is null then 'not_applicable' else coalesce(control, 'unresolved') end as control, earliest, case when earliest is null then 'unresolved' else 'resolved' end as status,
  case when earliest is null then 'unresolved' when lo >= {_FROM} and hi < {_TO} then 'match' when hi < {_FROM} or lo >= {_TO} then 'no_match' else 'unresolved' end as novel
from h left join v on v.host = h.host left join b on b.establishment = earliest""")
def creative_findings(spark, d):
    """Orders as captures, their parts as scripts that other captures embed too."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("sup"), F.min("l_quantity").alias("q"), F.min(F.to_date("l_shipdate")).alias("day"))
    q, part, line, text = F.col("q"), F.col("part"), F.col("l_linenumber"), lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    end = F.when(q != 17, F.date_add("day", F.when(q % 2 == 0, 1).otherwise(0)))
    own = F.when(line % 2 == 1, text("c", F.col("l_orderkey"))).otherwise(text("s", part))
    b = g.select("*", (F.col("l_orderkey") * 10 + line).alias("establishment"), F.col("l_orderkey").alias("capture"), own.alias("input"), _between(F.col("day"), end).alias("x"))
    uri = F.coalesce(*[F.when(part % 6 == i, u) for i, u in enumerate([text("https://p", part % 50, ".example.net/x"), text("https://192.0.2.", part % 20, "/p"), text("urn:example:", part % 9), text("http://P", part % 50, ".example.net:80/x"), F.lit("ftp://p1.example.net/")])])
    pick = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), (F.col("sup") % 5 + 1).cast("int"))
    references = b.select("capture", "input", uri.alias("uri"), F.when(q == 50, "mention").otherwise(pick(B.REFERENCE_ROLES)).alias("role"), "establishment", "x")
    asked = b.filter("l_linenumber % 3 = 0")
    correspondences = asked.select("capture", "input", F.col("establishment").alias("request"), "establishment", "x")
    requests = asked.select(
        F.col("establishment").alias("request"), F.when(q == 11, F.col("capture") + 1).otherwise(F.col("capture")).alias("capture"), text("https://r", part % 50, ".example.net/").alias("uri"),
        F.when(q == 23, "cached").otherwise(pick(B.REQUEST_STAGES)).alias("stage"), (q != 29).alias("traced"))
    captures = table(spark, d, "orders").select(F.col("o_orderkey").alias("capture"), text("c", F.col("o_orderkey")).alias("input"))
    scripts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("capture"), text("s", F.col("l_partkey")).alias("input"))
    k = F.col("k")
    keys = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("k")).distinct()
    say = lambda host, name, says, when: keys.filter(when).select(host.alias("host"), F.lit(name).alias("list"), F.lit(says).alias("says"))
    p, r = text("p", k, ".example.net"), text("r", k, ".example.net")
    controls = say(p, "pixels", "member", (k % 7 == 0) | (k % 13 == 0)).unionByName(say(p, "pixels", "nonmember", (k % 7 != 0) | (k % 13 == 0))).unionByName(say(p, "assets", "nonmember", k % 11 != 0))
    controls = controls.unionByName(say(r, "pixels", "nonmember", k % 2 == 0)).unionByName(say(r, "assets", "nonmember", k % 2 == 0))
    return B.creative_findings(captures, scripts, references, requests, correspondences, controls, _LISTS, T.query_period("1997-01-01", "1997-12-31")).drop("finding")


_KITS = """rep as (select p_partkey as kit, 'a' || p_partkey as representation, 'archive' as scope, cast(p_partkey // 3 as varchar) as same from part
  union all select p_partkey, case when p_partkey % 3 = 0 then 'd' else 'f' end || p_partkey, case when p_partkey % 3 = 0 then 'declared_subset' else 'collected_file_set' end, (p_partkey // 4) || ':' || (select string_agg(distinct l_linenumber % 2, ',' order by l_linenumber % 2) from lineitem where l_partkey = p_partkey) from part),
mem as (select distinct case when l_partkey % 3 = 0 then 'd' else 'f' end || l_partkey as representation, l_linenumber % 2 as path from lineitem),
itp as (select p_partkey as a, p_partkey + 5 as b, (['supported_specific_shared_feature', 'only_generic_default_paths', 'other'])[cast(p_partkey % 3 as integer) + 1] as qualification, unnest(case p_partkey % 4 when 0 then [0] when 1 then [0, 1] when 2 then [0, 1, 2] else [] end) as path from part),
named as (select a, b, qualification, case when a % 3 = 0 then 'd' else 'f' end || a as l, case when b % 3 = 0 then 'd' else 'f' end || b as r, path from itp),
shared as (select a, b, l, r, qualification from named left join mem x on x.representation = l and x.path = named.path left join mem y on y.representation = r and y.path = named.path group by all having count(*) filter (x.path is null or y.path is null) = 0),
m as (select x.kit as seed, y.kit as candidate, x.representation as "left", y.representation as "right", case when x.scope = 'archive' then 'archive' else 'file_set' end as reason, case when x.scope = 'declared_subset' then 'clue' else 'hosting' end as view
  from rep x join rep y on x.scope = y.scope and x.same = y.same and x.kit <> y.kit
  union all select a, b, l, r, 'paths', case when qualification = 'only_generic_default_paths' then 'clue' else 'hosting' end from shared where qualification <> 'other' and b in (select p_partkey from part))"""


def _kit_of(k):
    return F.concat(F.when(k % 3 == 0, "d").otherwise("f"), k.cast("string"))


def _kits(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    archive = F.struct(F.lit("archive").alias("scope"), F.concat(F.lit("a"), k.cast("string")).alias("representation"), F.sha2(F.floor(k / 3).cast("string"), 256).alias("sha256"))
    files = F.struct(F.when(k % 3 == 0, "declared_subset").otherwise("collected_file_set").alias("scope"), _kit_of(k).alias("representation"), F.lit(None).cast("string").alias("sha256"))
    representations = p.select(k.alias("kit"), F.explode(F.array(archive, files)).alias("r")).select("kit", "r.*")
    l = F.col("l_partkey")
    members = table(spark, d, "lineitem").select(_kit_of(l).alias("representation"), (F.col("l_linenumber") % 2).alias("path"), F.floor(l / 4).alias("content"))
    paths = F.when(k % 4 == 0, F.array(F.lit(0))).when(k % 4 == 1, F.array(F.lit(0), F.lit(1))).when(k % 4 == 2, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(None).cast("int")))
    qualification = F.element_at(F.array(F.lit("supported_specific_shared_feature"), F.lit("only_generic_default_paths"), F.lit("other")), (k % 3 + 1).cast("int"))
    interpretations = p.select(_kit_of(k).alias("left"), _kit_of(k + 5).alias("right"), qualification.alias("qualification"), F.explode(paths).alias("path"))
    return B.kit_matches(p.select(k.alias("kit")), representations, members, interpretations)


@query(f"with {_KITS} select * from m")
def kit_matches(spark, d):
    """Parts as kits: an archive each, and a set of files or a declared part of one."""
    return _kits(spark, d)


@query(f"""with {_KITS}, o as (select *, o_orderkey % 100 as location from orders where o_orderstatus in ('F', 'O') and o_orderkey % 17 <> 0),
dep as (select *, case when o_orderkey % 6 = 0 then 'match' when o_orderkey % 15 = 1 then 'unresolved' when o_orderkey % 8 = 0 then 'no_match' else 'match' end as activity from o),
cor as (select distinct l_orderkey, case when l_linenumber % 4 = 0 then 'a' || o_custkey else case when o_custkey % 3 = 0 then 'd' else 'f' end || o_custkey end as representation from lineitem join o on o_orderkey = l_orderkey where l_linenumber % 5 < 3 or (l_linenumber % 5 = 3 and l_returnflag = 'R' and o_orderstatus = 'F')),
del as (select o_orderkey, case when o_orderkey % 2 = 0 then 'fqdn' else 'ipv4' end as form, case when o_orderkey % 2 = 0 then 'H' || location || '.example.net' else '10.0.0.' || location end as value from o where o_orderkey % 9 <> 0 and case when o_orderkey % 2 = 0 then o_orderkey % 12 <> 0 else o_orderkey % 13 <> 0 end),
f as (select dep.*, representation, form, value, case when o_orderkey % 10 = 9 then 'unresolved' when o_orderkey % 25 = 3 or o_orderkey % 5 = 1 then 'unresolved' when o_orderkey % 5 = 0 then 'suppressed' else 'kept' end as purpose from dep join cor on l_orderkey = o_orderkey join del using (o_orderkey) where activity <> 'no_match'),
v as (select *, case when purpose <> 'kept' then purpose when o_orderkey in (22, 44, 62) then 'reference' when activity = 'match' and o_orderkey % 3 <> 0 and o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0 then 'discovery' else 'unresolved' end as view from f),
rec as (select l_partkey as candidate, l_suppkey % 2 as collection, max(cast(l_shipdate as date)) as received from lineitem group by all)
select seed, m.candidate, reason, v.o_orderkey as deployment, v.representation, form, value, v.view, purpose, activity, case when received is null then 2 when received between date '2000-06-30' - 180 and date '2000-06-30' then 0 else 1 end as visit
from (select distinct seed, candidate, "right", reason from m where view = 'hosting') m join v on v.o_custkey = m.candidate and v.representation = m."right" left join rec on rec.candidate = m.candidate and rec.collection = v.o_orderkey % 2""")
def kit_hosting(spark, d):
    """Orders as deployments of kits, their lines as what shows them, three of them known before by a copy of their record."""
    o, lines, k = table(spark, d, "orders"), table(spark, d, "lineitem"), F.col("o_orderkey")
    text = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    known = F.date_add(F.to_date("o_orderdate"), F.when(k % 8 == 0, -3).otherwise(3))
    stage = F.when(F.col("o_orderstatus") == "F", "served").when(F.col("o_orderstatus") == "O", "installed_serving_context").otherwise("archive_offered_for_download")
    own = o.select(
        k.alias("deployment"), F.col("o_custkey").alias("candidate"), k.alias("occurrence"), F.lit("s").alias("source_scope"), (k % 7).alias("origin"), (k % 2).alias("collection"), (k % 100).alias("location"), (k % 3).alias("resource"),
        (k % 17 != 0).alias("linked"), stage.alias("stage"), (k % 6 != 0).alias("dated"), F.when(k % 15 != 1, _at(F.to_date("o_orderdate"))).alias("x"), _at(known).alias("known"))
    copies = own.filter(F.col("deployment") % 2 == 0).withColumn("deployment", -F.col("deployment") - 1)
    n = F.col("n_nationkey")
    baseline = table(spark, d, "nation").filter("n_nationkey < 3").select((-F.when(n == 0, 22).when(n == 1, 44).otherwise(62) - 1).cast("long").alias("deployment")).distinct()
    key = own.select("deployment", "candidate", "occurrence", "resource", "location")
    kinds = F.array(*[F.lit(x) for x in (*B.SERVING_EVIDENCE, "archive_download")])
    line = lines.select(F.col("l_orderkey").alias("deployment"), "l_linenumber", "l_returnflag")
    representation = F.when(F.col("l_linenumber") % 4 == 0, text("a", F.col("candidate"))).otherwise(_kit_of(F.col("candidate")))
    provenance = F.when(F.col("l_returnflag") == "R", "actual_network_response").when(F.col("l_returnflag") == "A", "client_cache")
    correspondences = key.join(line, "deployment").select(*key.columns, representation.alias("representation"), F.element_at(kinds, (F.col("l_linenumber") % 5 + 1).cast("int")).alias("evidence"), provenance.alias("provenance"))
    even, place = k % 2 == 0, k % 100
    host = lambda name, i: text(name, i, ".example.net")
    deliveries = o.select(
        k.alias("deployment"), place.alias("location"), k.alias("occurrence"), F.when(even, "fqdn").otherwise("ipv4").alias("form"), F.when(even, host("H", place)).when(k % 13 == 0, "10.0.0.999").otherwise(text("10.0.0.", place)).alias("value"),
        F.when(even, F.concat(F.lit("https://"), host("h", F.when(k % 12 == 0, place + 1).otherwise(place)), F.lit(":8443/k"))).alias("uri"), F.when(k % 9 == 0, "unbound_network_peer").otherwise("delivery_endpoint").alias("role"))
    says = F.when(k % 10 == 9, F.array().cast("array<string>")).when(k % 25 == 3, F.array(F.lit("controlled"), F.lit("not_controlled"))).when(k % 5 == 0, F.array(F.lit("controlled"))).when(k % 5 == 1, F.array(F.lit("contested"))).otherwise(F.array(F.lit("not_controlled"), F.lit("not_controlled")))
    purposes = o.select(k.alias("deployment"), F.col("o_custkey").alias("candidate"), k.alias("occurrence"), (k % 3).alias("resource"), place.alias("location"), F.explode(says).alias("says"))
    against = F.array(*[F.lit(i).cast("long") for i in (-23, -45, -63)])
    comparisons = o.filter("o_orderkey % 3 <> 0").select(
        k.alias("comparison"), k.alias("deployment"), F.explode(F.when(k % 7 == 0, F.slice(against, 1, 2)).otherwise(against)).alias("baseline"), F.when(k % 11 == 0, "contested").otherwise("distinct_occurrences").alias("says"))
    hosted = B.kit_deployments(own.unionByName(copies), correspondences, deliveries, purposes, baseline, comparisons)
    receipts = lines.select(F.col("l_partkey").alias("candidate"), (F.col("l_suppkey") % 2).alias("collection"), F.to_date("l_shipdate").alias("received"))
    found = B.kit_hosting(_kits(spark, d), hosted, receipts, F.lit("2000-06-30").cast("date"), 180)
    return found.select("seed", "candidate", "reason", "deployment", "representation", "form", "value", "view", "purpose", "activity", "visit")
