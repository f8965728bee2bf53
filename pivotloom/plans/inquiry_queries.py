"""Registered inquiries: compositions over the given tables, and the streaming job."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pivotloom.functions import identity as I
from pivotloom.functions import scans as C
from pivotloom.functions import status as S
from pivotloom.functions import timeops as T
from pivotloom.operators import evidence as E
from pivotloom.operators import inquiries as Q
from pivotloom.sources.shared import shared_folder
from pivotloom.sources.views import table
from pivotloom.streaming import first_seen as FS

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _listings(spark, d):
    """A supplier with a balance under 1000 is listed from its first to its last shipment of returned goods."""
    bad = table(spark, d, "supplier").filter("s_acctbal < 1000").select(F.col("s_suppkey").alias("party"))
    l = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("party")).agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    return bad.join(l, "party").select("party", T.interval(T.seconds(F.col("a")), T.seconds(F.col("b")), True, True).alias("listed"))


_LISTED = "listed as (select s_suppkey as party, min(l_shipdate) as a, max(l_shipdate) as b from supplier join lineitem on l_suppkey = s_suppkey where s_acctbal < 1000 and l_returnflag = 'R' group by 1)"
_FROM, _TO = "1997-01-01", "1997-12-31"


@query(f"""with {_LISTED} select l_orderkey, l_linenumber, party, count(*) as n from lineitem join listed on l_suppkey = party
where l_shipdate between a and b and l_shipdate >= timestamp '{_FROM}' and l_shipdate < timestamp '{_TO}' + interval 1 day group by all""")
def sanctions_at_event(spark, d):
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("party"), T.seconds(F.col("l_shipdate")).alias("at"))
    found = Q.listed_counterparties(r, _listings(spark, d), "party", "historical_at", T.query_period(_FROM, _TO), F.col("at"))
    return found.groupBy("l_orderkey", "l_linenumber", "party").agg(F.count(F.lit(1)).alias("n"))


_CUTOFFS = ("1997-01-01", "1999-06-01")


@query(f"""with l as (select distinct l_suppkey as party, l_orderkey * 10 + l_linenumber as claim, cast(l_shipdate as date) as a, cast(l_shipdate as date) + 400 as b, case when l_quantity <> 30 then cast(l_shipdate as date) + 100 end as known from lineitem where l_returnflag = 'R' qualify row_number() over (partition by l_orderkey, l_linenumber order by l_suppkey, l_shipdate, l_quantity) = 1),
t as (select unnest([date '{_CUTOFFS[0]}', date '{_CUTOFFS[1]}']) as cutoff), am as (select claim, case claim % 3 when 0 then 'withdraw' when 1 then 'dispute' else 'correct' end as operation, a + 700 as received from l where claim % 4 = 0),
s as (select l.claim, cutoff, max(operation) as operation from l, t left join am on am.claim = l.claim and received <= cutoff group by all),
k as (select l.*, t.cutoff, case when known is null then 'unresolved' else 'match' end as k, case operation when 'dispute' then 'unresolved' when 'withdraw' then 'no_match' when 'correct' then 'no_match' else 'match' end as st from l, t join s on s.claim = l.claim and s.cutoff = t.cutoff where known is null or known <= t.cutoff)
select o_orderkey, party, claim, cast(cutoff as varchar) as cutoff, case when k = 'unresolved' or st = 'unresolved' then 'unresolved' else 'match' end as status from orders join (select s_suppkey, s_nationkey from supplier) on s_suppkey = o_custkey % 10 + 1 join k on party = s_suppkey
where st <> 'no_match' and cast(o_orderdate as date) between a and b and o_orderdate >= timestamp '{_FROM}' and o_orderdate < timestamp '{_TO}' + interval 1 day""")
def sanctions_as_known(spark, d):
    """Orders to parties that were listed then, by what was known before and after the listings' amendments."""
    from pyspark.sql import Window

    day, number = F.to_date("l_shipdate"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    first = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_suppkey", "l_shipdate", "l_quantity"))
    l = table(spark, d, "lineitem").filter("l_returnflag = 'R'").withColumn("_f", first).filter("_f = 1").select(
        F.col("l_suppkey").alias("party"), number.alias("claim"), day.alias("day"), F.when(F.col("l_quantity") != 30, F.date_add(day, 100)).alias("known"))
    seconds = lambda c: T.seconds(c.cast("timestamp"))
    listings = l.select("party", "claim", "known", T.interval(seconds(F.col("day")), seconds(F.date_add("day", 400)), True, True).alias("listed"))
    operation = F.when(F.col("claim") % 3 == 0, "withdraw").when(F.col("claim") % 3 == 1, "dispute").otherwise("correct")
    amendments = l.filter("claim % 4 = 0").select(F.col("claim").alias("amendment_id"), F.lit(None).cast("long").alias("supersedes"), "claim", operation.alias("operation"), F.lit(S.YES).alias("support"), F.date_add("day", 700).alias("received"))
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 10 + 1).alias("party"), seconds(F.to_date("o_orderdate")).alias("at"))
    found = Q.listed_as_known(orders, listings, amendments, "party", T.query_period(_FROM, _TO), F.col("at"), [F.lit(c).cast("date") for c in _CUTOFFS])
    return found.select("o_orderkey", "party", "claim", F.col("cutoff").cast("string").alias("cutoff"), "status")


@query(f"""with {_LISTED}, r as (select distinct l_suppkey as party, l_partkey from lineitem)
select party, l_partkey, 'some' as mode from r join listed using (party) where b >= timestamp '{_FROM}' and a < timestamp '{_TO}' + interval 1 day
union all select party, l_partkey, 'all' from r join listed using (party) where a <= timestamp '{_FROM}' and b >= timestamp '{_TO}' + interval 1 day
union all select party, l_partkey, 'any' from r join listed using (party)""")
def sanctions_by_period(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("party"), "l_partkey").distinct()
    run = lambda mode, name: Q.listed_counterparties(r, _listings(spark, d), "party", mode, T.query_period(_FROM, _TO)).select("party", "l_partkey", F.lit(name).alias("mode"))
    return run("historical_some", "some").unionByName(run("historical_all", "all")).unionByName(run("retrospective", "any"))


@query("""select m.event_id, n.event_id as name_event, md5(m.user_id || '/' || m.event_type) as ja3 from events m join events n on m.user_id = n.user_id
where m.event_type = 'click' and n.event_type = 'view' and abs(epoch_us(m.ts) - epoch_us(n.ts)) <= 3600000000""")
def fingerprint_to_names(spark, d):
    e = table(spark, d, "events")
    m = e.filter("event_type = 'click'").select("event_id", "user_id", "ts", F.md5(F.concat_ws("/", F.col("user_id").cast("string"), "event_type")).alias("ja3"))
    n = e.filter("event_type = 'view'").select(F.col("event_id").alias("name_event"), "user_id", "ts")
    return Q.named_in_exchange(m, n, ["user_id"], "ts", 3600).select("event_id", "name_event", "ja3")


@query("""select user_id, event_type as endpoint, epoch_us(min(date_trunc('day', ts))) as lo, count(*) as n from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-21' group by all""")
def certificate_presentations(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("endpoint"), T.bounds(F.col("ts"), F.lit("day")).alias("x"))
    subjects = e.select("user_id").distinct()
    found = Q.presentations(subjects, e, "user_id", T.query_period("2024-01-05", "2024-01-20"))
    return found.select("user_id", "endpoint", (F.col("lo") * 1_000_000).cast("long").alias("lo"), "n")


@query("""with f as (select l_suppkey, l_returnflag || l_linestatus as part, min(cast(l_shipdate as date)) as seen from lineitem group by all),
w as (select l_suppkey, count(*) as parts, max(seen) as complete from f group by 1) select l_suppkey, parts, cast(complete as varchar) as complete, complete between date '1999-01-01' - 365 and date '1999-01-01' as novel from w where parts >= 6""")
def first_complete_findings(spark, d):
    parts = table(spark, d, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("part"), F.to_date("l_shipdate").alias("seen"))
    return Q.first_complete_finding(parts, "l_suppkey", 6, F.lit("1999-01-01").cast("date"), 365).withColumn("complete", F.col("complete").cast("string"))


@query(r"""with ips as (select doc_id, unnest(regexp_extract_all(text, '\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b')) as ip from documents),
n as (select doc_id, ip, cast(split_part(ip, '.', 1) as bigint) as first from ips where len(list_filter(string_split(ip, '.'), lambda x: cast(x as bigint) > 255 or (length(x) > 1 and x[1] = '0'))) = 0)
select doc_id, ip, s_suppkey as assertion from n join supplier on s_nationkey * 8 = first - first % 8 where s_acctbal < 5000""")
def listing_assertions(spark, d):
    found = C.extract(table(spark, d, "documents"), "doc_id", "text", {"ipv4": C.INDICATORS["ipv4"]})
    ips = found.select("doc_id", F.col("value").alias("ip"), I.ipv4(F.col("value")).alias("v")).filter("v is not null")
    nets = table(spark, d, "nation").select(F.col("n_nationkey").alias("prefix_id"), F.concat((F.col("n_nationkey") * 8).cast("string"), F.lit(".0.0.0/5")).alias("prefix"))
    said = table(spark, d, "supplier").select(F.col("s_nationkey").alias("prefix_id"), F.col("s_suppkey").alias("assertion"), F.when(F.col("s_acctbal") < 5000, "all_addresses_in_prefix").otherwise("individual_addresses").alias("applies_to"))
    return Q.listing_assertions(ips, nets, said).select("doc_id", "ip", "assertion")


@query("""with o as (select case when l_quantity <> 8 or l_partkey % 5 <> 0 then l_partkey end as l_partkey, l_suppkey, l_linenumber, l_returnflag || l_linestatus as e, cast(l_shipdate as date) as x,
  case when l_quantity <> 3 then cast(l_shipdate as date) + case when l_quantity = 5 then -1 else 3 end end as available from lineitem),
c as (select distinct l_suppkey, l_linenumber from o where l_partkey is null),
g as (select l_partkey, l_suppkey, l_linenumber, count(distinct e) as endpoints, count(*) as n, count(distinct x) as times, count(*) filter (available is null or x > available) as late from o where l_partkey is not null group by all)
select l_partkey, l_suppkey, l_linenumber, endpoints, n, case when endpoints = 1 and times = 1 and late = 0 and c.l_suppkey is null then 'match' else 'unresolved' end as status from g left join c using (l_suppkey, l_linenumber)""")
def equivalent_observations(spark, d):
    q, day = F.col("l_quantity"), F.to_date("l_shipdate")
    available = F.when(q != 3, F.date_add(day, F.when(q == 5, -1).otherwise(3)))
    o = table(spark, d, "lineitem").select(F.when((q != 8) | (F.col("l_partkey") % 5 != 0), F.col("l_partkey")).alias("l_partkey"), "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", day.alias("x"), available.alias("available"))
    return Q.observed_once(o, ["l_partkey", "l_suppkey", "l_linenumber"], ["l_returnflag", "l_linestatus"]).select("l_partkey", "l_suppkey", "l_linenumber", "endpoints", "n", "status")


@query("""select l_suppkey, count(distinct l_partkey % 50) as held from lineitem where l_partkey % 50 in (1, 2, 3) group by 1 having count(distinct l_partkey % 50) = 3""")
def shared_paths(spark, d):
    members = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 50).alias("path"))
    chosen = table(spark, d, "nation").filter("n_nationkey between 1 and 3").select(F.col("n_nationkey").cast("long").alias("path"))
    return Q.shared_paths(members, "l_suppkey", chosen, "path")


@query("""select o_orderkey, count(l_shipdate) filter (l_linenumber <> 1) as declared, case when count(l_shipdate) filter (l_linenumber <> 1) = 0 then 'unsupported' when max(l_shipdate) filter (l_linenumber <> 1) <= timestamp '1998-06-01' then 'match' else 'no_match' end as status
from orders left join lineitem on l_orderkey = o_orderkey group by 1""")
def as_known_cutoff(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linenumber") != 1, F.to_date("l_shipdate")).alias("known"))
    rows = table(spark, d, "orders").select("o_orderkey").join(l, "o_orderkey", "left")
    return Q.as_known(rows, "o_orderkey", "known", F.lit("1998-06-01").cast("date")).select("o_orderkey", "declared", "status")


@query("""with linked as (select distinct l_orderkey, l_linestatus || l_returnflag as revision from lineitem), t as (select distinct l_orderkey, l_linenumber, case when l_linenumber % 3 = 0 then 'OR' else l_linestatus || l_returnflag end as revision from lineitem)
select l_orderkey, l_linenumber, t.revision, case when linked.revision is null then 'no_match' else 'match' end as status from t left join linked using (l_orderkey, revision)""")
def revision_mismatch(spark, d):
    l = table(spark, d, "lineitem")
    own = F.concat("l_linestatus", "l_returnflag")
    times = l.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 == 0, "OR").otherwise(own).alias("revision")).distinct()
    linked = l.select("l_orderkey", own.alias("revision")).distinct()
    found = times.join(linked.withColumn("there", F.lit(True)), ["l_orderkey", "revision"], "left")
    return found.select("l_orderkey", "l_linenumber", "revision", F.when(F.col("there"), S.YES).otherwise(S.NO).alias("status"))


_DECL = """decl as (select distinct p_partkey as package, s_suppkey as repository, case when s_nationkey = p_partkey % 25 then 'match' else 'no_match' end as status from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey)"""


@query(f"""with {_DECL}, used as (select distinct l_suppkey as repository, l_shipmode as infrastructure, cast(l_shipdate as date) as seen from (select *, l_returnflag || l_linestatus as l_shipmode from lineitem))
select package, repository, infrastructure, count(*) filter (seen between date '2001-01-01' - 3650 and date '2001-01-01') as inside, count(*) filter (not seen between date '2001-01-01' - 3650 and date '2001-01-01') as outside
from decl left join used using (repository) where status = 'match' group by all""")
def package_infrastructure(spark, d):
    l = table(spark, d, "lineitem")
    pairs = l.select(F.col("l_partkey").alias("package"), F.col("l_suppkey").alias("repository")).distinct()
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("repository"), "s_nationkey")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("package"))
    declared = pairs.join(p, "package").join(s, "repository").select("package", "repository", S.equal(F.col("s_nationkey"), F.col("package") % 25).alias("status"))
    used = l.select(F.col("l_suppkey").alias("repository"), F.concat("l_returnflag", "l_linestatus").alias("infrastructure"), F.to_date("l_shipdate").alias("seen")).distinct()
    found = Q.package_infrastructure(declared, used, "repository", F.lit("2001-01-01").cast("date"), 3650)
    return found.groupBy("package", "repository", "infrastructure").agg(F.count_if("inside").alias("inside"), F.count_if(~F.col("inside")).alias("outside"))


@query(r"""with hosts as (select page_id, case when page_id % 4 = 0 then '*.' else '' end || lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) as host, length(url) as size from pages),
c as (select page_id, starts_with(host, '*.') as wildcard, regexp_replace(host, '^\*\.', '') as bare, size from hosts), s as (select distinct regexp_replace(bare, '^[^.]*\.', '') as scope from c),
m as (select page_id, scope, wildcard, size from c join s on bare = scope or ends_with(bare, '.' || scope) where size between 20 and 60),
r as (select *, row_number() over (partition by scope order by page_id, wildcard) as place, count(*) over (partition by scope) as candidates from m)
select page_id, scope, wildcard, profile, place, candidates, candidates > 50 as partial from r join (select unnest(['usual', 'long']) as profile) on profile = 'usual' or size >= 40 where place <= 50""")
def certificate_expansion(spark, d):
    p = table(spark, d, "pages")
    host = I.dns_name(I.authority_host(I.uri_parts(F.col("url"))["authority"]))
    c = p.select("page_id", F.concat(F.when(F.col("page_id") % 4 == 0, "*.").otherwise(""), host).alias("host"), F.length("url").cast("string").alias("size"))
    seeds = c.select(F.regexp_replace(F.regexp_replace("host", r"^\*\.", ""), r"^[^.]*\.", "").alias("scope")).distinct()
    criteria = spark.createDataFrame([("usual", "size", "range", None, 20.0, 60.0), ("long", "size", "range", None, 40.0, 60.0)], "profile string, field string, kind string, allowed array<string>, low double, high double")
    profiles = E.profile_matches(c.select("page_id"), "page_id", c.select("page_id", F.lit("size").alias("field"), F.col("size").alias("value")), criteria)
    return Q.expanded_certificates(c, seeds, profiles, "page_id", "host", 50).select("page_id", "scope", "wildcard", "profile", "place", "candidates", "partial")


@query("""with f as (select o_orderkey, sha256(cast(o_custkey as varchar)) as digest from orders),
g as (select o_orderkey, max(case when l_quantity > 25 and l_shipdate - interval 60 day <= timestamp '1997-06-01' and timestamp '1997-06-01' <= l_shipdate + interval 60 day then 3 when l_quantity > 25 then 2 else 1 end) as rank, count(*) as n
  from orders join lineitem on l_orderkey = o_orderkey where l_linenumber % 2 = 1 and l_returnflag <> 'N' group by 1)
select o_orderkey, coalesce(n, 0) as signatures, ['absent', 'present', 'reported', 'verified'][coalesce(rank, 0) + 1] as signing from f left join g using (o_orderkey)""")
def signing_reports(spark, d):
    files = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.sha2(F.col("o_custkey").cast("string"), 256).alias("digest"), F.lit("image").alias("recipe"))
    day = F.to_date("l_shipdate")
    l = table(spark, d, "lineitem").join(files.select(F.col("o_orderkey").alias("l_orderkey"), F.col("digest").alias("own")), "l_orderkey")
    signatures = l.select(
        F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linenumber") % 2 == 1, F.col("own")).otherwise(F.sha2("own", 256)).alias("image"), F.when(F.col("l_returnflag") != "N", "image").otherwise("file").alias("image_recipe"),
        F.when(F.col("l_quantity") > 25, F.col("l_suppkey")).alias("signer"), F.date_sub(day, 60).alias("valid_from"), F.date_add(day, 60).alias("valid_to"))
    return Q.signing_reports(files, signatures, "o_orderkey", F.lit("1997-06-01").cast("date"))


@query("""with w as (select user_id, event_type, date_trunc('day', ts) as day, min(ts) as a, max(ts) as b, count(*) as sightings from events group by all)
select user_id, event_type, epoch_us(a) as first_seen, epoch_us(b) as last_seen, sightings from w where day + interval 1 day <= (select max(ts) from events) - interval 1 hour""")
def stream_first_seen(spark, d):
    """Finished daily windows of the feed, worked off as a stream."""
    folder = shared_folder(spark)
    schema = table(spark, d, "events").schema
    rows = FS.feed(spark, d, "events.parquet", schema)
    done = FS.run_once(FS.first_seen(rows, ["user_id", "event_type"], "ts", "1 hour", "1 day"), f"{folder}/first-seen-{uuid.uuid4().hex}")
    return done.select("user_id", "event_type", F.unix_micros("first_seen").alias("first_seen"), F.unix_micros("last_seen").alias("last_seen"), "sightings")
