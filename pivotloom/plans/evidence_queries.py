"""Registered evidence joins, claims, identities, scans, checks and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pivotloom.functions import identity as I
from pivotloom.functions import scans as C
from pivotloom.functions import status as S
from pivotloom.operators import claims as G
from pivotloom.operators import containment as K
from pivotloom.operators import evidence as E
from pivotloom.operators import merkle as M
from pivotloom.operators.cycles import cycle_members
from pivotloom.sources.views import EDGES_SQL, NODES_SQL, edges, nodes, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# joins ---------------------------------------------------------------------------------


@query("""select o_orderkey, p_partkey, s_suppkey, case when p_size is null then 'unresolved' when p_size > 40 then 'match' end as status
from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey where p_size > 40 and o_orderstatus = 'F'""")
def ordered_bindings(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    p = table(spark, d, "part").select("p_partkey", "p_size")
    joined = E.bind(E.bind(o, l, ["o_orderkey"]), p, ["p_partkey"], S.known(F.col("p_size") > 40, F.col("p_size")))
    return E.bind(joined, table(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"]).select("o_orderkey", "p_partkey", "s_suppkey", "status")


@query("""with o as (select o_custkey, o_totalprice > 450000 and o_orderstatus = 'F' as yes, o_totalprice > 450000 and o_orderstatus = 'P' as open from orders)
select c_custkey, count(*) filter (yes) as matches, case when count(*) filter (yes) > 0 then 'BOUND' when count(*) filter (open) > 0 then 'UNRESOLVED' else 'ABSENT' end as binding from customer left join o on o_custkey = c_custkey group by c_custkey""")
def optional_binding(spark, d):
    status = F.when(F.col("o_totalprice") <= 450000, S.NO).when(F.col("o_orderstatus") == "F", S.YES).when(F.col("o_orderstatus") == "P", S.UNRESOLVED).otherwise(S.NO)
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), status.alias("status"))
    return E.optional_binding(table(spark, d, "customer").select("c_custkey"), "c_custkey", o).select("c_custkey", "matches", "binding")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 480000)")
def anti_match(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 480000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("select s_suppkey from supplier where exists (select 1 from lineitem where l_suppkey = s_suppkey and l_quantity >= 50 and l_returnflag = 'R')")
def semi_match(spark, d):
    l = table(spark, d, "lineitem").filter("l_quantity >= 50 and l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, d, "supplier").select("s_suppkey").join(l, "s_suppkey", "left_semi")


_IPS = r"""ips as (select doc_id, unnest(regexp_extract_all(text, '\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b')) as ip from documents),
n as (select doc_id, ip, list_reduce(list_transform(string_split(ip, '.'), lambda x: cast(x as bigint)), lambda a, b: a * 256 + b) as v from ips
  where len(list_filter(string_split(ip, '.'), lambda x: cast(x as bigint) > 255 or (length(x) > 1 and x[1] = '0'))) = 0)"""


def _ips(spark, d):
    found = C.extract(table(spark, d, "documents"), "doc_id", "text", {"ipv4": C.INDICATORS["ipv4"]})
    return found.select("doc_id", F.col("value").alias("ip"), I.ipv4(F.col("value")).alias("v")).filter("v is not null")


@query(f"""with {_IPS}, p as (select n_nationkey, (n_nationkey * 8 + 8) || '.0.0.0/' || (5 + n_nationkey % 4) as prefix, cast((n_nationkey * 8 + 8) as bigint) * 16777216 as first, (1::bigint << (27 - n_nationkey % 4)) as size from nation)
select doc_id, ip, n_nationkey, prefix from n join p on v between first and first + size - 1 where first % size = 0""")
def ip_in_prefix(spark, d):
    k = F.col("n_nationkey")
    p = table(spark, d, "nation").select("n_nationkey", F.concat((k * 8 + 8).cast("string"), F.lit(".0.0.0/"), (5 + k % 4).cast("string")).alias("prefix"))
    return E.in_prefix(_ips(spark, d), "v", p, "prefix").select("doc_id", "ip", "n_nationkey", "prefix")


_HOSTS = "hosts as (select page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) as host from pages)"


def _hosts(spark, d):
    return table(spark, d, "pages").select("page_id", I.dns_name(I.authority_host(I.uri_parts(F.col("url"))["authority"])).alias("host"))


@query(f"""with {_HOSTS}, s as (select distinct regexp_replace(host, '^[^.]*\\.', '') as scope from hosts)
select page_id, host, scope from hosts join s on host = scope or ends_with(host, '.' || scope)""")
def name_in_scope(spark, d):
    h = _hosts(spark, d)
    scopes = h.select(F.regexp_replace("host", r"^[^.]*\.", "").alias("scope")).distinct()
    return E.in_scope(h, "host", scopes, "scope").select("page_id", "host", "scope")


@query("""select o_orderkey, cast(o_orderdate as varchar)[1:10] as published, cast(min(l_shipdate) as varchar)[1:10] as received from orders join lineitem on l_orderkey = o_orderkey
where l_shipdate >= o_orderdate and l_shipdate <= timestamp '1998-06-01' group by o_orderkey, o_orderdate""")
def received_claims(spark, d):
    c = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("published"))
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("received"))
    return E.received_claims(c, r, "o_orderkey", F.lit("1998-06-01").cast("date")).select("o_orderkey", F.col("published").cast("string").alias("published"), F.col("received").cast("string").alias("received"))


@query("""select l_orderkey as record_id, count(*) as refs, count(*) filter (l_returnflag = 'N' and l_linenumber % 2 = 0) = 0 as supported, string_agg(distinct l_returnflag, ',' order by l_returnflag) as sources from lineitem group by 1""")
def source_supported(spark, d):
    revision = F.when(~((F.col("l_returnflag") == "N") & (F.col("l_linenumber") % 2 == 0)), F.col("l_linestatus"))
    refs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_returnflag").alias("source_id"), F.lit("d").alias("document"), revision.alias("revision"), F.lit("c").alias("collection"))
    return E.source_supported(refs).select("record_id", "refs", "supported", "sources")


@query("""with v as (select o_orderkey as record_id, case when o_orderstatus <> 'P' then o_orderstatus end as revision from orders)
select record_id, revision, count(distinct l_returnflag) as n, case when revision is null or count(distinct l_returnflag) > 1 then 'unresolved' when count(distinct l_returnflag) = 1 then 'match' else 'no_match' end as status
from v left join lineitem on l_orderkey = record_id and l_linestatus = revision group by record_id, revision""")
def backed_value(spark, d):
    v = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("revision"))
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_linestatus").alias("revision"), F.col("l_returnflag").alias("source_id"))
    return E.backed_value(v, links).select("record_id", "revision", "n", "status")


@query("""with r as (select l_orderkey, l_linenumber, case l_returnflag when 'N' then 'O' when 'A' then 'F' end as declared, case when o_orderstatus <> 'P' then o_orderstatus end as collection_id from lineitem left join orders on o_orderkey = l_orderkey and o_orderkey % 50 <> 0)
select l_orderkey, l_linenumber, case when declared is null or collection_id is null then 'unresolved' when declared = collection_id then 'match' else 'no_match' end as status, count(*) as n from r group by all""")
def collection_context(spark, d):
    """Whether records name the collection of the bundle they came in."""
    flag = F.col("l_returnflag")
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(flag == "N", "O").when(flag == "A", "F").alias("declared"))
    b = table(spark, d, "orders").filter("o_orderkey % 50 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("collection_id"))
    j = E.with_context(r, b, "l_orderkey").withColumn("status", S.equal(F.col("declared"), F.col("collection_id")))
    return j.groupBy("l_orderkey", "l_linenumber", "status").agg(F.count(F.lit(1)).alias("n"))


# claims --------------------------------------------------------------------------------

_AMEND = """am as (select distinct l_orderkey * 10 + l_linenumber as amendment_id, l_orderkey as o_orderkey, case when l_linenumber > 1 and l_quantity > 25 then l_orderkey * 10 + l_linenumber - 1 end as supersedes,
  case l_returnflag when 'R' then 'withdraw' when 'A' then 'correct' else case when l_linenumber % 2 = 0 then 'dispute' else 'reinstate' end end as operation,
  case when l_quantity = 7 then 'unresolved' else 'match' end as support, case when l_quantity = 9 then 'unsupported' when l_shipdate < timestamp '1998-01-01' then 'match' else 'no_match' end as available from lineitem)"""
_STATES = f"""{_AMEND}, act as (select * from am where support = 'match' and available = 'match'),
cur as (select * from act where amendment_id not in (select supersedes from act where supersedes is not null)),
g as (select o_orderkey, bool_or(operation = 'withdraw') as w, bool_or(operation = 'correct') as c, bool_or(operation = 'dispute') as d, bool_or(operation = 'reinstate') as r from cur group by 1),
u as (select distinct o_orderkey, true as u from am where support <> 'match' or available = 'unsupported'),
st as (select o.o_orderkey, o_custkey, case when u then 'unresolved_amendment_context' when d or (r and (w or c)) then 'contested' when c then 'corrected' when w then 'withdrawn' else 'reported' end as state
  from orders o left join g using (o_orderkey) left join u using (o_orderkey))"""


def _amendments(spark, d):
    l, key, q = table(spark, d, "lineitem"), F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_quantity")
    flag = F.col("l_returnflag")
    op = F.when(flag == "R", "withdraw").when(flag == "A", "correct").when(F.col("l_linenumber") % 2 == 0, "dispute").otherwise("reinstate")
    available = F.when(q == 9, S.UNSUPPORTED).when(F.col("l_shipdate") < F.expr("timestamp_ntz'1998-01-01'"), S.YES).otherwise(S.NO)
    return l.select(
        key.alias("amendment_id"), F.col("l_orderkey").alias("o_orderkey"), op.alias("operation"), F.when((F.col("l_linenumber") > 1) & (q > 25), key - 1).alias("supersedes"),
        F.when(q == 7, S.UNRESOLVED).otherwise(S.YES).alias("support"), available.alias("available")).distinct()


@query(f"with {_STATES} select o_orderkey, state from st")
def amendment_states(spark, d):
    return G.amendment_state(table(spark, d, "orders").select("o_orderkey"), _amendments(spark, d), "o_orderkey")


@query(f"""with {_STATES}, p as (select o_custkey, bool_or(state in ('unresolved_amendment_context', 'contested')) as gaps, bool_or(state in ('corrected', 'withdrawn')) as ended from st group by 1),
q as (select o_orderkey, state, case when gaps then 'unresolved' when ended then 'no_match' else 'match' end as support_status, o_orderkey % 2 = 0 as enabled from st join p using (o_custkey)),
f as (select *, case when not enabled then 'not_selected' when state in ('unresolved_amendment_context', 'contested') then 'unresolved' when state in ('corrected', 'withdrawn') then 'suppressed' else 'retained_in_supplied_scope' end as chosen from q),
m as (select o_orderkey, 'retain_reports' as mode, chosen as disposition from f union all select o_orderkey, 'require_unwithdrawn_in_scope', case when support_status = 'match' then chosen else support_status end from f)
select o_orderkey, mode, disposition, disposition in ('not_selected', 'retained_in_supplied_scope') as returned from m""")
def amendment_filter(spark, d):
    states = G.amendment_state(table(spark, d, "orders").select("o_orderkey", "o_custkey"), _amendments(spark, d), "o_orderkey")
    rows = states.join(G.amendment_support(states, "o_custkey"), "o_custkey")
    run = lambda mode: G.amendment_filter(rows, mode, F.col("o_orderkey") % 2 == 0).select("o_orderkey", F.lit(mode).alias("mode"), "disposition", "returned")
    return run("retain_reports").unionByName(run("require_unwithdrawn_in_scope"))


_SUPERSEDES = "am as (select distinct l_orderkey, l_linenumber as id, l_partkey % 7 + 1 as supersedes from lineitem)"


@query(f"""with recursive {_SUPERSEDES}, e as (select a.* from am a where exists (select 1 from am b where b.l_orderkey = a.l_orderkey and b.id = a.supersedes)),
walk as (select l_orderkey, id as start, supersedes as cur from e union select w.l_orderkey, start, e.supersedes from walk w join e on e.l_orderkey = w.l_orderkey and e.id = w.cur)
select distinct l_orderkey from walk where start = cur""")
def supersession_cycles(spark, d):
    am = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("id"), (F.col("l_partkey") % 7 + 1).cast("long").alias("supersedes"))
    return cycle_members(am, "l_orderkey", "id", "supersedes").select("l_orderkey").distinct()


@query(f"""with recursive {_SUPERSEDES}, walk as (select l_orderkey, id as start, supersedes as cur from am union select w.l_orderkey, start, e.supersedes from walk w join am e on e.l_orderkey = w.l_orderkey and e.id = w.cur),
m as (select distinct l_orderkey, start as node from walk where start = cur), r as (select distinct l_orderkey, start, cur from walk)
select m.l_orderkey, m.node, count(*) as cycle_size from m join r a on a.l_orderkey = m.l_orderkey and a.start = m.node join r b on b.l_orderkey = m.l_orderkey and b.start = a.cur and b.cur = m.node group by all""")
def supersession_cycle_members(spark, d):
    """Every amendment that supersedes itself through others, with how many stand on cycles with it."""
    am = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("id"), (F.col("l_partkey") % 7 + 1).cast("long").alias("supersedes"))
    found = cycle_members(am, "l_orderkey", "id", "supersedes")
    sizes = found.groupBy("l_orderkey", "cycle").agg(F.count(F.lit(1)).alias("cycle_size"))
    return found.join(sizes, ["l_orderkey", "cycle"]).select("l_orderkey", "node", "cycle_size")


_POLICY = """raw as (select distinct l_orderkey, l_linenumber, case when l_quantity <> 12 then l_orderkey end as scope_key, case when l_linenumber <> 7 then l_linenumber % 3 end as part_key, l_quantity <> 13 as enabled, l_linenumber = 1 as required, l_discount > 0.05 and l_quantity = 50 as cut,
  case when l_returnflag = 'N' and l_quantity < 10 then 'no_match' when l_quantity = 11 then 'unresolved' else 'match' end as applies,
  case when l_tax > 0.07 and l_quantity > 49 then 'match' when l_tax > 0.07 and l_quantity > 48 then 'unresolved' else 'no_match' end as w0,
  case when l_discount < 0.01 and l_quantity > 48 then 'match' when l_quantity = 30 then 'unsupported' else 'no_match' end as a0, case when l_quantity = 1 and l_tax = 0.0 and l_discount = 0.0 then 'match' else 'no_match' end as x0 from lineitem),
r as (select *, case when applies = 'no_match' then 'no_match' when part_key is null then 'unresolved' when applies <> 'match' then applies else w0 end as w,
  case when applies = 'no_match' then 'match' when part_key is null then 'unresolved' when applies <> 'match' then applies else a0 end as a,
  case when applies = 'no_match' then 'no_match' when part_key is null then 'unresolved' else x0 end as x from raw where enabled),
g as (select scope_key, part_key, bool_or(w = 'match') as w, bool_or(a = 'match') as a, bool_or(x = 'match') as x, bool_or(w in ('unresolved', 'unsupported')) as u, bool_or(cut) as p from r where applies <> 'no_match' group by all),
v as (select scope_key, part_key, case when x or (w and a) then 'contested' when p then 'unresolved' when w then 'suppress' when u then 'unresolved' else 'keep' end as verdict from g), s as (select scope_key, bool_or(verdict = 'suppress') as gone from v group by 1),
d as (select r.*, case when gone then 'suppressed' when applies = 'no_match' or verdict = 'keep' then 'kept' else verdict end as decision from r left join v on v.scope_key is not distinct from r.scope_key and v.part_key is not distinct from r.part_key left join s on s.scope_key is not distinct from r.scope_key)"""


def _decided(spark, d):
    q, t, dis = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(q != 12, F.col("l_orderkey")).alias("scope_key"), F.when(F.col("l_linenumber") != 7, F.col("l_linenumber") % 3).alias("part_key"),
        (q != 13).alias("enabled"), (F.col("l_linenumber") == 1).alias("required"), ((dis > 0.05) & (q == 50)).alias("cut"),
        F.when((F.col("l_returnflag") == "N") & (q < 10), S.NO).when(q == 11, S.UNRESOLVED).otherwise(S.YES).alias("applies"),
        F.when((t > 0.07) & (q > 49), S.YES).when((t > 0.07) & (q > 48), S.UNRESOLVED).otherwise(S.NO).alias("when"),
        F.when((dis < 0.01) & (q > 48), S.YES).when(q == 30, S.UNSUPPORTED).otherwise(S.NO).alias("allow"),
        F.when((q == 1) & (t == 0.0) & (dis == 0.0), S.YES).otherwise(S.NO).alias("conflict")).distinct()
    return G.resolve_policies(G.policy_statuses(rows), "part_key", "scope_key", "cut")


@query(f"with {_POLICY} select l_orderkey, l_linenumber, decision, count(*) as n from d group by all")
def policy_decisions(spark, d):
    return _decided(spark, d).groupBy("l_orderkey", "l_linenumber", "decision").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_POLICY}, e as (select *, case when decision in ('contested', 'unresolved') then 'unresolved' else w end as own from d)
select l_orderkey, l_linenumber, case when decision = 'suppressed' then 'suppressed' when not required or (own = 'no_match' and a = 'match') then 'returned' when own = 'unsupported' or a = 'unsupported' then 'unsupported' else 'unresolved' end as control, count(*) as n from e group by all""")
def required_controls(spark, d):
    return G.required_controls(_decided(spark, d)).groupBy("l_orderkey", "l_linenumber", "control").agg(F.count(F.lit(1)).alias("n"))


@query("""with e as (select user_id, event_id, epoch_us(date_trunc('hour', ts)) as lo, case when event_id % 977 <> 0 then epoch_us(date_trunc('hour', ts)) + event_id % 3 * 1800000000 end as hi from events),
o as (select a.user_id, a.event_id, min(b.lo) as other from e a left join (select user_id, event_id, lo from e) b on b.user_id = a.user_id and b.event_id <> a.event_id group by all)
select e.user_id, coalesce(min(e.event_id) filter (hi <= coalesce(other, hi)), -1) as earliest, case when count(*) filter (hi <= coalesce(other, hi)) > 0 then 'resolved' else 'unresolved' end as status, count(*) as n from e join o using (event_id) group by all""")
def earliest_establishment(spark, d):
    lo = F.unix_micros(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    k = F.col("event_id")
    rows = table(spark, d, "events").select("user_id", "event_id", lo.alias("lo"), F.when(k % 977 != 0, lo + k % 3 * 1_800_000_000).alias("hi"))
    return G.earliest(rows, "user_id", "lo", "hi", "event_id").withColumn("earliest", F.coalesce("earliest", F.lit(-1)))


@query("""select user_id || ':' || event_type as claim, epoch_us(min(ts)) as first_seen, epoch_us(max(ts)) as last_seen, min(ts) between timestamp '2024-01-02' and timestamp '2024-01-31' as novel from events group by 1""")
def novelty(spark, d):
    us = lambda t: F.unix_micros(F.lit(t).cast("timestamp"))
    rows = table(spark, d, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("claim"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return G.novelty(rows, "claim", "at", us("2024-01-02"), us("2024-01-31"))


@query(f"""with m as (select distinct l_suppkey, {M.member_sql('l_returnflag', 'l_linestatus', 'l_linenumber')} as h from lineitem), r as {M.roots_sql('m', 'l_suppkey')}
select l_suppkey, n as members, digest, count(*) over (partition by digest) as equal_sets from r""")
def file_sets(spark, d):
    return M.equal_sets(M.set_digests(table(spark, d, "lineitem"), "l_suppkey", ["l_returnflag", "l_linestatus", "l_linenumber"]))


_FILES = """f as (select l_suppkey as s, l_partkey % 40 as path, max(l_linenumber) as content, l_suppkey % 2 as half from lineitem group by l_suppkey, l_partkey % 40, l_suppkey % 2),
p as (select s_suppkey as a, s_suppkey + 1 as b from supplier where s_suppkey + 1 in (select s_suppkey from supplier)), k as (select distinct a, b, path from p join f on s = a or s = b)"""


def _files(spark, d):
    f = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 40).alias("path")).agg(F.max("l_linenumber").alias("content"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"))
    return f, s.withColumn("b", F.col("a") + 1).join(s.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")


@query(f"""with {_FILES} select k.a, k.b, k.path, case when y.s is null then 'missing' when x.s is null then 'extra' else 'changed' end as fault
from k left join f x on x.s = k.a and x.path = k.path left join f y on y.s = k.b and y.path = k.path where x.s is null or y.s is null or x.content <> y.content""")
def file_set_differences(spark, d):
    """Files by which each supplier's set differs from the next one's."""
    f, pairs = _files(spark, d)
    return M.differences(f, pairs, "s", "path", ["content"])


@query(f"""with {_FILES}, c as (select distinct a, path from p join f on s = a where content = 7), n as (select p.a, p.b, c.path from p left join c on c.a = p.a)
select n.a, n.b, count(n.path) as chosen, count(y.s) as shared, case when count(n.path) = 0 then 'unresolved' when count(n.path) = count(y.s) then 'match' else 'no_match' end as status from n left join f y on y.s = n.b and y.path = n.path group by all""")
def paths_in_both(spark, d):
    """Whether each supplier's last files stand in the next one's set too."""
    f, pairs = _files(spark, d)
    return K.paths_in_both(f, pairs, "s", "path", f.filter("content = 7").select(F.col("s").alias("a"), "path"))


@query("""with m as (select distinct o_custkey as s, o_orderpriority || o_orderstatus || year(o_orderdate) as m from orders), z as (select s, count(*) as n from m group by 1),
j as (select x.s as a, y.s as b, count(*) as held from m x join m y on x.m = y.m and x.s <> y.s group by all) select a, b, n as size from j join z on z.s = a where held = n""")
def contained_sets(spark, d):
    """Customers all of whose kinds of orders another customer has too."""
    kind = F.concat("o_orderpriority", "o_orderstatus", F.year("o_orderdate").cast("string"))
    return K.contained_sets(table(spark, d, "orders").select("o_custkey", kind.alias("kind")), "o_custkey", "kind")


@query("""with c as (select s_suppkey as profile, 'Brand#' || (s_suppkey % 5 + 1) as brand, s_suppkey % 46 + s_acctbal / 10000 as low, s_suppkey % 46 + 4.5 + s_acctbal / 10000 as high, s_suppkey % 3 = 0 as loose from supplier)
select p_partkey, profile from part join c on (loose or p_brand = brand) and p_size between low and high and p_partkey % 9 <> 0""")
def profile_index(spark, d):
    """Parts and the suppliers' profiles that they meet, a ninth of them with a second size that meets none."""
    p, k = table(spark, d, "part"), F.col("s_suppkey")
    value = lambda name, c: F.struct(F.lit(name).alias("field"), c.cast("string").alias("value"))
    second = F.when(F.col("p_partkey") % 9 == 0, value("size", F.lit(-1000)))
    values = p.select("p_partkey", F.explode(F.filter(F.array(value("brand", F.col("p_brand")), value("size", F.col("p_size")), second), lambda x: x.isNotNull())).alias("v")).select("p_partkey", "v.field", "v.value")
    none, low = F.lit(None).cast("double"), k % 46 + F.col("s_acctbal") / 10000
    text = F.struct(F.lit("brand").alias("field"), F.lit("text").alias("kind"), F.array(F.concat(F.lit("Brand#"), (k % 5 + 1).cast("string"))).alias("allowed"), none.alias("low"), none.alias("high"))
    size = F.struct(F.lit("size").alias("field"), F.lit("range").alias("kind"), F.array().cast("array<string>").alias("allowed"), low.alias("low"), (k % 46 + 4.5 + F.col("s_acctbal") / 10000).alias("high"))
    criteria = table(spark, d, "supplier").select(k.alias("profile"), F.explode(F.filter(F.array(F.when(k % 3 != 0, text), size), lambda x: x.isNotNull())).alias("c")).select("profile", "c.*")
    return K.matching_profiles(values, criteria, "p_partkey")


@query("""with d as (select o_custkey, o_orderkey, o_totalprice, case when o_orderkey % 20 <> 0 then o_orderdate end as at_day from orders),
g as (select *, case when at_day is null then 2 when at_day between timestamp '1997-01-01' and timestamp '1998-12-31' then 0 else 1 end as visit from d),
r as (select *, row_number() over (partition by o_custkey order by visit, o_totalprice desc, o_orderkey) as place, count(*) over (partition by o_custkey) as candidates from g)
select o_custkey, o_orderkey, visit, place, candidates, candidates > 5 as partial from r where place <= 5""")
def candidate_budget(spark, d):
    day = lambda t: F.expr(f"timestamp_ntz'{t}'")
    seen = F.when(F.col("o_orderkey") % 20 != 0, F.col("o_orderdate"))
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", G.visit_priority(seen, day("1997-01-01"), day("1998-12-31")).alias("visit"))
    order = [F.col("visit"), F.desc("o_totalprice"), F.col("o_orderkey")]
    return G.ranked_results(rows, "o_custkey", order, 5).select("o_custkey", "o_orderkey", "visit", "place", "candidates", "partial")


_DIAGNOSED = """r as (select o_custkey, o_orderstatus = 'F' and o_orderkey % 4 = 0 as qualified, o_orderstatus = 'P' as optional,
  case when o_orderstatus = 'F' and o_orderkey % 4 = 0 then null when o_orderstatus = 'P' then 'unresolved' when o_orderkey % 31 = 0 then 'unsupported' when o_orderkey % 17 = 0 then 'unresolved' when o_orderkey % 5 = 0 then 'suppressed' when o_orderkey % 3 = 0 then 'outside_scope' end as status from orders)"""


@query(f"""with {_DIAGNOSED}, g as (select o_custkey, count(*) as examined, count(*) filter (qualified) as qualified, coalesce(bool_or(status in ('unresolved', 'unsupported')), false) as gaps,
  list(distinct status) filter (not optional and status is not null) as said from r group by 1)
select o_custkey, examined, qualified, least(qualified, 2) as returned, qualified > 2 as truncated, case when qualified > 0 then case when gaps then 'qualified_evidence_with_gaps' else 'qualified_evidence' end
  when list_contains(said, 'unsupported') then 'unsupported' when list_contains(said, 'unresolved') then 'unresolved' when list_contains(said, 'suppressed') then 'suppressed' when list_contains(said, 'outside_scope') then 'outside_scope' else 'no_qualifying_result' end as outcome from g""")
def run_outcomes(spark, d):
    from pivotloom.operators import results as R

    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    good = (status == "F") & (k % 4 == 0)
    said = F.when(good, None).when(status == "P", "unresolved").when(k % 31 == 0, "unsupported").when(k % 17 == 0, "unresolved").when(k % 5 == 0, "suppressed").when(k % 3 == 0, "outside_scope")
    rows = table(spark, d, "orders").select("o_custkey", good.alias("qualified"), (status == "P").alias("optional"), said.alias("status"))
    return R.run_outcome(rows, "o_custkey", 2)


@query("""with l as (select l_orderkey, list(l_linenumber) as lines from lineitem group by 1), p as (select o_orderkey, o_orderstatus as mode, o_orderpriority as level, coalesce(lines, []) as lines, o_orderkey % 9 = 0 as stray, o_orderkey % 13 = 0 as bare from orders left join l on l_orderkey = o_orderkey)
select o_orderkey, 'mode' as name, 'missing' as fault from p where bare union all select o_orderkey, 'mode', 'enum' from p where not bare and mode not in ('F', 'O')
union all select o_orderkey, 'level', 'missing_here' from p where not bare and mode = 'P' and level not in ('1-URGENT', '2-HIGH') union all select o_orderkey, 'lines', 'too_few' from p where len(lines) = 1
union all select o_orderkey, 'mode', 'given_twice' from p where not bare and o_orderkey % 17 = 0 union all select o_orderkey, 'lines', 'repeated' from p where len(list_distinct(lines)) < len(lines) union all select o_orderkey, 'lines', 'not_allowed' from p where len(lines) > 0 and (bare or mode <> 'F') union all select o_orderkey, 'stray', 'unknown' from p where stray""")
def parameter_rules(spark, d):
    from pivotloom.operators import results as R

    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.col("l_linenumber").cast("string")).alias("lines"))
    o = table(spark, d, "orders").join(l, "o_orderkey", "left")
    k, one = F.col("o_orderkey"), lambda c: F.array(F.col(c).cast("string"))
    entry = lambda name, items, when: F.when(when, F.struct(F.lit(name).alias("name"), items.alias("items")))
    entries = F.array(
        entry("mode", one("o_orderstatus"), k % 13 != 0), entry("mode", one("o_orderstatus"), (k % 13 != 0) & (k % 17 == 0)), entry("level", one("o_orderpriority"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")),
        entry("lines", F.col("lines"), F.col("lines").isNotNull()), entry("stray", one("o_orderkey"), k % 9 == 0))
    sets = o.select("o_orderkey", F.explode(F.filter(entries, lambda x: x.isNotNull())).alias("e")).select("o_orderkey", "e.name", "e.items")
    rules = {"mode": {"required": True, "enum": ["F", "O"]}, "level": {"requires_when": ("mode", "P")}, "lines": {"min_items": 2, "unique": True, "allowed_when": ("mode", "F")}}
    return R.rule_faults(sets, "o_orderkey", rules, o.select("o_orderkey"))


# identities and scans ------------------------------------------------------------------


@query("""select page_id, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) as scheme, regexp_extract(url, '://([^/?#]*)', 1) as authority, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path,
  case when contains(split_part(url, '#', 1), '?') then regexp_extract(url, '\\?([^#]*)', 1) end as query, case when contains(url, '#') then regexp_extract(url, '#(.*)$', 1) end as fragment,
  lower(regexp_extract(url, '://([^/?#:]*)', 1)) as host, 'dns' as host_kind from pages""")
def uri_parts(spark, d):
    p = table(spark, d, "pages").select("page_id", I.uri_parts(F.col("url")).alias("u"))
    return p.select("page_id", F.lower("u.scheme").alias("scheme"), "u.authority", "u.path", "u.query", "u.fragment", I.dns_name(I.authority_host(F.col("u.authority"))).alias("host"), I.host_kind(F.col("u.authority")).alias("host_kind"))


@query("""select doc_id, sha256(text) as computed, strlen(text) as bytes, case when doc_id % 9 = 0 then 'unresolved' when doc_id % 10 = 0 then 'unsupported'
  when doc_id % 7 = 0 and sha256(text) <> sha256(coalesce(lang, '') || text) then 'invalid' when doc_id % 8 = 0 and strlen(text) <> n_chars then 'invalid' else 'match' end as status from documents""")
def content_matches(spark, d):
    k, text = F.col("doc_id"), F.col("text")
    reported = F.when(k % 9 == 0, None).when(k % 7 == 0, F.sha2(F.concat(F.coalesce("lang", F.lit("")), "text"), 256)).otherwise(F.upper(F.sha2(text, 256)))
    length = F.when(k % 8 == 0, F.col("n_chars")).otherwise(F.octet_length(text))
    status = I.content_matches(text, I.digest(reported, "sha256"), length, F.when(k % 10 == 0, "normalised_text").otherwise("exact_source_bytes"))
    return table(spark, d, "documents").select("doc_id", F.sha2(text, 256).alias("computed"), F.octet_length(text).cast("long").alias("bytes"), status.alias("status"))


@query("""with s as (select doc_id, text, min(doc_id) over (partition by text) as class_id, source from documents where text is not null), g as (select class_id, count(*) as members, count(distinct source) as recipes from s group by 1),
r as (select class_id, source, count(*) as own from s group by all)
select doc_id, class_id, own - 1 as matches, members - own as unresolved from s join g using (class_id) join r using (class_id, source)""")
def typed_equal(spark, d):
    s = table(spark, d, "documents").filter("text is not null").select("doc_id", F.col("source").alias("recipe"), F.sha2("text", 256).alias("value"))
    return I.equality_classes(s, "doc_id", "recipe", "value").select("doc_id", "class_id", "matches", "unresolved")


@query("select event_id, md5(user_id || ',' || event_type || ',' || event_id % 7) as ja3, case when event_id % 2 = 0 then 'client' else 'server' end as role from events")
def fingerprints(spark, d):
    text = F.concat_ws(",", F.col("user_id").cast("string"), "event_type", (F.col("event_id") % 7).cast("string"))
    return table(spark, d, "events").select("event_id", I.digest(F.md5(text), "md5").alias("ja3"), F.when(F.col("event_id") % 2 == 0, "client").otherwise("server").alias("role"))


@query("""select p_partkey, p_brand as issuer, lower(to_hex(p_partkey + 255)) as serial, 'ff' || repeat('0', 28) || printf('%08x', p_partkey) as long_serial, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || ['8','9','a','b'][(instr('0123456789abcdef', substring(h, 17, 1)) - 1) % 4 + 1] || substring(h, 18, 3) || '-' || substring(h, 21, 12) as file_id
from (select *, sha1(unhex('6BA7B8119DAD11D180B400C04FD430C8') || encode(p_name || ' ' || p_partkey)) as h from part)""")
def issuer_serials(spark, d):
    serial = (F.col("p_partkey") + 255).cast("string")
    # 255 * 2^144 and the key, as 160-bit serials in decimal digits
    wide = F.concat(F.lit(str((255 << 144) // 10**12)), F.lpad((F.lit((255 << 144) % 10**12) + F.col("p_partkey")).cast("string"), 12, "0"))
    return table(spark, d, "part").select(
        "p_partkey", F.col("p_brand").alias("issuer"), I.serial_hex(serial, 10).alias("serial"), I.serial_hex(wide, 10).alias("long_serial"),
        I.file_uuid("6BA7B8119DAD11D180B400C04FD430C8", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))).alias("file_id"))


_FILE = """case doc_id % 5 when 0 then '{"hashes":{"MD5":"' || md5(text) || '"},"name":"' || source || '"}' when 1 then '{"hashes":{"SHA-256":"' || sha256(text) || '"}}' when 2 then '{"hashes":{"AAA":"x"},"name":"' || source || '"}' when 3 then '{"name":"' || source || '"}' end"""


@query(f"""select doc_id, 'file--' || substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || ['8','9','a','b'][(instr('0123456789abcdef', substring(h, 17, 1)) - 1) % 4 + 1] || substring(h, 18, 3) || '-' || substring(h, 21, 12) as file_ref
from (select doc_id, sha1(unhex('{I.OBJECT_NAMESPACE}') || encode({_FILE})) as h from documents where text is not null and source is not null)""")
def file_refs(spark, d):
    """Files' identifiers by their chosen hash and name, of which some have only one and some neither."""
    k, text = F.col("doc_id") % 5, F.col("text")
    hashes = F.when(k == 0, F.create_map(F.lit("SHA-256"), F.sha2(text, 256), F.lit("MD5"), F.md5(text))).when(k == 1, F.create_map(F.lit("ZZZ"), F.lit("y"), F.lit("SHA-256"), F.sha2(text, 256), F.lit("MD5"), F.lit(None).cast("string"))).when(k == 2, F.create_map(F.lit("ZZZ"), F.lit("y"), F.lit("AAA"), F.lit("x")))
    docs = table(spark, d, "documents").filter("text is not null and source is not null")
    return docs.select("doc_id", I.file_ref(hashes, F.when(k.isin(0, 2, 3), F.col("source")).otherwise("")).alias("file_ref"))


@query("""select doc_id, sha256(encode(text)) as spki_sha256, md5(encode(text)) as md5, sha1(encode(text)) as sha1, 'der|' || coalesce(lang, '') || '|' || sha256(encode(text)) as material,
  case when source is null or lang is null then 'unresolved' when lang = 'en' then 'match' else 'unresolved' end as same_as_english from documents""")
def material_digests(spark, d):
    docs = table(spark, d, "documents")
    pem = F.concat(F.lit("-----BEGIN CERTIFICATE-----\n"), F.base64(F.encode("text", "utf-8")), F.lit("\n-----END CERTIFICATE-----"))
    der = I.der_bytes(pem)
    own = I.material(F.lit("der"), F.col("lang"), der)
    same = I.compare(own["kind"], own["recipe"], own["value"], F.lit("der"), F.lit("en"), own["value"])
    return docs.select("doc_id", F.sha2(der, 256).alias("spki_sha256"), F.md5(der).alias("md5"), F.sha1(der).alias("sha1"), F.concat_ws("|", own["kind"], F.coalesce(own["recipe"], F.lit("")), own["value"]).alias("material"),
                       F.when(F.col("source").isNull() | F.col("lang").isNull(), S.UNRESOLVED).otherwise(same).alias("same_as_english"))


_SCAN = " union all ".join(f"select doc_id, '{k}' as kind, unnest(regexp_extract_all(text, '{p}')) as value from documents" for k, p in {**C.INDICATORS, **C.CREDENTIALS}.items())
_ENDS = " or ".join(f"value = '{n}' or ends_with(value, '.{n}')" for n in C.SPECIAL_DOMAINS)
_FIND = f"""case when kind = 'ipv4' then not ({' or '.join(f"starts_with(value, '{n}')" for n in C.DOCUMENTATION_NETS)}) when kind = 'domain' then not ({_ENDS})
  when kind in ({', '.join(f"'{k}'" for k in C.CREDENTIALS)}) then not regexp_matches(value, '{C.REDACTED}') else true end"""


@query(f"select doc_id, kind, value, count(*) as n from ({_SCAN}) where {_FIND} group by all")
def content_scan(spark, d):
    found = C.extract(table(spark, d, "documents"), "doc_id", "text", {**C.INDICATORS, **C.CREDENTIALS})
    return found.filter(C.counts_as_find(F.col("kind"), F.col("value"))).groupBy("doc_id", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


@query("select conv_id, turn, " + ", ".join(f"regexp_matches(text, '{p}') as {k}" for k, p in C.COMMANDS.items()) + ", count(*) as n from conversations group by all")
def command_scan(spark, d):
    found = table(spark, d, "conversations").select("conv_id", "turn", *C.flags(F.col("text"), C.COMMANDS))
    return found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("n"))


@query(r"select doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) as compact_sha, upper(regexp_replace(source || ' by-' || lang, '[^A-Za-z0-9]+', '_', 'g')) as relation from documents")
def string_forms(spark, d):
    from pivotloom.operators.pivot import relation_name

    return table(spark, d, "documents").select("doc_id", F.sha2(C.compact(F.col("text")), 256).alias("compact_sha"), relation_name(F.concat("source", F.lit(" by-"), "lang")).alias("relation"))


@query("""select event_id, cast(json_extract(props, '$.k') as bigint) as k, sha256('{"k":' || json_extract_string(props, '$.k') || '}') as digest from events""")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.parse_json("props"), C.pointer_path("/k"), "bigint").alias("k"), C.canonical_digest(F.col("props")).alias("digest"))


@query(f"""with {_HOSTS} select page_id, host, ends_with(host, '.example.com') or ends_with(host, '.example.net') or ends_with(host, '.example.org') as special, split_part(host, '.', -1) in {C.ENDINGS} as sensitive,
  not regexp_matches(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '//|/$') as literal_path from hosts join pages using (page_id)""")
def host_and_path_checks(spark, d):
    p = table(spark, d, "pages").select("page_id", I.uri_parts(F.col("url")).alias("u"))
    host = I.dns_name(I.authority_host(F.col("u.authority")))
    return p.select("page_id", host.alias("host"), C.special_use(host).alias("special"), C.sensitive_tld(host).alias("sensitive"), C.literal_path(F.col("u.path")).alias("literal_path"))


@query("""select l_orderkey, l_linenumber, epoch(l_shipdate)::bigint - epoch(o_orderdate)::bigint as seconds, epoch(l_shipdate) - epoch(o_orderdate) between 86400 and 2592000 as in_range, count(*) as n from lineitem join orders on o_orderkey = l_orderkey group by all""")
def validity_durations(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    s = (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) - F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("seconds")
    return j.select("l_orderkey", "l_linenumber", s).withColumn("in_range", F.col("seconds").between(86400, 2592000)).groupBy("l_orderkey", "l_linenumber", "seconds", "in_range").agg(F.count(F.lit(1)).alias("n"))


@query("""with g as (select p_partkey, case when bool_and(b) then 'match' when bool_or(b = false) then 'no_match' else 'unresolved' end as economy from (
  select p_partkey, unnest([p_type = 'ECONOMY', p_brand = 'Brand#1' or p_brand = 'Brand#3', p_size between 5 and 30]) as b from part) group by 1),
h as (select p_partkey, case when p_size between 31 and 50 then 'match' else 'no_match' end as large from part)
select p_partkey, 'economy' as profile, economy as status from g union all select p_partkey, 'large', large from h""")
def profile_matches(spark, d):
    values = table(spark, d, "part").select("p_partkey", F.explode(F.expr("map('p_type', p_type, 'p_brand', p_brand, 'p_size', cast(p_size as string))")).alias("field", "value"))
    criteria = spark.createDataFrame(
        [("economy", "p_type", "text", ["ECONOMY"], None, None), ("economy", "p_brand", "text", ["Brand#1", "Brand#3"], None, None), ("economy", "p_size", "range", None, 5.0, 30.0), ("large", "p_size", "range", None, 31.0, 50.0)],
        "profile string, field string, kind string, allowed array<string>, low double, high double")
    return E.profile_matches(table(spark, d, "part").select("p_partkey"), "p_partkey", values, criteria)


# checks and exports --------------------------------------------------------------------


@query("select l_orderkey || '/' || l_linenumber as id, count(*) as n from lineitem group by 1 having count(*) > 1")
def duplicate_identities(spark, d):
    return table(spark, d, "lineitem").groupBy(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("""select 'user' as reference, user_id as missing, count(*) as n from events where user_id not in (select s_suppkey from supplier) group by all
union all select 'label', doc_id, count(*) from documents where doc_id not in (select doc_id from labels) group by all""")
def dangling_references(spark, d):
    def part(rows, key, known, name):
        return rows.join(known.withColumnRenamed(known.columns[0], key), key, "left_anti").groupBy(F.lit(name).alias("reference"), F.col(key).alias("missing")).agg(F.count(F.lit(1)).alias("n"))

    a = part(table(spark, d, "events").select("user_id"), "user_id", table(spark, d, "supplier").select("s_suppkey"), "user")
    return a.unionByName(part(table(spark, d, "documents").select("doc_id"), "doc_id", table(spark, d, "labels").select("doc_id"), "label"))


@query("""select c_custkey as id, 'negative_balance' as rule from customer where c_acctbal < 0 union all select c_custkey, 'unknown_segment' from customer where c_mktsegment not in ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
union all select c_custkey, 'low_key' from customer where c_custkey < 10""")
def field_rules(spark, d):
    broken = F.filter(F.array(F.when(F.col("c_acctbal") < 0, "negative_balance"), F.when(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD"), "unknown_segment"), F.when(F.col("c_custkey") < 10, "low_key")), lambda x: x.isNotNull())
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.explode(broken).alias("rule"))


@query("select p_type as value, count(*) as uses from part where p_type not in (select distinct upper(split_part(p_name, ' ', 1)) from part) group by 1")
def vocabulary_drift(spark, d):
    p = table(spark, d, "part")
    catalogue = p.select(F.upper(F.split("p_name", " ")[0]).alias("value")).distinct()
    return p.select(F.col("p_type").alias("value")).join(catalogue, "value", "left_anti").groupBy("value").agg(F.count(F.lit(1)).alias("uses"))


@query("""with a as (select l_partkey, l_suppkey, count(*) as n from lineitem where l_shipdate < timestamp '1998-01-01' group by all), b as (select l_partkey, l_suppkey, count(*) as n from lineitem where l_shipdate >= timestamp '1998-01-01' group by all)
select coalesce(a.l_partkey, b.l_partkey) as l_partkey, coalesce(a.l_suppkey, b.l_suppkey) as l_suppkey, coalesce(a.n, 0) - coalesce(b.n, 0) as surplus from a full join b on a.l_partkey = b.l_partkey and a.l_suppkey = b.l_suppkey where coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def multiset_difference(spark, d):
    side = F.when(F.col("l_shipdate") < F.expr("timestamp_ntz'1998-01-01'"), 1).otherwise(-1)
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum(side).alias("surplus")).filter("surplus <> 0")


@query(f"""with m as (select distinct source, {M.member_sql("'100644'", 'doc_id', 'n_chars', 'sha256(text)')} as h from documents), r as {M.roots_sql('m', 'source')} select source, n as members, digest from r""")
def snapshot_digests(spark, d):
    rows = table(spark, d, "documents").select("source", F.lit("100644").alias("mode"), "doc_id", "n_chars", F.sha2("text", 256).alias("sha"))
    return M.set_digests(rows, "source", ["mode", "doc_id", "n_chars", "sha"])


_UUID = "substring({h}, 1, 8) || '-' || substring({h}, 9, 4) || '-5' || substring({h}, 14, 3) || '-' || ['8','9','a','b'][(instr('0123456789abcdef', substring({h}, 17, 1)) - 1) % 4 + 1] || substring({h}, 18, 3) || '-' || substring({h}, 21, 12)"


def _uuid_sql(kind: str, name: str) -> str:
    h = f"sha1(unhex('6BA7B8119DAD11D180B400C04FD430C8') || encode('{kind}|' || {name}))"
    return f"'{kind}--' || list_transform([{h}], lambda h: {_UUID.format(h='h')})[1]"


_EDGE_NAME = "concat_ws('|', src, dst, relation, coalesce(cast(seen as varchar), ''), source)"
_STIX = f"""e as (select distinct * from edges), ends as (select distinct unnest([src, dst]) as id from e), extension as (select {_uuid_sql('extension-definition', "'pivot-evidence'")} as x),
ids as (select *, {_uuid_sql('file', 'src')} as a, {_uuid_sql('file', 'dst')} as b, {_uuid_sql('observed-data', _EDGE_NAME)} as o, {_uuid_sql('relationship', _EDGE_NAME)} as r, {_uuid_sql('note', _EDGE_NAME)} as n from e),
objects as (select 'file' as type, {_uuid_sql('file', 'id')} as id, '"name":"' || label || '"' as said, []::varchar[] as refs from ends join nodes using (id)
  union all select 'observed-data', o, '"object_refs":["' || a || '","' || b || '"]' || coalesce(',"first_observed":"' || cast(seen as varchar) || '"', ''), [a, b] from ids
  union all select 'relationship', r, '"source_ref":"' || a || '","target_ref":"' || b || '","relationship_type":"' || relation || '"', [a, b] from ids
  union all select 'note', n, '"object_refs":["' || r || '"],"content":"' || source || '"', [r, x] from ids, extension
  union all select 'extension-definition', x, '"name":"pivot-evidence"', [] from extension)"""


@query(f"""with {EDGES_SQL}, {NODES_SQL}, {_STIX} select type, id, sha256('{{"type":"' || type || '","id":"' || id || '",' || said || '}}') as json_sha256 from objects""")
def stix_objects(spark, d):
    """Every object of the whole graph's export, with the digest of its JSON text."""
    from pivotloom.sources.exports import to_stix

    return to_stix(nodes(spark, d), edges(spark, d)).select("type", "id", F.sha2("json", 256).alias("json_sha256"))


@query(f"""with {EDGES_SQL}, {NODES_SQL}, {_STIX}, lost as (select {_uuid_sql('file', 'id')} as id from nodes where form = 'customer' and split_part(id, ':', 2)::bigint % 100 = 3),
kept as (select * from objects where id not in (select id from lost)), w as (select type, id, unnest(refs) as ref from kept)
select type, 'open' as fault, count(distinct id) as objects from w where ref not in (select id from kept) group by 1""")
def stix_closure(spark, d):
    """Objects of an export whose references are open when every hundredth customer's file is missing."""
    from pivotloom.sources.exports import stix_faults

    lost = nodes(spark, d).filter("form = 'customer' and cast(substring_index(id, ':', -1) as bigint) % 100 = 3").select("id")
    return stix_faults(nodes(spark, d), edges(spark, d), lost).groupBy(F.regexp_extract("id", "^(.*?)--", 1).alias("type"), "fault").agg(F.count(F.lit(1)).alias("objects"))


_ENCODED = """t as (select o_orderkey as id, 'customer:' || o_custkey as subject, case when o_orderstatus <> 'P' then 'status:' || o_orderstatus end as object from orders),
o as (select distinct l_orderkey as id, l_linenumber, l_suppkey, l_returnflag from lineitem where l_orderkey in (select o_orderkey from orders)),
n as (select id, count(*) as lines, count(*) filter (l_returnflag = 'R') as by_object from o group by 1)"""


@query(f"""with {_ENCODED}, x as (select 'SUBJECT' as type, count(*) as edges, count(*) filter (id % 97 = 0) as target, 0 as digest, 0 as ordinal, 0 as repeated from t
  union all select 'OBJECT', count(*), 0, count(*) filter (id % 83 = 0), 0, 0 from t where object is not null
  union all select 'EVIDENCE', sum(case when id % 89 = 0 then lines - 1 else lines end), 0, 0, count(*) filter (id % 89 = 0 and lines > 1), 0 from n
  union all select 'TIME_OBJECT', sum(by_object) + count(*) filter (id % 79 = 0 and by_object > 0), 0, 0, 0, count(*) filter (id % 79 = 0 and by_object > 0) from n
  union all select 'TIME_OCCURRENCE', sum(lines - by_object), 0, 0, 0, 0 from n)
select type, edges::bigint as edges, digest, target, ordinal, repeated from x where edges > 0""")
def evidence_encoding(spark, d):
    """Edges by type and the faults planted in them: targets, digests, a missing and a repeated ordinal."""
    from pyspark.sql import Window

    from pivotloom.sources.exports import encoding_faults, evidence_edges

    rows, k = evidence_edges(_evidence_records(spark, d)), F.col("src").cast("long")
    is_ = lambda kind: F.col("type") == kind
    rows = rows.withColumn("dst", F.when(is_("SUBJECT") & (k % 97 == 0), "customer:0").otherwise(F.col("dst")))
    rows = rows.withColumn("sha256", F.when(is_("OBJECT") & (k % 83 == 0), F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    rows = rows.filter(~(is_("EVIDENCE") & (k % 89 == 0) & (F.col("ordinal") == 0)))
    firsts = rows.filter(is_("TIME_OBJECT") & (k % 79 == 0)).withColumn("_n", F.row_number().over(Window.partitionBy("src").orderBy("ordinal"))).filter("_n = 1").drop("_n")
    rows = rows.unionByName(firsts)
    faults = encoding_faults(rows).groupBy("type").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("digest", "target", "ordinal", "repeated")])
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("edges")).join(faults, "type", "left").select("type", "edges", *map(zero, ("digest", "target", "ordinal", "repeated")))


@query(f"""with {_ENCODED}, r as (select id, lines, string_agg(l_suppkey || '/' || l_linenumber, ',' order by l_linenumber, l_suppkey, l_returnflag) as sources, string_agg(l_returnflag || case when l_returnflag = 'R' then 'o' else 'c' end || l_suppkey, ',' order by l_linenumber, l_suppkey, l_returnflag) as times from o join n using (id) group by all)
select cast(t.id as varchar) as id, subject, object, coalesce(lines, 0) as evidence, sha256(coalesce(sources, '') || ';' || coalesce(times, '')) as said from t left join r using (id)""")
def evidence_decoding(spark, d):
    """Records put together again from their shuffled edges, arrays in order."""
    from pivotloom.sources.exports import decode_evidence, evidence_edges

    records = _evidence_records(spark, d)
    back = decode_evidence(records.select("id"), evidence_edges(records).repartition("dst"))
    sources = F.array_join(F.transform("evidence", lambda e: F.concat(e["source_id"], F.lit("/"), e["field"])), ",")
    times = F.array_join(F.transform("times", lambda t: F.concat(t["role"], F.when(t["object"].isNotNull(), F.concat(F.lit("o"), t["object"])).otherwise(F.concat(F.lit("c"), t["occurrence"])))), ",")
    return back.select("id", "subject", "object", F.size("evidence").cast("long").alias("evidence"), F.sha2(F.concat(sources, F.lit(";"), times), 256).alias("said"))


@query(f"""with {_ENCODED}, f as (select id, 'SUBJECT' as type, 'lost' as fault from t where id % 97 = 0 union all select id, 'SUBJECT', 'added' from t where id % 97 = 0
  union all select id, 'EVIDENCE', unnest(['lost', 'added']) from n where id % 89 = 0 and lines > 1) select cast(id as varchar) as src, type, fault, count(*) as n from f group by all""")
def reencoding_faults(spark, d):
    """Edges that encoding the decoded records again doesn't give back: targets changed, and a missing first ordinal."""
    from pivotloom.sources.exports import evidence_edges
    from pivotloom.sources.exports import reencoding_faults as faults

    records, k = _evidence_records(spark, d), F.col("src").cast("long")
    rows = evidence_edges(records)
    rows = rows.withColumn("dst", F.when((F.col("type") == "SUBJECT") & (k % 97 == 0), F.concat("dst", F.lit("x"))).otherwise(F.col("dst")))
    rows = rows.filter(~((F.col("type") == "EVIDENCE") & (k % 89 == 0) & (F.col("ordinal") == 0)))
    return faults(records.select("id"), rows).select("src", "type", "fault").distinct().withColumn("n", F.lit(1).cast("long"))


def _evidence_records(spark, d):
    """Orders as records, their lines as references and times."""
    line = F.struct("l_linenumber", "l_suppkey", "l_returnflag")
    refs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_set(line)).alias("lines"))
    when = lambda x, test: F.when(test, x["l_suppkey"].cast("string"))
    time = lambda x: F.struct(x["l_returnflag"].alias("role"), when(x, x["l_returnflag"] == "R").alias("object"), when(x, x["l_returnflag"] != "R").alias("occurrence"))
    source = lambda x: F.struct(x["l_suppkey"].cast("string").alias("source_id"), x["l_linenumber"].cast("string").alias("field"))
    none = lambda kind: F.array().cast(f"array<struct<{kind}>>")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("customer:"), "o_custkey").alias("subject"), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("status:"), "o_orderstatus")).alias("object"))
    return o.join(refs, "id", "left").select(
        F.col("id").cast("string").alias("id"), "subject", "object", F.coalesce(F.transform("lines", source), none("source_id: string, field: string")).alias("evidence"),
        F.coalesce(F.transform("lines", time), none("role: string, object: string, occurrence: string")).alias("times"))


_EXPECTED = """t as (select 'customer:' || o_custkey as start, case when o_orderkey % 100 = 0 then 'order:' || (o_orderkey + 1) when o_orderkey % 101 = 0 then 'part:1' else 'order:' || o_orderkey end as target,
  case o_orderstatus when 'F' then 'included' when 'O' then 'suppressed' else 'candidate' end as list, case when o_orderkey % 3 = 0 then 'negative' when o_orderkey % 3 = 1 then 'weak_positive' else 'open' end as role from orders)"""


@query(f"""with {EDGES_SQL}, {NODES_SQL}, {_EXPECTED}, h as (select distinct src, dst, true as hop from edges where relation = 'PLACED'),
j as (select t.*, coalesce(hop, false) as hop, form from t left join h on src = start and dst = target left join nodes on id = target),
f as (select start, target, 'target_form' as fault from j where form is distinct from 'order'
  union all select start, target, 'no_hop' from j where not hop and (list <> 'candidate' or role in ('weak_positive', 'cautionary_positive', 'high_cardinality'))
  union all select start, target, 'unexpected_hop' from j where hop and list = 'candidate' and role = 'negative'
  union all select start, target, 'lists_overlap' from j group by all having count(distinct list) > 1)
select start, target, fault, count(*) as n from f group by all""")
def topology_faults(spark, d):
    from pivotloom.operators import pivot as P
    from pivotloom.operators import results as R

    k = F.col("o_orderkey")
    order = F.concat(F.lit("order:"), (k + F.when(k % 100 == 0, 1).otherwise(0)).cast("string"))
    status = F.col("o_orderstatus")
    expected = table(spark, d, "orders").select(
        F.concat(F.lit("customer:"), "o_custkey").alias("start"), F.when((k % 101 == 0) & (k % 100 != 0), "part:1").otherwise(order).alias("target"),
        F.when(status == "F", "included").when(status == "O", "suppressed").otherwise("candidate").alias("list"), F.when(k % 3 == 0, "negative").when(k % 3 == 1, "weak_positive").otherwise("open").alias("role"))
    found = R.topology_faults(nodes(spark, d), edges(spark, d), expected, P.PivotSpec("customer", (P.Hop("PLACED", "out", "order"),)))
    return found.groupBy("start", "target", "fault").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {EDGES_SQL} select relation, count(*) as edges_before, count(*) as edges_after, 0 as differing from edges group by relation")
def graph_round_trip(spark, d):
    from pivotloom.sources.exports import decode_graph, encode_graph

    e = edges(spark, d)
    both = e.withColumn("side", F.lit(1)).unionByName(decode_graph(encode_graph(e)).withColumn("side", F.lit(-1)))
    rows = both.groupBy("src", "dst", "relation", "seen", "source").agg(F.count_if(F.col("side") == 1).alias("b"), F.count_if(F.col("side") == -1).alias("a"))
    return rows.groupBy("relation").agg(F.sum("b").alias("edges_before"), F.sum("a").alias("edges_after"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("differing"))


@query(f"with {EDGES_SQL}, h as (select relation, {M.member_sql('src', 'dst', 'relation', 'seen', 'source')} as h from edges), r as {M.roots_sql('h', 'relation')} select relation, n as edge_count, digest from r")
def graph_digest(spark, d):
    from pivotloom.sources.exports import graph_digest

    return graph_digest(edges(spark, d), "relation")
