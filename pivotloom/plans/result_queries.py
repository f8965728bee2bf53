"""Registered queries of results and of checks on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pivotloom.functions import identity as I
from pivotloom.operators import claims as G
from pivotloom.operators import documents as D
from pivotloom.operators import evidence as E
from pivotloom.operators import merkle as M
from pivotloom.operators import results as R
from pivotloom.operators.cycles import cycle_members
from pivotloom.sources.views import EDGES_SQL, edges, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


@query(f"""select o_orderkey, 'order-' || {M.member_sql("'order'", 'o_custkey', 'o_orderpriority', 'o_orderstatus')} as result_id from orders where o_orderstatus <> 'P'""")
def constructed_results(spark, d):
    o = table(spark, d, "orders").withColumn("state", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return R.construct(o, "order-", "order", ["o_custkey", "o_orderpriority", "state"]).select("o_orderkey", "result_id")


_SEEDS = "seeds as (select case when event_id % 50 <> 0 then user_id end as c_custkey, event_type as kind from events)"


@query(f"""with {_SEEDS} select coalesce(c_custkey, -1) as c_custkey, fault, count(*) as n from (select c_custkey, 'missing' as fault from seeds where c_custkey is null union all select c_custkey, 'kind' from seeds where kind not in ('view', 'click')
union all select c_custkey, 'repeated' from seeds where c_custkey is not null group by 1 having count(*) > 1 union all select distinct c_custkey, 'unknown' from seeds where c_custkey is not null and c_custkey not in (select c_custkey from customer where c_acctbal > 1000)) group by 1, 2""")
def seed_faults(spark, d):
    k = F.col("event_id")
    seeds = table(spark, d, "events").select(F.when(k % 50 != 0, F.col("user_id")).alias("c_custkey"), F.col("event_type").alias("kind"))
    known = table(spark, d, "customer").filter("c_acctbal > 1000").select("c_custkey")
    return R.parameter_faults(seeds, known, "c_custkey", ["view", "click"]).groupBy(F.coalesce("c_custkey", F.lit(-1)).alias("c_custkey"), "fault").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {EDGES_SQL} select src as id, dst as ref, count(*) as n from edges where relation = 'SUPPLIED_BY' and dst not in (select 'supplier:' || s_suppkey from supplier where s_acctbal >= 0) group by all""")
def open_references(spark, d):
    refs = edges(spark, d).filter("relation = 'SUPPLIED_BY'").groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("refs"))
    ends = table(spark, d, "supplier").filter("s_acctbal >= 0").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.array().cast("array<string>").alias("refs"))
    return R.open_references(refs.unionByName(ends)).groupBy("id", "ref").agg(F.count(F.lit(1)).alias("n"))


@query("""select l_orderkey, l_linenumber, p_partkey as package, s_suppkey as repository, case when l_linenumber = p_size or false then case when s_nationkey = n_nationkey then 'match' else 'no_match' end else 'no_match' end as status, count(*) as n
from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join nation on n_nationkey = p_partkey % 25 group by all""")
def package_declarations(spark, d):
    declared = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("package"), F.col("l_suppkey").alias("repository"), F.col("l_linenumber").alias("declared_version"))
    packages = table(spark, d, "part").select(F.col("p_partkey").alias("package"), F.col("p_size").alias("version"), (F.col("p_partkey") % 25).cast("int").alias("registry"))
    repositories = table(spark, d, "supplier").select(F.col("s_suppkey").alias("repository"), F.col("s_nationkey").alias("source_registry"))
    return R.declarations(declared, packages, repositories).groupBy("l_orderkey", "l_linenumber", "package", "repository", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with h as (select o_custkey, cast(o_orderdate as date) as day, {M.member_sql('o_orderkey', 'cast(o_orderdate as date)')} as h from orders where o_orderstatus = 'F'),
e as (select o_custkey, n, digest, low, high from {M.roots_sql('h', 'o_custkey')} join (select o_custkey, min(day) as low, max(day) as high from h group by 1) using (o_custkey)),
m as (select c_custkey, c_nationkey, n, digest, low, high, case when c_nationkey % 5 = 0 then c_nationkey % 6 + 1 else n end as declared, case when c_nationkey % 7 = 0 then sha256('x') else digest end as told from customer left join e on o_custkey = c_custkey)
select c_custkey, coalesce(n, 0) as n, digest, case when c_nationkey = 24 then 'invalid' when n is null or declared <> n then 'unresolved' when told <> digest then 'invalid' when c_nationkey % 11 = 0 then 'unresolved'
  when low >= date '1995-01-01' and high <= date '2001-06-01' then 'match' else 'no_match' end as status from m""")
def history_gate(spark, d):
    e = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("at"), F.col("o_orderkey").alias("item"))
    day = lambda t: F.lit(t).cast("date")
    k = F.col("c_nationkey")
    own = M.roots(e.select("c_custkey", M.member_hash(["item", "at"]).alias("h")), "c_custkey").withColumnRenamed("n", "listed").withColumnRenamed("digest", "own")
    m = table(spark, d, "customer").join(own, "c_custkey", "left").select(
        "c_custkey", F.when(k % 5 == 0, k % 6 + 1).otherwise(F.col("listed")).alias("declared"), F.when(k % 7 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("own")).alias("declared_digest"),
        F.when(k % 11 == 0, "unknown").otherwise("complete_declared_scope").alias("coverage"), F.when(k == 24, day("2001-07-01")).otherwise(day("1995-01-01")).alias("origin"), day("2001-06-01").alias("through"))
    return R.history_gate(e, m, "c_custkey").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "digest", "status")


_CREATORS = [
    ("identities", "k % 13 = 0"), ("ref_shape", "k % 11 = 0"), ("ref_other", "k % 11 = 0 or k % 7 = 0 or k % 5 = 0 or k % 43 = 0"), ("ref_dangling", "k % 7 = 0 and k % 11 <> 0"), ("ref_type", "k % 5 = 0 and k % 7 <> 0 and k % 11 <> 0"),
    ("spec_version", "k % 17 = 0"), ("name", "k % 19 = 0"), ("class", "k % 23 = 0"), ("evidence", "k % 29 = 0"), ("created", "k % 31 = 0"), ("modified", "k % 37 = 0"), ("order", "k % 41 = 0 and k % 31 <> 0 and k % 37 <> 0"), ("creator_other", "k % 43 = 0")]


@query("select k as c_custkey, fault, count(*) as n from (" + " union all ".join(f"select c_custkey as k, '{fault}' as fault from customer where {test.replace('k %', 'c_custkey %')}" for fault, test in _CREATORS if fault != "creator_other")
       + " union all select c_custkey, 'creator_other' from customer where c_custkey % 43 = 0 union all select c_custkey, 'creator_other' from customer where c_custkey % 13 = 0) group by all")
def creator_faults(spark, d):
    """Customers' exports, each with an extension and its creator, with a planted fault of every kind."""
    k = F.col("c_custkey")
    uuid = lambda kind: F.concat(F.lit(f"{kind}--"), I.file_uuid(I.OBJECT_NAMESPACE, F.concat(F.lit(kind), k.cast("string"))))
    own, note = uuid("identity"), uuid("note")
    pick = lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good)
    ref = F.when(k % 11 == 0, "someone").when(k % 7 == 0, F.concat(F.lit("identity--"), F.lit("00000000-0000-4000-8000-000000000000"))).when(k % 5 == 0, F.concat(F.lit("identity--"), F.substring(note, 7, 36))).otherwise(own)
    stray = F.struct(F.concat(F.lit("identity--"), F.substring(note, 7, 36)).alias("id"), F.lit("note").alias("type"), F.lit("{}").alias("json"))
    ext = F.struct(uuid("extension-definition").alias("id"), F.lit("extension-definition").alias("type"), F.to_json(F.struct(ref.alias("created_by_ref"))).alias("json"))
    made = F.struct(
        pick(17, "2.0", "2.1").alias("spec_version"), pick(19, " ", F.col("c_name")).alias("name"), pick(23, "individual", "group").alias("identity_class"), F.when(k % 29 == 0, "e").alias("x_evidence"),
        pick(31, "2024-01-01", "2024-01-01T00:00:00.000Z").alias("created"), F.when(k % 37 == 0, "soon").when(k % 41 == 0, "2023-01-01T00:00:00.000Z").otherwise("2024-01-02T00:00:00.000Z").alias("modified"))
    identity = lambda id_: F.struct(id_.alias("id"), F.lit("identity").alias("type"), F.to_json(made).alias("json"))
    plain = F.struct(F.lit("identity--second").alias("id"), F.lit("identity").alias("type"), F.lit('{"spec_version": "2.1", "name": "n", "identity_class": "group", "created": "2024-01-01T00:00:00.000Z", "modified": "2024-01-01T00:00:00.000Z"}').alias("json"))
    every = F.filter(F.array(ext, stray, identity(own), F.when(k % 13 == 0, plain)), lambda x: x.isNotNull())
    objects = table(spark, d, "customer").select("c_custkey", pick(43, "identity--other", own).alias("expected"), F.explode(every).alias("o")).select("c_custkey", "expected", "o.*")
    return R.creator_faults(objects, "c_custkey").groupBy("c_custkey", "fault").agg(F.count(F.lit(1)).alias("n"))


_FAULTS = """case when k % 31 = 0 then 'manifest_not_linked' when k % 29 = 0 then 'source_unknown' when k % 37 = 0 then 'manifest_bytes_unavailable' when k % 41 = 0 then 'manifest_without_digest' when k % 43 = 0 then 'manifest_digest_scope'
  when k % 47 = 0 then 'manifest_digest_mismatch' when k % 53 = 0 then 'manifest_identity' when k % 59 = 0 then 'contract' when k % 61 = 0 then 'other_collection' when k % 67 = 0 then 'qualification'
  when n > 0 and k % 71 = 0 then 'unlisted_establishment' when k % 73 = 0 then 'missing_record' when n > 0 and k % 79 = 0 then 'record_digest' when k % 83 = 0 then 'coverage' when k % 89 = 0 then 'endpoints' when k % 97 = 0 then 'endpoints_reversed'
  when n = 0 then 'no_establishment' else 'all_checks' end"""


@query(f"""with e as (select o_custkey as k, count(*) as orders from orders where o_orderstatus = 'F' group by 1), c as (select c_custkey as k, coalesce(orders, 0) as n from customer left join e on e.k = c_custkey), r as (select k, n, {_FAULTS} as reason from c)
select k as history, case when reason = 'all_checks' then 'match' when reason in ('manifest_digest_mismatch', 'manifest_identity', 'record_digest', 'endpoints_reversed') then 'invalid' when reason in ('manifest_digest_scope', 'contract', 'qualification') then 'unsupported'
  when reason = 'other_collection' then 'no_match' else 'unresolved' end as status, reason, case when k % 37 = 0 then 0 else n - (case when n > 0 and k % 71 = 0 then 1 else 0 end) + (case when k % 73 = 0 then 1 else 0 end) end as establishments from r""")
def preserved_histories(spark, d):
    """Customers' histories of finished orders, each from its preserved manifest, with a planted fault of every kind."""
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    own = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), text(F.col("o_orderkey")).alias("record_id"), F.sha2(F.concat_ws("/", text(F.col("o_orderkey")), F.to_date("o_orderdate").cast("string")), 256).alias("sha256"), F.to_date("o_orderdate").alias("at"))
    ends = table(spark, d, "nation").select(F.lit("end").alias("kind"), F.col("n_nationkey")).filter("n_nationkey < 2").select(F.concat(F.lit("end:"), text(F.col("n_nationkey"))).alias("record_id"), F.lit(None).cast("long").alias("history"), F.lit("x").alias("sha256"), F.date_add(F.lit("1990-01-01").cast("date"), F.col("n_nationkey").cast("int") * 9000).alias("at"))
    records = own.select("record_id", F.col("c_custkey").alias("history"), "sha256", "at").unionByName(ends)
    first = own.groupBy("c_custkey").agg(F.min("record_id").alias("first"), F.sort_array(F.collect_list(F.struct("record_id", "sha256"))).alias("all"))
    c = table(spark, d, "customer").select("c_custkey").join(first, "c_custkey", "left")
    entries = F.coalesce("all", F.array().cast("array<struct<record_id: string, sha256: string>>"))
    entries = F.when(k % 71 == 0, F.filter(entries, lambda x: x["record_id"] != F.col("first"))).otherwise(entries)
    entries = F.when(k % 79 == 0, F.transform(entries, lambda x: F.struct(x["record_id"].alias("record_id"), F.when(x["record_id"] == F.element_at(entries, -1)["record_id"], "0").otherwise(x["sha256"]).alias("sha256")))).otherwise(entries)
    entries = F.when(k % 73 == 0, F.concat(entries, F.array(F.struct(F.lit("gone").alias("record_id"), F.lit("1").alias("sha256"))))).otherwise(entries)
    pick = lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good)
    manifest = F.struct(
        pick(53, "other", text(k)).alias("history_id"), F.lit("r1").alias("revision"), pick(59, "new", "history").alias("contract"), F.lit("1").alias("version"), pick(61, "elsewhere", "here").alias("collection_id"), pick(67, "weak", "strict").alias("qualification"),
        pick(83, "unknown", "complete_declared_scope").alias("coverage"), F.when(k % 89 == 0, "nowhere").when(k % 97 == 0, "end:1").otherwise("end:0").alias("origin_id"), pick(97, "end:0", "end:1").alias("through_id"), entries.alias("establishments"))
    made = c.select("c_custkey", F.to_json(F.struct(manifest.alias("manifest"))).cast("binary").alias("content"))
    sources = made.select(k.alias("source_id"), F.lit("d").alias("document"), F.when(k % 29 != 0, "r1").alias("revision"), F.lit("here").alias("collection"), pick(43, "normalized_text", "exact_source_bytes").alias("scope"), F.when(k % 41 != 0, F.when(k % 47 == 0, F.sha2(F.lit("y"), 256)).otherwise(F.sha2("content", 256))).alias("sha256"))
    preserved = made.filter(k % 37 != 0).select(k.alias("source_id"), "content")
    histories = c.select(k.alias("history"), k.alias("source_id"), (k % 31 != 0).alias("linked"))
    return D.preserved_histories(histories, sources, preserved, records, "/manifest", "here", "strict", ("history", "1"))


_DECLARED = """case when k % 29 = 0 then 'sidecar_bytes_unavailable' when k % 31 = 0 then 'sidecar_digest_mismatch' when k % 37 = 0 then 'metadata_digest_scope' when k % 41 = 0 then 'sidecar_shape' when k % 43 = 0 then 'normalized_absent' when k % 47 = 0 then 'normalized_differs'
  when k % 53 = 0 then 'other_pattern' when k % 59 = 0 then 'other_kind' when k % 61 = 0 then 'package_unknown' when k % 67 = 0 then 'other_package' when k % 71 = 0 then 'repository_unknown' when k % 73 = 0 then 'other_repository' when k % 79 = 0 then 'registry_unknown'
  when k % 83 = 0 then 'other_anchor' else 'all_checks' end"""


@query(f"""with r as (select p_partkey as k, {_DECLARED} as reason from part) select k as declaration, case when reason = 'all_checks' then 'match' when reason in ('sidecar_digest_mismatch', 'sidecar_shape') then 'invalid' when reason = 'metadata_digest_scope' then 'unsupported'
  when reason in ('normalized_differs', 'other_pattern', 'other_kind', 'other_package', 'other_repository', 'other_anchor') then 'no_match' else 'unresolved' end as status, reason from r""")
def preserved_declarations(spark, d):
    """Parts' declarations of their repositories, each from its preserved sidecar and registry document, with a planted fault of every kind."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    pick = lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good)
    uri = F.concat(F.lit("https://code.example/"), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))))
    identity = F.struct(F.lit("reg").alias("registry"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("version"))
    registry = F.to_json(F.struct(F.col("p_name").alias("name"), uri.alias("repository"))).cast("binary")
    anchor = F.struct(F.sha2(registry, 256).alias("sha256"), F.lit("r2").alias("revision"), F.lit("pub").alias("publisher"), F.lit("col").alias("collection"), F.lit("doc").alias("uri"), pick(83, "/other", "/repository/url").alias("field"))
    kind = F.struct(pick(59, "mirror", "version_source_repository").alias("kind"), anchor.alias("evidence"))
    said = F.struct(pick(53, "OTHER", "PATTERN").alias("pattern_id"), F.lit("3.0.0").alias("pattern_version"), identity.alias("package"), uri.alias("repository_uri"), kind.alias("declaration"))
    side = p.select(k.alias("sidecar"), F.when(k % 41 == 0, F.lit("[1, 2]").cast("binary")).otherwise(F.to_json(said).cast("binary")).alias("content"), F.to_json(said).alias("text"))
    side = side.select("sidecar", F.when(F.col("sidecar") % 29 != 0, F.col("content")).alias("content"), F.lit("exact_source_bytes").alias("scope"), F.when(F.col("sidecar") % 31 == 0, F.sha2(F.lit("y"), 256)).otherwise(F.sha2("content", 256)).alias("sha256"),
                       F.when(F.col("sidecar") % 43 != 0, F.when(F.col("sidecar") % 47 == 0, F.replace("text", F.lit("reg"), F.lit("tab"))).otherwise(F.col("text"))).alias("normalized"))
    meta = p.select(k.alias("metadata"), registry.alias("content"), pick(37, "normalized_text", "exact_source_bytes").alias("scope"), F.sha2(registry, 256).alias("sha256"), k.alias("source_id"), F.lit("doc").alias("document"), F.lit("r2").alias("revision"), F.when(k % 79 != 0, "pub").alias("publisher"), F.lit("col").alias("collection"))
    declared = p.select(*[k.alias(c) for c in ("declaration", "package", "repository", "sidecar", "metadata", "source_id")], F.lit("/repository").alias("field"))
    known = F.struct(F.lit("reg").alias("registry"), pick(67, "another", F.col("p_name")).alias("name"), F.when(k % 61 != 0, F.col("p_size").cast("string")).alias("version"))
    packages = p.select(k.alias("package"), known.alias("identity"))
    repositories = p.select(k.alias("repository"), F.when(k % 71 != 0, F.when(k % 73 == 0, F.concat(uri, F.lit("/x"))).otherwise(uri)).alias("uri"))
    return D.preserved_declarations(declared, packages, repositories, side, meta, ("PATTERN", "3.0.0"))


@query("""with s as (select l_orderkey as o_orderkey, l_linenumber, case when l_quantity <> 17 then max(cast(l_shipdate as date)) end as available from lineitem group by l_orderkey, l_linenumber, l_quantity),
q as (select distinct l_orderkey as o_orderkey, l_linenumber from lineitem where l_quantity > 1 and l_tax >= 0 union select o_orderkey, 9 from orders where o_orderstatus = 'P'),
b as (select coalesce(s.o_orderkey, q.o_orderkey) as o_orderkey, s.o_orderkey is not null as s, q.o_orderkey is not null as q, available from s full join q on s.o_orderkey = q.o_orderkey and s.l_linenumber = q.l_linenumber),
g as (select o_orderkey, count(*) filter (s) as support, count(*) filter (not s or not q) as differing, count(*) filter (s and available > cast(o_orderdate as date) + 60) as late, count(*) filter (s and available is null) as open from b join orders using (o_orderkey) group by 1)
select o_orderkey, support, differing, late, case when differing > 0 or open > 0 then 'unresolved' when late = 0 then 'match' else 'no_match' end as status from g""")
def establishment_support(spark, d):
    l = table(spark, d, "lineitem")
    c = table(spark, d, "orders").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), 60).alias("established"))
    s = l.groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity").agg(F.max(F.to_date("l_shipdate")).alias("seen"))
    s = s.select("o_orderkey", "l_linenumber", F.when(F.col("l_quantity") != 17, F.col("seen")).alias("available"))
    q = l.filter("l_quantity > 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    q = q.unionByName(table(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", F.lit(9).alias("l_linenumber")))
    found = R.establishment_supported(c, s, q, "o_orderkey", "l_linenumber", F.col("established"))
    return found.select("o_orderkey", "support", "differing", "late", "status")


@query("""with e as (select user_id, event_id, event_type, epoch_us(ts) as lo, epoch_us(ts) + 60000000 as hi from events), c as (select user_id, min(hi) as hi from e where event_type <> 'error' group by 1),
o as (select user_id, min(lo) as open_lo from e where event_type = 'error' group by 1) select user_id, hi, case when open_lo is null or hi < open_lo then 'match' else 'unresolved' end as status from c left join o using (user_id)""")
def later_equivalents(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").select("user_id", "event_type", us.alias("lo"), (us + 60_000_000).alias("hi"))
    chosen = e.filter("event_type <> 'error'").groupBy("user_id").agg(F.min("hi").alias("hi"))
    return G.later_equivalents(chosen, e.filter("event_type = 'error'"), "user_id")


@query("""with c as (select o_orderkey, o_orderstatus as publisher, case when o_orderkey % 10 = 0 then 'm' else 'n' end as namespace from orders where o_orderkey % 101 <> 0),
a as (select distinct l_orderkey * 10 + l_linenumber as id, l_orderkey, l_linenumber, case when l_quantity = 13 then 'other' when l_returnflag = 'R' then 'withdraw' when l_returnflag = 'A' then 'correct' else 'dispute' end as operation, l_quantity <> 11 as linked, l_linestatus as publisher,
  case when l_linenumber % 6 <> 0 then 'n' end as namespace, case when l_quantity = 14 or l_returnflag = 'A' then l_orderkey - l_linenumber % 3 end as replacement, cast(l_shipdate as date) as issued, case when l_quantity > 45 then l_orderkey * 10 + l_linenumber - 1 when l_quantity = 44 then l_orderkey * 10 + l_linenumber end as supersedes from lineitem
  qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_shipdate) = 1),
y as (select distinct l_orderkey from a where supersedes = id)
select a.l_orderkey, a.l_linenumber, case when c.o_orderkey is null or y.l_orderkey is not null or a.operation = 'other' or (a.replacement is not null and a.operation <> 'correct') then 'invalid'
  when a.linked and a.namespace = c.namespace and (a.operation = 'dispute' or a.publisher = c.publisher) and (a.operation <> 'correct' or (r.publisher = a.publisher and r.namespace = a.namespace and a.replacement <> a.l_orderkey))
    and (a.supersedes is null or (o.l_orderkey = a.l_orderkey and o.publisher = a.publisher and o.namespace = a.namespace and o.id <> a.id and o.issued <= a.issued)) then 'match' else 'unresolved' end as status
from a left join c on c.o_orderkey = a.l_orderkey left join c r on r.o_orderkey = a.replacement left join a o on o.id = a.supersedes left join y on y.l_orderkey = a.l_orderkey""")
def supported_amendments(spark, d):
    from pyspark.sql import Window

    q, flag, day, number = F.col("l_quantity"), F.col("l_returnflag"), F.to_date("l_shipdate"), F.col("l_linenumber")
    own = F.col("l_orderkey") * 10 + number
    first = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_shipdate"))
    a = table(spark, d, "lineitem").withColumn("_f", first).filter("_f = 1").select(
        own.alias("id"), F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.when(q == 13, "other").when(flag == "R", "withdraw").when(flag == "A", "correct").otherwise("dispute").alias("operation"),
        (q != 11).alias("issuer_linked"), F.col("l_linestatus").alias("publisher"), F.when(number % 6 != 0, "n").alias("namespace"),
        F.when((q == 14) | (flag == "A"), F.col("l_orderkey") - number % 3).alias("replacement"), day.alias("issued"), F.when(q > 45, own - 1).when(q == 44, own).alias("supersedes"))
    c = table(spark, d, "orders").filter("o_orderkey % 101 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("publisher"), F.when(F.col("o_orderkey") % 10 == 0, "m").otherwise("n").alias("namespace"))
    cyclic = cycle_members(a, "o_orderkey", "id", "supersedes").select("o_orderkey")
    found = G.supported_amendments(a, c, "o_orderkey", cyclic)
    return found.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "status")


@query("""select o_orderkey, count(l_linenumber) as evidence, o_orderstatus <> 'P' and count(l_linenumber) > 0 and coalesce(min(l_quantity) > 3, false) as supported from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderstatus""")
def path_support(spark, d):
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), (F.min("l_quantity") > 3).alias("ok"))
    j = table(spark, d, "orders").join(l, "o_orderkey", "left").withColumn("evidence", F.coalesce("n", F.lit(0)))
    return j.select("o_orderkey", "evidence", E.path_supported([F.col("o_orderstatus") != "P", F.col("ok")], F.col("evidence")).alias("supported"))


@query("""with w as (select o_orderkey, o_orderstatus as revision, 'A' as publisher, 1 as method from orders)
select o_orderkey, count(distinct l_suppkey) filter (l_linenumber % 3 = 1) as sources, case count(distinct l_suppkey) filter (l_linenumber % 3 = 1) when 1 then 'match' when 0 then 'no_match' else 'unresolved' end as status
from w left join lineitem on l_orderkey = o_orderkey and l_linestatus = revision and l_returnflag = publisher group by 1""")
def full_backing(spark, d):
    w = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("revision"), F.lit("A").alias("publisher"), F.lit(1).alias("method"))
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("revision"), F.col("l_returnflag").alias("publisher"), F.col("l_suppkey").alias("source_id"), (F.col("l_linenumber") % 3).alias("method"))
    return E.full_backing(w, links, "o_orderkey").select("o_orderkey", "sources", "status")


@query("""with e as (select l_orderkey, count(*) as n, count(distinct l_partkey) as p, count(distinct l_linestatus) as c, max(l_linestatus) as m from lineitem group by 1)
select o_orderkey, case when n is null then 'unresolved' when n = p and c = 1 and m = o_orderstatus then 'match' else 'no_match' end as status from orders left join e on l_orderkey = o_orderkey""")
def snapshot_consistency(spark, d):
    entries = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", F.col("l_linestatus").alias("commit"))
    return R.snapshot_consistency(entries, "o_orderkey", "l_partkey", table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("declared_commit"))).select("o_orderkey", "status")


@query("""with n as (select event_id, event_id % 3 <> 0 as present, epoch_us(ts) as lo, lead(epoch_us(ts)) over (partition by user_id order by ts, event_id) as lo2 from events)
select event_id, case when not present then 'match' when lo2 is null then 'unresolved' when lo < lo2 then 'match' else 'no_match' end as status from n""")
def time_compare_if_present(spark, d):
    from pyspark.sql import Window

    from pivotloom.functions import timeops as T

    x = T.bounds(F.col("ts"), F.lit("instant"))
    e = table(spark, d, "events").select("event_id", "user_id", "ts", x.alias("x")).withColumn("y", F.lead("x").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.select("event_id", T.compare_if_present(F.col("event_id") % 3 != 0, F.col("x"), F.col("y"), "lt").alias("status"))
