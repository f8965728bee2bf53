"""Registered pivots, with the SQL that states the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pivotloom.operators import pivot as P
from pivotloom.sources.views import COMMON_BRAND, EDGES_SQL, NODES_SQL, edges, nodes, table

AS_OF = "1998-01-01"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _customers(spark, d, segment):
    return table(spark, d, "customer").filter(F.col("c_mktsegment") == segment).select(F.concat(F.lit("customer:"), "c_custkey").alias("id"))


PLACED_LAST_YEAR = P.PivotSpec("customer", (P.Hop("PLACED", "out", "order"),), 365, (("customer", "negative_balance"), ("order", "negative_balance")))


@query(f"""with {NODES_SQL}, {EDGES_SQL}
select e.src as source_id, e.dst as target_id, e.relation, cast(e.seen as varchar) as seen, e.source as edge_source,
  not list_contains(n.negative_lists, 'negative_balance') and seen between date '{AS_OF}' - 365 and date '{AS_OF}' as included
from edges e join nodes n on n.id = e.src join nodes m on m.id = e.dst join customer c on 'customer:' || c_custkey = n.id
where c_mktsegment = 'BUILDING' and relation = 'PLACED' and m.form = 'order' and n.form = 'customer'""")
def pivot_outbound(spark, d):
    paths = P.pivot(_customers(spark, d, "BUILDING"), nodes(spark, d), edges(spark, d), PLACED_LAST_YEAR, AS_OF)
    return paths.select(F.col("seed").alias("source_id"), F.col("target").alias("target_id"), F.col("path")[1].alias("relation"), F.col("seens")[0].cast("string").alias("seen"), F.col("sources")[0].alias("edge_source"), "included")


@query(f"""with {EDGES_SQL}, {NODES_SQL}
select e.dst as source_id, e.src as target_id, count(*) filter (seen between date '{AS_OF}' - 90 and date '{AS_OF}') as paths, count(*) filter (not seen between date '{AS_OF}' - 90 and date '{AS_OF}') as outside
from edges e join part p on 'part:' || p_partkey = e.dst join nodes m on m.id = e.src and m.form = 'order' where p_size = 7 and relation = 'CONTAINS' group by all""")
def pivot_inbound(spark, d):
    seeds = table(spark, d, "part").filter("p_size = 7").select(F.concat(F.lit("part:"), "p_partkey").alias("id"))
    spec = P.PivotSpec("part", (P.Hop("CONTAINS", "in", "order"),), 90)
    return P.pivot(seeds, nodes(spark, d), edges(spark, d), spec, AS_OF).groupBy(F.col("seed").alias("source_id"), F.col("target").alias("target_id")).agg(F.count_if("included").alias("paths"), F.count_if(~F.col("included")).alias("outside"))


@query(f"""with {NODES_SQL}, {EDGES_SQL}
select src as seed, coalesce(string_agg(distinct dst, ',' order by dst) filter (not noisy), '') as included, coalesce(string_agg(distinct dst, ',' order by dst) filter (noisy), '') as suppressed
from (select e.*, list_contains(n.negative_lists, 'common_brand') or not e.seen between date '{AS_OF}' - 30 and date '{AS_OF}' as noisy from edges e join nodes n on n.id = e.dst where n.form = 'part' and e.relation = 'CONTAINS') x group by src""")
def pivot_target_sets(spark, d):
    seeds = table(spark, d, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("id"))
    spec = P.PivotSpec("order", (P.Hop("CONTAINS", "out", "part"),), 30, (("part", "common_brand"), ("supplier", "negative_balance")))
    sets = P.target_sets(P.pivot(seeds, nodes(spark, d), edges(spark, d), spec, AS_OF))
    return sets.select("seed", F.array_join("included", ",").alias("included"), F.array_join("suppressed", ",").alias("suppressed"))


@query(f"""with {EDGES_SQL}, {NODES_SQL}
select src as seed, dst as target, relation from edges join nodes a on a.id = src join nodes b on b.id = dst where relation in ('LOCATED_IN', 'SUPPLIED_BY') and a.form in ('supplier', 'customer') and b.form in ('nation', 'region')""")
def pivot_alternatives(spark, d):
    spec = P.PivotSpec("customer | supplier", (P.Hop("LOCATED_IN|SUPPLIED_BY", "out", "nation|region"),))
    everyone = nodes(spark, d)
    return P.pivot(everyone.select("id"), everyone, edges(spark, d), spec, AS_OF).select("seed", "target", F.col("path")[1].alias("relation"))


THREE_HOPS = P.PivotSpec("supplier", (P.Hop("SUPPLIED_BY", "in", "part"), P.Hop("CONTAINS", "in", "order"), P.Hop("PLACED", "in", "customer")), 60)
_THREE_HOPS_SQL = f"""with {EDGES_SQL}, {NODES_SQL}, w as (select * from edges where seen between date '{AS_OF}' - 60 and date '{AS_OF}'),
paths as (select a.dst as seed, c.src as target, a.src as p, b.src as o, a.seen as s1, b.seen as s2, c.seen as s3, a.source as f1, b.source as f2, c.source as f3
  from w a join nodes x on x.id = a.dst join nodes y on y.id = a.src join w b on b.dst = a.src and b.relation = 'CONTAINS' join nodes z on z.id = b.src
  join w c on c.dst = b.src and c.relation = 'PLACED' join nodes u on u.id = c.src
  where a.relation = 'SUPPLIED_BY' and x.form = 'supplier' and y.form = 'part' and z.form = 'order' and u.form = 'customer')"""


def _three_hops(spark, d):
    seeds = table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"))
    return P.pivot(seeds, nodes(spark, d), edges(spark, d), THREE_HOPS, AS_OF).filter("included")


@query(_THREE_HOPS_SQL + " select seed, target, concat_ws('>', seed, 'SUPPLIED_BY', p, 'CONTAINS', o, 'PLACED', target) as path, s1 <= s2 and s2 <= s3 as in_order, count(*) as n from paths group by all")
def pivot_multi_hop(spark, d):
    return _three_hops(spark, d).groupBy("seed", "target", F.array_join("path", ">").alias("path"), P.hop_order_kept(F.col("seens")).alias("in_order")).agg(F.count(F.lit(1)).alias("n"))


@query(_THREE_HOPS_SQL + f""", u as (select *, unnest([f1, f2, f3]) as f from paths)
select seed, target, multi_source_ratio, 3 as path_length, least(n, 3) as path_count_capped, vendor_diversity, days_since_support, novelty_flag, temporal_consistency from (
  select seed, target, count(*) as n, round((case when count(distinct f1) > 1 then 1 else 0 end + case when count(distinct f2) > 1 then 1 else 0 end + case when count(distinct f3) > 1 then 1 else 0 end) / 3.0::double, 6) as multi_source_ratio,
    date '{AS_OF}' - max(greatest(s1, s2, s3)) as days_since_support, min(least(s1, s2, s3)) >= date '{AS_OF}' - 45 as novelty_flag,
    round(sum(case when s1 <= s2 and s2 <= s3 then 1 else 0 end) / count(*)::double, 6) as temporal_consistency from paths group by all)
join (select seed, target, count(distinct f) as vendor_diversity from u group by all) using (seed, target)""")
def pivot_features(spark, d):
    return P.path_features(_three_hops(spark, d), AS_OF, 3, 45)


@query(_THREE_HOPS_SQL + """ select seed, target, path, cast(newest as varchar) as newest, place from (
  select *, row_number() over (partition by seed, target order by newest desc, path, concat_ws('>', f1, f2, f3), concat_ws('>', s1, s2, s3)) as place from (
    select *, greatest(s1, s2, s3) as newest, concat_ws('>', seed, 'SUPPLIED_BY', p, 'CONTAINS', o, 'PLACED', target) as path from paths)) where place <= 2""")
def pivot_top_paths(spark, d):
    return P.top_paths(_three_hops(spark, d), 2).select("seed", "target", F.array_join("path", ">").alias("path"), F.array_max("seens").cast("string").alias("newest"), "place")


@query(f"""with {EDGES_SQL}, {NODES_SQL}, f as (select form, count(*) as nodes from nodes group by 1), g as (select src as id, relation, count(*) as degree from edges group by all)
select id, form, relation, degree, round(ln(nodes / degree::double), 6) as rarity_idf, round(1 / (1 + ln(degree)), 6) as popular_penalty from g join nodes using (id) join f using (form)""")
def node_degree(spark, d):
    return P.degree_features(nodes(spark, d), edges(spark, d))


@query(f"""with {EDGES_SQL}, {NODES_SQL} select src as at_id, relation, count(*) as degree from edges join nodes n on n.id = dst
where relation = 'PLACED' and n.form = 'order' and seen between date '{AS_OF}' - 365 and date '{AS_OF}' group by all having count(*) > 2""")
def cut_starts(spark, d):
    found = P.cut_starts(nodes(spark, d), edges(spark, d), P.Hop("PLACED", "out", "order", cap=2), AS_OF, 365)
    return found.withColumnRenamed("at", "at_id")


@query(f"""with {EDGES_SQL}, s as (select dst as at_id, src as to_id, relation from edges where relation = 'LOCATED_IN'), g as (select at_id, relation, count(*) as degree from s group by all)
select at_id, to_id, degree, degree > 62 as capped from s join g using (at_id, relation)""")
def degree_cap(spark, d):
    steps = P.step(nodes(spark, d), edges(spark, d), P.Hop("LOCATED_IN", "in", "customer|supplier"), AS_OF, None)
    return P.cap_degree(steps, 62).select(F.col("at").alias("at_id"), F.col("to").alias("to_id"), "degree", "capped")


@query(f"""with {EDGES_SQL} select src as seed, dst as target, count(distinct source) as sources, count(*) as edges_seen from edges where relation = 'SUPPLIED_BY' group by all having count(distinct source) >= 2""")
def min_unique_sources(spark, d):
    grouped = edges(spark, d).filter("relation = 'SUPPLIED_BY'").groupBy(F.col("src").alias("seed"), F.col("dst").alias("target"))
    return grouped.agg(F.count_distinct("source").alias("sources"), F.count(F.lit(1)).alias("edges_seen")).filter("sources >= 2")


@query("""with s as (select doc_id, source, sha256(text) as selector from documents)
select selector, min(doc_id) as first_member, count(*) as members, count(distinct source) as sources from s group by all having count(*) > 1""")
def shared_selector_clusters(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("selector"))
    return docs.groupBy("selector").agg(F.min("doc_id").alias("first_member"), F.count(F.lit(1)).alias("members"), F.count_distinct("source").alias("sources")).filter("members > 1")


@query("""with m as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over w <= 600000000 then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id)),
r as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as run from m)
select user_id, cast(run as bigint) as run, count(*) as n, min(epoch_us(ts)) as first_seen, max(epoch_us(ts)) as last_seen from r group by user_id, run having count(*) >= 2""")
def event_sequences(spark, d):
    found = P.sequences(table(spark, d, "events"), "user_id", "ts", 600, 2)
    return found.select("user_id", "run", "n", F.col("first").alias("first_seen"), F.col("last").alias("last_seen"))


@query("""select a.user_id as a, b.user_id as b, count(*) as meetings from events a join events b on a.event_type = b.event_type and a.user_id < b.user_id and abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 30000000 group by all""")
def event_co_occurrence(spark, d):
    return P.co_occurrences(table(spark, d, "events"), "user_id", "event_type", "ts", 30)


@query(f"""with {EDGES_SQL} select src as seed, dst as target, cast(seen as varchar) as seen from edges where relation = 'PLACED' order by edges.seen desc, src, dst limit 100""")
def ordered_results(spark, d):
    found = edges(spark, d).filter("relation = 'PLACED'").select(F.col("src").alias("seed"), F.col("dst").alias("target"), F.col("seen").cast("string").alias("seen"))
    return found.orderBy(F.desc("seen"), "seed", "target").limit(100)


@query("select n_name, r_name, c_mktsegment, count(*) as customers, count(distinct c_nationkey) as nations, min(c_acctbal) as low, max(c_acctbal) as high from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by all")
def grouped_counts(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.groupBy("n_name", "r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), F.count_distinct("c_nationkey").alias("nations"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))


@query(f"""with {NODES_SQL} select s.id as supplier, n.id as nation, r.id as region, list_contains(s.negative_lists, 'negative_balance') as suppressed
from nodes s join supplier on s.id = 'supplier:' || s_suppkey join nodes n on n.id = 'nation:' || s_nationkey join nation on n_nationkey = s_nationkey join nodes r on r.id = 'region:' || n_regionkey""")
def suppression_by_side(spark, d):
    spec = P.PivotSpec("supplier", (P.Hop("LOCATED_IN", "out", "nation"), P.Hop("PART_OF", "out", "region")), None, (("supplier", "negative_balance"),))
    every = nodes(spark, d)
    found = P.pivot(every.filter("form = 'supplier'").select("id"), every, edges(spark, d), spec, AS_OF)
    return found.select(F.col("seed").alias("supplier"), F.col("path")[2].alias("nation"), F.col("target").alias("region"), (~F.col("included")).alias("suppressed"))
