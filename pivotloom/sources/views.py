"""Evidence views over the given tables: nodes, edges, records, times, claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nodes on these lists are noise for pivots of their form.
COMMON_BRAND = "Brand#2"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _node(form: str, key: str):
    return F.concat(F.lit(f"{form}:"), F.col(key))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, form, label, negative_lists; a filter on form prunes all other tables."""

    def part(name: str, key: str, label: str, listed=None, form: str | None = None) -> DataFrame:
        lists = F.when(listed[0], F.array(F.lit(listed[1]))).otherwise(F.array().cast("array<string>")) if listed else F.array().cast("array<string>")
        form = form or name
        return table(spark, sf_dir, name).select(_node(form, key).alias("id"), F.lit(form).alias("form"), F.col(label).cast("string").alias("label"), lists.alias("negative_lists"))

    return _union([
        part("customer", "c_custkey", "c_name", (F.col("c_acctbal") < 0, "negative_balance")),
        part("orders", "o_orderkey", "o_orderpriority", form="order"),
        part("part", "p_partkey", "p_name", (F.col("p_brand") == COMMON_BRAND, "common_brand")),
        part("supplier", "s_suppkey", "s_name", (F.col("s_acctbal") < 0, "negative_balance")),
        part("nation", "n_nationkey", "n_name"),
        part("region", "r_regionkey", "r_name"),
    ])


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, relation, seen (date, null when undated), source; a filter on relation prunes."""

    def part(name: str, src: tuple[str, str], dst: tuple[str, str], relation: str, seen: str | None, source: str) -> DataFrame:
        day = F.to_date(seen) if seen else F.lit(None).cast("date")
        return table(spark, sf_dir, name).select(_node(*src).alias("src"), _node(*dst).alias("dst"), F.lit(relation).alias("relation"), day.alias("seen"), (F.col(source) if seen else F.lit(source)).alias("source"))

    return _union([
        part("orders", ("customer", "o_custkey"), ("order", "o_orderkey"), "PLACED", "o_orderdate", "o_orderpriority"),
        part("lineitem", ("order", "l_orderkey"), ("part", "l_partkey"), "CONTAINS", "l_shipdate", "l_returnflag"),
        part("lineitem", ("part", "l_partkey"), ("supplier", "l_suppkey"), "SUPPLIED_BY", "l_shipdate", "l_returnflag"),
        part("customer", ("customer", "c_custkey"), ("nation", "c_nationkey"), "LOCATED_IN", None, "register"),
        part("supplier", ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "LOCATED_IN", None, "register"),
        part("nation", ("nation", "n_nationkey"), ("region", "n_regionkey"), "PART_OF", None, "register"),
    ])


NODES_SQL = f"""nodes as (
  select 'customer:' || c_custkey as id, 'customer' as form, c_name as label, case when c_acctbal < 0 then ['negative_balance'] else []::varchar[] end as negative_lists from customer
  union all select 'order:' || o_orderkey, 'order', o_orderpriority, []::varchar[] from orders
  union all select 'part:' || p_partkey, 'part', p_name, case when p_brand = '{COMMON_BRAND}' then ['common_brand'] else []::varchar[] end from part
  union all select 'supplier:' || s_suppkey, 'supplier', s_name, case when s_acctbal < 0 then ['negative_balance'] else []::varchar[] end from supplier
  union all select 'nation:' || n_nationkey, 'nation', n_name, []::varchar[] from nation
  union all select 'region:' || r_regionkey, 'region', r_name, []::varchar[] from region)"""

EDGES_SQL = """edges as (
  select 'customer:' || o_custkey as src, 'order:' || o_orderkey as dst, 'PLACED' as relation, cast(o_orderdate as date) as seen, o_orderpriority as source from orders
  union all select 'order:' || l_orderkey, 'part:' || l_partkey, 'CONTAINS', cast(l_shipdate as date), l_returnflag from lineitem
  union all select 'part:' || l_partkey, 'supplier:' || l_suppkey, 'SUPPLIED_BY', cast(l_shipdate as date), l_returnflag from lineitem
  union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'LOCATED_IN', null, 'register' from customer
  union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'LOCATED_IN', null, 'register' from supplier
  union all select 'nation:' || n_nationkey, 'region:' || n_regionkey, 'PART_OF', null, 'register' from nation)"""
