"""Sets as trees of digests: equality by the roots, differences by going down unequal nodes.

A member is hashed under a domain tag with every field's length before it, so no two
different members have one text, and nulls stay apart from empty texts. Members meet by the
first `LEAF` digits of their hash, leaves by the first two, and those in the root: an array
never holds more than 4,096 digests, but at a leaf, which holds a 16^`LEAF`th of its set. A
digest follows from its own set alone. Two sets are compared node by node, and only members
below unequal leaves are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits of a leaf's name, and the lengths of the names of the levels above it.
LEAF = 5
ABOVE = (2, 0)


def member_text(fields: list[Column]) -> Column:
    """Every field with its length before it; a null field is a bare minus."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (f.cast("string") for f in fields)]
    return F.concat(F.lit("member"), *[F.concat(F.lit(";"), p) for p in parts])


def member_hash(fields: list[str]) -> Column:
    return F.sha2(member_text([F.col(f) for f in fields]), 256)


def nodes(hashes: DataFrame, key: str) -> list[DataFrame]:
    """The levels of every set's tree from the leaves up, each key, name, h and n, over rows (key, h); repeated rows count."""
    joined = lambda c: F.array_join(F.sort_array(F.collect_list(c)), "")
    level = hashes.groupBy(key, F.substring("h", 1, LEAF).alias("name")).agg(F.sha2(F.concat(F.lit("leaf;"), joined("h")), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    out = [level]
    for digits in ABOVE:
        below = level.select(key, F.substring("name", 1, digits).alias("name"), F.concat("name", F.lit(":"), "h").alias("c"), "n")
        level = below.groupBy(key, "name").agg(F.sha2(F.concat(F.lit("node;"), joined("c")), 256).alias("h"), F.sum("n").alias("n"))
        out.append(level)
    return out


def roots(hashes: DataFrame, key: str) -> DataFrame:
    """key, n and digest of every set."""
    return nodes(hashes, key)[-1].select(key, "n", F.col("h").alias("digest"))


def set_digests(members: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per set the number and the digest of its distinct members."""
    return roots(members.select(key, member_hash(fields).alias("h")).distinct(), key).withColumnRenamed("n", "members")


def equal_sets(sets: DataFrame) -> DataFrame:
    """sets (members, digest) with how many have the same digest; counted and joined back, so that a common set is no window."""
    return sets.join(sets.groupBy("digest").agg(F.count(F.lit(1)).alias("equal_sets")), "digest")


def differences(members: DataFrame, pairs: DataFrame, key: str, path: str, fields: list[str]) -> DataFrame:
    """a, b, path and fault of the members in which two sets differ: missing (in b), extra, or changed.

    members has the key, a path that names a member in its set, and the fields of its content;
    pairs a and b. The trees are descended: roots, then nodes, then leaves that differ, so
    equal sets cost one row and nearly equal ones a few.
    """
    hashed = members.select(key, path, member_hash([path, *fields]).alias("h")).distinct()
    leaves, middle, top = nodes(hashed.select(key, "h"), key)
    left = pairs.select("a", "b").distinct()
    for level, cut in ((top, None), (middle, ABOVE[1]), (leaves, ABOVE[0])):
        left = _descend(level, left, key, cut)
    named = hashed.withColumn("name", F.substring("h", 1, LEAF))

    def side(which: str, own: str) -> DataFrame:
        return left.join(named.select(F.col(key).alias(which), "name", F.col(path).alias("path"), F.col("h").alias(own)), [which, "name"]).select("a", "b", "path", own)

    # a changed member stands below different leaves of the two sets, so sides meet by path after all leaves
    both = side("a", "ha").unionByName(side("b", "hb"), allowMissingColumns=True)
    own = both.groupBy("a", "b", "path").agg(F.collect_set("ha").alias("ha"), F.collect_set("hb").alias("hb"))
    only = own.select("a", "b", "path", F.array_except("ha", "hb").alias("ha"), F.array_except("hb", "ha").alias("hb")).filter("size(ha) > 0 or size(hb) > 0")
    fault = F.when(F.size("hb") == 0, "missing").when(F.size("ha") == 0, "extra").otherwise("changed")
    return only.select("a", "b", "path", fault.alias("fault"))


def _descend(level: DataFrame, pairs: DataFrame, key: str, cut: int | None) -> DataFrame:
    """a, b and name of the nodes of a level that differ between the sets of pairs, below the named nodes if there are."""
    on = [] if cut is None else ["up"]
    asked = pairs if cut is None else pairs.withColumnRenamed("name", "up")

    def side(which: str, own: str) -> DataFrame:
        nodes = level.select(F.col(key).alias(which), "name", F.col("h").alias(own), *([] if cut is None else [F.substring("name", 1, cut).alias("up")]))
        return asked.join(nodes, [which, *on]).select("a", "b", "name", own)

    return side("a", "ha").join(side("b", "hb"), ["a", "b", "name"], "full").filter(~F.col("ha").eqNullSafe(F.col("hb"))).select("a", "b", "name")


def inventory_faults(declared: DataFrame, members: DataFrame, key: str, path: str, fields: list[str]) -> DataFrame:
    """key, path and fault of sets whose declared inventory (same columns) isn't what they hold."""
    tagged = members.select(F.concat(F.lit("m"), key).alias("_k"), path, *fields).unionByName(declared.select(F.concat(F.lit("d"), key).alias("_k"), path, *fields))
    keys = declared.select(key).union(members.select(key)).distinct()
    pairs = keys.select(F.concat(F.lit("d"), key).alias("a"), F.concat(F.lit("m"), key).alias("b"))
    return differences(tagged, pairs, "_k", path, fields).select(F.expr("substring(a, 2)").alias(key), F.col("path").alias(path), "fault")


def roots_sql(hashed: str, key: str) -> str:
    """SQL of the root digests of a table (key, h)."""
    return f"""(with leaf as (select {key}, substring(h, 1, {LEAF}) as name, sha256('leaf;' || string_agg(h, '' order by h)) as h, count(*) as n from {hashed} group by all),
  mid as (select {key}, substring(name, 1, {ABOVE[0]}) as up, sha256('node;' || string_agg(name || ':' || h, '' order by name || ':' || h)) as h, sum(n)::bigint as n from leaf group by all)
  select {key}, sum(n)::bigint as n, sha256('node;' || string_agg(up || ':' || h, '' order by up || ':' || h)) as digest from mid group by {key})"""


def member_sql(*fields: str) -> str:
    """SQL of a member's hash."""
    parts = " || ".join(f"';' || coalesce(length(cast({f} as varchar)) || ':' || cast({f} as varchar), '-')" for f in fields)
    return f"sha256('member' || {parts})"
