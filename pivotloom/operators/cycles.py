"""Cycles of directed links, by contraction.

Chains of nodes with one link in and one out are contracted by pointer doubling, so a chain
of any length takes rounds of its logarithm; rings close on themselves while they are
doubled, until all their nodes know the largest. Nodes without a link in or out fall away. Both are repeated until neither changes
anything; each repetition removes every leaf of what is left. The strongly connected
components of the rest, if there is one, are found by colours: the largest node that reaches
each, and back from it within its colour, in rounds that follow the rest's diameter. Every round
is an equi join of short rows, written down in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pivotloom.sources.shared import written


def _doubled(links: DataFrame, chain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, n, u, v) of the chain nodes with the ends of their chain, and (c, n, label) of those on rings.

    links (c, u, v); chain (c, n) nodes with one link in and one out.
    """
    inside = chain.withColumn("in", F.lit(True))
    own = chain.join(links.select("c", F.col("u").alias("n"), "v"), ["c", "n"]).join(links.select("c", F.col("v").alias("n"), "u"), ["c", "n"])
    own = own.join(inside.withColumnsRenamed({"n": "v", "in": "vi"}), ["c", "v"], "left").join(inside.withColumnsRenamed({"n": "u", "in": "ui"}), ["c", "u"], "left")
    own = written(own.select("c", "n", "u", "v", F.col("ui").isNotNull().alias("ui"), F.col("vi").isNotNull().alias("vi"), F.col("n").alias("label")))
    before, left = None, (own.filter("vi").count(), 1)
    while left[0] and (left[0] != before or left[1]):
        ahead = own.select("c", F.col("n").alias("v"), F.col("v").alias("v2"), F.col("vi").alias("vi2"), F.col("label").alias("label2"))
        behind = own.select("c", F.col("n").alias("u"), F.col("u").alias("u2"), F.col("ui").alias("ui2"))
        j = own.join(ahead, ["c", "v"], "left").join(behind, ["c", "u"], "left")
        step = lambda on, new, old: F.when(F.col(on), F.col(new)).otherwise(F.col(old)).alias(old)
        own = written(j.select("c", "n", step("ui", "u2", "u"), step("vi", "v2", "v"), step("ui", "ui2", "ui"), step("vi", "vi2", "vi"), F.greatest("label", "label2").alias("label"), (F.col("label2") > F.col("label")).alias("moved")))
        before, left = left[0], own.filter("vi").agg(F.count(F.lit(1)), F.count_if("moved")).first()
    return own.filter("not vi").select("c", "n", "u", "v"), own.filter("vi").select("c", "n", _label(1, "label"))


def _label(kind: int, c: str) -> Column:
    """A component's name; that of a mere loop (kind 0) gives way to others."""
    return F.struct(F.lit(kind).alias("kind"), F.col(c).alias("node")).alias("label")


def _components(links: DataFrame) -> DataFrame:
    """(c, n, label) of the nodes on cycles of links (c, u, v), label naming their component."""
    found, links = None, written(links)
    while links.head(1):
        colour = written(links.select("c", F.col("u").alias("n")).union(links.select("c", "v")).distinct().withColumn("label", F.col("n")))
        moved = True
        while moved:
            over = links.join(colour.select("c", F.col("n").alias("u"), "label"), ["c", "u"]).groupBy("c", F.col("v").alias("n")).agg(F.max("label").alias("more"))
            colour = written(colour.drop("moved").join(over, ["c", "n"], "left").select("c", "n", F.greatest("label", "more").alias("label"), (F.coalesce(F.col("more") > F.col("label"), F.lit(False))).alias("moved")))
            moved = bool(colour.filter("moved").head(1))
        of = lambda end: colour.select("c", F.col("n").alias(end), F.col("label").alias(f"{end}l"))
        inner = written(links.join(of("u"), ["c", "u"]).join(of("v"), ["c", "v"]).filter("ul = vl").select("c", "u", "v", F.col("ul").alias("label")))
        back, n = written(inner.filter("v = label").select("c", F.col("u").alias("n"), "label").distinct()), 0
        while (now := back.count()) > n:
            n = now
            more = inner.join(back.select("c", F.col("n").alias("v"), "label"), ["c", "v", "label"]).select("c", F.col("u").alias("n"), "label")
            back = written(back.unionByName(more).distinct())
        found = back if found is None else found.unionByName(back)
        done = colour.filter("n = label").select("c", "n").unionByName(back.select("c", "n")).distinct()
        gone = lambda df, end: df.join(done.withColumnRenamed("n", end), ["c", end], "left_anti")
        links = written(gone(gone(links, "u"), "v"))
    return found.select("c", "n", _label(1, "label"))


def cycle_members(links: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """group, node and cycle of every node that reaches itself along links within its group.

    `cycle` names the strongly connected component, by one of its nodes. Links with a null on
    either side, and repeated ones, say nothing.
    """
    left = written(links.select(F.col(group).alias("c"), F.col(start).alias("u"), F.col(end).alias("v")).dropna().distinct())
    loops = lambda df: df.filter("u = v").select("c", F.col("u").alias("n"), _label(0, "u"))
    absorbed, found, left = [], loops(left), left.filter("u <> v")
    while True:
        out, into = left.groupBy("c", F.col("u").alias("n")).agg(F.count(F.lit(1)).alias("o")), left.groupBy("c", F.col("v").alias("n")).agg(F.count(F.lit(1)).alias("i"))
        degree = written(out.join(into, ["c", "n"], "full"))
        live, chain = degree.filter("o is not null and i is not null").select("c", "n"), degree.filter("o = 1 and i = 1").select("c", "n")
        n_all, n_live, n_chain = degree.agg(F.count(F.lit(1)), F.count_if(F.col("o").isNotNull() & F.col("i").isNotNull()), F.count_if((F.col("o") == 1) & (F.col("i") == 1))).first()
        if n_live == n_all and not n_chain:
            break
        ends = lambda df, nodes, how: df.join(nodes.withColumnRenamed("n", "u"), ["c", "u"], how).join(nodes.withColumnRenamed("n", "v"), ["c", "v"], how)
        kept = left
        if n_chain:
            inner, rings = _doubled(left, chain)
            absorbed.append(inner)
            found = found.unionByName(rings)
            kept = ends(left, chain, "left_anti").unionByName(inner.select("c", "u", "v")).distinct()
        kept = written(ends(kept, live, "left_semi").select("c", "u", "v"))
        found, left = found.unionByName(loops(kept)), kept.filter("u <> v")
    if n_all:
        found = found.unionByName(_components(left))
    members = written(found.groupBy("c", "n").agg(F.max("label").alias("label")))
    for inner in reversed(absorbed):
        of = lambda end: members.select("c", F.col("n").alias(end), F.col("label").alias(f"{end}l"))
        more = inner.join(of("u"), ["c", "u"]).join(of("v"), ["c", "v"]).filter("ul = vl").select("c", "n", F.col("ul").alias("label"))
        # a chain's node may have been named by a loop of its own before
        members = written(members.join(more.select("c", "n"), ["c", "n"], "left_anti").unionByName(more))
    return members.select(F.col("c").alias(group), F.col("n").alias("node"), F.col("label.node").alias("cycle"))
