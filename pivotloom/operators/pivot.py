"""Pivots over nodes and edges: hops, windows, suppression, caps, features, top paths."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hop:
    """One hop; relation and forms may name alternatives, parted by |."""

    relation: str
    direction: str
    form: str
    cap: int | None = None


@dataclass(frozen=True)
class PivotSpec:
    """Source forms, hops, a window of days, and (form, list) pairs that suppress.

    A path is suppressed if its seed or its target stands on a list declared for its form.
    """

    source: str
    hops: tuple[Hop, ...]
    window_days: int | None = None
    negative_lists: tuple[tuple[str, str], ...] = field(default=())


def relation_name(name: Column) -> Column:
    """A relation's spelling in edges: upper case, other characters as single underscores."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(name)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def alternatives(text: str) -> list[str]:
    """The non-empty parts of a|b."""
    return [p for p in (x.strip() for x in text.split("|")) if p]


def in_window(seen: Column, as_of: str, days: int | None) -> Column:
    """Both ends count; undated edges are outside any window."""
    if days is None:
        return F.lit(True)
    end = F.lit(as_of).cast("date")
    return F.coalesce(seen.between(F.date_sub(end, days), end), F.lit(False))


def listed(form: Column, lists: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Whether a node stands on a list that is declared for its own form."""
    hit = F.lit(False)
    for f, name in pairs:
        hit = hit | ((form == f) & F.array_contains(lists, name))
    return hit


def step(nodes: DataFrame, edges: DataFrame, hop: Hop, as_of: str, days: int | None, keep_outside: bool = False) -> DataFrame:
    """at, to, relation, seen, source, inside, form, negative_lists of the edges one hop may use, oriented along it.

    The form is that of the node, whatever its id looks like. Edges outside the window are
    left out, or kept with inside false; undated ones are in no window and always go.
    """
    inside = in_window(F.col("seen"), as_of, days)
    chosen = edges.filter(F.col("relation").isin(alternatives(hop.relation))).withColumn("inside", inside)
    chosen = chosen.filter("inside" if not keep_outside or days is None else "seen is not null")
    ends = ("src", "dst") if hop.direction == "out" else ("dst", "src")
    out = chosen.select(F.col(ends[0]).alias("at"), F.col(ends[1]).alias("to"), "relation", "seen", "source", "inside")
    reached = nodes.filter(F.col("form").isin(alternatives(hop.form))).select(F.col("id").alias("to"), "form", "negative_lists")
    out = out.join(reached, "to")
    return out if hop.cap is None else cap_degree(out, hop.cap).filter("not capped").drop("degree", "capped")


def cap_degree(steps: DataFrame, cap: int) -> DataFrame:
    """Each step with the fan-out of its start and whether that is over the cap.

    Degrees are a pre-aggregated count joined back, so a hub never meets in a window.
    """
    degree = steps.groupBy("at", "relation").agg(F.count(F.lit(1)).alias("degree"))
    return steps.join(degree, ["at", "relation"]).withColumn("capped", F.col("degree") > cap)


def cut_starts(nodes: DataFrame, edges: DataFrame, hop: Hop, as_of: str, days: int | None) -> DataFrame:
    """at, relation and degree of the starts that a hop's cap cuts."""
    steps = step(nodes, edges, Hop(hop.relation, hop.direction, hop.form), as_of, days)
    return steps.groupBy("at", "relation").agg(F.count(F.lit(1)).alias("degree")).filter(F.col("degree") > hop.cap)


def pivot(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, spec: PivotSpec, as_of: str) -> DataFrame:
    """seed, target, path, seens, sources, included of every path; multiplicity is kept.

    Each hop is an equi join on the frontier; caps cut hubs before the next hop. A path
    doesn't come back to its seed. A last hop outside the window makes a suppressed path;
    earlier hops outside it make none.
    """
    start = nodes.filter(F.col("form").isin(alternatives(spec.source))).join(seeds.select(F.col("id")).distinct(), "id", "left_semi")
    at = start.select(
        F.col("id").alias("seed"), F.col("id").alias("at"), F.array("id").alias("path"), F.array().cast("array<date>").alias("seens"),
        F.array().cast("array<string>").alias("sources"), listed(F.col("form"), F.col("negative_lists"), spec.negative_lists).alias("noisy"), F.lit(True).alias("inside"),
    )
    for i, hop in enumerate(spec.hops):
        last = i == len(spec.hops) - 1
        noisy = F.col("noisy") | listed(F.col("form"), F.col("negative_lists"), spec.negative_lists) if last else F.col("noisy")
        at = (
            at.drop("inside").join(step(nodes, edges, hop, as_of, spec.window_days, last), "at")
            .filter(F.col("to") != F.col("seed"))
            .select(
                "seed", F.col("to").alias("at"), F.concat("path", F.array("relation", "to")).alias("path"), F.concat("seens", F.array("seen")).alias("seens"),
                F.concat("sources", F.array("source")).alias("sources"), noisy.alias("noisy"), "inside",
            )
        )
    return at.select("seed", F.col("at").alias("target"), "path", "seens", "sources", (F.col("inside") & ~F.col("noisy")).alias("included"))


def target_sets(paths: DataFrame) -> DataFrame:
    """Per seed the sorted distinct included and suppressed targets."""
    pick = lambda on: F.array_sort(F.collect_set(F.when(on, F.col("target"))))
    return paths.groupBy("seed").agg(pick(F.col("included")).alias("included"), pick(~F.col("included")).alias("suppressed"))


def hop_order_kept(seens: Column) -> Column:
    """Whether the dated hops never go back in time; null if a hop is undated."""
    pairs = F.zip_with(F.slice(seens, F.lit(1), F.greatest(F.size(seens) - 1, F.lit(0))), F.slice(seens, F.lit(2), F.greatest(F.size(seens) - 1, F.lit(0))), lambda a, b: a <= b)
    return F.when(F.exists(seens, lambda s: s.isNull()), F.lit(None).cast("boolean")).otherwise(F.forall(pairs, lambda p: p))


def top_paths(paths: DataFrame, k: int) -> DataFrame:
    """The k newest paths of each seed and target."""
    w = Window.partitionBy("seed", "target").orderBy(F.desc(F.array_max("seens")), F.array_join("path", ">"), F.array_join("sources", ">"), F.array_join(F.transform("seens", lambda d: d.cast("string")), ">"))
    return paths.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def path_features(paths: DataFrame, as_of: str, top: int, novelty_days: int) -> DataFrame:
    """One row of features per seed and target, over the included paths.

    multi_source_ratio is the share of hops (by place) that have two or more sources.
    """
    end = F.lit(as_of).cast("date")
    kept = hop_order_kept(F.col("seens"))
    own = paths.filter("included")
    hops = own.select("seed", "target", F.posexplode("sources").alias("hop", "source")).groupBy("seed", "target", "hop").agg((F.min("source") < F.max("source")).cast("int").alias("several"))
    ratio = hops.groupBy("seed", "target").agg(F.round(F.avg("several"), 6).alias("multi_source_ratio"))
    return own.groupBy("seed", "target").agg(
        F.max((F.size("path") - 1) / 2).cast("int").alias("path_length"),
        F.least(F.count(F.lit(1)), F.lit(top)).alias("path_count_capped"),
        F.size(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("vendor_diversity"),
        F.datediff(end, F.max(F.array_max("seens"))).alias("days_since_support"),
        (F.min(F.array_min("seens")) >= F.date_sub(end, novelty_days)).alias("novelty_flag"),
        F.round(F.sum(kept.cast("int")) / F.count(kept), 6).alias("temporal_consistency"),
    ).join(ratio, ["seed", "target"])


def degree_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, form, relation, degree, rarity_idf and popular_penalty of nodes with outgoing edges.

    Rarity is over the nodes of the node's own form, whose number is a small aggregate.
    """
    n = F.col("degree")
    of_form = nodes.groupBy("form").agg(F.count(F.lit(1)).alias("nodes"))
    degree = edges.groupBy(F.col("src").alias("id"), "relation").agg(F.count(F.lit(1)).alias("degree"))
    known = degree.join(nodes.select("id", "form"), "id").join(of_form, "form")
    return known.select("id", "form", "relation", "degree", F.round(F.log(F.col("nodes") / n), 6).alias("rarity_idf"), F.round(1 / (1 + F.log(n)), 6).alias("popular_penalty"))


#: Stretches of time into which a sequence or a place is cut.
STRETCHES = 128


def stretch_of(events: DataFrame, at: Column, stretches: int = STRETCHES) -> Column:
    """The number of a time's stretch; stretches hold about as many rows each, by approximate quantiles."""
    found = events.agg(F.percentile_approx(at, [i / stretches for i in range(1, stretches)], 1000).alias("b")).first()["b"]
    bounds = sorted(set(found or []))
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= at)) if bounds else F.lit(0)


def sequences(events: DataFrame, key: str, at: str, max_gap_seconds: int, min_events: int, stretches: int = STRETCHES) -> DataFrame:
    """Runs of one key's events whose gaps stay within the limit: key, run, n, first, last (epoch microseconds).

    A segmented scan in two phases: runs are closed within a key's stretches of time, each a
    group of its own, so that a key with a third of all rows is worked on by many tasks; then
    the ends of stretches, one row a key and stretch, say which runs go on and how many came
    before. No window spans a key's events. Undated events are in no run.
    """
    us, gap = F.unix_micros(F.col(at).cast("timestamp")), max_gap_seconds * 1_000_000
    rows = events.select(F.col(key), us.alias("us"), "event_id").filter("us is not null")
    rows = rows.withColumn("part", stretch_of(rows, F.col("us"), stretches))
    w = Window.partitionBy(key, "part").orderBy("us", "event_id")
    fresh = F.when(F.coalesce(F.col("us") - F.lag("us").over(w) > gap, F.lit(False)), 1).otherwise(0)
    local = rows.withColumn("fresh", fresh).withColumn("own", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = local.groupBy(key, "part", "own").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first"), F.max("us").alias("last"))
    ends = runs.groupBy(key, "part").agg(F.min("first").alias("lo"), F.max("last").alias("hi"), F.max("own").alias("more"))
    by_key = Window.partitionBy(key).orderBy("part")
    opens = F.when(F.col("lo") - F.lag("hi").over(by_key) <= gap, 0).otherwise(1)
    carried = ends.withColumn("opens", opens).withColumn("before", F.sum(F.col("opens") + F.col("more")).over(by_key.rowsBetween(Window.unboundedPreceding, 0)) - F.col("more"))
    joined = runs.join(carried.select(key, "part", "before"), [key, "part"]).withColumn("run", F.col("before") + F.col("own"))
    return joined.groupBy(key, "run").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")).filter(F.col("n") >= min_events)


#: Events of a block in a crowded place and bucket.
BLOCK = 512


def co_occurrences(events: DataFrame, key: str, place: str, at: str, seconds: int, block: int = BLOCK) -> DataFrame:
    """Pairs of keys at one place within so many seconds, counted: a, b, meetings.

    Events stand in buckets of that many seconds, and a bucket in blocks of about `block`
    rows. Each event goes to the pairs of blocks (of its own and the next bucket) that its block
    is in, so a task meets two blocks, however crowded a place is, and its pairs are added up
    before they are sent. Rows sent grow with a bucket's blocks, pairs are as many as meetings.
    """
    width = seconds * 1_000_000
    us = F.unix_micros(F.col(at).cast("timestamp"))
    own = events.select(F.col(key).alias("k"), F.col(place).alias("p"), us.alias("t"), F.floor(us / width).alias("bucket")).dropna()
    sizes = own.groupBy("p", "bucket").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    after = sizes.select("p", (F.col("bucket") - 1).alias("bucket"), F.col("blocks").alias("next"))
    before = sizes.select("p", (F.col("bucket") + 1).alias("bucket"), F.col("blocks").alias("last"))
    zero = F.lit(0).cast("long")
    known = sizes.join(after, ["p", "bucket"], "left").join(before, ["p", "bucket"], "left").select("p", "bucket", "blocks", F.coalesce("next", zero).alias("next"), F.coalesce("last", zero).alias("last"))
    rows = own.join(known, ["p", "bucket"]).withColumn("x", F.pmod(F.xxhash64("k", "t"), F.col("blocks")))
    upto = lambda n: F.filter(F.sequence(zero, F.greatest(n - 1, zero)), lambda i: i < n)
    cell = lambda bucket, x, y, later: F.struct(bucket.alias("c"), x.alias("x"), y.alias("y"), F.lit(later).alias("later"))
    # as the earlier block of a pair, and as the later one; blocks of one bucket meet once, in order
    first = F.concat(F.transform(F.filter(upto(F.col("blocks")), lambda y: y >= F.col("x")), lambda y: cell(F.col("bucket"), F.col("x"), y, False)), F.transform(upto(F.col("next")), lambda y: cell(F.col("bucket"), F.col("x"), y, True)))
    second = F.concat(F.transform(F.filter(upto(F.col("blocks")), lambda x: x <= F.col("x")), lambda x: cell(F.col("bucket"), x, F.col("x"), False)), F.transform(upto(F.col("last")), lambda x: cell(F.col("bucket") - 1, x, F.col("x"), True)))
    side = lambda cells, k, t: rows.select("p", F.col("k").alias(k), F.col("t").alias(t), F.explode(cells).alias("cell"))
    met = side(first, "ka", "ta").join(side(second, "kb", "tb"), ["p", "cell"]).filter((F.col("ka") != F.col("kb")) & (F.abs(F.col("ta") - F.col("tb")) <= width))
    # within one block both orders of a pair are met
    met = met.filter(F.col("cell.later") | (F.col("cell.x") < F.col("cell.y")) | (F.col("ka") < F.col("kb")))
    return met.groupBy(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).agg(F.count(F.lit(1)).alias("meetings"))
