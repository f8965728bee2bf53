"""Time as intervals: bounds of coarse values, comparisons, windows, coexistence.

Bounds are decimal epoch seconds, so fractions finer than a microsecond stay exact. An
interval is struct<lo, hi, lo_inc, hi_inc>; a point has equal, included ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pivotloom.functions.dyadic import levels_of, with_ancestors, with_nodes
from pivotloom.functions.status import NO, UNRESOLVED, UNSUPPORTED, YES
from pivotloom.sources.shared import written

SECONDS = "decimal(20,6)"


def seconds(at: Column) -> Column:
    return (F.unix_micros(at.cast("timestamp")).cast("decimal(20,0)") / F.lit(1_000_000)).cast(SECONDS)


def interval(lo: Column, hi: Column, lo_inc: Column | bool = True, hi_inc: Column | bool = False) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lo.cast(SECONDS).alias("lo"), hi.cast(SECONDS).alias("hi"), as_col(lo_inc).alias("lo_inc"), as_col(hi_inc).alias("hi_inc"))


def bounds(at: Column, precision: Column) -> Column:
    """The interval a value of a precision can lie in; null for an unknown precision."""
    ts = at.cast("timestamp")
    out = F.when(precision == "instant", interval(seconds(ts), seconds(ts), True, True))
    for unit in ("second", "minute", "day", "month", "year"):
        start = F.date_trunc(unit, ts)
        step = {"second": "INTERVAL 1 SECOND", "minute": "INTERVAL 1 MINUTE", "day": "INTERVAL 1 DAY", "month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR"}[unit]
        out = out.when(precision == unit, interval(seconds(start), seconds(start + F.expr(step))))
    return out


def widen(x: Column, uncertainty: Column, state: Column | None = None) -> Column:
    """A clock's uncertainty in seconds spreads an occurrence; an uncertain state is null, so open."""
    out = F.struct((x["lo"] - uncertainty).cast(SECONDS).alias("lo"), (x["hi"] + uncertainty).cast(SECONDS).alias("hi"), x["lo_inc"].alias("lo_inc"), x["hi_inc"].alias("hi_inc"))
    return F.when(x.isNotNull() & (~state | (uncertainty == 0)), out) if state is not None else F.when(x.isNotNull(), out)


def well_formed(x: Column) -> Column:
    """Not reversed, and not empty."""
    return (x["lo"] < x["hi"]) | ((x["lo"] == x["hi"]) & x["lo_inc"] & x["hi_inc"])


def disjoint(a: Column, b: Column) -> Column:
    return (a["hi"] < b["lo"]) | (b["hi"] < a["lo"]) | ((a["hi"] == b["lo"]) & ~(a["hi_inc"] & b["lo_inc"])) | ((b["hi"] == a["lo"]) & ~(b["hi_inc"] & a["lo_inc"]))


def subset(a: Column, b: Column) -> Column:
    low = (a["lo"] > b["lo"]) | ((a["lo"] == b["lo"]) & (b["lo_inc"] | ~a["lo_inc"]))
    high = (a["hi"] < b["hi"]) | ((a["hi"] == b["hi"]) & (b["hi_inc"] | ~a["hi_inc"]))
    return low & high


def compare(a: Column, b: Column, how: str, state: Column | None = None) -> Column:
    """lt, lte or eq of two occurrences: match if true of all instants, no_match if of none.

    `state` says that either is a state, whose end must be chosen first: unsupported.
    """
    touch = (a["hi"] == b["lo"]) & a["hi_inc"] & b["lo_inc"]
    always_lt = (a["hi"] < b["lo"]) | ((a["hi"] == b["lo"]) & ~(a["hi_inc"] & b["lo_inc"]))
    never_lt = (a["lo"] > b["hi"]) | (a["lo"] == b["hi"])
    if how == "lt":
        yes, no = always_lt, never_lt
    elif how == "lte":
        yes, no = always_lt | touch, (a["lo"] > b["hi"]) | ((a["lo"] == b["hi"]) & ~(a["lo_inc"] & b["hi_inc"]))
    else:
        yes, no = (a["lo"] == a["hi"]) & (b["lo"] == b["hi"]) & (a["lo"] == b["lo"]), disjoint(a, b)
    open_ = F.when(a.isNull() | b.isNull(), UNRESOLVED)
    return (open_ if state is None else open_.when(state, UNSUPPORTED)).when(yes, YES).when(no, NO).otherwise(UNRESOLVED)


def within(x: Column, period: Column, mode: str, role: str = "occurrence") -> Column:
    """contained, some or all; the last two are for states."""
    if mode == "contained":
        rest = UNRESOLVED if role == "occurrence" else NO
        out = F.when(subset(x, period), YES).when(disjoint(x, period), NO).otherwise(rest)
    elif role != "state":
        out = F.lit(UNSUPPORTED)
    elif mode == "some":
        out = F.when(disjoint(x, period), NO).otherwise(YES)
    else:
        out = F.when(subset(period, x), YES).otherwise(NO)
    return F.when(x.isNull() | period.isNull(), UNRESOLVED).otherwise(out)


def within_at(occurrence: Column, state: Column, period: Column) -> Column:
    """An occurrence inside a state and a period."""
    from pivotloom.functions.status import all_of

    return all_of(within(occurrence, state, "contained"), within(occurrence, period, "contained"))


def query_period(start: str, end: str) -> Column:
    """Inclusive dates as a half-open interval."""
    return interval(seconds(F.lit(start).cast("date").cast("timestamp")), seconds(F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")))


def coexistence(state: Column, period: Column | None = None, occurrence: Column | None = None) -> Column:
    """Aggregate: whether all states of a group share an instant, within a period if one is given.

    A missing state leaves it open; an occurrence among them is unsupported.
    """
    low = F.max(F.struct(state["lo"].alias("at"), (~state["lo_inc"]).alias("open")))
    high = F.min(F.struct(state["hi"].alias("at"), state["hi_inc"].alias("closed")))
    if period is not None:
        low = F.greatest(low, F.struct(period["lo"].alias("at"), (~period["lo_inc"]).alias("open")))
        high = F.least(high, F.struct(period["hi"].alias("at"), period["hi_inc"].alias("closed")))
    shared = (low["at"] < high["at"]) | ((low["at"] == high["at"]) & ~low["open"] & high["closed"])
    out = F.when(F.count_if(state.isNull()) > 0, UNRESOLVED)
    if occurrence is not None:
        out = out.when(F.max(occurrence), UNSUPPORTED)
    return out.when(shared, YES).otherwise(NO)


def overlaps(rows: DataFrame, key: str, order: str, x: str, leaf: float) -> DataFrame:
    """Pairs of rows of one key whose intervals share an instant: the key, a, b, xa and xb, a before b in `order`.

    Of two such rows the one that begins later begins inside the other. Intervals stand in
    dyadic nodes of their own size, in leaves of so many seconds, and beginnings in the nodes
    of every size that occurs; both meet on key and node, each pair once, so the work follows
    the pairs and the number of sizes, never an interval's length. The rows are written down
    once, as those sizes must be known first. Rows without both ends take no part.
    """
    at = lambda c: F.floor(c / F.lit(leaf)).cast("long")
    own = written(rows.select(F.col(key), F.col(order).alias("i"), F.col(x).alias("x")).filter(F.col("x.lo").isNotNull() & F.col("x.hi").isNotNull()))
    side = lambda n: own.select(F.col(key), F.col("i").alias(f"_{n}"), F.col("x").alias(f"_x{n}"), F.struct(F.col("x.lo").alias("lo"), F.col("i").alias("at")).alias(f"_f{n}"))
    covers = with_nodes(side("p"), at(F.col("_xp.lo")), at(F.col("_xp.hi")))
    starts = with_ancestors(side("q"), at(F.col("_xq.lo")), levels_of(covers))
    j = covers.join(starts, [key, "level", "node"]).filter((F.col("_fp") < F.col("_fq")) & (F.col("_p") != F.col("_q")) & ~disjoint(F.col("_xp"), F.col("_xq")))
    low = F.col("_p") < F.col("_q")
    pick = lambda c, d: F.when(low, F.col(c)).otherwise(F.col(d))
    return j.select(key, pick("_p", "_q").alias("a"), pick("_q", "_p").alias("b"), pick("_xp", "_xq").alias("xa"), pick("_xq", "_xp").alias("xb"))


def metadata_gate(value: Column, clock: Column, zone: Column, precision: Column) -> Column:
    """unresolved for gaps, unsupported for another clock or precision, else match."""
    return (
        F.when(value.isNull() | clock.isNull() | zone.isNull() | precision.isNull() | (zone == "-00:00"), UNRESOLVED)
        .when((clock != "UTC") | ~precision.isin("instant", "second", "minute", "day", "month", "year"), UNSUPPORTED)
        .otherwise(YES)
    )


def stix_timestamp(text: Column) -> Column:
    """A date becomes its midnight; impossible dates, leap seconds and coarse times are null."""
    full = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00.000Z"))).otherwise(text)
    good = full.rlike(r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d\.\d{3,}Z$")
    return F.when(good & F.to_date(F.try_to_timestamp(F.substring(full, 1, 10), F.lit("yyyy-MM-dd"))).isNotNull(), full)


def compare_if_present(present: Column, a: Column, b: Column, how: str) -> Column:
    """A wholly absent left time passes as undated; a present one is compared."""
    return F.when(~present, YES).otherwise(compare(a, b, how))
