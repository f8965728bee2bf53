"""Registered queries of the four-valued predicates and of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from pivotloom.functions import status as S
from pivotloom.functions import timeops as T
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


def _st(test: str, *values: str) -> str:
    """SQL of a known() status."""
    gone = " or ".join(f"{v} is null" for v in values)
    return f"case when {gone} then 'unresolved' when {test} then 'match' else 'no_match' end"


_TAX = "case when l_linenumber % 5 = 0 then null else l_tax end"
_A, _B = _st("l_returnflag = 'R'", "l_returnflag"), _st("x_tax > 0.04", "x_tax")
_C = "case when l_linenumber = 7 then 'unsupported' else " + _st("l_quantity = floor(l_quantity) and l_quantity >= 0", "l_quantity") + " end"
_RANK_AND = "case {} when 'no_match' then 1 when 'unsupported' then 2 when 'unresolved' then 3 else 4 end"
_RANK_OR = "case {} when 'no_match' then 1 when 'unresolved' then 2 when 'unsupported' then 3 else 4 end"
_AND_NAME = "['no_match', 'unsupported', 'unresolved', 'match'][{}]"
_OR_NAME = "['no_match', 'unresolved', 'unsupported', 'match'][{}]"
_STATUSES = f"with l as (select *, {_TAX} as x_tax from lineitem), s as (select l_orderkey, l_linenumber, {_A} as a, {_B} as b, {_C} as c from l)"


def _statuses(spark, d):
    l = table(spark, d, "lineitem").withColumn("x_tax", F.when(F.col("l_linenumber") % 5 != 0, F.col("l_tax")))
    c = F.when(F.col("l_linenumber") == 7, S.UNSUPPORTED).otherwise(S.nonnegative_integer(F.col("l_quantity")))
    return l.select("l_orderkey", "l_linenumber", S.equal(F.col("l_returnflag"), F.lit("R")).alias("a"), S.known(F.col("x_tax") > 0.04, F.col("x_tax")).alias("b"), c.alias("c"))


@query(_STATUSES + f""" select l_orderkey, l_linenumber, a, b, c,
  {_AND_NAME.format('least(' + ', '.join(_RANK_AND.format(x) for x in 'abc') + ')')} as all_status,
  {_OR_NAME.format('greatest(' + ', '.join(_RANK_OR.format(x) for x in 'abc') + ')')} as any_status,
  case b when 'match' then 'no_match' when 'no_match' then 'match' else b end as not_status, count(*) as n from s group by all""")
def status_logic(spark, d):
    a, b, c = (F.col(x) for x in "abc")
    s = _statuses(spark, d).select("l_orderkey", "l_linenumber", "a", "b", "c", S.all_of(a, b, c).alias("all_status"), S.any_of(a, b, c).alias("any_status"), S.negate(b).alias("not_status"))
    return s.groupBy(*s.columns).agg(F.count(F.lit(1)).alias("n"))


@query(_STATUSES + f" select l_orderkey, {_AND_NAME.format('min(' + _RANK_AND.format('b') + ')')} as all_lines, {_OR_NAME.format('max(' + _RANK_OR.format('c') + ')')} as any_line from s group by l_orderkey")
def status_rollup(spark, d):
    return _statuses(spark, d).groupBy("l_orderkey").agg(S.group_all(F.col("b")).alias("all_lines"), S.group_any(F.col("c")).alias("any_line"))


@query(f"""with g as (select l_orderkey, list_sort(list(distinct l_returnflag)) as flags from lineitem group by 1)
select l_orderkey, array_to_string(flags, ',') as flags, {_st("list_contains(flags, 'R')", 'flags')} as has_r, {_st("list_has_all(['A', 'N'], flags)", 'flags')} as only_an,
  {_st("list_contains(['R', 'A,N'], array_to_string(flags, ','))", 'flags')} as one_of, {_st('len(flags) > 0', 'flags')} as is_present from g""")
def array_predicates(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("f"))
    f, text = F.col("f"), F.array_join("f", ",")
    return g.select("l_orderkey", text.alias("flags"), S.contains(f, F.lit("R")).alias("has_r"), S.all_in(f, F.array(F.lit("A"), F.lit("N"))).alias("only_an"), S.is_in(text, F.array(F.lit("R"), F.lit("A,N"))).alias("one_of"), S.present(f, F.size(f)).alias("is_present"))


@query(f"""select doc_id, {_st("length(trim(text)) > 0", 'text')} as has_text, {_st("lang <> 'en'", 'lang')} as not_english,
  {_st("len(string_split(text, chr(10))) > 0 and len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) = 0)) = 0", 'text')} as all_lines_filled from documents""")
def text_predicates(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", S.nonblank_text(t).alias("has_text"), S.unequal(F.col("lang"), F.lit("en")).alias("not_english"), S.nonblank_text_array(F.split(t, "\n", -1)).alias("all_lines_filled"))


@query("""select c_custkey, count(o_orderkey) filter (o_orderstatus = 'F') as supported, count(o_orderkey) filter (o_orderstatus = 'P') as uncertain,
  case when count(o_orderkey) filter (o_orderstatus = 'F') > 0 then 'no_match' when count(o_orderkey) filter (o_orderstatus = 'P') > 0 or c_custkey % 11 = 0 then 'unresolved' else 'match' end as absent
from customer left join orders on o_custkey = c_custkey and o_totalprice > 400000 group by c_custkey""")
def binding_absent(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("s"), F.count_if(F.col("o_orderstatus") == "P").alias("u"))
    j = table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("s", F.lit(0)).alias("supported"), F.coalesce("u", F.lit(0)).alias("uncertain"))
    return j.withColumn("absent", S.binding_absent(F.col("supported"), F.col("uncertain"), F.col("c_custkey") % 11 != 0))


_PRECISION = "case event_type when 'view' then 'instant' when 'click' then 'second' when 'signup' then 'minute' when 'error' then 'day' else 'month' end"
_BOUNDS = f"""with p as (select *, {_PRECISION} as precision from events),
t as (select event_id, user_id, ts, precision, case precision when 'instant' then epoch_us(ts) else epoch_us(date_trunc(precision, ts)) end as lo,
  case precision when 'instant' then epoch_us(ts) when 'second' then epoch_us(date_trunc('second', ts) + interval 1 second) when 'minute' then epoch_us(date_trunc('minute', ts) + interval 1 minute)
    when 'day' then epoch_us(date_trunc('day', ts) + interval 1 day) else epoch_us(date_trunc('month', ts) + interval 1 month) end as hi, precision = 'instant' as hi_inc from p)"""


def _times(spark, d):
    kind = F.col("event_type")
    precision = F.when(kind == "view", "instant").when(kind == "click", "second").when(kind == "signup", "minute").when(kind == "error", "day").otherwise("month")
    return table(spark, d, "events").select("event_id", "user_id", "ts", precision.alias("precision"), T.bounds(F.col("ts"), precision).alias("x"))


@query(_BOUNDS + " select event_id, precision, lo, hi, hi_inc from t")
def time_bounds(spark, d):
    us = lambda c: (F.col(c) * 1_000_000).cast("long")
    return _times(spark, d).select("event_id", "precision", us("x.lo").alias("lo"), us("x.hi").alias("hi"), F.col("x.hi_inc").alias("hi_inc"))


@query(_BOUNDS + """, n as (select *, lead(lo) over w as lo2, lead(hi) over w as hi2, lead(hi_inc) over w as hi_inc2 from t window w as (partition by user_id order by ts, event_id))
select event_id, case when lo2 is null then 'unresolved' when hi < lo2 or (hi = lo2 and not hi_inc) then 'match' when lo >= hi2 then 'no_match' else 'unresolved' end as lt,
  case when lo2 is null then 'unresolved' when hi <= lo2 then 'match' when lo > hi2 or (lo = hi2 and not hi_inc2) then 'no_match' else 'unresolved' end as lte,
  case when lo2 is null then 'unresolved' when lo = hi and lo2 = hi2 and lo = lo2 then 'match'
    when hi < lo2 or hi2 < lo or (hi = lo2 and not hi_inc) or (hi2 = lo and not hi_inc2) then 'no_match' else 'unresolved' end as eq from n""")
def time_compare(spark, d):
    from pyspark.sql import Window

    n = _times(spark, d).withColumn("y", F.lead("x").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return n.select("event_id", *[T.compare(F.col("x"), F.col("y"), how).alias(how) for how in ("lt", "lte", "eq")])


_SPANS = "spans as (select o_orderkey, o_custkey, o_orderdate, epoch_us(o_orderdate) as lo, epoch_us(max(l_shipdate)) as hi from orders join lineitem on l_orderkey = o_orderkey group by all)"
_FROM, _TO = "1996-03-01", "1996-06-30"
_P = f"epoch_us(timestamp '{_FROM}') as p_lo, epoch_us(timestamp '{_TO}' + interval 1 day) as p_hi"


def _spans(spark, d):
    ends = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    o = table(spark, d, "orders").join(ends, "o_orderkey")
    return o.select("o_orderkey", "o_custkey", "o_orderdate", T.interval(T.seconds(F.col("o_orderdate")), T.seconds(F.col("last")), True, True).alias("x"))


@query(f"""with {_SPANS}, p as (select *, {_P} from spans)
select o_orderkey, lo <= hi as well_formed, case when lo > hi then 'invalid' when lo >= p_lo and hi < p_hi then 'match' else 'no_match' end as contained,
  case when lo > hi then 'invalid' when hi < p_lo or p_hi <= lo then 'no_match' else 'match' end as some_time, case when lo > hi then 'invalid' when p_lo >= lo and p_hi <= hi then 'match' else 'no_match' end as all_time from p""")
def time_within(spark, d):
    x, p = F.col("x"), T.query_period(_FROM, _TO)
    good = T.well_formed(x)
    return _spans(spark, d).select("o_orderkey", good.alias("well_formed"), *[F.when(~good, "invalid").otherwise(T.within(x, p, mode, "state")).alias(name) for mode, name in (("contained", "contained"), ("some", "some_time"), ("all", "all_time"))])


@query(f"""with {_SPANS}, p as (select *, {_P} from spans where lo <= hi), g as (select o_custkey, count(*) as states, max(lo) as low, min(hi) as high, greatest(max(lo), max(p_lo)) as p_low, least(min(hi), max(p_hi)) as p_high, max(p_hi) as p_hi, bool_or(o_orderkey % 50 = 0) as moment from p group by 1)
select o_custkey, states, case when low <= high then 'match' else 'no_match' end as coexist, case when p_low < p_high or (p_low = p_high and p_high < p_hi) then 'match' else 'no_match' end as in_period,
  case when moment then 'unsupported' when low <= high then 'match' else 'no_match' end as as_states from g""")
def time_coexists(spark, d):
    x = F.col("x")
    v = _spans(spark, d).filter(T.well_formed(x)).groupBy("o_custkey")
    return v.agg(F.count(F.lit(1)).alias("states"), T.coexistence(x).alias("coexist"), T.coexistence(x, T.query_period(_FROM, _TO)).alias("in_period"), T.coexistence(x, None, F.col("o_orderkey") % 50 == 0).alias("as_states"))


@query(_BOUNDS + """, w as (select event_id, user_id, ts, precision = 'minute' as state, case when precision <> 'minute' or event_id % 4 = 0 then lo - event_id % 4 * 1000000 end as lo, hi + event_id % 4 * 1000000 as hi, hi_inc from t),
n as (select *, lead(lo) over v as lo2, lead(hi) over v as hi2, lead(hi_inc) over v as hi_inc2, lead(state) over v as state2 from w window v as (partition by user_id order by ts, event_id))
select event_id, case when lo is null or lo2 is null then 'unresolved' when state or state2 then 'unsupported' when hi < lo2 or (hi = lo2 and not hi_inc) then 'match' when lo >= hi2 then 'no_match' else 'unresolved' end as lt from n""")
def clock_uncertainty(spark, d):
    from pyspark.sql import Window

    state = F.col("precision") == "minute"
    e = _times(spark, d).select("event_id", "user_id", "ts", state.alias("state"), T.widen(F.col("x"), F.col("event_id") % 4, state).alias("x"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = e.withColumn("y", F.lead("x").over(w)).withColumn("state2", F.coalesce(F.lead("state").over(w), F.lit(False)))
    return n.select("event_id", T.compare(F.col("x"), F.col("y"), "lt", F.col("state") | F.col("state2")).alias("lt"))


@query(f"""with {_SPANS}, v as (select * from spans where lo <= hi)
select a.o_custkey, a.o_orderkey as a, b.o_orderkey as b from v a join v b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and a.lo <= b.hi and b.lo <= a.hi""")
def interval_overlap_join(spark, d):
    v = _spans(spark, d).filter(T.well_formed(F.col("x")))
    return T.overlaps(v, "o_custkey", "o_orderkey", "x", 30 * 86_400).select("o_custkey", "a", "b")


@query("""with e as (select event_id, case when event_id % 7 <> 0 then cast(ts as varchar) end as v, case event_id % 5 when 0 then 'GPS' when 1 then null else 'UTC' end as clock,
  case event_id % 11 when 3 then '-00:00' else 'Z' end as zone, case when event_id % 13 = 0 then 'century' else 'second' end as precision from events)
select event_id, case when v is null or clock is null or zone = '-00:00' then 'unresolved' when clock <> 'UTC' or precision = 'century' then 'unsupported' else 'match' end as gate from e""")
def time_metadata_gate(spark, d):
    k = F.col("event_id")
    e = table(spark, d, "events").select("event_id", F.when(k % 7 != 0, F.col("ts").cast("string")).alias("v"), F.when(k % 5 == 0, "GPS").when(k % 5 != 1, "UTC").alias("c"), F.when(k % 11 == 3, "-00:00").otherwise("Z").alias("z"), F.when(k % 13 == 0, "century").otherwise("second").alias("p"))
    return e.select("event_id", T.metadata_gate(F.col("v"), F.col("c"), F.col("z"), F.col("p")).alias("gate"))


@query("""select event_id, case when event_id % 3 = 0 then strftime(ts, '%Y-%m-%d') || 'T00:00:00.000Z' when event_id % 3 = 1 then strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.500Z' end as stix from events""")
def stix_timestamps(spark, d):
    k, t = F.col("event_id"), F.col("ts")
    text = F.when(k % 3 == 0, F.date_format(t, "yyyy-MM-dd")).when(k % 3 == 1, F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".500Z"))).when(k % 2 == 0, F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm"), F.lit(":60.000Z"))).otherwise("2023-02-30")
    return table(spark, d, "events").select("event_id", T.stix_timestamp(text).alias("stix"))


@query(f"""with {_SPANS}, e as (select e.event_id, e.user_id, epoch_us(e.ts) - 883612800000000 as tt from events e)
select event_id, o_orderkey, case when tt < lo or tt > hi then 'no_match' else case when tt >= epoch_us(timestamp '1996-01-01') and tt < epoch_us(timestamp '1997-01-01') then 'match' else 'no_match' end end as within_at
from e join spans on o_custkey = user_id where lo <= hi""")
def event_in_state(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("o_custkey"), (T.seconds(F.col("ts")) - 883612800).cast(T.SECONDS).alias("at"))
    j = e.join(_spans(spark, d).filter(T.well_formed(F.col("x"))), "o_custkey")
    return j.select("event_id", "o_orderkey", T.within_at(T.interval(F.col("at"), F.col("at"), True, True), F.col("x"), T.query_period("1996-01-01", "1996-12-31")).alias("within_at"))
