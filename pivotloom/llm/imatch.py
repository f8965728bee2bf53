"""I-Match fingerprints: hashes of the sorted distinct terms of lexicon subsets.

The lexicon holds the terms whose document frequency lies in a band: in at least `LOW` of
all documents (and two of them) and at most `HIGH`. A text's terms in the lexicon are
sorted and hashed whole, and once for each of 66 randomised subsets of the lexicon that
keep a quarter down to a 256th of it, chosen by digits of the term's MD5. The fingerprint
is the row of these hashes; the likeness of two is the share of equal ones among those
that are not empty on both sides. A text without a term in the lexicon uses all its terms.

Everything is DataFrame functions. Document frequencies cover all documents. As a term
must be in `LOW` of them, the lexicon has at most (mean distinct terms of a text) / LOW
members, however many documents there are; it is looked up as a hash table in a constant
array, so texts are neither exploded nor shuffled for it.

The neighbour of a document in id order comes from one shuffle of the texts into ranges of
about `RANGE_ROWS` rows, however many rows share an id; a copy of each range's first row is
put behind the range before it, so no window spans the table. Fingerprints are made after it.

Results for odd rows: a null text is an empty one; a text without terms has the hashes of
an empty list and is like another such text by 1; rows with a null key come last in the
order, and rows of one key are ordered by their texts' hashes; an empty table gives no
row; a single row is its own neighbour. Only the key and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pivotloom.llm.common import HashTable, longs

LOW, HIGH = 0.002, 0.01
RANGE_ROWS = 10_000
#: Rows looked at for each range, to choose its bounds.
SAMPLED = 40
WIDTH = 6
EMPTY = "-" * WIDTH
#: Nested subsets: the digit of a term's MD5 (from 1) that must be under a bound.
NESTED = [(1, "4"), (2, "1"), (3, "1")]
#: Families of disjoint subsets: a term is in the one numbered by where its MD5 first has the digits.
FAMILIES = [("0", 32), ("00", 31)]
HASHES = 1 + len(NESTED) + sum(n for _, n in FAMILIES)


def words(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def terms(text: Column) -> Column:
    """The words in sorted order."""
    return F.sort_array(words(text))


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """The hash of each term in the band and its df, over all documents."""
    bound = docs.agg(F.count(F.lit(1)).alias("n")).select(
        F.greatest(F.lit(2), F.ceil(F.col("n") * low)).alias("low"), F.greatest(F.lit(2), F.floor(F.col("n") * high)).alias("high")
    ).first()
    counted = docs.select(F.explode(F.transform(words(F.col(text)), lambda t: F.xxhash64(t))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    return counted.filter(F.col("df").between(bound["low"], bound["high"]))


def hash_table(lex: DataFrame) -> HashTable:
    """The lexicon's term hashes; its size is bounded, see above."""
    return HashTable([r["h"] for r in lex.select("h").collect()])


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def hashes(text: Column, table: HashTable) -> Column:
    """The fingerprint of a text: `HASHES` hashes of `WIDTH` digits in a row."""

    def known(t: Column) -> Column:
        return table.holds(F.xxhash64(t))

    def digest(part: Column, whole: bool = False) -> Column:
        value = F.substring(F.md5(F.array_join(F.transform(part, lambda s: s["t"]), " ").cast("binary")), 1, WIDTH)
        return value if whole else F.when(F.size(part) > 0, value).otherwise(EMPTY)

    def under(at: int, bound: str):
        return lambda s: F.substring(s["m"], at, 1) < bound

    def family(m: Column, digits: str, n: int) -> Column:
        """Terms are sorted by their subset's number once; each subset is a stretch of them."""
        own = F.array_sort(F.filter(F.transform(m, lambda s: F.struct(F.instr(s["m"], digits).alias("k"), s["t"].alias("t"))), lambda s: s["k"] > 0))
        return let(own, lambda o: let(stops(o), lambda at: stretches(o, at, n)))

    def stops(own: Column) -> Column:
        """Places (from 1) at which a subset's terms begin, and the one behind the last."""
        first = F.filter(F.transform(own, lambda s, i: F.when((i == 0) | (F.get(own, i - 1)["k"] != s["k"]), i + 1)), lambda i: i.isNotNull())
        return F.concat(first, F.array(F.size(own) + 1))

    def stretches(own: Column, at: Column, n: int) -> Column:
        entries = F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1), lambda i, j: F.struct(own[i - 1]["k"], digest(F.slice(own, i, j - i), True)))
        return let(F.map_from_entries(entries), lambda found: F.concat(*[F.coalesce(F.try_element_at(found, F.lit(j)), F.lit(EMPTY)) for j in range(1, n + 1)]))

    def all_digests(kept: Column) -> Column:
        marked = F.transform(kept, lambda t: F.struct(t.alias("t"), F.md5(t.cast("binary")).alias("m")))
        parts = lambda m: [digest(m, True), *[digest(F.filter(m, under(*x))) for x in NESTED], *[family(m, *f) for f in FAMILIES]]
        return F.transform(F.array(marked), lambda m: F.concat(*parts(m)))[0]

    both = F.transform(F.array(terms(text)), lambda all_terms: F.struct(all_terms.alias("all"), F.filter(all_terms, known).alias("in")))
    return all_digests(F.transform(both, lambda s: F.when(F.size(s["in"]) > 0, s["in"]).otherwise(s["all"]))[0])


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes among those not empty on both sides."""
    cut = lambda x, i: F.substring(x, i, F.lit(WIDTH))
    places = F.filter(F.sequence(F.lit(1), F.lit(WIDTH * (HASHES - 1) + 1), F.lit(WIDTH)), lambda i: (cut(a, i) != EMPTY) | (cut(b, i) != EMPTY))
    return F.transform(F.array(places), lambda p: F.size(F.filter(p, lambda i: cut(a, i) == cut(b, i))) / F.size(p))[0]


def range_bounds(rows: DataFrame, order: list[str]) -> list[tuple[int, ...]]:
    """Upper bounds, in falling order, of ranges of about `RANGE_ROWS` rows, from a sample of `SAMPLED` rows a range."""
    n = rows.count()
    ranges = -(-n // RANGE_ROWS)
    if ranges < 2:
        return []
    unit = 1 << 40
    share = int(unit * min(1.0, ranges * SAMPLED / n))
    found = sorted((tuple(r) for r in rows.select(*order).filter(F.pmod(F.xxhash64(*order), F.lit(unit)) <= share).collect()), reverse=True)
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}, reverse=True) if found else []


def with_next(rows: DataFrame, key: str, text: str, columns: list[str], added=None) -> DataFrame:
    """Each row with the struct `next` of the row after it by falling key, the first after the last.

    Rows are ordered by key, text hash and a number of their own, so that ranges part rows of
    one key, or copies (of which any may be the next one), too. `added` gives the columns that
    a row gets once it stands in its range, so that they aren't sent. A range's first row is
    copied behind the range before it, so no window spans two ranges.
    """
    order = ["_at", "_h", "_n"]
    keyed = rows.withColumns({"_at": F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))), "_h": F.xxhash64(text), "_n": F.monotonically_increasing_id()})
    bounds = range_bounds(keyed, order)
    step = max(1, int(len(bounds) ** 0.5))
    own = F.struct(*order)
    zipped = lambda some: F.arrays_zip(*[longs([b[i] for b in some]).alias(o) for i, o in enumerate(order)])
    every, coarse = zipped(bounds), zipped(bounds[step - 1 :: step])

    def not_above(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: own <= F.struct(*[b[o].alias(o) for o in order])))

    if bounds:
        block = not_above(coarse) * step
        at = block + F.when(block < len(bounds), not_above(F.slice(every, block + 1, F.lit(step)))).otherwise(0)
    else:
        at = F.lit(0)
    placed = keyed.withColumn("_range", at)
    named = order[:2]
    heads = {r["_range"]: r["top"] for r in placed.groupBy("_range").agg(F.max(F.struct(*named)).alias("top")).collect()}
    ranges = sorted(heads)
    before = {r: ranges[i - 1] for i, r in enumerate(ranges)}
    head = F.struct(*[F.element_at(longs([heads[r][i] if r in heads else 0 for r in range(len(bounds) + 1)]), F.col("_range") + 1).alias(o) for i, o in enumerate(named)])
    to = F.element_at(longs([before.get(r, 0) for r in range(len(bounds) + 1)]), F.col("_range") + 1).cast("int")
    stay = F.struct(F.col("_range").alias("r"), F.lit(False).alias("copy"))
    dealt = placed.withColumn("_p", F.explode(F.when(F.struct(*named) == head, F.array(stay, F.struct(to.alias("r"), F.lit(True).alias("copy")))).otherwise(F.array(stay))))
    dealt = dealt.withColumn("_r", F.col("_p.r")).repartition("_r")
    dealt = added(dealt) if added else dealt
    w = Window.partitionBy("_r").orderBy("_p.copy", F.desc("_at"), F.desc("_h"), F.desc("_n"))
    return dealt.withColumn("next", F.lead(F.struct(*columns)).over(w)).filter("not _p.copy").drop(*order, "_range", "_p", "_r")


def compare_edited(docs: DataFrame, text: str = "text", key: str = "doc_id", low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of texts, of their edited texts, and their likenesses.

    The edited text ends, from its middle, in the beginning of the next document.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    table = hash_table(lexicon(rows, "t", low, high))
    half = F.floor(F.length("t") / 2).cast("int")
    edited = F.concat(F.expr("substring(t, 1, length(t) - cast(floor(length(t) / 2) as int))"), F.substring(F.col("next.t"), F.lit(1), half))
    own = with_next(rows, "doc_id", "t", ["t", "fp"], lambda df: df.withColumn("fp", hashes(F.col("t"), table)))
    pairs = own.select("doc_id", F.length("t").cast("long").alias("n_chars"), "fp", F.col("next.fp").alias("next_fp"), edited.alias("e"))
    done = pairs.select("doc_id", "n_chars", "fp", "next_fp", F.sha2("e", 256).alias("edited_sha256"), hashes(F.col("e"), table).alias("edited_fp"))
    return done.select(
        "doc_id", "n_chars", "edited_sha256",
        F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
