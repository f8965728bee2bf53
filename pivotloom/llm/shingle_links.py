"""Links between near copies: MinHash bands, verified by the Jaccard of word shingles.

A document's set is the hashes of its shingles of `width` words. Its signature has `BANDS`
hashes of `ROWS` places each; a place is the first member of the set, in one of `ROWS`
random orders, at or after a random point of that band (the order being a ring), so two
sets of Jaccard J agree there with probability J and share a band with about
1 - (1 - J^ROWS)^BANDS: 0.9998 at 0.8. One order serves all bands, so a signature takes
`ROWS` sorts whatever the number of bands.

A link is a pair that shares a band and whose true Jaccard is at least `LEAST`. The classes
returned are those of all such links, however many sets share a band.

Documents that are linked already (their class is given) needn't be compared. A band's
smallest and largest class are aggregated, before and after the shuffle, and bands with one
class only are left out. The others are parted at random in parts of about `MEET` sets, whose
pairs are compared; near sets join their classes. This step follows the rows and only spares
work: in bands that then still hold several classes, every set outside the band's commonest
class meets every set of another class. A pair goes on if its sizes and its parity bitmaps allow such a Jaccard (each member flips one place of
its set's bitmap, so two sets differ in at least as many members as their bitmaps in
places), and is then compared in full. No pair is left out that could link. The number of
pairs tried grows with a band's sets times those outside its commonest class.

Results for odd rows: a text without a word has no set and no link here; one with fewer
words than a shingle has one shingle of all its words; repeated rows have equal sets; rows
with a null key can't be fetched again and link by their fingerprint alone; an empty table
gives no link. Only the key and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pivotloom.llm.common import checkpoint, connected_components, small_side

SEED = 42
WIDTH = 5
LEAST = 0.8
BANDS = 36
ROWS = 7
#: Sets that meet in one part of a band.
MEET = 8
#: Longs of a bitmap at most; a set of n members has at least 2 n places up to that.
MOST_LONGS = 1024
#: Texts whose sets are made at a time.
PIECE = 256
SIGNED = "id long, n long, bands array<long>"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_RANDOM = np.random.default_rng(7)
_ODD = _RANDOM.integers(0, 1 << 63, (ROWS, 3), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POINTS = _RANDOM.integers(0, 1 << 64, (ROWS, BANDS), dtype=np.uint64)
_NAMES = _RANDOM.integers(0, 1 << 64, BANDS, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, odd: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * odd
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    own = np.full(n, width, np.uint64)
    for i in range(width):
        own = own * _STEP + h[i : i + n]
    return np.unique(_mix(own, _STEP))


def band_hashes(own: np.ndarray) -> np.ndarray:
    """A hash for each band of the signature of a set that isn't empty; the band's number is part of it."""
    bands = _NAMES.copy()
    for (a, b, c), points in zip(_ODD, _POINTS):
        order = np.sort(_mix(own * a + b, c))
        bands = _mix(bands + order[np.searchsorted(order, points) % len(order)], a)
    return bands.view(np.int64)


def bitmap(own: np.ndarray) -> np.ndarray:
    """The parity of a set's members at each place; its second half folds onto its first by XOR."""
    longs = min(MOST_LONGS, 1 << max(0, -(-2 * len(own) // 64) - 1).bit_length())
    odd = np.bincount((own & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def set_id(own: np.ndarray) -> int:
    x = xxhash.xxh64_intdigest(own.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def signature(text: str | None, width: int = WIDTH) -> tuple[int | None, int, np.ndarray | None]:
    """id (null without words), size and bands of a text's set."""
    own = shingles(text, width)
    return (set_id(own), len(own), band_hashes(own)) if len(own) else (None, 0, None)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def members_of(texts: DataFrame, width: int) -> DataFrame:
    """id, members m and bitmap of its set, of every row (wanted, t) whose set is the wanted one.

    Texts are worked off a few at a time, so that a batch of sets is never held at once.
    """

    def lists(rows: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                part = batch.slice(at, PIECE)
                found = [(w, own) for w, t in zip(part.column(0).to_pylist(), part.column(1)) for own in [shingles(t.as_py(), width)] if len(own) and set_id(own) == w]
                columns = [pa.array([w for w, _ in found], pa.int64()), lists([own.view(np.int64) for _, own in found]), lists([bitmap(own) for _, own in found])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "m", "bits"])

    return texts.select("wanted", "t").mapInArrow(sets, "id long, m array<long>, bits array<long>")


def sets_of(ids: DataFrame, keys: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The sets of distinct ids, made again from a text; `keys` has id and key."""
    wanted = small_side(ids.join(keys, "id").select("key", F.col("id").alias("wanted")))
    return checkpoint(members_of(docs.join(wanted, "key"), width).dropDuplicates(["id"]))


def compared(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """ra and rb, the classes of those pairs (a, b, ra, rb) whose sets are near."""
    both = pairs.join(held.select(F.col("id").alias("a"), F.col("m").alias("ma")), "a").join(held.select(F.col("id").alias("b"), F.col("m").alias("mb")), "b")
    shared = F.size(F.array_intersect("ma", "mb"))
    return both.filter(shared >= least * (F.size("ma") + F.size("mb") - shared)).select("ra", "rb").distinct()


def verified(pairs: DataFrame, keys: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame:
    """As `compared`, of sets that are made again first."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    return compared(pairs, sets_of(ids, keys, docs, width), least)


def relabelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """`members` with the smallest class that links lead to."""
    roots = connected_components(found.select(F.col("ra").alias("src"), F.col("rb").alias("dst"))).withColumnRenamed("root", "_low")
    return members.join(roots.withColumnRenamed("node", "root"), "root", "left").withColumn("root", F.coalesce("_low", "root")).drop("_low")


def links(docs: DataFrame, marks: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """src and dst: classes that hold near copies.

    `marks` has key, the class `root`, and the signature's id, n and bands of every row.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    seen = marks.filter("key is not null and id is not null")
    equal = seen.groupBy("id").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("id", F.col("low").alias("ra"))
    same = seen.join(equal, "id").filter("root <> ra").select("ra", F.col("root").alias("rb")).distinct()

    rows = seen.select("key", "id", "n", "root", F.explode("bands").alias("band"))
    mixed = small_side(rows.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("band"))
    members = checkpoint(rows.join(mixed, "band").groupBy("band", "id", "n", "root").agg(F.min("key").alias("key")))
    keys = members.groupBy("id").agg(F.min("key").alias("key"))
    joined = members.withColumn("old", F.col("root"))
    parts = joined.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / MEET).alias("parts"))
    joined = joined.join(parts, "band").withColumn("part", F.pmod(F.xxhash64("id", "band"), F.col("parts")))
    joined = checkpoint(joined.select("band", "part", "root", F.struct("id", "n", "old").alias("x")))
    other = joined.select("band", "part", F.col("root").alias("other"), F.col("x").alias("y"))
    some = checkpoint(near_in_size(joined.join(other, ["band", "part"]).filter("root < other"), least))
    found = checkpoint(same.unionByName(verified(some, keys, docs, width, least)))

    joined = checkpoint(mixed_bands(relabelled(members.withColumn("old", F.col("root")), found)))
    held = sets_of(joined.select("id").distinct(), keys, docs, width)
    rest = checkpoint(cross_pairs(joined.join(held.select("id", "bits"), "id"), least))
    found = found.unionByName(compared(rest, held, least))
    return found.select(F.col("ra").alias("src"), F.col("rb").alias("dst"))


def mixed_bands(members: DataFrame) -> DataFrame:
    """The members of bands in which two classes are left."""
    still = members.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("band")
    return members.join(still, "band")


def cross_pairs(members: DataFrame, least: float) -> DataFrame:
    """All pairs of a band that are in two classes, but those that can't be near; as `near_in_size`."""
    sizes = members.groupBy("band", "root").agg(F.count(F.lit(1)).alias("k"))
    most = sizes.groupBy("band").agg(F.max(F.struct("k", "root"))["root"].alias("most"))
    each = members.join(most, "band").select("band", "root", "most", F.struct("id", "n", "old", "bits").alias("x"))
    few = each.filter("root <> most").drop("most")
    other = each.select("band", F.col("root").alias("other"), "most", F.col("x").alias("y"))
    two = F.expr("root <> other and (other = most or root < other)")
    bits = "if(size({0}.bits) > size({1}.bits), zip_with(slice({0}.bits, 1, size({1}.bits)), slice({0}.bits, size({1}.bits) + 1, size({1}.bits)), (p, q) -> p ^ q), {0}.bits)"
    differ = F.expr(f"aggregate(zip_with({bits.format('x', 'y')}, {bits.format('y', 'x')}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)")
    may = differ * (1 + least) <= (1 - least) * (F.col("x.n") + F.col("y.n")) + 1e-6
    return near_in_size(few.join(other, "band").filter(two), least, may)


def near_in_size(pairs: DataFrame, least: float, may: Column | None = None) -> DataFrame:
    """Distinct a < b, with their given classes ra and rb, of the structs x and y."""
    low, high = F.expr("if(x.id < y.id, x, y)"), F.expr("if(x.id < y.id, y, x)")
    fits = F.expr("x.id <> y.id") & (F.least("x.n", "y.n") >= least * F.greatest("x.n", "y.n"))
    return pairs.filter(fits if may is None else fits & may).select(low["id"].alias("a"), high["id"].alias("b"), low["old"].alias("ra"), high["old"].alias("rb")).distinct()
