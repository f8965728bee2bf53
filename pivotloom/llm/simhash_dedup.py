"""SimHash near-duplicates found by meet-in-the-middle ball hashing.

A document's fingerprint has, at each of 64 places, the majority bit of the XXH64 hashes
of its word shingles. Two fingerprints link at a distance of at most 3, and documents that
are linked, directly or through others, are a component.

Candidate search. The 64 places are cut into three blocks. Of a pair at distance 1 to 3
at least one block holds a differing place, so with that block removed at most 2 places
differ, and the two balls of radius 1, half of that, share a point. So every distinct
fingerprint emits, for each removed block, its kept places and all their variants at one
flip (132 short rows), rows are shuffled on these variants and fingerprints that meet are
compared in full. Copies collapse before that, as only distinct fingerprints are emitted.

Crowded variants. Rows of a partition arrive sorted by variant and are scanned as a
stream. A bucket of up to `crowd` fingerprints is compared pair by pair and yields a
spanning set of its true links. Members of a larger bucket are not compared there: they
go to a second search that needs no comparison, where each emits all whole variants up to
two flips (2,081), marked near at up to one. If a point has a near member, every other
member is within 2 + 1 flips of it, and is linked to it; every pair at distance 3 or less
has such a point. At most 2,081 fingerprints surround a point, so no bucket there can grow.

Results for odd rows: a null, empty or blank text has the fingerprint zero and links like
any other; fewer words than a shingle are hashed as one; repeated rows get equal results;
a null id keeps its fingerprint and takes the component of the other members, or null.
Very long texts are hashed in slices. Only the key and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pivotloom.llm import shingle_links
from pivotloom.llm.common import checkpoint, connected_components, small_side

SEED = 42
RADIUS = 3
BLOCKS = ((0, 21), (21, 42), (42, 64))
CROWD = 256
SLICE = 1 << 15
#: Fingerprints whose balls one task emits.
SPREAD_ROWS = 10_000
#: A fingerprint of more than 1/HOT_SHARE of all rows is joined by broadcast; there are fewer than HOT_SHARE such.
HOT_SHARE = 1000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, width: int = 3) -> int:
    """The signed 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        part = words[at : min(n, at + SLICE) + width - 1]
        shingles = zip(*(part[i:] for i in range(width))) if len(part) >= width else [part]
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(b" ".join(s), SEED) for s in shingles], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint_column(width: int = 3):
    """A column function: text to its fingerprint."""

    @F.arrow_udf("long")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            yield pa.array([fingerprint(x.as_py(), width) for x in t], pa.int64())

    return of


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3) -> DataFrame:
    """key and fp of every row; a map without a shuffle."""
    return docs.select(F.col(key).alias("key"), fingerprint_column(width)(F.col(text)).alias("fp"))


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def ball(distinct: DataFrame) -> DataFrame:
    """variant and fp: the kept places, and one flip of each, with each block removed.

    The number of the removed block stands in its own emptied places.
    """
    rows = []
    for number, (low, high) in enumerate(BLOCKS):
        gone = ((1 << high) - 1) ^ ((1 << low) - 1)
        flips = [0] + [1 << i for i in range(64) if not low <= i < high]
        rows += [f"struct({_signed(~gone)}L as keep, {_signed(number << low ^ f)}L as flip)".replace("-9223372036854775808L", "cast(-9223372036854775808BD as bigint)") for f in flips]
    return distinct.select("fp", F.inline(F.expr(f"array({', '.join(rows)})"))).select(F.expr("(fp & keep) ^ flip").alias("variant"), "fp")


def spanning_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """For each linked class within a bucket, links of its members to the smallest."""
    bits = fps.view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= RADIUS
    left, out = np.ones(len(fps), bool), []
    for i in range(len(fps)):
        if not left[i]:
            continue
        left[i], front = False, [i]
        while front:
            reached = near[front].any(0) & left
            left &= ~reached
            front = list(np.flatnonzero(reached))
            out += [(int(fps[i]), int(fps[j])) for j in front]
    return out


def scan_buckets(batches: Iterator[pa.RecordBatch], crowd: int) -> Iterator[pa.RecordBatch]:
    """Links within buckets of up to `crowd`; members of larger ones, as (fp, fp)."""

    def rows(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        a = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["src", "dst"])

    open_key, held, spilled = None, np.zeros(0, np.int64), False
    for batch in batches:
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        out: list[tuple[int, int]] = []
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.append(starts[1:], len(key))
        many = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(key)))
        for r in many:
            k, members = key[starts[r]], fp[starts[r] : ends[r]]
            if open_key is not None and k == open_key:
                members = np.concatenate((held, members))
            elif open_key is not None:
                out += spanning_links(held) if len(held) > 1 and not spilled else []
                open_key, spilled = None, False
            whole = ends[r] < len(key)
            if spilled or len(members) > crowd:
                out += [(int(x), int(x)) for x in members]
                members = members[:0]
                spilled = True
            if whole:
                out += spanning_links(members) if len(members) > 1 else []
                open_key, held, spilled = None, members[:0], False
            else:
                open_key, held = k, members
        if out:
            yield rows(out)
    if len(held) > 1 and not spilled:
        yield rows(spanning_links(held))


def crowded_links(crowded: DataFrame) -> DataFrame:
    """src and dst of links among fingerprints of crowded buckets, by whole variants."""
    points = (
        crowded.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
        .select("fp", "i", F.explode(F.expr("if(i = 64, array(64), sequence(i + 1, 64))")).alias("j"))
        .select("fp", F.expr("fp ^ if(i < 64, shiftleft(1L, i), 0L) ^ if(j < 64, shiftleft(1L, j), 0L)").alias("point"), (F.col("j") == 64).alias("near"))
    )
    hub = F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("point"))
    return points.select(hub.alias("src"), F.col("fp").alias("dst")).filter("src is not null and src <> dst").distinct()


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """src and dst of fingerprints whose classes are the components at distance 3."""
    spread = distinct.repartition(max(1, -(-distinct.count() // SPREAD_ROWS)), "fp")
    sorted_rows = ball(spread).repartition("variant").sortWithinPartitions("variant", "fp")
    found = checkpoint(sorted_rows.mapInArrow(lambda b: scan_buckets(b, crowd), "src long, dst long").distinct())
    own = found.filter("src <> dst")
    crowded = found.filter("src = dst").select(F.col("src").alias("fp"))
    return own if crowded.isEmpty() else own.unionByName(crowded_links(crowded))


def linked_roots(distinct: DataFrame, crowd: int) -> DataFrame:
    """fp and root (the smallest fingerprint reachable) of fingerprints with a link."""
    roots = connected_components(links(distinct, crowd))
    return roots.select(F.col("node").alias("fp"), "root")


def named(marks: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """key, fp, component and kept_fp of every row of `marks`.

    `distinct` has fp, its smallest key `first` and its rows `n`; `roots` the classes of linked
    fingerprints. The class's kept row has the smallest key and, of ids that repeat, the
    smallest fingerprint.
    """
    joined = distinct.join(roots, "fp")
    low = joined.groupBy("root").agg(F.min(F.when(F.col("first").isNotNull(), F.struct("first", "fp"))).alias("low"))
    linked = joined.join(low, "root").select("fp", "low")
    alone = F.struct("first", F.col("fp"))
    each = distinct.join(linked, "fp", "left").select("fp", F.coalesce("low", alone).alias("low"), "n")
    each = checkpoint(each.select("fp", F.col("low.first").alias("component"), F.col("low.fp").alias("kept_fp"), "n"))
    hot = F.col("n") > marks.count() / HOT_SHARE
    often = F.broadcast(each.filter(hot).drop("n"))
    rare = each.filter(~hot).drop("n")
    rows = marks.join(often, "fp").unionByName(marks.join(often.select("fp"), "fp", "left_anti").join(rare, "fp"))
    return rows.select("key", "fp", "component", "kept_fp")


def _distinct(marks: DataFrame) -> DataFrame:
    return checkpoint(marks.groupBy("fp").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")))


def classes(marks: DataFrame, crowd: int = CROWD) -> DataFrame:
    """key, fp, component and kept_fp of every row of `marks` (key, fp), which should be cheap to read."""
    distinct = _distinct(marks)
    return named(marks, distinct, linked_roots(distinct.select("fp"), crowd))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, crowd: int = CROWD) -> DataFrame:
    """key, fp (long) and component (smallest key reachable) of every row."""
    return classes(checkpoint(fingerprints(docs, text, key, width)), crowd).drop("kept_fp")


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, crowd: int = CROWD) -> DataFrame:
    """As `classes`, also linking documents of a five-word Jaccard of 0.8 or more."""

    @F.arrow_udf("fp long, " + shingle_links.SIGNED)
    def mark(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            rows = [(fingerprint(x, width), *shingle_links.signature(x)) for x in (x.as_py() for x in t)]
            fp, own, n, bands = zip(*rows) if rows else ((), (), (), ())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip((fp, own, n, bands), kinds)], names=["fp", "id", "n", "bands"])

    marks = checkpoint(docs.select(F.col(key).alias("key"), mark(F.col(text)).alias("m")).select("key", "m.*"))
    distinct = _distinct(marks)
    roots = checkpoint(linked_roots(distinct.select("fp"), crowd))
    placed = marks.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    more = connected_components(shingle_links.links(docs, placed, text, key)).select(F.col("node").alias("root"), F.col("root").alias("low"))
    fps = distinct.select("fp").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    joined = fps.join(more, "root", "left").select("fp", F.coalesce("low", "root").alias("root"))
    return named(marks.select("key", "fp"), distinct, joined)


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, classes_of=None) -> DataFrame:
    """The rows without the near-duplicates: of each class the row of its smallest key.

    A row is told by its key and fingerprint, so a row whose key another row has too is judged
    by its own text; of rows with both alike one stays. Rows with a null key all stay.
    """
    find = classes_of or (lambda *a: classes(checkpoint(fingerprints(*a))))
    found = checkpoint(find(docs, text, key, width).filter("key is not null").select("key", "fp", F.expr("key = component and fp = kept_fp").alias("stays")))
    repeated = checkpoint(found.groupBy(F.col("key").alias("_key_")).agg(F.count(F.lit(1)).alias("_n_")).filter("_n_ > 1").select("_key_"))
    gone = found.filter("not stays").select(F.col("key").alias("_key_")).distinct()
    if repeated.isEmpty():
        gone = small_side(gone)
        return docs.join(gone, docs[key] == gone["_key_"], "left_anti")
    elsewhere = small_side(gone.unionByName(repeated).distinct())
    single = docs.join(elsewhere, docs[key] == elsewhere["_key_"], "left_anti")
    own = docs.join(repeated, docs[key] == repeated["_key_"], "left_semi")
    marked = own.select(F.struct(*[own[c] for c in own.columns]).alias("_row_"), own[key].alias("_key_"), fingerprint_column(width)(own[text]).alias("_fp_"))
    staying = found.filter("stays").join(repeated, F.col("key") == F.col("_key_")).select("_key_", F.col("fp").alias("_fp_")).distinct()
    place = F.row_number().over(Window.partitionBy("_key_", "_fp_").orderBy(*[F.col("_row_").getField(c) for c in docs.columns]))
    kept = marked.join(staying, ["_key_", "_fp_"]).withColumn("_place_", place).filter("_place_ = 1")
    return single.unionByName(kept.select("_row_.*"))
