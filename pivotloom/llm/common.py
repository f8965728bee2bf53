"""Helpers shared by the text operators: checkpoints, bounded samples, components."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir; where none is named, one for a single machine only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pivotloom-checkpoint-"))


#: Rows of whole texts that go to a Python worker at once, where a step is written down here.
TEXTS_AT_ONCE = 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives lost executors.

    Meanwhile Arrow batches are small, so that long texts don't fill Python workers.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(TEXTS_AT_ONCE, int(before)) if int(before) > 0 else TEXTS_AT_ONCE))
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(ARROW_ROWS, before)


#: Rows of a few numbers each that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame) -> DataFrame:
    """df written down and counted; to be broadcast if it is small, else joined by a shuffle."""
    df = checkpoint(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def fold_of(doc_id) -> F.Column:
    """crc32 of the id written as text, modulo 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def per_class_sample(df: DataFrame, label: str, key: str, rows: int) -> DataFrame:
    """The `rows` rows of each label whose hashed key is smallest.

    A key that repeats counts once, with its smallest label. Labels are counted first, so
    that only about four times the rows wanted of each label pass a cut on the hashed key and
    meet in the ranking, whatever the table's size; labels that are themselves unbounded in
    number are no classes.
    """
    unit = 1 << 40
    place = F.pmod(F.xxhash64(key), F.lit(unit))
    counts = df.groupBy(label).agg(F.least(F.lit(1.0), F.lit(4.0 * rows) / F.approx_count_distinct(key)).alias("_share"))
    cut = df.join(F.broadcast(counts), label).filter(place <= F.col("_share") * unit).groupBy(key).agg(F.min(label).alias(label), F.max("_share").alias("_share"))
    w = Window.partitionBy(label).orderBy(place, key)
    return cut.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= rows).drop("_rank", "_share")


class HashTable:
    """A set of hashes as one constant array: slots of equal width, filled up with 0."""

    def __init__(self, hashes: list[int]):
        self.slots = 1 << max(4, (2 * len(hashes)).bit_length())
        slots: list[list[int]] = [[] for _ in range(self.slots)]
        for h in sorted(hashes):
            slots[h % self.slots].append(h)
        self.width = max(1, max(map(len, slots)))
        self.cells = [h for s in slots for h in s + [0] * (self.width - len(s))]

    def holds(self, h: Column) -> Column:
        at = (F.pmod(h, F.lit(self.slots)) * self.width + 1).cast("int")
        return F.array_contains(F.slice(longs(self.cells), at, F.lit(self.width)), h)


def longs(values: list[int]) -> Column:
    """A constant array; it is folded to a value when the query is optimised."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge, root being the smallest node reachable.

    Alternates the large-star and small-star steps on distinct edges. Every step is a
    partially aggregated minimum and an equi join, so a hub node neither gathers its
    neighbours in a task nor multiplies them; the joins can be split by AQE. Each round
    is checkpointed, and the rounds grow with the logarithm of the longest chain. It ends
    when a round changes nothing.
    """
    e = checkpoint(
        edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).filter("u <> v").distinct()
    )
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(low2, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                      F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        e = checkpoint(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()
