"""Reversible line dedup: exact reference tables behind sharded cuckoo filters.

A line's key is the line without blanks at its ends and with A-Z lower-cased, known by 128
bits of XXH3. The index has three tables: `references` (one row a key and document that holds
it), `counts` (a key's number of documents and the largest of their ids) and `filters`, the
cuckoo filters of the keys that stand in at least `min_docs` documents, one for each shard of
keys. All but a key's largest document lose its lines if its count reaches `min_docs`.

Lines are tested in the filter of their shard first; those that it may hold meet the exact
counts, so a false positive costs a join row and never a line. `insert` adds documents to
the index and `remove` takes them out by id: the touched keys are counted anew, and those that
cross `min_docs` enter or leave their filter. An index after any such steps has the references
and counts of one built from the documents that are left, so dedup is reversible.

References are dealt to filters by shard and salt, each shard into as many salts as its rows
need, so a line of a third of all documents is tested by many tasks. Counts are partially
aggregated. Filters are sized by their keys (about `SHARD_KEYS`); one that overflows is built
anew, twice as large, from the exact counts.

Results for odd rows: a null or empty text is one empty line; very long texts are split
whole; rows that share an id are one document, so a line in three such rows alone is held by
one; a null id is a document of its own, smaller than every other; repeated rows get the same
result each; of an empty table the index is empty. Only the key and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pivotloom.llm.common import checkpoint, small_side

MIN_CHARS = 20
MIN_DOCS = 3
#: Keys of a filter, and rows that are tested in one together.
SHARD_KEYS = 50_000
GROUP_ROWS = 250_000
SLOTS = 4
KICKS = 200
BLANKS = b" \t\n\x0b\x0c\r"
KEY = ["k1", "k2"]


def keys_of(text: bytes | None, min_chars: int) -> list[bytes | None]:
    """The digest of each line's key, or None for keys that are too short."""
    out: list[bytes | None] = []
    for line in (text or b"").lower().split(b"\n"):
        key = line.strip(BLANKS)
        enough = len(key) >= min_chars and (len(key) >= 4 * min_chars or key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if enough else None)
    return out


class Cuckoo:
    """Fingerprints of 16 bits in buckets of four, each key in one of two buckets."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells
        self.mask = len(cells) - 1

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        return cls(np.zeros((1 << max(3, int(keys / (SLOTS * 0.8))).bit_length(), SLOTS), np.uint16))

    @classmethod
    def read(cls, blob: bytes) -> Cuckoo:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy())

    @classmethod
    def of(cls, k2: np.ndarray) -> Cuckoo:
        """A filter that holds the keys, doubled until they fit."""
        size = len(k2)
        while not (made := cls.sized(size)).insert(k2):
            size = 2 * size + 1
        return made

    def places(self, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and first bucket."""
        u = k2.astype(np.uint64)
        mark = np.maximum(u >> np.uint64(48), 1).astype(np.uint16)
        return mark, (u & np.uint64(self.mask)).astype(np.int64)

    def other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ ((mark.astype(np.int64) * 0x5BD1E995) & self.mask)

    def put(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Which fingerprints found a free cell of their bucket."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        rank = np.arange(len(b)) - np.searchsorted(b, b)
        taken = self.cells[b] != 0
        fits = rank < SLOTS - taken.sum(1)
        free = np.argsort(taken[fits], axis=1, kind="stable")
        self.cells[b[fits], free[np.arange(len(free)), rank[fits]]] = mark[order][fits]
        done = np.zeros(len(b), bool)
        done[order[fits]] = True
        return done

    def insert(self, k2: np.ndarray) -> bool:
        """False if some key found no place; the filter is of no use then."""
        mark, bucket = self.places(k2)
        for kick in range(KICKS):
            for _ in range(2):
                left = ~self.put(bucket, mark)
                mark, bucket = mark[left], bucket[left]
                if not len(mark):
                    return True
                bucket = self.other(bucket, mark)
            b, first = np.unique(bucket, return_index=True)
            cell = (kick + b) % SLOTS
            thrown = self.cells[b, cell].copy()
            self.cells[b, cell] = mark[first]
            mark[first] = thrown
            bucket[first] = self.other(b, thrown)
        return False

    def delete(self, k2: np.ndarray) -> None:
        """Take out one fingerprint for each of the keys, all of which must have been inserted."""
        mark, bucket = self.places(k2)
        while len(mark):
            both = np.stack([bucket, self.other(bucket, mark)], 1)
            _, first = np.unique(np.stack([both.min(1), mark.astype(np.int64)], 1), axis=0, return_index=True)
            found = self.cells[both[first]] == mark[first][:, None, None]
            at = found.reshape(len(first), -1).argmax(1)
            held = found.any((1, 2))
            self.cells[both[first, at // SLOTS][held], (at % SLOTS)[held]] = 0
            mark, bucket = np.delete(mark, first), np.delete(bucket, first)

    def holds(self, k2: np.ndarray) -> np.ndarray:
        mark, bucket = self.places(k2)
        there = lambda b: (self.cells[b] == mark[:, None]).any(1)
        return there(bucket) | there(self.other(bucket, mark))


@dataclass(frozen=True)
class LineIndex:
    """References, counts and filters of a set of documents."""

    references: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS

    def write(self, folder: str) -> None:
        """The tables as Parquet under a shared folder, which must be new."""
        for name in ("references", "counts", "filters"):
            getattr(self, name).write.parquet(f"{folder}/{name}")

    def read(self, spark: SparkSession, folder: str) -> LineIndex:
        """The same parameters over the tables that were written there."""
        tables = {name: spark.read.parquet(f"{folder}/{name}") for name in ("references", "counts", "filters")}
        return replace(self, **tables)


def lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """k1, k2, doc_id of the keys of every document, each once a row of docs; a map without a shuffle."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [{d for d in keys_of(t.as_py(), min_chars) if d} for t in b.column(1)]
            flat = np.frombuffer(b"".join(d for own in found for d in own), "<i8").reshape(-1, 2)
            doc = b.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy()), doc], names=["k1", "k2", "doc_id"])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(digests, "k1 long, k2 long, doc_id long")


def _counted(references: DataFrame) -> DataFrame:
    return references.groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"))


def _shard(shards: int):
    return F.pmod("k1", F.lit(shards)).cast("int").alias("shard")


def _build_filters(counts: DataFrame, min_docs: int) -> tuple[DataFrame, int]:
    """Filters of the keys that reach min_docs, and the number of their shards."""
    common = counts.filter(F.col("docs") >= min_docs)
    shards = 1 << (common.count() // SHARD_KEYS).bit_length()

    def build(t: pa.Table) -> pa.Table:
        return pa.table({"shard": t["shard"][:1], "cells": pa.array([Cuckoo.of(t["k2"].to_numpy()).cells.tobytes()], pa.binary())})

    return checkpoint(common.select(_shard(shards), "k2").groupBy("shard").applyInArrow(build, "shard int, cells binary")), shards


def build(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
    references = checkpoint(lines(docs, text, key, min_chars).distinct())
    counts = checkpoint(_counted(references))
    filters, shards = _build_filters(counts, min_docs)
    return LineIndex(references, counts, filters, shards, min_chars, min_docs)


def _change(index: LineIndex, references: DataFrame, counts: DataFrame) -> LineIndex:
    """The index with new tables; keys that cross min_docs enter or leave their filter."""
    references, counts = checkpoint(references), checkpoint(counts)
    common = lambda df, name: df.filter(F.col("docs") >= index.min_docs).select(*KEY, F.lit(True).alias(name))
    moved = common(index.counts, "was").join(common(counts, "now"), KEY, "full").filter("was is null or now is null")
    moved = moved.select(_shard(index.shards), "k2", F.col("now").isNotNull().alias("enters"))

    def update(old: pa.Table, moved: pa.Table) -> pa.Table:
        k2, enters = moved["k2"].to_numpy(), moved["enters"].to_numpy(zero_copy_only=False)
        own = Cuckoo.read(old["cells"][0].as_py()) if len(old) else Cuckoo.sized(len(k2))
        own.delete(k2[~enters])
        cells = own.cells.tobytes() if not enters.any() or own.insert(k2[enters]) else b""
        shard = (old if len(old) else moved)["shard"][:1]
        return pa.table({"shard": shard, "cells": pa.array([cells], pa.binary())})

    filters = checkpoint(index.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInArrow(update, "shard int, cells binary"))
    if filters.filter("length(cells) = 0").head(1):
        filters, shards = _build_filters(counts, index.min_docs)
        return replace(index, references=references, counts=counts, filters=filters, shards=shards)
    return replace(index, references=references, counts=counts, filters=filters)


def insert(index: LineIndex, docs: DataFrame, text: str = "text", key: str = "doc_id") -> LineIndex:
    """The index with more documents; what it has already changes nothing."""
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in (*KEY, "doc_id")]
    fresh = checkpoint(lines(docs, text, key, index.min_chars).distinct().alias("n").join(index.references.alias("o"), same, "left_anti"))
    counts = index.counts.unionByName(_counted(fresh)).groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))
    return _change(index, index.references.unionByName(fresh), counts)


def remove(index: LineIndex, ids: DataFrame, key: str = "doc_id") -> LineIndex:
    """The index without the documents of these ids; only the keys they hold are counted anew."""
    ids = ids.select(F.col(key).cast("long").alias("id")).distinct()
    gone = F.col("doc_id").eqNullSafe(F.col("id"))
    left = index.references.join(ids, gone, "left_anti")
    touched = checkpoint(index.references.join(ids, gone, "left_semi").select(*KEY).distinct())
    counts = index.counts.join(touched, KEY, "left_anti").unionByName(_counted(left.join(touched, KEY, "left_semi")))
    return _change(index, left, counts)


def candidates(index: LineIndex) -> DataFrame:
    """References whose key the filter of its shard may hold: all that matter, and few others."""
    own = index.references.select(*KEY, "doc_id", _shard(index.shards))
    salts = small_side(own.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).alias("salts")))
    dealt = own.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id", "k2"), "salts")).drop("salts")
    filters = index.filters.join(salts, "shard").select("shard", "cells", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))

    def test(rows: pa.Table, own: pa.Table) -> pa.Table:
        rows = rows.select([*KEY, "doc_id"])
        if not len(rows) or not len(own):
            return rows.slice(0, 0)
        return rows.filter(pa.array(Cuckoo.read(own["cells"][0].as_py()).holds(rows["k2"].to_numpy())))

    at = ["shard", "salt"]
    return dealt.groupBy(*at).cogroup(filters.groupBy(*at)).applyInArrow(test, "k1 long, k2 long, doc_id long")


def dropped(index: LineIndex) -> DataFrame:
    """doc_id and digests (binary, 16 bytes a key) of the keys whose lines a document loses."""
    common = small_side(index.counts.filter(F.col("docs") >= index.min_docs))
    lost = candidates(index).join(common, KEY).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    return lost.groupBy("doc_id").agg(F.collect_list("k1").alias("k1"), F.collect_list("k2").alias("k2"))


def dedup(docs: DataFrame, index: LineIndex, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept of every row of docs, whose documents must be in the index.

    A document's lost keys are as many as its own lines at most; they are sent to its text.
    """
    min_chars = index.min_chars

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, lost, kept = [], [], []
            for t, k1, k2 in zip(b.column(1), b.column(2), b.column(3)):
                t = t.as_py() or b""
                if not k1.is_valid:
                    n.append(t.count(b"\n") + 1)
                    lost.append(0)
                    kept.append(t)
                    continue
                pairs = np.stack([k1.values.to_numpy(), k2.values.to_numpy()], 1)
                gone = {row.tobytes() for row in pairs.astype("<i8")}
                own = t.split(b"\n")
                left = [line for line, d in zip(own, keys_of(t, min_chars)) if d is None or d not in gone]
                n.append(len(own))
                lost.append(len(own) - len(left))
                kept.append(b"\n".join(left))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("binary").alias("t"))
    j = rows.join(dropped(index), F.col("k").eqNullSafe(F.col("doc_id")), "left").select("k", "t", "k1", "k2")
    return j.mapInArrow(keep, "doc_id long, n_lines long, n_dropped long, kept string")
