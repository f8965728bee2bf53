"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut in two halves, each quantised by its own k-means codebook (fitted on a
bounded sample), so a pair of centroids is a cell and `cells`^2 cells partition the data.
For a query a heap walks the pairs by rising sum of the two half distances until the cells
passed hold `share` of all vectors (or `least`), and the entries of these cells are ranked
by their exact Euclidean distance.

Every vector is indexed. Equal vectors are one entry that carries its k+1 smallest ids:
no further id can be among a query's k nearest, as ties go to smaller ids. Columns of cells
are put together in bins of about `CHUNK` entries, a column of more is cut into parts, and
queries are cut into chunks; a bin's part meets a chunk in one group of bounded size, and is
sent to those chunks only of which a query passes one of its cells.

Distances that rank are exact: the differences are squared and summed in double precision,
by a power of two apart from overflow. A matrix product only leaves out entries that are
farther than the k-th by more than its rounding error can be.

Results for odd rows: vectors that are null, zero, hold a null or a non-finite number, or
differ from the commonest dimension take no part, nor do null ids; an id stands for one row,
that with the smallest vector if it has several; fewer candidates than k give fewer rows; a
distance beyond the largest double is infinite; an empty table gives no row. Other columns
are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pivotloom.llm.common import checkpoint

CELLS = 64
SAMPLE = 8192
SHARE = 0.5
LEAST = 2000
CHUNK = 8192


def valid(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and v (doubles) of the rows that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null and size(v) > 0")
    rows = rows.filter(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))).filter(F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("v") == sizes[0]["d"]).groupBy("id").agg(F.min("v").alias("v")) if sizes else rows


def kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows of the sample."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = half_distances(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def half_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1))


def traverse(a: np.ndarray, b: np.ndarray, count: np.ndarray, wanted: int) -> dict[int, list[int]]:
    """Cells by rising a[i] + b[j] until they hold `wanted` entries, as i to its j's."""
    oa, ob = a.argsort(kind="stable"), b.argsort(kind="stable")
    heap, seen, held, out = [(a[oa[0]] + b[ob[0]], 0, 0)], {(0, 0)}, 0, {}
    while heap and held < wanted:
        _, p, q = heapq.heappop(heap)
        i, j = int(oa[p]), int(ob[q])
        if count[i, j]:
            held += int(count[i, j])
            out.setdefault(i, []).append(j)
        for x, y in ((p + 1, q), (p, q + 1)):
            if x < len(oa) and y < len(ob) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (a[oa[x]] + b[ob[y]], x, y))
    return out


def power_below(largest: float) -> float:
    """A power of two by which numbers of up to `largest` become at most 1 and their squares can be summed."""
    return 2.0 ** -min(1022, max(-1022, int(np.frexp(largest)[1]))) if largest > 0 else 1.0


def distances(entries: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances of the original vectors; scaling by a power of two rounds nothing."""
    with np.errstate(over="ignore"):
        gap = entries - query
        largest = float(np.abs(gap).max(initial=0.0))
        if 1e-140 < largest < 1e140:
            return np.sqrt((gap * gap).sum(1))
        gap = entries / 2 - query / 2
        scale = power_below(float(np.abs(gap).max(initial=0.0)))
        gap = gap * scale
        return np.sqrt((gap * gap).sum(1)) / scale * 2


def nearest(entries: np.ndarray, ids: np.ndarray, cell: np.ndarray, queries: np.ndarray, allowed: np.ndarray, keep: int) -> list[tuple[int, int, float]]:
    """(query place, entry id, distance) of each query's `keep` nearest allowed entries."""
    scale = power_below(max(float(np.abs(entries).max(initial=0.0)), float(np.abs(queries).max(initial=0.0))))
    x, y = queries * scale, entries * scale
    rough = half_distances(x, y)
    size = np.sqrt((x * x).sum(1)) + np.sqrt((y * y).sum(1).max(initial=0.0))
    slack = 8 * (x.shape[1] + 8) * np.finfo(float).eps * size * size
    rough[~allowed[:, cell]] = np.inf
    out = []
    for q, row in enumerate(rough):
        if len(row) > keep:
            cut = np.partition(row, keep - 1)[keep - 1]
            at = np.flatnonzero(row <= cut + slack[q] if np.isfinite(cut) else np.isfinite(row))
        else:
            at = np.flatnonzero(np.isfinite(row))
        exact = distances(entries[at], queries[q])
        best = np.lexsort((ids[at], exact))[:keep]
        out += [(q, int(ids[at[b]]), float(exact[b])) for b in best]
    return out


def bins_of(columns: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each column of cells, and the parts of each bin, from the columns' entries."""
    of, parts, held = np.zeros(len(columns), np.int64), [0], 0
    for i, n in enumerate(columns.tolist()):
        if held and held + n > chunk:
            parts.append(0)
            held = 0
        of[i], held = len(parts) - 1, held + n
        parts[-1] = max(1, -(-held // chunk))
    return of, np.array(parts)


def search(vectors: DataFrame, every: int = 100, k: int = 10, key: str = "vec_id", vector: str = "embedding",
           cells: int = CELLS, sample: int = SAMPLE, share: float = SHARE, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each row whose id is divisible by `every`."""
    rows = checkpoint(valid(vectors, key, vector))
    top = Window.partitionBy("v").orderBy("id")
    entries = checkpoint(
        rows.withColumn("_n", F.row_number().over(top)).filter(F.col("_n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "v", "ids")
    )
    asked = rows.filter(F.col("id") % every == 0).join(entries.select("rep", "v"), "v").select(F.col("id").alias("query_id"), "rep")
    asked = checkpoint(asked)

    fit_on = entries.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("v").collect()
    if not fit_on:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    scale = power_below(entries.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0])
    x = np.array([r["v"] for r in fit_on]) * scale
    cut = max(1, x.shape[1] // 2)
    books = (kmeans(x[:, :cut], cells), kmeans(x[:, cut:], cells) if x.shape[1] > cut else np.zeros((1, 0)))
    shape = (len(books[0]), len(books[1]))

    def halves(v: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        y = np.array(v.tolist()) * scale
        return half_distances(y[:, :cut], books[0]), half_distances(y[:, cut:], books[1])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                one, two = halves(b["v"])
                yield pd.DataFrame({"rep": b["rep"], "v": b["v"], "i": one.argmin(1), "j": two.argmin(1)})

    placed = checkpoint(entries.select("rep", "v").mapInPandas(place, "rep long, v array<double>, i int, j int"))
    count = np.zeros(shape, np.int64)
    for r in placed.groupBy("i", "j").count().collect():
        count[r["i"], r["j"]] = r["count"]
    wanted = max(least, int(share * count.sum()))
    queries = asked.select("rep").distinct().join(entries.select("rep", "v"), "rep")
    query_chunks = max(1, -(-asked.select("rep").distinct().count() // chunk))
    bin_of, parts = bins_of(count.sum(1), chunk)
    columns = [np.flatnonzero(bin_of == b) for b in range(len(parts))]

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            if len(b):
                one, two = halves(b["v"])
                for n, rep in enumerate(b["rep"].tolist()):
                    passed = np.zeros(shape, bool)
                    for i, js in traverse(one[n], two[n], count, wanted).items():
                        passed[i, js] = True
                    out += [(rep, g, rep % query_chunks, np.packbits(passed[own]).tobytes()) for g, own in enumerate(columns) if passed[own].any()]
            yield pd.DataFrame(out, columns=["rep", "g", "q", "cells"])

    def each_bin(values: list[int], g: str = "g") -> Column:
        return F.expr(f"element_at(array({', '.join(map(str, values))}), {g} + 1)")

    passed = checkpoint(queries.mapInPandas(probe, "rep long, g int, q int, cells binary"))
    probes = passed.join(queries, "rep").withColumn("e", F.explode(F.sequence(F.lit(0), each_bin(parts.tolist()).cast("int") - 1)))
    own = placed.withColumn("g", each_bin(bin_of.tolist(), "i").cast("int"))
    own = own.withColumn("e", F.pmod(F.xxhash64("rep"), each_bin(parts.tolist())).cast("int"))
    dealt = own.join(passed.select("g", F.col("q").alias("chunk")).distinct(), "g")

    def meet(group: tuple, own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asking):
            return pd.DataFrame({"rep": [], "found": [], "score": []}).astype({"rep": "int64", "found": "int64", "score": "float64"})
        mine, theirs, reps, ids, out = np.array(own["v"].tolist()), np.array(asking["v"].tolist()), asking["rep"].to_numpy(), own["rep"].to_numpy(), []
        at_column = np.searchsorted(columns[group[0]], own["i"].to_numpy())
        cell = at_column * shape[1] + own["j"].to_numpy()
        bits = np.array([np.frombuffer(c, np.uint8) for c in asking["cells"]])
        for at in range(0, len(theirs), 256):
            allowed = np.unpackbits(bits[at : at + 256], axis=1).astype(bool)
            out += [(reps[at + q], i, s) for q, i, s in nearest(mine, ids, cell, theirs[at : at + 256], allowed, k + 1)]
        return pd.DataFrame(out, columns=["rep", "found", "score"])

    near = dealt.groupBy("g", "e", "chunk").cogroup(probes.groupBy("g", "e", "q")).applyInPandas(meet, "rep long, found long, score double")
    closest = Window.partitionBy("rep").orderBy("score", "found")
    best = near.withColumn("_n", F.row_number().over(closest)).filter(F.col("_n") <= k + 1)
    ids = best.join(entries.select(F.col("rep").alias("found"), "ids"), "found").select("rep", "score", F.explode("ids").alias("vec_id"))
    per_rep = ids.withColumn("_n", F.row_number().over(Window.partitionBy("rep").orderBy("score", "vec_id"))).filter(F.col("_n") <= k + 1)
    each = asked.join(per_rep, "rep").filter("query_id <> vec_id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
