"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed character 1- to 3-grams over its
letters. Each language has several centroids, found by spherical k-means on a bounded
sample; the language of the centroid with the largest cosine is the answer, and a text
whose best cosine is under the calibrated threshold is rejected. A short text scores lower
than a long one of its language, so the threshold follows the number of distinct grams: it
is `THRESHOLD` of the least cosine that held-out texts, and their beginnings of the lengths
`STARTS`, have at that number. The held-out fifth of the sample fits nothing else.

Results for odd rows: a null text, or one without a letter, has language `und`, score 0
and is rejected; every other row gets a learned language, however short or long it is
(texts are read in slices, so memory doesn't follow their length). Repeated rows get the
same answer. Without any training row every answer is `und`. Other columns of the input
are passed through by `keep_identified` and never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pivotloom.llm.common import fold_of, per_class_sample

BITS = 14
SLICE = 1 << 20
#: Rows of each language that training reads at most.
TRAIN_ROWS = 300
CENTROIDS = 3
#: A text is rejected under this share of the least held-out cosine of texts with as many grams.
THRESHOLD = 0.3
#: Letters of the beginnings that stand for short texts.
STARTS = (8, 16, 32, 64, 128, 256, 512)
#: Held-out texts have a class for each doubling of distinct grams; one with fewer texts isn't used.
LEAST_HELD = 20
UNKNOWN = "und"
RESULT = "lang_pred string, score double, rejected boolean"

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For every code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def gram_counts(text: str, bits: int = BITS) -> np.ndarray | None:
    """Counts of hashed 1-, 2- and 3-grams; None for a text without a letter."""
    table, size, total, seen = letter_table(), 1 << bits, None, False
    for at in range(0, len(text), SLICE):
        points = np.frombuffer(text[max(0, at - 2) : at + SLICE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = table[points]
        if not is_letter.any():
            continue
        seen = True
        c = np.concatenate(([0], np.where(is_letter, points, 0), [0])).astype(np.uint32)
        two = c[:-1] * np.uint32(0x9E3779B1) ^ c[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) ^ c[2:] * np.uint32(0x27D4EB2F)
        one = c[1:-1][is_letter] * np.uint32(0x165667B1)
        two = two[(c[:-1] > 0) | (c[1:] > 0)] * np.uint32(0x2545F491)
        three = three[c[1:-1] > 0] * np.uint32(0x68E31DA4)
        counts = sum(np.bincount(h >> np.uint32(32 - bits), minlength=size) for h in (one, two, three))
        total = counts if total is None else total + counts
    return total if seen else None


@dataclass
class LanguageModel:
    """idf: per gram; centroids: one column each; languages: the language of each column.

    limits: (log2 of distinct grams, least cosine) points, between which it is interpolated.
    """

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    limits: list[tuple[float, float]]

    def limit(self, grams: int) -> float:
        return float(np.interp(np.log2(grams), *zip(*self.limits))) if self.limits else 0.0

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        value = (1 + np.log(counts[at])) * self.idf[at]
        return at, (value / np.sqrt((value * value).sum())).astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = gram_counts(text) if text else None
        if counts is None or not self.languages:
            return UNKNOWN, 0.0, True
        at, value = self.vector(counts)
        cosine = value @ self.centroids[at]
        best = int(cosine.argmax())
        score = float(min(1.0, max(0.0, cosine[best])))
        return self.languages[best], score, score < self.limit(len(at))


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from a farthest-first start; rows are unit vectors."""
    centres = [x.mean(0)]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[(x @ np.array(centres).T).max(1).argmin()])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        nearest = (x @ c.T).argmax(1)
        c = np.array([x[nearest == i].mean(0) if (nearest == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
          rows: int = TRAIN_ROWS, centroids: int = CENTROIDS) -> LanguageModel:
    """Fit on at most `rows` rows of each language outside fold 0.

    The sample is chosen on ids alone; only then are the texts of the chosen rows read (of
    rows that share an id the smallest text), and they are turned into sparse counts on the
    executors.
    """
    chosen = per_class_sample(
        docs.select(F.col(key).alias("k"), F.col(lang).alias("l")).filter("l is not null").filter(fold_of(F.col("k")) != 0), "l", "k", rows
    )
    sample = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null").join(F.broadcast(chosen), "k")
    sample = sample.groupBy("k").agg(F.min("l").alias("l"), F.min("t").alias("t")).select("l", "t")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for l, t in zip(b["l"], b["t"]):
                held = zlib.crc32(t.encode("utf-8", "surrogatepass")) % 5 == 0
                for part in [t, *(t[:n] for n in STARTS if n < len(t))] if held else [t]:
                    if (c := gram_counts(part)) is not None:
                        at = np.flatnonzero(c)
                        out.append((l, held, at.astype("<i4").tobytes(), c[at].astype("<i4").tobytes()))
            yield pd.DataFrame(out, columns=["l", "held", "at", "n"])

    rows_of_sample = sample.mapInPandas(count, "l string, held boolean, at binary, n binary").collect()
    size = 1 << BITS
    fitted = {r["l"] for r in rows_of_sample if not r["held"]}
    found = [r for r in rows_of_sample if not r["held"] or r["l"] not in fitted]
    found.sort(key=lambda r: (r["l"], bytes(r["at"]), bytes(r["n"])))
    df = np.ones(size)
    for r in found:
        df[np.frombuffer(r["at"], "<i4")] += 1
    model = LanguageModel((np.log((len(found) + 1) / df) + 1).astype(np.float32), np.zeros((size, 0), np.float32), [], [])
    columns = []
    for name in sorted({r["l"] for r in found}):
        rows_of = [r for r in found if r["l"] == name]
        x = np.zeros((len(rows_of), size), np.float32)
        for i, r in enumerate(rows_of):
            counts = np.zeros(size)
            counts[np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["n"], "<i4")
            at, value = model.vector(counts)
            x[i, at] = value
        c = cluster(x, centroids)
        columns += list(c)
        model.languages += [name] * len(c)
    if columns:
        model.centroids = np.ascontiguousarray(np.array(columns, np.float32).T)
        held = []
        for r in rows_of_sample:
            if r["held"]:
                counts = np.zeros(size)
                counts[np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["n"], "<i4")
                at, value = model.vector(counts)
                held.append((len(at), float((value @ model.centroids[at]).max())))
        model.limits = limits_of(held)
    return model


def limits_of(held: list[tuple[int, float]]) -> list[tuple[float, float]]:
    """Points of `LanguageModel.limits` from (distinct grams, cosine) of held-out texts.

    A text of one gram says too little to be rejected; beyond the last class its limit holds.
    """
    points = [(0.0, 0.0)]
    for k in range(1, BITS + 1):
        own = [(n, c) for n, c in held if k <= np.log2(n) < k + 1]
        if len(own) >= LEAST_HELD:
            points.append((float(np.median(np.log2([n for n, _ in own]))), THRESHOLD * min(c for _, c in own)))
    return points if len(points) > 1 else []


def predictor(model: LanguageModel):
    """A column function: text to struct<lang_pred, score, rejected>."""

    @F.arrow_udf(RESULT)
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            lang, score, rejected = zip(*(model.predict(x.as_py()) for x in t)) if len(t) else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["lang_pred", "score", "rejected"])

    return predict


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score and rejected of every row; a map without a shuffle."""
    return docs.select(F.col(key), predictor(model)(F.col(text)).alias("p")).select(key, "p.*")


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows whose language isn't rejected, with their own columns only."""
    columns = [docs[c] for c in docs.columns]
    return docs.select(*columns, predictor(model)(docs[text]).alias("_language_verdict_")).filter("not _language_verdict_.rejected").select(*docs.columns)
