"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes ratios.

Features say which hashed 3- to 5-grams of a text's lower-cased letters occur. Each is
scaled by the log of its smoothed ratio between toxic and other labelled texts, and a
logistic regression is fitted on the scaled features; its intercept is then moved from
the balanced sample to the share of toxic rows among all training labels.

Results for odd rows: a null or empty text has the score of a text without features, the
training prior; very long texts are read in slices; repeated rows get the same score; a
table without labels of both classes gives every text a score of about 0. Columns of the input
other than the key and the text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pivotloom.llm.common import checkpoint, fold_of, per_class_sample
from pivotloom.llm.language_id import letter_table

BITS = 18
SIZES = (3, 4, 5)
SLICE = 1 << 20
#: Labelled rows of each class that training reads at most, and features it keeps.
TRAIN_ROWS = 2000
FEATURES = 4096


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams, a slice and a size at a time; a run of other characters is one blank."""
    table = letter_table()
    for at in range(0, len(text), SLICE):
        points = np.frombuffer(text[max(0, at - max(SIZES)) : at + SLICE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        c = np.concatenate(([0], np.where(table[points], points, 0), [0])).astype(np.uint32)
        c = c[np.concatenate(([True], (c[1:] > 0) | (c[:-1] > 0)))]
        h = c * np.uint32(0x9E3779B1)
        for n in range(2, max(SIZES) + 1):
            if len(c) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[n - 1 :] * np.uint32(0xC2B2AE3D)
            if n in SIZES:
                yield (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)


@dataclass
class ToxicityModel:
    """slot: the feature of each hash or 0; weights: of each feature, 0 first."""

    slot: np.ndarray
    weights: np.ndarray
    intercept: float

    def features(self, text: str | None) -> np.ndarray:
        found = [f[f > 0] for h in grams(text or "") for f in [self.slot[h]]]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int16)

    def score(self, text: str | None) -> float:
        z = self.intercept + float(self.weights[self.features(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 2e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient steps."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    step = 1.0 / (0.25 * max(1e-9, float((x * x).sum(1).mean())) + penalty)
    v, vb = w.copy(), b
    for i in range(rounds):
        g = (1 / (1 + np.exp(-np.clip(x @ v + vb, -30, 30))) - y).astype(np.float32)
        new, new_b = v - step * (x.T @ g / len(y) + penalty * v), vb - step * float(g.mean())
        v, vb = new + (i / (i + 3)) * (new - w), new_b + (i / (i + 3)) * (new_b - b)
        w, b = new, new_b
    return w, b


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic",
          rows: int = TRAIN_ROWS, features: int = FEATURES) -> ToxicityModel:
    """Fit on at most `rows` labelled texts of each class outside fold 0, one text an id."""
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("y in (0, 1)").filter(fold_of(F.col("k")) != 0)
    share = marked.agg(F.avg("y")).first()[0]
    blank = ToxicityModel(np.zeros(1 << BITS, np.int16), np.zeros(1, np.float32), -500.0)
    if share in (None, 0.0, 1.0):
        return blank
    chosen = per_class_sample(marked, "y", "k", rows)
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")
    sample = checkpoint(texts.groupBy("k").agg(F.min("t").alias("t"), F.min("y").alias("y")))

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, rows_of = np.zeros((2, 1 << BITS), np.int32), [0, 0]
        for b in batches:
            for t, y in zip(b["t"], b["y"]):
                seen = np.unique(np.concatenate([np.zeros(0, np.uint32), *grams(t or "")]))
                count[y, seen] += 1
                rows_of[y] += 1
        for y in (0, 1):
            at = np.flatnonzero(count[y])
            yield pd.DataFrame({"y": [y], "rows": [rows_of[y]], "at": [at.astype("<i4").tobytes()], "n": [count[y, at].astype("<i4").tobytes()]})

    count, rows_of = np.zeros((2, 1 << BITS)), [0, 0]
    for r in sample.select("t", "y").coalesce(8).mapInPandas(tally, "y int, rows long, at binary, n binary").toLocalIterator():
        count[r["y"], np.frombuffer(r["at"], "<i4")] += np.frombuffer(r["n"], "<i4")
        rows_of[r["y"]] += r["rows"]
    if not all(rows_of):
        return blank
    p = (count + 1) / (np.array(rows_of)[:, None] + 2)
    ratio = np.log(p[1] / p[0])
    pooled = (count.sum(0) + 1) / (sum(rows_of) + 2)
    z = np.abs(p[1] - p[0]) / np.sqrt(pooled * (1 - pooled) * (1 / rows_of[0] + 1 / rows_of[1]))
    z[count.sum(0) < 3] = 0
    kept = np.sort(np.argsort(-z, kind="stable")[:features])
    slot = np.zeros(1 << BITS, np.int16)
    slot[kept] = np.arange(1, len(kept) + 1)
    draft = ToxicityModel(slot, np.zeros(len(kept) + 1, np.float32), 0.0)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t, y in zip(b["k"], b["t"], b["y"]):
                bits = np.zeros(len(kept) + 1, bool)
                bits[draft.features(t)] = True
                out.append((k, y, np.packbits(bits).tobytes()))
            yield pd.DataFrame(out, columns=["k", "y", "bits"])

    found = sorted(sample.mapInPandas(project, "k long, y int, bits binary").collect(), key=lambda r: (r["k"], r["y"]))
    x = np.array([np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=len(kept) + 1)[1:] for r in found], np.float32)
    x *= ratio[kept].astype(np.float32)
    y = np.array([r["y"] for r in found], np.float32)
    w, b = fit_logistic(x, y)
    weights = np.concatenate(([0], w * ratio[kept])).astype(np.float32)
    drift = np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return ToxicityModel(slot, weights, float(b + drift))


def scorer(model: ToxicityModel):
    """A column function: text to its score."""

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            yield pa.array([model.score(x.as_py()) for x in t], pa.float64())

    return score


def score_documents(docs: DataFrame, model: ToxicityModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, score and predicted of every row; a map without a shuffle."""
    return docs.select(F.col(key), scorer(model)(F.col(text)).alias("score")).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows scored under `limit`, with their own columns only."""
    return docs.select(*[docs[c] for c in docs.columns], scorer(model)(docs[text]).alias("_toxicity_score_")).filter(F.col("_toxicity_score_") < limit).select(*docs.columns)
