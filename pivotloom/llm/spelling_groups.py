"""Spelling variants: words one edit apart, found by pivotal grams.

Every word has its bigrams in one global order, rarest first. Its prefix is the three first of
them (with further places of the third), its pivots the two disjoint ones of the prefix with
the smallest sum of word counts, chosen by dynamic programming over places. One edit breaks
at most one pivot, so of two near words that whose prefix ends earlier in the order has a pivot
that stands in the other's prefix.

That pivot stands at the same place from the left if the edit is to its right, and from the
right if it is to its left, with all letters on the other side of it equal. A pivot's key is
therefore the place and the equal side; where that side has fewer than `STRONG` letters, the
edited side adds the half of its letters that the edit leaves alone. Both sides of the join
are short rows, no pair is made but of words with an equal key, and every pair is verified by
its distance. Bigrams are of an alphabet of 90 letters, so their counts are at most 8,100 rows.

A word's form is its near word of most occurrences, if it has `RATIO` times the word's own;
roots follow forms by pointer doubling, in rounds of the logarithm of the longest chain, which
is short as every form is `RATIO` times as frequent.

Results for odd rows: null and empty texts have no words; very long texts and words are
read whole; repeated rows count each; ties of forms go to the smallest in code-point order; a
null id is written as no digits before the colon; an empty table gives no row. Only the key
and the text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pivotloom.llm.common import checkpoint

LETTERS = 7
OCCURRENCES = 2
RATIO = 10
#: Every so many-th run (by its hash) loses a letter.
DAMAGE = 31
STRONG = 7
#: Entries of a task's counts that are held before they are handed on.
HELD_WORDS = 150_000
RUN = re.compile(f"[a-zÀ-ÿ]{{{LETTERS},}}")


def runs(doc_id: int | None, text: str | None) -> Counter[str]:
    """The words of one text, damaged where the hash of id and run says so, with their counts."""
    start, out = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id), Counter()
    for run, n in Counter(RUN.findall((text or "").encode().lower().decode())).items():
        h = zlib.crc32(run.encode(), start)
        if h % DAMAGE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def counts(held: Counter[str], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=names)


def words(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """word, n: distinct words that are long and frequent enough, counted over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for b in batches:
            for k, t in zip(b.column(0), b.column(1)):
                for w, n in runs(k.as_py(), t.as_py()).items():
                    if len(w) >= LETTERS:
                        held[w] += n
                if len(held) > HELD_WORDS:
                    yield counts(held, ["word", "n"])
                    held = Counter()
        yield counts(held, ["word", "n"])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OCCURRENCES)


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Each bigram's place in the global order and its number of words; bounded by the alphabet's square."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for b in batches:
            for w in b.column(0).to_pylist():
                held.update({w[i : i + 2] for i in range(len(w) - 1)})
        yield counts(held, ["gram", "words"])

    found = words.select("word").mapInArrow(count, "gram string, words long").groupBy("gram").agg(F.sum("words").alias("words")).collect()
    return {r["gram"]: (i, r["words"]) for i, r in enumerate(sorted(found, key=lambda r: (r["words"], r["gram"])))}


def prefix_of(word: str, order: dict[str, tuple[int, int]]) -> tuple[list[int], int]:
    """Places of the grams up to the third in the order, with ties, and that third's number."""
    grams = sorted((order[word[i : i + 2]][0], i) for i in range(len(word) - 1))
    last = grams[2][0]
    return [i for g, i in grams if g <= last], last


def pivots_of(word: str, places: list[int], order: dict[str, tuple[int, int]]) -> list[int]:
    """Two disjoint places of the prefix with the smallest sum of word counts.

    best[m] is the cheapest choice of m disjoint grams among the places so far.
    """
    best: list[list[tuple[int, list[int]]]] = [[(0, [])], [], []]
    for i in sorted(places):
        cost = order[word[i : i + 2]][1]
        for m in (1, 0):
            ready = [(c, chosen) for c, chosen in best[m] if not chosen or chosen[-1] + 2 <= i]
            if ready:
                c, chosen = min(ready)
                best[m + 1].append((c + cost, [*chosen, i]))
    return min(best[2])[1]


def keys_of(word: str, i: int, reach: tuple[int, ...]) -> set[int]:
    """Keys of the gram at place i, for an edit on either side of it.

    reach has the differences in length that a partner may have: 0 alone for a pivot, whose
    own lengths decide, and -1, 0 and 1 for a gram of a prefix.
    """
    out = set()
    for side, w, p in (("l", word, i), ("r", word[::-1], len(word) - 2 - i)):
        kept, rest = w[: p + 2], len(w) - p - 2
        if len(kept) >= STRONG:
            out.add(f"{side}{p}:{kept}")
            continue
        for d in reach:
            half = max(0, rest + d) // 2
            other = max(0, rest + d) - half
            if half <= rest:
                out.add(f"{side}{p}<{w[: p + 2 + half]}")
            if other <= rest:
                out.add(f"{side}{p}>{kept}|{w[len(w) - other :]}")
    return {int(np.int64(np.uint64(xxhash.xxh64_intdigest(x)))) for x in out}


def keyed(words: DataFrame, order: dict[str, tuple[int, int]], pivots: bool) -> DataFrame:
    """key, last, word, n of each word's pivots, or of its prefix."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, keys, lasts = [], [], []
            for row, w in enumerate(b.column(0).to_pylist()):
                places, last = prefix_of(w, order)
                chosen = pivots_of(w, places, order) if pivots else places
                own = set().union(*(keys_of(w, i, (0,) if pivots else (-1, 0, 1)) for i in chosen))
                at += [row] * len(own)
                keys += own
                lasts += [last] * len(own)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lasts, pa.int32()), b.column(0).take(rows), b.column(1).take(rows)], names=["key", "last", "word", "n"])

    return words.select("word", "n").mapInArrow(sign, "key long, last int, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n of every two words one edit apart, once; words must be written down."""
    order = gram_order(words)
    a = keyed(words, order, True).select("key", F.col("last").alias("a_last"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = keyed(words, order, False).select("key", F.col("last").alias("b_last"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = a.join(b, "key").filter(
        (F.col("a_last") <= F.col("b_last")) & (F.col("a") != F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1))
    first = F.col("a") < F.col("b")
    return met.select(
        F.least("a", "b").alias("a"), F.when(first, F.col("a_n")).otherwise(F.col("b_n")).alias("a_n"),
        F.greatest("a", "b").alias("b"), F.when(first, F.col("b_n")).otherwise(F.col("a_n")).alias("b_n")).distinct()


def with_roots(words: DataFrame) -> DataFrame:
    """words (word, form) with the root: forms followed to the last, the word itself without one."""
    links = checkpoint(words.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = checkpoint(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not links.filter("moved").head(1):
            break
    return words.join(links.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """word, n, form, root, n_near, form_n of every word."""
    known = checkpoint(words(docs, text, key))
    pairs = near_pairs(known)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("minus"), F.col("b").alias("form"))).alias("top"))
    j = known.join(best, "word", "left")
    form_n = -F.col("top.minus")
    taken = form_n >= RATIO * F.col("n")
    found = checkpoint(j.select("word", "n", F.when(taken, F.col("top.form")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, form_n).alias("form_n")))
    return with_roots(found).select("word", "n", "form", "root", "n_near", "form_n")
