"""Unigram encoding and decoding with the pieces of a SentencePiece vocabulary.

A blank becomes the marker U+2581 and one is put in front; the marked text is cut into the
pieces with the largest sum of log scores (Viterbi over a double-array trie). Characters
that no piece holds fall back to byte pieces, as does a U+2581 of the text itself, so
decoding gives back every text exactly. The vocabulary file is not trained or changed: it
ranks its pieces, and a piece of rank r has the log score of a Zipf-Mandelbrot law,
-log((r + SHIFT) * Z), Z making the scores a distribution.

No piece holds a marker behind another character, nor a line end, so the best cut of a
text is the best cuts of its words, in turn. Words new to a Python worker are cut together,
those of one length in lockstep, and remembered; beyond `CACHE_WORDS` only the words of the
present batch are kept. Words over `LOCKSTEP` characters are cut one by one in linear time.

Results for odd rows: a null or empty text has no ids and decodes to an empty text; very
long texts and words are cut whole; repeated rows get the same ids; of equal sums the cut
with the longest last piece is taken. Only the key and the text are read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
STAND_IN = "\ud800"  # for a marker of the text itself; no valid text holds it
SHIFT = 2.7
UNUSED = -1e8
BYTE_PENALTY = 10.0
LOCKSTEP = 48
CACHE_WORDS = 300_000
#: Words of more places are never remembered, so the cache is bounded in bytes too.
LONG_WORD = 64
DIGEST = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string, exact boolean"

_codecs: dict[str, "Codec"] = {}


class DoubleArray:
    """A trie of strings in three flat arrays: next = base[node] + code, if check[next] is node."""

    def __init__(self, words: dict[str, int]):
        self.code = {c: i + 1 for i, c in enumerate(sorted({c for w in words for c in w}))}
        items = sorted((tuple(self.code[c] for c in w), v) for w, v in words.items())
        base, check, value = [0], [0], [-1]
        self.longest = max(map(len, words))
        free, todo = 1, [(0, 0, len(items), 0)]
        while todo:
            node, lo, hi, depth = todo.pop()
            if len(items[lo][0]) == depth:
                value[node] = items[lo][1]
                lo += 1
            groups = []
            while lo < hi:
                c, start = items[lo][0][depth], lo
                while lo < hi and items[lo][0][depth] == c:
                    lo += 1
                groups.append((c, start, lo))
            if not groups:
                continue
            first, reach = groups[0][0], groups[-1][0] - groups[0][0]
            while free < len(check) and check[free] >= 0:
                free += 1
            at = free
            while True:
                if at + reach >= len(check):
                    more = at + reach + 1024 - len(check)
                    base += [0] * more
                    check += [-1] * more
                    value += [-1] * more
                if check[at] < 0 and all(check[at + c - first] < 0 for c, _, _ in groups):
                    break
                at += 1
            base[node] = at - first
            for c, s, e in groups:
                check[at + c - first] = node
                todo.append((at + c - first, s, e, depth + 1))
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, value))


class Codec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(i, sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
        used = {p: (i, -s) for i, p, s in pieces if s > UNUSED and not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        used.setdefault(MARK, (sp.piece_to_id(MARK), 1 + max(r for _, r in used.values())))  # the vocabulary has it, unranked
        if sp.is_unknown(used[MARK][0]):
            raise ValueError("the vocabulary has no piece for a blank")
        if any(MARK in p[1:] or "\n" in p for p in used):
            raise ValueError("a piece reaches over a word's end")
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.is_byte = np.zeros(len(pieces), bool)
        self.is_byte[self.byte_ids] = True
        z = math.log(sum(1 / (r + SHIFT) for _, r in used.values()))
        self.score = np.full(len(pieces), -np.inf)
        for i, r in used.values():
            self.score[i] = -math.log(r + SHIFT) - z
        self.fallback = float(self.score[[i for i, _ in used.values()]].min()) - BYTE_PENALTY
        self.trie = DoubleArray({p: i for p, (i, _) in used.items()})
        self.bytes_of = [b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace(MARK, " ").encode() for i, p, _ in pieces]
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.known: dict[str, bytes] = {"": b""}

    def _bytes(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in (MARK if char == STAND_IN else char).encode()]

    def _cut_one(self, word: str) -> list[int]:
        """Viterbi over one word."""
        base, check, value, score, code = self.trie.base, self.trie.check, self.trie.value, self.score, self.trie.code
        n = len(word)
        best, piece, start = [-math.inf] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            node, single = 0, False
            for j in range(i, n):
                c = code.get(word[j], 0)
                t = int(base[node]) + c
                if not c or not 0 < t < len(check) or check[t] != node:
                    break
                node, v = t, int(value[t])
                if v >= 0:
                    single |= j == i
                    if best[i] + score[v] > best[j + 1]:
                        best[j + 1], piece[j + 1], start[j + 1] = best[i] + float(score[v]), v, i
            if not single and best[i] + self.fallback > best[i + 1]:
                best[i + 1], piece[i + 1], start[i + 1] = best[i] + self.fallback, -1, i
        out, at = [], n
        while at:
            out.append(self._bytes(word[start[at]]) if piece[at] < 0 else [piece[at]])
            at = start[at]
        return [x for part in reversed(out) for x in part]

    def _cut_equal(self, words: list[str]) -> list[list[int]]:
        """Viterbi over words of one length in lockstep."""
        t, score, n, m = self.trie, self.score, len(words[0]), len(words)
        codes = np.array([[t.code.get(c, 0) for c in w] for w in words], np.int32)
        best, piece, start = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -1, np.int32), np.zeros((n + 1, m), np.int32)
        best[0] = 0
        for i in range(n):
            who, node, single = np.arange(m), np.zeros(m, np.int64), np.zeros(m, bool)
            for j in range(i, min(n, i + t.longest)):
                c = codes[who, j]
                to = t.base[node] + c
                on = (c > 0) & (to > 0) & (to < len(t.check))
                who, node, to = who[on], node[on], to[on]
                on = t.check[to] == node
                who, node = who[on], to[on]
                if not len(who):
                    break
                v = t.value[node]
                ends = v >= 0
                w, v = who[ends], v[ends]
                if j == i:
                    single[w] = True
                new = best[i, w] + score[v]
                more = new > best[j + 1, w]
                w = w[more]
                best[j + 1, w], piece[j + 1, w], start[j + 1, w] = new[more], v[more], i
            w = np.flatnonzero(~single & (best[i] + self.fallback > best[i + 1]))
            best[i + 1, w], piece[i + 1, w], start[i + 1, w] = best[i, w] + self.fallback, -1, i
        pieces, starts, out = piece.T.tolist(), start.T.tolist(), []
        for word, p, s in zip(words, pieces, starts):
            at, ids = n, []
            while at:
                if p[at] < 0:
                    ids += reversed(self._bytes(word[s[at]]))
                else:
                    ids.append(p[at])
                at = s[at]
            out.append(ids[::-1])
        return out

    def cut(self, words: list[str]) -> list[list[int]]:
        """Ids of each marked word."""
        by_length: dict[int, list[int]] = {}
        out: list[list[int]] = [[] for _ in words]
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for n, places in by_length.items():
            if n > LOCKSTEP or len(places) < 4:
                for k in places:
                    out[k] = self._cut_one(words[k])
                continue
            for at in range(0, len(places), 8192):
                part = places[at : at + 8192]
                for k, ids in zip(part, self._cut_equal([words[k] for k in part])):
                    out[k] = ids
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts as little-endian 32-bit bytes."""
        split = [(MARK + t.replace(MARK, STAND_IN).replace(" ", " " + MARK).replace("\n", " \n ")).split(" ") if t else [] for t in texts]
        known, every = self.known, set()
        for words in split:
            every.update(words)
        fresh = [w for w in every if w not in known]
        coded = {w: np.array(ids, "<u4").tobytes() for w, ids in zip(fresh, self.cut(fresh))}
        if len(known) + len(coded) > CACHE_WORDS:
            self.known = known = {"": b"", **{w: known[w] for w in every if w in known}}
        long = {w: coded.pop(w) for w in fresh if len(w) > LONG_WORD}
        known.update(coded)
        at_hand = {**{w: known[w] for w in every if w in known}, **long} if long else known
        return [b"".join(map(at_hand.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoder(path: str):
    """A column function: text to array<int> of ids."""

    @F.pandas_udf("array<int>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([np.frombuffer(x, "<i4") for x in codec(path).encode(t.tolist())], dtype=object)

    return encode


def decoder(path: str):
    """A column function: array<int> of ids to text."""

    @F.pandas_udf("string")
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in ids:
            yield pd.Series([codec(path).decode(np.asarray([] if x is None else x, "<u4").tobytes()) for x in s], dtype=object)

    return decode


def round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Digests of the ids of every text and of what they decode to; a map without a shuffle."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, out = b.slice(at, 256), []
                texts = part.column(1).to_pylist()
                for t, ids in zip(texts, c.encode(texts)):
                    back = c.decode(ids)
                    byte_pieces = int(c.is_byte[np.frombuffer(ids, "<u4")].sum())
                    out.append((len(ids) // 4, byte_pieces, zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == (t or "")))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, kind) for x, kind in zip(zip(*out), kinds))], names=["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_sha256", "exact"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(digest, DIGEST)
