"""Packing of tokenised documents into windows, best fit decreasing.

Each document's ids (with its end id) are cut into full windows and one rest. Rests are
sorted by falling length and each goes to the open window with the least room that still
takes it, found in a segment tree whose leaves count the open windows of each remaining
capacity. Pieces are dealt by a hash of their place into groups of about `group_rows`, packed
independently, so no task or machine sees the whole corpus, whatever ids repeat; a group of
this size leaves but a few windows unfilled. Pieces are small rows, as the texts don't leave
the map side; they are checkpointed first, so that their places stay.

Ids of a text are the ids of its words in turn, as the tokenizer's patterns never reach
over a blank, nor from a letter or digit to the punctuation behind it. Each word is
encoded once per Python worker and numbered; its ids stand in one flat array, from which a
text's are gathered. New words of letters are encoded many at a time, as one text that is
cut behind each piece that ends a word. When these tables take more than `CACHE_BYTES`,
they are begun anew. `WordEncoder` tries these properties on samples when it loads a
tokenizer; one without them encodes whole texts.

Results for odd rows: a null, empty or blank text has the end id only; very long texts
yield many full windows; a text with a special token's string has that token's id there;
repeated rows are packed each, as are rows that share an id; ties in length go by document
and start; a null key is kept; an empty table gives no row. Only the key and the text are
read. A sequence is padded to the window, except where its use is a power of two already.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pivotloom.llm.common import checkpoint

WINDOW = 2048
END_ID = 1
GROUP_ROWS = 20_000
#: Bytes of remembered words; an entry takes some besides its letters and ids.
CACHE_BYTES = 96 << 20
ENTRY_BYTES = 190
LONG_WORD = 64
#: New words encoded as one text.
TOGETHER = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long, padding long"

_encoders: dict[str, "WordEncoder"] = {}


class Numbers(dict):
    """Words to their numbers; a new word gets the next one."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class WordEncoder:
    """Ids of texts as arrays of 32-bit numbers, with words remembered."""

    #: ASCII punctuation, but for the apostrophe, right behind a letter or digit.
    behind_letter = re.compile(r"[!-&(-/:-@\[-`{-~](?<=[^\W_].)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()
        self.by_words = bool(self.ends.any()) and self.parts_words()

    def forget(self) -> None:
        """Begin the tables anew; the empty word has number 0 and no ids."""
        self.numbers, self.held = Numbers({"": 0}), 0
        self.flat, self.at = np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def parts_words(self) -> bool:
        """Whether samples put together, with and without a blank, have the ids of their parts."""
        parts = ["Word", "don't", "naïve", "x9", "12", "!?", "'s", "日本", "ÀB", "<", "²", "́", "ªb"]
        pairs = [a + " " + b for a in parts for b in parts] + [a + b for a in parts for b in ("!?", "<", ".'s", "_", "-́")]
        return all(self._by_words([t])[0].tolist() == w.tolist() for t, w in zip(pairs, self.whole(pairs)))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def code(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word; those of letters are encoded `TOGETHER` at a time."""
        letters = [w for w in words if w.isalpha() and len(w) <= LONG_WORD]
        coded: dict[str, np.ndarray] = {}
        for at in range(0, len(letters), TOGETHER):
            some = letters[at : at + TOGETHER]
            ids = self.whole([" ".join(some)])[0]
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                coded.update(zip(some, np.split(ids, stops[:-1])))
        rest = [w for w in words if w not in coded]
        coded.update(zip(rest, self.whole(rest)))
        return [coded[w] for w in words]

    def _by_words(self, texts: list[str]) -> list[np.ndarray]:
        if self.held > CACHE_BYTES:
            self.forget()
        known, number = len(self.numbers), self.numbers.__getitem__
        numbered = []
        for t in texts:
            t = self.behind_letter.sub(r" \g<0>", t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
            words = t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            numbered.append(np.fromiter(map(number, words), np.int64, len(words)))
        fresh = list(islice(reversed(self.numbers), len(self.numbers) - known))[::-1]
        if fresh:
            coded = self.code(fresh)
            lengths = np.fromiter(map(len, coded), np.int64, len(coded))
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(lengths)))
            self.flat = np.concatenate((self.flat, *coded))
            self.held += 4 * int(lengths.sum()) + sum(map(len, fresh)) + ENTRY_BYTES * len(fresh)
        out = []
        for n in numbered:
            start = self.at[n]
            length = self.at[n + 1] - start
            done = np.cumsum(length)
            out.append(self.flat[np.arange(done[-1]) + np.repeat(start - done + length, length)])
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        texts = [t or "" for t in texts]
        apart = {i for i, t in enumerate(texts) if not self.by_words or any(s in t for s in self.special)}
        own = iter(self._by_words([t for i, t in enumerate(texts) if i not in apart]))
        whole = iter(self.whole([texts[i] for i in sorted(apart)]))
        return [next(whole) if i in apart else next(own) for i in range(len(texts))]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cut(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: full windows, then the rest; a map without a shuffle."""
    end = np.uint32(end_id)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for k, ids in zip(part.column(0).to_pylist(), coder.encode(part.column(1).to_pylist())):
                    ids = np.append(ids, end)
                    for s in range(0, len(ids), window):
                        piece = ids[s : s + window]
                        out.append((k, s, len(piece), zlib.crc32(piece), len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(pieces, PIECES)


class RoomTree:
    """Counts of open windows by remaining capacity, in a segment tree."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity of at least `need` that an open window has, or -1."""
        at, count = need + self.leaves, self.count
        if count[at]:
            return need
        while at > 1:
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; pieces must come by falling length."""
    tree, open_windows = RoomTree(window), {}
    number, offset, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        room = tree.tightest(n)
        if room < 0:
            w, room, used = used, window, used + 1
        else:
            w = open_windows[room].pop()
            tree.add(room, -1)
        number[i], offset[i] = w, window - room
        if room > n:
            open_windows.setdefault(room - n, []).append(w)
            tree.add(room - n, 1)
    return number, offset


def pack(pieces: DataFrame, window: int = WINDOW, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Sequences of the pieces, which must come in the same order whenever they are read."""
    groups = max(1, -(-pieces.count() // group_rows))

    def fill(key: tuple[pa.Scalar, ...], pieces: pa.Table) -> pa.Table:
        pieces = pieces.drop_columns(["g"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        length = pieces["length"].to_numpy()
        number, offset = best_fit(length, window)
        use = np.bincount(number, weights=length).astype(np.int64)
        pad = np.where(use & (use - 1) == 0, 0, window - use)
        placed = {"sequence_id": key[0].as_py() * (1 << 32) + number, "offset": offset, "padding": pad[number]}
        for name, values in placed.items():
            pieces = pieces.append_column(name, pa.array(values, pa.int64()))
        return pieces

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(fill, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", window: int = WINDOW, end_id: int = END_ID, group_rows: int = GROUP_ROWS) -> DataFrame:
    return pack(checkpoint(cut(docs, tokenizer_path, text, key, window, end_id)), window, group_rows)
