"""Line dedup, spelling groups and token alignment against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from pivotloom.llm import line_dedup as L
from pivotloom.llm import spelling_groups as W
from pivotloom.llm import token_alignment as T
from pivotloom.llm.queries import OP11_SQL, TOKENIZERS, op11_line_dedup, op12_spelling_groups, op13_token_alignment

SF = "/root/testdata/sf0.001"
PATHS = (TOKENIZERS("byte_bpe_50k.json"), TOKENIZERS("piece_bpe_32k.model"))
BIG = (1 << 60) + 1
LINE = "the same line of more than twenty letters"


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, k1 string, cells string")


def odd(texts):
    ids = [BIG, BIG + 1, None, 5, 5, 6, 7]
    return [(i, t, "a", "b") for i, t in zip(ids, texts)]


def plain_dedup(rows):
    holders = defaultdict(set)
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= L.MIN_CHARS:
                holders[key(line)].add(-1 if doc is None else doc)
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if len(holders.get(key(x), ())) < L.MIN_DOCS or max(holders[key(x)]) == (-1 if doc is None else doc)]
        out.append((doc, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup_equals_sql(spark):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(db.execute(OP11_SQL).fetchall())
    got = sorted(tuple(r) for r in op11_line_dedup(spark, SF).collect())
    assert got == want
    assert sum(r[2] for r in got) > 0


def test_line_dedup_odd_rows(spark):
    a, b = f" {LINE}\t", LINE.upper()
    rows = odd([f"{a}\nx\n\n{LINE}", f"{b}\ny", LINE, None, LINE, "", "É" * 19 + "\n" + "é" * 20 + "\n" + LINE])
    docs = documents(spark, rows)
    got = L.dedup(docs, L.build(docs)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_dedup([r[:2] for r in rows])
    only_one = documents(spark, [(9, LINE, "", "")] * 4)
    assert {r["n_dropped"] for r in L.dedup(only_one, L.build(only_one)).collect()} == {0}
    none = documents(spark, [])
    assert L.dedup(none, L.build(none)).count() == 0


def test_line_index_is_reversible(spark):
    rng = random.Random(4)
    pool = [f"line number {i} of the common pool of lines" for i in range(40)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(6))), "", "") for i in range(60)]
    first, second = documents(spark, rows[:35]), documents(spark, rows[35:])
    state = lambda x: (sorted(map(tuple, x.references.collect())), sorted(map(tuple, x.counts.collect())))
    whole = L.build(documents(spark, rows))
    grown = L.insert(L.build(first), second)
    assert state(grown) == state(whole)
    assert state(L.insert(grown, first)) == state(whole)
    gone = [r for r in rows if r[0] % 3]
    left = documents(spark, gone)
    shrunk = L.remove(whole, documents(spark, [r for r in rows if r[0] % 3 == 0]))
    assert state(shrunk) == state(L.build(left))
    assert sorted((tuple(r) for r in L.dedup(left, shrunk).collect()), key=repr) == plain_dedup([r[:2] for r in gone])
    again = L.insert(shrunk, documents(spark, [r for r in rows if r[0] % 3 == 0]))
    assert state(again) == state(whole)
    assert sorted(map(tuple, L.dropped(again).select("doc_id").collect())) == sorted(map(tuple, L.dropped(whole).select("doc_id").collect()))


def test_line_index_is_written_and_read(spark, tmp_path):
    docs = documents(spark, [(i, LINE, "", "") for i in range(4)])
    index = L.build(docs)
    index.write(f"file://{tmp_path}/index")
    back = index.read(spark, f"file://{tmp_path}/index")
    assert sorted(r["n_dropped"] for r in L.dedup(docs, back).collect()) == [0, 1, 1, 1]


def test_cuckoo_filter_inserts_and_deletes():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 63), 1 << 63, 20_000, dtype=np.int64)
    own = L.Cuckoo.of(keys)
    assert own.holds(keys).all()
    assert own.holds(rng.integers(-(1 << 63), 1 << 63, 50_000, dtype=np.int64)).mean() < 0.002
    own.delete(keys[:12_000])
    assert own.holds(keys[12_000:]).all()
    assert own.holds(keys[:12_000]).mean() < 0.002
    own.delete(keys[12_000:])
    assert not own.cells.any()
    twice = L.Cuckoo.of(np.array([5, 5, 5]))
    twice.delete(np.array([5, 5]))
    assert twice.holds(np.array([5])).all()
    full = L.Cuckoo.sized(1)
    assert not full.insert(keys[:1000])


def plain_words(rows):
    found = Counter()
    for doc, text in rows:
        run = ""
        for c in (text or "") + "\n":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c <= "Z" else c
            elif run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                found[run] += 1
                run = ""
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def plain_groups(rows):
    known = plain_words(rows)
    shape = defaultdict(set)
    for w in known:
        for i in range(len(w)):
            shape[w[:i] + "*" + w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in known:
                shape[f"{w}-{i}"] |= {w, w[:i] + w[i + 1 :]}
    near = defaultdict(set)
    for own in shape.values():
        for w in own:
            near[w] |= own - {w}
    form = {}
    for w, n in known.items():
        best = min(near[w], key=lambda x: (-known[x], x), default=None)
        form[w] = best if best and known[best] >= 10 * n else None
    out = []
    for w, n in known.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, form[w], root, len(near[w]), known[form[w]] if form[w] else None))
    return sorted(out)


def test_spelling_groups_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in op12_spelling_groups(spark, SF).collect())
    assert got == plain_groups(rows)
    assert any(r[2] for r in got)


def test_spelling_groups_of_dense_words(spark):
    """Few letters and many neighbours, repeated letters, chains of forms, odd rows."""
    rng = random.Random(3)
    some = ["".join(rng.choice("abé") for _ in range(rng.randrange(7, 10))) for _ in range(1500)]
    chain = ["abcdefgh"] * 2 + ["abcdefgx"] * 30 + ["abcdefyx"] * 400 + ["aaaaaaa"] * 3 + ["aaaaaaaa"] * 40
    text = " ".join(some + some + chain)
    rows = [(1, text, "", ""), (None, "AAAAAAA,Übergröße Übergröße1übergröße", "", ""), (None, None, "", ""), (2, "", "", ""), (BIG, "z" * 5000 + " " + "z" * 5000 + "y", "", ""), (BIG, "z" * 5000, "", "")]
    got = sorted(tuple(r) for r in W.group_variants(documents(spark, rows)).collect())
    assert got == plain_groups([r[:2] for r in rows])
    assert W.group_variants(documents(spark, [])).count() == 0


def plain_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    al = T.aligner(PATHS)
    docs, count = [], Counter()
    for t in texts:
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t, num_threads=1) if t else []
        sides = []
        for ids, spelled in ((x, al.a.spelled), (y, al.b.spelled)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(spelled[i]), i))
                at += len(spelled[i])
            sides.append(out)
        if not t or any(b"".join(s[i] for i in ids) != b" " + t.encode() for ids, s in ((x, al.a.spelled), (y, al.b.spelled))):
            docs.append(None)
            continue
        links, j = [], 0
        for lo, hi, i in sides[0]:
            while sides[1][j][1] <= lo:
                j += 1
            k = j
            while k < len(sides[1]) and sides[1][k][0] < hi:
                links.append((i, sides[1][k][2]))
                k += 1
        ends = sorted({s[1] for s in sides[0]} & {s[1] for s in sides[1]})
        parts, lo = [], 0
        for hi in ends:
            parts.append("|".join(",".join(str(i) for s, e, i in side if lo <= s and e <= hi) for side in sides) if len(ends) < 400 else "")
            lo = hi
        docs.append((len(x), len(y), len(ends), links, ";".join(parts) if len(ends) < 400 else None))
        count.update(set(links))
    return docs, count


def check_alignment(ids, texts, got):
    docs, count = plain_alignment(texts)
    best = Counter()
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    want = []
    for k, d in zip(ids, docs):
        if d is None:
            want.append((k, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links, text = d
        digest = hashlib.sha256(text.replace(";", "\0").replace("|", ";").replace("\0", "|").encode()).hexdigest() if text is not None else None
        want.append((k, n_a, n_b, groups, len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), digest))
    got = sorted((tuple(r) for r in got), key=repr)
    want.sort(key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:7] == w[:7]
        assert w[7] is None or g[7] == w[7]


ODD = [
    "a  b", "x\n y", " lead", "trail ", "a\n\n  b  c\t d", "<|endoftext|> <s> </s> x", "▁ mark", "日本 語 naïve", "", None, "\x1c a \x1d b", "don't 's x's  's",
    "é́ x", "a　b  c", "x" * 400 + " y" + "日" * 90, "a b\n", "same words here", "same words here", "� \x00   z", "\n", " ", "👩‍👩‍👧 🇩🇪 é",
]


def test_alignment_of_whole_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_alignment([r[0] for r in rows], [r[1] for r in rows], op13_token_alignment(spark, SF).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


@pytest.mark.parametrize("width,pairs", [(T.CHUNK, T.BROADCAST_PAIRS), (7, T.BROADCAST_PAIRS), (1, 0), (40, 0)])
def test_alignment_of_odd_rows(spark, width, pairs):
    """Short and long texts, by fragments of any width, by broadcast and by join."""
    ids = [None, None, *[BIG + i for i in range(len(ODD) - 2)]]
    docs = documents(spark, [(i, t, "", "") for i, t in zip(ids, ODD)])
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    check_alignment(ids, ODD, T.align(docs, *PATHS, width=width, broadcast_pairs=pairs).select(names).collect())
    assert T.align(documents(spark, []), *PATHS).count() == 0


def test_fragments_compose_in_any_order():
    al, rng = T.aligner(PATHS), random.Random(7)
    same = lambda f: (f.cut, f.text, f.groups, f.n_a, f.n_b, f.codes.tolist(), f.times.tolist(), *(x.tolist() for o in (f.prefix, f.suffix) for x in (o.a, o.b)))
    for text in ("zqxjkwv" * 30 + "日本語" * 20, "plain words, cut 12345678 often; unbelievable-ness", "é" * 50):
        a, _, b, _, _ = al.encode([text])
        for width in (1, 3, 10, 64):
            parts = T.ranges(al, a, b, 0, True, width)
            left = parts[0]
            for f in parts[1:]:
                left = T.compose(al, left, f)
            for _ in range(4):
                rest = list(parts)
                while len(rest) > 1:
                    i = rng.randrange(len(rest) - 1)
                    rest[i : i + 2] = [T.compose(al, rest[i], rest[i + 1])]
                assert same(rest[0]) == same(left)
