"""Encoding, phrases and whitening against plain versions, and on odd tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tablegauge.llm import bpe, phrases, whitening  # noqa: E402
from tablegauge.llm.queries import op11_whitening, vocabulary  # noqa: E402

DOCS = "doc_id long, lang string, text string"
VECTORS = "vec_id long, embedding array<double>"
CLASH = ("ids", "decoded", "shard", "words", "f", "n", "a", "k", "salt", "at", "rank", "x", "dim", "weight", "count", "__x", "__dim")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


# --- byte-pair encoding (13) ---

def merged_plainly(symbols, merges):
    symbols = list(symbols)
    while True:
        found = [(merges[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in merges]
        if not found:
            return symbols
        _, i = min(found)
        symbols[i:i + 2] = [merges[symbols[i], symbols[i + 1]][1]]


def test_segment_tree_merges_like_a_plain_search():
    rng = random.Random(3)
    for _ in range(300):
        merges, new = {}, 4
        for rank in range(rng.randrange(1, 25)):
            merges.setdefault((rng.randrange(new), rng.randrange(new)), (rank, new))
            new += 1
        symbols = [rng.randrange(4) for _ in range(rng.randrange(0, 40))]
        assert bpe.merged(symbols, merges) == merged_plainly(symbols, merges)


def test_trees_side_by_side_merge_like_one():
    rng = random.Random(12)
    for _ in range(60):
        merges, new = {}, 4
        for rank in range(rng.randrange(1, 25)):
            if merges.setdefault((rng.randrange(new), rng.randrange(new)), (rank, new)) == (rank, new):
                new += 1
        merges = {pair: (i, made) for i, (pair, (_, made)) in enumerate(merges.items())}
        pieces = [[rng.randrange(4) for _ in range(rng.randrange(1, 17))] for _ in range(50)]
        symbols = np.array([s for p in pieces for s in p], np.int32)
        assert bpe.Forest(merges, new).merged(symbols, np.array([len(p) for p in pieces])) == [merged_plainly(p, merges) for p in pieces]


def test_ranks_hold_the_leftmost_lowest():
    rng = random.Random(4)
    for n in (1, 2, 3, 7, 8, 33):
        own = [rng.randrange(5) for _ in range(n)]
        tree = bpe.Ranks(list(own))
        for _ in range(50):
            assert tree.lowest() == (own.index(min(own)) if min(own) < bpe.NEVER else -1)
            i = rng.randrange(n)
            own[i] = rng.choice([rng.randrange(5), bpe.NEVER])
            tree.set(i, own[i])
    assert bpe.Ranks([bpe.NEVER]).lowest() == -1


def test_ids_and_texts_equal_the_library():
    whole, own, rng = Tokenizer.from_file(vocabulary()), bpe.coder(vocabulary()), random.Random(5)
    parts = ["a", "B", "é", "é", "Σ", " ", "\n", "\x1c", "\x85", "\xa0", " ", "😀", "中", "ﬁ", "1", "²", "'s", "'LL", "<|endoftext|>",
             "<|startoftext|>", "<|ENDOFTEXT|>", "İ", "ß", "́", "!", "?", "\x00", "​", "﻿", " ", "the", "tion", "\U0001fae9", "\U00018cd5"]
    texts = ["", " \n", "x" * 30_000, "word " * 3000] + ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(2000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x500), rng.randrange(32, 0xd800), rng.randrange(0xe000, 0x1ffff)])) for _ in range(20)) for _ in range(300)]
    for text in texts:
        ids = whole.encode(text, add_special_tokens=False).ids
        assert own.encode([text])[0].tolist() == ids
        assert own.decode(np.array(ids, np.int32)) == whole.decode(ids, skip_special_tokens=False)


def test_long_texts_are_cut_where_no_piece_lies(monkeypatch):
    whole, own, rng = Tokenizer.from_file(vocabulary()), bpe.coder(vocabulary()), random.Random(6)
    monkeypatch.setattr(bpe, "SLICE", 7)
    monkeypatch.setattr(bpe, "KEPT", 10)
    for _ in range(300):
        text = "".join(rng.choice(["ab", "é", " ", "\n", " ", "<|endoftext|>", "'s", "!", "́"]) for _ in range(40))
        assert own.encode([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_encoding_tables(spark):
    text = "Don't <|endoftext|> stop"
    docs = clashing(spark.createDataFrame([(1, "en", text), (1, "en", text), (None, None, None), (2, "en", "")], DOCS))
    done = bpe.decode(bpe.encode(docs, vocabulary()), vocabulary())
    whole = Tokenizer.from_file(vocabulary())
    ids = whole.encode(text, add_special_tokens=False).ids
    said = whole.decode(ids, skip_special_tokens=False)
    assert sorted(map(tuple, done.collect()), key=str) == sorted([(1, ids, said), (1, ids, said), (None, [], ""), (2, [], "")], key=str)
    assert bpe.encode(docs.limit(0), vocabulary()).collect() == []
    odd = spark.createDataFrame([(1, None), (2, [320, None, -5, 10**7, 49407])], "doc_id long, ids array<long>")
    assert sorted((r.doc_id, r.decoded) for r in bpe.decode(odd, vocabulary()).collect()) == [(1, ""), (2, "a</w> <|endoftext|>")]


# --- phrases (12) ---

def phrases_plainly(rows, least, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = f.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                own.update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, own in f.items():
        known = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = {q[i:i + m] for q, b in known.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if 100 * b >= 80 * known[q[i:i + m]]}
        made = []
        for p, a in known.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (own[p[:j]] + own[p[j:]]), j) for j in range(1, len(p)))
                made.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(made)[:top], 1)]
    return sorted(out)


def of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("size", [phrases.SHARD, 200])
def test_phrases_equal_a_plain_count(spark, size):
    rng = random.Random(7)
    words = ["a", "B", "the", "of", "é", "É", "x.y", "z,", "q!", "w\tv", "\x0b", "n\nm", "\x85", " ", "中", "a" * 50, "\xa0"]
    docs = [(i, rng.choice(["en", "en", "fr", "", None]), None if i % 50 == 0 else " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(300)]
    docs += [(1, "und", "one two three four five " * 8), (1, "und", "one two three four five " * 8)]
    df = clashing(spark.createDataFrame(docs, DOCS)).repartition(3)
    for least, top in ((4, 2000), (9, 7)):
        got = of(phrases.collocations(df, least, top, size))
        assert got == phrases_plainly([(lang, text) for _, lang, text in docs], least, top) and len(got) > 20


def test_phrases_of_a_long_text_and_of_none(spark):
    rng = random.Random(8)
    long = " ".join(rng.choice(["a", "b", "c", "d.", "e"]) for _ in range(40_000))
    df = spark.createDataFrame([(1, "en", long), (2, "en", "")], DOCS)
    assert of(phrases.collocations(df, 30, 2000, 1000)) == phrases_plainly([("en", long)], 30, 2000)
    assert of(phrases.collocations(df.limit(0))) == []
    assert of(phrases.collocations(spark.createDataFrame([(1, "en", None), (2, None, " . ! ")], DOCS))) == []
    assert of(phrases.collocations(spark.createDataFrame([(1, "en", "too few words here")], DOCS))) == []


def test_interval_extension_counts_every_phrase():
    rng = np.random.default_rng(9)
    for symbols in (2, 5, 40):
        ids = np.concatenate(([0], rng.integers(0, symbols, 400), [0]))
        ids = np.unique(ids, return_inverse=True)[1]
        index, own, left = phrases.Index(ids), None, False
        seen = {1: index.single()}
        own = seen[1]
        for m in (2, 3, 4):
            own = seen[m] = index.extended(own, left)
            left = not left
        for m, own in seen.items():
            plain = Counter(t for i in range(len(ids) - m + 1) if 0 not in (t := tuple(ids[i:i + m].tolist())))
            got = {tuple(w): c for w, c in zip(own.words.tolist(), own.count.tolist())}
            assert got == dict(plain)


def test_wide_keys_sort_like_narrow_ones():
    rng = np.random.default_rng(10)
    a, b = rng.integers(0, 5, 200), rng.integers(0, 5, 200)
    for scale in (1, 1 << 40):
        order, new = phrases._grouped(a * scale, b * scale)
        assert order.tolist() == sorted(range(200), key=lambda i: (a[i], b[i], i))
        assert int(new.sum()) == len({*zip(a.tolist(), b.tolist())})


def test_answers_sum_over_shards(spark):
    rows = [(0, 1, np.array([5, 6], "<u4").tobytes(), bytes([29, 3])), (0, 2, np.array([6, 5, 7], "<u4").tobytes(), bytes([26, 1, 30]))]
    got = phrases.answered(spark.createDataFrame(rows, phrases.ASKED), 30).collect()
    assert {r.shard: np.unpackbits(np.frombuffer(r.bits, np.uint8)).tolist()[:3] for r in got} == {1: [1, 0, 0], 2: [0, 1, 1]}


# --- whitening (11) ---

def whitened_plainly(x, components=32):
    n, dim = x.shape
    mean = [sum(map(int, c)) / n for c in x.T]
    gap = x - np.array(mean)
    e, v = np.linalg.eigh(gap.T @ gap / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    return gap @ v / np.sqrt(e), e / (gap ** 2).sum() * n


def test_whitening_equals_a_plain_one(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5)) * 3
    vectors = base[np.concatenate((np.arange(60), np.zeros(300, int), rng.integers(0, 60, 40)))]
    df = clashing(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], VECTORS)).repartition(4)
    got = {r.vec_id: r for r in whitening.whiten(df).collect()}
    x = np.floor(64 * vectors).astype(int) + 1_000_000
    want, explained = whitened_plainly(x)
    made = np.array([got[i].whitened for i in range(len(x))])
    made *= np.sign((made * want).sum(axis=0))
    assert np.abs(made - want).max() < 1e-9
    assert np.abs(np.array(got[0].explained) - explained).max() < 1e-12
    n, sums = len(x), x.sum(axis=0)
    assert [got[i].deviation for i in range(n)] == [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    assert all(r.n == n and r.identity_error < 1e-9 for r in got.values())
    assert got[0].whitened == got[60].whitened  # equal vectors, equal values
    distinct = whitening.whiten(df, counted=False).collect()
    assert {r.n for r in distinct} == {len({*map(tuple, x.tolist())})} and len(distinct) == len(x)
    assert max(r.identity_error for r in distinct) < 1e-9


def test_whitening_of_odd_tables(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.5, 1e300]), (None, [3.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [1.0, None]), (7, []), (8, [5.0]), (9, [inf, 0.0])]
    got = whitening.whiten(clashing(spark.createDataFrame(rows, VECTORS))).collect()
    assert sorted((r.vec_id or -1, r.dim) for r in got) == [(-1, 2), (1, 2), (1, 2), (2, 2), (8, 1)]
    alone = next(r for r in got if r.vec_id == 8)
    assert (alone.n, alone.deviation, alone.whitened, alone.identity_error) == (1, 0, [], None)
    assert all(r.deviation is None for r in got if r.dim == 2)  # beyond 64 bits
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    # Nothing varies: rows without components, and none in the query.
    path = str(tmp_path)
    spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], VECTORS).write.parquet(f"{path}/embeddings.parquet")
    assert op11_whitening(spark, path).collect() == []


def test_sums_beyond_64_bits_are_exact(spark):
    x = np.array([[2**61, -2**61, 5], [2**61 + 3, 7, 5]], "<i8")
    df = spark.createDataFrame([(3, bytearray(r.tobytes()), w) for r, w in zip(x, (7, 9))], "dim int, x binary, weight long")
    assert whitening.exact_sums(df) == {3: (16, [sum(int(r[j]) * w for r, w in zip(x, (7, 9))) for j in range(3)])}
