import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cartolith.llm import lm
from cartolith.llm.common import word_hashes


def corpus(n=400, seed=2):
    rnd = random.Random(seed)
    vocab = [f"{a}{b}" for a in "bcdfg" for b in ("a", "en", "i", "ou", "é")]
    follow = {w: rnd.sample(vocab, 4) for w in vocab}
    rows = []
    for i in range(n):
        w, out = rnd.choice(vocab), []
        for _ in range(rnd.randint(0, 40)):
            out.append(w)
            w = rnd.choice(follow.get(w, vocab)) if rnd.random() < 0.8 else rnd.choice(vocab) + ("x" * rnd.randint(1, 6) if rnd.random() < 0.1 else "")
        rows.append((i, " ".join(out)))
    return rows + [(1000, None), (1001, ""), (1002, "Ba EN\tba\n" * 300), (None, "ba"), (3, rows[3][1]), (1003, "zzz " * 2000)]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def tokens(t):
    return (t or "").encode().lower().split()


def brute(rows, least):
    """The automaton's scores from plain dictionaries, one token after another."""
    train = [tokens(t) for i, t in rows if not held(i)]
    uni, bi, tri = Counter(), Counter(), Counter()
    for t in train:
        s = [*t, None]
        uni.update(s)
        bi.update(zip(s, s[1:], strict=False))
        tri.update(zip(s, s[1:], s[2:], strict=False))
    n, v = sum(uni.values()), len(uni)
    d = lm.D
    words = set(uni) | {None}
    bi = {k: c for k, c in bi.items() if c >= least}
    tri = {k: c for k, c in tri.items() if c >= least}
    grams = Counter()
    for t in train:
        for w in t:
            x = b"  " + w + b" "
            grams.update(x[i : i + 3] for i in range(len(x) - 2))
    pair, head, first = Counter(), Counter(), Counter()
    for g, c in grams.items():
        pair[g[1:]] += c
        head[g[:2]] += c
        first[g[1]] += c

    def p1(w):
        if w is None:
            return (max(uni[None] - d, 0) + 1) / (n + 2)
        if uni[w]:
            return (uni[w] - d) / (n + 2)
        x, p = b"  " + w + b" ", (d * v + 1) / (n + 2)
        for i in range(len(x) - 2):
            low = (pair[x[i + 1 : i + 3]] + 0.5) / (first[x[i + 1]] + 128)
            p *= (grams[x[i : i + 3]] + 4 * low) / (head[x[i : i + 2]] + 4)
        return p

    gamma = lambda h, table, c: max(1e-9, (c - sum(x - d for k, x in table.items() if k[:-1] == h)) / max(1, c))
    g1 = {w: gamma((w,), bi, uni[w]) for w in words}
    g2 = {h: gamma(h, tri, bi[h]) for h in bi}

    def p2(u, w):
        if u not in words or u is None:
            return p1(w)
        return (bi[u, w] - d) / uni[u] + g1[u] * p1(w) if (u, w) in bi else g1[u] * p1(w)

    def p3(h, w):
        if h not in bi or h[1] is None:
            return p2(h[1], w)
        return (tri[(*h, w)] - d) / bi[h] + g2[h] * p2(h[1], w) if (*h, w) in tri else g2[h] * p2(h[1], w)

    out = []
    for i, t in rows:
        s = [*tokens(t), None]
        base = sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s)
        total = sum(math.log10(p3((s[k - 2] if k > 1 else None, s[k - 1]) if k else (None, None), w) if k else p1(w)) for k, w in enumerate(s))
        out.append((i, held(i), len(s), sum(uni[w] > 0 for w in s), n, base, total))
    return out, p3, words, uni


@pytest.mark.parametrize(("least", "block", "shard"), [(2, 8 << 20, 1 << 18), (2, 2000, 300), (5, 5000, 1000), (1, 5000, 1 << 18)])
def test_like_brute_force(spark, monkeypatch, least, block, shard):
    monkeypatch.setattr(lm, "BLOCK", block)
    monkeypatch.setattr(lm, "SHARD", shard)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as block", "3 as n").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted((tuple(r) for r in lm.score(df, least).collect()), key=key)
    want, p3, words, uni = brute(rows, least)
    want.sort(key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert np.allclose(g[5:], w[5:], rtol=1e-9, atol=1e-9), (g, w)
    # after any history, known words, the end and the share of unseen words make one
    for h in [(None, None), (b"ba", b"ben"), (b"ci", b"fou")]:
        known = sum(p3(h, w) for w in uni)
        unseen = p3(h, b"\xff") / brute_unseen_spelling(rows)
        assert abs(known + unseen - 1) < 1e-6


def brute_unseen_spelling(rows):
    train = [w for i, t in rows if not held(i) for w in tokens(t)]
    g, n = np.unique(lm.spelling_grams(train).astype(np.int64), return_counts=True)
    return 10 ** lm.Spelling(g, n).log10([b"\xff"])[0]


def test_empty_tables(spark):
    df = spark.createDataFrame([(10, None)], "doc_id long, text string")
    assert lm.score(df.limit(0)).count() == 0
    some = spark.createDataFrame([(i, "a b") for i in range(100) if held(i)], "doc_id long, text string")
    got = lm.score(some).collect()
    assert got and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and np.isfinite(r.score) for r in got)


def test_better_than_the_base_on_held_out_texts(spark):
    got = lm.score(spark.createDataFrame(corpus(), "doc_id long, text string")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_spelling_grams_and_hash():
    assert len(lm.spelling_grams([b"ab", b"c"])) == 5 and len(word_hashes([b"a b"])[0]) == 2


def test_ngrams_seen_twice_count_at_any_size(spark):
    """3,000,000 training tokens: a cut of 2^-18 of them is 12 occurrences."""
    train = [i for i in range(2000) if not held(i)]
    rows = [(i, "und so " * 1000) for i in train[:1500]] + [(i, "rara avis volat") for i in train[1500:1502]]
    new = next(i for i in range(5000, 6000) if held(i))
    got = lm.score(spark.createDataFrame([*rows, (new, "rara avis volat")], "doc_id long, text string")).where("held_out").collect()
    n, d, uni = 3_000_000 + 6 + 1502, lm.D, (2 - lm.D)
    p1 = uni / (n + 2)
    p2 = uni / 2 + d / 2 * p1
    p3 = uni / 2 + d / 2 * p2
    end = uni / 2 + d / 2 * (uni / 2 + d / 2 * (1502 - d + 1) / (n + 2))
    assert [r.train_tokens for r in got] == [n]
    assert abs(got[0].score - sum(math.log10(p) for p in (p1, p2, p3, end))) < 1e-9


def test_packed_arrays():
    rng = np.random.RandomState(1)
    for arrays in ([np.zeros(0, np.uint64)] * 2, [np.sort(rng.randint(0, 2**63, 500).astype(np.uint64)), rng.randint(0, 300, 500).astype(np.uint64)], [np.array([2**64 - 1], np.uint64), np.zeros(1, np.uint64)]):
        assert all((a == b).all() for a, b in zip(lm.unpacked(lm.packed(*arrays), 2), arrays, strict=True))


def test_a_long_text_is_one_block(spark):
    text = " ".join(str(i % 70_001) for i in range(2_000_000))
    ids = [i for i in range(50) if not held(i)][:2]
    got = lm.score(spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string").coalesce(1)).collect()
    assert [r.n_known for r in got] == [2_000_001] * 2 and got[0].score == got[1].score > got[0].base_score


def test_messages_stay_long_at_6_gb():
    gb = 1 << 30
    blocks = 6 * gb // lm.BLOCK
    assert lm.BLOCK // 6 // lm.shards_for(6 * gb) > 600 and blocks * lm.shards_for(6 * gb) < 2_000_000
    assert [lm.shards_for(n) for n in (0, 1, 6 * lm.SHARD, 12 * lm.SHARD)] == [1, 1, 1, 2] and lm.shards_for(gb // 2) == lm.SHARDS
    counts = [lm.shards_for(n) for n in range(0, 8 * gb, gb // 16)]
    assert counts == sorted(counts) and all(n <= 6 * lm.GROWN * lm.SHARD * c for n, c in zip(range(0, 8 * gb, gb // 16), counts, strict=True))
