import random

import numpy as np
import pytest

from cartolith.llm import neardup
from cartolith.operators.components import connected_components


def brute(rows, percent, n=5):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = ({tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}) if w else set()
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, base_words=120, variants=90):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 6)))
    base = [word() for _ in range(base_words)]
    rows = []
    for i in range(variants):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(word() for _ in range(rnd.randint(0, 30)))) for i in range(60)]
    rows += [(2000 + i, rows[i % 7][1].upper() if i % 2 else rows[i % 7][1].replace(" ", "\n", 3)) for i in range(20)]
    return rows + [(3000, None), (3001, ""), (3002, " \t"), (3003, "one two"), (3004, "ONE  two"), (3005, "one two three four five"), (3006, "Ünï two")]


@pytest.mark.parametrize(("seed", "percent", "chunk"), [(1, 85, 256), (2, 80, 256), (3, 85, 8), (4, 80, 8)])
def test_like_brute_force(spark, monkeypatch, seed, percent, chunk):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as component_id", "2 as rep")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, percent).collect()}
    assert got == brute(rows, percent)


@pytest.mark.parametrize(("seed", "wide"), [(3, 16), (4, 24)])
def test_wide_chunks_and_large_groups_like_brute_force(spark, monkeypatch, seed, wide):
    """Chunks of sketches wider than those of sets, and groups of sketches of more than two chunks."""
    monkeypatch.setattr(neardup, "CHUNK", 8)
    monkeypatch.setattr(neardup, "WIDE", wide)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 85).collect()} == brute(rows, 85)


def test_cells_of_an_unlinked_bucket_repeat_a_member_few_times(spark):
    """A bucket of which no two members are connected: each is in one cell for every WIDE members, not for every CHUNK."""
    n = neardup.WIDE
    rest = spark.range(n).selectExpr("7L as bucket", "id as rep", "id as part")
    assert neardup._cross_cells(rest, neardup.WIDE).count() == n
    assert neardup._cross_cells(rest, neardup.CHUNK).count() > n * n // neardup.CHUNK // 2


def test_null_ids_and_repeated_rows(spark):
    t = "a b c d e f g h"
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (7, t)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == [(0, None, True), (5, 5, True), (5, 5, True), (7, 5, False)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_odd_sketch_estimates_high_similarities():
    rng = np.random.RandomState(0)
    errors = []
    for _ in range(60):
        x = rng.randint(0, 2**62, 1000).astype(np.uint64)
        s = neardup.odd_sketch(neardup.minhash([x, np.concatenate([x[:950], rng.randint(0, 2**62, 50).astype(np.uint64)])]))
        errors.append(neardup.estimated(neardup._ONES[s[0] ^ s[1]].sum()) - 950 / 1050)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (1, 0, 3, 2)])
def test_an_id_with_two_texts_links_both(spark, order):
    rnd = random.Random(5)
    a, b = ([f"{c}{rnd.randrange(10**6)}" for _ in range(200)] for c in "ab")
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join(a[:-1] + ["z"])), (9, " ".join(["y"] + b[1:]))]
    df = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()) == [(5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False)]


@pytest.mark.parametrize(("percent", "least"), [(85, 0.9995), (80, 0.998)])
def test_pairs_at_the_limit_meet(percent, least):
    """Recall of bands and sketches of pairs at exactly the least similarity."""
    rng = np.random.RandomState(3)
    sets, n = [], 2000
    for _ in range(n):
        x = rng.randint(0, 2**63, 2 * (100 - percent) + percent + percent).astype(np.uint64)
        both, one, other = x[: 2 * percent], x[2 * percent : 2 * percent + 100 - percent], x[100 + percent :]
        sets += [np.concatenate([both, one]), np.concatenate([both, other])]
    samples = neardup.minhash(sets)
    keys, sketches = neardup.band_keys(samples), neardup.odd_sketch(samples)
    met = (keys[::2] == keys[1::2]).any(1) & (neardup._ONES[sketches[::2] ^ sketches[1::2]].sum(1) <= neardup._most_bits(percent))
    assert met.mean() >= least


def test_a_long_text(spark):
    t = " ".join(str(i * 7919 % 100_003) for i in range(200_000))
    df = spark.createDataFrame([(1, t), (2, t + " more"), (3, "a")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect())[:2] == [(1, brute([(1, t)], 80)[1][0], 1), (2, brute([(1, t)], 80)[1][0] + 1, 1)]
