import numpy as np
import pytest

from cartolith.llm import topk


def brute(vectors, k=20, every=20):
    ok = {i: np.floor(64 * np.array(v, float)).astype(object) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    d = max((len(v) for v in ok.values()), default=0)
    pad = {i: np.concatenate([v, np.zeros(d - len(v), object)]) for i, v in ok.items()}
    out = []
    for q in sorted(pad):
        if q % every == 0:
            s = sorted((-int((pad[q] * v).sum()), i) for i, v in pad.items() if i != q)[:k]
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return out


@pytest.mark.parametrize(("seed", "listed", "held"), [(0, 1, 1 << 22), (1, 1, 100), (2, 40, 1 << 22), (3, 500, 1000)])
def test_like_brute_force(spark, monkeypatch, seed, listed, held):
    monkeypatch.setattr(topk, "LISTED", listed)
    monkeypatch.setattr(topk, "QUERIES", 8)
    monkeypatch.setattr(topk, "SHARD_ROWS", 64)
    monkeypatch.setattr(topk, "HELD", held)
    rng = np.random.RandomState(seed)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(400)]
    rows = [(i, rows[i % 5][1] if i % 3 == 0 else v) for i, v in rows]  # a third are a few vectors
    rows += [(1000, None), (1020, [1.0, None]), (1040, [float("nan")] * 8), (1060, [float("inf")] * 8), (1080, []), (1100, [0.5, 0.5]), (None, rows[0][1]), (-20, [2000.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as v")
    got = sorted(tuple(r) for r in topk.exact_top_k(df).collect())
    assert got == brute(rows)


def test_few_and_no_rows(spark):
    rows = [(0, [0.5, -0.25]), (20, [0.5, -0.25]), (3, [-1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.exact_top_k(df).collect()) == brute(rows)
    assert topk.exact_top_k(df.limit(0)).count() == 0
    assert topk.exact_top_k(df.where("vec_id = 3")).count() == 0
    assert sorted(tuple(r) for r in topk.exact_top_k(df.union(df)).collect()) == brute(rows)


def test_phases_on_their_own():
    """The lists give a safe cutoff, and where they end above T / m the second look gives what they miss."""
    rng = np.random.RandomState(4)
    q, c = rng.randint(-99, 99, (6, 10)), rng.randint(-99, 99, (400, 10))
    nodes = [slice(0, 5), slice(5, 10)]
    total = q @ c.T
    at, listed, floor = topk._listed([topk._products(q[:, s], c[:, s]) for s in nodes], 3)
    for i in range(6):
        assert (total[i, at[i]] == listed[i]).all()
        cut = listed[i].min()
        want = set(np.flatnonzero(total[i] >= cut).tolist())
        if 2 * floor[i] < cut:
            assert want <= set(np.concatenate([at[i], np.flatnonzero(total[i] == cut)]).tolist())
        _, j, t = topk._collected([q[i : i + 1, s] for s in nodes], [c[:, s] for s in nodes], np.array([cut]))
        assert set(j.tolist()) == want and (t == total[i, j]).all()


@pytest.mark.parametrize("rows_of_a_shard", [1 << 15, 64])
def test_ties_go_to_the_smaller_id(spark, monkeypatch, rows_of_a_shard):
    """Vectors of few values: distinct candidates with equal scores stand on both sides of the last rank."""
    monkeypatch.setattr(topk, "SHARD_ROWS", rows_of_a_shard)
    rng = np.random.RandomState(5)
    rows = [(i, [float(x) for x in rng.randint(-1, 2, 12) / 64]) for i in rng.permutation(600).tolist()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.exact_top_k(df).collect()) == brute(rows)


def test_listed_takes_the_smaller_place_of_equal_totals():
    local = [np.ones((2, 50), np.int64), np.ones((2, 50), np.int64)]
    at, total, _ = topk._listed(local, 21)
    assert (np.sort(at, axis=1) == np.arange(21)).all() and (total == 2).all()
