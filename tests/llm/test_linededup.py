import hashlib
import random
from collections import defaultdict

import numpy as np

from cartolith.llm import linededup as ld

WS = " \t\n\r\x0b\x0c"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute(rows, min_docs=3):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(h := holders.get(key(x), ())) < min_docs or max(h) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(3)
    pool = [f"A shared Line number {k} of this corpus é" for k in range(25)] + ["short", "", "  ", "ééééééééééééééééééé", "éééééééééééééééééééé"]
    rows = [(i, "\n".join(rnd.choice((lambda x: x, str.upper, lambda x: f"\t{x} "))(rnd.choice(pool)) if rnd.random() < 0.6 else f"own line {i} {k} with enough letters" for k in range(rnd.randint(0, 9)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, pool[0]), (103, pool[0] + "\n" + pool[0]), (None, pool[0]), (103, pool[0] + "\n" + pool[0]), (104, "x" * 50_000 + "\n" + pool[1])]


def test_digest_like_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k1", "2 as drops", "3 as last")
    assert sorted((tuple(r) for r in ld.line_digest(df).collect()), key=str) == brute(rows)
    assert ld.line_digest(df.limit(0)).count() == 0


def test_inserts_and_deletes_are_reversible(spark):
    rows = corpus()
    a, b = rows[:40], rows[40:]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    index = ld.LineIndex(spark).insert(frame(a))
    drops = lambda: {(r.doc_id, d.k1) for r in index.dropped().collect() for d in r.drops}
    counts = lambda: {tuple(r) for r in index.counts.collect()}
    d0, c0 = drops(), counts()
    index.insert(frame(b))
    fresh = ld.LineIndex(spark).insert(frame(rows))
    assert counts() == {tuple(r) for r in fresh.counts.collect()}
    assert drops() == {(r.doc_id, d.k1) for r in fresh.dropped().collect() for d in r.drops} != d0
    index.delete(frame(b).select("doc_id"))
    assert (drops(), counts()) == (d0, c0)
    often = {r.k1 for r in index.counts.where("n >= 3").collect()}
    filters = {r.shard: ld.CuckooFilter.load(bytes(r.data)) for r in index.filters.collect()}
    assert all(filters[k % index.shards].contains(np.array([k]))[0] for k in often)


def test_filter_has_what_was_inserted_and_not_deleted():
    rng = np.random.RandomState(0)
    x = rng.randint(-(2**62), 2**62, 20_000)
    f = ld.CuckooFilter.build(x)
    assert f.contains(x).all() and f.contains(rng.randint(-(2**62), 2**62, 50_000)).mean() < 0.001
    f.delete(x[:10_000])
    assert f.contains(x[10_000:]).all() and f.contains(x[:10_000]).mean() < 0.001
    assert f.insert(x[:10_000]) and ld.CuckooFilter.load(f.dump()).contains(x).all()


def test_text_is_replaced_and_columns_stay(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "length(text) as n_chars", "7 as drops")
    out = ld.deduplicated(df)
    assert out.columns == df.columns
    want = {(i, h) for i, _, _, h in brute(rows)}
    got = out.collect()
    assert {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got} == want and len(got) == len(rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_many_changes_fold_and_split_shards(spark, monkeypatch):
    monkeypatch.setattr(ld, "SHARD_KEYS", 4)
    monkeypatch.setattr(ld, "FOLD", 3)
    lines = [f"line number {k} that several documents share" for k in range(300)]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    rows = [(i, "\n".join(lines[(i // 3) * 20 : (i // 3) * 20 + 20])) for i in range(45)]
    index = ld.LineIndex(spark).insert(frame(rows[:2]))
    assert index.shards == 16 and index.dropped().count() == 0
    for a, z in ((2, 9), (9, 30), (30, 45)):
        index.insert(frame(rows[a:z]))
    whole = ld.LineIndex(spark).insert(frame(rows))
    state = lambda x: ({tuple(r) for r in x.counts.collect()}, {(r.doc_id, d.k1) for r in x.dropped().collect() for d in r.drops}, x.often)
    assert index.shards > 16 and state(index) == state(whole) and index.often == 300
    index.delete(frame(rows[3:]).select("doc_id"))
    index.insert(frame(rows[3:5]))
    assert state(index) == state(ld.LineIndex(spark).insert(frame(rows[:5])))
    assert max(len(v) for v in index.versions.values()) <= 3 and index.postings.count() == 100


def test_equal_keys_fit_a_filter():
    assert ld.CuckooFilter.build(np.full(50, 7)).contains(np.array([7]))[0]
