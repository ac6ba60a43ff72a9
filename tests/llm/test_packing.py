import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cartolith.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_level(count, size, window, slack=1):
    """By the definition: the sum of squares after the placement, tried for each level."""
    best = None
    for h in range(window - size, -1, -1):
        if h and not count[h]:
            continue
        c = count.copy()
        if h:
            c[h] -= 1
        if h + size <= window - slack:
            c[h + size] += 1
        v = int((c[1:window] ** 2).sum())
        if best is None or v < best[0]:
            best = (v, h)
    return best[1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=15, max_size=15), st.integers(1, 15), st.integers(1, 6))
def test_level_is_the_least_sum_of_squares(counts, size, slack):
    p = packing.Packer(16, 10, 0, slack)
    p.count[1 : 17 - slack] = counts[: 16 - slack]
    assert p.level_for(size) == brute_level(p.count.copy(), size, 16, slack)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.integers(1, 8), st.integers(0, 9))
def test_every_id_once_and_no_padding(sizes, max_open, slack):
    p = packing.Packer(16, max_open, 0, slack)
    ids = [np.arange(n, dtype="<u4").tobytes() for n in sizes]
    for i, x in enumerate(ids):
        p.add(i, x)
    p.settle()
    back, seqs = defaultdict(list), defaultdict(list)
    for doc, start, b, n, seq, off, _ in p.drain():
        assert n == sizes[doc]
        back[doc].append((start, b))
        seqs[seq].append((off, len(b) // 4))
    assert {d: b"".join(b for _, b in sorted(v)) for d, v in back.items()} == dict(enumerate(ids))
    for v in seqs.values():
        at = 0
        for off, n in sorted(v):
            assert off == at
            at += n
        assert at <= 16 and at & (at - 1) == 0


def test_rows(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (None, "x"), (4, "word " * 5000), (4, "word " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as offset")
    t = Tokenizer.from_file(PATH)
    got = packing.pack(df, PATH, with_ids=True).collect()
    for doc, text in rows:
        want = t.encode(text or "", add_special_tokens=False).ids + [1]
        mine = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start)
        assert all(r.doc_tokens == len(want) for r in mine)
        assert sum(r.length for r in mine) == len(want) * sum(d == doc for d, _ in rows)
        if doc != 4:
            assert [i for r in mine for i in r.ids] == want
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_few_sequences_are_settled(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "repeat('word ', cast(pmod(xxhash64(id), 2500) as int)) as text").repartition(4, "doc_id")
    got = packing.pack(df, PATH).collect()
    assert sorted(got) == sorted(packing.pack(df, PATH).collect())
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
    seqs, settled = defaultdict(int), set()
    for r in got:
        seqs[r.sequence_id] += r.length
        if r.settled:
            settled.add(r.sequence_id)
    assert all(n & (n - 1) == 0 and n <= 2048 for n in seqs.values())
    assert all(n == 2048 for s, n in seqs.items() if s not in settled)
    assert len(settled) < 0.2 * len(seqs)
