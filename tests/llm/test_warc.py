import base64
import gzip
import hashlib
import io
import random

import pyarrow as pa
import pytest

from cartolith.llm import warc
from cartolith.llm.common import fresh


def archive(seed, n=40):
    rnd = random.Random(seed)
    payloads = [bytes(rnd.randrange(256) for _ in range(rnd.randint(0, 3000))) for _ in range(n)]
    payloads[3] = warc.MAGIC * 400 + bytes(rnd.randrange(256) for _ in range(500))  # what looks like members
    payloads[4] = gzip.compress(b"WARC/1.0 not a record of this archive") * 3
    members = [warc.record(i, "http://x/é", p, warc.sha1_base32(p), None) for i, p in enumerate(payloads)]
    starts = [sum(map(len, members[:i])) for i in range(n)]
    return payloads, b"".join(members), starts


@pytest.mark.parametrize("step", [1, 7, 97, 1000, 10**9])
def test_any_cut_gives_every_record_once(step):
    payloads, data, starts = archive(1, 12 if step == 1 else 40)
    got = []
    for s in range(0, len(data), step):
        got += warc.records_in(pa.BufferReader(data), s, min(len(data), s + step), len(data))
    assert [o for o, _ in got] == starts
    assert [warc.parsed(r)["payload"] for _, r in got] == payloads


def test_small_reads(monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 64)
    payloads, data, starts = archive(2)
    assert [o for o, _ in warc.records_in(pa.BufferReader(data), 0, len(data), len(data))] == starts


def test_archives_are_ordinary_gzip():
    _, data, _ = archive(3)
    assert gzip.open(io.BytesIO(data)).read().count(b"WARC/1.1\r\n") == 40


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    rows = [(i, ["a" * 3000, "é" * 7, "abc", "", None, f"own {i} " * 50][i % 6]) for i in range(60)] + [(100, "x" * 200_000), (None, "abc"), (None, "lost")]
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'http://h/' as url", "1 as payload", "2 as __x")
    got = warc.round_trip(df.repartition(3), least, 700).collect()
    last = {}
    for i, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", -1))
    want = []
    for i, h in rows:
        b = (h or "").encode()
        r = last[h or ""] if i is not None and len(b) >= least and last[h or ""] != i else None
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if r is not None else "response", r))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_payloads_and_files(spark):
    df = spark.createDataFrame([(1, "http://a", "same"), (2, "http://b", "same"), (3, None, "other é")], "page_id long, url string, html string")
    archives = warc.write_archives(df.coalesce(1), fresh(spark, "t"))
    assert [r.records for r in archives.collect()] == [3]
    got = {r.page_id: (r.url, r.payload and bytes(r.payload)) for r in warc.read_archives(spark, archives).collect()}
    assert got == {1: ("http://a", None), 2: ("http://b", b"same"), 3: ("", "other é".encode())}


def test_damaged_archives_raise(spark):
    _, data, starts = archive(5)
    read = lambda x, s=0, e=None: list(warc.records_in(pa.BufferReader(x), s, len(x) if e is None else e, len(x)))
    with pytest.raises(ValueError):
        read(data[:-20])  # cut off
    with pytest.raises(ValueError):
        read(data[: starts[7]] + b"x" * 30 + data[starts[8] :])
    with pytest.raises(ValueError):
        read(data[: starts[9]] + data[starts[9] + 5 :], starts[3] + 1)  # a range in the middle
    assert read(b"") == []
    df = spark.range(20).selectExpr("id as page_id", "'u' as url", "repeat('x', 50) as html")
    archives = warc.write_archives(df.coalesce(1), fresh(spark, "t"))
    with pytest.raises(ValueError):
        warc.all_read(warc.read_archives(spark, archives).where("page_id > 0"), archives)


def test_a_task_a_range(spark):
    from pyspark.sql import functions as F

    df = spark.range(4000).selectExpr("id as page_id", "'u' as url", "repeat(sha2(cast(id as string), 512), 4) as html")
    archives = warc.write_archives(df.repartition(3), fresh(spark, "t"))
    n = sum(-(-r.bytes // 20_000) for r in archives.collect())
    read = warc.read_archives(spark, archives, 20_000)
    per_task = read.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert n > 20 and len(per_task) >= 0.9 * n and sum(r["count"] for r in per_task) == 4000
