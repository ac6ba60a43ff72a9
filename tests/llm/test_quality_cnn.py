import zlib

import numpy as np

from cartolith.llm import quality_cnn as q


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        t = np.random.RandomState(n).randint(1, 256, n).astype(np.uint8).tobytes()
        chunks, k = q.chunks_of([t])
        back = np.zeros(int((k[0] - 1) * q.STEP + q.CHUNK), np.uint8)
        for i, c in enumerate(chunks):
            back[i * q.STEP : i * q.STEP + q.CHUNK] = c
        assert back[:n].tobytes() == t and not back[n:].any()


def test_gradients_are_those_of_the_loss():
    net, texts, y = q.Network(3), [b"hello there " * 60, b"zz", b""], np.array([1, 0, 1], np.float32)
    net.p["bias"] += 0.3

    def loss():
        s = net.score(texts, net.tables())
        return -np.mean(np.where(y == 1, np.log(s), np.log(1 - s)))

    g = net.gradients(texts, y)
    for name in ("filters", "bias", "mid", "lift", "out", "shift", "embed"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 2e-3
        up = loss()
        net.p[name][at] = old - 2e-3
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 4e-3 - g[name][at]) < 0.05 * abs(g[name][at]) + 2e-3, name


def test_held_out_rows_and_edges(spark):
    rng = np.random.RandomState(0)
    word = lambda: "".join(rng.choice(list("abcdef"), rng.randint(2, 7)))
    rows = [(i, " ".join(word() + ("***" if i % 3 == 0 else "") for _ in range(rng.randint(3, 150)))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i, _ in rows] + [(1, None, None), (None, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    extra = [(900, None), (901, ""), (None, "abc"), (5, rows[5][1])]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string").selectExpr("*", "1 as score", "2 as quality")
    got = q.quality_classifier(df, labels, epochs=4).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(by[i].held_out for i in held) and sum(r.held_out for r in got if r.doc_id is not None and r.doc_id < 300) >= len(held)
    assert np.mean([by[i].predicted == (i % 3 != 0) for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    none = q.quality_classifier(df, labels.limit(0))
    assert {r.score for r in none.collect()} == {0.5}
    assert q.quality_classifier(df.limit(0), labels).count() == 0


def test_sample_is_bounded_in_bytes(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "x" * (50 * i + 1)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    texts, y = q.labelled_sample(docs, labels, "quality", F.lit(True), 30, 5000)
    assert sum(map(len, texts)) <= 5000 and 3 <= len(texts) == len(y) < 30
    assert len(q.labelled_sample(docs, labels, "quality", F.lit(True), 30, 1 << 20)[0]) == 30
