"""Each stage against its operator's definition on its own input, and the whole run."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_neardup import brute as brute_near


def write(spark, path):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice(["the", "an", "ri", "sto", "ne", "ga", "den", "for", "un"]) for _ in range(rnd.randint(1, 3)))
    shared = ["a line that many of the documents share, word for word", "another line of the same kind that comes back often"]

    def text(bad):
        lines = [" ".join(word() + (rnd.choice(["***", "&&&"]) if bad else "") for _ in range(rnd.randint(8, 16))) + "." for _ in range(rnd.randint(4, 9))]
        if rnd.random() < 0.5:
            lines.insert(1, rnd.choice(shared))
        return "\n".join(lines)

    rows = [(i, text(i % 6 == 0), "en", f"s{i % 3}", 0) for i in range(240)]
    rows += [(300 + i, rows[i + 1][1].replace(" the", " tho", 1), "en", "s", 0) for i in range(0, 12, 6)] + [(400, rows[7][1], "en", "s", 0)]
    rows += [(500, None, None, None, None), (501, "", "en", "s", 0), (502, "a b c d e f g h " * 30, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages(spark, tmp_path):
    path = f"file://{tmp_path}"
    write(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(f"{path}/{k}")
        before, docs = {r.doc_id: r for r in docs.collect()}, spark.read.parquet(f"{path}/{k}")
        seen.append((before, {r.doc_id: r for r in docs.collect()}))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "line dedup", "MinHash near-dedup", "packing"]
    before, after = seen[0]
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(i in after) == (i % 6 != 0) for i in held]) > 0.97 and all(after[i] == before[i] for i in after)
    before, after = seen[1]
    assert not {500, 501, 502} & set(after) and all(after[i] == before[i] for i in after)
    assert len([i for i in after if i < 240 and i % 6]) >= 0.98 * len([i for i in before if i < 240 and i % 6])
    before, after = seen[2]
    dropped = {i: n for i, _, n, _ in brute_lines([(i, r.text) for i, r in before.items()])}
    assert set(after) == set(before) and any(dropped.values())
    assert all(before[i].text.count("\n") - after[i].text.count("\n") == dropped[i] and (after[i].n_chars == len(after[i].text) or not dropped[i]) for i in after)
    before, after = seen[3]
    classes = brute_near([(i, r.text) for i, r in before.items()], 80)
    assert set(after) == {i for i, (_, c) in classes.items() if i == c} < set(before)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in after.items()}
    pieces = docs.collect()
    assert {i: sum(p.length for p in pieces if p.doc_id == i) for i in want} == want
    whole = corpus_pipeline.run(spark, path).collect()
    assert sum(p.length for p in whole) == sum(want.values())


def test_extra_columns_and_empty_tables(spark, tmp_path):
    path = f"file://{tmp_path}"
    write(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 as drops", "2 as c0", "'x' as kept", "array(1) as t")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0


def test_emptied_documents_and_repeated_rows(spark):
    text = "\n".join(f"this is line number {k} of a text with enough words in it" for k in range(6))
    own = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (2, text), (3, text), (4, own), (4, own), (4, "another text under the same id " + own[::-1]), (None, own), (None, own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.lines(spark, docs, "").collect()) == [0, 0, 3, 4, 4, 4]
    near = corpus_pipeline.near(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text[:4]) for r in near) == [(0, "w0 w"), (0, "w0 w"), (1, "this"), (4, "anot"), (4, "w0 w")]
