import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cartolith.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té#|\x1c ", max_size=120), max_size=4))
def test_base_counts(texts):
    got = q.base_counts([t.encode() for t in texts]).tolist()
    assert got == [brute(t) for t in texts]


def test_ratio_by_definition():
    texts = [b"abcdefgh", b"abc", b"", b"xyzabcd"]
    w = np.random.RandomState(0).normal(size=q.BUCKETS)
    for t, r in zip(texts, q.ratios(texts, w), strict=True):
        b = []
        for i in range(len(t) - 3):
            g = int.from_bytes(t[i : i + 4], "little") * 0x9E3779B1 % 2**32
            b.append((g ^ g >> 15) >> 16)
        assert math.isclose(r, np.mean([w[x] for x in b]) if b else 0, abs_tol=1e-12)


def test_rows(spark):
    good = "The quick brown fox jumps over the lazy dog near the river bank. " * 1
    clean = [" ".join(f"{w}{i}" if k % 5 == 0 else w for k, w in enumerate((good * 4).split())) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(clean)] + [(100, None), (101, ""), (102, "a b " * 40), (103, " ".join(f"w{i}$$$ z{i}&&&" for i in range(60))), (None, clean[0]), (5, clean[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kept", "2 as raw")
    got = q.quality_rules(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        r = by[i]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == brute(t)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert not by[100].kept and not by[102].kept and not by[103].kept and not by[103].base_failed
    assert all(by[i].kept for i in range(40))
    assert q.quality_rules(df.limit(0)).count() == 0


def brute_trusted(text):
    words, chars, symbols, dup, repeat = brute(text)
    stops, shouted = len(re.findall(r"[.!?]", text)), len(re.findall(r"[A-Z]", text))
    if words < 40 or not 3 * words <= chars <= 15 * words or 200 * symbols > chars or dup or repeat:
        return False
    return 60 * stops >= words and 2 * stops <= words and 5 * shouted <= chars


def brute_verdicts(texts):
    """The whole method from plain dictionaries."""
    def grams(t):
        b = t.encode()
        for i in range(len(b) - q.N + 1):
            g = int.from_bytes(b[i : i + q.N], "little") * 0x9E3779B1 % 2**32
            yield (g ^ g >> 15) >> 16

    raw, target = Counter(), Counter()
    for t in texts:
        raw.update(grams(t))
        if brute_trusted(t):
            target.update(grams(t))
    n, m = sum(raw.values()), sum(target.values())
    weight = lambda g: (math.log((target[g] + q.ALPHA) / (m + q.ALPHA * q.BUCKETS)) - math.log((raw[g] + q.ALPHA) / (n + q.ALPHA * q.BUCKETS))) if m else 0.0
    out = []
    for t in texts:
        g = list(grams(t))
        ratio = sum(map(weight, g)) / max(1, len(g))
        words, _, _, _, repeat = brute(t)
        out.append((ratio, not (words < 20 or 100 * repeat > 30 * words) and ratio >= q.THRESHOLD))
    return out


def test_whole_query_like_brute_force(spark):
    rnd = np.random.RandomState(6)
    vocab = ["".join(rnd.choice(list("abcdefgh"), rnd.randint(2, 9))) for _ in range(150)]
    texts = []
    for i in range(90):
        words = [str(w) for w in rnd.choice(vocab, rnd.randint(5, 90))]
        text = " ".join(w + "." if k % 11 == 10 else w for k, w in enumerate(words))
        texts.append([text, text.upper(), text + " ###$$$" * 9, "zz qq " * 40, text.replace(" ", "\n", 5), text + " é" + "x" * 20_000][min(i % 9, 5) if i % 9 < 6 else 0])
    texts += ["", texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute_verdicts(texts)
    got = {r.doc_id: r for r in q.quality_rules(df).collect()}
    assert any(brute_trusted(t) for t in texts) and {k for _, k in want} == {True, False}
    for i, (ratio, kept) in enumerate(want):
        assert math.isclose(got[i].log_ratio, ratio, abs_tol=1e-9) and got[i].kept == kept
    assert {r.doc_id for r in q.kept(df).collect()} == {i for i, (_, k) in enumerate(want) if k}


def test_trusted_by_its_rules():
    base = " ".join(f"word{k}" + ("." if k % 12 == 11 else "") for k in range(60))
    texts = [base, base.upper(), base + "\n" + base, base.replace(".", ""), base[:80], "###" + base, base.replace("word", "w"), base.replace(" ", "! ")]
    assert q.trusted(q.base_counts([t.encode() for t in texts]), [t.encode() for t in texts]).tolist() == [brute_trusted(t) for t in texts]
