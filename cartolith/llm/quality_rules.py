"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target to the raw corpus (operator 5).

Byte n-grams are hashed into a fixed number of buckets. Two multinomials over the buckets are counted from all
documents: the raw corpus is every document; the trusted target is every document that passes strict rules
(``trusted``). A document's ratio is the mean, over its n-grams, of the logarithm of the smoothed probabilities'
quotient, so length does not count. Every document is judged by the same threshold; nothing is drawn at random.
Counting is one narrow pass, whose tasks add up their own counts; the table gathered is as large as the number
of buckets whatever the corpus.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; a text of fewer bytes
than an n-gram has ratio 0; without any trusted document the ratio is 0 for all and the base rules decide alone;
repeated rows get the same answer each.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import batch, filtered, map_arrow, shingle_hashes, utf8, word_hashes

N, BUCKETS, ALPHA, THRESHOLD = 4, 1 << 16, 1.0, -0.1
SYMBOLS = b"#*$%&|<>"
_WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_NOT_COUNTED = _WHITE + bytes(range(0x80, 0xC0))  # white space, and all but the first byte of a code point
WINDOW = 8


def repeated_words(words: list[bytes]) -> int:
    """Words that are in a window of 8 words which is in the text twice or more."""
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = bytearray(len(words))
    for i, w in enumerate(windows):
        if w in often:
            covered[i : i + WINDOW] = b"\1" * WINDOW
    return sum(covered)


def duplicate_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    return sum(n - 1 for line, n in Counter(lines).items() if n > 1 and line.strip())


def base_counts(texts: list[bytes]) -> np.ndarray:
    """Of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    hashes, at = word_hashes(texts)
    out = np.zeros((len(texts), 5), np.int64)
    for i, t in enumerate(texts):
        n = int(at[i + 1] - at[i])
        repeated = 0
        if n > WINDOW:
            s = np.sort(shingle_hashes(hashes[at[i] : at[i + 1]], WINDOW))
            if (s[1:] == s[:-1]).any():
                repeated = repeated_words(t.split())
        out[i] = n, len(t.translate(None, _NOT_COUNTED)), len(t) - len(t.translate(None, SYMBOLS)), duplicate_lines(t), repeated
    return out


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])


def trusted(counts: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Strict rules: 40 words at least, 3 to 15 characters a word, a symbol in 200 characters at most, no repeated lines
    or windows, and a sentence's full stop, question or exclamation mark in 60 words at least."""
    words, chars = np.maximum(1, counts[:, 0]), counts[:, 1]
    stops = np.array([len(t) - len(t.translate(None, b".!?")) for t in texts], np.int64)
    shouted = np.array([len(t) - len(t.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for t in texts], np.int64)
    fine = (counts[:, 0] >= 40) & (chars >= 3 * words) & (chars <= 15 * words) & (200 * counts[:, 2] <= chars)
    return fine & (counts[:, 3] == 0) & (counts[:, 4] == 0) & (60 * stops >= words) & (2 * stops <= words) & (5 * shouted <= chars)


def buckets_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of the texts, one text after another, and how many each text has."""
    n = np.array([max(0, len(t) - N + 1) for t in texts], np.int64)
    buf = np.frombuffer(b"".join(t for t in texts if len(t) >= N) + bytes(N), np.uint8).astype(np.uint32)
    size = len(buf) - N
    gram = buf[:size].copy()
    for k in range(1, N):
        gram |= buf[k : size + k] << np.uint32(8 * k)
    inside = np.ones(size, bool)
    ends = np.cumsum([len(t) for t in texts if len(t) >= N])
    for k in range(1, N):
        inside[ends - k] = False
    gram = gram[inside] * np.uint32(0x9E3779B1)
    return (gram ^ (gram >> np.uint32(15))) >> np.uint32(16), n


def bucket_counts(df: DataFrame) -> DataFrame:
    """(bucket, raw, target) over all rows."""

    def make():
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)

        def run(b: pa.RecordBatch):
            texts = b.column(0).to_pylist()
            good = trusted(base_counts(texts), texts)
            for out, some in ((raw, texts), (target, [t for t, g in zip(texts, good, strict=True) if g])):
                if some:
                    out += np.bincount(buckets_of(some)[0], minlength=BUCKETS)
            return ()

        def close():
            has = np.flatnonzero(raw)
            yield batch(bucket=pa.array(has, pa.int64()), raw=raw[has], target=target[has])

        run.close = close
        return run

    parts = map_arrow(df.select(utf8().alias("text")), make, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """The logarithm of target to raw probability of each bucket."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():  # BUCKETS rows at most
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return np.zeros(BUCKETS)
    share = lambda x: np.log(x + ALPHA) - np.log(x.sum() + ALPHA * BUCKETS)
    return share(target) - share(raw)


def ratios(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    buckets, n = buckets_of(texts)
    total = np.concatenate([[0.0], np.cumsum(weights[buckets])])
    ends = np.cumsum(n)
    return (total[ends] - total[ends - n]) / np.maximum(1, n)


def quality_rules(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, log_ratio of every row."""
    weights = log_ratios(bucket_counts(df))
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def make():
        def run(b: pa.RecordBatch):
            texts = b.column(1).to_pylist()
            counts, ratio = base_counts(texts), ratios(texts, shared.value)
            bad = base_failed(counts)
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
            yield batch(doc_id=b.column(0), **{k: counts[:, i].copy() for i, k in enumerate(names)}, base_failed=bad, kept=~bad & (ratio >= threshold), log_ratio=ratio)

        return run

    return map_arrow(df.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")), make, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, log_ratio double")


def kept(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that quality_rules keeps, with all their columns."""
    shared = df.sparkSession.sparkContext.broadcast(log_ratios(bucket_counts(df)))

    def make():
        return lambda texts: ~base_failed(base_counts(texts)) & (ratios(texts, shared.value) >= threshold)

    return filtered(df, make)
