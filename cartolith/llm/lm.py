"""Language-model scoring by a weighted backoff automaton (operator 6).

Words, bigrams and trigrams of every training document are counted exactly, however many there are; words count from
their first occurrence, n-grams from their second (``least``), at any size of the corpus. They are the states and arcs
of an automaton: a state for each history, an arc for each n-gram kept, and a failure arc with a backoff weight to the
shorter history; at the root a word has its unigram probability, and a word never seen in training the share of unseen
words times the probability of its spelling under a byte trigram model.

No task holds the automaton. Documents are written in blocks of about ``BLOCK`` bytes, a row each. A block asks for
what it needs: its distinct n-grams of one order, with its own counts, go in sorted and packed arrays to the shards that
their hashes name, and a shard answers each of its blocks with the totals, in the order asked, so that keys travel once.
Trigrams come first, in ``PASSES`` parts of the hashes, one after another, which bounds the disk; a shard passes on the
discounted counts of its trigrams by history to the shards of bigrams, those to the shards of words. A shard holds
packed arrays and its distinct n-grams; an n-gram that all blocks hold is one number a block. Then each block is joined
with its answers and its documents are traversed from left to right: a token takes two failure arcs at most, which are
followed for all tokens of a block at once.

Probabilities: absolute discounting, interpolated. N-grams are told apart by 64-bit hashes. Defined cases: a null or
empty text is the end token alone; without training documents all mass is that of the end token and of unseen words;
repeated rows are counted and scored each; a text of any length is one block at most and is scored whole; rows with a
null doc_id have the crc32 of the empty text, 0, and so are held out; other columns are not looked at.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import Words, batch, crc_mod, fresh, map_arrow, mix, shuffles_removed, utf8, word_hashes

D, LEAST, BLOCK = 0.75, 2, 4 << 20
#: Parts in which the n-grams of each order are counted.
PASSES = {3: 2, 2: 2, 1: 1}
#: N-grams that blocks ask of a shard, about; with more shards than ``SHARDS`` up to ``GROWN`` times as many, as
#: each block writes to each shard: messages, blocks times shards, are short where there are many.
SHARD, SHARDS, GROWN = 1 << 18, 128, 4
END = np.uint64(0x454E44)  # stands for the end token's hash
FLUSH = 2_000_000
ANSWERS = "ord int, block long, shard long, data binary"


# ------------------------------------------------------------------ packed arrays
def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length of unsigned numbers, as planes of bytes, compressed."""
    n = len(arrays[0])
    widths = [(int(a.max()).bit_length() + 7) // 8 if n else 0 for a in arrays]
    planes = b"".join(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(n, 8)[:, :w].T).tobytes() for a, w in zip(arrays, widths, strict=True))
    return struct.pack("<I", n) + bytes(widths) + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes, k: int) -> list[np.ndarray]:
    n, widths, at, out = struct.unpack_from("<I", data)[0], data[4 : 4 + k], 0, []
    planes = np.frombuffer(pa.decompress(data[4 + k :], n * sum(widths), "zstd", asbytes=True), np.uint8)
    for w in widths:
        a = np.zeros((n, 8), np.uint8)
        a[:, :w] = planes[at : at + w * n].reshape(w, n).T
        out.append(a.view("<u8").ravel())
        at += w * n
    return out


def steps(a: np.ndarray) -> np.ndarray:
    """Numbers, sorted as a rule, as differences modulo 2 ** 64."""
    return np.diff(a, prepend=np.uint64(0))


# ------------------------------------------------------------------ n-grams
def _pair(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(history * np.uint64(0xD6E8FEB86659FD93) + word)


def _with_ends(values: np.ndarray, offsets: np.ndarray, end) -> np.ndarray:
    """The documents' values with one more after each."""
    return np.insert(values, offsets[1:], end)


def _places(offsets: np.ndarray) -> np.ndarray:
    """How many tokens come before each in its document, ends among them."""
    n = np.diff(offsets) + 1
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Grams:
    """A block's distinct n-grams of one order: sorted by shard, then by history.

    word: 40 bits of the last word's hash; of single words the history is the word itself."""

    def __init__(self, order: int, history: np.ndarray, word: np.ndarray, key: np.ndarray, shards: int):
        codes, distinct = pd.factorize(key)
        one = np.empty(len(distinct), np.int64)
        one[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        shard = _shard(distinct, shards)
        bits = np.uint64(shards.bit_length())
        # the low bits number the n-grams: numbers are sorted faster than places, and a block's order is the same wherever it is made
        low = np.uint64((1 << len(one).bit_length()) - 1)
        order = (shard << (np.uint64(64) - bits) | history[one] >> bits) & ~low | np.arange(len(one), dtype=np.uint64)
        then = (np.sort(order) & low).astype(np.int64)
        self.history, self.word, self.shard = history[one][then], word[one][then], shard[then]
        rank = np.empty(len(one), np.int64)
        rank[then] = np.arange(len(one))
        #: where each occurrence's n-gram is
        self.at = rank[codes]

    def counted(self, train: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, train, len(self.history)).astype(np.uint64)

    def asked(self, n: np.ndarray) -> Iterable[tuple[int, bytes]]:
        """(shard, packed) for each shard."""
        edges = [0, *(np.flatnonzero(np.diff(self.shard)) + 1).tolist(), len(self.shard)]
        for a, z in zip(edges, edges[1:], strict=False):
            if z > a:
                yield int(self.shard[a]), packed(steps(self.history[a:z]), self.word[a:z], n[a:z])


def shards_for(asked: int) -> int:
    """For texts of so many bytes."""
    tokens = max(1, asked // 6)
    return max(-(-tokens // (GROWN * SHARD)), min(SHARDS, -(-tokens // SHARD)))


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return (key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)


class Tokens:
    """A block's tokens, ends among them, and the keys of the n-grams that end at each."""

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray):
        self.offsets, self.place = offsets, _places(offsets)
        self.hash = _with_ends(hashes, offsets, END)
        self.word = self.hash >> np.uint64(24)
        self.two, self.three = np.zeros_like(self.hash), np.zeros_like(self.hash)
        self.two[1:] = _pair(self.hash[:-1], self.word[1:])
        self.three[1:] = _pair(self.two[:-1], self.word[1:])

    def positions(self, order: int) -> np.ndarray:
        """Where an n-gram of the order ends; ends are no words."""
        if order > 1:
            return np.flatnonzero(self.place >= order - 1)
        inner = np.ones(len(self.hash), bool)
        inner[self.offsets[1:] + np.arange(len(self.offsets) - 1)] = False
        return np.flatnonzero(inner)

    def grams(self, order: int, shards: int, part: int | None = None) -> tuple[Grams, np.ndarray]:
        """The n-grams (of a part of the shards), and the positions at which they end."""
        at = self.positions(order)
        key = (self.hash, self.two, self.three)[order - 1][at]
        if part is not None:
            mine = _shard(key, shards) % np.uint64(PASSES[order]) == np.uint64(part)
            at, key = at[mine], key[mine]
        if order == 1:
            return Grams(1, key, np.zeros_like(key), key, shards), at
        return Grams(order, (self.hash, self.two)[order - 2][at - 1], self.word[at], key, shards), at


class Shard:
    """Adds up what blocks ask of a shard, and what the shards of the next order pass on."""

    def __init__(self, order: int, least: int):
        self.order, self.least = order, least
        self.asked: list[tuple[int, bytes]] = []
        self.read: list[tuple[np.ndarray, ...]] = []  # of each block, until there are many
        self.folded: tuple[np.ndarray, ...] | None = None
        self.kept: list[list[np.ndarray]] = []
        self.size = 0

    def _read(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        history, word, n = unpacked(data, 3)
        history = np.cumsum(history, dtype=np.uint64)
        return history if self.order == 1 else _pair(history, word), history, n

    def add(self, block: int, data: bytes) -> None:
        if block < 0:
            self.kept.append(unpacked(data, 3))
            return
        self.asked.append((block, data))
        self.read.append(self._read(data))
        self.size += len(self.read[-1][0])
        if self.size > 8 * SHARD:  # a shard of n-grams that very many blocks hold: keep what is distinct
            self.folded = self._total()[:3]
            self.read, self.size = [], 0

    def _total(self) -> tuple[np.ndarray, ...]:
        """Distinct keys, their histories and counts; and the place of each key read."""
        parts = ([self.folded] if self.folded else []) + self.read
        key, history, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        codes, distinct = pd.factorize(key)
        before = np.empty(len(distinct), np.uint64)
        before[codes] = history
        return distinct, before, np.bincount(codes, n, len(distinct)).astype(np.uint64), codes

    def answers(self) -> Iterable[tuple[int, bytes]]:
        """(block, packed totals, and of each n-gram as a history the sum and number of what is kept after it)."""
        if not self.asked:
            return
        key, history, n, codes = self._total()
        place = pd.Index(key)
        sums, many = np.zeros(len(key), np.uint64), np.zeros(len(key), np.uint64)
        for keys, s, t in self.kept:
            # what is kept after an n-gram, a row a shard of the next order; its keys differ from each other
            at = place.get_indexer(np.cumsum(keys, dtype=np.uint64))
            sums[at] += s
            many[at] += t
        self.types = int((n > 0).sum())
        n = np.where(n >= (1 if self.order == 1 else self.least), n, 0)
        has = np.flatnonzero(n)
        self.after = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint64)
        if self.order > 1 and len(has):
            of, before = pd.factorize(history[has])
            self.after = before, np.bincount(of, n[has], len(before)).astype(np.uint64), np.bincount(of, minlength=len(before)).astype(np.uint64)
        at = len(codes) - self.size
        for i, (block, data) in enumerate(self.asked):
            k = i - (len(self.asked) - len(self.read))
            if k >= 0:
                own = codes[at : at + len(self.read[k][0])]
                at += len(own)
            else:
                own = place.get_indexer(self._read(data)[0])
            yield block, packed(n[own], sums[own], many[own]) if self.order < 3 else packed(n[own])

    def passed_on(self, shards: int) -> Iterable[tuple[int, bytes]]:
        """(shard of the order below, packed): the counts kept after each history; after answers()."""
        key, n, t = self.after
        order = np.argsort(key, kind="stable")
        key, n, t = key[order], n[order], t[order]
        shard = _shard(key, shards)
        edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(key)]
        for a, z in zip(edges, edges[1:], strict=False):
            if z > a:
                yield int(shard[a]), packed(steps(key[a:z]), n[a:z], t[a:z])


# ------------------------------------------------------------------ spelling
class Counter:
    """Adds up numbers with weights; gives (key, n) pairs, those of many keys in parts."""

    def __init__(self):
        self.keys, self.n, self.size = [], [], 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.keys.append(keys)
        self.n.append(n)
        self.size += len(keys)
        if self.size >= FLUSH:
            self.keys, self.n = ([x] for x in self.total())
            self.size = len(self.keys[0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        codes, key = pd.factorize(np.concatenate(self.keys))
        return key, np.bincount(codes, np.concatenate(self.n), len(key)).astype(np.int64)


def _spelling(rows: DataFrame) -> Spelling:
    """From the sums of byte trigrams of all training words: 2 ** 24 at most."""
    counter = Counter()
    for r in rows.where("ord = -1").select("data").collect():
        counter.add(*(x.astype(np.int64) for x in unpacked(bytes(r.data), 2)))
    return Spelling(*counter.total())


def spelling_grams(words: list[bytes]) -> np.ndarray:
    """Byte trigrams of words, each with two spaces before and one after, as numbers."""
    x = np.frombuffer(b"".join(b"  " + w for w in words) + b"  ", np.uint8).astype(np.uint64)
    g = x[:-2] << np.uint64(16) | x[1:-1] << np.uint64(8) | x[2:]
    return g[(x[1:-1] != 32) | (x[2:] != 32)]  # not from a word's end into the next one's beginning


class Spelling:
    """log10 of the probability of a word's bytes and its end: byte trigrams, with bigrams and a uniform share below."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.n = grams[order].astype(np.int64), n[order].astype(np.float64)
        last = self.grams & 255
        pair = self.grams & 0xFFFF
        self.pairs = np.bincount(pair, self.n, 1 << 16)
        self.heads = np.bincount(self.grams >> 8, self.n, 1 << 16)
        self.firsts = np.bincount(pair >> 8, self.n, 256)
        assert not len(last) or last.max() < 256

    def log10(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        g = spelling_grams(words).astype(np.int64)
        at = np.minimum(np.searchsorted(self.grams, g), max(0, len(self.grams) - 1))
        n = np.where(self.grams[at] == g, self.n[at], 0.0) if len(self.grams) else np.zeros(len(g))
        head, pair = g >> 8, g & 0xFFFF
        low = (self.pairs[pair] + 0.5) / (self.firsts[pair >> 8] + 128)
        p = (n + 4 * low) / (self.heads[head] + 4)
        ends = np.cumsum([len(w) + 1 for w in words])
        total = np.concatenate([[0.0], np.cumsum(np.log10(p))])
        return total[ends] - total[np.concatenate([[0], ends[:-1]])]


# ------------------------------------------------------------------ blocks
def _blocks(df: DataFrame) -> DataFrame:
    """(block, ids, held, sizes, text, words): documents in blocks, a row each; text is lower-cased, joined and compressed, words counts those of training texts."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 10) == 0).alias("held_out"), utf8().alias("text"))

    def make():
        docs: list[tuple] = []
        state = {"size": 0, "n": 0, "part": 0}

        def row() -> pa.RecordBatch:
            ids, held, texts = zip(*docs, strict=True)
            docs.clear()
            state["size"] = 0
            state["n"] += 1
            words = sum(len(t.split()) for t, h in zip(texts, held, strict=True) if not h)
            return batch(
                block=pa.array([(state["part"] << 32) + state["n"]], pa.int64()), ids=pa.array([ids], pa.list_(pa.int64())), held=pa.array([held], pa.list_(pa.bool_())),
                sizes=pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), text=pa.array([pa.compress(b"".join(texts), "zstd", asbytes=True)], pa.binary()), words=pa.array([words], pa.int64()),
            )

        def run(b: pa.RecordBatch):
            for part, doc_id, held, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                state["part"] = part
                if docs and state["size"] + len(text) > BLOCK:
                    yield row()
                docs.append((doc_id, held, text.lower()))
                state["size"] += len(text)

        run.close = lambda: [row()] if docs else []
        return run

    schema = "block long, ids array<long>, held array<boolean>, sizes array<long>, text binary, words long"
    made = map_arrow(rows.select(F.spark_partition_id().cast("long").alias("part"), "*"), make, schema)
    path = fresh(df.sparkSession, "lm-blocks")
    # row groups of few blocks: a reader takes one at a time
    made.write.option("compression", "none").option("parquet.block.size", str(BLOCK)).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def _texts(text, sizes, held) -> Iterable[tuple[list[bytes], list[bool]]]:
    for t, n, h in zip(text, sizes, held, strict=True):
        ends = np.cumsum([0, *n.as_py()]).tolist()
        whole = pa.decompress(t.as_buffer(), ends[-1], "zstd", asbytes=True) if ends[-1] else b""
        yield [whole[a:z] for a, z in zip(ends, ends[1:], strict=False)], h.as_py()


def _answered(blocks: DataFrame, order: int, part: int, shards: dict[int, int], passed: DataFrame | None, least: int) -> DataFrame:
    """(ord, block, shard, data): a shard's answer to a block (ord: the order), what it passes on (block -1, ord: one less), its types (ord 0), or sums of byte trigrams (ord -1, with the words)."""

    def ask():
        spelt = Counter()  # with the words, the byte trigrams of training words are counted

        def words(texts: list[bytes], held: list[bool]):
            found, offsets = Words.of(texts)
            codes, first = found.distinct()
            times = np.bincount(codes, np.repeat(~np.array(held, bool), np.diff(offsets)), len(first)).astype(np.int64)
            known = first[times > 0].tolist()
            size = found.size[known] + 1
            spelt.add(spelling_grams([found.word(i) for i in known]).astype(np.int64), np.repeat(times[times > 0], size))
            own = found.hashes()[first]
            return Grams(1, own, np.zeros_like(own), own, shards[1]), times.astype(np.uint64)

        def run(b: pa.RecordBatch):
            for block, (texts, held) in zip(b.column(0).to_pylist(), _texts(*b.columns[1:]), strict=True):
                if order == 1:
                    grams, n = words(texts, held)
                    n = grams.counted(n)
                else:
                    tokens = Tokens(*word_hashes(texts))
                    grams, at = tokens.grams(order, shards[order], part)
                    n = grams.counted(np.repeat(~np.array(held, bool), np.diff(tokens.offsets) + 1)[at])
                found = list(grams.asked(n))
                for k in range(0, len(found), 64):
                    some = found[k : k + 64]
                    yield batch(block=pa.array([block] * len(some), pa.int64()), shard=pa.array([x[0] for x in some], pa.int64()), data=pa.array([x[1] for x in some], pa.binary()))

        def close():
            key, n = spelt.total()
            for h in np.unique(key >> 18).tolist():
                some = key >> 18 == h
                yield batch(block=pa.array([-1], pa.int64()), shard=pa.array([-1 - h], pa.int64()), data=pa.array([packed(key[some].astype(np.uint64), n[some].astype(np.uint64))], pa.binary()))

        run.close = close
        return run

    def answer():
        state: dict = {"shard": None}

        def done():
            if state["shard"] is None:
                return
            if state["shard"] < 0:
                key, n = state["own"].total()
                yield batch(ord=pa.array([-1], pa.int32()), block=pa.array([-1], pa.int64()), shard=pa.array([state["shard"]], pa.int64()), data=pa.array([packed(key.astype(np.uint64), n.astype(np.uint64))], pa.binary()))
                return
            own: Shard = state["own"]
            rows = [(order, block, state["shard"], data) for block, data in own.answers()]
            if not rows:
                return
            if order > 1:
                rows += [(order - 1, -1, shard, data) for shard, data in own.passed_on(shards[order - 1])]
            else:
                rows.append((0, -1, own.types, b""))
            ords, block, shard, data = zip(*rows, strict=True)
            yield batch(ord=pa.array(ords, pa.int32()), block=pa.array(block, pa.int64()), shard=pa.array(shard, pa.int64()), data=pa.array(data, pa.binary()))

        def run(b: pa.RecordBatch):
            for block, shard, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state["shard"] != shard:
                    yield from done()
                    state.update(shard=shard, own=Shard(order, least) if shard >= 0 else Counter())
                if shard >= 0:
                    state["own"].add(block, data)
                else:
                    state["own"].add(*(x.astype(np.int64) for x in unpacked(data, 2)))

        run.close = done
        return run

    rows = map_arrow(blocks.select("block", "text", "sizes", "held"), ask, "block long, shard long, data binary")
    if passed is not None:
        rows = rows.unionByName(passed.where(f"ord = {order} and block = -1 and shard % {PASSES[order]} = {part}").select("block", "shard", "data"))
    dealt = rows.repartition("shard").sortWithinPartitions("shard")
    path = fresh(blocks.sparkSession, f"lm-answers-{order}-{part}")
    map_arrow(dealt, answer, ANSWERS).write.parquet(path)
    return blocks.sparkSession.read.schema(ANSWERS).parquet(path)


# ------------------------------------------------------------------ scoring
class Totals:
    """The automaton's root."""

    def __init__(self, documents: int, tokens: int, types: int):
        self.documents, self.tokens, self.types = documents, tokens, types

    def unigram(self, c: np.ndarray) -> np.ndarray:
        """Probability at the root of words seen c times, c > 0."""
        return (c - D) / (self.tokens + 2)

    def unseen(self) -> float:
        return (D * self.types + 1) / (self.tokens + 2)

    def end_probability(self) -> float:
        return (max(self.documents - D, 0) + 1) / (self.tokens + 2)


def _states(tokens: Tokens, shards: dict[int, int], answers: list[tuple[int, int, bytes]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each order, the counts of the n-grams that end at each token, and their backoff weights as histories (1: no such state)."""
    counts, backs = [], []
    for order in (1, 2, 3):
        grams, at = tokens.grams(order, shards[order])
        found = [unpacked(data, 1 if order == 3 else 3) for _, data in sorted((x[1], x[2]) for x in answers if x[0] == order)]
        columns = [np.concatenate(x).astype(np.float64) for x in zip(*found, strict=True)] if found else [np.zeros(0)] * 3
        if len(columns[0]) != len(grams.history):
            raise ValueError("a block's answers do not fit what it asked for")
        n, back = np.zeros(len(tokens.hash)), np.ones(len(tokens.hash))
        n[at] = columns[0][grams.at]
        if order < 3:
            weight = np.where(columns[0] > 0, np.maximum(1e-9, (columns[0] - (columns[1] - D * columns[2])) / np.maximum(1, columns[0])), 1.0)
            back[at] = weight[grams.at]
        counts.append(n)
        backs.append(back)
    return counts, backs


def traverse(tokens: Tokens, counts: list[np.ndarray], backs: list[np.ndarray], root_log: np.ndarray) -> np.ndarray:
    """log10 probability of each token from left to right: the longest arc there is, failure arcs with their weights before it."""
    log = root_log.copy()
    for order in (2, 3):
        at = tokens.positions(order)
        before, back, n, low = counts[order - 2][at - 1], backs[order - 2][at - 1], counts[order - 1][at], log[at]
        out, hit = np.log10(back) + low, n > 0
        out[hit] = np.log10((n[hit] - D) / before[hit] + back[hit] * 10 ** low[hit])
        log[at] = out
    return log


def score(df: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; learns from rows whose crc32(doc_id) mod 10 is not 0."""
    spark = df.sparkSession
    with shuffles_removed(spark):
        blocks = _blocks(df)
        training = F.size(F.filter("held", lambda x: ~x))
        words, documents, asked = blocks.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum(training), F.lit(0)), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
        shards = dict.fromkeys((1, 2, 3), shards_for(asked))
        found: list[DataFrame] = []
        passed, types = None, 0
        for order in (3, 2, 1):
            parts = [_answered(blocks, order, part, shards, passed, least) for part in range(PASSES[order])]
            passed = parts[0]
            for x in parts[1:]:
                passed = passed.unionByName(x)
            found += parts
        types = passed.where("ord = 0").agg(F.coalesce(F.sum("shard"), F.lit(0))).first()[0] + (documents > 0)
        spelling = _spelling(passed)
    totals = Totals(documents, words + documents, types)
    model = spark.sparkContext.broadcast((spelling, totals))

    def scorer():
        spell, root = model.value

        def block_rows(ids, held: list[bool], texts: list[bytes], answers) -> pa.RecordBatch:
            words, offsets = Words.of(texts)
            codes, one = words.distinct()
            tokens = Tokens(words.hashes(), offsets)
            counts, backs = _states(tokens, shards, answers)
            c = np.zeros(len(one))
            c[codes] = counts[0][tokens.positions(1)]
            log = np.zeros(len(one))
            new = np.flatnonzero(c == 0)
            log[new] = np.log10(root.unseen()) + spell.log10([words.word(i) for i in one[new].tolist()])
            log[c > 0] = np.log10(root.unigram(c[c > 0]))
            scale = root.tokens + 0.1 * (root.types + 1)
            base = np.log10((c + 0.1) / scale)
            logs = traverse(tokens, counts, backs, _with_ends(log[codes], offsets, np.log10(root.end_probability())))
            n = np.diff(offsets) + 1
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            add = lambda x: np.add.reduceat(x, first)
            return batch(
                doc_id=ids, held_out=pa.array(held, pa.bool_()), n_tokens=pa.array(n, pa.int64()),
                n_known=pa.array(add(_with_ends((c > 0)[codes].astype(np.int64), offsets, int(root.documents > 0))), pa.int64()),
                train_tokens=pa.array(np.full(len(n), root.tokens), pa.int64()),
                base_score=add(_with_ends(base[codes], offsets, np.log10((root.documents + 0.1) / scale))), score=add(logs),
            )

        def run(b: pa.RecordBatch):
            for (texts, held), ids, answers in zip(_texts(b.column(0), b.column(1), b.column(2)), b.column(3), b.column(4), strict=True):
                rows = [(x["ord"], x["shard"], x["data"]) for x in answers.as_py() or ()]
                yield block_rows(ids.values, held, texts, rows)

        return run

    answers = found[0]
    for x in found[1:]:
        answers = answers.unionByName(x)
    answers = answers.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("ord", "shard", "data")).alias("answers"))
    joined = blocks.join(answers, "block", "left").select("text", "sizes", "held", "ids", "answers")
    return map_arrow(joined, scorer, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
