"""Quality classifier: a byte-level convolutional network in numpy (operator 10).

A document's bytes are cut into overlapping chunks that cover it whole. Learned filters run over each chunk; a
filter's largest response in the chunk is its feature, through a rectifier. Features are combined over the
chunks by their maximum and their mean, and a small dense layer gives the log-odds. As the first layer embeds
bytes and the filters are linear in that, a filter is a table of a weight for each byte at each of its places.

Training: back-propagation with Adam on at most ``sample`` labelled documents, whole texts, chosen by the least
hash of their id; those that would make it more than ``sample_bytes`` in all are passed over (both bounds are parameters;
nothing else is bounded). Seeds are fixed, rows are ordered by
hash and id, so the same table gives the same model.

Defined cases: a null or empty text is scored as one chunk of padding; without labelled rows, or with labels of
one kind only, every score is that kind's smoothed share; labels that are null are left out; of repeated labels
of an id the largest counts; rows with a null doc_id are scored, never learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import batch, crc_mod, filtered, map_arrow, released, utf8, written

CHUNK, WIDTH, STRIDE, DIM, FILTERS, HIDDEN = 512, 8, 2, 6, 32, 24
STEP = CHUNK - 64
PLACES = (CHUNK - WIDTH) // STRIDE + 1
LEAST_STEPS = 500  # few rows are gone over more often
BLOCK = 256  # chunks convolved at once


def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of the texts as rows, padded by zeros, and how many each text has."""
    n = np.array([1 + max(0, -(-(len(t) - CHUNK) // STEP)) for t in texts])
    out = np.zeros((int(n.sum()), CHUNK), np.uint8)
    at = 0
    for t, k in zip(texts, n, strict=True):
        flat = np.zeros((k - 1) * STEP + CHUNK, np.uint8)
        flat[: len(t)] = np.frombuffer(t, np.uint8)
        for i in range(k):
            out[at + i] = flat[i * STEP : i * STEP + CHUNK]
        at += k
    return out, n


class Network:
    def __init__(self, seed: int = 0):
        rng = np.random.RandomState(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "filters": rng.normal(0, 1 / np.sqrt(WIDTH * DIM), (WIDTH, DIM, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "mid": rng.normal(0, 1 / np.sqrt(2 * FILTERS), (2 * FILTERS, HIDDEN)).astype(np.float32),
            "lift": np.zeros(HIDDEN, np.float32),
            "out": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(np.float32),
            "shift": np.zeros(1, np.float32),
        }
        self.constant: float | None = None

    def tables(self) -> np.ndarray:
        return np.einsum("bd,kdf->kbf", self.p["embed"], self.p["filters"])

    def pooled(self, chunks: np.ndarray, tables: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each chunk's largest response to each filter, and its place."""
        top = np.empty((len(chunks), FILTERS), np.float32)
        at = np.empty((len(chunks), FILTERS), np.int64) if where else None
        for s in range(0, len(chunks), BLOCK):
            x = chunks[s : s + BLOCK]
            total = np.zeros((len(x), PLACES, FILTERS), np.float32)
            for k in range(WIDTH):
                total += tables[k].take(x[:, k : k + STRIDE * (PLACES - 1) + 1 : STRIDE], axis=0)
            top[s : s + BLOCK] = total.max(1)
            if at is not None:
                at[s : s + BLOCK] = total.argmax(1)
        return top, at

    @staticmethod
    def combined(h: np.ndarray, n: np.ndarray) -> np.ndarray:
        first = np.cumsum(n) - n
        return np.concatenate([np.maximum.reduceat(h, first), np.add.reduceat(h, first) / n[:, None]], axis=1).astype(np.float32)

    def score(self, texts: list[bytes], tables: np.ndarray) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.5)
        chunks, n = chunks_of(texts)
        top, _ = self.pooled(chunks, tables)
        v = self.combined(np.maximum(top + self.p["bias"], 0), n)
        z = np.maximum(v @ self.p["mid"] + self.p["lift"], 0) @ self.p["out"] + self.p["shift"]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        p, tables = self.p, self.tables()
        chunks, n = chunks_of(texts)
        top, at = self.pooled(chunks, tables, where=True)
        h = np.maximum(top + p["bias"], 0)
        v = self.combined(h, n)
        u = np.maximum(v @ p["mid"] + p["lift"], 0)
        z = u @ p["out"] + p["shift"]
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(texts)).astype(np.float32)
        du = dz[:, None] * p["out"] * (u > 0)
        dv = du @ p["mid"].T
        doc = np.repeat(np.arange(len(texts)), n)
        dh = dv[doc, FILTERS:] / n[doc][:, None]
        best = (h == v[doc, :FILTERS]).astype(np.float32)
        best /= np.maximum(1, np.add.reduceat(best, np.cumsum(n) - n))[doc]
        dtop = (dh + best * dv[doc, :FILTERS]) * (top + p["bias"] > 0)
        # by place: how much each byte adds to each filter, from which both layers' gradients follow
        dembed, dfilters = np.zeros_like(p["embed"]), np.zeros_like(p["filters"])
        row, column = np.arange(len(chunks))[:, None], np.arange(FILTERS)
        flat = dtop.ravel()
        for k in range(WIDTH):
            byte = chunks[row, STRIDE * at + k].astype(np.int64)
            m = np.bincount((byte * FILTERS + column).ravel(), flat, 256 * FILTERS).reshape(256, FILTERS).astype(np.float32)
            dembed += m @ p["filters"][k].T
            dfilters[k] = p["embed"].T @ m
        return {"embed": dembed, "filters": dfilters, "bias": dtop.sum(0), "mid": v.T @ du, "lift": du.sum(0), "out": u.T @ dz, "shift": dz.sum(keepdims=True)}

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 6, size: int = 32, rate: float = 0.01) -> Network:
        ones = int(labels.sum())
        if not 0 < ones < len(labels):
            self.constant = (ones + 1) / (len(labels) + 2)
            return self
        rng = np.random.RandomState(1)
        m = {k: np.zeros_like(x) for k, x in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        epochs = max(epochs, -(-LEAST_STEPS // -(-len(texts) // size)))
        t, steps = 0, epochs * -(-len(texts) // size)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for s in range(0, len(order), size):
                some = order[s : s + size]
                g = self.gradients([texts[i] for i in some], labels[some])
                t += 1
                now = rate * min(1.0, 2 * (1 - t / (steps + 1)))
                for k, x in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.999 * v[k] + 0.001 * x * x
                    self.p[k] -= (now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
        return self


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, in_training, sample: int, sample_bytes: int) -> tuple[list[bytes], np.ndarray]:
    """At most ``sample`` labelled documents of the training fold, of least hash of their id, and ``sample_bytes`` of text; ordered by hash and id."""
    kept = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
    kept = kept.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & in_training)
    kept = kept.groupBy("doc_id").agg(F.max("label").alias("label"))
    kept = kept.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    found = written(texts.join(F.broadcast(kept), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), "cnn-sample")
    order = lambda doc_id: doc_id * 0x9E3779B97F4A7C15 % 2**64
    sizes, room, chosen = {r.doc_id: r.n for r in found.select("doc_id", F.octet_length("text").alias("n")).collect()}, sample_bytes, []
    for doc_id in sorted(sizes, key=order):
        if sizes[doc_id] <= room:
            chosen.append(doc_id)
            room -= sizes[doc_id]
    fits = found.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")
    rows = found.join(F.broadcast(fits), "doc_id").collect()
    rows.sort(key=lambda r: order(r.doc_id))
    released(found)
    return [bytes(r.text) for r in rows], np.array([r.label for r in rows], np.float32)


def trained(docs: DataFrame, labels: DataFrame, sample: int, epochs: int, sample_bytes: int) -> Network:
    """Learns from labels of rows whose crc32(doc_id) mod 3 is not 1."""
    texts, y = labelled_sample(docs, labels, "quality", crc_mod("doc_id", 3) != 1, sample, sample_bytes)
    if texts:
        return Network().fit(texts, y, epochs)
    network = Network()
    network.constant = 0.5
    return network


def kept(docs: DataFrame, labels: DataFrame, sample: int = 4000, epochs: int = 6, sample_bytes: int = 64 << 20) -> DataFrame:
    """The rows that the classifier predicts to be good, with all their columns."""
    network = trained(docs, labels, sample, epochs, sample_bytes)
    shared = docs.sparkSession.sparkContext.broadcast((network, network.tables()))

    def make():
        net, tables = shared.value
        return lambda texts: net.score(texts, tables) >= 0.5

    return filtered(docs, make)


def quality_classifier(docs: DataFrame, labels: DataFrame, sample: int = 4000, epochs: int = 6, sample_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; learns from labels of rows whose crc32(doc_id) mod 3 is not 1."""
    network = trained(docs, labels, sample, epochs, sample_bytes)
    shared = docs.sparkSession.sparkContext.broadcast((network, network.tables()))

    def make():
        net, tables = shared.value

        def run(b: pa.RecordBatch):
            score = net.score(b.column(2).to_pylist(), tables)
            yield batch(doc_id=b.column(0), held_out=b.column(1), score=score, predicted=pa.array(score >= 0.5).cast(pa.int32()))

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 3) == 1).alias("held_out"), utf8().alias("text"))
    return map_arrow(rows, make, "doc_id long, held_out boolean, score double, predicted int")
