"""Helpers shared by the training-data operators.

Texts travel to Python as UTF-8 ``binary`` columns: ``bytes.split()``, ``bytes.lower()`` and
``bytes.strip()`` work on exactly ``[\\x20\\x09-\\x0D]`` and ``A-Z``, so no decoding is needed
to get the words or line keys that the operators are defined on.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.plans.iterate import dropped, shared_dir

#: Rows in an Arrow batch: bounds what a Python worker holds when texts are long.
ARROW_ROWS = 512
ARROW_BYTES = 16 << 20
#: Rows in a batch that goes back.
OUT_ROWS = 1 << 15
#: A table is broadcast only when it has at most so many bytes; beyond, it is joined by shuffle.
BROADCAST_BYTES = 64 << 20


def configure(spark: SparkSession) -> None:
    """Bound the Arrow batches, which hold whole texts, by rows and bytes. Results are made lazily, so this holds for the
    session from the first operator on; smaller bounds of the session's own are kept."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        own = int(str(spark.conf.get(name)).rstrip("b"))
        if not 0 < own <= most:
            spark.conf.set(name, str(most))


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. Survives the loss of any executor."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def released(*tables: DataFrame) -> None:
    """Remove tables that written() gave, once nothing reads them any more."""
    for x in tables:
        dropped(x.sparkSession, x.written_at)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Within, a query's shuffle files are removed at its end: for steps whose result is written at once.

    While a query runs a lost executor's part is made again as ever; afterwards the written table is what counts."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(name: str = "text") -> Column:
    """The text's UTF-8 bytes; a null text counts as an empty one."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def crc_mod(column: str, n: int) -> Column:
    """crc32(column as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch | None]]], schema: str) -> DataFrame:
    """mapInArrow with a per-task object: ``make()`` gives a function from a batch to output batches.

    The function may have an attribute ``close`` that gives the last ones."""
    configure(df.sparkSession)

    def pieces(found: Iterable) -> Iterator[pa.RecordBatch]:
        for out in found:
            for s in range(0, out.num_rows if out is not None else 0, OUT_ROWS):
                yield out.slice(s, OUT_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            yield from pieces(f(b))
        yield from pieces(getattr(f, "close", tuple)())

    return df.mapInArrow(run, schema)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) if not isinstance(v, pa.Array) else v for v in columns.values()], names=list(columns))


def filtered(df: DataFrame, make: Callable[[], Callable[[list[bytes]], np.ndarray]], text_col: str = "text") -> DataFrame:
    """The rows whose text passes: make() gives, in each task, a function from texts to booleans. All columns stay as they are."""
    names = df.columns
    renamed = df.toDF(*[f"c{i}" for i in range(len(names))])
    rows = renamed.select(utf8(f"c{names.index(text_col)}").alias("t"), "*")

    def start():
        keep = make()

        def run(b: pa.RecordBatch):
            mask = pa.array(np.asarray(keep(b.column(0).to_pylist()), bool))
            yield pa.RecordBatch.from_arrays(list(b.columns[1:]), names=b.schema.names[1:]).filter(mask)

        return run

    return map_arrow(rows, start, renamed.schema).toDF(*names)


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Whether a table is small; reads no more of it than needed."""
    return df.limit(rows + 1).count() <= rows


# ------------------------------------------------------------------ hashing of words, vectorised
_RNG = np.random.RandomState(20_011)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: _MASK[n] keeps the first n of 8 bytes
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of more bytes are hashed and compared one by one.
LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words in one buffer, by where they begin and end, to be read 8 bytes at a time. raw has 8 bytes more than it needs."""

    def __init__(self, raw: bytes, starts: np.ndarray, ends: np.ndarray):
        self.raw, self.starts, self.ends, self.size = raw, starts, ends, ends - starts
        self._hashes: np.ndarray | None = None
        self._eight = np.lib.stride_tricks.as_strided(np.frombuffer(raw, "<u8", 1), (len(raw) - 7,), (1,))

    @classmethod
    def of(cls, docs: list[bytes]) -> tuple[Words, np.ndarray]:
        """The words between white space, and where each document's words begin (one more entry than documents)."""
        raw = b" ".join([b"", *docs, b" " * 8])
        space = _SPACE[np.frombuffer(raw, np.uint8)]
        at = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts = at[0::2]
        return cls(raw, starts, at[1::2]), np.searchsorted(starts, np.cumsum([1, *(len(d) + 1 for d in docs)]))

    def word(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]]

    def _block(self, who: np.ndarray, k: int) -> np.ndarray:
        """Bytes k to k + 8 of words, zeros after their ends."""
        return self._eight[self.starts[who] + k] & _MASK[np.clip(self.size[who] - k, 0, 8)]

    def hashes(self) -> np.ndarray:
        """A block after another is mixed in, so no algebra of the bytes makes two words collide."""
        if self._hashes is None:
            self._hashes = self._hashed()
        return self._hashes

    def _hashed(self) -> np.ndarray:
        out = mix(self.size.astype(np.uint64) * _P + np.uint64(1))
        left, k = np.flatnonzero(self.size <= LONG_WORD), 0
        while len(left):
            out[left] = mix(out[left] * _P + self._block(left, k))
            k += 8
            left = left[self.size[left] > k]
        for i in np.flatnonzero(self.size > LONG_WORD).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.word(i))
        return out

    def same(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the words a are the words b, byte by byte."""
        if (self.size[a] != self.size[b]).any():
            return False
        long = (self.size[a] > LONG_WORD) & (a != b)
        if any(self.word(i) != self.word(j) for i, j in zip(a[long].tolist(), b[long].tolist(), strict=True)):
            return False
        a, b, k = a[~long], b[~long], 0
        while len(a):
            if (self._block(a, k) != self._block(b, k)).any():
                return False
            k += 8
            more = self.size[a] > k
            a, b = a[more], b[more]
        return True


    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Each word's place among the distinct ones, and which word is the first of each.

        Words of equal hash are compared byte by byte; if any two differ they are told apart by the words themselves."""
        codes, distinct = pd.factorize(self.hashes())
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        if not self.same(np.arange(len(codes)), first[codes]):
            codes, chunks = pd.factorize(np.array([self.word(i) for i in range(len(codes))], object))
            first = np.empty(len(chunks), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        return codes, first


def word_hashes(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each document's words begin (one more entry than documents)."""
    words, offsets = Words.of(docs)
    return words.hashes(), offsets


def distinct_words(docs: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The batch's distinct words, each word's place among them, and where each document's words begin."""
    words, offsets = Words.of(docs)
    codes, first = words.distinct()
    return [words.raw[a:z] for a, z in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)], codes, offsets


_Q = _RNG.randint(0, 2**62, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words; of the whole sequence if there are fewer words, but some."""
    if not len(words):
        return words
    if len(words) < n:
        return mix((words * _Q[: len(words)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words)))
    out = words[: len(words) - n + 1] * _Q[0]
    for k in range(1, n):
        out += words[k : len(words) - n + 1 + k] * _Q[k]
    return mix(out)
