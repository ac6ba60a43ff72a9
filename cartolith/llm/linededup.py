"""Reversible line deduplication: sharded cuckoo filters over exact reference counts (operator 7).

An index of lines is three tables in the shared folder, each a list of versions of which the last counts: postings
(line key, doc_id, whether it is gone), reference counts (line key: documents that hold it, largest of their ids), and one
cuckoo filter a shard with the keys that enough documents hold. Keys are 128-bit hashes of the line
stripped and lower-cased. Inserting documents or deleting them writes their own postings, the counts of the keys they
hold, and the filters of the shards where a key's count crosses the limit, into which it is inserted or deleted; all else
stays as it is. Versions are folded into one now and then. Deleting what was inserted gives the former answers
again. Shards are split in two by a new build when they hold twice the keys they are meant for.

Lines are judged by the filters first: postings go to their shard's filter, spread over ``SPREAD`` copies of it, so that a
line that a third of all documents hold is not one task's; the few that pass meet the counts, which
decide exactly. This is the same at any size.

Defined cases: a null or empty text is one empty line; keys of fewer code points than the limit are never
dropped; rows that repeat a doc_id are that one document; rows with a null doc_id are not counted and keep
all lines; if all lines go the text is empty; other columns, of any name, are kept as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm.common import batch, map_arrow, mix, utf8, written

SLOTS = 4
#: Keys to a shard, about; a shard's filter is a few times as many bytes.
SHARD_KEYS = 4096
#: Copies of a filter over which its postings are spread.
SPREAD = 16
#: Versions of a table after which they are folded into one.
FOLD = 8


class CuckooFilter:
    """Set of 64-bit hashes with deletion: 16-bit fingerprints in buckets of four, each in one of two buckets."""

    def __init__(self, buckets: int = 16):
        self.table = np.zeros((max(2, 1 << (buckets - 1).bit_length()), SLOTS), np.uint16)

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        out = cls(2)
        out.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return out

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(np.asarray(hashes, np.int64).view(np.uint64))
        print_ = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return print_, first, self._other(first, print_)

    def _other(self, bucket, print_):
        return bucket ^ (mix(np.asarray(print_, np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        p, a, b = self._places(hashes)
        return (self.table[a] == p[:, None]).any(1) | (self.table[b] == p[:, None]).any(1)

    def insert(self, hashes: np.ndarray) -> bool:
        """False if it is too full; then it is no longer sound and has to be built anew, larger."""
        p, a, b = self._places(hashes)
        left = np.arange(len(p))
        for at in (a, b):
            for _ in range(SLOTS):  # at most one a bucket and round
                bucket, who = np.unique(at[left], return_index=True)
                slot = (self.table[bucket] == 0).argmax(1)
                free = self.table[bucket, slot] == 0
                self.table[bucket[free], slot[free]] = p[left[who[free]]]
                left = np.delete(left, who[free])
        rng = np.random.RandomState(len(left))
        for i in left:
            bucket, mark = int(a[i]), p[i]
            for _ in range(500):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = mark
                    break
                k = rng.randint(SLOTS)
                self.table[bucket, k], mark = mark, self.table[bucket, k]
                bucket = int(self._other(np.array([bucket]), np.array([mark]))[0])
            else:
                return False
        return True

    def delete(self, hashes: np.ndarray) -> None:
        """Only of hashes that were inserted."""
        for p, a, b in zip(*self._places(hashes), strict=True):
            for bucket in (a, b):
                at = np.flatnonzero(self.table[bucket] == p)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break

    @classmethod
    def build(cls, hashes: np.ndarray) -> CuckooFilter:
        hashes = np.unique(hashes)  # more than eight equal ones fit no filter
        size = max(2, len(hashes) // 3)
        while True:
            out = cls(size)
            if out.insert(hashes):
                return out
            size *= 2


def line_key(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """The 128-bit key of a line as two signed integers; None if it is too short."""
    key = line.strip().lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    d = xxhash.xxh3_128_digest(key)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class LineIndex:
    """Versions, oldest first. postings: (k1, k2, doc_id, gone); counts: (k1, k2, n, last); filters: (shard, data), which begin anew when shards are split."""

    def __init__(self, spark: SparkSession, min_docs: int = 3, min_chars: int = 20):
        self.spark, self.min_docs, self.min_chars = spark, min_docs, min_chars
        self.shards, self.often = 1, 0
        self.versions: dict[str, list[DataFrame]] = {"postings": [], "counts": [], "filters": []}

    # ------------------------------------------------------------------ versions
    def _empty(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([], {"postings": "k1 long, k2 long, doc_id long, gone boolean", "counts": "k1 long, k2 long, n long, last long", "filters": "shard long, data binary"}[table])

    def _latest(self, table: str, of: DataFrame | None = None) -> DataFrame:
        """The rows that count, of some keys where ``of`` gives them."""
        keys = {"postings": ["k1", "k2", "doc_id"], "counts": ["k1", "k2"], "filters": ["shard"]}[table]
        some = [x if of is None else x.join(of, of.columns, "left_semi") for x in self.versions[table]] or [self._empty(table)]
        if len(some) > 1:
            rest = [c for c in some[0].columns if c not in keys]
            all_ = some[0].withColumn("_v", F.lit(0))
            for v, x in enumerate(some[1:], 1):
                all_ = all_.unionByName(x.withColumn("_v", F.lit(v)))
            one = all_.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_v").alias("x")).select(*keys, "x.*")
        else:
            one = some[0]
        return {"postings": lambda x: x.where("not gone"), "counts": lambda x: x.where("n > 0"), "filters": lambda x: x}[table](one)

    def _put(self, table: str, rows: DataFrame) -> DataFrame:
        out = written(rows.select(self._empty(table).columns), f"lines-{table}")
        self.versions[table].append(out)
        if len(self.versions[table]) > FOLD:
            self.versions[table] = [written(self._latest(table), f"lines-{table}")]
        return out

    @property
    def postings(self) -> DataFrame:
        return self._latest("postings").select("k1", "k2", "doc_id")

    @property
    def counts(self) -> DataFrame:
        return self._latest("counts")

    @property
    def filters(self) -> DataFrame:
        return self._latest("filters")

    # ------------------------------------------------------------------ changes
    def _postings_of(self, docs: DataFrame) -> DataFrame:
        least = self.min_chars

        def make():
            def run(b: pa.RecordBatch):
                keys, ids = [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    found = {k for line in set(t.split(b"\n")) if (k := line_key(line, least))}
                    keys += found
                    ids += [i] * len(found)
                k = np.array(keys, np.int64).reshape(-1, 2)
                yield batch(k1=k[:, 0].copy(), k2=k[:, 1].copy(), doc_id=pa.array(ids, pa.int64()))

            return run

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).where("doc_id is not null")
        return map_arrow(rows, make, "k1 long, k2 long, doc_id long")

    @staticmethod
    def _counted(postings: DataFrame) -> DataFrame:
        return postings.groupBy("k1", "k2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last"))

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents; those whose ids are there already only add lines."""
        first = not self.versions["postings"]
        return self._recount(self._put("postings", self._postings_of(docs).withColumn("gone", F.lit(False))), first)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Remove the documents of these ids (a column doc_id)."""
        ids = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        return self._recount(self._put("postings", self._latest("postings", ids).withColumn("gone", F.lit(True))))

    def _recount(self, changed: DataFrame, first: bool = False) -> LineIndex:
        """Counts and filters after a change of these postings. first: they are all there are."""
        if first:
            now = self._put("counts", self._counted(changed))
            self.often = self._often(now).count()
            return self._build()
        keys = written(changed.select("k1", "k2").distinct(), "lines-keys")
        was = self._latest("counts", keys).select("k1", "k2", F.lit(True).alias("was")).where(F.col("n") >= self.min_docs)
        counted = keys.join(self._counted(self._latest("postings", keys)), ["k1", "k2"], "left").select("k1", "k2", F.coalesce("n", F.lit(0)).alias("n"), "last")
        crossed = written(counted.join(was, ["k1", "k2"], "left").withColumn("now", F.col("n") >= self.min_docs).where("now != (was is not null)").select(self._shard(), "k1", "now"), "lines-crossed")
        self._put("counts", counted)
        self.often += crossed.agg(F.coalesce(F.sum(F.when(F.col("now"), 1).otherwise(-1)), F.lit(0))).first()[0]
        if self.often > 2 * SHARD_KEYS * self.shards:
            return self._build()

        def change(key, filters: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            k, now = rows.k1.to_numpy(np.int64), rows.now.to_numpy(bool)
            f = CuckooFilter.load(filters.data.iloc[0]) if len(filters) else CuckooFilter.build(k[:0])
            f.delete(k[~now])
            return pd.DataFrame({"shard": [key[0]], "data": [f.dump() if f.insert(k[now]) else None]})

        touched = crossed.select("shard").distinct()
        new = self._latest("filters", touched).groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(change, "shard long, data binary")
        new = written(new, "lines-changed")
        full = new.where("data is null").select("shard")
        if not full.isEmpty():  # these are built anew, larger, from the exact keys
            exact = self._often(self.counts).select(self._shard(), "k1").join(F.broadcast(full), "shard", "left_semi")
            new = new.where("data is not null").unionByName(self._built(exact))
        self._put("filters", new)
        return self

    def _shard(self):
        return F.pmod("k1", F.lit(self.shards)).cast("long").alias("shard")

    def _often(self, counts: DataFrame) -> DataFrame:
        return counts.where(F.col("n") >= self.min_docs)

    @staticmethod
    def _built(keys: DataFrame) -> DataFrame:
        """(shard, data) from (shard, k1); a shard has a few thousand keys."""

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": [pdf.shard.iloc[0]], "data": [CuckooFilter.build(pdf.k1.to_numpy(np.int64)).dump()]})

        return keys.groupBy("shard").applyInPandas(build, "shard long, data binary")

    def _build(self) -> LineIndex:
        """All filters from the exact keys, in as many shards as they need."""
        self.shards = max(16, -(-self.often // SHARD_KEYS))
        self.versions["filters"] = []
        self._put("filters", self._built(self._often(self.counts).select(self._shard(), "k1")))
        return self

    # ------------------------------------------------------------------ use
    def _passed(self, postings: DataFrame) -> DataFrame:
        """The postings (k1, k2, doc_id) whose key their shard's filter has."""
        spread = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("copy")
        none = F.lit(None).cast("long")
        rows = self.filters.select("shard", spread, "data", none.alias("k1"), none.alias("k2"), none.alias("doc_id"))
        asked = postings.select(self._shard(), F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).cast("int").alias("copy"), F.lit(None).cast("binary").alias("data"), "k1", "k2", "doc_id")

        def make():
            state: dict = {"key": None}

            def run(b: pa.RecordBatch):
                n = b.num_rows
                key = b.column(0).to_numpy() * SPREAD + b.column(1).to_numpy()
                has, keep = b.column(2).is_valid().to_numpy(zero_copy_only=False), np.zeros(n, bool)
                k1 = b.column(3).fill_null(0).to_numpy()
                edges = [0, *(np.flatnonzero((key[1:] != key[:-1]) | has[1:]) + 1).tolist(), n]
                for a, z in zip(edges, edges[1:], strict=False):
                    if z > a and has[a]:
                        state.update(key=key[a], filter=CuckooFilter.load(b.column(2)[a].as_py()))
                        a += 1
                    if z > a and state["key"] == key[a]:  # a shard without a filter has no such keys
                        keep[a:z] = state["filter"].contains(k1[a:z])
                yield pa.RecordBatch.from_arrays(list(b.columns[3:]), names=["k1", "k2", "doc_id"]).filter(pa.array(keep))

            return run

        dealt = rows.unionByName(asked).repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("data").isNull())
        return map_arrow(dealt.select("shard", "copy", "data", "k1", "k2", "doc_id"), make, "k1 long, k2 long, doc_id long")

    def dropped(self, postings: DataFrame | None = None) -> DataFrame:
        """(doc_id, drops: array of keys) of the documents that lose lines."""
        often = written(self._often(self.counts).select("k1", "k2", "last"), "lines-often")
        hits = self._passed(self.postings if postings is None else postings).join(often, ["k1", "k2"]).where("doc_id != last")
        return written(hits.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("drops")), "lines-drops")

    def apply(self, docs: DataFrame, make_batch, columns: list, schema: str) -> DataFrame:
        """make_batch(batch, outcomes) of all rows; columns of the batch; an outcome is (lines, dropped, kept bytes)."""
        least = self.min_chars
        joined = docs.select(*columns, F.col("doc_id").cast("long").alias("__id"), utf8().alias("__text"))
        joined = joined.join(self.dropped().withColumnRenamed("doc_id", "__id"), "__id", "left")

        def make():
            def run(b: pa.RecordBatch):
                out = []
                for t, drops in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True):
                    lines = t.split(b"\n")
                    if not drops:
                        out.append((len(lines), 0, t))
                        continue
                    gone = {(d["k1"], d["k2"]) for d in drops}
                    kept = [x for x in lines if line_key(x, least) not in gone]
                    out.append((len(lines), len(lines) - len(kept), b"\n".join(kept)))
                yield make_batch(b.select(list(range(2, b.num_columns))), out)

            return run

        return map_arrow(joined.select("drops", "__text", *[F.col(f"`{c}`") for c in joined.columns if c not in ("drops", "__text", "__id")]), make, schema)


def line_digest(df: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row."""

    def make_batch(b: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
        return batch(doc_id=b.column(0), n_lines=pa.array([x[0] for x in out], pa.int64()), n_dropped=pa.array([x[1] for x in out], pa.int64()), kept_sha256=[hashlib.sha256(x[2]).hexdigest() for x in out])

    index = LineIndex(df.sparkSession, min_docs, min_chars).insert(df)
    return index.apply(df, make_batch, [F.col("doc_id").cast("long").alias("doc_id")], "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def deduplicated(df: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """The rows with their remaining text, and n_chars, if there is such a column, counted anew; null texts stay null."""
    names = df.columns
    renamed = df.toDF(*[f"c{i}" for i in range(len(names))])
    text, id_, chars = (names.index(x) if x in names else None for x in ("text", "doc_id", "n_chars"))
    source = renamed.select("*", F.col(f"c{id_}").alias("doc_id"), F.col(f"c{text}").alias("text"))

    def make_batch(b: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
        columns, was = list(b.columns), b.column(text).is_valid()
        columns[text] = pa.array([x[2].decode() if ok else None for x, ok in zip(out, was.to_pylist(), strict=True)], pa.string())
        if chars is not None:
            old = columns[chars].to_pylist()
            columns[chars] = pa.array([len(x[2].decode()) if x[1] else n for x, n in zip(out, old, strict=True)], columns[chars].type)
        return pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(names))])

    index = LineIndex(df.sparkSession, min_docs, min_chars).insert(source)
    return index.apply(source, make_batch, [f"c{i}" for i in range(len(names))], renamed.schema).toDF(*names)


# DuckDB: the same answer by plain SQL.
ORACLE = r"""
WITH l AS (SELECT doc_id, i, line,
             translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
g AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT l.doc_id, l.i, l.line, (g.k IS NOT NULL AND l.doc_id <> g.last) AS gone FROM l LEFT JOIN g ON l.k = g.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
