"""Exact top-k search by a three-phase uniform threshold (operator 9).

Each vector is split over m nodes (runs of its components); a node's local score is the inner product of its run, and
a candidate's score is the sum over the nodes. Candidates are dealt into shards, queries meet each shard in blocks.

1. In each shard every node lists its best ``LISTED`` local scores for each query; only totals of what is listed are
   made. The k-th best of them, over all shards, is a safe cutoff T: k candidates reach it. Beside the totals a
   shard tells the least local score that a list goes down to.
2. A candidate that reaches T has a local score of T / m or more at some node. Where every node's list goes below
   T / m, nothing is missing. Only the other pairs of query and shard are looked at again, with T: there the nodes
   collect all entries of T / m or more, leaving out candidates whose length bounds their local scores below that.
3. Of the entries collected the remaining local scores are resolved, exactly, in integers; those whose total
   reaches T go to the final merge, by score and then smaller id.

Vectors that are equal are one candidate, with the k + 1 smallest of their ids, so a third of all rows may be
the same vector. Queries are a stated set; a shard is held by its task and the blocks of queries pass by it.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a
null id; of rows that repeat an id the smallest vector counts; vectors of fewer components are filled up by
zeros; components of 2 ** 63 / 64 and more are cut off there; with fewer candidates than k all are given; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolith.llm.common import map_arrow, written

NODES, LISTED, QUERIES = 2, 128, 1024
#: Rows of a shard, and bytes of its vectors in eight bytes a component.
SHARD_ROWS, SHARD_BYTES = 1 << 15, 32 << 20
#: Products of queries and candidates that are held at once.
HELD = 1 << 22


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v: array<long>) of the rows that take part, one an id."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ~F.coalesce(bad, F.lit(True)))
    v = F.transform(vec_col, lambda x: F.floor(F.lit(scale).cast("double") * x.cast("double")))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _blocks(df: DataFrame, dim: int, narrow: bool) -> DataFrame:
    """(b, ids, vecs, cut): the rows of each block as binaries. df: (b, rep, v, cut)."""
    kind = np.int16 if narrow else np.int64

    def make():
        held: list[tuple] = []
        key: list = [None]

        def block() -> tuple:
            m = np.zeros((len(held), dim), kind)
            for i, (_, v, _) in enumerate(held):
                m[i, : len(v)] = v
            row = (key[0], np.array([x[0] for x in held], np.int64).tobytes(), m.tobytes(), np.array([x[2] for x in held], np.int64).tobytes())
            held.clear()
            return row

        def table(rows: list[tuple]) -> pa.RecordBatch | None:
            if not rows:
                return None
            b, ids, vecs, cut = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(ids, pa.binary()), pa.array(vecs, pa.binary()), pa.array(cut, pa.binary())], names=["b", "ids", "vecs", "cut"])

        def run(batch: pa.RecordBatch):
            for b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key[0] != b or len(held) == SHARD_ROWS:
                    if held:
                        yield table([block()])
                    key[0] = b
                held.append(tuple(row))

        def close():
            yield table([block()] if held else [])

        run.close = close
        return run

    return map_arrow(df.select("b", "rep", "v", "cut").repartition("b").sortWithinPartitions("b", "rep"), make, "b long, ids binary, vecs binary, cut binary")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of a node's run, exact: in floating point only where every sum is below 2 ** 53."""
    most = lambda x: max(float(x.max()), -float(x.min()))
    if a.size and b.size and most(a) * most(b) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _best(keys: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row."""
    if keys.shape[1] <= k:
        return np.tile(np.arange(keys.shape[1]), (len(keys), 1))
    return np.argpartition(keys, keys.shape[1] - k, axis=1)[:, -k:]


def _listed(local: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1, of queries against a shard: places and totals of the k best of what the nodes list, and what the lists go down to.

    Places are in the order of ids, and of equal totals the smaller place is taken: one that is left out here is not looked for again."""
    lowest = np.iinfo(np.int64).min
    deep = max(LISTED, k)  # so with fewer than k totals all candidates are listed
    some = [_best(p, deep) for p in local]
    floor = np.max([np.take_along_axis(p, x, 1).min(1) for p, x in zip(local, some, strict=True)], axis=0) if local[0].shape[1] > deep else np.full(len(local[0]), lowest)
    some = np.sort(np.concatenate(some, axis=1), axis=1)
    total = sum(np.take_along_axis(p, some, 1) for p in local)
    total[:, 1:][some[:, 1:] == some[:, :-1]] = lowest  # listed by two nodes
    top = np.argsort(~total, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(some, top, 1), np.take_along_axis(total, top, 1), floor


def _collected(q: list[np.ndarray], c: list[np.ndarray], cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3: (query, candidate, total) of the entries of T / m or more at a node whose totals reach T. q, c: by node."""
    m, enough = len(q), None
    least = cuts.min()
    length = lambda x: np.sqrt((x.astype(np.float64) ** 2).sum(1))
    near = np.zeros(len(c[0]), bool)
    for a, b in zip(q, c, strict=True):
        near |= m * (length(a).max() * length(b)) * (1 + 1e-9) >= least
    at = np.flatnonzero(near)
    local = [_products(a, b[at]) for a, b in zip(q, c, strict=True)]
    enough = np.zeros(local[0].shape, bool)
    for p in local:
        enough |= m * p >= cuts[:, None]
    i, j = np.nonzero(enough)
    total = sum(p[i, j] for p in local)
    reach = total >= cuts[i]
    return i[reach], at[j[reach]], total[reach]


def _phase(cells: DataFrame, dim: int, narrow: bool, k: int, cut: bool) -> DataFrame:
    """(query, shard, candidate, score): totals of what is listed, and with candidate null what the lists go down to (cut: the totals that reach the cutoff).

    cells: (shard, is_query, ids, vecs, cut); a shard's candidates come before the queries that it meets."""
    kind = np.int16 if narrow else np.int64
    step = -(-dim // NODES)
    nodes = [slice(s, min(dim, s + step)) for s in range(0, dim, step)]

    def make():
        state: dict = {"shard": None, "parts": []}

        def table(shard, q, c, s) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(np.full(len(q), shard), pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.int64())], names=["query", "shard", "candidate", "score"])

        def run(batch: pa.RecordBatch):
            for shard, query, ids, vecs, cuts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m, n = np.frombuffer(vecs, kind).reshape(-1, dim), np.frombuffer(ids, np.int64)
                if not query:
                    if state["shard"] != shard:
                        state.update(shard=shard, parts=[])
                    state["parts"].append(([np.ascontiguousarray(m[:, s]) for s in nodes], n))
                    continue
                if state["shard"] != shard:
                    continue  # a shard without candidates
                own, cuts = [m[:, s] for s in nodes], np.frombuffer(cuts, np.int64)
                for part, who in state["parts"]:
                    rows = max(1, HELD // len(who))
                    for a in range(0, len(n), rows):
                        q, of = [x[a : a + rows] for x in own], n[a : a + rows]
                        if cut:
                            i, j, total = _collected(q, part, cuts[a : a + rows])
                            if len(i):
                                yield table(shard, of[i], who[j], total)
                            continue
                        at, total, floor = _listed([_products(x, y) for x, y in zip(q, part, strict=True)], k)
                        i, j = np.nonzero(total != np.iinfo(np.int64).min)
                        yield table(shard, of[i], who[at[i, j]], total[i, j])
                        more = np.flatnonzero(floor != np.iinfo(np.int64).min)
                        if len(more):
                            yield table(shard, of[more], [None] * len(more), floor[more])

        return run

    rows = cells.repartition("shard").sortWithinPartitions("shard", "is_query").select("shard", "is_query", "ids", "vecs", "cut")
    return map_arrow(rows, make, "query long, shard long, candidate long, score long")


def exact_top_k(df: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose id is divisible by ``every``, its k best other rows."""
    rows = written(quantised(df, id_col, vec_col, scale), "topk-rows")
    near = Window.partitionBy("v").orderBy("vec_id")
    some = rows.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1)  # k + 1 ids a vector
    classes = written(some.groupBy("v").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "topk-classes")
    queries = rows.where(F.col("vec_id") % every == 0)
    queries = written(queries.join(classes.select("v", "rep"), "v").select("vec_id", "rep"), "topk-queries")
    asked = written(queries.select("rep").distinct().join(classes.select("rep", "v"), "rep"), "topk-asked")
    n, dim, low, high = classes.agg(F.count("*"), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    nq = asked.count()
    dim, narrow = dim or 1, n > 0 and -(2**15) <= low and high < 2**15
    # shards are filled to three quarters on average, so that few are cut in two
    shards = max(1, -(-4 * n // (3 * max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * dim))))))
    none = F.lit(0).cast("long").alias("cut")
    base = _blocks(classes.select(F.expr(f"pmod(xxhash64(rep), {shards}L)").alias("b"), "rep", "v", none), dim, narrow)
    base = written(base.select(F.col("b").alias("shard"), F.lit(False).alias("is_query"), "ids", "vecs", "cut"), "topk-shards")
    q = _blocks(asked.select(F.expr(f"pmod(xxhash64(rep), {max(1, -(-nq // QUERIES))}L)").alias("b"), "rep", "v", none), dim, narrow)
    q = q.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(True).alias("is_query"), "ids", "vecs", "cut")

    # equal vectors are one class, and a class's own id is left out at the end, so k + 1 classes are wanted
    best = Window.partitionBy("query").orderBy(F.desc("score"), "candidate")
    first = written(_phase(base.unionByName(q), dim, narrow, k + 1, cut=False), "topk-listed")
    listed = first.where("candidate is not null").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r", "shard")
    listed = written(listed, "topk-best")
    cuts = listed.groupBy("query").agg(F.count("*").alias("m"), F.min("score").alias("cut")).where(F.col("m") == k + 1).select("query", "cut")
    # floor(T / m) <= the least that a list goes down to: entries may be missing
    again = first.where("candidate is null").join(cuts, "query").where(F.col("score") * NODES >= F.col("cut")).select("query", "shard", "cut").distinct()
    again = written(again, "topk-again")
    if not again.isEmpty():
        more = again.join(asked.withColumnRenamed("rep", "query"), "query").select(F.col("shard").alias("b"), F.col("query").alias("rep"), "v", "cut")
        more = _blocks(more, dim, narrow).select(F.col("b").alias("shard"), F.lit(True).alias("is_query"), "ids", "vecs", "cut")
        cells = base.join(again.select("shard").distinct(), "shard", "left_semi").unionByName(more)
        found = _phase(cells, dim, narrow, k + 1, cut=True).select("query", "candidate", "score").unionByName(listed).distinct()
        listed = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    ids = listed.join(classes.select(F.col("rep").alias("candidate"), "ids"), "candidate").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("top"))
    lists = written(lists, "topk-lists")
    out = queries.withColumnRenamed("vec_id", "query_id").join(lists, queries.rep == lists.query)
    own = F.expr(f"slice(filter(top, x -> x.vec_id != query_id), 1, {k})")
    return out.select("query_id", F.posexplode(own).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


# DuckDB: the same answer by brute force.
ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64e0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
