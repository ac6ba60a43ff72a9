"""Embedding, vector store, and cosine top-k with a box before it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolith.functions import geometry as g
from cartolith.operators.spatial_query import within_distance
from cartolith.plans.iterate import saved


def hash_vector(text: str, dim: int = 384) -> list[float]:
    """Deterministic unit vector of a text: a private generator seeded by its MD5."""
    seed = int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    v = np.random.RandomState(seed).randn(dim)
    return (v / np.linalg.norm(v)).tolist()


def hash_embedding(dim: int = 384) -> Callable[[Column], Column]:
    @F.pandas_udf("array<double>")
    def embed(text: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(text.fillna(""))  # a text's generator is run once a batch
        vectors = [hash_vector(t, dim) for t in distinct]
        return pd.Series([vectors[i] for i in codes])

    return embed


class EmbeddingManager:
    """Texts by a given provider (Column -> Column), else by hashing; images by a given provider only."""

    def __init__(self, text_provider: Callable[[Column], Column] | None = None, image_provider: Callable[[Column], Column] | None = None, dim: int = 384):
        self.text, self.image = text_provider or hash_embedding(dim), image_provider

    def embed_texts(self, df: DataFrame, column: str) -> DataFrame:
        return df.withColumn("embedding", self.text(F.col(column)))

    def embed_images(self, df: DataFrame, column: str) -> DataFrame:
        if self.image is None:
            raise NotImplementedError("no image model is installed")
        return df.withColumn("embedding", self.image(F.col(column)))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a, b) -> Column:
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def top_k(store: DataFrame, query: list[float], k: int = 5, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """The k nearest by cosine distance, ties to the smaller id: one pass and a bounded merge."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return store.withColumn("distance", cosine_distance(vector, q)).orderBy("distance", id_col).limit(k)


#: Queries that are sent to all tasks together, and bytes of their vectors.
MOST_QUERIES, MOST_BYTES = 50_000, 64 << 20
#: What products of matrices may err by, beside sums from left to right, of vectors of norm 1.
NEAR = 1e-9


def _by_length(vectors: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix); length 0: vectors that are null, empty or hold a null."""
    size = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
    flat = vectors.flatten()
    ends = np.cumsum(size)
    odd = size == 0
    if flat.null_count:
        odd[np.searchsorted(ends, np.flatnonzero(np.asarray(flat.is_null())), "right")] = True
    flat = np.asarray(flat.fill_null(0)).astype(np.float64)
    out = [(0, np.flatnonzero(odd), np.empty((int(odd.sum()), 0)))] if odd.any() else []
    for d in np.unique(size[~odd]).tolist():
        at = np.flatnonzero(~odd & (size == d))
        out.append((d, at, flat[(ends[at] - d)[:, None] + np.arange(d)]))
    return out


def _left_to_right(products: np.ndarray) -> np.ndarray:
    return np.cumsum(products, axis=1)[:, -1]


class _Vectors:
    """Vectors of one length: their norms, and which of them a product of matrices is good for."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.norm = matrix, np.sqrt(_left_to_right(matrix * matrix))
        self.plain = np.flatnonzero((self.norm > 1e-100) & (self.norm < 1e100))
        self.odd = np.flatnonzero(~((self.norm > 1e-100) & (self.norm < 1e100)))
        self.unit = matrix[self.plain] / self.norm[self.plain, None]


class _Nearest:
    """Of each query the k nearest rows so far. kind: 0 a number, 1 NaN, 2 no distance, in this order; of equals the earlier row."""

    def __init__(self, queries: pa.Array, k: int):
        self.k, self.groups = k, [(d, at, _Vectors(x) if d else None) for d, at, x in _by_length(queries)]
        self.limit = np.full(len(queries), -np.inf)  # similarity of the k-th so far
        empty = np.empty(0, np.int64)
        self.best = empty, empty, np.empty(0), empty  # query, kind, distance, row

    def _exact(self, q: _Vectors, x: _Vectors, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
        dots = [_left_to_right(q.matrix[qi[a : a + 65_536]] * x.matrix[xi[a : a + 65_536]]) for a in range(0, len(qi), 65_536)]
        both = q.norm[qi] * x.norm[xi]
        return 1 - np.concatenate([np.empty(0), *dots]) / np.where(both == 0, 1.0, both), both == 0

    def _met(self, at: np.ndarray, q: _Vectors, x: _Vectors):
        """(query, row) of one length that can be among the nearest, in parts."""
        for a in range(0, len(q.plain), 256):
            some = slice(a, a + 256)
            like = q.unit[some] @ x.unit.T
            low = self.limit[at[q.plain[some]]]
            if like.shape[1] > self.k:
                low = np.maximum(low, np.partition(like, like.shape[1] - self.k, axis=1)[:, -self.k] - NEAR)
            qi, xi = np.nonzero(like >= low[:, None])
            yield q.plain[some][qi], x.plain[xi]
        if len(x.odd):
            yield np.repeat(q.plain, len(x.odd)), np.tile(x.odd, len(q.plain))
        for i in q.odd.tolist():
            yield np.full(len(x.norm), i), np.arange(len(x.norm))

    def add(self, vectors: pa.Array, first: int) -> None:
        """Rows in rising order, numbered from first."""
        for d, rows, matrix in _by_length(vectors):
            if d:  # of equal vectors no more than k count
                _, codes = np.unique(matrix.view(f"V{8 * d}").ravel(), return_inverse=True)
                order = np.argsort(codes, kind="stable")
                sorted_ = codes[order]
                kept = np.sort(order[np.arange(len(order)) - np.searchsorted(sorted_, sorted_) < self.k])
                rows, x = rows[kept], _Vectors(matrix[kept])
            for e, at, q in self.groups:
                if d != e or not d:  # no distance
                    some = rows[: self.k]
                    self._keep(np.repeat(at, len(some)), np.full(len(at) * len(some), 2), np.zeros(len(at) * len(some)), first + np.tile(some, len(at)))
                    continue
                for qi, xi in self._met(at, q, x):
                    distance, none = self._exact(q, x, qi, xi)
                    kind = np.where(none, 2, np.isnan(distance))
                    self._keep(at[qi], kind, np.where(kind > 0, 0.0, distance), first + rows[xi])

    def _keep(self, *more: np.ndarray) -> None:
        asked = np.unique(more[0])
        old = np.isin(self.best[0], asked)
        query, kind, distance, row = (np.concatenate([b[old], m]) for b, m in zip(self.best, more, strict=True))
        order = np.lexsort((row, distance, kind, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        order, query = order[rank < self.k], query[rank < self.k]
        new = query, kind[order], distance[order], row[order]
        last = rank[rank < self.k] == self.k - 1
        full = last & (new[1] == 0)
        self.limit[new[0][full]] = 1 - new[2][full] - NEAR
        self.best = tuple(np.concatenate([b[~old], n]) for b, n in zip(self.best, new, strict=True))


def top_k_batch(store: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """For queries (query_id, query_vector) the k nearest by cosine distance, ties to the smaller id, rows without a distance last.

    Queries are broadcast in batches, at most ``MOST_QUERIES`` of them. A task meets its rows in the order of ids: products of
    matrices tell which can be among the nearest, whose distances are then added up from left to right; each
    task gives the k nearest of its rows."""
    spark = store.sparkSession
    rows = saved(store.withColumn("_row", F.monotonically_increasing_id()), "store")
    asked = saved(queries.select("query_id", "query_vector").withColumn("_q", F.monotonically_increasing_id()), "queries")
    size, n = asked.agg(F.coalesce(F.max(F.size("query_vector")), F.lit(0)), F.count("*")).first()
    batches = -(-n // max(1, min(MOST_QUERIES, MOST_BYTES // (8 * max(1, size))))) or 1
    dealt = rows.select("_row", F.col(id_col).alias("_id"), F.col(vector).alias("_v")).repartition(4 * spark.sparkContext.defaultParallelism).sortWithinPartitions("_id").select("_row", "_v")

    def nearest(some: DataFrame) -> DataFrame:
        table = some.select("_q", F.col("query_vector").cast("array<double>")).toArrow().combine_chunks()
        sent = spark.sparkContext.broadcast((np.asarray(table.column(0)), table.column(1).combine_chunks()))

        def run(parts):
            ids, vectors = sent.value
            found, keys, first = _Nearest(vectors, k), [], 0
            for b in parts:
                found.add(b.column(1), first)
                keys.append(np.asarray(b.column(0)))
                first += len(keys[-1])
            if keys:
                query, kind, distance, row = found.best
                distance = pa.array(np.where(kind == 1, np.nan, distance), mask=kind == 2, from_pandas=False)
                yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(np.concatenate(keys)[row]), distance], ["_q", "_row", "distance"])

        return dealt.mapInArrow(run, "_q long, _row long, distance double")

    found = nearest(asked if batches == 1 else asked.where(F.pmod(F.xxhash64("_q"), F.lit(batches)) == 0))
    for i in range(1, batches):
        found = found.unionByName(nearest(asked.where(F.pmod(F.xxhash64("_q"), F.lit(batches)) == i)))
    w = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "_id")
    ids = rows.select("_row", F.col(id_col).alias("_id"))
    best = found.join(asked.select("_q", "query_id"), "_q").join(ids, "_row")
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return rows.join(best.select("_row", "query_id", "distance", "rank"), "_row").drop("_row")


class VectorStore:
    """(id, embedding, metadata, document) in Parquet; every change is a new version, the latest is read."""

    def __init__(self, spark: SparkSession, path: str, dim: int | None = None):
        self.spark, self.path, self.dim = spark, path.rstrip("/"), dim

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        done = [n for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in done)

    def read(self) -> DataFrame | None:
        v = self._versions()
        return self.spark.read.parquet(f"{self.path}/v{v[-1]}") if v else None

    def _write(self, df: DataFrame) -> None:
        v = self._versions()
        df.write.mode("overwrite").parquet(f"{self.path}/v{v[-1] + 1 if v else 0}")

    def add(self, rows: DataFrame) -> None:
        """Rows whose id is there already are not added; of rows that repeat an id one is."""
        rows, old = rows.dropDuplicates(["id"]), self.read()
        self._write(rows if old is None else add_rows(old, rows))

    def delete(self, ids: list[str]) -> None:
        if (old := self.read()) is not None:
            self._write(delete_rows(old, self.spark.createDataFrame([(i,) for i in ids], old.select("id").schema)))

    def query(self, query: list[float], n_results: int = 5, where: Column | None = None) -> DataFrame:
        old = self.read()
        if old is None:
            raise AnalysisException("the store is empty")
        return top_k(old if where is None else old.where(where), query, n_results)


def add_rows(store: DataFrame, rows: DataFrame, id_col: str = "id") -> DataFrame:
    return store.unionByName(rows.join(store.select(id_col), id_col, "left_anti"), allowMissingColumns=True)


def delete_rows(store: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return store.join(ids, id_col, "left_anti")


class RetrievalEngine:
    def __init__(self, store: DataFrame, images: DataFrame | None = None, id_col: str = "id", embed: Callable[[str], list[float]] = hash_vector):
        self.store, self.images, self.id_col, self.embed = store, images, id_col, embed

    def _search(self, store: DataFrame, vector: list[float], n: int, bbox: tuple | None) -> DataFrame:
        if bbox:
            store = store.where(g.boxes_overlap(*bbox))
        return top_k(store, vector, n, self.id_col)

    def semantic_search(self, query: str | list[float], n_results: int = 5, bbox: tuple | None = None) -> DataFrame:
        return self._search(self.store, self.embed(query) if isinstance(query, str) else query, n_results, bbox)

    def image_search(self, vector: list[float], n_results: int = 5, bbox: tuple | None = None) -> DataFrame:
        if self.images is None:
            return top_k(self.store.limit(0), vector, n_results, self.id_col)
        return self._search(self.images, vector, n_results, bbox)

    def hybrid_search(self, query: str | list[float], lat: float, lon: float, radius_km: float, n_results: int = 10, x: str = "minx", y: str = "miny") -> DataFrame:
        """Semantic search among what is within the radius."""
        near = within_distance(self.store, lat, lon, radius_km * 1000, x, y)
        return top_k(near, self.embed(query) if isinstance(query, str) else query, n_results, self.id_col)


def threshold(results: DataFrame, least: float = 0.5) -> DataFrame:
    """After the top k: rows whose similarity is at least so much."""
    return results.withColumn("similarity", 1 - F.col("distance")).where(F.col("similarity") >= least)


def assemble_context(results: DataFrame, id_col: str = "id") -> DataFrame:
    """The results with their rank from 1. They are few: what a top k gave."""
    return results.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)))


#: Saved example queries: kind, text, parameters.
EXAMPLES = [
    ("semantic", "cities near water", {}), ("semantic", "mountain areas", {}), ("semantic", "dense urban districts", {}), ("semantic", "historic places", {}),
    ("range", "within 50 km of a point", {"lat": 40.7128, "lon": -74.006, "radius_km": 50.0}), ("range", "within 10 km of a point", {"lat": 51.5074, "lon": -0.1278, "radius_km": 10.0}),
    ("bbox", "a box", {"min_lat": 40.0, "min_lon": -75.0, "max_lat": 41.0, "max_lon": -73.0}),
]

