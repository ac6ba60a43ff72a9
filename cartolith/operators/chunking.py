"""Chunks and index entries."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.operators.spatial_query import total_bounds
from cartolith.plans.iterate import saved


def grid_chunks(df: DataFrame, cell_size: float = 1.0, x: str = "lon", y: str = "lat") -> DataFrame:
    """Boxes that cover the bounds, x first; the last ones are cut at the bounds. None without extent."""
    b = total_bounds(df, x, y).where("maxx > minx and maxy > miny")
    n = lambda low, high: F.ceil((F.col(high) - F.col(low)) / cell_size).cast("long")
    cells = b.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n("minx", "maxx") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), n("miny", "maxy") - 1)))
    left, low = F.col("minx") + F.col("i") * cell_size, F.col("miny") + F.col("j") * cell_size
    return cells.select((F.col("i") * n("miny", "maxy") + F.col("j")).alias("chunk_id"), left.alias("minx"), low.alias("miny"), F.least(left + cell_size, "maxx").alias("maxx"), F.least(low + cell_size, "maxy").alias("maxy"))


def kmeans(df: DataFrame, k: int, x: str, y: str, seed: int = 42) -> tuple[DataFrame, list, float]:
    """Rows with a column cluster; centres; inertia. k is no more than the number of rows. Rows of one place are learned from as one, with their number as its weight."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    places = saved(rows.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").cast("double").alias("n")), "places")
    n = places.agg(F.sum("n")).first()[0]
    if not n:
        return rows.withColumn("cluster", F.lit(0)), [], 0.0
    data = lambda df, *at: VectorAssembler(inputCols=list(at), outputCol="_f").transform(df)
    model = KMeans(k=max(1, min(k, int(n))), seed=seed, featuresCol="_f", predictionCol="cluster", weightCol="n", maxIter=40).fit(data(places, "x", "y"))
    return model.transform(data(rows, x, y)).drop("_f"), [list(map(float, c)) for c in model.clusterCenters()], float(model.summary.trainingCost)


def kmeans_chunks(df: DataFrame, n_clusters: int = 10, x: str = "lon", y: str = "lat", seed: int = 42) -> DataFrame:
    rows, _, _ = kmeans(df, n_clusters, x, y, seed)
    return rows.groupBy(F.col("cluster").cast("long").alias("chunk_id")).agg(F.min(x).alias("minx"), F.min(y).alias("miny"), F.max(x).alias("maxx"), F.max(y).alias("maxy"))


def build_index(df: DataFrame, cell_size: float = 1.0, id_col: str = "feature_id", x: str = "lon", y: str = "lat") -> DataFrame:
    """One entry a feature: bounds, centroid, properties, and the cell by which a store can be partitioned."""
    props = [c for c in df.columns if c not in (id_col, x, y, "geometry")]
    pairs = [v for c in props for v in (F.lit(c), F.col(c).cast("string"))]
    return df.select(
        F.col(id_col).alias("id"), F.col(x).alias("minx"), F.col(y).alias("miny"), F.col(x).alias("maxx"), F.col(y).alias("maxy"), F.col(y).alias("centroid_lat"), F.col(x).alias("centroid_lon"),
        (F.create_map(*pairs) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("properties"),
        F.format_string("%d_%d", F.floor(F.col(x) / cell_size), F.floor(F.col(y) / cell_size)).alias("cell_id"),
    )


def index_metadata(index: DataFrame) -> DataFrame:
    """Entries as one flat map; properties override the entry's own keys."""
    own = ["minx", "miny", "maxx", "maxy", "centroid_lat", "centroid_lon"]
    base = F.create_map(*[v for c in own for v in (F.lit(c), F.col(c).cast("string"))])
    clean = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys("properties"), k))
    return index.select("id", F.map_concat(clean, "properties").alias("metadata"))


def index_features(df: DataFrame, embed, id_col: str = "feature_id", **names) -> DataFrame:
    """(id, embedding, metadata, document) of every feature, ready for the vector store. embed: Column of text -> Column of vector."""
    meta = index_metadata(build_index(df, id_col=id_col, **names))
    named = F.coalesce(F.col("name"), F.concat(F.lit("feature_"), F.col(id_col))) if "name" in df.columns else F.concat(F.lit("feature_"), F.col(id_col))
    text = df.select(F.col(id_col).alias("id"), named.alias("text"))
    return text.join(meta, "id").select(F.concat(F.lit("feat-"), F.col("id")).alias("id"), embed(F.col("text")).alias("embedding"), "metadata", F.concat(F.lit("Feature: "), "text").alias("document"))
