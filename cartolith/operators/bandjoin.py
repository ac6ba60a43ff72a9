"""Pairs of points within a distance, by an equi-join on grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.plans.iterate import saved


#: Distinct points of a cell that are too many to meet each other.
CROWD = 512


def _celled(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return df.withColumn("_cx", F.floor(F.col(x) / size)).withColumn("_cy", F.floor(F.col(y) / size))


def _spread(df: DataFrame) -> DataFrame:
    """Each row in its own cell and the eight around it."""
    near = F.sequence(F.lit(-1), F.lit(1))
    return df.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near)).withColumn("_cx", F.col("_cx") + F.col("_dx")).withColumn("_cy", F.col("_cy") + F.col("_dy")).drop("_dx", "_dy")


def band_join(a: DataFrame, b: DataFrame, radius: float, ax: str, ay: str, bx: str, by: str, how: str = "inner") -> DataFrame:
    """Rows of a with rows of b no farther than radius, and their distance d; how: inner or left_semi.

    Column names of a and b must differ. Each point meets the nine cells around it only, so work grows with
    the pairs in neighbouring cells, not with all pairs."""
    if radius <= 0:
        raise ValueError("the radius must be positive")
    left, right = _celled(a, ax, ay, radius), _spread(_celled(b, bx, by, radius)).withColumnsRenamed({"_cx": "_rx", "_cy": "_ry"})
    d = F.hypot(F.col(ax) - F.col(bx), F.col(ay) - F.col(by))
    on = (F.col("_cx") == F.col("_rx")) & (F.col("_cy") == F.col("_ry")) & (d <= radius)
    out = left.join(right, on, how).drop("_cx", "_cy", "_rx", "_ry")
    return out if how == "left_semi" else out.withColumn("d", d)


def nearest_distance(points: DataFrame, id_col: str, x: str, y: str) -> DataFrame:
    """(id, d) of each point: the distance to the nearest other one; null if there is none.

    Points of one place are at 0 of each other; places of one point meet the places around them. Cells begin at about two places
    each, and at a quarter of the width as long as one has more than ``CROWD``, so places that lie close are settled in small
    cells; places whose nearest neighbour may be farther than a cell is wide are looked at again with cells of twice
    the width, so the number of rounds is logarithmic in the extent."""
    points = points.select(F.col(id_col).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    places = saved(points.groupBy("x", "y").agg(F.count("*").alias("k")), "places")
    n, many, x0, x1, y0, y1 = places.agg(F.coalesce(F.sum("k"), F.lit(0)), F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if n < 2:
        return points.select("id", F.lit(None).cast("double").alias("d"))
    extent = max(x1 - x0, y1 - y0)
    size = max(extent / max(1.0, (many / 2) ** 0.5), extent * 1e-9) or 1.0
    left, done = places.where("k = 1").select("x", "y"), [places.where("k > 1").select("x", "y", F.lit(0.0).alias("d"))]
    found = left.isEmpty()
    while not found and size > extent * 1e-9 and (_celled(places, "x", "y", size).groupBy("_cx", "_cy").count().agg(F.max("count")).first()[0] or 0) > CROWD:
        size /= 4
    while not found:
        other = _spread(_celled(places.select(F.col("x").alias("ox"), F.col("y").alias("oy")), "ox", "oy", size))
        d = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
        best = saved(_celled(left, "x", "y", size).join(other, ["_cx", "_cy"], "left").groupBy("x", "y").agg(F.min(F.when(d > 0, d)).alias("d")))
        far = size > 2 * extent
        done.append(best.where("d is not null" if far else F.col("d") <= size))
        left = best.where(F.col("d").isNull() | (F.col("d") > size)).select("x", "y")
        found = far or left.isEmpty()
        size *= 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return points.distinct().join(out, ["x", "y"]).select("id", "d")
