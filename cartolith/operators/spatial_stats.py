"""Density, clustering, hot spots, autocorrelation and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.operators.bandjoin import band_join, nearest_distance
from cartolith.operators.chunking import kmeans
from cartolith.operators.components import connected_components
from cartolith.operators.ordered import numbered
from cartolith.operators.spatial_query import total_bounds
from cartolith.plans.iterate import saved


def _cells(df: DataFrame, cell: float, x: str, y: str) -> DataFrame:
    """(i, j, x0, y0) of the density grid: origins from the lower bound, the last one of each axis left out."""
    n = lambda low, high: F.greatest(F.ceil((F.col(high) - F.col(low)) / cell).cast("long") - 1, F.lit(0).cast("long"))
    b = total_bounds(df, x, y).where("maxx is not null").withColumn("nx", n("minx", "maxx")).withColumn("ny", n("miny", "maxy")).where("nx > 0 and ny > 0")
    c = b.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1)))
    return c.select("i", "j", (F.col("minx") + F.col("i") * cell).alias("x0"), (F.col("miny") + F.col("j") * cell).alias("y0"))


def kernel_density(df: DataFrame, cell: float, column: str | None = None, x: str = "lon", y: str = "lat", bandwidths: float | None = None) -> DataFrame:
    """(i, j, density): at cell centres the sum of w * exp(-(d / 2 cell)^2 / 2) over all points.

    The kernel has no end, so each point adds to each cell, points of one place together: a stated cell set against all
    places, summed up in each task before the shuffle. The cells are broadcast, at most a million of them; with bandwidths given, points farther than so
    many bandwidths (2 cell) are left out and the pairs come from a grid join instead."""
    centres = saved(_cells(df, cell, x, y).select("i", "j", (F.col("x0") + cell / 2).alias("gx"), (F.col("y0") + cell / 2).alias("gy")), "cells")
    w = F.col(column).cast("double") if column else F.lit(1.0)
    points = df.select(F.col(x).alias("px"), F.col(y).alias("py"), w.alias("w")).groupBy("px", "py").agg(F.sum("w").alias("w"))
    if bandwidths:
        pairs = band_join(points, centres, bandwidths * 2 * cell, "px", "py", "gx", "gy")
    else:
        if centres.limit(1_000_001).count() > 1_000_000:
            raise ValueError("too many cells for a kernel without end; give bandwidths")
        pairs = points.join(F.broadcast(centres)).withColumn("d", F.hypot(F.col("px") - F.col("gx"), F.col("py") - F.col("gy")))
    sums = pairs.groupBy("i", "j").agg(F.sum(F.col("w") * F.exp(-0.5 * F.pow(F.col("d") / (2 * cell), 2))).alias("density"))
    return centres.select("i", "j").join(sums, ["i", "j"], "left").select("i", "j", F.coalesce("density", F.lit(0.0)).alias("density"))


def grid_density(df: DataFrame, cell: float, column: str | None = None, x: str = "lon", y: str = "lat") -> DataFrame:
    """(i, j, density): count, or sum of a column, of the points strictly inside each cell; empty cells are there."""
    cells = _cells(df, cell, x, y)
    low = total_bounds(df, x, y).select("minx", "miny")
    p = df.join(F.broadcast(low))
    i, j = F.floor((F.col(x) - F.col("minx")) / cell), F.floor((F.col(y) - F.col("miny")) / cell)
    inside = p.withColumn("i", i).withColumn("j", j).where((F.col(x) > F.col("minx") + F.col("i") * cell) & (F.col(y) > F.col("miny") + F.col("j") * cell))
    value = F.sum(F.col(column).cast("double")) if column else F.count("*").cast("double")
    return cells.select("i", "j").join(inside.groupBy("i", "j").agg(value.alias("v")), ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("density"))


def density_stats(grid: DataFrame) -> DataFrame:
    return grid.agg(F.count("*").alias("cells"), F.avg("density").alias("mean"), F.max("density").alias("max"), F.min("density").alias("min"), F.stddev_pop("density").alias("std"))


def spatial_kmeans(df: DataFrame, n_clusters: int = 5, x: str = "lon", y: str = "lat") -> DataFrame:
    rows, centres, _ = kmeans(df, n_clusters, x, y)
    n = rows.count()
    spark = df.sparkSession
    c = spark.createDataFrame([(i, *p) for i, p in enumerate(centres)], "cluster int, center_x double, center_y double")
    return rows.groupBy("cluster").agg(F.count("*").alias("size")).join(F.broadcast(c), "cluster").withColumn("density", F.col("size") / F.lit(max(n, 1)))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component: smallest node reachable) of all nodes; those without an edge are alone."""
    found = connected_components(edges)
    return nodes.select(F.col("node").cast("long").alias("node")).distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _core(p: DataFrame, cells: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """Points with at least min_samples neighbours, themselves among them. All points of a cell of so many are; the
    others, fewer than that a cell, are counted."""
    dense = cells.where(F.col("n") >= min_samples).select("cx", "cy", F.lit(True).alias("dense"))
    marked = p.join(dense, ["cx", "cy"], "left")
    few = marked.where("dense is null").select("id", "x", "y")
    near = band_join(few, p.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2")), eps, "x", "y", "x2", "y2")
    counted = near.groupBy("id").agg(F.count("*").alias("k")).where(F.col("k") >= min_samples).select("id")
    return marked.where("dense").select("id", "x", "y", "cx", "cy").unionByName(p.join(counted, "id", "left_semi").select("id", "x", "y", "cx", "cy"))


def _cell_links(core: DataFrame, eps: float, parts: int = 4) -> DataFrame:
    """(a, b): numbers of neighbouring cells with core points no farther apart than eps.

    Cells are quartered into parts x parts boxes first. Two boxes are decided by their bounds if even their far corners are
    within eps, or if even their near sides are not; only points of undecided boxes of cells that no decided pair
    links meet each other."""
    side = eps / 2**0.5
    boxed = core.withColumn("sx", F.floor(F.col("x") / (side / parts))).withColumn("sy", F.floor(F.col("y") / (side / parts)))
    boxes = saved(boxed.groupBy("cx", "cy", "cell", "sx", "sy").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")), "boxes")
    near = F.sequence(F.lit(-2), F.lit(2))
    other = boxes.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).withColumn("cx", F.col("cx") + F.col("dx")).withColumn("cy", F.col("cy") + F.col("dy"))
    other = other.select("cx", "cy", *[F.col(c).alias(f"o{c}") for c in ("cell", "sx", "sy", "x0", "x1", "y0", "y1")])
    pairs = boxes.join(other, ["cx", "cy"]).where("cell < ocell")
    gap = lambda a: F.greatest(F.lit(0.0), F.col(f"o{a}0") - F.col(f"{a}1"), F.col(f"{a}0") - F.col(f"o{a}1"))
    span = lambda a: F.greatest(F.col(f"o{a}1") - F.col(f"{a}0"), F.col(f"{a}1") - F.col(f"o{a}0"))
    pairs = pairs.withColumn("far", F.hypot(span("x"), span("y"))).where(F.hypot(gap("x"), gap("y")) <= eps)
    pairs = saved(pairs.select("cell", "ocell", "sx", "sy", "osx", "osy", (F.col("far") <= eps).alias("sure")), "box-pairs")
    sure = pairs.where("sure").select("cell", "ocell").distinct()
    open_ = pairs.join(sure, ["cell", "ocell"], "left_anti")
    at = boxed.select("sx", "sy", "x", "y")
    met = open_.join(at, ["sx", "sy"]).join(at.toDF("osx", "osy", "x2", "y2"), ["osx", "osy"]).where(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) <= eps)
    return sure.unionByName(met.select("cell", "ocell").distinct()).toDF("a", "b")


def dbscan(df: DataFrame, eps: float, min_samples: int = 5, id_col: str = "feature_id", x: str = "lon", y: str = "lat") -> DataFrame:
    """(id, is_core, cluster): clusters are numbered by their smallest core id from 0, noise is -1.

    A point counts itself. A border point goes to the cluster of its core neighbour of smallest cluster. Points of one
    cell of side eps / sqrt 2 are neighbours of each other, so clusters are components of cells with core points."""
    if eps <= 0:
        raise ValueError("eps must be positive")
    side = eps / 2**0.5
    p = df.select(F.col(id_col).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    p = saved(p.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side)), "points")
    core = saved(_core(p, p.groupBy("cx", "cy").agg(F.count("*").alias("n")), eps, min_samples), "core-points")
    names = core.groupBy("cx", "cy").agg(F.min("id").alias("cell"))
    core = saved(core.join(names, ["cx", "cy"]), "core")
    parts = components(_cell_links(core, eps), core.select(F.col("cell").alias("node")))
    of = core.select("id", "x", "y", "cell").join(parts.withColumnRenamed("node", "cell"), "cell")
    numbers = numbered(parts.select("component").distinct(), ["component"], "cluster")
    of = saved(of.join(numbers, "component").select("id", "x", "y", "cluster"), "clustered")
    rest = p.select("id", "x", "y").join(of.select("id"), "id", "left_anti")
    near = band_join(rest, of.select(F.col("x").alias("x2"), F.col("y").alias("y2"), "cluster"), eps, "x", "y", "x2", "y2")
    border = near.groupBy("id").agg(F.min("cluster").alias("cluster"))
    out = of.select("id", F.lit(True).alias("is_core"), "cluster").unionByName(border.select("id", F.lit(False).alias("is_core"), "cluster"))
    return p.select("id").join(out, "id", "left").select("id", F.coalesce("is_core", F.lit(False)).alias("is_core"), F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


def dbscan_summary(df: DataFrame, clusters: DataFrame, id_col: str = "feature_id", x: str = "lon", y: str = "lat") -> DataFrame:
    j = df.select(F.col(id_col).alias("id"), F.col(x).alias("x"), F.col(y).alias("y")).join(clusters, "id")
    total = df.agg(F.count("*").alias("total"))
    return j.groupBy("cluster").agg(F.count("*").alias("size"), F.avg("x").alias("center_x"), F.avg("y").alias("center_y")).join(F.broadcast(total)).select("cluster", "size", "center_x", "center_y", (F.col("size") / F.col("total")).alias("density"))


def places(df: DataFrame, id_col: str, x: str, y: str, *more) -> DataFrame:
    """(id, x, y, ...): the rows that pairs of different ids are made of."""
    p = df.select(F.col(id_col).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"), *more)
    return p.where("id is not null and x is not null and y is not null")


def same_id(p: DataFrame, threshold: float, *more) -> DataFrame:
    """Pairs of rows of the same id no farther apart than threshold, each row with itself among them: what pairs of places count too much.

    Rows of the same id and place are one with a count n first. more: further aggregates by id and place."""
    one = p.groupBy("id", "x", "y").agg(F.count("*").alias("n"), *more)
    two = one.select("id", *[F.col(c).alias(f"{c}2") for c in one.columns if c != "id"])
    d = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
    return one.join(two, "id").withColumn("d", d).where(F.col("d") <= threshold)


def _pairs_of_places(at: DataFrame, threshold: float) -> DataFrame:
    """Pairs of places (x, y, ...) no farther apart than threshold, each with itself among them; the second's columns end in 2."""
    return band_join(at, at.toDF(*[f"{c}2" for c in at.columns]), threshold, "x", "y", "x2", "y2")


def hot_spots(df: DataFrame, column: str, threshold: float, id_col: str = "feature_id", x: str = "lon", y: str = "lat", std: bool = False) -> DataFrame:
    """(id, gi, kind): binary weights without the point itself. std: the textbook statistic, which counts the point."""
    v = F.col(column).cast("double").alias("v")
    p = df.select(F.col(id_col).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"), v)
    some = places(df, id_col, x, y, v)
    # points of one place have the same neighbours, so places meet; then what is of the point's own id is taken off
    at = some.groupBy("x", "y").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    near = _pairs_of_places(at, threshold).groupBy("x", "y").agg(F.sum("v2").alias("wx"), F.sum("n2").alias("w"))
    by_id = some.groupBy("id", "x", "y").agg(F.count("*").alias("n")).join(near, ["x", "y"]).groupBy("id").agg(F.sum(F.col("n") * F.col("wx")).alias("wx"), F.sum(F.col("n") * F.col("w")).alias("w"))
    own = same_id(some, threshold, F.sum("v").alias("v")).groupBy("id").agg(F.sum(F.col("n") * F.col("v2")).alias("ox"), F.sum(F.col("n") * F.col("n2")).alias("o"))
    s = by_id.join(own, "id").where("w > o").select("id", (F.col("wx") - F.coalesce("ox", F.lit(0.0))).alias("wx"), (F.col("w") - F.col("o")).cast("double").alias("w"))
    a = p.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("s"), F.count("*").cast("double").alias("n"))
    one = p.join(s, "id", "left").join(F.broadcast(a)).withColumn("w", F.coalesce("w", F.lit(0.0)) + int(std)).withColumn("wx", F.coalesce("wx", F.lit(0.0)) + (F.col("v") if std else F.lit(0.0)))
    var = F.expr("try_divide(s * s * (w * (n - 1) - w * w), n - 1)") if not std else F.expr("try_divide(s * s * (n * w - w * w), n - 1)")
    gi = F.when(var > 0, (F.col("wx") - F.col("w") * F.col("mean")) / F.sqrt(F.when(var > 0, var))).otherwise(0.0)
    return one.select("id", gi.alias("gi")).withColumn("kind", F.when(F.col("gi") > 1.96, "hot").when(F.col("gi") < -1.96, "cold").otherwise("none"))


def hot_spot_summary(gi: DataFrame) -> DataFrame:
    return gi.agg(F.count_if(F.col("kind") == "hot").alias("hot"), F.count_if(F.col("kind") == "cold").alias("cold"), F.avg("gi").alias("mean_gi"), F.stddev_pop("gi").alias("std_gi"))


def morans_i(df: DataFrame, column: str, threshold: float, id_col: str = "feature_id", x: str = "lon", y: str = "lat", std: bool = False) -> DataFrame:
    """One row: i, expected, variance, z, p, interpretation. Without std the denominator adds up over all pairs of points."""
    v = F.col(column).cast("double").alias("v")
    a = df.select(v).agg(F.avg("v").alias("mu"), F.count("*").cast("double").alias("n"), F.var_pop("v").alias("var_v"))
    some = places(df, id_col, x, y, v).join(F.broadcast(a.select("mu"))).withColumn("e", F.col("v") - F.col("mu")).drop("v", "mu")
    at = some.groupBy("x", "y").agg(F.count("*").alias("n"), F.sum("e").alias("e"))
    both = lambda df, num, w: df.agg(F.sum(F.col("e") * F.col("e2")).alias(num), F.sum(F.col("n") * F.col("n2")).alias(w))
    num = both(_pairs_of_places(at, threshold), "all_num", "all_w").join(both(same_id(some, threshold, F.sum("e").alias("e")), "own_num", "own_w"))
    num = num.select(F.when(F.col("all_w") > F.col("own_w"), F.col("all_num") - F.col("own_num")).alias("num"), F.coalesce(F.col("all_w") - F.col("own_w"), F.lit(0)).cast("double").alias("w"))
    ss = "var_v * n" if std else "var_v * n * (n - 1)"
    total = "w" if std else "2 * w"
    r = a.join(num).select("n", F.expr(f"coalesce(try_divide(n * num, {total} * {ss}), 0e0)").alias("i"), F.expr("try_divide(-1e0, n - 1)").alias("expected"))
    r = r.withColumn("variance", F.expr("try_divide(n * n - 3 * n + 3, (n - 1) * (n + 1)) - expected * expected"))
    r = r.withColumn("z", F.when(F.col("variance") > 0, (F.col("i") - F.col("expected")) / F.sqrt(F.when(F.col("variance") > 0, F.col("variance")))).otherwise(0.0)).withColumn("p", 2 * (1 - F.abs("z")))
    return r.select("i", "expected", "variance", "z", "p", interpret_moran("i", "z").alias("interpretation"))


def interpret_moran(i: str, z: str):
    return F.when(F.abs(z) < 1.96, "random").when(F.col(i) > 0, "clustered").otherwise("dispersed")


def nearest_neighbor(df: DataFrame, id_col: str = "feature_id", x: str = "lon", y: str = "lat") -> DataFrame:
    """One row: mean and standard deviation of nearest distances, the expected mean, ratio, z, density and its reading."""
    d = nearest_distance(df, id_col, x, y).agg(F.count("*").cast("double").alias("n"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"))
    area = total_bounds(df, x, y).select(F.expr("(maxx - minx) * (maxy - miny)").alias("area"))
    r = d.join(F.broadcast(area)).withColumn("expected", F.expr("0.5e0 / sqrt(try_divide(n, area))")).withColumn("ratio", F.expr("try_divide(mean, expected)")).withColumn("se", F.expr("0.26136e0 / sqrt(try_divide(n * n, area))"))
    r = r.withColumn("z", F.expr("try_divide(mean - expected, se)"))
    kind = F.when(F.abs("z") < 1.96, "Random").when(F.col("ratio") < 1, "Clustered").otherwise("Dispersed")
    return r.select("mean", "std", "expected", "ratio", "z", F.expr("try_divide(n, area)").alias("density"), kind.alias("pattern"))
