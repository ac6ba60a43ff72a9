"""Elevation grids in long form (r, c, elev); a null elevation is nodata, which stencils see as a sentinel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolith.plans.iterate import saved

NODATA = -9999.0


def dem_stats(dem: DataFrame) -> DataFrame:
    return dem.agg(F.min("elev").alias("min"), F.max("elev").alias("max"), F.avg("elev").alias("mean"), F.stddev_pop("elev").alias("std"), F.percentile("elev", F.lit(0.5)).alias("median"), (F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"), F.count("elev").alias("valid"), F.count_if(F.col("elev").isNull()).alias("missing"))


def dem_histogram(dem: DataFrame, edges: int = 20) -> DataFrame:
    """(bin, low, high, n): edges - 1 bins from the least to the largest elevation, the last one closed."""
    k = edges - 1
    b = dem.agg(F.min("elev").alias("lo"), F.max("elev").alias("hi")).where("lo is not null")
    bins = b.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("step", (F.col("hi") - F.col("lo")) / k)
    of = F.least(F.coalesce(F.floor((F.col("elev") - F.col("lo")) / F.nullif((F.col("hi") - F.col("lo")) / k, F.lit(0.0))), F.lit(0)), F.lit(k - 1)).cast("int")
    n = dem.where("elev is not null").join(F.broadcast(b)).groupBy(of.alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(n, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("step")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def stencil(dem: DataFrame, size: int = 3, edge: str = "clamp") -> DataFrame:
    """(r, c, elev, dr, dc, v): each cell with its window. edge: clamp repeats the border, drop leaves what is outside out.

    A grid is as large as its table, however small its files look, so it is joined by shuffle and never sent to the driver."""
    h = size // 2
    off = F.sequence(F.lit(-h), F.lit(h))
    e = dem.select("r", "c", "elev").withColumn("dr", F.explode(off)).withColumn("dc", F.explode(off))
    nr, nc = F.col("r") + F.col("dr"), F.col("c") + F.col("dc")
    if edge == "clamp":
        b = dem.agg(F.max("r").alias("mr"), F.max("c").alias("mc"))
        e = e.join(F.broadcast(b))
        nr, nc = F.greatest(F.lit(0), F.least(nr, "mr")), F.greatest(F.lit(0), F.least(nc, "mc"))
    e = e.withColumn("nr", nr).withColumn("nc", nc)
    n = dem.select(F.col("r").alias("nr"), F.col("c").alias("nc"), F.coalesce("elev", F.lit(NODATA)).alias("v")).hint("merge")
    return e.join(n, ["nr", "nc"], "left" if edge == "pad" else "inner").select("r", "c", "elev", "dr", "dc", F.coalesce("v", F.lit(NODATA)).alias("v"))


def slope_aspect(dem: DataFrame, cell: float = 30.0, std: bool = False) -> DataFrame:
    """(r, c, slope, aspect) in degrees by Sobel sums over 2 cells (std: over 8); cells without data have none."""
    wx = F.col("dc") * F.when(F.col("dr") == 0, 2).otherwise(1)
    wy = F.col("dr") * F.when(F.col("dc") == 0, 2).otherwise(1)
    g = stencil(dem).groupBy("r", "c").agg(F.first("elev").alias("elev"), F.sum(wx * F.col("v")).alias("gx"), F.sum(wy * F.col("v")).alias("gy"))
    slope = F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) / ((8 if std else 2) * cell)))
    aspect = F.pmod(F.degrees(F.atan2(F.col("gy") + 0.0, F.col("gx") + 0.0)) + 360, F.lit(360.0))
    return g.select("r", "c", F.when(F.col("elev").isNotNull(), slope).alias("slope"), F.when(F.col("elev").isNotNull(), aspect).alias("aspect"))


def _classes(df: DataFrame, label, names: list[str]) -> DataFrame:
    """(class, n, pct) with empty classes."""
    total = df.agg(F.count("*").alias("total"))
    n = df.groupBy(label.alias("class")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(x,) for x in names], "class string")
    return every.join(n, "class", "left").join(F.broadcast(total)).select("class", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.expr("try_divide(n * 100e0, total)"), F.lit(0.0)).alias("pct"))


def slope_classes(slopes: DataFrame) -> DataFrame:
    s = F.col("slope")
    label = F.when(s < 2, "flat").when(s < 5, "gentle").when(s < 10, "moderate").when(s < 20, "steep").when(s < 30, "very_steep").otherwise("extreme")
    return _classes(slopes.where("slope is not null"), label, ["flat", "gentle", "moderate", "steep", "very_steep", "extreme"])


def direction(a):
    """Seven classes: north is 90 degrees wide and there is no north-west."""
    return F.when((a >= 315) | (a < 45), "N").when(a < 90, "NE").when(a < 135, "E").when(a < 180, "SE").when(a < 225, "S").when(a < 270, "SW").otherwise("W")


DIRECTIONS = ["N", "NE", "E", "SE", "S", "SW", "W"]


def aspect_classes(slopes: DataFrame) -> DataFrame:
    return _classes(slopes.where("aspect is not null"), direction(F.col("aspect")), DIRECTIONS)


def roughness_std(dem: DataFrame, size: int = 3, std: bool = False) -> DataFrame:
    """Population deviation in the window, where what is outside counts as the sentinel (std: is left out)."""
    s = stencil(dem, size, "drop" if std else "pad")
    s = s.where(F.col("v") != NODATA) if std else s
    return s.groupBy("r", "c").agg(F.stddev_pop("v").alias("value"))


def roughness_range(dem: DataFrame, size: int = 3) -> DataFrame:
    return stencil(dem, size, "drop").where(F.col("v") != NODATA).groupBy("r", "c").agg((F.max("v") - F.min("v")).alias("value"))


def tri(dem: DataFrame, size: int = 3) -> DataFrame:
    """Root of the summed squares of differences to the centre."""
    s = stencil(dem, size, "drop").where((F.col("v") != NODATA) & F.col("elev").isNotNull())
    return s.groupBy("r", "c").agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("elev"), 2))).alias("value"))


def vrm(dem: DataFrame, size: int = 3, std: bool = False) -> DataFrame:
    """1 - |sum of signs| / n over neighbours that differ; the sentinel where there is none (std: null)."""
    s = stencil(dem, size, "drop").where((F.col("v") != NODATA) & F.col("elev").isNotNull())
    differs = F.col("v") != F.col("elev")
    a = s.groupBy("r", "c").agg(F.sum(F.signum(F.col("v") - F.col("elev"))).alias("s"), F.count_if(differs).alias("k"), F.count("*").alias("n"))
    flat = F.lit(None).cast("double") if std else F.lit(NODATA)
    return a.select("r", "c", F.when((F.col("n") >= 2) & (F.col("k") > 0), 1 - F.abs("s") / F.nullif(F.col("k"), F.lit(0))).otherwise(flat).alias("value"))


def roughness_stats(dem: DataFrame, size: int = 3) -> DataFrame:
    """(method, mean, std, min, max) over the cells with data, of all methods from one look at each cell's window."""
    v, d, near = F.col("v"), F.col("v") - F.col("elev"), F.col("v") != NODATA
    both = near & F.col("elev").isNotNull()
    cells = stencil(dem, size, "pad").where("r is not null and c is not null").groupBy("r", "c").agg(
        F.count("elev").alias("valid"), F.stddev_pop("v").alias("std"), (F.max(F.when(near, v)) - F.min(F.when(near, v))).alias("range"),
        F.sqrt(F.sum(F.when(both, F.pow(d, 2)))).alias("tri"), F.sum(F.when(both, F.signum(d))).alias("s"), F.count_if(both & (d != 0)).alias("k"), F.count_if(both).alias("n"),
    )
    differ = (F.col("n") >= 2) & (F.col("k") > 0)
    vrm = F.when(differ, 1 - F.abs("s") / F.nullif(F.col("k"), F.lit(0))).when(F.col("n") > 0, F.lit(NODATA))
    cells = cells.where("valid > 0").select("std", "range", "tri", vrm.alias("vrm"))
    methods = ("std", "range", "tri", "vrm")
    of = lambda m: F.struct(F.avg(m).alias("mean"), F.stddev_pop(m).alias("std"), F.min(m).alias("min"), F.max(m).alias("max")).alias(m)
    one = cells.agg(*[of(m) for m in methods])
    return one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("method"), *[F.col(f"{m}.{x}").alias(x) for x in ("mean", "std", "min", "max")]) for m in methods])))


def viewshed(dem: DataFrame, row: int, col: int, cell: float = 30.0, max_distance: float = 5000.0) -> DataFrame:
    """(r, c) that are visible: 360 rays of steps; a ray ends at the border or at a cell without data."""
    steps = int(max_distance / cell)
    spark = dem.sparkSession
    rays = spark.range(360).select(F.col("id").alias("a")).withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(max(1, steps)))))
    rad = F.radians(F.col("a").cast("double"))
    rays = rays.withColumn("r", (row + F.col("d") * F.sin(rad)).cast("long")).withColumn("c", (col + F.col("d") * F.cos(rad)).cast("long"))
    z0 = dem.where((F.col("r") == row) & (F.col("c") == col)).select(F.col("elev").alias("z0"))
    on = rays.join(dem.select("r", "c", "elev"), ["r", "c"], "left").join(F.broadcast(z0))
    ray = Window.partitionBy("a").orderBy("d")
    on = on.withColumn("bad", F.max(F.col("elev").isNull().cast("int")).over(ray.rowsBetween(Window.unboundedPreceding, 0))).where("bad = 0")
    on = on.withColumn("angle", F.atan2(F.col("elev") - F.col("z0"), F.col("d") * cell))
    on = on.withColumn("top", F.max("angle").over(ray.rowsBetween(Window.unboundedPreceding, -1)))
    seen = on.where(F.col("top").isNull() | (F.col("angle") > F.col("top"))).select("r", "c")
    own = dem.where((F.col("r") == row) & (F.col("c") == col) & F.col("elev").isNotNull()).select("r", "c")
    return seen.unionByName(own.select(F.col("r").cast("long"), F.col("c").cast("long"))).distinct()


def viewshed_stats(seen: DataFrame, dem: DataFrame, cell: float = 30.0) -> DataFrame:
    return seen.agg(F.count("*").alias("visible")).join(dem.agg(F.count("elev").alias("total"))).select("visible", F.expr("try_divide(visible * 100e0, total)").alias("pct"), (F.col("visible") * cell * cell).alias("area"))


#: Rounds after which written steps are folded into one table.
FOLD = 16


def watershed(dem: DataFrame, row: int, col: int, std: bool = False) -> DataFrame:
    """(r, c): cells join if a neighbour in the set has no lower neighbour (std: if their steepest descent leads into it)."""
    valid = dem.where("elev is not null").select("r", "c", "elev")
    near = stencil(dem, 3, "drop").where((F.col("v") != NODATA) & F.col("elev").isNotNull() & ~((F.col("dr") == 0) & (F.col("dc") == 0)))
    if std:
        drop = (F.col("elev") - F.col("v")) / F.sqrt((F.abs("dr") + F.abs("dc")).cast("double"))
        best = near.where("v < elev").groupBy("r", "c").agg(F.max_by(F.struct("dr", "dc"), F.struct(drop, F.col("dr"), F.col("dc"))).alias("to"))
        into = saved(best.select((F.col("r") + F.col("to.dr")).alias("fr"), (F.col("c") + F.col("to.dc")).alias("fc"), "r", "c"), "flow")
    else:
        low = near.groupBy("r", "c").agg((F.min("v") >= F.first("elev")).alias("low")).where("low")
        into = saved(low.join(near.select("r", "c", "dr", "dc"), ["r", "c"]).select(F.col("r").alias("fr"), F.col("c").alias("fc"), (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c")), "flow")
    found = saved(valid.where((F.col("r") == row) & (F.col("c") == col)).select(F.col("r").cast("long"), F.col("c").cast("long")), "found")
    front, known = found, [found]
    while not front.isEmpty():
        seen = known[0]
        for x in known[1:]:
            seen = seen.unionByName(x)
        new = into.join(front.toDF("fr", "fc"), ["fr", "fc"]).select(F.col("r").cast("long"), F.col("c").cast("long")).distinct().join(seen, ["r", "c"], "left_anti")
        front = saved(new, "front")  # a round writes only the cells that it adds
        known.append(front)
        if len(known) > FOLD:
            known = [saved(seen.unionByName(front), "found")]
    out = known[0]
    for x in known[1:]:
        out = out.unionByName(x)
    return out


def watershed_stats(cells: DataFrame, dem: DataFrame, cell: float = 30.0) -> DataFrame:
    j = cells.join(dem, ["r", "c"]).agg(F.count("*").alias("cells"), F.min("elev").alias("min"), F.max("elev").alias("max"), F.avg("elev").alias("mean"))
    return j.join(dem.agg(F.count("elev").alias("total"))).select("cells", F.expr("try_divide(cells * 100e0, total)").alias("pct"), (F.col("cells") * cell * cell).alias("area"), "min", "max", "mean")


def local_minima(dem: DataFrame) -> DataFrame:
    near = stencil(dem, 3, "drop").where((F.col("v") != NODATA) & F.col("elev").isNotNull() & ~((F.col("dr") == 0) & (F.col("dc") == 0)))
    return near.groupBy("r", "c").agg((F.min("v") >= F.first("elev")).alias("low"))


def raster_tiles(dem: DataFrame, tile: int = 256, stride: int | None = None) -> DataFrame:
    """(tile_r, tile_c, row0, col0, height, width, n, mean): windows every stride rows and columns, cut at the border."""
    stride = stride or tile
    back = (tile - 1) // stride
    up = lambda c: F.filter(F.sequence(F.floor(F.col(c) / stride) - back, F.floor(F.col(c) / stride)), lambda t: (t >= 0) & (t * stride <= F.col(c)) & (F.col(c) < t * stride + tile))
    e = dem.withColumn("tile_r", F.explode(up("r"))).withColumn("tile_c", F.explode(up("c")))
    return e.groupBy("tile_r", "tile_c").agg(F.min("r").alias("row0"), F.min("c").alias("col0"), (F.max("r") - F.min("r") + 1).alias("height"), (F.max("c") - F.min("c") + 1).alias("width"), F.count("elev").alias("n"), F.avg("elev").alias("mean"))
