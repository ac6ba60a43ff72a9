"""Point, radius, polygon and box queries; validation; presentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.functions import geometry as g


def validate_normalize(df: DataFrame, x: str = "lon", y: str = "lat", srid: int = 4326, target: int = 4326) -> DataFrame:
    """Rows with a geometry that is valid, in the target reference system (4326, 3857 or 32633); a missing one counts as 4326."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    srid = srid or 4326
    if srid == 4326:
        df = df.where((F.abs(x) <= 180) & (F.abs(y) <= 90))
    if srid == target:
        return df
    if (srid, target) == (3857, 4326):
        p = g.from_mercator(x, y)
    elif (srid, target) == (4326, 3857):
        p = g.to_mercator(x, y)
    elif (srid, target) == (4326, 32633):
        p = g.to_utm33(x, y)
    else:
        raise ValueError(f"no projection from {srid} to {target}")
    return df.withColumn("_p", p).withColumn(x, F.col("_p.x")).withColumn(y, F.col("_p.y")).drop("_p")


def within_distance(df: DataFrame, lat: float, lon: float, metres: float, x: str = "lon", y: str = "lat", exact: bool = False) -> DataFrame:
    """Within metres / 111,000 degrees on both axes. exact: inside the 64-segment outline of a buffer instead of the disc."""
    r = metres / g.METRES_PER_DEGREE
    dx, dy = F.col(x) - lon, F.col(y) - lat
    inside = g.in_buffer(dx, dy, r) if exact else g.in_disc(dx, dy, r)
    return df.where(g.in_box(x, y, lon - r, lat - r, lon + r, lat + r) & inside)


def within_distance_std(df: DataFrame, lat: float, lon: float, metres: float, x: str = "lon", y: str = "lat") -> DataFrame:
    """Within metres on the sphere."""
    dlat = metres / 110_000.0
    return df.where((F.col(y) >= lat - dlat) & (F.col(y) <= lat + dlat) & (g.haversine_metres(F.lit(lat), F.lit(lon), y, x) <= metres))


class SpatialQueryEngine:
    """The four queries over one table of points."""

    def __init__(self, df: DataFrame, x: str = "lon", y: str = "lat"):
        self.df, self.x, self.y = df, x, y

    def point_query(self, lat: float, lon: float, tolerance_km: float = 1.0) -> DataFrame:
        return within_distance(self.df, lat, lon, tolerance_km * 1000, self.x, self.y)

    def range_query(self, lat: float, lon: float, radius_km: float) -> DataFrame:
        return within_distance(self.df, lat, lon, radius_km * 1000, self.x, self.y)

    def polygon_query(self, polygon: list[tuple[float, float]]) -> DataFrame:
        return self.df.where(g.within_polygon(self.x, self.y, polygon))

    def bbox_query(self, min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> DataFrame:
        return self.df.where(g.in_box(self.x, self.y, min_lon, min_lat, max_lon, max_lat))


def validate_report(df: DataFrame, x: str = "lon", y: str = "lat", srid: int | None = 4326) -> DataFrame:
    """(severity, code, n): what the validation panel warns of; rows with n = 0 do not warn."""
    invalid = F.col(x).isNull() | F.col(y).isNull() | F.isnan(x) | F.isnan(y)
    one = df.agg(F.count("*").alias("n"), F.count_if(invalid).alias("bad")).join(df.distinct().agg(F.count("*").alias("d")))
    row = lambda severity, code, n: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), n.cast("long").alias("n"))
    rows = F.array(
        row("warning", "no_name", F.lit(int("name" not in df.columns))), row("warning", "invalid_geometry", F.col("bad")), row("warning", "crs", F.lit(int(srid != 4326))),
        row("warning", "duplicates", F.col("n") - F.col("d")), row("error", "empty", F.col("n") == 0),
    )
    return one.select(F.inline(rows))


def quick_stats(df: DataFrame, x: str = "lon", y: str = "lat", srid: int = 4326) -> DataFrame:
    return df.agg(
        F.count("*").alias("n"), F.lit("Point").alias("geometry_type"), F.lit(f"EPSG:{srid}").alias("crs"), F.lit(len(df.columns)).alias("n_columns"),
        F.min(x).alias("minx"), F.min(y).alias("miny"), F.max(x).alias("maxx"), F.max(y).alias("maxy"),
    )


def total_bounds(df: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    return df.agg(F.min(x).alias("minx"), F.min(y).alias("miny"), F.max(x).alias("maxx"), F.max(y).alias("maxy"))


def map_center(df: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """Centroid of the distinct points; (20, 0) if there is none."""
    d = df.select(x, y).distinct().agg(F.avg(y).alias("lat"), F.avg(x).alias("lon"))
    return d.select(F.coalesce("lat", F.lit(20.0)).alias("lat"), F.coalesce("lon", F.lit(0.0)).alias("lon"))


def format_results(df: DataFrame, similarity: str, x: str = "lon", y: str = "lat") -> DataFrame:
    """Result cards: name, coordinates with hemispheres, percentage and its bucket."""
    lat = F.concat(F.format_string("%.4f", F.abs(y)), F.when(F.col(y) >= 0, "°N").otherwise("°S"))
    lon = F.concat(F.format_string("%.4f", F.abs(x)), F.when(F.col(x) >= 0, "°E").otherwise("°W"))
    pct = F.col(similarity) * 100
    name = F.coalesce(F.col("name"), F.lit("Unnamed")) if "name" in df.columns else F.lit("Unnamed")
    return df.select("feature_id", name.alias("name"), F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.concat(lat, F.lit(", "), lon)).alias("position"), pct.alias("pct"), F.when(pct >= 80, "high").when(pct >= 60, "medium").otherwise("low").alias("bucket"))


def marker_layer(df: DataFrame, layer: str, x: str = "lon", y: str = "lat", label: str = "name") -> DataFrame:
    return df.select(F.lit(layer).alias("layer"), F.col(y).alias("lat"), F.col(x).alias("lon"), F.coalesce(F.col(label).cast("string"), F.lit("Unnamed")).alias("label"))


def to_table(df: DataFrame, limit: int = 20, order_by: str = "feature_id") -> DataFrame:
    """The first rows without their geometry, beside the total count."""
    total = df.agg(F.count("*").alias("total"))
    return df.drop("geometry").orderBy(order_by).limit(limit).join(F.broadcast(total))


def detect_column(columns: list[str], keywords: list[str]) -> str | None:
    """The first column whose name contains a keyword."""
    return next((c for c in columns if any(k in c.lower() for k in keywords)), None)
