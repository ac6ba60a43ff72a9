"""Sinks: GeoJSON, KML, shapefile, GeoPackage, ASCII grid; and what they give when read back.

Each partition writes files of its own, so nothing is gathered; names come from the partition, so a task that runs
again writes the same files.
"""

from __future__ import annotations

import sqlite3
import struct
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.functions import geometry as g
from cartolith.plans.iterate import shared_dir
from cartolith.sources import files, raster, vector


def fresh(df: DataFrame, name: str) -> str:
    return f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ GeoJSON
def feature_lines(df: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """(value): a GeoJSON feature a row, from points with properties."""
    props = F.struct(*[c for c in df.columns if c not in (x, y)])
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), geometry.alias("geometry"))).alias("value"))


def geometry_lines(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """(value): a GeoJSON feature a row, from geometry struct(gtype, rings, parts) and properties; x and y are left out."""
    gm, zero = F.col(geometry), F.lit(0)
    xy = lambda p: F.array(p.x, p.y)
    rings = F.transform(gm.rings, lambda r: F.transform(r, xy))
    first = F.get(rings, zero)
    begun = F.concat(gm.parts, F.array(F.size(gm.rings)))
    polygons = F.transform(F.sequence(zero, F.size(gm.parts) - 1), lambda i: F.slice(rings, F.get(begun, i) + 1, F.get(begun, i + 1) - F.get(begun, i)))
    text = (
        F.when(gm.gtype == "Point", F.to_json(F.get(first, zero))).when(gm.gtype == "MultiPoint", F.to_json(F.transform(rings, lambda r: F.get(r, zero)))).when(gm.gtype == "LineString", F.to_json(first))
        .when(gm.gtype.isin("MultiLineString", "Polygon"), F.to_json(rings)).when(gm.gtype == "MultiPolygon", F.to_json(polygons))
    )
    shape = F.when(text.isNull(), F.lit("null")).otherwise(F.concat(F.lit('{"type":"'), gm.gtype, F.lit('","coordinates":'), text, F.lit("}")))
    props = [c for c in df.columns if c not in (geometry, "x", "y")]
    own = F.to_json(F.struct(*props)) if props else F.lit("{}")
    return df.select(F.concat(F.lit('{"type":"Feature","properties":'), own, F.lit(',"geometry":'), shape, F.lit("}")).alias("value"))


def chunk_features(chunks: DataFrame, params: dict[str, float]) -> DataFrame:
    """(value): a feature a chunk, its closed ring of five corners, with its number and the parameters."""
    p = lambda a, b: F.array(a, b)
    ring = F.array(p("minx", "miny"), p("maxx", "miny"), p("maxx", "maxy"), p("minx", "maxy"), p("minx", "miny"))
    props = F.struct("chunk_id", *[F.lit(v).alias(k) for k, v in params.items()])
    return chunks.select(F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))).alias("value"))


def _per_partition(lines: DataFrame, head: str, foot: str, between: str) -> DataFrame:
    """Text of one document a partition that has rows."""

    def wrap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun = False
        for pdf in batches:
            for v in pdf.value:
                yield pd.DataFrame({"value": [(between if begun else head) + v]})
                begun = True
        if begun:
            yield pd.DataFrame({"value": [foot]})

    return lines.select("value").mapInPandas(wrap, "value string")


def write_geojson(features: DataFrame, path: str) -> None:
    """A feature collection a partition; features: (value) from feature_lines or chunk_features."""
    _per_partition(features, '{"type":"FeatureCollection","features":[', "]}", ",").write.mode("overwrite").text(path)


def geometry_json(df: DataFrame) -> DataFrame:
    """Replace ring by its GeoJSON geometry as text."""
    coordinates = F.array(F.transform("ring", lambda p: F.array(p.x, p.y)))
    return df.withColumn("geojson", F.to_json(F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")))).drop("ring")


def parse_geometry(df: DataFrame, id_col: str) -> DataFrame:
    g = F.from_json("geojson", "type string, coordinates string")
    out = vector.parsed(df.select(id_col, g.alias("g")).select(id_col, F.col("g.type").alias("gtype"), F.col("g.coordinates").alias("coordinates")))
    return out.select(id_col, F.get("geometry.rings", F.lit(0)).alias("ring"))


# ------------------------------------------------------------------ KML, shapefile, GeoPackage, ASCII grid
def _xml(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def write_kml(df: DataFrame, path: str, name: str = "name", x: str = "lon", y: str = "lat") -> None:
    mark = F.concat(F.lit("<Placemark><name>"), _xml(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit("</name><Point><coordinates>"), F.col(x).cast("string"), F.lit(","), F.col(y).cast("string"), F.lit("</coordinates></Point></Placemark>"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document>\n'
    _per_partition(df.select(mark.alias("value")), head, "</Document></kml>", "").write.mode("overwrite").text(path)


def _write_files(df: DataFrame, path: str, save: Callable[[str, pd.DataFrame], None]) -> int:
    """save(stem, rows) for each partition that has rows; gives the number of files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            save(f"{path}/part-{TaskContext.get().partitionId():05d}", pd.concat(parts))
            yield pd.DataFrame({"n": [1]})

    return df.mapInPandas(run, "n long").count()


def save_shapefile(stem: str, rows: pd.DataFrame) -> None:
    """Points x, y with the other columns as text fields."""
    names = [c for c in rows.columns if c not in ("x", "y")]
    n, box = len(rows), (rows.x.min(), rows.y.min(), rows.x.max(), rows.y.max())

    def head(words: int) -> bytes:
        return struct.pack(">7I", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<II", 1000, 1) + struct.pack("<8d", *box, 0, 0, 0, 0)

    shp = b"".join(struct.pack(">II", i + 1, 10) + struct.pack("<I2d", 1, x, y) for i, (x, y) in enumerate(zip(rows.x, rows.y, strict=True)))
    shx = b"".join(struct.pack(">II", 50 + 14 * i, 10) for i in range(n))
    cells = {c: [b"" if v is None else str(v).encode()[:254] for v in rows[c]] for c in names}
    widths = {c: max(1, max(map(len, cells[c]))) for c in names}
    fields = b"".join(c.encode()[:10].ljust(11, b"\0") + b"C" + bytes(4) + bytes([widths[c], 0]) + bytes(14) for c in names)
    dbf = bytes([3, 124, 1, 1]) + struct.pack("<IHH", n, 33 + 32 * len(names), 1 + sum(widths.values())) + bytes(20) + fields + b"\r"
    dbf += b"".join(b" " + b"".join(cells[c][i].ljust(widths[c]) for c in names) for i in range(n)) + b"\x1a"
    files.write_bytes(stem + ".dbf", dbf)
    files.write_bytes(stem + ".shx", head(50 + 4 * n) + shx)
    files.write_bytes(stem + ".shp", head(50 + 14 * n) + shp)


def save_geopackage(stem: str, rows: pd.DataFrame) -> None:
    db = sqlite3.connect(":memory:")
    names = [c for c in rows.columns if c not in ("x", "y")]
    quoted = ", ".join('"' + c.replace('"', '""') + '" text' for c in names)
    db.execute("create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text, srs_id integer, z integer, m integer)")
    db.execute("insert into gpkg_geometry_columns values ('features', 'geom', 'POINT', 4326, 0, 0)")
    db.execute(f"create table features (geom blob, {quoted})")
    for r in rows.itertuples(index=False):
        v = r._asdict() if hasattr(r, "_asdict") else {}
        blob = b"GP\0\1" + struct.pack("<i", 4326) + struct.pack("<BI2d", 1, 1, v["x"], v["y"])
        db.execute(f"insert into features values ({', '.join('?' * (1 + len(names)))})", [blob, *[None if v[c] is None else str(v[c]) for c in names]])
    db.commit()
    files.write_bytes(stem + ".gpkg", db.serialize())


def write_ascii_grid(dem: DataFrame, path: str, nodata: float = -9999.0) -> None:
    """One grid a file is the format, so rows of the grid are made in parallel and then ordered into one."""
    b = dem.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()
    rows = dem.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("c", F.coalesce("elev", F.lit(nodata)).alias("e")))).alias("x")).select("r", F.concat_ws(" ", F.transform("x", lambda e: e.e.cast("string"))).alias("value"))
    head = f"ncols {b.c + 1}\nnrows {b.r + 1}\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value {nodata}\n"
    _per_partition(rows.orderBy("r").coalesce(1), head, "", "").write.mode("overwrite").text(path)


# ------------------------------------------------------------------ round trips
def csv_round_trip(df: DataFrame) -> DataFrame:
    path = fresh(df, "csv")
    df.write.option("header", True).csv(path)
    return vector.read_csv(df.sparkSession, path).select("feature_id", F.col("x").alias("lon"), F.col("y").alias("lat")).withColumn("feature_id", F.col("feature_id").cast("long"))


def geojson_round_trip(df: DataFrame) -> DataFrame:
    path = fresh(df, "geojson")
    write_geojson(feature_lines(df), path)
    r = vector.read_geojson(df.sparkSession, path)
    return r.select(F.element_at("properties", "feature_id").alias("feature_id"), F.element_at("properties", "name").alias("name"), F.col("x").alias("lon"), F.col("y").alias("lat"))


def geojson_written(df: DataFrame) -> DataFrame:
    """Write a feature collection a partition; one row of what the files hold, read as text by a JSON function."""
    path = fresh(df, "geojson")
    write_geojson(feature_lines(df), path)
    whole = df.sparkSession.read.text(path, wholetext=True).where("length(value) > 0")
    kind = "type string, features array<struct<type string, properties struct<feature_id bigint>, geometry struct<type string, coordinates array<double>>>>"
    f = whole.select(F.explode(F.from_json("value", kind).features).alias("f")).where("f.type = 'Feature' and f.geometry.type = 'Point'")
    return f.agg(F.count("*").alias("features"), F.count_distinct("f.properties.feature_id").alias("ids"), F.sum(F.col("f.geometry.coordinates")[0]).alias("lon"), F.sum(F.col("f.geometry.coordinates")[1]).alias("lat"))


def chunks_written(chunks: DataFrame, params: dict[str, float]) -> DataFrame:
    """Write chunks as feature collections; their numbers and bounds as the files have them."""
    path = fresh(chunks, "chunks")
    write_geojson(chunk_features(chunks, params), path)
    r = vector.read_geojson(chunks.sparkSession, path)
    low = [c.alias(n) for c, n in zip(g.bounds(F.get("geometry.rings", F.lit(0))), ("minx", "miny", "maxx", "maxy"), strict=True)]
    return r.select(F.element_at("properties", "chunk_id").cast("long").alias("chunk_id"), *low)


def kml_round_trip(df: DataFrame) -> DataFrame:
    path = fresh(df, "kml")
    write_kml(df, path)
    return vector.read_kml(df.sparkSession, path).select(F.element_at("properties", "name").alias("name"), F.col("x").alias("lon"), F.col("y").alias("lat"))


def _binary(df: DataFrame, save, read, name: str) -> DataFrame:
    path = fresh(df, name)
    _write_files(df.select("feature_id", F.col("lon").alias("x"), F.col("lat").alias("y")), path, save)
    return read(df.sparkSession, path).select(F.element_at("properties", "feature_id").alias("feature_id"), F.col("x").alias("lon"), F.col("y").alias("lat"))


def shp_round_trip(df: DataFrame) -> DataFrame:
    return _binary(df, save_shapefile, vector.read_shapefile, "shp")


def gpkg_round_trip(df: DataFrame) -> DataFrame:
    return _binary(df, save_geopackage, vector.read_geopackage, "gpkg")


def raster_round_trip(dem: DataFrame) -> DataFrame:
    path = fresh(dem, "asc")
    write_ascii_grid(dem, path)
    return raster.read_raster(dem.sparkSession, path).select("r", "c", "elev")
