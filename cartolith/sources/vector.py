"""Vector sources: CSV, GeoJSON, KML, shapefile, GeoPackage.

All but CSV give geometry struct(gtype, rings, parts), the x and y of a point or of the first vertex, and properties as a map.
The rings of a multi-part geometry stand in a row; parts are the places of those that begin a part (a polygon's other
rings are holes). ``centroids`` puts the centroid in x and y, as point analyses want it. Collections of several kinds raise.
Files are the unit of parallelism of shapefiles and GeoPackages, which cannot be split.
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cartolith.functions import geometry as g
from cartolith.sources import files

RING = "array<array<struct<x:double,y:double>>>"
SCHEMA = f"geometry struct<gtype:string,rings:{RING},parts:array<int>>, x double, y double, properties map<string,string>"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Points from latitude and longitude, or lat and lon; inferring the schema reads the file twice, so give one if you can."""
    r = spark.read.option("header", True)
    df = (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)
    by = {c.lower(): c for c in df.columns}
    for lat, lon in (("latitude", "longitude"), ("lat", "lon")):
        if lat in by and lon in by:
            return df.withColumn("x", F.col(by[lon]).cast("double")).withColumn("y", F.col(by[lat]).cast("double"))
    raise ValueError("a CSV needs columns latitude and longitude, or lat and lon")


def parsed(df: DataFrame, gtype: str = "gtype", coordinates: str = "coordinates") -> DataFrame:
    """Replace a GeoJSON type and its coordinates (JSON text) by geometry, x and y."""
    c, xy = F.col(coordinates), lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    line = lambda a: F.transform(a, xy)
    kind, each = F.col(gtype), F.lit(0)
    multi = F.from_json(c, "array<array<array<array<double>>>>")
    rings = (
        F.when(kind == "Point", F.array(F.array(xy(F.from_json(c, "array<double>")))))
        .when(kind == "MultiPoint", F.transform(F.from_json(c, "array<array<double>>"), lambda p: F.array(xy(p))))
        .when(kind == "LineString", F.array(line(F.from_json(c, "array<array<double>>"))))
        .when(kind.isin("Polygon", "MultiLineString"), F.transform(F.from_json(c, "array<array<array<double>>>"), line))
        .when(kind == "MultiPolygon", F.transform(F.flatten(multi), line))
        .when(kind.isNotNull(), F.raise_error(F.concat(F.lit("geometry is not supported: "), kind)).cast(RING))
    )
    # where each polygon of several begins: the rings of those before it
    starts = F.aggregate(multi, F.array().cast("array<int>"), lambda a, p: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), each) + F.size(p))))
    out = df.withColumn("_rings", rings)
    first = F.when(kind == "Polygon", F.array(each)).when(kind == "MultiPolygon", F.concat(F.array(each), F.slice(starts, 1, F.greatest(F.size(starts) - 1, each))))
    every = F.when(F.size("_rings") > 0, F.sequence(each, F.size("_rings") - 1)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("geometry", F.struct(kind.alias("gtype"), F.col("_rings").alias("rings"), F.coalesce(first, every).alias("parts"))).drop("_rings")
    head = F.get(F.get("geometry.rings", F.lit(0)), F.lit(0))
    return out.withColumn("x", head.x).withColumn("y", head.y).drop(gtype, coordinates)


def centroids(df: DataFrame) -> DataFrame:
    """x and y as the centroid of the geometry."""
    return df.withColumn("_c", g.geometry_centroid(F.col("geometry"))).withColumn("x", F.col("_c.x")).withColumn("y", F.col("_c.y")).drop("_c")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Feature collections, a document a file."""
    schema = "type string, features array<struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    f = docs.select(F.when(F.col("features").isNull(), F.raise_error(F.lit("not a GeoJSON feature collection"))).otherwise(F.col("features")).alias("fs")).select(F.explode("fs").alias("f"))
    return parsed(f.select(F.col("f.geometry.type").alias("gtype"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))).select("geometry", "x", "y", "properties")


_KML_LINE = "struct<coordinates:string>"
_KML_POLYGON = f"struct<outerBoundaryIs:struct<LinearRing:{_KML_LINE}>,innerBoundaryIs:array<struct<LinearRing:{_KML_LINE}>>>"


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks with a point, a line, a polygon with its holes, or several of one kind."""
    several = f"struct<Point:array<{_KML_LINE}>,LineString:array<{_KML_LINE}>,Polygon:array<{_KML_POLYGON}>>"
    schema = f"name string, description string, Point {_KML_LINE}, LineString {_KML_LINE}, Polygon {_KML_POLYGON}, MultiGeometry {several}"
    df = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    number = lambda p, i: F.get(F.split(p, ","), F.lit(i)).cast("double")
    pts = lambda text: F.transform(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda p: F.struct(number(p, 0).alias("x"), number(p, 1).alias("y")))
    rings = lambda p: F.concat(F.array(pts(p.outerBoundaryIs.LinearRing.coordinates)), F.transform(F.coalesce(p.innerBoundaryIs, F.array().cast(f"array<struct<LinearRing:{_KML_LINE}>>")), lambda i: pts(i.LinearRing.coordinates)))
    one = lambda a, c: F.coalesce(a, F.when(F.col(c).isNotNull(), F.array(F.col(c))))
    points, lines, polygons = (one(F.col(f"MultiGeometry.{k}"), k) for k in ("Point", "LineString", "Polygon"))
    many = F.when(F.col("MultiGeometry").isNotNull(), "Multi").otherwise("")
    kinds = sum(F.when(F.size(F.coalesce(a, F.array())) > 0, 1).otherwise(0) for a in (points, lines, polygons))
    kind = F.when(kinds > 1, F.raise_error(F.lit("a placemark of several kinds of geometry is not supported")).cast("string")).when(points.isNotNull(), F.concat(many, F.lit("Point"))).when(lines.isNotNull(), F.concat(many, F.lit("LineString"))).when(polygons.isNotNull(), F.concat(many, F.lit("Polygon")))
    text = lambda a: F.transform(a, lambda p: pts(p.coordinates))
    found = F.coalesce(text(points), text(lines), F.flatten(F.transform(polygons, rings)))
    before = F.aggregate(polygons, F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + 1 + F.coalesce(F.nullif(F.size(p.innerBoundaryIs), F.lit(-1)), F.lit(0)))))
    parts = F.when(polygons.isNotNull(), F.slice(before, 1, F.size(polygons))).when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1))
    props = F.map_filter(F.create_map(F.lit("name"), F.col("name"), F.lit("description"), F.col("description")), lambda _, v: v.isNotNull())
    df = df.select(F.struct(kind.alias("gtype"), found.alias("rings"), parts.alias("parts")).alias("geometry"), props.alias("properties"))
    first = F.get(F.get("geometry.rings", F.lit(0)), F.lit(0))
    return df.select("geometry", first.x.alias("x"), first.y.alias("y"), "properties")


class _File(InputPartition):
    def __init__(self, uri: str):
        super().__init__(uri)
        self.uri = uri


class _Reader(DataSourceReader):
    def __init__(self, path: str, suffix: str, rows):
        self.path, self.suffix, self.rows = path, suffix, rows

    def partitions(self) -> list[_File]:
        return [_File(u) for u in files.files(self.path, self.suffix)] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition.uri:
            yield from self.rows(partition.uri)


def _row(gtype: str, rings: list[list[tuple[float, float]]], props: dict[str, str], parts: list[int] | None = None) -> tuple:
    x, y = rings[0][0] if rings and rings[0] else (None, None)
    parts = ([0] if gtype == "Polygon" else list(range(len(rings)))) if parts is None else parts
    return ((gtype, [[(float(a), float(b)) for a, b in r] for r in rings], parts), x, y, props)


def _turn(ring: list[tuple[float, float]]) -> float:
    """Positive if the ring is anticlockwise."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))


def dbf_rows(data: bytes) -> Iterator[dict[str, str] | None]:
    """Records of a dBASE table as text; None for a deleted one."""
    n, head, size = struct.unpack("<IHH", data[4:12])
    fields = []
    for at in range(32, head - 1, 32):
        if data[at] == 0x0D:
            break
        fields.append((data[at : at + 11].split(b"\0")[0].decode(), data[at + 16]))
    for i in range(n):
        rec = data[head + i * size : head + (i + 1) * size]
        at, out = 1, {}
        for name, width in fields:
            if text := rec[at : at + width].decode("utf-8", "replace").strip():
                out[name] = text
            at += width
        yield None if rec[:1] == b"*" else out


def shp_rows(uri: str) -> Iterator[tuple]:
    stem = uri[:-4]
    for suffix in (".shx", ".dbf"):
        if not files.files(stem + suffix, suffix):
            raise FileNotFoundError(stem + suffix)
    shp, table = files.read_bytes(uri), dbf_rows(files.read_bytes(stem + ".dbf"))
    at = 100
    while at + 8 <= len(shp):
        _, words = struct.unpack(">II", shp[at : at + 8])
        body = shp[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        props = next(table, {})
        if props is None:
            continue
        kind = struct.unpack("<I", body[:4])[0]
        if kind in (1, 11, 21):
            yield _row("Point", [[struct.unpack("<2d", body[4:20])]], props)
        elif kind in (3, 5, 13, 15, 23, 25):
            parts, points = struct.unpack("<II", body[36:44])
            starts = [*struct.unpack(f"<{parts}I", body[44 : 44 + 4 * parts]), points]
            xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            pts = list(zip(xy[::2], xy[1::2], strict=True))
            rings = [pts[a:z] for a, z in zip(starts, starts[1:], strict=False)]
            if kind % 10 == 3:
                yield _row("LineString" if len(rings) == 1 else "MultiLineString", rings, props)
                continue
            # clockwise rings begin a polygon, the others are holes
            begun = [i for i, r in enumerate(rings) if i == 0 or _turn(r) <= 0]
            yield _row("Polygon" if len(begun) == 1 else "MultiPolygon", rings, props, begun)
        elif kind in (8, 18, 28):
            n = struct.unpack("<I", body[36:40])[0]
            xy = struct.unpack(f"<{2 * n}d", body[40 : 40 + 16 * n])
            yield _row("MultiPoint", [[p] for p in zip(xy[::2], xy[1::2], strict=True)], props)
        elif kind == 0:
            yield _row("Null", [], props)
        else:
            raise ValueError(f"shape type {kind} is not supported")


def wkb_geometry(b: bytes) -> tuple[str, list[list[tuple[float, float]]], list[int]]:
    """Well-known binary: (kind, rings, places of the rings that begin a part); z and m are left out."""
    kind, rings, parts, _ = _wkb(b, 0)
    return kind, rings, parts


def _wkb(b: bytes, at: int) -> tuple[str, list[list[tuple[float, float]]], list[int], int]:
    e = "<" if b[at] else ">"
    kind = struct.unpack_from(e + "I", b, at + 1)[0]
    at += 5
    if kind & 0x20000000:
        at += 4  # a reference system of its own
    dims = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000)
    kind &= 0xFFFF
    dims, kind = (dims, kind) if kind < 1000 else ((3, 3, 4)[kind // 1000 - 1], kind % 1000)

    def points(n: int) -> list[tuple[float, float]]:
        nonlocal at
        v = struct.unpack_from(f"{e}{dims * n}d", b, at)
        at += 8 * dims * n
        return list(zip(v[::dims], v[1::dims], strict=True))

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(e + "I", b, at - 4)[0]

    if kind == 1:
        return "Point", [points(1)], [0], at
    if kind == 2:
        return "LineString", [points(count())], [0], at
    if kind == 3:
        return "Polygon", [points(count()) for _ in range(count())], [0], at
    if kind not in (4, 5, 6):
        raise ValueError(f"geometry type {kind} is not supported")
    rings: list = []
    parts: list[int] = []
    for _ in range(count()):
        _, own, _, at = _wkb(b, at)
        parts.append(len(rings))
        rings += own
    return {4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}[kind], rings, parts, at


def gpkg_rows(uri: str) -> Iterator[tuple]:
    db = sqlite3.connect(":memory:")
    db.deserialize(files.read_bytes(uri))
    quote = lambda name: '"' + name.replace('"', '""') + '"'
    for name, column in db.execute("select table_name, column_name from gpkg_geometry_columns").fetchall():
        cursor = db.execute(f"select * from {quote(name)}")
        names = [d[0] for d in cursor.description]
        for row in cursor:
            values = dict(zip(names, row, strict=True))
            blob = values.pop(column)
            props = {k: str(v) for k, v in values.items() if v is not None}
            if blob is None:
                yield _row("Null", [], props)
                continue
            envelope = (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7]
            kind, rings, parts = wkb_geometry(blob[8 + envelope :])
            yield _row(kind, rings, props, parts)


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cartolith_shp"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], ".shp", shp_rows)


class GeoPackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cartolith_gpkg"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], ".gpkg", gpkg_rows)


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ShapefileSource)
    return spark.read.format("cartolith_shp").load(path)


def read_geopackage(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(GeoPackageSource)
    return spark.read.format("cartolith_gpkg").load(path)


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """By suffix."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    readers = {"csv": read_csv, "geojson": read_geojson, "json": read_geojson, "shp": read_shapefile, "kml": read_kml, "gpkg": read_geopackage}
    if suffix not in readers:
        raise ValueError(f"no reader for .{suffix}")
    return readers[suffix](spark, path)


def preview(df: DataFrame, n: int = 3) -> DataFrame:
    return df.limit(n)
