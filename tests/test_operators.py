"""Hand-computed and brute-force cases, edges and guards."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.functions import geometry as g
from cartolith.functions import stats
from cartolith.operators import chunking, network, population, retrieval, spatial_query, spatial_stats, temporal, terrain, weather
from cartolith.operators.bandjoin import band_join, nearest_distance
from cartolith.plans import runner
from cartolith.sources import raster, sinks, vector
from cartolith.streaming import windowed_climate


def pts(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y), float(i)) for i, (x, y) in enumerate(rows)], "feature_id long, lon double, lat double, val double")


SQUARE = [(0, 0), (0, 1), (1, 0), (1, 1), (9, 9)]


def test_band_join_and_nearest_like_brute_force(spark):
    rng = np.random.RandomState(0)
    xy = np.round(rng.uniform(-20, 20, (150, 2)), 1)
    xy[40:60] = xy[:20]
    p = pts(spark, xy)
    q = p.select(F.col("feature_id").alias("b"), F.col("lon").alias("bx"), F.col("lat").alias("by"))
    got = {(r.feature_id, r.b) for r in band_join(p, q, 3.0, "lon", "lat", "bx", "by").collect()}
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    assert got == {(i, j) for i in range(150) for j in range(150) if d[i, j] <= 3.0}
    np.fill_diagonal(d, np.inf)
    near = {r.id: r.d for r in nearest_distance(p, "feature_id", "lon", "lat").collect()}
    assert np.allclose([near[i] for i in range(150)], d.min(1))
    assert [r.d for r in nearest_distance(p.limit(1), "feature_id", "lon", "lat").collect()] == [None]


def test_square_and_outlier(spark):
    p = pts(spark, SQUARE)
    c = {r.id: (r.is_core, r.cluster) for r in spatial_stats.dbscan(p, 1.0, 2).collect()}
    assert c == {0: (True, 0), 1: (True, 0), 2: (True, 0), 3: (True, 0), 4: (False, -1)}
    n = spatial_stats.nearest_neighbor(p).first()
    assert math.isclose(n.mean, (4 + math.hypot(8, 8)) / 5)
    gi = {r.id: r.kind for r in spatial_stats.hot_spots(p, "val", 1.0).collect()}
    assert len(gi) == 5 and spatial_stats.morans_i(p, "val", 1.0).first().interpretation in ("random", "clustered", "dispersed")


def test_grid_builders(spark):
    p = pts(spark, [(0, 0), (2.5, 2.5), (1, 1), (0.5, 0.5)])
    chunks = chunking.grid_chunks(p, 1.0).collect()
    assert len(chunks) == 9 and max(r.maxx for r in chunks) == 2.5
    d = {(r.i, r.j): r.density for r in spatial_stats.grid_density(p, 1.0).collect()}
    assert d == {(0, 0): 1.0, (0, 1): 0.0, (1, 0): 0.0, (1, 1): 0.0}  # what lies on an edge, and the last cells, are out
    k = {(r.i, r.j): r.density for r in spatial_stats.kernel_density(p, 1.0, bandwidths=50.0).collect()}
    f = {(r.i, r.j): r.density for r in spatial_stats.kernel_density(p, 1.0).collect()}
    assert k.keys() == f.keys() and all(math.isclose(k[c], f[c]) for c in k)
    assert chunking.grid_chunks(p.limit(1)).count() == 0 and spatial_stats.grid_density(p.limit(0), 1.0).count() == 0
    assert sum(r.density for r in spatial_stats.grid_density(p, 0.7).collect()) <= 4


def test_polygon_boundary_and_buffer(spark):
    p = pts(spark, [(0, 0), (1, 1), (0.5, 0), (2, 2), (0.2, 0.9)])
    e = spatial_query.SpatialQueryEngine(p)
    assert [r.feature_id for r in e.polygon_query([(0, 0), (2, 0), (2, 1.5), (0, 1.5)]).orderBy("feature_id").collect()] == [1, 4]
    assert e.bbox_query(0, 0, 1, 1).count() == 4
    with pytest.raises(ValueError):
        spatial_query.validate_normalize(p, srid=9999, target=1)
    back = spatial_query.validate_normalize(spatial_query.validate_normalize(p, target=3857), srid=3857, target=4326).orderBy("feature_id").collect()
    assert all(abs(r.lon - x) < 1e-9 and abs(r.lat - y) < 1e-9 for r, (x, y) in zip(back, [(0, 0), (1, 1), (0.5, 0), (2, 2), (0.2, 0.9)], strict=True))
    u = spark.range(1).select(g.to_utm33(F.lit(16.0), F.lit(48.0)).alias("p")).first().p
    assert abs(u.x - 574_595) < 20 and abs(u.y - 5_316_784) < 30
    assert math.isclose(g.UNIT_BUFFER_AREA, 3.136548490545939)


def test_geometry_of_a_ring(spark):
    r = spark.range(1).select(F.array(*[g.point(F.lit(x), F.lit(y)) for x, y in [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 0.0)]]).alias("r"))
    v = r.select(g.polygon_area(F.col("r")).alias("a"), g.line_length(F.col("r")).alias("l"), g.centroid(F.col("r")).alias("c"), g.within_ring(F.lit(3.0), F.lit(1.0), F.col("r")).alias("i")).first()
    assert (v.a, v.l, v.i) == (6.0, 12.0, True) and math.isclose(v.c.x, 8 / 3) and math.isclose(v.c.y, 1.0)


def test_p_values():
    assert math.isclose(stats.student_two_sided(2.228, 10), 0.05, abs_tol=2e-4) and stats.student_two_sided(0.0, 5) == pytest.approx(1)
    assert math.isclose(stats.normal_two_sided(1.959964), 0.05, abs_tol=1e-6) and stats.normal_two_sided(None) is None


def series(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double").withColumn("ts", F.expr("timestamp'2024-01-01' + make_dt_interval(cast(id as int))"))


@pytest.mark.parametrize("n", [2, 7, 8, 23, 24, 60])
def test_mann_kendall_and_windows(spark, n):
    rng = np.random.RandomState(n)
    v = [float(x) for x in rng.randint(0, 9, n)]
    s = series(spark, v)
    want = sum(int(np.sign(b - a)) for i, a in enumerate(v) for b in v[i + 1 :])
    for block in (3, 4096):
        assert temporal.mann_kendall(s, "ts", "v", "id", block).first().s == want
    back = temporal.mann_kendall(series(spark, v[::-1]), "ts", "v", "id").first()
    assert back.s == -want and (back.z is None) == (n < 3)
    w = max(1, min(12, n // 4) + (min(12, n // 4) % 2 == 0))
    d = temporal.seasonal_decompose(s, "ts", "v", "id").orderBy("ts").collect()
    assert sum(r.trend is not None for r in d) == max(0, n - w + 1)
    assert temporal.seasonality_strength(temporal.seasonal_decompose(s, "ts", "v", "id")).first().strength == 0.0 or w == 1


def test_change_points(spark):
    v = [0.0] * 30 + [50.0] + [0.0, 1.0] * 20
    c = [r.i for r in temporal.change_candidates(series(spark, v), "ts", "v", "id").collect()]
    assert 30 in c
    kept = sorted(r.i for r in temporal.change_points(series(spark, v), "ts", "v", "id").collect())
    assert set(kept) <= set(c) and all(b - a >= 10 for a, b in zip(kept, kept[1:], strict=False))
    assert temporal.change_candidates(series(spark, v[:8]), "ts", "v", "id").count() == 0


def grid(spark, rows):
    return spark.createDataFrame([(r, c, None if v is None else float(v)) for r, row in enumerate(rows) for c, v in enumerate(row)], "r long, c long, elev double")


def test_terrain_by_numpy(spark):
    z = np.array([[5, 5, 6, 9, 2], [4, 1, 6, 3, 2], [7, 8, 6, 3, 4], [5, 5, 5, 5, 5], [1, 2, 3, 4, 5]], float)
    d = grid(spark, z.tolist())
    e = np.pad(z, 1, "edge")
    gx = sum(w * (e[1 + a : 6 + a, 2:7] - e[1 + a : 6 + a, 0:5]) for a, w in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(w * (e[2:7, 1 + a : 6 + a] - e[0:5, 1 + a : 6 + a]) for a, w in ((-1, 1), (0, 2), (1, 1)))
    s = {(r.r, r.c): r for r in terrain.slope_aspect(d, 30.0).collect()}
    assert np.allclose([s[i, j].slope for i in range(5) for j in range(5)], np.degrees(np.arctan(np.hypot(gx, gy) / 60)).ravel())
    tri = {(r.r, r.c): r.value for r in terrain.tri(d).collect()}
    assert math.isclose(tri[1, 1], math.sqrt(((z[:3, :3] - 1) ** 2).sum()))
    v = {(r.r, r.c): r.value for r in terrain.vrm(grid(spark, [[1, 1], [1, 1]])).collect()}
    assert set(v.values()) == {terrain.NODATA}
    assert sum(r.n for r in terrain.slope_classes(terrain.slope_aspect(d)).collect()) == 25
    h = terrain.dem_histogram(d).orderBy("bin").collect()
    assert [r.n for r in h] == np.histogram(z, np.linspace(1, 9, 20))[0].tolist()


def test_viewshed_and_watershed(spark):
    flat = grid(spark, [[1] * 7 for _ in range(7)])
    assert terrain.viewshed(flat, 3, 3, 30.0, 60.0).count() <= 49
    wall = [[0.0] * 9 for _ in range(9)]
    for i in range(9):
        wall[i][6] = 100.0
    seen = {(r.r, r.c) for r in terrain.viewshed(grid(spark, wall), 4, 4, 30.0, 200.0).collect()}
    assert (4, 6) in seen and (4, 7) not in seen and (4, 4) in seen
    plateau = grid(spark, [[1, 1, 9], [1, 1, 9], [9, 9, None]])
    w = {(r.r, r.c) for r in terrain.watershed(plateau, 0, 0).collect()}
    assert {(0, 0), (0, 1), (1, 0), (1, 1)} <= w and (2, 2) not in w
    cone = grid(spark, [[abs(i - 2) + abs(j - 2) for j in range(5)] for i in range(5)])
    assert terrain.watershed(cone, 2, 2, std=True).count() == 25
    assert terrain.watershed_stats(terrain.watershed(cone, 2, 2, std=True), cone).first().pct == 100.0


def test_ages_and_inequality(spark):
    a = spark.createDataFrame([(float(x), 1.0) for x in (0, 5, 5.5, 14, 15, 64, 65, 100, 101)] + [(None, 1.0)], "age double, population double")
    assert {r.bin: r.population for r in population.age_pyramid(a).collect()} == {0: 1.0, 1: 1.0, 2: 2.0, 12: 2.0, 19: 1.0}
    assert {r.group: r["count"] for r in population.age_groups(a).collect()} == {"children": 4, "youth": 1, "adults": 1, "elderly": 3}
    v = [1.0, 2.0, 2.0, 7.0, 9.0]
    x = np.sort(v)
    gini = (6 - 2 * np.cumsum(x).sum() / x.sum()) / 5
    assert math.isclose(population.inequality(spark.createDataFrame([(i,) for i in v], "v double"), "v").first().gini, gini)
    empty = a.limit(0)
    assert population.inequality(empty, "age").first().gini == 0 and population.age_stats(empty).first().mean is None
    assert population.dependency_ratios(a.where("age < 3")).first().total == 0


def test_migration_sums_to_zero(spark):
    f = spark.createDataFrame([(1, 2, 5.0), (2, 3, 1.5), (4, 4, 2.0)], "origin int, destination int, migrants double")
    net = {r.location: r.net for r in population.net_migration(f).collect()}
    assert net == {1: -5.0, 2: 3.5, 3: 1.5, 4: 0.0}


def links(spark, rows, xy):
    return spark.createDataFrame([(i, u, v, *map(float, xy[u]), *map(float, xy[v]), 36.0) for i, (u, v) in enumerate(rows)], "link_id long, u long, v long, ux double, uy double, vx double, vy double, speed_limit double")


def test_network(spark):
    n = links(spark, [(0, 1), (1, 2), (0, 1), (5, 5)], {0: (0, 0), 1: (3, 4), 2: (3, 5), 5: (9, 9)})
    assert {(r.x, r.y): r.degree for r in network.degrees(n).collect()} == {(0, 0): 2, (3, 4): 3, (3, 5): 1, (9, 9): 1}
    c = network.connectivity(n).first()
    assert (c.links, c.nodes, c.beta) == (4, 4, 1.0) and math.isclose(c.alpha, 1 / 3) and math.isclose(c.gamma, 4 / 6)
    assert {r.node: r.component for r in network.components(n).collect()} == {0: 0, 1: 0, 2: 0, 5: 5}
    assert {r.node: r.cost for r in network.shortest_path(n, 0).collect()} == {0: 0.0, 1: 5.0, 2: 6.0}
    assert {r.node: r.score for r in network.betweenness_std(n).collect()} == {1: 1.0}
    close = {r.node: r.score for r in network.closeness_std(n).collect()}
    assert math.isclose(close[1], 1.0) and math.isclose(close[0], 2 / 3)
    assert network.hull_area(network.nodes(n)).first().area == pytest.approx(abs(0 * 0 + 3 * 5 - 3 * 4 + 3 * 9 - 9 * 5 + 0) / 2, abs=10)
    assert network.route(n, 0, 0, 0, 0).first().speed is None
    assert network.travel_time(network.travel_times(n)).first().total == pytest.approx((5 + 1 + 5) / 10)
    assert network.centrality(n, "unknown").count() == 0


def test_service_overlap(spark):
    p = pts(spark, [(0, 0), (1, 0), (2, 0), (10, 10)])
    o = network.service_overlap(p, 1.0).first()
    lens = 2 * math.acos(0.5) - 0.5 * math.sqrt(3)
    assert o.pairs == 2 and math.isclose(o.total, 2 * lens)


def test_vector_store(spark, tmp_path):
    rows = lambda ids: spark.createDataFrame([(str(i), [float(i), 1.0], "d") for i in ids], "id string, embedding array<double>, document string")
    store = retrieval.VectorStore(spark, f"file://{tmp_path}/s")
    store.add(rows([1, 2]))
    store.add(rows([2, 3]))
    assert sorted(r.id for r in store.read().collect()) == ["1", "2", "3"]
    store.delete(["1"])
    assert [r.id for r in store.query([3.0, 1.0], 1).collect()] == ["3"]
    v = retrieval.hash_vector("a")
    assert len(v) == 384 and math.isclose(sum(x * x for x in v), 1) and v == retrieval.hash_vector("a") != retrieval.hash_vector("b")
    with pytest.raises(NotImplementedError):
        retrieval.EmbeddingManager().embed_images(rows([1]), "document")


def test_weather_guards(spark):
    w = spark.createDataFrame([], "obs_ts timestamp, v double")
    assert weather.precip_stats(w, "v").first().n == 0 and weather.climate(w, "v").count() == 0
    with pytest.raises(ValueError):
        weather.climate(w, "v", "yearly")


def test_runner(spark, tmp_path):
    m = runner.AnalysisManager(pts(spark, SQUARE))
    out = m.run(None, {"numeric": "val", "radius": 2.0, "cell": 3.0})
    assert out.count() > 5
    s = m.summary().first()
    assert (s.total, s.failed) == (6, 4) and m.errors["spatial"] is None and "Spatial" in m.report()
    assert m.export(f"file://{tmp_path}/m", "csv") and not m.export(f"file://{tmp_path}/n", "xml")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/m").count() == out.count()
    m.clear()
    assert m.status() == {"runs": 0, "families": 0, "failed": 0}


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("lat,lon,n\n1.5,2.5,x\n")
    r = vector.read_vector(spark, f"file://{tmp_path}/a.csv").first()
    assert (r.x, r.y) == (2.5, 1.5)
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        vector.read_vector(spark, f"file://{tmp_path}/b.csv")
    with pytest.raises(ValueError):
        vector.read_vector(spark, "x.unknown")
    (tmp_path / "p.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"p","n":1},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,0]]]}},{"type":"Feature","properties":{},"geometry":{"type":"LineString","coordinates":[[0,0],[3,4]]}}]}')
    g2 = vector.read_geojson(spark, f"file://{tmp_path}/p.geojson").collect()
    assert [x.geometry.gtype for x in g2] == ["Polygon", "LineString"] and g2[0].properties["name"] == "p"
    (tmp_path / "k.kml").write_text('<kml><Document><Placemark><name>a</name><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 1,0 1,1 0,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>')
    k = vector.read_kml(spark, f"file://{tmp_path}/k.kml").first()
    assert k.geometry.gtype == "Polygon" and len(k.geometry.rings[0]) == 4
    import struct

    data = struct.pack("<4f", 1, 2, -9999, 4)
    tags = [(256, 3, 1, 2), (257, 3, 1, 2), (258, 3, 1, 32), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (279, 4, 1, 16), (339, 3, 1, 3)]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + bytes(4)
    (tmp_path / "t.tif").write_bytes(b"II*\0" + struct.pack("<I", 24) + data + ifd)
    cells = raster.read_raster(spark, f"file://{tmp_path}/t.tif").collect()
    assert [(c.r, c.c, c.elev) for c in cells] == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, -9999.0), (1, 1, 4.0)]
    lines = sinks.chunk_features(chunking.grid_chunks(pts(spark, [(0, 0), (2, 2)]), 1.0), {"cell_size": 1.0})
    sinks.write_geojson(lines, f"file://{tmp_path}/chunks")
    assert vector.read_geojson(spark, f"file://{tmp_path}/chunks").count() == 4


def test_streaming(spark, tmp_path):
    src = spark.createDataFrame([(i, f"2024-01-01 0{i % 4}:10:00", float(i)) for i in range(8)], "id long, t string, v double").select("id", F.to_timestamp("t").alias("obs_ts"), "v")
    src.write.parquet(f"{tmp_path}/in")
    q = windowed_climate(spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in"), "v").writeStream.outputMode("complete").format("memory").queryName("climate").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("climate").collect()) == [2, 2, 2, 2]


def test_entry_without_the_training_data_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['cartolith.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 150 and int(out[1]) > 130 and out[2] == "False"


# ------------------------------------------------------------------ one order over many tasks, components, dense cells
def test_numbers_sums_and_windows_like_pandas(spark, monkeypatch):
    from cartolith.operators import ordered

    monkeypatch.setattr(ordered, "BLOCK", 16)
    rng = np.random.RandomState(2)
    v = [None if x > 0.9 else float(x) for x in rng.rand(300)]
    df = spark.createDataFrame([(int(k), i, x) for i, (k, x) in enumerate(zip(rng.randint(0, 9, 300), v, strict=True))], "k int, id long, v double").repartition(7)
    want = sorted((r.k, r.id, r.v) for r in df.collect())
    rows = ordered.numbered(df, ["k", "id"])
    assert [(r.k, r.id, r.v) for r in sorted(rows.collect(), key=lambda r: r.i)] == want and {r.i for r in rows.collect()} == set(range(300))
    sums = {r.id: r.s for r in ordered.running_sum(df, ["k", "id"], "v", "s").collect()}
    total = 0.0
    for _, i, x in want:
        total += x or 0.0
        assert sums[i] == pytest.approx(total)
    out = {r.i: r for r in ordered.sliding(rows, 7, 3, {"m": lambda w: F.max("v").over(w.rowsBetween(-7, 3)), "lag": lambda w: F.lag("v", 5).over(w)}).collect()}
    assert len(out) == 300
    for i in range(300):
        seen = [x for _, _, x in want[max(0, i - 7) : i + 4] if x is not None]
        assert out[i].m == (max(seen) if seen else None) and out[i].lag == (want[i - 5][2] if i >= 5 else None)
    assert ordered.numbered(df.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("block", [4, 50, 1 << 16])
def test_mann_kendall_of_ties_over_runs(spark, block):
    rng = np.random.RandomState(block % 7)
    v = [float(x) for x in rng.randint(0, 12, 230)]
    want = sum(int(np.sign(b - a)) for i, a in enumerate(v) for b in v[i + 1 :])
    assert temporal.mann_kendall(series(spark, v), "ts", "v", "id", block).first().s == want


def test_components_of_long_paths_and_stars(spark, monkeypatch):
    from cartolith.operators import components as c

    monkeypatch.setattr(c, "HELD", 8)
    rng = np.random.RandomState(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + k) for k in range(1, 90)] + [(5000, 5000), (None, 3)]
    edges = [edges[i] for i in rng.permutation(len(edges))]
    got = {r.node: r.component for r in c.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + k: 1000 for k in range(90)}
    alone = spatial_stats.components(spark.createDataFrame([(1, 2)], "a long, b long"), spark.createDataFrame([(1,), (2,), (9,)], "node long"))
    assert {r.node: r.component for r in alone.collect()} == {1: 1, 2: 1, 9: 9}


def _dbscan(xy, eps, least):
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)) <= eps
    core = d.sum(1) >= least
    cluster, n = np.full(len(xy), -1), 0
    for i in range(len(xy)):
        if core[i] and cluster[i] < 0:
            stack, cluster[i] = [i], n
            while stack:
                for k in np.flatnonzero(d[stack.pop()] & core & (cluster < 0)).tolist():
                    cluster[k] = n
                    stack.append(k)
            n += 1
    own = cluster.copy()
    for i in np.flatnonzero(~core):
        near = own[d[i] & core]
        cluster[i] = near.min() if len(near) else -1
    return core, cluster


@pytest.mark.parametrize(("seed", "eps", "least"), [(0, 1.0, 4), (1, 0.4, 3), (2, 2.5, 9), (3, 0.8, 1)])
def test_dbscan_like_brute_force(spark, seed, eps, least):
    rng = np.random.RandomState(seed)
    xy = np.round(np.concatenate([rng.normal(0, 1, (120, 2)), rng.normal(6, 0.3, (80, 2)), rng.uniform(-9, 9, (80, 2))]), 2)
    core, cluster = _dbscan(xy, eps, least)
    got = {r.id: (r.is_core, r.cluster) for r in spatial_stats.dbscan(pts(spark, xy), eps, least).collect()}
    assert got == {i: (bool(core[i]), int(cluster[i])) for i in range(len(xy))}


def test_dbscan_of_20_000_points_in_a_cell(spark):
    rng = np.random.RandomState(9)
    xy = np.concatenate([rng.uniform(0, 0.7, (20_000, 2)), [[1.69, 0.3], [5, 5]]])
    got = spatial_stats.dbscan(pts(spark, xy), 1.0, 5).groupBy("is_core", "cluster").count().collect()
    assert {(r.is_core, r.cluster): r["count"] for r in got} in ({(True, 0): 20_001, (False, -1): 1}, {(True, 0): 20_000, (False, 0): 1, (False, -1): 1})


def test_paths_and_centralities_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(network, "FOLD", 2)
    rng = np.random.RandomState(4)
    n, e = 25, [(int(a), int(b)) for a, b in rng.randint(0, 25, (40, 2))] + [(k, k + 1) for k in range(8)]
    at = rng.uniform(0, 9, (n, 2))
    links = spark.createDataFrame([(i, u, v, *map(float, at[u]), *map(float, at[v])) for i, (u, v) in enumerate(e)], "link_id long, u long, v long, ux double, uy double, vx double, vy double")
    w = np.full((n, n), np.inf)
    np.fill_diagonal(w, 0)
    hops = w.copy()
    for u, v in e:
        w[u, v] = w[v, u] = min(w[u, v], float(np.hypot(*(at[u] - at[v]))))
        if u != v:
            hops[u, v] = hops[v, u] = 1
    one = hops == 1
    for k in range(n):
        w = np.minimum(w, w[:, k : k + 1] + w[k])
        hops = np.minimum(hops, hops[:, k : k + 1] + hops[k])
    got = {r.node: r.cost for r in network.shortest_path(links, 0).collect()}
    assert got.keys() == {i for i in range(n) if np.isfinite(w[0, i])} and all(math.isclose(got[i], w[0, i], abs_tol=1e-9) for i in got)
    close = {r.node: r.score for r in network.closeness_std(links).collect()}
    for i in range(n):
        d = hops[i][np.isfinite(hops[i]) & (hops[i] > 0)]
        assert (i in close) == bool(len(d)) and (not len(d) or math.isclose(close[i], len(d) / d.sum()))
    paths = np.eye(n)
    for h in range(1, n):
        for s, t in zip(*np.nonzero(hops == h), strict=True):
            paths[s, t] = sum(paths[s, k] for k in np.flatnonzero(one[t]) if hops[s, k] == h - 1)
    want = {}
    for v in range(n):
        s = sum(paths[a, v] * paths[v, b] / paths[a, b] for a in range(n) for b in range(a) if v not in (a, b) and np.isfinite(hops[a, b]) and hops[a, v] + hops[v, b] == hops[a, b])
        if s:
            want[v] = s
    between = {r.node: r.score for r in network.betweenness_std(links).collect()}
    assert between.keys() == want.keys() and all(math.isclose(between[k], want[k], rel_tol=1e-9) for k in want)


def test_reach_by_blocks():
    rng = np.random.default_rng(5)
    n = 300
    chain = [(i, i + 1) for i in range(200, 260)]
    hub = [(7, i) for i in range(8, 190)]
    e = {(min(p), max(p)) for p in [*chain, *hub, *rng.integers(0, 150, (400, 2)).tolist(), (280, 281)] if p[0] != p[1]}
    linked = sorted({i for p in e for i in p}, key=lambda i: -sum(i in p for p in e))
    number = {x: i for i, x in enumerate(linked)}
    to = [[] for _ in linked]
    for u, v in e:
        to[number[u]].append(number[v])
        to[number[v]].append(number[u])
    hops = np.full((len(to), len(to)), -1)
    for s in range(len(to)):
        front, h = [s], 0
        while front:
            hops[s, front] = h
            front, h = [x for x in {y for f in front for y in to[f]} if hops[s, x] < 0], h + 1
    assert len(to) < n and (hops < 0).any() and hops.max() > 50
    for tile, least, words in ((2048, 4096, 16), (3, 20, 1), (16, 1, 2)):
        reach = network.Reach(np.cumsum([0, *map(len, to)]), np.array([x for k in to for x in k], np.int32))
        reach.TILE, reach.HUB, reach.words = tile, least, words
        reach.blocks = -(-len(to) // (64 * words))
        got = np.where(np.eye(len(to), dtype=bool), 0, -1)
        for block in range(reach.blocks):
            for h, nodes, bits in reach.layers(block):
                on = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").astype(bool)[:, : len(to) - block * 64 * words]
                at, source = np.nonzero(on)
                at, source = nodes[at], source + block * 64 * words
                assert (got[at, source] < 0).all()
                got[at, source] = h
        assert (got == hops).all()


def test_closeness_joins_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    links = spark.createDataFrame([(int(u), int(v) if v else None) for u, v in rng.integers(0, 90, (130, 2))], "u long, v long").repartition(3)
    monkeypatch.setattr(network, "MOST_ARCS", 0)
    want = {r.node: r.score for r in network.closeness_std(links).collect()}
    monkeypatch.undo()
    monkeypatch.setattr(network, "_layers", lambda links: pytest.fail("pairs of nodes are joined"))
    got = {r.node: r.score for r in network.closeness_std(links).collect()}
    assert got == want and len(got) > 50
    assert network.closeness_std(links.limit(0)).count() == 0
    assert network.closeness_std(spark.createDataFrame([(4, 4)], "u long, v long")).count() == 0


@pytest.mark.parametrize("most", [7, 50_000])
def test_top_k_batch_like_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(retrieval, "MOST_QUERIES", most)
    rng = np.random.default_rng(8)
    v = [[float(x) for x in np.float32(rng.normal(0, 1, 6))] for _ in range(60)]
    rows = [*v, *v[:9] * 8, *[[2 * x for x in y] for y in v[:5]], [0.0] * 6, None, [], [1.0, 2.0], [None, *v[0][1:]], [float("nan"), *v[0][1:]], [1e30] * 6]
    ids = rng.permutation(len(rows)).tolist()
    store = spark.createDataFrame(list(zip(ids, rows, map(str, ids), strict=True)), "id long, embedding array<float>, more string").repartition(3)
    queries = store.where("id % 4 = 0 or embedding is null or size(embedding) < 3 or embedding[1] = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    pairs = store.join(queries).withColumn("d", retrieval.cosine_distance("embedding", "query_vector"))
    want = {}
    for r in pairs.collect():
        want.setdefault(r.query_id, []).append((2 if r.d is None else int(math.isnan(r.d)), 0.0 if r.d is None or math.isnan(r.d) else r.d, r.id))
    got = {}
    out = retrieval.top_k_batch(store, queries, 5)
    assert sorted(out.columns) == ["distance", "embedding", "id", "more", "query_id", "rank"]
    for r in out.orderBy("query_id", "rank").collect():
        assert r.more == str(r.id)
        got.setdefault(r.query_id, []).append((2 if r.distance is None else int(math.isnan(r.distance)), 0.0 if r.distance is None or math.isnan(r.distance) else r.distance, r.id))
    assert got == {q: sorted(x)[:5] for q, x in want.items()}


def test_points_of_one_place_meet_as_one(spark, monkeypatch):
    from cartolith.operators import bandjoin

    xy = [(0.0, 0.0), (40.0, 0.0), (0.0, 40.0), (40.0, 40.0)] * 50
    df = pts(spark, np.array(xy))
    fit, learned = chunking.KMeans.fit, []
    monkeypatch.setattr(chunking.KMeans, "fit", lambda self, data: learned.append(data.count()) or fit(self, data))
    rows, centres, inertia = chunking.kmeans(df, 4, "lon", "lat")
    assert learned == [4] and sorted(map(tuple, centres)) == sorted(set(xy)) and inertia == 0 and {r["count"] for r in rows.groupBy("cluster").count().collect()} == {50}
    got = {(r.i, r.j): r.density for r in spatial_stats.kernel_density(df, 10.0).collect()}
    assert len(got) == 9 and math.isclose(got[0, 0], sum(math.exp(-0.5 * (math.hypot(5 - x, 5 - y) / 20) ** 2) for x, y in xy), rel_tol=1e-9)
    monkeypatch.setattr(bandjoin, "_spread", lambda df: pytest.fail("points of one place meet each other"))
    assert [r.d for r in nearest_distance(df, "feature_id", "lon", "lat").collect()] == [0.0] * len(xy)
    monkeypatch.undo()
    some = np.array([*xy[:8], (1.0, 0.0), (300.0, 7.0), (41.0, 2.0)])
    got = {r.id: r.d for r in nearest_distance(pts(spark, some), "feature_id", "lon", "lat").collect()}
    far = np.hypot(*(some[:, None] - some).transpose(2, 0, 1)) + np.diag([np.inf] * len(some))
    assert len(got) == len(some) and all(math.isclose(got[i], far[i].min()) for i in got)


# ------------------------------------------------------------------ files as other programs write them
def test_multi_part_geometries(spark, tmp_path):
    import json
    import sqlite3
    import struct

    box = lambda x, y, s, turn=1: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]][::turn]
    shapes = {
        "Point": [3, 4], "MultiPoint": [[0, 0], [2, 4]], "LineString": [[0, 0], [4, 0], [4, 2]], "MultiLineString": [[[0, 0], [6, 0]], [[0, 3], [0, 5]]],
        "Polygon": [box(0, 0, 4, -1), box(1, 1, 1)], "MultiPolygon": [[box(0, 0, 4, -1), box(1, 1, 1)], [box(10, 0, 2, -1)]],
    }
    want = {"Point": (3, 4), "MultiPoint": (1, 2), "LineString": (16 / 6, 1 / 3), "MultiLineString": (18 / 8, 1.0), "Polygon": ((32 - 1.5) / 15, (32 - 1.5) / 15), "MultiPolygon": ((30.5 + 44) / 19, (30.5 + 4) / 19)}
    parts = {"Point": [0], "MultiPoint": [0, 1], "LineString": [0], "MultiLineString": [0, 1], "Polygon": [0], "MultiPolygon": [0, 2]}
    features = [{"type": "Feature", "properties": {"k": k}, "geometry": {"type": k, "coordinates": c}} for k, c in shapes.items()] + [{"type": "Feature", "properties": {}, "geometry": None}]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))

    def check(df, kinds):
        got = {r.geometry.gtype: (r.x, r.y, list(r.geometry.parts)) for r in vector.centroids(df).where("geometry.gtype is not null").collect()}
        assert got.keys() == set(kinds)
        for k in kinds:
            assert got[k][:2] == pytest.approx(want[k]) and got[k][2] == parts[k], k

    json_rows = vector.read_geojson(spark, f"file://{tmp_path}/a.geojson")
    check(json_rows, shapes)
    sinks.write_geojson(sinks.geometry_lines(json_rows), f"file://{tmp_path}/again")
    again = vector.read_geojson(spark, f"file://{tmp_path}/again")
    assert sorted(map(str, again.select("geometry").collect())) == sorted(map(str, json_rows.select("geometry").collect()))
    assert json_rows.count() == 7 and vector.centroids(json_rows).where("geometry.gtype is null").first().x is None
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "GeometryCollection", "geometries": []}}]}))
    with pytest.raises(Exception, match="not supported"):
        vector.read_geojson(spark, f"file://{tmp_path}/b.geojson").collect()

    text = lambda ps: f"<coordinates>\n{' '.join(f'{x},{y},0' for x, y in ps)}\n</coordinates>"
    poly = lambda rings: "<Polygon><outerBoundaryIs><LinearRing>" + text(rings[0]) + "</LinearRing></outerBoundaryIs>" + "".join(f"<innerBoundaryIs><LinearRing>{text(r)}</LinearRing></innerBoundaryIs>" for r in rings[1:]) + "</Polygon>"
    kml = {
        "Point": f"<Point>{text([shapes['Point']])}</Point>", "LineString": f"<LineString>{text(shapes['LineString'])}</LineString>", "Polygon": poly(shapes["Polygon"]),
        "MultiPoint": "<MultiGeometry>" + "".join(f"<Point>{text([p])}</Point>" for p in shapes["MultiPoint"]) + "</MultiGeometry>",
        "MultiLineString": "<MultiGeometry>" + "".join(f"<LineString>{text(p)}</LineString>" for p in shapes["MultiLineString"]) + "</MultiGeometry>",
        "MultiPolygon": "<MultiGeometry>" + "".join(map(poly, shapes["MultiPolygon"])) + "</MultiGeometry>",
    }
    (tmp_path / "a.kml").write_text("<kml><Document>" + "".join(f"<Placemark><name>{k}</name>{v}</Placemark>" for k, v in kml.items()) + "</Document></kml>")
    check(vector.read_kml(spark, f"file://{tmp_path}/a.kml"), shapes)

    def wkb(kind, c, e="<", z=False):
        flat = lambda ps: b"".join(struct.pack(e + "3d" if z else e + "2d", *p, *([7.0] if z else [])) for p in ps)
        n = lambda x: struct.pack(e + "I", len(x))
        code = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6}[kind] + 1000 * z
        body = {"Point": lambda: flat([c]), "LineString": lambda: n(c) + flat(c), "Polygon": lambda: n(c) + b"".join(n(r) + flat(r) for r in c)}.get(kind) or (lambda: n(c) + b"".join(wkb(kind[5:], x, e, z) for x in c))
        return struct.pack("B", e == "<") + struct.pack(e + "I", code) + body()

    db = sqlite3.connect(tmp_path / "a.gpkg")
    db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
    db.execute("insert into gpkg_geometry_columns values ('t', 'g')")
    db.execute("create table t (g blob, k text)")
    for i, (k, c) in enumerate(shapes.items()):
        db.execute("insert into t values (?, ?)", [b"GP\0\1" + struct.pack("<i", 4326) + wkb(k, c, "<>"[i % 2], i % 3 == 0), k])
    db.commit()
    db.close()
    check(vector.read_geopackage(spark, f"file://{tmp_path}/a.gpkg"), shapes)

    def record(kind, rings):
        pts = [p for r in rings for p in r]
        starts = [sum(map(len, rings[:i])) for i in range(len(rings))]
        xy = b"".join(struct.pack("<2d", *p) for p in pts)
        if kind == 8:
            return struct.pack("<I4dI", 8, 0, 0, 0, 0, len(pts)) + xy
        return struct.pack(f"<I4dII{len(rings)}I", kind, 0, 0, 0, 0, len(rings), len(pts), *starts) + xy

    bodies = {
        "MultiPoint": record(8, [shapes["MultiPoint"]]), "LineString": record(3, [shapes["LineString"]]), "MultiLineString": record(3, shapes["MultiLineString"]),
        "Polygon": record(5, shapes["Polygon"]), "MultiPolygon": record(5, [r for p in shapes["MultiPolygon"] for r in p]),
    }
    (tmp_path / "a.shp").write_bytes(bytes(100) + b"".join(struct.pack(">II", i + 1, len(b) // 2) + b for i, b in enumerate(bodies.values())))
    (tmp_path / "a.shx").write_bytes(b"")
    (tmp_path / "a.dbf").write_bytes(bytes([3, 124, 1, 1]) + struct.pack("<IHH", 0, 33, 1) + bytes(20) + b"\r")
    check(vector.read_shapefile(spark, f"file://{tmp_path}/a.shp"), bodies)


def _lzw(data):
    """An encoder by the format's own rules, to read back."""
    table, width, held, bits, out = {}, 9, 0, 0, bytearray()

    def put(code):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            out.append(held >> (bits - 8) & 255)
            bits -= 8
        held &= (1 << bits) - 1

    def clear():
        nonlocal table, width
        put(256)
        table, width = {bytes([i]): i for i in range(256)}, 9

    table = {bytes([i]): i for i in range(256)}
    clear()
    last, n = b"", 258
    for b in data:
        piece = last + bytes([b])
        if piece in table:
            last = piece
            continue
        put(table[last])
        table[piece] = n
        n, last = n + 1, bytes([b])
        width = 9 + (n > 511) + (n > 1023) + (n > 2047)
        if n == 4095:
            clear()
            n = 258
    if last:
        put(table[last])
        n += 1
        width = 9 + (n > 511) + (n > 1023) + (n > 2047)
    put(257)
    out.append(held << (8 - bits) & 255) if bits else None
    return bytes(out)


@pytest.mark.parametrize("packing", [1, 5, 8, 32773])
@pytest.mark.parametrize(("kind", "predictor"), [("<f4", 1), ("<f4", 3), ("<i2", 2), (">u2", 2), (">f8", 3), ("<u1", 1)])
@pytest.mark.parametrize(("tile", "bands", "planar"), [(0, 1, 1), (16, 1, 1), (16, 3, 1), (16, 2, 2), (0, 3, 2)])
def test_geotiff_as_others_write_it(kind, predictor, packing, tile, bands, planar):
    import struct
    import zlib

    rng = np.random.RandomState(5)
    h, w, e, size = 37, 45, kind[0], int(kind[2:])
    a = (rng.randint(0, 200, (bands, h, w)) // 7 * 7).astype(kind)
    pack = {1: bytes, 5: _lzw, 8: zlib.compress, 32773: lambda x: b"".join(bytes([len(x[i : i + 100]) - 1]) + x[i : i + 100] for i in range(0, len(x), 100))}[packing]

    def encoded(block):  # [row, column, sample]
        if predictor == 2:
            block = np.concatenate([block[:, :1], np.diff(block.astype("i8"), axis=1).astype(block.dtype)], axis=1).astype(kind)
        if predictor == 3:
            rows, cols, n = block.shape
            planes = np.ascontiguousarray(block.astype(">" + kind[1:])).view(np.uint8).reshape(rows, cols * n, size).transpose(0, 2, 1).reshape(rows, cols * size, n)
            return np.concatenate([planes[:, :1], np.diff(planes.astype("i2"), axis=1).astype(np.uint8)], axis=1).tobytes()
        return block.tobytes()

    tw, th = (tile, tile) if tile else (w, 10)
    blocks = []
    for part in [a[b : b + 1] for b in range(bands)] if planar == 2 else [a]:
        for r in range(0, h, th):
            for c in range(0, w, tw):
                x = part[:, r : r + th, c : c + tw].transpose(1, 2, 0)
                if tile:
                    x = np.pad(x, ((0, th - x.shape[0]), (0, tw - x.shape[1]), (0, 0)))
                blocks.append(pack(encoded(np.ascontiguousarray(x))))
    at = [8 + sum(map(len, blocks[:i])) for i in range(len(blocks))]
    tags = {256: [w], 257: [h], 258: [8 * size] * bands, 259: [packing], 277: [bands], 284: [planar], 317: [predictor], 339: [{"u": 1, "i": 2, "f": 3}[kind[1]]] * bands}
    tags |= {322: [tw], 323: [th], 324: at, 325: list(map(len, blocks))} if tile else {273: at, 278: [th], 279: list(map(len, blocks))}
    data, head = b"".join(blocks), 8 + sum(map(len, blocks))
    entries, extra = b"", b""
    for tag, values in sorted(tags.items()):
        raw = struct.pack(f"{e}{len(values)}I", *values)
        where = raw if len(raw) <= 4 else struct.pack(e + "I", head + 2 + 12 * len(tags) + 4 + len(extra))
        extra += raw if len(raw) > 4 else b""
        entries += struct.pack(e + "HHI", tag, 4, len(values)) + where
    tiff = (b"II" if e == "<" else b"MM") + struct.pack(e + "HI", 42, head) + data + struct.pack(e + "H", len(tags)) + entries + bytes(4) + extra
    got, _ = raster.geotiff(tiff)
    assert (got == a.astype(float)).all()


def test_lzw_of_long_data():
    rng = np.random.RandomState(0)
    for data in (b"", b"a", b"ab" * 9000, bytes(rng.randint(0, 256, 40_000, dtype=np.uint8)), bytes(rng.randint(0, 3, 90_000, dtype=np.uint8))):
        assert raster.lzw(_lzw(data)) == data


def test_polygons_are_clipped_and_overlaid(spark):
    ring = lambda ps: [{"x": float(x), "y": float(y)} for x, y in [*ps, ps[0]]]
    shapes = {1: [(0, 0), (4, 0), (0, 4)], 2: [(1, 1), (3, 1), (3, 3), (1, 3)], 3: [(0, 0), (6, 0), (6, 6), (3, 1), (0, 6)]}
    df = spark.createDataFrame([(i, ring(p), 10.0 * i) for i, p in shapes.items()], "area_id long, ring array<struct<x:double,y:double>>, population double")
    part = lambda b: {r.area_id: r.a for r in df.select("area_id", g.let(g.clip_to_box(F.col("ring"), *b), g.polygon_area).alias("a")).collect()}
    assert part((0.0, 0.0, 2.0, 2.0)) == pytest.approx({1: 4.0, 2: 1.0, 3: 4.0})
    assert part((2.0, 0.0, 9.0, 9.0)) == pytest.approx({1: 2.0, 2: 2.0, 3: 21 - (12 - 10 / 3)})
    assert part((7.0, 7.0, 9.0, 9.0)) == pytest.approx({1: 0.0, 2: 0.0, 3: 0.0})
    whole = sum(r.density for r in population.population_grid(df, 0.5).collect()) * 0.25
    boxes = df.where("area_id = 2").selectExpr("area_id", "population", "1e0 as minx", "1e0 as miny", "3e0 as maxx", "3e0 as maxy")
    by = lambda d: {(r.i, r.j): r.density for r in population.population_grid(d, 0.7).collect()}
    assert by(df.where("area_id = 2")) == pytest.approx(by(boxes)) and 45 < whole <= 60
    rng = np.random.RandomState(1)
    xy = rng.uniform(0, 6, (400, 2))
    obs = spark.createDataFrame([(float(x), float(y), float(i)) for i, (x, y) in enumerate(xy)], "longitude double, latitude double, v double")
    got = {r.area_id: r.n for r in weather.overlay(df, obs, "v", size=1.0).collect()}

    def inside(p, x, y):
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(p, p[1:] + p[:1], strict=True)) % 2

    assert got == {i: sum(inside(p, x, y) for x, y in xy) for i, p in shapes.items()}


def test_json_files(tmp_path):
    from cartolith.sources import files

    files.write_json(f"file://{tmp_path}/a/b.json", {"k": [1, "é", None]})
    assert files.read_json(f"file://{tmp_path}/a/b.json") == {"k": [1, "é", None]} and len(files.files(f"file://{tmp_path}/a", ".json")) == 1


def test_nearest_distance_of_crowded_places(spark, monkeypatch):
    from cartolith.operators import bandjoin

    monkeypatch.setattr(bandjoin, "CROWD", 20)
    rng = np.random.RandomState(3)
    xy = np.concatenate([rng.normal(0, 0.001, (150, 2)), rng.normal(50, 0.01, (80, 2)), rng.uniform(-1000, 1000, (10, 2)), [[0, 0]] * 30])
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    np.fill_diagonal(d, np.inf)
    got = {r.id: r.d for r in nearest_distance(pts(spark, xy), "feature_id", "lon", "lat").collect()}
    assert np.allclose([got[i] for i in range(len(xy))], d.min(1))


def test_grids_are_joined_by_shuffle(spark):
    """A grid whose files look small is not sent to the driver."""
    dem = spark.range(30).selectExpr("id div 5 as r", "id % 5 as c", "cast(id * 7 % 11 as double) as elev")
    for f in (terrain.roughness_range, terrain.roughness_stats):
        assert "BroadcastHashJoin" not in f(dem)._jdf.queryExecution().executedPlan().toString()


def test_roughness_stats_like_the_single_methods(spark):
    """With nodata, an elevation that equals the sentinel, repeated and null cells, and without a cell."""
    rows = [(r, c, None if (r + c) % 7 == 0 else float((r * r + c) % 5)) for r in range(6) for c in range(6)]
    dem = spark.createDataFrame([*rows, (2, 2, 3.0), (3, 4, None), (None, 1, 2.0), (20, 20, -9999.0), (30, 30, 1.0)], "r long, c long, elev double")
    ok = dem.where("elev is not null").select("r", "c")
    for d in (dem, dem.limit(0)):
        got = {x.method: tuple(x)[1:] for x in terrain.roughness_stats(d).collect()}
        for name, f in (("std", terrain.roughness_std), ("range", terrain.roughness_range), ("tri", terrain.tri), ("vrm", terrain.vrm)):
            want = f(d).join(ok, ["r", "c"], "left_semi").selectExpr("avg(value)", "stddev_pop(value)", "min(value)", "max(value)").first()
            assert got[name] == pytest.approx(tuple(want), nan_ok=True), name


@pytest.mark.parametrize("seed", [0, 1])
def test_points_of_one_place_meet_as_one(spark, monkeypatch, seed):
    """Hot spots, Moran and overlap of crowded places, repeated ids and nulls like all pairs of points; what is joined are places."""
    rnd = random.Random(seed)
    rows = [(i if i % 9 else 5, float(rnd.randint(0, 5)), float(rnd.randint(0, 5)), None if i % 13 == 0 else rnd.random()) for i in range(300)]
    rows += [(None, 1.0, 1.0, 2.0), (900, None, 1.0, 2.0), (901, 50.0, 50.0, 1.0)]
    df = spark.createDataFrame(rows, "feature_id long, lon double, lat double, val double")
    met = []
    for module in (spatial_stats, network):
        join = module.band_join
        monkeypatch.setattr(module, "band_join", lambda a, *more, join=join: met.append(a.count()) or join(a, *more))
    gi = spatial_stats.hot_spots(df, "val", 1.5).collect()
    moran = spatial_stats.morans_i(df, "val", 1.5).first()
    overlap = network.service_overlap(df, 0.75).first()
    assert met and max(met) <= 37

    at = [r for r in rows if r[0] is not None and r[1] is not None]
    near = [(a, b, d) for a in at for b in at if a[0] != b[0] and (d := math.hypot(a[1] - b[1], a[2] - b[2])) <= 1.5]
    vs = [r[3] for r in rows if r[3] is not None]
    n, mean, s = len(rows), statistics.mean(vs), statistics.pstdev(vs)
    ids = {r[0] for r in rows}
    w = {i: sum(a[0] == i for a, _, _ in near) for i in ids}
    wx = {i: sum(b[3] or 0 for a, b, _ in near if a[0] == i) for i in ids}
    var = {i: s * s * (w[i] * (n - 1) - w[i] ** 2) / (n - 1) for i in ids}
    want = [(wx[r[0]] - w[r[0]] * mean) / math.sqrt(var[r[0]]) if var[r[0]] > 0 else 0.0 for r in rows]
    assert sorted(x.gi for x in gi) == pytest.approx(sorted(want), abs=1e-9)
    num = sum((a[3] - mean) * (b[3] - mean) for a, b, _ in near if a[3] is not None and b[3] is not None)
    assert moran.i == pytest.approx(n * num / (2 * len(near) * statistics.pvariance(vs) * n * (n - 1)))
    lens = [x for a, b, d in near if a[0] < b[0] and (x := 2 * 0.75**2 * math.acos(min(1.0, d / 1.5)) - d / 2 * math.sqrt(max(0.0, 2.25 - d * d))) > 0]
    assert (overlap.pairs, overlap.total) == (len(lens), pytest.approx(sum(lens)))
