"""All queries of the library proper by name, over the roles of fixtures.py, and their DuckDB text.

Computed doubles are rounded to six places on both sides: engines add up in different orders.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.functions import geometry as g
from cartolith.operators import chunking, network, population, retrieval, spatial_query, spatial_stats, temporal, terrain, weather
from cartolith.plans import runner
from cartolith.plans.fixtures import view, with_views
from cartolith.sources import samples, sinks, vector

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(F.col(f"`{c}`").cast("double"), 6) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def add(name: str, roles: str, build: Callable[..., DataFrame], sql: str | None = None) -> None:
    """build gets the roles as DataFrames."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(build(*[view(spark, sf_dir, r) for r in roles.split()]))

    query.__doc__ = name
    _QUERIES[name] = query
    if sql:
        _ORACLES[name] = with_views(" ".join(sql.split()))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# ------------------------------------------------------------------ spatial queries, presentation
LAT, LON, KM = 10.0, 20.0, 3000.0
RAD = KM * 1000 / 111_000.0
engine = spatial_query.SpatialQueryEngine
_disc = f"hypot_(lon-{LON}e0, lat-{LAT}e0) <= {RAD!r}e0".replace("hypot_(", "sqrt(pow(").replace(f", lat-{LAT}e0)", f",2)+pow(lat-{LAT}e0,2))").replace("e0e0", "e0")
add("range_query", "points", lambda p: engine(p).range_query(LAT, LON, KM).select("feature_id", "name", "lon", "lat"), f"select feature_id, name, R(lon) as lon, R(lat) as lat from points where {_disc}")
add("point_query", "points", lambda p: engine(p).point_query(LAT, LON, 1500.0).select("feature_id"), "select feature_id from points where sqrt(pow(lon-20e0,2)+pow(lat-10e0,2)) <= 1500000e0/111000e0")
add("range_query_buffer", "points", lambda p: spatial_query.within_distance(p, LAT, LON, KM * 1000, exact=True).select("feature_id"), """
    select feature_id from (select *, lon-20e0 as dx, lat-10e0 as dy, 3000000e0/111000e0 as r, pi()/32 as d from points)
    where sqrt(dx*dx+dy*dy)*cos((atan2(dy,dx) - d*floor(atan2(dy,dx)/d)) - d/2) <= r*cos(d/2)""")
add("range_query_std", "points", lambda p: spatial_query.within_distance_std(p, LAT, LON, KM * 1000).select("feature_id"), """
    select feature_id from points where 2*6378137e0*asin(sqrt(least(1e0, pow(sin((radians(lat)-radians(10e0))/2),2)+cos(radians(10e0))*cos(radians(lat))*pow(sin((radians(lon)-radians(20e0))/2),2)))) <= 3000000e0""")
_TRI = [(-100.0, -50.0), (120.0, -20.0), (0.0, 70.0)]
add("polygon_query", "points", lambda p: engine(p).polygon_query(_TRI).select("feature_id"), """
    select feature_id from points where (lon+100e0)*30e0-(lat+50e0)*220e0 < 0 and (lon-120e0)*90e0-(lat+20e0)*(-120e0) < 0 and (lon-0e0)*(-120e0)-(lat-70e0)*(-100e0) < 0""")
add("bbox_query", "points", lambda p: engine(p).bbox_query(-30.0, -60.0, 40.0, 50.0).select("feature_id"), "select feature_id from points where lon between -60e0 and 50e0 and lat between -30e0 and 40e0")
add("validate_normalize", "points", lambda p: spatial_query.validate_normalize(p.withColumn("lat", F.when(F.col("feature_id") % 7 != 0, F.col("lat") * 1.1))).select("feature_id", "lon", "lat"), "select feature_id, R(lon) as lon, R(lat*1.1e0) as lat from points where feature_id%7<>0 and abs(lat*1.1e0)<=90")
add("project_mercator", "points", lambda p: spatial_query.validate_normalize(p, target=3857).select("feature_id", "lon", "lat"), "select feature_id, R(radians(lon)*6378137e0) as lon, R(ln(tan(pi()/4+radians(lat)/2))*6378137e0) as lat from points")
add("validate_report", "points", lambda p: spatial_query.validate_report(p.select("lon", "lat", "category")), """
    select 'warning' as severity, 'no_name' as code, cast(1 as bigint) as n union all select 'warning','invalid_geometry', cast(count(*) filter (where lon is null or lat is null) as bigint) from points
    union all select 'warning','crs',0 union all select 'warning','duplicates',(select count(*) from points)-(select count(*) from (select distinct lon,lat,category from points)) union all select 'error','empty', cast(count(*)=0 as bigint) from points""")
add("quick_stats", "points", spatial_query.quick_stats, "select count(*) as n, 'Point' as geometry_type, 'EPSG:4326' as crs, cast(6 as int) as n_columns, R(min(lon)) as minx, R(min(lat)) as miny, R(max(lon)) as maxx, R(max(lat)) as maxy from points")
add("total_bounds", "points", spatial_query.total_bounds, "select R(min(lon)) as minx, R(min(lat)) as miny, R(max(lon)) as maxx, R(max(lat)) as maxy from points")
add("map_center", "points", spatial_query.map_center, "select R(avg(lat)) as lat, R(avg(lon)) as lon from (select distinct lon, lat from points)")
add("format_results", "points", lambda p: spatial_query.format_results(p.withColumn("s", (F.col("feature_id") % 101) / 100.0), "s"), """
    select feature_id, name, format('{:.4f}', abs(lat)) || case when lat>=0 then '°N' else '°S' end || ', ' || format('{:.4f}', abs(lon)) || case when lon>=0 then '°E' else '°W' end as position,
      R((feature_id%101)/100e0*100) as pct, case when (feature_id%101)/100e0*100>=80 then 'high' when (feature_id%101)/100e0*100>=60 then 'medium' else 'low' end as bucket from points""")
add("to_table", "points", lambda p: spatial_query.to_table(p.select("feature_id", "name"), 20), "select feature_id, name, (select count(*) from points) as total from points order by feature_id limit 20")
add("marker_layer", "points", lambda p: spatial_query.marker_layer(p, "data"), "select 'data' as layer, R(lat) as lat, R(lon) as lon, name as label from points")

# ------------------------------------------------------------------ geometry
_box = lambda a: a.withColumn("ring", g.bounds_polygon("minx", "miny", F.col("minx") + 10, F.col("miny") + 10))
add("bounds_polygon", "areas", lambda a: _box(a).select("area_id", F.posexplode("ring").alias("i", "p")).select("area_id", "i", "p.x", "p.y"), """
    select area_id, cast(i as int) as i, R(minx + case when i in (2,3) then 10 else 0 end) as x, R(miny + case when i in (1,2) then 10 else 0 end) as y from areas, range(5) t(i)""")
add("polygon_area", "areas", lambda a: _box(a).select("area_id", g.polygon_area(F.col("ring")).alias("area")), "select area_id, 100e0 as area from areas")
add("centroid", "areas", lambda a: _box(a).select("area_id", g.centroid(F.col("ring")).alias("c")).select("area_id", "c.x", "c.y"), "select area_id, R(minx+5) as x, R(miny+5) as y from areas")
add("line_length", "network", lambda n: n.select("link_id", g.line_length(F.array(g.point("ux", "uy"), g.point("vx", "vy"))).alias("length")), "select link_id, R(sqrt(pow(ux-vx,2)+pow(uy-vy,2))) as length from network")
add("geojson_roundtrip", "areas", lambda a: sinks.parse_geometry(sinks.geometry_json(_box(a).select("area_id", "ring")), "area_id").select("area_id", g.polygon_area(F.col("ring")).alias("area")), "select area_id, 100e0 as area from areas")

# ------------------------------------------------------------------ chunks and index
_grid_sql = """
    with b as (select min(lon) x0, min(lat) y0, max(lon) x1, max(lat) y1 from points), n as (select *, cast(ceil((x1-x0)/25e0) as bigint) nx, cast(ceil((y1-y0)/25e0) as bigint) ny from b),
    c as (select *, unnest(generate_series(0, nx-1)) as i from n), d as (select *, unnest(generate_series(0, ny-1)) as j from c)
    select i*ny+j as chunk_id, R(x0+i*25e0) as minx, R(y0+j*25e0) as miny, R(least(x0+i*25e0+25e0,x1)) as maxx, R(least(y0+j*25e0+25e0,y1)) as maxy from d"""
add("grid_chunks", "points", lambda p: chunking.grid_chunks(p, 25.0), _grid_sql)
add("kmeans_chunks", "points", lambda p: chunking.kmeans_chunks(p, 10))
add("build_index", "points", lambda p: chunking.build_index(p, 10.0).select("id", "minx", "miny", "maxx", "maxy", "centroid_lat", "centroid_lon", "cell_id"), """
    select feature_id as id, R(lon) as minx, R(lat) as miny, R(lon) as maxx, R(lat) as maxy, R(lat) as centroid_lat, R(lon) as centroid_lon, cast(floor(lon/10e0) as bigint) || '_' || cast(floor(lat/10e0) as bigint) as cell_id from points""")
add("index_metadata", "points", lambda p: chunking.index_metadata(chunking.build_index(p.select("feature_id", "lon", "lat", "name", F.lit("own").alias("minx")))).select("id", F.element_at("metadata", "name").alias("name"), F.element_at("metadata", "minx").alias("minx"), F.size("metadata").alias("keys")), "select feature_id as id, name, 'own' as minx, cast(7 as int) as keys from points")
add("index_features", "points", lambda p: chunking.index_features(p, retrieval.hash_embedding()).select("id", "document", F.size("embedding").alias("dim")), "select 'feat-' || feature_id as id, 'Feature: ' || name as document, cast(384 as int) as dim from points")
add("chunks_geojson", "points", lambda p: sinks.chunks_written(chunking.grid_chunks(p, 25.0), {"cell_size": 25.0}), _grid_sql)

# ------------------------------------------------------------------ retrieval
_Q0 = lambda v: [float(x) for x in v.where("vec_id = 0").first().embedding]
_dist = "1 - list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: cast(p[1] as double)*cast(p[2] as double)))/(sqrt(list_sum(list_transform(e.embedding, lambda x: cast(x as double)*cast(x as double))))*sqrt(list_sum(list_transform(q.embedding, lambda x: cast(x as double)*cast(x as double)))))"
_from = "from vectors e, (select embedding from vectors where vec_id = 0) q"
_engine = lambda v: retrieval.RetrievalEngine(v, v.where("vec_id % 2 = 0"), "vec_id")
add("hash_embedding", "points", lambda p: p.select("feature_id", F.explode(retrieval.hash_embedding()(F.col("name"))).alias("x")))
add("vector_topk", "vectors", lambda v: retrieval.top_k(v, _Q0(v), 10, "vec_id").select("vec_id", "distance"), f"select vec_id, R(d) as distance from (select e.vec_id, {_dist} as d {_from}) order by d, vec_id limit 10")
add("vector_topk_batch", "vectors", lambda v: retrieval.top_k_batch(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), 5, "vec_id").select("query_id", "rank", "vec_id"), f"""
    select query_id, cast(rank as int) as rank, vec_id from (select *, row_number() over (partition by query_id order by d, vec_id) as rank from (select q.vec_id as query_id, e.vec_id, {_dist} as d from vectors e, (select * from vectors where vec_id%20=0) q)) where rank<=5""")
add("semantic_search", "vectors", lambda v: _engine(v).semantic_search(_Q0(v), 5, (-60.0, -40.0, 60.0, 40.0)).select("vec_id", "distance"), f"select vec_id, R(d) as distance from (select e.vec_id, {_dist} as d {_from} where minx<=60 and maxx>=-60 and miny<=40 and maxy>=-40) order by d, vec_id limit 5")
add("image_search", "vectors", lambda v: _engine(v).image_search(_Q0(v), 5).select("vec_id", "distance"), f"select vec_id, R(d) as distance from (select e.vec_id, {_dist} as d {_from} where e.vec_id%2=0) order by d, vec_id limit 5")
add("hybrid_search", "vectors", lambda v: _engine(v).hybrid_search(_Q0(v), 0.0, 0.0, 5000.0).select("vec_id", "distance"), f"select vec_id, R(d) as distance from (select e.vec_id, {_dist} as d {_from} where sqrt(minx*minx+miny*miny) <= 5000000e0/111000e0) order by d, vec_id limit 10")
add("semantic_threshold", "vectors", lambda v: retrieval.threshold(retrieval.top_k(v, _Q0(v), 10, "vec_id"), 0.3).select("vec_id", "similarity"), f"select vec_id, R(1-d) as similarity from (select e.vec_id, {_dist} as d {_from} order by d, e.vec_id limit 10) where 1-d >= 0.3e0")
add("assemble_context", "vectors", lambda v: retrieval.assemble_context(retrieval.top_k(v, _Q0(v), 5, "vec_id"), "vec_id").select("rank", "vec_id", "distance"), f"select cast(row_number() over (order by d, vec_id) as int) as rank, vec_id, R(d) as distance from (select e.vec_id, {_dist} as d {_from} order by d, e.vec_id limit 5)")
add("bbox_meta_filter", "vectors", lambda v: v.where(g.boxes_overlap(-60.0, -40.0, 60.0, 40.0)).select("vec_id"), "select vec_id from vectors where minx<=60 and maxx>=-60 and miny<=40 and maxy>=-40")
add("vec_add", "vectors", lambda v: retrieval.add_rows(v, v.withColumn("vec_id", F.col("vec_id") + 1), "vec_id").select("vec_id"), "select vec_id from vectors union select vec_id+1 from vectors")
add("vec_delete", "vectors", lambda v: retrieval.delete_rows(v, v.where("vec_id % 3 = 0").select("vec_id"), "vec_id").select("vec_id"), "select vec_id from vectors where vec_id%3<>0")

# ------------------------------------------------------------------ spatial statistics
_cells = lambda cs: f"b as (select min(lon) x0, min(lat) y0, max(lon) x1, max(lat) y1 from points), c as (select i, j, x0+i*{cs} as gx, y0+j*{cs} as gy from b, lateral (select unnest(generate_series(0, cast(ceil((x1-x0)/{cs}) as bigint)-2)) as i), lateral (select unnest(generate_series(0, cast(ceil((y1-y0)/{cs}) as bigint)-2)) as j))"
add("kernel_density", "points", lambda p: spatial_stats.kernel_density(p, 30.0, "val"), f"with {_cells('30e0')} select i, j, R(sum(val*exp(-0.5e0*pow(sqrt(pow(lon-(gx+15e0),2)+pow(lat-(gy+15e0),2))/60e0,2)))) as density from c, points group by i, j")
add("kernel_density_stats", "points", lambda p: spatial_stats.density_stats(spatial_stats.kernel_density(p, 30.0)), f"with {_cells('30e0')}, k as (select i, j, sum(exp(-0.5e0*pow(sqrt(pow(lon-(gx+15e0),2)+pow(lat-(gy+15e0),2))/60e0,2))) as d from c, points group by i, j) select count(*) as cells, R(avg(d)) as mean, R(max(d)) as max, R(min(d)) as min, R(stddev_pop(d)) as std from k")
add("grid_density", "points", lambda p: spatial_stats.grid_density(p, 20.0), f"with {_cells('20e0')} select i, j, R(count(lon)) as density from c left join points on lon>gx and lon<gx+20e0 and lat>gy and lat<gy+20e0 group by i, j")
add("spatial_kmeans", "points", lambda p: spatial_stats.spatial_kmeans(p, 5))
_dbscan = """
    with recursive e as (select a.feature_id i, b.feature_id j from points a join points b on sqrt(pow(a.lon-b.lon,2)+pow(a.lat-b.lat,2))<=4e0), k as (select i from e group by i having count(*)>=4),
    ce as (select i, j from e where i in (select i from k) and j in (select i from k)), reach as (select i as root, i as node from k union select r.root, ce.j from reach r join ce on ce.i=r.node),
    lab as (select node, min(root) as c from reach group by node), num as (select c, row_number() over (order by c)-1 as cluster from (select distinct c from lab)),
    own as (select node, cluster from lab join num using (c)), border as (select e.i, min(cluster) as cluster from e join own on own.node=e.j group by e.i),
    labelled as (select feature_id, own.node is not null as is_core, coalesce(own.cluster, border.cluster, -1) as cluster from points left join own on own.node=feature_id left join border on border.i=feature_id)"""
add("dbscan", "points", lambda p: spatial_stats.dbscan(p, 4.0, 4).withColumnRenamed("id", "feature_id"), f"{_dbscan} select * from labelled")
add("dbscan_summary", "points", lambda p: spatial_stats.dbscan_summary(p, spatial_stats.dbscan(p, 4.0, 4)), f"""{_dbscan}
    select cluster, count(*) as size, R(avg(lon)) as center_x, R(avg(lat)) as center_y, R(count(*)/cast((select count(*) from points) as double)) as density from labelled join points using (feature_id) group by cluster""")
_near = "near as (select a.feature_id as id, a.val as v, b.val as v2 from points a join points b on a.feature_id<>b.feature_id and sqrt(pow(a.lon-b.lon,2)+pow(a.lat-b.lat,2))<=10e0)"
_gi = f"with {_near}, s as (select id, sum(v2) wx, cast(count(*) as double) w from near group by id), a as (select avg(val) m, stddev_pop(val) s0, cast(count(*) as double) n from points), g as (select feature_id as id, coalesce(w,0) w, coalesce(wx,0) wx, m, s0*s0*(coalesce(w,0)*(n-1)-coalesce(w,0)*coalesce(w,0))/(n-1) as var from points left join s on s.id=feature_id, a), r as (select id, case when var>0 then (wx-w*m)/sqrt(var) else 0 end as gi from g)"
add("hot_spots", "points", lambda p: spatial_stats.hot_spots(p, "val", 10.0), f"{_gi} select id, R(gi) as gi, case when gi>1.96e0 then 'hot' when gi<-1.96e0 then 'cold' else 'none' end as kind from r")
add("hot_spot_summary", "points", lambda p: spatial_stats.hot_spot_summary(spatial_stats.hot_spots(p, "val", 10.0)), f"{_gi} select count(*) filter (where gi>1.96e0) as hot, count(*) filter (where gi<-1.96e0) as cold, R(avg(gi)) as mean_gi, R(stddev_pop(gi)) as std_gi from r")
_moran = lambda den: f"""with {_near}, a as (select avg(val) mu, cast(count(*) as double) n, var_pop(val)*count(*) ss from points), t as (select sum((v-mu)*(v2-mu)) num, cast(count(*) as double) w from near, a),
    r as (select n*num/({den}) as i, -1/(n-1) as e, (n*n-3*n+3)/((n-1)*(n+1))-pow(-1/(n-1),2) as vr from a, t), z as (select *, (i-e)/sqrt(vr) as z from r)
    select R(i) as i, R(e) as expected, R(vr) as variance, R(z) as z, R(2*(1-abs(z))) as p, case when abs(z)<1.96e0 then 'random' when i>0 then 'clustered' else 'dispersed' end as interpretation from z"""  # noqa: E731
add("morans_i", "points", lambda p: spatial_stats.morans_i(p, "val", 10.0), _moran("2*w*ss*(n-1)"))
add("morans_i_std", "points", lambda p: spatial_stats.morans_i(p, "val", 10.0, std=True), _moran("w*ss"))
add("nearest_neighbor", "points", spatial_stats.nearest_neighbor, """
    with d as (select a.feature_id, min(sqrt(pow(a.lon-b.lon,2)+pow(a.lat-b.lat,2))) as d from points a join points b on a.feature_id<>b.feature_id group by a.feature_id),
    s as (select avg(d) m, stddev_pop(d) sd, cast(count(*) as double) n from d), b as (select (max(lon)-min(lon))*(max(lat)-min(lat)) as area from points),
    r as (select m, sd, n/area as density, 0.5e0/sqrt(n/area) as e, 0.26136e0/sqrt(n*n/area) as se from s, b)
    select R(m) as mean, R(sd) as std, R(e) as expected, R(m/e) as ratio, R((m-e)/se) as z, R(density) as density, case when abs((m-e)/se)<1.96e0 then 'Random' when m/e<1 then 'Clustered' else 'Dispersed' end as pattern from r""")

# ------------------------------------------------------------------ time
_ord = "row_number() over (order by obs_ts, event_id)"
_t = "epoch_us(obs_ts)/1e6"
add("ts_stats", "weather", lambda w: temporal.ts_stats(w, "obs_ts", "temperature").select(F.col("days"), "n", "dates", "mean", "std", "min", "max"), "select cast(floor((epoch_us(max(obs_ts))-epoch_us(min(obs_ts)))/86400000000) as bigint) as days, count(*) as n, count(distinct cast(obs_ts as date)) as dates, R(avg(temperature)) as mean, R(stddev_samp(temperature)) as std, R(min(temperature)) as min, R(max(temperature)) as max from weather")
_tr = f"with o as (select temperature v, {_t}-(select min({_t}) from weather) as t, {_ord}-1 as i from weather), a as (select regr_slope(v,t) s, regr_intercept(v,t) b, regr_r2(v,t) r, sqrt(greatest(0,(1-regr_r2(v,t))*regr_syy(v,t)/regr_sxx(v,t)/(count(*)-2))) se, sqrt(regr_syy(v,i)*(1-regr_r2(v,i))/count(*)) d, cast(count(*) as double) n from o)"
add("ts_trend", "weather", lambda w: temporal.trend(w, "obs_ts", "temperature", "event_id").select((F.col("slope") * 1e6).alias("slope_per_million"), "intercept", "r2", (F.col("stderr") * 1e6).alias("stderr_per_million"), "detrended_std", "n"), f"{_tr} select R(s*1e6) as slope_per_million, R(b) as intercept, R(r) as r2, R(se*1e6) as stderr_per_million, R(d) as detrended_std, R(n) as n from a")
add("ts_trend_p", "weather", lambda w: temporal.trend(w, "obs_ts", "temperature", "event_id").select("p", "interpretation"))
add("mann_kendall", "weather", lambda w: temporal.mann_kendall(w, "obs_ts", "temperature", "event_id").select("n", "s", "var", "z"), f"""
    with o as (select temperature v, {_ord} i from weather), p as (select cast(sum(case when b.v>a.v then 1 when b.v<a.v then -1 else 0 end) as bigint) s from o a join o b on a.i<b.i), n as (select count(*) n from o)
    select n, s, R(cast(n as double)*(n-1)*(2*n+5)/18) as var, R(case when s>0 then (s-1)/sqrt(cast(n as double)*(n-1)*(2*n+5)/18) when s<0 then (s+1)/sqrt(cast(n as double)*(n-1)*(2*n+5)/18) else 0 end) as z from p, n""")
add("monthly_pattern", "orders", lambda o: temporal.seasonal_pattern(o, "o_orderdate", "o_totalprice", "month"), "select cast(month(o_orderdate) as int) as month, R(avg(o_totalprice)) as mean, R(stddev_samp(o_totalprice)) as std, count(*) as n from orders group by 1")
add("weekly_pattern", "weather", lambda w: temporal.seasonal_pattern(w, "obs_ts", "temperature", "week"), "select cast(weekofyear(obs_ts) as int) as week, R(avg(temperature)) as mean, R(stddev_samp(temperature)) as std, count(*) as n from weather group by 1")
_dec = "with o as (select obs_ts, event_id, temperature v, weekofyear(obs_ts) k from weather), d as (select *, case when count(*) over w = 13 then avg(v) over w end as trend, avg(v) over (partition by k) - (select avg(v) from o) as seasonal from o window w as (order by obs_ts, event_id rows between 6 preceding and 6 following))"
add("seasonal_decompose", "weather", lambda w: temporal.seasonal_decompose(w, "obs_ts", "temperature", "event_id", "week").select(F.col("tie").alias("event_id"), "trend", "seasonal", "residual"), f"{_dec} select event_id, R(trend) as trend, R(seasonal) as seasonal, R(v-trend-seasonal) as residual from d")
add("seasonality_strength", "weather", lambda w: temporal.seasonality_strength(temporal.seasonal_decompose(w, "obs_ts", "temperature", "event_id", "week")), "select 0e0 as strength")
add("seasonality_strength_std", "weather", lambda w: temporal.seasonality_strength(temporal.seasonal_decompose(w, "obs_ts", "temperature", "event_id", "week"), True), f"{_dec} select R(least(1e0, var_pop(seasonal)/(var_pop(seasonal)+var_pop(v-trend-seasonal)))) as strength from d")
_chg = f"with o as (select {_ord}-1 as i, temperature v, avg(temperature) over w m, stddev_samp(temperature) over w s, count(*) over w c, count(*) over () n from weather window w as (order by obs_ts, event_id rows between 5 preceding and 4 following)), k as (select i, v, abs(v-m)/nullif(s,0) as z from o where c=10 and i>=10 and i<n-10)"
add("change_points", "weather", lambda w: temporal.change_candidates(w, "obs_ts", "temperature", "event_id").select(F.col("i").cast("long").alias("i"), "v", "z"), f"{_chg} select i, R(v) as v, R(z) as z from k where z>2")
add("change_points_deduped", "weather", lambda w: temporal.change_points(w, "obs_ts", "temperature", "event_id").select(F.col("i").cast("long").alias("i"), "v", "z"), f"""{_chg.replace("with o as", "with recursive o as", 1)}, c as (select * from k where z>2),
    kept as (select min(i) as i from c union all select (select min(c.i) from c where c.i>=kept.i+10) from kept where kept.i is not null) select i, R(v) as v, R(z) as z from kept join c using (i)""")
add("trend_by_location", "placed_yearly", lambda y: temporal.trend_by_location(y.withColumn("ts", F.make_timestamp_ntz(F.col("yr").cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))), "ts", "population", "location").select("location", "n", "mean", "std", (F.col("slope") * 1e6).alias("slope_per_million"), "r2"), "select location, count(*) as n, R(avg(population)) as mean, R(stddev_pop(population)) as std, R(regr_slope(population, epoch_us(make_timestamp(cast(yr as bigint),1,1,0,0,0e0))/1e6)*1e6) as slope_per_million, R(regr_r2(population, epoch_us(make_timestamp(cast(yr as bigint),1,1,0,0,0e0))/1e6)) as r2 from placed_yearly group by location having count(*)>1")
add("temporal_kmeans", "weather", lambda w: temporal.temporal_kmeans(w, "obs_ts", "temperature", 3))
add("autocorrelation", "weather", lambda w: temporal.autocorrelation(w, "obs_ts", "temperature", "event_id", 5), "with o as (select temperature v, " + ", ".join(f"lag(temperature,{k}) over (order by obs_ts, event_id) as l{k}" for k in range(1, 6)) + " from weather) " + " union all ".join(f"select cast({k} as int) as lag, R(corr(v,l{k})) as r, abs(corr(v,l{k}))>0.2e0 as significant from o" for k in range(1, 6)))

# ------------------------------------------------------------------ elevation
_st = "st as (select d.r, d.c, d.elev, o.dr, n.dc, e.elev as v from dem d, (select unnest([-1,0,1]) dr) o, (select unnest([-1,0,1]) dc) n, (select max(r) mr, max(c) mc from dem) b join dem e on e.r=greatest(0,least(d.r+o.dr,b.mr)) and e.c=greatest(0,least(d.c+n.dc,b.mc)))"
_in = "inn as (select d.r, d.c, d.elev, e.r-d.r as dr, e.c-d.c as dc, e.elev as v from dem d join dem e on abs(e.r-d.r)<=1 and abs(e.c-d.c)<=1)"
_sl = f"{_st}, g as (select r, c, sum(dc*case when dr=0 then 2 else 1 end*v) gx, sum(dr*case when dc=0 then 2 else 1 end*v) gy from st group by r, c), sa as (select r, c, degrees(atan(sqrt(gx*gx+gy*gy)/60e0)) as slope, (degrees(atan2(gy+0e0,gx+0e0))+360)%360e0 as aspect from g)"
add("dem_stats", "dem", terrain.dem_stats, "select R(min(elev)) as min, R(max(elev)) as max, R(avg(elev)) as mean, R(stddev_pop(elev)) as std, R(median(elev)) as median, max(r)+1 as rows, max(c)+1 as cols, count(elev) as valid, count(*)-count(elev) as missing from dem")
add("dem_histogram", "dem", terrain.dem_histogram, "with b as (select min(elev) lo, max(elev) hi, (max(elev)-min(elev))/19 as s from dem), k as (select cast(least(floor((elev-lo)/s),18) as int) as bin, count(*) n from dem, b group by 1) select cast(i as int) as bin, R(lo+i*s) as low, R(lo+(i+1)*s) as high, coalesce(n,0) as n from b, range(19) t(i) left join k on k.bin=i")
add("slope_aspect", "dem", terrain.slope_aspect, f"with {_sl} select r, c, R(slope) as slope, R(aspect) as aspect from sa")
_cls = lambda names, label, cond="true": f"k as (select {label} as k, count(*) n from src where {cond} group by 1), t as (select count(*) t from src where {cond}) select x.class, coalesce(n,0) as n, R(coalesce(n,0)*100e0/t) as pct from (select unnest([{', '.join(repr(n) for n in names)}]) as class) x left join k on k.k=x.class, t"
_SC = ["flat", "gentle", "moderate", "steep", "very_steep", "extreme"]
add("slope_classes", "dem", lambda d: terrain.slope_classes(terrain.slope_aspect(d)), f"with {_sl}, src as (select slope from sa), " + _cls(_SC, "case when slope<2 then 'flat' when slope<5 then 'gentle' when slope<10 then 'moderate' when slope<20 then 'steep' when slope<30 then 'very_steep' else 'extreme' end"))
_DIR = "case when {0}>=315 or {0}<45 then 'N' when {0}<90 then 'NE' when {0}<135 then 'E' when {0}<180 then 'SE' when {0}<225 then 'S' when {0}<270 then 'SW' else 'W' end"
add("aspect_classes", "dem", lambda d: terrain.aspect_classes(terrain.slope_aspect(d)), f"with {_sl}, src as (select aspect from sa), " + _cls(terrain.DIRECTIONS, _DIR.format("aspect")))
add("roughness_std", "dem", terrain.roughness_std, "with st as (select d.r, d.c, coalesce(e.elev,-9999e0) v from dem d, (select unnest([-1,0,1]) dr) o, (select unnest([-1,0,1]) dc) n left join dem e on e.r=d.r+o.dr and e.c=d.c+n.dc) select r, c, R(stddev_pop(v)) as value from st group by r, c")
add("roughness_range", "dem", terrain.roughness_range, f"with {_in} select r, c, R(max(v)-min(v)) as value from inn group by r, c")
add("tri", "dem", terrain.tri, f"with {_in} select r, c, R(sqrt(sum(pow(v-elev,2)))) as value from inn group by r, c")
_vrm = f"{_in}, vr as (select r, c, case when count(*)>=2 and count(*) filter (where v<>elev)>0 then 1-abs(sum(sign(v-elev)))/cast(count(*) filter (where v<>elev) as double) else -9999e0 end as value from inn group by r, c)"
add("vrm", "dem", terrain.vrm, f"with {_vrm} select r, c, R(value) as value from vr")
add("roughness_stats", "dem", terrain.roughness_stats, f"""with {_vrm}, st as (select d.r, d.c, coalesce(e.elev,-9999e0) v from dem d, (select unnest([-1,0,1]) dr) o, (select unnest([-1,0,1]) dc) n left join dem e on e.r=d.r+o.dr and e.c=d.c+n.dc),
    u as (select 'std' as method, stddev_pop(v) as value from st group by r, c union all select 'range', max(v)-min(v) from inn group by r, c union all select 'tri', sqrt(sum(pow(v-elev,2))) from inn group by r, c union all select 'vrm', value from vr)
    select method, R(avg(value)) as mean, R(stddev_pop(value)) as std, R(min(value)) as min, R(max(value)) as max from u group by method""")
_vs = """rays as (select a, d, cast(trunc(25+d*sin(radians(cast(a as double)))) as bigint) r, cast(trunc(20+d*cos(radians(cast(a as double)))) as bigint) c from range(360) t(a), range(1, 167) s(d)),
    o as (select a, d, rays.r, rays.c, elev, atan2(elev-(select elev from dem where r=25 and c=20), d*30e0) ang, max(case when elev is null then 1 else 0 end) over (partition by a order by d) bad from rays left join dem on dem.r=rays.r and dem.c=rays.c),
    q as (select *, max(ang) over (partition by a order by d rows between unbounded preceding and 1 preceding) top from o where bad=0), seen as (select r, c from q where top is null or ang>top union select r, c from dem where r=25 and c=20)"""
add("viewshed", "dem", lambda d: terrain.viewshed(d, 25, 20), f"with {_vs} select r, c from seen")
add("viewshed_stats", "dem", lambda d: terrain.viewshed_stats(terrain.viewshed(d, 25, 20), d), f"with {_vs} select count(*) as visible, R(count(*)*100e0/(select count(elev) from dem)) as pct, R(count(*)*900e0) as area from seen")
add("local_minima", "dem", terrain.local_minima, f"with {_in} select r, c, min(v)>=any_value(elev) as low from inn where not (dr=0 and dc=0) group by r, c")
_pour = "(select r, c from dem order by elev, r, c limit 1)"
_ws = f"{_in}, low as (select r, c from inn where not (dr=0 and dc=0) group by r, c having min(v)>=any_value(elev)), w as (select r, c from {_pour} union select i.r+i.dr, i.c+i.dc from w join low on low.r=w.r and low.c=w.c join inn i on i.r=w.r and i.c=w.c where not (i.dr=0 and i.dc=0))"
_pp = lambda d: (lambda x: (x.r, x.c))(d.orderBy("elev", "r", "c").first())
add("watershed", "dem", lambda d: terrain.watershed(d, *_pp(d)), f"with recursive {_ws} select distinct r, c from w")
add("watershed_stats", "dem", lambda d: terrain.watershed_stats(terrain.watershed(d, *_pp(d)), d), f"with recursive {_ws} select count(*) as cells, R(count(*)*100e0/(select count(*) from dem)) as pct, R(count(*)*900e0) as area, R(min(elev)) as min, R(max(elev)) as max, R(avg(elev)) as mean from (select distinct r, c from w) x join dem using (r, c)")
add("watershed_std", "dem", lambda d: terrain.watershed(d, *_pp(d), std=True), f"""with recursive {_in}, best as (select r, c, r+dr as fr, c+dc as fc from (select *, row_number() over (partition by r, c order by (elev-v)/sqrt(cast(abs(dr)+abs(dc) as double)) desc, dr desc, dc desc) as k from inn where v<elev) where k=1),
    w as (select r, c from {_pour} union select best.r, best.c from w join best on best.fr=w.r and best.fc=w.c) select r, c from w""")
add("raster_tile", "dem", lambda d: terrain.raster_tiles(d, 16), "select cast(floor(r/16e0) as bigint) as tile_r, cast(floor(c/16e0) as bigint) as tile_c, min(r) as row0, min(c) as col0, max(r)-min(r)+1 as height, max(c)-min(c)+1 as width, count(elev) as n, R(avg(elev)) as mean from dem group by 1, 2")

# ------------------------------------------------------------------ weather
_SEASON = "case when month({0}) in (12,1,2) then 'Winter' when month({0}) in (3,4,5) then 'Spring' when month({0}) in (6,7,8) then 'Summer' else 'Fall' end"
_M5 = "R(avg({0})) as mean, R(stddev_samp({0})) as std, R(min({0})) as min, R(max({0})) as max"
_areas = lambda a: a.withColumn("minx", F.col("minx") - 20).withColumn("miny", F.col("miny") - 20).withColumn("maxx", F.col("minx") + 10).withColumn("maxy", F.col("miny") + 10)
_hit = "with a as (select area_id, minx-20 as x0, miny-20 as y0 from areas), h as (select area_id, temperature v from a left join weather on longitude between x0 and x0+10 and latitude between y0 and y0+10)"
add("weather_overlay", "areas weather", lambda a, w: weather.overlay(_areas(a), w, "temperature"), f"{_hit} select area_id, {_M5.format('v')}, count(v) as n, R(median(v)) as median from h group by area_id")
add("weather_overlay_stats", "weather", lambda w: weather.overlay_stats(w, "temperature").drop("start", "end"), f"select count(temperature) as n, {_M5.format('temperature')}, R(min(longitude)) as minx, R(min(latitude)) as miny, R(max(longitude)) as maxx, R(max(latitude)) as maxy from weather")
_OD = lambda o: o.select(F.col("o_orderdate").alias("obs_ts"), F.col("o_totalprice").alias("v"))
for _name, _keys in (("daily", "cast(year(o_orderdate) as int) as year, cast(month(o_orderdate) as int) as month, cast(day(o_orderdate) as int) as day"), ("weekly", "cast(year(o_orderdate) as int) as year, cast(weekofyear(o_orderdate) as int) as week"), ("monthly", "cast(year(o_orderdate) as int) as year, cast(month(o_orderdate) as int) as month"), ("seasonal", f"cast(year(o_orderdate) as int) as year, {_SEASON.format('o_orderdate')} as season")):
    add(f"climate_{_name}", "orders", lambda o, p=_name: weather.climate(_OD(o), "v", p), f"select {_keys}, {_M5.format('o_totalprice')}, count(*) as n from orders group by {', '.join(map(str, range(1, _keys.count(' as year') + _keys.count(' as month') + _keys.count(' as day') + _keys.count(' as week') + _keys.count(' as season') + 1)))}")
add("climate_trend", "orders", lambda o: weather.climate_trend(weather.climate(_OD(o), "v", "seasonal")).drop("p"), f"with g as (select year(o_orderdate) y, {_SEASON.format('o_orderdate')} s, avg(o_totalprice) m from orders group by 1, 2), i as (select m, row_number() over (order by y, s)-1 as i from g) select R(regr_slope(m,i)) as slope, R(regr_intercept(m,i)) as intercept, R(regr_r2(m,i)) as r2, R(sqrt((1-regr_r2(m,i))*regr_syy(m,i)/regr_sxx(m,i)/(count(*)-2))) as stderr, count(*) as n from i")
add("seasonal_climate", "orders", lambda o: weather.seasonal_climate(_OD(o), "v"), f"with s as (select {_SEASON.format('o_orderdate')} as season, avg(o_totalprice) m, stddev_samp(o_totalprice) sd, min(o_totalprice) lo, max(o_totalprice) hi from orders group by 1) select season, R(m) as mean, R(sd) as std, R(lo) as min, R(hi) as max, R((select stddev_samp(m)/avg(m) from s)) as variability from s")
add("spatial_climate", "weather", lambda w: weather.spatial_climate(w, "temperature"), "with g as (select longitude, latitude, avg(temperature) m from weather group by 1, 2) select count(*) as stations, R(avg(m)) as mean, R(stddev_samp(m)) as std, R(corr(latitude,m)) as lat_corr, R(corr(longitude,m)) as lon_corr from g")
add("precip_stats", "weather", lambda w: weather.precip_stats(w, "precipitation"), f"select R(sum(precipitation)) as total, {_M5.format('precipitation')}, R(median(precipitation)) as median, count(*) filter (where precipitation=0) as dry, count(*) filter (where precipitation>0) as wet, count(precipitation) as n from weather")
add("precip_intensity", "weather", lambda w: weather.precip_intensity(w, "precipitation"), "select R(avg(precipitation)) as mean, R(stddev_samp(precipitation)) as std, R(max(precipitation)) as max, " + ", ".join(f"R(quantile_cont(precipitation,{q})) as q{int(q * 100)}" for q in (0.25, 0.5, 0.75, 0.9, 0.95)) + " from weather where precipitation>0")
add("precip_monthly", "orders", lambda o: weather.precip_sums(_OD(o), "v", "month"), "select cast(month(o_orderdate) as int) as month, R(sum(o_totalprice)) as total from orders group by 1")
add("precip_seasonal", "orders", lambda o: weather.precip_sums(_OD(o), "v", "season"), f"select {_SEASON.format('o_orderdate')} as season, R(sum(o_totalprice)) as total from orders group by 1")
add("drought", "weather", lambda w: weather.drought(w, "precipitation"), "with m as (select avg(precipitation)*0.5e0 as l from weather) select R(any_value(l)) as \"limit\", count(*) filter (where precipitation<l) as n, R(count(*) filter (where precipitation<l)*100e0/count(*)) as pct, R(avg(precipitation) filter (where precipitation<l)) as mean from weather, m")
add("precip_cumsum", "weather", lambda w: weather.precip_cumsum(w, "precipitation").drop("obs_ts"), "select event_id, R(sum(precipitation) over (order by obs_ts, event_id rows unbounded preceding)) as cumulative, R(case when count(*) over w=30 then avg(precipitation) over w end) as rolling from weather window w as (order by obs_ts, event_id rows between 15 preceding and 14 following)")
add("extreme_precip", "weather", lambda w: weather.extreme_precip(w, "precipitation"), "with q as (select quantile_cont(precipitation,0.95) l from weather) select R(any_value(l)) as \"limit\", count(*) filter (where precipitation>l) as n, R(max(precipitation) filter (where precipitation>l)) as max from weather, q")
add("temp_stats", "weather", lambda w: weather.temp_stats(w, "temperature"), f"select {_M5.format('temperature')}, R(median(temperature)) as median, R(max(temperature)-min(temperature)) as range from weather")
add("temp_extremes", "weather", lambda w: weather.temp_extremes(w, "temperature"), "with q as (select quantile_cont(temperature,0.9) h, quantile_cont(temperature,0.1) c, quantile_cont(temperature,0.95) n from weather) select count(*) filter (where temperature>h) as hot, count(*) filter (where temperature<c) as cold, count(*) filter (where temperature<=0) as freezing, count(*) filter (where temperature>n) as hot_nights from weather, q")
add("temp_monthly", "orders", lambda o: weather.temp_means(_OD(o), "v", "month"), "select cast(month(o_orderdate) as int) as month, R(avg(o_totalprice)) as mean from orders group by 1")
add("temp_annual", "orders", lambda o: weather.temp_means(_OD(o), "v", "year"), "select cast(year(o_orderdate) as int) as year, R(avg(o_totalprice)) as mean from orders group by 1")
add("temp_diurnal", "weather", lambda w: weather.temp_diurnal(w, "precipitation", "temperature"), "select R(avg(temperature-precipitation)) as mean, R(max(temperature-precipitation)) as max, R(min(temperature-precipitation)) as min from weather")
add("heat_waves", "weather", lambda w: weather.heat_waves(w, "temperature"), "with q as (select quantile_cont(temperature,0.9) l from weather) select R(any_value(l)) as \"limit\", count(*) filter (where temperature>l) as n, R(count(*) filter (where temperature>l)*100e0/count(*)) as pct from weather, q")
add("heat_waves_std", "weather", lambda w: weather.heat_waves_std(w.withColumn("station", F.col("event_id") % 7), "temperature", ["station"]).select("station", "start", "length", "max"), "with d as (select event_id%7 as station, cast(obs_ts as date) as day, max(temperature) v from weather group by 1, 2), h as (select * from d where v > (select quantile_cont(temperature,0.9) from weather)), g as (select *, day - cast(row_number() over (partition by station order by day) as int) as run from h) select station, min(day) as start, count(*) as length, R(max(v)) as max from g group by station, run having count(*)>=3")
add("wind_stats", "weather", lambda w: weather.wind_stats(w, "wind_speed"), f"select {_M5.format('wind_speed')}, R(median(wind_speed)) as median from weather")
add("wind_classes", "weather", lambda w: weather.wind_classes(w, "wind_speed"), "with src as (select wind_speed s from weather where wind_speed is not null), " + _cls(["calm", "light", "gentle", "moderate", "fresh", "strong"], "case when s<1 then 'calm' when s<3 then 'light' when s<5 then 'gentle' when s<8 then 'moderate' when s<11 then 'fresh' else 'strong' end"))
add("wind_direction", "weather", lambda w: weather.wind_directions(w, "wind_direction"), "with src as (select wind_direction d from weather), " + _cls(terrain.DIRECTIONS, _DIR.format("d")).replace("select x.class", "select x.class, (select k from k order by n desc, list_position(['N','NE','E','SE','S','SW','W'], k) limit 1) as prevailing, R((select avg(d) from src)) as mean"))
add("wind_monthly", "weather", lambda w: weather.temp_means(w, "wind_speed", "month"), "select cast(month(obs_ts) as int) as month, R(avg(wind_speed)) as mean from weather group by 1")
add("wind_hourly", "weather", lambda w: weather.temp_means(w, "wind_speed", "hour"), "select cast(hour(obs_ts) as int) as hour, R(avg(wind_speed)) as mean from weather group by 1")
add("weather_impact", "areas weather", lambda a, w: weather.weather_impact(_areas(a), w, "temperature"), f"{_hit}, o as (select area_id, avg(v) m, count(v) n from h group by area_id) select area_id, R(m) as mean, n, impact, grade, score from o, (values ('agricultural','low',0.2e0),('transportation','moderate',0.5e0),('energy','high',0.8e0)) x(impact,grade,score)")

# ------------------------------------------------------------------ population
_Q = lambda v, qs: ", ".join(f"R(quantile_cont({v},{q})) as q{int(q * 100)}" for q in qs)
_box2 = lambda a: a.withColumn("maxx", F.col("minx") + 10).withColumn("maxy", F.col("miny") + 10)
add("population_stats", "areas", lambda a: population.summary(a, "population"), f"select R(sum(population)) as total, {_M5.format('population')}, R(median(population)) as median, count(population) as n from areas")
add("density_stats", "areas", population.density_stats, f"select {_M5.format('population/area')}, {_Q('population/area', (0.25, 0.5, 0.75, 0.9, 0.95))} from areas")
add("population_grid", "areas", lambda a: population.population_grid(_box2(a), 7.0), """
    with b as (select min(minx) x0, min(miny) y0, max(minx)+10 x1, max(miny)+10 y1 from areas), c as (select i, j, x0+i*7e0 gx, y0+j*7e0 gy from b, lateral (select unnest(generate_series(0, cast(ceil((x1-x0)/7e0) as bigint)-2)) as i), lateral (select unnest(generate_series(0, cast(ceil((y1-y0)/7e0) as bigint)-2)) as j))
    select i, j, R(sum(population*greatest(0,least(minx+10,gx+7)-greatest(minx,gx))*greatest(0,least(miny+10,gy+7)-greatest(miny,gy))/100e0)/49e0) as density from c, areas group by i, j""")
add("population_classes", "areas", population.population_classes, f"select {_Q('population', (0.1, 0.25, 0.5, 0.75, 0.9))}, count(*) filter (where population<1e3) as low, count(*) filter (where population>=1e3 and population<1e4) as medium, count(*) filter (where population>=1e4 and population<1e5) as high, count(*) filter (where population>=1e5) as very_high from areas")
add("population_clustering", "points", lambda p: population.population_clustering(p, "val"), """
    with d as (select a.feature_id, a.val w, min(sqrt(pow(a.lon-b.lon,2)+pow(a.lat-b.lat,2))) d from points a join points b on a.feature_id<>b.feature_id group by 1, 2) select R(avg(d)) as mean, R(sum(d*w)/sum(w)) as weighted, case when avg(d)<1000 then 'high' else 'low' end as clustering from d""")
add("demographics", "part", lambda p: population.demographics(p, ["p_size", "p_brand"]), f"""
    select 'p_size' as "column", count(p_size) as n, {_M5.format('cast(p_size as double)')}, (select cast(p_size as varchar) from part group by p_size order by count(*) desc, p_size limit 1) as mode, count(distinct p_size) as "distinct" from part
    union all select 'p_brand', count(p_brand), null, null, null, null, (select p_brand from part group by p_brand order by count(*) desc, p_brand limit 1), count(distinct p_brand) from part""")
add("value_distribution", "part", lambda p: population.value_distribution(p, "p_brand"), "select p_brand as value, count(*) as n, R(count(*)*100e0/(select count(*) from part)) as pct from part group by p_brand")
_IND = ["income", "education", "housing"]
add("correlation_matrix", "indicators", lambda d: population.correlation_matrix(d, _IND), " union all ".join(f"select '{a}' as a, '{b}' as b, R(corr({a},{b})) as r from indicators" for a in _IND for b in _IND))
add("strong_correlations", "indicators", lambda d: population.strong_correlations(d, _IND, 0.05), "select * from (" + " union all ".join(f"select '{a}' as a, '{b}' as b, R(corr({a},{b})) as r from indicators" for i, a in enumerate(_IND) for b in _IND[i + 1 :]) + ") where abs(r)>=0.05e0")
_rate = "r as (select *, case when lag(population) over (order by yr)>0 then (population-lag(population) over (order by yr))/lag(population) over (order by yr)*100 end as rate from yearly)"
add("growth_rates", "yearly", population.growth_rates, f"with {_rate} select R(avg(rate)) as mean, R(stddev_pop(rate)) as std, R(max(rate)) as max, R(min(rate)) as min, count(rate) as n from r")
add("growth_trend", "yearly", lambda y: population.growth_trend(y).drop("p", "significant"), "with i as (select population p, row_number() over (order by yr)-1 as i from yearly) select R(regr_slope(p,i)) as slope, R(regr_r2(p,i)) as r2, R(sqrt((1-regr_r2(p,i))*regr_syy(p,i)/regr_sxx(p,i)/(count(*)-2))) as stderr, count(*) as n from i")
add("growth_trend_p", "yearly", lambda y: population.growth_trend(y).select("p", "significant"))
add("growth_by_location", "placed_yearly", population.growth_by_location, "with r as (select *, case when lag(population) over w>0 then (population-lag(population) over w)/lag(population) over w*100 end as rate from placed_yearly window w as (partition by location order by yr)) select location, R(avg(rate)) as mean_rate, R(arg_max(population,yr)-arg_min(population,yr)) as change from r group by location having count(*)>1 and count(rate)>0")
add("growth_projection", "yearly", population.growth_projection, "with a as (select arg_max(population,yr) l, arg_min(population,yr) f, count(*) n from yearly) select cast(i as int) as period, R(l+i*(l-f)/(n-1)) as population from a, range(1,6) t(i)")
add("age_stats", "ages", population.age_stats, f"select {_M5.format('age')}, R(median(age)) as median, R(max(age)-min(age)) as range from ages")
_AG = {"children": "age>=0 and age<=14", "youth": "age>=15 and age<=24", "adults": "age>=25 and age<=64", "elderly": "age>=65"}
add("age_groups", "ages", population.age_groups, " union all ".join(f"select '{k}' as \"group\", count(*) filter (where {c}) as count, R(count(*) filter (where {c})*100e0/count(age)) as pct from ages" for k, c in _AG.items()))
add("age_pyramid", "ages", population.age_pyramid, "select cast(ceil(age/5)-1 as int) as bin, R(sum(population)) as population from ages where age>0 and age<=100 group by 1")
add("dependency_ratios", "ages", population.dependency_ratios, "with a as (select count(*) filter (where age between 0 and 14) y, count(*) filter (where age>=65) o, count(*) filter (where age between 15 and 64) w from ages) select R(y*100e0/w) as youth, R(o*100e0/w) as elderly, R((y+o)*100e0/w) as total from a")
add("age_distribution", "ages", population.age_distribution, f"select {_Q('age', (0.25, 0.5, 0.75))}, R(skewness(age)) as skewness, R(kurtosis(age)) as kurtosis from ages")
add("migration_stats", "flows", population.migration_stats, f"select R(sum(migrants)) as total, {_M5.format('migrants')}, count(migrants) as n from flows")
add("top_origins", "flows", lambda f: population.top_flows(f, "origin"), "select origin, R(sum(migrants)) as migrants from flows group by origin order by sum(migrants) desc, origin limit 10")
add("top_destinations", "flows", lambda f: population.top_flows(f, "destination"), "select destination, R(sum(migrants)) as migrants from flows group by destination order by sum(migrants) desc, destination limit 10")
add("net_migration", "flows", population.net_migration, "with o as (select origin l, sum(migrants) m from flows group by 1), i as (select destination l, sum(migrants) m from flows group by 1) select coalesce(o.l,i.l) as location, R(coalesce(i.m,0)-coalesce(o.m,0)) as net from o full join i on o.l=i.l")
add("migration_network", "flows", population.migration_network, "select count(distinct origin) as origins, count(distinct destination) as destinations, count(*) as flows, R(avg(migrants)) as mean, R(count(*)/cast(count(distinct origin)*count(distinct destination) as double)) as density from flows")
add("temporal_migration", "flows", population.temporal_migration, "select cast(yr as int) as yr, R(sum(migrants)) as total, R(avg(migrants)) as mean, count(*) as n from flows group by 1")
add("migration_intensity", "flows", population.migration_intensity, f"select R(avg(migrants)) as mean, R(max(migrants)) as max, {_Q('migrants', (0.25, 0.5, 0.75, 0.9))} from flows")
add("indicator_stats", "indicators", lambda d: population.indicator_stats(d, _IND), " union all ".join(f"select '{c}' as indicator, count({c}) as n, {_M5.format(c)}, R(median({c})) as median from indicators" for c in _IND))
add("inequality", "orders", lambda o: population.inequality(o, "o_totalprice"), "with s as (select o_totalprice x, row_number() over (order by o_totalprice) r, count(*) over () n from orders) select R((any_value(n)+1-2*sum((n-r+1)*x)/sum(x))/any_value(n)) as gini, R(stddev_samp(x)/avg(x)) as cv, R(quantile_cont(x,0.9)/quantile_cont(x,0.1)) as p90_p10 from s")
add("composite_index", "indicators", lambda d: population.composite_index(d, _IND), f"with a as (select {', '.join(f'avg({c}) m{i}, stddev_samp({c}) s{i}' for i, c in enumerate(_IND))} from indicators), z as (select ({' + '.join(f'({c}-m{i})/s{i}' for i, c in enumerate(_IND))})/3 as v from indicators, a) select R(avg(v)) as mean, R(stddev_samp(v)) as std, {_Q('v', (0.25, 0.5, 0.75))} from z")

# ------------------------------------------------------------------ transport
_len = "sqrt(pow(ux-vx,2)+pow(uy-vy,2))"
_nodes = "nodes as (select ux as x, uy as y from network union select vx, vy from network)"
_ends = "ends as (select distinct link_id, x, y from (select link_id, ux as x, uy as y from network union all select link_id, vx, vy from network))"
_adj = "adj as (select u, v from links union select v, u from links)"
_A64 = repr(g.UNIT_BUFFER_AREA)
add("link_stats", "network", network.link_stats, f"select count(*) as links, R(sum({_len})) as total, {_M5.format(_len)} from network")
add("network_nodes", "network", network.nodes, f"with {_nodes} select R(x) as x, R(y) as y from nodes")
add("connectivity", "network", network.connectivity, f"with {_nodes}, a as (select (select count(*) from network) l, (select count(*) from nodes) n) select l as links, n as nodes, R(l/n) as beta, R((l-n+1)/cast(2*n-5 as double)) as alpha, R(l/(n*(n-1)/2e0)) as gamma from a")
add("topology", "network", network.topology, f"with {_ends}, d as (select x, y, count(*) k from ends group by 1, 2) select R(avg(k)) as mean, R(stddev_pop(k)) as std, max(k) as max, min(k) as min, count(*) filter (where k=0) as isolated, count(*) filter (where k=1) as terminal, count(*) filter (where k>2) as intersections from d")
add("network_density", "network", network.network_density)
add("nearest_node", "network", lambda n: network.nearest_node(network.nodes(n), 12.3, 4.5), f"with {_nodes} select R(x) as x, R(y) as y, R(sqrt(pow(x-12.3e0,2)+pow(y-4.5e0,2))) as d from nodes order by d, x, y limit 1")
_route = f"with {_nodes}, a as (select x, y from nodes order by sqrt(pow(x+100e0,2)+pow(y+50e0,2)), x, y limit 1), b as (select x, y from nodes order by sqrt(pow(x-100e0,2)+pow(y-50e0,2)), x, y limit 1), r as (select sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) d from a, b)"
_rt = lambda n: network.route(n, -100.0, -50.0, 100.0, 50.0)
add("route", "network", _rt, f"{_route} select R(d) as distance, R(d/(30/3.6e0)) as time, R(d/1000) as km, R(d/(30/3.6e0)/60) as minutes, R(d/1000/(d/(30/3.6e0)/3600)) as speed from r")
add("route_alternatives", "network", lambda n: network.route_alternatives(_rt(n)), f"{_route} select cast(i as int) as alternative, R(1+i*0.1e0) as factor, R(d*(1+i*0.1e0)) as distance, R(d/(30/3.6e0)*(1+i*0.1e0)) as time from r, range(1,4) t(i)")
add("shortest_path_std", "network", lambda n: network.shortest_path(n, 0), f"""with recursive e as (select u, v, min(w) as w from (select u, v, {_len} as w from network union all select v, u, {_len} from network) group by u, v),
    d(node, cost) using key (node) as (select cast(0 as bigint), 0e0 union select e.v, min(f.cost+e.w) from d f join e on e.u=f.node left join recurring.d o on o.node=e.v where o.cost is null or o.cost>f.cost+e.w+1e-12 group by e.v)
    select node, R(cost) as cost from d""")
add("service_areas", "points", lambda p: network.service_areas(p, 5.0), f"select count(*) as areas, R(count(*)*{_A64}*25e0) as total, R({_A64}*25e0) as mean, 0e0 as std, R({_A64}*25e0) as min, R({_A64}*25e0) as max, 1e0 as efficiency from points")
add("accessibility", "facilities", lambda f: network.accessibility(f, 5.0, 360.0 * 170.0), f"select count(*) as facilities, R(count(*)*{_A64}*25e0) as total_area, R({_A64}*25e0) as mean_area, R(count(*)/61200e0) as density from facilities")
add("population_access", "points facilities", lambda p, f: network.population_access(p, f, 15.0, "val"), "select R(sum(val) filter (where ok)) as accessible, R(sum(val)) as total, R(sum(val) filter (where ok)*100e0/sum(val)) as pct from (select val, exists (select 1 from facilities f where sqrt(pow(p.lon-f.lon,2)+pow(p.lat-f.lat,2))<=15e0) as ok from points p)")
add("travel_time", "network", lambda n: network.travel_time(network.travel_times(n)), f"with t as (select {_len}/(speed_limit/3.6e0) v from network) select R(sum(v)) as total, {_M5.format('v')} from t")
add("travel_time_dist", "network", lambda n: network.travel_time_dist(network.travel_times(n)), f"with t as (select {_len}/(speed_limit/3.6e0) v from network), m as (select avg(v) m from t), c as (select avg(pow(v-m,2)) m2, avg(pow(v-m,3)) m3, avg(pow(v-m,4)) m4 from t, m) select {', '.join(f'R(quantile_cont(v,{q})) as p{int(q * 100)}' for q in (0.25, 0.5, 0.75, 0.9))}, R(any_value(m3/pow(m2,1.5e0))) as skewness, R(any_value(m4/pow(m2,2)-3)) as kurtosis from t, c")
add("congestion", "network", network.congestion, "with a as (select avg(speed_limit) m, stddev_samp(speed_limit) s, quantile_cont(speed_limit,0.25) q from network) select link_id, R(speed_limit) as speed_limit, R(m) as mean, R(s) as std from network, a where speed_limit<q")
add("service_overlap", "points", lambda p: network.service_overlap(p, 5.0), "with d as (select sqrt(pow(a.lon-b.lon,2)+pow(a.lat-b.lat,2)) d from points a join points b on a.feature_id<b.feature_id), o as (select 50e0*acos(d/10e0)-d/2*sqrt(100e0-d*d) as a from d where d<10e0) select R(coalesce(sum(a),0)) as total, count(*) as pairs, R(coalesce(avg(a),0)) as mean from o where a>0")
add("adjacency", "links", network.adjacency, f"with {_adj} select u, v from adj")
add("degree_centrality", "links", network.degree_centrality, f"with {_adj} select u as node, count(*) as score from adj group by u")
add("key_nodes", "links", lambda n: network.key_nodes(network.degree_centrality(n)), f"with {_adj} select u as node, count(*) as score from adj group by u order by score desc, node limit 10")
_cc = f"with recursive {_adj}, w as (select u as root, u as node from adj union select w.root, adj.v from w join adj on adj.u=w.node), c as (select node, min(root) as component from w group by node)"
add("components", "links", network.components, f"{_cc} select node, component from c")
add("vulnerability", "links", network.vulnerability, f"{_cc}, s as (select component, count(*) k from c group by 1) select count(*) as components, max(k) as largest, case when count(*)=1 then 'high' else 'low' end as vulnerability from s")
_bfs = """with recursive adj as (select distinct u, v from (select u, v from links union select v, u from links) where u<>v),
    d(source, node, hops, paths) using key (source, node) as (select distinct u, u, 0, 1e0 from adj union
      select f.source, adj.v, f.hops+1, sum(f.paths) from d f join adj on adj.u=f.node left join recurring.d o on o.source=f.source and o.node=adj.v where o.hops is null group by f.source, adj.v, f.hops)"""
_closeness = f"{_bfs} select source as node, R(count(*)/cast(sum(hops) as double)) as score from d where hops>0 group by source"
add("closeness_std", "links", network.closeness_std, _closeness)
add("betweenness_std", "links", network.betweenness_std, f"""{_bfs} select a.node, R(sum(a.paths*b.paths/t.paths)/2) as score from d t join d a on a.source=t.source and a.hops>0 and a.hops<t.hops
    join d b on b.source=a.node and b.node=t.node and a.hops+b.hops=t.hops where t.hops>1 group by a.node""")

# ------------------------------------------------------------------ sources, sinks, orchestration
add("csv_points", "points", lambda p: sinks.csv_round_trip(p.select("feature_id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))), "select feature_id, R(lon) as lon, R(lat) as lat from points")
add("geojson_scan", "points", lambda p: sinks.geojson_round_trip(p), "select cast(feature_id as varchar) as feature_id, name, R(lon) as lon, R(lat) as lat from points")
add("kml_scan", "points", lambda p: sinks.kml_round_trip(p), "select name, R(lon) as lon, R(lat) as lat from points")
add("shp_scan", "points", lambda p: sinks.shp_round_trip(p), "select cast(feature_id as varchar) as feature_id, R(lon) as lon, R(lat) as lat from points")
add("gpkg_scan", "points", lambda p: sinks.gpkg_round_trip(p), "select cast(feature_id as varchar) as feature_id, R(lon) as lon, R(lat) as lat from points")
add("raster_scan", "dem", lambda d: sinks.raster_round_trip(d), "select r, c, R(elev) as elev from dem")
add("write_geojson", "points", lambda p: sinks.geojson_written(p.select("feature_id", "name", "lon", "lat")), "select count(*) as features, count(distinct feature_id) as ids, R(sum(lon)) as lon, R(sum(lat)) as lat from points")
add("sample_weather", "points", lambda p: samples.station_grid(p.sparkSession).groupBy("latitude", "longitude").agg(F.count("*").alias("n")))
add("demo_points", "points", lambda p: samples.demo_points(p.sparkSession).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")), "select cast(200 as bigint) as n, cast(200 as bigint) as ids")
add("sample_points", "points", lambda p: samples.points(p.sparkSession, 100).select("id", "population"))
# each family over the role that it is made for; the metrics that SQL has in one line are compared
_FAMILIES = {"points": ("feature_id", "lon", "lat"), "weather": ("event_id", "longitude", "latitude"), "dem": ("r", "c", "r"), "ages": ("population", "age", "population"), "network": ("link_id", "ux", "uy")}


def _managed(role: str, df: DataFrame, families: list[str], **params) -> runner.AnalysisManager:
    m = runner.AnalysisManager(df, *_FAMILIES[role])
    m.run(families, params)
    return m


def _store(v: DataFrame) -> DataFrame:
    """A store that is made, added to, deleted from and searched."""
    spark = v.sparkSession
    rows = v.select(F.col("vec_id").cast("string").alias("id"), "embedding")
    store = retrieval.VectorStore(spark, sinks.fresh(v, "store"))
    store.add(rows.where("vec_id % 3 = 0"))
    store.add(rows)
    store.delete(["1", "2"])
    return store.query(_Q0(v), 10).select("id", "distance")


def _examples(p: DataFrame) -> DataFrame:
    return p.sparkSession.createDataFrame([(i, k, t) for i, (k, t, _) in enumerate(retrieval.EXAMPLES)], "i int, kind string, text string")


def _read_vector(p: DataFrame) -> DataFrame:
    """The dispatcher over what the writers made, by suffix."""
    path = sinks.fresh(p, "any") + ".geojson"
    sinks.write_geojson(sinks.feature_lines(p.select("feature_id", "name", "lon", "lat")), path)
    return vector.centroids(vector.read_vector(p.sparkSession, path)).agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))


_all = ["spatial", "temporal", "elevation", "weather", "population", "transport"]
add("comprehensive", "points", lambda p: _managed("points", p, _all, numeric="val", radius=10.0, cell=30.0, time="never").all_metrics())
add("family_temporal", "weather", lambda w: _managed("weather", w, ["temporal"], time="obs_ts", numeric="temperature").all_metrics())
add("family_weather", "weather", lambda w: _managed("weather", w, ["weather"]).all_metrics().where("metric in ('mean', 'max', 'min')"), " union all ".join(f"select 'weather_{k}' as analysis_type, '{m}' as metric, R({f}({c})) as value from weather" for k, c in (("temperature", "temperature"), ("precipitation", "precipitation"), ("wind", "wind_speed")) for m, f in (("mean", "avg"), ("max", "max"), ("min", "min"))))
add("family_elevation", "dem", lambda d: _managed("dem", d, ["elevation"]).all_metrics())
add("family_population", "ages", lambda a: _managed("ages", a, ["population"], numeric="population").all_metrics().where("analysis_type = 'population_statistics' and metric in ('total', 'mean', 'n')"), "select 'population_statistics' as analysis_type, 'total' as metric, R(sum(population)) as value from ages union all select 'population_statistics', 'mean', R(avg(population)) from ages union all select 'population_statistics', 'n', R(count(population)) from ages")
add("family_transport", "network", lambda n: _managed("network", n, ["transport"]).all_metrics().where("analysis_type = 'transport_connectivity' and metric in ('links', 'nodes')"), "select 'transport_connectivity' as analysis_type, 'links' as metric, R(count(*)) as value from network union all select 'transport_connectivity', 'nodes', R(count(*)) from (select ux, uy from network union select vx, vy from network)")
add("run_summary", "points", lambda p: _managed("points", p, _all, numeric="val", time="never").summary(), "select cast(6 as bigint) as total, cast(2 as bigint) as succeeded, cast(4 as bigint) as failed")
add("run_status", "points", lambda p: p.sparkSession.createDataFrame([_managed("points", p, _all, numeric="val", time="never").status()], "runs long, families long, failed long"), "select cast(1 as bigint) as runs, cast(6 as bigint) as families, cast(4 as bigint) as failed")
add("report", "network", lambda n: n.sparkSession.createDataFrame([(i, x) for i, x in enumerate(_managed("network", n, ["transport"]).report("transport").split("\n"))], "i int, line string").where("line like '%connectivity links%'").select(F.trim("line").alias("line")), "select 'connectivity links: ' || format('{:.4f}', cast(count(*) as double)) as line from network")
add("centrality", "links", lambda n: network.centrality(n, "closeness"), _closeness)
add("vector_store", "vectors", _store, f"select id, R(d) as distance from (select cast(e.vec_id as varchar) as id, {_dist} as d {_from} where e.vec_id not in (1, 2)) order by d, id limit 10")
add("example_queries", "points", _examples)
add("read_vector", "points", _read_vector, "select count(*) as n, R(sum(lon)) as x, R(sum(lat)) as y from points")
add("to_centroids", "areas", lambda a: vector.centroids(_box(a).select("area_id", F.struct(F.lit("Polygon").alias("gtype"), F.array("ring").alias("rings"), F.array(F.lit(0)).alias("parts")).alias("geometry"))).select("area_id", "x", "y"), "select area_id, R(minx+5) as x, R(miny+5) as y from areas")
add("detect_columns", "weather", lambda w: w.sparkSession.createDataFrame([(k, spatial_query.detect_column(w.columns, v)) for k, v in runner.KEYWORDS.items()], "what string, column string").where("column is not null"), "select 'weather' as what, 'temperature' as column")
add("export_metrics", "weather", lambda w: runner.metrics({"temperature": weather.temp_stats(w, "temperature"), "precipitation": weather.precip_stats(w, "precipitation")}), " union all ".join(f"select '{k}' as analysis_type, '{m}' as metric, R({e}) as value from weather" for k, c, ms in (("temperature", "temperature", ("mean", "std", "max", "min", "median", "range")), ("precipitation", "precipitation", ("total", "mean", "std", "max", "min", "median", "dry", "wet", "n"))) for m, e in ((m, {"mean": f"avg({c})", "std": f"stddev_samp({c})", "max": f"max({c})", "min": f"min({c})", "median": f"median({c})", "range": f"max({c})-min({c})", "total": f"sum({c})", "dry": f"cast(count(*) filter (where {c}=0) as double)", "wet": f"cast(count(*) filter (where {c}>0) as double)", "n": f"cast(count({c}) as double)"}[m]) for m in ms)))

assert math.isclose(RAD, 27.027027027027028)
