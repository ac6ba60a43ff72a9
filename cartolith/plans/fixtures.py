"""Input roles over the driver's tables (FIXTURES.md), the same text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "points": "select c_custkey as feature_id, c_name as name, cast((c_custkey*7919)%3600 as double)/10e0-180e0 as lon, cast((c_custkey*104729)%1700 as double)/10e0-85e0 as lat, c_acctbal as val, c_mktsegment as category from customer",
    "weather": "select event_id, ts as obs_ts, cast((user_id*7919)%3600 as double)/10e0-180e0 as longitude, cast((user_id*104729)%1700 as double)/10e0-85e0 as latitude, value as temperature, case when event_id%3=0 then 0e0 else value end as precipitation, value/10e0 as wind_speed, cast((event_id*37)%360 as double) as wind_direction from events",
    "flows": "select l_suppkey%25 as origin, o_custkey%25 as destination, l_quantity as migrants, year(l_shipdate) as yr from lineitem join orders on l_orderkey=o_orderkey",
    "dem": "select cast(floor(p_partkey/40e0) as bigint) as r, p_partkey%40 as c, cast(p_size as double) as elev from part",
    "links": "select o_orderkey as link_id, o_custkey%(select cast(floor(count(*)/5e0) as bigint) from customer) as u, (o_custkey*31+o_orderkey)%(select cast(floor(count(*)/5e0) as bigint) from customer) as v, cast(20+o_orderkey%100 as double) as speed_limit from orders",
    "facilities": "select s_suppkey as feature_id, cast((s_suppkey*7919)%3600 as double)/10e0-180e0 as lon, cast((s_suppkey*104729)%1700 as double)/10e0-85e0 as lat from supplier",
    "areas": "select n_nationkey as area_id, cast(n_nationkey%5 as double)*10e0 as minx, cast(n_regionkey as double)*10e0 as miny, cast(count(*) as double) as population, 100e0 as area from customer join nation on c_nationkey=n_nationkey group by n_nationkey, n_regionkey",
    "ages": "select cast(p_size as double) as age, p_retailprice as population from part",
    "yearly": "select cast(year(o_orderdate) as double) as yr, cast(count(*) as double) as population from orders group by year(o_orderdate)",
    "placed_yearly": "select o_custkey%20 as location, cast(year(o_orderdate) as double) as yr, cast(count(*) as double) as population from orders group by o_custkey%20, year(o_orderdate)",
    "indicators": "select c_custkey as feature_id, c_acctbal as income, cast((c_custkey*31)%97 as double)+c_acctbal/1000e0 as education, cast((c_custkey*17)%89 as double) as housing from customer",
    "network": "select link_id, u, v, speed_limit, cast((u*7919)%3600 as double)/10e0-180e0 as ux, cast((u*104729)%1700 as double)/10e0-85e0 as uy, cast((v*7919)%3600 as double)/10e0-180e0 as vx, cast((v*104729)%1700 as double)/10e0-85e0 as vy from links",
    "vectors": "select vec_id, embedding, cast((vec_id*7919)%3600 as double)/10e0-180e0 as minx, cast((vec_id*104729)%1700 as double)/10e0-85e0 as miny, cast((vec_id*7919)%3600 as double)/10e0-179e0 as maxx, cast((vec_id*104729)%1700 as double)/10e0-84e0 as maxy from embeddings",
}
NEEDS = {
    "points": ("customer",), "weather": ("events",), "flows": ("lineitem", "orders"), "dem": ("part",), "links": ("orders", "customer"), "facilities": ("supplier",), "areas": ("customer", "nation"), "ages": ("part",), "yearly": ("orders",),
    "placed_yearly": ("orders",), "indicators": ("customer",), "network": ("links",), "vectors": ("embeddings",),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A role as a DataFrame; nothing is registered in the catalog."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = {t: view(spark, sf_dir, t) for t in NEEDS[name]}
    sql = VIEWS[name]
    for t in parts:
        for word in ("from", "join"):
            sql = sql.replace(f"{word} {t}", f"{word} {{{t}}} {t}")
    return spark.sql(sql, **parts)


def with_views(sql: str) -> str:
    """DuckDB text with the roles it names as common table expressions, and R(x) spelt out as rounding."""
    out = sql
    while (i := out.find("R(")) >= 0 and (i == 0 or not (out[i - 1].isalnum() or out[i - 1] == "_")):
        depth, j = 0, i + 1
        while True:
            depth += {"(": 1, ")": -1}.get(out[j], 0)
            if not depth:
                break
            j += 1
        out = out[:i] + "(round(" + out[i + 2 : j] + ", 6) + 0e0)" + out[j + 1 :]
    needed: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in needed:
            for t in NEEDS[name]:
                add(t)
            needed.append(name)

    import re

    for name in VIEWS:
        if re.search(rf"\b(from|join)\s+{name}\b", out, re.I):
            add(name)
    ctes = ", ".join(f"{n} as ({VIEWS[n]})" for n in needed)
    if not ctes:
        return out
    if m := re.match(r"\s*with\s+(recursive\s+)?", out, re.I):
        return f"with {m[1] or ''}{ctes}, {out[m.end() :]}"
    return f"with {ctes} {out}"
