"""Population: density, demographics, growth, ages, migration, indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolith.functions import geometry as g
from cartolith.functions import stats
from cartolith.operators.bandjoin import nearest_distance
from cartolith.operators.ordered import numbered, running_sum, sliding


def summary(df: DataFrame, column: str) -> DataFrame:
    v = F.col(column).cast("double")
    return df.agg(F.sum(v).alias("total"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), stats.median(v).alias("median"), F.count(v).alias("n"))


def _quantiles(v, points) -> list:
    return [stats.quantile(v, p).alias(f"q{int(p * 100)}") for p in points]


def density_stats(df: DataFrame, population: str = "population", area: str = "area") -> DataFrame:
    d = F.try_divide(F.col(population).cast("double"), F.col(area).cast("double"))
    return df.select(d.alias("d")).agg(F.avg("d").alias("mean"), F.stddev_samp("d").alias("std"), F.min("d").alias("min"), F.max("d").alias("max"), *_quantiles("d", (0.25, 0.5, 0.75, 0.9, 0.95)))


def population_grid(df: DataFrame, cell: float, population: str = "population") -> DataFrame:
    """(i, j, density): people of features by the share of their area in each cell, per unit of area; the last cell of each axis is left out.

    Features are boxes (minx, miny, maxx, maxy) or polygons (ring), which are clipped to the cells."""
    polygons = "ring" in df.columns
    if polygons:
        df = df.select(population, "ring", *[c.alias(n) for c, n in zip(g.bounds(F.col("ring")), ("minx", "miny", "maxx", "maxy"), strict=True)])
    b = df.agg(F.min("minx").alias("x0"), F.min("miny").alias("y0"), F.max("maxx").alias("x1"), F.max("maxy").alias("y1"))
    n = lambda lo, hi: F.greatest(F.ceil((F.col(hi) - F.col(lo)) / cell).cast("long") - 1, F.lit(0).cast("long"))
    b = b.withColumn("nx", n("x0", "x1")).withColumn("ny", n("y0", "y1")).where("nx > 0 and ny > 0")
    cells = b.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1))).select("i", "j")
    at = lambda v, o: F.floor((F.col(v) - F.col(o)) / cell)
    f = df.join(F.broadcast(b)).withColumn("i", F.explode(F.sequence(at("minx", "x0"), at("maxx", "x0")))).withColumn("j", F.explode(F.sequence(at("miny", "y0"), at("maxy", "y0"))))
    over = lambda lo, hi, k, o: F.greatest(F.lit(0.0), F.least(F.col(hi), F.col(o) + (F.col(k) + 1) * cell) - F.greatest(F.col(lo), F.col(o) + F.col(k) * cell))
    share = over("minx", "maxx", "i", "x0") * over("miny", "maxy", "j", "y0") / F.nullif((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")), F.lit(0.0))
    if polygons:
        low = lambda k, o: F.col(o) + F.col(k) * cell
        part = g.clip_to_box(F.col("ring"), low("i", "x0"), low("j", "y0"), low("i", "x0") + cell, low("j", "y0") + cell)
        share = g.let(part, g.polygon_area) / F.nullif(g.polygon_area(F.col("ring")), F.lit(0.0))
    sums = f.groupBy("i", "j").agg(F.sum(F.col(population) * share / (cell * cell)).alias("d"))
    return cells.join(sums, ["i", "j"], "left").select("i", "j", F.coalesce("d", F.lit(0.0)).alias("density"))


def population_classes(df: DataFrame, population: str = "population") -> DataFrame:
    v = F.col(population)
    return df.agg(*_quantiles(v, (0.1, 0.25, 0.5, 0.75, 0.9)), F.count_if(v < 1e3).alias("low"), F.count_if((v >= 1e3) & (v < 1e4)).alias("medium"), F.count_if((v >= 1e4) & (v < 1e5)).alias("high"), F.count_if(v >= 1e5).alias("very_high"))


def population_clustering(df: DataFrame, population: str, id_col: str = "feature_id", x: str = "lon", y: str = "lat") -> DataFrame:
    d = nearest_distance(df, id_col, x, y).join(df.select(F.col(id_col).alias("id"), F.col(population).cast("double").alias("w")), "id")
    a = d.agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("mean"), F.coalesce(F.expr("try_divide(sum(d * w), sum(w))"), F.lit(0.0)).alias("weighted"))
    return a.withColumn("clustering", F.when(F.col("mean") < 1000, "high").otherwise("low"))


def demographics(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, mean, std, min, max, distinct, mode) of each column; the mode is the smallest of equals."""
    out = None
    for c in columns:
        numeric = dict(df.dtypes)[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or dict(df.dtypes)[c].startswith("decimal")
        v = F.col(c).cast("double") if numeric else F.lit(None).cast("double")
        counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("k")).agg(F.min_by(F.col(c).cast("string"), F.struct(-F.col("k"), F.col(c))).alias("mode"), F.count("*").alias("distinct"))
        one = df.agg(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")).join(counts)
        out = one if out is None else out.unionByName(one)
    return out


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    total = df.agg(F.count(column).alias("total"))
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).join(F.broadcast(total)).select("value", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): Pearson over the rows where both are there; one pass for all pairs."""
    pairs = [(a, b) for a in columns for b in columns]
    both = lambda a, b: F.corr(F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double")))
    one = df.agg(*[both(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def strong_correlations(df: DataFrame, columns: list[str], threshold: float = 0.7) -> DataFrame:
    m = correlation_matrix(df, columns)
    order = F.array(*[F.lit(c) for c in columns])
    return m.where((F.array_position(order, F.col("a")) < F.array_position(order, F.col("b"))) & (F.abs("r") >= threshold))


def _rates(df: DataFrame, population: str) -> DataFrame:
    """df has prev, the value before."""
    return df.withColumn("rate", F.when(F.col("prev") > 0, (F.col(population) - F.col("prev")) / F.col("prev") * 100))


def growth_rates(df: DataFrame, time: str = "yr", population: str = "population", tie: str | None = None) -> DataFrame:
    rows = sliding(numbered(df, [time, *([tie] if tie else [])]), 1, 0, {"prev": lambda w: F.lag(population).over(w)})
    r = _rates(rows, population)
    return r.agg(F.avg("rate").alias("mean"), F.stddev_pop("rate").alias("std"), F.max("rate").alias("max"), F.min("rate").alias("min"), F.count("rate").alias("n"))


def growth_trend(df: DataFrame, time: str = "yr", population: str = "population") -> DataFrame:
    s = numbered(df, [time])
    a = s.agg(F.regr_slope(population, "i").alias("slope"), F.regr_r2(population, "i").alias("r2"), stats.slope_stderr(population, "i").alias("stderr"), F.count("*").alias("n"))
    a = a.withColumn("p", stats.student_p(F.expr("try_divide(slope, stderr)"), (F.col("n") - 2).cast("double")))
    return a.withColumn("significant", F.col("p") < 0.05)


def growth_by_location(df: DataFrame, location: str = "location", time: str = "yr", population: str = "population") -> DataFrame:
    r = _rates(df.withColumn("prev", F.lag(population).over(Window.partitionBy(location).orderBy(time))), population)
    a = r.groupBy(location).agg(F.avg("rate").alias("mean_rate"), (F.max_by(population, time) - F.min_by(population, time)).alias("change"), F.count("*").alias("n"), F.count("rate").alias("k"))
    return a.where("n > 1 and k > 0").drop("n", "k")


def growth_projection(df: DataFrame, time: str = "yr", population: str = "population", periods: int = 5) -> DataFrame:
    a = df.agg(F.max_by(population, time).alias("last"), F.min_by(population, time).alias("first"), F.count("*").alias("n")).where("n > 1")
    p = a.withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    return p.select("period", (F.col("last") + F.col("period") * (F.col("last") - F.col("first")) / (F.col("n") - 1)).alias("population"))


def age_stats(df: DataFrame, age: str = "age") -> DataFrame:
    v = F.col(age)
    return df.agg(F.avg(v).alias("mean"), stats.median(v).alias("median"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("range"))


def age_groups(df: DataFrame, age: str = "age") -> DataFrame:
    """Ages between the bounds of two groups belong to neither."""
    v, n = F.col(age), F.count(age)
    parts = {"children": (v >= 0) & (v <= 14), "youth": (v >= 15) & (v <= 24), "adults": (v >= 25) & (v <= 64), "elderly": v >= 65}
    one = df.agg(n.alias("n"), *[F.count_if(c).alias(k) for k, c in parts.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("group"), F.col(k).alias("count"), F.coalesce(F.try_divide(F.col(k) * F.lit(100.0), F.col("n")), F.lit(0.0)).alias("pct")) for k in parts])))


def age_pyramid(df: DataFrame, age: str = "age", population: str = "population") -> DataFrame:
    """(bin, population): right-closed bins of five years; 0 and what is above 100 have none."""
    v = F.col(age)
    return df.where((v > 0) & (v <= 100)).groupBy((F.ceil(v / 5) - 1).cast("int").alias("bin")).agg(F.sum(population).alias("population"))


def dependency_ratios(df: DataFrame, age: str = "age") -> DataFrame:
    v = F.col(age)
    a = df.agg(F.count_if((v >= 0) & (v <= 14)).alias("young"), F.count_if(v >= 65).alias("old"), F.count_if((v >= 15) & (v <= 64)).alias("working"))
    r = lambda e: F.coalesce(F.expr(f"try_divide(({e}) * 100e0, working)"), F.lit(0.0))
    return a.select(r("young").alias("youth"), r("old").alias("elderly"), r("young + old").alias("total"))


def age_distribution(df: DataFrame, age: str = "age") -> DataFrame:
    return df.agg(*_quantiles(age, (0.25, 0.5, 0.75)), stats.skew_corrected(age).alias("skewness"), stats.kurtosis_corrected(age).alias("kurtosis"))


def migration_stats(df: DataFrame, migrants: str = "migrants") -> DataFrame:
    v = F.col(migrants)
    return df.agg(F.sum(v).alias("total"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.max(v).alias("max"), F.min(v).alias("min"), F.count(v).alias("n"))


def top_flows(df: DataFrame, by: str, migrants: str = "migrants", k: int = 10) -> DataFrame:
    return df.groupBy(by).agg(F.sum(migrants).alias("migrants")).orderBy(F.desc("migrants"), by).limit(k)


def net_migration(df: DataFrame, origin: str = "origin", destination: str = "destination", migrants: str = "migrants") -> DataFrame:
    out = df.groupBy(F.col(origin).alias("location")).agg(F.sum(migrants).alias("leaving"))
    into = df.groupBy(F.col(destination).alias("location")).agg(F.sum(migrants).alias("coming"))
    return out.join(into, "location", "full").select("location", (F.coalesce("coming", F.lit(0.0)) - F.coalesce("leaving", F.lit(0.0))).alias("net"))


def migration_network(df: DataFrame, origin: str = "origin", destination: str = "destination", migrants: str = "migrants") -> DataFrame:
    a = df.agg(F.count_distinct(origin).alias("origins"), F.count_distinct(destination).alias("destinations"), F.count("*").alias("flows"), F.avg(migrants).alias("mean"))
    return a.withColumn("density", F.expr("try_divide(flows, cast(origins * destinations as double))"))


def temporal_migration(df: DataFrame, time: str = "yr", migrants: str = "migrants") -> DataFrame:
    return df.groupBy(time).agg(F.sum(migrants).alias("total"), F.avg(migrants).alias("mean"), F.count(migrants).alias("n"))


def migration_intensity(df: DataFrame, migrants: str = "migrants") -> DataFrame:
    return df.agg(F.avg(migrants).alias("mean"), F.max(migrants).alias("max"), *_quantiles(migrants, (0.25, 0.5, 0.75, 0.9)))


def indicator_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("indicator").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), stats.median("v").alias("median"))


def inequality(df: DataFrame, column: str) -> DataFrame:
    """Gini, variation and the 90 to 10 ratio; 0 where undefined. The rank of a value comes from the counts of
    distinct values, so equal values are one row of the ordered window."""
    v = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    d = v.groupBy("v").agg(F.count("*").alias("k"))
    d = running_sum(d, ["v"], "k", "upto")
    # ranks upto-k+1..upto: sum over them of (n - rank + 1) * v
    a = v.agg(F.count("*").cast("double").alias("n"), F.sum("v").alias("t"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s"), stats.quantile("v", 0.9).alias("q90"), stats.quantile("v", 0.1).alias("q10"))
    cum = d.join(F.broadcast(a.select("n"))).agg(F.sum(F.expr("v * (k * (n + 1) - (upto * (upto + 1) - (upto - k) * (upto - k + 1)) / 2e0)")).alias("c"))
    r = a.join(cum)
    z = lambda e: F.coalesce(F.expr(e), F.lit(0.0))
    return r.select(z("(n + 1 - 2 * try_divide(c, t)) / n").alias("gini"), z("try_divide(s, m)").alias("cv"), z("try_divide(q90, q10)").alias("p90_p10"))


def composite_index(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of the z-scores that a row has; its mean, deviation and quartiles over the rows."""
    a = df.agg(*[x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"m{i}"), F.nullif(F.stddev_samp(c), F.lit(0.0)).alias(f"s{i}"))])
    z = F.filter(F.array(*[(F.col(c) - F.col(f"m{i}")) / F.col(f"s{i}") for i, c in enumerate(columns)]), lambda x: x.isNotNull())
    rows = df.join(F.broadcast(a)).select(F.when(F.size(z) > 0, F.aggregate(z, F.lit(0.0), lambda s, x: s + x) / F.size(z)).alias("v"))
    return rows.agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), *_quantiles("v", (0.25, 0.5, 0.75)))
