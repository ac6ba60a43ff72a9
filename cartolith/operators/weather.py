"""Weather observations: overlay, climate, precipitation, temperature, wind, impact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolith.functions import geometry as g
from cartolith.functions import stats
from cartolith.operators.ordered import numbered, running_sum, sliding
from cartolith.operators.terrain import DIRECTIONS, _classes, direction


def season(ts):
    m = F.month(ts)
    return F.when(m.isin(12, 1, 2), "Winter").when(m.isin(3, 4, 5), "Spring").when(m.isin(6, 7, 8), "Summer").otherwise("Fall")


def overlay(features: DataFrame, obs: DataFrame, value: str, id_col: str = "area_id", lon: str = "longitude", lat: str = "latitude", size: float = 10.0) -> DataFrame:
    """Of each feature: mean, deviation, extremes, median and count of the observations in it. Features are boxes (minx,
    miny, maxx, maxy), their edges included, or polygons (ring), whose inside counts."""
    polygons = "ring" in features.columns
    f = features.select(id_col, "ring", *[c.alias(n) for c, n in zip(g.bounds(F.col("ring")), ("minx", "miny", "maxx", "maxy"), strict=True)]) if polygons else features.select(id_col, "minx", "miny", "maxx", "maxy")
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size)))
    f = f.withColumn("cx", cells("minx", "maxx")).withColumn("cy", cells("miny", "maxy"))
    o = obs.select(F.col(lon).alias("ox"), F.col(lat).alias("oy"), F.col(value).cast("double").alias("v")).withColumn("cx", F.floor(F.col("ox") / size)).withColumn("cy", F.floor(F.col("oy") / size))
    hit = f.join(o, ["cx", "cy"]).where((F.col("ox") >= F.col("minx")) & (F.col("ox") <= F.col("maxx")) & (F.col("oy") >= F.col("miny")) & (F.col("oy") <= F.col("maxy")))
    if polygons:
        hit = hit.where(g.within_ring(F.col("ox"), F.col("oy"), F.col("ring")))
    a = hit.groupBy(id_col).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("n"), stats.median("v").alias("median"))
    return features.select(id_col).join(a, id_col, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def overlay_stats(obs: DataFrame, value: str, time: str = "obs_ts", lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    v = F.col(value).cast("double")
    return obs.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.min(lon).alias("minx"), F.min(lat).alias("miny"), F.max(lon).alias("maxx"), F.max(lat).alias("maxy"), F.min(time).alias("start"), F.max(time).alias("end"))


def _period(time: str, period: str) -> list:
    keys = {
        "daily": [F.year(time).alias("year"), F.month(time).alias("month"), F.dayofmonth(time).alias("day")], "weekly": [F.year(time).alias("year"), F.weekofyear(time).alias("week")],
        "monthly": [F.year(time).alias("year"), F.month(time).alias("month")], "seasonal": [F.year(time).alias("year"), season(time).alias("season")],
    }
    if period not in keys:
        raise ValueError(f"unknown period {period}")
    return keys[period]


def climate(obs: DataFrame, value: str, period: str = "monthly", time: str = "obs_ts") -> DataFrame:
    v = F.col(value).cast("double")
    return obs.groupBy(*_period(time, period)).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))


def climate_trend(groups: DataFrame) -> DataFrame:
    """Line over the ordinal of the groups by their keys; there are few of them."""
    keys = [c for c in groups.columns if c in ("year", "month", "week", "day", "season")]
    g = numbered(groups, keys)
    a = g.agg(F.regr_slope("mean", "i").alias("slope"), F.regr_intercept("mean", "i").alias("intercept"), F.regr_r2("mean", "i").alias("r2"), stats.slope_stderr("mean", "i").alias("stderr"), F.count("*").alias("n"))
    return a.withColumn("p", stats.student_p(F.expr("try_divide(slope, stderr)"), (F.col("n") - 2).cast("double")))


def seasonal_climate(obs: DataFrame, value: str, time: str = "obs_ts") -> DataFrame:
    """By season, beside the variability over seasons."""
    v = F.col(value).cast("double")
    s = obs.groupBy(season(time).alias("season")).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    a = s.agg((F.stddev_samp("mean") / F.nullif(F.avg("mean"), F.lit(0.0))).alias("variability"))
    return s.join(F.broadcast(a))


def spatial_climate(obs: DataFrame, value: str, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    g = obs.groupBy(lon, lat).agg(F.avg(F.col(value).cast("double")).alias("mean"))
    return g.agg(F.count("*").alias("stations"), F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("std"), F.corr(lat, "mean").alias("lat_corr"), F.corr(lon, "mean").alias("lon_corr"))


def precip_stats(obs: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return obs.agg(F.sum(v).alias("total"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.max(v).alias("max"), F.min(v).alias("min"), stats.median(v).alias("median"), F.count_if(v == 0).alias("dry"), F.count_if(v > 0).alias("wet"), F.count(v).alias("n"))


def precip_intensity(obs: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    q = [stats.quantile(v, p).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75, 0.9, 0.95)]
    return obs.where(v > 0).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.max(v).alias("max"), *q)


def precip_sums(obs: DataFrame, value: str, by: str, time: str = "obs_ts") -> DataFrame:
    key = F.month(time) if by == "month" else season(time)
    return obs.groupBy(key.alias(by)).agg(F.sum(value).alias("total"))


def drought(obs: DataFrame, value: str) -> DataFrame:
    """Rows below half the mean: their number, share and mean."""
    m = obs.agg((F.avg(value) * 0.5).alias("limit"))
    low = F.col(value) < F.col("limit")
    return obs.join(F.broadcast(m)).agg(F.first("limit").alias("limit"), F.count_if(low).alias("n"), (F.count_if(low) * 100.0 / F.count("*")).alias("pct"), F.avg(F.when(low, F.col(value))).alias("mean"))


def precip_cumsum(obs: DataFrame, value: str, time: str = "obs_ts", tie: str = "event_id") -> DataFrame:
    def mean_of_30(window):
        win = window.rowsBetween(-15, 14)
        return F.when(F.count(value).over(win) == 30, F.avg(value).over(win))

    rows = running_sum(obs.select(tie, time, value), [time, tie], value, "cumulative")
    return sliding(numbered(rows, [time, tie]), 15, 14, {"rolling": mean_of_30}).select(tie, time, "cumulative", "rolling")


def extreme_precip(obs: DataFrame, value: str) -> DataFrame:
    q = obs.agg(stats.quantile(value, 0.95).alias("limit"))
    return obs.join(F.broadcast(q)).agg(F.first("limit").alias("limit"), F.count_if(F.col(value) > F.col("limit")).alias("n"), F.max(F.when(F.col(value) > F.col("limit"), F.col(value))).alias("max"))


def temp_stats(obs: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return obs.agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.max(v).alias("max"), F.min(v).alias("min"), stats.median(v).alias("median"), (F.max(v) - F.min(v)).alias("range"))


def temp_extremes(obs: DataFrame, value: str) -> DataFrame:
    q = obs.agg(stats.quantile(value, 0.9).alias("q90"), stats.quantile(value, 0.1).alias("q10"), stats.quantile(value, 0.95).alias("q95"))
    v = F.col(value)
    return obs.join(F.broadcast(q)).agg(F.count_if(v > F.col("q90")).alias("hot"), F.count_if(v < F.col("q10")).alias("cold"), F.count_if(v <= 0).alias("freezing"), F.count_if(v > F.col("q95")).alias("hot_nights"))


def temp_means(obs: DataFrame, value: str, by: str, time: str = "obs_ts") -> DataFrame:
    key = {"month": F.month(time), "year": F.year(time), "hour": F.hour(time)}[by]
    return obs.groupBy(key.alias(by)).agg(F.avg(value).alias("mean"))


def temp_diurnal(obs: DataFrame, low: str, high: str) -> DataFrame:
    d = F.col(high) - F.col(low)
    return obs.agg(F.avg(d).alias("mean"), F.max(d).alias("max"), F.min(d).alias("min"))


def heat_waves(obs: DataFrame, value: str) -> DataFrame:
    q = obs.agg(stats.quantile(value, 0.9).alias("limit"))
    hot = F.col(value) > F.col("limit")
    return obs.join(F.broadcast(q)).agg(F.first("limit").alias("limit"), F.count_if(hot).alias("n"), (F.count_if(hot) * 100.0 / F.count("*")).alias("pct"))


def heat_waves_std(obs: DataFrame, value: str, station: list[str], time: str = "obs_ts", days: int = 3) -> DataFrame:
    """Runs of so many consecutive days or more, by station, whose daily maximum is above the quantile: gaps and islands."""
    q = obs.agg(stats.quantile(value, 0.9).alias("limit"))
    d = obs.groupBy(*station, F.to_date(time).alias("day")).agg(F.max(value).alias("v")).join(F.broadcast(q)).where("v > limit")
    w = Window.partitionBy(*station).orderBy("day")
    runs = d.withColumn("run", F.datediff("day", F.lit("1970-01-01")) - F.row_number().over(w)).groupBy(*station, "run").agg(F.min("day").alias("start"), F.count("*").alias("length"), F.max("v").alias("max"))
    return runs.where(F.col("length") >= days).drop("run")


def wind_stats(obs: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return obs.agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.max(v).alias("max"), F.min(v).alias("min"), stats.median(v).alias("median"))


def wind_classes(obs: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    label = F.when(v < 1, "calm").when(v < 3, "light").when(v < 5, "gentle").when(v < 8, "moderate").when(v < 11, "fresh").otherwise("strong")
    return _classes(obs.where(v.isNotNull()), label, ["calm", "light", "gentle", "moderate", "fresh", "strong"])


def wind_directions(obs: DataFrame, value: str) -> DataFrame:
    """(class, n, pct, prevailing, mean): the mean is arithmetic; of equal classes the first in order prevails."""
    c = _classes(obs.where(F.col(value).isNotNull()), direction(F.col(value)), DIRECTIONS)
    order = F.array_position(F.array(*[F.lit(d) for d in DIRECTIONS]), F.col("class"))
    top = c.agg(F.max_by("class", F.struct(F.col("n"), -order)).alias("prevailing"))
    mean = obs.agg(F.avg(value).alias("mean"))
    return c.join(F.broadcast(top)).join(F.broadcast(mean))


def weather_impact(features: DataFrame, obs: DataFrame, value: str, **names) -> DataFrame:
    """The overlay with the three fixed impact grades."""
    rows = F.array(*[F.struct(F.lit(k).alias("impact"), F.lit(g).alias("grade"), F.lit(s).alias("score")) for k, g, s in (("agricultural", "low", 0.2), ("transportation", "moderate", 0.5), ("energy", "high", 0.8))])
    o = overlay(features, obs, value, **names)
    return o.withColumn("x", F.explode(rows)).select(o.columns[0], "mean", "n", "x.impact", "x.grade", "x.score")
