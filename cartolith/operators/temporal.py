"""Time series: statistics, trends, seasons, change points, autocorrelation.

Row numbers and sliding windows over the one order of a series come from ``ordered``: ranges of the order and blocks of
rows, so no task holds the series. ``location``-wise operators partition by it and scale with the number of locations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.functions import stats
from cartolith.operators.chunking import kmeans
from cartolith.operators.ordered import numbered, running_sum, sliding
from cartolith.plans.iterate import saved


def _series(df: DataFrame, time: str, value: str, tie: str | None) -> DataFrame:
    ts = F.to_timestamp(time)
    return df.select(ts.alias("ts"), F.col(value).cast("double").alias("v"), (F.col(tie) if tie else F.lit(0)).alias("tie")).where("ts is not null")


def seconds(c):
    return F.unix_micros(c) / 1e6


def ts_stats(df: DataFrame, time: str, value: str) -> DataFrame:
    s = _series(df, time, value, None)
    days = F.floor((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 86_400_000_000)
    return s.agg(F.min("ts").alias("start"), F.max("ts").alias("end"), days.cast("long").alias("days"), F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("dates"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def trend(df: DataFrame, time: str, value: str, tie: str) -> DataFrame:
    """Ordinary least squares over seconds since the first time, and the spread of what a line over the row number leaves."""
    s = _series(df, time, value, tie)
    first = s.agg(F.min(seconds("ts")).alias("t0"))
    rows = numbered(s, ["ts", "tie"]).join(F.broadcast(first)).withColumn("t", seconds("ts") - F.col("t0"))
    n = F.count("v")
    a = rows.agg(F.regr_slope("v", "t").alias("slope"), F.regr_intercept("v", "t").alias("intercept"), F.regr_r2("v", "t").alias("r2"), stats.slope_stderr("v", "t").alias("stderr"), F.sqrt(F.regr_syy("v", "i") * (1 - F.regr_r2("v", "i")) / n).alias("detrended_std"), n.cast("double").alias("n"))
    a = a.withColumn("p", stats.student_p(F.expr("try_divide(slope, stderr)"), F.col("n") - 2))
    return a.withColumn("interpretation", F.when(F.col("p") >= 0.05, "no significant trend").when(F.col("slope") > 0, "increasing").otherwise("decreasing"))


def _inversions(pdf: pd.DataFrame) -> pd.DataFrame:
    """Signs of the pairs of one run: sorted halves, merged."""
    v = pdf.sort_values("i").v.to_numpy()
    n, s, width = len(v), 0, 1
    rank = np.searchsorted(np.unique(v), v).astype(np.int64)
    while width < n:
        # pairs of neighbouring stretches at once: the stretch pair is the high part of the key
        at = np.arange(n)
        pair, second = at // (2 * width), (at // width) % 2 == 1
        key = pair * (n + 1) + rank
        first_sorted = np.sort(key[~second])
        below = np.searchsorted(first_sorted, key[second], "left") - np.searchsorted(first_sorted, pair[second] * (n + 1), "left")
        upto = np.searchsorted(first_sorted, key[second], "right")
        above = np.searchsorted(first_sorted, (pair[second] + 1) * (n + 1), "left") - upto
        s += int(below.sum() - above.sum())
        width *= 2
    return pd.DataFrame({"s": [s]})


def _across(run: DataFrame, width: int) -> DataFrame:
    """(s): signs of the pairs between the first and the second half of each stretch of 2 * width runs.

    By value, equal ones folded: a row of the second half counts the rows of the first half below it less those above,
    which running sums over ranges of (stretch, value) give."""
    side = F.floor(F.col("run") / width) % 2
    folded = run.groupBy(F.floor(F.col("run") / (2 * width)).alias("pair"), "v").agg(F.count_if(side == 0).alias("a"), F.count_if(side == 1).alias("b"))
    upto = running_sum(folded, ["pair", "v"], "a", "upto")
    # running sums go over all stretches; of each stretch the rows before it and in it
    whole = folded.groupBy("pair").agg(F.sum("a").alias("all")).where("all > 0")
    whole = running_sum(whole, ["pair"], "all", "end")
    j = upto.join(whole.select("pair", F.col("all"), "end"), "pair")
    below = F.col("upto") - F.col("a") - (F.col("end") - F.col("all"))
    return j.agg(F.coalesce(F.sum(F.col("b") * (below - (F.col("all") - below - F.col("a")))), F.lit(0)).cast("long").alias("s"))


def mann_kendall(df: DataFrame, time: str, value: str, tie: str, block: int = 1 << 16) -> DataFrame:
    """(n, s, var, z, p). S adds up the signs of all pairs, later minus earlier, without making them.

    Runs of ``block`` rows of the order are sorted and counted, then merged two by two: a merge counts the pairs between
    its halves in slices of values, so the work is n log n and a task holds two slices."""
    s = _series(df, time, value, tie).where("v is not null")
    rows = numbered(s, ["ts", "tie"]).select("i", "v")
    run = saved(rows.withColumn("run", F.floor(F.col("i") / block)).select("run", "i", "v"), "runs")
    n = run.count()
    total = run.groupBy("run").applyInPandas(_inversions, "s long").agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"))
    # between runs: by halves of ever longer stretches, each dealt by ranges of the values
    width = 1
    while width * block < n:
        total = total.unionByName(_across(run, width))
        width *= 2
    total = total.agg(F.sum("s").alias("s"))
    r = total.join(run.agg(F.count("*").alias("n"))).withColumn("var", F.expr("cast(n as double) * (n - 1) * (2 * n + 5) / 18"))
    z = F.when(F.col("s") > 0, (F.col("s") - 1) / F.sqrt("var")).when(F.col("s") < 0, (F.col("s") + 1) / F.sqrt("var")).otherwise(0.0)
    r = r.withColumn("z", F.when(F.col("n") >= 3, z))
    return r.select("n", "s", "var", "z").withColumn("p", stats.normal_p("z"))


def seasonal_pattern(df: DataFrame, time: str, value: str, unit: str = "month") -> DataFrame:
    """By month or ISO week: mean, sample standard deviation, count."""
    key = {"month": F.month("ts"), "week": F.weekofyear("ts")}[unit]
    return _series(df, time, value, None).groupBy(key.alias(unit)).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count("v").alias("n"))


def _centred(w: int) -> tuple[int, int]:
    """Rows before and after in a centred window of w rows."""
    return w - 1 - (w - 1) // 2, (w - 1) // 2


def rolling(column: str, w: int, f=F.avg):
    """Of a window of the order: the centred rolling value of w rows, null where the window is cut."""
    before, after = _centred(w)

    def value(window):
        win = window.rowsBetween(-before, after)
        return F.when(F.count(column).over(win) == w, f(column).over(win))

    return value


def seasonal_decompose(df: DataFrame, time: str, value: str, tie: str, unit: str = "month") -> DataFrame:
    """(ts, tie, v, trend, seasonal, residual). The window is a quarter of the rows, 12 at most, made odd."""
    s = _series(df, time, value, tie)
    n = s.count()
    w = min(12, n // 4)
    w = max(1, w + 1 if w % 2 == 0 else w)
    key = {"month": F.month("ts"), "week": F.weekofyear("ts")}[unit]
    means = s.groupBy(key.alias("k")).agg(F.avg("v").alias("m"))
    whole = s.agg(F.avg("v").alias("g"))
    d = sliding(numbered(s, ["ts", "tie"]), *_centred(w), {"trend": rolling("v", w)}).withColumn("k", key).join(F.broadcast(means), "k").join(F.broadcast(whole))
    d = d.withColumn("seasonal", F.col("m") - F.col("g"))
    return d.select("ts", "tie", "v", "trend", "seasonal", (F.col("v") - F.col("trend") - F.col("seasonal")).alias("residual"))


def seasonality_strength(parts: DataFrame, std: bool = False) -> DataFrame:
    """Share of the seasonal variance, at most 1. Without std any missing residual makes it 0; with it they are left out."""
    a = parts.agg(F.var_pop("seasonal").alias("vs"), F.var_pop("residual").alias("vr"), F.count_if(F.col("residual").isNull()).alias("gaps"), F.count("*").alias("n"))
    x = F.coalesce(F.least(F.lit(1.0), F.expr("try_divide(vs, vs + vr)")), F.lit(0.0))
    return a.select((x if std else F.when(F.col("gaps") > 0, 0.0).otherwise(x)).alias("strength"))


def change_candidates(df: DataFrame, time: str, value: str, tie: str) -> DataFrame:
    """(i, ts, v, z) where a value is more than two rolling standard deviations off its rolling mean."""
    s = _series(df, time, value, tie)
    n = s.count()
    w = min(10, n // 4)
    if w < 3:
        return s.limit(0).select(F.lit(0).alias("i"), "ts", "v", F.lit(0.0).alias("z"))
    d = sliding(numbered(s, ["ts", "tie"]), *_centred(w), {"m": rolling("v", w), "sd": rolling("v", w, F.stddev_samp)})
    z = F.abs(F.col("v") - F.col("m")) / F.nullif(F.col("sd"), F.lit(0.0))
    return d.withColumn("z", z).where((F.col("z") > 2) & (F.col("i") >= w) & (F.col("i") < n - w)).select(F.col("i").cast("int").alias("i"), "ts", "v", "z")


def change_points(df: DataFrame, time: str, value: str, tie: str) -> DataFrame:
    """Candidates without those less than a window after one that is kept: a fold over their order."""
    w = min(10, df.count() // 4)
    c = change_candidates(df, time, value, tie)
    order = c.agg(F.array_sort(F.collect_list("i")).alias("all"))
    step = lambda kept, i: F.when((F.size(kept) == 0) | (i - F.coalesce(F.element_at(kept, -1), F.lit(0)) >= w), F.concat(kept, F.array(i))).otherwise(kept)
    kept = order.select(F.explode(F.aggregate("all", F.array().cast("array<int>"), step)).alias("i"))
    return c.join(kept, "i")


def trend_by_location(df: DataFrame, time: str, value: str, location: str) -> DataFrame:
    rows = df.select(F.col(location).alias("location"), F.to_timestamp(time).alias("ts"), F.col(value).cast("double").alias("v"))
    first = rows.groupBy("location").agg(F.min(seconds("ts")).alias("t0"))
    t = rows.join(first, "location").withColumn("t", seconds("ts") - F.col("t0"))
    return t.groupBy("location").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.regr_slope("v", "t").alias("slope"), F.regr_r2("v", "t").alias("r2"), F.min("ts").alias("start"), F.max("ts").alias("end")).where("n > 1")


def temporal_kmeans(df: DataFrame, time: str, value: str, n_clusters: int = 3) -> DataFrame:
    """Clusters of standardised time and value (population deviation): size, time range, mean, deviation, inertia."""
    s = _series(df, time, value, None).withColumn("t", seconds("ts"))
    a = s.agg(F.avg("t").alias("mt"), F.nullif(F.stddev_pop("t"), F.lit(0.0)).alias("st"), F.avg("v").alias("mv"), F.nullif(F.stddev_pop("v"), F.lit(0.0)).alias("sv"))
    z = s.join(F.broadcast(a)).withColumn("zt", F.coalesce((F.col("t") - F.col("mt")) / F.col("st"), F.lit(0.0))).withColumn("zv", F.coalesce((F.col("v") - F.col("mv")) / F.col("sv"), F.lit(0.0)))
    rows, _, cost = kmeans(z, n_clusters, "zt", "zv")
    return rows.groupBy("cluster").agg(F.count("*").alias("size"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")).withColumn("inertia", F.lit(cost))


def autocorrelation(df: DataFrame, time: str, value: str, tie: str, max_lag: int = 10) -> DataFrame:
    """(lag, r, significant) for lags below the number of rows; an undefined correlation is 0."""
    s = _series(df, time, value, tie)
    k = max(0, min(max_lag, s.count() - 1))
    if not k:
        return s.limit(0).select(F.lit(0).alias("lag"), F.lit(0.0).alias("r"), F.lit(False).alias("significant"))
    lagged = sliding(numbered(s, ["ts", "tie"]), k, 0, {f"l{i}": lambda w, i=i: F.lag("v", i).over(w) for i in range(1, k + 1)})
    r = lagged.agg(*[F.coalesce(F.nanvl(F.corr("v", f"l{i}"), F.lit(0.0)), F.lit(0.0)).alias(f"r{i}") for i in range(1, k + 1)])
    rows = F.array(*[F.struct(F.lit(i).alias("lag"), F.col(f"r{i}").alias("r"), (F.abs(f"r{i}") > 0.2).alias("significant")) for i in range(1, k + 1)])
    return r.select(F.inline(rows))
