"""Synthetic inputs, made on the executors from seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exponential(scale: float, seed: int):
    return -scale * F.log(1 - F.rand(seed))


def points(spark: SparkSession, n: int = 100, seed: int = 42) -> DataFrame:
    """Points with a population, elevation, temperature, precipitation and a daily timestamp."""
    r = spark.range(n)
    return r.select(
        "id", (40 + 2 * F.rand(seed)).alias("latitude"), (-74 + 2 * F.rand(seed + 1)).alias("longitude"), F.greatest(F.lit(0), F.round(1000 + F.sqrt(F.lit(1000.0)) * F.randn(seed + 2))).cast("long").alias("population"),
        (100 + 50 * F.randn(seed + 3)).alias("elevation"), (20 + 5 * F.randn(seed + 4)).alias("temperature"), exponential(10, seed + 5).alias("precipitation"), F.expr("timestamp'2024-01-01' + make_dt_interval(cast(id as int))").alias("timestamp"),
    )


def station_grid(spark: SparkSession, side: int = 10, days: int = 31, seed: int = 42) -> DataFrame:
    """side x side stations, daily: a sine of the day for temperature, exponential precipitation and wind speed."""
    r = spark.range(side * side * days).withColumn("s", F.floor(F.col("id") / days)).withColumn("d", (F.col("id") % days).cast("int"))
    return r.select(
        (40 + 2 * F.floor(F.col("s") / side) / max(1, side - 1)).alias("latitude"), (-74 + 2 * (F.col("s") % side) / max(1, side - 1)).alias("longitude"), F.expr("timestamp'2024-01-01' + make_dt_interval(d)").alias("timestamp"),
        (20 + 10 * F.sin(2 * F.pi() * F.col("d") / 365) + 2 * F.randn(seed)).alias("temperature"), exponential(5, seed + 1).alias("precipitation"), exponential(3, seed + 2).alias("wind_speed"), (360 * F.rand(seed + 3)).alias("wind_direction"),
    )


# fixed values: what the categories of the demonstration table are called
AGES, INCOMES, EDUCATION = ["0-14", "15-24", "25-64", "65+"], ["low", "medium", "high"], ["primary", "secondary", "tertiary"]


def demo_points(spark: SparkSession, n: int = 200, seed: int = 42) -> DataFrame:
    """Points of a town with elevation, weather, people and their groups, a day apart; the same seed gives the same rows."""
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (F.floor(F.rand(seed + k) * len(names)) + 1).cast("int"))
    return spark.range(0, n, 1, 1).select(
        "id", (F.rand(seed) * 0.5 + 40.5).alias("latitude"), (F.rand(seed + 1) * 0.5 - 74.2).alias("longitude"), F.round(2000 + F.randn(seed + 2) * F.sqrt(F.lit(2000.0))).cast("long").alias("population"),
        (50 + F.randn(seed + 3) * 30).alias("elevation"), (20 + F.randn(seed + 4) * 10).alias("temperature"), (-5 * F.log(1 - F.rand(seed + 5))).alias("precipitation"), (10 + F.randn(seed + 6) * 3).alias("wind_speed"),
        (F.rand(seed + 7) * 360).alias("wind_direction"), F.expr("timestamp'2024-01-01' + make_dt_interval(cast(id as int))").alias("timestamp"), pick(AGES, 8).alias("age_group"), pick(INCOMES, 9).alias("income_level"), pick(EDUCATION, 10).alias("education_level"),
    )
