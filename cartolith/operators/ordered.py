"""One global order over many tasks: row numbers, sliding windows and running sums without a window of all rows.

Rows are dealt by ranges of the order and written; the rows before a range are counted, which is one number a
partition. Sliding windows run over blocks of the row number, each with the few rows that its frame reaches into.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolith.plans.iterate import saved

BLOCK = 1 << 16


def _dealt(df: DataFrame, order: list[str]) -> tuple[DataFrame, Window]:
    rows = saved(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ordered")
    return rows, Window.partitionBy("_p").orderBy(*order)


def _before(rows: DataFrame, total) -> DataFrame:
    """(_p, _before): the total over all earlier partitions; a row a partition."""
    found = sorted((r._p, r.n) for r in rows.groupBy("_p").agg(total.alias("n")).collect())
    sums = [0, *accumulate(n or 0 for _, n in found)]
    kind = dict(rows.groupBy("_p").agg(total.alias("n")).dtypes)["n"]
    return rows.sparkSession.createDataFrame([(p, s if kind == "bigint" else float(s)) for (p, _), s in zip(found, sums, strict=False)], f"_p int, _before {kind}")


def numbered(df: DataFrame, order: list[str], name: str = "i") -> DataFrame:
    """The rows with their place in the order, from 0."""
    rows, w = _dealt(df, order)
    return rows.withColumn(name, F.row_number().over(w)).join(F.broadcast(_before(rows, F.count("*"))), "_p").withColumn(name, F.col(name) + F.col("_before") - 1).drop("_p", "_before")


def running_sum(df: DataFrame, order: list[str], column: str, name: str) -> DataFrame:
    """The rows with the sum of a column over all rows up to each."""
    rows, w = _dealt(df, order)
    own = F.sum(column).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, own).join(F.broadcast(_before(rows, F.sum(column))), "_p").withColumn(name, F.when(F.col(name).isNotNull(), F.col(name) + F.col("_before")).otherwise(F.nullif("_before", F.lit(0)))).drop("_p", "_before")


def sliding(rows: DataFrame, before: int, after: int, columns: dict, i: str = "i") -> DataFrame:
    """The rows with more columns: name -> function of a window that reaches so many rows before and after.

    rows have their place i. A block's window sees the rows its frames reach into, which are copies from its neighbours."""
    block = max(BLOCK, 4 * (before + after))
    low, high = F.floor(F.greatest(F.col(i) - after, F.lit(0)) / block), F.floor((F.col(i) + before) / block)
    spread = rows.withColumn("_b", F.explode(F.sequence(low, high)))
    w = Window.partitionBy("_b").orderBy(i)
    return spread.select("*", *[f(w).alias(name) for name, f in columns.items()]).where(F.floor(F.col(i) / block) == F.col("_b")).drop("_b")
