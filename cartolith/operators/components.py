"""Connected components: forests of each partition first, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.plans.iterate import dropped, saved_at

#: Edges that a task holds while it makes forests.
HELD = 1 << 20


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable) by these edges alone, of nodes that are not the least themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        # each root takes the least root it has an edge to; then paths are halved until flat
        ru, rv = root[u], root[v]
        low, high = np.minimum(ru, rv), np.maximum(ru, rv)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    a, b, n = [], [], 0
    for pdf in batches:
        a.append(pdf.a.to_numpy())
        b.append(pdf.b.to_numpy())
        n += len(pdf)
        if n >= HELD:
            x, y = _forest(np.concatenate(a), np.concatenate(b))
            a, b, n = [x], [y], len(x)
            if n >= HELD // 2:
                yield pd.DataFrame({"a": x, "b": y})
                a, b, n = [], [], 0
    if n:
        x, y = _forest(np.concatenate(a), np.concatenate(b))
        yield pd.DataFrame({"a": x, "b": y})


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component: the smallest node reachable) of every node that is on an edge (a, b).

    Forests made in each task replace its edges, so long paths of neighbouring edges are short before the first
    shuffle. Each round's edges are written to the shared folder and the ones before removed; the driver gets a count and
    a check sum. Rounds grow with the logarithm of the longest path. Nulls are ignored; a loop's node is alone."""
    old: list[str] = []

    def put(df: DataFrame) -> DataFrame:
        out, path = saved_at(df, "components")
        old.append(path)
        return out

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    clean = edges.where("a is not null and b is not null").select(F.col("a").cast("long"), F.col("b").cast("long"))
    now = put(clean.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInPandas(_forests, "a long, b long").distinct())
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = put(both.groupBy("a").agg(F.least("a", F.min("b")).alias("b")))
        large = put(both.join(least.withColumnRenamed("b", "m"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = put(large.groupBy("a").agg(F.min("b").alias("b")))
        small = large.join(least.withColumnRenamed("b", "m"), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = put(small.unionByName(least).distinct())
        for path in old[:-1]:
            dropped(edges.sparkSession, path)
        del old[:-1]
        last, seen = seen, state(now)
        if last == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select("b", "b").distinct().toDF("node", "component"))
