"""Transport networks. Links have end points (ux, uy), (vx, vy), or end nodes u, v."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.functions import geometry as g
from cartolith.functions import stats
from cartolith.operators.bandjoin import band_join
from cartolith.operators.ordered import numbered
from cartolith.operators.spatial_stats import components as _components
from cartolith.operators.spatial_stats import places, same_id
from cartolith.plans.iterate import saved


#: Rounds after which written steps are folded into one table.
FOLD = 16
#: Links, each in both directions, that are sent to all tasks together.
MOST_ARCS = 32_000_000


def length():
    return F.hypot(F.col("ux") - F.col("vx"), F.col("uy") - F.col("vy"))


def link_stats(links: DataFrame) -> DataFrame:
    return links.select(length().alias("l")).agg(F.count("*").alias("links"), F.sum("l").alias("total"), F.avg("l").alias("mean"), F.stddev_samp("l").alias("std"), F.min("l").alias("min"), F.max("l").alias("max"))


def nodes(links: DataFrame) -> DataFrame:
    """Distinct end points."""
    return links.select(F.col("ux").alias("x"), F.col("uy").alias("y")).union(links.select("vx", "vy")).distinct()


def connectivity(links: DataFrame) -> DataFrame:
    a = links.agg(F.count("*").alias("l")).join(nodes(links).agg(F.count("*").alias("n")))
    return a.select(F.col("l").alias("links"), F.col("n").alias("nodes"), F.expr("coalesce(try_divide(cast(l as double), n), 0e0)").alias("beta"), F.expr("if(n > 2, (l - n + 1) / cast(2 * n - 5 as double), 0e0)").alias("alpha"), F.expr("coalesce(try_divide(cast(l as double), n * (n - 1) / 2e0), 0e0)").alias("gamma"))


def degrees(links: DataFrame) -> DataFrame:
    """(x, y, degree): links that begin or end there; a loop counts once, parallel links each."""
    ends = links.select(F.explode(F.array_distinct(F.array(F.struct(F.col("ux").alias("x"), F.col("uy").alias("y")), F.struct(F.col("vx").alias("x"), F.col("vy").alias("y"))))).alias("p"))
    return ends.groupBy("p.x", "p.y").agg(F.count("*").alias("degree"))


def topology(links: DataFrame) -> DataFrame:
    d = F.col("degree")
    return degrees(links).agg(F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), F.max(d).alias("max"), F.min(d).alias("min"), F.count_if(d == 0).alias("isolated"), F.count_if(d == 1).alias("terminal"), F.count_if(d > 2).alias("intersections"))


def hull_area(points: DataFrame) -> DataFrame:
    """(area) of the convex hull; 0 below three points. Each partition gives only its own hull to the last step."""

    def hull(pts):
        pts = sorted(set(pts))
        if len(pts) < 3:
            return pts
        out = []
        for seq in (pts, pts[::-1]):
            half = []
            for p in seq:
                while len(half) > 1 and (half[-1][0] - half[-2][0]) * (p[1] - half[-2][1]) - (half[-1][1] - half[-2][1]) * (p[0] - half[-2][0]) <= 0:
                    half.pop()
                half.append(p)
            out += half[:-1]
        return out

    def part(batches):
        import pandas as pd

        pts = []
        for pdf in batches:
            pts = hull(pts + list(zip(pdf.x, pdf.y, strict=True)))
        yield pd.DataFrame(pts, columns=["x", "y"], dtype="float64")

    def last(pdf):
        import pandas as pd

        h = hull(list(zip(pdf.x, pdf.y, strict=True)))
        a = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(h, h[1:] + h[:1], strict=True))) / 2 if len(h) > 2 else 0.0
        return pd.DataFrame({"area": [a]})

    some = points.select(F.col("x").cast("double"), F.col("y").cast("double")).mapInPandas(part, "x double, y double")
    return some.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(last, "area double")


def network_density(links: DataFrame) -> DataFrame:
    a = links.agg(F.sum(length()).alias("total"), F.count("*").alias("links")).join(hull_area(nodes(links)))
    return a.select("total", "area", F.expr("coalesce(try_divide(total, area), 0e0)").alias("length_density"), F.expr("coalesce(try_divide(cast(links as double), area), 0e0)").alias("link_density"))


def nearest_node(points: DataFrame, x: float, y: float) -> DataFrame:
    """The node nearest to (x, y); of equals the smallest coordinates."""
    d = F.hypot(F.col("x") - x, F.col("y") - y)
    return points.select("x", "y", d.alias("d")).orderBy("d", "x", "y").limit(1)


def route(links: DataFrame, ox: float, oy: float, dx: float, dy: float) -> DataFrame:
    """Both ends at their nearest nodes, a straight line between, at 30 km/h: km, minutes, speed (null for no distance)."""
    n = nodes(links)
    a = nearest_node(n, ox, oy).select(F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = nearest_node(n, dx, dy).select(F.col("x").alias("bx"), F.col("y").alias("by"))
    r = a.join(b).withColumn("distance", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))).withColumn("time", F.col("distance") / (30 / 3.6))
    return r.select("distance", "time", (F.col("distance") / 1000).alias("km"), (F.col("time") / 60).alias("minutes"), F.expr("try_divide(distance / 1000, time / 3600)").alias("speed"))


def route_alternatives(route: DataFrame) -> DataFrame:
    k = route.withColumn("alternative", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("factor", 1 + F.col("alternative") * 0.1)
    return k.select("alternative", "factor", (F.col("distance") * F.col("factor")).alias("distance"), (F.col("time") * F.col("factor")).alias("time"))


def shortest_path(links: DataFrame, source: int, target: int | None = None) -> DataFrame:
    """(node, cost) by length from a source node: a frontier that relaxes until nothing improves.

    Each round writes only the costs that fell; the costs so far are the least over the rounds, which are folded into
    one table now and then."""
    edges = links.select("u", "v", length().alias("w"))
    edges = saved(edges.union(edges.select("v", "u", "w")).groupBy("u", "v").agg(F.min("w").alias("w")), "edges")
    front = saved(links.sparkSession.createDataFrame([(source, 0.0)], "node long, cost double"), "front")
    known, rounds = front, 0
    least = lambda df: df.groupBy("node").agg(F.min("cost").alias("cost"))
    while not front.isEmpty():
        new = front.join(edges, front.node == edges.u).groupBy(F.col("v").alias("node")).agg(F.min(F.col("cost") + F.col("w")).alias("next"))
        front = saved(new.join(least(known), "node", "left").where("cost is null or next < cost - 1e-12").select(F.col("node").cast("long"), F.col("next").alias("cost")), "front")
        known, rounds = known.unionByName(front), rounds + 1
        if rounds % FOLD == 0:
            known = saved(least(known), "costs")
    cost = least(known)
    return cost if target is None else cost.where(F.col("node") == target)


def service_areas(points: DataFrame, radius: float) -> DataFrame:
    """Areas of buffers, one a point, of 64 segments."""
    a = g.UNIT_BUFFER_AREA * radius * radius
    return points.agg(F.count("*").alias("areas"), (F.count("*") * a).alias("total"), F.avg(F.lit(a)).alias("mean"), F.lit(0.0).alias("std"), F.lit(a).alias("min"), F.lit(a).alias("max"), F.expr("coalesce(try_divide(count(*), count(*)), 0e0)").alias("efficiency"))


def accessibility(facilities: DataFrame, radius: float, bounds_area: float) -> DataFrame:
    a = g.UNIT_BUFFER_AREA * radius * radius
    return facilities.agg(F.count("*").alias("facilities"), (F.count("*") * a).alias("total_area"), F.lit(a).alias("mean_area"), (F.count("*") / F.lit(float(bounds_area))).alias("density"))


def population_access(people: DataFrame, facilities: DataFrame, radius: float, weight: str | None = None) -> DataFrame:
    """People within any buffer, once each, and their share."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    p = people.select(F.col("lon").alias("px"), F.col("lat").alias("py"), w.alias("w"))
    near = band_join(p, facilities.select(F.col("lon").alias("fx"), F.col("lat").alias("fy")), radius, "px", "py", "fx", "fy", "left_semi")
    a = near.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("accessible")).join(p.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("total")))
    return a.withColumn("pct", F.coalesce(F.expr("try_divide(accessible * 100e0, total)"), F.lit(0.0)))


def service_overlap(points: DataFrame, radius: float, id_col: str = "feature_id") -> DataFrame:
    """Pairs of discs that overlap: their number, common area in sum and on average."""
    p = places(points, id_col, "lon", "lat")
    at = p.groupBy("x", "y").agg(F.count("*").alias("n"))
    met = band_join(at, at.toDF("x2", "y2", "n2"), 2 * radius, "x", "y", "x2", "y2")
    # points of one place have the same overlaps: places meet, and pairs of the same id are taken off
    lens = lambda df, sign: df.withColumn("a", g.lens_area(F.col("d"), radius)).where("a > 0").select("a", (F.col("n") * F.col("n2") * sign).alias("k"))
    pairs = lens(met, 1).unionByName(lens(same_id(p, 2 * radius), -1)).agg(F.coalesce(F.sum(F.col("a") * F.col("k")) / 2, F.lit(0.0)).alias("total"), F.expr("coalesce(sum(k) div 2, 0L)").alias("pairs"))
    total = F.when(F.col("pairs") > 0, F.col("total")).otherwise(0.0)
    return pairs.select(total.alias("total"), "pairs", F.coalesce(F.expr("try_divide(total, pairs)"), F.lit(0.0)).alias("mean"))


def travel_times(links: DataFrame, speed: str | None = "speed_limit", congestion: float = 1.0) -> DataFrame:
    """(link_id, time): length over speed times the factor; 30 km/h if there is no speed; 0 if it is not positive."""
    s = (F.coalesce(F.col(speed), F.lit(30.0)) if speed else F.lit(30.0)) * congestion / 3.6
    return links.select("link_id", F.when(s > 0, length() / F.when(s > 0, s)).otherwise(0.0).alias("time"))


def travel_time(times: DataFrame) -> DataFrame:
    return times.agg(F.sum("time").alias("total"), F.avg("time").alias("mean"), F.stddev_samp("time").alias("std"), F.min("time").alias("min"), F.max("time").alias("max"))


def travel_time_dist(times: DataFrame) -> DataFrame:
    return times.agg(*[stats.quantile("time", p).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75, 0.9)], F.skewness("time").alias("skewness"), F.kurtosis("time").alias("kurtosis"))


def congestion(links: DataFrame, speed: str = "speed_limit") -> DataFrame:
    """Links slower than the first quartile, beside the mean speed and its deviation."""
    a = links.agg(F.avg(speed).alias("mean"), F.stddev_samp(speed).alias("std"), stats.quantile(speed, 0.25).alias("limit"))
    return links.join(F.broadcast(a)).where(F.col(speed) < F.col("limit")).select("link_id", speed, "mean", "std")


def adjacency(links: DataFrame) -> DataFrame:
    e = links.select("u", "v")
    return e.union(links.select("v", "u")).distinct()


def degree_centrality(links: DataFrame) -> DataFrame:
    return adjacency(links).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("score"))


def key_nodes(scores: DataFrame, k: int = 10) -> DataFrame:
    return scores.orderBy(F.desc("score"), "node").limit(k)


def components(links: DataFrame) -> DataFrame:
    e = adjacency(links)
    return _components(e.select(F.col("u").cast("long").alias("a"), F.col("v").cast("long").alias("b")), e.select(F.col("u").cast("long").alias("node")))


def vulnerability(links: DataFrame) -> DataFrame:
    s = components(links).groupBy("component").agg(F.count("*").alias("size"))
    return s.agg(F.count("*").alias("components"), F.max("size").alias("largest")).withColumn("vulnerability", F.when(F.col("components") == 1, "high").otherwise("low"))


def _layers(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The edges, and by hops (source, node, paths): breadth-first layers from all nodes at once, each written once.

    Neighbours of a layer that are not in the next one are in it or in the one before, so those two are all that
    a layer is checked against."""
    e = saved(adjacency(links).where("u != v").select(F.col("u").cast("long"), F.col("v").cast("long")), "edges")
    layers = [saved(adjacency(links).select(F.col("u").cast("long").alias("source"), F.col("u").cast("long").alias("node"), F.lit(1.0).alias("paths")).distinct(), "layer")]
    while True:
        new = layers[-1].join(e, F.col("node") == F.col("u")).groupBy("source", F.col("v").alias("node")).agg(F.sum("paths").alias("paths"))
        for seen in layers[-2:]:
            new = new.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        new = saved(new, "layer")
        if new.isEmpty():
            return e, layers
        layers.append(new)


class Reach:
    """Breadth-first layers from blocks of sources, a bit a source, over packed neighbours.

    Nodes are numbered by falling degree; neighbours of node i are those from start[i] to start[i + 1]."""

    TILE, HUB = 2048, 4096  # nodes whose neighbours are gone through in step; of more neighbours: one by one

    def __init__(self, start: np.ndarray, neighbours: np.ndarray):
        self.start, self.neighbours, self.degree = start, neighbours, np.diff(start)
        self.n = len(self.degree)
        #: 64-bit words a node: three tables of them are held
        self.words = max(1, min(16, (1 << 24) // max(1, self.n)))
        self.blocks = -(-self.n // (64 * self.words))

    def _few(self, front: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the neighbours of a few nodes get: they are sought from the nodes."""
        k = self.degree[front]
        arcs = np.repeat(self.start[front] - np.cumsum(k) + k, k) + np.arange(k.sum())
        order = np.argsort(self.neighbours[arcs], kind="stable")
        to, first = np.unique(self.neighbours[arcs][order], return_index=True)
        return to, np.bitwise_or.reduceat(bits[np.repeat(np.arange(len(front)), k)[order]], first, axis=0)

    def _many(self, rows: np.ndarray, table: np.ndarray) -> np.ndarray:
        """What rows, in rising order, get from their neighbours."""
        out = np.zeros((len(rows), self.words), np.uint64)
        hubs = int(np.searchsorted(-self.degree[rows], -self.HUB))
        for i, r in enumerate(rows[:hubs].tolist()):
            for a in range(self.start[r], self.start[r + 1], self.HUB):
                out[i] |= np.bitwise_or.reduce(table[self.neighbours[a : min(a + self.HUB, self.start[r + 1])]], axis=0)
        got = np.empty((self.TILE, self.words), np.uint64)
        for a in range(hubs, len(rows), self.TILE):
            some = rows[a : a + self.TILE]
            at, k = self.start[some], self.degree[some]
            more = np.searchsorted(-k, -np.arange(k[0]))  # how many have an i-th neighbour
            for i, c in enumerate(more.tolist()):
                np.take(table, self.neighbours[at[:c] + i], axis=0, out=got[:c], mode="clip")
                out[a : a + c] |= got[:c]
        return out

    def layers(self, block: int):
        """(hops, nodes, bits): the nodes that sources of the block reach first by so many hops."""
        front = np.arange(block * 64 * self.words, min(self.n, (block + 1) * 64 * self.words))
        i = np.arange(len(front))
        bits = np.zeros((len(front), self.words), np.uint64)
        bits[i, i // 64] = np.uint64(1) << (i % 64).astype(np.uint64)
        all_ = np.bitwise_or.reduce(bits, axis=0)
        seen, table = np.zeros((self.n, self.words), np.uint64), np.zeros((self.n, self.words), np.uint64)
        seen[front] = bits
        left, hops = np.arange(self.n), 0
        while len(front):
            hops += 1
            if self.degree[front].sum() * 8 < self.start[-1]:
                rows, got = self._few(front, bits)
            else:
                left = left[(seen[left] != all_).any(axis=1)]
                table[front] = bits
                rows, got = left, self._many(left, table)
                table[front] = 0
            got &= ~seen[rows]
            new = got.any(axis=1)
            front, bits = rows[new], got[new]
            seen[front] |= bits
            if len(front):
                yield hops, front, bits


def _packed(links: DataFrame) -> tuple[DataFrame, Reach] | None:
    """(node, number) and the packed neighbours of all nodes with a link to another; None if there are too many."""
    e = saved(adjacency(links).where("u != v").select(F.col("u").cast("long"), F.col("v").cast("long")), "edges")
    if e.count() > MOST_ARCS:
        return None
    known = numbered(e.groupBy(F.col("u").alias("node")).agg((-F.count("*")).alias("less")), ["less", "node"], "number")
    known = saved(known.select("node", F.col("number").cast("int").alias("number")), "numbers")
    of = lambda end: known.select(F.col("node").alias(end), F.col("number").alias(f"n{end}"))
    lists = e.join(of("u"), "u").join(of("v"), "v").groupBy("nu").agg(F.collect_list("nv").alias("to"))
    to = saved(lists, "neighbours").orderBy("nu").select("to").toArrow().column("to")
    start, neighbours = np.zeros(len(to) + 1, np.int64), np.empty(e.count(), np.int32)
    at = 0
    for x in to.chunks:
        start[at + 1 : at + 1 + len(x)] = start[at] + np.cumsum(x.value_lengths().to_numpy())
        neighbours[start[at] : start[at + len(x)]] = x.flatten().to_numpy()
        at += len(x)
    return known, Reach(start, neighbours)


def _hops(known: DataFrame, reach: Reach) -> DataFrame:
    """(node, n, hops): from so many others so many hops in all. As links have no direction, what reaches a node is what it reaches."""
    spark = known.sparkSession
    sent = spark.sparkContext.broadcast((reach.start, reach.neighbours))

    def run(batches):
        own = Reach(*sent.value)
        n, hops = np.zeros(own.n, np.int64), np.zeros(own.n, np.int64)
        for b in batches:
            for block in b.column(0).to_pylist():
                for h, nodes, bits in own.layers(block):
                    k = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
                    n[nodes] += k
                    hops[nodes] += h * k
        at = np.flatnonzero(n)
        for a in range(0, len(at), 1 << 16):
            some = at[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(hops[some])], ["number", "n", "hops"])

    tasks = max(1, min(reach.blocks, 4 * spark.sparkContext.defaultParallelism))
    found = spark.range(0, reach.blocks, 1, tasks).mapInArrow(run, "number int, n long, hops long")
    return found.join(known, "number").groupBy("node").agg(F.sum("n").alias("n"), F.sum("hops").alias("hops"))


def closeness_std(links: DataFrame) -> DataFrame:
    """(node, score): reached nodes over the sum of hops to them.

    Up to ``MOST_ARCS`` the neighbours go to all tasks, each of which takes blocks of sources; beyond, layers are joined."""
    if packed := _packed(links):
        return _hops(*packed).select("node", (F.col("n") / F.col("hops")).alias("score"))
    _, layers = _layers(links)
    sums = [x.groupBy("source").agg(F.count("*").alias("n")).withColumn("hops", F.lit(h)) for h, x in enumerate(layers) if h]
    if not sums:
        return layers[0].limit(0).select("node", F.lit(0.0).alias("score"))
    d = sums[0]
    for x in sums[1:]:
        d = d.unionByName(x)
    return d.groupBy(F.col("source").alias("node")).agg((F.sum("n") / F.sum(F.col("n") * F.col("hops"))).alias("score"))


def betweenness_std(links: DataFrame) -> DataFrame:
    """(node, score): shortest paths through a node, over unordered pairs.

    Each node's share of the paths from a source is added up from the last layer to the first: what a node hands to
    one before it is the quotient of their path counts times one and its own share. Nodes between no two are not there."""
    e, layers = _layers(links)
    shares: list[DataFrame] = []
    later = None  # (source, node, paths, share) of the layer after
    for h in range(len(layers) - 1, 0, -1):
        own = layers[h]
        if later is None:
            later = own.withColumn("share", F.lit(0.0))
            continue
        handed = later.join(e, F.col("node") == F.col("u")).select("source", F.col("v").alias("node"), ((1 + F.col("share")) / F.col("paths")).alias("part"))
        got = handed.groupBy("source", "node").agg(F.sum("part").alias("part"))
        later = saved(own.join(got, ["source", "node"], "left").select("source", "node", "paths", F.coalesce(F.col("paths") * F.col("part"), F.lit(0.0)).alias("share")), "shares")
        shares.append(later.where("share > 0").groupBy("node").agg(F.sum("share").alias("share")))
    if not shares:
        return layers[0].limit(0).select("node", F.lit(0.0).alias("score"))
    out = shares[0]
    for x in shares[1:]:
        out = out.unionByName(x)
    return out.groupBy("node").agg((F.sum("share") / 2).alias("score"))


def centrality(links: DataFrame, kind: str = "degree") -> DataFrame:
    kinds = {"degree": degree_centrality, "closeness": closeness_std, "betweenness": betweenness_std}
    if kind not in kinds:
        return degree_centrality(links).limit(0)
    return kinds[kind](links)


assert math.isclose(g.UNIT_BUFFER_AREA, 32 * math.sin(math.pi / 32))
