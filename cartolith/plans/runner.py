"""Running families of analyses, with a status each, a report and exports."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.operators import network, population, spatial_stats, temporal, terrain, weather
from cartolith.operators.spatial_query import detect_column

# fixed values: keywords by which columns are found
KEYWORDS = {"time": ["time", "date", "timestamp"], "elevation": ["elevation", "height", "dem", "altitude"], "weather": ["temperature", "precipitation", "wind"], "population": ["population", "pop", "density"], "age": ["age"]}
NUMERIC = ("double", "float", "int", "bigint", "boolean")
METRICS = "analysis_type string, metric string, value double"


def metrics(results: dict[str, DataFrame]) -> DataFrame:
    """(analysis_type, metric, value): the numbers of one-row results, each unpivoted."""
    out = None
    for name, df in results.items():
        numeric = [c for c, t in df.dtypes if t in NUMERIC]
        cells = F.array(*[F.struct(F.lit(name).alias("analysis_type"), F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in numeric])
        one = df.select(F.inline(cells))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("nothing to export")
    return out


def summary(spark: SparkSession, statuses: dict[str, str | None]) -> DataFrame:
    """Families in all, without and with an error."""
    s = spark.createDataFrame(list(statuses.items()), "family string, error string")
    return s.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


class AnalysisManager:
    """Families over one table. Results are lazy DataFrames; a family that cannot be planned has an error instead."""

    FAMILIES = ("spatial", "temporal", "elevation", "weather", "population", "transport")

    def __init__(self, df: DataFrame, id_col: str = "feature_id", x: str = "lon", y: str = "lat"):
        self.df, self.id, self.x, self.y = df, id_col, x, y
        self.results: dict[str, dict[str, DataFrame]] = {}
        self.errors: dict[str, str | None] = {}
        self.history: list[dict] = []

    def _numeric(self) -> str | None:
        return next((c for c, t in self.df.dtypes if t in ("double", "float", "int", "bigint") and c not in (self.id, self.x, self.y)), None)

    def _need(self, what: str) -> str:
        c = detect_column([c for c in self.df.columns if c not in (self.id, self.x, self.y)], KEYWORDS[what])
        if c is None:
            raise ValueError(f"no {what} column")
        return c

    def _spatial(self, p: dict) -> dict[str, DataFrame]:
        df, at = self.df, {"x": self.x, "y": self.y}
        out = {"density": spatial_stats.density_stats(spatial_stats.kernel_density(df, p.get("cell", 10.0), None, **at)), "nearest_neighbor": spatial_stats.nearest_neighbor(df, self.id, **at)}
        sizes = spatial_stats.spatial_kmeans(df, p.get("clusters", 5), **at)
        out["clustering"] = sizes.agg(F.count("*").alias("clusters"), F.max("size").alias("largest"), F.min("size").alias("smallest"))
        if c := p.get("numeric") or self._numeric():
            out["morans_i"] = spatial_stats.morans_i(df, c, p.get("radius", 10.0), self.id, **at)
            out["hot_spots"] = spatial_stats.hot_spot_summary(spatial_stats.hot_spots(df, c, p.get("radius", 10.0), self.id, **at))
        return out

    def _temporal(self, p: dict) -> dict[str, DataFrame]:
        t, v = p.get("time") or self._need("time"), p.get("numeric") or self._numeric()
        if v is None:
            raise ValueError("no numeric column")
        return {"statistics": temporal.ts_stats(self.df, t, v).drop("start", "end"), "trend": temporal.trend(self.df, t, v, self.id), "mann_kendall": temporal.mann_kendall(self.df, t, v, self.id)}

    def _elevation(self, p: dict) -> dict[str, DataFrame]:
        if not {"r", "c", "elev"} <= set(self.df.columns):
            raise ValueError("a grid of r, c, elev is required")
        return {"statistics": terrain.dem_stats(self.df), "roughness": terrain.roughness_stats(self.df)}

    def _weather(self, p: dict) -> dict[str, DataFrame]:
        out: dict[str, DataFrame] = {}
        columns = [c for c in self.df.columns if any(k in c.lower() for k in KEYWORDS["weather"])]
        for c in columns:
            if "temp" in c.lower():
                out["temperature"] = weather.temp_stats(self.df, c)
            elif "precip" in c.lower():
                out["precipitation"] = weather.precip_stats(self.df, c)
            elif "speed" in c.lower():
                out["wind"] = weather.wind_stats(self.df, c)
        if not out:
            raise ValueError("no weather column")
        return out

    def _population(self, p: dict) -> dict[str, DataFrame]:
        c = p.get("numeric") or self._need("population")
        out = {"statistics": population.summary(self.df, c), "clustering": population.population_clustering(self.df, c, self.id, self.x, self.y)}
        age = detect_column(self.df.columns, KEYWORDS["age"])
        if age and dict(self.df.dtypes)[age] in ("double", "float", "int", "bigint"):
            out["age"] = population.age_stats(self.df, age)
        return out

    def _transport(self, p: dict) -> dict[str, DataFrame]:
        if not {"ux", "uy", "vx", "vy"} <= set(self.df.columns):
            raise ValueError("links with ux, uy, vx, vy are required")
        return {"links": network.link_stats(self.df), "connectivity": network.connectivity(self.df), "topology": network.topology(self.df)}

    def run(self, families: list[str] | None = None, params: dict | None = None) -> DataFrame:
        """Run the families; gives their metrics as one long table."""
        for name in families or self.FAMILIES:
            f: Callable[[dict], dict[str, DataFrame]] | None = getattr(self, f"_{name}", None) if name in self.FAMILIES else None
            try:
                if f is None:
                    raise ValueError(f"unknown family {name}")
                self.results[name], self.errors[name] = f(params or {}), None
            except (ValueError, PySparkException) as e:
                self.results.setdefault(name, {})
                self.errors[name] = str(e)
        self.history.append({"time": datetime.datetime.now(datetime.UTC), "families": list(families or self.FAMILIES)})
        return self.all_metrics()

    def _flat(self) -> dict[str, DataFrame]:
        return {f"{n}_{k}": d for n, ds in self.results.items() for k, d in ds.items()}

    def all_metrics(self) -> DataFrame:
        """The metrics of all results as one long table."""
        flat = self._flat()
        return metrics(flat) if flat else self.df.sparkSession.createDataFrame([], METRICS)

    def summary(self) -> DataFrame:
        return summary(self.df.sparkSession, self.errors)

    def report(self, family: str | None = None) -> str:
        """Text of each result: its numbers, four places, and what they are read as; and the last five runs."""
        out = []
        for name in [family] if family else list(self.results):
            out.append(name.replace("_", " ").title())
            if self.errors.get(name):
                out.append(f"  error: {self.errors[name]}")
            for k, d in self.results.get(name, {}).items():
                row = d.first()
                for c, t in d.dtypes if row else ():
                    value = row[c]
                    if t in NUMERIC:
                        out.append(f"  {k} {c.replace('_', ' ')}: {'none' if value is None else format(float(value), '.4f')}")
                    elif t == "string" and value is not None:
                        out.append(f"  {k} {c.replace('_', ' ')}: {value}")
        if not family:
            out += [f"{h['time']:%Y-%m-%d %H:%M} {', '.join(h['families'])}" for h in self.history[-5:]]
        return "\n".join(out)

    def export(self, path: str, form: str = "csv") -> bool:
        """Write the metrics; False for another format than csv or json."""
        flat = self._flat()
        if form not in ("csv", "json") or not flat:
            return False
        w = metrics(flat).write.mode("overwrite")
        (w.option("header", True).csv if form == "csv" else w.json)(path)
        return True

    def status(self) -> dict[str, int]:
        return {"runs": len(self.history), "families": len(self.results), "failed": sum(e is not None for e in self.errors.values())}

    def clear(self) -> None:
        self.results, self.errors, self.history = {}, {}, []
