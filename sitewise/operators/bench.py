"""Benchmark histories: trends, alerts, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitewise.schema import BENCH

#: Alert limits in percent, and the direction that is worse.
LIMITS = {"elapsed_s": (10.0, 1), "rss_kb": (15.0, 1), "throughput_vps": (10.0, -1), "metric_a": (5.0, 1)}

_BARS = "▁▂▃▄▅▆▇█"


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """CSV history; a header that differs from the schema raises when rows are read."""
    return spark.read.csv(path, header=True, schema=BENCH, enforceSchema=False)


def unpivot_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.unpivot(list(keys), list(metrics), "metric", "value")


def trend(long: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last value of each group, the one before, and their difference in units and percent."""
    before = F.lag("value").over(W.partitionBy(*keys).orderBy(order))
    rows = long.withColumn("prev", before)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("value", "prev"), order).alias("x"), F.count("*").alias("n"))
    v, p = F.col("x.value"), F.col("x.prev")
    return last.select(*keys, "n", v.alias("last"), p.alias("prev"), F.round(v - p, 6).alias("delta"), F.round((v - p) * 100 / F.nullif(p, F.lit(0.0)), 4).alias("delta_pct"))


def alerts(trends: DataFrame, metric: str = "metric", limits=LIMITS) -> DataFrame:
    """Trends that got worse by more than their limit."""
    bad = F.lit(False)
    for name, (limit, sign) in limits.items():
        bad = bad | ((F.col(metric) == name) & (F.col("delta_pct") * sign > limit))
    return trends.filter(bad)


def compare(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of two long histories: base, new, delta, percent (null where the base is 0)."""
    j = base.withColumnRenamed("value", "base").join(new.withColumnRenamed("value", "new"), [*keys, "metric"])
    return j.withColumns({"delta": F.round(F.col("new") - F.col("base"), 6), "delta_pct": F.round((F.col("new") - F.col("base")) * 100 / F.nullif(F.col("base"), F.lit(0.0)), 4)})


def throughput(df: DataFrame, units: str, seconds: str) -> DataFrame:
    return df.withColumn("throughput", F.round(F.col(units) / F.nullif(F.col(seconds), F.lit(0.0)), 4))


def sparkline(long: DataFrame, keys: Sequence[str], order: str, n: int = 8) -> DataFrame:
    """The last ``n`` values of each group as bars of eight heights."""
    w = W.partitionBy(*keys).orderBy(F.desc(order))
    last = long.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n)
    got = last.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "value"))), lambda x: x["value"]).alias("v"))
    low, high = F.array_min("v"), F.array_max("v")
    level = lambda x: F.when(high == low, 1).otherwise(F.floor((x - low) * 7 / (high - low)) + 1).cast("int")
    return got.select(*keys, F.array_join(F.transform("v", lambda x: F.substring(F.lit(_BARS), level(x), F.lit(1))), "").alias("spark"))


def markdown(trends: DataFrame, keys: Sequence[str], title: str = "Benchmarks") -> str:
    """A report of trends as a table; one row a group, so that it fits the driver."""
    names = [*keys, "n", "last", "prev", "delta", "delta_pct"]
    shown = lambda v: "" if v is None else f"{v:g}" if isinstance(v, float) else str(v)
    rows = trends.select(*names).orderBy(*keys).collect()
    table = [f"| {' | '.join(names)} |", f"|{' --- |' * len(names)}", *(f"| {' | '.join(map(shown, r))} |" for r in rows)]
    return "\n".join([f"# {title}", "", *table, ""])


def write_report(trends: DataFrame, folder: str, keys: Sequence[str]) -> None:
    """``report.md`` and ``trend.csv`` in a local folder."""
    import csv
    from pathlib import Path

    Path(folder).mkdir(parents=True, exist_ok=True)
    (Path(folder) / "report.md").write_text(markdown(trends, keys))
    with open(Path(folder) / "trend.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(trends.columns)
        out.writerows(tuple(r) for r in trends.orderBy(*keys).collect())
