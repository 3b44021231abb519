"""Projections: samples, normal forms and rebuilt records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def requested(spark: SparkSession, names: Sequence, samples: DataFrame, name: str = "sample_idx") -> DataFrame:
    """(rank, name) of the requested samples in request order; an unknown name raises. At most as many rows as asked for come to the driver."""
    found = {r[0] for r in samples.filter(F.col(name).isin(*names)).select(name).distinct().collect()}
    if unknown := [n for n in names if n not in found]:
        raise ValueError(f"unknown samples: {unknown[:5]}")
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], schema=f"rank int, {name} {samples.schema[name].dataType.simpleString()}")


def sample_project(calls: DataFrame, asked: DataFrame, name: str = "sample_idx") -> DataFrame:
    """Calls of the requested samples with their ``rank``; a repeated request repeats them.

    The list's size is known to the planner, which broadcasts it if it is small."""
    return calls.join(asked, name)


def drop_genotypes(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def with_counts_info(df: DataFrame, ac: str = "ac", an: str = "an") -> DataFrame:
    return df.withColumn("info", F.concat(F.lit("AN="), F.col(an).cast("string"), F.lit(";AC="), F.col(ac).cast("string")))


def gt_only(df: DataFrame, a1: str = "a1", a2: str = "a2") -> DataFrame:
    """Normal form: FILTER and INFO are ``.``, FORMAT is GT, alleles are phased."""
    text = lambda c: F.when(F.col(c) < 0, ".").otherwise(F.col(c).cast("string"))
    return df.withColumns({"filter": F.lit("."), "info": F.lit("."), "format": F.lit("GT"), "gt": F.concat(text(a1), F.lit("|"), text(a2))})


def rebuild_record(df: DataFrame, keys: Sequence[str], missing: int = -1) -> DataFrame:
    """Column ``record``: ``KEY=value`` of the numeric fields that are not missing, in order."""
    part = lambda k: F.when(F.col(k).isNotNull() & (F.col(k) > missing), F.concat(F.lit(f"{k.upper()}="), F.col(k).cast("string")))
    return df.withColumn("record", F.concat_ws(";", *(part(k) for k in keys)))
