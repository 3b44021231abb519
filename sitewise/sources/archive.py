"""Archives: partitioned, sorted Parquet with a mode, in place of compressed blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that a lossy archive keeps.
LOSSY = ("site_id", "chrom", "pos", "id", "ref", "alts", "qual_str")

_MODE = "__mode"


def write_archive(df: DataFrame, path: str, lossy: bool = False, per_file: int = 1_000_000) -> None:
    """Partitioned by chromosome and sorted by position, so that a range reads few row groups.

    Rows are dealt by chromosome and position range, not by chromosome alone: a large
    chromosome is written by many tasks.
    """
    mode = "lossy" if lossy else "lossless"
    if lossy:
        df = df.select(*(c for c in df.columns if c in LOSSY))
    df = df.withColumn(_MODE, F.lit(mode)).repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos")
    df.write.option("maxRecordsPerFile", per_file).partitionBy("chrom").parquet(path)


def read_archive(spark: SparkSession, path: str, lossy: bool = False) -> DataFrame:
    """The archive; a mode other than asked for raises."""
    df = spark.read.parquet(path)
    if _MODE not in df.columns:
        raise ValueError("not an archive")
    row = df.select(_MODE).first()
    if row and (row[0] == "lossy") != lossy:
        raise ValueError(f"the archive is {row[0]}")
    return df.drop(_MODE)
