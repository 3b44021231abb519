"""Hashes of files and of call sets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.functions import genotype as g


def file_hashes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, size, xxh3): the 64-bit XXH3 hash of each file, as 16 hex digits."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([xxhash.xxh3_64_hexdigest(x) for x in b.column(2).to_pylist()])], names=["path", "size", "xxh3"])

    return spark.read.format("binaryFile").load(list(paths)).select("path", F.col("length").alias("size"), "content").mapInArrow(run, "path string, size long, xxh3 string")


def record_hashes(lines: DataFrame) -> DataFrame:
    """(site_id, hash) of text records: INFO entries and FORMAT keys carry no order, short cells are filled up."""
    f = F.split("line", "\t")
    cells = F.slice(f, F.lit(10), F.greatest(F.size(f) - 9, F.lit(0)))
    canon = g.canonical_format(F.coalesce(F.get(f, F.lit(8)), F.lit(".")), cells)
    info = F.array_join(F.array_sort(F.filter(F.split(F.get(f, F.lit(7)), ";"), lambda x: x != "")), ";")
    text = F.concat_ws("\t", F.slice(f, F.lit(1), F.lit(7)), F.when(info == "", ".").otherwise(info), F.when(F.size(f) > 8, F.concat_ws("\t", F.array(canon["keys"]), canon["cells"])))
    return lines.select("site_id", F.sha2(g.canonical_exponent(text), 256).alias("hash"))


def set_hash(lines: DataFrame) -> str:
    """One hash of all records of a call set, whatever their order: the sum of the record hashes' first 15 digits."""
    row = record_hashes(lines).agg(F.sum(F.conv(F.substring("hash", 1, 15), 16, 10).cast("decimal(38,0)")), F.count("*")).first()
    return f"{int(row[0] or 0):x}-{row[1]}"
