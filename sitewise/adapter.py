"""Genotype-shaped views of the star-schema tables: one cell for each (part, supplier)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Derived columns of a cell, as SQL that both engines read alike; -1 is a missing allele.
CELL = {
    "a1": "CASE WHEN q % 11 = 0 THEN -1 WHEN q % 5 = 0 THEN 1 WHEN q % 7 = 0 THEN 2 ELSE 0 END",
    "a2": "CASE WHEN q % 11 = 0 THEN -1 WHEN ln % 3 = 0 THEN 1 ELSE 0 END",
    "ad0": "CASE WHEN q % 13 = 5 THEN 0 ELSE q END",
    "ad1": "CASE WHEN ln % 3 = 0 THEN ln ELSE 0 END",
    "dp": "CASE WHEN q % 13 = 5 THEN 0 ELSE q END + CASE WHEN ln % 3 = 0 THEN ln ELSE 0 END + CASE WHEN q % 17 = 0 THEN 1 ELSE 0 END",
    "pl0": "CASE WHEN q % 10 <> 3 AND q % 9 = 0 THEN ln ELSE 0 END",
    "pl1": "CASE WHEN q % 10 = 3 THEN 0 ELSE (q * 7 + ln * 5) % 256 END",
    "pl2": "CASE WHEN q % 10 = 3 THEN 0 WHEN q % 4 = 0 THEN 15 * ((q * 7 + ln * 5) % 256) ELSE (q * 11 + ln * 13) % 999 END",
}


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (chrom, pos, sample_idx, q, ln, a1, a2, ad0, ad1, dp, pl0, pl1, pl2); unique by (pos, sample_idx)."""
    # dealt by position, so that what is counted by site needs no further exchange
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pos"), F.col("l_suppkey").alias("sample_idx"), "l_quantity", "l_linenumber").repartition("pos")
    cells = rows.groupBy("pos", "sample_idx").agg(F.min("l_quantity").cast("bigint").alias("q"), F.max("l_linenumber").cast("bigint").alias("ln"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("chrom"))
    return cells.join(part, "pos").select("chrom", "pos", "sample_idx", "q", "ln", *(F.expr(e).cast("bigint").alias(k) for k, e in CELL.items()))


#: Columns of a site made from ``part``, as SQL for both engines.
SITE = {
    "chrom": "p_brand",
    "pos": "p_partkey",
    "id": "concat('rs', CAST(p_partkey AS STRING))",
    "ref": "substring('ACGT', p_size % 4 + 1, 1)",
    "alt": "CASE WHEN p_size % 10 = 0 THEN '.' WHEN p_size % 3 = 0 THEN 'A,<N>' WHEN p_size % 3 = 1 THEN 'G' ELSE 'C,T,GA' END",
    "qual": "CASE WHEN p_size % 7 = 0 THEN '.' ELSE concat(CAST(p_partkey % 90 AS STRING), '.7') END",
}


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(*(F.expr(e).alias(k) for k, e in SITE.items()))


def _duck(sql: str) -> str:
    return sql.replace("AS STRING", "AS VARCHAR")


#: The same views for the oracle engine.
DUCK_CALLS = (
    "WITH cells AS (SELECT l_partkey AS pos, l_suppkey AS sample_idx, CAST(MIN(l_quantity) AS BIGINT) AS q, CAST(MAX(l_linenumber) AS BIGINT) AS ln FROM lineitem GROUP BY 1, 2),\n"
    "calls AS (SELECT p_brand AS chrom, pos, sample_idx, q, ln, "
    + ", ".join(f"CAST({_duck(e)} AS BIGINT) AS {k}" for k, e in CELL.items())
    + " FROM cells JOIN part ON p_partkey = pos)\n"
)
DUCK_SITES = "WITH sites AS (SELECT " + ", ".join(f"{_duck(e)} AS {k}" for k, e in SITE.items()) + " FROM part)\n"
