"""Splitting and re-joining multi-allelic sites, haplotypes and duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def split_alleles(sites: DataFrame, alt: str = "alt", gt: str | None = None) -> DataFrame:
    """One row for each ALT: ``alt_no`` from 1, ``split_alt`` and, for several ALTs, a mark.

    The first of several ALTs is written ``A,<N>``, each further one ``A,<M>``. A row that is
    split already (its second ALT is a mark) and a site without ALT (``.``) pass through.
    With ``gt`` (array of allele numbers, null missing) column ``codes`` has the code of
    each haplotype: 0 reference, 1 this ALT, 2 another ALT, ``.`` missing.
    """
    alts = F.split(alt, ",")
    done = F.get(alts, F.lit(1)).isin("<M>", "<N>")
    one = F.when(done, F.array(F.col(alt))).otherwise(alts)
    df = sites.select("*", F.posexplode(one).alias("__i", "__a"), F.size(one).alias("__n"))
    mark = F.when(F.col("__n") == 1, "").when(F.col("__i") == 0, ",<N>").otherwise(",<M>")
    df = df.withColumns({"alt_no": (F.col("__i") + 1).cast("bigint"), "split_alt": F.concat("__a", mark)})
    if gt:
        df = df.withColumn("codes", F.transform(gt, lambda x: F.when(x.isNull(), ".").when(x == 0, "0").when(x == F.col("alt_no"), "1").otherwise("2")))
    return df.drop("__i", "__a", "__n")


def merge_alleles(split: DataFrame, keys: Sequence[str], codes: str | None = None) -> DataFrame:
    """Inverse of ``split_alleles``: one row for each site, ALTs in order without marks.

    With ``codes`` the allele of a haplotype is the ``alt_no`` whose code is 1, else 0, and
    null where it is missing. Rows of one site number as many as it has ALTs.
    """
    part = [F.col("alt_no"), F.regexp_replace("split_alt", ",<[MN]>$", "").alias("a")] + ([F.col(codes).alias("c")] if codes else [])
    df = split.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*part))).alias("__p"))
    out = df.withColumn("alt", F.array_join(F.transform("__p", lambda x: x["a"]), ","))
    if codes:
        width = F.size(F.get("__p", F.lit(0))["c"])
        allele = lambda h: F.aggregate(
            "__p", F.lit(0).cast("bigint"), lambda a, x: F.when(F.get(x["c"], h) == ".", F.lit(None)).when(F.get(x["c"], h) == "1", x["alt_no"]).otherwise(a)
        )
        out = out.withColumn("gt", F.transform(F.sequence(F.lit(0), width - 1), allele))
    return out.drop("__p")


def complete_sites(split: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Split rows of sites that still have their first ALT; drops orphan ``<M>`` rows."""
    has = split.groupBy(*keys).agg(F.min("alt_no").alias("__m")).filter("__m = 1").drop("__m")
    return split.join(has, list(keys), "left_semi")


def explode_haplotypes(calls: DataFrame, sample: str = "sample_idx", alleles: Sequence[str] = ("a1", "a2")) -> DataFrame:
    """One row for each haplotype: ``hap_idx`` counts them over the samples; ``code`` is 0, 1, 2 or ``.``."""
    cells = F.array(*(F.col(a) for a in alleles))
    df = calls.select("*", F.posexplode(cells).alias("__i", "__c"))
    code = F.when(F.col("__c").isNull() | (F.col("__c") < 0), ".").when(F.col("__c") > 1, "2").otherwise(F.col("__c").cast("string"))
    return df.withColumns({"hap_idx": F.col(sample) * len(alleles) + F.col("__i"), "code": code}).drop("__i", "__c")


def number_duplicates(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Running number from 1 of the rows that share their position."""
    return df.withColumn("dup_no", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint"))


def union_files(*frames: DataFrame) -> DataFrame:
    """Records of several files one after another, with ``file_no``; missing columns are null."""
    out = None
    for i, df in enumerate(frames):
        df = df.withColumn("file_no", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out
