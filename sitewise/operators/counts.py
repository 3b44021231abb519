"""Counts by site, chromosome, block and haplotype."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def allele_counts(calls: DataFrame, keys: Sequence[str], alleles: Sequence[str] = ("a1", "a2"), compat: bool = True) -> DataFrame:
    """AC, AN and AF of each site over the cells given; -1 or null is a missing allele.

    In ``compat`` mode AC counts every allele but the reference, missing ones too, and AN
    all haplotypes; else missing alleles count in neither. One hash aggregation with a
    map-side part.
    """
    def here(c: Column) -> Column:
        missing = c.isNull() | (c < 0)
        return F.when(missing, 1 if compat else 0).when(c == 0, 0).otherwise(1)

    def seen(c: Column) -> Column:
        return F.lit(1) if compat else F.when(c.isNull() | (c < 0), 0).otherwise(1)

    total = lambda f: F.sum(sum((f(F.col(a)) for a in alleles), F.lit(0))).cast("bigint")
    out = calls.groupBy(*keys).agg(total(here).alias("ac"), total(seen).alias("an"))
    return out.withColumn("af", F.round(F.col("ac") / F.nullif(F.col("an"), F.lit(0)), 6))


def chrom_index(df: DataFrame, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    return df.groupBy(chrom).agg(F.count("*").alias("n"), F.min(pos).alias("min_pos"), F.max(pos).alias("max_pos"))


def zone_map(df: DataFrame, span: int = 100, chrom: str = "chrom", pos: str = "pos", end: str | None = None) -> DataFrame:
    """Count, first and last position of position blocks of width ``span``."""
    return _zones(df.withColumn("block", F.floor(F.col(pos) / span).cast("bigint")), chrom, pos, end)


def row_zone_map(df: DataFrame, rows: int = 100, chrom: str = "chrom", pos: str = "pos", end: str | None = None, width: int | None = None) -> DataFrame:
    """Count, first and last position of blocks of ``rows`` records of a chromosome, in order."""
    from .ordered import running

    df = running(df, (chrom,), (pos,), "__i", F.lit(1).cast("bigint"), width)
    return _zones(df.withColumn("block", F.floor((F.col("__i") - 1) / rows).cast("bigint")), chrom, pos, end)


def _zones(df: DataFrame, chrom: str, pos: str, end: str | None) -> DataFrame:
    return df.groupBy(chrom, "block").agg(F.count("*").alias("n"), F.min(pos).alias("first_pos"), F.max(F.coalesce(F.col(end), F.col(pos)) if end else F.col(pos)).alias("last_pos"))


def ref_only(calls: DataFrame, keys: Sequence[str], alleles: Sequence[str] = ("a1", "a2")) -> DataFrame:
    """Sites at which every allele is the reference."""
    clean = F.min(F.when(sum((F.when(F.col(a) == 0, 0).otherwise(1) for a in alleles), F.lit(0)) == 0, 1).otherwise(0))
    return calls.groupBy(*keys).agg(clean.alias("__r")).filter("__r = 1").drop("__r")


def genotype_rows(calls: DataFrame, keys: Sequence[str], sample: str = "sample_idx", alleles: Sequence[str] = ("a1", "a2")) -> DataFrame:
    """Text ``row`` of each site: its cells in sample order. Grows with the samples of one site."""
    cell = F.concat_ws(":", F.col(sample), *(F.col(a) for a in alleles))
    return calls.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(sample), cell.alias("c")))), lambda x: x["c"]), ",").alias("row"))


def duplicate_rows(rows: DataFrame, order: str = "pos", row: str = "row") -> DataFrame:
    """Sites whose genotype row another site had before: ``copy_of`` is the first such site.

    Rows meet by a digest of 128 bits, and of those whose digests are equal the rows themselves are compared.
    """
    marked = rows.withColumn("__d", F.unhex(F.md5(F.col(row).cast("binary"))))
    first = marked.groupBy("__d").agg(F.min(order).alias("__f"), F.count("*").alias("__n")).filter("__n > 1").select("__d", "__f")
    some = marked.join(first, "__d")
    firsts = some.filter(F.col(order) == F.col("__f")).select("__d", F.col(row).alias("__r"), F.col(order).alias("copy_of"))
    later = some.filter(F.col(order) > F.col("__f")).join(firsts, "__d").filter(F.col(row) == F.col("__r"))
    return later.drop("__d", "__f", "__r", row)


def near_duplicate_rows(rows: DataFrame, depth: int = 100, order: str = "pos", row: str = "row", width: int | None = None) -> DataFrame:
    """Sites whose genotype row is that of a site at most ``depth`` records before (0: of none): the nearest is ``copy_of``."""
    from pyspark.sql import Window as W

    from .ordered import running

    if not depth:
        return rows.withColumn("copy_of", F.col(order)).limit(0).drop(row)
    marked = running(rows.withColumn("__all", F.lit(0)), ("__all",), (order,), "__no", F.lit(1).cast("bigint"), width)
    marked = marked.withColumn("__d", F.unhex(F.md5(F.col(row).cast("binary"))))
    w = W.partitionBy("__d", row).orderBy("__no")
    found = marked.withColumns({"__b": F.lag("__no").over(w), "copy_of": F.lag(order).over(w)})
    return found.filter(F.col("__no") - F.col("__b") <= depth).drop("__all", "__no", "__d", "__b", row)


def hap_density(calls: DataFrame, sample: str = "sample_idx", alleles: Sequence[str] = ("a1", "a2")) -> DataFrame:
    """Non-reference alleles of each haplotype (sample and place)."""
    haps = F.explode(F.array(*(F.struct(F.lit(i).alias("hap"), F.col(a).alias("allele")) for i, a in enumerate(alleles)))).alias("h")
    return calls.select(sample, haps).groupBy(sample, "h.hap").agg(F.sum((F.col("h.allele") > 0).cast("bigint")).alias("ones"))


def field_bytes(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Text bytes of each field, and their share of all: one pass, then an unpivot of one row."""
    one = df.agg(*(F.sum(F.octet_length(F.col(f).cast("string"))).cast("bigint").alias(f) for f in fields))
    long = one.unpivot([], list(fields), "field", "bytes")
    return _share(long)


def field_ratios(df: DataFrame, fields: Sequence[str], genotypes: int | None = None) -> DataFrame:
    """By field: rows, text bytes, bytes when each distinct value is stored once beside a number for each row,
    their ratio, and bits of that for each of ``genotypes`` (rows if not given)."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields))).alias("x")).select("x.*")
    values = long.groupBy("field", "v").agg(F.count("*").alias("c"))
    one = values.groupBy("field").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.octet_length("v")).alias("raw"), F.sum(F.octet_length("v")).alias("d"), F.count("*").alias("k"))
    width = F.when(F.col("k") <= 1 << 8, 1).when(F.col("k") <= 1 << 16, 2).otherwise(4)
    one = one.withColumn("packed", F.col("d") + F.col("n") * width)
    return one.select("field", "n", "raw", "packed", F.round(F.col("raw") / F.col("packed"), 4).alias("ratio"), F.round(F.col("packed") * 8 / (F.lit(genotypes) if genotypes else F.col("n")), 4).alias("bits"))


def _share(long: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    # one row a field: the window over all of them holds as many rows as there are fields
    return long.select("field", "bytes", F.round(F.col("bytes") * 100 / F.sum("bytes").over(W.partitionBy()), 4).alias("percent"))
