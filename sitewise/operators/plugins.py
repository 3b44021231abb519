"""Further site and sample tools: tags, statistics by sample, filters on neighbours, rewrites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions import genotype as g

from .ordered import neighbour, run_blocks, running


def variant_type(ref: Column, alt: Column) -> Column:
    """``ref``, ``other`` (symbolic), ``snp``, ``mnp`` or ``indel`` of one ALT."""
    same = F.length(ref) == F.length(alt)
    return F.when(alt == ".", "ref").when(alt.contains("<") | alt.contains("*"), "other").when(same & (F.length(ref) == 1), "snp").when(same, "mnp").otherwise("indel")


def each_alt(sites: DataFrame, alt: str = "alt") -> DataFrame:
    return sites.withColumn("one_alt", F.explode(F.split(alt, ",")))


def type_counts(sites: DataFrame) -> DataFrame:
    return each_alt(sites).groupBy(variant_type(F.col("ref"), F.col("one_alt")).alias("type")).agg(F.count("*").alias("n"))


def allele_lengths(sites: DataFrame) -> DataFrame:
    """Counts of REF and ALT lengths."""
    df = each_alt(sites).select(F.explode(F.array(F.struct(F.lit("ref").alias("side"), F.length("ref").alias("length")), F.struct(F.lit("alt").alias("side"), F.length("one_alt").alias("length")))).alias("x"))
    return df.groupBy("x.side", "x.length").agg(F.count("*").alias("n"))


def frequency_histogram(counts: DataFrame, bins: int = 10) -> DataFrame:
    """Sites by allele frequency bin, from 0; the last bin holds 1."""
    b = F.least(F.floor(F.col("af") * bins), F.lit(bins - 1)).cast("int")
    return counts.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def sample_statistics(calls: DataFrame, sample: str = "sample_idx") -> DataFrame:
    """By sample: cells, missing, hom-ref, het, hom-alt."""
    a1, a2 = F.col("a1"), F.col("a2")
    ok = (a1 >= 0) & (a2 >= 0)
    n = lambda c: F.sum(c.cast("bigint"))
    return calls.groupBy(sample).agg(
        F.count("*").alias("n"), n(~ok).alias("missing"), n(ok & (a1 == 0) & (a2 == 0)).alias("hom_ref"), n(ok & (a1 != a2)).alias("het"), n(ok & (a1 == a2) & (a1 > 0)).alias("hom_alt")
    )


def missing_to_ref(calls: DataFrame) -> DataFrame:
    return calls.withColumns({c: F.greatest(F.col(c), F.lit(0).cast("bigint")) for c in ("a1", "a2")})


def missing_to_major(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing alleles become the site's most frequent called allele, the least of equals; 0 if none."""
    alleles = calls.select(*keys, F.explode(F.array("a1", "a2")).alias("a")).filter("a >= 0").groupBy(*keys, "a").agg(F.count("*").alias("c"))
    major = alleles.groupBy(*keys).agg(F.max(F.struct("c", (-F.col("a")).alias("v"))).alias("m")).select(*keys, (-F.col("m.v")).alias("major"))
    df = calls.join(major, list(keys), "left")
    return df.withColumns({c: F.when(F.col(c) < 0, F.coalesce("major", F.lit(0).cast("bigint"))).otherwise(F.col(c)) for c in ("a1", "a2")}).drop("major")


def set_genotypes(calls: DataFrame, condition: str, a1: int = -1, a2: int = -1) -> DataFrame:
    """Genotypes of the rows where an SQL condition holds are replaced."""
    return calls.withColumns({c: F.when(F.expr(condition), F.lit(v).cast("bigint")).otherwise(F.col(c)) for c, v in (("a1", a1), ("a2", a2))})


def novel_alleles(calls: DataFrame, group: str, keys: Sequence[str]) -> DataFrame:
    """(keys, allele, cells): alleles that only samples for which ``group`` holds have."""
    df = calls.select(*keys, F.expr(group).alias("__g"), F.explode(F.array_distinct(F.array("a1", "a2"))).alias("allele")).filter("allele > 0")
    out = df.groupBy(*keys, "allele").agg(F.count("*").alias("cells"), F.min(F.col("__g").cast("int")).alias("__m"))
    return out.filter("__m = 1").drop("__m")


def shared_counts(calls: DataFrame, samples: Sequence[int], keys: Sequence[str], sample: str = "sample_idx") -> DataFrame:
    """Sites by the bit mask of the given samples that carry a non-reference allele."""
    bit = F.lit(0).cast("bigint")
    for i, s in enumerate(samples):
        bit = F.when(F.col(sample) == s, F.lit(1 << i).cast("bigint")).otherwise(bit)
    carry = calls.filter(F.col(sample).isin(*samples) & ((F.col("a1") > 0) | (F.col("a2") > 0)))
    return carry.groupBy(*keys).agg(F.bit_or(bit).alias("mask")).groupBy("mask").agg(F.count("*").alias("n"))


def without_overlaps(df: DataFrame, start: str = "pos", end: str = "end", by: str = "chrom", width: int | None = None) -> DataFrame:
    """Records that no earlier record of the chromosome reaches into, and that do not reach the next."""
    order = (start, end)
    df = running(df, (by,), order, "__r", F.col(end), width, most=True, before=True)
    df = neighbour(df, (by,), order, {"__n": F.col(start)}, 1, width)
    return df.filter((F.coalesce(F.col("__r"), F.lit(-1)) < F.col(start)) & (F.col("__n").isNull() | (F.col("__n") > F.col(end)))).drop("__r", "__n")


def reblock(df: DataFrame, band: Column, by: str = "chrom", pos: str = "pos", dp: str = "dp", width: int | None = None) -> DataFrame:
    """Blocks of neighbouring records in the same band: first and last position, rows, least depth."""
    rows = run_blocks(df, band, (by,), (pos,), width)
    return rows.groupBy(by, "__run").agg(F.min(pos).alias("start"), F.max(pos).alias("end_pos"), F.first("__band").alias("band"), F.count("*").alias("n"), F.min(dp).alias("min_dp")).drop("__run")


def scatter(df: DataFrame, rows: int, by: str = "chrom", pos: str = "pos", width: int | None = None) -> DataFrame:
    """Chunk number of each record: ``rows`` records of a chromosome in each."""
    df = running(df, (by,), (pos,), "__i", F.lit(1).cast("bigint"), width)
    return df.withColumn("chunk", F.floor((F.col("__i") - 1) / rows).cast("bigint")).drop("__i")


def pl_to_probabilities(pl: Column) -> Column:
    """Genotype probabilities of phred-scaled likelihoods; they add up to 1."""
    raw = F.transform(pl, lambda x: F.pow(F.lit(10.0), -x / 10.0))
    return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, y: a + y))


def hardy_weinberg(tags: DataFrame) -> DataFrame:
    """Chi-square statistic of het and hom counts against the proportions expected from AC / AN."""
    n, p = F.col("ns").cast("double"), F.col("ac") / F.nullif(F.col("an"), F.lit(0))
    hom = F.col("ac_hom") / 2.0
    parts = ((hom, n * p * p), (F.col("ac_het").cast("double"), 2 * n * p * (1 - p)), (n - hom - F.col("ac_het"), n * (1 - p) * (1 - p)))
    chi = sum((F.when(e > 0, (o - e) * (o - e) / e).otherwise(0.0) for o, e in parts), F.lit(0.0))
    return tags.withColumn("chi2", F.round(F.when(n > 0, chi), 4))


def mendelian(calls: DataFrame, trios: DataFrame, keys: Sequence[str], sample: str = "sample_idx") -> DataFrame:
    """(mother, father, child, n, bad): sites called in all three, and those no transmission explains.

    ``trios`` (mother, father, child) is broadcast if small; cells meet by site.
    """
    cell = lambda who: calls.filter("a1 >= 0 AND a2 >= 0").select(*keys, F.col(sample).alias(who), F.col("a1").alias(f"{who}1"), F.col("a2").alias(f"{who}2"))
    df = cell("child").join(trios, "child").join(cell("mother"), [*keys, "mother"]).join(cell("father"), [*keys, "father"])
    from_ = lambda a, who: (F.col(a) == F.col(f"{who}1")) | (F.col(a) == F.col(f"{who}2"))
    good = (from_("child1", "mother") & from_("child2", "father")) | (from_("child2", "mother") & from_("child1", "father"))
    return df.groupBy("mother", "father", "child").agg(F.count("*").alias("n"), F.sum((~good).cast("bigint")).alias("bad"))


def allele_balance(calls: DataFrame, sample: str = "sample_idx") -> DataFrame:
    """Mean ALT share of the depth at heterozygous cells of each sample."""
    het = calls.filter("a1 >= 0 AND a2 >= 0 AND a1 <> a2 AND ad0 + ad1 > 0")
    return het.groupBy(sample).agg(F.count("*").alias("n"), F.round(F.avg(F.col("ad1") / (F.col("ad0") + F.col("ad1"))), 6).alias("alt_share"))


def switch_points(calls: DataFrame, sample: str = "sample_idx", order: Sequence[str] = ("chrom", "pos"), width: int | None = None) -> DataFrame:
    """By sample, heterozygous cells whose phase differs from the heterozygous cell before."""
    het = calls.filter("a1 >= 0 AND a2 >= 0 AND a1 <> a2").withColumn("__side", (F.col("a1") > F.col("a2")).cast("int"))
    het = neighbour(het, (sample,), order, {"__b": F.col("__side")}, width=width)
    return het.withColumn("__s", F.when(F.col("__b").isNotNull(), (F.col("__side") != F.col("__b")).cast("bigint"))).groupBy(sample).agg(F.count("*").alias("het"), F.sum("__s").alias("switches"))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "Sequence", "Column", "DataFrame", "F", "g", "neighbour", "run_blocks", "running")]
