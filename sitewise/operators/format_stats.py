"""Statistics and consistency checks of depths (AD, DP) and likelihoods (PL, GQ)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions import genotype as g


def _count(c: Column) -> Column:
    return F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))


def _rate(c: Column) -> Column:
    return F.round(F.avg(c.cast("int")), 6)


def pl_argmin(df: DataFrame, pl: str = "pl") -> DataFrame:
    """Place of the least of three likelihoods, whether the first is 0, whether the least is 0: counts."""
    at = F.array_position(pl, F.array_min(pl)).cast("bigint") - 1
    return df.filter(F.size(pl) == 3).groupBy(at.alias("argmin"), (F.get(pl, F.lit(0)) == 0).cast("int").alias("first_zero"), (F.array_min(pl) == 0).cast("int").alias("min_zero")).agg(F.count("*").alias("n"))


def ad_classes(df: DataFrame, ref: str = "ad0", alt: str = "ad1") -> DataFrame:
    return df.groupBy(g.ad_class(F.col(ref), F.col(alt)).alias("ad_class")).agg(F.count("*").alias("n"))


def gt_ad_contingency(df: DataFrame) -> DataFrame:
    """Genotype class 0, 1, 2 against depth class, with depth agreement; alleles other than 0 and 1 are skipped."""
    cells = df.filter(F.col("a1").isin(0, 1) & F.col("a2").isin(0, 1))
    return cells.groupBy((F.col("a1") + F.col("a2")).alias("gt_class"), g.ad_class(F.col("ad0"), F.col("ad1")).alias("ad_class"), g.delta_bucket(F.col("dp") - F.col("ad0") - F.col("ad1")).alias("dp_delta")).agg(F.count("*").alias("n"))


def gt_pl_consistency(df: DataFrame, pl: str = "pl") -> DataFrame:
    """By genotype class: cells, whose own likelihood is 0, is the least, and the bucket of the least other."""
    cells = df.filter(F.col("a1").isin(0, 1) & F.col("a2").isin(0, 1)).withColumn("gt_class", F.col("a1") + F.col("a2"))
    own = F.get(pl, F.col("gt_class").cast("int"))
    other = F.array_min(F.filter(pl, lambda x, i: i != F.col("gt_class")))
    bucket = F.lit(">=8192")
    for k in range(13, 6, -1):
        bucket = F.when(other < (1 << k), F.lit(f"<{1 << k}")).otherwise(bucket)
    return cells.groupBy("gt_class", bucket.alias("other_bucket")).agg(F.count("*").alias("n"), _count(own == 0).alias("own_zero"), _count(own == F.array_min(pl)).alias("own_min"))


def distribution(df: DataFrame, value: Column, below: Column | None = None) -> DataFrame:
    """One row: rows, min, max, mean, median, population deviation, shares of 0 and of values (or of
    ``below``, over x) under 5.

    Values are counted first, so that the exact median is taken over distinct values, not over rows.
    """
    x, c = F.col("x"), F.col("c")
    counts = df.select(value.cast("double").alias("x")).groupBy("x").agg(F.count("*").alias("c"))
    one = counts.agg(
        F.sum(c).alias("n"), F.min(x).alias("least"), F.max(x).alias("largest"), F.sum(x * c).alias("s"), F.sum(x * x * c).alias("q"), F.percentile(x, 0.5, c).alias("median"),
        F.sum(F.when(x == 0, c).otherwise(0)).alias("z"), F.sum(F.when((x if below is None else below) < 5, c).otherwise(0)).alias("b"),
    )
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean))
    return one.select("n", "least", "largest", F.round(mean, 6).alias("mean"), "median", F.round(std, 6).alias("std"), F.round(F.col("z") / F.col("n"), 6).alias("zero_rate"), F.round(F.col("b") / F.col("n"), 6).alias("below5_rate"))


def top_patterns(df: DataFrame, pattern: Column, n: int = 10) -> DataFrame:
    """The ``n`` most frequent patterns with counts and percentages; ties by pattern."""
    counts = df.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__t"))
    top = counts.orderBy(F.desc("n"), "pattern").limit(n)
    return top.join(F.broadcast(total), F.lit(True)).select("pattern", "n", F.round(F.col("n") * 100 / F.col("__t"), 4).alias("percent"))  # one row on the right


def value_ranges(df: DataFrame, value: Column, bounds: Sequence[int] = (10, 50, 100, 255, 1000)) -> DataFrame:
    out = F.lit(f">={bounds[-1]}")
    for b in reversed(bounds):
        out = F.when(value < b, F.lit(f"<{b}")).otherwise(out)
    return df.groupBy(out.alias("range")).agg(F.count("*").alias("n"))


def pl_types(df: DataFrame, pl: str = "pl") -> DataFrame:
    a, b = F.get(pl, F.lit(1)), F.get(pl, F.lit(2))
    return df.groupBy(g.pl_type(F.col(pl)).alias("pl_type")).agg(F.count("*").alias("n"), F.min(a).alias("min_a"), F.max(a).alias("max_a"), F.min(b).alias("min_b"), F.max(b).alias("max_b"))


def agreement_rates(df: DataFrame, pl: str = "pl") -> DataFrame:
    """Share of cells with DP = sum AD, and with GQ equal to each of the definitions from PL."""
    p = F.col(pl)
    return df.agg(
        F.count("*").alias("n"), _rate(F.col("dp") == F.col("ad0") + F.col("ad1")).alias("dp_is_sum"),
        _rate(F.coalesce(F.col("gq") == g.second_min_distinct(p), F.lit(False))).alias("gq_distinct"), _rate(F.col("gq") == g.second_min(p)).alias("gq_second"),
        _rate(F.col("gq") == g.gq_from_pl(p)).alias("gq_gap"),
    )


def het_ratio(df: DataFrame, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """Reference share of the depth among cells with both depths: how many look heterozygous."""
    both = df.filter((F.col("ad0") > 0) & (F.col("ad1") > 0)).groupBy((F.col("ad0") / (F.col("ad0") + F.col("ad1"))).alias("r")).agg(F.count("*").alias("c"))
    return both.agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("r").between(low, high), F.col("c")).otherwise(0)).alias("het_like"),
        F.round(F.sum(F.col("r") * F.col("c")) / F.sum("c"), 6).alias("mean"), F.round(F.percentile("r", 0.5, F.col("c")), 6).alias("median"),
    )


def fallback_reasons(df: DataFrame, pl: str = "pl") -> DataFrame:
    """Why likelihoods are of no pattern (class 3): counts of reasons."""
    p = F.col(pl)
    reason = F.when(F.size(p) == 0, "empty").when(F.get(p, F.lit(0)) != 0, "first not 0").when(F.size(p) < 3, "too short").otherwise("mismatch")
    return df.filter(g.pl_type(p) == 3).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def best_ratio(df: DataFrame, ratios: Sequence[int], a: str = "pl1", b: str = "pl2", within: int = 7) -> DataFrame:
    """For each ratio r, cells with abs(b - r a) <= within: one pass, no join, an unpivot of one row."""
    cells = df.filter(f"{a} > 0")
    one = cells.agg(*(_count(F.abs(F.col(b) - r * F.col(a)) <= within).alias(str(r)) for r in ratios))
    return one.unpivot([], [str(r) for r in ratios], "ratio", "covered").withColumn("ratio", F.col("ratio").cast("int"))


def codec_cost(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Bytes of each field as zigzag varints, as plain varints, in fixed 1, 2 or 4 bytes, and as text; and the cheapest."""
    fixed = lambda c: F.when(F.max(F.abs(c)) < 1 << 7, 1).when(F.max(F.abs(c)) < 1 << 15, 2).otherwise(4) * F.count(c)
    kinds = {
        "fixed": fixed, "text": lambda c: F.sum(F.length(c.cast("string")) + 1), "varint": lambda c: F.sum(g.varint_len(F.abs(c))),
        "zigzag": lambda c: F.sum(g.varint_len(g.zigzag(c))),
    }
    one = df.agg(*(F.struct(*(make(F.col(f)).cast("bigint").alias(k) for k, make in kinds.items())).alias(f) for f in fields))
    long = one.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("b")) for f in fields))).alias("x")).select("x.field", "x.b.*")
    cheapest = F.array_min(F.array(*(F.struct(F.col(k).alias("b"), F.lit(k).alias("k")) for k in kinds)))["k"]
    return long.withColumn("best", cheapest)


def pl_codecs(cells: DataFrame, ratios: Sequence[int] = (10, 11, 12), a: str = "pl1", b: str = "pl2", sample: str = "sample_idx", order: Sequence[str] = ("chrom", "pos"), width: int | None = None) -> DataFrame:
    """Bytes of the pairs (a, b) under each codec: as they are, with the residual of b to a fixed multiple
    of the sample's a, to the best of the multiples (a byte says which), and with differences of both.

    Cells whose first likelihood is not 0, or both others are 0, or b = 15 a, are left out."""
    from .ordered import neighbour

    x, y = F.col(a), F.col(b)
    kept = cells.filter("pl0 = 0").filter(((x != 0) | (y != 0)) & ~((x > 0) & (y == 15 * x)))
    df = neighbour(kept, (sample,), order, {"__a": x, "__b": y}, width=width)
    size = lambda c: g.varint_len(g.zigzag(c))
    step = size(x - F.coalesce("__a", F.lit(0)))
    codecs = {"baseline": size(x) + size(y), **{f"ratio_{r}": step + size(y - r * x) for r in ratios}}
    codecs["adaptive"] = step + 1 + F.least(*(size(y - r * x) for r in ratios))
    codecs["joint_delta"] = step + size(y - F.coalesce("__b", F.lit(0)))
    one = df.agg(*(F.sum(c).cast("bigint").alias(k) for k, c in codecs.items()))
    return one.unpivot([], list(codecs), "codec", "bytes")


def coverage(df: DataFrame, thresholds: Sequence[int] = (63, 127), a: str = "pl1", b: str = "pl2", ratios: Sequence[int] = (10, 11, 12, 15)) -> DataFrame:
    """Cells whose residual to the best of several ratios fits each threshold."""
    rest = F.least(*(F.abs(F.col(b) - r * F.col(a)) for r in ratios))
    one = df.filter(f"{a} > 0").agg(F.count("*").alias("n"), *(_count(rest <= t).alias(f"within_{t}") for t in thresholds))
    return one


def entropy(df: DataFrame, value: Column) -> DataFrame:
    """Shannon entropy of a column in bits, from its value counts."""
    counts = df.groupBy(value.alias("v")).agg(F.count("*").alias("c"))
    one = counts.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return one.select("n", F.round(F.log2("n") - F.col("s") / F.col("n"), 6).alias("bits"))


def sparse(df: DataFrame, *fields: str) -> DataFrame:
    """Rows in which some of the fields are present and not ``.``."""
    some = F.lit(False)
    for f in fields:
        some = some | F.coalesce(F.col(f) != ".", F.lit(False))
    return df.filter(some)


def prediction_exceptions(df: DataFrame, predicted: Column, actual: str, keys: Sequence[str]) -> DataFrame:
    """Cells whose value is not the predicted one, with the difference; a cell without either is none."""
    return df.withColumn("difference", F.col(actual) - predicted).filter("difference <> 0").select(*keys, actual, "difference")


def argmin_mismatches(df: DataFrame, pl: str = "pl") -> DataFrame:
    """Cells whose own genotype has not the least likelihood, by genotype class and the place that has, with the largest value."""
    cells = df.filter(F.col("a1").isin(0, 1) & F.col("a2").isin(0, 1)).withColumn("gt_class", F.col("a1") + F.col("a2"))
    at = F.array_position(pl, F.array_min(pl)).cast("bigint") - 1
    own = F.get(pl, F.col("gt_class").cast("int"))
    return cells.filter(own != F.array_min(pl)).groupBy("gt_class", at.alias("argmin")).agg(F.count("*").alias("n"), F.max(F.array_max(pl)).alias("largest"))


def depth_tips(df: DataFrame, ad: str = "ad") -> DataFrame:
    """Depths of any length by which are zero: all, all but the reference, the reference alone, or neither.

    Classes are 00, 01 (reference only), 10 (an alternate only) and 11, with cells, depths and the mean number of alleles."""
    ref, rest = F.get(ad, F.lit(0)), F.aggregate(F.slice(ad, F.lit(2), F.greatest(F.size(ad), F.lit(0))), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    tip = F.when((ref == 0) & (rest == 0), "00").when(rest == 0, "01").when(ref == 0, "10").otherwise("11")
    return df.filter(F.size(ad) > 1).groupBy(tip.alias("tip")).agg(F.count("*").alias("n"), F.sum(ref).alias("ref_depth"), F.sum(rest).alias("alt_depth"), F.round(F.avg(F.size(ad)), 4).alias("alleles"))


def pattern_lengths(df: DataFrame, values: str) -> DataFrame:
    """(length, n, patterns): cells and distinct arrays by array length."""
    counts = df.groupBy(F.size(values).cast("bigint").alias("length"), F.array_join(F.col(values).cast("array<string>"), ",").alias("p")).agg(F.count("*").alias("c"))
    return counts.groupBy("length").agg(F.sum("c").alias("n"), F.count("*").alias("patterns"))


def value_shares(df: DataFrame, value: Column) -> DataFrame:
    """One row: values, and the percentages that are 0 and that are the largest."""
    counts = df.groupBy(value.alias("x")).agg(F.count("*").alias("c"))
    one = counts.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x") == 0, F.col("c")).otherwise(0)).alias("z"), F.max_by("c", "x").alias("m"), F.max("x").alias("largest"))
    return one.select("n", "largest", F.round(F.col("z") * 100 / F.col("n"), 4).alias("zero_percent"), F.round(F.col("m") * 100 / F.col("n"), 4).alias("largest_percent"))


def ratio_histogram(df: DataFrame, a: str = "pl1", b: str = "pl2", most: int = 30) -> DataFrame:
    """(ratio, n, mean_a): cells with a > 0 by the whole part of b / a, cut at ``most``."""
    r = F.least(F.floor(F.col(b) / F.col(a)).cast("bigint"), F.lit(most))
    return df.filter(f"{a} > 0").groupBy(r.alias("ratio")).agg(F.count("*").alias("n"), F.round(F.avg(a), 6).alias("mean_a"))


def best_of(covered: DataFrame) -> DataFrame:
    """The ratio that covers most cells (the least of equals) of a table (ratio, covered)."""
    return covered.agg(F.max_by("ratio", F.struct("covered", -F.col("ratio"))).alias("ratio"), F.max("covered").alias("covered"))
