"""Row predicates: position ranges, ids, quality, allele counts and frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions import genotype as g

def _whole(text: str) -> int | None:
    """A whole number, or None if the text is none."""
    digits = text.removeprefix("-")
    return int(text) if digits.isascii() and digits.isdigit() else None


def parse_range(spec: str) -> tuple[str, int | None, int | None]:
    """``chrom[:start[,end]]``, both ends inclusive; an end needs a start and must not precede it.

    What follows the last colon are positions if they are whole numbers, so that names may hold
    colons and hyphens; a bare name with a hyphen or comma is taken for a slip, and needs a colon
    at its end.
    """
    name, colon, tail = spec.rpartition(":")
    ends = [_whole(x) for x in tail.split(",")] if tail else []
    if colon and name and (not tail or (len(ends) < 3 and None not in ends)):
        chrom, start, end = name, *(ends + [None, None])[:2]
    elif spec and not set("-, ") & set(spec.rpartition(":")[2]):
        chrom, start, end = spec, None, None
    else:
        raise ValueError(f"not a range: {spec!r}")
    if end is not None and end < start:
        raise ValueError(f"the end precedes the start: {spec!r}")
    return chrom, start, end


def range_filter(df: DataFrame, spec: str, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """Rows whose position lies in the range; pushed down to the scan."""
    name, start, end = parse_range(spec)
    df = df.filter(F.col(chrom) == name)
    df = df if start is None else df.filter(F.col(pos) >= start)
    return df if end is None else df.filter(F.col(pos) <= end)


def require_chrom(df: DataFrame, spec: str, chrom: str = "chrom") -> None:
    """Raise if no row has the chromosome of the range (or span)."""
    try:
        name = parse_span(spec)[0]
    except ValueError:
        name = parse_range(spec)[0]
    if df.filter(F.col(chrom) == name).isEmpty():
        raise ValueError(f"unknown chromosome: {name}")


def block_range_filter(df: DataFrame, spec: str, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """``chrom:start-end`` on single-sample records: reversed ends are swapped; only POS counts."""
    name, a, b = parse_span(spec)
    return df.filter((F.col(chrom) == name) & F.col(pos).between(a, b))


def parse_span(spec: str) -> tuple[str, int, int]:
    """``chrom:start-end`` (or with a comma); the ends are put in order."""
    name, _, tail = spec.rpartition(":")
    ends = [_whole(x) for x in tail.replace("-", ",").split(",")]
    if not name or len(ends) != 2 or None in ends:
        raise ValueError(f"not a range: {spec!r}")
    return name, *sorted(ends)


def id_filter(df: DataFrame, spec: str, id: str = "id") -> DataFrame:
    """``ID=x``: exact match; an empty spec keeps all rows."""
    if not spec:
        return df
    if not spec.startswith("ID="):
        raise ValueError("the id filter begins with ID=")
    return df.filter(F.col(id) == spec[3:])


def qual_filter(df: DataFrame, low: float | None = None, high: float | None = None, qual: str = "qual", compat: bool = True) -> DataFrame:
    """Quality bounds, inclusive. ``compat`` compares integer parts, with ``.`` as 0; else doubles, without ``.``."""
    value: Column = g.leading_int(F.col(qual)) if compat else F.col(qual).try_cast("double")
    cut = (lambda x: int(x)) if compat else (lambda x: x)
    df = df if low is None else df.filter(value >= cut(low))
    return df if high is None else df.filter(value <= cut(high))


def count_filter(df: DataFrame, low: int = 0, high: int = 2**31 - 1, ac: str = "ac") -> DataFrame:
    return df.filter(F.col(ac).between(low, high))


def frequency_filter(df: DataFrame, low: float = 0.0, high: float = 1.0, ac: str = "ac", an: str = "an", compat: bool = True) -> DataFrame:
    """Bounds of AC / AN, inclusive; single precision in ``compat`` mode. Rows with AN 0 are dropped."""
    kind = "float" if compat else "double"
    af = (F.col(ac) / F.nullif(F.col(an), F.lit(0))).cast(kind)
    return df.filter(af.between(F.lit(low).cast(kind), F.lit(high).cast(kind)))


def biallelic_filter(df: DataFrame, alt: str = "alt") -> DataFrame:
    return df.filter(g.biallelic(F.col(alt)))


def first_records(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` records in the given order: a distributed top-n, not a full sort."""
    return df.orderBy(*order).limit(n)


def check_ploidy(df: DataFrame, ploidy: int = 2, gt: str = "gt") -> DataFrame:
    """Rows unchanged; a genotype of another width raises when it is read."""
    wrong = F.size(gt) != ploidy
    return df.withColumn(gt, F.when(wrong, F.raise_error(F.lit(f"genotype width is not {ploidy}"))).otherwise(F.col(gt)))


def sample_names(df: DataFrame, n: int, seed: int = 42, name: str = "sample_idx") -> DataFrame:
    """``n`` names chosen by a seeded hash: the same for any partitioning."""
    return df.select(name).distinct().orderBy(F.xxhash64(F.col(name), F.lit(seed)), name).limit(n)


def first_samples(df: DataFrame, n: int, name: str = "sample_idx") -> DataFrame:
    """Cells of the ``n`` samples that come first by name or number."""
    first = df.select(name).distinct().orderBy(name).limit(n)
    return df.join(first, name, "left_semi")


def random_ranges(sites: DataFrame, n: int, widths: tuple[int, ...], seed: int = 42, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """(chrom, start, end, span): ``n`` ranges of each width that begin at sites chosen by a seeded hash."""
    from pyspark.sql import Window as W

    starts = sites.select(chrom, F.col(pos).alias("start")).distinct().withColumn("span", F.explode(F.array(*map(F.lit, widths))))
    w = W.partitionBy("span").orderBy(F.xxhash64(chrom, "start", "span", F.lit(seed)), chrom, "start")
    chosen = starts.withColumn("__i", F.row_number().over(w)).filter(F.col("__i") <= n)
    return chosen.select(chrom, "start", (F.col("start") + F.col("span") - 1).alias("end"), "span")
