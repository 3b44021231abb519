"""Encodings and neighbours as ordered queries: runs, deltas, dictionaries, inferred ends.

A window over a whole chromosome, or over all sites of a sample, is one task however long it is.
With ``width`` these operators work on blocks of so many positions instead: each block is a
window of its own, and what a row needs from beyond it (the neighbour, or the sum or maximum so
far) is carried over from a table with one row for each block. The result is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitewise.functions import genotype as g

_BLOCK = "__block"


def _blocked(df: DataFrame, order: Sequence[str], width: int | None) -> DataFrame:
    """``df`` with its block: the position (the last of ``order`` that is one) by width, behind what sorts before it."""
    if width is None:
        return df.withColumn(_BLOCK, F.struct(F.lit(0).alias("at")))
    at = order[1] if len(order) > 1 and dict(df.dtypes)[order[0]] == "string" else order[0]
    before = [order[0]] if at != order[0] else []
    return df.withColumn(_BLOCK, F.struct(*before, F.floor(F.col(at) / width).alias("at")))


def _over_blocks(df: DataFrame, by: Sequence[str], edge: Column, total: Column, name: str, carry: Callable[[W], Column]) -> DataFrame:
    """``df`` with ``name``: what ``carry`` makes, over the blocks in order, of ``total`` in the one row of each block that is its ``edge``."""
    totals = df.filter(edge).select(*by, _BLOCK, total.alias("__total"))
    carried = totals.withColumn(name, carry(W.partitionBy(*by).orderBy(_BLOCK))).drop("__total")
    return df.join(carried, [*by, _BLOCK])


def neighbour(df: DataFrame, by: Sequence[str], order: Sequence[str], values: dict[str, Column], side: int = -1, width: int | None = None) -> DataFrame:
    """``df`` with columns ``values`` of the row before (``side`` -1) or after (1) in each group; null at its end."""
    df = _blocked(df, order, width).withColumn("__row", F.struct(*(c.alias(k) for k, c in values.items())))
    w = W.partitionBy(*by, _BLOCK).orderBy(*order)
    step, back = (F.lag, F.lead) if side < 0 else (F.lead, F.lag)
    if width is None:
        df = df.withColumn("__near", step("__row").over(w))
    else:
        df = df.withColumns({"__near": step("__row").over(w), "__edge": back(F.lit(1)).over(w).isNull()})
        df = _over_blocks(df, by, F.col("__edge"), F.col("__row"), "__far", lambda over: step("__total").over(over))
        df = df.withColumn("__near", F.coalesce("__near", "__far")).drop("__far", "__edge")
    return df.withColumns({k: F.col("__near")[k] for k in values}).drop("__row", "__near", _BLOCK)


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, value: Column, width: int | None = None, most: bool = False, before: bool = False) -> DataFrame:
    """``df`` with ``name``: the sum (or ``most``: the maximum) of ``value`` from the group's first row
    to this one, or to the one ``before`` it."""
    df = _blocked(df, order, width).withColumn("__value", value)
    fold = F.max if most else F.sum
    w = W.partitionBy(*by, _BLOCK).orderBy(*order)
    upto = lambda last: fold("__value").over(w.rowsBetween(W.unboundedPreceding, last))
    df = df.withColumn(name, upto(-1 if before else 0))
    if width is not None:
        df = df.withColumns({"__upto": upto(0), "__edge": F.lead(F.lit(1)).over(w).isNull()})
        df = _over_blocks(df, by, F.col("__edge"), F.col("__upto"), "__far", lambda over: fold("__total").over(over.rowsBetween(W.unboundedPreceding, -1)))
        df = df.withColumn(name, F.greatest(name, "__far") if most else F.coalesce(F.col(name) + F.col("__far"), name, "__far")).drop("__far", "__edge", "__upto")
    return df.drop("__value", _BLOCK)


def _run_starts(df: DataFrame, value: Column, by: Sequence[str], order: Sequence[str], width: int | None) -> DataFrame:
    """``df`` with ``__new``: 1 where a run of equal values begins, else 0."""
    df = neighbour(df, by, order, {"__b": value, "__one": F.lit(1)}, width=width)
    return df.withColumn("__new", F.when(F.col("__one").isNotNull() & value.eqNullSafe(F.col("__b")), 0).otherwise(1)).drop("__b", "__one")


def run_lengths(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], width: int | None = None) -> DataFrame:
    """Runs of equal neighbouring values: by, run number from 1, value and length."""
    df = running(_run_starts(df, F.col(value), by, order, width), by, order, "run", F.col("__new").cast("bigint"), width)
    return df.groupBy(*by, "run").agg(F.first(value).alias("value"), F.count("*").alias("length"))


def run_ratio(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], width: int | None = None) -> DataFrame:
    """Runs and distinct values as shares of the rows."""
    out = _run_starts(df, F.col(value), by, order, width).groupBy(*by).agg(F.count("*").alias("n"), F.sum("__new").cast("bigint").alias("runs"), F.countDistinct(value).alias("uniques"))
    return out.withColumns({"run_ratio": F.round(F.col("runs") / F.col("n"), 6), "unique_ratio": F.round(F.col("uniques") / F.col("n"), 6)})


def run_blocks(df: DataFrame, band: Column, by: Sequence[str], order: Sequence[str], width: int | None = None) -> DataFrame:
    """``df`` with ``__band`` and the number ``__run`` of the run of equal bands a row is in."""
    df = df.withColumn("__band", band)
    return running(_run_starts(df, F.col("__band"), by, order, width), by, order, "__run", F.col("__new").cast("bigint"), width).drop("__new")


def deltas(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], width: int | None = None) -> DataFrame:
    """Difference to the row before; the first row keeps its value."""
    df = neighbour(df, by, order, {"__b": F.col(value)}, width=width)
    return df.withColumn("delta", F.col(value) - F.coalesce("__b", F.lit(0))).drop("__b")


def dictionary(df: DataFrame, value: str, order: str, width: int | None = None) -> DataFrame:
    """Distinct values with a code in order of first appearance, from 0.

    The ranking runs over distinct values only, after a map-side aggregation, and with ``width``
    in blocks of the places where they first appear.
    """
    firsts = df.groupBy(value).agg(F.min(order).alias("first_at"), F.count("*").alias("n")).withColumn("__all", F.lit(0))
    return running(firsts, ("__all",), ("first_at", value), "code", F.lit(1).cast("bigint"), width).withColumn("code", F.col("code") - 1).drop("__all")


def dominant(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Most frequent value (the least of equals), its share, and the number of patches; of any type with an order."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("c"))
    most = counts.groupBy(*by).agg(F.max("c").alias("m"), F.sum("c").alias("n"))
    best = counts.join(most, list(by)).filter("c = m").groupBy(*by, "m", "n").agg(F.min(value).alias("dominant"))
    return best.select(*by, "dominant", F.round(F.col("m") / F.col("n"), 6).alias("ratio"), (F.col("n") - F.col("m")).alias("patches"))


def field_analysis(df: DataFrame, value: str) -> DataFrame:
    """Rows, distinct values, least, largest and mean (of texts: of their lengths), ratios, and the encoding they suggest."""
    counts = df.groupBy(value).agg(F.count("*").alias("c"))
    number = F.length(value) if dict(df.dtypes)[value] == "string" else F.col(value)
    one = counts.agg(
        F.sum("c").alias("total"), F.count("*").alias("uniques"), F.max("c").alias("top"), F.min(value).alias("least"), F.max(value).alias("largest"),
        F.round(F.sum(F.col("c") * number) / F.sum("c"), 6).alias("mean"),
    )
    unique, top = F.col("uniques") / F.col("total"), F.col("top") / F.col("total")
    kind = F.when(top >= 0.7, "mask").when(unique < 0.3, "dictionary").otherwise("raw")
    return one.select("total", "uniques", "least", "largest", "mean", F.round(unique, 6).alias("repetition_ratio"), F.round(top, 6).alias("dominant_ratio"), kind.alias("encoding"))


def infer_ends(df: DataFrame, by: Sequence[str], pos: str = "pos", width: int | None = None) -> DataFrame:
    """``end_pos``: one before the next position; null on the last row of a chromosome."""
    return neighbour(df, by, (pos,), {"__n": F.col(pos)}, 1, width).withColumn("end_pos", F.col("__n") - 1).drop("__n")


def end_exceptions(df: DataFrame, by: Sequence[str], pos: str = "pos", end: str = "end", width: int | None = None) -> DataFrame:
    """Rows whose end is not one before the next position, with ``diff`` = end - pos.

    A row without an end ends where it begins; the last row of a chromosome is always an exception.
    """
    last = F.coalesce(F.col(end), F.col(pos))
    df = neighbour(df, by, (pos,), {"__n": F.col(pos)}, 1, width)
    return df.filter(F.col("__n").isNull() | (last + 1 != F.col("__n"))).withColumn("diff", last - F.col(pos)).drop("__n")


def valid_deltas(cells: DataFrame, value: str, valid: str, sample: str = "sample_idx", order: Sequence[str] = ("chrom", "pos"), width: int | None = None, skip: str | None = None) -> DataFrame:
    """By sample, the difference of ``value`` to the cell before, kept only if both are valid.

    Cells for which ``skip`` holds are passed over: the cells on either side of them are neighbours."""
    cells = cells.filter(f"NOT coalesce({skip}, false)") if skip else cells
    df = neighbour(cells, (sample,), order, {"__v": F.col(value), "__ok": F.expr(valid)}, width=width)
    return df.filter(F.expr(valid) & F.col("__ok")).withColumn("delta", F.col(value) - F.col("__v")).drop("__v", "__ok")


def delta_histogram(df: DataFrame, delta: str = "delta") -> DataFrame:
    """One row: rows, zeros, signs, and cumulative counts of abs(delta) below powers of two to 4 096."""
    count = lambda c: F.sum(c.cast("bigint"))
    d = F.col(delta)
    below = [count(F.abs(d) < (1 << k)).alias(f"below_{1 << k}") for k in range(1, 13)]
    return df.agg(F.count("*").alias("n"), count(d == 0).alias("zero"), count(d > 0).alias("up"), count(d < 0).alias("down"), *below)


def adjacent_correlation(cells: DataFrame, value: str, sample: str = "sample_idx", keys: Sequence[str] = ("chrom", "pos"), width: int | None = None) -> DataFrame:
    """Pearson correlation over samples of a site's values with each sample's previous site.

    Sites where one side does not vary, or with fewer than three samples, are left out.
    """
    df = neighbour(cells, (sample,), keys, {"__b": F.col(value)}, width=width).filter("__b IS NOT NULL")
    x, y = F.col(value).cast("double"), F.col("__b").cast("double")
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("r"))
    return out.filter("n >= 3 AND sx > 0 AND sy > 0").select(*keys, "n", F.round("r", 6).alias("r"))


def fallback_costs(cells: DataFrame, a: str = "pl1", b: str = "pl2", valid: str = "pl0 = 0", ratio: int = 11, sample: str = "sample_idx", order: Sequence[str] = ("chrom", "pos"), width: int | None = None) -> DataFrame:
    """What it costs to store the pairs (a, b) of valid cells: bytes as values, as differences to the
    sample's cell before, and as a with the residual of b to ``ratio`` times a; and how many pairs of a
    difference of a and a residual fit 5, 6 and 7 bits each."""
    df = neighbour(cells.filter(valid), (sample,), order, {"__a": F.col(a), "__b": F.col(b)}, width=width)
    size = lambda x: g.varint_len(g.zigzag(x))
    x, y = F.col(a), F.col(b)
    before = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = lambda c: F.sum(c).cast("bigint")
    step, rest = x - F.coalesce("__a", x), y - ratio * x
    fits = {f"bits_{k}": total(((F.abs(step) < (1 << (k - 1))) & (F.abs(rest) < (1 << (k - 1)))).cast("int")) for k in (5, 6, 7)}
    return df.agg(
        F.count("*").alias("n"), total(size(x) + size(y)).alias("plain"), total(size(x - before("__a")) + size(y - before("__b"))).alias("delta"),
        total(size(x) + size(rest)).alias("residual"), *(c.alias(k) for k, c in fits.items()),
    )
