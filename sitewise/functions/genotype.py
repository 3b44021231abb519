"""Scalar functions on genotype, depth and likelihood columns, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leading_int(text: Column) -> Column:
    """The integer that a text begins with, else 0 (``29.7`` -> 29, ``.`` -> 0)."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0))


def sum_ad(ad: Column) -> Column:
    """Sum of allele depths; null if any is missing."""
    return F.aggregate(ad, F.lit(0).cast("bigint"), lambda a, x: a + x)


def pl_count(alleles: Column) -> Column:
    return (alleles * (alleles + 1) / 2).cast("int")


def pl_alleles(pl: Column) -> Column:
    """Number of alleles whose genotypes a likelihood array lists."""
    return ((F.sqrt(1 + 8 * F.size(pl).cast("double")) - 1) / 2).cast("int")


def pl_rebuild(a: Column, b: Column, alleles: Column) -> Column:
    """The patterned array of (a, b): 0 first, a for (0, j), b for (i, j) with i > 0; diagonal entries are b."""
    cell = lambda i, j: F.when(i == 0, F.lit(0)).when(j == 0, a).otherwise(b)
    return F.flatten(F.transform(F.sequence(F.lit(0), alleles - 1), lambda i: F.transform(F.sequence(F.lit(0), i), lambda j: cell(i, j))))


def pl_type(pl: Column) -> Column:
    """0: all zero; 1, 2: patterned from its second and third value (2 if b = 15 a); 3: neither.

    Arrays shorter than 3, or of a length that no allele number has, are type 3.
    """
    n, a, b = pl_alleles(pl), F.get(pl, F.lit(1)), F.get(pl, F.lit(2))
    odd = (F.size(pl) < 3) | (pl_count(n) != F.size(pl)) | (F.get(pl, F.lit(0)) != 0)
    patterned = F.forall(F.arrays_zip(pl.alias("x"), pl_rebuild(a, b, n).alias("y")), lambda z: z["x"] == z["y"])
    return F.when(odd, 3).when(F.forall(pl, lambda x: x == 0), 0).when(~patterned, 3).when(b == 15 * a, 2).otherwise(1)


def second_min_distinct(pl: Column) -> Column:
    """The least value above the minimum; null if there is none."""
    return F.get(F.array_sort(F.array_distinct(pl)), F.lit(1))


def second_min(pl: Column) -> Column:
    """The second value in ascending order, repeats counted."""
    return F.get(F.array_sort(pl), F.lit(1))


def gq_from_pl(pl: Column) -> Column:
    """Gap between the two least values; 0 for fewer than two."""
    s = F.array_sort(pl)
    return F.when(F.size(pl) < 2, F.lit(0)).otherwise(F.get(s, F.lit(1)) - F.get(s, F.lit(0)))


def gq_predict(pl: Column) -> Column:
    """Predicted genotype quality by the class of the likelihoods; null for class 0."""
    k = pl_type(pl)
    return F.when(k.isin(1, 2), F.get(pl, F.lit(1))).when(k == 3, second_min_distinct(pl))


def pl_normal(pl: Column) -> Column:
    """Three likelihoods with the first zero moved to the front, and its old place: struct<pl, at>."""
    at = F.coalesce(F.array_position(pl, F.lit(0).cast("bigint")).cast("int") - 1, F.lit(-1))
    moved = F.when(at > 0, F.concat(F.slice(pl, at + 1, F.lit(1)), F.filter(pl, lambda x, i: i != at))).otherwise(pl)
    return F.struct(moved.alias("pl"), at.alias("at"))


def zigzag(x: Column) -> Column:
    x = x.cast("bigint")
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def varint_len(x: Column) -> Column:
    """Bytes of a nonnegative integer in groups of seven bits."""
    out = F.lit(9)
    for k in range(8, 0, -1):
        out = F.when(x < (1 << (7 * k)), F.lit(k)).otherwise(out)
    return out


def ad_class(ref: Column, alt: Column) -> Column:
    """``00``, ``n0``, ``0n`` or ``nn`` by which of two depths are zero."""
    digit = lambda c: F.when(c == 0, F.lit("0")).otherwise(F.lit("n"))
    return F.concat(digit(ref), digit(alt))


def delta_bucket(d: Column) -> Column:
    return F.when(d == 0, "0").when(F.abs(d) <= 2, "[-2,2]").when(F.abs(d) <= 10, "[-10,10]").otherwise("other")


def dosage(a1: Column, a2: Column) -> Column:
    """Copies of allele 1; null if an allele is missing (negative or null); others count as ref."""
    one = lambda a: F.when(a == 1, 1).otherwise(0)
    return F.when((a1 >= 0) & (a2 >= 0), one(a1) + one(a2))


def bed_code(a1: Column, a2: Column) -> Column:
    """Two-bit genotype code of the BED format: 0 hom-alt, 1 missing, 2 het, 3 hom-ref."""
    d = dosage(a1, a2)
    return F.when(d.isNull(), 1).when(d == 2, 0).when(d == 1, 2).otherwise(3)


def pgen_code(a1: Column, a2: Column) -> Column:
    """Two-bit dosage of the PGEN format; 3 is missing, also for alleles beyond the first ALT."""
    return F.when((a1 < 0) | (a2 < 0) | (a1 > 1) | (a2 > 1) | a1.isNull() | a2.isNull(), 3).otherwise(dosage(a1, a2))


def first_alt(alt: Column) -> Column:
    return F.substring_index(alt, ",", 1)


def biallelic(alt: Column) -> Column:
    return ~alt.contains("<") & ~alt.contains(",")


def parse_gt(gt: Column) -> Column:
    """struct<alleles array<int>, phased boolean> of a text like ``0/1``, ``.|1`` or ``1``."""
    parts = F.transform(F.split(gt, r"[/|]"), lambda x: x.try_cast("int"))
    return F.struct(parts.alias("alleles"), F.when(gt.contains("|"), True).when(gt.contains("/"), False).alias("phased"))


def format_gt(alleles: Column, phased: Column) -> Column:
    text = F.transform(alleles, lambda a: F.coalesce(a.cast("string"), F.lit(".")))
    return F.when(F.coalesce(phased, F.lit(False)), F.array_join(text, "|")).otherwise(F.array_join(text, "/"))


def is_missing(alleles: Column) -> Column:
    return F.exists(alleles, lambda a: a.isNull() | (a < 0))


def is_hom_ref(alleles: Column) -> Column:
    return F.forall(alleles, lambda a: F.coalesce(a == 0, F.lit(False)))


def is_het(alleles: Column) -> Column:
    return ~is_missing(alleles) & (F.size(F.array_distinct(alleles)) > 1)


def canonical_info(info: Column) -> Column:
    """INFO entries in order; key order carries no meaning."""
    return F.array_join(F.array_sort(F.split(info, ";")), ";")


def canonical_hash(*fields: Column) -> Column:
    return F.sha2(F.concat_ws("\t", *fields), 256)


def human_size(n: Column) -> Column:
    """Bytes as text with a binary unit and two decimals."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(n >= 1024**k, F.concat(F.format_string("%.2f", n / float(1024**k)), F.lit(f" {unit}"))).otherwise(out)
    return out


def unzigzag(x: Column) -> Column:
    return F.shiftrightunsigned(x, 1).bitwiseXOR(-x.bitwiseAND(F.lit(1).cast("bigint")))


def varint_bytes(x: Column) -> Column:
    """Hex text of a nonnegative integer in groups of seven bits, low groups first, with a high bit on all but the last."""
    n = varint_len(x)
    group = lambda i: F.call_function("shiftright", x, i * 7).bitwiseAND(127)
    one = lambda i: F.lpad(F.hex(group(i) + F.when(i < n - 1, 128).otherwise(0)), 2, "0")
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), one), "")


def varint_value(text: Column) -> Column:
    """The integer of such a hex text."""
    at = lambda i: F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint").bitwiseAND(127)
    return F.aggregate(F.sequence(F.lit(0), (F.length(text) / 2).cast("int") - 1), F.lit(0).cast("bigint"), lambda a, i: a + F.call_function("shiftleft", at(i), i * 7))


def bitmap(flags: Column) -> Column:
    """The flags of an array, first in the lowest bit, as 64-bit words."""
    words = F.ceil(F.size(flags) / 64).cast("int")
    bit = lambda w: F.aggregate(
        F.slice(flags, w * 64 + 1, F.lit(64)), F.struct(F.lit(0).cast("bigint").alias("v"), F.lit(0).alias("i")),
        lambda a, x: F.struct(F.when(x, a["v"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), a["i"]))).otherwise(a["v"]).alias("v"), (a["i"] + 1).alias("i")), lambda a: a["v"],
    )
    return F.when(F.size(flags) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), words - 1), bit))


def popcount(words: Column) -> Column:
    """Bits that are set in an array of 64-bit words."""
    return F.aggregate(words, F.lit(0), lambda a, x: a + F.bit_count(x))


def canonical_format(keys: Column, cells: Column) -> Column:
    """FORMAT keys in order, and each cell's values in the same order, short cells filled with ``.``: struct<keys, cells>."""
    names = F.split(keys, ":")
    order = F.array_sort(F.transform(names, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    value = lambda c, o: F.coalesce(F.get(F.split(c, ":"), o["i"]), F.lit("."))
    return F.struct(F.array_join(F.transform(order, lambda o: o["k"]), ":").alias("keys"), F.transform(cells, lambda c: F.array_join(F.transform(order, lambda o: value(c, o)), ":")).alias("cells"))


def canonical_exponent(text: Column) -> Column:
    """Numbers like ``1.00e+05`` without the zeros before their exponent."""
    return F.regexp_replace(text, r"0+e\+", "e+")
