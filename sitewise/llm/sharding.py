"""Jump consistent hashing of rows to shards, with gapless slots inside each shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Multiplier of the published jump hash generator.
MULTIPLIER = 2862933555777941757

#: Steps of the generator that are unrolled when there are more shards than this.
#: A key makes about ln(shards) + 0.6 jumps; a key that needed more raises.
STEPS = 96

_LOW = 0xFFFFFFFF


def _next_key(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * MULTIPLIER + 1 modulo 2^64, in halves of 32 bits that never overflow."""
    c1, c0 = MULTIPLIER >> 32, MULTIPLIER & _LOW

    def low(a: Column, c: int) -> Column:
        return (a * F.lit(c & 0xFFFF) + F.shiftleft((a * F.lit(c >> 16)).bitwiseAND(_LOW), 16)).bitwiseAND(_LOW)

    p0 = lo.bitwiseAND(0xFFFF) * F.lit(c0)
    p1 = F.shiftright(lo, 16) * F.lit(c0)
    s = p0 + F.shiftleft(p1.bitwiseAND(0xFFFF), 16) + F.lit(1)
    carry = F.shiftright(s, 32) + F.shiftright(p1, 16)
    return (carry + low(hi, c0) + low(lo, c1)).bitwiseAND(_LOW), s.bitwiseAND(_LOW)


def jump_hash(key: Column, shards: int, also: int | None = None) -> Column:
    """Struct ``<shard int, other int>``: the jump consistent hash of a 64-bit key.

    ``other`` is the shard among ``also`` shards (``shards`` if not given); both come
    from one run of the generator, as the jumps do not depend on the shard count.
    """
    if shards < 1 or (also is not None and also < 1):
        raise ValueError("the shard count must be at least 1")
    also = also or shards
    most = max(shards, also)
    zero = F.lit(0).cast("bigint")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(_LOW).alias("lo"),
        zero.alias("j"), zero.alias("a"), zero.alias("b"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next_key(s["hi"], s["lo"])
        b = s["j"]
        r = F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")
        j = F.when(b < most, F.floor((b + 1).cast("double") * r).cast("bigint")).otherwise(b)
        return F.struct(
            hi.alias("hi"), lo.alias("lo"), j.alias("j"),
            F.when(b < shards, b).otherwise(s["a"]).alias("a"), F.when(b < also, b).otherwise(s["b"]).alias("b"),
        )

    n = most + 1 if most <= STEPS else STEPS
    done = lambda s: F.when(s["j"] < most, F.raise_error("jump hash: too few steps").cast("bigint")).otherwise(s["a"])
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(n)), start, step,
        lambda s: F.struct((s["a"] if most <= STEPS else done(s)).cast("int").alias("shard"), s["b"].cast("int").alias("other")),
    )


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = 8, text: str = "text", cell_rows: int = 4096) -> DataFrame:
    """Columns ``key, size, text_crc32, shard, slot, grown_shard`` of every row.

    The shard follows from the key and the shard count alone; ``grown_shard`` is the
    shard with one shard more, which takes rows only into the new one. ``slot`` numbers
    the rows of a shard from 0 without gaps. The numbering is not made in one task for
    each shard: rows are dealt to hashed cells of about ``cell_rows`` rows (at most 4 096
    cells a shard, so that the table of cell counts stays under 32 768 * ``shards`` / 8
    rows), numbered in the cell, and raised by the number of rows in earlier cells.

    Null keys hash as key 0. A null text counts as empty: size 1, crc32 0. Equal rows
    get slots of their own; which of them gets which is arbitrary. An empty table gives
    an empty result. Other columns are not read.
    """
    rows = df.select(F.col(key).alias("__k"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    both = jump_hash(F.coalesce(F.col("__k").cast("bigint"), F.lit(0).cast("bigint")), shards, shards + 1)
    rows = rows.select(
        "__k", (F.octet_length("__t") + 1).cast("bigint").alias("size"),
        F.crc32(F.col("__t").cast("binary")).alias("text_crc32"), both.alias("__s"),
    ).select("__k", "size", "text_crc32", F.col("__s.shard").alias("shard"), F.col("__s.other").alias("grown_shard"))
    cells = min(4096, max(16, -(-df.select(key).count() // (shards * cell_rows))))
    rows = rows.withColumn("__c", F.pmod(F.xxhash64("__k", "size", "text_crc32"), F.lit(cells)).cast("int"))
    counts = rows.groupBy("shard", "__c").agg(F.count("*").alias("__n"))
    before = W.partitionBy("shard").orderBy("__c").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("shard", "__c", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = W.partitionBy("shard", "__c").orderBy("__k", "size", "text_crc32")
    rows = rows.withColumn("__i", F.row_number().over(inside) - 1)
    # the window has dealt the rows by the keys of this join; no side is forced to be sent to all
    return rows.join(counts, ["shard", "__c"]).select(
        F.col("__k").alias(key), "size", "text_crc32", "shard", (F.col("__first") + F.col("__i")).cast("bigint").alias("slot"), "grown_shard"
    )
