"""BGEN v1.2 export: layout 2, zlib, 8-bit probabilities."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewise.functions import genotype as g


#: 8-bit probabilities of hom-ref and het for each dosage.
_PROBABILITIES = (bytes((255, 0)), bytes((0, 255)), bytes((0, 0)))


def _text(s: str) -> bytes:
    raw = s.encode()
    return struct.pack("<H", len(raw)) + raw


def variant_block(chrom: str, pos: int, id: str, ref: str, alt: str, codes: list[int | None]) -> bytes:
    """One variant with dosages 0, 1, 2 of the first ALT; None is missing."""
    import zlib

    n = len(codes)
    ploidy = bytes(0x82 if c is None else 2 for c in codes)
    probs = b"".join(b"\0\0" if c is None else _PROBABILITIES[c] for c in codes)
    body = struct.pack("<IHBB", n, 2, 2, 2) + ploidy + struct.pack("<BB", 0, 8) + probs
    packed = zlib.compress(body)
    alleles = b"".join(struct.pack("<I", len(a.encode())) + a.encode() for a in (ref, alt))
    head = _text(id) + _text(id) + _text(chrom) + struct.pack("<IH", pos, 2) + alleles
    return head + struct.pack("<II", len(packed) + 4, len(body)) + packed


def header_block(variants: int, samples: int) -> bytes:
    """Offset and header; flags: zlib and layout 2, without sample names."""
    return struct.pack("<IIII4sI", 20, 20, variants, samples, b"bgen", 1 | 2 << 2)


def bgen_rows(sites: DataFrame, calls: DataFrame) -> DataFrame:
    """(keys, bytes) of each biallelic site; keys are ``site_id`` if both have it, else chromosome and position."""
    keys = ["site_id"] if "site_id" in sites.columns and "site_id" in calls.columns else ["chrom", "pos"]
    dose = calls.select(*keys, "sample_idx", g.dosage(F.col("a1"), F.col("a2")).alias("d"))
    dose = dose.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "d"))), lambda x: x["d"]).alias("codes"))
    fields = [F.col(c).alias(f"__{c}") for c in ("chrom", "pos", "id", "ref", "alt")]
    rows = sites.filter(g.biallelic(F.col("alt"))).join(dose, keys).select(*keys, *fields, "codes")
    n = len(keys)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = [variant_block(*r) for r in zip(*(c.to_pylist() for c in b.columns[n:]))]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(out, pa.binary())], names=[*keys, "bytes"])

    return rows.mapInArrow(run, T.StructType([*(sites.schema[k] for k in keys), T.StructField("bytes", T.BinaryType())]))


def write_bgen(sites: DataFrame, calls: DataFrame, path: str, samples: int) -> int:
    from .plink import write_packed

    rows = bgen_rows(sites, calls)
    return write_packed(rows, path, header_block(rows.count(), samples), *rows.columns[:-1])
