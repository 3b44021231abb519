"""PLINK text and binary exports."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewise.functions import genotype as g

from .ordered_file import write


def bim_lines(sites: DataFrame) -> DataFrame:
    """Column ``line``: chromosome, id, 0, position, first ALT, REF, by tabs. ``<M>`` rows are skipped."""
    keep = sites.filter(~F.col("alt").endswith("<M>"))
    return keep.select(*_keys(sites), F.concat_ws("\t", "chrom", "id", F.lit("0"), F.col("pos").cast("string"), g.first_alt(F.col("alt")), "ref").alias("line"))


def fam_lines(names: Sequence[str]) -> list[str]:
    return [f"0 {n} 0 0 0 -9" for n in names]


def pvar_lines(sites: DataFrame) -> DataFrame:
    """Column ``line`` of strictly biallelic sites: chromosome, position, id, REF, ALT."""
    return sites.filter(g.biallelic(F.col("alt"))).select(*_keys(sites), F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", "alt").alias("line"))


def _keys(df: DataFrame) -> tuple[str, ...]:
    """What tells records apart: their number, as two records may share a position."""
    return ("site_id",) if "site_id" in df.columns else ()


def packed_rows(calls: DataFrame, code, keys: tuple[str, ...] | None = None, sample: str = "sample_idx") -> DataFrame:
    """(keys, bytes): two-bit codes of a site's samples in sample order, four in a byte, low bits first.

    Sites are told apart by ``site_id`` if there is one, else by chromosome and position."""
    keys = keys or _keys(calls) or ("chrom", "pos")
    cells = calls.select(*keys, sample, code.cast("int").alias("code"))
    rows = cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(sample, "code"))), lambda x: x["code"]).alias("codes"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out = []
            for codes in b.column(b.num_columns - 1).to_pylist():
                c = np.array(codes + [0] * (-len(codes) % 4), np.uint8).reshape(-1, 4)
                out.append((c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], names=[*keys, "bytes"])

    return rows.mapInArrow(run, T.StructType([*(calls.schema[k] for k in keys), T.StructField("bytes", T.BinaryType())]))


#: First bytes of a variant-major BED file and of a fixed-width PGEN file.
BED_MAGIC = bytes((0x6C, 0x1B, 0x01))
PGEN_MAGIC = bytes((0x6C, 0x1B, 0x02))


def write_packed(rows: DataFrame, path: str, header: bytes, *order: str) -> int:
    """Write packed rows behind a header to one local file, in order."""
    return write(rows.select(*order, "bytes"), path, order, bytes, header)


def bed_rows(calls: DataFrame, **options) -> DataFrame:
    return packed_rows(calls, g.bed_code(F.col("a1"), F.col("a2")), **options)


def pgen_rows(calls: DataFrame, **options) -> DataFrame:
    return packed_rows(calls, g.pgen_code(F.col("a1"), F.col("a2")), **options)


def write_bed(calls: DataFrame, path: str) -> int:
    rows = bed_rows(calls)
    return write_packed(rows, path, BED_MAGIC, *rows.columns[:-1])


def write_pgen(calls: DataFrame, path: str, samples: int) -> int:
    rows = pgen_rows(calls)
    return write_packed(rows, path, PGEN_MAGIC + struct.pack("<IIB", rows.count(), samples, 0x40), *rows.columns[:-1])


def _write_lines(lines: DataFrame, path: str, head: str = "") -> int:
    order = tuple(c for c in lines.columns if c != "line")
    return write(lines, path, order, lambda line: f"{line}\n".encode(), head.encode())


def write_bed_set(sites: DataFrame, calls: DataFrame, names: Sequence[str], base: str) -> int:
    """``base``.bed, .bim and .fam: one row in each of the first two for every record but ``<M>`` rows."""
    sites = sites.filter(~F.col("alt").endswith("<M>"))
    n = write_bed(calls.join(sites.select("site_id"), "site_id", "left_semi"), f"{base}.bed")
    _write_lines(bim_lines(sites), f"{base}.bim")
    with open(f"{base}.fam", "w") as f:
        f.writelines(f"{x}\n" for x in fam_lines(names))
    return n


def write_pgen_set(sites: DataFrame, calls: DataFrame, names: Sequence[str], base: str) -> int:
    """``base``.pgen, .pvar and .psam of the strictly biallelic records."""
    sites = sites.filter(g.biallelic(F.col("alt")))
    n = write_pgen(calls.join(sites.select("site_id"), "site_id", "left_semi"), f"{base}.pgen", len(names))
    _write_lines(pvar_lines(sites), f"{base}.pvar", "#CHROM\tPOS\tID\tREF\tALT\n")
    with open(f"{base}.psam", "w") as f:
        f.writelines(["#IID\n", *(f"{x}\n" for x in names)])
    return n
