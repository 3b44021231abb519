"""Command line: compress, decompress, gvcf, gvcf-decompress and gvcf-query over Spark."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.operators import counts, filters
from sitewise.sources import archive, bcf, bgen, plink, vcf


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sitewise")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in ("compress", "gvcf"):
        c = sub.add_parser(verb)
        c.add_argument("-i", "--input", required=True, help="comma-separated files, @file with one on each line, or - for standard input")
        c.add_argument("-o", "--output", required=True)
        c.add_argument("-M", "--lossy", action="store_true")
        c.add_argument("-b", "--bcf", action="store_true")
        c.add_argument("-p", "--ploidy", type=int)
    for verb in ("decompress", "gvcf-decompress", "gvcf-query"):
        d = sub.add_parser(verb)
        d.add_argument("-i", "--input", required=True)
        d.add_argument("-o", "--output")
        d.add_argument("-M", "--lossy", action="store_true")
        d.add_argument("-r", "--range")
        d.add_argument("-s", "--samples", help="comma-separated names, or @file")
        d.add_argument("-O", "--sample-names", help="file to write the sample names to")
        d.add_argument("-I", "--id", default="")
        d.add_argument("-n", "--records", type=int)
        d.add_argument("-G", "--no-genotypes", action="store_true")
        d.add_argument("-C", "--counts", action="store_true")
        d.add_argument("-H", "--no-header", action="store_true")
        d.add_argument("--header-only", action="store_true")
        d.add_argument("-S", "--split", action="store_true")
        d.add_argument("-f", "--format", choices=("vcf", "bcf", "bed", "pgen", "bgen"), default="vcf")
        d.add_argument("-l", "--level", type=int, default=6, choices=range(10), help="of compressed output")
        for k, kind in (("qual", int), ("AC", int), ("AF", float)):
            d.add_argument(f"--min-{k}", type=kind)
            d.add_argument(f"--max-{k}", type=kind)
    return p


def _list(text: str) -> list[str]:
    if text.startswith("@"):
        with open(text[1:]) as f:
            return f.read().split()
    return [x for x in text.split(",") if x]


def compress(spark: SparkSession, a) -> None:
    if a.input == "-":
        if a.bcf:
            raise ValueError("binary input must be a file")
        lines = vcf.read_stdin(spark, sys.stdin.buffer)
    else:
        files = _list(a.input)
        lines = bcf.read_lines(spark, files) if a.bcf else vcf.read_lines(spark, files)
    header = vcf.merged_header(lines)
    kind = "gvcf" if vcf.is_gvcf(lines) else "sites"
    names, sites = vcf.sample_names(lines), vcf.sites(lines)
    if a.verb == "gvcf" and len(names) != 1:
        raise ValueError(f"a gVCF file has one sample, not {len(names)}")
    if a.verb == "gvcf" and kind != "gvcf":
        raise ValueError("not a gVCF file: its header names none of END, MIN_DP and NON_REF")
    calls = vcf.calls(sites, names)
    if a.ploidy:
        calls = filters.check_ploidy(calls, a.ploidy)
    archive.write_archive(sites.drop("cells"), f"{a.output}/sites", lossy=a.lossy)
    archive.write_archive(calls.select("chrom", "pos", "site_id", "sample_idx", "sample", "gt") if a.lossy else calls, f"{a.output}/calls")
    rows = [(0, i, x, a.verb if a.verb == "gvcf" else "sites") for i, x in enumerate(header)]
    spark.createDataFrame(rows, "file_no int, offset bigint, line string, kind string").coalesce(1).write.parquet(f"{a.output}/headers")


def select(spark: SparkSession, a) -> tuple[DataFrame, DataFrame, list[str]]:
    """Sites and calls of the archive after all filters, and the samples in output order."""
    sites = archive.read_archive(spark, f"{a.input}/sites", lossy=a.lossy)
    calls = archive.read_archive(spark, f"{a.input}/calls")
    header = spark.read.parquet(f"{a.input}/headers")
    kind = header.select("kind").first()
    if kind and (kind[0] == "gvcf") != a.verb.startswith("gvcf"):
        raise ValueError(f"the archive is of kind {kind[0]}")
    names = vcf.sample_names(header)
    if a.range:
        filters.require_chrom(sites, a.range)
        cut = filters.block_range_filter if a.verb == "gvcf-query" else filters.range_filter
        sites, calls = cut(sites, a.range), cut(calls, a.range)
    if a.samples:
        asked = _list(a.samples)
        if unknown := sorted({*asked} - {*names}):
            raise ValueError(f"unknown samples: {unknown}")
        rank = spark.createDataFrame([(n, i) for i, n in enumerate(asked)], "sample string, rank int")
        calls, names = calls.drop("sample_idx").join(rank, "sample").withColumnRenamed("rank", "sample_idx"), asked
    sites = filters.qual_filter(filters.id_filter(sites, a.id), a.min_qual, a.max_qual, "qual_str")
    if a.counts or any(x is not None for x in (a.min_AC, a.max_AC, a.min_AF, a.max_AF)):
        alleles = calls.select("site_id", F.explode("gt").alias("a"))
        found = counts.allele_counts(alleles, ("site_id",), ("a",))
        found = filters.count_filter(found, a.min_AC or 0, 2**31 - 1 if a.max_AC is None else a.max_AC)
        found = filters.frequency_filter(found, a.min_AF or 0.0, 1.0 if a.max_AF is None else a.max_AF)
        sites = sites.join(found, "site_id").withColumn("info_text", F.concat(F.lit("AN="), F.col("an"), F.lit(";AC="), F.col("ac")))
    if a.records is not None:
        sites = sites.orderBy("site_id").limit(a.records)
    return sites, calls, names


def decompress(spark: SparkSession, a) -> None:
    sites, calls, names = select(spark, a)
    if a.sample_names:
        with open(a.sample_names, "w") as f:
            f.writelines(f"{n}\n" for n in names)
    header = [r.line for r in spark.read.parquet(f"{a.input}/headers").orderBy("file_no", "offset").collect()]
    if header:
        columns = [f"#{c}" if i == 0 else c for i, c in enumerate(vcf.CORE)]
        header[-1] = "\t".join(columns + ([] if a.no_genotypes else ["FORMAT", *names]))
    if a.lossy:
        sites = sites.withColumns({"filters": F.array().cast("array<string>"), "info_text": F.coalesce("info_text", F.lit(".")) if a.counts else F.lit(".")})
        calls = calls.withColumn("phased", F.lit(True))
    if a.format in ("bed", "pgen", "bgen"):
        flat = sites.withColumn("alt", F.when(F.size("alts") == 0, ".").otherwise(F.array_join("alts", ",")))
        two = calls.select("site_id", "sample_idx", *(F.coalesce(F.get("gt", F.lit(i)), F.lit(-1)).alias(f"a{i + 1}") for i in (0, 1))).join(flat.select("site_id"), "site_id", "left_semi")
        base = a.output.removesuffix(f".{a.format}")
        {"bed": lambda: plink.write_bed_set(flat, two, names, base), "pgen": lambda: plink.write_pgen_set(flat, two, names, base), "bgen": lambda: bgen.write_bgen(flat, two, a.output, len(names))}[a.format]()
        return
    # chosen samples come with GT alone, whole records with all fields
    lines = vcf.record_lines(sites, None if a.no_genotypes else calls, gt_only=bool(a.lossy or a.samples))
    if a.format == "bcf":
        bcf.write_bcf(lines, "\n".join(header), a.output, a.level)
    elif a.split:
        vcf.write_split(lines, a.output, F.substring_index("line", "\t", 1), [] if a.no_header else header)
    elif a.output:
        body = lines.limit(0) if a.header_only else lines
        vcf.write_text(body, a.output, [] if a.no_header else header, compressed=a.output.endswith((".gz", ".bgz", ".bgzf")), level=a.level)
    else:
        sys.stdout.writelines(f"{h}\n" for h in ([] if a.no_header else header))
        if not a.header_only:
            for r in lines.orderBy("site_id").toLocalIterator():
                sys.stdout.write(f"{r.line}\n")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    (compress if a.verb in ("compress", "gvcf") else decompress)(spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
