"""Site tools: keys, structured annotations, reference bases, normal forms, soft filters, statistics, conversions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewise.functions import genotype as g

from .ordered import neighbour
from .plugins import each_alt, variant_type


def variant_key(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """A 64-bit key: 5 bits of chromosome, 28 of the position from 0, 31 of the alleles.

    Chromosomes are numbers, with X 23, Y 24, M or MT 25 and 0 for others. Alleles of A, C, G and T of
    at most 11 letters together are spelled out after their lengths; others are a hash with the lowest bit set.
    """
    name = F.regexp_replace(chrom, "^(?i)chr(?=.)", "")
    number = F.when(name.rlike("^[0-9]{1,2}$"), name.try_cast("bigint")).when(name.rlike("^[xX]$"), 23).when(name.rlike("^[yY]$"), 24).when(name.rlike("^[mM][tT]?$"), 25).otherwise(0)
    both = F.upper(F.concat(ref, alt))
    spelled = both.rlike("^[ACGT]{1,11}$") & (F.length(ref) > 0) & (F.length(alt) > 0)
    digits = F.conv(F.translate(both, "ACGT", "0123"), 4, 10).cast("bigint")
    bases = digits * F.pow(F.lit(4.0), (F.lit(11) - F.length(both)).cast("double")).cast("bigint") * 2
    exact = F.shiftleft(F.length(ref).cast("bigint"), 27).bitwiseOR(F.shiftleft(F.length(alt).cast("bigint"), 23)).bitwiseOR(bases)
    hashed = F.xxhash64(ref, alt).bitwiseAND((1 << 31) - 1).bitwiseOR(1)
    return F.shiftleft(number.cast("bigint"), 59).bitwiseOR(F.shiftleft(pos.cast("bigint") - 1, 31)).bitwiseOR(F.when(spelled, exact).otherwise(hashed))


def hex_key(key: Column) -> Column:
    return F.lower(F.lpad(F.hex(key), 16, "0"))


def split_annotation(df: DataFrame, field: str, names: Sequence[str], keys: Sequence[str], between: str = ",", inside: str = "|") -> DataFrame:
    """(keys, no, one column for each name): the entries of a structured text, in order from 0; absent parts are empty."""
    rows = df.select(*keys, F.posexplode(F.split(field, F.lit(f"\\Q{between}\\E"), -1)).alias("no", "__e"))
    parts = F.split("__e", F.lit(f"\\Q{inside}\\E"), -1)
    return rows.select(*keys, "no", *(F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)))


def worst_annotation(entries: DataFrame, keys: Sequence[str], consequence: str, severity: Sequence[str]) -> DataFrame:
    """The entry of each site whose consequence stands last in ``severity``; the first of equals, unknown ones before all."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, severity)), F.col(consequence)), F.lit(0))
    rest = [c for c in entries.columns if c not in keys]
    best = entries.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(rank, -F.col("no"))).alias("__b"))
    return best.select(*keys, "__b.*")


def frame_shifts(sites: DataFrame, exons: DataFrame, width: int, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """(chrom, pos, alt_no, oof): indels in exons (chrom, start, end): 1 if the bases added or lost in the exon
    are no multiple of three, else 0. An insertion counts if it lies before an exon's last base, of a
    deletion what lies inside. Of several exons the first counts. Sites of one position are told apart by ALT.
    """
    from .setops import overlap_intervals

    alts = sites.select(chrom, pos, "ref", F.posexplode(F.split("alt", ",")).alias("alt_no", "a")).filter(variant_type(F.col("ref"), F.col("a")) == "indel")
    size = F.length("a") - F.length("ref")
    spans = alts.select(chrom, "ref", "a", "alt_no", size.alias("size"), F.col(pos).alias("start"), (F.col(pos) + F.greatest(F.lit(0), -size)).alias("end"))
    met = overlap_intervals(spans, exons.select(chrom, "start", "end"), width, chrom)
    lost = F.least("end", "end_b") - F.greatest(F.col("start") + 1, F.col("start_b")) + 1
    inside = F.when(F.col("size") > 0, F.when(F.col("end_b") > F.col("start"), F.col("size")).otherwise(0)).otherwise(F.greatest(lost, F.lit(0)))
    met = met.withColumn("__n", inside)
    out = met.groupBy(chrom, F.col("start").alias(pos), "alt_no", "ref", "a").agg(F.min_by("__n", "start_b").alias("n")).filter("n > 0")
    return out.select(chrom, pos, (F.col("alt_no") + 1).cast("bigint").alias("alt_no"), F.when(F.col("n") % 3 != 0, 1).otherwise(0).alias("oof"))


def with_reference(sites: DataFrame, chunks: DataFrame, size: int, left: int = 0, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """``sites`` with ``bases``: the reference from ``left`` positions before POS to the end of REF.

    ``chunks`` is (chrom, chunk, seq): ``size`` bases from position chunk * size on. A site joins the few
    chunks it touches by equality, so that no task holds a chromosome. Null where a chunk is missing.
    """
    first, last = F.greatest(F.col(pos) - left, F.lit(0)), F.col(pos) + F.length("ref") - 1
    rows = sites.withColumns({"__no": F.struct(*sites.columns), "__from": first, "__to": last}).select("__no", chrom, "__from", "__to").distinct()
    need = rows.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("__from") / size), F.floor(F.col("__to") / size))))
    got = need.join(chunks, [chrom, "chunk"])
    text = got.groupBy("__no", "__from", "__to").agg(F.array_sort(F.collect_list(F.struct("chunk", "seq"))).alias("c"))
    whole = F.array_join(F.transform("c", lambda x: x["seq"]), "")
    wanted = F.floor(F.col("__to") / size) - F.floor(F.col("__from") / size) + 1
    bases = F.when(F.size("c") == wanted, F.substring(whole, (F.col("__from") % size + 1).cast("int"), (F.col("__to") - F.col("__from") + 1).cast("int")))
    text = text.select(*(F.col(f"__no.{c}").alias(f"__k_{c}") for c in sites.columns), bases.alias("bases"))
    same = None
    for c in sites.columns:
        eq = F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        same = eq if same is None else same & eq
    return sites.join(text, same, "left").drop(*(f"__k_{c}" for c in sites.columns))


def check_reference(sites: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """Sites whose REF differs from the reference, with the reference's ``bases``; letters of any case are equal."""
    return with_reference(sites, chunks, size).filter(F.upper("bases") != F.upper("ref"))


def fill_reference(sites: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """``sites`` with REF from the reference, where it has the bases."""
    return with_reference(sites, chunks, size).withColumn("ref", F.coalesce("bases", "ref")).drop("bases")


def left_aligned(pos: int, ref: str, alts: list[str], bases: str) -> tuple[int, str, list[str]]:
    """Position and alleles moved as far left as ``bases`` (the reference up to the end of REF) allow, and trimmed."""
    before = bases[: len(bases) - len(ref)]
    alleles = [ref, *alts]
    while len({a[-1:].upper() for a in alleles}) == 1 and (min(map(len, alleles)) > 1 or before):
        if min(map(len, alleles)) > 1:
            alleles = [a[:-1] for a in alleles]
        else:
            alleles, before, pos = [before[-1] + a[:-1] for a in alleles], before[:-1], pos - 1
    while min(map(len, alleles)) > 1 and len({a[0].upper() for a in alleles}) == 1:
        alleles, pos = [a[1:] for a in alleles], pos + 1
    return pos, alleles[0], alleles[1:]


def left_align(sites: DataFrame, chunks: DataFrame, size: int, reach: int = 1000) -> DataFrame:
    """``sites`` with indels moved left by up to ``reach`` positions and trimmed; columns pos, ref and alt change.

    Symbolic alleles, sites without ALT and sites whose REF is not the reference's stay as they are.
    """
    df = with_reference(sites, chunks, size, reach)
    names = sites.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                bases, ref, alt = r.pop("bases"), r["ref"], r["alt"]
                if bases and alt not in (None, ".", "") and not set("<*[]") & set(alt) and bases.upper().endswith(ref.upper()):
                    r["pos"], r["ref"], alts = left_aligned(r["pos"], ref, alt.split(","), bases)
                    r["alt"] = ",".join(alts)
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([b.schema.field(n) for n in names]))

    return df.select(*names, "bases").mapInArrow(run, sites.schema)


def soft_filter(sites: DataFrame, condition: Column, name: str, filters: str = "filter") -> DataFrame:
    """FILTER gets ``name`` where the condition holds, beside what it has; PASS where it fails and nothing is set."""
    old = F.filter(F.split(F.coalesce(F.col(filters), F.lit(".")), ";"), lambda x: ~x.isin(".", "PASS", name))
    hit = F.coalesce(condition, F.lit(False))
    new = F.when(hit, F.concat(old, F.array(F.lit(name)))).otherwise(old)
    return sites.withColumn(filters, F.when(F.size(new) == 0, "PASS").otherwise(F.array_join(new, ";")))


def indel_gap(sites: DataFrame, gap: int, width: int | None = None, chrom: str = "chrom", pos: str = "pos", qual: str = "qual") -> DataFrame:
    """Indels that are not the best of a cluster of indels within ``gap`` positions of each other's ends: the one
    with the best quality (missing is least), the first of equals, is kept."""
    from .ordered import run_blocks, running

    size = F.array_max(F.transform(F.split("alt", ","), lambda a: F.abs(F.length(a) - F.length("ref"))))
    rows = sites.filter(~F.col("alt").contains("<") & (F.col("alt") != ".") & (size > 0)).withColumn("__e", F.col(pos) + F.length("ref") - 1)
    rows = running(rows, (chrom,), (pos,), "__r", F.col("__e"), width, most=True, before=True)
    rows = rows.withColumn("__new", F.when(F.col("__r").isNull() | (F.col(pos) > F.col("__r") + gap), 1).otherwise(0))
    rows = running(rows, (chrom,), (pos,), "__k", F.col("__new").cast("bigint"), width)
    score = F.coalesce(F.col(qual).try_cast("double"), F.lit(-1.0))
    best = rows.groupBy(chrom, "__k").agg(F.max_by(pos, F.struct(score, -F.col(pos))).alias("__best"))
    return rows.join(best, [chrom, "__k"]).filter(F.col(pos) != F.col("__best")).drop("__e", "__r", "__new", "__k", "__best")


def substitution_counts(sites: DataFrame) -> DataFrame:
    """One row: transitions, transversions and their ratio over all single-base ALTs."""
    df = each_alt(sites).filter(variant_type(F.col("ref"), F.col("one_alt")) == "snp")
    pair = F.array_join(F.array_sort(F.array(F.upper("ref"), F.upper("one_alt"))), "")
    df = df.filter(F.upper("ref") != F.upper("one_alt"))
    one = df.agg(F.sum(pair.isin("AG", "CT").cast("bigint")).alias("ts"), F.sum((~pair.isin("AG", "CT")).cast("bigint")).alias("tv"))
    return one.select("ts", "tv", F.round(F.col("ts") / F.nullif(F.col("tv"), F.lit(0)), 4).alias("ts_tv"))


def indel_lengths(sites: DataFrame) -> DataFrame:
    """Counts of ALT lengths less REF length among indels."""
    df = each_alt(sites).filter(variant_type(F.col("ref"), F.col("one_alt")) == "indel")
    return df.groupBy((F.length("one_alt") - F.length("ref")).alias("length")).agg(F.count("*").alias("n"))


def quality_histogram(sites: DataFrame, qual: str = "qual") -> DataFrame:
    """Sites, SNPs and indels (by the first ALT) by whole quality; missing quality is -1."""
    kind = variant_type(F.col("ref"), g.first_alt(F.col("alt")))
    value = F.coalesce(F.floor(F.col(qual).try_cast("double")).cast("bigint"), F.lit(-1))
    return sites.groupBy(value.alias("qual")).agg(F.count("*").alias("n"), F.sum((kind == "snp").cast("bigint")).alias("snps"), F.sum((kind == "indel").cast("bigint")).alias("indels"))


def of_types(sites: DataFrame, *types: str) -> DataFrame:
    """Sites with an ALT of one of the types (see ``variant_type``)."""
    return sites.filter(F.exists(F.split("alt", ","), lambda a: variant_type(F.col("ref"), a).isin(*types)))


def in_regions(sites: DataFrame, regions: DataFrame, width: int, keys: Sequence[str] = ("chrom", "pos")) -> DataFrame:
    """Sites that lie in any of the regions (chrom, start, end); each once, however many regions hold it."""
    from .setops import overlap_join

    inside = overlap_join(sites.select(*keys).distinct(), regions.select("chrom", "start", "end"), width).select(*keys).distinct()
    return sites.join(inside, list(keys), "left_semi")


def merge_alleles_of(frames: Sequence[DataFrame], keys: Sequence[str] = ("chrom", "pos", "ref")) -> DataFrame:
    """(keys, alts, file_no, gt): records of several files at one site with one list of ALTs; ``gt`` of each file is
    renumbered to it. ``frames`` have keys, alts and gt; ALTs keep the order of files and of each file's list."""
    rows = None
    for i, df in enumerate(frames):
        df = df.select(*keys, "alts", "gt", F.lit(i).alias("file_no"))
        rows = df if rows is None else rows.unionByName(df)
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("file_no", "alts"))).alias("__l"))
    lists = lists.select(*keys, F.array_distinct(F.flatten(F.transform("__l", lambda x: x["alts"]))).alias("__all"))
    df = rows.join(lists, list(keys))
    of = lambda a: F.when(a.isNull() | (a <= 0), a).otherwise(F.array_position("__all", F.get("alts", (a - 1).cast("int"))).cast("int"))
    return df.withColumn("gt", F.transform("gt", of)).select(*keys, F.col("__all").alias("alts"), "file_no", "gt")


def rename_samples(header: Sequence[str], names: dict[str, str]) -> list[str]:
    """Header lines with sample names replaced; unknown names and names that would repeat raise."""
    columns = header[-1].split("\t")
    if unknown := sorted(set(names) - set(columns[9:])):
        raise ValueError(f"unknown samples: {unknown}")
    new = [names.get(c, c) for c in columns[9:]]
    if len(set(new)) < len(new):
        raise ValueError("a sample name is repeated")
    return [*header[:-1], "\t".join(columns[:9] + new)]


def legend_lines(sites: DataFrame) -> DataFrame:
    """Legend of haplotype files for biallelic sites: id (chrom:pos_ref_alt), position, both alleles."""
    keep = sites.filter(g.biallelic(F.col("alt")) & (F.col("alt") != "."))
    name = F.concat("chrom", F.lit(":"), F.col("pos").cast("string"), F.lit("_"), "ref", F.lit("_"), "alt")
    return keep.select("chrom", "pos", F.concat_ws(" ", name, F.col("pos").cast("string"), "ref", "alt").alias("line"))


def haplotype_lines(calls: DataFrame, keys: Sequence[str], sample: str = "sample_idx") -> DataFrame:
    """Alleles of all haplotypes of a site in sample order: 0, 1, or ``?`` if missing; other alleles are 1."""
    one = lambda c: F.when(F.col(c) < 0, "?").when(F.col(c) > 0, "1").otherwise("0")
    cell = F.concat(one("a1"), F.lit(" "), one("a2"))
    rows = calls.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(sample), cell.alias("c")))).alias("l"))
    return rows.select(*keys, F.array_join(F.transform("l", lambda x: x["c"]), " ").alias("line"))


def probabilities_to_pl(p: Column) -> Column:
    """Phred-scaled likelihoods, the least 0, of genotype probabilities."""
    raw = F.transform(p, lambda x: -10.0 * F.log10(F.greatest(x, F.lit(1e-30))))
    return F.transform(raw, lambda x: F.round(x - F.array_min(raw)).cast("int"))


def pl_to_gl(pl: Column) -> Column:
    return F.transform(pl, lambda x: -x / 10.0)


def write_samples(calls: DataFrame, folder: str, sample: str = "sample") -> None:
    """One folder of Parquet files for each sample, rows dealt by sample and position."""
    calls.repartitionByRange(sample, "chrom", "pos").sortWithinPartitions(sample, "chrom", "pos").write.partitionBy(sample).parquet(folder)


def gap_free(df: DataFrame, by: str = "chrom", pos: str = "pos", end: str = "end", width: int | None = None) -> DataFrame:
    """Rows after which positions are missing before the next row begins, with the number missing."""
    df = neighbour(df, (by,), (pos,), {"__n": F.col(pos)}, 1, width)
    return df.withColumn("missing", F.col("__n") - F.col(end) - 1).filter("missing > 0").drop("__n")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "Iterator", "Sequence", "Column", "DataFrame", "F", "T", "g", "each_alt", "variant_type", "neighbour")]
