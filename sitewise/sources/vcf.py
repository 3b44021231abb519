"""Variant-call text: scan into sites and calls, normal forms, and text output.

Lines are read by Spark's text source in one scan over all files: plain files split, gzip and
BGZF files are one split each. A record's ``site_id`` combines the number of its file, the
partition and the place there, so that order survives every shuffle. Files keep their given order.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Sequence
from typing import IO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.functions import genotype as g

CORE = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO")

#: Bits of a ``site_id`` for the place in a partition and for the partition; the rest number files.
ROW_BITS, PART_BITS = 28, 20

#: FORMAT keys with columns of their own.
TYPED = ("GT", "AD", "DP", "GQ", "MIN_DP", "PL")


def _plain_uri(uri: str) -> str:
    return re.sub(r"^(\w+):/+", r"\1:/", uri)


def file_numbers(spark: SparkSession, files: Sequence[str], paths: Sequence[str]) -> DataFrame:
    """(uri, file_no): found files in the order of the given paths, by name within a folder or pattern."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    roots = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        roots.append(_plain_uri(path.getFileSystem(conf).makeQualified(path).toUri().toString()))
    if len(set(roots)) < len(roots):
        raise ValueError("a file is given twice")
    place = {r: i for i, r in enumerate(roots)}

    def rank(uri: str) -> tuple[int, str]:
        u = _plain_uri(uri)
        at = place.get(u, place.get(u.rpartition("/")[0]))
        return (next(i for i, r in enumerate(roots) if u.startswith(r + "/") or fnmatch.fnmatch(u, r)) if at is None else at, u)

    found = sorted(set(files), key=rank)
    if len(found) > 1 << (63 - ROW_BITS - PART_BITS):
        raise ValueError(f"more than {1 << (63 - ROW_BITS - PART_BITS)} files")
    return spark.createDataFrame([(u, i) for i, u in enumerate(found)], "uri string, file_no int")


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file_no, offset, line) of all files in one scan: offsets grow within a file."""
    paths = list(paths)
    if not paths:
        raise ValueError("no files")
    text = spark.read.text(paths)
    numbers = file_numbers(spark, text.inputFiles(), paths)
    rows = text.select(F.input_file_name().alias("uri"), F.monotonically_increasing_id().alias("offset"), F.rtrim("value", F.lit("\r")).alias("line"))
    # as many rows on the right as there are files
    return rows.join(F.broadcast(numbers), "uri").select("file_no", "offset", "line")


def read_stdin(spark: SparkSession, stream: IO[bytes], folder: str | None = None) -> DataFrame:
    """Lines of a stream of text, which is put into the shared folder first, a part at a time."""
    from pyarrow import fs

    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("reading a stream needs spark.checkpoint.dir, a folder that all executors share")
    path = f"{folder.rstrip('/')}/stdin-{uuid.uuid4().hex}.vcf"
    where, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    where.create_dir(at.rpartition("/")[0], recursive=True)
    with where.open_output_stream(at) as out:
        while data := stream.read(1 << 20):
            out.write(data)
    return read_lines(spark, [path])


def headers(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("line").startswith("#")).select("file_no", "offset", "line")


def merged_header(lines: DataFrame) -> list[str]:
    """Header lines of all files, each once, in order of appearance, the column line last.

    Of lines that define the same key and ID the first counts; so does the first file's column
    line. Files whose sample columns differ raise, as their cells could not be told apart.
    """
    first = headers(lines).groupBy("line").agg(F.min(F.struct("file_no", "offset")).alias("at"))
    rows = [r.line for r in first.orderBy("at").collect()]
    columns = [x for x in rows if x.startswith("#CHROM")]
    if len(columns) > 1:
        raise ValueError("the files have different samples")
    out: dict[str, str] = {}
    for x in rows:
        if x.startswith("#CHROM"):
            continue
        m = re.match(r"##(\w+)=<(?:.*?,)?ID=([^,>]+)", x)
        out.setdefault(f"{m[1]}={m[2]}" if m else "format" if x.startswith("##fileformat") else x, x)
    return [*out.values(), *columns]


def sample_names(lines: DataFrame) -> list[str]:
    """Sample names of the first file's column line; a repeated name raises."""
    row = lines.filter(F.col("line").startswith("#CHROM")).orderBy("file_no", "offset").select("line").first()
    names = row.line.split("\t")[9:] if row else []
    if len(set(names)) < len(names):
        raise ValueError("a sample name is repeated")
    return names


def site_id(file_no: Column, offset: Column) -> Column:
    """Number of a record that grows with its file and its place there; places beyond the bits raise."""
    part, row = F.shiftrightunsigned(offset, 33), offset.bitwiseAND((1 << 33) - 1)
    packed = F.shiftleft(file_no.cast("bigint"), ROW_BITS + PART_BITS) + F.shiftleft(part, ROW_BITS) + row
    wide = (part >= (1 << PART_BITS)) | (row >= (1 << ROW_BITS))
    return F.when(wide, F.raise_error(F.lit("too many partitions, or records in one")).cast("bigint")).otherwise(packed)


def _firsts(pairs: Column) -> Column:
    """A map of (k, v) structs; of a repeated key the first value counts."""
    keys = F.transform(pairs, lambda x: x["k"])
    return F.map_from_entries(F.filter(pairs, lambda x, i: F.array_position(keys, x["k"]) == i + 1))


def sites(lines: DataFrame) -> DataFrame:
    """One row for each record: typed core columns, FORMAT keys and the samples' texts.

    Of a repeated INFO key the first value is in the map; ``info_text`` has all."""
    f = F.split("line", "\t")
    at = lambda i: F.get(f, F.lit(i))
    dot = lambda c: F.when(c != ".", c)
    pairs = F.transform(F.filter(F.split(at(7), ";"), lambda x: (x != ".") & (x != "")), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise(F.lit("")).alias("v")))
    rows = lines.filter(~F.col("line").startswith("#") & (F.col("line") != ""))
    return rows.select(
        site_id(F.col("file_no"), F.col("offset")).alias("site_id"), at(0).alias("chrom"), at(1).cast("bigint").alias("pos"), at(2).alias("id"), at(3).alias("ref"),
        F.when(at(4) == ".", F.array().cast("array<string>")).otherwise(F.split(at(4), ",")).alias("alts"), at(4).alias("alt"), at(5).alias("qual_str"), at(5).try_cast("double").alias("qual"),
        F.when(at(6) == ".", F.array().cast("array<string>")).otherwise(F.split(at(6), ";")).alias("filters"),
        _firsts(pairs).alias("info"), at(7).alias("info_text"), F.split(dot(at(8)), ":").alias("keys"), F.slice(f, F.lit(10), F.greatest(F.size(f) - 9, F.lit(0))).alias("cells"),
    )


def cell_text(keys: Column) -> Column:
    """The text of a call from its columns, in the order of the site's FORMAT keys."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    many = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("."))), ","), F.lit("."))
    typed = {"GT": F.coalesce(g.format_gt(F.col("gt"), F.col("phased")), F.lit(".")), "AD": many("ad"), "DP": one("dp"), "GQ": one("gq"), "MIN_DP": one("min_dp"), "PL": many("pl")}

    def value(k: Column) -> Column:
        out = F.coalesce(F.col("other")[k], F.lit("."))
        for name, text in typed.items():
            out = F.when(k == name, text).otherwise(out)
        return out

    return F.array_join(F.transform(keys, value), ":")


def calls(sites: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row for each site and sample: alleles, phase and typed AD, DP, GQ, MIN_DP, PL, the rest as text.

    ``raw`` is the original text of the few calls that these columns would not give back as it
    was: values cut short, leading zeros, mixed phase. Of a repeated FORMAT key the first counts.
    """
    if not names:
        raise ValueError("the file has no samples")
    df = sites.select("site_id", "chrom", "pos", "keys", F.posexplode("cells").alias("sample_idx", "cell"))
    df = df.withColumn("sample", F.get(F.lit(list(names)), F.col("sample_idx")))
    df = df.withColumn("__v", F.split("cell", ":"))
    n = F.least(F.size("keys"), F.size("__v"))
    pairs = F.zip_with(F.slice("keys", F.lit(1), n), F.slice("__v", F.lit(1), n), lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    df = df.withColumn("other", _firsts(pairs))
    text = lambda k: F.col("other")[k]
    ints = lambda k: F.transform(F.split(F.when(text(k) != ".", text(k)), ","), lambda x: x.try_cast("int"))
    one = lambda k: text(k).try_cast("int")
    df = df.withColumns({
        "__g": g.parse_gt(text("GT")), "ad": ints("AD"), "dp": one("DP"), "gq": one("GQ"), "min_dp": one("MIN_DP"), "pl": ints("PL"),
        "other": F.map_filter("other", lambda k, _: ~k.isin(*TYPED)),
    }).withColumns({"gt": F.col("__g.alleles"), "phased": F.col("__g.phased")})
    raw = F.when(cell_text(F.col("keys")) != F.col("cell"), F.col("cell"))
    return df.select("site_id", "chrom", "pos", "sample_idx", "sample", "gt", "phased", "ad", "dp", "gq", "min_dp", "pl", "other", raw.alias("raw"))


def is_gvcf(lines: DataFrame) -> bool:
    """Whether the header speaks of END, MIN_DP or NON_REF."""
    h = headers(lines).filter(F.col("line").rlike(r"ID=(END|MIN_DP)\b|NON_REF"))
    return not h.isEmpty()


def gvcf(sites_: DataFrame, names: Sequence[str]) -> DataFrame:
    """Single-sample records with END; more or fewer samples than one raise."""
    if len(names) != 1:
        raise ValueError(f"a gVCF file has one sample, not {len(names)}")
    return sites_.drop("chrom", "pos").join(calls(sites_, names).drop("sample", "sample_idx"), "site_id").select(
        "site_id", "chrom", "pos", "id", "ref", "alts", "qual", "filters", F.col("info")["END"].try_cast("bigint").alias("end_pos"), "gt", "phased", "dp", "gq", "min_dp", "pl", "ad"
    )


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("."))


def record_lines(sites_: DataFrame, calls_: DataFrame | None = None, gt_only: bool = True) -> DataFrame:
    """(site_id, line): records as text, with all FORMAT fields or GT alone of each call, or without samples.

    All fields come in the order of the site's keys; with every sample of the scan, a line is
    the one that was read, byte by byte.
    """
    core = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), _text(F.col("id")), "ref", F.when(F.size("alts") == 0, ".").otherwise(F.array_join("alts", ",")),
                       _text(F.col("qual_str")), F.when(F.size("filters") == 0, ".").otherwise(F.array_join("filters", ";")), _text(F.col("info_text")))
    if calls_ is None:
        return sites_.select("site_id", core.alias("line"))
    if gt_only:
        text, head = g.format_gt(F.col("gt"), F.col("phased")), F.lit("GT")
    else:
        calls_ = calls_.join(sites_.select("site_id", "keys"), "site_id")
        text, head = F.coalesce("raw", cell_text(F.col("keys"))), F.coalesce(F.array_join("keys", ":"), F.lit("."))
    cells = calls_.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("sample_idx", text.alias("t")))).alias("c"))
    return sites_.join(cells, "site_id").select("site_id", F.concat_ws("\t", core, head, F.array_join(F.transform("c", lambda x: x["t"]), "\t")).alias("line"))


def write_text(lines: DataFrame, path: str, head: Sequence[str] = (), compressed: bool = False, level: int = 6) -> None:
    """One ordered local file, BGZF blocks if ``compressed``; executors make and compress its parts."""
    from .ordered_file import write

    write(lines.select("site_id", "line"), path, ("site_id",), lambda line: f"{line}\n".encode(), "".join(f"{h}\n" for h in head).encode(), compressed, level)


def write_split(lines: DataFrame, folder: str, chrom: Column, head: Sequence[str] = ()) -> None:
    """One folder for each chromosome, with the header before the records.

    Rows are dealt by chromosome and place, so that a large chromosome is written by several
    tasks; its files follow each other by name.
    """
    rows = lines.select(chrom.alias("chrom"), "site_id", "line")
    if head:
        tops = F.posexplode(F.array(*map(F.lit, head))).alias("i", "line")
        rows = rows.unionByName(rows.select("chrom").distinct().select("chrom", tops).select("chrom", (F.col("i") - len(head)).cast("bigint").alias("site_id"), "line"))
    rows = rows.repartitionByRange("chrom", "site_id").sortWithinPartitions("chrom", "site_id")
    rows.select("chrom", "line").write.partitionBy("chrom").text(folder)
