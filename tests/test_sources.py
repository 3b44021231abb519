import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from sitewise.operators import counts, filters, reshape
from sitewise.sources import archive, bcf, bgen, plink, vcf

HEADER = """##fileformat=VCFv4.2
##FILTER=<ID=low,Description="x">
##INFO=<ID=NS,Number=1,Type=Integer,Description="x">
##INFO=<ID=DB,Number=0,Type=Flag,Description="x">
##FORMAT=<ID=GT,Number=1,Type=String,Description="x">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="x">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="x">
##contig=<ID=c1>
##contig=<ID=c-2>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2"""
RECORDS = [
    "c1\t10\tr1\tA\tG\t29.7\tPASS\tNS=2;DB\tGT:AD:DP\t0|1:3,4:7\t./.:.:.",
    "c1\t10\tr2\tA\tC,T,GA\t.\tlow\t.\tGT\t1|3\t2/0",
    "c1\t12\t.\tC\t.\t50\t.\tNS=1\tGT\t0/0\t0",
    "c-2\t5\tr4\tT\tA\t9\tPASS\tDB\tGT\t1/1\t./1",
]


@pytest.fixture
def lines(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("\n".join([HEADER, *RECORDS]) + "\n")
    return vcf.read_lines(spark, [str(tmp_path / "a.vcf")])


def test_scan(lines):
    sites = vcf.sites(lines)
    rows = sites.orderBy("site_id").collect()
    assert [(r.chrom, r.pos, r.alts) for r in rows] == [("c1", 10, ["G"]), ("c1", 10, ["C", "T", "GA"]), ("c1", 12, []), ("c-2", 5, ["A"])]
    assert rows[0].info == {"NS": "2", "DB": ""} and rows[1].info == {} and rows[1].qual is None and rows[0].qual == 29.7
    calls = {(r.pos, r.sample, r.chrom, tuple(r.gt)): r for r in vcf.calls(sites, vcf.sample_names(lines)).collect()}
    first = calls[10, "s1", "c1", (0, 1)]
    assert (first.ad, first.dp, first.phased) == ([3, 4], 7, True)
    assert calls[10, "s2", "c1", (None, None)].ad is None
    assert calls[12, "s2", "c1", (0,)].phased is None


def test_text_round_trip(spark, lines, tmp_path):
    sites = vcf.sites(lines)
    out = vcf.record_lines(sites, vcf.calls(sites, ["s1", "s2"]))
    vcf.write_text(out, str(tmp_path / "o.vcf.gz"), head=HEADER.split("\n"), compressed=True)
    back = gzip.open(tmp_path / "o.vcf.gz", "rt").read().split("\n")[10:-1]
    want = ["\t".join([*(f := r.split("\t"))[:8], "GT", *(x.split(":")[0] for x in f[9:])]) for r in RECORDS]
    assert back == want


def test_split_by_chromosome(lines, tmp_path):
    sites = vcf.sites(lines)
    vcf.write_split(vcf.record_lines(sites), str(tmp_path / "s"), F.substring_index("line", "\t", 1))
    assert sorted(p.name for p in (tmp_path / "s").glob("chrom=*")) == ["chrom=c-2", "chrom=c1"]


def test_bcf_round_trip(spark, lines, tmp_path):
    sites = vcf.sites(lines)
    out = vcf.record_lines(sites, vcf.calls(sites, ["s1", "s2"]))
    assert bcf.write_bcf(out, HEADER, str(tmp_path / "o.bcf")) == 4
    back = bcf.read_lines(spark, str(tmp_path / "o.bcf"))
    got = [r.line for r in back.orderBy("offset").collect()]
    want = ["\t".join([*(f := r.split("\t"))[:8], "GT", *(x.split(":")[0] for x in f[9:])]) for r in RECORDS]
    assert got == HEADER.split("\n") + want


def test_gvcf_needs_one_sample(lines):
    with pytest.raises(ValueError):
        vcf.gvcf(vcf.sites(lines), ["s1", "s2"])
    assert not vcf.is_gvcf(lines)
    with pytest.raises(ValueError):
        vcf.calls(vcf.sites(lines), [])


def test_split_and_merge_are_inverse(lines):
    sites = vcf.sites(lines).filter("size(alts) > 0")
    calls = vcf.calls(vcf.sites(lines), ["s1", "s2"]).select("site_id", "sample_idx", "gt")
    cells = calls.groupBy("site_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "gt"))), lambda x: x["gt"])).alias("gt"))
    wide = sites.join(cells, "site_id").select("site_id", "alt", "gt")
    split = reshape.split_alleles(wide, gt="gt").select("site_id", "alt_no", "split_alt", "codes")
    assert split.filter("split_alt = 'C,<N>'").first().codes == ["1", "2", "2", "0"]
    merged = {r.site_id: (r.alt, r.gt) for r in reshape.merge_alleles(split, ["site_id"], "codes").collect()}
    assert merged == {r.site_id: (r.alt, r.gt) for r in wide.collect()}


def test_archive(spark, lines, tmp_path):
    sites = vcf.sites(lines)
    archive.write_archive(sites, str(tmp_path / "x"))
    got = filters.range_filter(archive.read_archive(spark, str(tmp_path / "x")), "c1:11,20")
    assert [r.pos for r in got.collect()] == [12]
    assert "PartitionFilters: [isnotnull(chrom" in got._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        archive.read_archive(spark, str(tmp_path / "x"), lossy=True)


def test_binary_exports(spark, tmp_path):
    calls = spark.createDataFrame([("c", 1, 0, 0, 0), ("c", 1, 1, 0, 1), ("c", 1, 2, 1, 1), ("c", 1, 3, -1, 1), ("c", 1, 4, 2, 0)], "chrom string, pos long, sample_idx int, a1 int, a2 int")
    plink.write_bed(calls, str(tmp_path / "a.bed"))
    assert (tmp_path / "a.bed").read_bytes() == plink.BED_MAGIC + bytes((3 | 2 << 2 | 0 << 4 | 1 << 6, 3))
    plink.write_pgen(calls, str(tmp_path / "a.pgen"), 5)
    assert (tmp_path / "a.pgen").read_bytes() == plink.PGEN_MAGIC + struct.pack("<IIB", 1, 5, 0x40) + bytes((0 | 1 << 2 | 2 << 4 | 3 << 6, 3))
    sites = spark.createDataFrame([("c", 1, "r", "A", "G")], "chrom string, pos long, id string, ref string, alt string")
    bgen.write_bgen(sites, calls, str(tmp_path / "a.bgen"), 5)
    raw = (tmp_path / "a.bgen").read_bytes()
    assert struct.unpack_from("<IIII", raw) == (20, 20, 1, 5)
    body = zlib.decompress(raw[raw.index(b"\x78\x9c") :])
    assert body[8:13] == bytes((2, 2, 2, 0x82, 2)) and body[15:] == bytes((255, 0, 0, 255, 0, 0, 0, 0, 255, 0))


@pytest.mark.parametrize("spec, want", [("c1", ("c1", None, None)), ("c1:5", ("c1", 5, None)), ("c1:5,9", ("c1", 5, 9))])
def test_ranges(spec, want):
    assert filters.parse_range(spec) == want


@pytest.mark.parametrize("spec", ["c1:9,5", "c1,5", "", "a-b"])
def test_bad_ranges(spec):
    with pytest.raises(ValueError):
        filters.parse_range(spec)


def test_counts_of_missing_alleles(spark):
    df = spark.createDataFrame([("c", 1, 0, -1, -1), ("c", 1, 1, 0, 2)], "chrom string, pos long, sample_idx int, a1 int, a2 int")
    assert counts.allele_counts(df, ("chrom", "pos")).first()[2:4] == (3, 4)
    assert counts.allele_counts(df, ("chrom", "pos"), compat=False).first()[2:4] == (1, 2)


@pytest.mark.parametrize("spec, want", [("HLA-A*01:01:5,9", ("HLA-A*01:01", 5, 9)), ("c-2:5", ("c-2", 5, None)), ("c-2:", ("c-2", None, None)), ("HLA:a", ("HLA:a", None, None)), ("c1:-3", ("c1", -3, None))])
def test_ranges_of_odd_names(spec, want):
    assert filters.parse_range(spec) == want


def test_spans():
    assert filters.parse_span("HLA-A:9-5") == ("HLA-A", 5, 9)
    with pytest.raises(ValueError):
        filters.parse_span("c1:5")


def test_many_files_keep_their_order(spark, tmp_path):
    paths = []
    for i in range(64):
        paths.append(str(tmp_path / f"{(i * 37) % 64}.vcf"))
        with open(paths[-1], "w") as f:
            f.write("\n".join([HEADER, *(f"c1\t{p}\tf{i}\tA\tG\t.\t.\tNS=1;NS=2\tGT\t0/1\t0/0" for p in (2, 1))]) + "\n")
    lines = vcf.read_lines(spark, paths)
    rows = vcf.sites(lines).orderBy("site_id").collect()
    assert [(r.id, r.pos) for r in rows] == [(f"f{i}", p) for i in range(64) for p in (2, 1)]
    assert rows[0].info == {"NS": "1"} and rows[0].info_text == "NS=1;NS=2"
    assert lines._jdf.queryExecution().executedPlan().toString().count("Scan text") == 1
    with pytest.raises(ValueError):
        vcf.read_lines(spark, [paths[0], paths[0]])


def test_bcf_fields_come_back_typed(spark, tmp_path):
    head = HEADER.replace("##contig=<ID=c1>", '##INFO=<ID=AF,Number=A,Type=Float,Description="x">\n##INFO=<ID=SB,Number=.,Type=Integer,Description="x">\n##FORMAT=<ID=GL,Number=G,Type=Float,Description="x">\n##FORMAT=<ID=FT,Number=1,Type=String,Description="x">\n##contig=<ID=c1>')
    records = [
        "c1\t10\tr1\tA\tG\t29.7\tPASS\tNS=2;DB;AF=0.25;SB=1,70000,-3\tGT:AD:DP:GL:FT\t0|1:3,4:7:-0.5,-1.25,0:ok\t./.:.:.:.:.",
        "c1\t11\t.\tA\tC,T\t.\t.\tAF=0.5,1e-06\tGT:AD\t1|2:1,2,300\t0:5",
    ]
    (tmp_path / "a.vcf").write_text("\n".join([head, *records]) + "\n")
    lines = vcf.read_lines(spark, [str(tmp_path / "a.vcf")])
    sites = vcf.sites(lines)
    text = vcf.record_lines(sites, vcf.calls(sites, ["s1", "s2"]), gt_only=False)
    assert bcf.write_bcf(text, head, str(tmp_path / "o.bcf")) == 2
    got = [r.line for r in bcf.read_lines(spark, [str(tmp_path / "o.bcf")]).orderBy("offset").collect()]
    assert got == head.split("\n") + records
    types = bcf.field_types(head)
    body = bcf.record_bytes(records[0], {s: i for i, s in enumerate(bcf.dictionaries(head)[0])}, {"c1": 0}, types)
    assert struct.pack("<B3i", 3 << 4 | 3, 1, 70000, -3) in body and struct.pack("<Bf", 1 << 4 | 5, 0.25) in body


def test_blocks(tmp_path):
    import random

    from sitewise.sources import ordered_file

    raw = random.Random(1).randbytes(300_000)
    packed = ordered_file.blocks(raw) + ordered_file.block(b"")
    assert gzip.decompress(packed) == raw
    assert b"".join(ordered_file.unblocked(packed[i : i + 1000] for i in range(0, len(packed), 1000))) == raw
