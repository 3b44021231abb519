import gzip
import io
import struct
import sys

import pytest

from sitewise.cli import main
from tests.test_sources import HEADER, RECORDS


@pytest.fixture
def store(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("\n".join([HEADER, *RECORDS]) + "\n")
    main(["compress", "-i", str(tmp_path / "a.vcf"), "-o", str(tmp_path / "x")], spark)
    return tmp_path


def run(spark, store, *options):
    out = store / "o.vcf"
    main(["decompress", "-i", str(store / "x"), "-o", str(out), *options], spark)
    return [line for line in out.read_text().splitlines() if not line.startswith("##")]


def test_whole(spark, store):
    assert [line.split("\t")[1] for line in run(spark, store)[1:]] == ["10", "10", "12", "5"]


def test_query(spark, store):
    got = run(spark, store, "-r", "c1:10,11", "-s", "s2,s1", "--min-AC", "2", "-C")
    assert got[0].endswith("FORMAT\ts2\ts1")
    assert [x.split("\t")[7:] for x in got[1:]] == [["AN=4;AC=3", "GT", "./.", "0|1"], ["AN=4;AC=3", "GT", "2/0", "1|3"]]


def test_options(spark, store):
    assert [x.split("\t")[2] for x in run(spark, store, "-I", "ID=r4", "-G", "-H")] == ["r4"]
    assert len(run(spark, store, "-n", "2")) == 3
    assert [x.split("\t")[1] for x in run(spark, store, "--min-qual", "30", "-H")] == ["12"]
    with pytest.raises(ValueError):
        run(spark, store, "-s", "nobody")
    with pytest.raises(ValueError):
        run(spark, store, "-M")


def test_lossless_records_come_back_byte_by_byte(spark, tmp_path):
    odd = [
        "c1\t20\t.\tA\tG\t1e+02\tPASS\tNS=1;NS=2;DB\tGT:AD:DP:GQ:PL:XX\t0|1:3,4:7:99:0,5,60:a\t./.",
        "c1\t21\t.\tA\tG,T\t.\t.\t.\tGT:DP:AD\t0/1|2:07:1,.,3\t.:.:.", "c1\t22\t.\tA\t.\t0\tlow\tDB\tDP\t5\t.", "c1\t23\t.\tA\tG\t.\t.\t.\tGT:GT\t0/0:1/1\t1:.",
    ]
    head = HEADER.replace("##contig=<ID=c1>", '##FORMAT=<ID=XX,Number=1,Type=String,Description="x">\n##contig=<ID=c1>')
    text = "\n".join([head, *RECORDS, *odd]) + "\n"
    (tmp_path / "a.vcf").write_text(text)
    main(["compress", "-i", str(tmp_path / "a.vcf"), "-o", str(tmp_path / "x")], spark)
    main(["decompress", "-i", str(tmp_path / "x"), "-o", str(tmp_path / "o.vcf")], spark)
    assert (tmp_path / "o.vcf").read_text() == text
    main(["decompress", "-i", str(tmp_path / "x"), "-o", str(tmp_path / "o.vcf.gz"), "-l", "1"], spark)
    raw = (tmp_path / "o.vcf.gz").read_bytes()
    assert gzip.decompress(raw).decode() == text and raw[12:16] == b"BC\2\0" and raw.endswith(bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000"))


def test_gvcf_records_come_back(spark, tmp_path):
    head = HEADER.replace("\ts1\ts2", "\ts1").replace("##contig=<ID=c1>", '##INFO=<ID=END,Number=1,Type=Integer,Description="x">\n##contig=<ID=c1>')
    records = ["c1\t1\t.\tA\t<NON_REF>\t.\t.\tEND=9\tGT:DP:GQ:MIN_DP:PL\t0/0:30:60:28:0,60,900", "c1\t10\t.\tC\tG,<NON_REF>\t50.5\t.\tDB\tGT:AD:DP:GQ:PL\t0/1:5,6,0:11:99:150,0,140,160,170,300", "c-2\t3\t.\tA\t<NON_REF>\t.\t.\tEND=5\tGT:DP\t0/0:2"]
    text = "\n".join([head, *records]) + "\n"
    (tmp_path / "g.vcf").write_text(text)
    main(["gvcf", "-i", str(tmp_path / "g.vcf"), "-o", str(tmp_path / "x")], spark)
    main(["gvcf-decompress", "-i", str(tmp_path / "x"), "-o", str(tmp_path / "o.vcf")], spark)
    assert (tmp_path / "o.vcf").read_text() == text
    main(["gvcf-query", "-i", str(tmp_path / "x"), "-o", str(tmp_path / "q.vcf"), "-H", "-r", "c-2:9-1"], spark)
    assert (tmp_path / "q.vcf").read_text() == records[2] + "\n"
    with pytest.raises(ValueError, match="kind"):
        main(["decompress", "-i", str(tmp_path / "x"), "-o", str(tmp_path / "n.vcf")], spark)
    with pytest.raises(ValueError, match="one sample|not a gVCF"):
        (tmp_path / "a.vcf").write_text("\n".join([HEADER.replace("\ts1\ts2", "\ts1"), RECORDS[0].rpartition("\t")[0]]) + "\n")
        main(["gvcf", "-i", str(tmp_path / "a.vcf"), "-o", str(tmp_path / "y")], spark)


def test_files_and_their_headers_are_merged(spark, tmp_path, monkeypatch):
    names = []
    for i in (2, 0, 1):
        names.append(str(tmp_path / f"f {i}.vcf"))
        head = HEADER.replace("##contig=<ID=c1>", f'##INFO=<ID=K{i},Number=1,Type=Integer,Description="x">\n##contig=<ID=c1>')
        open(names[-1], "w").write("\n".join([head, RECORDS[0].replace("r1", f"k{i}").replace("NS=2", f"K{i}=7")]) + "\n")
    main(["compress", "-i", ",".join(names), "-o", str(tmp_path / "x")], spark)
    main(["decompress", "-i", str(tmp_path / "x"), "-f", "bcf", "-o", str(tmp_path / "o.bcf")], spark)
    main(["compress", "-b", "-i", f"{tmp_path}/o.bcf", "-o", str(tmp_path / "y")], spark)
    for store in "xy":
        main(["decompress", "-i", str(tmp_path / store), "-o", str(tmp_path / "o.vcf")], spark)
        lines = (tmp_path / "o.vcf").read_text().splitlines()
        assert [x.split("\t")[2] for x in lines if x[0] != "#"] == ["k2", "k0", "k1"]
        assert sum(x.startswith("##INFO=<ID=K") for x in lines) == 3 and sum(x.startswith("##contig") for x in lines) == 2
    with pytest.raises(ValueError, match="different samples"):
        (tmp_path / "z.vcf").write_text(HEADER.replace("s2", "s9") + "\n")
        main(["compress", "-i", f"{names[0]},{tmp_path}/z.vcf", "-o", str(tmp_path / "w")], spark)
    monkeypatch.setattr(sys, "stdin", type("S", (), {"buffer": io.BytesIO(open(names[1], "rb").read())}))
    monkeypatch.setattr("sitewise.sources.vcf.read_stdin", lambda spark, stream, f=__import__("sitewise.sources.vcf", fromlist=["x"]).read_stdin: f(spark, stream, f"file://{tmp_path}/spool"))
    main(["compress", "-i", "-", "-o", str(tmp_path / "s")], spark)
    assert spark.read.parquet(str(tmp_path / "s" / "sites")).count() == 1


def test_exports_keep_records_at_one_position_apart(spark, store):
    for kind in ("bed", "pgen", "bgen"):
        main(["decompress", "-i", str(store / "x"), "-f", kind, "-o", str(store / f"o.{kind}")], spark)
    assert (store / "o.bed").read_bytes()[3:] == bytes((2 | 1 << 2, 2 | 3 << 2, 3 | 1 << 2, 0 | 1 << 2))
    assert [x.split("\t")[1] for x in (store / "o.bim").read_text().splitlines()] == ["r1", "r2", ".", "r4"]
    assert (store / "o.fam").read_text() == "0 s1 0 0 0 -9\n0 s2 0 0 0 -9\n"
    assert struct.unpack_from("<IIB", (store / "o.pgen").read_bytes(), 3) == (3, 2, 0x40)
    assert (store / "o.pgen").read_bytes()[12:] == bytes((1 | 3 << 2, 0 | 3 << 2, 2 | 3 << 2))
    assert (store / "o.pvar").read_text().splitlines() == ["#CHROM\tPOS\tID\tREF\tALT", "c1\t10\tr1\tA\tG", "c1\t12\t.\tC\t.", "c-2\t5\tr4\tT\tA"]
    assert (store / "o.psam").read_text() == "#IID\ns1\ns2\n"
    assert struct.unpack_from("<IIII", (store / "o.bgen").read_bytes()) == (20, 20, 3, 2)


def test_unknown_contig(spark, store):
    assert [x.split("\t")[2] for x in run(spark, store, "-r", "c-2:5", "-H")] == ["r4"]
    with pytest.raises(ValueError, match="unknown chromosome"):
        run(spark, store, "-r", "c9:5")


def test_split_has_headers(spark, store):
    main(["decompress", "-i", str(store / "x"), "-S", "-o", str(store / "split")], spark)
    for chrom, n in (("c1", 3), ("c-2", 1)):
        lines = "".join(p.read_text() for p in sorted((store / "split" / f"chrom={chrom}").glob("part-*"))).splitlines()
        assert lines[: len(HEADER.splitlines())] == HEADER.splitlines() and len(lines) == len(HEADER.splitlines()) + n
