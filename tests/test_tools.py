import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.functions import genotype as g
from sitewise.functions.expressions import compile_filter, to_sql
from sitewise.functions.query_format import format_records, parse
from sitewise.operators import bench, cohort, counts, filters, format_stats, ordered, plugins, setops, variants
from sitewise.sources import hashes, vcf


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(c, p, rng.randrange(3), p + rng.randrange(12), rng.randrange(5)) for c in "ab" for p in sorted(rng.sample(range(400), 60))]
    return spark.createDataFrame(data, "chrom string, pos long, v int, `end` long, sample_idx long").persist()


def result(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("width", [1, 7, 50, 1000])
@pytest.mark.parametrize("make", [
    lambda d, w: ordered.run_lengths(d, "v", ("chrom",), ("pos",), w), lambda d, w: ordered.run_ratio(d, "v", ("chrom",), ("pos",), w), lambda d, w: ordered.deltas(d, "v", ("chrom",), ("pos",), w),
    lambda d, w: ordered.infer_ends(d, ("chrom",), width=w), lambda d, w: ordered.end_exceptions(d, ("chrom",), width=w), lambda d, w: setops.near(d, 5, width=w),
    lambda d, w: plugins.without_overlaps(d, width=w), lambda d, w: plugins.scatter(d, 7, width=w), lambda d, w: plugins.reblock(d.withColumnRenamed("v", "dp"), F.col("dp"), width=w),
    lambda d, w: ordered.dictionary(d, "v", "pos", w), lambda d, w: ordered.valid_deltas(d, "v", "v > 0", width=w), lambda d, w: counts.row_zone_map(d, 9, width=w),
    lambda d, w: counts.near_duplicate_rows(d.select("chrom", "pos", F.concat_ws("-", "v").alias("row")).filter("chrom = 'a'"), 4, width=w), lambda d, w: variants.gap_free(d, width=w),
    lambda d, w: cohort.homozygous_runs(d.selectExpr("chrom", "pos", "0L AS sample_idx", "0L AS a1", "CAST(v > 1 AS BIGINT) AS a2"), 2, w),
])
def test_blocks_change_nothing(rows, make, width):
    assert result(make(rows, width)) == result(make(rows, None))


def test_sample_pairs_over_blocks(spark, monkeypatch):
    rng = random.Random(4)
    cells = [(p, s, rng.randrange(3)) for p in range(30) for s in range(11) if rng.random() < 0.8]
    monkeypatch.setattr(setops, "SAMPLE_BLOCK", 4)
    monkeypatch.setattr(setops, "SITE_BATCH", 3)
    df = spark.createDataFrame(cells, "pos long, sample_idx long, dosage int")
    got = {(r.s1, r.s2): (r.n, r.differ) for r in setops.concordance(df, ("pos",)).collect()}
    at = {(p, s): d for p, s, d in cells}
    want = {}
    for a, b in itertools.combinations(range(11), 2):
        both = [(at[p, a], at[p, b]) for p in range(30) if (p, a) in at and (p, b) in at]
        want[a, b] = (len(both), sum(x != y for x, y in both))
    assert got == want


def brute_pairs(cells):
    at = {(p, s): d for p, s, d in cells}
    out = {}
    for p in {p for p, *_ in cells}:
        for a, b in itertools.combinations(sorted(s for q, s, _ in cells if q == p), 2):
            n, differ = out.get((a, b), (0, 0))
            out[a, b] = n + 1, differ + (at[p, a] != at[p, b])
    return out


@pytest.mark.parametrize("dense", [0, float("inf")])
def test_few_calls_a_site(spark, monkeypatch, dense):
    """Sites that hold few of the samples, by matrices and by lists; no table of pairs is aggregated by row."""
    rng = random.Random(6)
    cells = [(p, s, rng.randrange(3)) for p in range(60) for s in rng.sample(range(-9, 40), rng.randrange(6))]
    monkeypatch.setattr(setops, "SAMPLE_BLOCK", 4)
    monkeypatch.setattr(setops, "DENSE", dense, raising=False)
    df = spark.createDataFrame(cells, "pos long, sample_idx int, dosage int")
    out = setops.concordance(df, ("pos",))
    assert out.dtypes == [("s1", "int"), ("s2", "int"), ("n", "bigint"), ("differ", "bigint")]
    assert not re.search(r"Aggregate.*keys=\[.*s1", out._jdf.queryExecution().toString())
    got = [(r.s1, r.s2, r.n, r.differ) for r in out.collect()]
    assert sorted(got) == sorted((*k, *v) for k, v in brute_pairs(cells).items())
    assert setops.concordance(df.limit(0), ("pos",)).count() == 0


@pytest.mark.parametrize("dense", [0, 0.3, 10])
def test_pair_counts_in_bounded_memory(monkeypatch, dense):
    """Lists given out early and tables add up to the same; listed sites hold no tables."""
    monkeypatch.setattr(setops, "PAIRS", 5)
    monkeypatch.setattr(setops, "HELD", 40)
    rng = random.Random(7)
    cells = [(p, s, rng.randrange(3)) for p in range(80) for s in sorted(rng.sample(range(8, 40), rng.randrange(1, 12)))]
    own, got = setops.PairCounts(2, 4, dense), {}

    def take(found):
        for pairs, n, differ in found:
            assert (pairs[1:] > pairs[:-1]).all()
            for k, *v in zip(pairs.tolist(), n.tolist(), differ.tolist()):
                pair = 8 + k // 4 % 4, k // 16 * 4 + k % 4
                got[pair] = tuple(a + b for a, b in zip(got.get(pair, (0, 0)), v))

    for lo in range(0, 80, 9):
        part = [[4 * s + d for q, s, d in cells if q == p] for p in range(lo, min(80, lo + 9))]
        take(own.add(np.array(sum(part, []), "i8"), np.cumsum([0, *map(len, part)])))
        assert own.held < 40 + 5 and (dense < 10 or not own.tables)
    take(own.rest())
    assert got == {k: v for k, v in brute_pairs(cells).items() if k[0] < 12}


def spelled(reference, pos, ref, alt):
    """The sequence with the allele in place; ``pos`` counts from 0."""
    assert reference[pos : pos + len(ref)] == ref
    return reference[:pos] + alt + reference[pos + len(ref) :]


def test_left_alignment(spark):
    rng = random.Random(5)
    reference = "".join(rng.choice("AC") for _ in range(256))
    sites = []
    for i in range(120):
        p = rng.randrange(30, 220)
        ref = reference[p : p + rng.randrange(1, 6)]
        alt = ref[0] + "".join(rng.choice("AC") for _ in range(rng.randrange(0, 5)))
        if alt != ref:
            sites.append((i, "c", p, ref, alt))
    sites.append((999, "c", 40, "G", "T"))
    df = spark.createDataFrame(sites, "no int, chrom string, pos long, ref string, alt string")
    chunks = spark.createDataFrame([("c", i, reference[i * 16 : i * 16 + 16]) for i in range(16)], "chrom string, chunk long, seq string")
    got = {r.no: r for r in variants.left_align(df, chunks, 16, reach=30).collect()}
    for no, _, p, ref, alt in sites[:-1]:
        r = got[no]
        assert spelled(reference, r.pos, r.ref, r.alt) == spelled(reference, p, ref, alt) and r.pos <= p + len(ref)
        assert r.ref[-1] != r.alt[-1] or min(len(r.ref), len(r.alt)) == 1  # no shared last letter is left
        if len(r.ref) != len(r.alt):
            assert len(r.ref) == 1 or len(r.alt) == 1 or r.ref[0] != r.alt[0]
    assert (got[999].pos, got[999].ref) == (40, "G")
    assert result(variants.check_reference(df.filter("no = 999"), chunks, 16)) == [("T", reference[40], "c", 999, 40, "G")]


def test_variant_keys(spark):
    df = spark.createDataFrame([("chrX", 193330, "GCA", "G"), ("1", 976157, "N" * 20, "A"), ("MT", 1, "a", "c")], "chrom string, pos long, ref string, alt string")
    keys = [r.k for r in df.select(variants.variant_key(*map(F.col, ("chrom", "pos", "ref", "alt"))).alias("k")).collect()]
    assert (keys[0] >> 59) & 31 == 23 and (keys[0] >> 31) & 0xFFFFFFF == 193329 and keys[0] & 0x7FFFFFFF == (3 << 27 | 1 << 23 | 0b10010010 << 15)
    assert keys[1] & 1 and (keys[1] >> 31) & 0xFFFFFFF == 976156 and (keys[2] >> 59) & 31 == 25


@pytest.mark.parametrize("spec", ["a]b", "[a", "[[x]]", "]["])
def test_bad_formats(spec):
    with pytest.raises(ValueError):
        parse(spec)


def test_formats(spark):
    sites = spark.createDataFrame([("c", 5, "x", "AT", "A,G", {"DP": "7"}), ("c", 9, None, "A", ".", {})], "chrom string, pos long, id string, ref string, alt string, info map<string,string>")
    cells = spark.createDataFrame([("c", 5, "s2", 0, 2, 8), ("c", 5, "s1", -1, 1, None)], "chrom string, pos long, sample string, a1 int, a2 int, dp int")
    got = [r.line for r in format_records(sites, r"%CHROM\t%END %ID %INFO/DP %TYPE[;%SAMPLE:%GT:%TGT:%DP]\n", cells, sample="sample").orderBy("pos").collect()]
    assert got == ["c\t6 x 7 indel;s1:./1:./A:.;s2:0/2:AT/G:8\n", "c\t9 . . ref\n"]
    with pytest.raises(ValueError):
        format_records(sites.drop("info"), "%NOPE")
    with pytest.raises(ValueError):
        format_records(sites, "[%GT]")


def test_functions_skip_nulls(spark):
    df = spark.createDataFrame([([1, None, 4], [[1, 5], [None, 2]], [2, 9])], "v array<int>, s array<array<int>>, ad array<int>")
    value = lambda text: df.select(F.expr(to_sql(text)).alias("x")).first().x
    assert value("MEDIAN(v)") == 2.5 and value("STDEV(v)") == 1.5 and value("AVG(v)") == 2.5 and value("COUNT(v)") == 2
    assert value("SMPL_MAX(s)") == [5, 2] and value("sMIN(s)") == [1, 2] and value("SMPL_SUM(s)") == [6.0, 2.0] and value("SMPL_MEDIAN(s)") == [3.0, 2.0] and value("SMPL_STDEV(s)") == [2.0, 0.0]
    assert value("BINOM(ad)") == pytest.approx(2 * (1 + 11 + 55) / 2**11)
    assert df.filter(compile_filter("MAX(SMPL_AVG(s))>2.5")).count() == 1


def test_codes(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    for x in (0, 1, -1, 63, -64, 64, 300, -(2**40), 2**55):
        code = g.varint_bytes(g.zigzag(F.lit(x)))
        assert one(g.unzigzag(g.varint_value(code))) == x and one(F.length(code) / 2) == one(g.varint_len(g.zigzag(F.lit(x))))
    assert one(g.varint_bytes(F.lit(300).cast("bigint"))) == "AC02"
    flags = [i % 3 == 0 for i in range(130)]
    words = one(g.bitmap(F.lit(flags)))
    assert [w & (2**64 - 1) for w in words] == [sum(1 << i for i, f in enumerate(flags[k : k + 64]) if f) for k in (0, 64, 128)]
    assert one(g.popcount(g.bitmap(F.lit(flags)))) == sum(flags)
    assert one(g.canonical_exponent(F.lit("1.00e+05"))) == "1.e+05"


def test_hashes(spark, tmp_path):
    import xxhash

    (tmp_path / "f").write_bytes(b"abc" * 1000)
    assert hashes.file_hashes(spark, [str(tmp_path / "f")]).first().xxh3 == xxhash.xxh3_64_hexdigest(b"abc" * 1000)
    line = "c\t1\t.\tA\tG\t.\t.\t{}\t{}\t{}\t{}"
    a = [(1, line.format("B=1;A=2", "GT:DP", "0/1:7", "1/1")), (2, "c\t2\t.\tA\tG\t.\t.\t.")]
    b = [(8, "c\t2\t.\tA\tG\t.\t.\t."), (9, line.format("A=2;B=1", "DP:GT", "7:0/1", ".:1/1"))]
    of = lambda rows: hashes.set_hash(spark.createDataFrame(rows, "site_id long, line string"))
    assert of(a) == of(b) != of(a[:1]) and of(a[:1] * 2) != of(a[:1])


def test_reports(spark, tmp_path):
    long = spark.createDataFrame([("d", "m", 1, 2.0), ("d", "m", 2, 3.0), ("e", "m", 1, 5.0)], "dataset string, metric string, day int, value double")
    t = bench.trend(long, ("dataset", "metric"), "day")
    bench.write_report(t, str(tmp_path / "r"), ("dataset", "metric"))
    assert "| d | m | 2 | 3 | 2 | 1 | 50 |" in (tmp_path / "r" / "report.md").read_text()
    assert (tmp_path / "r" / "trend.csv").read_text().splitlines()[2].startswith("e,m,1,5.0")
    history = "date,git,host,cpu,threads,compressor,dataset,mode,step,variants,elapsed_s,rss_kb,throughput_vps,metric_a,metric_b,notes\n2026-01-01,a,h,c,4,z,d,m,s,10,2.0,3,5.0,1.0,1.0,\n"
    (tmp_path / "h.csv").write_text(history)
    assert bench.read_history(spark, str(tmp_path / "h.csv")).first().elapsed_s == 2.0


def test_alert_limits(spark):
    rows = [("a", "elapsed_s", 10.1), ("b", "elapsed_s", 9.9), ("c", "rss_kb", 15.1), ("d", "rss_kb", 14.9), ("e", "throughput_vps", -10.1), ("f", "throughput_vps", -9.9), ("g", "metric_a", 5.1), ("h", "metric_a", 4.9), ("i", "throughput_vps", 50.0)]
    df = spark.createDataFrame(rows, "k string, metric string, delta_pct double")
    assert sorted(r.k for r in bench.alerts(df).collect()) == ["a", "c", "e", "g"]


def test_ploidy_check_raises(spark):
    df = spark.createDataFrame([([0, 1],), ([1],)], "gt array<int>")
    with pytest.raises(Exception, match="width"):
        filters.check_ploidy(df, 2).collect()
    assert filters.check_ploidy(df.limit(1), 2).count() == 1


def test_header_names():
    assert variants.rename_samples(["##x", "#CHROM\tP\t3\t4\t5\t6\t7\t8\t9\ta\tb"], {"a": "z"})[1].endswith("z\tb")
    for bad in ({"q": "z"}, {"a": "b"}):
        with pytest.raises(ValueError):
            variants.rename_samples(["#CHROM\tP\t3\t4\t5\t6\t7\t8\t9\ta\tb"], bad)


def test_sample_folders(spark, tmp_path):
    variants.write_samples(spark.createDataFrame([("s1", "c", 1), ("s2", "c", 1)], "sample string, chrom string, pos long"), str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").glob("sample=*")) == ["sample=s1", "sample=s2"]


def test_exact_tests():
    assert cohort.fisher(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert cohort.hardy_weinberg_exact(100, 0, 0) == (1.0, 1.0) and cohort.hardy_weinberg_exact(0, 0, 0) == (1.0, 1.0)
    p, more = cohort.hardy_weinberg_exact(10, 10, 10)
    assert p == pytest.approx((1024 + 252) / 184756) and more == pytest.approx(1024 / 184756)


def test_orphan_rows(spark):
    """A further-ALT row without its first is dropped by one operator and kept as it is by none other."""
    from sitewise.operators import reshape

    df = spark.createDataFrame([("c", 1, 1, "A,<N>"), ("c", 1, 2, "T,<M>"), ("c", 2, 2, "G,<M>")], "chrom string, pos long, alt_no long, split_alt string")
    assert sorted(r.pos for r in reshape.complete_sites(df, ("chrom", "pos")).collect()) == [1, 1]
    assert {r.pos: r.alt for r in reshape.merge_alleles(df, ("chrom", "pos")).collect()} == {1: "A,T", 2: "G"}


def test_gvcf_records(spark, tmp_path):
    text = "##INFO=<ID=END,Number=1,Type=Integer,Description=\"x\">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\nc\t1\t.\tA\t<NON_REF>\t.\t.\tEND=9\tGT:MIN_DP\t0/0:3\n"
    (tmp_path / "g.vcf").write_text(text)
    lines = vcf.read_lines(spark, [str(tmp_path / "g.vcf")])
    row = vcf.gvcf(vcf.sites(lines), vcf.sample_names(lines)).first()
    assert vcf.is_gvcf(lines) and (row.end_pos, row.min_dp, row.gt) == (9, 3, [0, 0])


def test_value_statistics_of_ties(spark):
    df = spark.createDataFrame([(x,) for x in (0, 0, 5, 7)], "x int")
    r = format_stats.distribution(df, F.col("x")).first()
    assert (r.n, r.median, r.zero_rate, r.below5_rate) == (4, 2.5, 0.5, 0.5) and r.std == pytest.approx(3.082207, abs=1e-6)
