"""Registered queries of the cohort and site tools, each with its SQL for a second engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.adapter import DUCK_CALLS, DUCK_SITES, calls, sites, table
from sitewise.functions import genotype as g
from sitewise.functions.expressions import compile_filter
from sitewise.functions.query_format import format_records
from sitewise.operators import cohort, counts, filters, format_stats, ordered, setops, variants
from sitewise.plans.queries import KEYS, WIDTH, _pl, query

_OK = "(a1 >= 0 AND a2 >= 0)"
_DOS = "(CASE WHEN a1 = 1 THEN 1 ELSE 0 END + CASE WHEN a2 = 1 THEN 1 ELSE 0 END)"


# --- ploidy and presence ---------------------------------------------------


@query(DUCK_CALLS + ", g AS (SELECT sample_idx, chrom, pos, CASE WHEN ln % 2 = 0 THEN 1 ELSE 2 END AS p FROM calls WHERE a1 >= 0 AND (ln % 2 = 0 OR a2 >= 0)), r AS (SELECT *, CASE WHEN LAG(p) OVER (PARTITION BY sample_idx, chrom ORDER BY pos) = p THEN 0 ELSE 1 END AS n FROM g), k AS (SELECT *, SUM(n) OVER (PARTITION BY sample_idx, chrom ORDER BY pos) AS run FROM r)\nSELECT sample_idx, chrom, MIN(pos) AS start, MAX(pos) AS end_pos, MIN(p) AS ploidy FROM k GROUP BY sample_idx, chrom, run")
def ploidy_ranges(spark, sf_dir):
    gt = F.when(F.col("ln") % 2 == 0, F.array("a1")).otherwise(F.array("a1", "a2"))
    return cohort.ploidy_ranges(calls(spark, sf_dir).withColumn("gt", gt), WIDTH)


@query(DUCK_CALLS + "SELECT pos, sample_idx, CASE WHEN sample_idx % 2 = 1 AND pos <= 500 THEN CAST(a1 AS VARCHAR) WHEN sample_idx % 2 = 0 AND pos BETWEEN 400 AND 900 THEN concat_ws('/', a1, a2, a2) ELSE concat_ws('/', a1, a2) END AS gt FROM calls")
def fix_ploidy(spark, sf_dir):
    df = calls(spark, sf_dir).withColumn("gt", F.array("a1", "a2"))
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("chrom")).distinct()
    spans = F.explode(F.array(F.struct(F.lit(0).alias("start"), F.lit(500).alias("end"), F.lit("M").alias("sex"), F.lit(1).alias("ploidy")), F.struct(F.lit(400).alias("start"), F.lit(900).alias("end"), F.lit("F").alias("sex"), F.lit(3).alias("ploidy"))))
    rules = brands.select("chrom", spans.alias("r")).select("chrom", "r.*")
    sexes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample_idx"), F.when(F.col("s_suppkey") % 2 == 1, "M").otherwise("F").alias("sex"))
    return cohort.fix_ploidy(df, rules, sexes).select("pos", "sample_idx", F.array_join(F.col("gt").cast("array<string>"), "/").alias("gt"))


@query(DUCK_CALLS + f", c AS (SELECT pos // 50 AS bin, sample_idx, COUNT(*) AS n FROM calls WHERE {_OK} GROUP BY 1, 2), b AS (SELECT DISTINCT bin FROM c), s AS (SELECT CAST(UNNEST(range(1, 11)) AS BIGINT) AS sample_idx)\nSELECT bin, s.sample_idx FROM (SELECT * FROM b, s) s LEFT JOIN c USING (bin, sample_idx) WHERE COALESCE(n, 0) < 12")
def sparse_samples(spark, sf_dir):
    return cohort.sparse_samples(calls(spark, sf_dir), range(1, 11), F.floor(F.col("pos") / 50), 12)


_G = "concat_ws('/', LEAST(a1, a2), GREATEST(a1, a2))"


@query(DUCK_CALLS + f", x AS (SELECT pos, {_G} AS genotype, sample_idx = 1 AS inside, LEAST(a1, a2) AS low FROM calls), i AS (SELECT pos, MIN(genotype) AS genotype FROM x WHERE inside GROUP BY 1 HAVING COUNT(*) = 1 AND MIN(genotype) = MAX(genotype) AND MIN(low) >= 0)\nSELECT pos, genotype FROM i WHERE NOT EXISTS (SELECT 1 FROM x WHERE NOT inside AND x.pos = i.pos AND x.genotype = i.genotype)")
def exclusive_genotypes(spark, sf_dir):
    return cohort.exclusive_genotypes(calls(spark, sf_dir), (1,), ("pos",))


@query(DUCK_CALLS + "SELECT pos, sample_idx, CASE WHEN q % 4 = 0 AND q % 3 <> 0 AND a1 <> 1 AND a2 <> 1 THEN -1 ELSE a1 END AS a1, CASE WHEN q % 4 = 0 AND q % 3 <> 0 AND a1 <> 1 AND a2 <> 1 THEN -1 ELSE a2 END AS a2 FROM calls")
def keep_identical(spark, sf_dir):
    """The other set lacks cells with q divisible by 3, has alleles in the other order, and an allele 1 more where q is divisible by 4."""
    df = calls(spark, sf_dir)
    other = df.filter("q % 3 <> 0").withColumns({"a1": F.col("a2"), "a2": F.when((F.col("q") % 4 == 0) & (F.col("a1") != 1) & (F.col("a2") != 1), F.lit(1).cast("bigint")).otherwise(F.col("a1"))})
    return cohort.keep_identical(df, other, ("pos", "sample_idx")).select("pos", "sample_idx", "a1", "a2")


@query(DUCK_CALLS + ", x AS (SELECT pos, ln, MIN(sample_idx) AS sample_idx, COUNT(DISTINCT sample_idx) AS n FROM calls WHERE a1 > 0 OR a2 > 0 GROUP BY 1, 2)\nSELECT pos, ln, sample_idx FROM x WHERE n = 1")
def private_sites(spark, sf_dir):
    return cohort.private_sites(calls(spark, sf_dir), ("pos", "ln"))


@query(DUCK_CALLS + f"SELECT pos, ln FROM calls GROUP BY 1, 2 HAVING MAX(CASE WHEN {_OK} THEN 1 ELSE 0 END) = 0")
def uncalled_sites(spark, sf_dir):
    return cohort.uncalled_sites(calls(spark, sf_dir), ("pos", "ln"))


@query(DUCK_CALLS + f"SELECT sample_idx, least_dp, COUNT(*) AS n, COUNT(*) FILTER (a1 <> a2) AS het, COUNT(*) FILTER (a1 = a2 AND a1 > 0) AS hom_alt FROM calls, (VALUES (0), (10), (30)) t(least_dp) WHERE {_OK} AND dp >= least_dp GROUP BY 1, 2")
def sample_thresholds(spark, sf_dir):
    return cohort.sample_thresholds(calls(spark, sf_dir), (0, 10, 30))


@query(DUCK_CALLS + "SELECT * FROM (SELECT chrom, pos, sample_idx, dp FROM calls) WHERE sample_idx IN (SELECT DISTINCT sample_idx FROM calls ORDER BY 1 LIMIT 3)")
def first_samples(spark, sf_dir):
    return filters.first_samples(calls(spark, sf_dir), 3).select("chrom", "pos", "sample_idx", "dp")


@query()
def chosen_samples(spark, sf_dir):
    return filters.sample_names(calls(spark, sf_dir), 5)


@query()
def random_ranges(spark, sf_dir):
    return filters.random_ranges(sites(spark, sf_dir), 20, (1000, 10_000, 100_000))


# --- trios -----------------------------------------------------------------

_TRIO = ", t AS (SELECT t.mother, t.father, t.child, c.chrom, c.pos, c.a1 AS c1, c.a2 AS c2, m.a1 AS m1, m.a2 AS m2, f.a1 AS f1, f.a2 AS f2 FROM (VALUES (2, 3, 1), (5, 6, 4)) t(mother, father, child) JOIN calls c ON c.sample_idx = t.child JOIN calls m ON m.sample_idx = t.mother AND m.pos = c.pos JOIN calls f ON f.sample_idx = t.father AND f.pos = c.pos WHERE LEAST(c.a1, c.a2, m.a1, m.a2, f.a1, f.a2) >= 0)"
_FITS = "((c1 IN (m1, m2) AND c2 IN (f1, f2)) OR (c2 IN (m1, m2) AND c1 IN (f1, f2)))"
_HET = lambda w: f"({w}1 <> {w}2 AND LEAST({w}1, {w}2) = 0)"
_REF = lambda w: f"({w}1 = 0 AND {w}2 = 0)"


def _trios(spark):
    return spark.sql("SELECT * FROM VALUES (2L, 3L, 1L), (5L, 6L, 4L) AS t(mother, father, child)")


@query(DUCK_CALLS + _TRIO + f"\nSELECT mother, father, child, COUNT(*) AS n, COUNT(*) FILTER (GREATEST(c1, c2, m1, m2, f1, f2) > 0) AS non_ref, COUNT(*) FILTER (NOT {_FITS}) AS errors, COUNT(*) FILTER (c1 NOT IN (m1, m2, f1, f2) OR c2 NOT IN (m1, m2, f1, f2)) AS novel, COUNT(*) FILTER ((({_HET('m')} AND {_REF('f')}) OR ({_HET('f')} AND {_REF('m')})) AND {_HET('c')}) AS transmitted, COUNT(*) FILTER ((({_HET('m')} AND {_REF('f')}) OR ({_HET('f')} AND {_REF('m')})) AND {_REF('c')}) AS untransmitted FROM t GROUP BY 1, 2, 3")
def trio_statistics(spark, sf_dir):
    return cohort.trio_statistics(calls(spark, sf_dir), _trios(spark), KEYS)


@query(DUCK_CALLS + _TRIO + f", d AS (SELECT DISTINCT mother, father, child, chrom, pos, UNNEST([c1, c2]) AS allele, m1, m2, f1, f2 FROM t WHERE NOT {_FITS})\nSELECT mother, father, child, chrom, pos, allele FROM d WHERE allele > 0 AND allele NOT IN (m1, m2, f1, f2)")
def de_novo(spark, sf_dir):
    return cohort.de_novo(calls(spark, sf_dir), _trios(spark), KEYS)


@query(DUCK_CALLS + _TRIO + ", h AS (SELECT *, GREATEST(c1, c2) IN (m1, m2) AS m, GREATEST(c1, c2) IN (f1, f2) AS f FROM t WHERE c1 <> c2 AND LEAST(c1, c2) = 0)\nSELECT mother, father, child, COUNT(*) AS het, COUNT(*) FILTER (m AND NOT f) AS maternal, COUNT(*) FILTER (f AND NOT m) AS paternal FROM h GROUP BY 1, 2, 3")
def parental_origin(spark, sf_dir):
    return cohort.parental_origin(calls(spark, sf_dir), _trios(spark), KEYS)


@query(DUCK_CALLS + _TRIO + ", o AS (SELECT *, c1 IN (m1, m2) AND c2 IN (f1, f2) AS one, c2 IN (m1, m2) AND c1 IN (f1, f2) AS two FROM t WHERE c1 <> c2), s AS (SELECT *, LAG(two) OVER (PARTITION BY child, chrom ORDER BY pos) AS b FROM o WHERE one <> two)\nSELECT mother, father, child, COUNT(*) AS phased, COUNT(*) FILTER (b IS NOT NULL AND b <> two) AS switches FROM s GROUP BY 1, 2, 3")
def trio_switches(spark, sf_dir):
    return cohort.trio_switches(calls(spark, sf_dir), _trios(spark), WIDTH)


# --- tests and likelihoods -------------------------------------------------

_CHOOSE = lambda n, k: f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"
_LP = lambda k: f"({_CHOOSE('(n11 + n12)', k)} + {_CHOOSE('(n21 + n22)', f'(n11 + n21 - {k})')} - {_CHOOSE('(n11 + n12 + n21 + n22)', '(n11 + n21)')})"


@query(DUCK_CALLS + f", p AS (SELECT a.sample_idx AS sample, b.sample_idx AS control, a.chrom, a.pos, a.ad0 + 1 AS n11, a.ad1 + 1 AS n12, b.ad0 + 1 AS n21, b.ad1 + 1 AS n22 FROM calls a JOIN calls b ON a.pos = b.pos WHERE a.sample_idx = 1 AND b.sample_idx IN (2, 3, 4))\nSELECT sample, control, chrom, pos, n11, n12, n21, n22, ROUND(LEAST(1.0, list_sum(list_transform(range(GREATEST(0, n11 - n22), LEAST(n11 + n12, n11 + n21) + 1), lambda k: CASE WHEN {_LP('k')} <= {_LP('n11')} + 1e-7 THEN exp({_LP('k')}) ELSE 0.0 END))), 5) AS p FROM p WHERE GREATEST(n11 + n12, n21 + n22) >= 12")
def allele_depth_bias(spark, sf_dir):
    pairs = spark.sql("SELECT * FROM VALUES (1L, 2L), (1L, 3L), (1L, 4L) AS t(sample, control)")
    df = calls(spark, sf_dir).withColumns({"ad0": F.col("ad0") + 1, "ad1": F.col("ad1") + 1})
    return cohort.allele_depth_bias(df, pairs, KEYS, least=12).withColumn("p", F.round("p", 5))


@query(DUCK_CALLS + ", e AS (SELECT chrom, pos, power(10.0, -pl0 / 10.0) AS x, power(10.0, -pl1 / 10.0) AS y, power(10.0, -pl2 / 10.0) AS z FROM calls), d AS (SELECT chrom, pos, (y + 2 * z) / (x + y + z) AS m, (y + 4 * z) / (x + y + z) AS s FROM e), s AS (SELECT chrom, pos, COUNT(*) AS n, SUM(m) AS e, SUM(m * m) AS e2, SUM(s) AS f FROM d GROUP BY 1, 2)\nSELECT chrom, pos, n, ROUND(CASE WHEN e > 0 AND e < 2 * n THEN 1 - (f - e2) / (2 * n * (e / (2 * n)) * (1 - e / (2 * n))) ELSE 1.0 END, 5) AS info FROM s")
def imputation_score(spark, sf_dir):
    like = {f"p{i}": F.pow(F.lit(10.0), -F.col(f"pl{i}") / 10.0) for i in range(3)}
    return cohort.imputation_score(calls(spark, sf_dir).withColumns(like), KEYS)


@query(DUCK_CALLS + ", f AS (SELECT chrom, pos, ROUND(SUM((a1 > 0)::INT + (a2 > 0)::INT) / NULLIF(CAST(SUM((a1 >= 0)::INT + (a2 >= 0)::INT) AS DOUBLE), 0), 6) AS p FROM calls GROUP BY 1, 2), l AS (SELECT sample_idx, p, power(10.0, -pl0 / 10.0) AS x, power(10.0, -pl1 / 10.0) AS y, power(10.0, -pl2 / 10.0) AS z FROM calls JOIN f USING (chrom, pos) WHERE p IS NOT NULL), s AS (SELECT sample_idx, COUNT(*) AS n, ROUND(AVG(log10(GREATEST(x * (1 - p) + z * p, 1e-3))), 5) AS haploid, ROUND(AVG(log10(GREATEST(x * (1 - p) * (1 - p) + 2 * y * p * (1 - p) + z * p * p, 1e-3))), 5) AS diploid FROM l GROUP BY 1)\nSELECT *, CASE WHEN haploid > diploid THEN 1 ELSE 2 END AS guess FROM s")
def guess_ploidy(spark, sf_dir):
    return cohort.guess_ploidy(calls(spark, sf_dir))


_W = lambda h: f"({h} * ln(2.0) - lgamma({h} + 1.0) - lgamma((r - {h}) / 2 + 1.0) - lgamma(ns - {h} - (r - {h}) / 2 + 1.0))"
_NS = f"SUM(CASE WHEN {_OK} THEN 1 ELSE 0 END)"
_TAC = f"SUM(CASE WHEN {_OK} THEN (CASE WHEN a1 > 0 THEN 1 ELSE 0 END) + (CASE WHEN a2 > 0 THEN 1 ELSE 0 END) ELSE 0 END)"
_TH = f"SUM(CASE WHEN {_OK} AND (a1 > 0) <> (a2 > 0) THEN 1 ELSE 0 END)"


@query(DUCK_CALLS + f", t AS (SELECT chrom, pos, CAST({_NS} AS BIGINT) AS ns, CAST({_TAC} AS BIGINT) AS ac, CAST({_TH} AS BIGINT) AS het FROM calls GROUP BY 1, 2), u AS (SELECT *, LEAST(ac, 2 * ns - ac) AS r FROM t), w AS (SELECT *, list_transform(range(r % 2, r + 1, 2), lambda h: exp({_W('h')} - {_W('het')})) AS p, range(r % 2, r + 1, 2) AS hs FROM u)\nSELECT chrom, pos, CASE WHEN ns = 0 OR r = 0 THEN 1.0 ELSE ROUND(LEAST(1.0, list_sum(list_filter(p, lambda x: x <= 1 + 1e-9)) / list_sum(p)), 5) END AS hwe, CASE WHEN ns = 0 OR r = 0 THEN 1.0 ELSE ROUND(LEAST(1.0, list_sum(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN hs[i] >= het THEN p[i] ELSE 0.0 END)) / list_sum(p)), 5) END AS exc_het FROM w")
def excess_heterozygosity(spark, sf_dir):
    tags = cohort.excess_heterozygosity(setops.site_tags(calls(spark, sf_dir), KEYS))
    return tags.select("chrom", "pos", F.round("hwe", 5).alias("hwe"), F.round("exc_het", 5).alias("exc_het"))


@query(DUCK_CALLS + f", d AS (SELECT chrom, pos, sample_idx, CAST({_DOS} AS DOUBLE) AS d FROM calls WHERE {_OK}), p AS (SELECT a.chrom, a.pos AS pos_a, b.pos AS pos_b, COUNT(*) AS n, covar_pop(a.d, b.d) AS c, var_pop(a.d) AS vx, var_pop(b.d) AS vy FROM d a JOIN d b ON a.chrom = b.chrom AND a.sample_idx = b.sample_idx AND b.pos > a.pos AND b.pos - a.pos <= 60 GROUP BY 1, 2, 3)\nSELECT chrom, pos_a, pos_b, n, ROUND(c * c / (vx * vy), 6) AS r2 FROM p WHERE vx > 0 AND vy > 0")
def linkage(spark, sf_dir):
    df = calls(spark, sf_dir).withColumn("dosage", g.dosage(F.col("a1"), F.col("a2"))).filter("dosage IS NOT NULL")
    return cohort.linkage(df, 60)


@query(DUCK_SITES + "SELECT chrom, pos FROM sites QUALIFY ROW_NUMBER() OVER (PARTITION BY chrom, pos // 200 ORDER BY CASE WHEN alt = '.' THEN 1 ELSE 0 END, pos) <= 2")
def prune_sites(spark, sf_dir):
    return cohort.prune(sites(spark, sf_dir), 200, 2, (F.when(F.col("alt") == ".", 1).otherwise(0), F.col("pos"))).select("chrom", "pos")


@query(DUCK_CALLS + f", s AS (SELECT sample_idx, chrom, pos, a1 = a2 AS h FROM calls WHERE {_OK}), r AS (SELECT *, CASE WHEN LAG(h) OVER (PARTITION BY sample_idx, chrom ORDER BY pos) = h THEN 0 ELSE 1 END AS n FROM s), k AS (SELECT *, SUM(n) OVER (PARTITION BY sample_idx, chrom ORDER BY pos) AS run FROM r)\nSELECT sample_idx, chrom, MIN(pos) AS start, MAX(pos) AS end_pos, COUNT(*) AS n FROM k WHERE h GROUP BY sample_idx, chrom, run HAVING COUNT(*) >= 3")
def homozygous_runs(spark, sf_dir):
    return cohort.homozygous_runs(calls(spark, sf_dir), 3, WIDTH)


@query(DUCK_CALLS + f", t AS (SELECT chrom, pos, sample_idx % 3 AS \"group\", CAST({_NS} AS BIGINT) AS ns, CAST({_TAC} AS BIGINT) AS ac FROM calls GROUP BY 1, 2, 3)\nSELECT chrom, pos, \"group\", ns, 2 * ns AS an, ac FROM t")
def group_tags(spark, sf_dir):
    return setops.group_tags(calls(spark, sf_dir), KEYS, F.col("sample_idx") % 3).select("chrom", "pos", "group", "ns", "an", "ac")


# --- sites -----------------------------------------------------------------

#: Sites with indels: REF and ALT follow from the position.
_INDELS = {
    "chrom": "p_brand", "pos": "p_partkey", "ref": "CASE WHEN p_partkey % 4 = 0 THEN 'ACG' ELSE substring('ACGT', p_partkey % 4 + 1, 1) END",
    "alt": "CASE WHEN p_partkey % 3 = 0 THEN 'A' WHEN p_partkey % 3 = 1 THEN 'ACGTT,T' WHEN p_size % 5 = 0 THEN '.' ELSE 'AC' END", "qual": "CASE WHEN p_size % 7 = 0 THEN '.' ELSE CAST(p_partkey * 7 % 50 AS STRING) END",
    "filter": "CASE WHEN p_size % 3 = 0 THEN '.' WHEN p_size % 3 = 1 THEN 'PASS' ELSE 'q10' END",
}
_DUCK_INDELS = "x AS (SELECT " + ", ".join(f"{e.replace('AS STRING', 'AS VARCHAR')} AS {k}" for k, e in _INDELS.items()) + " FROM part)\n"


def _indels(spark, sf_dir):
    return table(spark, sf_dir, "part").select(*(F.expr(e).alias(k) for k, e in _INDELS.items()))


_FIRST = "split_part(alt, ',', 1)"


@query(DUCK_CALLS + f", {_DUCK_INDELS}, l AS (SELECT chrom, pos, CAST(GREATEST(-20, LEAST(20, length({_FIRST}) - length(ref))) AS BIGINT) AS length FROM x WHERE alt <> '.' AND length({_FIRST}) <> length(ref)), c AS (SELECT l.length, a1, a2, ad0, ad1 FROM l JOIN calls c ON l.pos = c.pos WHERE {_OK} AND (a1 = 1 OR a2 = 1)), s AS (SELECT length, COUNT(*) AS sites FROM l GROUP BY 1)\nSELECT length, sites, COALESCE(het, 0) AS het, COALESCE(hom, 0) AS hom, mean_alt_share FROM s LEFT JOIN (SELECT length, COUNT(*) FILTER (a1 <> a2) AS het, COUNT(*) FILTER (a1 = a2) AS hom, ROUND(AVG(CASE WHEN a1 <> a2 AND ad0 + ad1 > 0 THEN ad1 / (ad0 + ad1) END), 6) AS mean_alt_share FROM c GROUP BY 1) USING (length)")
def indel_statistics(spark, sf_dir):
    return cohort.indel_statistics(calls(spark, sf_dir), _indels(spark, sf_dir), KEYS)


_BASE = lambda i: f"(instr('ACGT', substr(b, {i}, 1)) - 1)"


@query("WITH s AS (SELECT p_partkey + 1 AS pos, CAST(p_size % 25 + 1 AS VARCHAR) AS chrom, substring('ACGT', p_size % 4 + 1, 1) AS ref, UNNEST(CASE WHEN p_size % 3 = 0 THEN ['A'] ELSE ['C', 'TT'] END) AS alt FROM part), d AS (SELECT *, ref || alt AS b FROM s), k AS (SELECT *, CAST(length(ref) * 134217728 + length(alt) * 8388608 + CASE WHEN length(b) = 2 THEN (" + f"{_BASE(1)} * 4 + {_BASE(2)}) * 262144 ELSE ({_BASE(1)} * 16 + {_BASE(2)} * 4 + {_BASE(3)}) * 65536 END * 2 AS HUGEINT) + CAST(pos - 1 AS HUGEINT) * 2147483648 + CAST(chrom AS HUGEINT) * 576460752303423488 AS k FROM d)\nSELECT pos, alt, format('{{:08x}}{{:08x}}', CAST(k // 4294967296 AS BIGINT), CAST(k % 4294967296 AS BIGINT)) AS key FROM k")
def variant_key(spark, sf_dir):
    df = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("pos"), (F.col("p_size") % 25 + 1).cast("string").alias("chrom"), F.expr("substring('ACGT', p_size % 4 + 1, 1)").alias("ref"), F.explode(F.expr("CASE WHEN p_size % 3 = 0 THEN array('A') ELSE array('C', 'TT') END")).alias("alt"))
    return df.select("pos", "alt", variants.hex_key(variants.variant_key(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt"))).alias("key"))


_CSQ = "concat(p_brand, '|', p_type, '|', CAST(p_size AS STRING), ',', p_name, '|', CASE WHEN p_size % 2 = 0 THEN 'stop' ELSE 'intron' END)"
_DUCK_CSQ = "WITH s AS (SELECT p_partkey AS pos, string_split(" + _CSQ.replace("STRING", "VARCHAR") + ", ',') AS e FROM part), x AS (SELECT pos, UNNEST(e) AS e, UNNEST(range(len(e))) AS no FROM s)"


@query(_DUCK_CSQ + " SELECT pos, CAST(no AS INT) AS no, split_part(e, '|', 1) AS gene, split_part(e, '|', 2) AS consequence, split_part(e, '|', 3) AS score FROM x")
def split_annotation(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.expr(_CSQ).alias("csq"))
    return variants.split_annotation(df, "csq", ("gene", "consequence", "score"), ("pos",))


@query(_DUCK_CSQ + ", r AS (SELECT pos, CAST(no AS INT) AS no, split_part(e, '|', 1) AS gene, split_part(e, '|', 2) AS consequence, CASE split_part(e, '|', 2) WHEN 'intron' THEN 1 WHEN 'stop' THEN 2 ELSE 0 END AS k FROM x) SELECT pos, no, gene, consequence FROM r QUALIFY ROW_NUMBER() OVER (PARTITION BY pos ORDER BY k DESC, no) = 1")
def worst_annotation(spark, sf_dir):
    return variants.worst_annotation(split_annotation(spark, sf_dir).drop("score"), ("pos",), "consequence", ("intron", "stop"))


@query("WITH " + _DUCK_INDELS + ", a AS (SELECT chrom, pos, ref, UNNEST(string_split(alt, ',')) AS a, UNNEST(range(1, len(string_split(alt, ',')) + 1)) AS alt_no FROM x WHERE alt <> '.'), n AS (SELECT *, length(a) - length(ref) AS s FROM a WHERE length(a) <> length(ref)), e AS (SELECT p_brand AS chrom, p_partkey AS start, p_partkey + 7 AS \"end\" FROM part WHERE p_size % 5 = 0), m AS (SELECT n.chrom, n.pos, alt_no, e.start, CASE WHEN s > 0 THEN CASE WHEN e.end > pos THEN s ELSE 0 END ELSE GREATEST(LEAST(pos - s, e.end) - GREATEST(pos + 1, e.start) + 1, 0) END AS k FROM n JOIN e ON n.chrom = e.chrom AND n.pos <= e.end AND e.start <= n.pos + GREATEST(0, -s)), f AS (SELECT chrom, pos, alt_no, arg_min(k, start) AS k FROM m GROUP BY 1, 2, 3)\nSELECT chrom, pos, alt_no, CASE WHEN k % 3 <> 0 THEN 1 ELSE 0 END AS oof FROM f WHERE k > 0")
def frame_shifts(spark, sf_dir):
    exons = table(spark, sf_dir, "part").filter("p_size % 5 = 0").selectExpr("p_brand AS chrom", "p_partkey AS start", "p_partkey + 7 AS end")
    return variants.frame_shifts(_indels(spark, sf_dir), exons, 64)


def _chunks(spark, sf_dir):
    """A reference with A, C, G, T in turn: position p has the letter p % 4."""
    spans = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("chrom")).agg(F.max("p_partkey").alias("m"))
    return spans.select("chrom", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("m") / 64) + 1)).alias("chunk"), F.lit("ACGT" * 16).alias("seq"))


_REFERENCE = "substring('ACGTACG', CAST(pos % 4 + 1 AS INT), length(ref))"


@query("WITH " + _DUCK_INDELS + f", y AS (SELECT chrom, pos, CASE WHEN pos % 8 = 0 THEN 'ACT' ELSE ref END AS ref FROM x) SELECT chrom, pos, ref, {_REFERENCE} AS bases FROM y WHERE ref <> {_REFERENCE}")
def check_reference(spark, sf_dir):
    df = _indels(spark, sf_dir).withColumn("ref", F.expr("CASE WHEN pos % 8 = 0 THEN 'ACT' ELSE ref END"))
    return variants.check_reference(df.select("chrom", "pos", "ref"), _chunks(spark, sf_dir), 64)


@query("WITH " + _DUCK_INDELS + f"SELECT chrom, pos, {_REFERENCE.replace('length(ref)', 'CAST(pos % 3 + 1 AS INT)')} AS ref FROM x")
def fill_reference(spark, sf_dir):
    df = _indels(spark, sf_dir).select("chrom", "pos", F.expr("repeat('N', cast(pos % 3 + 1 as int))").alias("ref"))
    return variants.fill_reference(df, _chunks(spark, sf_dir), 64).select("chrom", "pos", "ref")


@query("WITH " + _DUCK_INDELS + "SELECT chrom, pos, CASE WHEN TRY_CAST(qual AS DOUBLE) < 20 THEN CASE WHEN filter IN ('.', 'PASS') THEN 'LowQual' ELSE filter || ';LowQual' END WHEN filter IN ('.', 'PASS') THEN 'PASS' ELSE filter END AS filter FROM x")
def soft_filter(spark, sf_dir):
    return variants.soft_filter(_indels(spark, sf_dir), compile_filter("QUAL<20"), "LowQual").select("chrom", "pos", "filter")


@query("WITH " + _DUCK_INDELS + ", i AS (SELECT chrom, pos, pos + length(ref) - 1 AS e, COALESCE(TRY_CAST(qual AS DOUBLE), -1) AS q FROM x WHERE alt <> '.' AND len(list_filter(string_split(alt, ','), lambda a: length(a) <> length(ref))) > 0), r AS (SELECT *, CASE WHEN pos > MAX(e) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 40 OR LAG(pos) OVER (PARTITION BY chrom ORDER BY pos) IS NULL THEN 1 ELSE 0 END AS n FROM i), k AS (SELECT *, SUM(n) OVER (PARTITION BY chrom ORDER BY pos) AS k FROM r)\nSELECT chrom, pos FROM k QUALIFY ROW_NUMBER() OVER (PARTITION BY chrom, k ORDER BY q DESC, pos) > 1")
def indel_gap(spark, sf_dir):
    return variants.indel_gap(_indels(spark, sf_dir), 40, WIDTH).select("chrom", "pos")


_EACH = "WITH " + _DUCK_INDELS + ", a AS (SELECT chrom, pos, ref, qual, UNNEST(string_split(alt, ',')) AS a FROM x)"
_SNP = "(length(a) = 1 AND length(ref) = 1 AND a <> '.' AND a <> ref)"


@query(_EACH + f", s AS (SELECT COUNT(*) FILTER (ref || a IN ('AG', 'GA', 'CT', 'TC')) AS ts, COUNT(*) FILTER (ref || a NOT IN ('AG', 'GA', 'CT', 'TC')) AS tv FROM a WHERE {_SNP}) SELECT ts, tv, ROUND(ts / NULLIF(CAST(tv AS DOUBLE), 0), 4) AS ts_tv FROM s")
def substitution_counts(spark, sf_dir):
    return variants.substitution_counts(_indels(spark, sf_dir))


@query(_EACH + " SELECT length(a) - length(ref) AS length, COUNT(*) AS n FROM a WHERE a <> '.' AND length(a) <> length(ref) GROUP BY 1")
def indel_lengths(spark, sf_dir):
    return variants.indel_lengths(_indels(spark, sf_dir))


@query("WITH " + _DUCK_INDELS + f"SELECT COALESCE(CAST(FLOOR(TRY_CAST(qual AS DOUBLE)) AS BIGINT), -1) AS qual, COUNT(*) AS n, COUNT(*) FILTER (alt <> '.' AND length({_FIRST}) = length(ref) AND length(ref) = 1) AS snps, COUNT(*) FILTER (alt <> '.' AND length({_FIRST}) <> length(ref)) AS indels FROM x GROUP BY 1")
def quality_histogram(spark, sf_dir):
    return variants.quality_histogram(_indels(spark, sf_dir))


@query("WITH " + _DUCK_INDELS + "SELECT chrom, pos FROM x WHERE alt <> '.' AND len(list_filter(string_split(alt, ','), lambda a: length(a) = length(ref))) > 0")
def of_types(spark, sf_dir):
    return variants.of_types(_indels(spark, sf_dir), "snp", "mnp").select("chrom", "pos")


@query("WITH " + _DUCK_INDELS + "SELECT chrom, pos FROM x WHERE EXISTS (SELECT 1 FROM part r WHERE r.p_brand = x.chrom AND r.p_size % 9 = 0 AND x.pos BETWEEN r.p_partkey AND r.p_partkey + 30)")
def in_regions(spark, sf_dir):
    regions = table(spark, sf_dir, "part").filter("p_size % 9 = 0").selectExpr("p_brand AS chrom", "p_partkey AS start", "p_partkey + 30 AS end")
    return variants.in_regions(_indels(spark, sf_dir), regions, 64).select("chrom", "pos")


_A, _B = "['G', 'T']", "CASE WHEN p_size % 2 = 0 THEN ['C', 'G'] ELSE ['T'] END"


@query(f"WITH s AS (SELECT p_partkey AS pos, p_size, {_A} AS a, {_B} AS b FROM part), u AS (SELECT pos, a, b, list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))) AS alts FROM s) SELECT pos, array_to_string(alts, ',') AS alts, 0 AS file_no, '0,2' AS gt FROM u UNION ALL SELECT pos, array_to_string(alts, ','), 1, CAST(list_position(alts, b[1]) AS VARCHAR) || ',' || CAST(list_position(alts, b[len(b)]) AS VARCHAR) FROM u")
def merge_alleles_of(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("pos", F.col("p_partkey"))
    one = part.select("pos", F.array(F.lit("G"), F.lit("T")).alias("alts"), F.array(F.lit(0), F.lit(2)).alias("gt"))
    alts = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("C"), F.lit("G"))).otherwise(F.array(F.lit("T")))
    two = part.select("pos", alts.alias("alts")).withColumn("gt", F.array(F.lit(1), F.size("alts")))
    out = variants.merge_alleles_of((one, two), ("pos",))
    return out.select("pos", F.array_join("alts", ",").alias("alts"), "file_no", F.array_join(F.col("gt").cast("array<string>"), ",").alias("gt"))


@query(DUCK_SITES + "SELECT chrom, pos, chrom || ':' || CAST(pos AS VARCHAR) || '_' || ref || '_' || alt || ' ' || CAST(pos AS VARCHAR) || ' ' || ref || ' ' || alt AS line FROM sites WHERE alt NOT LIKE '%<%' AND alt NOT LIKE '%,%' AND alt <> '.'")
def legend_lines(spark, sf_dir):
    return variants.legend_lines(sites(spark, sf_dir))


_HAP = lambda c: f"CASE WHEN {c} < 0 THEN '?' WHEN {c} > 0 THEN '1' ELSE '0' END"


@query(DUCK_CALLS + f"SELECT chrom, pos, string_agg({_HAP('a1')} || ' ' || {_HAP('a2')}, ' ' ORDER BY sample_idx) AS line FROM calls GROUP BY 1, 2")
def haplotype_lines(spark, sf_dir):
    return variants.haplotype_lines(calls(spark, sf_dir), KEYS)


@query(DUCK_CALLS + "SELECT pos, sample_idx, concat_ws(',', pl0 - LEAST(pl0, pl1, pl2), pl1 - LEAST(pl0, pl1, pl2), pl2 - LEAST(pl0, pl1, pl2)) AS pl, ROUND(-pl1 / 10.0, 4) AS gl1 FROM calls WHERE GREATEST(pl0, pl1, pl2) - LEAST(pl0, pl1, pl2) < 290")
def tag_conversions(spark, sf_dir):
    """Likelihoods to probabilities and back: the phred scale again, the least 0."""
    from sitewise.operators import plugins

    df = _pl(calls(spark, sf_dir)).filter("greatest(pl0, pl1, pl2) - least(pl0, pl1, pl2) < 290")
    back = variants.probabilities_to_pl(plugins.pl_to_probabilities(F.col("pl")))
    return df.select("pos", "sample_idx", F.array_join(back.cast("array<string>"), ",").alias("pl"), F.round(F.get(variants.pl_to_gl(F.col("pl")), F.lit(1)), 4).alias("gl1"))


@query(DUCK_SITES + "SELECT chrom, pos, chrom || chr(9) || CAST(pos - 1 AS VARCHAR) || ' ' || id || ' ' || split_part(alt, ',', 1) || '/' || CASE WHEN alt = '.' THEN '0' ELSE CAST(len(string_split(alt, ',')) AS VARCHAR) END || ' ' || qual AS line FROM sites")
def format_sites(spark, sf_dir):
    return format_records(sites(spark, sf_dir), r"%CHROM\t%POS0 %ID %FIRST_ALT/%N_ALT %QUAL")


_ALLELE = lambda a: f"CASE WHEN {a} < 0 THEN '.' ELSE CAST({a} AS VARCHAR) END"
_LETTER = lambda a: f"CASE WHEN {a} < 0 THEN '.' ELSE COALESCE(list_concat([ref], string_split(alt, ','))[{a} + 1], '.') END"


@query(DUCK_CALLS + ", " + DUCK_SITES.removeprefix("WITH ") + f", c AS (SELECT pos, string_agg(' ' || CAST(sample_idx AS VARCHAR) || '=' || {_ALLELE('a1')} || '/' || {_ALLELE('a2')} || ',' || {_LETTER('a1')} || '/' || {_LETTER('a2')} || ',' || CAST(dp AS VARCHAR), '' ORDER BY sample_idx) AS t FROM calls JOIN (SELECT pos, ref, alt FROM sites) USING (pos) GROUP BY 1)\nSELECT chrom, pos, CAST(pos AS VARCHAR) || ':' || COALESCE(t, '') AS line FROM sites LEFT JOIN c USING (pos)")
def format_calls(spark, sf_dir):
    cells = calls(spark, sf_dir).select("chrom", "pos", "sample_idx", "a1", "a2", "dp")
    return format_records(sites(spark, sf_dir), "%POS:[ %SAMPLE=%GT,%TGT,%DP]", cells)


# --- expressions -----------------------------------------------------------

_MEAN = "((pl0 + pl1 + pl2) / 3.0)"


@query(DUCK_CALLS + f"SELECT pos, sample_idx FROM calls WHERE sqrt((pl0 * pl0 + pl1 * pl1 + pl2 * pl2) / 3.0 - {_MEAN} * {_MEAN}) > 100.5 AND list_sort([pl0, pl1, pl2])[2] >= 60 AND GREATEST(ad0, ad1) < 45 AND pl0 + pl1 + pl2 < 900 AND LEAST(pl0, pl1) < 100")
def expression_statistics(spark, sf_dir):
    df = _pl(calls(spark, sf_dir)).withColumns({"ad": F.array("ad0", "ad1"), "first": F.array("pl0", "pl1")})
    return df.filter(compile_filter("STDEV(pl)>100.5 && MEDIAN(pl)>=60 && MAX(ad)<45 && SUM(pl)<900 && MIN(first)<100")).select("pos", "sample_idx")


_TAIL = "list_sum(list_transform(range(0, LEAST(ad0, ad1) + 1), lambda i: exp(lgamma(ad0 + ad1 + 1.0) - lgamma(i + 1.0) - lgamma(ad0 + ad1 - i + 1.0) - (ad0 + ad1) * ln(2.0))))"


@query(DUCK_CALLS + f"SELECT pos, sample_idx, ROUND(CASE WHEN ad0 = ad1 THEN 1.0 ELSE LEAST(1.0, 2 * {_TAIL}) END, 6) AS p FROM calls")
def expression_binomial(spark, sf_dir):
    from sitewise.functions.expressions import to_sql

    df = calls(spark, sf_dir).withColumn("ad", F.array("ad0", "ad1"))
    return df.select("pos", "sample_idx", F.round(F.expr(to_sql("BINOM(ad)")), 6).alias("p"))


@query(DUCK_CALLS + ", s AS (SELECT chrom, pos, list(GREATEST(pl0, pl1, pl2) ORDER BY sample_idx) AS m, list((pl0 + pl1 + pl2) / 3.0 ORDER BY sample_idx) AS a, list(CASE WHEN dp > 20 THEN 1 ELSE 0 END) AS d FROM calls GROUP BY 1, 2)\nSELECT chrom, pos FROM s WHERE list_max(m) > 900 AND list_min(a) < 20.5 AND list_sum(d) > 3 AND list_sum(d) / len(d) < 0.75")
def expression_samples(spark, sf_dir):
    """Functions of each sample's values, and counts of samples that pass."""
    df = _pl(calls(spark, sf_dir)).groupBy(*KEYS).agg(F.collect_list("pl").alias("pl"), F.collect_list(F.col("dp") > 20).alias("deep"))
    return df.filter(compile_filter("MAX(SMPL_MAX(pl))>900 && MIN(SMPL_AVG(pl))<20.5 && N_PASS(deep)>3 && F_PASS(deep)<0.75")).select(*KEYS)


# --- encodings and statistics ----------------------------------------------

_BITS = "(CASE WHEN pl0 = 0 THEN 1 ELSE 0 END + CASE WHEN ad1 = 0 THEN 2 ELSE 0 END + CASE WHEN a1 > 0 THEN 4 ELSE 0 END + CASE WHEN a2 > 0 THEN 8 ELSE 0 END + CASE WHEN dp > 30 THEN 16 ELSE 0 END)"


@query(DUCK_CALLS + f"SELECT pos, sample_idx, CAST({_BITS} AS BIGINT) AS word, CAST(bit_count({_BITS}) AS INT) AS bits FROM calls")
def bitmaps(spark, sf_dir):
    words = g.bitmap(F.array(F.expr("pl0 = 0"), F.expr("ad1 = 0"), F.expr("a1 > 0"), F.expr("a2 > 0"), F.expr("dp > 30")))
    return calls(spark, sf_dir).withColumn("w", words).select("pos", "sample_idx", F.get("w", F.lit(0)).alias("word"), g.popcount(F.col("w")).alias("bits"))


_Z = "(CASE WHEN pl2 - 11 * pl1 >= 0 THEN 2 * (pl2 - 11 * pl1) ELSE -2 * (pl2 - 11 * pl1) - 1 END)"


@query(DUCK_CALLS + f", z AS (SELECT pos, sample_idx, pl2 - 11 * pl1 AS v, {_Z} AS z FROM calls)\nSELECT pos, sample_idx, v AS value, upper(CASE WHEN z < 128 THEN printf('%02x', z) WHEN z < 16384 THEN printf('%02x%02x', z % 128 + 128, z // 128) ELSE printf('%02x%02x%02x', z % 128 + 128, (z // 128) % 128 + 128, z // 16384) END) AS code FROM z")
def varints(spark, sf_dir):
    df = calls(spark, sf_dir).withColumn("code", g.varint_bytes(g.zigzag(F.col("pl2") - 11 * F.col("pl1"))))
    return df.select("pos", "sample_idx", g.unzigzag(g.varint_value(F.col("code"))).alias("value"), "code")


@query(DUCK_CALLS + "SELECT pos, sample_idx, dp, dp - ad0 - ad1 AS difference FROM calls WHERE dp <> ad0 + ad1")
def depth_exceptions(spark, sf_dir):
    return format_stats.prediction_exceptions(calls(spark, sf_dir), F.col("ad0") + F.col("ad1"), "dp", ("pos", "sample_idx"))


@query(DUCK_CALLS + ", c AS (SELECT a1 + a2 AS gt_class, [pl0, pl1, pl2] AS p FROM calls WHERE a1 IN (0, 1) AND a2 IN (0, 1))\nSELECT gt_class, CAST(list_position(p, list_min(p)) - 1 AS BIGINT) AS argmin, COUNT(*) AS n, MAX(list_max(p)) AS largest FROM c WHERE p[gt_class + 1] <> list_min(p) GROUP BY 1, 2")
def argmin_mismatches(spark, sf_dir):
    return format_stats.argmin_mismatches(_pl(calls(spark, sf_dir)))


_AD = "CASE WHEN ln % 2 = 0 THEN [ad0, ad1] ELSE [ad0, ad1, ln % 4] END"
_SPARK_AD = "CASE WHEN ln % 2 = 0 THEN array(ad0, ad1) ELSE array(ad0, ad1, ln % 4) END"


@query(DUCK_CALLS + f", d AS (SELECT {_AD} AS ad FROM calls), t AS (SELECT ad[1] AS r, list_sum(ad[2:]) AS a, len(ad) AS k FROM d)\nSELECT CASE WHEN r = 0 AND a = 0 THEN '00' WHEN a = 0 THEN '01' WHEN r = 0 THEN '10' ELSE '11' END AS tip, COUNT(*) AS n, CAST(SUM(r) AS BIGINT) AS ref_depth, CAST(SUM(a) AS BIGINT) AS alt_depth, ROUND(AVG(k), 4) AS alleles FROM t GROUP BY 1")
def depth_tips(spark, sf_dir):
    return format_stats.depth_tips(calls(spark, sf_dir).withColumn("ad", F.expr(_SPARK_AD)))


@query(DUCK_CALLS + f", d AS (SELECT {_AD} AS ad FROM calls)\nSELECT len(ad) AS length, COUNT(*) AS n, COUNT(DISTINCT array_to_string(ad, ',')) AS patterns FROM d GROUP BY 1")
def pattern_lengths(spark, sf_dir):
    return format_stats.pattern_lengths(calls(spark, sf_dir).withColumn("ad", F.expr(_SPARK_AD)), "ad")


@query(DUCK_CALLS + ", v AS (SELECT UNNEST([pl0, pl1, pl2]) AS x FROM calls)\nSELECT COUNT(*) AS n, MAX(x) AS largest, ROUND(COUNT(*) FILTER (x = 0) * 100.0 / COUNT(*), 4) AS zero_percent, ROUND(COUNT(*) FILTER (x = (SELECT MAX(x) FROM v)) * 100.0 / COUNT(*), 4) AS largest_percent FROM v")
def value_shares(spark, sf_dir):
    df = calls(spark, sf_dir).select(F.explode(F.array("pl0", "pl1", "pl2")).alias("x"))
    return format_stats.value_shares(df, F.col("x"))


@query(DUCK_CALLS + "SELECT CAST(LEAST(pl2 // pl1, 30) AS BIGINT) AS ratio, COUNT(*) AS n, ROUND(AVG(pl1), 6) AS mean_a FROM calls WHERE pl1 > 0 GROUP BY 1")
def ratio_histogram(spark, sf_dir):
    return format_stats.ratio_histogram(calls(spark, sf_dir))


@query(DUCK_CALLS + ", c AS (SELECT r AS ratio, COUNT(*) FILTER (ABS(pl2 - r * pl1) <= 7) AS covered FROM calls, (SELECT CAST(UNNEST(range(8, 21)) AS INT) AS r) WHERE pl1 > 0 GROUP BY 1)\nSELECT ratio, covered FROM c ORDER BY covered DESC, ratio LIMIT 1")
def best_ratio_of_all(spark, sf_dir):
    return format_stats.best_of(format_stats.best_ratio(calls(spark, sf_dir), range(8, 21)))


@query("WITH n AS (SELECT p_brand AS chrom, p_partkey AS pos, (ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 16 AS block FROM part) SELECT chrom, block, COUNT(*) AS n, MIN(pos) AS first_pos, MAX(pos) AS last_pos FROM n GROUP BY 1, 2")
def row_zone_map(spark, sf_dir):
    return counts.row_zone_map(sites(spark, sf_dir), 16, width=WIDTH)


@query("WITH n AS (SELECT p_brand AS chrom, p_partkey AS pos, (ROW_NUMBER() OVER w - 1) // 16 AS block, LEAD(p_partkey) OVER w - 1 AS e FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)) SELECT chrom, block, COUNT(*) AS n, MIN(pos) AS first_pos, MAX(COALESCE(e, pos)) AS last_pos FROM n GROUP BY 1, 2")
def gvcf_row_index(spark, sf_dir):
    return counts.row_zone_map(ordered.infer_ends(sites(spark, sf_dir), ("chrom",), width=WIDTH), 16, end="end_pos", width=WIDTH)


@query("WITH l AS (SELECT 'type' AS field, p_type AS v FROM part UNION ALL SELECT 'brand', p_brand FROM part UNION ALL SELECT 'name', p_name FROM part), c AS (SELECT field, v, COUNT(*) AS c FROM l GROUP BY 1, 2), s AS (SELECT field, CAST(SUM(c) AS BIGINT) AS n, CAST(SUM(c * strlen(v)) AS BIGINT) AS raw, CAST(SUM(strlen(v)) + SUM(c) * CASE WHEN COUNT(*) <= 256 THEN 1 WHEN COUNT(*) <= 65536 THEN 2 ELSE 4 END AS BIGINT) AS packed FROM c GROUP BY 1) SELECT field, n, raw, packed, ROUND(raw / packed, 4) AS ratio, ROUND(packed * 8 / n, 4) AS bits FROM s")
def field_ratios(spark, sf_dir):
    return counts.field_ratios(table(spark, sf_dir, "part").selectExpr("p_type AS type", "p_brand AS brand", "p_name AS name"), ("type", "brand", "name"))


@query("WITH r AS (SELECT p_partkey AS pos, p_type AS row, ROW_NUMBER() OVER (ORDER BY p_partkey) AS no FROM part), b AS (SELECT pos, no, LAG(no) OVER (PARTITION BY row ORDER BY no) AS b, LAG(pos) OVER (PARTITION BY row ORDER BY no) AS copy_of FROM r) SELECT pos, copy_of FROM b WHERE no - b <= 20")
def near_duplicate_rows(spark, sf_dir):
    """Types of parts stand in for genotype rows, which hardly repeat in these tables."""
    df = table(spark, sf_dir, "part").selectExpr("p_partkey AS pos", "p_type AS row")
    return counts.near_duplicate_rows(df, 20, width=WIDTH).select("pos", "copy_of")


@query("WITH r AS (SELECT p_partkey AS pos, p_type AS row FROM part), f AS (SELECT row, MIN(pos) AS copy_of FROM r GROUP BY 1) SELECT pos, copy_of FROM r JOIN f USING (row) WHERE pos > copy_of")
def duplicate_rows(spark, sf_dir):
    """As ``dup_rows``, over texts that do repeat."""
    return counts.duplicate_rows(table(spark, sf_dir, "part").selectExpr("p_partkey AS pos", "p_type AS row"))


@query("WITH s AS (SELECT p_partkey AS pos, 'GT:DP:AD' AS k, ['0/1:' || CAST(p_size AS VARCHAR) || ':' || p_name, '1/1'] AS c FROM part) SELECT pos, 'AD:DP:GT' AS keys, split_part(c[1], ':', 3) || ':' || split_part(c[1], ':', 2) || ':0/1|.:.:1/1' AS cells FROM s")
def canonical_format(spark, sf_dir):
    cells = F.array(F.concat_ws(":", F.lit("0/1"), F.col("p_size").cast("string"), "p_name"), F.lit("1/1"))
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), g.canonical_format(F.lit("GT:DP:AD"), cells).alias("c"))
    return df.select("pos", "c.keys", F.array_join("c.cells", "|").alias("cells"))


@query(DUCK_CALLS + ", v AS (SELECT * FROM calls WHERE pl0 <> 3), w AS (SELECT pl2 - LAG(pl2) OVER s AS d, pl0, LAG(pl0) OVER s AS b0 FROM v WINDOW s AS (PARTITION BY sample_idx ORDER BY chrom, pos)), d AS (SELECT d FROM w WHERE pl0 = 0 AND b0 = 0)\nSELECT COUNT(*) AS n, CAST(SUM(CASE WHEN d = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero, CAST(SUM(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS up, CAST(SUM(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS BIGINT) AS down, " + ", ".join(f"CAST(SUM(CASE WHEN ABS(d) < {1 << k} THEN 1 ELSE 0 END) AS BIGINT) AS below_{1 << k}" for k in range(1, 13)) + " FROM d")
def pl2_delta_hist(spark, sf_dir):
    """Of the third likelihood; cells whose first is 3 stand for cells of another width, and are passed over."""
    return ordered.delta_histogram(ordered.valid_deltas(calls(spark, sf_dir), "pl2", "pl0 = 0", width=WIDTH, skip="pl0 = 3"))


# --- records as text -------------------------------------------------------

_FORMAT = "GT:AD:DP:PL"
_SPARK_CELL = "concat_ws(':', concat_ws('/', if(a1 < 0, '.', string(a1)), if(a2 < 0, '.', string(a2))), concat_ws(',', ad0, ad1), dp, concat_ws(',', pl0, pl1, pl2))"
_DUCK_CELL = f"concat_ws(':', {_ALLELE('a1')} || '/' || {_ALLELE('a2')}, ad0 || ',' || ad1, dp, pl0 || ',' || pl1 || ',' || pl2)"
_INFO = "concat('END=', CAST(pos + 3 AS STRING), ';Z=1;DB')"
_DUCK_LINES = DUCK_CALLS + ", " + DUCK_SITES.removeprefix("WITH ") + f", j AS (SELECT pos, string_agg({_DUCK_CELL}, chr(9) ORDER BY sample_idx) AS cells FROM calls GROUP BY 1), lines AS (SELECT s.pos, concat_ws(chr(9), s.chrom, s.pos, s.id, s.ref, s.alt, s.qual, 'PASS', 'END=' || CAST(s.pos + 3 AS VARCHAR) || ';Z=1;DB', '{_FORMAT}', cells) AS line FROM sites s JOIN j USING (pos))\n"


def _lines(spark, sf_dir):
    """The star-schema genotypes as lines of a text file: a site has the samples that ordered its part."""
    cells = calls(spark, sf_dir).groupBy("pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", F.expr(_SPARK_CELL).alias("c")))), lambda x: x["c"]), "\t").alias("cells"))
    df = sites(spark, sf_dir).join(cells, "pos")
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", "alt", "qual", F.lit("PASS"), F.expr(_INFO), F.lit(_FORMAT), "cells")
    return df.select(F.lit(0).alias("file_no"), F.col("pos").alias("offset"), line.alias("line"))


def _names() -> list[str]:
    return [f"s{i}" for i in range(4096)]


@query(_DUCK_LINES + "SELECT pos, line FROM lines")
def record_round_trip(spark, sf_dir):
    """Text to typed columns and back, byte by byte."""
    from sitewise.sources import vcf

    found = vcf.sites(_lines(spark, sf_dir))
    return vcf.record_lines(found, vcf.calls(found, _names()), gt_only=False).select(F.col("site_id").alias("pos"), "line")


_ORDERED = ", n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pos ORDER BY sample_idx) - 1 AS i FROM calls)\n"


@query(DUCK_CALLS + _ORDERED + f"SELECT pos, CAST(i AS INT) AS sample_no, 's' || CAST(i AS VARCHAR) AS sample, {_ALLELE('a1')} || '/' || {_ALLELE('a2')} AS gt, ad0 + ad1 AS depth, CAST(dp AS INT) AS dp, CAST(pl2 AS INT) AS pl2, CAST(NULL AS VARCHAR) AS raw FROM n")
def parsed_calls(spark, sf_dir):
    from sitewise.sources import vcf

    df = vcf.calls(vcf.sites(_lines(spark, sf_dir)), _names())
    return df.select("pos", F.col("sample_idx").alias("sample_no"), "sample", g.format_gt(F.col("gt"), F.col("phased")).alias("gt"), g.sum_ad(F.col("ad")).alias("depth"), "dp", F.get("pl", F.lit(2)).alias("pl2"), "raw")


@query(DUCK_CALLS + ", f AS (SELECT * FROM calls QUALIFY ROW_NUMBER() OVER (PARTITION BY pos ORDER BY sample_idx) = 1)\nSELECT pos, pos + 3 AS end_pos, CAST(dp AS INT) AS dp, CAST(pl1 AS INT) AS pl1 FROM f")
def block_records(spark, sf_dir):
    """Single-sample records with END; the first sample of each site is the one."""
    from sitewise.sources import vcf

    first = _lines(spark, sf_dir).withColumn("line", F.substring_index("line", "\t", 10))
    return vcf.gvcf(vcf.sites(first), ["s0"]).select("pos", "end_pos", "dp", F.get("pl", F.lit(1)).alias("pl1"))


_DUCK_CANON = f"concat_ws(':', ad0 || ',' || ad1, dp, {_ALLELE('a1')} || '/' || {_ALLELE('a2')}, pl0 || ',' || pl1 || ',' || pl2)"


@query(DUCK_CALLS + ", " + DUCK_SITES.removeprefix("WITH ") + f", c AS (SELECT pos, string_agg({_DUCK_CANON}, chr(9) ORDER BY sample_idx) AS cells FROM calls GROUP BY 1)\nSELECT s.pos, sha256(concat_ws(chr(9), s.chrom, s.pos, s.id, s.ref, s.alt, s.qual, 'PASS', 'DB;END=' || CAST(s.pos + 3 AS VARCHAR) || ';Z=1', 'AD:DP:GT:PL', cells)) AS hash FROM sites s JOIN c USING (pos)")
def record_hashes(spark, sf_dir):
    from sitewise.sources import hashes

    df = _lines(spark, sf_dir).select(F.col("offset").alias("site_id"), "line")
    return hashes.record_hashes(df).withColumnRenamed("site_id", "pos")


@query(DUCK_CALLS + "SELECT pos, sample_idx, a1 < 0 OR a2 < 0 AS missing, a1 = 0 AND a2 = 0 AS hom_ref, a1 >= 0 AND a2 >= 0 AND a1 <> a2 AS het, CAST((a1 + 2) * (a1 + 3) / 2 AS INT) AS likelihoods FROM calls")
def genotype_predicates(spark, sf_dir):
    gt = F.array("a1", "a2")
    return calls(spark, sf_dir).select("pos", "sample_idx", g.is_missing(gt).alias("missing"), g.is_hom_ref(gt).alias("hom_ref"), g.is_het(gt).alias("het"), g.pl_count(F.col("a1") + 2).alias("likelihoods"))


@query(DUCK_CALLS + "SELECT pos, sample_idx, CASE WHEN ln % 2 = 0 THEN concat_ws(',', 0, pl1, pl2) ELSE concat_ws(',', 0, pl1, pl2, pl1, pl2, pl2) END AS pl FROM calls")
def rebuilt_likelihoods(spark, sf_dir):
    alleles = F.when(F.col("ln") % 2 == 0, 2).otherwise(3)
    df = calls(spark, sf_dir).withColumn("pl", g.pl_rebuild(F.col("pl1"), F.col("pl2"), alleles))
    return df.select("pos", "sample_idx", F.array_join(F.col("pl").cast("array<string>"), ",").alias("pl"))
