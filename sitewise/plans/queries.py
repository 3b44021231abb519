"""Registered queries over the star-schema tables, each with its SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.adapter import DUCK_CALLS, DUCK_SITES, calls, sites, table
from sitewise.functions import genotype as g
from sitewise.operators import bench, counts, filters, format_stats, ordered, plugins, projection, reshape, setops

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

KEYS = ("chrom", "pos")
SAMPLES = (3, 1, 7, 2)

#: Positions in a block of the ordered operators; a genome would take a million.
WIDTH = 5000


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


_AC = "SUM(CASE WHEN a1 = 0 THEN 0 ELSE 1 END + CASE WHEN a2 = 0 THEN 0 ELSE 1 END)"
_COUNTS = f"SELECT chrom, pos, CAST({_AC} AS BIGINT) AS ac, CAST(2 * COUNT(*) AS BIGINT) AS an, ROUND({_AC} / (2.0 * COUNT(*)), 6) AS af FROM calls"
_CHROM = "(SELECT MIN(p_brand) FROM part)"


def _spec(spark: SparkSession, sf_dir: str, start: int = 1, end: int = 100_000) -> str:
    return f"{table(spark, sf_dir, 'part').agg(F.min('p_brand')).first()[0]}:{start},{end}"


def _pl(df: DataFrame) -> DataFrame:
    df = df.withColumn("pl", F.array("pl0", "pl1", "pl2"))
    return df.withColumn("gq", F.when(F.col("q") % 6 == 0, 99).otherwise(F.coalesce(g.second_min_distinct(F.col("pl")), F.lit(0))))


_SORTED = "list_sort([pl0, pl1, pl2])"
_DISTINCT = "list_sort(list_distinct([pl0, pl1, pl2]))"
_PL = f", pls AS (SELECT *, CASE WHEN q % 6 = 0 THEN 99 ELSE COALESCE({_DISTINCT}[2], 0) END AS gq, LEAST(pl0, pl1, pl2) AS lo, CASE WHEN pl0 <> 0 THEN 3 WHEN pl1 = 0 AND pl2 = 0 THEN 0 WHEN pl2 = 15 * pl1 THEN 2 ELSE 1 END AS pl_type FROM calls)\n"


# --- selection -------------------------------------------------------------


@query(DUCK_CALLS + _COUNTS + f" WHERE chrom = {_CHROM} AND pos BETWEEN 1 AND 100000 AND sample_idx IN (3, 1, 7, 2) GROUP BY chrom, pos HAVING {_AC} >= 1")
def flagship(spark, sf_dir):
    """Allele counts of requested samples in a range, with at least one count."""
    df = filters.range_filter(calls(spark, sf_dir), _spec(spark, sf_dir))
    return filters.count_filter(counts.allele_counts(df.filter(F.col("sample_idx").isin(*SAMPLES)), KEYS), low=1)


@query(DUCK_SITES + f"SELECT * FROM sites WHERE chrom = {_CHROM} AND pos BETWEEN 10 AND 5000")
def range_select(spark, sf_dir):
    return filters.range_filter(sites(spark, sf_dir), _spec(spark, sf_dir, 10, 5000))


@query(DUCK_SITES + "SELECT * FROM sites WHERE id = 'rs42'")
def id_select(spark, sf_dir):
    return filters.id_filter(sites(spark, sf_dir), "ID=rs42")


@query(DUCK_SITES + "SELECT * FROM sites WHERE CASE WHEN qual = '.' THEN 0 ELSE CAST(split_part(qual, '.', 1) AS INT) END BETWEEN 0 AND 60")
def qual_select(spark, sf_dir):
    return filters.qual_filter(sites(spark, sf_dir), 0, 60.9)


@query(DUCK_SITES + "SELECT * FROM sites WHERE TRY_CAST(qual AS DOUBLE) BETWEEN 20.0 AND 60.7")
def qual_select_std(spark, sf_dir):
    return filters.qual_filter(sites(spark, sf_dir), 20.0, 60.7, compat=False)


@query(DUCK_SITES + "SELECT * FROM sites WHERE alt NOT LIKE '%<%' AND alt NOT LIKE '%,%'")
def biallelic_only(spark, sf_dir):
    return filters.biallelic_filter(sites(spark, sf_dir))


@query(DUCK_SITES + f"SELECT * FROM sites WHERE chrom = {_CHROM} AND pos BETWEEN 10 AND 900")
def gvcf_range(spark, sf_dir):
    chrom = _spec(spark, sf_dir).partition(":")[0]
    return filters.block_range_filter(sites(spark, sf_dir), f"{chrom}:900-10")


@query(DUCK_SITES + "SELECT chrom, pos, id FROM sites ORDER BY chrom, pos LIMIT 25")
def first_records(spark, sf_dir):
    return filters.first_records(sites(spark, sf_dir), 25, "chrom", "pos").select("chrom", "pos", "id")


@query(DUCK_CALLS + ", asked AS (SELECT * FROM (VALUES (0, 3), (1, 1), (2, 7), (3, 2)) t(rank, s))\nSELECT chrom, pos, sample_idx, a1, a2, rank FROM calls JOIN asked ON s = sample_idx")
def sample_project(spark, sf_dir):
    df = calls(spark, sf_dir)
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample_idx"))
    return projection.sample_project(df, projection.requested(spark, SAMPLES, known)).select("chrom", "pos", "sample_idx", "a1", "a2", "rank")


@query(DUCK_CALLS + "SELECT chrom, pos, sample_idx, '.' AS filter, '.' AS info, 'GT' AS format, (CASE WHEN a1 < 0 THEN '.' ELSE CAST(a1 AS VARCHAR) END) || '|' || (CASE WHEN a2 < 0 THEN '.' ELSE CAST(a2 AS VARCHAR) END) AS gt FROM calls")
def gt_only(spark, sf_dir):
    return projection.gt_only(calls(spark, sf_dir)).select("chrom", "pos", "sample_idx", "filter", "info", "format", "gt")


@query(DUCK_CALLS + f"SELECT chrom, pos, 'AN=' || CAST(2 * COUNT(*) AS VARCHAR) || ';AC=' || CAST(CAST({_AC} AS BIGINT) AS VARCHAR) AS info FROM calls GROUP BY chrom, pos")
def counts_info(spark, sf_dir):
    return projection.with_counts_info(counts.allele_counts(calls(spark, sf_dir), KEYS)).select("chrom", "pos", "info")


@query(DUCK_CALLS + "SELECT pos, sample_idx, concat_ws(';', CASE WHEN dp > 0 THEN 'DP=' || CAST(dp AS VARCHAR) END, CASE WHEN pl1 > 0 THEN 'PL1=' || CAST(pl1 AS VARCHAR) END) AS record FROM calls")
def rebuilt_records(spark, sf_dir):
    return projection.rebuild_record(calls(spark, sf_dir), ("dp", "pl1"), missing=0).select("pos", "sample_idx", "record")


# --- counts ----------------------------------------------------------------


@query(DUCK_CALLS + _COUNTS + " GROUP BY chrom, pos")
def ac_an(spark, sf_dir):
    return counts.allele_counts(calls(spark, sf_dir), KEYS)


_AC_STD = "SUM(CASE WHEN a1 > 0 THEN 1 ELSE 0 END + CASE WHEN a2 > 0 THEN 1 ELSE 0 END)"
_AN_STD = "SUM(CASE WHEN a1 >= 0 THEN 1 ELSE 0 END + CASE WHEN a2 >= 0 THEN 1 ELSE 0 END)"


@query(DUCK_CALLS + f"SELECT chrom, pos, CAST({_AC_STD} AS BIGINT) AS ac, CAST({_AN_STD} AS BIGINT) AS an, ROUND({_AC_STD} / NULLIF(CAST({_AN_STD} AS DOUBLE), 0), 6) AS af FROM calls GROUP BY chrom, pos")
def ac_an_std(spark, sf_dir):
    return counts.allele_counts(calls(spark, sf_dir), KEYS, compat=False)


@query(DUCK_CALLS + _COUNTS + f" GROUP BY chrom, pos HAVING {_AC} BETWEEN 12 AND 24")
def minac_filter(spark, sf_dir):
    return filters.count_filter(counts.allele_counts(calls(spark, sf_dir), KEYS), 12, 24)


@query(DUCK_CALLS + _COUNTS + f" GROUP BY chrom, pos HAVING CAST({_AC} / (2.0 * COUNT(*)) AS FLOAT) BETWEEN CAST(0.2 AS FLOAT) AND CAST(0.4 AS FLOAT)")
def af_filter(spark, sf_dir):
    return filters.frequency_filter(counts.allele_counts(calls(spark, sf_dir), KEYS), 0.2, 0.4)


@query("SELECT p_brand AS chrom, COUNT(*) AS n, MIN(p_partkey) AS min_pos, MAX(p_partkey) AS max_pos FROM part GROUP BY 1")
def chrom_index(spark, sf_dir):
    return counts.chrom_index(sites(spark, sf_dir))


@query("SELECT p_brand AS chrom, p_partkey // 100 AS block, COUNT(*) AS n, MIN(p_partkey) AS first_pos, MAX(p_partkey) AS last_pos FROM part GROUP BY 1, 2")
def block_zone_map(spark, sf_dir):
    return counts.zone_map(sites(spark, sf_dir), 100)


@query("WITH e AS (SELECT p_brand AS chrom, p_partkey AS pos, LEAD(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS e FROM part) SELECT chrom, pos // 100 AS block, COUNT(*) AS n, MIN(pos) AS first_pos, MAX(COALESCE(e, pos)) AS last_pos FROM e GROUP BY 1, 2")
def gvcf_block_index(spark, sf_dir):
    return counts.zone_map(ordered.infer_ends(sites(spark, sf_dir), ("chrom",), width=WIDTH), 100, end="end_pos")


@query(DUCK_CALLS + "SELECT chrom, pos, ln FROM calls GROUP BY 1, 2, 3 HAVING MAX(CASE WHEN a1 = 0 AND a2 = 0 THEN 0 ELSE 1 END) = 0")
def ref_only_sites(spark, sf_dir):
    """A site is a position and a line number here: over a whole position no row is reference alone."""
    return counts.ref_only(calls(spark, sf_dir), ("chrom", "pos", "ln"))


@query(DUCK_CALLS + ", r AS (SELECT chrom, pos, string_agg(CAST(sample_idx AS VARCHAR) || ':' || CAST(a1 AS VARCHAR) || ':' || CAST(a2 AS VARCHAR), ',' ORDER BY sample_idx) AS row FROM calls GROUP BY 1, 2), m AS (SELECT row, MIN(pos) AS copy_of FROM r GROUP BY 1)\nSELECT chrom, pos, copy_of FROM r JOIN m USING (row) WHERE pos > copy_of")
def dup_rows(spark, sf_dir):
    rows = counts.genotype_rows(calls(spark, sf_dir), KEYS)
    return counts.duplicate_rows(rows).select("chrom", "pos", "copy_of")


@query(DUCK_CALLS + ", h AS (SELECT sample_idx, 0 AS hap, a1 AS a FROM calls UNION ALL SELECT sample_idx, 1, a2 FROM calls)\nSELECT sample_idx, hap, CAST(SUM(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS BIGINT) AS ones FROM h GROUP BY 1, 2")
def hap_density(spark, sf_dir):
    return counts.hap_density(calls(spark, sf_dir))


@query(DUCK_SITES + ", b AS (SELECT CAST(SUM(strlen(id)) AS BIGINT) AS id, CAST(SUM(strlen(alt)) AS BIGINT) AS alt, CAST(SUM(strlen(qual)) AS BIGINT) AS qual FROM sites), l AS (SELECT 'id' AS field, id AS bytes FROM b UNION ALL SELECT 'alt', alt FROM b UNION ALL SELECT 'qual', qual FROM b)\nSELECT field, bytes, ROUND(bytes * 100 / SUM(bytes) OVER (), 4) AS percent FROM l")
def field_bytes(spark, sf_dir):
    return counts.field_bytes(sites(spark, sf_dir), ("id", "alt", "qual"))


# --- reshaping -------------------------------------------------------------

_SPLIT = """, s AS (SELECT chrom, pos, alt, CASE WHEN alt LIKE '%,<N>' THEN [alt] ELSE string_split(alt, ',') END AS a FROM sites),
x AS (SELECT chrom, pos, UNNEST(a) AS v, UNNEST(range(1, len(a) + 1)) AS alt_no, len(a) AS n FROM s)
"""


@query(DUCK_SITES + _SPLIT + "SELECT chrom, pos, alt_no, v || CASE WHEN n = 1 THEN '' WHEN alt_no = 1 THEN ',<N>' ELSE ',<M>' END AS split_alt FROM x")
def split_multiallelic(spark, sf_dir):
    return reshape.split_alleles(sites(spark, sf_dir)).select("chrom", "pos", "alt_no", "split_alt")


@query(DUCK_SITES + "SELECT chrom, pos, CASE WHEN alt LIKE '%,<N>' THEN regexp_replace(alt, ',<N>$', '') ELSE alt END AS alt FROM sites")
def merge_multiallelic(spark, sf_dir):
    return reshape.merge_alleles(reshape.split_alleles(sites(spark, sf_dir)).select("chrom", "pos", "alt_no", "split_alt"), KEYS)


@query(DUCK_CALLS + "SELECT chrom, pos, sample_idx * 2 + i AS hap_idx, CASE WHEN a < 0 THEN '.' ELSE CAST(a AS VARCHAR) END AS code FROM (SELECT chrom, pos, sample_idx, 0 AS i, a1 AS a FROM calls UNION ALL SELECT chrom, pos, sample_idx, 1, a2 FROM calls)")
def hap_explode(spark, sf_dir):
    return reshape.explode_haplotypes(calls(spark, sf_dir)).select("chrom", "pos", "hap_idx", "code")


@query("SELECT l_partkey AS pos, l_orderkey, l_linenumber, l_suppkey, l_quantity, ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS dup_no FROM (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem)")
def dup_counter(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pos"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").distinct()
    return reshape.number_duplicates(df, ("pos",), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


@query("SELECT 0 AS file_no, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 1, s_name, s_acctbal, NULL FROM supplier")
def union_files(spark, sf_dir):
    a = table(spark, sf_dir, "customer").selectExpr("c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment")
    b = table(spark, sf_dir, "supplier").selectExpr("s_name AS name", "s_acctbal AS balance")
    return reshape.union_files(a, b).select("file_no", "name", "balance", "segment")


# --- ordered ---------------------------------------------------------------

_PART = "WITH s AS (SELECT p_brand AS chrom, p_partkey AS pos, p_size % 3 AS v, p_size AS z FROM part)"


def _small(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_brand AS chrom", "p_partkey AS pos", "p_size % 3 AS v", "p_size AS z")


@query(_PART + ", r AS (SELECT *, CASE WHEN LAG(v) OVER w = v THEN 0 ELSE 1 END AS n FROM s WINDOW w AS (PARTITION BY chrom ORDER BY pos)), k AS (SELECT *, CAST(SUM(n) OVER (PARTITION BY chrom ORDER BY pos) AS BIGINT) AS run FROM r)\nSELECT chrom, run, MIN(v) AS value, COUNT(*) AS length FROM k GROUP BY 1, 2")
def rle(spark, sf_dir):
    return ordered.run_lengths(_small(spark, sf_dir), "v", ("chrom",), ("pos",), WIDTH)


@query(_PART + ", r AS (SELECT *, CASE WHEN LAG(v) OVER (PARTITION BY chrom ORDER BY pos) = v THEN 0 ELSE 1 END AS n FROM s)\nSELECT chrom, COUNT(*) AS n, CAST(SUM(n) AS BIGINT) AS runs, COUNT(DISTINCT v) AS uniques, ROUND(SUM(n) / COUNT(*), 6) AS run_ratio, ROUND(COUNT(DISTINCT v) / COUNT(*), 6) AS unique_ratio FROM r GROUP BY 1")
def run_ratio(spark, sf_dir):
    return ordered.run_ratio(_small(spark, sf_dir), "v", ("chrom",), ("pos",), WIDTH)


@query(_PART + " SELECT chrom, pos, pos - COALESCE(LAG(pos) OVER (PARTITION BY chrom ORDER BY pos), 0) AS delta FROM s")
def pos_delta(spark, sf_dir):
    return ordered.deltas(_small(spark, sf_dir), "pos", ("chrom",), ("pos",), WIDTH).select("chrom", "pos", "delta")


@query("WITH d AS (SELECT p_type AS value, MIN(p_partkey) AS first_at, COUNT(*) AS n FROM part GROUP BY 1) SELECT *, ROW_NUMBER() OVER (ORDER BY first_at, value) - 1 AS code FROM d")
def dictionary(spark, sf_dir):
    return ordered.dictionary(table(spark, sf_dir, "part").selectExpr("p_type AS value", "p_partkey"), "value", "p_partkey", WIDTH)


@query(_PART + ", c AS (SELECT chrom, v, COUNT(*) AS c FROM s GROUP BY 1, 2), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chrom ORDER BY c DESC, v) AS k, SUM(c) OVER (PARTITION BY chrom) AS n FROM c)\nSELECT chrom, v AS dominant, ROUND(c / n, 6) AS ratio, CAST(n - c AS BIGINT) AS patches FROM r WHERE k = 1")
def dominant_value(spark, sf_dir):
    return ordered.dominant(_small(spark, sf_dir), "v", ("chrom",))


@query(_PART + ", c AS (SELECT z, COUNT(*) AS c FROM s GROUP BY 1)\nSELECT CAST(SUM(c) AS BIGINT) AS total, COUNT(*) AS uniques, MIN(z) AS least, MAX(z) AS largest, ROUND(SUM(c * z) / SUM(c), 6) AS mean, ROUND(COUNT(*) / SUM(c), 6) AS repetition_ratio, ROUND(MAX(c) / SUM(c), 6) AS dominant_ratio, CASE WHEN MAX(c) / SUM(c) >= 0.7 THEN 'mask' WHEN COUNT(*) / SUM(c) < 0.3 THEN 'dictionary' ELSE 'raw' END AS encoding FROM c")
def field_analysis(spark, sf_dir):
    return ordered.field_analysis(_small(spark, sf_dir), "z")


@query(_PART + " SELECT chrom, pos, LEAD(pos) OVER (PARTITION BY chrom ORDER BY pos) - 1 AS end_pos FROM s")
def end_inference(spark, sf_dir):
    return ordered.infer_ends(_small(spark, sf_dir), ("chrom",), width=WIDTH).select("chrom", "pos", "end_pos")


_BELOW = ", ".join(f"CAST(SUM(CASE WHEN ABS(d) < {1 << k} THEN 1 ELSE 0 END) AS BIGINT) AS below_{1 << k}" for k in range(1, 13))
_HIST = f"SELECT COUNT(*) AS n, CAST(SUM(CASE WHEN d = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero, CAST(SUM(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS up, CAST(SUM(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS BIGINT) AS down, {_BELOW} FROM d"


@query(DUCK_CALLS + ", w AS (SELECT *, LAG(pl1) OVER s AS b, LAG(pl0) OVER s AS b0 FROM calls WINDOW s AS (PARTITION BY sample_idx ORDER BY chrom, pos)), d AS (SELECT pl1 - b AS d FROM w WHERE pl0 = 0 AND b0 = 0)\n" + _HIST)
def pl_delta_hist(spark, sf_dir):
    return ordered.delta_histogram(ordered.valid_deltas(calls(spark, sf_dir), "pl1", "pl0 = 0", width=WIDTH))


@query(DUCK_CALLS + ", w AS (SELECT *, LAG(ad0) OVER s AS b, LAG(ad1) OVER s AS b1 FROM calls WINDOW s AS (PARTITION BY sample_idx ORDER BY chrom, pos)), d AS (SELECT ad0 - b AS d FROM w WHERE ad1 = 0 AND b1 = 0)\n" + _HIST)
def ad_delta_hist(spark, sf_dir):
    return ordered.delta_histogram(ordered.valid_deltas(calls(spark, sf_dir), "ad0", "ad1 = 0", width=WIDTH))


@query(DUCK_CALLS + ", w AS (SELECT chrom, pos, CAST(ad0 + ad1 AS DOUBLE) AS x, CAST(LAG(ad0 + ad1) OVER (PARTITION BY sample_idx ORDER BY chrom, pos) AS DOUBLE) AS y FROM calls)\nSELECT chrom, pos, COUNT(*) AS n, ROUND(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) AS r FROM w WHERE y IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) >= 3 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0")
def adjacent_corr(spark, sf_dir):
    return ordered.adjacent_correlation(calls(spark, sf_dir).withColumn("s", F.col("ad0") + F.col("ad1")), "s", width=WIDTH)


# --- FORMAT statistics -----------------------------------------------------


@query(DUCK_CALLS + _PL + "SELECT CAST(list_position([pl0, pl1, pl2], lo) - 1 AS BIGINT) AS argmin, CAST(pl0 = 0 AS INT) AS first_zero, CAST(lo = 0 AS INT) AS min_zero, COUNT(*) AS n FROM pls GROUP BY 1, 2, 3")
def pl_argmin(spark, sf_dir):
    return format_stats.pl_argmin(_pl(calls(spark, sf_dir)))


_ADC = "(CASE WHEN ad0 = 0 THEN '0' ELSE 'n' END) || (CASE WHEN ad1 = 0 THEN '0' ELSE 'n' END)"


@query(DUCK_CALLS + f"SELECT {_ADC} AS ad_class, COUNT(*) AS n FROM calls GROUP BY 1")
def ad_class(spark, sf_dir):
    return format_stats.ad_classes(calls(spark, sf_dir))


@query(DUCK_CALLS + f"SELECT a1 + a2 AS gt_class, {_ADC} AS ad_class, CASE WHEN dp - ad0 - ad1 = 0 THEN '0' WHEN ABS(dp - ad0 - ad1) <= 2 THEN '[-2,2]' WHEN ABS(dp - ad0 - ad1) <= 10 THEN '[-10,10]' ELSE 'other' END AS dp_delta, COUNT(*) AS n FROM calls WHERE a1 IN (0, 1) AND a2 IN (0, 1) GROUP BY 1, 2, 3")
def gt_ad_contingency(spark, sf_dir):
    return format_stats.gt_ad_contingency(calls(spark, sf_dir))


_BUCKET = "CASE " + " ".join(f"WHEN o < {1 << k} THEN '<{1 << k}'" for k in range(7, 14)) + " ELSE '>=8192' END"


@query(DUCK_CALLS + ", c AS (SELECT *, a1 + a2 AS gt_class, [pl0, pl1, pl2][a1 + a2 + 1] AS own, CASE a1 + a2 WHEN 0 THEN LEAST(pl1, pl2) WHEN 1 THEN LEAST(pl0, pl2) ELSE LEAST(pl0, pl1) END AS o, LEAST(pl0, pl1, pl2) AS lo FROM calls WHERE a1 IN (0, 1) AND a2 IN (0, 1))\n" + f"SELECT gt_class, {_BUCKET} AS other_bucket, COUNT(*) AS n, COUNT(*) FILTER (own = 0) AS own_zero, COUNT(*) FILTER (own = lo) AS own_min FROM c GROUP BY 1, 2")
def gt_pl_consistency(spark, sf_dir):
    return format_stats.gt_pl_consistency(_pl(calls(spark, sf_dir)))


_DIST = "COUNT(*) AS n, CAST(MIN(x) AS DOUBLE) AS least, CAST(MAX(x) AS DOUBLE) AS largest, ROUND(AVG(x), 6) AS mean, CAST(MEDIAN(x) AS DOUBLE) AS median, ROUND(STDDEV_POP(x), 6) AS std, ROUND(AVG(CASE WHEN x = 0 THEN 1 ELSE 0 END), 6) AS zero_rate, ROUND(AVG(CASE WHEN x < 5 THEN 1 ELSE 0 END), 6) AS below5_rate"


@query(DUCK_CALLS + f", v AS (SELECT CAST(UNNEST([ad0, ad1]) AS DOUBLE) AS x FROM calls)\nSELECT {_DIST} FROM v")
def ad_distribution(spark, sf_dir):
    df = calls(spark, sf_dir).select(F.explode(F.array("ad0", "ad1")).alias("x"))
    return format_stats.distribution(df, F.col("x"))


@query(DUCK_CALLS + f", v AS (SELECT CAST(ad0 + ad1 AS DOUBLE) AS x FROM calls)\nSELECT {_DIST} FROM v")
def sum_ad_distribution(spark, sf_dir):
    return format_stats.distribution(calls(spark, sf_dir), g.sum_ad(F.array("ad0", "ad1")))


@query(DUCK_CALLS + f"SELECT {_ADC} AS ad_class, COUNT(*) AS n, CAST(SUM(ad0) AS BIGINT) AS ref_depth, CAST(SUM(ad1) AS BIGINT) AS alt_depth FROM calls GROUP BY 1")
def ad_tips(spark, sf_dir):
    df = calls(spark, sf_dir)
    return df.groupBy(g.ad_class(F.col("ad0"), F.col("ad1")).alias("ad_class")).agg(F.count("*").alias("n"), F.sum("ad0").alias("ref_depth"), F.sum("ad1").alias("alt_depth"))


@query(DUCK_CALLS + ", c AS (SELECT CAST(ad0 AS VARCHAR) || ',' || CAST(ad1 AS VARCHAR) AS pattern, COUNT(*) AS n FROM calls GROUP BY 1)\nSELECT pattern, n, ROUND(n * 100 / (SELECT SUM(n) FROM c), 4) AS percent FROM c ORDER BY n DESC, pattern LIMIT 10")
def top_patterns(spark, sf_dir):
    return format_stats.top_patterns(calls(spark, sf_dir), F.concat_ws(",", "ad0", "ad1"))


@query(DUCK_CALLS + ", v AS (SELECT UNNEST([pl0, pl1, pl2]) AS x FROM calls)\nSELECT CASE WHEN x < 10 THEN '<10' WHEN x < 50 THEN '<50' WHEN x < 100 THEN '<100' WHEN x < 255 THEN '<255' WHEN x < 1000 THEN '<1000' ELSE '>=1000' END AS range, COUNT(*) AS n FROM v GROUP BY 1")
def pl_ranges(spark, sf_dir):
    df = calls(spark, sf_dir).select(F.explode(F.array("pl0", "pl1", "pl2")).alias("x"))
    return format_stats.value_ranges(df, F.col("x"))


@query(DUCK_CALLS + _PL + "SELECT pl_type, COUNT(*) AS n, MIN(pl1) AS min_a, MAX(pl1) AS max_a, MIN(pl2) AS min_b, MAX(pl2) AS max_b FROM pls GROUP BY 1")
def pl_types(spark, sf_dir):
    return format_stats.pl_types(_pl(calls(spark, sf_dir)))


@query(DUCK_CALLS + _PL + f"SELECT COUNT(*) AS n, ROUND(AVG(CASE WHEN dp = ad0 + ad1 THEN 1 ELSE 0 END), 6) AS dp_is_sum, ROUND(AVG(CASE WHEN gq = {_DISTINCT}[2] THEN 1 ELSE 0 END), 6) AS gq_distinct, ROUND(AVG(CASE WHEN gq = {_SORTED}[2] THEN 1 ELSE 0 END), 6) AS gq_second, ROUND(AVG(CASE WHEN gq = {_SORTED}[2] - {_SORTED}[1] THEN 1 ELSE 0 END), 6) AS gq_gap FROM pls")
def agreement_rates(spark, sf_dir):
    return format_stats.agreement_rates(_pl(calls(spark, sf_dir)))


@query(DUCK_CALLS + _PL + f"SELECT pos, sample_idx, CASE WHEN pl_type IN (1, 2) THEN pl1 WHEN pl_type = 3 THEN {_DISTINCT}[2] END AS predicted FROM pls")
def gq_prediction(spark, sf_dir):
    return _pl(calls(spark, sf_dir)).select("pos", "sample_idx", g.gq_predict(F.col("pl")).alias("predicted"))


@query(DUCK_CALLS + ", r AS (SELECT ad0 / (ad0 + ad1) AS r FROM calls WHERE ad0 > 0 AND ad1 > 0)\nSELECT COUNT(*) AS n, COUNT(*) FILTER (r BETWEEN 0.3 AND 0.7) AS het_like, ROUND(AVG(r), 6) AS mean, ROUND(MEDIAN(r), 6) AS median FROM r")
def het_ratio(spark, sf_dir):
    return format_stats.het_ratio(calls(spark, sf_dir))


@query(DUCK_CALLS + _PL + "SELECT CASE WHEN pl0 <> 0 THEN 'first not 0' ELSE 'mismatch' END AS reason, COUNT(*) AS n FROM pls WHERE pl_type = 3 GROUP BY 1")
def pl_fallback_reasons(spark, sf_dir):
    return format_stats.fallback_reasons(_pl(calls(spark, sf_dir)))


@query(DUCK_CALLS + "SELECT r AS ratio, COUNT(*) FILTER (ABS(pl2 - r * pl1) <= 7) AS covered FROM calls, (SELECT CAST(UNNEST(range(8, 21)) AS INT) AS r) WHERE pl1 > 0 GROUP BY 1")
def best_ratio(spark, sf_dir):
    return format_stats.best_ratio(calls(spark, sf_dir), range(8, 21))


_REST = "LEAST(ABS(pl2 - 10 * pl1), ABS(pl2 - 11 * pl1), ABS(pl2 - 12 * pl1), ABS(pl2 - 15 * pl1))"


@query(DUCK_CALLS + f"SELECT COUNT(*) AS n, COUNT(*) FILTER ({_REST} <= 63) AS within_63, COUNT(*) FILTER ({_REST} <= 127) AS within_127 FROM calls WHERE pl1 > 0")
def pl_coverage(spark, sf_dir):
    return format_stats.coverage(calls(spark, sf_dir))


_VAR = lambda c: f"CAST(SUM(CASE WHEN 2 * {c} < 128 THEN 1 WHEN 2 * {c} < 16384 THEN 2 WHEN 2 * {c} < 2097152 THEN 3 ELSE 4 END) AS BIGINT)"


_LONG = "SELECT 'pl1' AS field, pl1 AS x FROM calls UNION ALL SELECT 'pl2', pl2 FROM calls UNION ALL SELECT 'dp', dp FROM calls"


@query(DUCK_CALLS + f", l AS ({_LONG}), c AS (SELECT field, CAST(CASE WHEN MAX(ABS(x)) < 128 THEN 1 WHEN MAX(ABS(x)) < 32768 THEN 2 ELSE 4 END * COUNT(x) AS BIGINT) AS fixed, CAST(SUM(strlen(CAST(x AS VARCHAR)) + 1) AS BIGINT) AS text, CAST(SUM(CASE WHEN x < 128 THEN 1 WHEN x < 16384 THEN 2 WHEN x < 2097152 THEN 3 ELSE 4 END) AS BIGINT) AS varint, {_VAR('x')} AS zigzag FROM l GROUP BY 1)\nSELECT *, CASE WHEN fixed <= LEAST(text, varint, zigzag) THEN 'fixed' WHEN text <= LEAST(varint, zigzag) THEN 'text' WHEN varint <= zigzag THEN 'varint' ELSE 'zigzag' END AS best FROM c")
def codec_cost(spark, sf_dir):
    return format_stats.codec_cost(calls(spark, sf_dir), ("pl1", "pl2", "dp"))


# --- exports and hashes ----------------------------------------------------


@query(DUCK_CALLS + "SELECT pos, sample_idx, CASE WHEN a1 < 0 OR a2 < 0 THEN 1 WHEN a1 = 1 AND a2 = 1 THEN 0 WHEN a1 = 1 OR a2 = 1 THEN 2 ELSE 3 END AS bed, CASE WHEN a1 < 0 OR a2 < 0 OR a1 > 1 OR a2 > 1 THEN 3 ELSE a1 + a2 END AS pgen FROM calls")
def plink_dosage(spark, sf_dir):
    return calls(spark, sf_dir).select("pos", "sample_idx", g.bed_code(F.col("a1"), F.col("a2")).alias("bed"), g.pgen_code(F.col("a1"), F.col("a2")).alias("pgen"))


@query(DUCK_SITES + "SELECT concat_ws(chr(9), chrom, id, '0', CAST(pos AS VARCHAR), split_part(alt, ',', 1), ref) AS line FROM sites")
def bim_lines(spark, sf_dir):
    from sitewise.sources import plink

    return plink.bim_lines(sites(spark, sf_dir))


@query(DUCK_SITES + "SELECT concat_ws(chr(9), chrom, CAST(pos AS VARCHAR), id, ref, alt) AS line FROM sites WHERE alt NOT LIKE '%<%' AND alt NOT LIKE '%,%'")
def pvar_lines(spark, sf_dir):
    from sitewise.sources import plink

    return plink.pvar_lines(sites(spark, sf_dir))


@query(DUCK_SITES + "SELECT chrom, pos, sha256(concat_ws(chr(9), chrom, CAST(pos AS VARCHAR), id, ref, array_to_string(list_sort(string_split('DP=' || qual || ';AC=' || alt, ';')), ';'))) AS hash FROM sites")
def canonical_hash(spark, sf_dir):
    info = g.canonical_info(F.concat(F.lit("DP="), F.col("qual"), F.lit(";AC="), F.col("alt")))
    return sites(spark, sf_dir).select("chrom", "pos", g.canonical_hash(F.col("chrom"), F.col("pos").cast("string"), F.col("id"), F.col("ref"), info).alias("hash"))


@query(DUCK_CALLS + _COUNTS + " GROUP BY chrom, pos ORDER BY ac DESC, chrom, pos LIMIT 10")
def top_sites(spark, sf_dir):
    return filters.first_records(counts.allele_counts(calls(spark, sf_dir), KEYS), 10, F.desc("ac"), "chrom", "pos")


# --- benchmark histories (months of orders stand in for runs) --------------

_HISTORY = "WITH h AS (SELECT o_orderpriority AS dataset, strftime(o_orderdate, '%Y-%m') AS month, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2), l AS (SELECT dataset, month, 'n' AS metric, CAST(n AS DOUBLE) AS value FROM h UNION ALL SELECT dataset, month, 'elapsed_s', total FROM h)"


def _history(spark, sf_dir):
    h = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("dataset"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    h = h.agg(F.count("*").cast("double").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("elapsed_s"))
    return bench.unpivot_metrics(h, ("dataset", "month"), ("n", "elapsed_s"))


@query(_HISTORY + " SELECT * FROM l")
def bench_unpivot(spark, sf_dir):
    return _history(spark, sf_dir)


_TREND = _HISTORY + ", p AS (SELECT *, LAG(value) OVER w AS prev, ROW_NUMBER() OVER (PARTITION BY dataset, metric ORDER BY month DESC) AS k, COUNT(*) OVER (PARTITION BY dataset, metric) AS n FROM l WINDOW w AS (PARTITION BY dataset, metric ORDER BY month)), t AS (SELECT dataset, metric, n, value AS last, prev, ROUND(value - prev, 6) AS delta, ROUND((value - prev) * 100 / NULLIF(prev, 0), 4) AS delta_pct FROM p WHERE k = 1)"


@query(_TREND + " SELECT * FROM t")
def bench_trend(spark, sf_dir):
    return bench.trend(_history(spark, sf_dir), ("dataset", "metric"), "month")


@query(_TREND + " SELECT * FROM t WHERE (metric = 'elapsed_s' AND delta_pct > -50.0) OR (metric = 'n' AND -delta_pct > 10.0)")
def bench_alert(spark, sf_dir):
    return bench.alerts(bench.trend(_history(spark, sf_dir), ("dataset", "metric"), "month"), limits={"elapsed_s": (-50.0, 1), "n": (10.0, -1)})


@query(_HISTORY + " SELECT a.dataset, a.metric, substr(a.month, 6) AS m, a.value AS base, b.value AS new, ROUND(b.value - a.value, 6) AS delta, ROUND((b.value - a.value) * 100 / NULLIF(a.value, 0), 4) AS delta_pct FROM l a JOIN l b ON a.dataset = b.dataset AND a.metric = b.metric AND substr(a.month, 6) = substr(b.month, 6) AND a.month LIKE '1995%' AND b.month LIKE '1996%'")
def bench_diff(spark, sf_dir):
    h = _history(spark, sf_dir).withColumn("m", F.substring("month", 6, 2))
    year = lambda y: h.filter(F.col("month").startswith(y)).drop("month")
    return bench.compare(year("1995"), year("1996"), ("dataset", "m"))


# --- sets and overlaps -----------------------------------------------------

_SETS = "WITH a AS (SELECT DISTINCT l_partkey AS pos FROM lineitem WHERE l_quantity > 40), b AS (SELECT DISTINCT l_partkey AS pos FROM lineitem WHERE l_discount > 0.08)"


def _sets(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    one = lambda c: df.filter(c).select(F.col("l_partkey").alias("pos")).distinct()
    return one("l_quantity > 40"), one("l_discount > 0.08D")


@query(_SETS + " SELECT pos FROM a INTERSECT SELECT pos FROM b")
def isec_intersect(spark, sf_dir):
    return setops.intersect(*_sets(spark, sf_dir), ("pos",))


@query(_SETS + " SELECT pos FROM a EXCEPT SELECT pos FROM b")
def isec_complement(spark, sf_dir):
    return setops.complement(*_sets(spark, sf_dir), ("pos",))


@query(_SETS + " SELECT pos, CAST(SUM(m) AS BIGINT) AS mask FROM (SELECT pos, 1 AS m FROM a UNION ALL SELECT pos, 2 FROM b) GROUP BY 1")
def isec_presence(spark, sf_dir):
    return setops.presence(_sets(spark, sf_dir), ("pos",))


@query("SELECT COALESCE(a.k, b.k) AS k, a.v AS \"left\", b.v AS \"right\" FROM (SELECT c_nationkey AS k, COUNT(*) AS v FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, COUNT(*) AS v FROM supplier GROUP BY 1) b ON a.k = b.k")
def merge_full_outer(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("v"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("v"))
    return setops.merge(a, b, ("k",), "v")


@query(_SETS + " SELECT pos FROM a UNION SELECT pos FROM b")
def concat_dedup(spark, sf_dir):
    return setops.concat_dedup(_sets(spark, sf_dir), ("pos",))


@query("SELECT p.p_brand AS chrom, p.p_partkey AS pos, i.p_partkey AS start FROM part p JOIN part i ON p.p_brand = i.p_brand AND p.p_partkey BETWEEN i.p_partkey AND i.p_partkey + i.p_size")
def annotate_interval(spark, sf_dir):
    points = sites(spark, sf_dir).select("chrom", "pos")
    spans = table(spark, sf_dir, "part").selectExpr("p_brand AS chrom", "p_partkey AS start", "p_partkey + p_size AS end")
    return setops.overlap_join(points, spans, 64).select("chrom", "pos", "start")


@query("WITH s AS (SELECT p_brand AS chrom, p_partkey AS pos, LAG(p_partkey) OVER w AS a, LEAD(p_partkey) OVER w AS b FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)) SELECT chrom, pos FROM s WHERE pos - a < 5 OR b - pos < 5")
def snp_gap(spark, sf_dir):
    return setops.near(sites(spark, sf_dir), 5, width=WIDTH).select("chrom", "pos")


_DOS = "(CASE WHEN a1 = 1 THEN 1 ELSE 0 END + CASE WHEN a2 = 1 THEN 1 ELSE 0 END)"


@query(DUCK_CALLS + f", d AS (SELECT pos, sample_idx AS s, {_DOS} AS g FROM calls WHERE a1 >= 0 AND a2 >= 0)\nSELECT x.s AS s1, y.s AS s2, COUNT(*) AS n, CAST(SUM(CASE WHEN x.g <> y.g THEN 1 ELSE 0 END) AS BIGINT) AS differ FROM d x JOIN d y ON x.pos = y.pos AND x.s < y.s GROUP BY 1, 2")
def gtcheck_pairs(spark, sf_dir):
    df = calls(spark, sf_dir).withColumn("dosage", g.dosage(F.col("a1"), F.col("a2"))).filter("dosage IS NOT NULL")
    samples = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample_idx"))
    return setops.concordance(df, ("pos",), samples=samples)


_OK = "(a1 >= 0 AND a2 >= 0)"
_NS = f"SUM(CASE WHEN {_OK} THEN 1 ELSE 0 END)"
_TAC = f"SUM(CASE WHEN {_OK} THEN (CASE WHEN a1 > 0 THEN 1 ELSE 0 END) + (CASE WHEN a2 > 0 THEN 1 ELSE 0 END) ELSE 0 END)"
_HET = f"SUM(CASE WHEN {_OK} AND (a1 > 0) <> (a2 > 0) THEN 1 ELSE 0 END)"


@query(DUCK_CALLS + f", t AS (SELECT chrom, pos, CAST({_NS} AS BIGINT) AS ns, CAST(2 * {_NS} AS BIGINT) AS an, CAST({_TAC} AS BIGINT) AS ac, CAST({_HET} AS BIGINT) AS ac_het, CAST({_TAC} - {_HET} AS BIGINT) AS ac_hom, COUNT(*) AS cells FROM calls GROUP BY 1, 2)\nSELECT chrom, pos, ns, an, ac, ac_het, ac_hom, ROUND(LEAST(ac / NULLIF(CAST(an AS DOUBLE), 0), 1 - ac / NULLIF(CAST(an AS DOUBLE), 0)), 6) AS maf, ROUND(1 - ns / cells, 6) AS f_missing FROM t")
def site_tags(spark, sf_dir):
    return setops.site_tags(calls(spark, sf_dir), KEYS)


# --- streams ---------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return ev.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


@query("WITH e AS (SELECT event_id, user_id, ts, CASE WHEN ts - LAG(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, SUM(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, MIN(ts) AS start, COUNT(*) AS n FROM s GROUP BY user_id, k")
def events_sessions(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    # a session ends strictly before the gap has passed; one microsecond more makes the gap inclusive
    out = ev.groupBy(F.session_window("ts", "30 minutes 1 microsecond").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


@query(_HISTORY + ", r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset, metric ORDER BY month DESC) AS k FROM l), w AS (SELECT dataset, metric, list(value ORDER BY month) AS v FROM r WHERE k <= 8 GROUP BY 1, 2)\nSELECT dataset, metric, array_to_string(list_transform(v, lambda x: substr('▁▂▃▄▅▆▇█', CASE WHEN list_max(v) = list_min(v) THEN 1 ELSE CAST(FLOOR((x - list_min(v)) * 7 / (list_max(v) - list_min(v))) AS INT) + 1 END, 1)), '') AS spark FROM w")
def bench_sparkline(spark, sf_dir):
    return bench.sparkline(_history(spark, sf_dir), ("dataset", "metric"), "month")


_ALTS = ", x AS (SELECT chrom, pos, ref, UNNEST(string_split(alt, ',')) AS a FROM sites)\n"
_TYPE = "CASE WHEN a = '.' THEN 'ref' WHEN contains(a, '<') OR contains(a, '*') THEN 'other' WHEN length(ref) = length(a) AND length(ref) = 1 THEN 'snp' WHEN length(ref) = length(a) THEN 'mnp' ELSE 'indel' END"


@query(DUCK_SITES + _ALTS + f"SELECT {_TYPE} AS type, COUNT(*) AS n FROM x GROUP BY 1")
def type_counts(spark, sf_dir):
    return plugins.type_counts(sites(spark, sf_dir))


@query(DUCK_SITES + _ALTS + "SELECT side, length, COUNT(*) AS n FROM (SELECT 'ref' AS side, length(ref) AS length FROM x UNION ALL SELECT 'alt', length(a) FROM x) GROUP BY 1, 2")
def allele_lengths(spark, sf_dir):
    return plugins.allele_lengths(sites(spark, sf_dir))


@query(DUCK_CALLS + ", c AS (" + _COUNTS + " GROUP BY chrom, pos)\nSELECT LEAST(CAST(FLOOR(af * 10) AS INT), 9) AS bin, COUNT(*) AS n FROM c GROUP BY 1")
def af_histogram(spark, sf_dir):
    return plugins.frequency_histogram(counts.allele_counts(calls(spark, sf_dir), KEYS))


@query(DUCK_CALLS + "SELECT sample_idx, COUNT(*) AS n, COUNT(*) FILTER (a1 < 0 OR a2 < 0) AS missing, COUNT(*) FILTER (a1 = 0 AND a2 = 0) AS hom_ref, COUNT(*) FILTER (a1 >= 0 AND a2 >= 0 AND a1 <> a2) AS het, COUNT(*) FILTER (a1 > 0 AND a1 = a2) AS hom_alt FROM calls GROUP BY 1")
def sample_statistics(spark, sf_dir):
    return plugins.sample_statistics(calls(spark, sf_dir))


@query(DUCK_CALLS + "SELECT pos, sample_idx, GREATEST(a1, 0) AS a1, GREATEST(a2, 0) AS a2 FROM calls")
def missing_to_ref(spark, sf_dir):
    return plugins.missing_to_ref(calls(spark, sf_dir)).select("pos", "sample_idx", "a1", "a2")


@query(DUCK_CALLS + ", al AS (SELECT pos, a, COUNT(*) AS c FROM (SELECT pos, a1 AS a FROM calls UNION ALL SELECT pos, a2 FROM calls) WHERE a >= 0 GROUP BY 1, 2), m AS (SELECT pos, a AS major FROM al QUALIFY ROW_NUMBER() OVER (PARTITION BY pos ORDER BY c DESC, a) = 1)\nSELECT pos, sample_idx, CASE WHEN a1 < 0 THEN COALESCE(major, 0) ELSE a1 END AS a1, CASE WHEN a2 < 0 THEN COALESCE(major, 0) ELSE a2 END AS a2 FROM calls LEFT JOIN m USING (pos)")
def missing_to_major(spark, sf_dir):
    return plugins.missing_to_major(calls(spark, sf_dir), ("pos",)).select("pos", "sample_idx", "a1", "a2")


@query(DUCK_CALLS + "SELECT pos, sample_idx, CASE WHEN dp < 10 THEN -1 ELSE a1 END AS a1, CASE WHEN dp < 10 THEN -1 ELSE a2 END AS a2 FROM calls")
def set_genotypes(spark, sf_dir):
    return plugins.set_genotypes(calls(spark, sf_dir), "dp < 10").select("pos", "sample_idx", "a1", "a2")


@query(DUCK_CALLS + ", x AS (SELECT pos, sample_idx % 2 = 0 AS g, UNNEST(list_distinct([a1, a2])) AS allele FROM calls)\nSELECT pos, allele, COUNT(*) AS cells FROM x WHERE allele > 0 GROUP BY 1, 2 HAVING bool_and(g)")
def novel_alleles(spark, sf_dir):
    return plugins.novel_alleles(calls(spark, sf_dir), "sample_idx % 2 = 0", ("pos",))


@query(DUCK_CALLS + ", m AS (SELECT pos, bit_or(CASE sample_idx WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 4 END) AS mask FROM calls WHERE sample_idx IN (1, 2, 3) AND (a1 > 0 OR a2 > 0) GROUP BY 1)\nSELECT CAST(mask AS BIGINT) AS mask, COUNT(*) AS n FROM m GROUP BY 1")
def shared_counts(spark, sf_dir):
    return plugins.shared_counts(calls(spark, sf_dir), (1, 2, 3), ("pos",))


@query("WITH s AS (SELECT p_brand AS chrom, p_partkey AS pos, p_partkey + p_size AS e FROM part), r AS (SELECT *, MAX(e) OVER (PARTITION BY chrom ORDER BY pos, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, LEAD(pos) OVER (PARTITION BY chrom ORDER BY pos, e) AS nx FROM s) SELECT chrom, pos, e AS \"end\" FROM r WHERE COALESCE(reach, -1) < pos AND (nx IS NULL OR nx > e)")
def without_overlaps(spark, sf_dir):
    df = table(spark, sf_dir, "part").selectExpr("p_brand AS chrom", "p_partkey AS pos", "p_partkey + p_size AS end")
    return plugins.without_overlaps(df, width=WIDTH)


@query("WITH s AS (SELECT p_brand AS chrom, p_partkey AS pos, p_size // 10 AS b, p_size AS dp FROM part), r AS (SELECT *, CASE WHEN LAG(b) OVER (PARTITION BY chrom ORDER BY pos) = b THEN 0 ELSE 1 END AS n FROM s), k AS (SELECT *, SUM(n) OVER (PARTITION BY chrom ORDER BY pos) AS k FROM r) SELECT chrom, MIN(pos) AS start, MAX(pos) AS end_pos, MIN(b) AS band, COUNT(*) AS n, MIN(dp) AS min_dp FROM k GROUP BY chrom, k")
def gvcf_reblock(spark, sf_dir):
    df = table(spark, sf_dir, "part").selectExpr("p_brand AS chrom", "p_partkey AS pos", "p_size AS dp")
    return plugins.reblock(df, F.expr("dp div 10"), width=WIDTH)


@query("SELECT p_brand AS chrom, p_partkey AS pos, (ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 7 AS chunk FROM part")
def scatter_chunks(spark, sf_dir):
    return plugins.scatter(sites(spark, sf_dir), 7, width=WIDTH).select("chrom", "pos", "chunk")


@query(DUCK_CALLS + ", e AS (SELECT pos, sample_idx, power(10.0, -pl0 / 10.0) AS x, power(10.0, -pl1 / 10.0) AS y, power(10.0, -pl2 / 10.0) AS z FROM calls)\nSELECT pos, sample_idx, ROUND(x / (x + y + z), 5) AS p0, ROUND(y / (x + y + z), 5) AS p1, ROUND(z / (x + y + z), 5) AS p2 FROM e")
def pl_probabilities(spark, sf_dir):
    p = plugins.pl_to_probabilities(F.col("pl"))
    df = _pl(calls(spark, sf_dir)).withColumn("p", p)
    return df.select("pos", "sample_idx", *(F.round(F.get("p", F.lit(i)), 5).alias(f"p{i}") for i in range(3)))


@query(DUCK_CALLS + ", h AS (SELECT child.pos, child.a1 AS c1, child.a2 AS c2, m.a1 AS m1, m.a2 AS m2, f.a1 AS f1, f.a2 AS f2 FROM calls child JOIN calls m ON m.pos = child.pos AND m.sample_idx = 2 JOIN calls f ON f.pos = child.pos AND f.sample_idx = 3 WHERE child.sample_idx = 1 AND LEAST(child.a1, child.a2, m.a1, m.a2, f.a1, f.a2) >= 0)\nSELECT 2 AS mother, 3 AS father, 1 AS child, COUNT(*) AS n, COUNT(*) FILTER (NOT ((c1 IN (m1, m2) AND c2 IN (f1, f2)) OR (c2 IN (m1, m2) AND c1 IN (f1, f2)))) AS bad FROM h HAVING COUNT(*) > 0")
def mendelian(spark, sf_dir):
    trios = spark.createDataFrame([(2, 3, 1)], "mother long, father long, child long")
    return plugins.mendelian(calls(spark, sf_dir), trios, ("pos",))


@query(DUCK_CALLS + "SELECT sample_idx, COUNT(*) AS n, ROUND(AVG(ad1 / (ad0 + ad1)), 6) AS alt_share FROM calls WHERE a1 >= 0 AND a2 >= 0 AND a1 <> a2 AND ad0 + ad1 > 0 GROUP BY 1")
def allele_balance(spark, sf_dir):
    return plugins.allele_balance(calls(spark, sf_dir))


@query(DUCK_CALLS + ", h AS (SELECT *, a1 > a2 AS s, LAG(a1 > a2) OVER (PARTITION BY sample_idx ORDER BY chrom, pos) AS b FROM calls WHERE a1 >= 0 AND a2 >= 0 AND a1 <> a2)\nSELECT sample_idx, COUNT(*) AS het, CAST(SUM(CASE WHEN b IS NULL THEN NULL WHEN s <> b THEN 1 ELSE 0 END) AS BIGINT) AS switches FROM h GROUP BY 1")
def switch_points(spark, sf_dir):
    return plugins.switch_points(calls(spark, sf_dir), width=WIDTH)


@query(DUCK_SITES + "SELECT chrom, pos FROM sites WHERE TRY_CAST(qual AS DOUBLE) > 20 AND (alt = 'G' OR pos % 2 = 1) AND NOT regexp_matches(id, '7$')".replace("pos % 2 = 1", "alt LIKE '%,T,%'"))
def expression_filter(spark, sf_dir):
    from sitewise.functions.expressions import compile_filter

    return sites(spark, sf_dir).filter(compile_filter('QUAL>20 && (ALT="G" || N_ALT>2) && ID!~"7$"')).select("chrom", "pos")


@query(DUCK_CALLS + f", t AS (SELECT chrom, pos, CAST({_NS} AS DOUBLE) AS n, CAST({_TAC} AS DOUBLE) AS ac, CAST({_HET} AS DOUBLE) AS het FROM calls GROUP BY 1, 2), u AS (SELECT *, ac / NULLIF(2 * n, 0) AS p, (ac - het) / 2 AS hom FROM t)\nSELECT chrom, pos, ROUND(CASE WHEN n > 0 THEN CASE WHEN n*p*p > 0 THEN (hom - n*p*p)*(hom - n*p*p)/(n*p*p) ELSE 0 END + CASE WHEN 2*n*p*(1-p) > 0 THEN (het - 2*n*p*(1-p))*(het - 2*n*p*(1-p))/(2*n*p*(1-p)) ELSE 0 END + CASE WHEN n*(1-p)*(1-p) > 0 THEN (n - hom - het - n*(1-p)*(1-p))*(n - hom - het - n*(1-p)*(1-p))/(n*(1-p)*(1-p)) ELSE 0 END END, 4) AS chi2 FROM u")
def hardy_weinberg(spark, sf_dir):
    return plugins.hardy_weinberg(setops.site_tags(calls(spark, sf_dir), KEYS)).select("chrom", "pos", "chi2")


_LEN = lambda c: f"CASE WHEN {c} < 128 THEN 1 WHEN {c} < 16384 THEN 2 WHEN {c} < 2097152 THEN 3 ELSE 4 END"
_ZIG = lambda c: _LEN(f"(CASE WHEN {c} >= 0 THEN 2 * ({c}) ELSE -2 * ({c}) - 1 END)")


_FITS = ", ".join(f"CAST(SUM(CASE WHEN ABS(st) < {1 << (k - 1)} AND ABS(pl2 - 11 * pl1) < {1 << (k - 1)} THEN 1 ELSE 0 END) AS BIGINT) AS bits_{k}" for k in (5, 6, 7))


@query(DUCK_CALLS + ", w AS (SELECT *, pl1 - COALESCE(LAG(pl1) OVER s, 0) AS da, pl2 - COALESCE(LAG(pl2) OVER s, 0) AS db, pl1 - COALESCE(LAG(pl1) OVER s, pl1) AS st FROM calls WHERE pl0 = 0 WINDOW s AS (PARTITION BY sample_idx ORDER BY chrom, pos))\n" + f"SELECT COUNT(*) AS n, CAST(SUM({_ZIG('pl1')} + {_ZIG('pl2')}) AS BIGINT) AS plain, CAST(SUM({_ZIG('da')} + {_ZIG('db')}) AS BIGINT) AS delta, CAST(SUM({_ZIG('pl1')} + {_ZIG('(pl2 - 11 * pl1)')}) AS BIGINT) AS residual, {_FITS} FROM w")
def pl_fallback_costs(spark, sf_dir):
    return ordered.fallback_costs(calls(spark, sf_dir), width=WIDTH)


_STEP = _ZIG("(pl1 - COALESCE(pa, 0))")


@query(DUCK_CALLS + ", k AS (SELECT * FROM calls WHERE pl0 = 0 AND (pl1 <> 0 OR pl2 <> 0) AND NOT (pl1 > 0 AND pl2 = 15 * pl1)), w AS (SELECT *, LAG(pl1) OVER s AS pa, LAG(pl2) OVER s AS pb FROM k WINDOW s AS (PARTITION BY sample_idx ORDER BY chrom, pos))\n" + "SELECT codec, CAST(bytes AS BIGINT) AS bytes FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS codec, SUM({e}) AS bytes FROM w" for k, e in {"baseline": f"{_ZIG('pl1')} + {_ZIG('pl2')}", **{f"ratio_{r}": f"{_STEP} + {_ZIG(f'(pl2 - {r} * pl1)')}" for r in (10, 11, 12)}, "adaptive": f"{_STEP} + 1 + LEAST(" + ", ".join(_ZIG(f"(pl2 - {r} * pl1)") for r in (10, 11, 12)) + ")", "joint_delta": f"{_STEP} + {_ZIG('(pl2 - COALESCE(pb, 0))')}"}.items()) + ")")
def pl_codecs(spark, sf_dir):
    return format_stats.pl_codecs(calls(spark, sf_dir), width=WIDTH)


@query(DUCK_CALLS + ", c AS (SELECT ad0, COUNT(*) AS c FROM calls GROUP BY 1)\nSELECT CAST(SUM(c) AS BIGINT) AS n, ROUND(log2(SUM(c)) - SUM(c * log2(c)) / SUM(c), 6) AS bits FROM c")
def ad_entropy(spark, sf_dir):
    return format_stats.entropy(calls(spark, sf_dir), F.col("ad0"))


@query(DUCK_SITES + "SELECT chrom, pos, qual FROM sites WHERE qual <> '.'")
def sparse_fields(spark, sf_dir):
    return format_stats.sparse(sites(spark, sf_dir), "qual").select("chrom", "pos", "qual")


@query(DUCK_CALLS + "SELECT pos, sample_idx, CASE WHEN pl0 <> 0 AND pl1 = 0 THEN concat_ws(',', pl1, pl0, pl2) WHEN pl0 <> 0 AND pl2 = 0 THEN concat_ws(',', pl2, pl0, pl1) ELSE concat_ws(',', pl0, pl1, pl2) END AS pl, CASE WHEN pl0 = 0 THEN 0 WHEN pl1 = 0 THEN 1 WHEN pl2 = 0 THEN 2 ELSE -1 END AS at FROM calls")
def pl_normal(spark, sf_dir):
    x = g.pl_normal(F.col("pl"))
    return _pl(calls(spark, sf_dir)).withColumn("x", x).select("pos", "sample_idx", F.array_join("x.pl", ",").alias("pl"), F.col("x.at").alias("at"))


@query(_HISTORY.replace(", l AS", ", t AS (SELECT dataset, month, ROUND(n / NULLIF(total, 0), 4) AS throughput FROM h), l AS") + " SELECT * FROM t")
def bench_throughput(spark, sf_dir):
    h = _history(spark, sf_dir).groupBy("dataset", "month").pivot("metric", ["n", "elapsed_s"]).agg(F.first("value"))
    return bench.throughput(h, "n", "elapsed_s").select("dataset", "month", "throughput")


@query(DUCK_CALLS + ", s AS (SELECT chrom, pos, SUM(ad0 + ad1) AS s FROM calls GROUP BY 1, 2), d AS (SELECT s - LAG(s) OVER (PARTITION BY chrom ORDER BY pos) AS d FROM s), v AS (SELECT CAST(d AS DOUBLE) AS x FROM d WHERE d IS NOT NULL)\nSELECT " + _DIST.replace("x < 5", "ABS(x) < 5") + " FROM v")
def sum_ad_difference(spark, sf_dir):
    """Signed differences; the share below 5 is of absolute values."""
    s = calls(spark, sf_dir).groupBy(*KEYS).agg(F.sum(F.col("ad0") + F.col("ad1")).alias("s"))
    d = ordered.neighbour(s, ("chrom",), ("pos",), {"before": F.col("s")}, width=WIDTH).filter("before IS NOT NULL")
    return format_stats.distribution(d, F.col("s") - F.col("before"), F.abs("x"))


@query("WITH e AS (SELECT p_brand AS chrom, p_partkey AS pos, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_partkey + p_size - 1 END AS \"end\", LEAD(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) SELECT chrom, pos, COALESCE(\"end\", pos) - pos AS diff FROM e WHERE n IS NULL OR COALESCE(\"end\", pos) + 1 <> n")
def end_exceptions(spark, sf_dir):
    df = table(spark, sf_dir, "part").selectExpr("p_brand AS chrom", "p_partkey AS pos", "CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_partkey + p_size - 1 END AS end")
    return ordered.end_exceptions(df, ("chrom",), width=WIDTH).select("chrom", "pos", "diff")


@query("SELECT a.p_brand AS chrom, a.p_partkey AS start, b.p_partkey AS start_b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <= b.p_partkey + b.p_size * 2 AND b.p_partkey <= a.p_partkey + a.p_size")
def overlap_intervals(spark, sf_dir):
    spans = lambda k: table(spark, sf_dir, "part").selectExpr("p_brand AS chrom", "p_partkey AS start", f"p_partkey + p_size * {k} AS end")
    return setops.overlap_intervals(spans(1), spans(2), 64).select("chrom", "start", "start_b")


_TEXT = "WITH s AS (SELECT p_brand AS chrom, p_type AS t FROM part)"


@query(_TEXT + ", c AS (SELECT chrom, t, COUNT(*) AS c FROM s GROUP BY 1, 2), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chrom ORDER BY c DESC, t) AS k, SUM(c) OVER (PARTITION BY chrom) AS n FROM c) SELECT chrom, t AS dominant, ROUND(c / n, 6) AS ratio, CAST(n - c AS BIGINT) AS patches FROM r WHERE k = 1")
def dominant_text(spark, sf_dir):
    return ordered.dominant(table(spark, sf_dir, "part").selectExpr("p_brand AS chrom", "p_type AS t"), "t", ("chrom",))


@query(_TEXT + ", c AS (SELECT t, COUNT(*) AS c FROM s GROUP BY 1) SELECT CAST(SUM(c) AS BIGINT) AS total, COUNT(*) AS uniques, MIN(t) AS least, MAX(t) AS largest, ROUND(SUM(c * length(t)) / SUM(c), 6) AS mean, ROUND(COUNT(*) / SUM(c), 6) AS repetition_ratio, ROUND(MAX(c) / SUM(c), 6) AS dominant_ratio, CASE WHEN MAX(c) / SUM(c) >= 0.7 THEN 'mask' WHEN COUNT(*) / SUM(c) < 0.3 THEN 'dictionary' ELSE 'raw' END AS encoding FROM c")
def field_analysis_text(spark, sf_dir):
    return ordered.field_analysis(table(spark, sf_dir, "part").selectExpr("p_type AS t"), "t")
