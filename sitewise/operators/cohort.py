"""Cohort tools: ploidy, sparsity, shared genotypes, strands of trios, linkage, runs of homozygosity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import neighbour, run_blocks, running

_CALLED = "a1 >= 0 AND a2 >= 0"


def ploidy_ranges(calls: DataFrame, width: int | None = None, sample: str = "sample_idx") -> DataFrame:
    """(sample, chrom, start, end_pos, ploidy): stretches of sites at which a sample's called genotypes have one width.

    ``calls`` has ``gt``; genotypes with a missing allele are passed over."""
    df = calls.filter(F.forall("gt", lambda a: F.coalesce(a >= 0, F.lit(False))) & (F.size("gt") > 0))
    df = run_blocks(df, F.size("gt"), (sample, "chrom"), ("pos",), width)
    return df.groupBy(sample, "chrom", "__run").agg(F.min("pos").alias("start"), F.max("pos").alias("end_pos"), F.first("__band").alias("ploidy")).drop("__run")


def fix_ploidy(calls: DataFrame, rules: DataFrame, sexes: DataFrame, default: int = 2, sample: str = "sample_idx") -> DataFrame:
    """``calls`` with ``gt`` of the ploidy that ``rules`` (chrom, start, end, sex, ploidy) give a sample's sex there.

    Longer genotypes are cut, shorter ones repeat their last allele; ``sexes`` is (sample, sex). Of
    several rules that fit the least ploidy counts; without one it is ``default``. Rules are few.
    """
    by_sex = rules.groupBy("chrom", F.col("sex").alias("__sex")).agg(F.collect_list(F.struct("start", "end", "ploidy")).alias("__rules"))
    df = calls.join(sexes.select(sample, F.col("sex").alias("__sex")), sample, "left").join(by_sex, ["chrom", "__sex"], "left")
    fit = F.filter("__rules", lambda r: F.col("pos").between(r["start"], r["end"]))
    df = df.withColumn("__p", F.coalesce(F.array_min(F.transform(fit, lambda r: r["ploidy"])), F.lit(default)))
    longer = F.concat("gt", F.array_repeat(F.element_at("gt", -1), F.col("__p") - F.size("gt")))
    df = df.withColumn("gt", F.when(F.size("gt") >= F.col("__p"), F.slice("gt", F.lit(1), F.col("__p"))).otherwise(longer))
    return df.select(*calls.columns)


def sparse_samples(calls: DataFrame, samples: Sequence, bins: Column, least: int = 1, sample: str = "sample_idx") -> DataFrame:
    """(bin, sample): those of ``samples`` with fewer than ``least`` called genotypes in a region where any sample has one.

    The regions are repeated for each sample, which is the form of the answer at its largest."""
    called = calls.filter(_CALLED).select(sample, bins.alias("bin"))
    enough = called.groupBy("bin", sample).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    wanted = called.select("bin").distinct().withColumn(sample, F.explode(F.lit(list(samples)).cast(f"array<{calls.schema[sample].dataType.simpleString()}>")))
    return wanted.join(enough, ["bin", sample], "left_anti")


def exclusive_genotypes(calls: DataFrame, chosen: Sequence, keys: Sequence[str], sample: str = "sample_idx") -> DataFrame:
    """(keys, genotype): sites where all chosen samples share a genotype that no other sample has.

    Genotypes are sorted allele pairs; a site where a chosen sample is missing is none."""
    pair = F.concat_ws("/", F.least("a1", "a2"), F.greatest("a1", "a2"))
    inside = F.col(sample).isin(*chosen)
    df = calls.withColumn("__g", pair)
    sites = df.filter(inside).groupBy(*keys).agg(F.count("*").alias("n"), F.min("__g").alias("genotype"), F.max("__g").alias("__m"), F.min(F.least("a1", "a2")).alias("__low"))
    sites = sites.filter((F.col("n") == len(chosen)) & (F.col("genotype") == F.col("__m")) & (F.col("__low") >= 0)).select(*keys, "genotype")
    others = df.filter(~inside).select(*keys, F.col("__g").alias("genotype")).distinct()
    return sites.join(others, [*keys, "genotype"], "left_anti")


def keep_identical(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Calls of ``a``; where ``b`` has the same cell with another genotype (in any order of alleles), alleles become missing."""
    other = b.select(*keys, F.least("a1", "a2").alias("__l"), F.greatest("a1", "a2").alias("__h"))
    same = (F.least("a1", "a2") == F.col("__l")) & (F.greatest("a1", "a2") == F.col("__h"))
    df = a.join(other, list(keys), "left")
    return df.withColumns({c: F.when(F.col("__l").isNotNull() & ~same, F.lit(-1).cast("bigint")).otherwise(F.col(c)) for c in ("a1", "a2")}).drop("__l", "__h")


def trios_of(calls: DataFrame, trios: DataFrame, keys: Sequence[str], sample: str = "sample_idx") -> DataFrame:
    """One row for each trio and site called in all three: child1, child2, mother1, ..."""
    cell = lambda who: calls.filter(_CALLED).select(*keys, F.col(sample).alias(who), F.col("a1").alias(f"{who}1"), F.col("a2").alias(f"{who}2"))
    return cell("child").join(trios, "child").join(cell("mother"), [*keys, "mother"]).join(cell("father"), [*keys, "father"])


def _consistent() -> Column:
    of = lambda a, who: (F.col(a) == F.col(f"{who}1")) | (F.col(a) == F.col(f"{who}2"))
    return (of("child1", "mother") & of("child2", "father")) | (of("child2", "mother") & of("child1", "father"))


def trio_statistics(calls: DataFrame, trios: DataFrame, keys: Sequence[str], sample: str = "sample_idx") -> DataFrame:
    """By trio: called sites, those with an alternate allele, Mendelian errors, new alleles of the child,
    and alternates that a heterozygous parent of a heterozygous child passed on, or did not."""
    df = trios_of(calls, trios, keys, sample)
    alleles = ("child1", "child2", "mother1", "mother2", "father1", "father2")
    n = lambda c: F.sum(c.cast("bigint"))
    alt = F.greatest(*alleles) > 0
    parents = F.array(*alleles[2:])
    new = ~F.array_contains(parents, F.col("child1")) | ~F.array_contains(parents, F.col("child2"))
    het = lambda who: (F.col(f"{who}1") != F.col(f"{who}2")) & (F.least(f"{who}1", f"{who}2") == 0)
    hom_ref = lambda who: (F.col(f"{who}1") == 0) & (F.col(f"{who}2") == 0)
    one_het = (het("mother") & hom_ref("father")) | (het("father") & hom_ref("mother"))
    return df.groupBy("mother", "father", "child").agg(
        F.count("*").alias("n"), n(alt).alias("non_ref"), n(~_consistent()).alias("errors"), n(new).alias("novel"),
        n(one_het & het("child")).alias("transmitted"), n(one_het & hom_ref("child")).alias("untransmitted"),
    )


def de_novo(calls: DataFrame, trios: DataFrame, keys: Sequence[str], sample: str = "sample_idx") -> DataFrame:
    """(mother, father, child, keys, allele): alleles of a child that neither parent has, at sites no transmission explains."""
    df = trios_of(calls, trios, keys, sample).filter(~_consistent())
    seen = F.array("mother1", "mother2", "father1", "father2")
    df = df.withColumn("allele", F.explode(F.array_distinct(F.array_except(F.array("child1", "child2"), seen))))
    return df.filter("allele > 0").select("mother", "father", "child", *keys, "allele")


def parental_origin(calls: DataFrame, trios: DataFrame, keys: Sequence[str], sample: str = "sample_idx") -> DataFrame:
    """By trio: heterozygous calls of the child whose alternate can only be the mother's, or only the father's."""
    df = trios_of(calls, trios, keys, sample).filter("child1 <> child2 AND least(child1, child2) = 0")
    alt = F.greatest("child1", "child2")
    has = lambda who: (F.col(f"{who}1") == alt) | (F.col(f"{who}2") == alt)
    n = lambda c: F.sum(c.cast("bigint"))
    return df.groupBy("mother", "father", "child").agg(F.count("*").alias("het"), n(has("mother") & ~has("father")).alias("maternal"), n(has("father") & ~has("mother")).alias("paternal"))


def trio_switches(calls: DataFrame, trios: DataFrame, width: int | None = None, sample: str = "sample_idx") -> DataFrame:
    """By trio: heterozygous calls of the child that the parents phase, and changes of side between
    neighbours on a chromosome of the child's own phase against the parents'."""
    df = trios_of(calls, trios, ("chrom", "pos"), sample).filter("child1 <> child2")
    of = lambda a, who: (F.col(a) == F.col(f"{who}1")) | (F.col(a) == F.col(f"{who}2"))
    one, two = of("child1", "mother") & of("child2", "father"), of("child2", "mother") & of("child1", "father")
    df = df.withColumn("__side", F.when(one & ~two, 0).when(two & ~one, 1)).filter("__side IS NOT NULL")
    by = ("mother", "father", "child", "chrom")
    df = neighbour(df, by, ("pos",), {"__b": F.col("__side")}, width=width)
    return df.groupBy("mother", "father", "child").agg(F.count("*").alias("phased"), F.sum((F.col("__b").isNotNull() & (F.col("__b") != F.col("__side"))).cast("bigint")).alias("switches"))


def allele_depth_bias(calls: DataFrame, pairs: DataFrame, keys: Sequence[str], sample: str = "sample_idx", least: int = 0) -> DataFrame:
    """(sample, control, keys, n11, n12, n21, n22, p): Fisher's exact test of the depths (ad0, ad1) of two samples.

    The two-sided p-value sums the probabilities of all tables as unlikely as the one seen, or less
    likely; cells with a smaller depth than ``least`` in both are left out.
    """
    one = calls.select(*keys, F.col(sample).alias("sample"), F.col("ad0").alias("n11"), F.col("ad1").alias("n12"))
    two = calls.select(*keys, F.col(sample).alias("control"), F.col("ad0").alias("n21"), F.col("ad1").alias("n22"))
    df = one.join(pairs, "sample").join(two, [*keys, "control"]).filter(F.greatest(F.col("n11") + F.col("n12"), F.col("n21") + F.col("n22")) >= least)
    kept = ["sample", "control", *keys, "n11", "n12", "n21", "n22"]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            n = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in kept[-4:]]
            p = [fisher(*map(int, x)) for x in zip(*n)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.array(p, float), pa.float64())], names=[*b.schema.names, "p"])

    from pyspark.sql import types as T

    df = df.select(*kept)
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("p", T.DoubleType())]))


def fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p-value of a table of two rows and two columns."""
    from math import exp, lgamma

    rows, column, total = (a + b, c + d), a + c, a + b + c + d
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    log = lambda k: choose(rows[0], k) + choose(rows[1], column - k) - choose(total, column)
    seen = log(a)
    return min(1.0, sum(exp(x) for k in range(max(0, column - rows[1]), min(rows[0], column) + 1) if (x := log(k)) <= seen + 1e-7))


def imputation_score(df: DataFrame, keys: Sequence[str], p: Sequence[str] = ("p0", "p1", "p2")) -> DataFrame:
    """(keys, n, info): information of a site's genotype probabilities against allele counts in Hardy-Weinberg proportion."""
    total = sum((F.col(c) for c in p), F.lit(0.0))
    q = [F.when(total > 0, F.col(c) / total).otherwise(0.0) for c in p]
    mean, square = q[1] + 2 * q[2], q[1] + 4 * q[2]
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(mean).alias("e"), F.sum(mean * mean).alias("e2"), F.sum(square).alias("f"))
    theta = F.col("e") / (2 * F.col("n"))
    info = F.when((theta > 0) & (theta < 1), 1 - (F.col("f") - F.col("e2")) / (2 * F.col("n") * theta * (1 - theta))).otherwise(1.0)
    return out.select(*keys, "n", F.round(info, 5).alias("info"))


def indel_statistics(calls: DataFrame, sites: DataFrame, keys: Sequence[str], longest: int = 20) -> DataFrame:
    """(length, sites, het, hom, mean_alt_share): by length of the first ALT less REF, cut at +-``longest``; SNPs are left out.

    ``calls`` has a1, a2, ad0 and ad1, ``sites`` REF and ALT."""
    size = F.length(F.substring_index("alt", ",", 1)) - F.length("ref")
    keep = sites.filter(~F.col("alt").contains("<") & (F.col("alt") != ".")).withColumn("length", F.greatest(F.lit(-longest), F.least(F.lit(longest), size)).cast("bigint")).filter("length <> 0")
    df = keep.select(*keys, "length").join(calls.filter("a1 >= 0 AND a2 >= 0 AND (a1 = 1 OR a2 = 1)").select(*keys, "a1", "a2", "ad0", "ad1"), list(keys), "left")
    het = F.col("a1").isNotNull() & (F.col("a1") != F.col("a2"))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    share = F.avg(F.when(het & (F.col("ad0") + F.col("ad1") > 0), F.col("ad1") / (F.col("ad0") + F.col("ad1"))))
    out = df.groupBy("length").agg(n(het).alias("het"), n(F.col("a1") == F.col("a2")).alias("hom"), F.round(share, 6).alias("mean_alt_share"))
    return keep.groupBy("length").agg(F.count("*").alias("sites")).join(out, "length")


def linkage(calls: DataFrame, window: int, sample: str = "sample_idx", chrom: str = "chrom", pos: str = "pos", dosage: str = "dosage") -> DataFrame:
    """(chrom, pos_a, pos_b, n, r2): squared correlation of dosages of sites at most ``window`` positions apart.

    Sites meet in blocks of the window's width, so that the join has an equality key; a site meets
    those of its own block and the next."""
    cells = calls.select(chrom, pos, sample, F.col(dosage).cast("double").alias("d"), F.floor(F.col(pos) / window).alias("__k"))
    a = cells.select(chrom, F.col(pos).alias("pos_a"), sample, F.col("d").alias("x"), F.explode(F.array("__k", F.col("__k") + 1)).alias("__k"))
    b = cells.select(chrom, F.col(pos).alias("pos_b"), sample, F.col("d").alias("y"), "__k")
    df = a.join(b, [chrom, sample, "__k"]).filter((F.col("pos_b") > F.col("pos_a")) & (F.col("pos_b") - F.col("pos_a") <= window))
    out = df.groupBy(chrom, "pos_a", "pos_b").agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    return out.filter("vx > 0 AND vy > 0").select(chrom, "pos_a", "pos_b", "n", F.round(F.col("c") * F.col("c") / (F.col("vx") * F.col("vy")), 6).alias("r2"))


def prune(sites: DataFrame, window: int, most: int, rank: Sequence[Column], chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """At most ``most`` sites of each window of positions, the first by ``rank``."""
    from pyspark.sql import Window as W

    w = W.partitionBy(chrom, F.floor(F.col(pos) / window)).orderBy(*rank)
    return sites.withColumn("__i", F.row_number().over(w)).filter(F.col("__i") <= most).drop("__i")


def homozygous_runs(calls: DataFrame, least: int, width: int | None = None, sample: str = "sample_idx") -> DataFrame:
    """(sample, chrom, start, end_pos, n): runs of at least ``least`` neighbouring called sites without a heterozygous call."""
    df = run_blocks(calls.filter(_CALLED), F.col("a1") == F.col("a2"), (sample, "chrom"), ("pos",), width).filter("__band")
    return df.groupBy(sample, "chrom", "__run").agg(F.min("pos").alias("start"), F.max("pos").alias("end_pos"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("__run")


def guess_ploidy(calls: DataFrame, sample: str = "sample_idx", floor: float = 1e-3) -> DataFrame:
    """(sample, n, haploid, diploid, guess): mean log10 likelihoods of a haploid and a diploid genome from three
    likelihoods a cell (phred-scaled pl0, pl1, pl2), with the site's alternate frequency as prior."""
    from sitewise.operators.counts import allele_counts

    af = allele_counts(calls, ("chrom", "pos"), compat=False).select("chrom", "pos", F.col("af").alias("p")).filter("p IS NOT NULL")
    like = lambda c: F.pow(F.lit(10.0), -F.col(c) / 10.0)
    p = F.col("p")
    two = like("pl0") * (1 - p) * (1 - p) + 2 * like("pl1") * p * (1 - p) + like("pl2") * p * p
    one = like("pl0") * (1 - p) + like("pl2") * p
    df = calls.join(af, ["chrom", "pos"])
    out = df.groupBy(sample).agg(F.count("*").alias("n"), F.round(F.avg(F.log10(F.greatest(one, F.lit(floor)))), 5).alias("haploid"), F.round(F.avg(F.log10(F.greatest(two, F.lit(floor)))), 5).alias("diploid"))
    return out.withColumn("guess", F.when(F.col("haploid") > F.col("diploid"), 1).otherwise(2))


def sample_thresholds(calls: DataFrame, depths: Sequence[int], sample: str = "sample_idx") -> DataFrame:
    """(sample, least_dp, n, het, hom_alt): counts of called cells of at least each depth."""
    df = calls.filter(_CALLED).withColumn("least_dp", F.explode(F.filter(F.array(*map(F.lit, depths)), lambda d: d <= F.col("dp"))))
    n = lambda c: F.sum(c.cast("bigint"))
    a, b = F.col("a1"), F.col("a2")
    return df.groupBy(sample, "least_dp").agg(F.count("*").alias("n"), n(a != b).alias("het"), n((a == b) & (a > 0)).alias("hom_alt"))


def private_sites(calls: DataFrame, keys: Sequence[str], sample: str = "sample_idx") -> DataFrame:
    """(keys, sample): sites at which a single sample has an alternate allele."""
    carry = calls.filter("a1 > 0 OR a2 > 0").groupBy(*keys).agg(F.count_distinct(sample).alias("n"), F.min(sample).alias(sample))
    return carry.filter("n = 1").drop("n")


def uncalled_sites(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sites at which no sample has a called genotype."""
    called = F.max(F.expr(f"CASE WHEN {_CALLED} THEN 1 ELSE 0 END"))
    return calls.groupBy(*keys).agg(called.alias("__c")).filter("__c = 0").drop("__c")


def excess_heterozygosity(tags: DataFrame) -> DataFrame:
    """``tags`` (ns, ac, ac_het) with exact tests of Hardy-Weinberg proportions: ``hwe`` (two-sided) and
    ``exc_het`` (of as many heterozygotes or more)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            get = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
            tests = [hardy_weinberg_exact(n, ac, het) for n, ac, het in zip(get("ns"), get("ac"), get("ac_het"))]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([t[i] for t in tests], pa.float64()) for i in (0, 1))], names=[*b.schema.names, "hwe", "exc_het"])

    from pyspark.sql import types as T

    return tags.mapInArrow(run, T.StructType([*tags.schema.fields, T.StructField("hwe", T.DoubleType()), T.StructField("exc_het", T.DoubleType())]))


def hardy_weinberg_exact(n: int, ac: int, het: int) -> tuple[float, float]:
    """(two-sided p-value, probability of ``het`` or more heterozygotes) among n samples with ac alternates."""
    from math import exp, lgamma, log

    rare = min(ac, 2 * n - ac)
    if n == 0 or rare == 0:
        return 1.0, 1.0

    def weight(h: int) -> float:
        a = (rare - h) // 2
        return h * log(2) - lgamma(h + 1) - lgamma(a + 1) - lgamma(n - h - a + 1)

    logs = {h: weight(h) for h in range(rare % 2, rare + 1, 2)}
    top = max(logs.values())
    p = {h: exp(x - top) for h, x in logs.items()}
    total, seen = sum(p.values()), p.get(het, 0.0)
    return min(1.0, sum(x for x in p.values() if x <= seen * (1 + 1e-9)) / total), min(1.0, sum(x for h, x in p.items() if h >= het) / total)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "Iterator", "Sequence", "Column", "DataFrame", "F", "neighbour", "run_blocks", "running")]
