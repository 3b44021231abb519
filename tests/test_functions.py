import pytest
from pyspark.sql import functions as F

from sitewise.functions import genotype as g
from sitewise.functions.expressions import compile_filter, to_sql


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def ints(*v):
    return F.lit([*v]).cast("array<bigint>")


@pytest.mark.parametrize("text, want", [("29.7", 29), ("1e+06", 1), (".", 0), ("-3x", -3), ("", 0)])
def test_leading_int(spark, text, want):
    assert one(spark, g.leading_int(F.lit(text))) == want


@pytest.mark.parametrize("pl, want", [((0, 2, 30), 2), ((0, 2, 3), 1), ((0, 0, 0), 0), ((1, 2, 3), 3), ((0, 5), 3), ((0, 1, 2, 1, 2, 2), 1), ((0, 1, 2, 1, 9, 2), 3)])
def test_pl_type(spark, pl, want):
    assert one(spark, g.pl_type(ints(*pl))) == want


def test_likelihoods(spark):
    assert one(spark, g.second_min_distinct(ints(0, 0, 5))) == 5 and one(spark, g.second_min_distinct(ints(0, 0))) is None
    assert one(spark, g.second_min(ints(0, 0, 5))) == 0 and one(spark, g.gq_from_pl(ints(3, 9, 4))) == 1 and one(spark, g.gq_from_pl(ints(3))) == 0
    assert one(spark, g.pl_rebuild(F.lit(3), F.lit(9), F.lit(3))) == [0, 3, 9, 3, 9, 9]
    assert tuple(one(spark, g.pl_normal(ints(7, 0, 9)))) == ([0, 7, 9], 1)


@pytest.mark.parametrize("x, want", [(0, 0), (-1, 1), (1, 2), (-5, 9)])
def test_zigzag(spark, x, want):
    assert one(spark, g.zigzag(F.lit(x))) == want


@pytest.mark.parametrize("x, want", [(0, 1), (127, 1), (128, 2), (2**62, 9)])
def test_varint(spark, x, want):
    assert one(spark, g.varint_len(F.lit(x))) == want


@pytest.mark.parametrize("gt, alleles, phased", [("0/1", [0, 1], False), (".|1", [None, 1], True), ("1", [1], None), ("./.", [None, None], False)])
def test_genotypes(spark, gt, alleles, phased):
    r = one(spark, g.parse_gt(F.lit(gt)))
    assert (r.alleles, r.phased) == (alleles, phased)
    assert one(spark, g.format_gt(g.parse_gt(F.lit(gt))["alleles"], g.parse_gt(F.lit(gt))["phased"])) == gt


def test_predicates(spark):
    assert one(spark, g.is_missing(F.lit([0, -1]))) and one(spark, g.is_hom_ref(F.lit([0, 0]))) and one(spark, g.is_het(F.lit([0, 1]))) and not one(spark, g.is_het(F.lit([-1, 1])))


@pytest.mark.parametrize("text, want", [("POS>3 && ID=\"a\"", ["a"]), ("!(POS>3)", ["b"]), ("ID~\"^[ab]\" & POS*2-1>=3", ["a", "b"]), ("N_ALT>1 || ILEN=2", ["a", "b"]), ("QUAL>5", ["a"]), ("MAX(v)>4", ["b"])])
def test_expressions(spark, text, want):
    df = spark.createDataFrame([("a", 5, "A", "C,T", "9", [1, 2]), ("b", 2, "A", "GTT", ".", [5])], "id string, pos long, ref string, alt string, qual string, v array<int>")
    assert sorted(r.id for r in df.filter(compile_filter(text)).collect()) == want


@pytest.mark.parametrize("text", ["POS>", "(POS", "NOPE(POS)", "POS ? 3", "POS 3"])
def test_bad_expressions(text):
    with pytest.raises(ValueError):
        to_sql(text)
