from pyspark.sql import functions as F

from sitewise.adapter import DUCK_CALLS
from sitewise.plans import queries
from tests.oracle import connect, difference

#: Over all cells, with the sample itself in the key.
WHOLE = DUCK_CALLS + ", r AS (SELECT chrom, pos, string_agg(CAST(sample_idx AS VARCHAR) || ':' || CAST(a1 AS VARCHAR) || ':' || CAST(a2 AS VARCHAR), ',' ORDER BY sample_idx) AS row FROM calls GROUP BY 1, 2), m AS (SELECT row, MIN(pos) AS copy_of FROM r GROUP BY 1)\nSELECT chrom, pos, copy_of FROM r JOIN m USING (row) WHERE pos > copy_of"


def test_dup_rows_reads_whole_rows(spark, sf_dir):
    assert difference(queries.dup_rows(spark, sf_dir), WHOLE, connect(sf_dir)) is None


def test_dup_rows_finds_planted_copy(spark, sf_dir, monkeypatch):
    """A copied site is found in whole; one that differs in a sample number alone is none."""
    cells = queries.calls(spark, sf_dir)
    first = cells.agg(F.min("pos")).first()[0]
    site = cells.filter(F.col("pos") == first)
    moved = site.withColumn("sample_idx", F.col("sample_idx") + 16)
    planted = cells.unionByName(site.withColumn("pos", F.lit(10**6).cast("bigint"))).unionByName(moved.withColumn("pos", F.lit(10**6 + 1).cast("bigint")))
    monkeypatch.setattr(queries, "calls", lambda *_: planted)
    found = {(r.pos, r.copy_of) for r in queries.dup_rows(spark, sf_dir).collect()}
    assert (10**6, first) in found and not any(p == 10**6 + 1 for p, _ in found)
