import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from sitewise.llm import common, langid, mixing, quality, queries
from tests.llm.test_operators import brute_force, verdict
from tests.oracle import connect, difference


def test_stages_keep_columns_and_clean_rows(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("kept", F.lit("clash")).withColumn("score", F.lit(3))
    docs = table.unionByName(table.limit(3)).unionByName(table.limit(1).withColumns({"text": F.lit(None).cast("string"), "doc_id": F.lit(10**9).cast("long"), "lang": F.lit(None).cast("string")}))
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(cp.STAGES) - 1:
            assert out.filter("not round_trip").count() == 0 and out.count() == docs.count()
            break
        assert out.schema.names == table.schema.names
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.filter("kept <> 'clash' or score <> 3").count() == 0
        if name == "n-gram jaccard join":
            assert after.count() == after.select("doc_id").distinct().count() == after.select("text").distinct().count()
        docs = after
    assert [n for n, _ in cp.STAGES] == ["quality rules", "language id", "n-gram jaccard join", "mixing", "bpe"]


def test_jaccard_keeps_one_row_a_class(spark, sf_dir):
    """Repeated and null ids: no class is lost, and none stays twice."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(100)) for x in "abcd")
    near = lambda t: t.replace("50", "x50")
    rows = [(1, a), (1, b), (1, c), (2, near(a)), (3, b), (None, near(c)), (None, d), (None, d), (None, near(d)), (7, " "), (7, " ")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, kept string")
    out = cp.jaccard_join(spark, docs, sf_dir).collect()
    groups = sorted(r.text[0] for r in out)
    assert groups == [" ", " ", "a", "b", "c", "d"]
    assert {r.text[0]: r.doc_id for r in out if r.text[0] in "abc"} == {"a": 1, "b": 1, "c": 1}


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages_match_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality.fit_rules(docs, labels)
    assert ids(cp.quality_rules(spark, docs, sf_dir)) == Counter(i for i, t in rows if verdict(t, rules) is None)
    model = langid.fit_centroids(docs)
    assert ids(cp.language_id(spark, docs, sf_dir)) == Counter(i for (i, _), p in zip(rows, model.predict([t for _, t in rows])) if not p[2])
    worded = [(i, t) for i, t in rows if re.search(r"[^\x20\x09-\x0D]", t or "")]
    classes = defaultdict(list)
    for i, c, *_ in brute_force(worded):
        classes[c].append(i)
    blank = [i for i, t in rows if (i, t) not in worded]
    assert ids(cp.jaccard_join(spark, docs, sf_dir)) == Counter([min(v) for v in classes.values()] + blank)
    lib = __import__("tokenizers").Tokenizer.from_file(queries._tokenizer("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in cp.bpe_tokens(spark, docs, sf_dir).collect()}
    assert all(got[i].ids == lib.encode(t or "", add_special_tokens=False).ids and got[i].round_trip for i, t in rows)


def test_mixing_stage_matches_brute_force(spark, sf_dir):
    """Posteriors, rates and copies of the stage, worked out row by row."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model, mix, scored = mixing.mix_rates(docs, labels, queries.label_domain(), cp.WEIGHTS, lift=cp.LIFT)
    seen = {r.doc_id: r for r in scored.collect()}
    share = {r.doc_id: r.u for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) / F.lit(float(1 << 20))).alias("u")).collect()}
    want, totals = Counter(), [0.0] * len(model.domains)
    for i, r in seen.items():
        assert sum(r.posterior) == pytest.approx(1)
        rate = max(0.0, 1 - sum(x * y for x, y in zip(mix.slope, r.posterior)))
        totals = [a + rate * r.n_tokens * p for a, p in zip(totals, r.posterior)]
        if n := math.floor(rate + share[i]):
            want[i] = n
    assert ids(cp.mix_sources(spark, docs, sf_dir)) == want
    assert totals == pytest.approx(mix.expected, rel=1e-9) and (not mix.met or totals == pytest.approx(mix.targets, abs=1e-4 * sum(mix.targets)))


def test_stages_write_few_files(spark, sf_dir, tmp_path, monkeypatch):
    """Tables of many small partitions: no stage writes or returns more files than there are cores."""
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    docs, cores = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(64), spark.sparkContext.defaultParallelism
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(before, ("64", "false")):
            spark.conf.set(k, v)
        for i, (_, stage) in enumerate(cp.STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/sitewise/result{i}")
        files = Counter(p.parent.name for p in tmp_path.glob("sitewise/*/part-*"))
        assert len(files) > len(cp.STAGES) and max(files.values()) <= cores
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_targets_are_met(spark, sf):
    """On larger tables the stated shares are reached, for the query and for the pipeline."""
    folder = Path(f"/root/testdata/sf{sf}")
    if not folder.exists():
        pytest.skip("no such tables")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    for weights, lift in ((queries.WEIGHTS, None), (cp.WEIGHTS, cp.LIFT)):
        _, mix, _ = mixing.mix_rates(docs, labels, queries.label_domain(), weights, lift=lift)
        assert mix.met and all(abs(g - t) <= 1e-3 * sum(mix.targets) for g, t in zip(mix.expected, mix.targets))


@pytest.mark.filterwarnings("ignore:domains with too few")
def test_a_domain_of_one_row_moves_no_rates(spark, tmp_path):
    """One labelled row is no domain: no document is repeated over and over for its target, and none is lost for it."""
    rng = random.Random(8)
    words = [a + b for a in "bcdfglmnprst" for b in ("ane", "ilo", "omu", "eri", "uta")]
    text = lambda n, *more: " ".join([*rng.choices(words, k=n), *more])
    rows = [(i, text(rng.choice((6, 40, 90))), 1, 0) for i in range(400)] + [(400 + i, text(60, "idiot", "idiot"), 1, 1) for i in range(80)] + [(480, text(5), 0, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int").write.parquet(str(tmp_path / "rows"))
    docs = spark.read.parquet(str(tmp_path / "rows"))
    docs.select("doc_id", "quality", "toxic").write.parquet(str(tmp_path / "labels.parquet"))
    docs = docs.select("doc_id", "text")
    with pytest.warns(UserWarning, match="quality=0 toxic=0': 1"):
        model, mix, _ = mixing.mix_rates(docs, spark.read.parquet(str(tmp_path / "labels.parquet")), queries.label_domain(), cp.WEIGHTS, lift=cp.LIFT)
    assert mix.met and model.domains == ["quality=1 toxic=0", "quality=1 toxic=1"]
    got = ids(cp.mix_sources(spark, docs, str(tmp_path)))
    assert max(got.values()) <= 2 and set(range(400)) <= set(got)


def test_stages_take_empty_tables(spark, sf_dir):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, sf_dir, name):
    assert difference(queries.QUERIES[name](spark, sf_dir), queries.ORACLE[name], connect(sf_dir)) is None
