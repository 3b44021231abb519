"""A corpus pipeline of five of the corpus operators, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the
last return the columns of the documents they got, in few partitions (``common.few``), as each is
written. Documents without words fail the quality rules. Nulls in other columns, repeated rows and further columns pass through unharmed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.llm import bpe, jaccard, langid, mixing, quality
from sitewise.llm.common import few, stored, table
from sitewise.llm.queries import _tokenizer, label_domain

#: Shares of expected tokens after mixing.
WEIGHTS = {"quality=1 toxic=0": 0.90, "quality=0 toxic=0": 0.02, "quality=1 toxic=1": 0.07, "quality=0 toxic=1": 0.01}

#: Documents of this domain are kept whole: its target is a little above what there is.
LIFT = {"quality=1 toxic=0": 1.1}


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns in one struct, so that no operator's column meets theirs."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest).alias("__rest") if rest else F.lit(None).alias("__rest"))


def _unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col(c) if c in ("doc_id", "text") else F.col("__rest")[c].alias(c) for c in columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = quality.fit_rules(docs, table(spark, sf_dir, "labels"))
    return few(_unpacked(quality.judge_quality(_packed(docs), rules).filter("kept"), docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: no letter, or too far from every language that was learned."""
    return few(_unpacked(langid.identify(_packed(docs), langid.fit_centroids(docs)).filter("not rejected"), docs.columns))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts stays, whatever its id.

    The key of a row is its id (null ids last) and a digest of its text; of each group the row with
    the least key stays, and of rows with one key one. Rows without words are groups of their own
    and all stay. Texts are shuffled once, by key, when the rows that stay are chosen.
    """
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    number = F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType))
    key = F.struct(F.col("doc_id").isNull().alias("none"), number.alias("id"), F.unhex(F.sha2("text", 256)).alias("digest"))
    keyed = docs.filter(worded).withColumn("__key", key)
    found = jaccard.similar_documents(keyed.select("__key", "text"), doc_id="__key")
    keep = found.select(F.col("class_id").alias("__key")).distinct()
    kept = keyed.join(keep, "__key", "left_semi").dropDuplicates(["__key"])
    return few(kept.select(*docs.columns).unionByName(docs.filter(~worded)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its rate says: whole copies, the fraction by a hash of its id."""
    model, mix, _ = mixing.mix_rates(docs, table(spark, sf_dir, "labels"), label_domain(), WEIGHTS, lift=LIFT)
    rows = mixing.score_domains(_packed(docs), model)
    rows = rows.select("doc_id", "text", "__rest", mixing.copies(mix.rate("posterior"), "doc_id").alias("__copies"))
    return few(_unpacked(rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies")))), docs.columns))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether they decode to it."""
    coded = bpe.bpe_round_trip(docs.select("doc_id", "text"), _tokenizer("byte_bpe_50k.json"))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return few(coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", same.alias("round_trip")))


STAGES = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("n-gram jaccard join", jaccard_join),
    ("mixing", mix_sources),
    ("bpe", bpe_tokens),
]

#: Learned rules, centroids and rates are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
