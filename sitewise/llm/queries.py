"""The queries of the corpus operators and what SQL can say about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, jaccard, langid, mixing, quality, sharding, tokenfile, toxicity, urls
from .common import fold, shared_path, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0)
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "saved")


#: Domains are the combinations of the two labels; weights are shares of expected tokens.
WEIGHTS = {"quality=1 toxic=0": 0.90, "quality=0 toxic=0": 0.07, "quality=1 toxic=1": 0.02, "quality=0 toxic=1": 0.01}


def label_domain():
    return F.when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), F.format_string("quality=%d toxic=%d", "quality", "toxic"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model, mix, scored = mixing.mix_rates(docs, labels, label_domain(), WEIGHTS)
    rows = scored.withColumn("rate", mix.rate("posterior"))
    best = F.get(F.lit(model.domains), (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int"))
    return rows.select("doc_id", "n_tokens", best.alias("domain"), "posterior", "rate", mixing.copies(F.col("rate"), "doc_id").alias("copies"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "tokens")
    manifest = tokenfile.write_token_files(table(spark, sf_dir, "documents"), folder, _tokenizer("word_bpe_49k.json"), end_id=2)
    return tokenfile.read_token_files(spark, manifest)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_centroids(docs.filter(fold("doc_id", 4) != 2))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit_rules(docs, table(spark, sf_dir, "labels"))
    judged = quality.judge_quality(docs.select("doc_id", "text"), rules)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule_no")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(f"('{x}')" for x in urls.LISTED)
    return urls.judge_urls(table(spark, sf_dir, "pages"), spark.sql(f"SELECT key FROM VALUES {rows} AS t(key)"))


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = audio.text_to_audio(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    stored = media.withColumns({"media_bytes": F.octet_length("media").cast("bigint"), "media_sha256": F.sha2("media", 256)})
    read = audio.read_audio(stored)
    info = F.col("info")
    note = info["tags"]["TXXX:payload"]
    read = read.withColumns({"n_bytes": F.substring_index(note, ";", -1).cast("bigint"), "payload_bytes": F.substring_index(note, ";", 1).cast("bigint")})
    read = read.withColumn("payload", F.substring(info["body"], F.lit(1), F.col("payload_bytes").cast("int")))
    feature = F.format_string(
        "mpeg%s layer%d %dHz %dch frames=%d/%d samples=%d us=%d crc=%d/%d skipped=%d seek=%08x", info["version"], info["layer"], info["rate"],
        info["channels"], info["frames"], info["table_frames"], info["samples"], info["duration_us"], info["crc_good"], info["crc_good"] + info["crc_bad"],
        info["skipped"], F.crc32(F.array_join(info["offsets"].cast("array<string>"), ",").cast("binary")),
    )
    return read.select(
        "doc_id", "n_bytes", "payload_bytes", F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), (F.col("payload_bytes") - 63).cast("int"), F.lit(64))).alias("tail_crc32"),
        "media_bytes", "media_sha256", feature.alias("feature"),
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.bpe_round_trip(docs, _tokenizer("byte_bpe_50k.json"))
    return coded.select("doc_id", *(c.alias(k) for k, c in bpe.digests(coded).items()))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_token_files": op3_token_files,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_sharding": op6_sharding,
    "op7_url_filter": op7_url_filter,
    "op8_mpeg_audio": op8_mpeg_audio,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_jaccard_join": op10_jaccard_join,
}


_LISTED = ", ".join(f"'{x}'" for x in urls.LISTED)

ORACLE = {
    "op7_url_filter": f"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM u
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM h
), l AS (
  SELECT *, len(list_filter(['.' || x FOR x IN [{_LISTED}]], lambda x: ends_with('.' || host, x))) > 0 AS listed,
    CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM l
""",
}
