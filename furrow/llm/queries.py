"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    block_topk, bpe_prefix, collocations, host_paths, line_crf, periodic_runs, perspectives, raking, sentence_spans, shingle_join,
    spot_signatures, suffix_dedup, toxicity,
)
from .arrow import own_names

RANKS = "byte_bpe_50k.tiktoken"

def op1_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pairs = spot_signatures.with_next(spark, docs).withColumn("edited", spot_signatures.edited(F.col("text"), F.col("next_text")))
    done = pairs.withColumn("edited_found", spot_signatures.signatures(F.col("edited")))
    return done.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        spot_signatures.fingerprint(F.col("found")).alias("fingerprint"),
        spot_signatures.fingerprint(F.col("edited_found")).alias("edited_fingerprint"),
        F.round(spot_signatures.likeness(F.col("found"), F.col("edited_found")), 9).alias("near_edited"),
        F.round(spot_signatures.likeness(F.col("found"), F.col("next_found")), 9).alias("near_next"),
    )


#: Target token shares. Sources are levelled; the rest of a dimension goes to its other values.
MIX = {
    "source": {f"src{i}": 0.05 for i in range(20)},
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15},
    "topic": {str(i): 0.05 for i in range(10)},
}
RATE = 0.5


def with_topic(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add the topic, in place of a column so named: the label of the document's vector, as text; null without one."""
    (vec,) = own_names("vec")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    topics = vectors.where("vec_id is not null").groupBy(F.col("vec_id").alias(vec)).agg(F.min("label").cast("string").alias("topic"))
    return docs.drop("topic").join(topics, F.col("doc_id") == F.col(vec), "left").drop(vec)


def token_count(text: str) -> F.Column:
    """White-space words of a text."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def op2_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", token_count("text").alias("tokens"))
    mixed = raking.mix(with_topic(docs, spark, sf_dir), MIX, RATE, bounded=False)  # as its SQL has it
    return mixed.withColumns({c: F.round(c, 6) for c in ("weight", "probability")})


OP2_SQL = f"""
SELECT doc_id, source, lang, tokens, topic, round(weight, 6) AS weight, round(probability, 6) AS probability, kept FROM (
{raking.sql("""SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens, topic
 FROM documents LEFT JOIN (SELECT vec_id, min(label)::VARCHAR AS topic FROM embeddings GROUP BY vec_id) ON doc_id = vec_id""", MIX, RATE)})"""


def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~_held_out())
    field = line_crf.train(docs, labels)
    return line_crf.score(docs, field).select(
        "doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op5_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return host_paths.extract(pages).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )


def op6_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = bpe_prefix.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.component_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sentence_spans.dedup(docs).select("doc_id", "n_sentences", "n_removed", "text")


def op10_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    lexicon = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out))
    return toxicity.score(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.col("doc_id").cast("string"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.when(crc % 10 == 0, F.expr("crc32(cast(doc_id AS string)) div 10")).alias("g"))
    done = periodic_runs.periodic_runs(docs, planted="g")
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("x"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length"))))
    told = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return done.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(told, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.first_phrases(collocations.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {f.__name__: f for f in [op1_spot_signatures, op2_raking, op3_line_crf, op4_perspectives, op5_host_paths, op6_bpe_prefix, op7_shingle_join, op8_suffix_dedup, op9_sentence_spans, op10_block_topk, op11_toxicity, op12_periodic_runs, op13_collocations]}
ORACLE: dict[str, str] = {"op1_spot_signatures": spot_signatures.sql(), "op2_raking": OP2_SQL, "op4_perspectives": perspectives.sql(), "op7_shingle_join": shingle_join.sql(), "op9_sentence_spans": sentence_spans.sql(), "op10_block_topk": block_topk.sql(), "op13_collocations": collocations.sql()}
