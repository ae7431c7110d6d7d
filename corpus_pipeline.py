"""A corpus pipeline of five operators; each stage works on all that the one before it kept.

1. quality: documents that the line CRF scores under 0.5 go.
2. near_duplicates: of each group of documents with similar 5-word shingle sets the one of smallest id stays, and of it
   one row. Rows of one text and id are one document, and rows of one text without an id too, which come after all ids;
   rows of one id with other texts are documents of their own.
3. substrings: bytes covered by a repeated 200-byte string go from the texts; characters cut in two go whole, and a
   document of which nothing is left goes. All places of the string go, the first too: no copy of a passage that several
   documents share stays in the corpus, nor a document that lies whole in a longer one.
4. mixture: documents are sampled by calibrated probabilities, so that expected tokens meet the target shares of sources,
   languages and topics; categories with too few tokens are taken whole, and shares off their targets are logged.
5. tokens: texts become token ids.

All stages but the last return the columns of ``documents``; ``n_chars`` follows the text.

Stages send rows to Python workers in batches of some ``SENT`` bytes. They set that for the session, as a stage's rows
are computed when its result is written; ``run`` puts the caller's setting back.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.joins import parted
from furrow.lineage import cut, discard
from furrow.llm import bpe_prefix, line_crf, queries, raking, shingle_join, suffix_dedup
from furrow.llm.arrow import own_names

#: Bytes of a batch. At Spark's 64 MB most partitions of texts are one batch, which the JVM and the worker hold whole.
BATCH, SENT = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_batches(stage: Stage) -> Stage:
    """The stage, for a session whose batches are small."""

    @wraps(stage)
    def made(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH, SENT)
        return stage(spark, docs, sf_dir)

    return made


@in_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more stay, row by row; a null text scores as an empty one. Columns are kept as they are."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = line_crf.train(docs, labels)
    (score,) = own_names("score")
    return line_crf.score(docs, field, out=score).where(F.col(score) >= 0.5).select(*docs.columns)


def _own_id() -> Column:
    """A number for each id and text, in the order of the ids; texts without an id come last."""
    body = F.coalesce("text", F.lit(""))
    digits = [F.pmod(F.xxhash64(body, F.lit(seed)), F.lit(10**18)).cast("decimal(18,0)") for seed in (0, 7)]
    unit = F.lit(Decimal(10**18))
    numbered = F.col("doc_id").cast("decimal(19,0)") * unit + digits[0]
    return F.coalesce(numbered, F.lit(Decimal(10**37)) + digits[0] * unit + digits[1]).cast("decimal(38,0)")


@in_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays. Null and empty texts are like nothing: one row of each id stays. Columns are kept as they are."""
    (own,) = own_names("own")
    numbered = docs.withColumn(own, _own_id())
    found = shingle_join.component_ids(numbered, doc_id=own).groupBy("doc_id").agg(F.count("*").alias("many"), F.min("component_id").alias("first"))
    several = cut(found.where("first <> doc_id or many > 1").withColumnRenamed("doc_id", own))
    repeated = cut(several.where((F.col("first") == F.col(own)) & (F.col("many") > 1)).select(own))  # mostly few: then no text moves for them
    asked, apart = parted(numbered, own, several)
    alone = apart.unionByName(asked.join(several.select(own), own, "left_anti")).select(*docs.columns)
    one = numbered.join(repeated, own, "left_semi").groupBy(own).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return alone.unionByName(one)


@in_batches
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text was empty or null stay, with an empty text. Columns but text and n_chars are kept as they are."""
    (gone,) = own_names("n_removed")
    kept = suffix_dedup.dedup_text(docs, out=gone)
    left = kept.where((F.col("text") != "") | (F.col(gone) == 0))
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


@in_batches
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the rows; those without words, language, source or topic fall in the rest of each. Columns are kept as they are."""
    (row,) = own_names("row")
    cells = ["doc_id", "source", "lang"]
    sized = docs.select(*cells, queries.token_count("text").alias("tokens"), F.struct(*docs.columns).alias(row))
    return raking.mix(queries.with_topic(sized, spark, sf_dir), queries.MIX, queries.RATE).where("kept").select(f"{row}.*")


@in_batches
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of token ids for each row; a null text has none."""
    ids = bpe_prefix.encode(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN)
    return ids.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: A fitted model and byte-pair encoding are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again."""
    docs, callers = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(BATCH, None)
    try:
        for _, stage in STAGES:
            before, docs = docs, cut(stage(spark, docs, sf_dir))
            discard(before)
    finally:
        spark.conf.unset(BATCH) if callers is None else spark.conf.set(BATCH, callers)
    return docs
