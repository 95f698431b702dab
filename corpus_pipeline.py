"""From raw documents to token ids: quality rules, line deduplication, near deduplication, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, lines, mixing, near, quality
from ledgerloom.llm.common import shared_path
from ledgerloom.llm.queries import BPE_FILE

#: A clean document may be short: here only wordless ones fail for their length.
LEAST_WORDS = 1
#: What a text with a word in it has.
WORD = r"[^ \t\n\x0B\f\r]"
#: Share of the tokens that goes on, by weight; sources that hold less than their share give it to their siblings.
MIX_PERCENT = 90
MIX_WEIGHTS = {"lang": {"en": 6, "de": 2, "fr": 2, "es": 2}}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their language's and source's thresholds go."""
    return quality.keep_good(docs, quality.Rules(least_words=LEAST_WORDS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, in every document. n_chars follows the text.

    Documents that lose all their words go, and whole copies of an earlier text too: what is left of those are short lines.
    """
    out = lines.dedup_lines(docs, counts=True)
    text = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").groupBy(F.xxhash64(F.lit(1), "text").alias("h"), F.xxhash64(F.lit(2), "text").alias("g"))
    first = text.agg(F.min("doc_id").alias("_first")).select("_first").distinct()
    worded = F.coalesce("text", F.lit("")).rlike(WORD)
    stays = F.when(worded, F.col("_first").isNotNull() | F.col("doc_id").isNull()).otherwise(F.col("n_removed") == 0)
    out = out.join(first, F.col("doc_id") == F.col("_first"), "left").where(stays).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 80 percent of their five-word shingles, the smallest id stays."""
    return near.drop_near(docs, near.Near(width=5))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken up to their leaf's token budget."""
    return mixing.mix(docs, MIX_WEIGHTS, part_percent=MIX_PERCENT, epochs=1)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256."""
    return bpe.encode_documents(docs, BPE_FILE, ids=True, digests=True)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mix_sources), ("encoding", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
