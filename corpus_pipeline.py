"""The corpus pipeline: from raw documents to a training mix, in five stages.

Each stage takes what its predecessor kept, whole, and is written as Parquet before the next one reads it. All but the last
return the columns of `documents`. An empty table passes through every stage; other cases are those of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.config import materialize
from corpuscle.llm import decontaminate, langid, line_dedup, mixing, shingle_dedup, simhash

# Less than this share of its n-grams in any one language, a text is in no language that was learned.
LEAST_LANGUAGE_SCORE = 0.2
# Words of a shingle of the sets that are compared whole; fingerprints have their own.
SHINGLE = 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach."""
    found = langid.identify(docs)
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document or line has; those left without a word go."""
    out = line_dedup.dedup(docs, drop_emptied=True)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are the smallest id of their group: linked by fingerprints, or by shingle sets that overlap by 0.8.

    Both kinds of links see the whole input, and a group follows them in any mixture.
    """
    docs = shingle_dedup.one_each(docs)
    near = simhash.groups(docs).filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    return shingle_dedup.keep_first(docs, SHINGLE, materialize(near, "simhash-links")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight: a row per drawn copy, with its shard and its place there."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

# The stages learn filters, hash and tile; SQL cannot say them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
